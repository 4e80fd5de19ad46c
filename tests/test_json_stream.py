"""One JSON document over many ranges: equal to Python's reader, whatever is cut where."""

import hashlib
import json
import random

import pytest

from loomgraph.operators import audit
from loomgraph.sources import json_stream
from tests.test_normalizers import document


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def read(spark, folder, raw):
    path = folder / f"{hashlib.md5(raw).hexdigest()}.json"
    path.write_bytes(raw)
    return json_stream.read(spark, f"file://{path}", ("nodes", "edges"))


def told(got):
    """What read gives, in plain terms."""
    lists = {}
    for r in got.items.selectExpr("list", "i", "to_json(v) as v").collect():
        lists.setdefault(r["list"], {})[r["i"]] = json.loads(r["v"])
    return {k: [v[i] for i in range(len(v))] for k, v in lists.items()}, {r["name"]: json.loads(r["body"]) for r in got.members.collect()}


def made(rng, n):
    text = lambda: rng.choice(["", "a,b", 'quote " and, comma', "back\\slash", "\\", '\\"', "é,ü", "[{", "}],", "🙂", "line\nbreak", "x" * rng.randint(0, 900)])
    value = lambda: rng.choice([None, True, 1, -2.5, text(), [], {}, [1, [2, text()]], {"k,": text(), "l": {"m": [text()]}}])
    out = {"schema_version": 2, text() + "odd": value()}
    out["nodes"] = [value() for _ in range(n)]
    out["other"] = {"deep": [value() for _ in range(rng.randint(0, 5))], "t": text()}
    out["edges"] = [value() for _ in range(rng.randint(0, n))]
    out["more"] = [value() for _ in range(rng.randint(0, 5))]
    return out


@pytest.mark.parametrize("seed,indent", [(2, 2), (3, None)])
def test_equals_pythons_reader(small_ranges, tmp_path, seed, indent):
    rng = random.Random(seed)
    doc = made(rng, rng.choice([0, 1, 40]) if seed != 3 else 40)
    raw = json.dumps(doc, indent=indent, ensure_ascii=seed % 2 == 0).encode()
    got = read(small_ranges, tmp_path, raw)
    assert (got.sha, got.why) == (hashlib.sha256(raw).hexdigest(), None)
    lists, members = told(got)
    for name in ("nodes", "edges"):
        assert lists.get(name, []) == doc[name]
    want = {k: ([0] if k in ("nodes", "edges") and v else [] if isinstance(v, list) else {} if isinstance(v, dict) else v) for k, v in doc.items()}
    assert members == want


BAD = [
    b'{"nodes": [1, 2}', b'{"nodes": [1,, 2]}', b'{"nodes": [1 2]}', b'{"nodes": [1]}, {}', b'{"nodes": [1]} x', b'{"nodes": [1],}', b'{"a": "open}', b"", b'{"a": {"b": 1, 2}}', b'{"a": [1, "b": 2]}', b'{"nodes": [1] [2]}', b'{"a": 1},', b'\xef\xbb\xbf{"a": 1}',
]


@pytest.mark.parametrize("raw", BAD)
def test_what_is_no_json(spark, tmp_path, raw):
    with pytest.raises(ValueError):
        json.loads(raw.decode())
    got = read(spark, tmp_path, raw)
    assert (got.sha, got.why) == (hashlib.sha256(raw).hexdigest(), "not JSON")


def test_other_documents(spark, tmp_path):
    assert read(spark, tmp_path, b'{"a": "\xff"}').why == "not UTF-8"
    for raw, want in ((b"[1, 2]", [1, 2]), (b'"text"', "text"), (b"null", None), (b" {} ", {}), (b'{"nodes": [], "edges": [ ]}\n', {"nodes": [], "edges": []})):
        got = read(spark, tmp_path, raw)
        assert got.why is None
        members = told(got)[1]
        assert members == (want if isinstance(want, dict) else {None: want})
    twice = read(spark, tmp_path, b'{"nodes": [1, 2], "x": 1, "nodes": [{"a": 1, "a": 2}, 3], "x": 2}')
    assert told(twice) == ({"nodes": [{"a": 2}, 3]}, {"nodes": [0], "x": 2})


@pytest.mark.parametrize("changes", [{"language": lambda v: 5, "nodes": lambda v: [*v, {"id": 5}, {**v[0], "kind": "widget"}]}, {"edges": lambda v: [*v, v[0], 7] * 30, "modules": lambda v: {"a": [1, 2]}}])
def test_the_audit_of_a_file_equals_that_of_its_text(small_ranges, tmp_path, changes):
    spark, doc = small_ranges, document(**changes)
    raw = json.dumps(doc, indent=1)
    (tmp_path / "g.json").write_text(raw)
    head, items = audit.read_graph(spark, f"file://{tmp_path}/g.json")
    a, told_a = audit.verify(head, items=items)
    b, told_b = audit.verify(audit.from_text(spark.createDataFrame([(raw,)], "text string")))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert told_a == told_b


def test_a_document_of_many_megabytes_is_split(spark, tmp_path):
    n = 300_000
    with open(tmp_path / "g.json", "w") as f:
        f.write('{"schema_version":2,"nodes":[')
        f.write(",".join(f'{{"id":"n{k}","doc":"{"words, and more, " * 8}"}}' for k in range(n)))
        f.write("]}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        got = json_stream.read(spark, f"file://{tmp_path}/g.json", ("nodes",))
        assert got.why is None and json_stream._records(spark, f"file://{tmp_path}/g.json").rdd.getNumPartitions() > 8
        assert got.items.selectExpr("count(*)", "count(distinct i)", "max(i)", "sum(cast(substring(variant_get(v, '$.id', 'string'), 2) as bigint) - i)").first()[:] == (n, n, n - 1, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
