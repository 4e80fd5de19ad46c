"""Queries over whole tables against plain Python on small tables."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import dictionary, graph, survey
from loomgraph.plans import queries as core
from loomgraph.plans import dictionary_queries, evidence_queries, graph_queries, rule_queries, survey_queries  # noqa: F401
from loomgraph.session import shared_dir


def joined_rows(df):
    """Rows that the joins of a collected DataFrame made."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
            if "Join" in p.nodeName():
                out.append(p.metrics().apply("numOutputRows").value())
    return out


def test_box_overlaps_takes_every_vector(spark, tmp_path):
    rng = random.Random(4)
    boxes = [(k, [rng.random() / 2, rng.random() / 2]) for k in range(0, 600, 3)]
    spark.createDataFrame(boxes, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    held = {r["vec_id"]: [v * 100 for v in r["embedding"]] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    want = {(a, b) for a, p in held.items() for b, q in held.items() if a < b and abs(p[0] - q[0]) < 4 and abs(p[1] - q[1]) < 4}
    got = [(r["a"], r["b"]) for r in core.QUERIES["box_overlaps"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(b >= 200 for _, b in want)


CUTS = ("occurrences > 1", "batch IN ('b1'", "p_brand < '", "vec_id <", "p_partkey <", "len(p) <")


def test_queries_cut_nothing():
    assert not [n for n in core.QUERIES if n.endswith("_whole")]
    assert not [(n, c) for n, sql in core.ORACLES.items() for c in CUTS if c in sql]


def test_edges_seen_once_count(spark, data):
    got = [r["occurrences"] for r in core.QUERIES["first_party_edges"](spark, data).collect()]
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count() + spark.read.parquet(f"{data}/supplier.parquet").count()
    assert sum(got) == lines and 1 in got


def test_shared_by_all_asks_every_brand(spark, tmp_path):
    parts = [(f"Brand#{b}", t) for b in (11, 12, 13, 55) for t in ("everywhere", "not in the last") if (b, t) != (55, "not in the last")]
    spark.createDataFrame(parts, "p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert [r["item"] for r in core.QUERIES["shared_by_all"](spark, str(tmp_path)).collect()] == ["everywhere"]


def test_one_edge_is_enough_for_the_blast_radius(spark, tmp_path):
    tables = {
        "region": ([(1, "ASIA")], "r_regionkey bigint, r_name string"),
        "nation": ([(1, "CHINA", 1)], "n_nationkey bigint, n_name string, n_regionkey bigint"),
        "supplier": ([(1, "s", 1)], "s_suppkey bigint, s_name string, s_nationkey bigint"),
        "part": ([(k, "p", 1, f"Brand#{k}", "t") for k in (1, 2)], "p_partkey bigint, p_name string, p_size int, p_brand string, p_type string"),
        "lineitem": ([(1, 1, 2, 1, 1.0, 1.0, 0.0, 0.0, "A", "O", "1995-01-01")], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"),
    }
    for name, (held, shape) in tables.items():
        spark.createDataFrame(held, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(r["file"] for r in core.QUERIES["blast_radius"](spark, str(tmp_path)).collect()) == ["ASIA/CHINA", "Brand#11/none", "Brand#2/t"]


def test_simple_cycles_of_any_length(spark):
    pairs = [(k, (k + 1) % 9) for k in range(9)] + [(4, 2), (7, 0), (20, 21), (21, 22), (8, 20), (3, 3)]
    found = set()

    def walk(path):
        for a, b in pairs:
            if a == path[-1] and a != b:
                if b == path[0]:
                    found.add(tuple(path))
                elif b > path[0] and b not in path:
                    walk([*path, b])

    for k in range(23):
        walk([k])
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = [tuple(r["path"]) for r in graph.simple_cycles(edges).collect()]
    assert sorted(got) == sorted(found) and max(map(len, got)) == 9
    assert sorted(tuple(r["path"]) for r in graph.simple_cycles(edges, 3).collect()) == sorted(c for c in found if len(c) <= 3)


def test_paths_go_only_where_they_can_close(spark):
    # 1 and 2 are a cycle; from 2 leads a dense mesh without cycles of its own, whose end leads to 0 and so to 1 again
    mesh = [(a, b) for a in range(10, 16) for b in range(a + 1, 16)]
    pairs = [(1, 2), (2, 1), (2, 10), (15, 0), (0, 1), *mesh]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    told = sorted(tuple(r) for r in graph.ways_back(links).collect())
    # over nodes greater than 1 nothing of the mesh leads to 1; over nodes greater than 0 all does
    assert [t for t in told if t[0] == 1] == [(1, 2, 1)] and {t[1] for t in told if t[0] == 0} == {1, 2, *range(10, 16)}
    assert not [t for t in told if t[0] > 1] and (0, 15, 1) in told and (0, 10, 2) in told and (0, 1, 4) in told
    got = [tuple(r["path"]) for r in graph.simple_cycles(links).collect()]
    assert len(got) == len(set(got)) == 1 + 2**4 and (1, 2) in got
    assert sorted(tuple(r["path"]) for r in graph.simple_cycles(links, 5).collect()) == [(0, 1, 2, 10, 15), (1, 2)]


def test_simple_cycles_of_random_graphs(spark):
    import random

    for seed in range(1):
        rnd = random.Random(seed)
        pairs = sorted({(rnd.randrange(9), rnd.randrange(9)) for _ in range(20)})
        found = []

        def walk(path):
            for a, b in pairs:
                if a == path[-1] and b >= path[0] and a != b:
                    if b == path[0]:
                        found.append(tuple(path))
                    elif b not in path:
                        walk([*path, b])

        for k in range(9):
            walk([k])
        edges = spark.createDataFrame([*pairs, *pairs[:3]], "a bigint, b bigint")
        assert sorted(tuple(r["path"]) for r in graph.simple_cycles(edges).collect()) == sorted(found)
        assert sorted(tuple(r["path"]) for r in graph.simple_cycles(edges, 4).collect()) == sorted(c for c in found if len(c) <= 4)


def test_seal_problems_judges_every_kind(spark, data):
    keys = [r["c_custkey"] for r in spark.read.parquet(f"{data}/customer.parquet").select("c_custkey").collect()]
    got = [r["path"] for r in core.QUERIES["seal_problems"](spark, data).filter("kind = 'terms'").collect()]
    assert sorted(got) == sorted(f"terms.json{k}" for k in keys if k % 3 == 0 and k % 5 != 0)


def test_resolved_paths_takes_repeated_tokens_once(spark):
    # 2000 rows of a token and as many of its path: their pairs, 4 million, never end up as rows
    again = spark.range(2000)
    tokens = again.select(F.lit("n").alias("token")).unionByName(spark.createDataFrame([("only",), ("twice",), ("none",), (None,)], "token string"))
    listing = again.select(F.lit("x/n").alias("path")).unionByName(spark.createDataFrame([("a/n",), ("q/only",), ("q/twice",), ("q/twice",)], "path string"))
    df = survey.resolve_paths(tokens, listing, ["a", "x"])
    assert sorted(map(tuple, df.collect()), key=repr) == [("n", "a/n"), ("none", None), ("only", "q/only"), ("twice", None), (None, None)]
    assert max(joined_rows(df)) <= 10


def ring_graph(spark, names):
    """Nodes, edges and modules of a ring of so many names."""
    ids = spark.range(names)
    nodes = ids.select(F.col("id").alias("ord"), F.concat(F.lit("P"), "id").alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.lit("class").alias("kind"), F.concat(F.lit("m"), F.col("id") % 3).alias("module"), F.lit("f.h").alias("file"), F.lit(1).alias("line"))
    edges = ids.select(F.col("id").alias("ord"), F.concat(F.lit("P"), "id").alias("src"), F.concat(F.lit("P"), (F.col("id") + 1) % names).alias("dst"), F.lit("dependency").alias("kind"), F.lit("l").alias("label"), F.lit("e.h").alias("file"), F.lit(2).alias("line"))
    modules = spark.createDataFrame([(f"m{k}", []) for k in range(3)], "id string, depends_on array<string>")
    return nodes, edges, modules


@pytest.fixture
def small_broadcasts(spark):
    """A limit that a broadcast of 60,000 records breaks."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_projected_edges_of_many_names(spark, small_broadcasts):
    shown = dictionary.project(*dictionary.build(*ring_graph(spark, 60000)))[1]
    assert [tuple(r) for r in shown.agg(F.count("*"), F.sum("occurrences"), F.countDistinct("src"), F.countDistinct("dst"), F.max("line")).collect()] == [(60000, 60000, 60000, 60000, 2)]


def test_projected_modules_of_many_names(spark, small_broadcasts):
    listed = dictionary.project(*dictionary.build(*ring_graph(spark, 60000)))[2]
    assert sorted((r["id"], r["depends_on"]) for r in listed.collect()) == [("m0", ["m1"]), ("m1", ["m2"]), ("m2", ["m0"])]


def test_projected_modules_stores_names_and_no_uses(spark, data):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    dictionary_queries.projected_modules(spark, data).collect()
    stored = [spark.read.parquet(str(p)).count() for p in set(folder.iterdir()) - before]
    names = sum(spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("part", "supplier"))
    assert stored and sum(stored) <= 2 * names < spark.read.parquet(f"{data}/lineitem.parquet").count()


def test_projected_modules_of_a_random_graph(spark):
    rnd = random.Random(3)
    rows = [(k, f"I{rnd.randrange(45)}", rnd.choice(["", None, *(f"n{j}" for j in range(30))]), rnd.choice(["class", "external", "concept", None]), rnd.choice(["", None, "a", "b", "c", "d", "e"]), None, None) for k in range(60)]
    links = [(k, f"I{rnd.randrange(50)}", f"I{rnd.randrange(50)}", "dependency", None, None, None) for k in range(80)]
    nodes = spark.createDataFrame(rows, "ord bigint, id string, name string, kind string, module string, file string, line int")
    edges = spark.createDataFrame(links, "ord bigint, src string, dst string, kind string, label string, file string, line int")
    modules = spark.createDataFrame([("a", ["b"]), ("z", [])], "id string, depends_on array<string>")
    by_name = {r[2]: (r[3] or "type", r[4] or "") for r in rows if r[2]}
    own = {n: x for n, x in by_name.items() if x[0] != "concept" and x[1]}
    by_id = {i: max((r[0], r[2]) for r in rows if r[1] == i and r[2] is not None)[1] for i in {r[1] for r in rows if r[2] is not None}}
    want = {x[1]: set() for x in own.values() if x[0] != "external"}
    for s, t in ((by_id.get(r[1]), by_id.get(r[2])) for r in links):
        if s in own and t in own and own[t][0] != "external" and own[s][1] != own[t][1] and own[s][1] in want:
            want[own[s][1]].add(own[t][1])
    got = dictionary.project(*dictionary.build(nodes, edges, modules))[2].collect()
    assert sorted((r["id"], r["depends_on"]) for r in got) == sorted((m, sorted(x)) for m, x in want.items())
    assert any(want.values())
