"""Batches, manifests, gates, resumes, stage plans, labels."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import batches, evidence, facts, ordered, terms
from loomgraph.plans import stages
from loomgraph.sources import sinks


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def table(spark, held, shape):
    return spark.createDataFrame(held, shape)


@pytest.fixture(scope="module")
def code(spark):
    nodes = table(spark, [("a", "A", "class", "x.py", 1, None), ("b", "B", "class", "x.py", 2, "interface"), ("c", "_C", "class", "y.py", 3, "abstract"), ("d", "D", "class", None, None, None), ("e", "E", "class", "z.py", 1, None), ("x", "lib", "external", None, None, None)], "id string, name string, kind string, file string, line int, abstraction string")
    edges = table(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("a", "x"), ("d", "a"), ("e", "c"), ("e", "a")], "src string, dst string")
    return nodes, edges


def test_layered_plans(spark, code):
    plan = batches.layered(*code, target=2)
    assert rows(plan, "id", "level", "batch_id", "file", "in_cycle", "depends_on") == [("a", 1, "L1-B00", "x.py", False, ["b"]), ("b", 0, "L0-B00", "x.py", True, ["c"]), ("c", 0, "L0-B00", "y.py", True, ["b"]), ("d", 2, "L2-B00", None, False, ["a"]), ("e", 2, "L2-B00", "z.py", False, ["a", "c"])]
    part = batches.layered(*code, target=1, only_files=table(spark, [("x.py",)], "file string"))
    assert rows(part, "id", "batch_id") == [("a", "L1-B00"), ("b", "L0-B00")]
    assert rows(batches.batch_ids(plan)) == [("L0-B00",), ("L1-B00",), ("L2-B00",), ("NONNODE",)] and rows(batches.files(plan)) == [("x.py",), ("y.py",), ("z.py",)] and ("c", "_C") in rows(batches.names(plan))
    assert [r[0] for r in batches.summary_lines(batches.summary(plan)).collect()][:2] == ["5 symbols, 3 files, 3 batches, 2 in cycles", "level 0: 2 symbols, 2 files, 1 batches"]


def test_plans_by_file(code):
    from loomgraph.operators import graph

    weights = {r["file"]: r for r in graph.file_weights(*code).collect()}
    # x: out b->c; into c->b, e->a.  y: out c->b; into to _C doesn't count.  z: out two
    assert {f: (r["out_edges"], r["into_edges"], r["interfaces"], r["abstracts"]) for f, r in weights.items()} == {"x.py": (1, 2, 1, 0), "y.py": (1, 0, 0, 1), "z.py": (2, 0, 0, 0)}
    assert [round(weights[f]["weight"], 6) for f in ("x.py", "y.py", "z.py")] == [2.5, 1.1, 0.0]
    plan = batches.by_file(*code)
    assert rows(plan, "batch_id", "id", "in_cycle") == [("F00", "a", False), ("F00", "b", True), ("F01", "c", True), ("F02", "e", False)]


def test_hashes_and_manifests(spark, tmp_path):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x")
    present = evidence.read_hashes(spark, f"file://{tmp_path}", str(tmp_path))
    assert rows(present) == [("d/a.py", sha("x"))]
    cited = table(spark, [("d/a.py",), ("b.py",)], "path string")
    hashes = evidence.source_hashes(cited, present)
    want = sha(f"b.py=missing\nd/a.py={sha('x')}\n")
    assert rows(evidence.digest(hashes)) == [(want,)]
    m = evidence.manifest(cited, present, "g", "griffe+pycalls", "f", "i").first()
    assert (m["sources_sha256"], m["raw_provenance"], m["generation_id"], m["sources"]) == (want, "prep", sha(f"f\ng\n{want}\ni\n"), {"b.py": "missing", "d/a.py": sha("x")})
    text = table(spark, [(evidence.manifest(cited, present, "g", "c", "f").select(F.to_json(F.struct("*"))).first()[0],)], "text string")
    assert evidence.read_manifest(text, "g").count() == 1 and evidence.read_manifest(text, "h").count() == 0 and evidence.read_manifest(table(spark, [("{}",), ("{",)], "text string"), "g").count() == 0
    held = spark.range(1).select(evidence.fingerprint(F.array(F.struct(F.lit("p.py").alias("path"), F.lit(sha("x")).alias("sha256"))), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), F.create_map(F.lit("c"), F.lit("3"))).alias("v")).first()["v"]
    assert held == hashlib.sha256(b"p.py\0" + bytes.fromhex(sha("x")) + b"a=1\0b=2\0input:c=3\0").hexdigest()
    files = table(spark, [(".clang-uml", "1"), ("build/compile_commands.json", "2"), ("x", "3")], "path string, sha256 string")
    assert len(rows(evidence.config_inputs(files, "clang-uml"))) == 2 and rows(evidence.config_inputs(files, "griffe+pycalls")) == []


def test_seals(spark):
    sources, files = table(spark, [("a.py",)], "path string"), table(spark, [("a.py", "h"), ("docs/codegraph/terms-db.json", "t"), ("docs/wiki/p.md", "w"), ("docs/wiki/x/q.md", "n")], "path string, sha256 string")
    snap = lambda h: table(spark, [("a.py", h)], "path string, file_hash string")
    why = lambda *a, **k: evidence.refusal(*a, **k)[0]
    assert why(sources, files, snap("h"), "s", "s", ("wiki",)) is None and why(sources, files, snap("old"), "s", "s", ("wiki",)) == "changed sources" and why(sources, files.limit(0), snap("h"), "s", "s", ("wiki",)) == "missing sources"
    assert why(sources, files, snap("h"), None, "s", ("wiki",)) == "wiki behind" and why(sources, files, snap("h"), None, "s", ("terms-db",)) is None and why(sources, files, snap("h"), None, "s", ("odd",)) == "no such kind"
    doc = evidence.seal(files, ("terms-db", "wiki"), "p", "c", table(spark, [("a.py", "blob")], "path string, id string"))
    assert doc["artifacts"] == {"terms-db": [{"path": "docs/codegraph/terms-db.json", "sha256": "t"}], "wiki": [{"path": "docs/wiki/p.md", "sha256": "w"}]} and doc["inputs"] == {"a.py": "blob"}
    mark = evidence.superseded(spark.range(1), "wiki", "c", F.lit("2026-01-02 03:04:05").cast("timestamp")).first()["superseded_by"]
    assert tuple(mark) == ("wiki", "2026-01-02T03:04:05+00:00", "c")
    import json

    loaded = evidence.load_manifest(table(spark, [(json.dumps(doc),), ("{",), ('{"contract":"x"}',), ('{"contract":"mode1-artifacts","version":1}',)], "text string"))
    assert [r["why"] for r in loaded.collect()] == [None, "not JSON", "another contract", "no artifacts"]


def test_gates_and_resumes(spark):
    receipt = lambda *r: table(spark, [r] if r else [], "status string, codegraph_sha256 string, generation_id string")
    lot = lambda *r: table(spark, [r] if r else [], "codegraph_sha256 string, generation_id string")
    why = lambda *a: evidence.gate(*a).first()["why"]
    assert why(receipt(), "g") == "no receipt" and why(receipt("failed", "g", "n"), "g") == "not passed" and why(receipt("passed", "h", "n"), "g") == "receipt of another graph" and why(receipt("passed", "g", "n"), "g") is None
    good = receipt("passed", "g", "n")
    assert why(good, "g", lot()) == "no batches" and why(good, "g", lot("g", "m")) == "batches of another graph" and why(good, "g", lot("g", "n")) is None
    assert why(good, "g", lot("g", "n"), lot("x", "m")) == "ranking of another collection" and why(good, "g", lot("g", "n"), lot("x", "n")) is None
    ran = table(spark, [(0, "prep", True, None, None), (1, "survey/b1", False, True, "s"), (2, "survey/b2", False, None, "boom"), (3, "check", False, None, "x")], "ord int, stage string, ok boolean, skipped boolean, why string")
    doc = evidence.resume(ran, ["prep", "warm", "survey", "check"], "cold", ["wiki", "terms-db"])
    assert rows(doc) == [("cold", "survey", "boom", ["prep", "warm"], ["terms-db", "wiki"])] and evidence.resume(ran.filter("ok"), ["prep"], "cold", []).count() == 0
    assert rows(evidence.start_stage(doc, "cold")) == [("survey", ["terms-db", "wiki"])] and evidence.start_stage(doc, "warm").count() == 0
    names, present = table(spark, [("b", 0), ("a", 1)], "path string, rank int"), table(spark, [("a",)], "path string")
    assert rows(evidence.first_present(names, present)) == [("a",)] and rows(evidence.existing(names, present)) == [("a", 1)]
    pages = table(spark, [("p", "1"), ("q", "2")], "page string, hash string")
    assert rows(evidence.record_pages(pages, table(spark, [("p", "3")], "page string, hash string"))) == [("p", "3"), ("q", "2")]
    assert rows(evidence.snapshot_hashes(table(spark, [("a", "1"), ("b", None)], "path string, file_hash string"))) == [("a", "1")]
    held = table(spark, [("s.json",)], "name string")
    assert evidence.claimed("f" * 64, "f" * 64, held, [])[1] is None and evidence.claimed("e" * 64, "f" * 64, held, ["e" * 12])[1] == "e" * 12 + "-2" and evidence.claimed("??", "f" * 64, held, [])[1] == "unstamped"


def test_stage_plans():
    assert stages.expand(["prep", "x"]) == ["collect-graph", "verify-graph", "derive-facts", "x"]
    assert stages.reading_stages(cold=True)[:3] == ["lang-hint", "lang-decide", "collect-graph"] and stages.reading_stages(only=["wiki", "warmup"]) == ["detect-changes", "outline-wiki", "write-wiki"] and "write-wiki" not in stages.reading_stages(skip=["wiki"])
    with pytest.raises(ValueError):
        stages.reading_stages(only=["nowhere"])
    assert stages.grading_stages(False, False) == ["collect"] and stages.grading_stages(True, True) == ["grade", "emit"] and stages.grading_stages(True, False, ask=True) == ["ask", "grade", "emit"] and stages.grading_stages(True, False, only=["emit"]) == ["emit"]
    assert stages.report_stages(True) == ["init", "build", "check"] and stages.report_stages(True, only=["agent"]) == ["agent"] and stages.report_stages(False, skip=["check"]) == ["init", "agent", "build"]
    assert stages.restart_from("verify-graph") == "collect-graph" and stages.restart_from("x") == "x" and stages.restart_from(None) is None
    edges = {("*", "ok"): "next", ("gate", "ok"): None}
    assert [stages.destination(edges, s, o) for s, o in (("a", "ok"), ("gate", "ok"), ("a", "fail"))] == ["next", None, None]


def test_class_labels(spark):
    members = [(f"m{k}", "int<T>", "public" if k else "private") for k in range(8)]
    df = table(spark, [("ns::Box", members, ([("run", "protected", True)], 2), True, {"m1": "owns"})], "name string, members array<struct<name:string,type:string,access:string>>, methods struct<shown:array<struct<name:string,access:string,virtual:boolean>>,more:int>, abstract boolean, notes map<string,string>")
    got = df.select(sinks.class_label(F.col("name"), F.col("members"), F.col("methods"), F.col("abstract"), F.col("notes")).alias("v")).first()["v"]
    assert got.startswith('<<TABLE BORDER="0"') and "<B>Box</B><BR/>" in got and '- m0 : <FONT COLOR="#666666">int&lt;T&gt;</FONT>' in got and '<FONT COLOR="#7030a0">owns</FONT>' in got and "m6" not in got
    assert got.count("… 외 2") == 2 and '# run() <FONT COLOR="#1f4e79">v</FONT>' in got


def test_diagrams_and_values(spark):
    text = ["<!-- graphviz: big -->", "", "```mermaid", "a", "```", "x", "y", "z", "w", "```mermaid", "b", "```", "graphviz: none", "```mermaid", "c"]
    lines = table(spark, [("d", k + 1, t) for k, t in enumerate(text)], "doc string, line int, text string")
    got = rows(ordered.diagram_blocks(lines, table(spark, [("big",)], "name string")), "number", "first", "last", "mark", "state")
    assert got == [(1, 3, 5, "big", "replaced"), (2, 10, 12, None, "to render"), (3, 14, None, "none", "to render")]
    seen = table(spark, [(0, "b"), (1, "a"), (2, "a"), (3, "c")], "ord int, value string")
    assert [tuple(r) for r in ordered.counted(seen, "value").collect()] == [("a", 2, 1), ("b", 1, 0), ("c", 1, 3)]
    assert [r["number"] for r in ordered.numbered(spark.range(1000).repartition(7), ["id"], "number").orderBy("id").collect()] == list(range(1, 1001))
    holes = spark.range(500).select("id", F.when(F.col("id") % 50 == 7, F.col("id")).alias("v")).repartition(5)
    assert [r["c"] for r in ordered.carry_down(holes, "v", "c", "id").orderBy("id").collect()] == [None if k < 7 else (k - 7) // 50 * 50 + 7 for k in range(500)]


def plain_rank(ids, weights, d=0.85, rounds=100, tol=1e-6):
    n = len(ids)
    rank, out = {i: 1 / n for i in ids}, {i: sum(w for (a, _), w in weights.items() if a == i) for i in ids}
    for _ in range(rounds):
        loose = sum(rank[i] for i in ids if not out[i])
        after = {i: (1 - d) / n + d * (loose / n + sum(rank[a] * w / out[a] for (a, b), w in weights.items() if b == i)) for i in ids}
        done = sum(abs(after[i] - rank[i]) for i in ids) < n * tol
        rank = after
        if done:
            break
    return rank


def test_class_facts(spark):
    nodes = table(spark, [(i, f"N{i}", "external" if i == "x" else "class", "m", f"{i}.py", 1) for i in "abcdx"], "id string, name string, kind string, module string, file string, line int")
    edges = table(spark, [("a", "b", "dependency", 2), ("a", "b", "association", 1), ("b", "c", "dependency", 1), ("a", "c", "dependency", 1), ("a", "x", "dependency", 4)], "src string, dst string, kind string, occurrences bigint")
    got = facts.class_rows(nodes, edges).orderBy("number").collect()
    want = plain_rank("abcd", {("a", "b"): 3, ("b", "c"): 1, ("a", "c"): 1})
    assert [r["id"] for r in got] == sorted("abcd", key=lambda i: (-round(want[i], 6), i)) and all(abs(r["pagerank"] - want[r["id"]]) < 2e-6 for r in got)
    assert {r["id"]: (r["in_deg"], r["out_deg"], r["ext_touch"], r["listed"]) for r in got} == {"a": (0, 2, 4, False), "b": (1, 1, 0, False), "c": (2, 0, 0, False), "d": (0, 0, 0, True)}
    assert rows(facts.focus(edges.select("src", "dst", "kind"), "m", nodes.filter("id = 'c'"))) == [("a", "c", "dependency"), ("b", "c", "dependency")]


def test_details_and_entry_points(spark):
    one = table(spark, [("A", [("m", "int", "public")], [("run", "public", True, ["x"])], True, 0), ("A", None, None, None, 1)], "display_name string, members array<struct<name:string,type:string,access:string>>, methods array<struct<name:string,access:string,is_pure_virtual:boolean,parameters:array<string>>>, is_abstract boolean, ord int")
    two = table(spark, [("B", None, [("go", "private", None, 2)], False, 5), ("Ext", None, None, None, 6)], "name string, members array<struct<name:string,type:string,access:string>>, methods array<struct<name:string,access:string,is_abstract:boolean,param_count:int>>, is_abstract boolean, ord int")
    got = {r["name"]: r for r in facts.details(one, two).collect()}
    assert set(got) == {"A", "B"} and got["A"]["members"] == [] and [tuple(m) for m in got["B"]["methods"]] == [("go", "private", False, 2)]
    assert [tuple(m) for m in facts.details(one.filter("ord = 0")).first()["methods"]] == [("run", "public", True, 1)]
    types = table(spark, [("B", "b.cs", 2, {"is_monobehaviour": True}), ("A", "a.cs", 1, {"is_scriptable_object": True, "is_monobehaviour": True}), ("C", "c.cs", 1, None)], "name string, file string, line int, unity map<string,boolean>")
    assert [tuple(r) for r in facts.entry_points(types).collect()] == [("asset", "A", "(a.cs:1)"), ("behaviour", "A", "(a.cs:1)"), ("behaviour", "B", "(b.cs:2)")]


def test_term_documents(spark):
    import json

    held = table(spark, [("b", "class", "B!"), ("a", "class", None)], "name string, kind string, means string")
    assert rows(terms.glossary(held, ["kind"])) == [("class", 2, "a", "a: \nb: B!")]
    used = table(spark, [("a", "b", "dependency"), ("a", "a", "dependency"), ("a", "zz", "dependency"), ("a", "b", "dependency")], "name string, to string, kind string")
    assert json.loads(terms.term_graph(held, used).first()["payload"]) == {"nodes": [{"name": "a", "kind": "class"}, {"name": "b", "kind": "class"}], "links": [{"name": "a", "to": "b", "kind": "dependency"}]}
    rules = table(spark, [("r1", 1), ("r2", 2)], "rule string, n int")
    assert rows(terms.same_rules(rules, rules)) == [] and rows(terms.same_rules(rules, rules.filter("n = 1"))) == [("r2", 2, "one")]
