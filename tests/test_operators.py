"""Semantic laws of the core operators on small literal inputs, and random graphs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import changes, graph, measure, normalize, ordered, packing, quiz, terms, verify
from loomgraph.plans.stages import Stage, run, simulate
from loomgraph.sources import readers, sinks
from loomgraph.streaming import changes as streams


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(9)
    n = 24
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(34)}
    return list(range(n)), sorted((a, b) for a, b in pairs if a != b), spark


def reach(n, pairs):
    out = {a: set() for a in n}
    for a, b in pairs:
        out[a].add(b)
    full = {}
    for a in n:
        seen, stack = set(), [a]
        while stack:
            for b in out[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        full[a] = seen
    return full


def test_random_graph_analytics(random_graph):
    n, pairs, spark = random_graph
    nodes, edges = spark.createDataFrame([(k,) for k in n], "id bigint"), spark.createDataFrame(pairs, "a bigint, b bigint")
    full = reach(n, pairs)
    scc = {a: min([b for b in full[a] if a in full[b]] + [a]) for a in n}
    assert dict(rows(graph.strong_components(nodes, edges), "id", "scc")) == scc
    level = {c: 0 for c in scc.values()}
    for _ in n:
        for a, b in pairs:
            if scc[a] != scc[b]:
                level[scc[a]] = max(level[scc[a]], level[scc[b]] + 1)
    got = {i: (lv, c) for i, lv, c in rows(graph.layers(nodes, edges), "id", "level", "in_cycle")}
    assert got == {a: (level[scc[a]], list(scc.values()).count(scc[a]) > 1) for a in n}
    assert rows(graph.cycle_edges(nodes, edges), "a", "b") == [p for p in sorted(pairs, key=repr) if scc[p[0]] == scc[p[1]]]
    both = reach(n, pairs + [(b, a) for a, b in pairs])
    assert dict(rows(graph.components(nodes, edges), "id", "component")) == {a: min(both[a] | {a}) for a in n}


def test_pagerank_matches_power_iteration(random_graph):
    n, pairs, spark = random_graph
    nodes = spark.createDataFrame([(k,) for k in n], "id bigint")
    edges = spark.createDataFrame([(a, b, float(1 + (a + b) % 3)) for a, b in pairs], "src bigint, dst bigint, weight double")
    rank = {k: 1 / len(n) for k in n}
    out = {a: sum(1 + (x + y) % 3 for x, y in pairs if x == a) for a in n}
    for _ in range(8):
        sink = sum(rank[a] for a in n if not out[a])
        rank = {b: 0.15 / len(n) + 0.85 * (sum(rank[x] * (1 + (x + y) % 3) / out[x] for x, y in pairs if y == b) + sink / len(n)) for b in n}
    got = dict(rows(graph.pagerank(nodes, edges, iterations=8), "id", "rank"))
    assert all(abs(got[k] - rank[k]) < 1e-9 for k in n) and abs(sum(got.values()) - 1) < 1e-9


def test_first_edge_keeps_its_evidence(spark):
    raw = spark.createDataFrame([("a", "b", "x", "second", 2, 2), ("a", "b", "x", "first", 1, 1), ("a", "c", "x", None, None, 3)], "src string, dst string, kind string, label string, line int, ord int")
    assert rows(graph.fold_edges(raw)) == [("a", "b", "x", "first", 1, 2), ("a", "c", "x", None, None, 1)]


def test_snapshot_verdict_order(spark):
    shape = "path string, mtime double, size bigint, file_hash string, decl_hash string"
    old = spark.createDataFrame([("same", 1.0, 1, "h", "d"), ("touched", 1.0, 1, "h", "d"), ("moved", 1.0, 1, "h", "d"), ("edited", 1.0, 1, "h", "d"), ("gone", 1.0, 1, "h", "d"), ("no_decl", 1.0, 1, "h", None)], shape)
    new = spark.createDataFrame([("same", 1.0, 1, "other", "other"), ("touched", 2.0, 1, "h", "d"), ("moved", 2.0, 1, "i", "d"), ("edited", 2.0, 1, "i", "e"), ("fresh", 1.0, 1, "h", "d"), ("no_decl", 2.0, 1, "i", None)], shape)
    got = dict(rows(changes.verdicts(old, new)))
    assert got == {"same": "unchanged", "touched": "unchanged", "moved": "location_only", "edited": "reread", "gone": "deleted", "fresh": "reread", "no_decl": "location_only"}


def test_blast_radius_keeps_unknown_seeds(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("x", None)], "id string, file string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x")], "src string, dst string")
    seeds = spark.createDataFrame([("C",), ("nowhere",)], "file string")
    assert [r[0] for r in rows(graph.blast_radius(nodes, edges, seeds, 1))] == ["B", "C", "nowhere"]
    assert [r[0] for r in rows(graph.blast_radius(nodes, edges, seeds, 2))] == ["A", "B", "C", "nowhere"]


def plain_fold(records):
    """Records (key, file, rec) in order."""
    held = {}
    for key, file, rec in records:
        if key in held and held[key][0] != file:
            old = held.pop(key)
            for f, r in (old, (file, rec)):
                stem = f.split("/")[-1].rsplit(".", 1)[0]
                held[f"{stem}.{key}" if stem else key] = (f, r)
        else:
            held[key] = (file, rec)
    return sorted((k, *v) for k, v in held.items())


def test_shards_fold_in_order(spark):
    shape = "shard string, pos int, key string, file string, rec string"
    fold = lambda held: rows(packing.merge_shards(spark.createDataFrame(held, shape)))
    two = [("s1", 0, "k", "src/A.py", "r1"), ("s2", 0, "k", "src/B.py", "r2")]
    assert fold(two) == [("A.k", "src/A.py", "r1"), ("B.k", "src/B.py", "r2")]
    assert fold([*two, ("s3", 0, "k", "C.py", "r3")]) == [("A.k", "src/A.py", "r1"), ("B.k", "src/B.py", "r2"), ("k", "C.py", "r3")]
    assert fold([("s3", 0, "m", "A", "r"), ("s4", 0, "m", "A", "again"), ("s5", 0, "m", "B", "again")]) == [("A.m", "A", "again"), ("B.m", "B", "again")]
    base = spark.createDataFrame([("k", "Z.py", "old")], "key string, file string, rec string")
    assert rows(packing.merge_shards(spark.createDataFrame(two[:1], shape), base)) == [("A.k", "src/A.py", "r1"), ("Z.k", "Z.py", "old")]
    rng = random.Random(4)
    for _ in range(3):
        held = [(f"s{k // 5}", k % 5, rng.choice("ab"), rng.choice(["x/A.py", "B.py", "C"]), f"r{rng.randint(0, 30)}") for k in range(40)]
        assert fold(held) == plain_fold([r[2:] for r in held])


def test_pack_never_splits_a_file(spark):
    members = spark.createDataFrame([(0, f, f"{f}{k}") for f, n in (("a", 2), ("b", 5), ("c", 1), ("d", 1)) for k in range(n)], "level int, file string, symbol string")
    assert {r[1]: r[3] for r in rows(packing.pack(members, 3), "level", "file", "n", "batch")} == {"a": 0, "b": 1, "c": 2, "d": 2}


def test_doc_above_stops_at_other_lines(spark):
    text = "x = 1\n# far\n\n# near\n@deco\ndef f\n# other\ny = 2\ndef g"
    lines = ordered.explode_lines(spark.createDataFrame([("p", text)], "doc string, text string").withColumnRenamed("doc", "path"), key="path")
    t = F.col("text")
    got = ordered.doc_above(lines, t.startswith("def"), t.startswith("#"), (t == "") | t.startswith("@"), key="path")
    assert rows(got, "line", "doc") == [(6, "# far # near"), (9, "")]


def test_line_counts_differ_as_defined(spark):
    texts = ["", "a", "a\n", "a\nb", "a\r\nb\x0c", "a b", "a\x1cb\x85"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = [tuple(r) for r in df.select(X.lines_by_bytes(t), X.lines_by_breaks(t), X.lines_by_split(t)).collect()]
    want = [(x.count("\n") + (x != "" and not x.endswith("\n")), len(x.splitlines()), len(x.split("\n"))) for x in texts]
    assert got == want


def test_citation_levels(spark):
    lines = spark.createDataFrame([("d", 1, "see a.py:3, b.py:9-12 and gone.py:1; a.py:0 a.py:2")], "doc string, line int, text string")
    files = spark.createDataFrame([("a.py", 5), ("b.py", 8)], "path string, n_lines int")
    at = spark.createDataFrame([("a.py", 3, "n")], "file string, line int, name string")
    edge = spark.createDataFrame([("a.py", 3), ("a.py", 2)], "file string, line int")
    got = {(p, c): v for p, c, v in rows(terms.check_citations(lines, files, at, edge), "path", "cited", "verdict")}
    assert got == {("a.py", 3): "node", ("b.py", 9): "L2_no_line", ("gone.py", 1): "L1_no_file", ("a.py", 0): "unfounded", ("a.py", 2): "edge"}
    named = spark.createDataFrame([("d", 1, "Box is here"), ("d", 2, "at a.py:3"), ("d", 3, "x"), ("d", 4, "a.py:3"), ("d", 5, " <!-- Sources: a.py:3 -->"), ("d", 6, "m a.py:4 Box")], "doc string, line int, text string")
    at = spark.createDataFrame([("a.py", 3, "ns::Box"), ("a.py", 3, "Other")], "file string, line int, name string")
    detail = terms.detail_at(
        spark.createDataFrame([("ns::Box<int>", [("mA", ("a.py", 4))], [("run", ("a.py", None))])], "display_name string, members array<struct<name:string,source_location:struct<file:string,line:int>>>, methods array<struct<name:string,source_location:struct<file:string,line:int>>>"),
        spark.createDataFrame([("N.T", [("go", "b.py", 2)])], "name string, methods array<struct<name:string,file:string,line:int>>"),
    )
    assert rows(detail) == [("a.py", 4, "Box.mA"), ("b.py", 2, "T.go")]
    got = rows(terms.check_citations(named, files, at, edge.limit(0), detail), "line", "verdict", "unnamed")
    assert got == [(2, "node", False), (4, "node", True), (5, "node", False), (6, "member", False)]
    failed, more = terms.first_failures(terms.check_citations(lines, files, at, edge), 1)
    assert [r["path"] for r in failed.collect()] == ["b.py"] and more == 1


def test_dictionaries_are_checked_where_reading_wrote_them(spark):
    shape = "name string, kind string, module string, where string, means string, neighbours array<string>, source string"
    held = spark.createDataFrame([
        ("Box", "class", "m", "a.py:2", "a box", [], "codegraph"), ("Lid", "class", "m", "a.py:2", "a lid", [], "reading"), ("Gone", "class", "m", "z.py:1", "x", [], "reading"), ("Far", "class", "m", "a.py:9", "x", [], "reading"), ("Odd", "thing", "m", "", " ", [], "reading"), ("mod", "module", None, "", "m", [], "reading"), ("bad", "class", "m", "a.py:1", "x", [], "dream"),
    ], shape)
    used = spark.createDataFrame([("Box", "Lid", "dependency", "a.py:1", "reading"), ("Box", "None", "calls", "a.py:3", "reading"), ("Box", "Lid", "odd", "a.py:1", None), ("Lid", "Box", "inheritance", "a.py:3", None)], "name string, to string, kind string, where string, source string")
    lines = spark.createDataFrame([("a.py", k + 1, t) for k, t in enumerate(["import x", "class Lid", "Box()"])], "path string, line int, text string")
    assert rows(terms.check_terms(held, used, lines)) == sorted([
        ("failed", "Box", "use of kind: calls"), ("failed", "Box", "uses unknown: None"), ("failed", "Far", "where L2: a.py:9"), ("failed", "Gone", "where L1: z.py"), ("failed", "Odd", "empty means"), ("failed", "Odd", "kind: thing"), ("failed", "Odd", "no citation"), ("failed", "bad", "source: dream"), ("failed", "mod", "no module"),
    ])


def test_terms_of_any_length_are_found_at_word_limits(spark):
    docs = spark.createDataFrame([(1, "the code graph and a code, not codegraph; items[] items[]x C++ a.b"), (2, "Code graph")], "doc int, text string")
    asked = spark.createDataFrame([(t,) for t in ["code graph", "code", "items[]", "C++", "a.b", "graph and", "++"]], "term string")
    got = rows(terms.pick_terms(asked, docs))
    held = {1: docs.first()["text"], 2: "Code graph"}
    import re

    def times(t, text):
        lead, tail = (r"\b", r"\b" if re.search(r"\w$", t, re.A) else "")
        return len(re.findall(lead + re.escape(t) + tail, text, re.A))

    assert got == sorted(((d, t, n) for d, text in held.items() for t in [r["term"] for r in asked.collect()] if (n := times(t, text))), key=repr)
    assert rows(terms.new_code_terms(spark.createDataFrame([("A1",)], "term string"), spark.createDataFrame([("A1 B2 x.json",)], "text string"))) == [("B2",), ("x.json",)]
    concepts = spark.createDataFrame([(0, "B2"), (1, "C3"), (2, "D")], "ord int, term string")
    assert rows(terms.split_concepts(concepts, spark.createDataFrame([("B2", "means"), ("C3", "  ")], "term string, means string"))) == [(0, "B2", True), (1, "C3", False), (2, "D", False)]
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "term string")
    assert rows(terms.without(one("a", "b", "c", "b"), "term", one("a"), one("c", "d"))) == [("b",)]


def test_quiz_checks_in_order(spark):
    q = spark.createDataFrame([(k, "t", f"q{k}", 2) for k in range(1, 7)], "qnum int, term string, question string, answer int")
    a = spark.createDataFrame([(1, "t", "q1", "2"), (2, "u", "q2", "9"), (3, "t", "??", "2"), (4, "t", "q4", " "), (5, "t", "q5", "x"), (9, "t", "q9", "1")], "qnum int, term string, question string, user_ans string")
    assert dict(rows(quiz.tally(q, a), "qnum", "complaint")) == {1: None, 2: "term", 3: "question", 4: "blank", 5: "range", 6: "missing", 9: "extra"}


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(X.rename_target(F.lit("src/{old => new}/a.py"))) == "src/new/a.py"
    assert value(X.rename_target(F.lit("src/{old => }/a.py"))) == "src/a.py"
    assert value(X.rename_target(F.lit("a.py => b.py"))) == "b.py"
    assert value(X.duration(F.lit(59.94))) == "59.9초" and value(X.duration(F.lit(61.5))) == "1분 01.5초"
    assert value(X.short_name(F.lit("a##b::C.d<int>"))) == "d"
    assert value(X.percent(F.lit(2 / 3))) == 67
    assert value(X.path_tokens(F.lit("see a/b.py, xa/b.py. and c/d/e.ts:4 (a/b.py)"))) == ["a/b.py", "xa/b.py", "c/d/e.ts"]
    assert value(X.code_terms(F.lit("fooBar plain snake_case x.json FooBar"))) == ["x.json"]
    assert value(X.code_terms(F.lit("D12 A1 ABC-123 ABCD1 é1 items[] x-y.json Items[] A1b"))) == ["A1", "ABC-123", "items[]", "x-y.json"]
    assert value(X.path_tokens(F.lit("*.py a/b.hxx x~y.md a/b.py:3-4"))) == ["*.py", "y.md", "a/b.py"] and [tuple(x) for x in value(X.path_lines(F.lit("a/b.py:3-4 c.md")))] == [("a/b.py", "3-4"), ("c.md", None)]
    assert [tuple(x) for x in value(X.citations(F.lit("(~a/b+c.mm:3-9) x.glsl:4 y.hxx:1 z.txt:1")))] == [("~a/b+c.mm", 3, 9), ("x.glsl", 4, None)]
    assert value(X.module_of(F.lit("src/render/a/b.h"))) == "render" and value(X.module_of(F.lit("apps/Top/main.cpp"))) == "apps/Top" and value(X.module_of(F.lit("src/a.h"))) == "src" and value(X.module_of(F.lit(""))) is None
    assert value(X.holds_term(F.lit("a code graph."), F.lit("code graph"))) and not value(X.holds_term(F.lit("codex"), F.lit("code"))) and value(X.holds_term(F.lit("items[]x"), F.lit("items[]")))
    assert value(X.undefined_terms(F.lit('import A1 from "x"\n<Section title="D2 B2" className="C3">E5 F6'), F.array(F.lit("F6")))) == ["E5"] and value(X.section_ids(F.lit('<Section title="D2 b"><Section  title="D13">'))) == ["D2", "D13"]
    assert value(X.rounded(F.lit(2.5), 0)) == 2.0
    assert value(X.escape_regex(F.lit("a.b(c)*"))) == r"a\.b\(c\)\*"
    assert value(X.json_refs(F.lit('{"$ref": "#/d/B", "x": {"$ref":"#/d/A"}}'))) == ["A", "B"]


def test_python_sources(spark):
    text = "from pkg.b import helper\nimport b as bee\nfrom deep.tool import *\nimport os\n\ndef run(x: int, /, y: str = 'a', *rest, k: int = 1, j=2, **more) -> int:\n    helper()\n    helper()\n    os.getcwd()\n    bee.C()\n    print(x)\n    go()\n    return run(x)\n\ndef go(*, a): pass\nrun(1)\n"
    src = spark.createDataFrame(
        [("src/pkg/a.py", text), ("src/pkg/b.py", "def helper():\n    from tool import fix\n    fix()\n\nclass C:\n    async def m(self):\n        helper()\n        self.x.y()\n"), ("src/pkg/deep/tool.py", "def fix(): pass\n"), ("lib/one/same.py", "def f(): pass"), ("lib/two/same.py", "def f(): pass"), ("lib/use.py", "import same\nfrom one.same import f\nsame.f()\nclass U:\n    def g(self):\n        f()\n        same.f()\n"), ("bad.py", "def (")],
        "path string, text string",
    )
    scanned = readers.scan_python(src)
    assert rows(scanned.filter("kind = 'fault'"), "file") == [("bad.py",)]
    symbols, calls = readers.python_calls(scanned)
    assert ("pkg.a.run", "(x: int, y: str = 'a', *rest, k: int = 1, j=2, **more) -> int") in rows(symbols, "name", "signature") and ("pkg.a.go", "(*, a)") in rows(symbols, "name", "signature")
    assert [r["name"] for r in symbols.orderBy("ord").collect()][:3] == ["lib.one.same.f", "lib.two.same.f", "lib.use.U"]
    assert rows(calls) == [("lib.use.U.g", "lib.one.same.f", "lib/use.py", 6), ("pkg.a.run", "pkg.a.go", "src/pkg/a.py", 12), ("pkg.a.run", "pkg.b.C", "src/pkg/a.py", 10), ("pkg.a.run", "pkg.b.helper", "src/pkg/a.py", 7), ("pkg.b.C.m", "pkg.b.helper", "src/pkg/b.py", 7), ("pkg.b.helper", "pkg.deep.tool.fix", "src/pkg/b.py", 3)]


def test_declarations_and_the_comments_above_them(spark):
    cs = "using X;\n/// <summary>A box</summary>\n///  of things.\n\n[Attr]\npublic sealed class Box<T> : Base {\n  // no\n  private enum E {\n"
    cpp = "// far\nint x;\n//! a lid\ntemplate <class T> class Lid;\nnamespace n {\n"
    src = spark.createDataFrame([("a.cs", cs)], "path string, text string")
    assert rows(readers.declarations(src, "cs", 100), "line", "kind", "name", "doc", "n_lines") == [(6, "class", "Box<T>", "A box of things.", 9), (8, "enum", "E", "", 9)]
    assert rows(readers.declarations(src, "cs", 5), "doc") == [("",), ("A box",)] and rows(readers.declarations(src, "cs"), "doc") == [("",), ("",)]
    assert rows(readers.declarations(spark.createDataFrame([("a.h", cpp)], "path string, text string"), "cpp", 50), "line", "kind", "name", "doc") == [(4, "class", "Lid", "a lid"), (5, "namespace", "n", "")]


def test_symbols_of_a_documentation_folder(spark, tmp_path):
    import json

    at = lambda f, n: {"Filename": f, "LineNumber": n}
    fn = {"USR": "u1", "Name": "run", "Namespace": ["inner", "GlobalNamespace"], "Location": at("b.cpp", 4), "ReturnType": {"Name": "void"}, "Params": [{"Name": "x", "Type": {"Name": "int"}}, {"Name": "", "Type": {"Name": "char"}}], "Description": [{"ParagraphComment": [{"TextComment": " runs "}, {"TextComment": "it"}]}]}
    (tmp_path / "sub").mkdir()
    (tmp_path / "index.json").write_text(json.dumps({"Functions": [fn, {"Name": "lost"}], "Enums": [{"USR": "u2", "Name": "E", "Location": at("a.h", 9)}]}))
    (tmp_path / "sub" / "index.json").write_text(json.dumps({"Functions": [{**fn, "Name": "again"}]}))
    (tmp_path / "rec.json").write_text(json.dumps({"InfoType": "record", "TagType": "struct", "Name": "S", "Location": at("a.h", 1)}))
    (tmp_path / "other.json").write_text(json.dumps({"InfoType": "namespace", "Name": "N", "Location": at("a.h", 1)}))
    (tmp_path / "bad.json").write_text("{")
    got = readers.read_symbols(spark, f"file://{tmp_path}")
    assert rows(got, "ord", "name", "kind", "namespace", "file", "line", "signature", "doc") == [(1, "S", "struct", "", "a.h", 1, "", ""), (2, "E", "enum", "", "a.h", 9, "", ""), (3, "run", "function", "inner", "b.cpp", 4, "void run(int x, char)", "runs it")]


def test_listings(spark):
    files = spark.createDataFrame([("src/a.py",), ("src/b.ts",), ("build/c.py",), ("lib/a.py",), ("x.h",)], "path string")
    assert rows(readers.tracked(files, "py")) == [("lib/a.py",), ("src/a.py",)]
    assert rows(readers.tracked(files, "py", ("src/",))) == [("src/a.py",)]
    assert dict(rows(readers.count_languages(files), "language", "n")) == {"py": 3, "ts": 1, "cpp": 1, "cs": 0} and rows(readers.top_language(readers.count_languages(files))) == [("py",)]
    assert ("a.py", 2, None) in rows(readers.by_basename(files), "name", "n", "path")


def test_sinks(spark, tmp_path):
    w = spark.createDataFrame([("b", 1, 2, 0, 1, 0.5), ("a", 1, 2, 1, 0, 0.5)], "file string, out_edges bigint, into_edges bigint, interfaces bigint, abstracts bigint, weight double")
    lines = lambda df: [r["line"] for r in df.orderBy("ord").collect()]
    assert lines(sinks.weights_csv(w)) == ["file,out,into,interfaces,abstracts,weight", "a,1,2,1,0,0.500000", "b,1,2,0,1,0.500000"]
    d = spark.createDataFrame([(1, "f", "n", "t", 'say "x"', "a:1", "unknown-target"), (2, "f", "n", "u", None, None, "unknown-shallow")], "ord int, file string, key string, to string, label string, where string, why string")
    assert lines(sinks.dropped_csv(d)) == ["file,key,to,label,where,why", "f,n,t,\"say 'x'\",a:1,unknown-target", 'f,n,u,"",,unknown-shallow']
    u = spark.createDataFrame([(1, "f", "k", "d", 0.25, 3, "queued")], "ord int, file string, key string, dep string, priority double, into int, status string")
    assert lines(sinks.unresolved_csv(u)) == ["file,key,dep,priority,into,status", "f,k,d,0.250000,3,queued"]
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "a string, b string")
    assert [r[0] for r in sinks.dot_edges(pairs, pairs.filter("a <> 'b' or b <> 'c'")).collect()] == ['  "a" -> "b" [color=red, dir=both];', '  "b" -> "c";']
    sinks.write_document({"b": 1, "a": [2]}, str(tmp_path / "x.json"))
    first = (tmp_path / "x.json").read_bytes()
    sinks.write_document({"a": [2], "b": 1}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_bytes() == first
    assert rows(sinks.upsert(pairs, spark.createDataFrame([("a", "z")], "a string, b string"), ["a"])) == [("a", "z"), ("b", "a"), ("b", "c")]


def test_stage_graph_is_checked_before_it_runs():
    good = [Stage("one", (), ("g",), {"ok": "two"}, lambda s: s.update(g=1) or "ok"), Stage("two", ("g",), ("h",), {"ok": None}, lambda s: s.update(h=2) or "ok")]
    assert simulate(good) == [] and run(good, {}) == [("one", "ok"), ("two", "ok")]
    skips = [Stage("one", (), ("g",), {"ok": "two", "skip": "two"}), Stage("two", ("g",), (), {"ok": "one"}), Stage("three")]
    faults = simulate(skips)
    assert "two: may lack g" in faults and "two: ok leads back to one" in faults and "three: no edge leads here" in faults
    with pytest.raises(ValueError):
        run(skips, {})


def test_module_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (3, 4)], "a int, b int")
    assert sorted(r["path"] for r in graph.simple_cycles(edges, 4).collect()) == [[1, 2], [1, 2, 3]]


def test_progress_and_usage(spark):
    p = spark.createDataFrame([("t", "begin", 1), ("t", "end", 2), ("u", "begin", 1)], "token string, kind string, ord int")
    assert rows(measure.all_ended(p)) == [(False,)] and rows(measure.all_ended(p.filter("token = 't'"))) == [(True,)] and rows(measure.all_ended(p.limit(0))) == [(True,)]


def test_streaming_windows_equal_batch(spark, data, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{data}/events.parquet", tmp_path / "in")
    stream = streams.windowed(streams.read_events(spark, f"file://{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = spark.read.parquet(f"{data}/events.parquet").groupBy(F.window("ts", "1 hour"), "event_type").count().count()
    assert spark.table("windows").count() == want
    seen = []
    done = streams.advance(streams.read_events(spark, f"file://{tmp_path}/in"), lambda df, k: seen.append(df.count()), lambda df, k: seen.append("commit"), f"file://{tmp_path}/ck")
    done.awaitTermination(120)
    assert seen == [1000, "commit"]


def test_completed_sessions_queue_what_became_ready(spark, tmp_path):
    shape = "batch string, key string, file string, rec string, needs array<string>"
    for k, held in enumerate(([("b1", "a", "f", "r", ["c"]), ("b1", "bad", "f", "", [])], [("b2", "c", "f", "r", []), ("b2", "d", "f", "r", ["bad"])])):
        spark.createDataFrame(held, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = streams.completions(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), lambda df: df.filter("rec = ''").withColumn("fault", F.lit("empty")), lambda df, n: seen.append((n, sorted(r["key"] for r in df.collect()))), f"{tmp_path}/out", f"{tmp_path}/ck") if k else None
        if q is not None:
            q.awaitTermination(120)
    assert seen and seen[-1][1] == ["a"] and spark.read.parquet(f"{tmp_path}/out/bad").select("key", "fault").collect() == [("bad", "empty")]


seen: list = []


def test_waiting_records_are_queued_once_over_restarts(spark, tmp_path):
    import random

    rnd, shape = random.Random(3), "batch string, key string, file string, rec string, needs array<string>"
    batches = [[(f"b{n}", f"k{rnd.randrange(40)}", "f", "r", [f"k{rnd.randrange(40)}" for _ in range(rnd.randrange(4))]) for _ in range(8)] for n in range(5)]
    got: dict = {}

    def run():
        source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        streams.completions(source, lambda df: df.limit(0).withColumn("fault", F.lit("")), lambda df, n: got.__setitem__(n, sorted(r["key"] for r in df.collect())), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(300)

    for n, held in enumerate(batches):
        spark.createDataFrame(held, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n in (1, 2, 4):  # the query ends and starts again from its checkpoint
            run()
    # in plain Python over all that came so far
    waits, have, want = set(), set(), {}
    for n, held in enumerate(batches):
        have |= {r[1] for r in held}
        asked = waits | {(r[1], x) for r in held for x in r[4]}
        waits = {(k, x) for k, x in asked if x not in have}
        want[n] = sorted({k for k, _ in asked} - {k for k, _ in waits})
    assert got == want and any(want.values())


def test_change_sets_and_snapshots(spark):
    files = spark.createDataFrame([("a.py", 1.0, 2, b"x"), ("b.py", 1.0, 2, b"y")], "path string, mtime double, size bigint, content binary")
    decls = spark.createDataFrame([("a.py", "class", "B", 5), ("a.py", "class", "A", 9)], "path string, kind string, name string, line int")
    moved = spark.createDataFrame([("a.py", "class", "A", 1), ("a.py", "class", "B", 2)], "path string, kind string, name string, line int")
    one, two = streams.declaration_hashes(files, decls), streams.declaration_hashes(files.withColumn("content", F.lit(b"z")).withColumn("mtime", F.lit(2.0)), moved)
    assert rows(one.filter("path = 'b.py'"), "decl_hash") == [(None,)] and rows(one, "path", "decl_hash") == rows(two, "path", "decl_hash")
    told, targets = streams.change_set(one, two)
    assert rows(told) == [("a.py", "location_only"), ("b.py", "location_only")] and rows(targets) == [("a.py",), ("b.py",)]
    told, targets = streams.change_set(None, two)
    assert targets is None and told.count() == 2 and rows(streams.change_set(one, one, lambda s: s)[1]) == []
    ran, whole = streams.layer_rows(spark.createDataFrame([("b", True), ("a", False)], "label string, ok boolean"))
    assert [r["label"] for r in ran.collect()] == ["a", "b"] and rows(whole) == [(False,)]
