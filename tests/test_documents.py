"""Functions on documents of any shape."""

import json

from pyspark.sql import functions as F

from loomgraph.functions import documents as D
from loomgraph.functions import rules as R


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_nested_texts(spark):
    doc = {"a": [{"TextComment": " one "}, {"x": {"TextComment": "two"}}, {"TextComment": "  "}]}
    assert value(spark, json.dumps(doc), D.nested_texts) == "one two"
    assert value(spark, "{broken", D.nested_texts) == "" and value(spark, None, D.nested_texts) == ""


def test_schema_without_names(spark):
    schema = {"title": "T", "properties": {"title": {"title": "x", "type": "string"}}, "items": [{"description": "d", "type": "int"}]}
    assert json.loads(value(spark, json.dumps(schema), D.without_names)) == {"properties": {"title": {"type": "string"}}, "items": [{"type": "int"}]}


def test_expression_names(spark):
    name = lambda n: {"cls": "ExprName", "name": n}
    tree = {"cls": "ExprSubscript", "left": {"cls": "ExprAttribute", "values": [name("typing"), name("Dict")]}, "slice": {"cls": "ExprTuple", "elements": [name("K"), {"cls": "ExprBinOp", "left": name("V"), "right": "None"}]}}
    assert value(spark, json.dumps(tree), D.expression_names) == ["typing.Dict", "K", "V"]


def test_terms_and_paths_in_html(spark):
    page = '<p>code graph and graph, subgraph</p><pre>graph</pre><summary>graph</summary><TH>graph</TH><p class="x mono">graph</p><p class="x">no <a href="#">graph</a> a/b.py c.py</p><!-- graph -->'
    refs = {"graph": "<i>g</i>", "code graph": "<i>cg</i>"}
    wrapped = value(spark, page, lambda c: D.wrap_terms(c, refs))
    assert wrapped.count("<i>") == 3 and "<i>cg</i> and <i>g</i>, subgraph" in wrapped and "<pre>graph</pre>" in wrapped and '<a href="#"><i>g</i></a>' in wrapped
    assert all(x in wrapped for x in ("<summary>graph</summary>", "<TH>graph</TH>", 'mono">graph<', "<!-- graph -->"))
    assert value(spark, page, lambda c: D.wrap_terms(c, {})) == page and value(spark, None, lambda c: D.wrap_terms(c, refs)) is None
    linked = value(spark, page, lambda c: D.link_paths(c, {"a/b.py": "/src/a/b.py"}))
    assert '<a class="path-link" target="_blank" rel="noopener" href="/src/a/b.py">a/b.py</a> c.py' in linked
    assert value(spark, linked, lambda c: D.link_paths(c, {"a/b.py": "/src/a/b.py"})) == linked
    assert value(spark, page, lambda c: D.unlinked_paths(c, {"a/b.py": "x"})) == ["c.py"]
    code = "<code>a/b.py:3-5</code><h2>a/b.py</h2><textarea>a/b.py</textarea><p>xa/b.py a/b.py: *.py</p>"
    got = value(spark, code, lambda c: D.link_paths(c, {"a/b.py": "1", "*.py": "2"}))
    assert got.count("path-link") == 3 and ">a/b.py:3-5</a></code>" in got and "<h2>a/b.py</h2>" in got


def test_slots_are_strict(spark):
    one = lambda t, v: tuple(value(spark, t, lambda c: D.render_slots(c, v)))
    assert one("{{a}} {{ b }}", {"a": "{{b}}", "b": "2"}) == ("{{b}} 2", None)
    assert one("{{a}}", {"b": "2"}) == (None, "missing a; unused b")


def test_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert tuple(one(R.split_where(F.lit("a/b.py:3-7")))) == ("a/b.py", 3) and tuple(one(R.split_where(F.lit("a/b.py")))) == ("a/b.py", None)
    assert one(R.python_abstraction(F.array(F.lit("typing.Protocol[T]")), F.array().cast("array<string>"))) == "interface"
    assert one(R.python_abstraction(F.array().cast("array<string>"), F.array(F.lit("abc.abstractmethod")))) == "abstract"
    assert one(R.collector_for(F.array(F.lit("setup.py"), F.lit("App.sln")))) == "roslyn-dump" and one(R.collector_for(F.array(F.lit("requirements.txt")))) == "griffe+pycalls" and one(R.collector_for(F.array(F.lit("x")))) == "none"
    assert one(R.collector_from(F.lit('{"collector": "clang-uml"}'))) == "clang-uml" and one(R.collector_from(F.lit("{"))) is None
    assert one(R.stem(F.lit("ns::Box[]"), F.lit("class"))) == "Box" and one(R.stem(F.lit("a.b[]"), F.lit("concept"))) == "a.b"
    assert one(R.strings_of(F.lit('["a","b"]'))) == ["a", "b"] and one(R.strings_of(F.lit("7"))) == []
    assert one(R.entry_fits(F.lit("wiki"), F.lit("wiki/a.md"))) and not one(R.entry_fits(F.lit("wiki"), F.lit("wiki/../a.md")))
    assert one(R.similar(F.lit("report"), F.lit("reporting"))) and not one(R.similar(F.lit("abc"), F.lit("abd")))
    methods = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("args")) for n, a in [("C", 0), ("~C", 0), ("GetX", 0), ("GetY", 1), *[(f"m{k}", 0) for k in range(7)]]])
    shown = one(R.shown_methods(methods, F.lit("C")))
    assert [m["name"] for m in shown["shown"]] == ["GetY", "m0", "m1", "m2", "m3", "m4"] and shown["more"] == 2


def test_small_decisions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert [one(R.language_of(F.lit(p))) for p in ("a/b.hxx", "x.CS", "x.cs", "a.tsx", ".py", "a.d.ts", None)] == ["cpp", None, "cs", "ts", None, "ts", None]
    assert [one(R.language_for(F.lit(c))) for c in ("griffe+pycalls", "none", None)] == ["py", None, None]
    assert [one(R.scanner_language(F.lit(c))) for c in ("python", "csharp", "cpp", "perl")] == ["py", "cs", "cpp", None]
    assert [one(R.import_group(F.lit(c))) for c in ("heapq", "struct.pack", "tomllib", "numpy.x", "", None)] == ["(표준) stdlib"] * 3 + ["numpy", "(기타)", "(기타)"]
    assert [one(R.file_of(F.lit(c))) for c in ("a.py:3", "a.py", None)] == ["a.py", "a.py", ""]
    said = lambda *a: tuple(one(R.run_verdict(*[F.lit(x) for x in a])))
    assert said(1, False, False, "x")[0] is False and said(2, True, True, "x") == (False, "exit code 2: x") and said(0, True, True, None) == (False, "ended in an error: no reason given") and said(0, True, False, "s") == (True, "")
    assert one(R.manuscript_written(F.lit("decisions: [1]"), F.lit('<Section title="D1 x"'))) and not one(R.manuscript_written(F.lit("decisions: [ ]"), F.lit('<Section title="D1"'))) and not one(R.manuscript_written(F.lit(None).cast("string"), F.lit("x")))
    conf = one(R.author_config(F.lit("a: 1\nadd_compile_flags:\n  - -O2\n  - -DX\npaths: [src, lib]\n")))
    assert (conf["flags"], conf["paths"]) == (["-O2", "-DX"], ["src", "lib"]) and one(R.author_config(F.lit("add_compile_flags: [-a, -b]")))["flags"] == ["-a", "-b"]
    steps = lambda *a: tuple(one(R.prep_steps(F.lit(a[0]).cast("string"), *[F.lit(x) for x in a[1:]])))
    assert steps("clang-uml", True, True, False, True, True) == (["clang-uml", "clang-doc", "normalize"], None) and steps("clang-uml", True, False, False, True, False) == ([], "no configuration")
    assert steps("griffe+pycalls", False, True, False, True, False) == (["facts", "render-modules"], None) and steps(None, True, True, True, True, False) == ([], "no collector") and steps("roslyn-dump", True, False, False, False, False) == ([], "no dump")
    use = one(R.usage_of(F.lit('{"usage": {"input_tokens": 5, "cache_read_input_tokens": 7}, "total_cost_usd": 0.5}')))
    assert (use["input"], use["output"], use["total"], use["cost_usd"], use["turns"]) == (5, 0, 12, 0.5, 0) and one(R.usage_of(F.lit("{")))["total"] == 0
    taken = F.array(F.lit("a.md"), F.lit("a.1.md"))
    assert one(R.backup_name(F.lit("a.md"), taken)) == "a.2.md" and one(R.backup_name(F.lit("b.md"), taken)) == "b.md"
    assert one(R.fault_line(F.lit("where"), F.lit("b1"), F.lit("k"), F.lit("d"), F.lit("f"))) == "where [b1] k: d (f)"
