"""The three normalizers on literal dumps, and the audit of broken documents."""

import json

import pytest

from loomgraph.operators import audit, csharp, normalize, python_graph
from loomgraph.sources import readers


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def reasons(report):
    return {r["reason"]: r["count"] for r in report.collect()}


def test_own_types_are_told_by_namespace_or_by_their_place(spark):
    from loomgraph.operators.assemble import first_party

    cases = [
        ("app::ui", "x.h", 1, "A", True), ("", "src/a.h", 1, "A", True), ("", "/r/src/a.h", 1, "A", True), ("", "src/a.h", 2, "A", False), ("", "src/a.h", 3, "QWidget", False), ("std", "src/a.h", 1, "A", False), ("__gnu_cxx", "src/a.h", 1, "A", False),
        ("", "build/gen.h", 1, "A", False), ("", "src/ui_autogen.h", 1, "A", False), ("", "lib/other.h", 1, "A", False), ("", "/usr/include/a.h", 1, "A", False), ("", "../a.h", 1, "A", False), ("", None, None, "A", False), ("", "src/a.h", 4, "ns::Out##In<int>", True), ("", "src/a.h", 99, "A", False),
    ]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, namespace string, file string, line int, name string")
    text = ["class EXPORT A {", "  A a", "class QWidget;", "struct In : Base {"]
    lines = spark.createDataFrame([(p, k + 1, t) for p in ("src/a.h", "build/gen.h", "src/ui_autogen.h", "lib/other.h") for k, t in enumerate(text)], "path string, line int, text string")
    tracked = spark.createDataFrame([("src/a.h",), ("build/gen.h",), ("src/ui_autogen.h",)], "path string")
    got = {r["k"]: r["own"] for r in first_party(df, ("app",), lines, tracked, "/r").collect()}
    assert [got[k] for k in range(len(cases))] == [c[4] for c in cases]


@pytest.fixture(scope="module")
def diagram(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("uml")
    place = lambda f, line=3: {"file": f, "line": line}
    e = lambda i, name, ns, f, args=(), abstract=False, shown=None, members=(), kind="class": {"id": i, "name": name, "display_name": shown or name, "namespace": ns, "is_abstract": abstract, "type": kind, "source_location": place(f), "members": [{"name": n, "source_location": place(f, k)} for n, k in members], "template_parameters": [{"type": a} for a in args]}
    deep = [e(f"w{k}", "list", "std", "/u", [f"list{k + 1}"], shown=f"list{k}") for k in range(6)]
    doc = {
        "elements": [
            e("1", "A", "app", "src/a/a.h", members=[("mB", 7), ("twice", 8), ("twice", 9)]), e("2", "B", "app", "src/b/b.h"), e("3", "I", "app", "src/b/i.h", abstract=True), e("4", "vector", "std", "/u", ["shared_ptr<B>", "A"], shown="vector<shared_ptr<B>>"), e("5", "shared_ptr", "std", "/u", ["B"], shown="shared_ptr<B>"),
            e("6", "Q", "Qt::x", "/usr/q.h"), e("7", "int", "", "x"), e("8", "function", "std", "/u"), e("9", "Lonely", "", "/z"), e("10", "Color", "app", "apps/top/c.h", kind="enum"), *deep, e("11", "B", "app", "src/b/b.h", shown="list6"),
        ],
        "relationships": [{"type": t, "source": s, "destination": d, "label": label} for t, s, d, label in [
            ("extension", "1", "3", None), ("extension", "1", "2", None), ("aggregation", "1", "4", "mB"), ("aggregation", "1", "2", "twice"), ("association", "2", "6", "q"), ("containment", "1", "2", None), ("composition", "1", "2", None), ("dependency", "1", "404", None), ("dependency", "6", "1", None),
            ("dependency", "2", "2", None), ("dependency", "1", "8", None), ("friendship", "10", "1", None), ("dependency", "1", "w0", None), ("dependency", "1", "w3", None), ("dependency", "1", "7", None)]],
        "metadata": "m",
    }
    (folder / "good.json").write_text(json.dumps(doc))
    (folder / "bad.json").write_text("{")
    (folder / "lacks.json").write_text('{"elements": []}')
    return readers.read_diagram(spark, f"file://{folder}")


def test_cpp(diagram):
    elements, relations, faults = diagram
    assert sorted(r["reason"] for r in faults.collect()) == ["missing relationships", "not JSON"]
    nodes, edges, modules, report = normalize.normalize(elements, relations, namespaces=("app",))
    assert rows(nodes, "id", "name", "kind", "module") == [
        ("C1", "A", "class", "a"), ("C2", "B", "class", "b"), ("C3", "I", "class", "b"), ("C7", "Color", "enum", "apps/top"), ("C8", "list6", "class", "b"), ("X:(STL) std", "(STL) std", "external", "__external__"), ("X:Qt", "Qt", "external", "__external__"),
    ]
    assert rows(edges, "src", "dst", "kind", "label", "line", "occurrences", "constraint") == [
        ("C1", "C2", "composition", "mB", 7, 2, None), ("C1", "C2", "inheritance", None, None, 1, None), ("C1", "C3", "realization", None, None, 1, None), ("C1", "C8", "dependency", None, None, 1, None), ("C1", "X:(STL) std", "dependency", None, None, 1, False),
        ("C2", "X:Qt", "aggregation", "q", None, 1, False), ("C7", "C1", "friendship", None, None, 1, None),
    ]
    assert rows(modules) == [("a", ["b"]), ("apps/top", ["a"]), ("b", [])]
    assert reasons(report) == {
        "모르는 관계 종류": 1, "끝점 해소 실패": 3, "R5 투과 래퍼": 8, "R7 원시 타입 제외": 1, "containment 버림(자리 없음)": 1, "자기참조 버림": 2, "R4 외부발 간선 버림": 1, "중복 간선 접음": 1, "R1 로 제거된 외부 노드": 1, "1차 노드": 5, "외부 원본 타입": 3, "모듈 간 의존": 5,
    }
    first = report.first()
    assert (first["reason"], first["class"], first["samples"]) == ("모르는 관계 종류", "fault", ["composition"])


def test_documentation_symbols_move_nodes_and_add_new_ones(spark, diagram):
    elements, relations, _ = diagram
    sym = [("A", "class", "", "src/z/a.h", 40, "", "about A", 0), ("run", "function", "app", "src/z/run.cpp", 5, "void run()", "", 1), ("run", "function", "app", "src/z/run.h", 9, "", "runs", 2), ("qrun", "function", "Qt", "/usr/q.h", 1, "", "", 3)]
    symbols = spark.createDataFrame([(n, k, ns or "app2", f, line, s, d, o) for n, k, ns, f, line, s, d, o in sym], normalize.SYMBOLS)
    nodes, _, _, report = normalize.normalize(elements, relations, symbols, namespaces=("app", "app2"))
    got = {r["name"]: (r["id"], r["file"], r["line"], r["signature"], r["doc"]) for r in nodes.collect()}
    assert got["app::run"] == ("C10", "src/z/run.h", 9, "void run()", "runs") and got["app2::A"][0] == "C9" and got["A"][1] == "src/a/a.h"
    told = reasons(report)
    assert (told["clang-doc 1차 아님(버림)"], told["clang-doc 신규 노드"], told["clang-doc 로 위치 갱신"]) == (1, 2, 1)


def name(n):
    return {"cls": "ExprName", "name": n}


def dotted(*parts):
    return {"cls": "ExprAttribute", "values": [name(p) for p in parts]}


def sub(left, inner):
    return {"cls": "ExprSubscript", "left": left, "slice": inner}


def either(a, b):
    return {"cls": "ExprBinOp", "left": a, "right": b, "operator": "|"}


def many(*parts):
    return {"cls": "ExprTuple", "elements": list(parts)}


def test_python(spark):
    fn = lambda line, params=(), returns=None, labels=(): {"kind": "function", "lineno": line, "parameters": [{"name": n, "annotation": a} for n, a in params], "returns": returns, "labels": list(labels)}
    attr = lambda line, annotation: {"kind": "attribute", "lineno": line, "annotation": annotation}
    module_attr = lambda value, line=1: {"kind": "attribute", "lineno": line, "labels": ["module-attribute"], "value": value}
    call = lambda f, *args: {"cls": "ExprCall", "function": name(f), "arguments": list(args)}
    nest = name("B")
    for _ in range(9):
        nest = either(nest, "None")
    a = {"kind": "module", "filepath": "/r/src/pkg/a.py", "imports": {"B": "pkg.b.B", "np": "numpy", "List": "typing.List", "S": "b.Side"}, "members": {
        "T": module_attr(call("TypeVar", "'T'")), "Al": module_attr(sub(name("List"), name("B"))), "Loop": module_attr(sub(name("list"), name("Loop"))), "CONST": module_attr(call("compute")), "Td": module_attr(call("TypedDict", "'Td'", {"cls": "ExprDict", "keys": ["'x'", "'y'"], "values": [name("A"), name("int")]}), 5),
        "Nt": module_attr(call("NamedTuple", "'Nt'", {"cls": "ExprList", "elements": [many("'p'", name("B")), many("'q'", name("A"))]}), 6), "Bad": module_attr(call("TypedDict", "'Bad'", call("f")), 7),
        "A": {"kind": "class", "lineno": 10, "bases": [name("B"), dotted("abc", "ABC")], "members": {
            "f": attr(11, either(name("B"), "None")), "g": attr(12, sub(name("List"), name("A"))), "h": attr(13, name("Al")), "m": fn(14, [("self", None), ("x", sub(name("dict"), many(name("str"), dotted("np", "ndarray")))), ("y", name("T"))], name("Zed")),
            "q": fn(0, [("f", name("B"))], "'str'"), "deep": attr(15, nest), "loop": attr(16, name("Loop")), "In": {"kind": "class", "lineno": 20, "bases": [name("S")], "members": {}}}}}}
    b = {"kind": "module", "filepath": "/r/src/pkg/b.py", "imports": {"P": "typing.Protocol", "Gone": "pkg.a.Gone", "Two": "x.Same"}, "members": {
        "B": {"kind": "class", "lineno": 3, "bases": [name("P")], "members": {"z": attr(4, name("Gone")), "w": attr(5, name("len")), "t": attr(6, name("Two"))}}, "Side": {"kind": "class", "lineno": 9, "bases": [], "members": {"k": fn(10, labels=["abstractmethod"])}}}}
    same = lambda: {"kind": "module", "filepath": None, "members": {"x": {"kind": "module", "filepath": "/r/src/pkg/x.py", "members": {"Same": {"kind": "class", "lineno": 1, "bases": [], "members": {}}}}}}
    loose = {"kind": "module", "filepath": "/r/src/pkg/loose.py", "members": {"Gone": {"kind": "class", "lineno": 1, "bases": [], "members": {}}}}
    dump = {"pkg": {"kind": "module", "filepath": ["/r/src/pkg"], "members": {"a": a, "b": b, "one": same(), "two": same(), "loose": loose}}}
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in dump.items()], "name string, doc string")
    symbols = spark.createDataFrame([("pkg.a.A", "class", "pkg.a", "src/pkg/a.py", 10, None, 0), ("pkg.a.A.m", "method", "pkg.a", "src/pkg/a.py", 14, "(self, x)", 1), ("pkg.c.run", "function", "pkg.c", "src/pkg/c.py", 1, "()", 2)], python_graph.SYMBOLS)
    calls = spark.createDataFrame([("pkg.c.run", "pkg.a.A", "src/pkg/c.py", 2, 0), ("pkg.c.run", "pkg.a.A", "src/pkg/c.py", 3, 1), ("pkg.c.run", "pkg.x", "src/pkg/c.py", 4, 2)], python_graph.CALLS)
    tracked = spark.createDataFrame([(f"src/pkg/{f}.py",) for f in "abcx"], "path string")
    nodes, edges, modules, report = python_graph.normalize(docs, symbols, calls, tracked, "/r")
    got = {r["name"]: r for r in nodes.collect()}
    assert [got[n]["id"] for n in sorted(n for n in got if n.startswith("pkg") and got[n]["kind"] == "class")] == [f"C{k}" for k in range(1, 10)]
    assert {n: r["abstraction"] for n, r in got.items() if r["abstraction"]} == {"pkg.a.A": "abstract", "pkg.b.Side": "abstract"} and got["pkg.a.A.m"]["signature"] == "(self, x)" and got["pkg.c.run"]["id"] == "C11"
    by_id = {r["id"]: n for n, r in got.items()}
    told = sorted(((by_id[r["src"]], by_id[r["dst"]], r["kind"], r["label"], r["line"], r["occurrences"], r["constraint"]) for r in edges.collect()), key=repr)
    assert told == sorted([
        ("pkg.a.A", "(표준) stdlib", "inheritance", None, 10, 1, False), ("pkg.a.A", "numpy", "dependency", "m(x)", 14, 1, False), ("pkg.a.A", "pkg.b.B", "association", "f", 11, 2, None), ("pkg.a.A", "pkg.b.B", "dependency", "q(f)", 11, 1, None), ("pkg.a.A", "pkg.b.B", "inheritance", None, 10, 1, None),
        ("pkg.a.A.In", "pkg.b.Side", "inheritance", None, 20, 1, None), ("pkg.a.Nt", "pkg.a.A", "association", "q", 6, 1, None), ("pkg.a.Nt", "pkg.b.B", "association", "p", 6, 1, None), ("pkg.a.Td", "pkg.a.A", "association", "x", 5, 1, None), ("pkg.c.run", "pkg.a.A", "dependency", "호출", 2, 2, None),
    ], key=repr)
    counts = reasons(report)
    assert {k: counts[k] for k in ("git 추적 밖 모듈", "이름 해소 실패", "1차 이름 꼬리 겹침", "식 깊이 초과", "타입 변수", "빌트인", "이름이 아닌 식 버림", "함수 꼴 TypedDict 노드", "중첩 클래스", "호출 간선", "호출이 기존 간선에 접힘", "호출 양끝 해소 실패")} == {
        "git 추적 밖 모듈": 1, "이름 해소 실패": 2, "1차 이름 꼬리 겹침": 1, "식 깊이 초과": 3, "타입 변수": 1, "빌트인": 1, "이름이 아닌 식 버림": 2, "함수 꼴 TypedDict 노드": 3, "중첩 클래스": 1, "호출 간선": 1, "호출이 기존 간선에 접힘": 1, "호출 양끝 해소 실패": 1,
    }
    assert len(told) == 10 and sum(x[5] for x in told) == 12


def test_fields_of_classes_in_function_form():
    assert python_graph.form_fields(["'X'"]) == [] and python_graph.form_fields(["'X'", {"cls": "ExprDict", "keys": ["'a'", None], "values": [1, 2]}]) == [("a", 1), (None, 2)]
    odd = {"cls": "ExprList", "elements": [many("'p'", 1), many("'q'")]}
    assert python_graph.form_fields(["'X'", odd]) == [(None, odd)] and python_graph.form_fields(["'X'", {"cls": "ExprKeyword"}]) == []


def test_csharp(spark):
    own, net = "own", "netstandard"
    listed = "System.Collections.Generic.List`1"
    types = [
        ("1", "N.A", "Class", own, "Assets/@Scripts/Ui/a.cs", 1, None, [], 0), ("2", "N.G", "Interface", own, "Assets/@Scripts/g.cs", 3, None, [], 1), ("3", "N.G<A>", "Class", own, "Assets/@Scripts/g.cs", 3, "N.G`1", ["1"], 2), ("4", "List<A>", "Class", net, None, None, listed, ["1"], 3),
        ("5", "Transform", "Class", "UnityEngine.CoreModule", None, None, None, [], 4), ("6", "System.String", "Class", net, None, None, None, [], 5), ("7", "T", "TypeParameter", None, None, None, None, [], 6), ("8", "X.Y", "Class", "Vendor.Sub", None, None, None, [], 7), ("9", "Err", "Error", None, None, None, None, [], 8),
        ("10", "(A, X.Y)", "Struct", net, "Assets/@Scripts/g.cs", 9, "System.ValueTuple`2", ["4", "8"], 9), ("11", "P", "Class", "UnityEngine.PhysicsModule", None, None, None, [], 10), ("12", "W", "Class", "UnityEditor.X", None, None, None, [], 11), ("13", "Z", "Class", "Zed", None, None, None, [], 12),
    ]
    relations = [
        ("inherit", "1", "2", None, None, False, None, "a.cs", 1), ("assoc", "2", "4", "items", ["SerializeField"], False, "field", "g.cs", 4), ("assoc", "2", "10", "more", None, False, None, "g.cs", 5), ("depend", "3", "5", None, None, False, None, "g.cs", 6), ("depend", "1", "6", None, None, False, None, None, None),
        ("odd", "1", "2", None, None, False, None, None, None), ("assoc", "1", "7", "t", None, False, None, None, None), ("assoc", "1", "1", "v", None, True, None, None, None), ("assoc", "1", "9", "v", None, False, None, None, None), ("depend", "5", "1", "v", None, False, None, None, None),
        ("depend", "1", "11", None, None, False, None, None, None), ("depend", "1", "12", None, None, False, None, None, None), ("realize", "1", "13", None, None, False, None, None, None),
    ]
    packages = spark.createDataFrame([("Vendor", "com.vendor", 0)], "assembly string, package string, ord int")
    nodes, edges, modules, report = csharp.normalize(spark.createDataFrame(types, csharp.TYPES), spark.createDataFrame([(*r, k) for k, r in enumerate(relations)], csharp.RELATIONS), own, packages)
    assert rows(nodes, "id", "kind", "module", "collapsed_from") == [
        ("C1", "class", "Ui", None), ("C2", "interface", "@Scripts", None), ("X:(벤더링) Zed", "external", "__external__", ["Z"]), ("X:(엔진 에디터) UnityEditor", "external", "__external__", ["W"]), ("X:(엔진) UnityEngine.CoreModule", "external", "__external__", ["Transform"]), ("X:com.unity.modules.physics", "external", "__external__", ["P"]),
        ("X:com.vendor", "external", "__external__", ["X.Y"]),
    ]
    assert rows(edges.filter("dst like 'C%' or dst = 'X:com.vendor'"), "src", "dst", "kind", "label", "line", "occurrences", "constraint", "origin", "attrs") == [
        ("C1", "C2", "inheritance", None, 1, 1, None, None, None), ("C2", "C1", "association", "items", 4, 2, None, "field", ["SerializeField"]), ("C2", "X:com.vendor", "association", "more", 5, 1, False, None, None),
    ]
    assert rows(modules) == [("@Scripts", ["Ui"]), ("Ui", ["@Scripts"])]
    told = reasons(report)
    assert {k: told[k] for k in ("모르는 관계 종류", "dst Error 버림", "dst TypeParameter 버림", "R5 투과 래퍼 경유", "R7 원시·암묵 기반 버림", "enum 멤버 버림(플래그)", "소스 제네릭 인스턴스 접음", "중복 간선 접음", "R4 외부발 간선 버림")} == {
        "모르는 관계 종류": 1, "dst Error 버림": 1, "dst TypeParameter 버림": 1, "R5 투과 래퍼 경유": 3, "R7 원시·암묵 기반 버림": 1, "enum 멤버 버림(플래그)": 1, "소스 제네릭 인스턴스 접음": 1, "중복 간선 접음": 1, "R4 외부발 간선 버림": 1,
    }
    assert csharp.refused(0, 1) and not csharp.refused(0, 0)


def document(**changes):
    n = lambda i, kind="class", module="m", file="a.py", line=1: {"id": i, "name": i, "kind": kind, "module": module, "file": file, "line": line}
    e = lambda a, b, **k: {"from": a, "to": b, "kind": "dependency", "label": None, "file": None, "line": None, **k}
    good = {"schema_version": 2, "language": "python", "platform": "x", "source_tool": "t", "repo_commit": None, "nodes": [n("a"), n("b", module="k"), n("x", "external", "__external__", None, None)], "edges": [e("a", "b"), e("a", "x", constraint=False)], "modules": [{"id": "k", "depends_on": []}, {"id": "m", "depends_on": ["k"]}]}
    return good | {k: v(good[k]) for k, v in changes.items()}


def audited(spark, doc, **how):
    read = audit.from_text(spark.createDataFrame([(doc if isinstance(doc, str) else json.dumps(doc),)], "text string"))
    faults, told = audit.verify(read, **how)
    return sorted((r["code"], r["at"]) for r in faults.collect()), told


def test_a_good_graph_passes(spark):
    facts = audit.file_facts(spark.createDataFrame([("a.py", b"x\ny")], "path string, content binary"))
    sha = audit.from_text(spark.createDataFrame([(json.dumps(document()),)], "text string")).first()["sha"]
    now = facts.first()["sha"]
    manifest = spark.createDataFrame([(sha, {"a.py": now})], "codegraph_sha256 string, sources map<string,string>")
    report = spark.createDataFrame([(sha, "python", [])], "codegraph_sha256 string, language string, reasons array<struct<reason:string,class:string,count:bigint,samples:array<string>>>")
    inventory = (spark.createDataFrame([("py", 1, "c", True), ("ts", 2, "none", False)], "language string, files int, collector string, collected boolean"), spark.createDataFrame([("a.py", "collected"), ("z.py", "no-symbols")], "path string, status string"))
    faults, told = audited(spark, document(), facts=facts, manifest=manifest, report=report, inventory=inventory)
    assert faults == [("coverage-gap", "$.files['z.py']"), ("language-not-collected", "$.languages['ts']")]
    assert (told["status"], told["survey"], told["checks_run"], told["nodes"], told["coverage"]["no_symbols"]) == ("passed", "ready", ["V0", "V1", "V2", "V3", "manifest", "V4", "coverage"], 3, 1)
    drifted = spark.createDataFrame([(sha, {"a.py": "old", "b.py": "gone"})], "codegraph_sha256 string, sources map<string,string>")
    assert audited(spark, document(), facts=facts, manifest=drifted)[0] == [("source-drift", "$.sources['a.py']"), ("source-drift", "$.sources['b.py']")]
    other = spark.createDataFrame([("other", {"a.py": now})], "codegraph_sha256 string, sources map<string,string>")
    faults, told = audited(spark, document(), facts=facts, manifest=other, report=report.limit(0))
    assert [f[0] for f in faults] == ["generation-mismatch", "report-stale"] and told["survey"] == "blocked" and "manifest mismatch" in told["blocked_by"]


def test_every_layer_finds_its_faults(spark):
    assert audited(spark, "{")[0] == [("unreadable", "$")] and audited(spark, [1])[0] == [("top-field", "$")]
    bad = document(schema_version=lambda v: 3, language=lambda v: "perl", nodes=lambda v: [*v, {"id": 5}, {**v[0], "kind": "widget", "line": 99}, {**v[0], "id": "o", "file": "../o.py"}, {**v[0], "id": "l", "line": None}, {**v[2], "id": "y", "module": "m"}], edges=lambda v: [*v, v[0], {**v[0], "to": "zz"}, {**v[0], "from": "x"}, {**v[1], "from": "b", "constraint": None}, {**v[0], "kind": "odd"}, {**v[0], "from": "b", "to": "a", "occurrences": 0, "file": "gone.py", "line": 1}])
    facts = audit.file_facts(spark.createDataFrame([("a.py", b"x\ny"), ("o.py", b"")], "path string, content binary"))
    got = audited(spark, bad, facts=facts)[0]
    assert got == [
        ("duplicate-edge", "$.edges[2]"), ("duplicate-node", "$.nodes[4].id"), ("edge-shape", "$.edges[5]"), ("edge-shape", "$.edges[6]"), ("external-node", "$.nodes[7]"), ("external-source", "$.edges[4]"), ("file-missing", "$.edges[7].file"), ("file-outside-repo", "$.nodes[5].file"), ("first-party-location", "$.nodes[6]"),
        ("freshness-unknown", "$"), ("language", "$.language"), ("line-out-of-range", "$.nodes[4].line"), ("node-kind", "$.nodes[4].kind"), ("node-shape", "$.nodes[3]"), ("occurrences-range", "$.edges[7].occurrences"), ("schema-version", "$.schema_version"),
    ]
    lists = document(modules=lambda v: [{"id": "m", "depends_on": ["q", "m"]}, {"id": "m", "depends_on": ["k"]}, {"id": "un", "depends_on": []}], edges=lambda v: [*v, {**v[0], "to": "zz"}, {**v[1], "from": "b", "constraint": True}])
    assert audited(spark, lists)[0] == [
        ("dangling-edge", "$.edges[2]"), ("external-constraint", "$.edges[3]"), ("module-dep", "$.modules[0].depends_on"), ("module-dep", "$.modules[0].depends_on"), ("module-dep", "$.modules[1].depends_on"), ("module-dep-mismatch", "$.modules[0].depends_on"),
        ("module-list", "$.modules"), ("module-list", "$.modules"), ("module-list", "$.modules"),
    ]
    assert audited(spark, document(nodes=lambda v: []))[0][0] == ("dangling-edge", "$.edges[0]") and ("empty-graph", "$.nodes") in audited(spark, document(nodes=lambda v: []))[0]
    assert ("external-only", "$.nodes") in audited(spark, document(nodes=lambda v: v[2:]))[0]
    died = spark.createDataFrame([("griffe", 1, ["boom"])], "step string, returncode int, stderr_tail array<string>")
    assert audit.failure_document(died)["blocked_by"] == ["collect-failed"] and audited(spark, document(), failure=died)[1]["status"] == "failed"
    assert {r["code"] for r in audit.layers(spark).collect()} == set(audit.fixed.LAYER) and len(audit.fixed.LAYER) == 34


def test_paths_that_leave_the_repository(spark):
    paths = ["a/../b.py", "../a.py", "a/../../b.py", "/a.py", "./a.py", "a/b/../../c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(audit.outside_repo(audit.F.col("p"))).collect()] == [False, True, True, True, False, False]
