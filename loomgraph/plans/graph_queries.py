"""Queries of the normalizers, the audit, plans of reading and small operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, csharp, normalize, python_graph
from ..session import table
from .queries import query

# --- C++ elements: parts are types, suppliers are containers of parts -------------

_N = "(SELECT count(*) FROM part)"
_CPP = f"""WITH el AS (SELECT 'P' || p_partkey AS eid, 'N' || p_partkey AS shown, CASE WHEN p_partkey % 4 = 0 THEN 'X:Qt' WHEN p_partkey % 9 = 0 THEN 'X:(STL) std' ELSE 'N' || p_partkey END AS node, p_size % 5 = 0 AS abstract FROM part),
wr AS (SELECT 'V' || s_suppkey AS eid, CASE WHEN s_suppkey % 4 = 0 THEN 'N' || ((s_suppkey * 3 - 3) % {_N} + 1) ELSE 'N' || ((s_suppkey * 3) % {_N} + 1) END AS shown FROM supplier),
ends AS (SELECT eid, node, abstract FROM el UNION ALL SELECT wr.eid, node, false FROM wr JOIN el ON wr.shown = el.shown),
rel AS (SELECT 'P' || l_partkey AS s, CASE WHEN l_linenumber % 3 = 0 THEN 'V' || l_suppkey ELSE 'P' || ((l_partkey * 7) % {_N} + 1) END AS d, CASE WHEN l_quantity < 5 THEN 'containment' WHEN l_quantity < 9 THEN 'odd' WHEN l_returnflag = 'A' THEN 'aggregation' WHEN l_returnflag = 'R' THEN 'extension' ELSE 'association' END AS t FROM lineitem),
pr AS (SELECT a.node AS s, b.node AS d, CASE t WHEN 'aggregation' THEN 'composition' WHEN 'association' THEN 'aggregation' WHEN 'extension' THEN CASE WHEN b.abstract THEN 'realization' ELSE 'inheritance' END END AS kind FROM rel JOIN ends a ON rel.s = a.eid JOIN ends b ON rel.d = b.eid WHERE t NOT IN ('containment', 'odd'))"""


def _elements(spark, d):
    """Elements and relations of a class diagram.  A container of four holds another container."""
    n = table(spark, d, "part").count()
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    text, none = (lambda v: F.lit(v).cast("string")), F.lit(None)
    place = lambda f, l: F.struct(f.cast("string").alias("file"), l.cast("int").alias("line"))  # noqa: E731,E741
    no_members = F.array().cast("array<struct<name:string,source_location:struct<file:string,line:int>>>")
    args = lambda a: F.array(F.struct(a.alias("type"), text(None).alias("name")))
    name = lambda i: F.concat(F.lit("N"), i)
    types = table(spark, d, "part").select(
        F.concat(F.lit("P"), k).alias("id"), name(k).alias("name"), name(k).alias("display_name"), F.when(k % 4 == 0, "Qt::Core").when(k % 9 == 0, "std").otherwise("app").alias("namespace"), (F.col("p_size") % 5 == 0).alias("is_abstract"), text("class").alias("type"),
        place(F.concat(F.col("p_brand"), F.lit("/a.h")), k % 300 + 1).alias("source_location"), no_members.alias("members"), F.array().cast("array<struct<type:string,name:string>>").alias("template_parameters"), k.cast("bigint").alias("ord"),
    )
    shown = lambda i: F.concat(F.lit("vector<"), i, F.lit(">"))
    held = F.when(s % 4 == 0, shown(s - 1)).otherwise(name((s * 3) % n + 1))
    boxes = table(spark, d, "supplier").select(
        F.concat(F.lit("V"), s).alias("id"), text("vector").alias("name"), shown(s).alias("display_name"), text("std").alias("namespace"), F.lit(False).alias("is_abstract"), text("class").alias("type"), place(none, none).alias("source_location"), no_members.alias("members"), args(held).alias("template_parameters"), (s + 1_000_000_000).cast("bigint").alias("ord"),
    )
    item = table(spark, d, "lineitem")
    kind = F.when(F.col("l_quantity") < 5, "containment").when(F.col("l_quantity") < 9, "odd").when(F.col("l_returnflag") == "A", "aggregation").when(F.col("l_returnflag") == "R", "extension").otherwise("association")
    target = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("V"), "l_suppkey")).otherwise(F.concat(F.lit("P"), (F.col("l_partkey") * 7) % n + 1))
    relations = item.select(kind.alias("type"), F.concat(F.lit("P"), "l_partkey").alias("source"), target.alias("destination"), F.col("l_linestatus").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("ord"))
    return types.unionByName(boxes), relations


def _by_name(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    name = F.when(F.col("kind") == "external", F.col("id")).otherwise(F.col("name"))
    told = nodes_.select("id", name.alias("name"))
    return edges.join(told.withColumnsRenamed({"id": "src", "name": "source"}), "src").join(told.withColumnsRenamed({"id": "dst", "name": "target"}), "dst").select("source", "target", F.col("kind"), F.col("occurrences"))


@query(_CPP + " SELECT s AS source, d AS target, kind, count(*) AS occurrences FROM pr WHERE s <> d AND s NOT LIKE 'X:%' GROUP BY ALL")
def cpp_edges(spark: SparkSession, d: str) -> DataFrame:
    whole, edges, _, _ = normalize.normalize(*_elements(spark, d), namespaces=("app",))
    return _by_name(whole, edges)


@query(_CPP + """, e AS (SELECT DISTINCT s, d, kind FROM pr WHERE s <> d AND s NOT LIKE 'X:%'), c AS (
SELECT 'R5 투과 래퍼' AS reason, count(*) AS n FROM wr UNION ALL SELECT '1차 노드', count(*) FROM el WHERE node NOT LIKE 'X:%' UNION ALL SELECT '외부 원본 타입', count(*) FROM el WHERE node LIKE 'X:%'
UNION ALL SELECT 'containment 버림(자리 없음)', count(*) FROM rel WHERE t = 'containment' UNION ALL SELECT '모르는 관계 종류', count(*) FROM rel WHERE t = 'odd' UNION ALL SELECT '끝점 해소 실패', count(*) FROM rel WHERE t NOT IN ('containment', 'odd') AND (s NOT IN (SELECT eid FROM ends) OR d NOT IN (SELECT eid FROM ends))
UNION ALL SELECT '자기참조 버림', count(*) FROM pr WHERE s = d UNION ALL SELECT 'R4 외부발 간선 버림', count(*) FROM pr WHERE s <> d AND s LIKE 'X:%' UNION ALL SELECT '중복 간선 접음', (SELECT count(*) FROM pr WHERE s <> d AND s NOT LIKE 'X:%') - (SELECT count(*) FROM e)
UNION ALL SELECT 'R1 로 제거된 외부 노드', count(DISTINCT node) FROM el WHERE node LIKE 'X:%' AND node NOT IN (SELECT d FROM e)) SELECT reason, n FROM c WHERE n > 0""")
def cpp_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Types without a place have no module, so nothing is counted across modules."""
    report = normalize.normalize(*_elements(spark, d), namespaces=("app",))[3]
    return report.filter("reason <> '모듈 간 의존'").select("reason", F.col("count").alias("n"))


# --- C# types ---------------------------------------------------------------------

_CS = f"""WITH ty AS (SELECT 'P' || p_partkey AS tid, CASE WHEN p_partkey % 11 = 0 THEN 'System.String' ELSE 'N.P' || p_partkey END AS name, p_partkey % 5 <> 0 AS own, CASE WHEN p_partkey % 7 < 3 THEN 'com.lib' || (p_partkey % 7) ELSE '(벤더링) Lib' || (p_partkey % 7) || '.Sub' END AS grp FROM part),
li AS (SELECT 'L' || s_suppkey AS tid, 'P' || CASE WHEN s_suppkey % 4 = 0 THEN ((s_suppkey * 3 - 3) % {_N} + 1) ELSE ((s_suppkey * 3) % {_N} + 1) END AS held FROM supplier),
ends AS (SELECT tid, tid AS id FROM ty UNION ALL SELECT li.tid, held FROM li),
nd AS (SELECT tid, CASE WHEN own THEN name || '@' || tid ELSE 'X:' || grp END AS node, name, own FROM ty),
rel AS (SELECT 'P' || l_partkey AS s, CASE WHEN l_linenumber % 3 = 0 THEN 'L' || l_suppkey ELSE 'P' || ((l_partkey * 7) % {_N} + 1) END AS d, CASE l_returnflag WHEN 'A' THEN 'inheritance' WHEN 'R' THEN 'association' ELSE 'dependency' END AS kind FROM lineitem WHERE l_quantity >= 5),
pr AS (SELECT a.node AS s, b.node AS d, kind FROM rel JOIN ends y ON rel.d = y.tid JOIN nd a ON rel.s = a.tid JOIN nd b ON y.id = b.tid WHERE b.name <> 'System.String')"""


def _types(spark, d):
    n = table(spark, d, "part").count()
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    none = F.array().cast("array<string>")
    one = table(spark, d, "part").select(
        F.concat(F.lit("P"), k).alias("id"), F.when(k % 11 == 0, "System.String").otherwise(F.concat(F.lit("N.P"), k)).alias("name"), F.lit("Class").alias("kind"), F.when(k % 5 == 0, F.concat(F.lit("Lib"), k % 7, F.lit(".Sub"))).otherwise("own").alias("assembly"),
        F.concat(F.lit("Assets/@Scripts/"), "p_brand", F.lit("/f"), k, F.lit(".cs")).alias("file"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("generic_def"), none.alias("type_args"), k.cast("bigint").alias("ord"),
    )
    held = F.when(s % 4 == 0, F.concat(F.lit("L"), s - 1)).otherwise(F.concat(F.lit("P"), (s * 3) % n + 1))
    two = table(spark, d, "supplier").select(
        F.concat(F.lit("L"), s).alias("id"), F.lit("List").alias("name"), F.lit("Class").alias("kind"), F.lit("netstandard").alias("assembly"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit("System.Collections.Generic.List`1").alias("generic_def"), F.array(held).alias("type_args"), (s + 1_000_000_000).cast("bigint").alias("ord"),
    )
    item = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "inherit").when(F.col("l_returnflag") == "R", "assoc").otherwise("depend")
    target = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("L"), "l_suppkey")).otherwise(F.concat(F.lit("P"), (F.col("l_partkey") * 7) % n + 1))
    relations = item.select(kind.alias("kind"), F.concat(F.lit("P"), "l_partkey").alias("src"), target.alias("dst"), F.col("l_linestatus").alias("member"), F.array().cast("array<string>").alias("attrs"), (F.col("l_quantity") < 5).alias("is_enum_member"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("ord"))
    packages = spark.range(3).select(F.concat(F.lit("Lib"), "id").alias("assembly"), F.concat(F.lit("com.lib"), "id").alias("package"), F.col("id").alias("ord"))
    return one.unionByName(two), relations, "own", packages


@query(_CS + " SELECT split_part(s, '@', 1) AS source, split_part(d, '@', 1) AS target, kind, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT s, d, kind, count(*) AS n FROM pr WHERE s <> d AND s NOT LIKE 'X:%' GROUP BY ALL) GROUP BY ALL")
def cs_edges(spark: SparkSession, d: str) -> DataFrame:
    """Own types may share a name, so occurrences are summed by name."""
    whole, edges, _, _ = csharp.normalize(*_types(spark, d))
    return _by_name(whole, edges).groupBy("source", "target", "kind").agg(F.sum("occurrences").alias("occurrences"))


@query(_CS + ", e AS (SELECT DISTINCT d FROM pr WHERE s <> d AND s NOT LIKE 'X:%') SELECT kind, module, count(*) AS n FROM (SELECT 'class' AS kind, p_brand AS module FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT DISTINCT 'external', '__external__' || d FROM e WHERE d LIKE 'X:%') GROUP BY ALL")
def cs_nodes(spark: SparkSession, d: str) -> DataFrame:
    whole = csharp.normalize(*_types(spark, d))[0]
    return whole.select("kind", F.when(F.col("kind") == "external", F.concat("module", "id")).otherwise(F.col("module")).alias("module")).groupBy("kind", "module").agg(F.count("*").alias("n"))


# --- Python modules: nations are modules, suppliers their classes -------------------

_PY = """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS m, 'pk.m' || s_nationkey || '.S' || s_suppkey AS name, (s_suppkey * 3) % (SELECT count(*) FROM supplier) AS t FROM supplier),
f AS (SELECT m, min(k) AS k FROM s GROUP BY m), j AS (SELECT a.*, b.name AS target, c.name AS first FROM s a JOIN s b ON a.t = b.k JOIN f ON a.m = f.m JOIN s c ON f.k = c.k),
u AS (SELECT name AS source, target, 'inheritance' AS kind FROM j UNION ALL SELECT name, target, 'association' FROM j UNION ALL SELECT name, target, 'association' FROM j WHERE k % 2 = 0 UNION ALL SELECT name, 'X:(표준) stdlib', 'dependency' FROM j UNION ALL SELECT name, first, 'dependency' FROM j UNION ALL SELECT name, 'X:numpy', 'dependency' FROM j WHERE k % 3 = 0)"""


def _dump(spark, d):
    """One row for each module: a class of each supplier, with a base, annotated attributes and a method."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("m"))
    n = s.count()
    t = s.withColumn("t", (F.col("k") * 3) % n)
    home = s.select(F.col("k").alias("t"), F.concat(F.lit("pk.m"), "m", F.lit(".S"), "k").alias("full"))
    rows = t.join(home, "t")
    name = lambda v: f'{{"cls":"ExprName","name":"{v}"}}'
    x, first = name("x@K@"), name("First")
    held = f'{{"cls":"ExprSubscript","left":{name("list")},"slice":{{"cls":"ExprBinOp","operator":"|","left":{x},"right":"None"}}}}'
    body = (
        f'"S@K@":{{"kind":"class","lineno":3,"bases":[{x}],"members":{{"f":{{"kind":"attribute","lineno":4,"annotation":{held}}},@TWICE@'
        f'"go":{{"kind":"function","lineno":6,"labels":[],"parameters":[{{"name":"self","annotation":null}},{{"name":"a","annotation":{name("os.PathLike")}}},{{"name":"b","annotation":{first}}}],"returns":@BACK@}}}}}}'
    )
    twice = F.when(F.col("k") % 2 == 0, f'"g":{{"kind":"attribute","lineno":5,"annotation":{x}}},').otherwise("")
    back = F.when(F.col("k") % 3 == 0, '{"cls":"ExprAttribute","values":[{"cls":"ExprName","name":"np"},{"cls":"ExprName","name":"ndarray"}]}').otherwise("null")
    cls = F.replace(F.replace(F.replace(F.lit(body), F.lit("@TWICE@"), twice), F.lit("@BACK@"), back), F.lit("@K@"), F.col("k").cast("string"))
    imported = F.concat(F.lit('"x'), "k", F.lit('":"'), "full", F.lit('"'))
    parts = rows.groupBy("m").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", cls.alias("c")))).getField("c"), ",").alias("members"), F.array_join(F.collect_list(imported), ",").alias("imports"), F.min("k").alias("first"))
    alias = F.concat(F.lit('"First":{"kind":"attribute","lineno":1,"labels":["module-attribute"],"value":{"cls":"ExprSubscript","left":{"cls":"ExprName","name":"tuple"},"slice":{"cls":"ExprTuple","elements":["...",{"cls":"ExprName","name":"S'), "first", F.lit('"}]}}},'))
    doc = F.concat(F.lit('{"kind":"module","filepath":"src/pk/m'), "m", F.lit('.py","imports":{"os":"os","np":"numpy",'), "imports", F.lit('},"members":{'), alias, "members", F.lit("}}"))
    return parts.select(F.concat(F.lit("pk.m"), "m").alias("name"), doc.alias("doc"))


@query(_PY + " SELECT source, target, kind, count(*) AS occurrences FROM u WHERE source <> target GROUP BY ALL")
def py_edges(spark: SparkSession, d: str) -> DataFrame:
    whole, edges, _, _ = python_graph.normalize(_dump(spark, d))
    return _by_name(whole, edges)


@query(_PY + """, c AS (SELECT '모듈' AS reason, count(DISTINCT m) AS n FROM s UNION ALL SELECT '1차 노드', count(*) FROM s UNION ALL SELECT '형 별칭 펼침', count(*) FROM s UNION ALL SELECT 'R5 투과 컨테이너 경유', 2 * count(*) FROM s UNION ALL SELECT 'R7 원시 타입 버림', 2 * count(*) FROM s UNION ALL SELECT '자기참조 버림', count(*) FROM u WHERE source = target
UNION ALL SELECT '중복 간선 접음', (SELECT count(*) FROM u WHERE source <> target) - (SELECT count(*) FROM (SELECT DISTINCT source, target, kind FROM u WHERE source <> target)) UNION ALL SELECT '외부 원본 타입', count(DISTINCT target) FROM u WHERE target LIKE 'X:%') SELECT reason, n FROM c WHERE n > 0""")
def py_ledger(spark: SparkSession, d: str) -> DataFrame:
    return python_graph.normalize(_dump(spark, d))[3].select("reason", F.col("count").alias("n"))


@query("SELECT 'pk.m' || s_nationkey || '.S' || s_suppkey AS name, 'C' || row_number() OVER (ORDER BY 'pk.m' || s_nationkey || '.S' || s_suppkey) AS id, 'pk' AS module, 'src/pk/m' || s_nationkey || '.py' AS file, 3 AS line FROM supplier")
def py_nodes(spark: SparkSession, d: str) -> DataFrame:
    return python_graph.normalize(_dump(spark, d))[0].filter("kind <> 'external'").select("name", "id", "module", "file", "line")


# --- audit ---------------------------------------------------------------------------

_DOC = """WITH nd AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, 'n' || CASE WHEN p_partkey % 40 = 7 THEN p_partkey - 1 ELSE p_partkey END AS id, CASE WHEN p_partkey % 31 = 0 THEN 'widget' WHEN p_partkey % 13 = 0 THEN 'external' ELSE 'class' END AS kind,
CASE WHEN p_partkey % 13 = 0 AND p_partkey % 26 <> 0 THEN '__external__' ELSE p_brand END AS module, CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '../x.py' WHEN p_partkey % 23 = 0 THEN 'gone.py' ELSE 'f' || (p_partkey % 6) || '.py' END AS file, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 60 END AS line FROM part),
ed AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, 'n' || (s_suppkey % (SELECT count(*) FROM part) + 1) AS src, 'n' || ((s_suppkey * 7) % (SELECT count(*) + 20 FROM part) + 1) AS dst, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS occurrences, s_suppkey % 2 = 0 AS free FROM supplier),
lk AS (SELECT id, arg_max(kind, i) AS kind, arg_max(module, i) AS module FROM nd GROUP BY id), own AS (SELECT DISTINCT module FROM nd WHERE kind <> 'external'),
md AS (SELECT DISTINCT p_brand AS id FROM part WHERE p_brand <> 'Brand#11' UNION ALL SELECT 'Ghost')"""


def _document(spark, d):
    """A graph document of many faults: nodes of parts, edges of suppliers."""
    p, s, k, j = table(spark, d, "part"), table(spark, d, "supplier"), F.col("p_partkey"), F.col("s_suppkey")
    n = p.count()
    text = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    ident = F.concat(F.lit("n"), F.when(k % 40 == 7, k - 1).otherwise(k))
    kind = F.when(k % 31 == 0, "widget").when(k % 13 == 0, "external").otherwise("class")
    module = F.when((k % 13 == 0) & (k % 26 != 0), "__external__").otherwise(F.col("p_brand"))
    file = F.when((k % 13 == 0) | (k % 17 == 0), None).when(k % 19 == 0, "../x.py").when(k % 23 == 0, "gone.py").otherwise(F.concat(F.lit("f"), k % 6, F.lit(".py")))
    line = F.when(k % 13 != 0, k % 60)
    node = F.concat(F.lit('{"id":'), text(ident), F.lit(',"name":'), text(ident), F.lit(',"kind":'), text(kind), F.lit(',"module":'), text(module), F.lit(',"file":'), text(file), F.lit(',"line":'), F.coalesce(line.cast("string"), F.lit("null")), F.lit("}"))
    end = lambda c: F.concat(F.lit('"n'), c, F.lit('"'))
    edge = F.concat(F.lit('{"from":'), end(j % n + 1), F.lit(',"to":'), end((j * 7) % (n + 20) + 1), F.lit(',"kind":"dependency","label":null,"file":null,"line":null,"occurrences":'), F.when(j % 3 == 0, "0").otherwise("1"), F.when(j % 2 == 0, ',"constraint":false}').otherwise("}"))
    listed = p.filter("p_brand <> 'Brand#11'").select(F.col("p_brand").alias("id")).distinct().unionByName(spark.range(1).select(F.lit("Ghost").alias("id")))
    mod = F.concat(F.lit('{"id":'), text(F.col("id")), F.lit(',"depends_on":["Brand#12","Nowhere"]}'))
    gathered = lambda df, key, c: df.agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), c.alias("c")))).getField("c"), ",").alias("x"))
    a, b, c = gathered(p, "p_partkey", node), gathered(s, "s_suppkey", edge).withColumnRenamed("x", "y"), gathered(listed, "id", mod).withColumnRenamed("x", "z")
    # three rows of one document
    doc = F.concat(F.lit('{"schema_version":2,"language":"python","platform":"x","source_tool":"t","repo_commit":null,"nodes":['), "x", F.lit('],"edges":['), "y", F.lit('],"modules":['), "z", F.lit("]}"))
    return audit.from_text(a.join(F.broadcast(b)).join(F.broadcast(c)).select(doc.alias("text")))


def _facts(spark):
    files = spark.range(6).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"), F.repeat(F.lit("x\n"), (F.col("id") * 10 + 5).cast("int")).cast("binary").alias("content"))
    return audit.file_facts(files)


@query(_DOC + " SELECT 'node-kind' AS code, '$.nodes[' || i || '].kind' AS at FROM nd WHERE kind = 'widget' UNION ALL SELECT 'occurrences-range', '$.edges[' || i || '].occurrences' FROM ed WHERE occurrences < 1")
def graph_shape_faults(spark: SparkSession, d: str) -> DataFrame:
    read = _document(spark, d)
    return audit.check_top(read).unionByName(audit.elements(read)[3]).select("code", "at")


@query(_DOC + """, x AS (SELECT ed.*, a.kind AS sk, a.module AS sm, b.kind AS dk, b.module AS dm, a.id AS hs, b.id AS hd FROM ed LEFT JOIN lk a ON src = a.id LEFT JOIN lk b ON dst = b.id),
ac AS (SELECT DISTINCT sm AS id, dm AS dep FROM x WHERE coalesce(dk, '') <> 'external' AND sm <> dm), st AS (SELECT id, unnest(['Brand#12', 'Nowhere']) AS dep FROM md), mi AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM md)
SELECT 'duplicate-node' AS code, '$.nodes[' || i || '].id' AS at FROM nd WHERE i > (SELECT min(i) FROM nd z WHERE z.id = nd.id) UNION ALL SELECT 'external-node', '$.nodes[' || i || ']' FROM nd WHERE (kind = 'external') <> (module = '__external__') OR kind = 'external' AND (file IS NOT NULL OR line IS NOT NULL)
UNION ALL SELECT 'first-party-location', '$.nodes[' || i || ']' FROM nd WHERE kind <> 'external' AND module <> '__external__' AND (file IS NULL OR line IS NULL) UNION ALL SELECT 'dangling-edge', '$.edges[' || i || ']' FROM x WHERE hs IS NULL OR hd IS NULL
UNION ALL SELECT 'external-source', '$.edges[' || i || ']' FROM x WHERE sk = 'external' UNION ALL SELECT 'external-constraint', '$.edges[' || i || ']' FROM x WHERE dk = 'external' AND NOT free UNION ALL SELECT 'duplicate-edge', '$.edges[' || i || ']' FROM ed WHERE i > (SELECT min(i) FROM ed z WHERE z.src = ed.src AND z.dst = ed.dst)
UNION ALL SELECT 'module-list', '$.modules' FROM own WHERE module NOT IN (SELECT id FROM md) UNION ALL SELECT 'module-list', '$.modules' FROM md WHERE id NOT IN (SELECT module FROM own)
UNION ALL SELECT 'module-dep', '$.modules[' || i || '].depends_on' FROM mi WHERE id = 'Brand#12' UNION ALL SELECT 'module-dep', '$.modules[' || i || '].depends_on' FROM mi UNION ALL SELECT 'module-dep', '$.modules[' || i || '].depends_on' FROM mi WHERE id <> 'Brand#12' AND 'Brand#12' NOT IN (SELECT id FROM md)
UNION ALL SELECT 'module-dep-mismatch', '$.modules[' || i || '].depends_on' FROM mi""")
def graph_consistency_faults(spark: SparkSession, d: str) -> DataFrame:
    got = audit.elements(_document(spark, d))
    return audit.check_consistency(*got[:3], got[4]).select("code", "at")


_PLACES = _DOC + """, pl AS (SELECT '$.nodes[' || i || ']' AS place, file, line FROM nd WHERE file IS NOT NULL), fs AS (
SELECT 'file-outside-repo' AS code, place || '.file' AS at FROM pl WHERE file LIKE '../%' UNION ALL SELECT 'file-missing', place || '.file' FROM pl WHERE file = 'gone.py' UNION ALL SELECT 'line-out-of-range', place || '.line' FROM pl WHERE file LIKE 'f%' AND line NOT BETWEEN 1 AND CAST(substr(file, 2, 1) AS INT) * 10 + 5)"""


@query(_PLACES + ' SELECT code, "at" FROM fs')
def graph_source_faults(spark: SparkSession, d: str) -> DataFrame:
    nodes_, edges, _, _, _ = audit.elements(_document(spark, d))
    return audit.check_sources(nodes_, edges, _facts(spark))[0].select("code", "at")


@query(_PLACES + ", c AS (SELECT 'freshness' AS section, code, count(*) AS n FROM fs GROUP BY ALL) SELECT section, code, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM c")
def graph_freshness_section(spark: SparkSession, d: str) -> DataFrame:
    nodes_, edges, _, _, _ = audit.elements(_document(spark, d))
    return audit.sections(audit.check_sources(nodes_, edges, _facts(spark))[0]).select("section", "code", "n", "total")


@query("""WITH f AS (SELECT p_type AS path, CASE WHEN p_size % 4 = 0 THEN 'no-symbols' WHEN p_size % 4 = 1 THEN 'excluded' ELSE 'collected' END AS status, p_partkey AS k FROM part) SELECT 'coverage-gap' AS code, '$.files[''' || path || k || ''']' AS at FROM f WHERE status = 'no-symbols' UNION ALL SELECT 'language-not-collected', '$.languages[''' || n_name || ''']' FROM nation WHERE n_nationkey % 2 = 1
UNION ALL SELECT CASE event_type WHEN 'error' THEN 'unknown-kind' ELSE 'unresolved-drop' END, '$.reasons[''' || event_type || ''']' FROM (SELECT DISTINCT event_type FROM events WHERE event_type IN ('error', 'click'))""")
def graph_coverage_faults(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    files = p.select(F.concat("p_type", "p_partkey").alias("path"), F.when(F.col("p_size") % 4 == 0, "no-symbols").when(F.col("p_size") % 4 == 1, "excluded").otherwise("collected").alias("status"))
    languages = table(spark, d, "nation").select(F.col("n_name").alias("language"), F.lit(1).alias("files"), F.lit("c").alias("collector"), (F.col("n_nationkey") % 2 == 0).alias("collected"))
    cls = F.when(F.col("event_type") == "error", "fault").when(F.col("event_type") == "click", "unresolved").otherwise("policy")
    reasons = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct(F.col("event_type").alias("reason"), cls.alias("class"), F.col("n").alias("count"), F.array().cast("array<string>").alias("samples"))).alias("reasons"))
    report = reasons.select(F.lit("sha").alias("codegraph_sha256"), F.lit("python").alias("language"), "reasons")
    return audit.check_inventory(languages, files)[0].unionByName(audit.check_ledger(report, "sha", "python")).select("code", "at")

