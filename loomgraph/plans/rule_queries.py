"""Queries of small rules, listings, declarations, labels and states, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import rules as R
from ..functions import text as X
from ..operators import audit, changes, evidence, facts, normalize, ordered, quiz, survey, terms
from ..session import table
from ..sources import readers, sinks
from .queries import query


def _customers(spark, d):
    return table(spark, d, "customer"), F.col("c_custkey")


def _pick(k, *values):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


@query("""WITH c AS (SELECT c_custkey AS k, ['a/b.py:3-7', 'a/b.py:12', 'a/b.py', 'x:y.py:4'][c_custkey % 4 + 1] AS w, ['ns::Box<int>', 'a.b.Lid[]', 'k##m'][c_custkey % 3 + 1] AS n, CASE WHEN c_custkey % 5 = 0 THEN 'concept' ELSE 'class' END AS kind FROM customer)
SELECT k, CASE k % 4 WHEN 3 THEN 'x:y.py' ELSE 'a/b.py' END AS file, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 3 THEN 4 END AS line, CASE WHEN k % 3 = 0 THEN CASE WHEN kind = 'class' THEN 'Box' ELSE n END WHEN k % 3 = 1 THEN CASE WHEN kind = 'class' THEN 'Lid' ELSE 'a.b.Lid' END ELSE CASE WHEN kind = 'class' THEN 'm' ELSE n END END AS stem,
k % 7 = 0 OR k % 6 = 0 AS reading, k % 11 = 0 AS caught_up, k % 13 <> 1 OR k % 17 = 0 OR k % 2 = 0 AS collect, CASE WHEN k % 3 = 0 THEN 'py' WHEN k % 3 = 1 THEN 'ts' END AS word, k % 10 <> 0 AS warned FROM c""")
def record_rules(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d)
    where, name = _pick(k, "a/b.py:3-7", "a/b.py:12", "a/b.py", "x:y.py:4"), _pick(k, "ns::Box<int>", "a.b.Lid[]", "k##m")
    place = R.split_where(where)
    return c.select(
        k.alias("k"), place["file"].alias("file"), place["line"].alias("line"), R.stem(name, F.when(k % 5 == 0, "concept").otherwise("class")).alias("stem"), R.written_by_reading(F.when(k % 7 == 0, "reading"), F.when(k % 6 == 0, "reading")).alias("reading"),
        R.caught_up(F.when(k % 11 == 0, "h"), F.lit("h")).alias("caught_up"), R.needs_collect(k % 13 == 1, F.when(k % 2 == 0, 1).otherwise(0), k % 17 == 0, F.lit(False), F.lit(False)).alias("collect"), R.one_word(_pick(k, " PY ", "ts", "perl"), ("py", "ts")).alias("word"), R.version_note((k % 10).cast("string"), F.lit("0"))["warn"].alias("warned"),
    )


@query("""SELECT c_custkey AS k, c_custkey % 4 IN (0, 1) AS fits, c_custkey % 3 = 0 AS similar_, CASE c_custkey % 5 WHEN 0 THEN 'roslyn-dump' WHEN 1 THEN 'clang-uml' WHEN 2 THEN 'griffe+pycalls' ELSE 'none' END AS collector, CASE WHEN c_custkey % 2 = 0 THEN 'tool' END AS selected, CASE WHEN c_custkey % 6 = 0 THEN 7 END AS member_line, 'm1,m2' AS shown, CAST(c_custkey % 3 AS INT) AS more_,
CASE c_custkey % 4 WHEN 0 THEN 'heuristic' WHEN 1 THEN 'compiler' ELSE 'none' END AS resolution, 'a' || (c_custkey % 9) || ', b' AS firsts, 'a\\.b\\*' || c_custkey AS pattern FROM customer""")
def choice_rules(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d)
    kind, path = _pick(k, "wiki", "terms", "wiki", "graph"), _pick(k, "wiki/a.md", "terms.json", "wiki/../a.md", "/codegraph.json")
    top = F.array(F.lit("src"), _pick(k, "App.slnx", "CMakeLists.txt", "requirements.txt", "x", "setup.cfg"))
    member = lambda n, line: F.struct(F.lit(n).alias("name"), F.lit("f").alias("file"), F.lit(line).alias("line"))
    members = F.when(k % 6 == 0, F.array(member("m", 7), member("n", 8))).otherwise(F.array(member("m", 7), member("m", 9)))
    method = lambda n, a: F.struct(n.alias("name"), F.lit(a).alias("args"))
    methods = F.concat(F.array(method(F.lit("C"), 0), method(F.lit("GetX"), 0), method(F.lit("m1"), 0), method(F.lit("m2"), 1)), F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: method(F.concat(F.lit("x"), i), 0)))
    shown = R.shown_methods(F.slice(methods, F.lit(1), (4 + k % 3).cast("int")), F.lit("C"), 2)
    return c.select(
        k.alias("k"), R.entry_fits(kind, path).alias("fits"), R.similar(F.lit("report"), _pick(k, "reporting", "other", "report")).alias("similar_"), R.collector_for(top).alias("collector"), R.collector_from(F.when(k % 2 == 0, '{"collector":"tool"}').otherwise('{"collector":""}')).alias("selected"),
        R.member_at(members, F.lit("m"))["line"].alias("member_line"), F.array_join(F.transform(shown["shown"], lambda m: m["name"]), ",").alias("shown"), shown["more"].cast("int").alias("more_"), audit.capabilities(_pick(k, "python", "cpp", "perl", "x"))["resolution"].alias("resolution"),
        R.first_of(F.array(F.concat(F.lit("a"), k % 9), F.lit("b"), F.lit("c")), 2).alias("firsts"), X.escape_regex(F.concat(F.lit("a.b*"), k)).alias("pattern"),
    )


_FOLDER = "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'obj/' ELSE p_brand || '/' END || 'f' || (p_partkey % 150) || '.py' AS path FROM part"


@query(f"WITH l AS (SELECT DISTINCT path FROM ({_FOLDER})) SELECT list_extract(string_split(path, '/'), -1) AS name, count(*) AS n, CASE WHEN count(*) = 1 THEN min(path) END AS path FROM l WHERE path NOT LIKE 'obj/%' GROUP BY 1")
def files_by_name(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 4 == 0, "obj/").otherwise(F.concat("p_brand", F.lit("/"))), F.lit("f"), k % 150, F.lit(".py"))
    return readers.source_index(table(spark, d, "part").select(path.alias("path")).distinct())


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '/else/a b.py' ELSE 'src/a b' || c_custkey || '.py' END AS path, 'pk.a' || c_custkey AS module, 'outer::inner' AS namespace, 'void f' || c_custkey || '(int x, char)' AS signature FROM customer")
def places_and_signatures(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d)
    uri = F.when(k % 3 == 0, "file:///else/a%20b.py").otherwise(F.concat(F.lit("file:///repo/src/a%20b"), k, F.lit(".py")))
    params = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(n).alias("name")) for t, n in (("int", "x"), ("char", ""))])
    return c.select(k.alias("k"), readers.repo_relative(uri, "/repo").alias("path"), X.dotted_module(F.concat(F.lit("src/pk/a"), k, F.lit(".py"))).alias("module"), readers.qualified_namespace(F.array(F.lit("inner"), F.lit("outer"), F.lit("GlobalNamespace"))).alias("namespace"), readers.signature(F.lit("void"), F.concat(F.lit("f"), k), params).alias("signature"))


@query("WITH s AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'u' || (c_custkey % 20) ELSE '' END AS usr, 'f' || (c_custkey % 8) AS file, CAST(c_custkey % 10 AS INT) AS line, 'n' || (c_custkey % 4) AS name, printf('p%06d', c_custkey) AS path FROM customer), k AS (SELECT *, CASE WHEN usr <> '' THEN usr ELSE file || '|' || line || '|' || name END AS key FROM s) SELECT arg_min(path, path) AS path, arg_min(file, path) AS file, arg_min(line, path) AS line, arg_min(name, path) AS name FROM k GROUP BY key")
def first_symbols(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d)
    s = c.select(F.when(k % 3 == 0, F.concat(F.lit("u"), k % 20)).otherwise("").alias("usr"), F.concat(F.lit("f"), k % 8).alias("file"), (k % 10).cast("int").alias("line"), F.concat(F.lit("n"), k % 4).alias("name"), F.format_string("p%06d", k).alias("path"))
    return readers.first_symbols(s).select("path", "file", "line", "name")


_CODE = "'# about ' || c_name || chr(10) || chr(10) || '@dec' || chr(10) || 'class K' || c_custkey || ':' || chr(10) || '    def go(self): pass' || chr(10) || 'x = 1'"


@query("SELECT 'f' || c_custkey AS path, 6 AS n_lines, 4 AS line, 'class' AS kind, 'K' || c_custkey AS name, substr('about ' || c_name, 1, 20) AS doc FROM customer UNION ALL SELECT 'f' || c_custkey, 6, 5, 'def', 'go', '' FROM customer")
def declared_names(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d)
    text = F.concat(F.lit("# about "), "c_name", F.lit("\n\n@dec\nclass K"), k, F.lit(":\n    def go(self): pass\nx = 1"))
    return readers.declarations(c.select(F.concat(F.lit("f"), k).alias("path"), text.alias("text")), "py", 20)


@query("WITH s AS (SELECT 'C' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN 'app' ELSE 'Qt' END AS ns, c_custkey AS k FROM customer), o AS (SELECT * FROM s WHERE ns = 'app') SELECT 'app::' || name AS name, 'C' || row_number() OVER (ORDER BY k) AS id, 'src' AS module, 'doc' || k AS doc FROM o")
def documented_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Documentation symbols of customers, all new, half of them of another namespace."""
    c, k = _customers(spark, d)
    s = c.select(F.concat(F.lit("C"), k).alias("name"), F.lit("function").alias("kind"), F.when(k % 2 == 0, "app").otherwise("Qt").alias("namespace"), F.lit("src/a.h").alias("file"), F.lit(1).alias("line"), F.lit("").alias("signature"), F.concat(F.lit("doc"), k).alias("doc"), k.alias("ord"))
    none = spark.createDataFrame([], "id string, name string, kind string, module string, file string, line int, signature string, doc string, abstraction string, collapsed_from array<string>")
    return normalize.merge_symbols(none, s, namespaces=("app",))[0].select("name", "id", "module", "doc")


@query("""WITH p AS (SELECT c_custkey AS page, c_custkey % 5 AS layer FROM customer), h AS (SELECT c_custkey AS page FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT layer, count(*) FILTER (WHERE page IN (SELECT page FROM h)) AS k FROM p GROUP BY layer)
SELECT page, layer, CAST(coalesce((SELECT sum(k) FROM n WHERE n.layer < p.layer), 0) AS BIGINT) AS lower_ FROM p WHERE page NOT IN (SELECT page FROM h)""")
def pages_to_write(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d)
    return survey.next_pages(c.select(k.alias("page"), (k % 5).alias("layer")), c.filter(k % 3 == 0).select(k.alias("page"))).withColumnRenamed("lower", "lower_")


@query("SELECT c_custkey AS page, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' WHEN c_custkey % 4 = 1 THEN 'edited' WHEN c_custkey % 3 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM customer")
def page_states(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d)
    pages = c.select(k.alias("page"), F.md5("c_name").alias("hash"))
    recorded = c.filter(k % 4 != 0).select(k.alias("page"), F.md5(F.when(k % 4 == 1, "x").otherwise(F.col("c_name"))).alias("hash"))
    return survey.page_state(pages, recorded, c.filter(k % 3 == 0).select(k.alias("page")))


@query("WITH p AS (SELECT doc_id AS page, 'see f' || (doc_id % 40) || '.py and (g' || (doc_id % 9) || '.ts:3)' AS t FROM documents), c AS (SELECT 'f' || c_custkey || '.py' AS path FROM customer WHERE c_custkey % 3 = 0) SELECT DISTINCT page FROM p JOIN c ON contains(t, 'see ' || path || ' ')")
def stale_pages(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d)
    i = F.col("doc_id")
    pages = table(spark, d, "documents").select(i.alias("page"), F.concat(F.lit("see f"), i % 40, F.lit(".py and (g"), i % 9, F.lit(".ts:3)")).alias("text"))
    return changes.stale_pages(pages, c.filter(k % 3 == 0).select(F.concat(F.lit("f"), k, F.lit(".py")).alias("path")))


@query("""WITH v AS (SELECT 'o' || o_orderkey AS path, CASE o_orderkey % 4 WHEN 0 THEN 'reread' WHEN 1 THEN 'location_only' WHEN 2 THEN 'unchanged' ELSE 'deleted' END AS verdict FROM orders) SELECT 'target' AS what, path FROM v WHERE verdict IN ('reread', 'location_only') UNION ALL SELECT 'unsurveyed', 'o' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 UNION ALL SELECT 'snapshot', 'o' || o_orderkey FROM orders WHERE o_orderkey % 5 <> 0""")
def files_to_read(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    path, mark = F.concat(F.lit("o"), k).alias("path"), lambda df, w: df.select(F.lit(w).alias("what"), "path")
    targets = changes.change_targets(o.select(path, _pick(k, "reread", "location_only", "unchanged", "deleted").alias("verdict")))
    new = o.select(path, F.lit("h").alias("hash"))
    old = o.filter(k % 5 != 0).select(path, F.when(k % 7 == 0, "old").otherwise("h").alias("hash"))
    snapshot = evidence.snapshot_hashes(o.select(path, F.when(k % 5 != 0, "h").alias("file_hash")))
    return mark(targets, "target").unionByName(mark(changes.unsurveyed(new, old), "unsurveyed")).unionByName(mark(snapshot, "snapshot"))


@query("WITH u AS (SELECT 'k' || o_orderkey AS name, CASE WHEN o_custkey % 3 = 0 THEN 'C' ELSE 'n' END || o_custkey AS dep FROM orders), i AS (SELECT 'C' || c_custkey AS id, 'n' || c_custkey AS name FROM customer WHERE c_custkey % 4 <> 0) SELECT u.name, coalesce(i.name, dep) AS dep, CASE WHEN i.name IS NOT NULL OR dep IN (SELECT name FROM i) THEN 'kept' ELSE 'dropped' END AS state FROM u LEFT JOIN i ON dep = i.id")
def normalized_uses(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").filter("c_custkey % 4 <> 0")
    uses = o.select(F.concat(F.lit("k"), "o_orderkey").alias("name"), F.concat(F.when(F.col("o_custkey") % 3 == 0, "C").otherwise("n"), "o_custkey").alias("to"))
    good, bad = terms.normalize_uses(uses, c.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_custkey").alias("name")))
    return good.withColumn("state", F.lit("kept")).unionByName(bad.withColumn("state", F.lit("dropped"))).withColumnRenamed("to", "dep")


@query("WITH b AS (SELECT DISTINCT 'b' || (o_orderkey % 30) AS batch, 'n' || o_custkey AS name FROM orders) SELECT batch, name FROM b WHERE CAST(substr(name, 2) AS INT) IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 > 1)")
def hot_names(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d)
    batches = table(spark, d, "orders").select(F.concat(F.lit("b"), F.col("o_orderkey") % 30).alias("batch"), F.concat(F.lit("n"), "o_custkey").alias("name")).distinct()
    name = F.concat(F.lit("n"), k).alias("name")
    return survey.hot_keys(batches, c.select(name, (k % 2 == 0).alias("shallow")), c.select(name, F.greatest(k % 5 - 1, F.lit(0)).alias("into")))


@query("""WITH e AS (SELECT DISTINCT c_nationkey AS a, (c_nationkey * 3) % 25 AS b FROM customer WHERE c_nationkey <> (c_nationkey * 3) % 25), m AS (SELECT e.*, r.a IS NOT NULL AS back FROM e LEFT JOIN e r ON e.a = r.b AND e.b = r.a), s AS (SELECT *, concat_ws(', ', CASE WHEN a % 2 = 0 THEN 'color=red' END, CASE WHEN back THEN 'dir=both' END) AS style FROM m WHERE NOT back OR 'n' || a < 'n' || b)
SELECT '  "n' || a || '" -> "n' || b || '"' || CASE WHEN style <> '' THEN ' [' || style || ']' ELSE '' END || ';' AS line FROM s""")
def dot_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    e = table(spark, d, "customer").select(n.alias("i"), ((n * 3) % 25).alias("j")).filter("i <> j").distinct()
    pairs = e.select(F.concat(F.lit("n"), "i").alias("a"), F.concat(F.lit("n"), "j").alias("b"), "i")
    return sinks.dot_edges(pairs.select("a", "b"), pairs.filter("i % 2 = 0").select("a", "b"))


@query("SELECT '| ' || n_nationkey || ' | ' || n_name || '\\|x |' AS line FROM nation UNION ALL SELECT n_name || ' /' || n_name FROM nation UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'good' END || n_nationkey FROM nation")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a table, entries of a side bar, and rows on either side of a fault."""
    n = table(spark, d, "nation")
    rows = sinks.markdown_table(n.select("n_nationkey", F.concat("n_name", F.lit("|x")).alias("name")), ["n_nationkey"])
    names = n.select(F.concat("n_name", F.lit(".md")).alias("name")).unionByName(spark.range(1).select(F.lit("index.md").alias("name")))
    bar = sinks.sidebar(names).select(F.concat("text", F.lit(" "), "link").alias("line"))
    good, bad = sinks.split_sinks(n.select("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, "even"))
    return rows.unionByName(bar).unionByName(good.select(F.concat(F.lit("good"), "n_nationkey").alias("line"))).unionByName(bad.select(F.concat("fault", "n_nationkey").alias("line")))


@query("""SELECT c_custkey AS k, 'typing.Dict,K' || c_custkey AS names, 'hello ' || c_name || ' it' AS texts, '{"properties": {"title": {"type": "s"}}}' AS shape, 'Ab,Bc' AS refs, CASE WHEN c_custkey % 2 = 0 THEN 'x 1 ' || c_custkey END AS slots, CASE WHEN c_custkey % 2 = 1 THEN 'missing b' END AS lacking FROM customer""")
def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d)
    tree = F.concat(F.lit('{"cls":"ExprSubscript","left":{"cls":"ExprAttribute","values":[{"cls":"ExprName","name":"typing"},{"cls":"ExprName","name":"Dict"}]},"slice":{"cls":"ExprName","name":"K'), k, F.lit('"}}'))
    doc = F.concat(F.lit('{"a":[{"TextComment":" hello "},{"b":{"TextComment":"'), "c_name", F.lit('"}},{"TextComment":" "},{"TextComment":"it"}]}'))
    schema = F.lit('{"title":"T","properties":{"title":{"title":"x","type":"s"}}}')
    refs = F.lit('{"$ref":"#/d/Bc","x":{"$ref":"#/d/Ab"},"y":{"$ref":"#/d/Bc"}}')
    slots = D.render_slots(F.concat(F.when(k % 2 == 0, "x {{a}} ").otherwise("{{a}} {{b}}"), k), {"a": "1"})
    return c.select(k.alias("k"), F.array_join(D.expression_names(tree), ",").alias("names"), D.nested_texts(doc).alias("texts"), D.without_names(schema).alias("shape"), F.array_join(X.json_refs(refs), ",").alias("refs"), slots["text"].alias("slots"), slots["fault"].alias("lacking"))


@query("WITH q AS (SELECT c_custkey AS doc, unnest(range(3)) AS i FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT doc, i, unnest(range(2)) AS j FROM q) SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY i, j) AS number, 'q' || (i * 2 + j) AS item, 2 AS n_choices FROM r")
def numbered_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of two levels, numbered through, each with its choices and no answer.  Odd customers ask nothing."""
    c, k = _customers(spark, d)
    inner = lambda i: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda j: F.concat(F.lit("q"), (i * 2 + j).cast("string")))
    outer = F.when(k % 2 == 0, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(inner(i).alias("asks")))).otherwise(F.array().cast("array<struct<asks:array<string>>>"))
    flat = ordered.flatten(c.select(k.alias("doc"), outer.alias("terms")), "terms", "asks", "doc")
    sheet = quiz.answer_sheet(flat.select(F.col("number").alias("qnum"), F.col("doc").alias("term"), F.col("item").alias("question"), F.array(F.lit("x"), F.lit("y")).alias("choices")))
    return sheet.select(F.col("term").alias("doc"), F.col("qnum").alias("number"), F.col("question").alias("item"), F.size("choices").alias("n_choices"))


@query("SELECT 'C' || row_number() OVER (ORDER BY c_name) AS id, c_name AS name FROM customer")
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return ordered.dense_ids(table(spark, d, "customer").select(F.col("c_name").alias("name")), "C", ["name"])


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<script[ >]')) AS INT) AS scripts, 'D1,D22' AS sections, 'A' || (page_id % 90) AS undefined, page_id % 2 = 0 AS written, '-O2,-D' || page_id AS flags, 'src,lib' AS paths FROM pages")
def report_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    source = F.concat(F.lit('import Z9 from "z"\n<Section title="D1 x"><Section  title="D22"> A'), k % 90, F.lit(' B1 <p className="C3">'))
    conf = R.author_config(F.concat(F.lit("add_compile_flags:\n  - -O2\n  - -D"), k, F.lit("\npaths: [src, lib]\n")))
    return table(spark, d, "pages").select(
        "page_id", R.script_count(F.col("html")).alias("scripts"), F.array_join(X.section_ids(source), ",").alias("sections"), F.array_join(X.undefined_terms(source, F.array(F.lit("B1"))), ",").alias("undefined"), R.manuscript_written(F.when(k % 2 == 0, "decisions: [1]").otherwise("decisions: [ ]"), source).alias("written"),
        F.array_join(conf["flags"], ",").alias("flags"), F.array_join(conf["paths"], ",").alias("paths"),
    )


@query("""WITH p AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY p_brand) SELECT name, '<<TABLE BORDER="0" CELLBORDER="1" CELLSPACING="0" CELLPADDING="4"><TR><TD ALIGN="CENTER" BGCOLOR="#eef3fa"><B>' || name || '</B></TD></TR><TR><TD ALIGN="LEFT" BALIGN="LEFT"><FONT POINT-SIZE="8">+ m : <FONT COLOR="#666666">t' || n || '</FONT></FONT></TD></TR><TR><TD ALIGN="LEFT" BALIGN="LEFT"><FONT POINT-SIZE="8">- run()</FONT></TD></TR></TABLE>>' AS label FROM p""")
def class_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    member = F.array(F.struct(F.lit("m").alias("name"), F.concat(F.lit("t"), "n").alias("type"), F.lit("public").alias("access")))
    method = F.array(F.struct(F.lit("run").alias("name"), F.lit("private").alias("access"), F.lit(False).alias("is_abstract"), F.lit(1).alias("param_count")))
    told = facts.details(types=p.select("name", member.alias("members"), method.alias("methods"), F.lit(False).alias("is_abstract"), F.lit(0).alias("ord")))
    shown = R.shown_methods(F.col("methods"), F.col("name"))
    return told.select("name", sinks.class_label(F.col("name"), F.col("members"), shown, F.col("abstract"), F.create_map().cast("map<string,string>")).alias("label"))


_CODES = sorted(audit.fixed.LAYER)


@query("WITH c(i, code, section, blocks) AS (VALUES " + ", ".join(f"({k}, '{code}', '{audit.fixed.SECTION_OF_LAYER[audit.fixed.LAYER[code]]}', {str(code not in audit.fixed.REPORT_ONLY).lower()})" for k, code in enumerate(_CODES)) + f"), f AS (SELECT CAST(floor(value) AS BIGINT) % {len(_CODES)} AS i, event_type FROM events WHERE value >= 0) SELECT event_type, section, code, count(*) AS n, bool_and(blocks) AS blocking FROM f JOIN c USING (i) GROUP BY ALL")
def fault_layers(spark: SparkSession, d: str) -> DataFrame:
    """Events as faults of a code each, by section."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.floor("value") % len(_CODES) + 1).cast("int"))
    faults = table(spark, d, "events").filter("value >= 0").select("event_type", code.alias("code"))
    return audit.placed(faults).groupBy("event_type", "section", "code").agg(F.count("*").alias("n"), F.bool_and("blocks").alias("blocking"))


@query("WITH c AS (SELECT 'd' || (c_custkey % 20) AS name, CASE WHEN c_custkey % 4 < 2 THEN 'u' || (c_custkey % 40) ELSE 'b' END AS v FROM customer) SELECT name, v, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'place', '(f' || (c_custkey % 40) || '.cs:' || c_custkey || ')', 1 FROM customer WHERE c_custkey % 6 = 0")
def entry_facts(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d)
    counts = c.select(F.concat(F.lit("d"), k % 20).alias("name"), F.when(k % 4 < 2, F.concat(F.lit("u"), k % 40)).otherwise("b").alias("v")).groupBy("name", "v").agg(F.count("*").alias("n"))
    types = c.select(F.concat(F.lit("T"), k).alias("name"), F.concat(F.lit("f"), k % 40, F.lit(".cs")).alias("file"), k.alias("line"), F.create_map(F.lit("is_monobehaviour"), k % 6 == 0).alias("unity"))
    return counts.unionByName(facts.entry_points(types).select(F.lit("place").alias("name"), F.col("place").alias("v"), F.lit(1).cast("bigint").alias("n")))
