"""Queries of batches, evidence, dictionaries, listings and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import rules as R
from ..functions import text as X
from ..operators import batches, evidence, facts, graph, ordered, terms
from ..operators.assemble import first_party
from ..session import table
from ..sources import readers, sinks
from ..sources.adapters import cyclic_edges, nodes, raw_edges, with_views
from .queries import _FILES_OF, _REACH, _weighed, query

# --- plans of reading ---------------------------------------------------------------

_LEVELS = _REACH + """
, dag AS (SELECT DISTINCT x.scc AS ca, y.scc AS cb FROM cyc JOIN scc x ON a = x.id JOIN scc y ON b = y.id WHERE x.scc <> y.scc)
, lev AS (SELECT DISTINCT scc AS c, 0 AS l FROM scc UNION SELECT dag.ca, l + 1 FROM lev JOIN dag ON lev.c = dag.cb)
, lv AS (SELECT scc.id, max(l) AS level, (SELECT count(*) FROM scc z WHERE z.scc = scc.scc) > 1 AS in_cycle FROM scc JOIN lev ON scc.scc = lev.c GROUP BY scc.id, scc.scc)
, sy AS (SELECT id, level, in_cycle, 'f' || (id % 7) AS file FROM lv)
, fc AS (SELECT level, file, count(*) AS n, row_number() OVER (PARTITION BY level ORDER BY file) AS rn FROM sy GROUP BY level, file)
, pk AS (SELECT level, file, n, rn, n AS filled, CAST(0 AS BIGINT) AS batch FROM fc WHERE rn = 1
  UNION ALL SELECT fc.level, fc.file, fc.n, fc.rn, CASE WHEN pk.filled > 0 AND pk.filled + fc.n > 8 THEN fc.n ELSE pk.filled + fc.n END, CASE WHEN pk.filled > 0 AND pk.filled + fc.n > 8 THEN pk.batch + 1 ELSE pk.batch END FROM pk JOIN fc ON fc.level = pk.level AND fc.rn = pk.rn + 1)
, pl AS (SELECT sy.*, printf('L%d-B%02d', sy.level, batch) AS batch_id FROM sy JOIN pk ON sy.level = pk.level AND sy.file = pk.file)"""


def _graph(spark, d):
    k = F.col("id")
    n = spark.range(table(spark, d, "supplier").count()).select(k, k.cast("string").alias("name"), F.lit("class").alias("kind"), F.concat(F.lit("f"), k % 7).alias("file"), F.lit(1).alias("line"))
    return n, cyclic_edges(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"))


@query(with_views("cyc_n", "cyc", body=_LEVELS + " SELECT id, level, in_cycle, batch_id, coalesce((SELECT string_agg(b, ',' ORDER BY b) FROM cyc WHERE a = id), '') AS depends_on FROM pl", recursive=True))
def layered_plan(spark: SparkSession, d: str) -> DataFrame:
    return batches.layered(*_graph(spark, d)).select("id", "level", "in_cycle", "batch_id", F.array_join(F.transform("depends_on", lambda x: x.cast("string")), ",").alias("depends_on"))


@query(with_views("cyc_n", "cyc", body=_LEVELS + " SELECT level, count(*) AS symbols, count(DISTINCT file) AS files, count(DISTINCT batch_id) AS batches, count(*) FILTER (WHERE in_cycle) AS cyclic FROM pl GROUP BY GROUPING SETS ((level), ())", recursive=True))
def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    return batches.summary(batches.layered(*_graph(spark, d)))


@query(with_views("node", "raw", "edge", body=_FILES_OF + """, w AS (SELECT file, out_edges, into_edges, interfaces, abstracts, coalesce(1 - out_edges / nullif(max(out_edges) OVER (), 0), 1) + coalesce(into_edges / nullif(max(into_edges) OVER (), 0), 0) + coalesce(score / nullif(max(score) OVER (), 0), 0) AS weight FROM fw)
SELECT 0 AS ord, 'file,out,into,interfaces,abstracts,weight' AS line UNION ALL SELECT row_number() OVER (ORDER BY weight DESC, file), concat_ws(',', file, out_edges, into_edges, interfaces, abstracts, printf('%.6f', weight)) FROM w"""))
def file_weights_csv(spark: SparkSession, d: str) -> DataFrame:
    return sinks.weights_csv(graph.file_weights(_weighed(spark, d), graph.fold_edges(raw_edges(spark, d))))


# --- fact tables --------------------------------------------------------------------------


@query("WITH m AS (SELECT p_brand AS id, count(*) AS classes, round(sum(p_size / 1000.0), 6) AS pagerank_sum, min(p_size) < 2 AS in_cycle FROM part GROUP BY p_brand) SELECT row_number() OVER (ORDER BY pagerank_sum DESC, id) AS number, * FROM m")
def module_facts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("module"), (F.col("p_size") / 1000).alias("pagerank"), "p_size")
    return facts.module_rows(p, None, p.filter("p_size < 2").select(F.col("module").alias("id"))).drop("depends_on")


@query(with_views("node", "raw", "edge", body=", x AS (SELECT dst, sum(occurrences) AS touches FROM edge WHERE dst LIKE 'R%' GROUP BY dst) SELECT row_number() OVER (ORDER BY touches DESC, dst) AS number, name, CAST(touches AS BIGINT) AS touches, 5 AS folded, 'N0, N1, N2 외 2' AS head FROM x JOIN node ON dst = id"))
def external_facts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).withColumn("collapsed_from", F.when(F.col("kind") == "external", F.array(*[F.lit(f"N{k}") for k in (1, 0, 2)], F.lit("longer"), F.lit("N33"))))
    return facts.external_rows(n, graph.fold_edges(raw_edges(spark, d)))


@query("WITH h AS (SELECT 'f' || (user_id % 40) AS path, count(*) AS commits, sum(event_id % 5) AS added FROM events GROUP BY 1), c AS (SELECT 'f' || (c_custkey % 30) AS file, 'm' || (c_custkey % 30) AS module FROM customer) SELECT row_number() OVER (ORDER BY commits DESC, path) AS number, path, module, commits, CAST(added AS BIGINT) AS added, CAST(0 AS BIGINT) AS deleted FROM h JOIN (SELECT DISTINCT * FROM c) ON path = file")
def hotspot_facts(spark: SparkSession, d: str) -> DataFrame:
    u, c = F.col("user_id") % 40, F.col("c_custkey") % 30
    spots = table(spark, d, "events").groupBy(F.concat(F.lit("f"), u).alias("path")).agg(F.count("*").alias("commits"), F.sum(F.col("event_id") % 5).alias("added"), F.lit(0).cast("bigint").alias("deleted"))
    return facts.hotspot_rows(spots, table(spark, d, "customer").select(F.concat(F.lit("f"), c).alias("file"), F.concat(F.lit("m"), c).alias("module"), F.col("c_custkey").alias("number")))


# --- hashes, manifests, gates ----------------------------------------------------------

_HASHES = "ci AS (SELECT DISTINCT 'f' || (o_orderkey % 900) AS path FROM orders), pr AS (SELECT 'f' || c_custkey AS path, sha256(c_name) AS sha256 FROM customer WHERE c_custkey % 10 <> 3)"


def _hashes(spark, d):
    cited = table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey") % 900).alias("path"))
    present = table(spark, d, "customer").filter("c_custkey % 10 <> 3").select(F.concat(F.lit("f"), "c_custkey").alias("path"), F.sha2("c_name", 256).alias("sha256"))
    return cited, present


@query(f"WITH {_HASHES} SELECT ci.path, coalesce(sha256, 'missing') AS hash FROM ci LEFT JOIN pr ON ci.path = pr.path")
def hashed_sources(spark: SparkSession, d: str) -> DataFrame:
    return evidence.source_hashes(*_hashes(spark, d))


@query(f"""WITH {_HASHES}, h AS (SELECT ci.path, coalesce(sha256, 'missing') AS hash FROM ci LEFT JOIN pr ON ci.path = pr.path), s AS (SELECT sha256(string_agg(path || '=' || hash || chr(10), '' ORDER BY path)) AS digest, count(*) AS n FROM h)
SELECT digest AS sources_sha256, n, 'unknown' AS raw_provenance, sha256('fp' || chr(10) || 'gs' || chr(10) || digest || chr(10) || 'inv' || chr(10)) AS generation_id FROM s""")
def collection_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = evidence.manifest(*_hashes(spark, d), "gs", "roslyn-dump", "fp", "inv")
    return m.select("sources_sha256", F.size("sources").cast("bigint").alias("n"), "raw_provenance", "generation_id")


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'wiki' WHEN c_custkey % 4 = 1 THEN 'terms-db' ELSE 'none' END AS kind FROM customer) WHERE kind = 'wiki' GROUP BY kind")
def artifact_entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("docs/wiki/p"), k, F.lit(".md"))).when(k % 4 == 1, F.concat(F.lit("docs/wiki/sub/p"), k, F.lit(".md"))).otherwise(F.concat(F.lit("docs/wiki/p"), k, F.lit(".txt")))
    files = table(spark, d, "customer").select(path.alias("path"), F.sha2("c_name", 256).alias("sha256"))
    return evidence.entries(files, "wiki").groupBy(F.lit("wiki").alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id AS run, event_id AS ord, CASE event_type WHEN 'click' THEN 'survey/b' || (event_id % 3) WHEN 'view' THEN 'prep' ELSE 'check' END AS stage, event_id % 4 <> 0 AS ok, event_id % 8 = 0 AS skipped FROM events)
SELECT 'g' AS graph, split_part(arg_min(stage, ord), '/', 1) AS failed_at, CASE split_part(arg_min(stage, ord), '/', 1) WHEN 'prep' THEN 0 WHEN 'survey' THEN 1 ELSE 2 END AS done, 'wiki' AS verified FROM r WHERE NOT ok AND NOT skipped""")
def resume_point(spark: SparkSession, d: str) -> DataFrame:
    e, k, t = table(spark, d, "events"), F.col("event_id"), F.col("event_type")
    stage = F.when(t == "click", F.concat(F.lit("survey/b"), k % 3)).when(t == "view", "prep").otherwise("check")
    rows = e.select(k.alias("ord"), stage.alias("stage"), (k % 4 != 0).alias("ok"), (k % 8 == 0).alias("skipped"), F.lit(None).cast("string").alias("why"))
    return evidence.resume(rows, ["prep", "survey", "check"], "g", ["wiki"]).select("graph", "failed_at", F.size("done").alias("done"), F.array_join("verified", ",").alias("verified"))


@query("""WITH e AS (SELECT c_custkey AS pos, c_nationkey AS list, CASE WHEN c_custkey % 7 = 0 THEN '/other/x' || (c_custkey % 50) WHEN c_custkey % 5 = 0 THEN '/r/Qt/x' || (c_custkey % 50) ELSE '/r/src/x' || (c_custkey % 50) END AS file FROM customer),
g AS (SELECT *, CASE WHEN file NOT LIKE '/r%' THEN 'outside-repo' WHEN file LIKE '%/Qt/%' THEN 'external' END AS reason FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY list, pos) AS rn FROM g WHERE reason IS NULL)
SELECT file, 'kept' AS reason, count(*) AS n FROM k WHERE rn = 1 GROUP BY ALL UNION ALL SELECT file, 'duplicate-config', count(*) FROM k WHERE rn > 1 GROUP BY ALL UNION ALL SELECT file, reason, count(*) FROM g WHERE reason IS NOT NULL GROUP BY ALL""")
def compile_entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    tail = F.concat(F.lit("x"), k % 50)
    file = F.when(k % 7 == 0, F.concat(F.lit("../other/"), tail)).when(k % 5 == 0, F.concat(F.lit("./Qt//"), tail)).otherwise(F.concat(F.lit("/r/a/../src/"), tail))
    lists = table(spark, d, "customer").select(F.col("c_nationkey").alias("list"), k.alias("pos"), file.alias("file"), F.when(k % 2 == 0, "/r").alias("directory"))
    kept, dropped = evidence.merge_entries(lists, "/r")
    whole = kept.select("file", F.lit("kept").alias("reason")).unionByName(dropped.select("file", "reason"))
    return whole.groupBy("file", "reason").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT 'p' || o_orderkey AS page FROM orders), h AS (SELECT DISTINCT 'p' || (o_orderkey * 2) AS page FROM orders) SELECT w.page, CASE WHEN h.page IS NULL THEN 'unwritten' ELSE 'written' END AS state FROM w LEFT JOIN h ON w.page = h.page")
def page_round(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return evidence.written_pages(o.select(F.concat(F.lit("p"), k).alias("page")), o.select(F.concat(F.lit("p"), k * 2).alias("page")))


@query("WITH e AS (SELECT 'n' || c_custkey || '.md' AS page FROM customer), k AS (SELECT 'n' || c_custkey || '.md' AS page FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'n' || c_custkey || '.1.md' FROM customer WHERE c_custkey % 6 = 0) SELECT page, '.bak/' || CASE WHEN page NOT IN (SELECT page FROM k) THEN page WHEN replace(page, '.md', '.1.md') NOT IN (SELECT page FROM k) THEN replace(page, '.md', '.1.md') ELSE replace(page, '.md', '.2.md') END AS moved_to FROM e")
def page_backups(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    name = lambda end: F.concat(F.lit("n"), k, F.lit(end)).alias("page")
    return evidence.backups(c.select(name(".md")), c.filter(k % 3 == 0).select(name(".md")).unionByName(c.filter(k % 6 == 0).select(name(".1.md"))))


@query("WITH w AS (SELECT 'f' || c_custkey AS path, sha1(c_name) AS h FROM customer), k AS (SELECT 'f' || c_custkey AS path, sha1(CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE c_name END) AS h, 'o' || c_custkey AS outline FROM customer WHERE c_custkey % 4 <> 0) SELECT w.path, outline FROM w LEFT JOIN k ON w.path = k.path AND w.h = k.h")
def cached_outlines(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    path = F.concat(F.lit("f"), k).alias("path")
    cache = c.filter(k % 4 != 0).select(path, F.sha1(F.when(k % 3 == 0, "old").otherwise(F.col("c_name"))).alias("sha1"), F.concat(F.lit("o"), k).alias("outline"))
    return evidence.outlines(c.select(path, F.sha1("c_name").alias("sha1")), cache)


# --- dictionaries ---------------------------------------------------------------------------

_LINES = "ln AS (SELECT 'f' || c_nationkey || '.py' AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line, c_name AS text FROM customer)"


def _lines(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("f"), "c_nationkey", F.lit(".py")).alias("path"), F.col("c_name").alias("text"), F.col("c_custkey").alias("k"))
    return c.withColumn("line", F.row_number().over(Window.partitionBy("path").orderBy("k"))).select("path", "line", "text")


_DICT = f"""WITH {_LINES}, td AS (SELECT c_name AS name, CASE WHEN c_custkey % 9 = 0 THEN 'thing' ELSE 'class' END AS kind, CASE WHEN c_custkey % 8 <> 0 THEN 'm' END AS module, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE (CASE WHEN c_custkey % 11 = 0 THEN 'gone.py' ELSE 'f' || c_nationkey || '.py' END) || ':' || (c_custkey % 90) END AS wh, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE 'x' END AS means, CASE WHEN c_custkey % 5 = 0 THEN 'dream' WHEN c_custkey % 2 = 0 THEN 'codegraph' ELSE 'reading' END AS source FROM customer),
sz AS (SELECT path, max(line) AS n FROM ln GROUP BY path), ci AS (SELECT name, split_part(wh, ':', 1) AS path, CAST(split_part(wh, ':', 2) AS INT) AS line FROM td WHERE source = 'reading' AND wh <> ''), pc AS (SELECT ci.*, n, (SELECT string_agg(text, chr(10)) FROM ln WHERE ln.path = ci.path AND ln.line BETWEEN ci.line - 1 AND ci.line + 1) AS win FROM ci LEFT JOIN sz ON ci.path = sz.path)"""


@query(_DICT + """ SELECT level, name, count(*) AS n FROM (SELECT 'failed' AS level, name FROM td WHERE source = 'dream' UNION ALL SELECT 'failed', name FROM td WHERE source <> 'dream' AND module IS NULL UNION ALL SELECT 'failed', name FROM td WHERE source <> 'dream' AND trim(means) = ''
UNION ALL SELECT 'failed', name FROM td WHERE source = 'reading' AND kind = 'thing' UNION ALL SELECT 'failed', name FROM td WHERE source = 'reading' AND wh = '' UNION ALL SELECT 'failed', name FROM pc WHERE n IS NULL UNION ALL SELECT 'failed', name FROM pc WHERE n IS NOT NULL AND (line = 0 OR line > n)
UNION ALL SELECT 'unfounded', name FROM pc WHERE n IS NOT NULL AND line BETWEEN 1 AND n AND NOT contains(win, name)) GROUP BY ALL""")
def dictionary_faults(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    where = F.when(k % 7 == 0, "").otherwise(F.concat(F.when(k % 11 == 0, "gone.py").otherwise(F.concat(F.lit("f"), "c_nationkey", F.lit(".py"))), F.lit(":"), k % 90))
    held = c.select(F.col("c_name").alias("name"), F.when(k % 9 == 0, "thing").otherwise("class").alias("kind"), F.when(k % 8 != 0, "m").alias("module"), where.alias("where"), F.when(k % 6 == 0, " ").otherwise("x").alias("means"), F.array(F.lit("n")).alias("neighbours"), F.when(k % 5 == 0, "dream").when(k % 2 == 0, "codegraph").otherwise("reading").alias("source"))
    none = held.select("name", F.col("name").alias("to"), "kind", "where", "source").filter("1 = 0")
    return terms.check_terms(held, none, _lines(spark, d)).groupBy("level", "name").agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT DISTINCT 'c' || o_custkey AS term FROM orders), a AS (SELECT DISTINCT 'c' || c_custkey AS term FROM customer WHERE c_custkey % 3 = 0), x AS (SELECT DISTINCT 'c' || c_custkey AS term FROM customer WHERE c_custkey % 5 = 0) SELECT term FROM k WHERE term NOT IN (SELECT term FROM a) AND term NOT IN (SELECT term FROM x)")
def unasked_terms(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("term"), "c_custkey")
    return terms.without(table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("term")), "term", c.filter("c_custkey % 3 = 0"), c.filter("c_custkey % 5 = 0"))


# --- texts ------------------------------------------------------------------------------------

_WORDS = "SELECT doc_id, text, 'see src/a' || (doc_id % 7) || '.py:' || doc_id || ' and *.ts, lib/b.hxx x.md. ' || CASE WHEN doc_id % 2 = 0 THEN 'A' || (doc_id % 90) || ' D1 cfg-x.json rows[] ' ELSE 'ABCD12 Zed.json ' END AS t FROM documents"


def _words(spark, d):
    k = F.col("doc_id")
    t = F.concat(F.lit("see src/a"), k % 7, F.lit(".py:"), k, F.lit(" and *.ts, lib/b.hxx x.md. "), F.when(k % 2 == 0, F.concat(F.lit("A"), k % 90, F.lit(" D1 cfg-x.json rows[] "))).otherwise("ABCD12 Zed.json "))
    return table(spark, d, "documents").select(k, "text", t.alias("t"))


@query(f"WITH w AS ({_WORDS}) SELECT doc_id, 'src/a' || (doc_id % 7) || '.py,*.ts,x.md' || CASE WHEN doc_id % 2 = 0 THEN ',cfg-x.json' ELSE ',Zed.json' END AS paths, CASE WHEN doc_id % 2 = 0 THEN 'A' || (doc_id % 90) || ',cfg-x.json,rows[]' ELSE '' END AS codes, 'src/a' || (doc_id % 7) || '.py' AS cited, CAST(doc_id AS INT) AS line, 'src/a' || (doc_id % 7) || '.py' AS file FROM w")
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    t, c = F.col("t"), X.citations(F.col("t"))
    return _words(spark, d).select("doc_id", F.array_join(X.path_tokens(t), ",").alias("paths"), F.array_join(X.code_terms(t), ",").alias("codes"), c[0]["path"].alias("cited"), c[0]["line"].alias("line"), R.file_of(F.substring("t", 5, 200)).alias("file"))


@query("""SELECT page_id, md5('<h1>' || url || '</h1><p><a class="path-link" target="_blank" rel="noopener" href="/x">src/a.py:3</a> b.py</p><code>x ' || page_id || '</code>') AS linked,
md5('<h1>code map</h1><p>[CM] ' || page_id || ' [M], remap</p><pre>map</pre><span class="mono">map</span>') AS wrapped FROM pages""")
def rewritten_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    one = F.concat(F.lit("<h1>"), "url", F.lit("</h1><p>src/a.py:3 b.py</p><code>x "), "page_id", F.lit("</code>"))
    two = F.concat(F.lit("<h1>code map</h1><p>code map "), "page_id", F.lit(' map, remap</p><pre>map</pre><span class="mono">map</span>'))
    return p.select("page_id", F.md5(D.link_paths(one, {"src/a.py": "/x"})).alias("linked"), F.md5(D.wrap_terms(two, {"map": "[M]", "code map": "[CM]"})).alias("wrapped"))


@query("WITH n AS (SELECT ['README.md', 'CLAUDE.md', 'ARCHITECTURE.md', 'AGENTS.md'] AS n), d AS (SELECT doc_id AS k, n[doc_id + 1] AS name, text FROM documents, n WHERE doc_id < 4 AND doc_id <> 2) SELECT md5(string_agg('===== ' || name || ' =====' || chr(10) || substr(text, 1, 6000), chr(10) || chr(10) ORDER BY k)) AS heads FROM d")
def document_heads(spark: SparkSession, d: str) -> DataFrame:
    """A project of which every document is a file, three of them known by their names."""
    names = F.when(F.col("doc_id") == 0, "README.md").when(F.col("doc_id") == 1, "CLAUDE.md").when(F.col("doc_id") == 3, "AGENTS.md").otherwise(F.concat("doc_id", F.lit(".md")))
    return readers.document_heads(table(spark, d, "documents").select(names.alias("name"), "text")).select(F.md5("text").alias("heads"))


@query("""WITH l AS (SELECT CASE WHEN p_partkey % 6 = 0 THEN 'build/' ELSE 'src/' END || 'f' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.hxx' WHEN 2 THEN '.cs' WHEN 3 THEN '.tsx' ELSE '.md' END AS path FROM part)
SELECT language, count(*) AS n FROM (SELECT CASE WHEN path LIKE '%.py' THEN 'py' WHEN path LIKE '%.hxx' THEN 'cpp' WHEN path LIKE '%.cs' THEN 'cs' WHEN path LIKE '%.tsx' THEN 'ts' END AS language FROM l) WHERE language IS NOT NULL GROUP BY language UNION ALL SELECT 'tracked py', count(*) FROM l WHERE path LIKE 'src/%.py' UNION ALL SELECT 'indexed', count(*) FROM l WHERE path LIKE '%.py' OR path LIKE '%.cs'""")
def listed_languages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    end = F.element_at(F.array(*map(F.lit, (".py", ".hxx", ".cs", ".tsx", ".md"))), (k % 5 + 1).cast("int"))
    listing = table(spark, d, "part").select(F.concat(F.when(k % 6 == 0, "build/").otherwise("src/"), F.lit("f"), k, end).alias("path"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("language"), "n")
    return readers.count_languages(listing).select("language", "n").unionByName(count(readers.tracked(listing, "py"), "tracked py")).unionByName(count(readers.source_index(listing), "indexed"))


@query("WITH c AS (SELECT event_type AS value, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type) SELECT value, n, first, row_number() OVER (ORDER BY n DESC, first) AS number FROM c")
def counted_values(spark: SparkSession, d: str) -> DataFrame:
    got = ordered.counted(table(spark, d, "events").select(F.col("event_type").alias("value"), F.col("event_id").alias("ord")), "value")
    return ordered.ranked(got, "n", "first")


@query("SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried, row_number() OVER (ORDER BY event_id) AS place FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN event_id END AS v FROM events)")
def carried_over_all(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.col("event_id")).alias("v"))
    return ordered.numbered(ordered.carry_down(e, "v", "carried", "event_id"), ["event_id"], "place").select("event_id", "carried", "place")


@query("WITH u AS (SELECT user_id AS k, count(*) AS input, sum(event_id % 7) AS cached FROM events GROUP BY 1) SELECT k, input, CAST(cached AS BIGINT) AS cache_read, CAST(input + cached AS BIGINT) AS total, CASE WHEN k % 3 = 0 THEN 'exit code 2: bad' WHEN k % 5 = 0 THEN 'ended in an error: bad' ELSE '' END AS why FROM u")
def run_usage(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    u = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("input"), F.sum(F.col("event_id") % 7).alias("cached"))
    doc = F.concat(F.lit('{"usage":{"input_tokens":'), "input", F.lit(',"cache_read_input_tokens":'), "cached", F.lit("}}"))
    use = R.usage_of(doc)
    return u.select("k", use["input"].alias("input"), use["cache_read"].alias("cache_read"), use["total"].alias("total"), R.run_verdict(F.when(k % 3 == 0, 2).otherwise(0), F.lit(True), k % 5 == 0, F.lit("bad"))["why"].alias("why"))


@query("SELECT 'f' || c_nationkey || '.py' AS path, 0 AS line, 0 AS part, '══ f' || c_nationkey || '.py  (' || count(*) || '줄)' AS text FROM customer GROUP BY c_nationkey UNION ALL SELECT 'f' || c_nationkey || '.py', CAST(c_custkey AS INT), 1, '  ' || lpad(CAST(c_custkey AS VARCHAR), 5, ' ') || ' ' || rpad('class', 12, ' ') || ' ' || c_name FROM customer UNION ALL SELECT 'f' || c_nationkey || '.py', CAST(c_custkey AS INT), 2, '        ㄴ ' || c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def declaration_listing(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    n = c.groupBy("c_nationkey").agg(F.count("*").alias("n_lines"))
    decls = c.join(n, "c_nationkey").select(F.concat(F.lit("f"), "c_nationkey", F.lit(".py")).alias("path"), "n_lines", k.cast("int").alias("line"), F.lit("class").alias("kind"), F.col("c_name").alias("name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("doc"))
    return sinks.declaration_lines(decls)


# --- Python sources: a module for each nation, a function for each supplier ------------------

_CALLED = """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS m, 'pk.m' || s_nationkey || '.f' || s_suppkey AS name, (s_suppkey * 3) % (SELECT count(*) FROM supplier) AS t FROM supplier), j AS (SELECT a.name, b.name AS target, a.m, a.k FROM s a JOIN s b ON a.t = b.k), f AS (SELECT m, min(k) AS k FROM s GROUP BY m)"""


def _sources(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("m"))
    n = s.count()
    home = s.select(F.col("k").alias("t"), F.col("m").alias("home"))
    told = s.withColumn("t", (F.col("k") * 3) % n).join(home, "t")
    imported = F.concat(F.lit("from m"), "home", F.lit(" import f"), "t", F.lit(" as g"), "k", F.lit("\n"))
    first = F.min("k").over(Window.partitionBy("m"))
    body = F.concat(F.lit("def f"), "k", F.lit("(a: int = 1):\n    g"), "k", F.lit("()\n    print(a)\n    f"), "first", F.lit("()\n"))
    parts = told.withColumn("first", first).groupBy("m").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", imported.alias("i"), body.alias("b"))))["i"], "").alias("i"), F.array_join(F.array_sort(F.collect_list(F.struct("k", imported.alias("i"), body.alias("b"))))["b"], "").alias("b"))
    return parts.select(F.concat(F.lit("src/pk/m"), "m", F.lit(".py")).alias("path"), F.concat("i", "b").alias("text"))


@query(_CALLED + " SELECT DISTINCT caller, callee FROM (SELECT name AS caller, target AS callee FROM j UNION ALL SELECT j.name, 'pk.m' || f.m || '.f' || f.k FROM j JOIN f ON j.m = f.m) WHERE caller <> callee")
def python_calls(spark: SparkSession, d: str) -> DataFrame:
    return readers.python_calls(readers.scan_python(_sources(spark, d)))[1].select("caller", "callee")


@query(_CALLED + " SELECT name, 'function' AS kind, 'pk.m' || m AS module, '(a: int = 1)' AS signature, row_number() OVER (ORDER BY 'src/pk/m' || m || '.py', k) AS ord FROM j")
def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    return readers.python_calls(readers.scan_python(_sources(spark, d)))[0].select("name", "kind", "module", "signature", "ord")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'std' WHEN c_custkey % 3 = 0 THEN 'app' ELSE '' END AS ns, c_custkey % 7 AS line, c_custkey % 4 <> 0 AS tracked FROM customer) SELECT k, ns = 'app' OR ns = '' AND tracked AND line = 1 AS own FROM c""")
def own_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of customers: by namespace, or in a tracked file on the line that defines them."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    file = F.concat(F.lit("f"), k, F.lit(".h")).alias("file")
    rows = c.select(k.alias("k"), F.when(k % 5 == 0, "std").when(k % 3 == 0, "app").otherwise("").alias("namespace"), file, (k % 7).cast("int").alias("line"), F.concat(F.lit("T"), k).alias("name"))
    text = F.array(F.concat(F.lit("struct T"), k, F.lit(" {")), F.concat(F.lit("class T"), k, F.lit(";")), F.concat(F.lit("T"), k, F.lit(" t")))
    lines = c.select(file, F.posexplode(text).alias("i", "text")).select(F.col("file").alias("path"), (F.col("i") + 1).alias("line"), "text")
    tracked = c.filter(k % 4 != 0).select(file).withColumnRenamed("file", "path")
    return first_party(rows, ("app",), lines, tracked).select("k", "own")


@query("WITH u AS (SELECT event_id AS ord, 'f' || (user_id % 9) AS file, 'k' || user_id AS key, event_type AS dep, value AS priority, event_id % 5 AS into_ FROM events) SELECT 0 AS ord, 'file,key,dep,priority,into,status' AS line UNION ALL SELECT ord + 1, concat_ws(',', file, key, dep, printf('%.6f', floor(priority)), into_, 'shallow') FROM u")
def unresolved_lines(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("event_id")
    rows = e.select((k + 1).alias("ord"), F.concat(F.lit("f"), F.col("user_id") % 9).alias("file"), F.concat(F.lit("k"), "user_id").alias("key"), F.col("event_type").alias("dep"), F.floor("value").alias("priority"), (k % 5).alias("into"), F.lit("shallow").alias("status"))
    return sinks.unresolved_csv(rows)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'clang-uml,normalize,facts,render-modules' WHEN c_custkey % 4 = 1 THEN 'griffe,pycalls,normalize,facts,render-modules' WHEN c_custkey % 4 = 2 AND c_custkey % 3 = 0 THEN 'normalize,facts,render-modules' ELSE '' END AS steps, CASE WHEN c_custkey % 4 = 2 AND c_custkey % 3 <> 0 THEN 'no dump' WHEN c_custkey % 4 = 3 THEN 'no collector' END AS blocked FROM customer")
def prep_plans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    collector = F.when(k % 4 == 0, "clang-uml").when(k % 4 == 1, "griffe+pycalls").when(k % 4 == 2, "roslyn-dump")
    p = R.prep_steps(collector, F.lit(True), F.lit(True), k % 3 == 0, F.lit(False), F.lit(False))
    return table(spark, d, "customer").select(k.alias("id"), F.array_join(p["steps"], ",").alias("steps"), p["blocked"].alias("blocked"))


@query("WITH t AS (SELECT 's' || (c_nationkey % 9) || '.name' || c_custkey AS name, c_mktsegment AS kind, c_custkey % 4 AS g, 'm' || c_custkey AS means FROM customer) SELECT g, kind, count(*) AS n, min(name) AS first, string_agg(name || ': ' || means, chr(10) ORDER BY name) AS entries FROM t GROUP BY g, kind")
def glossary(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    held = c.select(F.concat(F.lit("s"), F.col("c_nationkey") % 9, F.lit(".name"), k).alias("name"), F.col("c_mktsegment").alias("kind"), (k % 4).alias("g"), F.concat(F.lit("m"), k).alias("means"))
    return terms.glossary(held, ["g", "kind"]).select("g", "kind", "n", "first", "entries")

