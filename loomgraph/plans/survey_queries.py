"""Queries of reading plans, seals and small rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import changes, evidence, graph, quiz, survey
from ..session import table
from ..sources import readers
from ..sources.adapters import nodes, raw_edges, with_views
from .queries import _TALLY, _quiz, query


@query(with_views("node", "raw", "edge", body="SELECT n.name, coalesce(c.k, 0) AS into_ FROM (SELECT DISTINCT name FROM node) n LEFT JOIN (SELECT t.name, count(*) AS k FROM edge JOIN node s ON src = s.id JOIN node t ON dst = t.id WHERE s.file IS DISTINCT FROM t.file GROUP BY t.name) c ON n.name = c.name").replace("into_", "n_into"))
def in_counts(spark: SparkSession, d: str) -> DataFrame:
    return survey.in_counts(nodes(spark, d), graph.fold_edges(raw_edges(spark, d))).select("name", F.col("into").alias("n_into"))


_PLAN = "mem AS (SELECT 'b' || (o_custkey % 60) AS batch, 'o' || o_orderkey AS name FROM orders), need AS (SELECT 'o' || l_orderkey AS name, 'p' || l_partkey AS dep FROM lineitem), mrg AS (SELECT 'p' || p_partkey AS name, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_type END AS means FROM part WHERE p_partkey % 50 <> 7)"


def _plan(spark, d):
    members = table(spark, d, "orders").select(F.concat(F.lit("b"), F.col("o_custkey") % 60).alias("batch"), F.concat(F.lit("o"), "o_orderkey").alias("name"))
    needs = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("name"), F.concat(F.lit("p"), "l_partkey").alias("dep"))
    merged = table(spark, d, "part").filter("p_partkey % 50 <> 7").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.when(F.col("p_size") % 9 != 0, F.col("p_type")).alias("means"))
    return members, needs, merged


@query(f"WITH {_PLAN} SELECT DISTINCT batch, dep FROM mem JOIN need ON mem.name = need.name WHERE dep NOT IN (SELECT name FROM mrg)")
def pending_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return survey.pending_excerpt(*_plan(spark, d))


@query(f"WITH {_PLAN} SELECT DISTINCT batch, dep, coalesce(means, '') AS means FROM mem JOIN need ON mem.name = need.name JOIN mrg ON dep = mrg.name")
def known_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return survey.known_excerpt(*_plan(spark, d))


@query(f"""WITH {_PLAN}, hot AS (SELECT batch, name FROM mem WHERE CAST(substr(name, 2) AS BIGINT) % 20 = 0), want AS (SELECT name, length(name) + CAST(substr(name, 2) AS BIGINT) % 17 AS n_into FROM mem),
ready AS (SELECT batch, bool_and(dep IS NULL OR dep IN (SELECT name FROM mrg)) AS ok FROM hot LEFT JOIN need ON hot.name = need.name GROUP BY batch)
SELECT ready.batch, max(n_into) AS n_into FROM ready JOIN hot ON ready.batch = hot.batch JOIN want ON hot.name = want.name WHERE ok AND ready.batch NOT IN ('b5', 'b6') GROUP BY ready.batch""")
def second_pass(spark: SparkSession, d: str) -> DataFrame:
    members, needs, merged = _plan(spark, d)
    number = F.substring("name", 2, 20).cast("bigint")
    hot = members.filter(number % 20 == 0)
    into = members.select("name", (F.length("name") + number % 17).alias("into"))
    queued = spark.createDataFrame([("b5",), ("b6",)], "batch string")
    return survey.second_pass_candidates(hot, needs, merged, into, queued).select("batch", F.col("into").alias("n_into"))


@query("WITH p AS (SELECT o_orderkey AS page, CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE [o_custkey % 50, o_custkey % 70] END AS s FROM orders), l AS (SELECT p_partkey AS id, p_size AS level FROM part), e AS (SELECT page, unnest(s) AS id FROM p) SELECT p.page, CAST(coalesce(max(level), 0) AS INT) AS layer FROM p LEFT JOIN e ON p.page = e.page LEFT JOIN l ON e.id = l.id GROUP BY p.page")
def page_layers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    pages = o.select(F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 4 != 0, F.array(F.col("o_custkey") % 50, F.col("o_custkey") % 70)).otherwise(F.array().cast("array<bigint>")).alias("symbols"))
    layer = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("level"))
    return survey.page_layers(pages, layer).select("page", F.col("layer").cast("int").alias("layer"))


@query("""WITH pl AS (SELECT DISTINCT 'b' || (o_custkey % 300) AS batch, 'k' || (o_orderkey % 7) AS key FROM orders), sh AS (SELECT DISTINCT 'b' || (o_custkey % 301) AS batch, 'k' || (o_orderkey % 7) AS key FROM orders WHERE o_custkey % 13 <> 0), fa AS (SELECT 'b' || (c_custkey % 300) AS batch FROM customer WHERE c_custkey % 40 = 0),
odd AS (SELECT batch FROM (SELECT * FROM pl EXCEPT SELECT * FROM sh) UNION SELECT batch FROM (SELECT * FROM sh EXCEPT SELECT * FROM pl))
SELECT DISTINCT batch, CASE WHEN batch NOT IN (SELECT batch FROM sh) THEN 'missing' WHEN batch IN (SELECT batch FROM fa) THEN 'faulty' WHEN batch IN (SELECT batch FROM odd) THEN 'uncovered' ELSE 'good' END AS state FROM pl""")
def shard_states(spark: SparkSession, d: str) -> DataFrame:
    o, key = table(spark, d, "orders"), F.concat(F.lit("k"), F.col("o_orderkey") % 7).alias("key")
    plan = o.select(F.concat(F.lit("b"), F.col("o_custkey") % 300).alias("batch"), key)
    shards = o.filter("o_custkey % 13 <> 0").select(F.concat(F.lit("b"), F.col("o_custkey") % 301).alias("batch"), key)
    faults = table(spark, d, "customer").filter("c_custkey % 40 = 0").select(F.concat(F.lit("b"), F.col("c_custkey") % 300).alias("batch"))
    return survey.shard_state(plan, shards, faults)


_SEAL = "se AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'terms' ELSE 'wiki' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'terms.json' || c_custkey ELSE 'wiki/p' || c_custkey || '.md' END AS path, sha256(c_name) AS sha256 FROM customer WHERE c_custkey % 5 <> 0), pr AS (SELECT 'wiki/p' || c_custkey || '.md' AS path, sha256(c_name || CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END) AS sha256 FROM customer WHERE c_custkey % 7 <> 0)"


@query(f"""WITH {_SEAL}, j AS (SELECT kind, se.path, CASE WHEN NOT (kind = 'wiki' AND regexp_matches(se.path, '^wiki/[^/]+[.]md$') OR kind = 'terms' AND se.path = 'terms.json') THEN 'wrong place' WHEN pr.path IS NULL THEN 'missing' WHEN pr.sha256 <> se.sha256 THEN 'changed' END AS problem FROM se LEFT JOIN pr ON se.path = pr.path)
SELECT kind, path, problem FROM j WHERE problem IS NOT NULL UNION ALL SELECT 'graph', NULL, 'no entry' UNION ALL SELECT 'wiki', path, 'extra page' FROM pr WHERE path NOT IN (SELECT path FROM se)""")
def seal_problems(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    page = F.concat(F.lit("wiki/p"), k, F.lit(".md"))
    sealed = c.filter(k % 5 != 0).select(F.when(k % 3 == 0, "terms").otherwise("wiki").alias("kind"), F.when(k % 3 == 0, F.concat(F.lit("terms.json"), k)).otherwise(page).alias("path"), F.sha2("c_name", 256).alias("sha256"))
    present = c.filter(k % 7 != 0).select(page.alias("path"), F.sha2(F.concat("c_name", F.when(k % 11 == 0, "x").otherwise("")), 256).alias("sha256"))
    return survey.seal_problems(sealed, present, spark.createDataFrame([("graph",), ("terms",), ("wiki",)], "kind string"))


@query("""WITH n AS (SELECT c_custkey AS id, 'f' || c_custkey AS name FROM customer), e AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 7) % 100 AS dst FROM orders WHERE o_orderkey % 3 = 0), c AS (SELECT 'f' || o_custkey AS caller, 'f' || ((o_custkey * 7) % 120) AS callee FROM orders WHERE o_orderkey % 2 = 0),
k AS (SELECT s.id AS src, t.id AS dst, count(*) AS calls FROM c JOIN n s ON caller = s.name JOIN n t ON callee = t.name WHERE s.id <> t.id GROUP BY ALL)
SELECT coalesce(e.src, k.src) AS src, coalesce(e.dst, k.dst) AS dst, CASE WHEN e.src IS NULL THEN 'call' ELSE 'old' END AS label, CASE WHEN e.src IS NULL THEN 0 ELSE 1 END + coalesce(calls, 0) AS occurrences FROM e FULL JOIN k ON e.src = k.src AND e.dst = k.dst""")
def merged_calls(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("f"), "c_custkey").alias("name"))
    e = o.filter("o_orderkey % 3 = 0").select(k.alias("src"), ((k * 7) % 100).alias("dst"), F.lit("dependency").alias("kind"), F.lit("old").alias("label"), F.lit(1).cast("bigint").alias("occurrences")).distinct()
    calls = o.filter("o_orderkey % 2 = 0").select(F.concat(F.lit("f"), k).alias("caller"), F.concat(F.lit("f"), (k * 7) % 120).alias("callee"))
    return survey.merge_python_calls(n, e, calls).select("src", "dst", "label", "occurrences")


@query("WITH a AS (SELECT c_mktsegment || (c_nationkey % 9) AS assembly, 'def' || c_custkey AS package, 1 AS r, c_custkey AS o FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_mktsegment || c_nationkey, 'dll' || c_custkey, 0, -c_custkey FROM customer WHERE c_custkey % 4 = 1) SELECT assembly, arg_max(package, (r, o)) AS package FROM a GROUP BY assembly")
def assembly_packages(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    one = c.filter(k % 4 == 0).select(F.concat("c_mktsegment", F.col("c_nationkey") % 9).alias("assembly"), F.concat(F.lit("def"), k).alias("package"), k.alias("ord"))
    two = c.filter(k % 4 == 1).select(F.concat("c_mktsegment", "c_nationkey").alias("assembly"), F.concat(F.lit("dll"), k).alias("package"), k.alias("ord"))
    return survey.assembly_packages(one, two)


@query("WITH t AS (SELECT 'f' || p_partkey AS path FROM part), s AS (SELECT 'f' || p_partkey AS path FROM part WHERE p_size < 25), dr AS (SELECT 'f' || p_partkey AS path, p_type AS reason FROM part WHERE p_partkey % 3 = 0) SELECT t.path, coalesce(reason, 'not in scope') AS reason FROM t LEFT JOIN dr ON t.path = dr.path WHERE t.path NOT IN (SELECT path FROM s)")
def excluded_files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("path", F.concat(F.lit("f"), "p_partkey"))
    return survey.excluded_files(p, p.filter("p_size < 25"), p.filter("p_partkey % 3 = 0").select("path", F.col("p_type").alias("reason")))


@query("""WITH l AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a/' ELSE 'b/c/' END || 'n' || (c_custkey % 900) AS path FROM customer), t AS (SELECT DISTINCT 'n' || (o_orderkey % 1000) AS token FROM orders)
SELECT token, coalesce(CASE WHEN 'a/' || token IN (SELECT path FROM l) THEN 'a/' || token WHEN 'x/' || token IN (SELECT path FROM l) THEN 'x/' || token END, (SELECT min(path) FROM l WHERE string_split(path, '/')[-1] = token HAVING count(*) = 1)) AS path FROM t""")
def resolved_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    listing = table(spark, d, "customer").select(F.concat(F.when(k % 2 == 0, "a/").otherwise("b/c/"), F.lit("n"), k % 900).alias("path"))
    tokens = table(spark, d, "orders").select(F.concat(F.lit("n"), F.col("o_orderkey") % 1000).alias("token"))
    return survey.resolve_paths(tokens, listing, ["a", "x"])


@query("""WITH x AS (SELECT c_custkey AS id, ['a.py', 'b/c.ts', 'd.hxx', 'e.cs', 'f.md'][c_custkey % 5 + 1] AS p, ['os.path', 'numpy.linalg', '', 'json', 'heapq', 'tomllib'][c_custkey % 6 + 1] AS i, '2026-0' || (c_custkey % 9 + 1) || '-10-' || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN '-design' ELSE '' END || '.md' AS f FROM customer)
SELECT id, CASE WHEN regexp_matches(p, '[.](cpp|cc|cxx|h|hpp|hxx)$') THEN 'cpp' WHEN p LIKE '%.cs' THEN 'cs' WHEN p LIKE '%.py' THEN 'py' WHEN regexp_matches(p, '[.]tsx?$') THEN 'ts' END AS language,
CASE WHEN i = '' THEN '(기타)' WHEN split_part(i, '.', 1) IN ('os', 'json', 'heapq', 'tomllib') THEN '(표준) stdlib' ELSE split_part(i, '.', 1) END AS import_root, regexp_replace(regexp_replace(f, '[.]md$', ''), '^[0-9]{4}-[0-9]{2}-[0-9]{2}-', '') AS slug,
nullif(regexp_extract(f, '^([0-9]{4}-[0-9]{2}-[0-9]{2})-([a-z0-9][a-z0-9-]*?)(-design)?[.]md$', 1), '') AS date, p || ':' || id AS place, CASE WHEN id % 7 = 0 THEN 'missing' WHEN id % 5 = 0 THEN 'stale' WHEN id % 3 = 0 THEN 'warned' ELSE 'fresh' END AS state FROM x""")
def small_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    p, i = pick("a.py", "b/c.ts", "d.hxx", "e.cs", "f.md"), pick("os.path", "numpy.linalg", "", "json", "heapq", "tomllib")
    f = F.concat(F.lit("2026-0"), k % 9 + 1, F.lit("-10-"), F.lower("c_mktsegment"), F.when(k % 2 == 0, "-design").otherwise(""), F.lit(".md"))
    one = lambda n: F.when(k % n == 0, 1).otherwise(0)
    return table(spark, d, "customer").select(
        k.alias("id"), R.language_of(p).alias("language"), R.import_group(i).alias("import_root"), R.plan_slug(f).alias("slug"), R.document_name(f, F.lit("plans"))["date"].alias("date"), R.where(p, k.cast("int")).alias("place"), R.status_line(one(7), one(5), one(3)).alias("state"),
    )


_DOCS = """d AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'specs' ELSE 'plans' END AS dir, '2026-0' || (c_custkey % 9 + 1) || '-1' || (c_custkey % 10) || '-' || lower(c_mktsegment) || CASE WHEN c_custkey % 4 < 2 THEN '-' || (c_custkey % 50) ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '-design' ELSE '' END || '.md' AS file FROM customer),
n AS (SELECT DISTINCT dir, substr(file, 1, 10) AS date, CASE WHEN dir = 'specs' THEN regexp_extract(file, '^.{11}(.+)-design[.]md$', 1) ELSE regexp_extract(file, '^.{11}(.+)[.]md$', 1) END AS slug FROM d),
p AS (SELECT DISTINCT lower(c_mktsegment) || '-' || (c_custkey % 50) AS slug FROM customer WHERE c_custkey % 8 = 1)"""


@query(f"""WITH {_DOCS}, k AS (SELECT * FROM n WHERE slug <> ''), l AS (SELECT * FROM k WHERE NOT (dir = 'plans' AND slug IN (SELECT slug FROM p)))
SELECT row_number() OVER (ORDER BY date DESC, dir, slug) AS place, date, dir, slug, coalesce((SELECT string_agg(DISTINCT o.slug, ',' ORDER BY o.slug) FROM k o WHERE o.slug <> l.slug AND (contains(o.slug, l.slug) OR contains(l.slug, o.slug) OR left(o.slug, 4) = left(l.slug, 4) AND length(o.slug) >= 4 AND length(l.slug) >= 4)), '') AS near FROM l""")
def documents_without_report(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    tail = F.concat(F.lower("c_mktsegment"), F.when(k % 4 < 2, F.concat(F.lit("-"), k % 50)).otherwise(""), F.when(k % 3 == 0, "-design").otherwise(""), F.lit(".md"))
    listing = c.select(F.when(k % 2 == 0, "specs").otherwise("plans").alias("dir"), F.concat(F.lit("2026-0"), k % 9 + 1, F.lit("-1"), k % 10, F.lit("-"), tail).alias("file"))
    reports = c.filter(k % 8 == 1).select(F.lit("plans").alias("dir"), F.concat(F.lower("c_mktsegment"), F.lit("-"), k % 50).alias("slug"))
    return survey.without_report(listing, reports).withColumn("near", F.array_join("near", ","))


@query("""WITH f AS (SELECT CASE p_partkey % 6 WHEN 0 THEN p_brand || '/m.py' WHEN 1 THEN 'src/' || p_name || '/m.py' WHEN 2 THEN 'test/' || p_partkey || '.py' WHEN 3 THEN p_type || '/deep/er/m.py' WHEN 4 THEN '.' || p_brand || '/m.py' ELSE p_type || '/readme.md' END AS path FROM part)
SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS root FROM f WHERE path LIKE '%.py' AND path NOT LIKE 'test/%' AND path NOT LIKE '.%' AND path NOT LIKE '%/deep/%'""")
def python_roots(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.when(k % 6 == 0, F.concat("p_brand", F.lit("/m.py"))).when(k % 6 == 1, F.concat(F.lit("src/"), "p_name", F.lit("/m.py"))).when(k % 6 == 2, F.concat(F.lit("test/"), k, F.lit(".py"))).when(k % 6 == 3, F.concat("p_type", F.lit("/deep/er/m.py"))).when(k % 6 == 4, F.concat(F.lit("."), "p_brand", F.lit("/m.py"))).otherwise(F.concat("p_type", F.lit("/readme.md")))
    return readers.python_roots(table(spark, d, "part").select(path.alias("path")))


_SCANS = """o AS (SELECT 'd' || doc_id AS path, doc_id % 100 AS mtime, n_chars AS size, md5(coalesce(text, '')) AS file_hash, lang AS decl_hash FROM documents WHERE doc_id % 11 <> 0),
n AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 ELSE doc_id % 101 END AS mtime, n_chars AS size, md5(CASE WHEN doc_id % 7 = 0 THEN lower(coalesce(text, '')) || 'x' ELSE coalesce(text, '') END) AS file_hash, CASE WHEN doc_id % 14 = 0 THEN source ELSE lang END AS decl_hash FROM documents WHERE doc_id % 13 <> 0),
v AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'reread' WHEN o.mtime IS NOT DISTINCT FROM n.mtime AND o.size IS NOT DISTINCT FROM n.size THEN 'unchanged' WHEN o.file_hash = n.file_hash THEN 'unchanged' WHEN o.decl_hash IS NOT DISTINCT FROM n.decl_hash THEN 'location_only' ELSE 'reread' END AS verdict FROM o FULL JOIN n ON o.path = n.path)"""


def _scans(spark, d):
    x, k = table(spark, d, "documents"), F.col("doc_id")
    text, path, size = F.coalesce("text", F.lit("")), F.concat(F.lit("d"), "doc_id").alias("path"), F.col("n_chars").alias("size")
    old = x.filter(k % 11 != 0).select(path, (k % 100).alias("mtime"), size, F.md5(text).alias("file_hash"), F.col("lang").alias("decl_hash"))
    now = F.md5(F.when(k % 7 == 0, F.concat(F.lower(text), F.lit("x"))).otherwise(text))
    new = x.filter(k % 13 != 0).select(path, F.when(k % 3 == 0, k % 100).otherwise(k % 101).alias("mtime"), size, now.alias("file_hash"), F.when(k % 14 == 0, F.col("source")).otherwise(F.col("lang")).alias("decl_hash"))
    return old, new


@query(f"""WITH {_SCANS}, b AS (SELECT * FROM (VALUES ('deleted', '삭제됨', 20), ('location_only', '위치만', 23), ('unchanged', '유효', 26), ('reread', '재읽기', 29)) t(verdict, name, pos)),
i AS (SELECT pos, 2 AS depth, name, path FROM b LEFT JOIN v ON b.verdict = v.verdict UNION ALL SELECT 10, 1, 'targets', path FROM v WHERE verdict IN ('reread', 'location_only')),
g AS (SELECT pos, any_value(depth) AS depth, any_value(name) AS name, max(path) AS final FROM i GROUP BY pos)
SELECT * FROM (VALUES (0, '', '{{'), (1, '', ' "hops": 1,'), (16, '', ' "verdicts": {{'), (90, '', ' }}'), (91, '', '}}')) t(part, path, line)
UNION ALL SELECT 15, '', ' "tracked": ' || count(*) || ',' FROM n
UNION ALL SELECT pos, '', repeat(' ', depth) || '"' || name || '": [' || CASE WHEN final IS NOT NULL THEN '' WHEN pos = 29 THEN ']' ELSE '],' END FROM g
UNION ALL SELECT i.pos + 1, i.path, repeat(' ', i.depth + 1) || '"' || i.path || '"' || CASE WHEN i.path = g.final THEN '' ELSE ',' END FROM i JOIN g ON i.pos = g.pos WHERE i.path IS NOT NULL
UNION ALL SELECT pos + 2, '', repeat(' ', depth) || CASE WHEN pos = 29 THEN ']' ELSE '],' END FROM g WHERE final IS NOT NULL""")
def difference_document(spark: SparkSession, d: str) -> DataFrame:
    old, new = _scans(spark, d)
    told = changes.verdicts(old, new)
    return changes.difference_lines(told, changes.change_targets(told), 1, new.count())


@query(f"WITH {_SCANS} SELECT t.verdict, count(path) AS n FROM (VALUES ('deleted'), ('location_only'), ('unchanged'), ('reread')) t(verdict) LEFT JOIN v ON t.verdict = v.verdict GROUP BY t.verdict")
def verdict_buckets(spark: SparkSession, d: str) -> DataFrame:
    return changes.buckets(changes.verdicts(*_scans(spark, d)))


@query(_TALLY + """, g AS (SELECT term, sum(correct) AS correct, sum(dont_know) AS dk FROM t WHERE complaint IS NULL GROUP BY term), m AS (SELECT 't' || (doc_id // 3) AS term, min(lang || ' of ' || source) AS means FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1)
SELECT g.term, coalesce(means, '') AS TermMeans, CASE WHEN dk >= 2 OR correct < 2 THEN 'unknown' ELSE 'certain' END AS UserMentalValue FROM g LEFT JOIN m ON g.term = m.term""")
def graded_records(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "documents").filter("doc_id % 4 <> 0").select(F.expr("concat('t', doc_id div 3)").alias("term"), F.concat("lang", F.lit(" of "), "source").alias("means"))
    return quiz.records(quiz.grade(quiz.tally(*_quiz(spark, d))), means)


@query("""WITH k AS (SELECT doc_id // 3 AS repo, CASE doc_id % 3 WHEN 0 THEN 'wiki' WHEN 1 THEN 'terms-db' ELSE source END AS kind FROM documents), s AS (SELECT doc_id AS repo, lang AS recorded, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS current FROM documents WHERE doc_id % 5 <> 0)
SELECT repo, kind, CAST(row_number() OVER (PARTITION BY repo ORDER BY kind) AS INT) AS ord FROM (SELECT DISTINCT repo, kind FROM k WHERE kind IS NOT NULL) k WHERE kind <> 'wiki' OR EXISTS (SELECT 1 FROM s WHERE s.repo = k.repo AND recorded = current)""")
def sealable_kinds(spark: SparkSession, d: str) -> DataFrame:
    x, k = table(spark, d, "documents"), F.col("doc_id")
    verified = x.select(F.expr("doc_id div 3").alias("repo"), F.when(k % 3 == 0, "wiki").when(k % 3 == 1, "terms-db").otherwise(F.col("source")).alias("kind"))
    return evidence.sealable(verified, x.filter(k % 5 != 0).select(k.alias("repo"), F.col("lang").alias("recorded"), F.when(k % 2 == 0, F.col("lang")).otherwise(F.col("source")).alias("current")))
