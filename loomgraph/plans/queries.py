"""Registered queries of the code-graph engine and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import changes, graph, measure, ordered, packing, quiz, terms, verify
from ..session import cut, table
from ..sources.adapters import SQL, cyclic_edges, nodes, raw_edges, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _edges(spark, d):
    return graph.fold_edges(raw_edges(spark, d))


# --- folding and contraction -------------------------------------------------


@query(with_views("raw", "edge", body="SELECT src, dst, kind, label, line, occurrences FROM edge"))
def fold_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(with_views("node", "raw", "edge", body="SELECT src, dst, kind, occurrences FROM edge WHERE src IN (SELECT id FROM node WHERE kind <> 'external')"))
def first_party_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.drop_external_sources(_edges(spark, d), nodes(spark, d)).select("src", "dst", "kind", "occurrences")


@query(with_views("node", "raw", body="SELECT id, kind, module FROM node WHERE kind <> 'external' OR id IN (SELECT dst FROM raw)"))
def prune_untouched(spark: SparkSession, d: str) -> DataFrame:
    return graph.prune_untouched(nodes(spark, d), raw_edges(spark, d)).select("id", "kind", "module")


_DEPS = "deps AS (SELECT DISTINCT s.module AS module, t.module AS depends_on FROM raw JOIN node s ON raw.src = s.id JOIN node t ON raw.dst = t.id WHERE s.module <> t.module AND t.module <> '__external__' AND s.module <> '__external__')"


@query(with_views("node", "raw", body="SELECT * FROM (WITH " + _DEPS + " SELECT module, depends_on FROM deps)"))
def module_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return graph.module_dependencies(nodes(spark, d), raw_edges(spark, d))


@query(with_views("node", "raw", body="SELECT * FROM (WITH " + _DEPS + " SELECT m.module AS id, coalesce(string_agg(depends_on, ',' ORDER BY depends_on), '') AS depends_on FROM (SELECT DISTINCT module FROM node WHERE module <> '__external__') m LEFT JOIN deps ON m.module = deps.module GROUP BY m.module)"))
def module_list(spark: SparkSession, d: str) -> DataFrame:
    return graph.modules(nodes(spark, d), raw_edges(spark, d)).select("id", F.array_join("depends_on", ",").alias("depends_on"))


@query(with_views("node", "raw", body="""
SELECT n.id, CAST(coalesce(o.c, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.c, 0) AS BIGINT) AS in_degree FROM node n
LEFT JOIN (SELECT src, count(DISTINCT dst) AS c FROM raw WHERE dst NOT LIKE 'R%' GROUP BY src) o ON n.id = o.src
LEFT JOIN (SELECT dst, count(DISTINCT src) AS c FROM raw GROUP BY dst) i ON n.id = i.dst WHERE n.kind <> 'external'"""))
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(nodes(spark, d), raw_edges(spark, d))


@query(with_views("node", "raw", "edge", body="SELECT s.module AS module, t.name AS external, CAST(sum(occurrences) AS BIGINT) AS touches FROM edge JOIN node s ON edge.src = s.id JOIN node t ON edge.dst = t.id WHERE t.kind = 'external' GROUP BY ALL"))
def external_touch(spark: SparkSession, d: str) -> DataFrame:
    return graph.external_touch(nodes(spark, d), _edges(spark, d))


_FILES_OF = """, nd AS (SELECT *, CASE WHEN line % 7 = 0 THEN 'interface' WHEN line % 5 = 0 THEN 'abstract' END AS abstraction FROM node), fw AS (SELECT f.file, coalesce(o.c, 0) AS out_edges, coalesce(i.c, 0) AS into_edges, f.interfaces, f.abstracts, 5 * f.interfaces + 3 * f.abstracts AS score FROM
  (SELECT file, count(*) FILTER (WHERE abstraction = 'interface') AS interfaces, count(*) FILTER (WHERE abstraction = 'abstract') AS abstracts FROM nd WHERE kind <> 'external' GROUP BY file) f
  LEFT JOIN (SELECT s.file, count(*) AS c FROM edge JOIN nd s ON src = s.id JOIN nd t ON dst = t.id WHERE s.file <> t.file GROUP BY s.file) o ON f.file = o.file
  LEFT JOIN (SELECT t.file, count(*) FILTER (WHERE list_extract(string_split(t.name, '.'), -1) NOT LIKE '\\_%' ESCAPE '\\') AS c FROM edge JOIN nd s ON src = s.id JOIN nd t ON dst = t.id WHERE s.file <> t.file GROUP BY t.file) i ON f.file = i.file)"""


def _weighed(spark, d):
    return nodes(spark, d).withColumn("abstraction", F.when(F.col("line") % 7 == 0, "interface").when(F.col("line") % 5 == 0, "abstract"))


@query(with_views("node", "raw", "edge", body=_FILES_OF + """
SELECT file, CAST(out_edges AS BIGINT) AS out_edges, CAST(into_edges AS BIGINT) AS into_edges, CAST(interfaces AS BIGINT) AS interfaces, CAST(abstracts AS BIGINT) AS abstracts,
  round(coalesce(1 - out_edges / nullif(max(out_edges) OVER (), 0), 1) + coalesce(into_edges / nullif(max(into_edges) OVER (), 0), 0) + coalesce(score / nullif(max(score) OVER (), 0), 0), 6) AS weight FROM fw"""))
def file_weights(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_weights(_weighed(spark, d), _edges(spark, d)).withColumn("weight", F.round("weight", 6))


@query(with_views("raw", body="SELECT DISTINCT src, dst, kind FROM raw WHERE src IN ('S1', 'S2') OR dst = 'P7'"))
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    focus = spark.createDataFrame([("S1",), ("S2",), ("P7",)], "id string")
    return graph.neighbourhood(raw_edges(spark, d).select("src", "dst", "kind").distinct(), focus)


@query(with_views("cyc_n", "cyc", body="SELECT x.a, x.b FROM cyc x JOIN cyc y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b"))
def mutual_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.mutual_pairs(cyclic_edges(spark, d))


@query(with_views("cyc_n", "cyc", body="SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM cyc"))
def undirected_links(spark: SparkSession, d: str) -> DataFrame:
    e = cut(cyclic_edges(spark, d), "cyc")
    return graph.undirected_links(e, e.select(F.explode(F.array("a", "b")).alias("id")).distinct())


# --- iteration ------------------------------------------------------------------


def _rank_sql(n: int) -> str:
    steps = ["r0 AS (SELECT k, 1.0 / n AS r FROM cyc_n)"]
    for i in range(1, n + 1):
        steps.append(
            f"r{i} AS (SELECT c.k, 0.15 / c.n + 0.85 * (coalesce(f.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE k NOT IN (SELECT a FROM cyc)) / c.n) AS r FROM cyc_n c "
            f"LEFT JOIN (SELECT b, sum(r / o.d) AS s FROM cyc JOIN r{i - 1} p ON a = p.k JOIN outs o ON o.a = cyc.a GROUP BY b) f ON f.b = c.k)"
        )
    return with_views("cyc_n", "cyc", body="") .rstrip() + ", outs AS (SELECT a, count(*) AS d FROM cyc GROUP BY a), " + ", ".join(steps) + f" SELECT k AS id, round(r, 6) AS rank FROM r{n}"


def _keys(spark, d):
    return spark.range(table(spark, d, "supplier").count())


@query(_rank_sql(20))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    e = cyclic_edges(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"))
    return graph.pagerank(_keys(spark, d), e).select("id", F.round("rank", 6).alias("rank"))


@query(with_views("cyc_n", "cyc", body=", und AS (SELECT a, b FROM cyc UNION SELECT b, a FROM cyc), walk AS (SELECT CAST(3 AS BIGINT) AS id, 0 AS hop UNION SELECT und.b, hop + 1 FROM walk JOIN und ON walk.id = und.a WHERE hop < 3) SELECT id, min(hop) AS hop FROM walk GROUP BY id", recursive=True))
def reach_three_hops(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(spark.createDataFrame([(3,)], "id bigint"), cyclic_edges(spark, d), 3)


_TENS = "link AS (SELECT c_custkey AS a, c_custkey - c_custkey % 10 AS b FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN c_custkey - 1 ELSE c_custkey END FROM customer), known AS (SELECT * FROM link WHERE a IN (SELECT c_custkey FROM customer) AND b IN (SELECT c_custkey FROM customer))"


@query(f"WITH RECURSIVE {_TENS}, und AS (SELECT a, b FROM known UNION SELECT b, a FROM known), walk AS (SELECT c_custkey AS id, c_custkey AS root FROM customer UNION SELECT und.b, root FROM walk JOIN und ON walk.id = und.a) SELECT id, min(root) AS component FROM walk GROUP BY id")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Customers linked to the one before them and to the head of their ten; a head that isn't there is ignored."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    links = c.select(k.alias("a"), F.explode(F.array(k - k % 10, F.when(k % 10 > 0, k - 1).otherwise(k))).alias("b"))
    return graph.components(c.select(k.alias("id")), links)


_REACH = ", walk AS (SELECT a, b FROM cyc UNION SELECT walk.a, cyc.b FROM walk JOIN cyc ON walk.b = cyc.a), scc AS (SELECT k AS id, least(k, coalesce((SELECT min(x.b) FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a WHERE x.a = k), k)) AS scc FROM cyc_n)"


@query(with_views("cyc_n", "cyc", body=_REACH + " SELECT id, scc FROM scc", recursive=True))
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(_keys(spark, d), cyclic_edges(spark, d))


@query(with_views("cyc_n", "cyc", body=_REACH + """
, dag AS (SELECT DISTINCT x.scc AS ca, y.scc AS cb FROM cyc JOIN scc x ON a = x.id JOIN scc y ON b = y.id WHERE x.scc <> y.scc)
, lev AS (SELECT DISTINCT scc AS c, 0 AS l FROM scc UNION SELECT dag.ca, l + 1 FROM lev JOIN dag ON lev.c = dag.cb)
SELECT scc.id, max(l) AS level, (SELECT count(*) FROM scc z WHERE z.scc = scc.scc) > 1 AS in_cycle FROM scc JOIN lev ON scc.scc = lev.c GROUP BY scc.id, scc.scc""", recursive=True))
def layers(spark: SparkSession, d: str) -> DataFrame:
    return graph.layers(_keys(spark, d), cyclic_edges(spark, d))


@query(with_views("cyc_n", "cyc", body=_REACH + " SELECT a, b FROM cyc JOIN scc x ON a = x.id JOIN scc y ON b = y.id WHERE x.scc = y.scc", recursive=True))
def cycle_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_edges(_keys(spark, d), cyclic_edges(spark, d))


@query(with_views("cyc_n", "cyc", body=_REACH + ", inner_ AS (SELECT a, b FROM cyc JOIN scc x ON a = x.id JOIN scc y ON b = y.id WHERE x.scc = y.scc), path AS (SELECT a AS s, [a, b] AS p, b AS l FROM inner_ WHERE a < b UNION ALL SELECT s, list_append(p, inner_.b), inner_.b FROM path JOIN inner_ ON l = inner_.a WHERE inner_.b > s AND NOT list_contains(p, inner_.b)) SELECT array_to_string(p, '>') AS path, CAST(len(p) AS INT) AS length FROM path JOIN inner_ ON l = inner_.a AND s = inner_.b", recursive=True))
def simple_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_cycles(cyclic_edges(spark, d)).select(F.array_join("path", ">").alias("path"), F.size("path").alias("length"))


@query(with_views("node", "raw", "edge", body="""
, pair AS (SELECT DISTINCT s.file AS a, t.file AS b FROM edge JOIN node s ON src = s.id JOIN node t ON dst = t.id WHERE s.file <> t.file)
SELECT DISTINCT file FROM (SELECT 'Brand#11/none' AS file UNION ALL SELECT 'ASIA/CHINA' UNION ALL SELECT b FROM pair WHERE a IN ('ASIA/CHINA', 'Brand#11/none') UNION ALL SELECT a FROM pair WHERE b IN ('ASIA/CHINA', 'Brand#11/none'))"""))
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    changed = spark.createDataFrame([("Brand#11/none",), ("ASIA/CHINA",)], "file string")
    return graph.blast_radius(nodes(spark, d), _edges(spark, d), changed, 1)


# --- batches --------------------------------------------------------------------


@query("""WITH RECURSIVE f AS (SELECT p_brand AS level, p_type AS file, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS rn FROM part GROUP BY p_brand, p_type),
b AS (SELECT level, file, n, rn, n AS filled, CAST(0 AS BIGINT) AS batch FROM f WHERE rn = 1
  UNION ALL SELECT f.level, f.file, f.n, f.rn, CASE WHEN b.filled > 0 AND b.filled + f.n > 8 THEN f.n ELSE b.filled + f.n END, CASE WHEN b.filled > 0 AND b.filled + f.n > 8 THEN b.batch + 1 ELSE b.batch END FROM b JOIN f ON f.level = b.level AND f.rn = b.rn + 1)
SELECT level, file, n, batch FROM b""")
def pack_batches(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "part").select(F.col("p_brand").alias("level"), F.col("p_type").alias("file"), F.col("p_partkey").alias("symbol"))
    return packing.pack(members, 8)


@query("""WITH RECURSIVE f AS (SELECT p_brand AS level, p_type AS file, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS rn FROM part GROUP BY p_brand, p_type),
b AS (SELECT level, n, rn, n AS filled, CAST(0 AS BIGINT) AS batch FROM f WHERE rn = 1
  UNION ALL SELECT f.level, f.n, f.rn, CASE WHEN b.filled > 0 AND b.filled + f.n > 8 THEN f.n ELSE b.filled + f.n END, CASE WHEN b.filled > 0 AND b.filled + f.n > 8 THEN b.batch + 1 ELSE b.batch END FROM b JOIN f ON f.level = b.level AND f.rn = b.rn + 1)
SELECT level, count(DISTINCT batch) AS batches, CAST(sum(n) AS BIGINT) AS symbols FROM b GROUP BY level""")
def plan_sessions(spark: SparkSession, d: str) -> DataFrame:
    return packing.sessions(pack_batches(spark, d))


_SHARD = "SELECT 's' || (o_orderkey % 5) AS shard, CAST(o_orderkey AS INT) AS pos, 'k' || (o_custkey % 400) AS key, 'f' || (o_orderkey % 2) AS file, 'r' || o_orderkey AS rec FROM orders"


@query(f"""WITH RECURSIVE s AS (SELECT key, file, rec, row_number() OVER (PARTITION BY key ORDER BY shard, pos) AS rn FROM ({_SHARD})),
f AS (SELECT key, rn, file AS bf, rec AS br, CAST([] AS STRUCT(k VARCHAR, f VARCHAR, r VARCHAR)[]) AS o FROM s WHERE rn = 1
  UNION ALL SELECT s.key, s.rn, CASE WHEN bf <> s.file THEN NULL ELSE s.file END, CASE WHEN bf <> s.file THEN NULL ELSE s.rec END, CASE WHEN bf <> s.file THEN list_concat(o, [{{'k': bf || '.' || s.key, 'f': bf, 'r': br}}, {{'k': s.file || '.' || s.key, 'f': s.file, 'r': s.rec}}]) ELSE o END FROM f JOIN s ON s.key = f.key AND s.rn = f.rn + 1),
l AS (SELECT key, arg_max(bf, rn) AS bf, arg_max(br, rn) AS br, max_by(o, rn) AS o FROM (SELECT key, rn, coalesce(bf, '') AS bf, coalesce(br, '') AS br, o FROM f) GROUP BY key), u AS (SELECT unnest(o) AS e, unnest(range(len(o))) AS n FROM l)
SELECT e.k AS key, arg_max(e.f, n) AS file, arg_max(e.r, n) AS rec FROM u GROUP BY e.k UNION ALL SELECT key, bf, br FROM l WHERE bf <> ''""")
def merge_shards(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    shards = o.select(F.concat(F.lit("s"), F.col("o_orderkey") % 5).alias("shard"), F.col("o_orderkey").cast("int").alias("pos"), F.concat(F.lit("k"), F.col("o_custkey") % 400).alias("key"), F.concat(F.lit("f"), F.col("o_orderkey") % 2).alias("file"), F.concat(F.lit("r"), "o_orderkey").alias("rec"))
    return packing.merge_shards(shards)


@query(f"WITH s AS ({_SHARD}) SELECT key, arg_max(file, (shard, pos)) AS file, arg_max(rec, (shard, pos)) AS rec FROM s GROUP BY key")
def last_record_wins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("k"), F.col("o_custkey") % 400).alias("key"), F.concat(F.lit("f"), F.col("o_orderkey") % 2).alias("file"), F.concat(F.lit("r"), "o_orderkey").alias("rec"), F.concat(F.lit("s"), F.col("o_orderkey") % 5).alias("shard"), F.col("o_orderkey").alias("pos"))
    return o.groupBy("key").agg(F.max_by("file", F.struct("shard", "pos")).alias("file"), F.max_by("rec", F.struct("shard", "pos")).alias("rec"))


# --- snapshots ------------------------------------------------------------------

_OLD = "SELECT 'o' || o_orderkey AS path, CAST(o_orderkey % 100 AS DOUBLE) AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS size, sha256(o_orderstatus || '|' || o_orderkey) AS file_hash, sha256(o_orderpriority) AS decl_hash FROM orders WHERE o_orderkey % 11 <> 0"
_NEW = "SELECT 'o' || o_orderkey AS path, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 ELSE o_orderkey % 101 END AS DOUBLE) AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS size, sha256(o_orderstatus || '|' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END) AS file_hash, sha256(o_orderpriority || CASE WHEN o_orderkey % 14 = 0 THEN 'y' ELSE '' END) AS decl_hash FROM orders WHERE o_orderkey % 13 <> 0"


def _snapshots(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    sha = lambda c: F.sha2(c, 256)
    size = F.floor("o_totalprice").cast("bigint").alias("size")
    path = F.concat(F.lit("o"), "o_orderkey").alias("path")
    old = o.filter(k % 11 != 0).select(path, (k % 100).cast("double").alias("mtime"), size, sha(F.concat_ws("|", "o_orderstatus", "o_orderkey")).alias("file_hash"), sha(F.col("o_orderpriority")).alias("decl_hash"))
    new = o.filter(k % 13 != 0).select(
        path, F.when(k % 3 == 0, k % 100).otherwise(k % 101).cast("double").alias("mtime"), size, sha(F.concat(F.concat_ws("|", "o_orderstatus", "o_orderkey"), F.when(k % 7 == 0, "x").otherwise(""))).alias("file_hash"),
        sha(F.concat("o_orderpriority", F.when(k % 14 == 0, "y").otherwise(""))).alias("decl_hash"),
    )
    return old, new


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'reread' WHEN o.mtime = n.mtime AND o.size = n.size THEN 'unchanged'
WHEN o.file_hash = n.file_hash THEN 'unchanged' WHEN o.decl_hash = n.decl_hash THEN 'location_only' ELSE 'reread' END AS verdict FROM o FULL JOIN n ON o.path = n.path""")
def snapshot_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return changes.verdicts(*_snapshots(spark, d))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT o.path FROM o LEFT JOIN n ON o.path = n.path WHERE o.file_hash IS DISTINCT FROM n.file_hash")
def manifest_drift(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return changes.drift(old.select("path", F.col("file_hash").alias("hash")), new.select("path", F.col("file_hash").alias("hash")))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.path, n.path) AS path FROM o FULL JOIN n ON o.path = n.path WHERE o.file_hash IS DISTINCT FROM n.file_hash")
def symmetric_changes(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return changes.symmetric_changes(old.select("path", F.col("file_hash").alias("hash")), new.select("path", F.col("file_hash").alias("hash")))


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), j AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'vanished' WHEN o.file_hash <> n.file_hash THEN 'changed' END AS state FROM o FULL JOIN n ON o.path = n.path)
SELECT path, state, CASE state WHEN 'changed' THEN 0 WHEN 'created' THEN 1 ELSE 2 END AS rank FROM j WHERE state IS NOT NULL""")
def seal_staleness(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return changes.staleness(old.select("path", F.col("file_hash").alias("hash")), new.select("path", F.col("file_hash").alias("hash")))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.path, n.path) AS key, CASE WHEN n.path IS NULL THEN 'missing' ELSE 'extra' END AS fault FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL")
def plan_coverage(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return changes.coverage(old.select(F.col("path").alias("key")), new.select(F.col("path").alias("key")))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT o.path, 'wider' AS issue FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT path, 'narrower' FROM n WHERE path NOT IN (SELECT path FROM o)")
def plan_agrees(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return changes.targets_agree(old, new)


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT n.path, CASE WHEN o.path IS NOT NULL THEN 'collected' WHEN regexp_matches(n.path, '5$') THEN 'excluded' ELSE 'missed' END AS status, CASE WHEN o.path IS NULL AND regexp_matches(n.path, '5$') THEN 'suffix' END AS reason FROM n LEFT JOIN o ON n.path = o.path")
def source_inventory(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return changes.inventory(new, old, new.filter(F.col("path").endswith("5")).select("path", F.lit("suffix").alias("reason")))


@query("SELECT substr(n_name, 1, 1) AS letter, sha256(string_agg(n_name || '=' || n_nationkey || chr(10), '' ORDER BY n_name)) AS digest FROM nation GROUP BY 1")
def sources_digest(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))), lambda x: F.concat(x["n_name"], F.lit("="), x["n_nationkey"].cast("string"), F.lit("\n"))), "")
    return n.groupBy(F.substring("n_name", 1, 1).alias("letter")).agg(F.sha2(joined, 256).alias("digest"))


@query("SELECT c_custkey AS id, sha256(sha256(c_name) || chr(10) || sha256(c_mktsegment) || chr(10) || sha256(CAST(c_nationkey AS VARCHAR)) || chr(10)) AS generation FROM customer")
def generation_id(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    parts = [x for col in ("c_name", "c_mktsegment") for x in (F.sha2(col, 256), F.lit("\n"))] + [F.sha2(F.col("c_nationkey").cast("string"), 256), F.lit("\n")]
    return c.select(F.col("c_custkey").alias("id"), F.sha2(F.concat(*parts), 256).alias("generation"))


@query("SELECT c_custkey AS id, sha1(encode('blob ' || strlen(c_name)) || '\\x00'::BLOB || encode(c_name)) AS blob_id FROM customer")
def blob_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.blob_id(F.col("c_name")).alias("blob_id"))


# --- verification ---------------------------------------------------------------


def _broken(spark, d):
    """The graph with injected defects."""
    n = nodes(spark, d)
    e = _edges(spark, d).select("src", "dst", "kind", F.when(F.col("dst").startswith("R") & (F.col("src") != "S3"), False).alias("constraint"))
    n = n.unionByName(n.filter("id = 'P5'")).withColumn("line", F.when(F.col("id") == "P9", None).otherwise(F.col("line")))
    extra = spark.createDataFrame([("S1", "P999999999", "dependency", None), ("X1", "P1", "dependency", None), ("R1", "P1", "dependency", None)], "src string, dst string, kind string, constraint boolean")
    # thirteen rules read the graph: it is folded once
    n, e = cut(n, "broken-nodes"), cut(e.unionByName(extra), "broken-edges")
    modules = graph.modules(n, e).filter("id <> 'Brand#11'").unionByName(spark.createDataFrame([("Ghost", ["Ghost", "Brand#12"])], "id string, depends_on array<string>"))
    return n, e, cut(modules, "broken-modules")


_BROKEN = with_views("node", "raw", "edge", body="""
, n2 AS (SELECT id, name, kind, module, file, CASE WHEN id = 'P9' THEN NULL ELSE line END AS line FROM (SELECT * FROM node UNION ALL SELECT * FROM node WHERE id = 'P5'))
, e2 AS (SELECT src, dst, kind, CASE WHEN dst LIKE 'R%' AND src <> 'S3' THEN false END AS constr FROM edge UNION ALL VALUES ('S1', 'P999999999', 'dependency', NULL), ('X1', 'P1', 'dependency', NULL), ('R1', 'P1', 'dependency', NULL))
, counted AS (SELECT DISTINCT s.module AS module, t.module AS depends_on FROM e2 JOIN n2 s ON src = s.id JOIN n2 t ON dst = t.id WHERE s.module <> t.module AND s.module <> '__external__' AND t.module <> '__external__')
, own AS (SELECT DISTINCT module AS id FROM n2 WHERE module <> '__external__')
, listed AS (SELECT id FROM own WHERE id <> 'Brand#11' UNION ALL SELECT 'Ghost')
, stated AS (SELECT * FROM counted WHERE module <> 'Brand#11' UNION ALL VALUES ('Ghost', 'Ghost'), ('Ghost', 'Brand#12'))
, faults AS (
SELECT 'duplicate_node' AS code, id AS place FROM n2 GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_edge', src || ' ' || dst || ' ' || kind FROM e2 GROUP BY src, dst, kind HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'dangling_source', src FROM e2 WHERE src NOT IN (SELECT id FROM n2)
UNION ALL SELECT DISTINCT 'dangling_target', dst FROM e2 WHERE dst NOT IN (SELECT id FROM n2)
UNION ALL SELECT 'external_shape', id FROM n2 WHERE (kind = 'external') <> (module = '__external__' AND file IS NULL)
UNION ALL SELECT 'no_location', id FROM n2 WHERE kind <> 'external' AND (file IS NULL OR line IS NULL)
UNION ALL SELECT 'edge_from_external', src || ' ' || dst || ' ' || kind FROM e2 WHERE src IN (SELECT id FROM n2 WHERE kind = 'external')
UNION ALL SELECT 'external_constraint', src || ' ' || dst || ' ' || kind FROM e2 WHERE constr IS DISTINCT FROM false AND dst IN (SELECT id FROM n2 WHERE kind = 'external')
UNION ALL SELECT 'module_not_listed', id FROM own WHERE id NOT IN (SELECT id FROM listed)
UNION ALL SELECT 'module_unknown', id FROM listed WHERE id NOT IN (SELECT id FROM own)
UNION ALL SELECT 'self_dependency', module FROM stated WHERE module = depends_on
UNION ALL SELECT 'dependency_not_counted', module || ' ' || depends_on FROM (SELECT * FROM stated EXCEPT SELECT * FROM counted) WHERE module <> depends_on
UNION ALL SELECT 'dependency_not_stated', module || ' ' || depends_on FROM (SELECT * FROM counted EXCEPT SELECT * FROM stated))""")


@query(_BROKEN + " SELECT code, place FROM faults")
def consistency_faults(spark: SparkSession, d: str) -> DataFrame:
    return verify.consistency(*_broken(spark, d))


@query(_BROKEN + ", s AS (SELECT CASE WHEN code LIKE 'module%' OR code LIKE '%dependency%' THEN 'modules' ELSE 'elements' END AS section, code, count(*) AS n FROM faults GROUP BY ALL) SELECT section, code, n, CAST(sum(n) OVER (PARTITION BY section) AS BIGINT) AS total FROM s")
def fault_sections(spark: SparkSession, d: str) -> DataFrame:
    faults = verify.consistency(*_broken(spark, d))
    section = F.when(F.col("code").startswith("module") | F.col("code").contains("dependency"), "modules").otherwise("elements")
    return verify.section_counts(faults.withColumn("section", section)).select("section", "code", "n", "total")


@query(_BROKEN + ", t AS (SELECT code, place, row_number() OVER (PARTITION BY code ORDER BY place) AS rn, count(*) OVER (PARTITION BY code) AS n FROM faults) SELECT code, n, string_agg(place, ';' ORDER BY place) AS examples FROM t WHERE rn <= 5 GROUP BY code, n")
def fault_handoff(spark: SparkSession, d: str) -> DataFrame:
    return verify.handoff(verify.consistency(*_broken(spark, d))).select("code", "n", F.array_join("examples", ";").alias("examples"))


@query("""WITH d AS (SELECT event_type AS reason, CASE event_type WHEN 'error' THEN 'fault' WHEN 'click' THEN 'unresolved' WHEN 'view' THEN 'policy' ELSE 'count' END AS class, 'e' || event_id AS sample, event_id AS ord FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY ord) AS rn, count(*) OVER (PARTITION BY reason) AS n FROM d)
SELECT reason, class, n AS count, string_agg(sample, ',' ORDER BY rn) AS samples, CASE class WHEN 'fault' THEN 0 WHEN 'unresolved' THEN 1 WHEN 'policy' THEN 2 ELSE 3 END AS rank FROM t WHERE rn <= 5 GROUP BY reason, class, n""")
def drop_ledger(spark: SparkSession, d: str) -> DataFrame:
    e, kind = table(spark, d, "events"), F.col("event_type")
    cls = F.when(kind == "error", "fault").when(kind == "click", "unresolved").when(kind == "view", "policy").otherwise("count")
    drops = e.select(kind.alias("reason"), cls.alias("class"), F.concat(F.lit("e"), "event_id").alias("sample"), F.col("event_id").alias("ord"))
    return verify.ledger_report(verify.ledger(drops)).select("reason", "class", "count", F.array_join("samples", ",").alias("samples"), "rank")


# --- lines and citations --------------------------------------------------------

_CITE = "SELECT 'd' || (user_id % 20) AS doc, CAST(event_id AS INT) AS line, 'see src/f' || (user_id % 50) || '.py:' || (event_id % 60) || ' and x/g' || (event_id % 9) || '.ts:7-9 for ' || event_type AS text FROM events"
_FILES = "SELECT 'src/f' || i || '.py' AS path, CAST((i * 7) % 50 + 1 AS INT) AS n_lines FROM range(45) t(i) UNION ALL SELECT 'x/g' || i || '.ts', 20 FROM range(5) t(i)"


def _cited(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit("see src/f"), F.col("user_id") % 50, F.lit(".py:"), F.col("event_id") % 60, F.lit(" and x/g"), F.col("event_id") % 9, F.lit(".ts:7-9 for "), "event_type")
    lines = e.select(F.concat(F.lit("d"), F.col("user_id") % 20).alias("doc"), F.col("event_id").cast("int").alias("line"), text.alias("text"))
    i = F.col("id")
    files = spark.range(45).select(F.concat(F.lit("src/f"), i, F.lit(".py")).alias("path"), ((i * 7) % 50 + 1).cast("int").alias("n_lines")).unionByName(spark.range(5).select(F.concat(F.lit("x/g"), i, F.lit(".ts")).alias("path"), F.lit(20).alias("n_lines")))
    node_at = spark.range(45).select(F.concat(F.lit("src/f"), i, F.lit(".py")).alias("file"), (i % 11).cast("int").alias("line"))
    edge_at = spark.range(45).select(F.concat(F.lit("src/f"), i, F.lit(".py")).alias("file"), (i % 6).cast("int").alias("line"))
    return lines, files, node_at, edge_at


_VERDICT = f"""WITH l AS ({_CITE}), f AS ({_FILES}), nd AS (SELECT 'src/f' || i || '.py' AS file, i % 11 AS line FROM range(45) t(i)), ed AS (SELECT 'src/f' || i || '.py' AS file, i % 6 AS line FROM range(45) t(i)),
c AS (SELECT doc, line, unnest(regexp_extract_all(text, '[A-Za-z0-9_@./+~-]+[.](?:py|ts):[0-9]+')) AS cite FROM l), p AS (SELECT doc, line, split_part(cite, ':', 1) AS path, CAST(split_part(cite, ':', 2) AS INT) AS cited FROM c)
SELECT doc, line, p.path, cited, CASE WHEN n_lines IS NULL THEN 'L1_no_file' WHEN cited > n_lines THEN 'L2_no_line' WHEN EXISTS (SELECT 1 FROM nd WHERE nd.file = p.path AND nd.line = cited) THEN 'node' WHEN EXISTS (SELECT 1 FROM ed WHERE ed.file = p.path AND ed.line = cited) THEN 'edge' ELSE 'unfounded' END AS verdict
FROM p LEFT JOIN f ON p.path = f.path"""


@query(_VERDICT)
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    return terms.check_citations(*_cited(spark, d)).drop("unnamed")


@query(f"WITH v AS ({_VERDICT}) SELECT verdict, count(*) AS n, count(DISTINCT path) AS files FROM v GROUP BY verdict")
def citation_totals(spark: SparkSession, d: str) -> DataFrame:
    return terms.check_citations(*_cited(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


@query("""SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS INT) AS by_bytes,
CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS by_split FROM documents""")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.lines_by_bytes(t).alias("by_bytes"), X.lines_by_split(t).alias("by_split"))


@query("""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc, CAST(line AS INT) AS line, md5(concat_ws(chr(10), lag(text) OVER w, text, lead(text) OVER w)) AS context FROM l WINDOW w AS (PARTITION BY doc ORDER BY line)""")
def line_context(spark: SparkSession, d: str) -> DataFrame:
    lines = ordered.explode_lines(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return ordered.with_context(lines).select("doc", "line", F.md5("context").alias("context"))


_TURNS = "SELECT conv_id AS doc, CAST(turn AS INT) AS line, text, role FROM conversations"


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("line"), "text", "role")


@query(f"""WITH l AS (SELECT *, role NOT IN ('user', 'system') AS stops FROM ({_TURNS})),
m AS (SELECT doc, line, role, (SELECT max(s.line) FROM l s WHERE s.doc = l.doc AND s.line < l.line AND s.stops) AS last_stop FROM l WHERE role = 'assistant')
SELECT m.doc, m.line, md5(coalesce((SELECT string_agg(trim(c.text, ' '), ' ' ORDER BY c.line) FROM l c WHERE c.doc = m.doc AND c.line < m.line AND c.role = 'user' AND c.line >= m.line - 14 AND c.line > coalesce(m.last_stop, -1)), '')) AS above FROM m""")
def doc_above(spark: SparkSession, d: str) -> DataFrame:
    return _above(_turns(spark, d).withColumn("text", F.concat_ws("\t", "role", "text")))


def _above(rows: DataFrame) -> DataFrame:
    named = rows.select(F.col("doc").alias("key"), "line", "text")
    kind = F.split("text", "\t").getItem(0)
    held = ordered.doc_above(named, kind == "assistant", kind == "user", kind == "system", reach=14, key="key")
    return held.select(F.col("key").alias("doc"), "line", F.md5(F.regexp_replace("doc", r"(^| )user\t", "$1")).alias("above"))


@query(f"WITH l AS ({_TURNS}), c AS (SELECT doc, line, role, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY doc ORDER BY line) AS k FROM l) SELECT doc, line, CASE WHEN role <> 'user' AND k % 2 = 1 THEN CAST((k + 1) / 2 AS INT) END AS block FROM c")
def fence_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).withColumn("text", F.col("role"))
    return ordered.fence_blocks(rows, "^user$").select("doc", "line", "block")


@query(f"WITH l AS ({_TURNS}) SELECT doc, line, last_value(CASE WHEN role = 'user' THEN line END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM l")
def carried_down(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).withColumn("v", F.when(F.col("role") == "user", F.col("line")))
    return ordered.carry_down(rows, "v", "asked", "line", "doc").select("doc", "line", "asked")


@query(f"WITH l AS ({_TURNS}), s AS (SELECT doc, line, text, role, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY doc ORDER BY line) AS k FROM l) SELECT doc, min(line) AS first_line, count(*) AS n_lines, md5(coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (WHERE role <> 'user'), '')) AS body FROM s GROUP BY doc, k")
def dialogue_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).withColumn("text", F.when(F.col("role") == "user", F.concat(F.lit("@@ "), F.md5("text"))).otherwise(F.col("text")))
    return ordered.sections(rows, r"^@@ ([0-9a-f]{32})$").select("doc", "first_line", "n_lines", F.md5("body").alias("body"))



@query("""WITH l AS (SELECT user_id % 10 AS repo, event_id AS ord, CASE WHEN event_type = 'click' THEN event_id END AS hash, 'src/m' || (event_id % 40) || '.py' AS path, event_id % 17 AS added, event_id % 5 AS deleted FROM events),
c AS (SELECT *, last_value(hash IGNORE NULLS) OVER (PARTITION BY repo ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS commit FROM l)
SELECT repo, path, count(DISTINCT commit) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted FROM c WHERE hash IS NULL GROUP BY ALL""")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("event_id")
    new = F.format_string("src/{old => m%d}.py", (k % 40).cast("int"))
    text = F.when(F.col("event_type") == "click", F.lpad(F.col("event_id").cast("string"), 10, "0")).otherwise(F.concat_ws("\t", (k % 17).cast("string"), (k % 5).cast("string"), new))
    return ordered.hotspots(e.select((F.col("user_id") % 10).alias("repo"), k.alias("ord"), text.alias("text")))


@query("""WITH h AS (SELECT user_id AS path, count(*) AS commits, min(event_id) AS first FROM events GROUP BY user_id) SELECT path, commits FROM h ORDER BY commits DESC, first LIMIT 30""")
def hotspot_top(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.count("*").alias("commits"), F.min("event_id").alias("first"))
    return h.orderBy(F.desc("commits"), "first").limit(30).select("path", "commits")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<script')) AS INT) AS scripts, CAST(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS INT) AS links FROM pages")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<script")).alias("scripts"), F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("links"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped, md5(replace(replace(html, '\\', '\\\\'), '\"', '\\\"')) AS dot FROM pages")
def escapes(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.md5(X.escape_html(h)).alias("escaped"), F.md5(X.escape_dot(h)).alias("dot"))


@query("SELECT event_id, CASE WHEN v < 60 THEN printf('%.1f초', v) ELSE printf('%d분 %04.1f초', CAST(floor(v / 60) AS INT), v - floor(v / 60) * 60) END AS shown, CAST(floor(v / 100 * 100 + 0.5) AS INT) AS pct, least(greatest(v, 10.0), 90.0) AS clamped FROM (SELECT event_id, floor(value * 10) / 10 AS v FROM events)")
def scalars(spark: SparkSession, d: str) -> DataFrame:
    v = F.floor(F.col("value") * 10) / 10  # tenths: the engines round halves of them differently
    return table(spark, d, "events").select("event_id", X.duration(v).alias("shown"), X.percent(v / 100).alias("pct"), X.clamp(v, F.lit(10.0), F.lit(90.0)).alias("clamped"))


@query("SELECT c_custkey AS id, list_extract(string_split(list_extract(string_split(list_extract(string_split(q, '##'), -1), '::'), -1), '.'), -1) AS short, split_part(f, '/', 2) AS module, NOT starts_with(list_extract(string_split(q, '.'), -1), '_') AS public FROM (SELECT c_custkey, 'a##b::' || CASE WHEN c_custkey % 3 = 0 THEN 'x.' ELSE '_' END || CASE WHEN c_custkey % 4 = 0 THEN '_' ELSE '' END || c_mktsegment AS q, 'src/' || c_mktsegment || '/' || c_name || '.py' AS f FROM customer)")
def names(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    q = F.concat(F.lit("a##b::"), F.when(k % 3 == 0, "x.").otherwise("_"), F.when(k % 4 == 0, "_").otherwise(""), "c_mktsegment")
    f = F.concat(F.lit("src/"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".py"))
    return c.select(k.alias("id"), X.short_name(q).alias("short"), X.module_of(f).alias("module"), X.is_public(q).alias("public"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, 'id=\"', 'id=\"p' || page_id || '-', 'g'), 'href=\"#', 'href=\"#p' || page_id || '-', 'g')) AS svg FROM (SELECT page_id, '<svg viewBox=\"0\"><g id=\"a' || page_id || '\"/><use href=\"#a' || page_id || '\"/></svg>' AS html FROM pages)")
def inline_svg(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "pages"), F.col("page_id")
    svg = F.concat(F.lit('<?xml version="1.0"?><svg width="3pt" height="4pt" viewBox="0"><g id="a'), k, F.lit('"/><use href="#a'), k, F.lit('"/></svg>'))
    return p.select("page_id", F.md5(X.inline_svg(svg, F.concat(F.lit("p"), k, F.lit("-")))).alias("svg"))


def _overlaps(vectors: DataFrame) -> DataFrame:
    """Boxes of a layout that overlap, by a grid of cells as wide as a box."""
    b = vectors.select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))
    cell = lambda c, k: (F.floor(F.col(c) / 4) + k).alias(f"c{c}")
    left = b.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), cell("x", 0), cell("y", 0))
    near = F.explode(F.array(*[F.struct(cell("x", i), cell("y", j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    right = b.select(F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), near.alias("n")).select("b", "xb", "yb", F.col("n.cx").alias("cx"), F.col("n.cy").alias("cy"))
    ox, oy = 4 - F.abs(F.col("xa") - F.col("xb")), 4 - F.abs(F.col("ya") - F.col("yb"))
    hit = left.join(right, ["cx", "cy"]).filter((F.col("a") < F.col("b")) & (ox > 0) & (oy > 0))
    return hit.select("a", "b", F.round(F.when(ox <= oy, ox).otherwise(oy), 4).alias("amount"), F.when(ox <= oy, "x").otherwise("y").alias("axis"))


@query("""WITH b AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings)
SELECT p.id AS a, q.id AS b, round(CASE WHEN ox <= oy THEN ox ELSE oy END, 4) AS amount, CASE WHEN ox <= oy THEN 'x' ELSE 'y' END AS axis FROM (SELECT p.id, q.id AS qid, 4 - abs(p.x - q.x) AS ox, 4 - abs(p.y - q.y) AS oy FROM b p JOIN b q ON p.id < q.id) z JOIN b p ON z.id = p.id JOIN b q ON z.qid = q.id WHERE ox > 0 AND oy > 0""")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(table(spark, d, "embeddings"))


# --- dictionaries ---------------------------------------------------------------

_TERMS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS term FROM benchmark"


@query(f"WITH t AS ({_TERMS}), w AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS term FROM documents) SELECT doc, term, count(*) AS n FROM w WHERE term IN (SELECT term FROM t) GROUP BY ALL")
def term_pick(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("term"))
    return terms.pick_terms(t, table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query("""WITH t AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+ [a-z]+')) AS term FROM benchmark) WHERE split_part(term, ' ', 1) <> split_part(term, ' ', 2)),
k AS (SELECT doc_id AS doc, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]') AS r FROM documents), w AS (SELECT doc, unnest(r) AS x, generate_subscripts(r, 1) AS p FROM k),
g AS (SELECT doc, x, lead(x, 1) OVER v AS gap, lead(x, 2) OVER v AS y FROM w WINDOW v AS (PARTITION BY doc ORDER BY p))
SELECT doc, term, count(*) AS n FROM (SELECT doc, x || ' ' || y AS term FROM g WHERE gap = ' ') WHERE term IN (SELECT term FROM t) GROUP BY ALL""")
def phrase_pick(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+ [a-z]+"), F.lit(0))).alias("term"))
    return terms.pick_terms(t.filter("substring_index(term, ' ', 1) <> substring_index(term, ' ', -1)"), table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query(f"WITH t AS ({_TERMS}) SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS term FROM documents) WHERE term NOT IN (SELECT term FROM t)")
def new_concepts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("term"))
    return terms.new_concepts(t, table(spark, d, "documents"), "[A-Z][a-z]+")




def _named(spark, d):
    n = nodes(spark, d).withColumn("name", F.when(F.col("kind") == "class", F.col("name")).otherwise(F.concat("module", F.lit("_"), (F.col("line") % 20))))
    return n


@query(with_views("node", "raw", body=", nm AS (SELECT id, CASE WHEN kind = 'class' THEN name ELSE module || '_' || (line % 20) END AS name, kind, module FROM node) SELECT name, arg_max(id, id) AS id, arg_max(kind, id) AS kind, arg_max(module, id) AS module FROM nm WHERE name IS NOT NULL GROUP BY name"))
def terms_by_name(spark: SparkSession, d: str) -> DataFrame:
    n = _named(spark, d).filter("name is not null").select("id", "name", "kind", "module", F.col("id").alias("ord"))
    return terms.by_name(n).select("name", "id", "kind", "module")


_USES = with_views("node", "raw", "edge", body=", nm AS (SELECT id, CASE WHEN kind = 'class' THEN name ELSE module || '_' || (line % 20) END AS name FROM node), us AS (SELECT DISTINCT s.name AS name, t.name AS dep, edge.kind FROM edge JOIN nm s ON src = s.id JOIN nm t ON dst = t.id)")


def _uses(spark, d):
    return terms.uses_by_name(_edges(spark, d), _named(spark, d))


@query(_USES + ", bo AS (SELECT name, dep FROM us UNION SELECT dep, name FROM us) SELECT name, string_agg(dep, ',' ORDER BY dep) AS neighbours FROM bo WHERE name <> dep AND name IS NOT NULL AND dep IS NOT NULL GROUP BY name")
def term_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return terms.neighbours(_uses(spark, d), _named(spark, d).filter("name is not null")).select("name", F.array_join("neighbours", ",").alias("neighbours"))


@query("""WITH s AS (SELECT 'o' || o_orderkey AS name, 'c' || o_custkey AS dep FROM orders), m AS (SELECT 'c' || c_custkey AS name FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT 'c' || c_custkey AS name FROM customer WHERE c_custkey % 5 <> 0), q AS (SELECT 'c' || c_custkey AS name FROM customer WHERE c_custkey % 7 = 0), w AS (SELECT 'c' || c_custkey AS name, c_acctbal AS weight FROM customer WHERE c_custkey % 2 = 0)
SELECT s.name, dep, CASE WHEN dep IN (SELECT name FROM m) THEN 'resolved' WHEN dep NOT IN (SELECT name FROM n) THEN 'unknown' WHEN dep IN (SELECT name FROM q) THEN 'queued' ELSE 'shallow' END AS state, coalesce(w.weight, 0.0) AS priority FROM s LEFT JOIN w ON dep = w.name""")
def unresolved_terms(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), "c_custkey", F.col("c_acctbal").alias("weight"))
    s = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("name"), F.concat(F.lit("c"), "o_custkey").alias("dep"))
    return terms.unresolved(s, c.filter("c_custkey % 3 = 0"), c.filter("c_custkey % 7 = 0"), c.filter("c_custkey % 5 <> 0"), c.filter("c_custkey % 2 = 0"))


@query("""WITH n AS (SELECT r_name || '.' || n_name || '.' || 'C' || (c_custkey % 30) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), p AS (SELECT DISTINCT name, string_split(name, '.') AS p FROM n),
s AS (SELECT DISTINCT name, array_to_string(p[i:], '.') AS suffix FROM p, range(1, 3) t(i)) SELECT suffix, min(name) AS name FROM s GROUP BY suffix HAVING count(*) = 1""")
def suffix_index(spark: SparkSession, d: str) -> DataFrame:
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = table(spark, d, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(".", "r_name", "n_name", F.concat(F.lit("C"), F.col("c_custkey") % 30)).alias("name"))
    return terms.suffixes(n.distinct())


@query("""WITH n AS (SELECT DISTINCT replace(p_type, ' ', '.') AS name FROM part) SELECT DISTINCT array_to_string(string_split(name, '.')[:i], '.') AS prefix FROM n, range(1, 9) t(i) WHERE i <= len(string_split(name, '.'))""")
def prefix_closure(spark: SparkSession, d: str) -> DataFrame:
    return terms.prefixes(table(spark, d, "part").select(F.replace("p_type", F.lit(" "), F.lit(".")).alias("name")).distinct())


@query("SELECT p_type AS item FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY p_type HAVING count(*) = (SELECT count(DISTINCT p_brand) FROM part)")
def shared_by_all(spark: SparkSession, d: str) -> DataFrame:
    return terms.shared_by_all(table(spark, d, "part").select("p_brand", F.col("p_type").alias("item")), "p_brand", "item")


@query("WITH r AS (SELECT p_brand AS module, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name), p_name) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT DISTINCT p_brand, p_name FROM part)) SELECT module, n, string_agg(p_name, ', ' ORDER BY rn) AS label FROM r WHERE rn <= 3 GROUP BY module, n")
def module_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_name").distinct()
    w = Window.partitionBy("p_brand").orderBy(F.length("p_name"), "p_name")
    # a ranking keeps three names of each task's share of a module; none is gathered whole
    few = p.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 3").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("_rn", "p_name"))).alias("s"))
    label = F.array_join(F.transform("s", lambda x: x["p_name"]), ", ")
    return p.groupBy("p_brand").agg(F.count("*").alias("n")).join(few, "p_brand").select(F.col("p_brand").alias("module"), "n", label.alias("label"))


# --- quiz and measurements ------------------------------------------------------

_QUIZ = "SELECT CAST(doc_id AS INT) AS qnum, 't' || (doc_id // 3) AS term, 'q' || doc_id AS question, CAST(doc_id % 4 + 1 AS INT) AS answer FROM labels WHERE doc_id % 10 <> 9"
_SHEET = "SELECT CAST(doc_id AS INT) AS qnum, 't' || (CASE WHEN doc_id % 31 = 0 THEN 7777 ELSE doc_id // 3 END) AS term, 'q' || doc_id AS question, CASE WHEN doc_id % 13 = 0 THEN ' ' WHEN doc_id % 17 = 0 THEN '9' WHEN doc_id % 6 = 0 THEN '5' ELSE CAST(CASE WHEN quality = 1 THEN doc_id % 4 + 1 ELSE (doc_id + 1) % 4 + 1 END AS VARCHAR) END AS user_ans FROM labels WHERE doc_id % 12 <> 11"
_TALLY = f"""WITH q AS ({_QUIZ}), a AS ({_SHEET}), j AS (SELECT coalesce(q.qnum, a.qnum) AS qnum, coalesce(q.term, a.term) AS term, CASE WHEN q.qnum IS NULL THEN 'extra' WHEN a.qnum IS NULL THEN 'missing' WHEN q.term <> a.term THEN 'term' WHEN q.question <> a.question THEN 'question' WHEN trim(user_ans) = '' THEN 'blank' WHEN TRY_CAST(trim(user_ans) AS INT) IS NULL OR TRY_CAST(trim(user_ans) AS INT) NOT BETWEEN 1 AND 5 THEN 'range' END AS complaint, q.answer, TRY_CAST(trim(user_ans) AS INT) AS chosen FROM q FULL JOIN a ON q.qnum = a.qnum),
t AS (SELECT qnum, term, complaint, CASE WHEN complaint IS NULL AND chosen = answer THEN 1 ELSE 0 END AS correct, CASE WHEN complaint IS NULL AND chosen = 5 THEN 1 ELSE 0 END AS dont_know FROM j)"""


def _quiz(spark, d):
    x, k = table(spark, d, "labels"), F.col("doc_id")
    third = F.expr("doc_id div 3")
    q = x.filter(k % 10 != 9).select(k.cast("int").alias("qnum"), F.concat(F.lit("t"), third).alias("term"), F.concat(F.lit("q"), k).alias("question"), (k % 4 + 1).cast("int").alias("answer"))
    ans = F.when(k % 13 == 0, " ").when(k % 17 == 0, "9").when(k % 6 == 0, "5").otherwise(F.when(F.col("quality") == 1, k % 4 + 1).otherwise((k + 1) % 4 + 1).cast("string"))
    a = x.filter(k % 12 != 11).select(k.cast("int").alias("qnum"), F.concat(F.lit("t"), F.when(k % 31 == 0, F.lit(7777)).otherwise(third)).alias("term"), F.concat(F.lit("q"), k).alias("question"), ans.alias("user_ans"))
    return q, a


@query(_TALLY + " SELECT * FROM t")
def quiz_tally(spark: SparkSession, d: str) -> DataFrame:
    return quiz.tally(*_quiz(spark, d))


@query(_TALLY + ", g AS (SELECT term, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(dont_know) AS BIGINT) AS dont_know FROM t WHERE complaint IS NULL GROUP BY term) SELECT term, correct, dont_know, CAST(floor(correct / 3.0 * 100 + 0.5) AS INT) AS rate, CASE WHEN dont_know >= 2 THEN 'unknown' WHEN correct >= 2 THEN 'certain' ELSE 'unknown' END AS mental FROM g")
def quiz_grades(spark: SparkSession, d: str) -> DataFrame:
    return quiz.grade(quiz.tally(*_quiz(spark, d)))


@query(_TALLY + ", g AS (SELECT term, sum(correct) AS correct, sum(dont_know) AS dk FROM t WHERE complaint IS NULL GROUP BY term) SELECT term, CAST(floor(correct / 3.0 * 100 + 0.5) AS INT) AS rate FROM g WHERE dk >= 2 OR correct < 2")
def study_note(spark: SparkSession, d: str) -> DataFrame:
    return quiz.study_note(quiz.grade(quiz.tally(*_quiz(spark, d))))


@query(f"WITH q AS ({_QUIZ}) SELECT count(*) >= 6 AND count(DISTINCT answer) = 1 AS same_position FROM q")
def answer_positions(spark: SparkSession, d: str) -> DataFrame:
    return quiz.position_complaint(_quiz(spark, d)[0])


_STAGE = "SELECT event_id AS ord, CASE WHEN event_type IN ('click', 'view') THEN event_type || '/b' || (user_id % 9) ELSE event_type END AS stage, round(value, 2) AS seconds, event_id % 1000 AS input, user_id % 500 AS output, event_id % 77 AS cache_read, event_id % 13 AS cache_write, round(value / 100, 4) AS cost_usd, user_id % 11 = 0 AS skipped FROM events"


def _stages(spark, d):
    e, k, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    stage = F.when(F.col("event_type").isin("click", "view"), F.concat("event_type", F.lit("/b"), u % 9)).otherwise(F.col("event_type"))
    return e.select(k.alias("ord"), stage.alias("stage"), F.round("value", 2).alias("seconds"), (k % 1000).alias("input"), (u % 500).alias("output"), (k % 77).alias("cache_read"), (k % 13).alias("cache_write"), F.round(F.col("value") / 100, 4).alias("cost_usd"), (u % 11 == 0).alias("skipped"))


@query(f"WITH s AS ({_STAGE}) SELECT split_part(stage, '/', 1) AS stage, round(sum(seconds), 2) AS seconds, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, round(sum(cost_usd), 3) AS cost_usd, count(*) AS rows, min(ord) AS first FROM s GROUP BY 1")
def stage_totals(spark: SparkSession, d: str) -> DataFrame:
    return measure.stage_totals(_stages(spark, d)).withColumns({"seconds": F.round("seconds", 2), "cost_usd": F.round("cost_usd", 3)})


@query(f"WITH s AS ({_STAGE}) SELECT CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, round(sum(cost_usd), 3) AS cost_usd FROM s WHERE NOT skipped")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return measure.usage(_stages(spark, d)).withColumn("cost_usd", F.round("cost_usd", 3))


@query("SELECT coalesce(bool_and(k = 'purchase'), true) AS idle FROM (SELECT arg_max(event_type, event_id) AS k FROM events GROUP BY user_id)")
def progress_idle(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("token"), F.when(F.col("event_type") == "purchase", "end").otherwise("report").alias("kind"), F.col("event_id").alias("ord"))
    return measure.all_ended(e)


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n")


__all__ = ["ORACLES", "QUERIES", "SQL"]
