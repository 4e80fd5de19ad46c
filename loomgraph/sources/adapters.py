"""The driver's tables seen as a code graph and its records.

Each adapter has the same text in SQL (SQL dict) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXTERNAL
from ..session import table

#: All columns of lineitem, in an order that makes rows distinct: what "first" means for raw edges.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

SQL = {
    "node": """
        SELECT 'S' || s_suppkey AS id, s_name AS name, 'class' AS kind, n_name AS module, r_name || '/' || n_name AS file, CAST(s_suppkey % 500 + 1 AS INT) AS line
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'P' || p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'function' END, p_brand, p_brand || '/' || p_type, CAST(p_partkey % 300 + 1 AS INT) FROM part
        UNION ALL SELECT 'R' || r_regionkey, r_name, 'external', '__external__', NULL, NULL FROM region""",
    "raw": """
        SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst,
          CASE l_returnflag WHEN 'A' THEN 'composition' WHEN 'R' THEN 'aggregation' ELSE 'dependency' END AS kind, l_linestatus AS label, CAST(l_linenumber AS INT) AS line,
          row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord
        FROM lineitem
        UNION ALL SELECT 'S' || s_suppkey, 'R' || n_regionkey, 'dependency', NULL, NULL, -s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "edge": """
        SELECT src, dst, kind, label, line, occurrences FROM (
          SELECT src, dst, kind, label, line, count(*) OVER (PARTITION BY src, dst, kind) AS occurrences, row_number() OVER (PARTITION BY src, dst, kind ORDER BY ord) AS rn FROM raw) WHERE rn = 1""",
    "cyc": """
        SELECT DISTINCT a, b FROM (
          SELECT k AS a, k // 2 AS b FROM cyc_n WHERE k >= 1
          UNION ALL SELECT k, CASE WHEN k % 5 = 0 THEN k + 1 ELSE k - 1 END FROM cyc_n WHERE k >= 1 AND k < n - 1
          UNION ALL SELECT k, least(n - 1, 2 * k) FROM cyc_n WHERE k % 9 = 4) WHERE a <> b""",
    "cyc_n": "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier",
}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, kind, module, file, line): suppliers, parts and, as externals, regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])  # fixed tables: 25 and 5 rows
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    first = supplier.select(
        F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("class").alias("kind"), F.col("n_name").alias("module"),
        F.concat("r_name", F.lit("/"), "n_name").alias("file"), (F.col("s_suppkey") % 500 + 1).cast("int").alias("line"),
    )
    second = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "class").otherwise("function").alias("kind"),
        F.col("p_brand").alias("module"), F.concat("p_brand", F.lit("/"), "p_type").alias("file"), (F.col("p_partkey") % 300 + 1).cast("int").alias("line"),
    )
    third = region.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("external").alias("kind"), F.lit(EXTERNAL).alias("module"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    return first.unionByName(second).unionByName(third)


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind, label, line, ord): one edge for each lineitem and one from each supplier to its region.

    ord is a struct: rows are ordered by all their columns, so no global numbering is needed.
    """
    item = table(spark, sf_dir, "lineitem")
    order = F.struct(*LINE_ORDER)
    kind = F.when(F.col("l_returnflag") == "A", "composition").when(F.col("l_returnflag") == "R", "aggregation").otherwise("dependency")
    first = item.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), kind.alias("kind"), F.col("l_linestatus").alias("label"), F.col("l_linenumber").cast("int").alias("line"), order.alias("ord"))
    nation = F.broadcast(table(spark, sf_dir, "nation"))  # a fixed table of 25 rows
    second = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("S"), "s_suppkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst"), F.lit("dependency").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("line"),
        F.lit(None).cast(first.schema["ord"].dataType).alias("ord"),
    )
    return first.unionByName(second)


def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): a directed graph with cycles on the dense supplier keys, for the iterative operators."""
    supplier = table(spark, sf_dir, "supplier")
    n = supplier.count()
    k = F.col("k")
    keys = spark.range(n).select(F.col("id").alias("k"))
    half = keys.filter(k >= 1).select(k.alias("a"), F.expr("k div 2").alias("b"))
    step = keys.filter((k >= 1) & (k < n - 1)).select(k.alias("a"), F.when(k % 5 == 0, k + 1).otherwise(k - 1).alias("b"))
    jump = keys.filter(k % 9 == 4).select(k.alias("a"), F.least(F.lit(n - 1).cast("bigint"), 2 * k).alias("b"))
    return half.unionByName(step).unionByName(jump).filter("a <> b").distinct()


def with_views(*names: str, body: str, recursive: bool = False) -> str:
    """Oracle SQL: the adapters named, in order, before body."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body
