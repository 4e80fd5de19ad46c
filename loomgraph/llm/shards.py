"""Contiguous byte-balanced shards from global prefix sums.  DataFrame functions only.

Rows are ordered by a hash of their text, so equal texts are neighbours, and
dealt into ranges.  Each range's total is one row, their prefix sums give every
range its offset, and a window inside the range gives each row its place in the
global sum of bytes.  The shard is the equal target that holds the middle of
the row, or of its group: equal texts of up to GROUP_SHARE of a shard go
together, larger ones and hot texts are split where a target cuts them.  So shards are
contiguous in that order and their sizes differ by no more than such groups.

Scale: texts are read once and never shuffled; 40 bytes a row are, three times.
Rows of a hot text (more than one row in HOT_SHARE) are ordered by a number of
the row, so they are dealt over many ranges; those of other texts share one.  There are as many ranges as keep all cores busy, or one
for ROWS rows, so totals and shard starts stay short lists.

Null texts have no bytes, count as 8 and are one group with empty ones; null
doc_ids and repeated rows are rows like any other.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, spill

SHARDS = 24
ROW_BYTES = 8
#: Groups of equal texts up to this share of a shard are never split.
GROUP_SHARE = 0.02
#: Rows of a range at most, and at least where that many ranges aren't needed to keep cores busy.
ROWS, FEW = 1_000_000, 250


def bucket_count(df: DataFrame, rows: int = ROWS) -> int:
    """Enough ranges for four rounds of tasks, none of them tiny, and none larger than so many rows."""
    n, width = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(n // FEW + 1, 4 * width), -(-n // rows))


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", id_col: str = "doc_id", row_bytes: int = ROW_BYTES, group_share: float = GROUP_SHARE) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of docs."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(body) + row_bytes).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(body).alias("h"), F.monotonically_increasing_id().alias("uid"),
    )
    base = spill(base, "shard-sizes")
    # fewer than HOT_SHARE texts are hot; only their rows may be dealt over several ranges
    hot = base.groupBy("h", "crc").agg(F.count("*").alias("n")).filter(F.col("n") > max(HOT_ROWS, base.count() // HOT_SHARE)).select("h", "crc", F.lit(True).alias("hot"))
    base = base.join(F.broadcast(hot), ["h", "crc"], "left").withColumn("salt", F.when(F.col("hot"), F.col("uid")).otherwise(-1)).drop("hot")
    order = ["h", "crc", "salt", "id", "uid"]
    ranged = spill(base.repartitionByRange(bucket_count(base), *order[:3]).withColumn("bucket", F.spark_partition_id()), "shard-ranges")
    # a row for each range: what lies before it, and the whole
    per = ranged.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    all_of, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    table = F.broadcast(spill(per.select("bucket", sums("bytes", before).alias("bytes_before"), sums("n", before).alias("rows_before"), sums("bytes", all_of).alias("bytes_in_all")), "shard-offsets"))
    inside = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("bucket", "h", "crc")
    placed = ranged.withColumn("to", F.sum("size").over(inside)).withColumn("rank", F.count("*").over(inside))
    placed = placed.withColumn("group_to", F.max("to").over(group)).withColumn("group_bytes", F.sum("size").over(group)).join(table, "bucket")
    together = F.col("group_bytes") <= F.floor(F.col("bytes_in_all") * (group_share / shards))
    twice = lambda to, size: (F.col("bytes_before") + F.col(to)) * 2 - F.col(size)  # noqa: E731  twice the middle
    middle = F.when(together, twice("group_to", "group_bytes")).otherwise(twice("to", "size"))
    total = F.col("bytes_in_all").cast("decimal(38,0)") * 2
    placed = placed.select(
        "id", "size", "crc",
        F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / total).cast("int")).alias("shard"),
        (F.col("rows_before") + F.col("rank") - 1).alias("place"),
    )
    placed = spill(placed, "shard-placed")
    starts = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # one row for each shard
    return placed.join(starts, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("place") - F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
