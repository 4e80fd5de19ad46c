"""Batches of symbols: files stay whole, in order, up to a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs


def pack(members: DataFrame, target: int = 8, group: str = "level", file: str = "file", symbol: str = "symbol") -> DataFrame:
    """(group, file, n, batch): next-fit in file order; a file larger than the target stands alone.

    Only counts of files are packed (one row a file), in ranges, so a group of
    any number of files is packed on many tasks.
    """
    return runs.next_fit(members.groupBy(group, file).agg(F.count(symbol).alias("n")), target, group, file)


def sessions(batches: DataFrame, group: str = "level") -> DataFrame:
    """(group, batches, symbols): the plan in short; a group has one session at least."""
    return batches.groupBy(group).agg(F.greatest(F.countDistinct("batch"), F.lit(1)).alias("batches"), F.sum("n").alias("symbols"))


def merge_shards(shards: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Records of shards (shard, pos, key, file, rec) folded in shard order over base.

    A later record of a key replaces one from its own file; one from another
    file takes the name `stem of its file`.key, and so does the record it met;
    the bare key is then free for the next.  Of records that end at one name
    the last wins.
    """
    rows = shards.select("key", F.struct("shard", F.col("pos").cast("bigint").alias("pos")).alias("at"), "file", "rec")
    if base is not None:
        rows = rows.unionByName(base.select("key", F.struct(F.lit("").alias("shard"), F.lit(-1).cast("bigint").alias("pos")).alias("at"), "file", "rec"))
    ends = runs.fold_shards(rows)
    stem = F.nullif(F.regexp_replace(F.substring_index("file", "/", -1), "[.][^.]*$", ""), F.lit(""))
    named = ends.select(F.when(F.col("bare"), F.col("key")).otherwise(F.concat_ws(".", stem, "key")).alias("key"), F.struct("at", F.when(F.col("bare"), 2).otherwise(F.col("n")).alias("n")).alias("at"), "file", "rec")
    return named.groupBy("key").agg(F.max_by(F.struct("file", "rec"), "at").alias("r")).select("key", "r.file", "r.rec")


def second_pass(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Records of the second pass replace those that exist; others are ignored."""
    return base.join(patch.select("key", F.col("rec").alias("_new")), "key", "left").select("key", "file", F.coalesce("_new", "rec").alias("rec"))
