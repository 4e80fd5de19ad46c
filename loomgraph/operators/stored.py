"""Rows stored by a key once, for loops that join them again and again; keys of very many rows aside."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_dir

#: A key is hot beyond this many rows, or beyond one row in HOT_SHARE.
HOT_ROWS, HOT_SHARE = 64, 500


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined to the one row that right has for a key, hot keys of left aside.

    rows is the number of rows of left, which is read twice.  A hot key has more
    than one in HOT_SHARE of them, so there are fewer than HOT_SHARE hot keys:
    their rows of right are broadcast, and no task gets all rows of a hot key.
    """
    hot = hot_keys(left, key, rows)
    hot_right = right.join(F.broadcast(hot), key, "left_semi").withColumn("_hot", F.lit(True))
    own = [F.col(c) for c in left.columns]
    added = [c for c in right.columns if c != key]
    told = left.join(F.broadcast(hot_right), key, "left")
    found = told.filter("_hot").select(*own, *added)
    rest = told.filter("_hot is null").select(*own).join(right, key, how).select(*own, *added)
    return found.unionByName(rest)


def hot_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(key): those with more than one row in HOT_SHARE; fewer than HOT_SHARE."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(HOT_ROWS, rows // HOT_SHARE)).select(key)


def buckets_of(df: DataFrame) -> int:
    """As many buckets as a shuffle has partitions, so that a shuffle by the key meets them without another."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, label: str = "stored") -> DataFrame:
    """df written below the shared folder in buckets of the key and read back: joins and aggregates by the key move nothing.

    A bucketed table has a name in the session's catalog; release() takes it out again, its files stay.
    """
    spark, n = df.sparkSession, buckets_of(df)
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out._stored_as = name
    return out


def release(*stored: DataFrame) -> None:
    """Takes names of bucketed tables out of the catalog.  DataFrames made of them no longer run."""
    for df in stored:
        if (name := getattr(df, "_stored_as", None)) is not None:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS `{name}`")


class Links:
    """Rows stored by a key, to be joined with one row for each key in every step of a loop.

    Those of hot keys lie aside as they come and meet their few rows by
    broadcast; the others lie in buckets, so a join with rows in equal buckets
    shuffles neither side.
    """

    def __init__(self, rows: DataFrame, key: str, label: str = "links"):
        rows = cut(rows, label)
        self.key, self.count, self.columns = key, rows.count(), rows.columns
        self.hot_keys = cut(hot_keys(rows, key, self.count), f"{label}-hot")
        self.any_hot = bool(self.hot_keys.take(1))
        hot = F.broadcast(self.hot_keys)  # fewer than HOT_SHARE
        self.rest = bucketed(rows.join(hot, key, "left_anti").select(self.columns) if self.any_hot else rows, key, label)
        self.hot = cut(rows.join(hot, key, "left_semi").select(self.columns), f"{label}-aside") if self.any_hot else None

    def meet(self, state: DataFrame) -> DataFrame:
        """Rows with the columns that state has for their key; rows whose key it lacks go."""
        out = self.rest.join(state, self.key)
        if not self.any_hot:
            return out
        few = state.join(F.broadcast(self.hot_keys), self.key, "left_semi")
        return out.unionByName(self.hot.join(F.broadcast(few), self.key).select(out.columns))

    def release(self) -> None:
        release(self.rest)
