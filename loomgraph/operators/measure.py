"""Measurements of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = ("input", "output", "cache_read", "cache_write")


def stage_totals(rows: DataFrame) -> DataFrame:
    """(stage, seconds, tokens, cost_usd, rows, first): rows `stage/part` fold to their stage, in order of first sight."""
    name = F.substring_index("stage", "/", 1)
    return rows.groupBy(name.alias("stage")).agg(F.sum("seconds").alias("seconds"), *[F.sum(c).alias(c) for c in TOKENS], F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("rows"), F.min("ord").alias("first"))


def usage(rows: DataFrame) -> DataFrame:
    """One row of totals over all rows that ran."""
    return rows.filter("not coalesce(skipped, false)").agg(*[F.sum(c).alias(c) for c in TOKENS], F.sum("cost_usd").alias("cost_usd"))


def all_ended(progress: DataFrame, key: str = "token", kind: str = "kind") -> DataFrame:
    """One row: whether every token's last event is `end`; true where there are none."""
    last = progress.groupBy(key).agg(F.max_by(kind, "ord").alias("last"))
    return last.agg(F.coalesce(F.bool_and(F.col("last") == "end"), F.lit(True)).alias("idle"))


def estimate(sessions: int, low: float, high: float) -> tuple[float, float]:
    """Least and most cost of so many sessions, halves rounded to even."""
    return round(sessions * low, 2), round(sessions * high, 2)
