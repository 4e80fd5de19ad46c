"""Structured Streaming forms: windows over events, quiet periods, and snapshots that advance after success."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the events' Parquet files in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; rows later than `late` are dropped by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of events of a user with no pause of `gap`: its quiet periods end them."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def advance(changes: DataFrame, handle: Callable[[DataFrame, int], None], commit: Callable[[DataFrame, int], None], checkpoint: str):
    """Handles each batch of changes and commits its snapshot only after it succeeded: at least once."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            handle(df, number)
            commit(df, number)
        finally:
            df.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completions(done: DataFrame, checked: Callable[[DataFrame], DataFrame], queued: Callable[[DataFrame, int], None], folder: str, checkpoint: str):
    """Follows a stream of finished sessions: each batch is checked, good records and faults are kept apart, and what became ready is queued.

    done is a stream of shard records (batch, key, file, rec, needs array).
    checked gives (key, fault) of a batch's faulty records.  Good records are
    written below folder/good by batch number, faulty ones below folder/bad with
    their fault, and what is still waited for below folder/waiting, so a batch
    that runs again replaces itself.  queued gets the keys that a batch made
    ready.  Of earlier batches only the pairs still waited for and the column of
    keys are read, no record.  folder and checkpoint begin and end together.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        held = df.persist()
        try:
            faults = checked(held).select("key", "fault")
            held.join(faults, "key", "left_anti").write.mode("overwrite").parquet(f"{folder}/good/batch={number}")
            held.join(faults, "key").write.mode("overwrite").parquet(f"{folder}/bad/batch={number}")
            fresh = spark.read.schema(held.schema).parquet(f"{folder}/good/batch={number}")
            # batches are numbered without gaps from 0 on; one that runs again must not see what it or a later one left
            keys = spark.read.schema("key string").parquet(*[f"{folder}/good/batch={k}" for k in range(number + 1)])
            waiting = spark.read.schema(WAITING).parquet(f"{folder}/waiting/batch={number - 1}") if number else spark.createDataFrame([], WAITING)
            asked, lacking = ready(fresh, waiting, keys)
            lacking.write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")
            still = spark.read.schema(WAITING).parquet(f"{folder}/waiting/batch={number}")
            queued(asked.join(still, "key", "left_anti"), number)
        finally:
            held.unpersist()

    return done.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What is waited for: a record's key and one of its needs that isn't merged yet.
WAITING = "key string, need string"


def ready(fresh: DataFrame, waiting: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key) of records that wait or are fresh and have needs, and (key, need): what of it is still lacking; the rest is ready.

    fresh (key, needs), waiting (key, need) before them, keys (key) of all that
    is merged, fresh ones too.  A pair that waited can only be met by a fresh
    key, so only fresh needs are looked for among all keys.  A record that was
    ready before isn't so again unless it comes again.
    """
    new = fresh.select("key", F.explode("needs").alias("need")).distinct()
    left = waiting.join(fresh.select(F.col("key").alias("need")), "need", "left_anti").select("key", "need")
    lacking = left.unionByName(new.join(keys.select(F.col("key").alias("need")), "need", "left_anti").select("key", "need")).distinct()
    return waiting.select("key").unionByName(new.select("key")).distinct(), lacking


def change_set(old: DataFrame | None, new: DataFrame, radius: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """verdicts of a scan against the last snapshot, and the files to read again; None for all, where there is no snapshot.

    radius spreads the changed files along the graph, where there is one.
    """
    from ..operators.changes import change_targets, verdicts

    if old is None:
        return new.select("path", F.lit("reread").alias("verdict")), None
    told = verdicts(old, new)
    seeds = change_targets(told)
    return told, radius(seeds) if radius is not None else seeds


def declaration_hashes(files: DataFrame, decls: DataFrame, seen: float = 0.0) -> DataFrame:
    """A snapshot of files (path, mtime, size, content): hashes of bytes, and of the sorted kinds and names declared; null where nothing is.

    Places and comments don't count, so code that only moves keeps its second hash.
    """
    names = decls.groupBy("path").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("kind", "name")))), 256).alias("decl_hash"))
    told = files.select("path", "mtime", "size", F.lit(seen).alias("seen"), F.sha2("content", 256).alias("file_hash"))
    return told.join(names, "path", "left").select("path", "mtime", "size", "seen", "file_hash", "decl_hash")


def layer_rows(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a layer's sessions (label, ok, ...) in order of label, and one row (ok): all of them must be."""
    return results.orderBy("label"), results.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))
