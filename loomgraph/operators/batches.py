"""Plans of reading: layers of symbols in batches, or one batch a file in order of weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import graph, packing
from .ordered import numbered


def _own(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind <> 'external'")


def needs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depends_on): the distinct own nodes that an own node depends on, sorted, without itself."""
    ids = _own(nodes).select("id")
    pairs = edges.select(F.col("src").alias("id"), F.col("dst").alias("dep")).filter("id <> dep").distinct()
    kept = pairs.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "dep"), "dep", "left_semi")
    return kept.groupBy("id").agg(F.array_sort(F.collect_list("dep")).alias("depends_on"))


def layered(nodes: DataFrame, edges: DataFrame, target: int = 8, only_files: DataFrame | None = None) -> DataFrame:
    """(level, batch_id, file, id, name, kind, line, in_cycle, depends_on): a row for each symbol of the plan.

    A symbol's level is one above the highest it depends on, cycles as one, over
    the whole graph; only then are other files left out.  Batches of a level
    hold whole files, by name, up to the target.
    """
    own = _own(nodes)
    levels = cut(graph.layers(own, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(own.select(F.col("id").alias("a")), "a", "left_semi").join(own.select(F.col("id").alias("b")), "b", "left_semi")), "levels")
    rows = own.select("id", "name", "kind", F.coalesce("file", F.lit("")).alias("file"), "line").join(levels, "id")
    if only_files is not None:
        rows = rows.join(only_files.select("file").distinct(), "file", "left_semi")
    packed = packing.pack(rows.select("level", "file", F.col("id").alias("symbol")), target)
    named = rows.join(packed.select("level", "file", "batch"), ["level", "file"]).join(needs(nodes, edges), "id", "left")
    return named.select("level", F.format_string("L%d-B%02d", "level", "batch").alias("batch_id"), F.nullif("file", F.lit("")).alias("file"), "id", "name", "kind", "line", "in_cycle", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def by_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As layered, a batch for each file in order of weight, on one level; adds weight."""
    own = _own(nodes).filter("coalesce(file, '') <> ''")
    weights = numbered(graph.file_weights(nodes, edges), [F.desc("weight"), F.asc("file")], "place").select("file", "weight", (F.col("place") - 1).alias("place"))
    cycles = graph.layers(_own(nodes), edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select("id", "in_cycle")
    rows = own.select("id", "name", "kind", "file", "line").join(weights, "file").join(cycles, "id").join(needs(nodes, edges), "id", "left")
    return rows.select(F.lit(0).alias("level"), F.format_string("F%02d", "place").alias("batch_id"), "file", "id", "name", "kind", "line", "in_cycle", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), "weight")


def batch_ids(plan: DataFrame, others: bool = True) -> DataFrame:
    """(batch_id): the plan's batches, and NONNODE for what is no symbol, which comes last."""
    ids = plan.select("batch_id").distinct()
    return ids.unionByName(ids.sparkSession.range(1).select(F.lit("NONNODE").alias("batch_id"))) if others else ids


def names(plan: DataFrame) -> DataFrame:
    """(id, name) of all symbols of a plan."""
    return plan.select("id", F.coalesce("name", F.lit("")).alias("name")).distinct()


def files(plan: DataFrame) -> DataFrame:
    """(file): the distinct files of all batches."""
    return plan.filter("file is not null").select("file").distinct()


def summary(plan: DataFrame) -> DataFrame:
    """(level, symbols, files, batches, cyclic): a row for each level, and one of the whole with no level."""
    level = plan.groupBy("level").agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"), F.countDistinct("batch_id").alias("batches"), F.count(F.when(F.col("in_cycle"), 1)).alias("cyclic"))
    whole = plan.agg(F.lit(None).cast("int").alias("level"), F.count("*").alias("symbols"), F.countDistinct("file").alias("files"), F.countDistinct("batch_id").alias("batches"), F.count(F.when(F.col("in_cycle"), 1)).alias("cyclic"))
    return level.unionByName(whole)


def summary_lines(told: DataFrame) -> DataFrame:
    """(line): a plan in short, the whole first."""
    text = F.when(F.col("level").isNull(), F.format_string("%d symbols, %d files, %d batches, %d in cycles", "symbols", "files", "batches", "cyclic")).otherwise(F.format_string("level %d: %d symbols, %d files, %d batches", "level", "symbols", "files", "batches"))
    return told.orderBy(F.col("level").asc_nulls_first()).select(text.alias("line"))
