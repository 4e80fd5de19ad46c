"""Operators on ordered lines: context, comment blocks, fences, sections, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def explode_lines(docs: DataFrame, text: str = "text", key: str = "doc") -> DataFrame:
    """(key, line, text): lines from 1, as parts between newlines."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "text")).select(key, (F.col("line") + 1).alias("line"), "text")


def with_context(lines: DataFrame, key: str = "doc") -> DataFrame:
    """Adds context: the line before, the line and the line after, where they exist."""
    w = Window.partitionBy(key).orderBy("line")
    return lines.withColumn("context", F.concat_ws("\n", F.lag("text").over(w), F.col("text"), F.lead("text").over(w)))


def doc_above(lines: DataFrame, declaration: Column, comment: Column, skip: Column, reach: int = 14, key: str = "doc", says=F.trim) -> DataFrame:
    """(key, line, doc): for each declaration the comment lines right above it, at most `reach` lines up.

    Lines to skip (blank, attributes) are passed over; the first other line ends the walk.
    """
    w = Window.partitionBy(key).orderBy("line")
    marked = lines.select(key, "line", "text", declaration.alias("is_decl"), comment.alias("is_comment"), (~(comment | skip)).alias("stops"))
    before = w.rowsBetween(-reach, -1)
    stop = F.max(F.when(F.col("stops"), F.col("line"))).over(before)
    held = F.collect_list(F.when(F.col("is_comment"), F.struct("line", "text"))).over(before)
    rows = marked.withColumn("_stop", F.coalesce(stop, F.lit(-1))).withColumn("_held", held).filter("is_decl")
    told = F.transform(F.filter("_held", lambda x: x["line"] > F.col("_stop")), lambda x: says(x["text"]))
    return rows.select(key, "line", F.array_join(F.filter(told, lambda t: t != ""), " ").alias("doc"))


def fence_blocks(lines: DataFrame, fence: str = "^```", key: str = "doc") -> DataFrame:
    """Adds block: the number of the fenced block a line stands in, null outside; fences themselves stand outside."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_fence = F.regexp("text", F.lit(fence))
    opened = lines.withColumn("_f", F.sum(F.when(is_fence, 1).otherwise(0)).over(w))
    return opened.withColumn("block", F.when(~is_fence & (F.col("_f") % 2 == 1), (F.col("_f") + 1) / 2).cast("int")).drop("_f")


def sections(lines: DataFrame, marker: str = r"^## (.+)$", key: str = "doc") -> DataFrame:
    """(key, section, first_line, n_lines, body): text under each marker; what precedes the first has a null section."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.nullif(F.regexp_extract("text", marker, 1), F.lit(""))
    numbered = lines.withColumn("_name", name).withColumn("_no", F.sum(F.when(F.col("_name").isNotNull(), 1).otherwise(0)).over(w))
    return numbered.groupBy(key, "_no").agg(
        F.max("_name").alias("section"), F.min("line").alias("first_line"), F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_name").isNull(), F.struct("line", "text")))), lambda x: x["text"]), "\n").alias("body"),
    ).drop("_no")


def _ranges(rows: DataFrame, order: list) -> DataFrame:
    """rows dealt in ranges of order, written with the number of their range as _part."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(width, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _before():
    """Over the ranges before a range, one row for each."""
    return Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Adds name: the place of each row by order, from 1, over all rows.  No task holds more than a range of them."""
    held = _ranges(rows, order)
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.withColumn("_rn", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_rn") + F.col("_n")).drop("_part", "_rn", "_n")


def carry_down(rows: DataFrame, value: str, name: str, order: str = "ord", key: str | None = None) -> DataFrame:
    """Adds name: the last non-null value at or above each row, within key where one is given."""
    upto = lambda w: w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if key:
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(upto(Window.partitionBy(key))))
    held = _ranges(rows, [order])
    lasts = held.groupBy("_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))  # a row for each range
    above = lasts.select("_part", F.last("_last", ignorenulls=True).over(_before()).alias("_above"))
    inside = F.last(value, ignorenulls=True).over(upto(Window.partitionBy("_part")))
    return held.withColumn("_in", inside).join(F.broadcast(above), "_part").withColumn(name, F.coalesce("_in", "_above")).drop("_part", "_in", "_above")


def counted(rows: DataFrame, value: str, order: str = "ord") -> DataFrame:
    """(value, n, first): how often each value comes, the most frequent first and of equal ones the one seen first."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")


def ranked(rows: DataFrame, value: str, order: str = "ord", name: str = "number") -> DataFrame:
    """rows numbered from 1, the greatest value first, equal ones as they came."""
    return numbered(rows, [F.desc(value), F.asc(order)], name)


def hotspots(log: DataFrame, key: str = "repo") -> DataFrame:
    """(key, path, commits, added, deleted) of change-log lines (key, ord, text): a hash line opens a commit, the rest are added, deleted, path.

    A path counts once in a commit however often it is listed; `-` counts as 0.
    """
    from ..functions.text import rename_target

    parts = log.withColumn("hash", F.nullif(F.regexp_extract("text", r"^([0-9a-f]{7,40})$", 1), F.lit("")))
    carried = carry_down(parts, "hash", "commit", "ord", key).filter(F.col("hash").isNull() & F.regexp("text", F.lit(r"^(\d+|-)\t(\d+|-)\t.+$")))
    number = lambda k: F.coalesce(F.regexp_extract("text", r"^(\d+|-)\t(\d+|-)\t(.+)$", k).try_cast("bigint"), F.lit(0))
    rows = carried.select(key, "commit", rename_target(F.regexp_extract("text", r"^(\d+|-)\t(\d+|-)\t(.+)$", 3)).alias("path"), number(1).alias("added"), number(2).alias("deleted"))
    return rows.groupBy(key, "path").agg(F.countDistinct("commit").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def diagram_blocks(lines: DataFrame, drawn: DataFrame, reach: int = 3, key: str = "doc") -> DataFrame:
    """(key, number, first, last, mark, state): fenced diagrams of (key, line, text), and what becomes of each.

    A block whose mark stands at most `reach` kept lines above it is replaced by
    the drawing of that name where drawn (name) has it; else it is to be rendered.
    """
    w = Window.partitionBy(key).orderBy("line")
    opens, shuts = F.regexp("text", F.lit(r"^\s*```mermaid\b")), F.regexp("text", F.lit(r"^\s*```\s*$"))
    told = lines.withColumns({"_open": opens, "_shut": shuts})
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = told.withColumn("_block", F.sum(F.when(F.col("_open"), 1).otherwise(0)).over(upto))
    ends = told.filter("_shut").groupBy(key, "_block").agg(F.min("line").alias("last"))
    mark = F.nullif(F.regexp_extract("text", r"graphviz:\s*([\w./-]+)", 1), F.lit(""))
    told = told.withColumn("_mark", F.last(mark, ignorenulls=True).over(w.rowsBetween(-reach, -1)))
    heads = told.filter("_open").select(key, "_block", F.col("line").alias("first"), F.col("_mark").alias("mark"))
    have = drawn.select(F.col("name").alias("mark"), F.lit(True).alias("_have")).distinct()
    rows = heads.join(ends, [key, "_block"], "left").join(have, "mark", "left")
    return rows.select(key, F.col("_block").cast("int").alias("number"), "first", "last", "mark", F.when(F.col("_have"), "replaced").otherwise("to render").alias("state"))


def flatten(nested: DataFrame, outer: str, inner: str, key: str) -> DataFrame:
    """Two levels of arrays as rows with a running number over both, from 1, within key."""
    w = Window.partitionBy(key).orderBy("outer_pos", "inner_pos")
    rows = nested.select(key, F.posexplode(outer).alias("outer_pos", "o")).select(key, "outer_pos", F.posexplode(F.col(f"o.{inner}")).alias("inner_pos", "item"))
    return rows.withColumn("number", F.row_number().over(w))


def dense_ids(rows: DataFrame, prefix: str, order: list[str], key: str | None = None) -> DataFrame:
    """Adds id: prefix and place by order, from 1."""
    if key is None:
        return numbered(rows, order, "_place").withColumn("id", F.concat(F.lit(prefix), "_place")).drop("_place")
    return rows.withColumn("id", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(key).orderBy(*order))))
