"""Mixing of sources to target weights by pivotal dependent rounding.

Every document of a source is due target / source_size copies.  The whole part
is certain; the fraction is a probability.  Two documents with fractions meet
and mass moves from one to the other, in a random direction and weighted by
their sizes, until one of them is whole: the expected copies of each document
stay what they were and the words that the source takes stay the same in every
step.  Exchange makes the smaller of two documents whole, so long ones (more
than one word in LONG of their source, of which there can't be more than LONG)
are settled first, the longest first, and the others make up for what they take
too much or too little.  So a source misses its target by less than one short
document, unless long ones leave the others no room.

Scale: texts never move; documents meet in groups of (source, bucket) of about
GROUP documents, with as many buckets as the source needs, so a hot source is
dealt over many tasks.  Each group leaves at most one document with a fraction;
these residuals meet again in a tree of groups.  Groups and random numbers
depend on doc_ids and texts alone, so reruns agree however the input is partitioned.

Null texts have size 0; documents of size 0 take no words.  A null source is a
source, after all others.  Equal doc_ids are separate rows; null ones are dealt
by their texts.  Rows equal in id and text share a group.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, as_row, spill

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Documents of a group, and residuals of a group in the tree.
GROUP, FAN_IN = 4000, 256
#: A document of more than one word in LONG of its source is settled before the others.
LONG = 200
EPS = 1e-9
#: Sources at most; beyond them targets by source make no mix, and the plan would outgrow a broadcast.
SOURCES = 100_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Words due to each source: by weight, none above most times its size, the excess reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size = dict(order)
    out: dict = {}
    left, free = share * sum(size.values()), {s for s in size if size[s] > 0}
    out |= {s: 0.0 for s in size if size[s] <= 0}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = most * size[s]
            free.discard(s)
        left -= sum(out[s] for s in full)
    return out


def pivotal(rows: list[list], seed: str) -> None:
    """rows: [size, fraction]; leaves at most one fraction that isn't 0 or 1 and keeps the sum of size * fraction."""
    rng = random.Random(seed)
    hold = None
    for row in rows:
        if not EPS < row[1] < 1 - EPS:
            row[1] = float(round(row[1]))
            continue
        if hold is None:
            hold = row
            continue
        a, b = hold, row
        # up: mass from b to a; down: from a to b; in words
        up = min((1 - a[1]) * a[0], b[1] * b[0])
        down = min(a[1] * a[0], (1 - b[1]) * b[0])
        move = up if rng.random() < down / (up + down) else -down
        a[1] += move / a[0]
        b[1] -= move / b[0]
        whole = [x for x in (a, b) if not EPS < x[1] < 1 - EPS]
        for x in whole:
            x[1] = float(round(x[1]))
        hold = None if len(whole) == 2 else a if whole == [b] or whole and whole[0] is b else b


def _meet(df: DataFrame, keys: list[str], seed: int, level: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tie", "id", "copy"], kind="stable")
        rows = [list(x) for x in zip(pdf["size"].tolist(), pdf["part"].tolist())]
        pivotal(rows, f"{seed}/{level}/{pdf['source'].iloc[0]}/{pdf['bucket'].iloc[0]}")
        return pdf.assign(part=[r[1] for r in rows])

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def settle(rows: list[tuple[int, float]], source_size: int, target: float, most: float, seed: str) -> list[int]:
    """rows: (size, tie) of the long documents of a source.  Copies of each, so that those after it and the short ones can still meet the target.

    A document is due the rate of what is left; its copies are that rate rounded
    by a coin.  Where that leaves too much or too little for the words that
    remain, it takes the nearest number that doesn't.
    """
    rng = random.Random(seed)
    out, due, words = [0] * len(rows), target, source_size
    for k in sorted(range(len(rows)), key=lambda k: (-rows[k][0], rows[k][1])):
        size = rows[k][0]
        words -= size
        rate = due / (words + size)
        low = int(rate + EPS)
        copies = low + (rng.random() < rate - low)
        if not 0 <= due - copies * size <= most * words:
            misses = lambda c: max(0.0, c * size - due, due - c * size - most * words)
            copies = min(range(int(most) + 1), key=lambda c: (misses(c), abs(c - rate)))
        out[k] = copies
        due = min(max(due - copies * size, 0.0), most * words)
    return out


def _settled(rows: DataFrame, most: float, seed: int) -> DataFrame:
    """The long documents with their copies; at most LONG of a source."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tie", "id"], kind="stable")
        first = pdf.iloc[0]
        pairs = list(zip(pdf["size"].tolist(), range(len(pdf))))
        return pdf.assign(copies=settle(pairs, int(first["source_size"]), float(first["target"]), most, f"{seed}/long/{first['source']}"))

    return rows.groupBy("source").applyInPandas(run, T.StructType([*rows.schema.fields, T.StructField("copies", T.IntegerType())]))


def _broadcast(spark, plan: list[tuple], fields: str) -> DataFrame:
    """One short row for each source."""
    return F.broadcast(spark.createDataFrame(plan, fields))


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken), one row for each row of docs.

    The sources are listed on the driver: their number is that of the targets
    asked for, not of the documents.  More than SOURCES fail.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text), F.lit(seed)).alias("tie"),
    )
    base = spill(base, "mix-sizes")
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(per) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    due = targets([(r["source"], r["source_size"]) for r in per], weights, share, most)
    plan = [(r["source"], r["source_size"], float(due[r["source"]]), max(1, -(-r["n"] // GROUP))) for r in per]
    named = _broadcast(spark, plan, "s string, source_size bigint, target double, buckets int")
    rows = base.join(named, base["source"].eqNullSafe(named["s"])).drop("s")
    is_long = F.col("size") * LONG > F.col("source_size")
    long = spill(_settled(rows.filter(is_long), most, seed), "mix-long")
    used = {r["source"]: (r["words"], r["taken"]) for r in long.groupBy("source").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()}
    rates = []
    for name, size, target, _ in plan:
        words, taken = used.get(name, (0, 0))
        rates.append((name, min(max((target - taken) / (size - words), 0.0), most) if size > words else 0.0))
    rated = _broadcast(spark, rates, "s string, rate double")
    rows = rows.filter(~is_long)
    rate = F.col("rate")
    due_rows = rows.join(rated, rows["source"].eqNullSafe(rated["s"])).select(
        "id", "source", "size", "source_size", "target",
        F.floor(rate + EPS).cast("int").alias("whole"),
        F.when(F.col("size") > 0, F.greatest(rate - F.floor(rate + EPS), F.lit(0.0))).otherwise(0.0).alias("part"),
        F.pmod(F.col("tie"), F.col("buckets")).cast("int").alias("bucket"),
        F.xxhash64("tie", F.lit(seed + 1)).alias("tie"),
        F.lit(0).alias("copy"),
    )
    now = spill(_meet(due_rows, ["source", "bucket"], seed, 0), "mix-level")
    is_open = (F.col("part") > EPS) & (F.col("part") < 1 - EPS)
    done = [now.filter(~is_open)]
    left, widest, level = now.filter(is_open), max((p[3] for p in plan), default=1), 0
    while widest > 1:
        level += 1
        widest = -(-widest // FAN_IN)
        up = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("int"))
        now = spill(_meet(up, ["source", "bucket"], seed, level), "mix-level")
        done.append(now.filter(~is_open))
        left = now.filter(is_open)
    # what is left: one short document of a source at most
    last = left.withColumn("part", F.when(F.pmod(F.xxhash64("tie", F.lit(seed + 2)), F.lit(1 << 30)) / float(1 << 30) < F.col("part"), 1.0).otherwise(0.0))
    short = last
    for d in done:
        short = short.unionByName(d)
    out = short.select("id", "source", "size", "source_size", "target", (F.col("whole") + F.col("part").cast("int")).cast("int").alias("copies")).unionByName(long.select("id", "source", "size", "source_size", "target", "copies"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """docs, each row as many times as the mix takes it, with the columns of docs.

    A row is known by its id, text, source and a hash of its other columns, all
    carried beside it, so rows that differ anywhere are drawn apart; rows equal
    in every column share the sum of their copies.
    """
    at = lambda c: F.col("row").getField(c)
    known = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.hex(F.xxhash64(c)))
    rest = [at(c).alias(c) for c in docs.columns if c not in (id_col, text, source)]
    others = [F.hex(F.xxhash64(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})))] if rest else []
    keyed = docs.select(as_row(docs).alias("row"))
    keyed = keyed.select("row", F.concat_ws("|", F.coalesce(at(id_col).cast("string"), F.lit("null")), known(at(text)), known(at(source).cast("string")), *others).alias("key"))
    few = keyed.select(F.col("key").alias("id"), at(text).alias("text"), at(source).alias("source"))
    decided = spill(mix(few, "text", "id", "source", **how).groupBy("id").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows")), "mix-copies")
    if decided.filter("rows > 1").take(1):
        keyed = keyed.dropDuplicates(["key"])
    joined = keyed.join(decided.filter("copies > 0").select(F.col("id").alias("key"), "copies"), "key")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
