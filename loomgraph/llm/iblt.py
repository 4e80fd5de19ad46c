"""Document fingerprints as invertible Bloom lookup sketches.  DataFrame functions only.

A text is the multiset of its paragraphs: lines, cut after sentences whose last
letter is one of MARKS.  What is written decides where a cut falls, so an
insertion changes the paragraphs around it and none further on; only runs of RUN
sentences or BODY characters without a mark are cut by length.  The digest of a
paragraph and its occurrence number is a key.  A sketch has three sub-tables;
each key is in one cell of each, and a cell holds the count, the XOR of keys and
the XOR of their checks.  Sketches of two versions subtract cell by cell, keys
of both vanish, and peeling takes out cells of a single key until nothing is
left: the digests that differ.  If something is left, the pair is sketched anew,
larger, until it can be peeled.

A sub-table has as many cells as the two versions have keys, in powers of two,
so few pairs need a second try.  The fingerprint is the sketch of a text at the
width that fits a version of equal length (up to WIDEST), its cells in base64;
fingerprints of equal width subtract and peel as they are.  Likeness of two
fingerprints is the Jaccard index of the paragraph multisets, from the digests
that peeling recovers.

Scale: each text is shuffled once, to bring it beside the next document; ranges
of doc_id make the neighbours, and a copy of each range's first row closes the
range before, so no task sees more than its range.  A doc_id of very many rows,
or null, is dealt over several ranges by its texts' hash.  After that only keys
move (8 bytes a paragraph), grouped by row and cell on one partitioning for all
rounds of peeling.

Null texts are empty: no paragraphs, no cells; two empty texts have likeness 1.
Null doc_ids come first.  Equal doc_ids are ordered by a hash of the text; rows
equal in both stay in one range.  A single row is its own next.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spill
from .shards import bucket_count

MARKS, RUN, BODY = "ad", 12, 400
#: Least and greatest cells of a sub-table; the greatest holds for fingerprints only.
NARROWEST, WIDEST = 8, 1024
#: Sweeps over the three sub-tables before a pair counts as failed.
SWEEPS = 4
#: Texts of a range at most: a task sorts one range at a time.
RANGE_ROWS = 50_000
#: Partitions of the peeling to one of a shuffle: a row of keys grows into many cells.
FINER = 4
_SENTENCES = rf"[^\n.!?]{{1,{BODY}}}+"
PARAGRAPH = rf"(?:{_SENTENCES}(?<![{MARKS}])[.!?]++){{1,{RUN - 1}}}+(?:{_SENTENCES}[.!?]*+)?|{_SENTENCES}[.!?]*+|[.!?]++"

#: SQL fragments; k is a key.
_CHECK = "xxhash64({k}, 7)"


def _index(key: str, table: int, width: str, salt: int) -> str:
    """The cell of a key in a sub-table."""
    return f"pmod(xxhash64({key}, {11 + 3 * salt + table}), {width})"


def _power(least: str) -> str:
    """The power of two that is no less."""
    return f"shiftleft(1L, length(bin(greatest({NARROWEST}L, cast({least} as bigint)) - 1L)))"


def keys(text: F.Column) -> F.Column:
    """Sorted keys of a text: digests of its paragraphs with their occurrence numbers."""
    digests = F.sort_array(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))
    nth = lambda s, d, i: F.when((i == 0) | (s[i - 1] != d), F.lit(1).cast("bigint")).otherwise(i.cast("bigint") + 2 - F.array_position(s, d))
    # the lambda binds the sorted digests, which would else be made anew for each of them
    return F.transform(F.array(digests), lambda s: F.transform(s, lambda d, i: F.xxhash64(d, nth(s, d, i))))[0]


def fingerprints(texts: DataFrame) -> DataFrame:
    """(rid, side0, side1): the fingerprints of texts (rid, a, b), whose keys a and b are.

    The width of a sub-table, then number, count, key and half the check of each
    cell that holds any.  Cells are summed as rows, on the partitioning of rid.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("k")) for k, c in enumerate("ab")])).alias("x")
    rows = texts.select("rid", sides).select("rid", "x.side", F.explode_outer("x.k").alias("k"), F.expr(f"least({WIDEST}L, {_power('2 * size(x.k)')})").alias("m"))
    at = ", ".join(f"{t} * m + {_index('k', t, 'm', 0)}" for t in range(3))
    cells = rows.withColumn("c", F.expr(_CHECK.format(k="k"))).select("rid", "side", "m", "k", "c", F.explode(F.expr(f"if(k is null, array(-1L), array({at}))")).alias("at"))
    sums = cells.groupBy("rid", "side", "m", "at").agg(F.count("*").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    hexed = lambda c, width: F.lpad(F.hex(c), width, "0")
    shown = sums.select("rid", "side", "m", F.when(F.col("at") >= 0, F.concat(hexed("at", 4), hexed("n", 8), hexed("k", 16), F.right(hexed("c", 16), F.lit(8)))).alias("cell"))
    held = shown.groupBy("rid", "side", "m").agg(F.array_join(F.sort_array(F.collect_list("cell")), "").alias("cells"))
    text = held.select("rid", "side", F.base64(F.unhex(F.concat(hexed("m", 4), "cells"))).alias("text"))
    return text.groupBy("rid").agg(*[F.max(F.when(F.col("side") == k, F.col("text"))).alias(f"side{k}") for k in (0, 1)])


def _likeness(size_a: str, plus: str, minus: str) -> F.Column:
    union = F.col(size_a) + F.col(minus)
    return F.when(union == 0, F.lit(1.0)).otherwise((F.col(size_a) - F.col(plus)) / union)


def peel_pairs(pairs: DataFrame, level: int) -> DataFrame:
    """pairs: (rid, pair, a, b) with keys of both versions.  Returns (rid, pair, plus, minus, left); left > 0: a failure.

    A sub-table has as many cells as the two versions have keys, doubled at
    each level.  A sweep peels one sub-table after the other, in each of which a
    key has one cell; what is left is written and swept again, so a task holds
    the tables of one sweep only.
    """
    width = FINER * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = pairs.repartition(width, "rid").withColumn("m", F.expr(f"{_power('size(a) + size(b)')} * {1 << level}L"))
    signed = sized.select("rid", "pair", "m", F.explode(F.expr("concat(transform(a, k -> named_struct('n', 1L, 'k', k)), transform(b, k -> named_struct('n', -1L, 'k', k)))")).alias("e"))
    spread = signed.select("rid", "pair", "m", F.expr(f"explode(array({', '.join(f'{t} * m + ' + _index('e.k', t, 'm', level) for t in range(3))}))").alias("cell"), F.col("e.n").alias("n"), F.col("e.k").alias("k"))
    now, swept = spread.withColumn("c", F.expr(_CHECK.format(k="k"))), []

    def sums(df: DataFrame) -> DataFrame:
        out = df.groupBy("rid", "pair", "m", "cell").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
        return out.filter("n <> 0 or k <> 0 or c <> 0")

    for sweep in range(SWEEPS):
        now = sums(now)
        for t in range(3):
            pure = f"cell >= 0 and cell div m = {t} and abs(n) = 1 and {_CHECK.format(k='k')} = c"
            others = ", ".join(f"named_struct('cell', {u} * m + {_index('k', u, 'm', level)}, 'n', -n, 'k', k, 'c', c)" for u in range(3) if u != t)
            found = "named_struct('cell', if(n = 1, -1L, -2L), 'n', 1L, 'k', 0L, 'c', 0L)"
            itself = "named_struct('cell', cell, 'n', n, 'k', k, 'c', c)"
            moved = now.select("rid", "pair", "m", F.expr(f"explode(if({pure}, array({others}, {found}), array({itself})))").alias("u"))
            now = sums(moved.select("rid", "pair", "m", F.col("u.cell").alias("cell"), F.col("u.n").alias("n"), F.col("u.k").alias("k"), F.col("u.c").alias("c")))
        state = spill(now, "iblt-sweep")
        swept.append(state.filter("cell < 0"))
        now = state.filter("cell >= 0")
        if sweep == SWEEPS - 1 or not now.take(1):
            break
        now = now.repartition(width, "rid")
    rows = state.filter("cell >= 0")
    for found in swept:
        rows = rows.unionByName(found)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("int")
    return rows.groupBy("rid", "pair").agg(count(F.col("cell") == -1).alias("plus"), count(F.col("cell") == -2).alias("minus"), F.count(F.when(F.col("cell") >= 0, 1)).alias("left"))


def ranges(df: DataFrame, id_col: str, tie: str, buckets: int) -> F.Column:
    """A column that numbers ranges of (id_col, tie) of about equal row counts; tie is a hash of 63 bits.

    The cuts are one array on the driver, of at most `buckets` numbers.  An id
    that several cuts name, or null, has as many ranges of its own.
    """
    shares = [k / buckets for k in range(1, buckets)] or [0.5]
    at, share = F.col(id_col), F.col(tie).cast("double") / float(1 << 63)
    got = df.agg(F.percentile_approx(id_col, F.array(*map(F.lit, shares)), max(20_000, 20 * buckets)).alias("cuts"), F.count("*").alias("n"), F.count(F.when(at.isNull(), 1)).alias("nulls")).first()
    unnamed = max(1, round(buckets * got["nulls"] / max(1, got["n"])))
    part = lambda k: F.least(F.floor(share * k), k - 1)
    times = Counter((got["cuts"] or []) if buckets > 1 else [])
    cuts = sorted(times)
    if not cuts:
        return F.when(at.isNull(), part(F.lit(unnamed))).otherwise(F.lit(unnamed)).cast("int")
    own = [0] + [times[c] if times[c] > 1 else 0 for c in cuts]
    base, number = [], unnamed
    for k in own:
        base.append(number)
        number += k + 1
    kind = df.schema[id_col].dataType.simpleString()
    constant = lambda values, kind: F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")  # noqa: E731  one constant, however many ranges
    # two steps of about the square root of the cuts each
    wide = max(1, int(len(cuts) ** 0.5))
    every = constant(cuts, kind)
    head = F.size(F.filter(constant(cuts[::wide], kind), lambda c: c <= at))
    rest = F.size(F.filter(F.slice(every, F.greatest(head - 1, F.lit(0)) * wide + 2, wide - 1), lambda c: c <= at)) if wide > 1 else F.lit(0)
    where = F.when(head == 0, F.lit(0)).otherwise((head - 1) * wide + 1 + rest)
    mine = F.element_at(constant(own, "int"), where + 1)
    inner = F.when(mine == 0, F.lit(0)).when(F.element_at(every, F.greatest(where, F.lit(1))) == at, part(mine)).otherwise(mine)
    return F.when(at.isNull(), part(F.lit(unnamed))).otherwise(F.element_at(constant(base, "int"), where + 1) + inner).cast("int")


def with_next(docs: DataFrame, text: str = "text", id_col: str = "doc_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, body, next, k, next_k): each text with that of the next document by ascending id, after the last the first."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("tie", F.shiftrightunsigned(F.xxhash64("body"), 1))
    ranged = slim.withColumn("range", ranges(slim, "id", "tie", bucket_count(slim, range_rows)))
    # the first row of each range and the range before it: one short row for each range, then its texts
    firsts = ranged.groupBy("range").agg(F.min(F.struct("id", "tie")).alias("first"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("range")
    last = F.max("range").over(Window.partitionBy(F.lit(0)))
    heads = firsts.select(F.col("range").alias("_range"), F.coalesce(F.lag("range").over(in_order), last).alias("_before"), F.col("first.id").alias("_id"), F.col("first.tie").alias("_tie"))
    candidates = ranged.join(F.broadcast(heads), (F.col("range") == F.col("_range")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    guards = candidates.groupBy("_before").agg(F.min("body").alias("body"), F.first("id", ignorenulls=True).alias("id"), F.first("tie").alias("tie"))
    guards = guards.select("id", "tie", "body", F.col("_before").alias("range"), F.lit(1).alias("guard"))
    both = ranged.select("id", "tie", "body", "range", F.lit(0).alias("guard")).unionByName(guards).withColumn("k", keys(F.col("body")))
    inside = Window.partitionBy("range").orderBy("guard", F.col("id").asc_nulls_first(), "tie", "body")
    return both.withColumn("next", F.lead("body").over(inside)).withColumn("next_k", F.lead("k").over(inside)).filter("guard = 0").select("id", "body", "next", "k", "next_k")


def compare_with_edits(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs."""
    rows = with_next(docs, text, id_col).withColumn("n_chars", F.length("body").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("body", F.col("n_chars").cast("int") - half), F.left("next", half)))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "k", keys(F.col("edited")).alias("edited_k"), "next_k")
    first = spill(rows.withColumn("size", F.size("k")), "iblt-keys")
    versions = F.explode(F.array(F.struct(F.lit(0).alias("pair"), F.col("edited_k").alias("b")), F.struct(F.lit(1).alias("pair"), F.col("next_k").alias("b")))).alias("x")
    pairs = first.select("rid", F.col("k").alias("a"), versions).select("rid", "x.pair", "a", "x.b").filter("size(a) + size(b) > 0")
    picked, done, level = pairs, None, 0
    while True:
        got = spill(peel_pairs(picked, level), "iblt-peeled")
        level += 1
        done = got.filter("left = 0") if done is None else done.unionByName(got.filter("left = 0"))
        left = got.filter("left > 0").select("rid", "pair")
        if not left.take(1):
            break
        picked = pairs.join(left, ["rid", "pair"], "left_semi").select("rid", "pair", "a", "b")
    value = lambda pair, c: F.max(F.when(F.col("pair") == pair, F.col(c)))
    found = done.groupBy("rid").agg(value(0, "plus").alias("e_plus"), value(0, "minus").alias("e_minus"), value(1, "plus").alias("n_plus"), value(1, "minus").alias("n_minus"))
    # a pair whose sketches cancel out wholly leaves no row: nothing differs
    width = FINER * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = fingerprints(first.select("rid", F.col("k").alias("a"), F.col("edited_k").alias("b")).repartition(width, "rid"))
    out = first.select("rid", "id", "n_chars", "edited_sha256", "size").repartition(width, "rid").join(prints, "rid").join(found, "rid", "left").fillna(0, ["e_plus", "e_minus", "n_plus", "n_minus"])
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("side0").alias("fingerprint"), F.col("side1").alias("edited_fingerprint"),
        _likeness("size", "e_plus", "e_minus").alias("near_edited"), _likeness("size", "n_plus", "n_minus").alias("near_next"),
    )
