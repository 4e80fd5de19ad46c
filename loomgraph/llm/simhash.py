"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; the vector of
their bit counts is its embedding.  The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, so it may serve as a
lower bound.  The 32 coordinates form g groups.  If two embeddings are within
radius 4, at most 4 groups differ, so they agree wholly in g - 4 groups at
least: the cells of the grid are the choices of g - 4 groups with their
coordinates (35 for 7 groups).  Points that share a cell and whose total bit
counts lie within the radius are verified exactly.  g is the least of GRIDS that
leaves few points in a cell; the links found are the same for any g.

Scale: texts never move.  What is shuffled is 35 short rows (70 from 7 million
points on) for each *distinct* fingerprint, so exact copies cost nothing.  A cell emits a spanning forest of
its links and not its pairs; a cell of more than CELL points is dealt again in
pairs of blocks to many tasks.  Joins keep hot keys aside (a fingerprint of very
many copies, the hub of a star), so no task gets all rows of one.

Nulls and empty texts have no words: fingerprint zero, linked like any other.
Rows with an equal doc_id are all returned.  A null doc_id is kept and counts
as larger than any other when a component takes its name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, join_unique, small_batches, spill

RADIUS = 4
SHINGLE = 4
SEGMENTS = 32
#: Numbers of groups that the segments may form, and the mean of random points in a cell that asks for more of them.
GRIDS = (7, 8, 9, 10, 12)
CROWD = 4
#: Points of a cell that one task compares with each other.
CELL = 8192
#: Up to this size cells are compared by shifting whole batches.
SMALL = 48
HASHES = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over XXH64 (seed 42) of space-joined word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), 42), "big")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), HASHES):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + HASHES], ends[at : at + HASHES])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")
    return out.withColumnRenamed("id", id_col)


def embedding(fp) -> F.Column:
    """Bit counts of the 32 two-bit segments, two bits each, in one long."""
    low = fp.bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid(points: int, radius: int = RADIUS) -> int:
    """Groups to form for so many points: the count of a two-bit segment tells one bit and a half."""
    for g in GRIDS:
        if points <= CROWD * 2 ** (1.5 * SEGMENTS * (g - radius) / g):
            return g
    return GRIDS[-1]


def _masks(groups: int = GRIDS[0], radius: int = RADIUS) -> list[int]:
    sizes = [SEGMENTS // groups + (k < SEGMENTS % groups) for k in range(groups)]
    at, parts = 0, []
    for n in sizes:
        parts.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(parts, groups - radius)]


class _Forest:
    """Union-find over the positions of an array."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of left with right, in blocks; the total bit count is the first bound.

    Points carry the label of their tree, so a row of a block costs a look at
    the labels of its hits, and only a hit of another tree gives a link.
    """
    same = left is right
    order_l, order_r = np.argsort(np.bitwise_count(left), kind="stable"), np.argsort(np.bitwise_count(right), kind="stable")
    left, right = left[order_l], right[order_r]
    count_l, count_r = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
    n = 0 if same else len(left)  # where the labels of right begin
    labels, out_a, out_b = np.arange(n + len(right)), [], []
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        lo = np.searchsorted(count_r, count_l[at] - radius, "left")
        hi = np.searchsorted(count_r, count_l[min(at + 256, len(left)) - 1] + radius, "right")
        if lo >= hi:
            continue
        near = np.bitwise_count(part[:, None] ^ right[None, lo:hi]) <= radius
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            hits = np.flatnonzero(near[k]) + lo
            mine, others = labels[at + k], labels[n + hits]
            strange = others != mine
            if strange.any():
                trees, first = np.unique(others[strange], return_index=True)
                out_a += [at + k] * len(trees)
                out_b += hits[strange][first].tolist()
                labels[np.isin(labels, trees)] = mine
    return left[out_a], right[out_b]


def _batch(a, b, kind=0, cell=None, block=None, blocks=None) -> pa.RecordBatch:
    n = len(a)
    full = lambda v: pa.array(np.full(n, v, np.int32))
    return pa.RecordBatch.from_arrays(
        [full(kind), full(-1 if cell is None else cell[0]), pa.array(np.full(n, 0 if cell is None else cell[1], np.int64)), pa.array(np.asarray(block if block is not None else np.zeros(n), np.int32)), full(blocks or 0), pa.array(np.asarray(a).view(np.int64)), pa.array(np.asarray(b).view(np.int64))],
        names=["kind", "combo", "cell", "block", "blocks", "a", "b"],
    )


SHAPE = "kind int, combo int, cell bigint, block int, blocks int, a bigint, b bigint"


def _cells(radius: int):
    """Reads rows (combo, cell, fp) sorted by cell; emits links, and the points of cells that are too large."""

    def close(combo, cell, fps):
        """One cell larger than SMALL."""
        if len(fps) > CELL:
            blocks = -(-len(fps) // CELL)
            return _batch(fps, fps, 1, (combo, cell), np.arange(len(fps)) // CELL, blocks)
        return _batch(*_links(fps, fps, radius))

    def small(combo, cell, fps):
        """Whole cells of at most SMALL points, all at once: row i with row i + d."""
        out_a, out_b, d = [], [], 1
        while d < min(SMALL, len(fps)):
            same = np.flatnonzero((cell[d:] == cell[:-d]) & (combo[d:] == combo[:-d]))
            if not len(same):
                break
            hit = same[np.bitwise_count(fps[same] ^ fps[same + d]) <= radius]
            out_a.append(fps[hit])
            out_b.append(fps[hit + d])
            d += 1
        if not out_a:
            return None
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        keep, (ids, at) = [], np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = _Forest(len(ids))
        for k, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
            if forest.join(x, y):
                keep.append(k)
        return _batch(a[keep], b[keep]) if keep else None

    def run(batches):
        rest = (np.zeros(0, np.int32), np.zeros(0, np.int64), [])
        tail: list[np.ndarray] = []  # points of the cell that may go on, beyond those in rest
        for b in batches:
            combo, cell, fps = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)
            if tail and len(combo) and combo[0] == rest[0] and cell[0] == rest[1]:
                go_on = np.flatnonzero((combo != combo[0]) | (cell != cell[0]))
                cut = go_on[0] if len(go_on) else len(combo)
                tail.append(fps[:cut])
                combo, cell, fps = combo[cut:], cell[cut:], fps[cut:]
                if not len(combo):
                    continue
            if tail:
                whole = np.concatenate(tail)
                if len(whole) > 1:
                    yield close(rest[0], rest[1], whole)
                tail = []
            if not len(combo):
                continue
            edges = np.flatnonzero((np.diff(combo) != 0) | (np.diff(cell) != 0)) + 1
            starts, ends = np.r_[0, edges], np.r_[edges, len(combo)]
            rest, tail = (combo[starts[-1]], cell[starts[-1]]), [fps[starts[-1] :]]
            sizes = (ends - starts)[:-1]
            for k in np.flatnonzero(sizes > SMALL):
                yield close(combo[starts[k]], cell[starts[k]], fps[starts[k] : ends[k]])
            few = np.repeat(sizes <= SMALL, sizes)
            few = np.r_[few, np.zeros(len(combo) - len(few), bool)]
            if (found := small(combo[few], cell[few], fps[few])) is not None:
                yield found
        if tail and len(whole := np.concatenate(tail)) > 1:
            yield close(rest[0], rest[1], whole)

    return run


def _block_pairs(radius: int):
    """Reads rows (combo, cell, low, high, block, fp), sorted; compares block low with block high."""

    def close(key, block, fps):
        left = fps[block == key[2]]
        return _batch(*_links(left, left if key[2] == key[3] else fps[block == key[3]], radius))

    def run(batches):
        now, blocks, points = None, [], []
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(4))))
            block, fps = b.column(4).to_numpy(), b.column(5).to_numpy().view(np.uint64)
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != now:
                    if now is not None:
                        yield close(now, np.concatenate(blocks), np.concatenate(points))
                    now, blocks, points = keys[at], [], []
                blocks.append(block[at:end])
                points.append(fps[at:end])
                at = end
        if now is not None:
            yield close(now, np.concatenate(blocks), np.concatenate(points))

    return run


def links(points: DataFrame, radius: int = RADIUS, groups: int | None = None) -> DataFrame:
    """points: distinct (fp), read twice.  Returns (a, b), enough links within the radius to join each component, none beyond it."""
    spark = points.sparkSession
    small_batches(spark, 1 << 16)
    vector = embedding(F.col("fp"))
    cells = points.select("fp", F.posexplode(F.array(*[vector.bitwiseAND(F.lit(m)) for m in _masks(groups or grid(points.count(), radius), radius)])).alias("combo", "cell"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(width, "combo", "cell").sortWithinPartitions("combo", "cell").select("combo", "cell", "fp")
    found = spill(dealt.mapInArrow(_cells(radius), SHAPE), "simhash-cells")
    large = found.filter("kind = 1")
    pairs = large.select("combo", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), F.col("a").alias("fp"))
    pairs = pairs.select("combo", "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp")
    keys = ["combo", "cell", "low", "high"]
    more = pairs.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(_block_pairs(radius), SHAPE)
    return found.filter("kind = 0").select("a", "b").unionByName(more.select("a", "b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each connected component, for all nodes that have an edge.

    Alternates the large-star and the small-star step until nothing changes.
    Least neighbours are aggregated on both sides of the shuffle and joined back
    with hubs aside, so no star is gathered in one task.
    """
    now = spill(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "stars")
    seen = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spill(join_unique(both, least, "u", 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "stars-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_unique(large, down, "u", seen[0]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
        now, before = spill(small.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).filter("u <> v").distinct(), "stars"), seen
        seen = _mark(now)
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(stars: DataFrame) -> tuple:
    """Number and hash of the links: equal for equal sets."""
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(id_col, fp, component_id) for every row of docs."""
    prints = spill(with_fingerprints(docs, text, id_col), "simhash")
    distinct = spill(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    # nodes are ordered by their least id, so a component's least node names it and no group is gathered to find the name
    node = F.struct(F.col("least").isNull().alias("unnamed"), F.col("least"), F.col("fp"))
    nodes = distinct.select("fp", node.alias("node"))
    pairs = spill(links(distinct.select("fp"), radius), "simhash-links")
    count = pairs.count()
    for end in ("a", "b"):
        pairs = join_unique(pairs, nodes.withColumnsRenamed({"fp": end, "node": f"n{end}"}), end, count)
    roots = components(pairs, "na", "nb").select(F.col("node.fp").alias("fp"), F.col("root.least").alias("root_id"), F.lit(True).alias("linked"))
    by_fp = distinct.join(roots, "fp", "left").select("fp", F.when(F.col("linked"), F.col("root_id")).otherwise(F.col("least")).alias("component_id"))
    return join_unique(prints, spill(by_fp, "simhash-names"), "fp", prints.count()).select(id_col, "fp", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """docs with exactly one row of each component: that of the least doc_id, and of the least text hash where an id has several texts.

    A row is known by its id, its text and a hash of its other columns, all
    carried beside it, so one id may keep a row in each of several components.
    A null doc_id comes after all others, by text.  Only the names of rows that
    go are joined back; rows equal in every column are one where they occur.
    """
    rest = [F.col(f"row.{_tick(c)}") for c in docs.columns if c not in (id_col, text)]
    told = [F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("bigint")]
    body = F.col(f"row.{_tick(text)}")
    name = F.struct(F.col(f"row.{_tick(id_col)}").isNull().alias("unnamed"), F.col(f"row.{_tick(id_col)}").alias("id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("body"), *[c.alias("rest") for c in told])
    keyed = docs.select(as_row(docs).alias("row")).select("row", name.alias("name"), body.alias("body"))
    found = spill(near_duplicates(keyed, "body", "name", radius), "simhash-classes")
    go = found.filter("name <> component_id").select("name").distinct()
    left = keyed.select("row", "name").join(go, "name", "left_anti")
    if found.filter("name = component_id").groupBy("name").count().filter("count > 1").take(1):
        left = left.dropDuplicates(["name"])
    return left.select("row.*")


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
