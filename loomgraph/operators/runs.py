"""Sequential rules over ordered groups of any size: next-fit batches and folded shards, without gathering a group.

Rows are dealt by range of (group, order).  A run is what a range holds of one
group.  Only the first and the last run of a range can belong to a group of
other ranges too; each is summed up as what it makes of any state it may begin
with, the driver joins these sums range by range, and a second pass over the
ranges begins each with its true state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def ranged(df: DataFrame, by: list[Column], tie: list[Column], label: str) -> DataFrame:
    """df in ranges of (by, tie), sorted, with the number of the range as part; as many as a shuffle has partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    uid = df.withColumn("_uid", F.monotonically_increasing_id())
    told = uid.repartitionByRange(n, *by, *tie, F.col("_uid")).sortWithinPartitions(*by, *tie, F.col("_uid"))
    return cut(told.drop("_uid").withColumn("part", F.spark_partition_id()), label)


def by_part(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, order: list[Column]) -> DataFrame:
    """run over the rows of each part in order.  A part may come in several tasks' files, so it is dealt by number again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "part").sortWithinPartitions("part", *order).mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """(part, group, first of the part, rows) of each run's share of a batch, columns as lists."""
    part, group, began = None, None, False
    for b in batches:
        parts, groups, *rest = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("part", *columns)]
        start = 0
        for k in range(1, len(parts) + 1):
            if k == len(parts) or parts[k] != parts[start] or groups[k] != groups[start]:
                if parts[start] != part:
                    part, group, first = parts[start], groups[start], True
                elif groups[start] != group or not began:
                    group, first = groups[start], False
                began = True
                yield part, group, first, [r[start:k] for r in rest]
                start = k


def fitted(sizes, target: int, filled: np.ndarray, closed: np.ndarray) -> None:
    """Next-fit over sizes for every state at once, in place; beyond the target all states are alike."""
    for n in sizes:
        new = (filled > 0) & (filled + n > target)
        closed += new
        np.minimum(np.where(new, n, filled + n), target + 1, out=filled)


def next_fit(counts: DataFrame, target: int, group: str, file: str) -> DataFrame:
    """(group, file, n, batch) of counts (group, file, n): next-fit in file order; a file larger than the target stands alone."""
    order = [F.col(group), F.col(file).asc_nulls_last()]
    rows = ranged(counts.select(F.col(group).alias("g"), F.col(file).alias("f"), "n"), [F.col("g")], [F.col("f").asc_nulls_last()], "fit-ranges")
    kind = counts.schema[group].dataType.simpleString()
    inner = [F.col("g"), F.col("f").asc_nulls_last()]

    def sum_up(batches):
        states = np.arange(target + 2)
        sums: dict[tuple, list] = {}
        ends: dict[int, list] = {}
        for part, g, first, (sizes,) in _runs(batches, ["g", "n"]):
            held = ends.setdefault(part, [])
            if not held or held[-1][0] != g:
                if len(held) == 2:
                    held.pop()
                held.append([g, states.copy(), np.zeros(target + 2, np.int64)])
            fitted(sizes, target, held[-1][1], held[-1][2])
        out = [(part, k, g, filled.tolist(), closed.tolist()) for part, held in ends.items() for k, (g, filled, closed) in enumerate(held)]
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array([repr(x) for x in cols[2]], pa.string()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int64()))], names=["part", "k", "g", "filled", "closed"])

    # two rows for each range at most: its first and its last run
    ends = sorted(by_part(rows, sum_up, "part int, k int, g string, filled array<bigint>, closed array<bigint>", inner).collect(), key=lambda r: (r["part"], r["k"]))
    begins: dict[int, tuple[int, int]] = {}
    now, filled, closed = None, 0, 0
    for r in ends:
        if r["k"] == 0 and r["g"] == now:
            begins[r["part"]] = (filled, closed)
            filled, closed = r["filled"][filled], closed + r["closed"][filled]
        else:
            filled, closed = r["filled"][0], r["closed"][0]
        now = r["g"]

    def number(batches):
        part, g, filled, closed = None, None, 0, 0
        for b in batches:
            parts, groups, sizes = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("part", "g", "n"))
            out = []
            for p, x, n in zip(parts, groups, sizes):
                if p != part:
                    filled, closed = begins.get(p, (0, 0))
                elif x != g:
                    filled, closed = 0, 0
                part, g = p, x
                if filled and filled + n > target:
                    filled, closed = 0, closed + 1
                filled += n
                out.append(closed)
            keep = [b.column(b.schema.get_field_index(c)) for c in ("g", "f", "n")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.int64())], names=["g", "f", "n", "batch"])

    done = by_part(rows, number, f"g {kind}, f string, n bigint, batch bigint", inner)
    return done.select(F.col("g").alias(group), F.col("f").alias(file), "n", "batch")


def fold_shards(rows: DataFrame) -> DataFrame:
    """(key, at, n, file, rec, bare) of rows (key, at, file, rec): where each record ends that doesn't give way.

    In the order of at a record takes its bare key, or that of one from its own
    file, which goes.  One that meets a record of another file takes that one
    with it: both end at names of their own (bare false, at and n by the later
    one), and the key is free.
    """
    parts = ranged(rows, [F.col("key")], [F.col("at")], "fold-ranges")
    inner = [F.col("key"), F.col("at")]

    def sum_up(batches):
        # of a run: its first file and place, and the file left bare if its first record finds no other (a) or is taken with another (b)
        ends: dict[int, list] = {}
        for part, key, first, (files, ats) in _runs(batches, ["key", "file", "at"]):
            held = ends.setdefault(part, [])
            if not held or held[-1]["key"] != key:
                if len(held) == 2:
                    held.pop()
                held.append({"key": key, "file": files[0], "at": ats[0], "a": [], "b": None})
            run = held[-1]
            for f in files:
                if run["b"] is None:
                    run["a"], run["b"] = [f], []
                    continue
                for side in ("a", "b"):
                    run[side] = [f] if not run[side] or run[side][0] == f else []
        out = [(p, k, r["key"], r["file"], r["at"]["shard"], r["at"]["pos"], r["a"], r["b"]) for p, held in ends.items() for k, r in enumerate(held)]
        cols = list(zip(*out)) if out else [[]] * 8
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["part", "k", "key", "file", "shard", "pos", "a", "b"])

    ends = sorted(by_part(parts, sum_up, "part int, k int, key string, file string, shard string, pos bigint, a array<string>, b array<string>", inner).collect(), key=lambda r: (r["part"], r["k"]))
    taken: set[int] = set()  # ranges whose first record is taken with one of a range before
    fate: dict[int, tuple] = {}  # of the record that a range's last run leaves bare: replaced, or taken at a place
    now, left, owner = None, [], None
    for r in ends:
        if r["k"] == 0 and r["key"] == now and left:
            clash = left[0] != r["file"]
            fate[owner] = ("named", r["shard"], r["pos"]) if clash else ("gone", None, None)
            if clash:
                taken.add(r["part"])
            after = r["b"] if clash else r["a"]
        else:
            after = r["a"]
        # the run leaves a record of its own, or none
        now, left, owner = r["key"], after, r["part"]

    kind = rows.schema["rec"].dataType.simpleString()

    def settle(batches):
        waiting, part, key, file = None, None, None, None
        names = ["key", "shard", "pos", "n", "file", "rec", "bare"]

        def emit(table, picks):
            keep = [k for k, f in enumerate(picks) if f is not None]
            told = [picks[k] for k in keep]
            some = table.take(pa.array(keep, pa.int64()))
            at = some.column(some.schema.get_field_index("at"))
            own = list(zip(pc.struct_field(at, "shard").to_pylist(), pc.struct_field(at, "pos").to_pylist()))
            shard, pos = ([o[j] if f[0] == "bare" else f[j + 1] for o, f in zip(own, told)] for j in (0, 1))
            cols = [some.column(some.schema.get_field_index("key")), pa.array(shard, pa.string()), pa.array(pos, pa.int64()), pa.array([f[3] for f in told], pa.int32()), some.column(some.schema.get_field_index("file")), some.column(some.schema.get_field_index("rec")), pa.array([f[0] == "bare" for f in told], pa.bool_())]
            return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([c]) for c in cols], names=names).combine_chunks().to_batches()

        def end(p):
            f = fate.get(p)
            return ("bare", None, None, 0) if f is None else None if f[0] == "gone" else ("named", f[1], f[2], 0)

        for b in batches:
            table = pa.Table.from_batches([b])
            if waiting is not None:
                table = pa.concat_tables([waiting, table])
            keys, files, ats, ps = (table.column(c).to_pylist() for c in ("key", "file", "at", "part"))
            picks: list = [None] * len(keys)
            begin, bare = (1, 0) if waiting is not None else (0, None)
            for k in range(begin, len(keys)):
                if ps[k] != part or keys[k] != key:
                    if bare is not None:
                        picks[bare] = end(part) if ps[k] != part else ("bare", None, None, 0)
                    bare = None
                    if ps[k] != part and ps[k] in taken:
                        picks[k] = ("named", ats[k]["shard"], ats[k]["pos"], 1)
                    else:
                        bare = k
                    part, key = ps[k], keys[k]
                elif bare is None:
                    bare = k
                elif files[bare] == files[k]:
                    bare = k
                else:
                    picks[bare] = ("named", ats[k]["shard"], ats[k]["pos"], 0)
                    picks[k] = ("named", ats[k]["shard"], ats[k]["pos"], 1)
                    bare = None
            waiting = table.slice(bare, 1) if bare is not None else None
            yield from emit(table, picks)
        if waiting is not None:
            yield from emit(waiting, [end(part)])

    shape = f"key string, shard string, pos bigint, n int, file string, rec {kind}, bare boolean"
    return by_part(parts, settle, shape, inner).select("key", F.struct("shard", "pos").alias("at"), "n", "file", "rec", "bare")
