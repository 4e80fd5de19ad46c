"""Best-fit packing of whole documents, in a hierarchy of residuals.

Documents longer than a sequence are cut into full pieces and a last one; no
other is cut.  A task packs the pieces of its partition by best fit, longest
first: a piece goes to the bin with the least room that still holds it.  Nearly
full bins (at most limit // NEARLY tokens of room) are written as sequences.
Underfull ones go up a tree: FAN_IN groups meet, their bins are items, and best
fit runs again, until one group is left and writes all it has.

An underfull bin goes up as its pieces, each a bin of one, so a later round can
put them together anew.  Where a group would leave more than KEEP pieces, its
roomiest bins go up whole, each as one item, and the others are written: of two
bins of a best fit at most one is under half full, so those that go are hosts
that a small bin of another group could hardly need.

Scale: texts are read once and never shuffled; a task holds WINDOW pieces of a
few numbers each, a group of the tree FAN_IN * KEEP.  Sequence ids are made of
level, group and number, so a task that runs again gives the same.

Null and empty texts are documents of the one closing id.  Null ids, repeated
rows and equal ids are packed as often as they come.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spill
from .packing import CLOSING_ID, tokenizer

LIMIT = 4096
#: Room of a nearly full bin: one token in so many.
NEARLY = 256
#: Pieces that a task packs at once, pieces that a group leaves, groups that meet.
WINDOW, KEEP, FAN_IN = 100_000, 4_000, 16

NAMES = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "group", "item"]
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, `group` bigint, item bigint"


def best_fit(sizes: list[int], limit: int) -> list[tuple[int, list[int]]]:
    """(room, numbers of the items) of each bin; longest items first, each into the least room that holds it."""
    by_room: dict[int, list[list[int]]] = defaultdict(list)
    rooms = 0  # bit r: there is a bin with room r
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fit = rooms >> sizes[k]
        if fit:
            room = (fit & -fit).bit_length() - 1 + sizes[k]
            held = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, held = limit, []
        held.append(k)
        by_room[room - sizes[k]].append(held)
        rooms |= 1 << (room - sizes[k])
    return [(room, held) for room in sorted(by_room) for held in by_room[room]]


class Level:
    """Packs items, which are lists of pieces (id, piece, start, length, crc), and writes rows."""

    def __init__(self, limit: int, first_id: int, group: int, keep: int):
        self.limit, self.next_id, self.group, self.keep = limit, first_id, group, keep
        self.rows: list[tuple] = []

    def write(self, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((*p, self.next_id, offset, None, None))
            offset += p[3]
        self.next_id += 1

    def pack(self, items: list[list[tuple]], last: bool = False) -> list[list[tuple]]:
        """Writes nearly full bins, or all if last; returns the items that go on."""
        left = []
        for room, held in best_fit([sum(p[3] for p in item) for item in items], self.limit):
            if last or room <= self.limit // NEARLY:
                self.write([p for k in held for p in items[k]])
            else:
                left.append((room, [items[k] for k in held]))
        count = sum(len(item) for _, held in left for item in held)
        if count <= self.keep:
            return [item for _, held in left for item in held]
        go, count = [], 0
        for _, held in sorted(left, key=lambda x: -x[0]):
            whole = [p for item in held for p in item]
            if count + len(whole) <= self.keep:
                go.append(whole)
                count += len(whole)
            else:
                self.write(whole)
        return go

    def leave(self, items: list[list[tuple]]) -> None:
        self.rows += [(*p, None, None, self.group, k) for k, item in enumerate(items) for p in item]

    def flush(self, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[]] * len(NAMES)
        kinds = [kind, pa.int32(), *[pa.int64()] * 7]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=NAMES)


def _first_id(level: int, group: int) -> int:
    return level << 57 | group << 32


def _local(raw: bytes, limit: int, window: int, keep: int):
    closing = CLOSING_ID.to_bytes(4, "little")

    def run(batches):
        words = tokenizer(raw)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        level, held, kind = Level(limit, _first_id(0, part), part, keep), [], pa.int64()
        for b in batches:
            kind = b.column(0).type
            for doc, ids in zip(b.column(0).to_pylist(), words.ids([t or "" for t in b.column(1).to_pylist()])):
                ids += closing
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    body = ids[at : at + 4 * limit]
                    held.append([(doc, piece, at // 4, len(body) // 4, zlib.crc32(body))])
            if len(held) >= window:
                held = level.pack(held)
            yield level.flush(kind)
        level.leave(level.pack(held))
        yield level.flush(kind)

    return run


def _meet(depth: int, limit: int, keep: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(n).to_pylist() for n in (*NAMES[:5], "group", "item")]
        rows = sorted(zip(*columns), key=lambda r: (r[5], r[6], r[1], r[2], r[4], r[0] is None, r[0]))
        items: dict[tuple, list] = defaultdict(list)
        for *piece, group, item in rows:
            items[group, item].append(tuple(piece))
        up = (rows[0][5] // FAN_IN) if rows else 0
        level = Level(limit, _first_id(depth, up), up, keep)
        level.leave(level.pack(list(items.values()), last))
        return pa.Table.from_batches([level.flush(table.column("id").type)])

    return run


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", limit: int = LIMIT, window: int = WINDOW, keep: int = KEEP) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece of a document.

    The tokenizer's file is read on the driver and sent along: its size doesn't depend on the data.
    """
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    small_batches(docs.sparkSession)
    shape = f"id {docs.schema[id_col].dataType.simpleString()}, {PIECES}"
    now = spill(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_local(raw, limit, window, keep), shape), "best-fit")
    done, depth = [now.filter("item is null")], 0
    left = now.filter("item is not null")
    groups = left.agg(F.max("group")).first()[0]
    while groups is not None:
        depth, last = depth + 1, groups < FAN_IN
        now = spill(left.groupBy(F.floor(F.col("group") / FAN_IN).alias("above")).applyInArrow(_meet(depth, limit, keep, last), shape), "best-fit-level")
        done.append(now.filter("item is null"))
        left, groups = now.filter("item is not null"), None if last else groups // FAN_IN
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
