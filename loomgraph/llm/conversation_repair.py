"""Cheapest repair of the turn structure of conversations, by A* on the edit lattice.

A node of the lattice is (rows used, state of the pattern `(s?(ua)+)?`); an edge
keeps, reroles or deletes a row or inserts an empty one.  The heuristic is a
suffix sum: what must be deleted costs its deletion, what is truncated costs its
charge at least.  It never overestimates and never falls by more than an edge
costs, so the first visit of a node is its best, and with keys (cost plus
heuristic, audit) the one with the least audit too.

Long conversations are cut into blocks of BLOCK rows.  A block's result is a
matrix: for each state before and after it the cheapest cost and its least
audit, each found by A*.  Two blocks in a row compose: least sum over the state
between.  Audits of equal cost between the same nodes are never prefixes of one
another, so appending the same edits keeps their order and composing is exact.

Rows are dealt by range of (conversation, turn, role, text).  Conversations that
lie inside one range are repaired there.  The first and the last of each range,
and so any that spans ranges, go on as rows: equal rows find their first by an
aggregate that is joined back with hot keys aside, blocks are solved wherever
they are, matrices meet FAN_IN at a time in a tree, the path of the root names
the states around each block, and blocks give their repaired texts.  A SHA-256
is a chain: the blocks' texts of one conversation pass one task, block by
block, and only its state is held.

Nulls count as one space, in the damage's hash too, and a null turn comes first.
Rows of equal turn are in order of role, then of their text's hash, then text.  A null
conversation is one of its own; the null id comes back as null.  Repeated rows
are duplicates.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_unique, small_batches, spill
from .shards import bucket_count

KEEP, REROLE, DELETE, INSERT, CHARGE = 0, 2, 3, 2, 1
BLOCK, FAN_IN = 256, 64
#: Rows of a range at most.
ROWS = 50_000
WHITE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: The state after each role in each state: 0 nothing yet, 1 after s, 2 after u, 3 after a.  0 and 3 accept.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = ("user", "user", "assistant", "user")
ACCEPTING = (0, 3)
LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): rows after damage; dropped ones stay with gone, so their conversation isn't forgotten."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain(text), "[.!?]", "")).otherwise(plain(text))
    return conversations.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(plain(role)).alias("role"), F.when(kind == 0, "").otherwise(body).alias("text"), (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def fault(text: str, seen_before: bool) -> int:
    """The first fault of a row, 0 if it has none."""
    body = text.rstrip(WHITE)
    return BLANK if not body else DUPLICATE if seen_before else TRUNCATED if body[-1] not in ".!?" else 0


def search(rows: list[tuple[str, int]], entry: int, exits: tuple[int, ...], first_only: bool) -> dict[int, tuple[int, str]]:
    """rows: (role's initial, fault).  The cheapest (cost, audit) from a state before the rows to each of the states after them."""
    n = len(rows)
    due = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        f = rows[k][1]
        due[k] = due[k + 1] + (DELETE if f in (BLANK, DUPLICATE) else CHARGE if f == TRUNCATED else 0)
    heap, closed, found = [(due[0], "", 0, 0, entry)], set(), {}
    while heap:
        _, audit, cost, k, state = heapq.heappop(heap)
        if (k, state) in closed:
            continue
        closed.add((k, state))
        if k == n and state in exits:
            found[state] = (cost, audit)
            if first_only or len(found) == len(exits):
                break
        nexts = [("I", INSERT, k, STEPS[state][WANTED[state][0]])]
        if k < n:
            initial, f = rows[k]
            nexts.append(("D", DELETE, k + 1, state))
            if f not in (BLANK, DUPLICATE):
                charge = CHARGE if f == TRUNCATED else 0
                nexts.append(("R", REROLE + charge, k + 1, STEPS[state][WANTED[state][0]]))
                if initial in STEPS[state]:
                    nexts.append(("K", KEEP + charge, k + 1, STEPS[state][initial]))
        for letter, price, at, to in nexts:
            if (at, to) not in closed:
                heapq.heappush(heap, (cost + price + due[at], audit + letter, cost + price, at, to))
    return found


def matrix(rows: list[tuple[str, int]]) -> dict[tuple[int, int], tuple[int, str, str]]:
    """(before, after) -> (cost, audit, state after each block) of one block."""
    return {(a, b): (cost, audit, str(b)) for a in range(4) for b, (cost, audit) in search(rows, a, (0, 1, 2, 3), False).items()}


def composed(first: dict, second: dict) -> dict:
    out: dict = {}
    for (a, m), (cost, audit, path) in first.items():
        for b in range(4):
            if (m, b) in second:
                more, rest, end = second[m, b]
                if (a, b) not in out or (cost + more, audit + rest, path + end) < out[a, b]:
                    out[a, b] = (cost + more, audit + rest, path + end)
    return out


def cheapest(found: dict) -> tuple[int, str, str]:
    """The best way from nothing to an accepting state."""
    return min(found[0, b] for b in ACCEPTING if (0, b) in found)


def lines(rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """rows: (role, text).  The repaired rows as role:text."""
    out, k = [], 0
    for letter in audit:
        if letter == "D":
            k += 1
            continue
        if letter == "K":
            role, text = rows[k]
        else:
            role, text = WANTED[state], rows[k][1] if letter == "R" else ""
        k += letter != "I"
        state = STEPS[state][role[0]]
        out.append(f"{role}:{text}")
    return out


def solved(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation of (initial, fault) rows."""
    if len(rows) <= BLOCK:
        found = search(rows, 0, ACCEPTING, True)
        return next(iter(found.values()))
    whole = matrix(rows[:BLOCK])
    for at in range(BLOCK, len(rows), BLOCK):
        whole = composed(whole, matrix(rows[at : at + BLOCK]))
    return cheapest(whole)[:2]


class Tally:
    """Counts of consecutive rows of a conversation; those of neighbours add up."""

    FIELDS = "n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint"

    def __init__(self, n=0, blank=0, duplicate=0, truncated=0, illegal=0, first=None, last=None, low=None, high=None, turns=0):
        self.n, self.blank, self.duplicate, self.truncated, self.illegal = n, blank, duplicate, truncated, illegal
        self.first, self.last, self.low, self.high, self.turns = first, last, low, high, turns

    def values(self) -> tuple:
        return self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.turns

    def add(self, turn: int | None, initial: str, f: int) -> None:
        self.join(Tally(1, f == BLANK, f == DUPLICATE, f == TRUNCATED, 0, initial, initial, turn, turn, turn is not None))

    def join(self, after: Tally) -> None:
        if not after.n:
            return
        if self.n:
            self.illegal += self.last + after.first not in LEGAL
        else:
            self.first = after.first
        self.last = after.last
        self.n, self.blank, self.duplicate = self.n + after.n, self.blank + after.blank, self.duplicate + after.duplicate
        self.truncated, self.illegal = self.truncated + after.truncated, self.illegal + after.illegal
        if after.low is not None:
            self.turns += after.turns - (self.high == after.low)
            self.low, self.high = after.low if self.low is None else self.low, after.high

    def report(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal"""
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, int(self.blank), int(self.duplicate), int(self.truncated), int(self.illegal)


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
RAW = "part int, idx bigint, turn bigint, role string, text string, gone boolean"


def _repaired(conv, rows: list[tuple]) -> tuple:
    """rows: (turn, role, text, gone) in order."""
    tally, seen, marked, kept = Tally(), set(), [], []
    for turn, role, text, gone in rows:
        if not gone:
            f = fault(text, (role, text) in seen)
            seen.add((role, text))
            tally.add(turn, role[:1], f)
            marked.append((role[:1], f))
            kept.append((role, text))
    cost, audit = solved(marked)
    return (conv, *tally.report(), cost, audit, hashlib.sha256("\n".join(lines(kept, audit, 0)).encode()).hexdigest())


def _ranges(names: list[str], kinds: list[pa.DataType]):
    """Repairs what lies inside the range; the rows of its first and last conversation go on."""

    def run(batches):
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        kind, now, number, held, began, at = pa.int64(), None, 0, [], 0, 0
        done: list[tuple] = []
        raw = lambda conv, first, rows: [(conv, *[None] * 8, part, first + k, *r) for k, r in enumerate(rows)]

        def flush():
            columns = list(zip(*done)) if done else [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *kinds])], names=names)

        for b in batches:
            kind = b.column(0).type
            for conv, *row in zip(*[c.to_pylist() for c in b.columns]):
                if number and conv == now:
                    held.append(tuple(row))
                else:
                    if number > 1:
                        done.append((*_repaired(now, held), *[None] * 6))
                    elif number:
                        done += raw(now, began, held)
                    now, number, held, began = conv, number + 1, [tuple(row)], at
                at += 1
            if number == 1:  # the first conversation needs no more than its place
                done += raw(now, began, held)
                held, began = [], at
            yield flush()
        if number:
            done += raw(now, began, held)
        yield flush()

    return run


BLOCKS = f"conv {{kind}}, pos bigint, ways array<struct<a:int,b:int,cost:bigint,audit:string,path:string>>, blocks array<bigint>, {Tally.FIELDS}"


def _node(conv: pa.Array, pos: int, found: dict, blocks: list[int], tally: Tally) -> pa.Table:
    ways = [{"a": a, "b": b, "cost": c, "audit": t, "path": p} for (a, b), (c, t, p) in sorted(found.items())]
    fields = {
        "conv": conv, "pos": pa.array([pos], pa.int64()),
        "ways": pa.array([ways], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.string())]))),
        "blocks": pa.array([blocks], pa.list_(pa.int64())),
    }
    for (name, kind), v in zip((x.split() for x in Tally.FIELDS.split(", ")), tally.values()):
        fields[name] = pa.array([v if v is None or kind == "string" else int(v)], pa.string() if kind == "string" else pa.int64())
    return pa.table(fields)


def _solve_block(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*[table.column(c).to_pylist() for c in ("pos", "turn", "role", "text", "gone", "later")]))
    tally, marked = Tally(), []
    for _, turn, role, text, gone, later in rows:
        if not gone:
            f = fault(text, later)
            tally.add(turn, role[:1], f)
            marked.append((role[:1], f))
    pos = rows[0][0] // BLOCK
    return _node(table.column("conv").slice(0, 1).combine_chunks(), pos, matrix(marked), [pos], tally)


def _meet(table: pa.Table) -> pa.Table:
    nodes = sorted(table.drop_columns(["conv"]).to_pylist(), key=lambda r: r["pos"])
    whole, blocks, tally = None, [], Tally()
    for r in nodes:
        found = {(w["a"], w["b"]): (w["cost"], w["audit"], w["path"]) for w in r["ways"]}
        whole = found if whole is None else composed(whole, found)
        blocks += r["blocks"]
        tally.join(Tally(*[r[x.split()[0]] for x in Tally.FIELDS.split(", ")]))
    return _node(table.column("conv").slice(0, 1).combine_chunks(), nodes[0]["pos"] // FAN_IN, whole, blocks, tally)


def _block_texts(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*[table.column(c).to_pylist() for c in ("pos", "role", "text", "gone", "audit", "entry")]))
    out = lines([(role, text) for _, role, text, gone, *_ in rows if not gone], rows[0][4], rows[0][5])
    return pa.table({"conv": table.column("conv").slice(0, 1).combine_chunks(), "pos": pa.array([rows[0][0] // BLOCK], pa.int64()), "count": pa.array([len(out)], pa.int64()), "body": pa.array(["\n".join(out)], pa.string())})


def _hashes(batches):
    """One digest for each conversation; its blocks come in order."""
    kind, now, state, any_line = pa.int64(), None, None, False
    for b in batches:
        kind = b.column(0).type
        done = []
        for conv, count, body in zip(*[c.to_pylist() for c in b.columns]):
            if state is None or conv != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state, any_line = conv, hashlib.sha256(), False
            if count:
                state.update((b"\n" if any_line else b"") + body.encode())
                any_line = True
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done], pa.string())], names=["conv", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], names=["conv", "sha"])


def _spanning(rows: DataFrame, parts: int, kind: str) -> DataFrame:
    """Repairs of the conversations whose rows these are: (conv, part, idx, turn, role, text, gone)."""
    spark = rows.sparkSession
    widest = rows.agg(F.max("idx")).first()[0] or 0
    stride = 1 << max(int(widest).bit_length(), BLOCK.bit_length() - 1)
    name = F.md5(F.concat(F.coalesce(F.col("conv").cast("string"), F.lit("null")), F.lit("|"), F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = spill(rows.select("conv", (F.col("part").cast("bigint") * stride + F.col("idx")).alias("pos"), "turn", "role", "text", "gone", F.when(~F.col("gone"), name).alias("name")), "repair-rows")
    live = rows.filter("name is not null").select("name", "pos")
    firsts = live.groupBy("name").agg(F.min("pos").alias("first"))
    later = spill(join_unique(live, firsts, "name", rows.count()).filter("pos > first").select("pos", F.lit(True).alias("later")), "repair-later")
    marked = rows.drop("name").join(later, "pos", "left").withColumn("later", F.coalesce("later", F.lit(False)))
    shape = BLOCKS.format(kind=kind)
    blocks = spill(marked.groupBy("conv", F.floor(F.col("pos") / BLOCK).alias("block")).applyInArrow(_solve_block, shape), "repair-blocks")
    node, left = blocks, math.ceil(parts * stride / BLOCK)
    while left > 1:
        node, left = spill(node.groupBy("conv", F.floor(F.col("pos") / FAN_IN).alias("above")).applyInArrow(_meet, shape), "repair-tree"), -(-left // FAN_IN)
    ends = F.filter("ways", lambda w: (w["a"] == 0) & w["b"].isin(*ACCEPTING))
    best = F.array_min(F.transform(ends, lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"), w["path"].alias("path"))))
    roots = spill(node.withColumn("best", best).select(
        "conv", "blocks", F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("bigint").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", "best.path",
    ), "repair-roots")
    entry = F.when(F.col("k") == 0, 0).otherwise(F.substring("path", F.col("k"), F.lit(1)).cast("int"))
    # a block number may hold the end of one conversation and the start of another, so both are told apart by their conversation
    way = lambda c: F.filter("ways", lambda w: (w["a"] == F.col("entry")) & (w["b"] == F.col("exit")))[0][c]
    named = roots.select(F.col("conv").alias("of"), "path", F.posexplode("blocks").alias("k", "at")).select("of", "at", entry.alias("entry"), F.substring("path", F.col("k") + 1, F.lit(1)).cast("int").alias("exit"))
    chosen = blocks.join(named, (blocks["pos"] == named["at"]) & blocks["conv"].eqNullSafe(named["of"])).select("of", "at", "entry", way("audit").alias("audit"))
    texts = rows.select("conv", "pos", "role", "text", "gone").join(chosen, (F.floor(F.col("pos") / BLOCK) == F.col("at")) & F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    bodies = spill(texts.groupBy("conv", "at").applyInArrow(_block_texts, f"conv {kind}, pos bigint, count bigint, body string"), "repair-texts")
    small_batches(spark, 16)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashes = spill(bodies.repartition(width, "conv").sortWithinPartitions("conv", "pos").select("conv", "count", "body").mapInArrow(_hashes, f"conv {kind}, sha string"), "repair-hashes")
    small_batches(spark)
    hashes = hashes.withColumnRenamed("conv", "of")
    return roots.join(hashes, roots["conv"].eqNullSafe(hashes["of"])).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def repair(rows: DataFrame, conv_id: str = "conv_id", most: int = ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    rows: (conv, turn, role, text, gone), as `damaged` gives them.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["conv"].dataType.simpleString()
    base = spill(rows.withColumn("uid", F.monotonically_increasing_id()), "repair-input")
    parts = bucket_count(base, most)
    order = ["conv", "turn", "role", F.xxhash64("text")]
    dealt = base.repartitionByRange(parts, *order, "uid").sortWithinPartitions(*order, "text").select("conv", "turn", "role", "text", "gone")
    shape = f"conv {kind}, {RESULT}, {RAW}"
    names = T._parse_datatype_string(shape).names
    kinds = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    found = spill(dealt.mapInArrow(_ranges(names, kinds), shape), "repair-ranges")
    inside = found.filter("part is null").select("conv", *[x.split()[0] for x in RESULT.split(", ")])
    spanning = _spanning(found.filter("part is not null").select("conv", *[x.split()[0] for x in RAW.split(", ")]), parts, kind)
    return inside.unionByName(spanning).withColumnRenamed("conv", conv_id)
