"""One JSON document of any size, taken apart over many tasks.

The file is read as records that end at commas, which Spark's reader splits by
byte ranges.  What a comma means depends on what stands before it, so there are
two passes.  The first sums up each range for both ways it may begin, outside a
string and inside one: how its brackets change the depth and whether a string is
open at its end.  These sums, a row for each range, are added up on the driver
and say how every range really begins.  The second pass cuts the ranges at
commas of depth two and less into pieces, which are members of the document or
elements of its lists; pieces over several ranges are put together by an
aggregate of those alone.  A piece is as large as an element; nothing larger is
ever held.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: A member's name and what follows it.
_HEADER = re.compile(r'\s*("(?:[^"\\]|\\.)*")\s*:\s*(.*)', re.S)
#: JSON values of more bytes can't be held as a variant.
LARGEST = 120_000_000
_BOM, _WHITE = b"\xef\xbb\xbf", " \t\n\r"


class Range(NamedTuple):
    """What a byte range does to the lexer."""

    at: int
    odd: bool  # an odd number of quotes: a string is open at its end if none was at its start
    plain: int  # change of depth if it begins outside a string
    inside: int  # change of depth if it begins inside one
    size: int
    broken: int  # records that aren't UTF-8


class Document(NamedTuple):
    sha: str
    #: Why it is no document, else null.
    why: str | None
    #: (list, i, v): the elements of the lists asked for, as variants.
    items: DataFrame
    #: (name, body): the other members of the object, and its lists as `[]`, or `[0]` where they have elements; of a document that is no object one row without a name.
    members: DataFrame


def _records(spark: SparkSession, path: str) -> DataFrame:
    held = spark.read.option("lineSep", ",").text(path)
    return held.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_path").alias("file"))


def _batches(batches):
    """(range, records) of each run of records that are of one range."""
    for b in batches:
        ats = b.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(ats)) + 1).tolist(), len(ats)]
        for a, z in zip(edges, edges[1:]):
            if z > a:
                yield int(ats[a]), b.column(0).slice(a, z - a).to_pylist()


def lexed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the number of unescaped quotes up to it mod 2, and +1 or -1 where a bracket opens or closes."""
    place = np.arange(len(data))
    slash = data == 92
    quote = data == 34
    if slash.any():
        last = np.maximum.accumulate(np.where(slash, -1, place))
        before = np.concatenate([[-1], last[:-1]])
        quote &= (place - 1 - before) % 2 == 0
    step = np.zeros(len(data), np.int8)
    step[(data == 123) | (data == 91)] = 1
    step[(data == 125) | (data == 93)] = -1
    return np.cumsum(quote) & 1, step


def _valid(value: bytes) -> bool:
    try:
        value.decode()
        return True
    except UnicodeDecodeError:
        return False


def _sum_up(batches):
    now, held = None, [0, 0, 0, 0, 0]
    rows = []
    for at, values in _batches(batches):
        if at != now:
            if now is not None:
                rows.append((now, *held))
            now, held = at, [0, 0, 0, 0, 0]
        data = np.frombuffer(b",".join(values) + b",", np.uint8)
        odd, step = lexed(data)
        plain, inside = int(step[odd == 0].sum()), int(step[odd == 1].sum())
        if held[0]:
            plain, inside = inside, plain
        held = [held[0] ^ int(odd[-1]), held[1] + plain, held[2] + inside, held[3] + len(data), held[4] + (0 if _valid(data.tobytes()) else 1)]
    if now is not None:
        rows.append((now, *held))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)], names=["at", "odd", "plain", "inside", "size", "broken"])


def _pieces(begins: dict[int, tuple[bool, int]], first: int):
    """Pieces of each range: (at, n, part, low, high, member, rank, text).

    n numbers the pieces that begin in the range from 0; -1 is what goes on from
    before.  low and high are the depths before and after it; member is the n of
    the piece that the member began with, null where that was in another range.
    """

    def run(batches):
        now, number, member, rank, low, start, fresh = None, -1, None, -1, 0, b"", False
        rows: list[tuple] = []

        def close(high):
            rows.append((now, number, low, high, member, rank, start.decode()))

        def end():
            if not fresh:  # a piece that begins at the end of a range is the next range's
                close(depth)

        def flush():
            out = list(zip(*rows)) if rows else [[]] * 7
            rows.clear()
            kinds = [*[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["at", "n", "low", "high", "member", "rank", "text"])

        def open_one(depth):
            nonlocal number, member, rank, low, start
            number, low, start = number + 1, depth, b""
            if depth <= 1:
                member, rank = number, 0
            else:
                rank += 1

        string, depth = False, 0
        for at, values in _batches(batches):
            if at != now:
                if now is not None:
                    end()
                    yield flush()
                now, number, member, rank = at, -1, None, -1
                string, depth = begins[at]
                low, start = depth, b""
                if at == first or not string and depth <= 2:
                    open_one(depth)
            data = b",".join(values) + b","
            view = np.frombuffer(data, np.uint8)
            odd, step = lexed(view)
            odd = odd ^ int(string)
            depths = depth + np.cumsum(np.where(odd == 0, step, 0))
            commas = np.flatnonzero(view == 44)
            cuts = commas[(odd[commas] == 0) & (depths[commas] <= 2)]
            begin = 0
            for c in cuts.tolist():
                start += data[begin:c]
                close(int(depths[c]))
                open_one(int(depths[c]))
                begin = c + 1
            start += data[begin:]  # with the comma that follows its last record
            fresh = begin == len(data)
            string, depth = bool(odd[-1]), int(depths[-1])
            yield flush()
        if now is not None:
            end()
        yield flush()

    return run


def taken_apart(text: str, low: int, high: int) -> tuple[str | None, str, str, str, bool]:
    """(name, kind, body, closing, right) of a piece.

    kind: S a value, L or O the start of a list or an object that is a member, E
    what goes on inside one, N no object at all.  body: the element, the inside
    of an object, or the value; closing: the brackets that end it.
    """
    closing, body = "", text.rstrip(_WHITE)
    if low < 0 or high < 0:
        return None, "S", text, "", False
    for _ in range(max(0, 2 - high) if low == 2 else 0):
        if body[-1:] not in ("]", "}"):
            return None, "E", text, "", False
        closing, body = body[-1] + closing, body[:-1].rstrip(_WHITE)
    if low == 2:
        return None, "E", body, closing, True
    if low == 0:
        body = body.lstrip(_WHITE)
        if body[:1] != "{":
            return None, "N", text, "", True
        body = body[1:]
    if high == 0:
        if body[-1:] != "}":
            return None, "S", text, "", False
        body, closing = body[:-1].rstrip(_WHITE), "}"
    if not body.strip(_WHITE) and low == 0 and high == 0:
        return None, "S", "", closing, True
    found = _HEADER.fullmatch(body)
    if not found:
        return None, "S", text, closing, False
    name, value = json.loads(found[1], strict=False), found[2]
    if value[:1] not in ("[", "{"):
        return name, "S", value, closing, True
    kind, value = ("L" if value[0] == "[" else "O"), value[1:]
    if high >= 2:
        return name, kind, value, closing, True
    if value[-1:] != ("]" if kind == "L" else "}"):
        return name, kind, value, closing, False
    return name, kind, value[:-1].rstrip(_WHITE), value[-1] + closing, True


def _take_apart(batches):
    for b in batches:
        parts = []
        for text, low, high in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "low", "high")]):
            try:
                parts.append(taken_apart(text, low, high))
            except ValueError:
                parts.append((None, "S", text, "", False))
        columns = list(zip(*parts)) if parts else [[]] * 5
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        keep = [b.column(b.schema.get_field_index(c)) for c in ("m_at", "m_n", "rank", "low")]
        yield pa.RecordBatch.from_arrays([*keep, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["m_at", "m_n", "rank", "low", "name", "kind", "body", "closing", "right"])


def _rewrite(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON that a variant doesn't take, because a key comes twice, with the last of each key; null where it is no JSON."""

    def one(v: str) -> str | None:
        try:
            return json.dumps(json.loads(v))
        except ValueError:
            return None

    for b in bodies:
        yield b.map(one)


def strict(body: Column) -> Column:
    """body as a variant, null where it is no JSON.  The parser stops after the first value, so what follows it must fail in an array and in an object."""
    inside = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    return F.when(F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}"))).isNotNull(), F.try_variant_get(inside, "$[0]", "variant"))


def parsed(rows: DataFrame) -> DataFrame:
    """rows with v, their body as a variant; null where it is no JSON.  A value larger than a variant fails the job."""
    told = cut(rows.withColumn("v", strict(F.col("body"))), "json-parsed")
    odd = told.filter("v is null")
    if not odd.take(1):
        return told
    fit = F.when(F.octet_length("body") > LARGEST, F.raise_error(F.lit(f"a JSON value of more than {LARGEST} bytes"))).otherwise(F.col("body"))
    return told.filter("v is not null").unionByName(odd.withColumn("v", strict(F.pandas_udf(_rewrite, "string")(fit))))


def read(spark: SparkSession, path: str, lists: tuple[str, ...]) -> Document:
    """The document in a file, its lists' elements as rows.

    Of a member that comes twice the last counts.  The hash is a chain, so one
    task reads all bytes for it, in order and without a shuffle.
    """
    records = _records(spark, path)
    files = records.select("file", "size").distinct().limit(2).collect()
    if len(files) > 1:
        raise ValueError(f"{path} holds more than one file")
    sums = sorted(Range(r["at"], bool(r["odd"]), r["plain"], r["inside"], r["size"], r["broken"]) for r in records.select("value", "at").mapInArrow(_sum_up, "at bigint, odd bigint, plain bigint, inside bigint, size bigint, broken bigint").collect())
    none = spark.createDataFrame([], "list string, i bigint, v variant"), spark.createDataFrame([], "name string, body string")
    missing = files[0]["size"] - (sum(r.size for r in sums) - 1) if files else 0
    sha = _hash(records, missing)
    if any(r.broken for r in sums):
        return Document(sha, "not UTF-8", *none)
    begins, string, depth = {}, False, 0
    for r in sums:
        begins[r.at] = (string, depth)
        depth += r.inside if string else r.plain
        string ^= r.odd
    if not sums or string or depth or missing:  # the reader leaves out a mark of byte order and a last comma
        return Document(sha, "not JSON", *none)
    found = cut(records.select("value", "at").mapInArrow(_pieces(begins, sums[0].at), "at bigint, n bigint, low bigint, high bigint, member bigint, rank bigint, text string"), "json-pieces")
    # a row for each range: its last piece, the member that one is of, and how many pieces that member has here
    ends = {r["at"]: r["e"] for r in found.groupBy("at").agg(F.max_by(F.struct("n", "member", "rank"), "n").alias("e")).collect()}
    carried, piece, member, count = [], (sums[0].at, 0), (sums[0].at, 0), 0
    for r in sums:
        carried.append((r.at, *piece, *member, count))
        e = ends[r.at]
        if e["n"] >= 0:
            piece = (r.at, e["n"])
        if e["member"] is not None:
            member, count = (r.at, e["member"]), e["rank"] + 1
        else:
            count += e["rank"] + 1
    before = F.broadcast(spark.createDataFrame(carried, "at bigint, p_at bigint, p_n bigint, b_at bigint, b_n bigint, b_count bigint"))  # a row for each range
    told = found.join(before, "at").select(
        "at", "low", "high", "text", F.when(F.col("n") < 0, F.col("p_at")).otherwise(F.col("at")).alias("p_at"), F.when(F.col("n") < 0, F.col("p_n")).otherwise(F.col("n")).alias("p_n"),
        F.when(F.col("member").isNull(), F.col("b_at")).otherwise(F.col("at")).alias("m_at"), F.coalesce("member", "b_n").alias("m_n"),
        F.when(F.col("member").isNull(), F.col("b_count") + F.col("rank")).otherwise(F.col("rank")).alias("rank"), (F.col("n") < 0).alias("goes_on"),
    )
    # the last piece of a range may go on in those after it
    last = F.broadcast(spark.createDataFrame([(at, e["n"]) for at, e in ends.items()], "p_at bigint, p_n bigint"))
    over = told.filter("goes_on").unionByName(told.filter("not goes_on").join(last, ["p_at", "p_n"], "left_semi").select(told.columns))
    whole = told.filter("not goes_on").join(last, ["p_at", "p_n"], "left_anti")
    first, final = F.min_by(F.struct("low", "m_at", "m_n", "rank"), "at"), F.max_by("high", "at")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    stitched = over.groupBy("p_at", "p_n").agg(first.alias("f"), final.alias("high"), joined.alias("text")).select("f.low", "high", "f.m_at", "f.m_n", "f.rank", "text")
    columns = ["low", "high", "m_at", "m_n", "rank", "text"]
    shape = "m_at bigint, m_n bigint, rank bigint, low bigint, name string, kind string, body string, closing string, right boolean"
    parts = cut(whole.select(columns).unionByName(stitched.select(columns)).mapInArrow(_take_apart, shape), "json-parts")
    heads = parts.filter("rank = 0")
    if heads.filter("kind = 'N'").take(1):
        # no object, so nothing to take apart
        whole = spark.read.text(path, wholetext=True).select(F.when(F.octet_length("value") > LARGEST, F.raise_error(F.lit("a document too large for one value"))).otherwise(F.col("value")).alias("body"))
        if not whole.filter(strict(F.col("body")).isNotNull()).take(1):
            return Document(sha, "not JSON", *none)
        return Document(sha, None, none[0], whole.select(F.lit(None).cast("string").alias("name"), "body"))
    if parts.filter("not right").take(1) or heads.filter("kind = 'E'").take(1) or heads.filter("low = 0").count() != 1:
        return Document(sha, "not JSON", *none)
    named = cut(heads.filter("name is not null").groupBy("name").agg(F.max_by(F.struct("m_at", "m_n", "kind", "body"), F.struct("m_at", "m_n")).alias("h")).select("name", "h.*"), "json-members")
    asked = F.broadcast(named.filter(F.col("name").isin(*lists) & (F.col("kind") == "L")).select(F.col("name").alias("list"), "m_at", "m_n"))  # a row for each list asked for
    held = parts.join(asked, ["m_at", "m_n"], "left")
    blank = F.trim(F.translate("body", "\t\n\r", "   ")) == ""
    empty = blank & (F.col("rank") == 0) & F.col("closing").startswith("]")
    items = parsed(held.filter(F.col("list").isNotNull() & ~empty).select("list", F.col("rank").alias("i"), "body", "closing"))
    # what no one asked for must be JSON too, piece by piece
    rest = held.filter("list is null").join(heads.select("m_at", "m_n", F.col("kind").alias("of"), F.col("name").isNotNull().alias("said")), ["m_at", "m_n"]).filter("said")
    inside = F.when(blank & (F.col("closing") != ""), F.lit(None)).otherwise(F.col("body"))
    body = F.when(F.col("of") == "S", F.col("body")).when(F.col("of") == "O", F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(inside)
    loose = rest.filter(~((F.col("of") != "S") & (F.col("rank") == 0) & blank & (F.col("closing") != ""))).select(F.when((F.col("of") == "O") & blank, F.lit("")).otherwise(body).alias("body"))
    ends = {"L": "]", "O": "}"}
    crossed = held.join(heads.select("m_at", "m_n", F.col("kind").alias("of")), ["m_at", "m_n"]).filter("kind = 'E' and closing <> ''").filter(F.left("closing", F.lit(1)) != F.when(F.col("of") == "L", ends["L"]).otherwise(ends["O"]))
    if crossed.take(1) or items.filter("v is null").take(1) or parsed(loose).filter("v is null").take(1):
        return Document(sha, "not JSON", *none)
    some = F.broadcast(items.select(F.col("list").alias("name")).distinct().withColumn("some", F.lit(True)))  # a row for each list
    members = named.join(some, "name", "left").select("name", F.when(F.col("some"), "[0]").when(F.col("kind") == "L", "[]").when(F.col("kind") == "O", "{}").otherwise(F.col("body")).alias("body"))
    return Document(sha, None, items.select("list", "i", "v"), members)


def _hash(records: DataFrame, missing: int) -> str:
    def run(batches):
        state, any_record = hashlib.sha256(), False
        state.update(_BOM if missing >= 3 else b"")
        last = -1
        for at, values in _batches(batches):
            if at < last:
                raise ValueError("ranges out of order")
            last = at
            state.update((b"," if any_record else b"") + b",".join(values))
            any_record = True
        state.update(b"," if missing in (1, 4) else b"")
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], names=["sha"])

    got = records.select("value", "at").coalesce(1).mapInArrow(run, "sha string").collect()
    return got[0][0] if got else hashlib.sha256(b"").hexdigest()
