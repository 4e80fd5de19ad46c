"""Packing of tokenised examples into fixed sequences by vector bin packing.

An example needs three things of a sequence: tokens, a segment, and
loss-bearing tokens.  Placing is by the dot-product heuristic: of the open
sequences that still have room under all three limits, the one whose free
capacity has the largest dot product with the example's demand, both as shares
of the limits.  Examples longer than a sequence fill whole sequences first;
what is left of them is packed.  Examples may be cut, so what doesn't fit
anywhere else closes the gap of the fullest open sequence and goes on in the
next.

Scale: a map over the scan, no shuffle.  Each task keeps at most OPEN open
sequences, and at the end of its partition cuts what is left into full ones;
its last sequence is cut at powers of two, so a task pads nothing.  Ids hold
the task's partition, so a task that runs again gives the same ids.

Null and empty texts are documents of the one closing id.  Repeated rows and
equal doc_ids are packed as often as they come.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LIMIT = 2048
SEGMENTS = 64
#: Open sequences that a task keeps at once.
OPEN = 64
CLOSING_ID = 1
CACHED = 400_000

#: Beyond these characters the tokenizer itself does all the work.
_ODD = re.compile("[^\t-\r -~¡-¬®-ɏ‐-‧]")
#: ASCII separators that Python takes for white space and the tokenizer doesn't, and other controls.
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


#: Stands for the end of a word: no byte of UTF-8.
_END = b"\xff"
_ENDS = frozenset(".,;:!?")


class _Words(dict):
    """Ids of words between white space, as little-endian bytes; computed when first seen."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        super().__init__()
        self.split = regex.compile(pattern).findall
        self.merge = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def ids(self, piece: str) -> bytes:
        return struct.pack(f"<{len(got)}I", *got) if len(got := self.merge(piece.encode() + _END)) != 1 else got[0].to_bytes(4, "little")

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            found = self.ids(word)
        elif word[-1] in _ENDS and word[:-1].isalpha():
            found = (self.get(word[:-1]) or self.ids(word[:-1])) + self.ids(word[-1])
        else:
            found = b"".join(map(self.ids, self.split(word)))
        self[word] = found
        return found


class WordTokenizer:
    """Ids of a byte-level BPE tokenizer whose tokens never span white space, as little-endian bytes.

    Words that came before are looked up; others are merged by rank with a
    faster library, which gives the same ids: each result of a merge comes from
    one pair, and every token of the vocabulary is its own encoding (tests
    check both), so merging by pair and by result agree.  Texts with unusual
    characters, special tokens or white space go to the tokenizer itself.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        shape = json.loads(raw)
        pattern = shape["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.known = _Words(pattern, byte_ranks(shape["model"]["vocab"]))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        for t in texts:
            if not t.isascii() and _ODD.search(t) or "<|" in t or _CONTROL.search(t):
                out.append(self.encode([t])[0])
                continue
            if len(known) > CACHED:
                known.clear()
            out.append(b"".join(map(known.__getitem__, unicodedata.normalize("NFC", t).lower().split())))
        return out


def byte_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE with word ends, as bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    ranks = {}
    for token, k in vocab.items():
        if token.startswith("<|"):
            continue
        body = token.removesuffix("</w>")
        ranks[bytes(map(byte.__getitem__, body)) + (_END if body != token else b"")] = k
    return ranks


_TOKENIZERS: dict[int, WordTokenizer] = {}


def tokenizer(raw: bytes) -> WordTokenizer:
    """One for each Python worker."""
    key = zlib.crc32(raw)
    if key not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[key] = WordTokenizer(raw)
    return _TOKENIZERS[key]


class Packer:
    """Places segments (key, start, length, loss) into sequences under the three limits."""

    def __init__(self, limit=LIMIT, segments=SEGMENTS, loss=None, open_bins=OPEN, first_id=0):
        self.limits = np.array([limit, segments, loss or limit], float)
        self.limit, self.open_bins, self.next_id = limit, open_bins, first_id
        self.free = np.zeros((0, 3))
        self.bins: list[list[tuple]] = []

    def _new(self) -> int:
        return (self.next_id, setattr(self, "next_id", self.next_id + 1))[0]

    def _close(self, k: int):
        placed = self.bins.pop(k)
        free = int(self.free[k][0])
        self.free = np.delete(self.free, k, 0)
        if free:
            yield from self._tail(placed, self.limit - free)
        else:
            yield self._new(), placed

    def add(self, key, start: int, length: int, loss: int):
        """Yields (sequence id, segments) of those that are done. loss: loss-bearing tokens, the last of the segment."""
        while length >= self.limit and loss <= self.limits[2] or loss > self.limits[2]:
            take = min(self.limit, length)
            take_loss = max(0, loss - (length - take))
            while take_loss > self.limits[2]:
                take -= take_loss - int(self.limits[2])
                take_loss = max(0, loss - (length - take))
            yield from self._tail([(key, start, take, take_loss)], take)
            start, length, loss = start + take, length - take, loss - take_loss
        if not length:
            return
        need = np.array([length, 1, loss], float)
        if len(self.bins):
            fits = np.flatnonzero((self.free >= need).all(axis=1))
            if len(fits):
                k = fits[np.argmax(((self.free[fits] / self.limits) * (need / self.limits)).sum(axis=1))]
                self.free[k] -= need
                self.bins[k].append((key, start, length, loss))
                if self.free[k][0] < 1 or self.free[k][1] < 1:
                    yield from self._close(k)
                return
        if len(self.bins) >= self.open_bins:
            k = int(np.argmin(self.free[:, 0]))
            take = min(length - 1, int(self.free[k][0]))
            take_loss = max(0, loss - (length - take))
            if take > 0 and self.free[k][1] >= 1 and take_loss <= self.free[k][2]:
                self.bins[k].append((key, start, take, take_loss))
                self.free[k] -= [take, 1, take_loss]
                start, length, loss = start + take, length - take, loss - take_loss
            yield from self._close(k)
        self.bins.append([(key, start, length, loss)])
        self.free = np.vstack([self.free, self.limits - [length, 1, loss]])

    def end(self):
        """Merges what is open into full sequences; the last one ends in powers of two."""
        left = sorted((s for b in self.bins for s in b), key=lambda s: -s[2])
        self.bins, self.free = [], np.zeros((0, 3))
        now, tokens, loss_sum = [], 0, 0
        for key, start, length, loss in left:
            while length:
                take = min(length, self.limit - tokens)
                take_loss = max(0, loss - (length - take))
                if len(now) >= self.limits[1] or take_loss + loss_sum > self.limits[2]:
                    yield from self._tail(now, tokens)
                    now, tokens, loss_sum = [], 0, 0
                    continue
                now.append((key, start, take, take_loss))
                tokens, loss_sum, start, length, loss = tokens + take, loss_sum + take_loss, start + take, length - take, loss - take_loss
                if tokens == self.limit:
                    yield self._new(), now
                    now, tokens, loss_sum = [], 0, 0
        yield from self._tail(now, tokens)

    def _tail(self, segments, tokens):
        """Cuts tokens of one sequence at powers of two; a full one stays whole."""
        at = 0
        segments = list(segments)
        while tokens:
            room = tokens if tokens == self.limit else 1 << (tokens.bit_length() - 1)
            tokens -= room
            out = []
            while room:
                key, start, length, loss = segments[at]
                take = min(room, length)
                take_loss = max(0, loss - (length - take))
                out.append((key, start, take, take_loss))
                room -= take
                if take == length:
                    at += 1
                else:
                    segments[at] = (key, start + take, length - take, loss - take_loss)
            yield self._new(), out


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", limit: int = LIMIT, segments: int = SEGMENTS, loss_limit: int | None = None, prompt_tokens: str | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence.

    prompt_tokens names a column with the number of leading tokens that bear no
    loss (none if not given).  The tokenizer's file is read on the driver and
    sent along: its size doesn't depend on the data.
    """
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    small_batches(docs.sparkSession)
    closing = CLOSING_ID.to_bytes(4, "little")

    def run(batches):
        words = tokenizer(raw)
        packer = Packer(limit, segments, loss_limit, first_id=(TaskContext.get().partitionId() if TaskContext.get() else 0) << 34)
        held: dict[int, tuple] = {}  # documents with tokens in open sequences: id, ids, tokens not yet out
        rows: list[tuple] = []

        def out(done):
            for sequence, parts in done:
                offset = 0
                for key, start, length, loss in parts:
                    doc, ids, left = held[key]
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset, loss))
                    offset += length
                    if left == length:
                        del held[key]
                    else:
                        held[key] = (doc, ids, left - length)

        def flush(like):
            cols = list(zip(*rows)) if rows else [[]] * 8
            batch = pa.RecordBatch.from_arrays([pa.array(cols[0], like), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])
            rows.clear()
            return batch

        number, kind = 0, pa.int64()
        for b in batches:
            kind = b.column(0).type
            prompts = b.column(2).to_pylist()
            for doc, ids, prompt in zip(b.column(0).to_pylist(), words.ids([t or "" for t in b.column(1).to_pylist()]), prompts):
                ids += closing
                n = len(ids) // 4
                held[number] = (doc, ids, n)
                out(packer.add(number, 0, n, n - min(n, prompt or 0)))
                number += 1
            yield flush(kind)
        out(packer.end())
        yield flush(kind)

    kind = docs.schema[id_col].dataType.simpleString()
    prompt = F.col(prompt_tokens).cast("bigint") if prompt_tokens else F.lit(0).cast("bigint")
    out = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), prompt.alias("prompt")).mapInArrow(run, f"id {kind}, {PIECES}")
    return out.withColumnRenamed("id", id_col)
