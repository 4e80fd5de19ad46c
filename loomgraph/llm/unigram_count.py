"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton enumerates, at each end, every vocabulary piece that
ends there.  The dynamic program carries two numbers, the best score and the
pieces of the best path, and never builds the pieces.  Its ties are the
tokenizer's own: positions are filled from the earliest start on and only a
strictly better score replaces an earlier one; a character that is no piece
costs the least score minus ten, and counts as its bytes where the vocabulary
has byte pieces.

The vocabulary is that of a public piece file, with its scores; scores are
whole numbers, so sums are exact in doubles on texts of any length.

Where no piece holds a word mark after another character (true of the file,
and checked), a best path never crosses the start of a word, so texts are cut
there and words counted once per worker.

Scale: one map over the scan, no shuffle; the automaton is built once for each
worker from the file's bytes, whose size doesn't depend on the data.  Null and
empty texts have no tokens.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
UNKNOWN_COST = 10.0
CACHED = 400_000


def read_pieces(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a sentencepiece file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(raw)
    return [(p.piece, p.score, p.type) for p in model.pieces]


NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class Counter:
    """Counts tokens; score_and_count gives the best score as well."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        normal = {}
        for piece, score, kind in pieces:
            if kind in (NORMAL, USER) and piece:
                normal[piece] = float(score)
        for piece, score in normal.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.least = min(normal.values(), default=0.0)
        self.bytes = sum(kind == BYTE for _, _, kind in pieces) == 256
        #: words can be counted alone
        self.apart = all(MARK not in piece.lstrip(MARK) for piece in normal)
        self.known: dict[str, tuple[float, int]] = {}

    def viterbi(self, text: str) -> tuple[float, int]:
        """Best score and pieces of a text, marks and all."""
        n = len(text)
        ends: list[list] = [[] for _ in range(n + 1)]
        singles = bytearray(n)
        for last, (length, score) in self.automaton.iter(text):
            ends[last + 1].append((last + 1 - length, score))
            if length == 1:
                singles[last] = 1
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        unknown_before = [False] * (n + 1)  # the best path here ends with an unknown character
        cost = self.least - UNKNOWN_COST
        for end in range(1, n + 1):
            top, pieces, unknown = None, 0, False
            for start, score in ends[end]:  # the automaton reports the longest first, so starts ascend
                got = best[start] + score
                if top is None or got > top:
                    top, pieces = got, count[start] + 1
            if not singles[end - 1]:
                got = best[end - 1] + cost
                if top is None or got > top:
                    top, unknown = got, True
                    # neighbours that are unknown fuse, unless they fall back to bytes
                    pieces = count[end - 1] + (len(text[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not unknown_before[end - 1]))
            best[end], count[end], unknown_before[end] = top, pieces, unknown
        return best[n], count[n]

    def score_and_count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        marked = MARK + text.replace(" ", MARK)
        if not self.apart:
            return self.viterbi(marked)
        known = self.known
        if len(known) > CACHED:
            known.clear()
        score, count = 0.0, 0
        for word in _WORDS.findall(marked):
            got = known.get(word)
            if got is None:
                got = known[word] = self.viterbi(word)
            score += got[0]
            count += got[1]
        return score, count


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

_COUNTERS: dict[int, Counter] = {}


def counter(raw: bytes) -> Counter:
    """One for each Python worker."""
    key = zlib.crc32(raw)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(read_pieces(raw))
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, pieces_path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, n_tokens and score (the best path's) for every row."""
    with open(pieces_path, "rb") as f:
        raw = f.read()
    small_batches(docs.sparkSession)

    def run(batches):
        count = counter(raw).score_and_count
        for b in batches:
            got = [count(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.float64())], names=[*b.schema.names[:-1], "n_tokens", "score"])

    picked = docs.select(*[F.col(c) for c in carry], F.col(text).alias("_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}n_tokens bigint, score double")
