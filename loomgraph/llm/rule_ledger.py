"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger stores its
measurements and one bit for each rule it fails.  Policies are versions of a
mask: a document is kept if no bit of the policy's mask is set.  Ablations (what
each rule rejects, alone and first) come from bitwise aggregation of the ledger
and never touch a text again.

Scale: one map over the scan, no shuffle; ablations shuffle one row a partition.

Null and empty texts have no words and fail the base rules.  Documents are
measured whole, whatever their length; equal rows are measured alike.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, map_texts

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words", "n_upper_words", "n_alpha_words")

#: Rules in the order of their bits: name and the SQL condition of a failure.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "100 * n_symbols > 15 * n_words"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("upper_case", "n_words > 0 and 100 * n_upper_words > 60 * n_words"),
    ("few_letters", "n_words > 0 and 100 * n_alpha_words < 60 * n_words"),
    ("little_variety", "n_words >= 50 and 100 * n_unique_words < 8 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versions of the policy: a mask each.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": BIT["few_words"] | BIT["repeated_words"] | BIT["many_symbols"] | BIT["word_length"] | BIT["duplicate_lines"],
    "v2": (1 << len(RULES)) - 1,
}
CURRENT = "v2"


_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
#: Odd factors of the rolling hash that finds candidates for repeated windows.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that the text has twice or more.

    Equal windows have equal hashes; windows of equal hash are then compared as they are.
    """
    if len(words) <= WINDOW:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - WINDOW + 1
    rolling = sum(codes[k : k + n] * _FACTORS[k] for k in range(WINDOW))
    order = np.argsort(rolling, kind="stable")
    same = rolling[order[1:]] == rolling[order[:-1]]
    if not same.any():
        return 0
    at = np.unique(np.r_[order[1:][same], order[:-1][same]]).tolist()
    windows = [tuple(words[k : k + WINDOW]) for k in at]
    counts = Counter(windows)
    repeat = reach = 0  # words before reach are counted
    for k, w in zip(at, windows):
        if counts[w] > 1:
            repeat += k + WINDOW - max(reach, k)
            reach = k + WINDOW
    return repeat


def measure_words(text: str | None) -> tuple[tuple[int, ...], bytes, list[bytes]]:
    """The measurements of a whole text, its bytes and its words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    dup, n_lines = 0, int(n > 0)
    if b"\n" in raw:
        lines = Counter(raw.split(b"\n"))
        if len(lines) == 1 + raw.count(b"\n"):
            n_lines = sum(1 for line in lines if line and not line.isspace())
        else:
            kept = [k for line, k in lines.items() if line.split()]
            dup, n_lines = sum(kept) - len(kept), sum(kept)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    upper = sum(map(bytes.isupper, words))
    bare = sum(1 for w in words if not w.isalpha() and not _LETTER.search(w))
    return (n, chars, symbols, dup, repeated_words(words), n_lines, len(set(words)), upper, n - bare), raw, words


def measure(text: str | None) -> tuple[int, ...]:
    return measure_words(text)[0]


def _failures() -> F.Column:
    bits = F.lit(0).cast("bigint")
    for name, rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0).cast("bigint"))
    return bits


def ledger(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, the measurements and failures, a bit for each rule failed."""
    return map_texts(docs, text, carry, _measures, _FIELDS).withColumn("failures", _failures())


_FIELDS = [(m, T.LongType()) for m in MEASURES]


def _measures(texts: list) -> list[pa.Array]:
    return [pa.array(c, pa.int64()) for c in list(zip(*map(measure, texts))) or [()] * len(MEASURES)]


def verdict(failures: F.Column, policy: str = CURRENT) -> F.Column:
    return failures.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(ledger_rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(policy, rule, fails, fails_alone, kept_without): what each rule of the policy does."""
    mask = POLICIES[policy]
    masked = F.col("failures").bitwiseAND(F.lit(mask))
    # at most one row for each set of failed rules: bounded by 2 ** rules
    sets = ledger_rows.groupBy(masked.alias("failed")).agg(F.count("*").alias("n"))
    stacked = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("bigint").alias("bit")) for name, _ in RULES if BIT[name] & mask])
    rows = sets.select("failed", "n", F.explode(stacked).alias("r"))
    has = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("failed") == F.col("r.bit")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return rows.groupBy(F.lit(policy).alias("policy"), F.col("r.rule").alias("rule")).agg(count(has).alias("fails"), count(alone).alias("fails_alone"), count((F.col("failed") == 0) | alone).alias("kept_without"))


def quality_report(docs: DataFrame, text: str = "text", id_col: str = "doc_id", policy: str = CURRENT) -> DataFrame:
    """(id_col, measurements, failures, base_failed, kept)."""
    rows = ledger(docs, text, (id_col,))
    failed = ~verdict(F.col("failures"), "base")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(F.col("failures"), policy))


def keep(docs: DataFrame, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows of docs that pass the base rules and the policy, with the columns of docs."""
    rows = map_rows(docs, text, _measures, _FIELDS).withColumn("failures", _failures())
    return rows.filter(verdict(F.col("failures"), "base") & verdict(F.col("failures"), policy)).select("row.*")
