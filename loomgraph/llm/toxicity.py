"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The training folds are dealt by hash of doc_id.  Each half learns a lexicon
(words and word stems whose documents are toxic far more often than chance
allows) that makes the features of the other half, so no document is described
by what it taught; three quarters fit the trees and one the calibration.  Features: lexicon
densities, hits close to the second person, capitals, punctuation, and the rate
of obfuscated words and of lexicon words found behind the obfuscation.

The sample is bounded by SAMPLE toxic and SAMPLE other labelled documents, those
with the least hash of doc_id; of an id with several texts the least is taken.  For the lexicon, copies within a label count
once, by the one of the least doc_id.  Trees and calibration weigh each label
by its labelled rows over its sampled ones, so the cut means the same at any size.  Scoring is
one map over the scan with no shuffle; the lexicon has at most LEXICON units.

Null and empty texts have no words and get the score of such a text.  Without
labels of both kinds every score is the share of toxic ones.
"""

from __future__ import annotations

import re
from collections import Counter
from math import lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_texts, small_batches, spill
from .learn import Isotonic, Trees, sigmoid

SAMPLE = 6000
LEXICON = 5000
#: Toxic documents that a unit of the lexicon needs.
LEAST = 4
STEMS = (4, 5, 6)
CUT = 0.5
NEAR = 5
CACHED = 300_000
#: Words of a shingle and seeds of its hashes, all of whose least values copies share.
SHINGLE, SEEDS = 3, 4
#: Second-person words of the languages served.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ustedes ti tus vosotros".split())
#: Characters that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
WORDS = re.compile(r"[^\W_]+(?:[@$!*|.'_\-]+[^\W_]+)*|[^\W_]*[@$!*|][^\W_]*")
_DOUBLE = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[@$!*|._\-]")
_LETTER = re.compile(r"[^\W\d_]")
FEATURES = 16


def units(word: str):
    """The lexicon units of a word: itself and its stems."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield f"{word[:n]}~"


def plain(word: str) -> str:
    """What is read behind look-alike characters, fillers and drawn-out letters."""
    return _DOUBLE.sub(r"\1", _INNER.sub("", word.translate(LEET)))


class _Tokens(dict):
    """What a token as written adds to the features: None for most, which add nothing."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str):
        get = self.lexicon.get
        as_is = behind = odd = 0.0
        second = False
        for word in WORDS.findall(token.lower()):
            as_is = max(as_is, *(get(u, 0.0) for u in units(word)))
            strange = not word.isalpha() and not word.isdigit() and bool(_LETTER.search(word))
            odd = max(odd, float(strange))
            second |= word in SECOND_PERSON
            if strange or _DOUBLE.search(word):
                behind = max(behind, *(get(u, 0.0) for u in units(plain(word))))
        behind = 0.0 if as_is else behind
        upper = token.isupper()
        letter = token.strip(".-_*").lower()
        letter = letter if len(letter) == 1 and letter.isalpha() else ""
        found = (as_is, behind, odd, second, upper, letter) if as_is or behind or odd or second or upper or letter else None
        self[token] = found
        return found


class Features:
    """Dense features of whole texts, given a lexicon {unit: log-odds}."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.tokens = lexicon, _Tokens(lexicon)

    def __getstate__(self):
        return self.lexicon

    def __setstate__(self, lexicon):
        self.__init__(lexicon)

    def spelled(self, at: list[tuple[int, str]]) -> int:
        """Lexicon words spelled in single letters one after another."""
        found, run, last = 0, "", -2
        for k, letter in [*at, (-9, "")]:
            if k != last + 1:
                found += any(u in self.lexicon for i in range(len(run) - 3) for u in units(run[i:]))
                run = ""
            run, last = run + letter, k
        return found

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * FEATURES
        if len(self.tokens) > CACHED:
            self.tokens.clear()
        told = [(k, v) for k, v in enumerate(map(self.tokens.__getitem__, words)) if v is not None]
        hits = np.array([k for k, v in told if v[0]], int)
        second = np.array([k for k, v in told if v[3]], int)
        total, most = sum(v[0] for _, v in told), max((v[0] for _, v in told), default=0.0)
        behind = sum(v[1] > 0 for _, v in told) + self.spelled([(k, v[5]) for k, v in told if v[5]])
        near = 0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(hits - second[np.minimum(at, len(second) - 1)]), np.abs(hits - second[np.maximum(at - 1, 0)]))
            near = int((gap <= NEAR).sum())
        count = max(1, len(hits))
        return [
            len(hits) / n, total / n, np.log1p(len(hits)), most, len({words[k] for k in hits}) / count, near / n, near / count, len(second) / n,
            sum(v[4] for _, v in told) / n, text.count("!") / n, text.count("?") / n, (text.count(",") + text.count(".")) / n, sum(v[2] for _, v in told) / n, behind / n, np.log1p(behind), np.log1p(n),
        ]


def _tail(a: int, n: int, p: float) -> float:
    """log10 of the chance of a or more of n under p, by its largest term."""
    if a <= n * p:
        return 0.0
    return (lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1) + a * log(p) + (n - a) * log(1 - p)) / log(10)


def learn_lexicons(sample: DataFrame, text: str = "text", half: str = "half", size: int = LEXICON) -> list[dict[str, float]]:
    """sample: bounded (text, label, half).  Units whose documents are toxic beyond chance, in half 0, half 1 and both."""

    def run(batches):
        counts = [Counter() for _ in range(4)]
        for b in batches:
            for t, y, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                counts[2 * h + y].update({u for w in set(WORDS.findall((t or "").lower())) for u in units(w)})
        # units of no toxic document here may be so elsewhere, so all are sent; the sample bounds them
        names = list(set().union(*counts))
        for at in range(0, len(names), 20_000):
            part = names[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([c[u] for u in part], pa.int64()) for c in counts]], names=["unit", "b0", "a0", "b1", "a1"])

    totals = {(r["label"], r[half]): r["n"] for r in sample.groupBy("label", half).agg(F.count("*").alias("n")).collect()}
    found = sample.select(text, "label", half).mapInArrow(run, "unit string, b0 bigint, a0 bigint, b1 bigint, a1 bigint").groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("a0", "b0", "a1", "b1")])
    rows = found.filter(F.col("a0") + F.col("a1") >= LEAST).orderBy(F.desc(F.col("a0") + F.col("a1") - F.col("b0") - F.col("b1")), "unit").limit(8 * size).collect()
    out = []
    for halves in ((0,), (1,), (0, 1)):
        a_all, b_all = (sum(totals.get((y, h), 0) for h in halves) for y in (1, 0))
        out.append(_chosen([(r["unit"], sum(r[f"a{h}"] for h in halves), sum(r[f"b{h}"] for h in halves)) for r in rows], a_all, b_all, size))
    return out


def _chosen(rows: list[tuple[str, int, int]], a_all: int, b_all: int, size: int) -> dict[str, float]:
    if not a_all or not b_all:
        return {}
    base = a_all / (a_all + b_all)
    found = {u: (a, log((a + 0.5) / (a_all + 1)) - log((b + 0.5) / (b_all + 1))) for u, a, b in rows if a >= LEAST and a * b_all > 4 * b * a_all and _tail(a, a + b, base) < -2.5}
    found = dict(sorted(found.items(), key=lambda x: (-x[1][1], x[0]))[:size])
    short = _too_short(found)
    return {u: v[1] for u, v in found.items() if u not in short}


def _too_short(found: dict) -> set[str]:
    """Stems that say no more than a longer unit: nearly all their documents are that unit's."""
    out = set()
    for unit, (a, _) in found.items():
        whole = not unit.endswith("~")
        body = unit.rstrip("~")
        for n in STEMS[:1] if whole else STEMS:
            short = f"{body[:n]}~"
            if n < len(body) and short in found and a >= 0.95 * found[short][0]:
                out.add(short)
    return out


def _key(text: str | None) -> bytes:
    """Least hashes of the shingles of three words under four seeds: true copies share all, near ones mostly."""
    words = (text or "").encode().split()
    shingles = {b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}
    return b"".join(min(xxhash.xxh64_digest(g, seed) for g in shingles) for seed in range(1, SEEDS + 1))


def without_copies(rows: DataFrame, text: str = "text", label: str = "label", id_col: str = "doc_id") -> DataFrame:
    """rows with one of each set of copies within a label: that of the least id_col."""
    small_batches(rows.sparkSession)
    at = rows.columns.index(text)

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_key(t) for t in b.column(at).to_pylist()], pa.binary())], names=[*b.schema.names, "_key"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    first = Window.partitionBy(label, "_key").orderBy(id_col, F.xxhash64(text))
    return rows.mapInArrow(keys, f"{kinds}, _key binary").withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_key", "_rn")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Bounded (id_col, text, label, weight) of the training folds; weight is how many labelled rows of its label a row stands for."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")).filter((fold(F.col("_id")) != 0) & F.col("label").isin(0, 1)).distinct()
    first = lambda y: known.filter(F.col("label") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    stands = lambda y: first(y).withColumn("weight", F.lit(max(1.0, count.get(y, 0) / sample)))
    chosen = stands(1).unionByName(stands(0))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    # one text for each id and label, so repeated ids can't grow the sample
    once = slim.join(F.broadcast(chosen), F.col("id") == F.col("_id")).groupBy("id", "label", "weight").agg(F.min("text").alias("text"))
    return once.select(F.col("id").alias(id_col), "text", "label", "weight")


class ToxicModel:
    def __init__(self, lexicon: dict[str, float]):
        self.features, self.trees, self.calibrate, self.rate = Features(lexicon), None, None, 0.0
        #: Documents of the sample, and those left for the lexicon without copies.
        self.sampled = self.learned = 0

    def fit(self, x, y, w, x_cal, y_cal, w_cal) -> ToxicModel:
        self.rate = float(np.average(y, weights=w)) if len(y) else 0.0
        if len(set(y.tolist())) < 2:
            return self
        self.trees = Trees().fit(x, y, w)
        if len(y_cal):
            self.calibrate = Isotonic(self.trees.margin(x_cal), y_cal, w_cal)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        z = self.trees.margin(x)
        raw = sigmoid(z)
        # a grain of the raw score keeps the order inside a calibrated pool
        return raw if self.calibrate is None else np.clip(0.999 * self.calibrate(z) + 0.001 * raw, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> ToxicModel:
    small_batches(docs.sparkSession)
    part = F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(8))
    rows = labelled_sample(docs, labels, label, text, id_col, sample).withColumn("part", part).withColumn("half", (part % 2).cast("int"))
    rows = spill(rows, "toxic-sample")

    once = spill(without_copies(rows, "text", "label", id_col), "toxic-once")
    of_half = learn_lexicons(once.select("text", "label", "half"))
    model = ToxicModel(of_half[2])
    model.sampled, model.learned = rows.count(), once.count()
    # the features of each half are made with the lexicon of the other
    other = [Features(of_half[1]), Features(of_half[0])]

    def run(batches):
        for b in batches:
            x = [other[h](t) for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(x, pa.list_(pa.float64()))], names=[*b.schema.names[2:], "x"])

    got = rows.select("text", "half", id_col, "part", "label", "weight").mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, part bigint, label int, weight double, x array<double>").collect()
    got = sorted(got, key=lambda r: (r[id_col], r["label"], r["x"]))
    column = lambda name, parts: np.array([r[name] for r in got if r["part"] in parts], float)
    take = lambda parts: (column("x", parts).reshape(-1, FEATURES), column("label", parts), column("weight", parts))
    return model.fit(*take(range(6)), *take((6, 7)))


def score(docs: DataFrame, model: ToxicModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns and score for every row."""
    rows = lambda texts: [pa.array(model(np.array([model.features(t) for t in texts], float).reshape(-1, FEATURES)), pa.float64())]
    return map_texts(docs, text, carry, rows, [("score", T.DoubleType())])


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", cut: float = CUT) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs."""
    scored = score(docs, fit(docs, labels, text, id_col), text, (id_col,))
    return scored.select(id_col, F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
