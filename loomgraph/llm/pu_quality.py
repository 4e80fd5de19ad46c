"""Quality classifier by positive-unlabelled learning.

Trusted positives (labels.quality = 1) and unlabelled web text train a linear
model of least non-negative unbiased risk; the class prior among the unlabelled
is estimated first, from the scores of a plain positive-against-unlabelled
model.  No label of a bad document is ever used.

The sample is bounded: SAMPLE trusted positives and SAMPLE unlabelled documents
of the training folds, those with the least hash of doc_id, so it is the same
in every run; of an id with several texts the least one is taken.  Everything else covers all rows: scoring is one map over the
scan with no shuffle.

Null and empty texts are scored as texts of no words.  If there is no positive
to learn from, every score is the neutral 0.5.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_rows, map_texts
from .learn import Scaler, class_prior, fit_logistic, fit_nnpu, sigmoid
from .rule_ledger import measure_words

SAMPLE = 6000
CUT = 0.3
FEATURES = 15


def features(text: str | None) -> list[float]:
    """Dense shape features of one whole text; none reads its source, language or id."""
    (n, chars, symbols, dup, repeat, lines, unique, upper, alpha), raw, words = measure_words(text)
    if not n:
        return [0.0] * (FEATURES - 1) + [1.0]
    marks = len(raw) - len(raw.translate(None, MARKS))
    stops = raw.count(b".") + raw.count(b"?") + raw.count(b"\n")
    return [
        np.log1p(n), min(2.0, symbols / n) ** 0.5, (repeat / n) ** 0.5, (sum(map(eq, words, words[1:])) / n) ** 0.5, unique / n, upper / n, 1 - alpha / n,
        min(30.0, chars / n), dup / max(lines, 1), min(2.0, raw.count(b"!") / n) ** 0.5, min(2.0, raw.count(b"|") / n) ** 0.5, min(2.0, marks / n), min(1.0, stops / n), min(2.0, lines / n), 0.0,
    ]


MARKS = b".,;:?!\"'()-"


def feature_rows(docs: DataFrame, carry: tuple[str, ...], text: str = "text") -> DataFrame:
    rows = lambda texts: [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]
    return map_texts(docs, text, carry, rows, [("x", T.ArrayType(T.DoubleType()))])


class QualityModel:
    """A score from 0 to 1 for feature rows; fits nothing but numbers of FEATURES each."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        self.scaler = self.weights = None
        self.prior = 0.5
        if len(positive) < 2 or len(unlabelled) < 2:
            return
        self.scaler = Scaler(positive)
        p, u = self.scaler(positive), self.scaler(unlabelled)
        guess = fit_logistic(np.r_[p, u], np.r_[np.ones(len(p)), np.zeros(len(u))])
        z = lambda x: np.c_[x, np.ones(len(x))] @ guess
        self.prior = class_prior(z(p), z(u))
        self.weights = fit_nnpu(p, u, self.prior)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        # row by row, so a score doesn't depend on the batch it is made in
        return sigmoid((self.scaler(x) * self.weights[:-1]).sum(axis=1) + self.weights[-1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("body"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    train = fold(F.col("id")) != 0
    first = lambda df, role: df.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("chosen"), F.lit(role).alias("role"))
    chosen = first(known.filter(train & (F.col("label") == 1)).select("id").distinct(), 1).unionByName(first(slim.filter(train).select("id").distinct(), 0))
    # at most twice `sample` short rows, and one text for each
    picked = slim.join(F.broadcast(chosen), F.col("id") == F.col("chosen")).groupBy("id", "role").agg(F.min("body").alias("body"))
    rows = sorted(feature_rows(picked, ("id", "role"), "body").collect(), key=lambda r: (r["id"], r["role"]))
    split = lambda role: np.array([r["x"] for r in rows if r["role"] == role], float).reshape(-1, FEATURES)
    return QualityModel(split(1), split(0))


def _scores(model: QualityModel):
    return lambda texts: [pa.array(model(np.array([features(t) for t in texts], float).reshape(-1, FEATURES)), pa.float64())]


def score(docs: DataFrame, model: QualityModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns and score for every row."""
    return map_texts(docs, text, carry, _scores(model), [("score", T.DoubleType())])


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", cut: float = CUT) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs."""
    scored = score(docs, fit(docs, labels, text, id_col), text, (id_col,))
    return scored.select(id_col, F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", cut: float = CUT) -> DataFrame:
    """The rows of docs whose score reaches the cut, with the columns of docs."""
    scored = map_rows(docs, text, _scores(fit(docs, labels, text, id_col)), [("score", T.DoubleType())])
    return scored.filter(F.col("score") >= cut).select("row.*")
