"""Delta Lloyd against plain rounds over all vectors and all centroids."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import delta_lloyd

SCHEMA = "vec_id bigint, embedding array<float>, label int, owner string, q int, distance string, n string"


def plain(rows, width, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    ends = [(i, *nearest(v)) for i, v in kept]
    per = Counter()
    for _, d, j in ends:
        per[j] += d
    return [(i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in ends]


def as_floats(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def odd_rows(width, n=300, seed=3):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss((k % 5) / 4, 0.2) for _ in range(width)]) for k in range(n)]
    rows += [rows[4], rows[4], (5, rows[9][1])] + [(1000 + k, rows[7][1]) for k in range(150)]
    rows += [(None, rows[3][1]), (2000, None), (2001, [0.5] * (width - 1)), (2002, [0.5] * (width - 1) + [None]), (2003, [float("nan")] * width), (2004, [float("inf")] * width), (2005, []), (2006, [-0.0] * width), (2007, [1000.5] * width)]
    return [(i, as_floats(v)) for i, v in rows]


@pytest.mark.parametrize("width,n", [(64, 300), (3, 400), (2, 20)])
def test_equals_plain_rounds(spark, width, n):
    rows = odd_rows(width, n)
    df = spark.createDataFrame([(i, v, 1, "o", 2, "d", "n") for i, v in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in delta_lloyd.inertias(df, width=width).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows, width), key=repr)


def test_ties_go_to_the_smaller_number_and_few_vectors_start_all(spark):
    rows = [(k, as_floats([float(k % 4 // 2), float(k % 2)])) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    for k in (1, 2, 3, 40):
        assert sorted(tuple(r) for r in delta_lloyd.inertias(df, width=2, k=k).collect()) == sorted(plain(rows, 2, k))


def test_no_vectors_and_components_too_large(spark):
    none = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id bigint, embedding array<double>")
    got = delta_lloyd.inertias(none)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="beyond"):
        delta_lloyd.inertias(spark.createDataFrame([(1, [1e30, 1.0])], "vec_id bigint, embedding array<double>"), width=2).collect()


def test_large_integers_stay_exact():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-(1 << 26), 1 << 26, (9, 64)), rng.integers(-(1 << 26), 1 << 26, (4, 64))
    assert delta_lloyd.squares(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]


def test_only_changed_centroids_are_compared():
    rng = np.random.default_rng(2)
    v, c = rng.integers(-300, 300, (200, 64)), rng.integers(-300, 300, (8, 64))
    owner, distance = delta_lloyd.reassign(v, np.full(200, -1), np.zeros(200, np.int64), c, np.arange(8))
    changed = np.array([1, 5])
    c2 = c.copy()
    c2[changed] += 7
    got = delta_lloyd.reassign(v, owner, distance, c2, changed)
    want = delta_lloyd.squares(v, c2)
    assert (got[0] == want.argmin(1)).all() and (got[1] == want.min(1)).all()
