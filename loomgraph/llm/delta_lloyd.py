"""Clustering of vectors around centroids by Lloyd rounds that carry only changes.

Components become integers, so every sum and distance is exact.  The state holds
each vector's owner and the square of its distance; beside it stand the sum and
the number of vectors of every cluster.  A round looks at the centroids that
changed in the update before it: a vector whose own centroid stayed is compared
with the changed ones only, one whose centroid moved with all.  Vectors that go
from one owner to another add a signed integer transfer to both clusters; a task
sums its transfers and adds a row for each cluster it touched to what it writes,
so a round is one map and a sum of at most k rows a task.  Nothing else is shuffled.

Scale: tasks hold a batch of vectors and k centroids.  A common vector is no key
of anything.  A round's state ends its lineage in the shared folder.

Vectors with another number of components, or with a null, NaN or infinite one,
are left out, as are null vectors.  Repeated rows count as often as they come;
a null id is kept and starts no centroid while others are left.  Fewer vectors than k
start as many centroids as there are.  Components beyond LARGEST can't be held
exactly and fail the job.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spill

WIDTH, CENTROIDS, ROUNDS = 64, 40, 5
#: A component x becomes floor(STEPS * x).
STEPS, SEED = 256.0, 2
#: Integer components beyond this would let squared distances leave a long.
LARGEST = 1 << 27
#: Up to this, sums of products stay below 2**53 and doubles are exact.
EXACT = 1 << 22
BATCH = 1 << 13

STATE = "q array<int>, owner int, distance bigint, n bigint, shift array<bigint>"


def quantised(vectors: DataFrame, id_col: str, vector: str, width: int) -> DataFrame:
    """(vec_id, q) of the vectors that are whole and finite."""
    v = F.col(vector)
    whole = v.isNotNull() & (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    step = lambda x: F.floor(F.lit(STEPS) * x.cast("double"))
    fits = F.forall(v, lambda x: F.abs(F.lit(STEPS) * x.cast("double")) < LARGEST)
    q = F.when(fits, F.transform(v, lambda x: step(x).cast("int"))).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} steps")))
    return vectors.filter(whole).select(F.col(id_col).alias("vec_id"), q.alias("q"))


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of v to rows of c, as exact integers."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = v.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], axis=1)


def reassign(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the changed centroids moved.  owner -1: none yet.  Ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    moved = (owner < 0) | np.isin(owner, changed)
    if moved.any():
        d = squares(v[moved], centroids)
        owner[moved] = d.argmin(1)
        distance[moved] = d.min(1)
    stayed = np.flatnonzero(~moved)
    if len(stayed) and len(changed):
        d = squares(v[stayed], centroids[changed])
        at, least = changed[d.argmin(1)], d.min(1)
        better = (least < distance[stayed]) | (least == distance[stayed]) & (at < owner[stayed])
        owner[stayed[better]], distance[stayed[better]] = at[better], least[better]
    return owner, distance


def _round(centroids: np.ndarray, changed: np.ndarray, width: int):
    names = ["vec_id", "q", "owner", "distance", "n", "shift"]
    k = len(centroids)

    def run(batches):
        kind, sums, counts = None, np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            kind = b.column(0).type
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
            was = b.column(2).to_numpy(zero_copy_only=False)
            now, distance = reassign(v, was, b.column(3).to_numpy(zero_copy_only=False), centroids, changed)
            moved = now != was
            np.add.at(sums, now[moved], v[moved])
            np.add.at(counts, now[moved], 1)
            left = moved & (was >= 0)
            np.subtract.at(sums, was[left], v[left])
            np.subtract.at(counts, was[left], 1)
            none = pa.nulls(len(now))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(now, pa.int32()), pa.array(distance, pa.int64()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))], names=names)
        touched = np.flatnonzero((counts != 0) | (sums != 0).any(1))
        if len(touched):
            none = pa.nulls(len(touched))
            yield pa.RecordBatch.from_arrays([none.cast(kind), none.cast(pa.list_(pa.int32())), pa.array(touched, pa.int32()), none.cast(pa.int64()), pa.array(counts[touched]), pa.array(sums[touched].tolist(), pa.list_(pa.int64()))], names=names)

    return run


def _transfers(state: DataFrame, width: int) -> list:
    """(owner, vectors more or less, sum more or less) of the clusters that a round touched: k rows at most."""
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = state.filter("n is not null").groupBy("owner").agg(F.sum("n").alias("n"), F.array(*[wide(F.col("shift")[i]) for i in range(width)]).alias("shift")).collect()
    return [(r["owner"], r["n"], list(map(int, r["shift"]))) for r in rows]


def starts(points: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids hash least; equal ids by their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["q"]) for r in points.orderBy(name.asc_nulls_last(), "q").limit(k).select("q").collect()]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", width: int = WIDTH, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(id_col, cluster, distance) of every vector kept, and the final centroids.

    distance is squared, in steps.  The centroids are k rows that the driver holds.
    """
    small_batches(vectors.sparkSession, BATCH)
    kind = vectors.schema[id_col].dataType.simpleString()
    points = spill(quantised(vectors, id_col, vector, width), "lloyd-points")
    centroids = starts(points, k, seed)
    if not centroids:
        none = points.select(F.col("vec_id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0)
        return none, []
    sums, counts = [[0] * width for _ in centroids], [0] * len(centroids)
    state = points.select("vec_id", "q", F.lit(-1).alias("owner"), F.lit(0).cast("bigint").alias("distance"))
    changed = list(range(len(centroids)))
    for _ in range(rounds):
        moved = state.mapInArrow(_round(np.array(centroids, np.int64), np.array(changed, np.int64), width), f"vec_id {kind}, {STATE}")
        written = spill(moved, "lloyd-round")
        for c, n, shift in _transfers(written, width):
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], shift)]
        new = [[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(len(centroids))]
        changed = [c for c in range(len(centroids)) if new[c] != centroids[c]]
        centroids = new
        state = written.filter("n is null").select("vec_id", "q", "owner", "distance")
    last = state.mapInArrow(_round(np.array(centroids, np.int64), np.array(changed, np.int64), width), f"vec_id {kind}, {STATE}")
    return last.filter("n is null").select(F.col("vec_id").alias(id_col), F.col("owner").alias("cluster"), "distance"), centroids


def _pick(values: list, at: Column, kind: str) -> Column:
    """The value with that number: a literal of k values."""
    return F.array(*[F.lit(v) for v in values])[at].cast(kind)


def inertias(vectors: DataFrame, id_col: str = "vec_id", **how) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept."""
    out, centroids = cluster(vectors, id_col, **how)
    if centroids:
        out = spill(out, "lloyd-owners")
    per = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    own = [per.get(c, 0) for c in range(len(names))]
    at = F.col("cluster")
    return out.select(id_col, "cluster", "distance", _pick(own, at, "bigint").alias("cluster_inertia"), F.lit(sum(own)).cast("bigint").alias("inertia"), _pick(names, at, "string").alias("centroid_sha256"))
