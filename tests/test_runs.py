"""Next-fit and folded shards over ranges: equal to the sequential rules, with one group over many tasks."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import packing, runs


def plain_fit(sizes, target):
    batch, filled, out = 0, 0, []
    for n in sizes:
        if filled and filled + n > target:
            batch, filled = batch + 1, 0
        out.append(batch)
        filled += n
    return out


def test_next_fit_over_ranges(spark):
    rng = random.Random(3)
    counts = [("big", f"f{k:05d}", rng.choice([0, 1, 1, 2, 3, 9, 20])) for k in range(3000)] + [(None if g == 7 else f"g{g}", f"f{k:02d}", rng.randint(1, 9)) for g in range(40) for k in range(rng.randint(1, 6))] + [("g1", None, 3)]
    df = spark.createDataFrame(counts, "level string, file string, n bigint").repartition(5)
    for target in (1, 8, 40):
        got = {(r["level"], r["file"]): r["batch"] for r in runs.next_fit(df, target, "level", "file").collect()}
        want = {}
        for g in {c[0] for c in counts}:
            own = sorted((c for c in counts if c[0] == g), key=lambda c: (c[1] is None, c[1] or ""))
            want |= {(g, c[1]): b for c, b in zip(own, plain_fit([c[2] for c in own], target))}
        assert got == want
    assert runs.next_fit(df.limit(0), 8, "level", "file").count() == 0


def test_a_group_of_many_files_is_packed_on_many_tasks(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("g").alias("level"), F.format_string("%08d", "id").alias("file"), (F.col("id") * 7 % 5 + 1).alias("n"))
    assert runs.ranged(df, [F.col("level")], [F.col("file")], "t").select("part").distinct().count() > 1
    got = [r["batch"] for r in runs.next_fit(df, 8, "level", "file").orderBy("file").select("batch").collect()]
    assert got == plain_fit([k * 7 % 5 + 1 for k in range(n)], 8)


def plain_fold(rows):
    bare, out = {}, {}
    for key, file, rec in rows:
        if key in bare and bare[key][0] != file:
            for f, r in (bare.pop(key), (file, rec)):
                stem = (f or "").split("/")[-1].rsplit(".", 1)[0]
                out[f"{stem}.{key}" if stem else key] = (f, r)
        else:
            bare[key] = (file, rec)
    return sorted((k, *v) for k, v in {**out, **bare}.items())


def test_a_key_of_many_records_is_folded_on_many_tasks(spark):
    rng = random.Random(9)
    rows = [("hot", rng.choice(["x/A.py", "B.py", "C", "A.txt"]), f"r{k}") for k in range(20_000)] + [(f"k{rng.randint(0, 300)}", rng.choice(["A.py", "B.py"]), f"s{k}") for k in range(2000)] + [("same", "A.py", f"t{k}") for k in range(5000)]
    rng.shuffle(rows)
    held = [(f"s{k // 1000:03d}", k % 1000, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(held, "shard string, pos int, key string, file string, rec string").repartition(6)
    assert sorted(map(tuple, packing.merge_shards(df).collect())) == plain_fold(rows)
    nested = df.select("shard", "pos", "key", "file", F.struct(F.col("rec").alias("v"), F.array("pos").alias("p")).alias("rec"))
    assert sorted((r["key"], r["file"], r["rec"]["v"]) for r in packing.merge_shards(nested).collect()) == plain_fold(rows)
