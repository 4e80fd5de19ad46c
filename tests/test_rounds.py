"""Graph loops: few rounds on long chains, no shuffle of edges in a step, hubs aside, equal to plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, stored


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain(n, pairs):
    """(scc, level) of each node, by depth-first search without recursion."""
    out, into = [[] for _ in range(n)], [[] for _ in range(n)]
    for a, b in pairs:
        if a != b:
            out[a].append(b)
            into[b].append(a)
    order, seen = [], [False] * n
    for s in range(n):
        stack = [(s, 0)]
        while stack:
            v, k = stack.pop()
            if k == 0:
                if seen[v]:
                    continue
                seen[v] = True
            if k < len(out[v]):
                stack += [(v, k + 1), (out[v][k], 0)]
            else:
                order.append(v)
    scc = [-1] * n
    for s in reversed(order):
        if scc[s] < 0:
            part, stack = [], [s]
            scc[s] = s
            while stack:
                v = stack.pop()
                part.append(v)
                for u in into[v]:
                    if scc[u] < 0:
                        scc[u] = s
                        stack.append(u)
            for v in part:
                scc[v] = min(part)
    level = {}
    for v in order:  # what a node depends on comes before it, but for its own component
        c = scc[v]
        level[c] = max([level.get(c, 0)] + [level.get(scc[w], 0) + 1 for w in out[v] if scc[w] != c])
    for _ in range(3):
        for v in order:
            c = scc[v]
            level[c] = max([level[c]] + [level[scc[w]] + 1 for w in out[v] if scc[w] != c])
    return scc, [level[c] for c in scc]


def shapes():
    rng = random.Random(6)
    n = 60
    yield "random", n, [(rng.randrange(n), rng.randrange(n)) for _ in range(80)]
    yield "dense", 15, [(rng.randrange(15), rng.randrange(15)) for _ in range(60)]
    yield "cores on a string", 40, [(k, k + 1) for k in range(39)] + [(k + 3, k) for k in (0, 10, 20)] + [(k, k - 1) for k in range(25, 30)] + [(rng.randrange(40), rng.randrange(20, 40)) for _ in range(6)]
    yield "rings", 30, [(k, (k + 1) % 10) for k in range(10)] + [(10 + k, 10 + (k + 1) % 5) for k in range(5)] + [(3, 12), (14, 20), (20, 21), (21, 22), (22, 23)]
    yield "both ways", 40, [(k, k + 1) for k in range(30)] + [(k + 1, k) for k in range(30)] + [(35, 2), (36, 35)]
    yield "ladder", 12, [(k, k + 2) for k in range(10)] + [(k, k + 3) for k in range(0, 8, 2)] + [(k, k + 1) for k in range(1, 9, 2)]
    yield "tree", 63, [((k - 1) // 2, k) for k in range(1, 63)]
    yield "loops only", 5, [(k, k) for k in range(5)]


def test_components_and_levels_of_shapes(spark):
    """All shapes side by side in one graph."""
    n, pairs = 0, []
    for _, size, own in shapes():
        pairs += [(a + n, b + n) for a, b in own]
        n += size
    nodes, edges = spark.range(n), spark.createDataFrame(pairs, "a bigint, b bigint")
    scc, level = plain(n, pairs)
    got = {r["id"]: (r["level"], r["in_cycle"]) for r in graph.layers(nodes, edges).collect()}
    assert got == {k: (level[k], scc.count(scc[k]) > 1) for k in range(n)}


def counted(monkeypatch):
    """Counts what loops write."""
    seen = []
    for where in (graph, stored):
        monkeypatch.setattr(where, "cut", lambda df, label="cut", f=graph.cut if where is graph else stored.cut: (seen.append(label), f(df, label))[1])
    monkeypatch.setattr(stored, "bucketed", lambda df, key, label="stored", f=stored.bucketed: (seen.append(label), f(df, key, label))[1])
    return seen


def test_a_chain_of_a_hundred_thousand_nodes_takes_few_rounds(spark, monkeypatch):
    n = 100_000
    nodes, edges = spark.range(n), spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    seen = counted(monkeypatch)
    assert graph.strong_components(nodes, edges).filter("id <> scc").count() == 0
    assert len(seen) < 60
    seen.clear()
    got = graph.depths(nodes, edges)
    assert got.selectExpr("count(*)", f"sum(abs(level - ({n} - 1 - id)))").first()[:] == (n, 0)
    assert len(seen) < 60


def test_a_ring_and_a_street_take_few_rounds(spark, monkeypatch):
    n = 20_000
    nodes = spark.range(2 * n)
    ring = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"))
    street = spark.range(n, 2 * n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = ring.unionByName(street).unionByName(street.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(spark.createDataFrame([(5, n + 7)], "a bigint, b bigint"))
    seen = counted(monkeypatch)
    got = graph.strong_components(nodes, edges).groupBy("scc").count().collect()
    assert sorted(map(tuple, got)) == [(0, n), (n, n)]
    assert len(seen) < 120


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^#]*)#", plan), plan


def test_a_step_of_rank_shuffles_contributions_only(spark):
    """Of edges and ranks neither moves: the one exchange by key is that of dst."""
    edges = spark.range(5000).select((F.col("id") % 700).alias("id"), (F.col("id") * 7 % 900).alias("dst"), F.lit(1.0).alias("w"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    try:
        share = stored.Links(edges, "id")
        state = stored.bucketed(spark.range(900).select("id", F.lit(False).alias("sink"), F.lit(1.0).alias("t"), F.lit(1.0).alias("rank"), F.lit(0.0).alias("old")), "id")
        keys, plan = exchanges(graph.rank_step(share, state, 900, 0.85))
        assert not share.any_hot and keys == ["dst"], plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_star_lies_aside(spark):
    """Half of all rows belong to one key; none of them is in a bucket."""
    n = 200_000
    star = spark.range(n).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("bigint").alias("id"), F.col("id").alias("b"))
    links = stored.Links(star, "id")
    assert links.any_hot and links.hot.count() == n // 2 and links.rest.filter("id = 0").count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    links = stored.Links(star, "id")
    per = [r["n"] for r in links.rest.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(per) < 2 * sorted(per)[len(per) // 2]
    assert links.meet(spark.range(n).select("id", (F.col("id") + 1).alias("x"))).agg(F.sum("x"), F.count("*")).first()[:] == (n // 2 + sum(range(2, n + 1, 2)), n)
    got = graph.components(spark.range(n), star.select(F.col("id").alias("a"), "b"))
    assert got.groupBy("component").count().filter("count > 1").collect()[0][:] == (0, n // 2)
    assert graph.reachable(spark.createDataFrame([(0,)], "id bigint"), star.select(F.col("id").alias("a"), "b"), 2).count() == n // 2
    links.release()


def test_loops_leave_no_names_behind(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "a bigint, b bigint")
    before = {t.name for t in spark.catalog.listTables()}
    graph.layers(spark.range(5), edges).collect()
    graph.pagerank(spark.range(5), edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"))).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
