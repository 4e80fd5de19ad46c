"""Folding, contraction and iterative analytics of code graphs.

An edge (src, dst) says that src depends on dst.  Loops write their state to the
shared folder in every step, so plans stay flat and a lost executor costs one
step.  Edges that a loop joins again and again are stored in buckets of their
key, hubs aside (stored.Links), so no step shuffles them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..schemas import EXTERNAL
from ..session import cut
from . import stored


def fold_edges(raw: DataFrame, keys: tuple[str, ...] = ("src", "dst", "kind"), evidence: tuple[str, ...] = ("label", "line"), order: str = "ord") -> DataFrame:
    """One edge for each key: evidence of the first, and how many there were."""
    first = raw.groupBy(*keys).agg(F.min_by(F.struct(*evidence), F.struct(F.col(order).isNotNull(), F.col(order))).alias("_e"), F.count("*").alias("occurrences"))
    return first.select(*keys, *[F.col(f"_e.{c}").alias(c) for c in evidence], "occurrences")


def drop_external_sources(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that start at a first-party node."""
    return edges.join(nodes.filter(F.col("kind") != "external").select(F.col("id").alias("src")), "src", "left_semi")


def prune_untouched(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without the external ones that no edge reaches."""
    touched = edges.select(F.col("dst").alias("id")).distinct()
    return nodes.filter(F.col("kind") != "external").unionByName(nodes.filter(F.col("kind") == "external").join(touched, "id", "left_semi"))


def module_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, depends_on): distinct pairs across first-party modules.

    Edges are contracted to modules as they are joined, so the distinct shuffles
    pairs of modules and not of nodes.
    """
    own = nodes.filter(F.col("module") != EXTERNAL)
    end = lambda e, name: own.select(F.col("id").alias(e), F.col("module").alias(name))
    half = edges.join(end("src", "module"), "src").groupBy("module", "dst").agg(F.count("*").alias("_n"))
    return half.join(end("dst", "depends_on"), "dst").filter(F.col("module") != F.col("depends_on")).select("module", "depends_on").distinct()


def modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depends_on): the module list with sorted dependencies, empty where there are none."""
    names = nodes.filter((F.col("module") != EXTERNAL) & F.col("module").isNotNull()).select(F.col("module").alias("id")).distinct()
    needs = module_dependencies(nodes, edges).groupBy(F.col("module").alias("id")).agg(F.array_sort(F.collect_set("depends_on")).alias("depends_on"))
    return names.join(needs, "id", "left").select("id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of first-party nodes, over distinct first-party neighbours."""
    own = nodes.filter(F.col("kind") != "external").select("id")
    pairs = edges.select("src", "dst").distinct().join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    return own.join(counts, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def external_touch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, external, touches): occurrences of edges from each module to each external node."""
    own = nodes.filter(F.col("kind") != "external").select(F.col("id").alias("src"), "module")
    out = nodes.filter(F.col("kind") == "external").select(F.col("id").alias("dst"), F.col("name").alias("external"))
    return edges.join(out, "dst").join(own, "src").groupBy("module", "external").agg(F.sum("occurrences").alias("touches"))


def file_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, out_edges, into_edges, interfaces, abstracts, weight): cross-file edges of each file, in-edges to public names only.

    What depends on little weighs more, and so does what much depends on:
    weight = (1 - out/max) + into/max + abstraction/max, where an interface
    counts 5 and an abstract class 3.  Without any edge out the first term is 1,
    the others are 0 where their maximum is.
    """
    told = nodes if "abstraction" in nodes.columns else nodes.withColumn("abstraction", F.lit(None).cast("string"))
    own = told.filter((F.col("kind") != "external") & (F.coalesce("file", F.lit("")) != "")).select("id", "file", "name", "abstraction")
    public = ~F.element_at(F.split(F.coalesce("name", F.lit("")), r"\."), -1).startswith("_")
    pairs = edges.select("src", "dst").join(own.select(F.col("id").alias("src"), F.col("file").alias("sf")), "src").join(own.select(F.col("id").alias("dst"), F.col("file").alias("df"), public.alias("public")), "dst").filter("sf <> df")
    row = lambda file, o=0, i=0, f=0, a=0: F.struct(file.alias("file"), *[(c if not isinstance(c, int) else F.lit(c)).cast("bigint").alias(n) for n, c in (("o", o), ("i", i), ("f", f), ("a", a))])
    sides = pairs.select(F.explode(F.array(row(F.col("sf"), o=1), row(F.col("df"), i=F.when(F.col("public"), 1).otherwise(0)))).alias("e"))
    held = own.select(row(F.col("file"), f=F.when(F.col("abstraction") == "interface", 1).otherwise(0), a=F.when(F.col("abstraction") == "abstract", 1).otherwise(0)).alias("e"))
    # one aggregate for both counts of edges and kinds of nodes
    rows = sides.unionByName(held).groupBy("e.file").agg(F.sum("e.o").alias("out_edges"), F.sum("e.i").alias("into_edges"), F.sum("e.f").alias("interfaces"), F.sum("e.a").alias("abstracts"))
    score = fixed.INTERFACE_WEIGHT * F.col("interfaces") + fixed.ABSTRACT_WEIGHT * F.col("abstracts")
    rows = cut(rows, "file-weights")
    most = rows.agg(F.max("out_edges").alias("mo"), F.max("into_edges").alias("mi"), F.max(score).alias("ms"))
    share = lambda c, m: F.when(F.col(m) > 0, c / F.col(m))
    weight = F.coalesce(1 - share(F.col("out_edges"), "mo"), F.lit(1.0)) + F.coalesce(share(F.col("into_edges"), "mi"), F.lit(0.0)) + F.coalesce(share(score, "ms"), F.lit(0.0))
    return rows.join(F.broadcast(most)).select("file", "out_edges", "into_edges", "interfaces", "abstracts", weight.alias("weight"))  # one row of maxima


def neighbourhood(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Edges with either end among focus (id): one hop, not further."""
    f = focus.select("id").distinct()
    out = edges.join(f.withColumnRenamed("id", "src"), "src", "left_semi").select(*edges.columns)
    into = edges.join(f.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
    return out.unionByName(into.join(f.withColumnRenamed("id", "src"), "src", "left_anti").select(*edges.columns))


def mutual_pairs(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) with a < b where both directions exist."""
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col(a) < F.col(b)).alias("d")).filter("a <> b").distinct()
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b")


def undirected_links(links: DataFrame, known: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct undirected links between known ends (id); self links go."""
    pairs = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    ids = known.select("id")
    return pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float | None = None) -> DataFrame:
    """(id, rank) by weighted power iteration: nodes (id), edges (src, dst, weight).

    Parallel edges add up first.  The mass of nodes without out-edges is spread
    evenly.  With a tolerance the loop ends when the summed change falls below
    tolerance times the number of nodes.  Edges and ranks are stored by node, so
    a step shuffles contributions only; hubs lie aside.
    """
    ids = cut(nodes.select("id").distinct(), "rank-nodes")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    both = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    total = cut(both.groupBy("src").agg(F.sum("w").alias("t")), "rank-totals")
    share = stored.Links(both.withColumnRenamed("src", "id"), "id", "rank_edges")
    sinks = ids.join(total.select(F.col("src").alias("id")), "id", "left_anti").withColumn("sink", F.lit(True))
    start = ids.join(sinks, "id", "left").join(total.withColumnRenamed("src", "id"), "id", "left")
    state = stored.bucketed(start.select("id", F.coalesce("sink", F.lit(False)).alias("sink"), "t", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("old")), "id", "rank_state")
    for _ in range(iterations):
        after = stored.bucketed(rank_step(share, state, n, damping), "id", "rank_state")
        stored.release(state)
        state = after
        if tolerance is not None:
            change = state.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if change < n * tolerance:
                break
    out = cut(state.select("id", "rank"), "rank")
    stored.release(state)
    share.release()
    return out


def rank_step(share: stored.Links, state: DataFrame, n: int, damping: float) -> DataFrame:
    """One step: state (id, sink, t, rank, old), where t is the weight of a node's out-edges."""
    dangling = state.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("dangling"))
    flow = share.meet(state.select("id", (F.col("rank") / F.col("t")).alias("unit"))).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("unit")).alias("flow"))
    base = F.lit((1 - damping) / n) + F.lit(damping / n) * F.col("dangling")
    after = state.select("id", "sink", "t", F.col("rank").alias("old")).join(flow, "id", "left").join(F.broadcast(dangling))  # one row
    return after.select("id", "sink", "t", (base + F.lit(damping) * F.coalesce("flow", F.lit(0.0))).alias("rank"), "old")


def reachable(seeds: DataFrame, edges: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """(id, hop): nodes within hops of the seeds (id), with the least hop; seeds that have no edge stay."""
    pairs = edges.select("a", "b")
    if not directed:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = stored.Links(pairs.distinct().withColumnRenamed("a", "id"), "id", "reach_edges")
    front = stored.bucketed(seeds.select("id").distinct(), "id", "reach")
    layers_, held = [(front, 0)], front
    for hop in range(1, hops + 1):
        found = links.meet(front).select(F.col("b").alias("id")).distinct()
        # what was seen is in buckets of the same key, each hop by itself
        for seen, _ in layers_:
            found = found.join(seen, "id", "left_anti")
        front = stored.bucketed(found, "id", "reach")
        layers_.append((front, hop))
        if not front.take(1):
            break
    held = None
    for seen, hop in layers_:
        one = seen.withColumn("hop", F.lit(hop))
        held = one if held is None else held.unionByName(one)
    out = cut(held, "reach")
    stored.release(*[seen for seen, _ in layers_])
    links.release()
    return out


def blast_radius(nodes: DataFrame, edges: DataFrame, changed: DataFrame, hops: int = 1) -> DataFrame:
    """(file): files within hops of the changed ones along edges of either direction; unknown files stay."""
    place = nodes.filter(F.col("file").isNotNull()).select("id", "file")
    files = edges.join(place.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(place.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").select("a", "b").filter("a <> b").distinct()
    return reachable(changed.select(F.col("file").alias("id")), files, hops).select(F.col("id").alias("file"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of the connected component; ends that aren't nodes are ignored.

    Each round takes the least label around a node and then that label's own
    label, so long chains shorten by halves.  Edges and labels are stored by
    node; hubs, and labels of very many nodes, are joined aside.
    """
    ids = cut(nodes.select("id").distinct(), "comp-nodes")
    n = ids.count()
    pairs = edges.select("a", "b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    both = stored.Links(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumnRenamed("b", "id"), "id", "comp_edges")
    label = stored.bucketed(ids.withColumns({"component": F.col("id"), "old": F.col("id")}), "id", "comp")
    while True:
        near = both.meet(label.select("id", "component")).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = cut(label.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old")), "comp-least")
        up = least.select(F.col("id").alias("component"), F.col("component").alias("up"))
        after = stored.bucketed(stored.join_unique(least, up, "component", n).select("id", F.least("component", "up").alias("component"), "old"), "id", "comp")
        stored.release(label)
        label = after
        if not label.filter("component <> old").take(1):
            out = cut(label.select("id", "component"), "comp-labels")
            stored.release(label)
            both.release()
            return out


def _ends(links: DataFrame) -> DataFrame:
    """(id, o, i, nxt, prv): how many links leave and reach each end, and one neighbour on either side."""
    side = lambda c, d, o, i: F.struct(F.col(c).alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"), F.col(d).alias("other"))
    rows = links.select(F.explode(F.array(side("a", "b", 1, 0), side("b", "a", 0, 1))).alias("e")).select("e.*")
    return rows.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max(F.when(F.col("o") == 1, F.col("other"))).alias("nxt"), F.max(F.when(F.col("i") == 1, F.col("other"))).alias("prv"))


def chain_ends(inner: DataFrame) -> DataFrame:
    """(id, to, last, least, done) of inner (id, nxt): where the chain of an inner node leaves them, and its last inner node.

    Steps double, so a chain of any length takes the logarithm of it in rounds.
    Nodes whose chain never leaves stand in a ring of their own: done is false,
    and least is the ring's least node.
    """
    n = inner.count()
    stops = inner.select(F.col("id").alias("to"), F.lit(True).alias("_inner"))
    now = cut(inner.select("id", F.col("nxt").alias("to")).join(stops, "to", "left").select("id", "to", F.col("id").alias("last"), F.col("id").alias("least"), F.col("_inner").isNull().alias("done")), "chain")
    for _ in range(max(1, n).bit_length() + 1):
        if not now.filter("not done").take(1):
            break
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        more = now.filter("not done").join(ahead, "to").select("id", F.col("to2").alias("to"), F.col("last2").alias("last"), F.least("least", "least2").alias("least"), F.col("done2").alias("done"))
        now = cut(now.filter("done").unionByName(more), "chain")
    return now


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc): the least id among nodes that reach each other.

    A round lets go of nodes that nothing leaves or nothing reaches, which are
    components of their own; takes nodes with one link in and one out for a link
    between the ends of their chain; and makes one node of those joined by links
    in both directions.  What none of this shortens is coloured.  Afterwards the
    rounds are gone through backwards: the inside of a chain belongs to its ends
    if they belong together, and else each of its nodes stands alone.
    """
    left = ids = cut(nodes.select("id").distinct(), "scc-nodes")
    links = edges.select("a", "b").filter("a <> b").distinct().join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    links = cut(links.select("a", "b"), "scc-links")
    found: list[DataFrame] = [ids.withColumn("scc", F.col("id")).limit(0)]
    undo: list[tuple] = []
    while True:
        role = F.when(F.col("o").isNull() | (F.col("o") == 0) | (F.col("i") == 0), "alone").when((F.col("o") == 1) & (F.col("i") == 1) & (F.col("nxt") != F.col("prv")), "inner").otherwise("left")
        ends = cut(left.join(_ends(links), "id", "left").select("id", "nxt", "prv", role.alias("role")), "scc-ends")
        some = {r["role"]: r["n"] for r in ends.groupBy("role").agg(F.count("*").alias("n")).collect()}  # three rows
        alone, inner = ends.filter("role = 'alone'").select("id"), ends.filter("role = 'inner'").select("id", "nxt", "prv")
        found.append(alone.select("id", F.col("id").alias("scc")))
        new = None
        if "inner" in some:
            chain = chain_ends(inner)
            found.append(chain.filter("not done").select("id", F.col("least").alias("scc")))
            heads = inner.join(inner.select(F.col("id").alias("prv")), "prv", "left_anti").select("id", F.col("prv").alias("u"))
            told = cut(chain.filter("done").join(heads, "id").select("last", "u", F.col("to").alias("w")), "scc-chains")
            undo.append(("chain", chain.filter("done").select("id", "last"), told, some["inner"]))
            new = told.filter("u <> w").select(F.col("u").alias("a"), F.col("w").alias("b"))
            for end in ("a", "b"):
                new = new.join(alone.withColumnRenamed("id", end), end, "left_anti")
        if set(some) <= {"alone"}:
            break
        left = ends.filter("role = 'left'").select("id")
        if set(some) != {"left"}:
            kept = links.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
            links = cut(kept.unionByName(new.select("a", "b")).distinct() if new is not None else kept, "scc-links")
            continue
        pairs = cut(mutual_pairs(links), "scc-mutual")
        if pairs.take(1):
            both = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
            into = cut(components(both, pairs).filter("id <> component").select("id", F.col("component").alias("into")), "scc-into")
            undo.append(("merge", into, None, into.count()))
            for end in ("a", "b"):
                links = links.join(into.withColumnsRenamed({"id": end, "into": f"i{end}"}), end, "left")
            links = cut(links.select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b")).filter("a <> b").distinct(), "scc-links")
            left = left.join(into, "id", "left_anti")
        else:
            part = coloured(left, links)
            found.append(part)
            left = cut(left.join(part, "id", "left_anti").select("id"), "scc-left")
            links = cut(links.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"), "scc-links")
    known = lambda: reduce(DataFrame.unionByName, found)
    found = [cut(known(), "scc-found")]
    of = lambda key, name: known().select(F.col("id").alias(key), F.col("scc").alias(name))
    for kind, rows, told, n in reversed(undo):
        if kind == "merge":
            more = stored.join_unique(rows, of("into", "scc"), "into", n).select("id", "scc")
        else:
            owner = told.join(of("u", "su"), "u").join(of("w", "sw"), "w").select("last", F.when(F.col("su") == F.col("sw"), F.col("su")).alias("scc"))
            more = stored.join_unique(rows, cut(owner, "scc-owners"), "last", n).select("id", F.coalesce("scc", "id").alias("scc"))
        found.append(cut(more, "scc-found"))
    told = cut(known(), "scc-found")
    least = told.groupBy("scc").agg(F.min("id").alias("least"))
    return stored.join_unique(told, least, "scc", told.count()).select("id", F.col("least").alias("scc"))


def coloured(left: DataFrame, links: DataFrame) -> DataFrame:
    """(id, scc): some strong components of a graph whose nodes all have links in and out.

    The least id that reaches a node is its colour; what reaches that id through
    nodes of its colour is its component.  Every colour gives one.
    """
    rows = stored.Links(links.withColumnRenamed("a", "id"), "id", "scc_links")
    colour = stored.bucketed(left.withColumns({"colour": F.col("id"), "old": F.col("id")}), "id", "scc_colour")
    while True:
        into = rows.meet(colour.select("id", "colour")).groupBy(F.col("b").alias("id")).agg(F.min("colour").alias("near"))
        after = stored.bucketed(colour.join(into, "id", "left").select("id", F.least("colour", F.coalesce("near", "colour")).alias("colour"), F.col("colour").alias("old")), "id", "scc_colour")
        stored.release(colour)
        colour = after
        if not colour.filter("colour <> old").take(1):
            break
    of = cut(colour.select("id", "colour"), "scc-colour")
    stored.release(colour)
    rows.release()
    n = links.count()
    same = stored.join_unique(stored.join_unique(links, of.withColumnsRenamed({"id": "a", "colour": "ca"}), "a", n), of.withColumnsRenamed({"id": "b", "colour": "cb"}), "b", n).filter("ca = cb")
    back = stored.Links(same.select(F.col("b").alias("id"), "a", F.col("ca").alias("colour")), "id", "scc_same")
    part = cut(of.filter("id = colour").select("id", F.col("colour").alias("scc")), "scc-part")
    front = part
    while True:
        more = back.meet(front.select("id")).select(F.col("a").alias("id"), F.col("colour").alias("scc")).distinct().join(part, "id", "left_anti")
        front = cut(more, "scc-front")
        if not front.take(1):
            back.release()
            return part
        part = cut(part.unionByName(front), "scc-part")


def depths(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) of an acyclic graph: ids (id) distinct, edges (a, b) distinct.  0 has no edge out; else one more than the highest level behind an edge.

    A node with one edge left is a step in a chain: its level is the greater of
    what is known and that of the chain's end plus the way there, so chains of
    any length are taken at once and looked up again when their end is known.
    """
    kind = ids.schema["id"].dataType
    left, links = ids.withColumn("base", F.lit(0)), edges.select("a", "b", F.lit(1).alias("w"))
    found, undo = [ids.withColumn("level", F.lit(0)).limit(0)], []
    while True:
        out = links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("o"), F.max(F.struct("b", "w")).alias("e"))
        told = cut(left.join(out, "id", "left").select("id", "base", F.coalesce("o", F.lit(0)).alias("o"), F.col("e.b").alias("to"), F.col("e.w").alias("d")), "depth-nodes")
        ends = told.filter("o = 0").select("id", F.col("base").alias("level"))
        now = told.filter("o = 1").select("id", "to", F.col("base").alias("c"), "d")
        inside = now.select(F.col("id").alias("to"), F.lit(True).alias("_inner"))
        now = cut(now.join(inside, "to", "left").select("id", "to", "c", "d", F.col("_inner").isNull().alias("done")), "depth-chain")
        while now.filter("not done").take(1):
            ahead = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("c").alias("c2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
            more = now.filter("not done").join(ahead, "to").select("id", F.col("to2").alias("to"), F.greatest("c", F.col("d") + F.col("c2")).alias("c"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done"))
            now = cut(now.filter("done").unionByName(more), "depth-chain")
        n = now.count()
        steps = stored.join_unique(now.select("id", "to", "c", "d"), ends.withColumnsRenamed({"id": "to", "level": "end"}), "to", n, "left")
        steps = cut(steps.select("id", F.when(F.col("end").isNull(), F.col("to")).alias("to"), F.when(F.col("end").isNull(), F.col("c")).otherwise(F.greatest("c", F.col("d") + F.col("end"))).alias("c"), "d"), "depth-steps")
        reached, waiting = steps.filter("to is null").select("id", F.col("c").alias("level")), steps.filter("to is not null")
        found += [ends, reached]
        undo.append((waiting, n))
        left = told.filter("o > 1").select("id", "base")
        if not left.take(1):
            break
        # what stands behind an edge: a known level, or a chain that ends at an open node
        behind = ends.unionByName(reached).select(F.col("id").alias("b"), F.lit(None).cast(kind).alias("to"), F.col("level").alias("c"), F.lit(0).alias("d"), F.lit(True).alias("known")).unionByName(waiting.select(F.col("id").alias("b"), "to", "c", "d", F.lit(False).alias("known")))
        rows = links.join(left.select(F.col("id").alias("a")), "a", "left_semi").join(behind, "b", "left")
        rows = cut(rows.select("a", F.when(F.col("known").isNull(), F.col("b")).otherwise(F.col("to")).alias("b"), (F.col("w") + F.coalesce("d", F.lit(0))).alias("w"), (F.col("w") + F.col("c")).alias("c")), "depth-rows")
        links = rows.filter("b is not null").groupBy("a", "b").agg(F.max("w").alias("w"))
        least = rows.filter("c is not null").groupBy(F.col("a").alias("id")).agg(F.max("c").alias("c"))
        left = left.join(least, "id", "left").select("id", F.greatest("base", F.coalesce("c", F.lit(0))).alias("base"))
    known = lambda: reduce(DataFrame.unionByName, found)
    found = [cut(known(), "depth-found")]
    for waiting, n in reversed(undo):
        if n and waiting.take(1):
            more = stored.join_unique(waiting, known().select(F.col("id").alias("to"), "level"), "to", n)
            found.append(cut(more.select("id", F.greatest("c", F.col("d") + F.col("level")).alias("level")), "depth-found"))
    return known()


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level, in_cycle): 0 depends on nothing; else one more than the highest level it depends on, cycles as one."""
    links = edges.select("a", "b").filter("a <> b").distinct()
    scc = cut(strong_components(nodes, links), "scc")
    n = scc.count()
    size = cut(scc.groupBy("scc").agg(F.count("*").alias("n")), "scc-sizes")
    dag = cut(links.join(scc.select(F.col("id").alias("a"), F.col("scc").alias("ca")), "a").join(scc.select(F.col("id").alias("b"), F.col("scc").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct(), "dag")
    level = depths(size.select(F.col("scc").alias("id")), dag).withColumnRenamed("id", "scc")
    return stored.join_unique(scc, cut(level.join(size, "scc"), "scc-levels"), "scc", n).select("id", F.col("level").cast("int").alias("level"), (F.col("n") > 1).alias("in_cycle"))


def cycle_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges on some elementary cycle: those inside a strong component of more than one node."""
    links = edges.select("a", "b").filter("a <> b").distinct()
    scc = cut(strong_components(nodes, links), "scc")
    return links.join(scc.select(F.col("id").alias("a"), F.col("scc").alias("sa")), "a").join(scc.select(F.col("id").alias("b"), F.col("scc").alias("sb")), "b").filter("sa = sb").select("a", "b")


def ways_back(links: DataFrame) -> DataFrame:
    """(start, id, back): nodes greater than start from which a path over nodes greater than it leads to start, and its fewest steps.

    links (a, b) are distinct and no loops.  A path from start can close only
    over nodes that are here; one row for each such pair.
    """
    near = links.filter("a > b").select(F.col("b").alias("start"), F.col("a").alias("id"))
    seen = near = cut(near.withColumn("back", F.lit(1)), "cycle-back")
    steps = 1
    while near.take(1):
        steps += 1
        ahead = near.select("start", F.col("id").alias("b")).join(links, "b").filter(F.col("a") > F.col("start")).select("start", F.col("a").alias("id")).distinct()
        near = cut(ahead.join(seen, ["start", "id"], "left_anti").withColumn("back", F.lit(steps)), "cycle-back")
        seen = seen.unionByName(near)
    return seen


def simple_cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(path): elementary cycles, each once, from its least node on; those of up to `longest` nodes where it is given.  For module graphs.

    A path goes on only over nodes greater than its start that lead back to it
    over such nodes, and, where cycles are bounded, in few enough steps.
    """
    links = cut(edges.select("a", "b").filter("a <> b").distinct(), "cycle-edges")
    # no cycle leaves its strong component, so no path need either
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    links = cut(cycle_edges(ends, links).select("a", "b"), "cycle-edges")
    back = cut(ways_back(links), "cycle-back")
    # the links that a path from each start may take, each with the fewest steps from its end to the start
    steps = back.withColumnRenamed("id", "b").join(links, "b").select("start", "a", "b", "back")
    paths = steps.filter("a = start").select("start", F.array("a", "b").alias("path"), F.col("b").alias("last"), F.col("back").alias("_back"))
    steps = cut(steps.filter("a > start"), "cycle-steps")
    if longest is not None:
        paths = paths.filter(F.size("path") + F.col("_back") - 1 <= longest)
    paths = cut(paths, "cycle-paths")
    found = None
    while True:
        # whose last node is one step from the start
        closed = paths.filter("_back = 1").select("path")
        found = closed if found is None else found.unionByName(closed)
        on = paths.select("start", "path", F.col("last").alias("a")).join(steps, ["start", "a"]).filter(~F.array_contains("path", F.col("b")))
        if longest is not None:
            on = on.filter(F.size("path") + F.col("back") <= longest)
        paths = cut(on.select("start", F.concat("path", F.array("b")).alias("path"), F.col("b").alias("last"), F.col("back").alias("_back")), "cycle-paths")
        if not paths.take(1):
            return found
