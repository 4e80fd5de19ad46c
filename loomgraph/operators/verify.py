"""Verification: faults as rows, drops in a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EXTERNAL

#: Order of drop classes in reports.
CLASS_RANK = {"fault": 0, "unresolved": 1, "policy": 2, "count": 3}
SAMPLES = 5


def consistency(nodes: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(code, place): every violated invariant of a graph.

    nodes (id, kind, module, file, line), edges (src, dst, kind, constraint),
    modules (id, depends_on array).
    """
    fault = lambda df, code, at: df.select(F.lit(code).alias("code"), F.concat_ws(" ", *[F.col(c).cast("string") for c in at]).alias("place"))
    ids = nodes.select("id").distinct()
    external = nodes.filter(F.col("kind") == "external").select("id").distinct()
    out = [
        fault(nodes.groupBy("id").count().filter("count > 1"), "duplicate_node", ["id"]),
        fault(edges.groupBy("src", "dst", "kind").count().filter("count > 1"), "duplicate_edge", ["src", "dst", "kind"]),
        fault(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("src").distinct(), "dangling_source", ["src"]),
        fault(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("dst").distinct(), "dangling_target", ["dst"]),
        fault(nodes.filter((F.col("kind") == "external") != ((F.col("module") == EXTERNAL) & F.col("file").isNull())), "external_shape", ["id"]),
        fault(nodes.filter((F.col("kind") != "external") & (F.col("file").isNull() | F.col("line").isNull())), "no_location", ["id"]),
        fault(edges.join(external.withColumnRenamed("id", "src"), "src", "left_semi"), "edge_from_external", ["src", "dst", "kind"]),
        fault(edges.filter(~F.col("constraint").eqNullSafe(F.lit(False))).join(external.withColumnRenamed("id", "dst"), "dst", "left_semi"), "external_constraint", ["src", "dst", "kind"]),
    ]
    own = nodes.filter(F.col("module") != EXTERNAL).select(F.col("module").alias("id")).distinct()
    listed = modules.select("id").distinct()
    out += [fault(own.join(listed, "id", "left_anti"), "module_not_listed", ["id"]), fault(listed.join(own, "id", "left_anti"), "module_unknown", ["id"])]
    from .graph import module_dependencies

    counted = module_dependencies(nodes, edges)
    stated = modules.select(F.col("id").alias("module"), F.explode("depends_on").alias("depends_on")).distinct()
    out += [
        fault(stated.filter("module = depends_on"), "self_dependency", ["module"]),
        fault(stated.exceptAll(counted).filter("module <> depends_on"), "dependency_not_counted", ["module", "depends_on"]),
        fault(counted.exceptAll(stated), "dependency_not_stated", ["module", "depends_on"]),
    ]
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def ledger(drops: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """drops (reason, class, sample, ord) to (reason, class, count, samples): the first samples of each reason.

    Samples are chosen by a bounded top-k, so no reason is gathered whole.
    """
    counts = drops.groupBy("reason", "class").agg(F.count("*").alias("count"))
    w = Window.partitionBy("reason", "class").orderBy("ord", "sample")
    top = drops.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= samples)
    kept = top.groupBy("reason", "class").agg(F.array_sort(F.collect_list(F.struct("_rn", "sample"))).alias("s"))
    return counts.join(kept, ["reason", "class"], "left").select("reason", "class", "count", F.transform("s", lambda x: x["sample"]).alias("samples"))


def ledger_report(rows: DataFrame) -> DataFrame:
    """Ledger rows with the rank of their class and their place in the report."""
    rank = F.coalesce(*[F.when(F.col("class") == k, v) for k, v in CLASS_RANK.items()], F.lit(len(CLASS_RANK)))
    return rows.withColumn("rank", rank).orderBy("rank", F.desc("count"), "reason")


def section_counts(faults: DataFrame) -> DataFrame:
    """(section, code, n) with the section's total."""
    by_code = faults.groupBy("section", "code").agg(F.count("*").alias("n"))
    total = by_code.groupBy("section").agg(F.sum("n").alias("total"))
    return by_code.join(total, "section")


def handoff(faults: DataFrame, examples: int = 5) -> DataFrame:
    """(code, n, examples): codes with their count and first examples."""
    w = Window.partitionBy("code").orderBy("place")
    kept = faults.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= examples).groupBy("code").agg(F.array_sort(F.collect_list("place")).alias("examples"))
    return faults.groupBy("code").agg(F.count("*").alias("n")).join(kept, "code")


def fit(status: F.Column, blockers: F.Column) -> F.Column:
    """ready, or not where checks failed or something blocks."""
    return F.when((status == "passed") & (blockers == 0), "ready").otherwise("not_ready")
