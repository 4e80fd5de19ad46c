"""Fact tables of a graph: ranked classes, modules, external nodes, hotspots and entry points, and details of types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .ordered import numbered


def class_rows(nodes: DataFrame, edges: DataFrame, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(number, name, kind, module, file, line, pagerank, in_deg, out_deg, ext_touch, listed) of own nodes, the highest rank first.

    Ranks are over own nodes only, weighed by occurrences; equal ones (at six
    decimals) keep the order of ids.  A node without any own edge is only
    listed, not written about.
    """
    own = nodes.filter("kind <> 'external'")
    ids = own.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ranks = graph.pagerank(ids, inner.select("src", "dst", F.col("occurrences").cast("double").alias("weight")), iterations=iterations, tolerance=tolerance)
    outer = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    touch = outer.groupBy(F.col("src").alias("id")).agg(F.sum("occurrences").alias("ext_touch"))
    degrees = graph.degrees(nodes, edges)
    rows = own.join(ranks, "id").join(degrees, "id").join(touch, "id", "left")
    told = rows.select("id", "name", "kind", "module", "file", "line", F.round("rank", 6).alias("pagerank"), F.col("in_degree").alias("in_deg"), F.col("out_degree").alias("out_deg"), F.coalesce("ext_touch", F.lit(0)).alias("ext_touch"))
    return numbered(told, [F.desc("pagerank"), F.asc("id")], "number").withColumn("listed", (F.col("in_deg") == 0) & (F.col("out_deg") == 0))


def module_rows(classes: DataFrame, needs: DataFrame | None = None, cyclic: DataFrame | None = None) -> DataFrame:
    """(number, id, classes, pagerank_sum, in_cycle, depends_on) of classes' modules, the greatest sum first.  needs (id, depends_on), cyclic (id)."""
    rows = classes.filter("coalesce(module, '') <> ''").groupBy(F.col("module").alias("id")).agg(F.count("*").alias("classes"), F.round(F.sum("pagerank"), 6).alias("pagerank_sum"))
    flag = cyclic.select("id", F.lit(True).alias("_c")).distinct() if cyclic is not None else rows.select("id", F.lit(False).alias("_c"))
    rows = rows.join(flag, "id", "left").withColumn("in_cycle", F.coalesce("_c", F.lit(False))).drop("_c")
    rows = rows.join(needs.select("id", "depends_on"), "id", "left") if needs is not None else rows.withColumn("depends_on", F.array().cast("array<string>"))
    return numbered(rows, [F.desc("pagerank_sum"), F.asc("id")], "number")


def external_rows(nodes: DataFrame, edges: DataFrame, shown: int = 3) -> DataFrame:
    """(number, name, touches, folded, head) of external nodes that edges reach: the most touched first, with the shortest of the names each stands for."""
    outer = nodes.filter("kind = 'external'").select(F.col("id").alias("dst"), "name", F.coalesce("collapsed_from", F.array().cast("array<string>")).alias("names"))
    touched = edges.groupBy("dst").agg(F.sum("occurrences").alias("touches")).join(outer, "dst")
    short = F.transform(F.slice(F.array_sort(F.transform("names", lambda n: F.struct(F.length(n).alias("l"), n.alias("n")))), 1, shown), lambda x: x["n"])
    more = F.when(F.size("names") > shown, F.concat(F.lit(" 외 "), (F.size("names") - shown).cast("string"))).otherwise("")
    rows = touched.select("dst", "name", "touches", F.size("names").alias("folded"), F.concat(F.array_join(short, ", "), more).alias("head"))
    return numbered(rows, [F.desc("touches"), F.asc("dst")], "number").select("number", "name", "touches", "folded", "head")


def hotspot_rows(spots: DataFrame, classes: DataFrame) -> DataFrame:
    """(number, path, module, commits, added, deleted) of changed files that have nodes, the most often changed first."""
    home = classes.filter("file is not null").groupBy(F.col("file").alias("path")).agg(F.max_by("module", "number").alias("module"))
    return numbered(spots.join(home, "path"), [F.desc("commits"), F.asc("path")], "number").select("number", "path", "module", "commits", "added", "deleted")


def entry_points(types: DataFrame) -> DataFrame:
    """(kind, name, place): types an engine calls by reflection, and assets; types (name, file, line, unity map<string, boolean>)."""
    kinds = F.array(F.when(F.try_element_at("unity", F.lit("is_monobehaviour")), "behaviour"), F.when(F.try_element_at("unity", F.lit("is_scriptable_object")), "asset"))
    return types.select(F.explode(F.array_compact(kinds)).alias("kind"), "name", F.concat(F.lit("("), "file", F.lit(":"), F.col("line").cast("string"), F.lit(")")).alias("place")).orderBy("kind", "name")


def details(elements: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """(name, members, methods, abstract) by type name, from either collector's shape; C# types without either list are external and left out.

    Of types that share a name the last counts.
    """
    member, method = "array<struct<name:string,type:string,access:string>>", "array<struct<name:string,access:string,virtual:boolean,args:int>>"
    parts = []
    if elements is not None:
        own = F.transform("methods", lambda m: F.struct(m["name"].alias("name"), m["access"].alias("access"), F.coalesce(m["is_pure_virtual"], F.lit(False)).alias("virtual"), F.size(m["parameters"]).alias("args")))
        parts.append(elements.select(F.col("display_name").alias("name"), F.coalesce("members", F.array().cast(member)).cast(member).alias("members"), F.coalesce(own, F.array().cast(method)).alias("methods"), F.coalesce("is_abstract", F.lit(False)).alias("abstract"), "ord"))
    if types is not None:
        own = F.transform("methods", lambda m: F.struct(m["name"].alias("name"), m["access"].alias("access"), F.coalesce(m["is_abstract"], F.lit(False)).alias("virtual"), F.coalesce(m["param_count"], F.lit(0)).alias("args")))
        told = types.filter("members is not null or methods is not null")
        parts.append(told.select("name", F.coalesce("members", F.array().cast(member)).cast(member).alias("members"), F.coalesce(own, F.array().cast(method)).alias("methods"), F.coalesce("is_abstract", F.lit(False)).alias("abstract"), "ord"))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return whole.groupBy("name").agg(F.max_by(F.struct("members", "methods", "abstract"), "ord").alias("d")).select("name", "d.*")


def focus(edges: DataFrame, module: str, nodes: DataFrame) -> DataFrame:
    """(src, dst, kind, ...) edges with either end in a module: the module and its direct neighbours."""
    return graph.neighbourhood(edges, nodes.filter(F.col("module") == module).select("id"))
