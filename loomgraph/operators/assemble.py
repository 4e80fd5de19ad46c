"""What the normalizers of all languages share: places, external nodes, folded edges, the ledger, the graph's tail.

A normalizer makes entries (one for each node it would create, in order), uses
(one for each edge it would add, in order) and drops (reason, sample, ord).
ord is an array of numbers, so order survives every shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import module_of as top_folder  # noqa: F401
from ..schemas import EXTERNAL
from ..session import cut
from . import verify
from .ordered import numbered


def ords(*parts) -> Column:
    """An order as an array of numbers."""
    return F.array(*[F.col(p).cast("bigint") if isinstance(p, str) else p.cast("bigint") for p in parts])


def drop(rows: DataFrame, reason: str, sample: Column | None = None, ord: Column | None = None) -> DataFrame:
    """A row of the ledger for each of rows."""
    return rows.select(F.lit(reason).alias("reason"), (F.lit(None).cast("string") if sample is None else sample).alias("sample"), (F.array().cast("array<bigint>") if ord is None else ord).alias("ord"))


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def ledger(drops: DataFrame) -> DataFrame:
    """(reason, class, count, samples, rank): the report of a graph's drops."""
    cls = F.create_map(*[F.lit(x) for pair in fixed.DROP_CLASS.items() for x in pair])[F.col("reason")]
    told = drops.withColumn("class", cls)
    kept = verify.ledger(told.filter("sample is not null")).select("reason", "samples")
    counts = told.groupBy("reason", "class").agg(F.count("*").alias("count"))
    rows = counts.join(kept, "reason", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    return verify.ledger_report(rows)


def first_party(rows: DataFrame, namespaces: tuple[str, ...] = (), lines: DataFrame | None = None, tracked: DataFrame | None = None, root: str = "") -> DataFrame:
    """rows (namespace, file, line, name, ...) with own: whether the type is the repository's.

    A namespace of the allow-list decides by itself.  Otherwise the place must
    lie in the repository, be no generated file, be tracked where a listing is
    given, and the line it names must define the type; types of the standard
    library never are.
    """
    base = F.trim(F.split(F.element_at(F.split(F.replace(F.coalesce("name", F.lit("")), F.lit("##"), F.lit("::")), "::"), -1), "<")[0])
    head = F.split(F.coalesce("namespace", F.lit("")), "::")[0]
    inside = F.col("file")
    if root:
        inside = F.when(F.col("file").startswith(root.rstrip("/") + "/"), F.substring("file", len(root.rstrip("/")) + 2, 1 << 20)).otherwise(F.col("file"))
    placed = rows.withColumns({"_head": head, "_base": base, "_path": inside})
    marked = reduce(lambda a, m: a | F.contains(F.concat(F.lit("/"), "_path"), F.lit(m)), fixed.GENERATED_MARKERS, F.lit(False))
    outside = F.col("_path").startswith("/") | F.col("_path").startswith("../") | F.contains("_path", F.lit("/../"))
    can = ~F.col("_head").isin(*fixed.NEVER_FIRST_PARTY_NS) & (F.coalesce("_path", F.lit("")) != "") & ~outside & ~marked
    if tracked is not None:
        placed = placed.join(tracked.select(F.col("path").alias("_path")).distinct().withColumn("_tracked", F.lit(True)), "_path", "left")
        can = can & F.coalesce("_tracked", F.lit(False))
    if lines is None:
        defines = F.lit(False)
    else:
        text = lines.groupBy(F.col("path").alias("_path"), F.col("line").alias("_line")).agg(F.first("text").alias("_text"))
        placed = placed.join(text, (placed["_path"] == text["_path"]) & (placed["line"] == text["_line"]), "left").drop(text["_path"])
        pattern = F.concat(F.lit(r"\b(?:class|struct|enum(?:\s+class)?|union)\s+(?:\w+\s+)*\Q"), "_base", F.lit(r"\E\b"))
        defines = (F.col("_base") != "") & ~F.trim(F.regexp_replace("_text", r"^\s+|\s+$", "")).endswith(";") & F.regexp(F.trim("_text"), pattern)
    listed = F.col("_head").isin(*namespaces) if namespaces else F.lit(False)
    return placed.withColumn("own", listed | F.coalesce(can & F.coalesce(defines, F.lit(False)), F.lit(False))).select(*rows.columns, "own")


def external_nodes(uses: DataFrame) -> DataFrame:
    """uses (id, name, raw): one node for each id, with the distinct raw names it stands for, sorted."""
    return uses.groupBy("id", "name").agg(F.array_sort(F.collect_set("raw")).alias("collapsed_from"))


NODE = ("id", "name", "kind", "module", "file", "line", "signature", "doc", "abstraction", "collapsed_from")


def node_ids(creators: DataFrame, start: int = 0) -> DataFrame:
    """creators (key, external, ord): id of each, C and its number among all, or X: and its name where external."""
    rows = numbered(creators, ["ord"], "_place")
    return rows.withColumn("id", F.when(F.col("external"), F.concat(F.lit("X:"), "key")).otherwise(F.concat(F.lit("C"), F.col("_place") + start))).drop("_place")


def assemble(nodes: DataFrame, uses: DataFrame, drops: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, edges, modules (id, depends_on) and the ledger.

    uses (src, dst, kind, label, file, line, ord) are edges in the order they
    come: self edges and those that start outside go, the first of a kind
    between two nodes gives the evidence, the others are counted.  External
    nodes that no edge reaches go, and edges to the others bind nothing.  Uses
    that an optional column `quiet` marks have drops of their own when folded;
    any other column is evidence too.
    """
    if "quiet" not in uses.columns:
        uses = uses.withColumn("quiet", F.lit(False))
    evidence = [c for c in uses.columns if c not in ("src", "dst", "kind", "quiet")]
    kinds = nodes.select(F.col("id").alias("_id"), (F.col("kind") == "external").alias("_ext"))
    told = uses.filter("src <> dst").join(kinds.withColumnsRenamed({"_id": "src", "_ext": "src_ext"}), "src").join(kinds.withColumnsRenamed({"_id": "dst", "_ext": "dst_ext"}), "dst")
    told = cut(told, "uses")
    kept = told.filter("not src_ext")
    edges = kept.groupBy("src", "dst", "kind").agg(F.min_by(F.struct(*evidence), "ord").alias("e"), F.count("*").alias("occurrences"), F.bool_or("dst_ext").alias("dst_ext"), (F.count(F.when(~F.col("quiet"), 1)) - 1).alias("folded"))
    edges = cut(edges.select("src", "dst", "kind", *[f"e.{c}" for c in evidence], "occurrences", F.when(F.col("dst_ext"), False).alias("constraint"), "folded"), "edges")
    touched = edges.select(F.col("dst").alias("id")).distinct()
    own, outer = nodes.filter("kind <> 'external'"), nodes.filter("kind = 'external'")
    whole = own.unionByName(outer.join(touched, "id", "left_semi").select(*nodes.columns))
    place = whole.filter("kind <> 'external' and coalesce(module, '') <> ''").select("id", "module")
    across = edges.join(place.withColumnsRenamed({"id": "src", "module": "a"}), "src").join(place.withColumnsRenamed({"id": "dst", "module": "b"}), "dst").filter("a <> b").select("a", "b")
    needs = across.distinct().groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set("b")).alias("depends_on"))
    modules = place.select(F.col("module").alias("id")).distinct().join(needs, "id", "left").select("id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    rest = edges.filter("folded > 0").select(F.explode(F.sequence(F.lit(1).cast("bigint"), "folded")))
    drops = [
        *drops, drop(uses.filter("src = dst"), "자기참조 버림"), drop(told.filter("src_ext"), "R4 외부발 간선 버림"), drop(rest, "중복 간선 접음"),
        drop(outer.join(touched, "id", "left_anti"), "R1 로 제거된 외부 노드"), drop(across, "모듈 간 의존"),
    ]
    return whole, edges.drop("folded"), modules, ledger(all_of(drops))
