"""From a C# compiler's types and relations to a code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import cut
from .assemble import all_of, assemble, drop, external_nodes, node_ids, ords
from .normalize import outside

DEPTH = 4
TYPES = "id string, name string, kind string, assembly string, file string, line int, generic_def string, type_args array<string>, ord bigint"
RELATIONS = "kind string, src string, dst string, member string, attrs array<string>, is_enum_member boolean, origin string, file string, line int, ord bigint"


def project_module(path: Column) -> Column:
    """The module of a script: the folder below the scripts' root, the editors, or the first folder."""
    parts = F.split(path, "/")
    assets, n = parts[0] == "Assets", F.size(parts)
    second = F.try_element_at(parts, F.lit(2))
    scripts = F.when(n > 3, F.try_element_at(parts, F.lit(3))).otherwise("@Scripts")
    return F.when(F.coalesce(path, F.lit("")) == "", None).when(assets & (second == "@Scripts") & (n >= 3), scripts).when(assets & (second == "@Editors") & (n >= 2), "@Editors").otherwise(parts[0])


def assembly_group(assembly: Column, package: Column, parent: Column) -> Column:
    """The name external types of an assembly fold to; package is the assembly's own, parent that of an assembly it extends by a dot."""
    module = F.regexp_extract(assembly, r"^UnityEngine\.(\w+)Module$", 1)
    return (
        F.when(F.coalesce(assembly, F.lit("")) == "", fixed.OTHER_LABEL)
        .when(package.isNotNull(), package)
        .when(assembly.startswith("UnityEditor"), fixed.CS_EDITOR)
        .when((module != "") & (module != "Core"), F.concat(F.lit(fixed.CS_MODULE), F.lower(module)))
        .when(assembly.startswith("UnityEngine"), F.concat(F.lit(fixed.CS_ENGINE), assembly))
        .when(assembly.isin("netstandard", "mscorlib") | assembly.startswith("System"), fixed.CS_BCL)
        .when(parent.isNotNull(), parent)
        .otherwise(F.concat(F.lit(fixed.CS_VENDORED), assembly))
    )


def grouped(types: DataFrame, packages: DataFrame) -> DataFrame:
    """types with group: what each folds to where it is external.  packages: (assembly, package, ord)."""
    known = packages.select("assembly", "package")
    named = types.join(known, "assembly", "left")
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split("assembly", r"\.")) - 1), lambda k: F.array_join(F.slice(F.split("assembly", r"\."), 1, k), "."))
    dotted = types.filter(F.instr("assembly", ".") > 0).select("assembly").distinct().select("assembly", F.explode(heads).alias("head"))
    parent = dotted.join(packages.select(F.col("assembly").alias("head"), F.col("package").alias("p"), "ord"), "head").groupBy("assembly").agg(F.min_by("p", "ord").alias("parent"))
    return named.join(parent, "assembly", "left").withColumn("group", assembly_group(F.col("assembly"), F.col("package"), F.col("parent"))).select(*types.columns, "group")


def refused(errors: int, unresolved_types: int) -> bool:
    """A dump whose references were wrong is not read."""
    return bool(errors or unresolved_types)


def is_first(assembly: Column, own: str) -> Column:
    """Whose type it is goes by assembly: external containers carry the place of their first use."""
    return F.coalesce(assembly == own, F.lit(False))


def resolve(types: DataFrame, own: str, depth: int = DEPTH) -> tuple[DataFrame, list[DataFrame]]:
    """(start, id, pos): the types that each stands for, and drops by start.  Containers stand for their arguments; type parameters and error types for nothing."""
    wrapper = F.coalesce(F.col("generic_def").isin(*fixed.CS_TRANSPARENT), F.lit(False))
    role = F.when(wrapper, "wrapper").when(is_first(F.col("assembly"), own), "own").when(F.col("kind") == "TypeParameter", "parameter").when(F.col("kind") == "Error", "error").otherwise("external")
    told = cut(types.select("id", role.alias("role"), F.coalesce("type_args", F.array().cast("array<string>")).alias("args")), "type-roles")
    ended, passed = [], []
    front = told.select(F.col("id").alias("start"), "id", F.array().cast("array<int>").alias("pos"))
    for step in range(depth + 1):
        at = cut(front.join(told, "id"), "type-front")
        ended.append(at.filter("role <> 'wrapper'").select("start", "id", "pos", "role"))
        passed.append(at.filter("role = 'wrapper'").select("start"))
        if step == depth or not at.filter("role = 'wrapper'").take(1):
            break
        front = at.filter("role = 'wrapper'").select("start", "pos", F.posexplode("args").alias("k", "arg")).select("start", F.col("arg").alias("id"), F.concat("pos", F.array("k")).alias("pos"))
    out = cut(all_of(ended), "type-ends")
    drops = [
        all_of(passed).select("start", F.lit("R5 투과 래퍼 경유").alias("reason"), F.lit(None).cast("string").alias("sample")),
        out.filter("role = 'parameter'").select("start", F.lit("dst TypeParameter 버림").alias("reason"), F.lit(None).cast("string").alias("sample")),
        out.filter("role = 'error'").select("start", F.lit("dst Error 버림").alias("reason"), F.col("id").alias("sample")),
    ]
    return out.filter("role in ('own', 'external')").select("start", "id", "pos", "role"), drops


def normalize(types: DataFrame, relations: DataFrame, own: str, packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, edges (with origin and attrs), modules and ledger of a dump: types (TYPES), relations (RELATIONS), the assembly that is the repository's, and (assembly, package, ord).

    Instances of an own generic fold to the definition at their place.
    External types get a node only where a relation leads to them.
    """
    types = cut(grouped(types, packages), "types")
    mine = types.filter(is_first(F.col("assembly"), own))
    plain, made = mine.filter("coalesce(size(type_args), 0) <= 0"), mine.filter("size(type_args) > 0")
    ids = cut(node_ids(plain.select(F.col("id").alias("key"), F.lit(False).alias("external"), ords("ord").alias("ord"))), "type-ids").select(F.col("key").alias("tid"), "id")
    placed = plain.select(F.col("id").alias("tid"), "file", "line", "ord").join(ids, "tid").groupBy("file", "line").agg(F.max_by("id", "ord").alias("id"))
    m, p = made.alias("m"), placed.alias("p")
    instances = m.join(p, F.col("m.file").eqNullSafe(F.col("p.file")) & F.col("m.line").eqNullSafe(F.col("p.line"))).select(F.col("m.id").alias("tid"), F.col("p.id").alias("id"))
    ends, noted = resolve(types, own)
    kind = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in fixed.CS_KIND.items()])
    told = cut(relations.withColumn("edge_kind", kind), "relations")
    used = told.filter("not is_enum_member and edge_kind is not null")
    drops = [drop(told.filter("is_enum_member"), "enum 멤버 버림(플래그)"), drop(told.filter("not is_enum_member and edge_kind is null"), "모르는 관계 종류", F.col("kind"), ords("ord")), drop(plain, "1차 노드"), drop(instances, "소스 제네릭 인스턴스 접음"), drop(packages, "asm->pkg 사전")]
    # every walk of an end is counted as often as relations take it
    for note in noted:
        for k, end in enumerate(("src", "dst")):
            drops.append(used.select(F.col(end).alias("start"), "ord").join(note, "start").select("reason", "sample", F.array(F.col("ord").cast("bigint"), F.lit(k).cast("bigint")).alias("ord")))
    side = lambda end: ends.select(F.col("start").alias(end), F.col("id").alias(f"{end}_id"), F.col("pos").alias(f"{end}_pos"))
    names = types.select(F.col("id").alias("dst_id"), F.col("name").alias("dst_name"))
    targets = cut(used.join(side("dst"), "dst").join(names, "dst_id"), "targets")
    drops.append(drop(targets.filter(F.col("dst_name").isin(*fixed.CS_BASE_TYPES)), "R7 원시·암묵 기반 버림"))
    pairs = targets.filter(~F.col("dst_name").isin(*fixed.CS_BASE_TYPES)).join(side("src"), "src")
    known = ids.unionByName(instances)
    outer = types.select(F.col("id").alias("tid"), "name", F.concat(F.lit("X:"), "group").alias("out_id"), "group")
    # an own instance without a definition is no node of its own: it folds as external types do
    look = cut(outer.join(known, "tid", "left").select("tid", F.coalesce("id", "out_id").alias("id"), F.col("id").isNull().alias("out"), "name", "group"), "type-nodes")
    end = lambda e: look.select(F.col("tid").alias(f"{e}_id"), F.col("id").alias(f"{e}_node"))
    linked = cut(pairs.join(end("src"), "src_id").join(end("dst"), "dst_id"), "links")
    reached = linked.select(F.col("src_id").alias("tid")).unionByName(linked.select(F.col("dst_id").alias("tid"))).distinct()
    folded = look.filter("out").join(reached, "tid", "left_semi")
    drops.append(drop(folded, "외부 원본 타입"))
    none = F.lit(None)
    nodes = plain.select(F.col("id").alias("tid"), "name", F.lower(F.coalesce(F.nullif("kind", F.lit("")), F.lit("class"))).alias("kind"), project_module(F.col("file")).alias("module"), "file", "line").join(ids, "tid").select(
        "id", "name", "kind", "module", "file", "line", none.cast("string").alias("signature"), none.cast("string").alias("doc"), none.cast("string").alias("abstraction"), none.cast("array<string>").alias("collapsed_from"),
    )
    nodes = nodes.unionByName(outside(external_nodes(folded.select("id", F.col("group").alias("name"), F.col("name").alias("raw"))), nodes.columns))
    order = F.concat(F.array(F.col("ord").cast("bigint")), F.transform(F.concat("dst_pos", F.array(F.lit(-1)), "src_pos"), lambda x: x.cast("bigint")))
    uses = linked.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), F.col("edge_kind").alias("kind"), F.col("member").alias("label"), "file", "line", "origin", F.when(F.size("attrs") > 0, F.col("attrs")).alias("attrs"), order.alias("ord"))
    return assemble(cut(nodes, "nodes"), uses, drops)
