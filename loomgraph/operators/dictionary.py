"""The dictionary of a code graph: its records and uses, what reading adds, and the graph back.

Records are (name, id, kind, module, where, means, does, near, neighbours,
source, hotspot), keyed by name; near holds the neighbours that a record states
itself, which only a module's do.  Uses are (name, to, kind, label, where, ord,
source), as often as they come, in the order of ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, rules
from ..session import cut
from . import stored

RECORD = ["name", "id", "kind", "module", "where", "means", "does", "near", "neighbours", "source", "hotspot"]
USE = ["name", "to", "kind", "label", "where", "ord", "source"]


def _place(file: Column, line: Column) -> Column:
    """file:line, the file alone, or the empty text."""
    return F.when(F.coalesce(file, F.lit("")) == "", "").when(F.coalesce(line, F.lit(0)) == 0, file).otherwise(F.concat(file, F.lit(":"), line.cast("string")))


def _shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast.

    Files of many like rows are small, so Spark would think that records are few
    and hold them all in the driver.
    """
    return df.hint("merge")


def _hashed(df: DataFrame) -> DataFrame:
    """df, with one small row for a key, as the right side of a join with far more rows: never broadcast, and the many are shuffled but not sorted."""
    return df.hint("shuffle_hash")


def neighboured(records: DataFrame, uses: DataFrame) -> DataFrame:
    """records with neighbours: what a module states, and both ends of uses between records, sorted, without itself."""
    keys = records.select("name")
    pairs = uses.select("name", F.col("to").alias("other")).filter("name <> other").distinct().join(_shuffled(keys.withColumnRenamed("name", "other")), "other", "left_semi").join(_shuffled(keys), "name", "left_semi")
    both = pairs.select("name", "other").unionByName(pairs.select(F.col("other").alias("name"), F.col("name").alias("other")))
    stated = records.filter(F.col("kind") == "module").select("name", F.explode("near").alias("other"))
    near = both.unionByName(stated).filter("other <> ''").groupBy("name").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))
    return records.drop("neighbours").join(_shuffled(near), "name", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>"))).select(RECORD)


def entries(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """Records of a graph's nodes (ord, id, name, kind, module, file, line) and modules (id, depends_on), still without neighbours and without what a node means.

    Of nodes that share a name the last is meant.  A module is a record unless a
    node has its name; what it means counts its nodes and names the first
    modules it depends on.
    """
    named = nodes.filter(F.coalesce("name", F.lit("")) != "")
    last = named.groupBy("name").agg(F.max_by(F.struct("id", "kind", "module", "file", "line"), "ord").alias("r")).select("name", "r.*")
    nothing = F.array().cast("array<string>")
    own = last.select(
        "name", F.when(F.coalesce("id", F.lit("")) == "", F.col("name")).otherwise(F.col("id")).alias("id"), F.coalesce("kind", F.lit("type")).alias("kind"), F.coalesce("module", F.lit("")).alias("module"),
        _place(F.col("file"), F.col("line")).alias("where"), F.lit("").alias("means"), F.lit(None).cast("string").alias("does"), nothing.alias("near"), nothing.alias("neighbours"), F.lit("codegraph").alias("source"), F.lit(False).alias("hotspot"),
    )
    members = nodes.filter(F.coalesce("module", F.lit("")) != "").groupBy(F.col("module").alias("name")).agg(F.count("*").alias("n"))
    deps = F.array_sort(F.coalesce("depends_on", nothing))
    told = F.concat(F.format_string(fixed.MODULE_MEANS, F.coalesce("n", F.lit(0))), F.when(F.size("near") > 0, F.format_string(fixed.MODULE_NEEDS, F.array_join(F.slice("near", 1, fixed.SHOWN_NAMES), ", "))).otherwise(""))
    groups = modules.filter(F.coalesce("id", F.lit("")) != "").select(F.col("id").alias("name"), deps.alias("near")).join(_shuffled(own.select("name")), "name", "left_anti").join(_shuffled(members), "name", "left")
    groups = groups.select("name", F.col("name").alias("id"), F.lit("module").alias("kind"), F.col("name").alias("module"), F.lit("").alias("where"), told.alias("means"), F.lit(None).cast("string").alias("does"), "near", nothing.alias("neighbours"), F.lit("codegraph").alias("source"), F.lit(False).alias("hotspot"))
    return own.unionByName(groups)


def uses_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Uses of a graph's edges (ord, src, dst, kind, label, file, line) between nodes (ord, id, name); of nodes that share an id the last is meant."""
    by_id = cut(nodes.groupBy("id").agg(F.max_by("name", "ord").alias("name")).filter("coalesce(name, '') <> ''"), "dictionary-ids")
    ends = lambda e, n: by_id.select(F.col("id").alias(e), F.col("name").alias(n))
    uses = edges.join(_hashed(ends("src", "name")), "src").join(_hashed(ends("dst", "to")), "dst")
    return uses.select("name", "to", F.coalesce("kind", F.lit("dependency")).alias("kind"), "label", _place(F.col("file"), F.col("line")).alias("where"), "ord", F.lit(None).cast("string").alias("source"))


def build(nodes: DataFrame, edges: DataFrame, modules: DataFrame, hotspots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and uses of a graph: entries() and uses_of(), hotspots (name); what a node means names its first neighbours."""
    uses = cut(uses_of(nodes, edges), "dictionary-uses")
    records = cut(neighboured(cut(entries(nodes, modules), "dictionary"), uses), "dictionary")
    about = F.concat(F.format_string(fixed.NODE_MEANS, "module", "kind"), F.when(F.size("neighbours") > 0, F.format_string(fixed.NODE_NEAR, F.array_join(F.slice("neighbours", 1, fixed.SHOWN_NAMES), ", "))).otherwise(""))
    records = records.withColumn("means", F.when(F.col("kind") == "module", F.col("means")).otherwise(about))
    if hotspots is not None:
        hot = hotspots.select("name").distinct().withColumn("_h", F.lit(True))
        records = records.join(hot, "name", "left").withColumn("hotspot", F.coalesce("_h", F.lit(False)))
    return records.select(RECORD), uses.select(USE)


def merge(records: DataFrame, uses: DataFrame, read: DataFrame, read_uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary with what reading says: read (name, kind, module, where, means, does), read_uses (name, to, kind, label, where, ord).

    The structure of a known record stays; any means or does that isn't empty
    wins, and uses whose (to, kind) it lacks are added, the first of each, and
    marked.  Records that were unknown come as they are.
    """
    known = records.select("name")
    r = read.select("name", *[F.col(c).alias(f"r_{c}") for c in ("kind", "module", "where", "means", "does")], F.lit(True).alias("r_here"))
    both = records.withColumn("b_here", F.lit(True)).join(r, "name", "full_outer")
    here = F.col("b_here").isNotNull()
    wins = lambda c: F.coalesce(F.when(F.col(f"r_{c}") != "", F.col(f"r_{c}")), F.col(c))
    nothing = F.array().cast("array<string>")
    source = F.when(~here, "reading").when(F.col("r_here"), "codegraph+reading").otherwise(F.col("source"))
    merged = both.select(
        "name", "id", *[F.when(here, F.col(c)).otherwise(F.col(f"r_{c}")).alias(c) for c in ("kind", "module", "where")], F.when(here, wins("means")).otherwise(F.col("r_means")).alias("means"), F.when(here, wins("does")).otherwise(F.col("r_does")).alias("does"),
        F.coalesce("near", nothing).alias("near"), nothing.alias("neighbours"), source.alias("source"), F.coalesce("hotspot", F.lit(False)).alias("hotspot"),
    )
    key = ["name", "to", "kind"]
    old = read_uses.join(known, "name", "left_semi").groupBy(*key).agg(F.min_by(F.struct("label", "where", "ord"), "ord").alias("u")).join(uses.select(*key).distinct(), key, "left_anti")
    added = old.select(*key, "u.label", "u.where", "u.ord", F.lit("reading").alias("source"))
    new = read_uses.join(known, "name", "left_anti").select(*key, "label", "where", "ord", F.lit(None).cast("string").alias("source"))
    whole = cut(uses.unionByName(added).unionByName(new), "dictionary-uses")
    return neighboured(cut(merged, "dictionary"), whole), whole


def project(records: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph back: nodes (id, name, kind, module, file, line), edges (src, dst, kind, label, file, line, occurrences, constraint) and modules (id, depends_on).

    Records that are no nodes go with their uses.
    """
    nodes = cut(project_nodes(records), "projected-nodes")
    return nodes, project_edges(nodes, uses), project_modules(nodes, uses)


def project_nodes(records: DataFrame) -> DataFrame:
    place = rules.split_where(F.nullif("where", F.lit("")))
    own = records.filter(~F.coalesce(F.col("kind").isin(*fixed.NON_NODE_KINDS), F.lit(False)))
    return own.select(F.coalesce(F.nullif("id", F.lit("")), "name").alias("id"), "name", "kind", "module", place["file"].alias("file"), place["line"].alias("line"))


def project_edges(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """Edges of nodes and stored uses.  An edge has the evidence of its first use; one to an external node isn't constrained (false)."""
    n = uses.count()
    src = nodes.select("name", F.col("id").alias("src"))
    dst = nodes.select(F.col("name").alias("to"), F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    told = stored.join_unique(stored.join_unique(uses, _shuffled(src), "name", n), _shuffled(dst), "to", n)
    first = told.groupBy("src", "dst", "kind").agg(F.min_by(F.struct("label", "where", "dst_kind"), F.struct("name", "ord")).alias("e"), F.count("*").alias("occurrences"))
    at = rules.split_where(F.nullif("where", F.lit("")))
    return first.select("src", "dst", "kind", "e.*", "occurrences").select("src", "dst", "kind", "label", at["file"].alias("file"), at["line"].alias("line"), "occurrences", F.when(F.col("dst_kind") == "external", F.lit(False)).alias("constraint"))


def project_modules(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """Modules of stored nodes, and the others that their uses lead to.  Uses are read once and only by their ends, so neither they nor edges need be stored."""
    within = nodes.filter("coalesce(module, '') <> ''")
    own = within.filter("kind <> 'external'")
    src = within.select("name", F.col("module").alias("id"))
    dst = own.select(F.col("name").alias("to"), F.col("module").alias("dst_module"))
    told = uses.select("name", "to").join(_hashed(dst), "to").join(_hashed(src), "name").filter("id <> dst_module").select("id", "dst_module").distinct()
    across = told.groupBy("id").agg(F.array_sort(F.collect_set("dst_module")).alias("depends_on"))
    return own.select(F.col("module").alias("id")).distinct().join(_shuffled(across), "id", "left").select("id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
