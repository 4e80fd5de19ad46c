"""What a collection and a seal are bound to: hashes, manifests, gates, resumes, states of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import changes

#: Kinds of artifacts that may be sealed, and the contract they are sealed under.
KINDS, CONTRACT, VERSION = ("terms-db", "wiki"), "mode1-artifacts", 1


def read_hashes(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(path, sha256) of the files below a path, by Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return files.select((F.regexp_replace(name, "^" + root.rstrip("/") + "/", "") if root else name).alias("path"), F.sha2("content", 256).alias("sha256"))


def source_hashes(cited: DataFrame, present: DataFrame) -> DataFrame:
    """(path, hash) of cited paths; those that aren't there are `missing`."""
    return cited.select("path").distinct().join(present.select("path", F.col("sha256").alias("hash")), "path", "left").withColumn("hash", F.coalesce("hash", F.lit("missing")))


def digest(hashes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, digest): sha256 of `path=hash` lines in order of path.  For a source list, which one row may hold."""
    line = F.concat("path", F.lit("="), "hash", F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "")
    return hashes.groupBy(*(key or [])).agg(F.sha2(joined, 256).alias("digest"))


def generation(fingerprint: Column, graph: Column, sources: Column, inventory: Column) -> Column:
    """The id of a collection: sha256 of four digests, a line each."""
    return F.sha2(F.concat(*[x for c in (fingerprint, graph, sources, inventory) for x in (c, F.lit("\n"))]), 256)


def fingerprint(code: Column, versions: Column, inputs: Column) -> Column:
    """sha256 of the collector's code (array<struct<path, sha256>>), tool versions and input hashes (maps), each in order of name."""
    ended = lambda c: F.concat(F.encode(c, "UTF-8"), F.unhex(F.lit("00")))
    join = lambda parts: F.aggregate(parts, F.lit("").cast("binary"), lambda a, x: F.concat(a, x))
    entries = lambda m, head: F.transform(F.array_sort(F.map_entries(m)), lambda e: ended(F.concat(F.lit(head), e["key"], F.lit("="), e["value"])))
    files = F.transform(code, lambda x: F.concat(ended(x["path"]), F.unhex(x["sha256"])))
    return F.sha2(F.concat(join(files), join(entries(versions, "")), join(entries(inputs, "input:"))), 256)


def manifest(cited: DataFrame, present: DataFrame, graph_sha: str, collector: str, fingerprint_: str, inventory_sha: str = "") -> DataFrame:
    """One row (fingerprint, codegraph_sha256, sources map, sources_sha256, inventory_sha256, raw_provenance, generation_id)."""
    hashes = source_hashes(cited, present)
    whole = hashes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "hash")))).alias("sources"))
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("\n"))), "")
    told = whole.withColumn("sources_sha256", F.sha2(joined, 256))
    provenance = "unknown" if collector == "roslyn-dump" else "prep"
    return told.select(
        F.lit(fingerprint_).alias("fingerprint"), F.lit(graph_sha).alias("codegraph_sha256"), "sources", "sources_sha256", F.lit(inventory_sha).alias("inventory_sha256"), F.lit(provenance).alias("raw_provenance"),
        generation(F.lit(fingerprint_), F.lit(graph_sha), F.col("sources_sha256"), F.lit(inventory_sha)).alias("generation_id"),
    )


def read_manifest(docs: DataFrame, graph_sha: str, text: str = "text") -> DataFrame:
    """The manifest of a graph: none where it doesn't parse, lacks a field or is of another graph."""
    shape = "struct<fingerprint:string,codegraph_sha256:string,sources:map<string,string>,sources_sha256:string,inventory_sha256:string,raw_provenance:string,generation_id:string>"
    must = ("fingerprint", "codegraph_sha256", "sources", "sources_sha256", "generation_id", "raw_provenance")
    whole = docs.filter(F.try_parse_json(text).isNotNull()).select(F.from_json(text, shape).alias("m")).select("m.*")
    return whole.filter(reduce(lambda a, c: a & F.col(c).isNotNull(), must, F.lit(True)) & (F.col("codegraph_sha256") == graph_sha))


def config_inputs(files: DataFrame, collector: str) -> DataFrame:
    """(path, sha256) of what configures a collector: its own file and the compile commands; only one collector has any."""
    mine = (F.col("path") == ".clang-uml") | F.col("path").endswith("compile_commands.json")
    return files.filter(mine if collector == "clang-uml" else F.lit(False)).select("path", "sha256")


def entries(files: DataFrame, kind: str) -> DataFrame:
    """(path, sha256) of an artifact kind's files, in order of path."""
    right = F.col("path") == "docs/codegraph/terms-db.json" if kind == "terms-db" else F.regexp("path", F.lit(r"^docs/wiki/[^/]+\.md$"))
    return files.filter(right).select("path", "sha256").orderBy("path")


def sealable(verified: DataFrame, surveys: DataFrame) -> DataFrame:
    """(repo, kind, ord): kinds of each repository that may be sealed, numbered in order of kind.

    verified (repo, kind) names what passed its check; surveys (repo, recorded,
    current) has the survey that the wiki recorded last and the one that is, a
    row a repository.  A wiki goes only with a record that is the current one;
    without a row or a record it doesn't.  Kinds that come twice count once.
    """
    late = surveys.filter(~rules.caught_up(F.col("recorded"), F.col("current"))).select("repo").distinct().withColumn("_late", F.lit(True))
    known = surveys.select("repo").distinct().withColumn("_known", F.lit(True))
    held = verified.filter("kind is not null").select("repo", "kind").distinct().join(late, "repo", "left").join(known, "repo", "left")
    good = held.filter((F.col("kind") != "wiki") | (F.col("_known") & F.col("_late").isNull())).select("repo", "kind")
    # a repository has few kinds, however many rows name them
    return good.withColumn("ord", F.row_number().over(Window.partitionBy("repo").orderBy("kind")))


def refusal(sources: DataFrame, present: DataFrame, snapshot: DataFrame, wiki_recorded: str | None, snapshot_sha: str | None, kinds: tuple[str, ...]) -> tuple[str | None, DataFrame | None]:
    """Why a seal is refused, and the files: tracked sources that are gone, sources changed since the survey, a wiki behind it.  None where nothing stands against it."""
    if not kinds or any(k not in KINDS for k in kinds):
        return "no such kind", None
    gone = changes.missing(sources, present)
    if gone.take(1):
        return "missing sources", gone
    stale = changes.unsurveyed(source_hashes(sources, present), snapshot.select("path", F.col("file_hash").alias("hash")))
    if stale.take(1):
        return "changed sources", stale
    if "wiki" in kinds and (wiki_recorded is None or wiki_recorded != snapshot_sha):
        return "wiki behind", None
    return None, None


def seal(files: DataFrame, kinds: tuple[str, ...], producer: str, source: str, inputs: DataFrame) -> dict:
    """The sealed manifest as a document: entries of each kind, and the content ids of the sources (path, id)."""
    rows = {k: [{"path": r["path"], "sha256": r["sha256"]} for r in entries(files, k).collect()] for k in kinds}
    ids = {r["path"]: r["id"] for r in inputs.orderBy("path").collect()}  # the document lists them all
    return {"contract": CONTRACT, "version": VERSION, "producer_commit": producer, "source_commit": source, "artifacts": rows, "inputs": ids}


def superseded(sealed: DataFrame, stage: str, producer: str, now: Column | None = None) -> DataFrame:
    """A sealed manifest's row with the mark of a later failure and when it was made, UTC."""
    at = rules.utc_stamp(F.current_timestamp() if now is None else now)
    return sealed.withColumn("superseded_by", F.struct(F.lit(stage).alias("stage"), at.alias("at"), F.lit(producer).alias("producer_commit")))


def load_manifest(docs: DataFrame, text: str = "text") -> DataFrame:
    """(manifest, why): a sealed manifest, or why it isn't one."""
    shape = "struct<contract:string,version:int,producer_commit:string,source_commit:string,artifacts:map<string,array<struct<path:string,sha256:string>>>,inputs:map<string,string>>"
    m = F.from_json(text, shape)
    why = F.when(F.try_parse_json(text).isNull(), "not JSON").when(m["contract"].isNull() | (m["contract"] != CONTRACT), "another contract").when(m["version"].isNull() | (m["version"] != VERSION), "another version").when(m["artifacts"].isNull(), "no artifacts")
    return docs.select(m.alias("manifest"), why.alias("why")).withColumn("manifest", F.when(F.col("why").isNull(), F.col("manifest")))


def gate(receipt: DataFrame, graph_sha: str, batches: DataFrame | None = None, ranking: DataFrame | None = None) -> DataFrame:
    """(why): the first thing that stands against going on from a verified graph; null where nothing does.

    receipt (status, codegraph_sha256, generation_id), batches
    (codegraph_sha256, generation_id) and ranking (generation_id) have one row
    each, or none where they weren't written.
    """
    one = receipt.sparkSession.range(1).select(F.lit(1).alias("_1"))
    held = one.join(receipt.select(F.lit(1).alias("_1"), "status", F.col("codegraph_sha256").alias("r_sha"), F.col("generation_id").alias("r_gen")), "_1", "left")
    why = F.when(F.col("r_sha").isNull(), "no receipt").when(F.col("status") != "passed", "not passed").when(F.col("r_sha") != graph_sha, "receipt of another graph")
    if batches is not None:
        held = held.join(batches.select(F.lit(1).alias("_1"), F.col("codegraph_sha256").alias("b_sha"), F.col("generation_id").alias("b_gen")), "_1", "left")
        why = why.when(F.col("b_sha").isNull(), "no batches").when((F.col("b_sha") != graph_sha) | ~F.col("b_gen").eqNullSafe(F.col("r_gen")), "batches of another graph")
    if ranking is not None:
        held = held.join(ranking.select(F.lit(1).alias("_1"), F.col("generation_id").alias("k_gen")), "_1", "left")
        why = why.when(F.col("k_gen").isNull(), "no ranking").when(~F.col("k_gen").eqNullSafe(F.col("r_gen")), "ranking of another collection")
    return held.select(why.alias("why"))


def resume(rows: DataFrame, order: list[str], graph: str, verified: list[str]) -> DataFrame:
    """(graph, failed_at, why, done, verified) of the first row that failed and wasn't skipped; no row where none did.

    rows (ord, stage, ok, skipped, why); stage/part counts as its stage; done are
    the stages before it.
    """
    failed = rows.filter("not coalesce(ok, false) and not coalesce(skipped, false)").agg(F.min_by(F.struct("stage", "why"), "ord").alias("f")).filter("f is not null")
    stage = F.substring_index("f.stage", "/", 1)
    names = F.array(*map(F.lit, order)) if order else F.array().cast("array<string>")
    done = F.slice(names, F.lit(1), F.greatest(F.array_position(names, stage).cast("int") - 1, F.lit(0)))
    return failed.select(F.lit(graph).alias("graph"), stage.alias("failed_at"), F.coalesce("f.why", F.lit("")).alias("why"), done.alias("done"), F.array_sort(F.array(*map(F.lit, verified)) if verified else F.array().cast("array<string>")).alias("verified"))


def start_stage(resumes: DataFrame, graph: str) -> DataFrame:
    """(stage, verified): where a run of this graph goes on, and what it carries over; no row for another graph."""
    return resumes.filter(F.col("graph") == graph).select(F.col("failed_at").alias("stage"), "verified")


def existing(artifacts: DataFrame, present: DataFrame) -> DataFrame:
    """Artifacts (name, path) that are already there."""
    return artifacts.join(present.select("path").distinct(), "path", "left_semi").select(*artifacts.columns)


def first_present(names: DataFrame, present: DataFrame) -> DataFrame:
    """(path): the first of names (path, rank) that is there."""
    return names.join(present.select("path").distinct(), "path", "left_semi").agg(F.min_by("path", "rank").alias("path"))


def snapshot_hashes(snapshot: DataFrame) -> DataFrame:
    """(path, hash) of a snapshot's files that could be read."""
    return snapshot.filter("file_hash is not null").select("path", F.col("file_hash").alias("hash"))


def record_pages(state: DataFrame, written: DataFrame) -> DataFrame:
    """(page, hash): the state with the pages just written; others keep what was recorded."""
    from ..sources.sinks import upsert

    return upsert(state.select("page", "hash"), written.select("page", "hash"), ["page"])


def written_pages(jobs: DataFrame, present: DataFrame) -> DataFrame:
    """(page, state): pages of a round that are there now, and those that aren't."""
    have = present.select("page").distinct().withColumn("_have", F.lit(True))
    return jobs.select("page").distinct().join(have, "page", "left").select("page", F.when(F.col("_have"), "written").otherwise("unwritten").alias("state"))


def backups(edited: DataFrame, kept: DataFrame) -> DataFrame:
    """(page, moved_to): names for edited pages that overwrite none of those kept before: the page's own, or its stem with the least free number.

    Kept names are matched by stem, so a page only looks at its own earlier copies.
    """
    parts = lambda df: df.select("page", F.regexp_extract("page", r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), F.regexp_extract("page", r"^(.*?)(\.[^.]*)?$", 2).alias("ext")).distinct()
    number = F.regexp_extract("stem", r"^.*\.([0-9]+)$", 1)
    old = parts(kept)
    taken = old.select("stem", "ext", F.lit(0).alias("k")).unionByName(old.filter(number != "").select(F.regexp_extract("stem", r"^(.*)\.[0-9]+$", 1).alias("stem"), "ext", number.cast("int").alias("k")))
    used = taken.groupBy("stem", "ext").agg(F.collect_set("k").alias("used"))
    free = F.filter(F.sequence(F.lit(0), F.size("used")), lambda k: ~F.array_contains("used", k))[0]
    rows = parts(edited).join(used, ["stem", "ext"], "left").withColumn("k", F.coalesce(free, F.lit(0)))
    return rows.select("page", F.concat(F.lit(".bak/"), F.when(F.col("k") == 0, F.col("page")).otherwise(F.concat("stem", F.lit("."), F.col("k").cast("string"), "ext"))).alias("moved_to"))


def outlines(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, outline): cached outlines whose content is still that of the file; null is a miss.  wanted (path, sha1), cache (path, sha1, outline)."""
    return wanted.join(cache.select("path", "sha1", "outline"), ["path", "sha1"], "left").select("path", "outline")


def put_outline(cache: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The cache with fresh outlines (path, sha1, outline) in place of older ones of their paths."""
    from ..sources.sinks import upsert

    return upsert(cache, fresh.select("path", "sha1", "outline"), ["path"])


def claimed(stamp: str | None, plan_sha: str, entries_: DataFrame, taken: list[str]) -> tuple[DataFrame, str | None]:
    """Entries of a shard folder that belong to another plan, and the folder they move to; none where the stamp is the plan's.

    An unreadable stamp is none.  A folder of that name is never written into again.
    """
    old = stamp if stamp and len(stamp) == 64 and all(c in "0123456789abcdef" for c in stamp) else ""
    if old == plan_sha:
        return entries_.limit(0), None
    name = old[:12] or "unstamped"
    dest, k = name, 1
    while dest in taken:
        k += 1
        dest = f"{name}-{k}"
    return entries_, dest


def merge_entries(lists: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Compile entries (list, pos, file, directory) as (file), the first of each file, and those dropped with their reason.

    Paths become absolute; reasons by precedence: outside-repo, external, duplicate-config.
    """
    from ..functions import fixed

    base = F.coalesce(F.nullif("directory", F.lit("")), F.lit(repo))
    full = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat(base, F.lit("/"), "file"))
    steps = F.filter(F.split(full, "/"), lambda s: (s != "") & (s != "."))
    normal = F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))), "/"))
    told = lists.filter("file is not null").withColumn("full", normal)
    outside = ~F.col("full").startswith(repo)
    external = reduce(lambda a, m: a | F.contains("full", F.lit(m)), fixed.EXTERNAL_MARKERS, F.lit(False))
    good = told.withColumn("reason", F.when(outside, "outside-repo").when(external, "external"))
    rank = F.row_number().over(Window.partitionBy("full").orderBy("list", "pos"))
    kept = good.filter("reason is null").withColumn("_rn", rank)
    dropped = good.filter("reason is not null").unionByName(kept.filter("_rn > 1").drop("_rn").withColumn("reason", F.lit("duplicate-config")))
    return kept.filter("_rn = 1").select(F.col("full").alias("file"), "list", "pos"), dropped.select(F.col("full").alias("file"), "list", "pos", "reason")
