"""Reading plans: batches, candidates for a second pass, excerpts, pages, and what a seal still lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import document_name, similar
from ..session import cut
from .ordered import numbered


def in_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, into): in-edges from other files, by name; names without any keep a row."""
    place = nodes.select("id", "file", "name")
    pairs = edges.join(place.select(F.col("id").alias("src"), F.col("file").alias("sf")), "src").join(place.select(F.col("id").alias("dst"), F.col("file").alias("df"), "name"), "dst").filter(~F.col("sf").eqNullSafe(F.col("df")))
    counts = pairs.groupBy("name").agg(F.count("*").alias("into"))
    return nodes.select("name").distinct().join(counts, "name", "left").select("name", F.coalesce("into", F.lit(0)).alias("into"))


def hot_keys(batches: DataFrame, records: DataFrame, into: DataFrame) -> DataFrame:
    """(batch, name): planned names that have a record, a shallow one, and in-edges."""
    rows = batches.select("batch", "name").join(records.filter("shallow").select("name").distinct(), "name", "left_semi")
    return rows.join(into.filter("into > 0").select("name"), "name", "left_semi").select("batch", "name")


def second_pass_candidates(hot: DataFrame, needs: DataFrame, merged: DataFrame, into: DataFrame, queued: DataFrame) -> DataFrame:
    """(batch, into): batches not queued whose hot names have all their needs (name, dep) merged, most wanted first."""
    present = merged.select(F.col("name").alias("dep")).distinct().withColumn("_p", F.lit(True))
    ready = hot.join(needs, "name", "left").join(present, "dep", "left").groupBy("batch").agg(F.bool_and(F.col("dep").isNull() | F.col("_p").isNotNull()).alias("ready"))
    most = hot.join(into, "name").groupBy("batch").agg(F.max("into").alias("into"))
    return ready.filter("ready").join(queued.select("batch").distinct(), "batch", "left_anti").join(most, "batch").select("batch", "into").orderBy(F.desc("into"), "batch")


def known_excerpt(members: DataFrame, needs: DataFrame, merged: DataFrame) -> DataFrame:
    """(batch, dep, means): needs of a batch that are already described."""
    rows = members.join(needs, "name").select("batch", "dep").distinct()
    return rows.join(merged.select(F.col("name").alias("dep"), F.coalesce("means", F.lit("")).alias("means")), "dep").select("batch", "dep", "means")


def pending_excerpt(members: DataFrame, needs: DataFrame, merged: DataFrame) -> DataFrame:
    """(batch, dep): needs outside the batch that nothing describes yet."""
    rows = members.join(needs, "name").select("batch", "dep").distinct()
    own = members.select("batch", F.col("name").alias("dep")).distinct()
    return rows.join(own, ["batch", "dep"], "left_anti").join(merged.select(F.col("name").alias("dep")).distinct(), "dep", "left_anti").select("batch", "dep")


def page_layers(pages: DataFrame, layer: DataFrame) -> DataFrame:
    """(page, layer): the highest layer of a page's known symbols; 0 where there are none."""
    rows = pages.select("page", F.explode_outer("symbols").alias("id")).join(layer.select("id", "level"), "id", "left")
    return rows.groupBy("page").agg(F.coalesce(F.max("level"), F.lit(0)).alias("layer"))


def next_pages(layers: DataFrame, present: DataFrame) -> DataFrame:
    """(page, layer, lower): pages to write, with how many lower pages are there already."""
    have = present.select("page").distinct().withColumn("_have", F.lit(1))
    marked = layers.join(have, "page", "left")
    count = marked.groupBy("layer").agg(F.sum(F.coalesce("_have", F.lit(0))).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)  # one row a layer
    below = count.withColumn("lower", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return marked.filter("_have is null").join(below.select("layer", "lower"), "layer").select("page", "layer", "lower").orderBy("layer", "page")


def page_state(pages: DataFrame, recorded: DataFrame, changed: DataFrame) -> DataFrame:
    """(page, state): unknown where no hash is recorded, edited where it differs, stale where sources changed, else fresh.

    pages (page, hash), recorded (page, hash), changed (page).
    """
    old = recorded.select("page", F.col("hash").alias("_old"))
    hit = changed.select("page").distinct().withColumn("_hit", F.lit(True))
    rows = pages.join(old, "page", "left").join(hit, "page", "left")
    return rows.select("page", F.when(F.col("_old").isNull(), "unknown").when(F.col("_old") != F.col("hash"), "edited").when(F.col("_hit"), "stale").otherwise("fresh").alias("state"))


def shard_state(plan: DataFrame, shards: DataFrame, faults: DataFrame) -> DataFrame:
    """(batch, state): missing, faulty, uncovered (a planned key isn't written, or an extra one is) or good."""
    planned, written = plan.select("batch", "key").distinct(), shards.select("batch", "key").distinct()
    odd = planned.join(written, ["batch", "key"], "left_anti").unionByName(written.join(planned, ["batch", "key"], "left_anti")).select("batch").distinct().withColumn("_odd", F.lit(True))
    has = written.select("batch").distinct().withColumn("_has", F.lit(True))
    bad = faults.select("batch").distinct().withColumn("_bad", F.lit(True))
    rows = planned.select("batch").distinct().join(has, "batch", "left").join(bad, "batch", "left").join(odd, "batch", "left")
    return rows.select("batch", F.when(F.col("_has").isNull(), "missing").when(F.col("_bad"), "faulty").when(F.col("_odd"), "uncovered").otherwise("good").alias("state"))


def judged(sealed: DataFrame, needed: DataFrame, optional: bool) -> DataFrame:
    """(kind): the kinds to judge; if they are optional those that are sealed, and all where none is."""
    need = needed.select("kind").distinct()
    if not optional:
        return need
    there = need.join(sealed.select("kind").distinct(), "kind", "left_semi")
    return there.unionByName(need.join(F.broadcast(there.agg(F.count("*").alias("_n"))), F.col("_n") == 0).select("kind"))  # one row


def seal_problems(sealed: DataFrame, present: DataFrame, needed: DataFrame, contract: DataFrame | None = None, optional: bool = False, shape: DataFrame | None = None) -> DataFrame:
    """(kind, path, problem): kinds that a seal lacks, wrong places, missing files, other hashes, extra wiki pages.

    contract is the seal's row (contract, version): where it is another, that is
    the only problem.  Only needed kinds are judged (judged).  shape (problem)
    says what is wrong with the form of the terms, which counts where they are
    needed and nothing else is wrong.
    """
    from ..functions.rules import entry_fits

    nothing = F.lit(None).cast("string")
    if contract is not None:
        other = contract.filter(~(F.col("contract").eqNullSafe(F.lit(fixed.SEAL_CONTRACT)) & F.col("version").eqNullSafe(F.lit(fixed.SEAL_VERSION)))).limit(1)
        if other.take(1):
            return other.select(nothing.alias("kind"), nothing.alias("path"), F.format_string("contract %s, version %s", "contract", F.col("version").cast("string")).alias("problem"))
    need = judged(sealed, needed, optional)
    absent = need.join(sealed.select("kind").distinct(), "kind", "left_anti").select("kind", nothing.alias("path"), F.lit("no entry").alias("problem"))
    now = present.select("path", F.col("sha256").alias("_now"))
    # merge: files of many like rows are small, so Spark would think the paths are few and broadcast them
    rows = sealed.join(need, "kind", "left_semi").join(now.hint("merge"), "path", "left")
    problem = F.when(~entry_fits(F.col("kind"), F.col("path")), "wrong place").when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("sha256"), "changed")
    found = rows.select("kind", "path", problem.alias("problem")).filter("problem is not null")
    pages = sealed.filter("kind = 'wiki'").join(need, "kind", "left_semi")
    extra = present.filter(F.regexp("path", F.lit(r"^wiki/[^/]+\.md$"))).join(pages.select("path").hint("merge"), "path", "left_anti").select(F.lit("wiki").alias("kind"), "path", F.lit("extra page").alias("problem")).join(pages.select("kind").distinct(), "kind", "left_semi").select("kind", "path", "problem")
    whole = absent.unionByName(found).unionByName(extra)
    if shape is not None and need.filter("kind = 'terms'").take(1) and not whole.take(1):
        return shape.select(F.lit("terms").alias("kind"), nothing.alias("path"), "problem")
    return whole


def listed_documents(listing: DataFrame) -> DataFrame:
    """(dir, file, date, slug) of files (dir, file) that are named like the documents of their folder."""
    named = document_name(F.col("file"), F.col("dir"))
    return listing.select("dir", "file", named["date"].alias("date"), named["slug"].alias("slug")).filter("slug is not null")


def document_of(listing: DataFrame, slug: str, folder: str = "specs") -> DataFrame:
    """(dir, file, date, slug): the first file of a folder, by ord, whose slug is this one and not merely holds it."""
    own = listing.filter(F.col("dir") == folder)
    return listed_documents(own).join(own.select("file", "ord"), "file").filter(F.col("slug") == slug).orderBy("ord").limit(1).select("dir", "file", "date", "slug")


def without_report(listing: DataFrame, reports: DataFrame) -> DataFrame:
    """(place, date, dir, slug, near): documents that have no report (dir, slug), the newest first, each with the slugs like its own."""
    docs = cut(listed_documents(listing).select("dir", "date", "slug").distinct(), "documents")
    lacking = docs.join(reports.select("dir", "slug").distinct(), ["dir", "slug"], "left_anti")
    # slugs that are alike share their first four characters or one is part of the other: grams of four find both
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("slug") - 3, F.lit(1))), lambda i: F.substring(F.col("slug"), i, F.lit(4)))))
    names = docs.select("slug").distinct()
    heads = names.filter(F.length("slug") >= 4).select(F.col("slug").alias("other"), F.substring("slug", 1, 4).alias("gram"))
    pairs = lacking.select("slug").distinct().select("slug", grams.alias("gram")).join(heads, "gram").select("slug", "other")
    back = names.select(F.col("slug").alias("other"), grams.alias("gram")).join(lacking.select("slug").distinct().filter(F.length("slug") >= 4).select("slug", F.substring("slug", 1, 4).alias("gram")), "gram").select("slug", "other")
    short = names.filter(F.length("slug") < 4).select(F.col("slug").alias("other"))
    parts = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n)))
    small = F.explode(F.array_distinct(F.concat(parts("slug", 1), parts("slug", 2), parts("slug", 3))))
    held = lacking.select("slug").distinct().select("slug", small.alias("other")).join(short, "other").select("slug", "other")
    inside = names.select(F.col("slug").alias("other"), small.alias("part")).join(lacking.select("slug").distinct().filter(F.length("slug") < 4).select("slug", F.col("slug").alias("part")), "part").select("slug", "other")
    alike = pairs.unionByName(back).unionByName(held).unionByName(inside).distinct().filter(similar(F.col("slug"), F.col("other")))
    near = alike.groupBy("slug").agg(F.array_sort(F.collect_set("other")).alias("near"))
    rows = lacking.join(near, "slug", "left").select("date", "dir", "slug", F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    return numbered(rows, [F.desc("date"), F.asc("dir"), F.asc("slug")], "place").select("place", "date", "dir", "slug", "near")


def merge_python_calls(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges with calls (caller, callee) between known names folded in: one more occurrence, or a new dependency labelled call."""
    n = nodes.select("id", "name")
    own = calls.join(n.select(F.col("name").alias("caller"), F.col("id").alias("src")), "caller").join(n.select(F.col("name").alias("callee"), F.col("id").alias("dst")), "callee").filter("src <> dst")
    new = own.groupBy("src", "dst").agg(F.count("*").alias("_calls")).withColumn("kind", F.lit("dependency"))
    both = edges.select("src", "dst", "kind", "label", "occurrences").join(new, ["src", "dst", "kind"], "full_outer")
    return both.select("src", "dst", "kind", F.when(F.col("occurrences").isNull(), "call").otherwise(F.col("label")).alias("label"), (F.coalesce("occurrences", F.lit(0)) + F.coalesce("_calls", F.lit(0))).alias("occurrences"))


def fill_docs(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes with the signature and doc of their symbol (by name) where they lack their own."""
    s = symbols.groupBy("name").agg(F.min_by(F.struct("signature", "doc"), F.struct("file", "line")).alias("_s"))
    return nodes.join(s, "name", "left").withColumn("signature", F.coalesce("signature", F.nullif(F.col("_s.signature"), F.lit("")))).withColumn("doc", F.coalesce("doc", F.nullif(F.col("_s.doc"), F.lit("")))).drop("_s")


def assembly_packages(definitions: DataFrame, libraries: DataFrame) -> DataFrame:
    """(assembly, package): definitions first, the last of them; libraries fill gaps."""
    rows = definitions.select("assembly", "package", F.lit(1).alias("rank"), "ord").unionByName(libraries.select("assembly", "package", F.lit(0).alias("rank"), (-F.col("ord")).alias("ord")))
    return rows.groupBy("assembly").agg(F.max_by("package", F.struct("rank", "ord")).alias("package"))


def excluded_files(tracked: DataFrame, scope: DataFrame, dropped: DataFrame) -> DataFrame:
    """(path, reason) of tracked files the collector doesn't see; a reason of its own is kept."""
    rows = tracked.select("path").join(scope.select("path").distinct(), "path", "left_anti").join(dropped.select("path", "reason"), "path", "left")
    return rows.select("path", F.coalesce("reason", F.lit("not in scope")).alias("reason"))


def resolve_paths(tokens: DataFrame, listing: DataFrame, bases: list[str]) -> DataFrame:
    """(token, path): a token below the first base that has it; a bare name only where it is the only one."""
    asked = tokens.select("token").distinct()  # a token, and a path, may come any number of times
    files = listing.groupBy("path").agg(F.count("*").alias("n"))
    rank = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(b).alias("base")) for k, b in enumerate(bases)]))
    tried = asked.select("token", rank.alias("b")).select("token", "b.rank", F.concat(F.when(F.col("b.base") == "", "").otherwise(F.concat("b.base", F.lit("/"))), "token").alias("path"))
    hit = tried.join(files.select("path").hint("merge"), "path").groupBy("token").agg(F.min_by("path", "rank").alias("direct"))
    names = files.groupBy(F.element_at(F.split("path", "/"), -1).alias("token")).agg(F.sum("n").alias("n"), F.min("path").alias("only")).filter("n = 1").select("token", "only")
    return asked.join(hit.hint("merge"), "token", "left").join(names.hint("merge"), "token", "left").select("token", F.coalesce("direct", "only").alias("path"))
