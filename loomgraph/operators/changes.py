"""Comparing snapshots, manifests and plans: every verdict is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import cut

#: Buckets of a change set whose files are read again.
TARGETS = ("reread", "location_only")


def verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, verdict) of two snapshots (path, mtime, size, file_hash, decl_hash).

    Equal time and size beat a changed hash; a changed hash with equal
    declarations moves locations only.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
    same = lambda c: F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    verdict = (
        F.when(F.col("n.path").isNull(), "deleted").when(F.col("o.path").isNull(), "reread").when(same("mtime") & same("size"), "unchanged").when(same("file_hash"), "unchanged").when(same("decl_hash"), "location_only").otherwise("reread")
    )
    return both.select(F.coalesce("o.path", "n.path").alias("path"), verdict.alias("verdict"))


def change_targets(verdict_rows: DataFrame) -> DataFrame:
    return verdict_rows.filter(F.col("verdict").isin(*TARGETS)).select("path").distinct()


def buckets(verdict_rows: DataFrame) -> DataFrame:
    """(verdict, n): how many paths each of the four verdicts has; all four are there, also those that no path has."""
    counts = verdict_rows.groupBy("verdict").agg(F.count("*").alias("n"))
    domain = verdict_rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, fixed.DIFFERENCE_BUCKETS))).alias("verdict"))
    return domain.join(counts, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))


def live_files(verdict_rows: DataFrame) -> DataFrame:
    """(path): tracked files that exist now, which is what no verdict calls deleted."""
    return verdict_rows.filter(F.col("verdict").isin("unchanged", "reread", "location_only")).select("path").distinct()


def difference_lines(verdict_rows: DataFrame, targets: DataFrame | None, hops: int, tracked: int) -> DataFrame:
    """(part, path, line): the difference document of a scan as lines of JSON; in order of part and path they are the document.

    verdict_rows (path, verdict), targets (path) that are read again, or None
    where nothing could be judged and so all are, hops that changes were spread
    along the graph, and how many files are tracked.  Keys are sorted, as are
    paths, by code points; all four buckets are there.  A path that comes twice
    with a verdict stands twice; one of another verdict is in no bucket.  No
    list is gathered: each path is a row, and sinks.write_lines writes ranges.
    """
    spark = verdict_rows.sparkSession
    names = sorted(fixed.DIFFERENCE_BUCKETS.items(), key=lambda b: b[1])
    # part numbers leave room for a list's opening, its items and its closing
    places = {verdict: 20 + 3 * k for k, (verdict, _) in enumerate(names)}
    goals = 10
    items = verdict_rows.filter(F.col("verdict").isin(*places)).select(F.coalesce(*[F.when(F.col("verdict") == v, F.lit(at)) for v, at in places.items()]).alias("at"), "path")
    if targets is not None:
        items = items.unionByName(targets.select(F.lit(goals).alias("at"), "path"))
    # stored, so that the verdicts behind the lists are worked out once
    items = cut(items.filter("path is not null").groupBy("at", "path").agg(F.count("*").alias("n")), "difference")
    last = items.groupBy("at").agg(F.max("path").alias("_last"))
    lists = [(goals, "targets", 1)] * (targets is not None) + [(places[v], name, 2) for v, name in names]
    # one row for each list, five at most
    heads = spark.createDataFrame(lists, "at int, name string, depth int").join(last, "at", "left")
    final = F.when(F.col("at") == max(places.values()), "").otherwise(",")
    pad = F.repeat(F.lit(" "), F.col("depth"))
    opened = heads.select("at", F.lit("").alias("path"), F.concat(pad, F.lit('"'), "name", F.lit('": ['), F.when(F.col("_last").isNull(), F.concat(F.lit("]"), final)).otherwise("")).alias("line"))
    closed = heads.filter("_last is not null").select(F.col("at") + 2, F.lit(""), F.concat(pad, F.lit("]"), final))
    told = items.join(F.broadcast(heads.filter("_last is not null").select("at", "depth", "_last")), "at")
    ends = F.when(F.col("path") == F.col("_last"), "").otherwise(",")
    text = F.expr("substring(to_json(struct(path)), 9, length(to_json(struct(path))) - 9)")
    each = told.select("*", F.explode(F.expr("sequence(1L, n)")).alias("k"))
    body = each.select(F.col("at") + 1, "path", F.concat(F.repeat(F.lit(" "), F.col("depth") + 1), text, F.when(F.col("k") < F.col("n"), ",").otherwise(ends)))
    single = [(0, "{"), (1, f' "hops": {hops},'), (15, f' "tracked": {tracked},'), (16, ' "verdicts": {'), (90, " }"), (91, "}")] + ([(goals, ' "targets": null,')] if targets is None else [])
    frame = spark.createDataFrame([(at, "", line) for at, line in single], "part int, path string, line string")
    return frame.union(opened).union(body).union(closed)


def drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded (path, hash) whose current hash differs; a missing one differs too."""
    now = current.select(F.col("path").alias("_p"), F.col("hash").alias("now"))
    return recorded.join(now, F.col("path") == F.col("_p"), "left").filter(~F.col("hash").eqNullSafe(F.col("now"))).select("path")


def symmetric_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose hash differs between two maps, either way."""
    b, a = before.alias("b"), after.alias("a")
    return b.join(a, F.col("b.path") == F.col("a.path"), "full_outer").filter(~F.col("b.hash").eqNullSafe(F.col("a.hash"))).select(F.coalesce("b.path", "a.path").alias("path"))


def staleness(sealed: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state, rank): changed, created or vanished inputs of a seal; rank orders the states."""
    s, n = sealed.alias("s"), now.alias("n")
    both = s.join(n, F.col("s.path") == F.col("n.path"), "full_outer")
    state = F.when(F.col("s.path").isNull(), "created").when(F.col("n.path").isNull(), "vanished").when(~F.col("s.hash").eqNullSafe(F.col("n.hash")), "changed")
    return both.select(F.coalesce("s.path", "n.path").alias("path"), state.alias("state")).filter("state is not null").withColumn("rank", F.when(F.col("state") == "changed", 0).when(F.col("state") == "created", 1).otherwise(2))


def coverage(planned: DataFrame, written: DataFrame) -> DataFrame:
    """(key, fault): planned keys that aren't written, and written ones nobody planned."""
    p, w = planned.select("key").distinct().alias("p"), written.select("key").distinct().alias("w")
    both = p.join(w, F.col("p.key") == F.col("w.key"), "full_outer")
    return both.filter("p.key is null or w.key is null").select(F.coalesce("p.key", "w.key").alias("key"), F.when(F.col("w.key").isNull(), "missing").otherwise("extra").alias("fault"))


def unsurveyed(sources: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Sources without a snapshot hash or with another."""
    return drift(sources, snapshot)


def missing(sources: DataFrame, present: DataFrame) -> DataFrame:
    return sources.select("path").join(present.select("path"), "path", "left_anti")


def inventory(sources: DataFrame, collected: DataFrame, excluded: DataFrame) -> DataFrame:
    """(path, status, reason) of tracked sources: collected, excluded with its reason, or missed."""
    c = collected.select("path").distinct().withColumn("_c", F.lit(True))
    rows = sources.select("path").distinct().join(c, "path", "left").join(excluded.select("path", "reason"), "path", "left")
    status = F.when(F.col("_c"), "collected").when(F.col("reason").isNotNull(), "excluded").otherwise("missed")
    return rows.select("path", status.alias("status"), F.when(status == "excluded", F.col("reason")).alias("reason"))


def stale_pages(pages: DataFrame, changed: DataFrame, text: str = "text") -> DataFrame:
    """(page): pages whose text names a changed path.  Paths are cut out of the text and joined, not searched in pairs."""
    tokens = pages.select("page", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./\-]+"), F.lit(0)))).alias("path"))
    return tokens.join(changed.select("path").distinct(), "path", "left_semi").select("page").distinct()


def targets_agree(planned: DataFrame, targets: DataFrame | None) -> DataFrame:
    """(path, issue): a plan wider than the change set, or narrower where the run is full (targets None means all)."""
    if targets is None:
        return planned.select("path").limit(0).withColumn("issue", F.lit(""))
    wide = planned.select("path").distinct().join(targets.select("path"), "path", "left_anti").withColumn("issue", F.lit("wider"))
    narrow = targets.select("path").distinct().join(planned.select("path"), "path", "left_anti").withColumn("issue", F.lit("narrower"))
    return wide.unionByName(narrow)
