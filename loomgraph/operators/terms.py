"""Term dictionaries: building, merging, projecting, checking and finding terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import stem
from ..functions.text import citations, code_terms, short_name
from ..session import cut


def by_name(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """Nodes keyed by name: of equal names the last wins."""
    last = nodes.groupBy("name").agg(F.max_by(F.struct(*[c for c in nodes.columns if c != "name"]), order).alias("r"))
    return last.select("name", "r.*")


def uses_by_name(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, to, kind): distinct edges with ids rewritten to names."""
    n = nodes.select("id", "name")
    return edges.join(n.select(F.col("id").alias("src"), F.col("name")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("to")), "dst").select("name", "to", "kind").distinct()


def neighbours(uses: DataFrame, known: DataFrame) -> DataFrame:
    """(name, neighbours): sorted undirected neighbours that are known, without itself."""
    both = uses.select("name", F.col("to").alias("other")).unionByName(uses.select(F.col("to").alias("name"), F.col("name").alias("other"))).filter("name <> other").distinct()
    keys = known.select("name").distinct()
    kept = both.join(keys, "name", "left_semi").join(keys.withColumnRenamed("name", "other"), "other", "left_semi")
    return kept.groupBy("name").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def unresolved(shallow: DataFrame, merged: DataFrame, queued: DataFrame, nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """shallow (name, dep): one row each with its state: resolved, unknown, queued or shallow, in that order of precedence."""
    flag = lambda df, c: df.select(F.col("name").alias("dep")).distinct().withColumn(c, F.lit(True))
    rows = shallow.join(flag(merged, "_m"), "dep", "left").join(flag(nodes, "_n"), "dep", "left").join(flag(queued, "_q"), "dep", "left").join(weights.select(F.col("name").alias("dep"), "weight"), "dep", "left")
    state = F.when(F.col("_m"), "resolved").when(F.col("_n").isNull(), "unknown").when(F.col("_q"), "queued").otherwise("shallow")
    return rows.select("name", "dep", state.alias("state"), F.coalesce("weight", F.lit(0.0)).alias("priority"))


def normalize_uses(uses: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uses with ids rewritten to names, and those whose target is unknown."""
    looked = uses.join(ids.select(F.col("id").alias("to"), F.col("name").alias("_by_id")), "to", "left").join(ids.select(F.col("name").alias("to")).distinct().withColumn("_known", F.lit(True)), "to", "left")
    good = looked.filter("_by_id is not null or _known").withColumn("to", F.coalesce("_by_id", "to")).select(*uses.columns)
    return good, looked.filter("_by_id is null and _known is null").select(*uses.columns)


#: A token is a word or any one other character, white space too, so a term is a run of tokens wherever it stands.
_TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_]"

#: Bytes of terms that are held in every task; a larger dictionary is shuffled instead.
HELD_BYTES = 16 << 20


def anchors(terms: DataFrame) -> DataFrame:
    """(term, run, anchor, at, begins, laps): each distinct term's tokens, and the one it is looked for by, `at` tokens after its start.

    That is the token which fewest terms have, of those the longest, then the
    first: a word that many terms share brings no candidates for them.  begins
    says that the term starts with a word, laps that it can overlap itself.
    """
    runs = terms.filter("term <> ''").select("term").distinct().withColumn("run", F.regexp_extract_all("term", F.lit(_TOKEN), F.lit(0)))
    each = runs.select("term", "run", F.posexplode("run").alias("at", "anchor"))
    shared = each.groupBy("anchor").agg(F.countDistinct("term").alias("_shared"))
    told = each.join(shared, "anchor").groupBy("term").agg(F.min_by(F.struct("run", "anchor", "at"), F.struct("_shared", -F.length("anchor"), "at")).alias("a"))
    ends_as_it_begins = F.expr("size(run) > 1 and exists(sequence(1, greatest(size(run) - 1, 1)), k -> slice(run, 1, k) = slice(run, -k, k))")
    return told.select("term", "a.*").withColumns({"begins": F.regexp("term", F.lit("^[A-Za-z0-9_]")), "laps": ends_as_it_begins})


def pick_terms(terms: DataFrame, docs: DataFrame, text: str = "text", key: str = "doc", held_bytes: int = HELD_BYTES) -> DataFrame:
    """(key, term, n): terms of any number of words that stand in a text at ASCII word limits, and how often.

    A term that begins with no word character must follow one.  Of places that
    overlap the left one counts.  Null and empty texts and terms have none; rows
    of equal key are added up.

    Texts are cut into tokens once, whatever the number of terms.  Each token
    meets the terms anchored on it, and the tokens around it are compared with
    theirs.  Terms of up to held_bytes are broadcast, so only what was found is
    shuffled; beyond that tokens meet terms in a shuffle, and carry as many
    tokens around them as the longest term has.
    """
    known = cut(anchors(terms), "terms")
    had = known.agg(F.coalesce(F.sum(4 * F.length("term") + 32 * F.size("run") + 64), F.lit(0)).alias("bytes"), F.coalesce(F.max("at"), F.lit(0)).alias("before"), F.coalesce(F.max(F.size("run") - F.col("at")), F.lit(1)).alias("after"), F.coalesce(F.bool_or("laps"), F.lit(False)).alias("laps")).first()
    cut_up = docs.select(key, F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)).alias("_tokens"))
    row = [key]
    if had["laps"]:
        cut_up, row = cut_up.withColumn("_text", F.xxhash64("_tokens")), [key, "_text"]
    # outer, so that no filter on the tokens is inferred, which would cut every text again
    places = cut_up.select(*row, "_tokens", F.posexplode_outer("_tokens").alias("_place", "anchor"))
    if had["bytes"] <= held_bytes:
        met = places.withColumn("_from", F.lit(0)).join(F.broadcast(known), "anchor")
    else:
        low = F.greatest(F.col("_place") - had["before"] - 1, F.lit(0))
        met = places.filter("anchor is not null").select(*row, "_place", "anchor", low.alias("_from"), F.slice("_tokens", low + 1, F.col("_place") - low + had["after"]).alias("_tokens")).join(known, "anchor")
    start = F.col("_place") - F.col("at")
    here = start - F.col("_from")  # among the tokens at hand
    whole = (start >= 0) & ((F.size("run") == 1) | (F.slice("_tokens", F.greatest(here, F.lit(0)) + 1, F.size("run")) == F.col("run")))
    stands = F.col("begins") | ((start > 0) & F.coalesce(F.regexp(F.get("_tokens", here - 1), F.lit("^[A-Za-z0-9_]")), F.lit(False)))
    found = met.filter(whole & stands)
    if not had["laps"]:
        return found.groupBy(key, "term").agg(F.count("*").alias("n"))
    # places of a term that can overlap itself are taken from the left; rows alike in key and text have each place equally often
    held = found.groupBy(*row, "term").agg(F.count("*").alias("_all"), F.array_sort(F.collect_set(F.when(F.col("laps"), start))).alias("_starts"), F.max(F.size("run")).alias("_size"))
    apart = F.expr("aggregate(_starts, struct(0L as n, 0 as end), (a, s) -> if(s >= a.end, struct(a.n + 1L as n, s + _size as end), a), a -> a.n)")
    counted = held.withColumn("n", F.when(F.size("_starts") == 0, F.col("_all")).otherwise((apart * F.col("_all") / F.size("_starts")).cast("bigint")))
    return counted.groupBy(key, "term").agg(F.sum("n").alias("n"))


def new_code_terms(terms: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(term): distinct code-like ids, json names and array fields of the texts that the dictionary lacks, sorted."""
    found = docs.select(F.explode(code_terms(F.col(text))).alias("term")).distinct()
    return found.join(terms.select("term").distinct(), "term", "left_anti").orderBy("term")


def without(items: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """(key): the distinct items that none of the others has, sorted."""
    left = items.select(key).distinct()
    for other in others:
        left = left.join(other.select(key).distinct(), key, "left_anti")
    return left.orderBy(key)


def split_concepts(concepts: DataFrame, answers: DataFrame) -> DataFrame:
    """concepts (ord, term) with ready: whether an answer (term, means) that isn't blank is there."""
    told = answers.filter(F.trim("means") != "").select("term").distinct().withColumn("_t", F.lit(True))
    return concepts.join(told, "term", "left").select("ord", "term", F.coalesce("_t", F.lit(False)).alias("ready"))


def new_concepts(terms: DataFrame, docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(term): distinct tokens of the pattern that the dictionary lacks."""
    tokens = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("term")).distinct()
    return tokens.join(terms.select("term").distinct(), "term", "left_anti")


def detail_at(elements: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(file, line, label): members and methods by the place that declares them, from either collector.

    elements (display_name, members, methods) have places of their own inside
    source_location; types (name, members, methods) beside the name.
    """
    each = lambda df, owner, kind, at: df.select(owner.alias("owner"), F.explode(kind).alias("m")).select(F.col(f"m.{at}file").alias("file"), F.col(f"m.{at}line").alias("line"), F.concat("owner", F.lit("."), F.coalesce("m.name", F.lit("None"))).alias("label"))
    parts = [each(elements, short_name(F.coalesce("display_name", F.lit("?"))), kind, "source_location.") for kind in ("members", "methods") if kind in elements.columns]
    if types is not None:
        parts += [each(types, short_name(F.col("name")), kind, "") for kind in ("members", "methods") if kind in types.columns]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.filter("file is not null and coalesce(line, 0) <> 0")


def check_citations(lines: DataFrame, files: DataFrame, node_at: DataFrame, edge_at: DataFrame, detail: DataFrame | None = None) -> DataFrame:
    """(doc, line, path, cited, verdict, unnamed) for each path:line citation of (doc, line, text).

    L1: the file (path, n_lines) exists; L2: it isn't shorter; L3: a node
    (file, line, name), or else an edge, or else a member or method stands
    there; else the citation is unfounded, which is no failure.  unnamed warns
    that a cited node's name stands neither on the citing line nor beside it,
    where that line is no list of sources.
    """
    w = Window.partitionBy("doc").orderBy("line")
    near = lines.withColumn("context", F.concat_ws("\n", F.lag("text").over(w), F.col("text"), F.lead("text").over(w)))
    cites = near.select("doc", "line", "context", F.regexp("text", F.lit(r"^\s*<!-- Sources:")).alias("listed"), F.posexplode(citations(F.col("text"))).alias("k", "c")).select("doc", "line", "k", "context", "listed", F.col("c.path").alias("path"), F.col("c.line").alias("cited"))
    place = [F.col("file").alias("path"), F.col("line").alias("cited")]
    named = "name" in node_at.columns
    nodes = node_at.select(*place, (short_name(F.col("name")) if named else F.lit("")).alias("short")).groupBy("path", "cited").agg(F.collect_set("short").alias("_names"))
    flag = lambda df, c: df.select(*place).distinct().withColumn(c, F.lit(True))
    rows = cites.join(files.select("path", "n_lines"), "path", "left").join(nodes, ["path", "cited"], "left").join(flag(edge_at, "_edge"), ["path", "cited"], "left")
    if detail is not None:
        rows = rows.join(flag(detail, "_member"), ["path", "cited"], "left")
    member = F.col("_member") if detail is not None else F.lit(False)
    node = F.col("_names").isNotNull()
    verdict = F.when(F.col("n_lines").isNull(), "L1_no_file").when(F.col("cited") > F.col("n_lines"), "L2_no_line").when(node, "node").when(F.col("_edge"), "edge").when(member, "member").otherwise("unfounded")
    seen = F.exists("_names", lambda n: F.contains(F.col("context"), n))
    return rows.withColumn("verdict", verdict).select("doc", "line", "path", "cited", "verdict", ((F.col("verdict") == "node") & ~F.col("listed") & ~F.coalesce(seen, F.lit(True))).alias("unnamed"))


def first_failures(checked: DataFrame, shown: int = 10) -> tuple[DataFrame, int]:
    """The first failed citations in order, and how many more there are."""
    failed = checked.filter(F.col("verdict").isin("L1_no_file", "L2_no_line"))
    return failed.orderBy("doc", "line", "path", "cited").limit(shown), max(0, failed.count() - shown)


def check_terms(terms: DataFrame, uses: DataFrame, source_lines: DataFrame) -> DataFrame:
    """(level, name, reason): what is wrong with a dictionary, as far as reading wrote it.

    terms (name, kind, module, where, means, neighbours, source), uses (name,
    to, kind, where, source), source_lines (path, line, text).  A cited line
    must exist, and its name must stand on it or beside it.
    """
    fail = lambda df, reason, name="name": df.select(F.lit("failed").alias("level"), F.col(name).alias("name"), reason.alias("reason"))
    known = F.coalesce(F.col("source").isin(*fixed.TERM_SOURCES), F.lit(False))
    good = terms.filter(known)
    out = [fail(terms.filter(~known), F.concat(F.lit("source: "), F.coalesce("source", F.lit("none"))))]
    for field in ("kind", "module", "where", "means", "neighbours"):
        out.append(fail(good.filter(F.col(field).isNull()), F.lit(f"no {field}")))
    out.append(fail(good.filter(F.trim(F.coalesce("means", F.lit(""))) == ""), F.lit("empty means")))
    told = uses.withColumnRenamed("source", "_by").join(good.select("name", F.col("source").alias("_of")), "name")
    mine = told.filter((F.col("_of") == "reading") | F.coalesce(F.col("_by") == "reading", F.lit(False)))
    targets = terms.select(F.col("name").alias("to"), F.col("kind").alias("_to_kind"), F.lit(True).alias("_known"))
    looked = mine.join(targets, "to", "left")
    out.append(fail(looked.filter("_known is null"), F.concat(F.lit("uses unknown: "), F.coalesce("to", F.lit("none")))))
    out.append(fail(mine.filter(~F.coalesce(F.col("kind").isin(*fixed.TERM_EDGE_KINDS), F.lit(False))), F.concat(F.lit("use of kind: "), F.coalesce("kind", F.lit("none")))))
    read = good.filter("source = 'reading'")
    out.append(fail(read.filter(~F.coalesce(F.col("kind").isin(*fixed.TERM_KINDS), F.lit(False))), F.concat(F.lit("kind: "), F.coalesce("kind", F.lit("none")))))
    out.append(fail(read.filter(~F.coalesce(F.col("kind").isin("module", "external"), F.lit(False)) & (F.coalesce("where", F.lit("")) == "")), F.lit("no citation")))
    cites = read.select("name", F.lit("where").alias("what"), "where", stem(F.col("name"), F.col("kind")).alias("stem"))
    of_uses = looked.filter("_of <> 'codegraph'").select("name", F.concat(F.lit("uses "), "to").alias("what"), "where", F.when(F.col("_known"), stem(F.col("to"), F.col("_to_kind"))).otherwise("").alias("stem"))
    number = F.regexp_extract("where", r"^.*:([0-9]+)$", 1)
    asked = cites.unionByName(of_uses).filter("coalesce(where, '') <> ''").withColumns({"path": F.when(number != "", F.regexp_extract("where", r"^(.*):[0-9]+$", 1)).otherwise(F.col("where")), "line": F.nullif(number, F.lit("")).try_cast("int")}).filter("path <> ''")
    sizes = source_lines.groupBy("path").agg(F.max("line").alias("n_lines"))
    w = Window.partitionBy("path").orderBy("line")
    windows = source_lines.select("path", "line", F.concat_ws("\n", F.lag("text").over(w), F.col("text"), F.lead("text").over(w)).alias("window"))
    placed = asked.join(sizes, "path", "left").join(windows, ["path", "line"], "left")
    out.append(fail(placed.filter("n_lines is null"), F.concat("what", F.lit(" L1: "), "path")))
    short = F.col("n_lines").isNotNull() & (F.coalesce("line", F.lit(0)) == 0) | (F.col("line") > F.col("n_lines"))
    out.append(fail(placed.filter(short), F.concat("what", F.lit(" L2: "), "where")))
    found = placed.filter(F.col("n_lines").isNotNull() & ~F.coalesce(short, F.lit(False)) & (F.col("stem") != "") & ~F.coalesce(F.contains("window", F.col("stem")), F.lit(False)))
    out.append(found.select(F.lit("unfounded").alias("level"), "name", F.concat("what", F.lit(" L3: "), "where").alias("reason")))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def glossary(terms: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, first, entries): terms (name, means) of each group as `name: means` lines in order of name.  A glossary's groups fit a page."""
    held = F.array_sort(F.collect_list(F.struct("name", "means")))
    lines = F.array_join(F.transform(held, lambda t: F.concat(t["name"], F.lit(": "), F.coalesce(t["means"], F.lit("")))), "\n")
    return terms.groupBy(*group).agg(F.count("*").alias("n"), F.min("name").alias("first"), lines.alias("entries"))


def term_graph(terms: DataFrame, uses: DataFrame) -> DataFrame:
    """(payload): the dictionary as one JSON document of nodes and links between them, for a page that draws it."""
    known = terms.select("name").distinct()
    links = uses.join(known, "name", "left_semi").join(known.withColumnRenamed("name", "to"), "to", "left_semi").filter("name <> to").select("name", "to", "kind").distinct()
    nodes = terms.agg(F.array_sort(F.collect_list(F.struct("name", "kind"))).alias("nodes"))
    return nodes.join(F.broadcast(links.agg(F.array_sort(F.collect_list(F.struct("name", "to", "kind"))).alias("links")))).select(F.to_json(F.struct("nodes", "links")).alias("payload"))  # one row each


def same_rules(one: DataFrame, two: DataFrame) -> DataFrame:
    """(side, ...) the rules that only one of two copies has; none where they are equal."""
    left, right = one.exceptAll(two), two.exceptAll(one)
    return left.withColumn("side", F.lit("one")).unionByName(right.withColumn("side", F.lit("two")))


def suffixes(paths: DataFrame, name: str = "name", least: int = 2) -> DataFrame:
    """(suffix, name): dotted suffixes of at least `least` segments that name one thing only."""
    parts = paths.select(name, F.split(name, r"\.").alias("p")).filter(F.size("p") >= least)
    every = parts.select(name, F.explode(F.expr(f"transform(sequence(1, size(p) - {least - 1}), i -> array_join(slice(p, i, size(p)), '.'))")).alias("suffix")).distinct()
    return every.groupBy("suffix").agg(F.min(name).alias(name), F.count("*").alias("_n")).filter("_n = 1").drop("_n")


def prefixes(names: DataFrame, name: str = "name") -> DataFrame:
    """(prefix): all dotted prefixes."""
    return names.select(F.explode(F.expr(f"transform(sequence(1, size(split({name}, '[.]'))), i -> array_join(slice(split({name}, '[.]'), 1, i), '.'))")).alias("prefix")).distinct()


def shared_by_all(items: DataFrame, group: str, item: str) -> DataFrame:
    """Items that every group has."""
    pairs = items.select(group, item).distinct()
    n = pairs.select(group).distinct().agg(F.count("*").alias("_n"))
    return pairs.groupBy(item).agg(F.count("*").alias("_c")).join(F.broadcast(n)).filter("_c = _n").select(item)  # one row
