"""Verification of a code-graph document in layers: reading, shape, consistency, sources, manifest, ledger, coverage.

A fault is a row (code, at, detail, ord); codes, layers and sections are fixed.
A document in a file is split over tasks element by element, one in a column is
taken apart with variant functions; a wrong shape is a fault of its element and
never ends the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..schemas import EXTERNAL
from ..session import cut
from ..sources import json_stream
from .assemble import all_of

FAULT = "code string, at string, detail string"
TEXT, MAYBE_TEXT, MAYBE_INT = ("STRING",), ("STRING", "VOID"), ("BIGINT", "VOID")
#: Fields of a graph and of its elements, the types they may have, and whether they must be there.
TOP = {"schema_version": (("BIGINT",), True), "language": (TEXT, True), "platform": (TEXT, True), "source_tool": (TEXT, True), "repo_commit": (MAYBE_TEXT, True), "nodes": (("ARRAY",), True), "edges": (("ARRAY",), True), "modules": (("ARRAY",), True)}
NODE = {
    "id": (TEXT, True), "name": (TEXT, True), "kind": (TEXT, True), "module": (MAYBE_TEXT, True), "file": (MAYBE_TEXT, True), "line": (MAYBE_INT, True),
    "signature": (TEXT, False), "doc": (TEXT, False), "abstraction": (TEXT, False, ("interface", "abstract")), "collapsed_from": (("ARRAY<STRING>", "ARRAY<VOID>"), False),
}
EDGE = {
    "from": (TEXT, True), "to": (TEXT, True), "kind": (TEXT, True, fixed.EDGE_KINDS), "label": (MAYBE_TEXT, True), "file": (MAYBE_TEXT, True), "line": (MAYBE_INT, True),
    "occurrences": (("BIGINT",), False), "constraint": (("BOOLEAN",), False), "origin": (TEXT, False), "attrs": (("ARRAY<STRING>", "ARRAY<VOID>"), False),
}
MODULE = {"id": (TEXT, True), "depends_on": (("ARRAY<STRING>", "ARRAY<VOID>"), True)}


def fault(rows: DataFrame, code: str, at: Column, detail: Column) -> DataFrame:
    if code not in fixed.LAYER:
        raise KeyError(code)
    return rows.select(F.lit(code).alias("code"), at.alias("at"), detail.alias("detail"))


LISTS = ("nodes", "edges", "modules")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The document in a file of any size, taken apart over many tasks.

    One row (sha, doc, why): the hash, the document as a variant with its lists
    cut short, and why it is missing or can't be read; and (list, i, v), the
    elements of its lists.
    """
    held = json_stream.read(spark, path, LISTS)
    head = spark.range(1).select(F.lit(held.sha).alias("sha"), F.lit(held.why).cast("string").alias("why"))
    if held.why is not None:
        return head.select("sha", F.lit(None).cast("variant").alias("doc"), "why"), held.items
    name = F.to_json(F.array("name"))
    fields = F.concat(F.expr("substring(to_json(array(name)), 2, length(to_json(array(name))) - 2)"), F.lit(":"), "body")
    told = held.members.agg(F.count("name").alias("n"), F.count("*").alias("rows"), F.array_join(F.sort_array(F.collect_list(F.when(name.isNotNull(), fields))), ",").alias("fields"), F.max("body").alias("body"))
    text = F.when((F.col("rows") > 0) & (F.col("n") == 0), F.col("body")).otherwise(F.concat(F.lit("{"), "fields", F.lit("}")))
    return cut(head.join(F.broadcast(told)).select("sha", F.try_parse_json(text).alias("doc"), "why"), "audit-head"), held.items  # one row each


def from_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """(sha, doc, why) of documents in a column, whole.  One too large for a variant fails the job; read_graph takes it."""
    fit = F.when(F.octet_length(text) > json_stream.LARGEST, F.raise_error(F.lit("a document too large for one value"))).otherwise(F.col(text))
    doc = json_stream.strict(fit)
    return docs.select(F.sha2(F.col(text).cast("binary"), 256).alias("sha"), doc.alias("doc"), F.when(doc.isNull(), "not JSON").alias("why"))


def check_read(read: DataFrame) -> DataFrame:
    return fault(read.filter("why is not null"), "unreadable", F.lit("$"), F.col("why"))


def _shape(v: Column) -> Column:
    """The type of a variant, whole numbers as BIGINT; of a list of one type its element's too, of an object nothing more."""
    return F.regexp_replace(F.schema_of_variant(v), r"^(?:(OBJECT)<|(ARRAY)<(?!STRING>|VOID>)).*$", "$1$2")


def _field_faults(v: str, shape: dict) -> Column:
    """What is wrong with the fields of an object, in their order; empty where nothing is."""
    out = []
    for name, (kinds, must, *words) in shape.items():
        here = F.try_variant_get(F.col(v), f"$.{name}", "variant")
        kind = _shape(here)
        fits = kind.isin(*kinds) | (F.lit("ARRAY" in kinds) & kind.startswith("ARRAY"))
        said = F.try_variant_get(F.col(v), f"$.{name}", "string")
        odd = ~said.isin(*words[0]) if words else F.lit(False)
        out.append(F.when(here.isNull(), F.lit(f"{name}: missing") if must else None).when(~fits, F.concat(F.lit(f"{name}: "), kind)).when(odd, F.concat(F.lit(f"{name}: "), said)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def check_top(read: DataFrame) -> DataFrame:
    """Fields of the document: those that lack or have a wrong type, a version that isn't 2, an unknown language, no nodes."""
    ok = read.filter("why is null")
    bare, docs = ok.filter(~_object(F.col("doc"))), ok.filter(_object(F.col("doc")))
    field = docs.select(F.explode(_field_faults("doc", TOP)).alias("f"))
    got = lambda name, kind: F.try_variant_get("doc", f"$.{name}", kind)
    kind_of = lambda name: _shape(F.try_variant_get("doc", f"$.{name}", "variant"))
    version, language = got("schema_version", "bigint"), got("language", "string")
    count = F.size(got("nodes", "array<variant>"))
    return all_of([
        fault(bare, "top-field", F.lit("$"), F.lit("not an object")),
        fault(field, "top-field", F.concat(F.lit("$."), F.substring_index("f", ":", 1)), F.col("f")),
        fault(docs.filter((kind_of("schema_version") == "BIGINT") & (version != 2)), "schema-version", F.lit("$.schema_version"), version.cast("string")),
        fault(docs.filter((kind_of("language") == "STRING") & ~language.isin(*fixed.GRAPH_LANGUAGES)), "language", F.lit("$.language"), language),
        fault(docs.filter(kind_of("nodes").startswith("ARRAY") & (count == 0)), "empty-graph", F.lit("$.nodes"), F.lit("no nodes")),
    ])


def _items(read: DataFrame, name: str, items: DataFrame | None = None) -> DataFrame:
    """(i, v): the elements of a list of the document, none where it is no list.  items: those that read_graph told apart."""
    if items is not None:
        return items.filter(F.col("list") == name).select(F.col("i").cast("int").alias("i"), "v")
    docs = read.filter("why is null")
    docs = docs.filter(_object(F.col("doc")))
    return docs.select(F.posexplode(F.try_variant_get("doc", f"$.{name}", "array<variant>")).alias("i", "v"))


def elements(read: DataFrame, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, edges and modules of right shape with their place i, the faults of shape and vocabulary, and what had a wrong shape.

    nodes (i, id, name, kind, module, file, line), edges (i, src, dst, kind,
    file, line, occurrences, constraint), modules (i, id, depends_on).
    """
    faults, kept = [], {}
    for name, code, shape in (("nodes", "node-shape", NODE), ("edges", "edge-shape", EDGE), ("modules", "module-shape", MODULE)):
        told = cut(_items(read, name, items).withColumn("faults", F.when(~_object(F.col("v")), F.array(F.lit("not an object"))).otherwise(_field_faults("v", shape))), f"audit-{name}")
        at = F.format_string(f"$.{name}[%d]", "i")
        faults.append(fault(told.filter(F.size("faults") > 0), code, at, F.array_join("faults", "; ")))
        kept[name] = (told.filter(F.size("faults") == 0), told.filter(F.size("faults") > 0))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    nodes = kept["nodes"][0].select("i", *[get(c, "string").alias(c) for c in ("id", "name", "kind", "module", "file")], get("line", "bigint").alias("line"))
    edges = kept["edges"][0].select("i", get("from", "string").alias("src"), get("to", "string").alias("dst"), *[get(c, "string").alias(c) for c in ("kind", "label", "file")], get("line", "bigint").alias("line"), get("occurrences", "bigint").alias("occurrences"), get("constraint", "boolean").alias("constraint"))
    modules = kept["modules"][0].select("i", get("id", "string").alias("id"), get("depends_on", "array<string>").alias("depends_on"))
    nodes, edges, modules = cut(nodes, "audit-n"), cut(edges, "audit-e"), cut(modules, "audit-m")
    count = nodes.agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") != "external", 1)).alias("own"))
    faults += [
        fault(nodes.filter(~F.col("kind").isin(*fixed.NODE_KINDS)), "node-kind", F.format_string("$.nodes[%d].kind", "i"), F.col("kind")),
        fault(edges.filter("occurrences < 1"), "occurrences-range", F.format_string("$.edges[%d].occurrences", "i"), F.col("occurrences").cast("string")),
        fault(count.filter("n > 0 and own = 0"), "external-only", F.lit("$.nodes"), F.col("n").cast("string")),
    ]
    spoiled = kept["nodes"][1].select(F.when(_shape(F.try_variant_get("v", "$.id", "variant")) == "STRING", get("id", "string")).alias("id"), F.lit("node").alias("of")).unionByName(kept["modules"][1].select(F.lit(None).cast("string").alias("id"), F.lit("module").alias("of")))
    return nodes, edges, modules, all_of(faults), cut(spoiled, "audit-spoiled")


def _later(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key came before."""
    return rows.join(rows.groupBy(*keys).agg(F.min("i").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), keys).filter("i > _first").drop("_first")


def check_consistency(nodes: DataFrame, edges: DataFrame, modules: DataFrame, spoiled: DataFrame | None = None) -> DataFrame:
    """Ids that repeat, edges that dangle or break the rules of external nodes, places that lack, and module lists that don't match.

    spoiled (id, of) are elements whose shape was wrong: what they leave open is
    no fault of others.
    """
    spark = nodes.sparkSession
    if spoiled is None:
        spoiled = spark.createDataFrame([], "id string, of string")
    at_node, at_edge = F.format_string("$.nodes[%d]", "i"), F.format_string("$.edges[%d]", "i")
    outer = F.col("kind") == "external"
    placed = F.col("file").isNotNull() | F.col("line").isNotNull()
    odd = (outer != F.coalesce(F.col("module") == EXTERNAL, F.lit(False))) | (outer & placed)
    # of nodes that share an id the last one is meant
    kinds = nodes.groupBy("id").agg(F.max_by(F.struct("kind", "module"), "i").alias("_k"))
    known = kinds.select("id").unionByName(spoiled.filter("id is not null").select("id")).distinct()
    nameless = spoiled.filter("of = 'node' and id is null").limit(1).count() > 0
    partly = spoiled.limit(1).count() > 0
    end = lambda e, n: kinds.select(F.col("id").alias(e), F.col("_k.kind").alias(f"{n}_kind"), F.col("_k.module").alias(f"{n}_module"))
    there = lambda e: known.select(F.col("id").alias(e), F.lit(True).alias(f"has_{e}"))
    told = cut(edges.join(end("src", "s"), "src", "left").join(end("dst", "d"), "dst", "left").join(there("src"), "src", "left").join(there("dst"), "dst", "left"), "audit-ends")
    out = [
        fault(_later(nodes, ["id"]), "duplicate-node", F.format_string("$.nodes[%d].id", "i"), F.col("id")),
        fault(nodes.filter(odd), "external-node", at_node, F.col("id")),
        fault(nodes.filter(~odd & ~outer & (F.col("file").isNull() | F.col("line").isNull())), "first-party-location", at_node, F.col("id")),
        fault(told.filter("s_kind = 'external'"), "external-source", at_edge, F.col("src")),
        fault(told.filter((F.col("d_kind") == "external") & ~F.col("constraint").eqNullSafe(F.lit(False))), "external-constraint", at_edge, F.col("dst")),
        fault(_later(edges, ["src", "dst", "kind"]), "duplicate-edge", at_edge, F.concat_ws(" ", "src", "dst", "kind")),
    ]
    if not nameless:
        gone = F.array_compact(F.array(F.when(F.col("has_src").isNull(), F.col("src")), F.when(F.col("has_dst").isNull(), F.col("dst"))))
        out.append(fault(told.filter("has_src is null or has_dst is null"), "dangling-edge", at_edge, F.array_join(gone, ", ")))
    listed = modules.select("id").distinct()
    if not partly:
        used = nodes.filter((F.col("kind") != "external") & (F.coalesce("module", F.lit("")) != "")).select(F.col("module").alias("id")).distinct()
        place = F.lit("$.modules")
        out += [
            fault(used.join(listed, "id", "left_anti"), "module-list", place, F.concat("id", F.lit(": not listed"))),
            fault(listed.join(used, "id", "left_anti"), "module-list", place, F.concat("id", F.lit(": not used"))),
            fault(modules.groupBy("id").count().filter("count > 1"), "module-list", place, F.concat("id", F.lit(": listed twice"))),
        ]
        across = told.filter("coalesce(d_kind, '') <> 'external' and coalesce(s_module, '') <> '' and coalesce(d_module, '') <> '' and s_module <> d_module").select(F.col("s_module").alias("id"), F.col("d_module").alias("dep")).distinct()
        stated = modules.select("i", "id", F.explode("depends_on").alias("dep")).distinct()
        wanted = modules.select("i", "id").join(across, "id")
        side = lambda a, b, kind: a.join(b, ["i", "id", "dep"], "left_anti").select("i", "dep", F.lit(kind).alias("side"))
        apart = side(wanted, stated, "lacking").unionByName(side(stated, wanted, "extra"))
        names = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("side") == kind, F.col("dep")))), ", ")
        told_apart = apart.groupBy("i").agg(names("lacking").alias("lacking"), names("extra").alias("extra"))
        out.append(fault(told_apart, "module-dep-mismatch", F.format_string("$.modules[%d].depends_on", "i"), F.format_string("lacking %s; extra %s", "lacking", "extra")))
    deps = modules.select("i", "id", F.explode("depends_on").alias("dep"))
    at_module = F.format_string("$.modules[%d].depends_on", "i")
    strange = deps.filter("dep <> id").join(listed.withColumnRenamed("id", "dep"), "dep", "left_anti")
    out += [fault(deps.filter("dep = id"), "module-dep", at_module, F.concat("dep", F.lit(": itself"))), fault(strange, "module-dep", at_module, F.concat("dep", F.lit(": not listed")))]
    return all_of(out)


def file_facts(files: DataFrame) -> DataFrame:
    """(path, n_lines, sha) of (path, content as binary): lines as newlines, and one for a last line without."""
    breaks = F.size(F.split(F.decode("content", "ISO-8859-1"), "\n", -1)) - 1
    last = F.when((F.octet_length("content") > 0) & (F.right(F.hex("content"), F.lit(2)) != "0A"), 1).otherwise(0)
    return files.select("path", (breaks + last).cast("bigint").alias("n_lines"), F.sha2("content", 256).alias("sha"))


def places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(at, file, line) of every node and edge that names a file."""
    one = nodes.select(F.format_string("$.nodes[%d]", "i").alias("at"), "file", "line")
    return one.unionByName(edges.select(F.format_string("$.edges[%d]", "i").alias("at"), "file", "line")).filter("file is not null")


def cited_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path): the distinct files that nodes and edges name."""
    return nodes.select(F.col("file").alias("path")).unionByName(edges.select(F.col("file").alias("path"))).filter("path is not null").distinct()


def outside_repo(path: Column) -> Column:
    """Absolute, or climbing out of the folder it starts in."""
    steps = F.split(path, "/")
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).when((s == ".") | (s == ""), 0).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(0)).alias("low")))
    return path.startswith("/") | (depth["low"] < 0)


def check_sources(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults of cited places, and (path, sha) of the cited files that exist.  facts: file_facts of the repository."""
    told = places(nodes, edges).join(facts.withColumnRenamed("path", "file"), "file", "left")
    climbs = outside_repo(F.col("file"))
    inside = told.filter(~climbs)
    beyond = ~F.col("line").between(F.lit(1).cast("bigint"), F.col("n_lines"))
    faults = all_of([
        fault(told.filter(climbs), "file-outside-repo", F.concat("at", F.lit(".file")), F.col("file")),
        fault(inside.filter("sha is null"), "file-missing", F.concat("at", F.lit(".file")), F.col("file")),
        fault(inside.filter(F.col("sha").isNotNull() & F.col("line").isNotNull() & beyond), "line-out-of-range", F.concat("at", F.lit(".line")), F.format_string("%d of %d: %s", "line", "n_lines", "file")),
    ])
    return faults, inside.filter("sha is not null").select(F.col("file").alias("path"), "sha").distinct()


def check_manifest(manifest: DataFrame | None, sha: str, now: DataFrame) -> tuple[DataFrame, str]:
    """Faults of freshness, and ok, missing or mismatch.  manifest: one row (codegraph_sha256, sources map, ...), or none."""
    spark = now.sparkSession
    held = manifest.select("codegraph_sha256").head(1) if manifest is not None else []
    one = spark.range(1)
    if not held:
        return fault(one, "freshness-unknown", F.lit("$"), F.lit("no manifest")), "missing"
    if held[0][0] != sha:
        return fault(one, "generation-mismatch", F.lit("$"), F.lit(f"manifest of {str(held[0][0])[:12]}")), "mismatch"
    then = manifest.select(F.explode("sources").alias("path", "then"))
    both = then.join(now.select("path", F.col("sha").alias("now")), "path", "full_outer")
    drift = both.filter(F.col("then").isNull() | (F.col("then") != F.coalesce("now", F.lit("missing"))))
    detail = F.when(F.col("then").isNull(), "not in the manifest").otherwise(F.format_string("%s then, %s now", F.substring("then", 1, 12), F.substring(F.coalesce("now", F.lit("missing")), 1, 12)))
    return fault(drift, "source-drift", F.format_string("$.sources['%s']", "path"), detail), "ok"


def check_ledger(report: DataFrame | None, sha: str, language: str | None) -> DataFrame:
    """Faults of a ledger document: one row (codegraph_sha256, language, reasons array<struct<reason, class, count, samples>>), or none."""
    spark = SparkSession.getActiveSession()
    held = report.select("codegraph_sha256", "language").head(1) if report is not None else []
    if not held or held[0][0] != sha or held[0][1] != language:
        return fault(spark.range(1), "report-stale", F.lit("$"), F.lit("no ledger of this graph"))
    rows = report.select(F.explode("reasons").alias("r")).select("r.*")
    at, detail = F.format_string("$.reasons['%s']", "reason"), F.format_string("%d: %s", "count", F.array_join("samples", ", "))
    return fault(rows.filter("class = 'fault'"), "unknown-kind", at, detail).unionByName(fault(rows.filter("class = 'unresolved'"), "unresolved-drop", at, detail))


def check_inventory(languages: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults of coverage, and one row of counts.  languages (language, files, collector, collected), files (path, status)."""
    faults = fault(languages.filter("not collected"), "language-not-collected", F.format_string("$.languages['%s']", "language"), F.format_string("%d files, collector %s", "files", "collector")).unionByName(fault(files.filter("status = 'no-symbols'"), "coverage-gap", F.format_string("$.files['%s']", "path"), F.lit("not cited")))
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s.replace("-", "_"))
    counts = files.agg(F.count("*").alias("files_total"), *[count(s) for s in ("collected", "excluded", "unsupported", "failed", "no-symbols")])
    return faults, counts


def failure_fault(failure: DataFrame) -> DataFrame:
    """A collector that died: rows (step, returncode, stderr_tail array)."""
    last = F.coalesce(F.try_element_at("stderr_tail", F.lit(-1)), F.lit(""))
    return fault(failure, "collect-failed", F.lit("$"), F.format_string("%s: exit %d: %s", "step", "returncode", last))


def layers(spark: SparkSession) -> DataFrame:
    """(code, layer, section, blocks): the dimension of fault codes."""
    rows = [(c, layer, fixed.SECTION_OF_LAYER[layer], c not in fixed.REPORT_ONLY) for c, layer in fixed.LAYER.items()]
    return spark.createDataFrame(rows, "code string, layer string, section string, blocks boolean")


def placed(faults: DataFrame) -> DataFrame:
    """faults with layer, section and whether they block."""
    return faults.join(F.broadcast(layers(faults.sparkSession)), "code")  # 34 rows


def sections(faults: DataFrame) -> DataFrame:
    """(section, code, n, total)."""
    by_code = placed(faults).groupBy("section", "code").agg(F.count("*").alias("n"))
    return by_code.withColumn("total", F.sum("n").over(Window.partitionBy("section")))  # at most 34 rows


def capabilities(language: Column) -> Column:
    """struct<methods, calls, resolution>: what a collector of a language can tell."""
    row = lambda m, c, r: F.struct(F.lit(m).alias("methods"), F.lit(c).alias("calls"), F.lit(r).alias("resolution"))
    out = row(False, False, "none")
    for name, told in fixed.CAPABILITIES.items():
        out = F.when(language == name, row(*told)).otherwise(out)
    return out


def verdict(faults: DataFrame, readable: bool, checks_run: list[str], manifest: str) -> dict:
    """status, and for which use a graph is fit: report-only codes don't block; one without sources checked or a manifest isn't ready."""
    blocking = sorted({r["code"] for r in placed(faults).filter("blocks").select("code").distinct().collect()})  # at most 34
    status = "failed" if blocking or not readable else "passed"
    why = [*blocking, *([] if "V3" in checks_run else ["V3 not run"]), *([] if manifest == "ok" else [f"manifest {manifest}"])]
    return {"status": status, "survey": "ready" if status == "passed" and not why else "blocked", "blocked_by": why}


def verify(read: DataFrame, facts: DataFrame | None = None, manifest: DataFrame | None = None, report: DataFrame | None = None, inventory: tuple[DataFrame, DataFrame] | None = None, failure: DataFrame | None = None, items: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """All layers in turn: the faults, and the result document without them.

    A layer that can't open its input leaves the later ones out; facts None
    leaves out sources and manifest.  items: the elements, where read_graph gave them.
    """
    spark = read.sparkSession
    head = read.select("sha", "why", F.try_variant_get("doc", "$.language", "string").alias("language"), F.coalesce(_object(F.col("doc")), F.lit(False)).alias("is_object")).head(1)
    checks, state, counts = ["V0"], "missing", None
    faults = [check_read(read)] if head else [fault(spark.range(1), "unreadable", F.lit("$"), F.lit("no document"))]
    usable = bool(head) and head[0]["why"] is None and head[0]["is_object"]
    sha, language = (head[0]["sha"], head[0]["language"]) if head else ("", None)
    nodes = edges = modules = None
    if head and head[0]["why"] is None:
        faults.append(check_top(read))
        checks.append("V1")
    if usable:
        nodes, edges, modules, shapes, spoiled = elements(read, items)
        faults += [shapes, check_consistency(nodes, edges, modules, spoiled)]
        checks.append("V2")
        if facts is not None:
            cited, now = check_sources(nodes, edges, facts)
            drift, state = check_manifest(manifest, sha, now)
            faults += [cited, drift]
            checks += ["V3", *(["manifest"] if manifest is not None else [])]
        if report is not None:
            faults.append(check_ledger(report, sha, language))
            checks.append("V4")
        if inventory is not None:
            gaps, counts = check_inventory(*inventory)
            faults.append(gaps)
            checks.append("coverage")
    if failure is not None:
        faults.append(failure_fault(failure))
    whole = cut(all_of(faults), "faults")
    doc = verdict(whole, usable, checks, state)
    doc |= {"codegraph_sha256": sha or None, "language": language, "nodes": nodes.count() if nodes is not None else 0, "edges": edges.count() if edges is not None else 0, "modules": modules.count() if modules is not None else 0, "checks_run": checks, "manifest": state, "coverage": counts.first().asDict() if counts is not None else None, "total": whole.count()}
    return whole, doc


def verify_empty(faults: DataFrame) -> dict:
    """The result document where there is no graph: no check ran, and it is fit for nothing."""
    codes = sorted(r["code"] for r in faults.select("code").distinct().collect())  # at most 34
    return {"status": "failed", "survey": "blocked", "blocked_by": codes, "codegraph_sha256": None, "language": None, "nodes": 0, "edges": 0, "modules": 0, "checks_run": [], "manifest": "missing", "coverage": None, "total": faults.count()}


def failure_document(failure: DataFrame) -> dict:
    """As verify_empty, of a collector that died."""
    return verify_empty(failure_fault(failure))
