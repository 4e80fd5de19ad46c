"""Small decisions as column functions: places, groups, languages, names of documents, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Collectors by what stands at the top of a project, in order of precedence.
COLLECTORS = (("roslyn-dump", r"\.(csproj|slnx|sln)$"), ("clang-uml", r"^CMakeLists\.txt$"), ("griffe+pycalls", r"^(pyproject\.toml|requirements\.txt)$"))


def where(file: Column, line: Column) -> Column:
    """file:line, the file alone, or nothing."""
    return F.when(file.isNull(), None).when(line.isNull(), file).otherwise(F.concat(file, F.lit(":"), line.cast("string")))


def split_where(place: Column) -> Column:
    """struct<file, line> of file:line; the line is null where there is none."""
    line = F.nullif(F.regexp_extract(place, r":(\d+)(?:-\d+)?$", 1), F.lit(""))
    return F.struct(F.regexp_replace(place, r":\d+(?:-\d+)?$", "").alias("file"), line.cast("int").alias("line"))


def import_group(target: Column) -> Column:
    """The root of an import; the standard library is one."""
    root = F.substring_index(F.coalesce(target, F.lit("")), ".", 1)
    return F.when(root == "", fixed.OTHER_LABEL).when(root.isin(*fixed.STDLIB), fixed.PY_STDLIB).otherwise(root)


def python_abstraction(bases: Column, decorated: Column) -> Column:
    """interface for a Protocol, abstract for ABC or abstract methods, else nothing; bases: array of names."""
    named = lambda name: F.exists(bases, lambda b: F.regexp(b, F.lit(rf"(^|\.){name}(\[|$)")))
    return F.when(named("Protocol"), "interface").when(named("ABC") | F.exists(decorated, lambda d: d.endswith("abstractmethod")), "abstract")


def extension(path: Column) -> Column:
    """The last extension of a file's name with its dot; a leading dot is none."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)


def language_of(path: Column) -> Column:
    """The language of a source by its extension; null where it is none."""
    return F.coalesce(*[F.when(extension(path).isin(*ends), k) for k, ends in fixed.LANG_EXTS.items()])


def language_for(collector: Column) -> Column:
    """The language of a collector."""
    return F.coalesce(*[F.when(collector == name, k) for k, name in fixed.COLLECTOR.items() if name != "none"])


def scanner_language(graph_language: Column) -> Column:
    """A graph's language as declarations are scanned for it; null where they aren't."""
    name = F.coalesce(*[F.when(graph_language == k, v) for k, v in fixed.LANG_ALIAS.items()], graph_language)
    return F.when(name.isin(*fixed.LANG_EXTS), name)


def file_of(where: Column) -> Column:
    """The file of a place: what stands before the first colon."""
    return F.coalesce(F.substring_index(where, ":", 1), F.lit(""))


def run_verdict(code: Column, has_result: Column, is_error: Column, subtype: Column) -> Column:
    """struct<ok, why> of a session: it needs a result, exit code 0 and no error, asked in that order."""
    why = F.coalesce(F.nullif(subtype, F.lit("")), F.lit("no reason given"))
    number = code.cast("string")
    told = F.when(~F.coalesce(has_result, F.lit(False)), F.concat(F.lit("no result, exit code "), number)).when(code != 0, F.concat(F.lit("exit code "), number, F.lit(": "), why)).when(F.coalesce(is_error, F.lit(False)), F.concat(F.lit("ended in an error: "), why)).otherwise("")
    return F.struct((told == "").alias("ok"), told.alias("why"))


def manuscript_written(data: Column, report: Column) -> Column:
    """Both sources are there, decisions are no empty list, and a decision has a section."""
    there = (F.coalesce(data, F.lit("")) != "") & (F.coalesce(report, F.lit("")) != "")
    return there & ~F.coalesce(F.regexp(data, F.lit(r"decisions:\s*\[\s*\]")), F.lit(False)) & F.coalesce(F.regexp(report, F.lit(r'<Section\s+title="D[0-9]')), F.lit(False))


def author_config(text: Column) -> Column:
    """struct<flags, paths> of a diagram's configuration: flags as a block or inline list, then paths."""
    trimmed = lambda items: F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    block = F.regexp_extract(text, r"(?m)^add_compile_flags:\s*\n((?:\s+-\s.*\n)+)", 1)
    listed = F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^\s*-\s*", ""))
    inline = F.regexp_extract(text, r"(?m)^add_compile_flags:\s*\[([^\]]*)\]", 1)
    paths = F.regexp_extract(text, r"paths:\s*\[([^\]]*)\]", 1)
    return F.struct(F.concat(trimmed(listed), trimmed(F.split(inline, ","))).alias("flags"), trimmed(F.split(paths, ",")).alias("paths"))


def prep_steps(collector: Column, collect: Column, has_config: Column, has_dump: Column, has_docs: Column, collect_only: Column) -> Column:
    """struct<steps, blocked>: the steps of a collection, or why there can be none."""
    none = F.array().cast("array<string>")
    tail = F.when(collect_only, none).otherwise(F.array(F.lit("facts"), F.lit("render-modules")))
    steps = lambda *names: F.concat(F.array(*map(F.lit, names)), tail)
    cpp = F.when(~has_config, none).when(has_docs, steps("clang-uml", "clang-doc", "normalize")).otherwise(steps("clang-uml", "normalize"))
    chosen = F.when(~collect, tail).when(collector == "clang-uml", cpp).when(collector == "griffe+pycalls", steps("griffe", "pycalls", "normalize")).when((collector == "roslyn-dump") & has_dump, steps("normalize")).otherwise(none)
    known = F.coalesce(collector.isin("clang-uml", "griffe+pycalls", "roslyn-dump"), F.lit(False))
    blocked = F.when(~collect, None).when((collector == "clang-uml") & ~has_config, "no configuration").when((collector == "roslyn-dump") & ~has_dump, "no dump").when(~known, "no collector")
    return F.struct(chosen.alias("steps"), blocked.alias("blocked"))


def usage_of(result: Column) -> Column:
    """struct of tokens, cost, turns and time of a session's result document; what it lacks is 0."""
    doc = F.try_parse_json(result)
    number = lambda path, kind="bigint": F.coalesce(F.try_variant_get(doc, path, kind), F.lit(0).cast(kind))
    parts = {k: number(f"$.usage.{v}") for k, v in (("input", "input_tokens"), ("output", "output_tokens"), ("cache_read", "cache_read_input_tokens"), ("cache_write", "cache_creation_input_tokens"))}
    total = parts["input"] + parts["output"] + parts["cache_read"] + parts["cache_write"]
    return F.struct(*[c.alias(k) for k, c in parts.items()], number("$.total_cost_usd", "double").alias("cost_usd"), number("$.num_turns").alias("turns"), number("$.duration_api_ms").alias("api_ms"), total.alias("total"))


def fault_line(kind: Column, batch: Column, at: Column, detail: Column, fix: Column) -> Column:
    """One fault of a shard on one line."""
    return F.format_string("%s [%s] %s: %s (%s)", kind, batch, F.coalesce(at, F.lit("-")), F.coalesce(detail, F.lit("")), F.coalesce(fix, F.lit("")))


def backup_name(name: Column, taken: Column) -> Column:
    """The first of name, stem.1.ext, stem.2.ext ... that taken (array) lacks."""
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    tries = F.concat(F.array(name), F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda k: F.concat(stem, F.lit("."), k.cast("string"), ext)))
    return F.filter(tries, lambda t: ~F.array_contains(taken, t))[0]


def collector_for(top: Column) -> Column:
    """The collector of a project by its top-level names (array); none where nothing tells."""
    holds = lambda pattern: F.exists(top, lambda n: F.regexp(n, F.lit(pattern)))
    return F.coalesce(*[F.when(holds(p), k) for k, p in COLLECTORS], F.lit("none"))


def collector_from(selection: Column) -> Column:
    """The collector that a selection document names; none where it is malformed or names none."""
    return F.nullif(F.try_variant_get(F.try_parse_json(selection), "$.collector", "string"), F.lit(""))


def stem(key: Column, kind: Column) -> Column:
    """The fragment of a name that a cited line must show; [] at its end goes, records that are no nodes keep the rest."""
    from .text import short_name

    bare = F.regexp_replace(key, r"\[\]$", "")
    return F.when(kind.isin(*fixed.NON_NODE_KINDS), bare).otherwise(short_name(bare))


def written_by_reading(record_source: Column, use_source: Column) -> Column:
    return F.coalesce(record_source == "reading", F.lit(False)) | F.coalesce(use_source == "reading", F.lit(False))


def strings_of(value: Column) -> Column:
    """An optional JSON value as an array of strings; empty where it is none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(value), "$", "array<string>"), F.array().cast("array<string>"))


def needs_collect(has_graph: Column, changed: Column, forced: Column, tool_changed: Column, source_changed: Column) -> Column:
    return ~F.coalesce(has_graph, F.lit(False)) | F.coalesce(forced, F.lit(False)) | F.coalesce(tool_changed, F.lit(False)) | F.coalesce(source_changed, F.lit(False)) | (F.coalesce(changed, F.lit(0)) > 0)


def caught_up(recorded: Column, current: Column) -> Column:
    """Whether the recorded hash is the current one; an unreadable one isn't."""
    return F.coalesce(recorded == current, F.lit(False))


#: Where artifacts of a kind may stand.
ARTIFACTS = (("graph", r"^codegraph\.json$"), ("terms", r"^terms\.json$"), ("wiki", r"^wiki/[^/]+\.md$"), ("verify", r"^verify\.json$"))


def entry_fits(kind: Column, path: Column) -> Column:
    """A path belongs to its artifact's kind: relative, not climbing, of the right shape."""
    shape = F.lit(False)
    for k, p in ARTIFACTS:
        shape = shape | ((kind == k) & F.regexp(path, F.lit(p)))
    return shape & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def plan_slug(plan: Column) -> Column:
    """The name of a plan without its date; never empty."""
    base = F.regexp_replace(F.element_at(F.split(plan, "/"), -1), r"\.md$", "")
    slug = F.regexp_replace(base, r"^\d{4}-\d{2}-\d{2}-", "")
    return F.when(slug == "", base).otherwise(slug)


def document_name(name: Column, folder: Column) -> Column:
    """struct<date, slug> of a document's file name by the pattern of its folder; nulls where it doesn't fit or the folder has none."""
    part = lambda k: F.coalesce(*[F.when(folder == d, F.nullif(F.regexp_extract(name, p, k), F.lit(""))) for d, p in fixed.DOC_FOLDERS])
    return F.struct(part(1).alias("date"), part(2).alias("slug"))


def names_of(value: Column) -> Column:
    """The elements of a variant that is a list, as texts; none of one that is missing or no list."""
    return F.coalesce(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(x.cast("string"), F.lit("None"))), F.array().cast("array<string>"))


def similar(a: Column, b: Column) -> Column:
    """One holds the other, or both begin with the same four characters; equal names aren't similar."""
    return (a != b) & (a.contains(b) | b.contains(a) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (F.substring(a, 1, 4) == F.substring(b, 1, 4))))


def version_note(data: Column, current: Column) -> Column:
    """A mismatch is a warning, never a failure."""
    return F.struct(F.lit(True).alias("ok"), (~data.eqNullSafe(current)).alias("warn"))


def shown_methods(methods: Column, owner: Column, limit: int = 6) -> Column:
    """struct<shown, more>: methods (array<struct<name, args>>) without constructors, destructors, operators and plain getters."""
    kept = F.filter(methods, lambda m: (m["name"] != owner) & ~m["name"].startswith("~") & ~m["name"].startswith("operator") & ~((m["args"] == 0) & F.regexp(m["name"], F.lit("^(Get|Is)[A-Z]"))))
    return F.struct(F.slice(kept, 1, limit).alias("shown"), F.greatest(F.lit(0), F.size(kept) - limit).alias("more"))


def status_line(missing: Column, stale: Column, warnings: Column) -> Column:
    """One word by precedence."""
    return F.when(missing > 0, "missing").when(stale > 0, "stale").when(warnings > 0, "warned").otherwise("fresh")


def one_word(answer: Column, vocabulary: tuple[str, ...]) -> Column:
    word = F.lower(F.trim(answer))
    return F.when(word.isin(*vocabulary), word)


def script_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit("(?i)<script[ >]"))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def first_of(names: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(names, 1, n), ", ")


def member_at(members: Column, label: Column) -> Column:
    """The place of the member named label if there is exactly one; members: array<struct<name, file, line>>."""
    hits = F.filter(members, lambda m: m["name"] == label)
    return F.when(F.size(hits) == 1, hits[0])
