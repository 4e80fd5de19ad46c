"""Column functions: names, escapes, citations, tokens, boxes, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def short_name(name: Column) -> Column:
    """The last fragment after ##, ::, . in that order, before <."""
    return F.substring_index(F.substring_index(F.substring_index(F.substring_index(name, "##", -1), "::", -1), ".", -1), "<", 1)


def is_public(name: Column) -> Column:
    return ~F.element_at(F.split(name, r"\."), -1).startswith("_")


def module_of(path: Column) -> Column:
    """The module of a source: the folder below src, apps/ and the folder below it, or the first folder."""
    parts = F.split(path, "/")
    deep, second = F.size(parts) > 2, F.try_element_at(parts, F.lit(2))
    return F.when(F.coalesce(path, F.lit("")) == "", None).when((parts[0] == "src") & deep, second).when((parts[0] == "apps") & deep, F.concat(F.lit("apps/"), second)).otherwise(parts[0])


def dotted_module(path: Column) -> Column:
    """A path of Python source as a module name, a leading src/ removed."""
    return F.translate(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"^src/", ""), "/", ".")


def qualified(namespace: Column, name: Column) -> Column:
    return F.concat_ws("::", F.nullif(namespace, F.lit("")), name)


def citations(text: Column) -> Column:
    """array<struct<path, line, last>> of path:line citations; the end of a range is read but never checked."""
    part = lambda k: F.regexp_extract_all(text, F.lit(fixed.CITE), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("path"), part(2).alias("line"), part(3).alias("last"))
    return F.transform(zipped, lambda x: F.struct(x["path"].alias("path"), x["line"].try_cast("int").alias("line"), F.nullif(x["last"], F.lit("")).try_cast("int").alias("last")))


def lines_by_bytes(text: Column) -> Column:
    """Newlines, plus one for a partial last line."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (n + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("int")


def lines_by_breaks(text: Column) -> Column:
    """Lines cut at every line break of Unicode; no empty last line."""
    breaks = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
    parts = F.size(F.split(text, breaks, -1))
    return F.when(text == "", 0).otherwise(parts - F.when(F.regexp(text, F.lit(rf"(?s).*(?:{breaks})\z")), 1).otherwise(0)).cast("int")


def lines_by_split(text: Column) -> Column:
    """Parts between newlines: one more than there are newlines."""
    return F.size(F.split(text, "\n", -1))


def escape_dot(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def duration(seconds: Column) -> Column:
    """Seconds below a minute with one decimal; else minutes and seconds with two digits."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 60, F.format_string("%.1f초", seconds)).otherwise(F.format_string("%d분 %04.1f초", minutes.cast("int"), seconds - minutes * 60))


def percent(share: Column) -> Column:
    """Half up."""
    return F.floor(share * 100 + 0.5).cast("int")


def rename_target(path: Column) -> Column:
    """The new path of a rename in a change log: a/{old => new}/c or old => new."""
    braces = F.regexp_replace(path, r"\{[^{}]*? => ([^{}]*)\}", "$1")
    plain = F.regexp_replace(braces, r"^.* => ", "")
    return F.regexp_replace(plain, "//+", "/")


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(v, low), high)


def inline_svg(svg: Column, prefix: Column) -> Column:
    """Drops what precedes <svg, drops its size, prefixes ids and the references to them, rounds points to pixels."""
    body = F.regexp_replace(svg, r"(?s)^.*?(<svg)", "$1")
    body = F.regexp_replace(body, r'(<svg[^>]*?) (?:width|height)="[^"]*"', "$1")
    body = F.regexp_replace(body, r'(<svg[^>]*?) (?:width|height)="[^"]*"', "$1")
    for pattern in (r'id="', r'href="#', r"url\(#"):
        body = F.regexp_replace(body, F.lit(f"({pattern})"), F.concat(F.lit("$1"), prefix))
    return body


def json_refs(schema: Column) -> Column:
    """Distinct $ref names of a JSON schema, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(schema, F.lit(r'"\$ref"\s*:\s*"[^"]*/([^"/]+)"'), F.lit(1))))


def blob_id(content: Column) -> Column:
    """The content id a version store gives a file."""
    body = content.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(body).cast("string")), "UTF-8"), F.unhex(F.lit("00")), body))


def choice_number(value: Column) -> Column:
    """An answer as a number; null where it is blank or no whole number."""
    return F.when(F.regexp(F.trim(value), F.lit(r"^-?\d+$")), F.trim(value).cast("int"))


def path_tokens(text: Column) -> Column:
    """Path-shaped tokens (globs too) that no word or path character touches, in order, distinct."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + fixed.PATH), F.lit(1)))


def path_lines(text: Column) -> Column:
    """array<struct<path, lines>> of path tokens with the line or range after them, if there is one."""
    part = lambda k: F.regexp_extract_all(text, F.lit("(?U)" + fixed.PATH), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("path"), part(2).alias("lines")), lambda x: F.struct(x["path"].alias("path"), F.nullif(x["lines"], F.lit("")).alias("lines")))


def code_terms(text: Column) -> Column:
    """Code-like ids that are no decisions, json names and array fields, ASCII only, distinct and sorted."""
    found = [F.regexp_extract_all(text, F.lit(_ascii_limits(p)), F.lit(0)) for p in fixed.TERM_PATTERNS]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def _ascii_limits(pattern: str) -> str:
    """A pattern with its word limits spelled out, so they are ASCII whatever the engine takes for a word."""
    inner = pattern.removeprefix(r"\b")
    open_end = inner.removesuffix(r"\b")
    return "(?<![A-Za-z0-9_])" + open_end + ("(?![A-Za-z0-9_])" if open_end != inner else "")


def holds_term(text: Column, term: Column) -> Column:
    """Whether a text has a term at word limits; behind it only where the term ends in a word character."""
    tail = F.when(F.regexp(term, F.lit("[A-Za-z0-9_]$")), "(?![A-Za-z0-9_])").otherwise("")
    lead = F.when(F.regexp(term, F.lit("^[A-Za-z0-9_]")), "(?<![A-Za-z0-9_])").otherwise("(?<=[A-Za-z0-9_])")
    return F.regexp(text, F.concat(lead, escape_regex(term), tail))


def undefined_terms(source: Column, known: Column) -> Column:
    """Code-like ids of a report's body that known (array) lacks; imports, class names and section titles are no body."""
    body = F.regexp_replace(F.regexp_replace(source, r"(?m)^import[^\n]*$", ""), 'className="[^"]*"', "")
    return F.array_except(code_terms(F.regexp_replace(body, r'<Section\s+title="[^"]*"', "")), known)


def section_ids(source: Column) -> Column:
    """The decision ids of a report's sections, in order."""
    return F.regexp_extract_all(source, F.lit(r'<Section\s+title="(D[0-9]+)(?![A-Za-z0-9_])'), F.lit(1))


def rounded(value: Column, digits: int = 6) -> Column:
    """Halves to even."""
    return F.bround(value, digits)
