"""Sinks: CSV bodies, DOT and markdown text, single documents, and Parquet with a good and a bad side."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_dot, escape_html, short_name
from ..operators.ordered import numbered


def with_header(lines: DataFrame, header: str) -> DataFrame:
    """(ord, line): a header before lines (ord, line); ord keeps the order of the text."""
    return lines.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("ord"), F.lit(header).alias("line")).unionByName(lines.select(F.col("ord").cast("bigint").alias("ord"), "line"))


def weights_csv(weights: DataFrame) -> DataFrame:
    """(ord, line): file,out,into,interfaces,abstracts,weight with six decimals, heaviest first."""
    rows = numbered(weights, [F.desc("weight"), F.asc("file")], "ord")
    text = F.concat_ws(",", "file", *[F.col(c).cast("string") for c in ("out_edges", "into_edges", "interfaces", "abstracts")], F.format_string("%.6f", F.col("weight").cast("double")))
    return with_header(rows.select("ord", text.alias("line")), "file,out,into,interfaces,abstracts,weight")


def unresolved_csv(rows: DataFrame) -> DataFrame:
    """(ord, line): file,key,dep,priority,into,status of unresolved rows (ord, ...), six decimals of priority."""
    text = F.concat_ws(",", "file", "key", "dep", F.format_string("%.6f", F.col("priority").cast("double")), F.col("into").cast("string"), "status")
    return with_header(rows.select("ord", text.alias("line")), "file,key,dep,priority,into,status")


def dropped_csv(dropped: DataFrame) -> DataFrame:
    """(ord, line): file,key,to,"label",where,why of (ord, ...); quotes inside the label become apostrophes."""
    label = F.concat(F.lit('"'), F.replace(F.coalesce("label", F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))
    text = F.concat_ws(",", "file", "key", "to", label, F.coalesce("where", F.lit("")), "why")
    return with_header(dropped.select("ord", text.alias("line")), "file,key,to,label,where,why")


def class_label(name, members, methods, abstract, notes):
    """A class as a table of three parts: its name, its first six members with notes on ownership, its telling methods.

    members array<struct<name, type, access>>, methods array<struct<name,
    access, virtual>> as rules.shown_methods picks them, notes map<name, note>.
    """
    sign = lambda a: F.when(a == "public", "+").when(a == "protected", "#").when(a == "private", "-").otherwise(" ")
    small = lambda color, text: F.concat(F.lit(f'<FONT COLOR="{color}">'), text, F.lit("</FONT>"))
    more = lambda n: F.when(n > 0, F.array(small("#999999", F.concat(F.lit("… 외 "), n.cast("string"))))).otherwise(F.array().cast("array<string>"))
    row = lambda lines: F.when(F.size(lines) > 0, F.concat(F.lit('<TR><TD ALIGN="LEFT" BALIGN="LEFT"><FONT POINT-SIZE="8">'), F.array_join(lines, "<BR/>"), F.lit("</FONT></TD></TR>"))).otherwise("")
    note = lambda m: F.coalesce(F.concat(F.lit(" "), small("#7030a0", F.nullif(F.try_element_at(notes, m["name"]), F.lit("")))), F.lit(""))
    own = F.transform(F.slice(members, 1, 6), lambda m: F.concat(sign(m["access"]), F.lit(" "), escape_html(F.coalesce(m["name"], F.lit(""))), F.lit(" : "), small("#666666", escape_html(F.coalesce(m["type"], F.lit("")))), note(m)))
    told = F.transform(methods["shown"], lambda m: F.concat(sign(m["access"]), F.lit(" "), escape_html(m["name"]), F.lit("()"), F.when(m["virtual"], F.lit(' <FONT COLOR="#1f4e79">v</FONT>')).otherwise("")))
    kind = F.when(abstract, F.lit('<BR/><FONT POINT-SIZE="8" COLOR="#666666">&#171;interface&#187;</FONT>')).otherwise("")
    head = F.concat(F.lit('<TR><TD ALIGN="CENTER" BGCOLOR="#eef3fa"><B>'), escape_html(short_name(name)), F.lit("</B>"), kind, F.lit("</TD></TR>"))
    return F.concat(F.lit('<<TABLE BORDER="0" CELLBORDER="1" CELLSPACING="0" CELLPADDING="4">'), head, row(F.concat(own, more(F.size(members) - 6))), row(F.concat(told, more(methods["more"]))), F.lit("</TABLE>>"))


def declaration_lines(decls: DataFrame) -> DataFrame:
    """(path, line, part, text): declarations (path, n_lines, line, kind, name, doc) as a listing, a head for each file and their docs below them."""
    heads = decls.select("path", "n_lines").distinct().select("path", F.lit(0).alias("line"), F.lit(0).alias("part"), F.format_string("══ %s  (%d줄)", "path", "n_lines").alias("text"))
    rows = decls.select("path", "line", F.lit(1).alias("part"), F.concat(F.lit("  "), F.lpad(F.col("line").cast("string"), 5, " "), F.lit(" "), F.rpad("kind", 12, " "), F.lit(" "), "name").alias("text"))
    docs = decls.filter("coalesce(doc, '') <> ''").select("path", "line", F.lit(2).alias("part"), F.concat(F.lit("        ㄴ "), "doc").alias("text"))
    return heads.unionByName(rows).unionByName(docs).orderBy("path", "line", "part")


def ledger_document(report: DataFrame, graph_sha: str, language: str, tool: str) -> DataFrame:
    """One row (codegraph_sha256, language, source_tool, reasons): a ledger bound to the graph it is of."""
    held = F.array_sort(F.collect_list(F.struct("rank", (-F.col("count")).alias("_n"), "reason", "class", "count", "samples")))
    reasons = F.transform(held, lambda r: F.struct(r["reason"].alias("reason"), r["class"].alias("class"), r["count"].alias("count"), r["samples"].alias("samples")))
    return report.agg(F.lit(graph_sha).alias("codegraph_sha256"), F.lit(language).alias("language"), F.lit(tool).alias("source_tool"), reasons.alias("reasons"))


def dot_edges(pairs: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(line): DOT edges of (a, b); red where (a, b) is among cyclic, mutual pairs once with both heads."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct().withColumn("_back", F.lit(True))
    red = cyclic.select("a", "b").distinct().withColumn("_red", F.lit(True))
    rows = pairs.select("a", "b").distinct().join(back, ["a", "b"], "left").join(red, ["a", "b"], "left").filter("_back is null or a < b")
    style = F.concat_ws(", ", F.when(F.col("_red"), "color=red"), F.when(F.col("_back"), "dir=both"))
    text = F.concat(F.lit('  "'), escape_dot(F.col("a")), F.lit('" -> "'), escape_dot(F.col("b")), F.lit('"'), F.when(style != "", F.concat(F.lit(" ["), style, F.lit("]"))).otherwise(""), F.lit(";"))
    return rows.orderBy("a", "b").select(text.alias("line"))


def markdown_table(df: DataFrame, order: list) -> DataFrame:
    """(line): rows of a markdown table in order."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns])
    return df.orderBy(*order).select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def write_document(value: object, path: str, indent: int = 2) -> None:
    """One small JSON document on the driver: equal values give equal bytes, and readers see the old or the new."""
    text = json.dumps(value, ensure_ascii=False, indent=indent, sort_keys=True) + "\n"
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temp, path)


def write_lines(lines: DataFrame, folder: str, order: tuple[str, ...] = ("part", "path")) -> None:
    """Lines in order as text files: ranges are written side by side, and the files in order of name are the document."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(folder)


def upsert(existing: DataFrame | None, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Rows of fresh, and those of existing whose key isn't among them."""
    if existing is None:
        return fresh
    return existing.join(fresh.select(*key).distinct(), key, "left_anti").select(*fresh.columns).unionByName(fresh)


def split_sinks(df: DataFrame, fault: F.Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a fault, and those with one and its name."""
    judged = df.withColumn("fault", fault)
    return judged.filter("fault is null").drop("fault"), judged.filter("fault is not null")


def sidebar(names: DataFrame) -> DataFrame:
    """(text, link) of markdown files but the index, by text."""
    pages = names.filter(F.col("name").endswith(".md") & (F.col("name") != "index.md"))
    stem = F.regexp_replace("name", r"\.md$", "")
    return pages.select(stem.alias("text"), F.concat(F.lit("/"), stem).alias("link")).orderBy("text")
