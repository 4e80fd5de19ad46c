"""Readers of the engine's documents: class diagrams, symbol folders, Python sources, listings, logs, snapshots.

Every reader takes its schema as given and keeps an ordinal where order has meaning.
"""

from __future__ import annotations

import ast
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.documents import nested_texts
from ..functions.text import dotted_module
from ..operators.ordered import doc_above, numbered
from ..schemas import UML
from ..session import cut

CALLS = "kind string, a string, b string, file string, line int, signature string, ord bigint"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, by Spark's reader only, so any store will do."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str, schema, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(path, doc) parsed by schema, and (path, reason) of those that are malformed or lack a required key."""
    texts = read_texts(spark, path)
    parsed = texts.select("path", "text", F.try_parse_json("text").alias("v"), F.from_json("text", schema).alias("doc"))
    lacking = F.filter(F.array(*[F.when(F.col(f"doc.{k}").isNull(), F.lit(k)) for k in required]) if required else F.array().cast("array<string>"), lambda x: x.isNotNull())
    reason = F.when(F.col("v").isNull(), "not JSON").when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
    judged = parsed.withColumn("reason", reason)
    return judged.filter("reason is null").select("path", "doc"), judged.filter("reason is not null").select("path", "reason")


def read_diagram(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """elements, relationships (with their ordinal) and faults of class-diagram documents."""
    docs, faults = read_documents(spark, path, UML, ("elements", "relationships"))
    elements = docs.select(F.posexplode("doc.elements").alias("ord", "e")).select("ord", "e.*")
    relations = docs.select(F.posexplode("doc.relationships").alias("ord", "r")).select("ord", "r.*")
    return elements, relations, faults


def qualified_namespace(names: Column) -> Column:
    """An inner-first namespace array as outer::inner, without the global one."""
    return F.array_join(F.filter(F.reverse(names), lambda x: x != "GlobalNamespace"), "::")


def signature(returns: Column, name: Column, params: Column) -> Column:
    """`type name(type arg, ...)`; params: array<struct<type, name>>."""
    return F.concat(returns, F.lit(" "), name, F.lit("("), F.array_join(F.transform(params, lambda p: F.trim(F.concat_ws(" ", p["type"], p["name"]))), ", "), F.lit(")"))


#: A documentation collector's item, as far as it is read.
DOC_ITEM = "struct<USR:string,Name:string,Namespace:array<string>,Location:struct<Filename:string,LineNumber:int>,ReturnType:struct<Name:string>,Params:array<struct<Name:string,Type:struct<Name:string>>>,InfoType:string,TagType:string>"


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, namespace, file, line, signature, doc, ord) of a documentation collector's folder.

    Functions and enums come from index.json, records from the files of their
    own; others, and files that can't be read, are passed over.  Of symbols with
    one id, or else one place and name, the first by path stays.
    """
    texts = read_texts(spark, path).filter(F.col("path").endswith(".json") & F.try_parse_json("text").isNotNull())
    is_index = F.substring_index("path", "/", -1) == "index.json"
    listed = F.from_json("text", f"struct<Functions:array<{DOC_ITEM}>,Enums:array<{DOC_ITEM}>>")
    described = lambda key: F.try_variant_get(F.try_parse_json("text"), f"$.{key}", "array<variant>")
    index = texts.filter(is_index).withColumn("d", listed)
    several = lambda key, kind: index.select("path", F.posexplode(F.arrays_zip(F.col(f"d.{key}").alias("i"), F.transform(described(key), lambda v: F.to_json(v)).alias("raw"))).alias("k", "x"), F.lit(kind).alias("kind")).select("path", "k", F.col("x.i").alias("i"), F.col("x.raw").alias("raw"), "kind")
    single = texts.filter(~is_index).select("path", F.lit(0).alias("k"), F.from_json("text", DOC_ITEM).alias("i"), F.col("text").alias("raw")).filter("i.InfoType = 'record'")
    kind = F.when(F.col("i.TagType").isin("struct", "union"), F.col("i.TagType")).otherwise("class")
    items = several("Functions", "function").unionByName(several("Enums", "enum")).unionByName(single.withColumn("kind", kind))
    params = F.transform(F.coalesce("i.Params", F.array().cast("array<struct<Name:string,Type:struct<Name:string>>>")), lambda p: F.trim(F.concat_ws(" ", p["Type"]["Name"], p["Name"])))
    spelled = F.concat(F.trim(F.concat_ws(" ", F.col("i.ReturnType.Name"), F.col("i.Name"))), F.lit("("), F.array_join(params, ", "), F.lit(")"))
    told = items.filter("i.Location.Filename <> '' and i.Location.LineNumber > 0").select(
        F.col("i.USR").alias("usr"), F.coalesce("i.Name", F.lit("")).alias("name"), "kind", qualified_namespace(F.coalesce("i.Namespace", F.array().cast("array<string>"))).alias("namespace"), F.col("i.Location.Filename").alias("file"), F.col("i.Location.LineNumber").alias("line"),
        F.when(F.col("kind") == "function", spelled).otherwise("").alias("signature"), nested_texts(F.get_json_object("raw", "$.Description")).alias("doc"), F.format_string("%s %09d", "path", "k").alias("path"),
    )
    return numbered(first_symbols(told).drop("usr", "path"), ["file", "line", "name"], "ord")


def first_symbols(symbols: DataFrame) -> DataFrame:
    """Of symbols with one key (usr, or else file, line, name) the first by path, in order of place."""
    key = F.coalesce(F.nullif("usr", F.lit("")), F.concat_ws("|", "file", "line", "name"))
    first = symbols.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*symbols.columns), "path").alias("s"))
    return first.select("s.*").orderBy("file", "line", "name")


def tracked(listing: DataFrame, language: str, includes: tuple[str, ...] = ()) -> DataFrame:
    """(path) of a language's files outside skipped folders, under a prefix if any are given."""
    right = F.lit(False)
    for end in fixed.DECL_EXTS[language]:
        right = right | F.col("path").endswith(end)
    inside = F.lit(not includes)
    for prefix in includes:
        inside = inside | F.col("path").startswith(prefix)
    return listing.filter(right & inside & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, fixed.DECL_SKIPPED)))).select("path").distinct().orderBy("path")


def count_languages(listing: DataFrame) -> DataFrame:
    """(language, n, rank) of a listing by extension, one row for each language, none left out."""
    def counted(ends):
        hit = F.lit(False)
        for end in ends:
            hit = hit | F.col("path").endswith(end)
        return F.count(F.when(hit, 1))

    rows = F.array(*[F.struct(F.lit(k).alias("language"), counted(ends).alias("n"), F.lit(rank).alias("rank")) for rank, (k, ends) in enumerate(fixed.LANG_EXTS.items())])
    return listing.select("path").distinct().agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def top_language(counts: DataFrame, among: tuple[str, ...] | None = None) -> DataFrame:
    """(language): the one with most sources, the first of equal ones; null where none has any."""
    able = counts.filter("n > 0") if among is None else counts.filter("n > 0").filter(F.col("language").isin(*among))
    return able.agg(F.max_by("language", F.struct("n", -F.col("rank"))).alias("language"))


def walked(listing: DataFrame, skipped: tuple[str, ...] = fixed.WALK_SKIPPED) -> DataFrame:
    """The paths of a folder's listing below no skipped folder."""
    return listing.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skipped))))


def document_heads(docs: DataFrame, limit: int = 6000) -> DataFrame:
    """(text): the first characters of a project's own documents, a header each, in their fixed order; docs (name, text)."""
    rank = F.coalesce(*[F.when(F.col("name") == n, k) for k, n in enumerate(fixed.DOC_NAMES)])
    part = F.concat(F.lit("===== "), "name", F.lit(" =====\n"), F.substring("text", 1, limit))
    told = docs.filter(F.col("name").isin(*fixed.DOC_NAMES)).select(rank.alias("rank"), part.alias("part"))  # four at most
    return told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n").alias("text"))


def source_index(listing: DataFrame) -> DataFrame:
    """(name, n, path) as by_basename, of sources outside skipped folders."""
    name = F.substring_index("path", "/", -1)
    kept = walked(listing, fixed.INDEX_SKIPPED).filter(F.regexp_extract(name, r"\.([^.]*)$", 1).isin(*fixed.INDEX_EXTS))
    return by_basename(kept)


def by_basename(listing: DataFrame) -> DataFrame:
    """(name, n, path): how many files have a name, and the path where it is one."""
    return listing.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("path")).withColumn("path", F.when(F.col("n") == 1, F.col("path")))


def repo_relative(uri: Column, root: str) -> Column:
    """A file URI as a path below root, escapes decoded."""
    path = F.url_decode(F.regexp_replace(uri, "^file://", ""))
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(path)


def relative_files(entries: DataFrame, root: str) -> DataFrame:
    """(path): the distinct files of compile entries (file) below root, sorted."""
    return entries.filter("file is not null").select(F.substring("file", len(root) + 2, 1 << 20).alias("path")).distinct().orderBy("path")


def python_roots(listing: DataFrame) -> DataFrame:
    """(root): folders at the top, or right below src, that hold Python files of their own, sorted; `.` where there are none.  listing: (path)."""
    steps = F.split("path", "/")
    deep = F.size(steps)
    root = F.when(deep == 2, steps[0]).when((deep == 3) & (steps[0] == "src"), F.concat(F.lit("src/"), steps[1]))
    found = listing.filter(F.col("path").endswith(".py")).select(root.alias("root")).filter("root is not null").filter(~F.col("root").startswith(".") & ~F.col("root").isin(*fixed.NO_ROOTS)).distinct()
    none = found.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(".").alias("root"))
    return found.unionByName(none).orderBy("root")


def declarations(sources: DataFrame, language: str, chars: int = 0, reach: int = 14) -> DataFrame:
    """(path, n_lines, line, kind, name, doc) of lines of (path, text) that declare something.

    doc is the comment right above, blank lines and attributes passed over, its
    first `chars` characters; none of it is read where chars is 0.
    """
    pattern, heads, lead, cut_off = fixed.DECLARATIONS[language]
    parts = sources.select("path", F.split("text", "\n", -1).alias("t"))
    lines = parts.select("path", F.size("t").alias("n_lines"), F.posexplode("t").alias("line", "text")).withColumn("line", F.col("line") + 1)
    name = F.trim(F.regexp_replace(F.regexp_extract("text", pattern, 2), r"[:{(=][\s\S]*$", ""))
    found = lines.select("path", "n_lines", "line", F.regexp_extract("text", pattern, 1).alias("kind"), name.alias("name")).filter("name <> ''")
    if not chars:
        return found.withColumn("doc", F.lit(""))
    bare = F.trim("text")
    says = reduce(lambda a, h: a | bare.startswith(h), heads, F.lit(False))
    skip = (bare == "") | bare.startswith("[") | bare.startswith("@")
    above = doc_above(lines, F.regexp("text", F.lit(pattern)), says, skip, reach, "path", lambda x: _comment(x, lead, cut_off))
    return found.join(above, ["path", "line"], "left").select("path", "n_lines", "line", "kind", "name", F.substring(F.coalesce("doc", F.lit("")), 1, chars).alias("doc"))


def _comment(line: Column, lead: str, cut_off: str | None) -> Column:
    """What a comment line says."""
    body = F.regexp_replace(F.trim(line), lead, "")
    return F.trim(F.regexp_replace(body, cut_off, "") if cut_off else body)


def signature_of(fn: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """(parameters) -> returns as it would be written, positional-only marks aside."""
    args = fn.args
    positional = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(positional) - len(args.defaults)) + list(args.defaults)

    def one(arg: ast.arg, default: ast.expr | None) -> str:
        told = f": {ast.unparse(arg.annotation)}" if arg.annotation else ""
        given = "" if default is None else (" = " if told else "=") + ast.unparse(default)
        return arg.arg + told + given

    star = [f"*{args.vararg.arg}"] if args.vararg else ["*"] if args.kwonlyargs else []
    parts = [*map(one, positional, defaults), *star, *map(one, args.kwonlyargs, args.kw_defaults), *([f"**{args.kwarg.arg}"] if args.kwarg else [])]
    return f"({', '.join(parts)})" + (f" -> {ast.unparse(fn.returns)}" if fn.returns else "")


def _scan(path: str, text: str) -> list[tuple]:
    """Symbols, imports and raw calls of one Python module; none where it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [("fault", "syntax", None, path, None, None)]
    out: list[tuple] = []
    is_function = lambda n: isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))

    def calls(owner: str, body: ast.AST) -> None:
        for n in ast.walk(body):
            if not isinstance(n, ast.Call):
                continue
            if isinstance(n.func, ast.Name):
                out.append(("call", owner, n.func.id, path, n.lineno, None))
            elif isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name):
                out.append(("call", owner, f"{n.func.value.id}.{n.func.attr}", path, n.lineno, None))

    for node in tree.body:
        if is_function(node):
            out.append(("function", node.name, None, path, node.lineno, signature_of(node)))
            calls(node.name, node)
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, None, path, node.lineno, None))
            for sub in filter(is_function, node.body):
                out.append(("method", f"{node.name}.{sub.name}", None, path, sub.lineno, signature_of(sub)))
                calls(f"{node.name}.{sub.name}", sub)
        else:
            calls("", node)
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            out += [("from", a.asname or a.name, f"{node.module or ''}|{a.name}", path, node.lineno, None) for a in node.names]
        elif isinstance(node, ast.Import):
            out += [("import", a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], path, node.lineno, None) for a in node.names]
    return out


def scan_python(sources: DataFrame) -> DataFrame:
    """(kind, a, b, file, line, signature, ord): symbols, imports, raw calls and faults of Python sources (path, text)."""

    def run(batches):
        for b in batches:
            rows = [(*r, k) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, r in enumerate(_scan(p, t or ""))]
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "a", "b", "file", "line", "signature", "ord"])

    return sources.select("path", "text").mapInArrow(run, CALLS)


def import_names(files: DataFrame) -> DataFrame:
    """(written, module): every dotted path by which exactly one module or folder of the sources (file) can be meant.

    A path is a folder's or module's own, or a tail of it; a tail of several is none.
    """
    parts = F.split(dotted_module(F.col("file")), r"\.")
    known = files.select("file").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("module")).distinct()
    piece = F.split("module", r"\.")
    tails = known.select("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(piece)), lambda i: F.array_join(F.slice(piece, i, F.size(piece)), "."))).alias("written")).distinct()
    return tails.groupBy("written").agg(F.count("*").alias("n"), F.min("module").alias("module")).filter("n = 1").select("written", "module")


def python_calls(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbols (name, kind, module, file, line, signature, ord) and resolved calls (caller, callee, file, line).

    Imports that hit the sources rename what they bind; other names that are no
    built-ins are the module's own.  Only calls between different symbols of the
    sources stay, the first of each pair.
    """
    module = dotted_module(F.col("file"))
    order = F.struct("file", "ord")
    told = scanned.filter(F.col("kind").isin("function", "class", "method")).select(F.concat_ws(".", module, "a").alias("name"), "kind", module.alias("module"), "file", "line", "signature", order.alias("at"))
    symbols = numbered(told, ["at"], "ord").drop("at")
    names = cut(import_names(scanned), "import-names")
    whole = scanned.filter("kind = 'import'").select("file", F.col("a").alias("head"), F.col("b").alias("written"), F.lit(None).cast("string").alias("tail"), "ord")
    parts = scanned.filter("kind = 'from'").select("file", F.col("a").alias("head"), F.substring_index("b", "|", 1).alias("written"), F.substring_index("b", "|", -1).alias("tail"), "ord")
    bound = whole.unionByName(parts).join(names, "written").select("file", "head", F.concat_ws(".", "module", "tail").alias("target"), "ord")
    imports = bound.groupBy("file", "head").agg(F.max_by("target", "ord").alias("target"))
    raw = scanned.filter("kind = 'call'").select(F.concat_ws(".", module, F.nullif("a", F.lit(""))).alias("caller"), module.alias("module"), "file", "line", F.col("b").alias("called"), "ord")
    raw = raw.withColumn("head", F.substring_index("called", ".", 1)).withColumn("rest", F.when(F.instr("called", ".") > 0, F.regexp_replace("called", r"^[^.]*\.", "")))
    looked = raw.join(imports, ["file", "head"], "left")
    own = F.col("rest").isNull() & ~F.col("head").isin(*fixed.BUILTINS)
    callee = F.when(F.col("target").isNotNull(), F.concat_ws(".", "target", "rest")).when(own, F.concat_ws(".", "module", "head")).otherwise(F.col("called"))
    pairs = looked.select("caller", callee.alias("callee"), "file", "line", "ord").filter("caller <> callee")
    ids = told.select("name").distinct()
    kept = pairs.join(ids.withColumnRenamed("name", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("name", "callee"), "callee", "left_semi")
    first = kept.groupBy("caller", "callee").agg(F.min(F.struct("file", "ord", "line")).alias("f"))
    return symbols, first.select("caller", "callee", F.col("f.file").alias("file"), F.col("f.line").alias("line")).orderBy("caller", "callee")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime, size, seen, file_hash, decl_hash) of a snapshot document, wrapped in `files` or bare."""
    entry = "struct<mtime:double,size:bigint,seen:double,file_hash:string,decl_hash:string>"
    texts = read_texts(spark, path)
    files = F.coalesce(F.from_json("text", f"struct<files:map<string,{entry}>>")["files"], F.from_json("text", f"map<string,{entry}>"))
    return texts.select(F.explode(files).alias("path", "e")).select("path", "e.*")
