"""From a C++ collector's elements and relationships, and a documentation collector's symbols, to a code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import member_at
from ..functions.text import qualified
from ..schemas import EXTERNAL, KIND_MAP
from ..session import cut
from .assemble import all_of, assemble, drop, external_nodes, first_party, node_ids, ords, top_folder

DEPTH = 4
SYMBOLS = "name string, kind string, namespace string, file string, line int, signature string, doc string, ord bigint"


def shown_name() -> Column:
    return F.coalesce(F.nullif("display_name", F.lit("")), F.col("name"))


def is_wrapper(namespace: Column, name: Column) -> Column:
    """A container or smart pointer of the standard library: it stands for what it holds."""
    return (F.split(F.coalesce(namespace, F.lit("")), "::")[0] == "std") & name.isin(*fixed.STD_TRANSPARENT)


def external_group(namespace: Column, name: Column) -> Column:
    """External types fold to the root of their namespace; the standard library to one label, those of no namespace to their name."""
    root = F.split(F.coalesce(namespace, F.lit("")), "::")[0]
    return F.when(root == "std", fixed.STD_LABEL).when(root != "", root).otherwise(F.concat(F.lit(fixed.OTHER_LABEL + " "), F.coalesce(name, F.lit("?"))))


def marked_elements(elements: DataFrame, **where) -> DataFrame:
    """(eid, ord, shown, bare, role, group, type, abstract, args, file, line, members): what each element becomes.

    role: wrapper, primitive, own or external.  where: see first_party.
    """
    flat = elements.select(
        F.col("id").alias("eid"), F.col("ord").cast("bigint").alias("ord"), "namespace", "name", shown_name().alias("shown"), "type", F.coalesce("is_abstract", F.lit(False)).alias("abstract"),
        F.coalesce(F.transform("template_parameters", lambda p: p["type"]), F.array().cast("array<string>")).alias("args"), F.col("source_location.file").alias("file"), F.col("source_location.line").alias("line"), "members",
    )
    named = flat.withColumns({"bare": F.col("name"), "name": F.coalesce("name", "shown")})
    told = first_party(named, **where)
    role = F.when(is_wrapper(F.col("namespace"), F.col("bare")), "wrapper").when(F.col("shown").isin(*fixed.CPP_PRIMITIVES), "primitive").when(F.col("own"), "own").otherwise("external")
    return told.withColumns({"role": role, "group": external_group(F.col("namespace"), F.col("bare"))})


def element_nodes(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eid, id) of elements that became nodes, and the nodes with the place they were made at."""
    own = marked.filter("role = 'own'").select(F.col("eid").alias("key"), F.lit(False).alias("external"), ords("ord").alias("ord"))
    outer = marked.filter("role = 'external'").groupBy(F.col("group").alias("key")).agg(F.min("ord").alias("ord")).select("key", F.lit(True).alias("external"), ords("ord").alias("ord"))
    ids = cut(node_ids(own.unionByName(outer)), "node-ids")
    mine = marked.filter("role = 'own'").join(ids.filter("not external").select(F.col("key").alias("eid"), "id"), "eid")
    theirs = marked.filter("role = 'external'").withColumn("id", F.concat(F.lit("X:"), "group"))
    none = F.lit(None)
    nodes = mine.select(
        "id", F.col("shown").alias("name"), F.when(F.col("type") == "enum", "enum").otherwise("class").alias("kind"), top_folder(F.col("file")).alias("module"), "file", F.col("line").cast("int").alias("line"),
        none.cast("string").alias("signature"), none.cast("string").alias("doc"), none.cast("string").alias("abstraction"), none.cast("array<string>").alias("collapsed_from"),
    )
    folded = external_nodes(theirs.select("id", F.col("group").alias("name"), F.col("shown").alias("raw")))
    return mine.select("eid", "id").unionByName(theirs.select("eid", "id")), nodes.unionByName(outside(folded, nodes.columns))


def outside(folded: DataFrame, columns: list[str]) -> DataFrame:
    """External nodes (id, name, collapsed_from) with the columns of all nodes."""
    fixed_columns = {"id": F.col("id"), "name": F.col("name"), "kind": F.lit("external"), "module": F.lit(EXTERNAL), "line": F.lit(None).cast("int"), "collapsed_from": F.col("collapsed_from")}
    return folded.select(*[fixed_columns.get(c, F.lit(None).cast("string")).alias(c) for c in columns])


def merge_symbols(nodes: DataFrame, symbols: DataFrame, **where) -> tuple[DataFrame, list[DataFrame]]:
    """nodes with a documentation collector's symbols (SYMBOLS): own ones move and describe the node of their name, or are new nodes.

    The last symbol of a name places the node; the last signature and doc that
    aren't empty stay.
    """
    told = cut(first_party(symbols, **where), "symbols").withColumn("qname", qualified(F.col("namespace"), F.col("name")))
    mine = told.filter("own")
    last = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ord"))).alias(c)
    by_name = mine.groupBy("qname").agg(F.max_by(F.struct("file", "line"), "ord").alias("at"), F.min_by("kind", "ord").alias("kind"), F.min("ord").alias("ord"), F.count("*").alias("n"), last("signature"), last("doc"))
    by_name = cut(by_name.withColumns({"signature": F.nullif("signature", F.lit("")), "doc": F.nullif("doc", F.lit(""))}), "symbol-names")
    # of nodes that share a name, the one made last is the one known by it
    known = nodes.filter("kind <> 'external'").groupBy(F.col("name").alias("qname")).agg(F.max_by("id", F.substring("id", 2, 20).cast("bigint")).alias("id"))
    hit = by_name.join(known, "qname")
    new = by_name.join(known, "qname", "left_anti")
    ids = node_ids(new.select(F.col("qname").alias("key"), F.lit(False).alias("external"), ords("ord").alias("ord")), nodes.count())
    moved = nodes.join(hit.select("id", "at", F.col("signature").alias("_signature"), F.col("doc").alias("_doc")), "id", "left")
    moved = moved.select(
        "id", "name", "kind", F.when(F.col("at").isNotNull(), top_folder(F.col("at.file"))).otherwise(F.col("module")).alias("module"), F.when(F.col("at").isNotNull(), F.col("at.file")).otherwise(F.col("file")).alias("file"),
        F.when(F.col("at").isNotNull(), F.col("at.line")).otherwise(F.col("line")).alias("line"), F.coalesce("_signature", "signature").alias("signature"), F.coalesce("_doc", "doc").alias("doc"), "abstraction", "collapsed_from",
    )
    made = new.join(ids.select(F.col("key").alias("qname"), "id"), "qname").select(
        "id", F.col("qname").alias("name"), "kind", top_folder(F.col("at.file")).alias("module"), F.col("at.file").alias("file"), F.col("at.line").alias("line"), "signature", "doc", F.lit(None).cast("string").alias("abstraction"), F.lit(None).cast("array<string>").alias("collapsed_from")
    )
    again = hit.select("n").unionByName(new.select((F.col("n") - 1).alias("n"))).filter("n > 0").select(F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    drops = [drop(told.filter("not own"), "clang-doc 1차 아님(버림)"), drop(again, "clang-doc 로 위치 갱신"), drop(new, "clang-doc 신규 노드", F.col("kind"), ords("ord"))]
    return moved.unionByName(made), drops


def resolve(marked: DataFrame, ids: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(eid, id, pos): the nodes that an element stands for; wrappers stand for their arguments, as often as those come.

    pos orders the nodes of an element.  Of elements that share a display name the last is meant.
    """
    shown = marked.groupBy(F.col("shown").alias("arg")).agg(F.max_by("eid", "ord").alias("next"))
    info = marked.filter("role = 'wrapper'").select(F.col("eid").alias("at"), "args")
    out = [ids.select("eid", "id", F.array().cast("array<int>").alias("pos"))]
    front = marked.filter("role = 'wrapper'").select("eid", F.col("eid").alias("at"), F.array().cast("array<int>").alias("pos"))
    known = ids.select(F.col("eid").alias("next"), "id")
    for _ in range(depth):
        args = front.join(info, "at").select("eid", "pos", F.posexplode("args").alias("k", "arg")).select("eid", F.concat("pos", F.array("k")).alias("pos"), "arg").join(shown, "arg")
        out.append(args.join(known, "next").select("eid", "id", "pos"))
        front = args.select("eid", F.col("next").alias("at"), "pos")
    return all_of(out)


def normalize(elements: DataFrame, relations: DataFrame, symbols: DataFrame | None = None, namespaces: tuple[str, ...] = (), lines: DataFrame | None = None, tracked: DataFrame | None = None, root: str = "") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, edges, modules and ledger of a C++ class diagram, with its documentation symbols where given.

    A repository's own types are told by namespace, or by place: in root, in
    tracked (path), on a line of lines (path, line, text) that defines them.
    Kinds are mapped after both ends resolve: an extension of an abstract
    element is a realization.  Of elements that share an id the last counts.
    """
    where = {"namespaces": namespaces, "lines": lines, "tracked": tracked, "root": root}
    marked = cut(marked_elements(elements, **where), "elements")
    ids, nodes = element_nodes(marked)
    drops = [drop(marked.filter("role = 'wrapper'"), "R5 투과 래퍼"), drop(marked.filter("role = 'primitive'"), "R7 원시 타입 제외"), drop(marked.filter("role = 'own'"), "1차 노드"), drop(marked.filter("role = 'external'"), "외부 원본 타입")]
    if symbols is not None:
        nodes, more = merge_symbols(cut(nodes, "element-nodes"), symbols, **where)
        drops += more
    nodes = cut(nodes, "nodes")
    ends = cut(resolve(marked, ids), "ends")
    last = marked.groupBy("eid").agg(F.max_by(F.struct("abstract", "members"), "ord").alias("e"))
    flags = last.select(F.col("eid").alias("destination"), F.col("e.abstract").alias("_abstract"))
    bodies = last.select(F.col("eid").alias("source"), F.col("e.members").alias("_members"))
    base = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in KIND_MAP.items()])
    kind = F.when((F.col("type") == "extension") & F.coalesce("_abstract", F.lit(False)), "realization").otherwise(base)
    place = member_at(F.transform("_members", lambda m: F.struct(m["name"].alias("name"), m["source_location"]["file"].alias("file"), m["source_location"]["line"].alias("line"))), F.col("label"))
    told = relations.join(flags, "destination", "left").join(bodies, "source", "left").select("type", "source", "destination", "label", F.col("ord").cast("bigint").alias("ord"), kind.alias("kind"), place.alias("at"))
    told = cut(told, "relations")
    drops += [drop(told.filter("type = 'containment'"), "containment 버림(자리 없음)"), drop(told.filter("type <> 'containment' and kind is null"), "모르는 관계 종류", F.col("type"), ords("ord"))]
    known = told.filter("type <> 'containment' and kind is not null")
    left = ends.select(F.col("eid").alias("source"), F.col("id").alias("src"), F.col("pos").alias("p"))
    right = ends.select(F.col("eid").alias("destination"), F.col("id").alias("dst"), F.col("pos").alias("q"))
    has = lambda side, end: side.select(end, F.lit(True).alias(f"_{end}")).distinct()
    lost = known.join(has(left, "source"), "source", "left").join(has(right, "destination"), "destination", "left").filter("_source is null or _destination is null")
    drops.append(drop(lost, "끝점 해소 실패", F.format_string("%s -> %s (%s)", "source", "destination", "type"), ords("ord")))
    place_of = F.concat(F.array("ord"), F.transform(F.concat(F.array(F.size("p")), "p", F.array(F.size("q")), "q"), lambda x: x.cast("bigint")))
    uses = known.join(left, "source").join(right, "destination").select("src", "dst", "kind", "label", F.col("at.file").alias("file"), F.col("at.line").cast("int").alias("line"), place_of.alias("ord"))
    return assemble(nodes, uses, drops)
