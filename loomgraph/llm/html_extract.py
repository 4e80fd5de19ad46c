"""Main text of HTML pages by two-pass block rules.

A page becomes blocks: runs of text between block tags.  The first pass decides
each block by itself, from where it stands (an article, or a menu, header,
footer, sidebar, notice, advert, form or comments), its length, its link
density and its stop-word density.  The lists of stop words are of four
languages; a block that has too few of them is judged by its sentences instead,
so other languages pass.  Short blocks that say too little stay undecided and in the second pass take the label of their nearest decided
neighbours: both alike decide, and where they differ the nearer one does.

Scripts, styles and markup never reach a block.  Broken markup is read as it
comes: a closing tag closes what is open of its name, and everything inside.

Scale: one map over the scan, whole pages, no shuffle, in time linear in a page
however deep or broken it is.  A null or empty page,
or one with no main text, gives the empty text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Elements by role.
RAW = frozenset("script style noscript template textarea title xmp iframe svg annotation annotation-xml canvas object select option datalist audio video map".split())
BOILER = frozenset("nav footer aside form button menu dialog head search".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article main header footer nav aside form fieldset legend figure figcaption address details summary hr center menu dialog hgroup search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that name what is not main text.
NEGATIVE = re.compile(
    r"(?:^|[\s_\-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|pagination|pager|sidebar|side|aside|rail|related|recommended|recommendations|popular|trending|widget|share|sharing|social|tags|toolbar|masthead|header|footer|foot|copyright|legal|"
    r"comment|comments|commentlist|respond|reply|replies|discussion|disqus|contentinfo|complementary|search|form)(?:$|[\s_\-])"
)
#: Frequent words of the languages served.
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are as with be by at from or an this have not but which you they his her all will there their one were can has more if no so what about when who its also into than then them these some other only new out up over after "
    "de la le et les des en un une du que qui est pour dans par sur pas au avec il elle on ne se ce sont plus ou mais leur son sa ses aux nous vous cette comme être fait "
    "der die das und zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man kann "
    "el los las y del se por con una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está".split()
)
LONG, SHORT = 140, 70
LINKS, LINKS_MAIN = 0.3, 0.6
STOP_LOW, STOP_HIGH = 0.12, 0.25
#: Prose without listed stop words ends a sentence in so many characters at least.
SENTENCE = 280

GOOD, BAD, OPEN, NEAR_GOOD = 1, 0, -1, 2

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*>|\?[^>]*>|(/?)([a-zA-Z][a-zA-Z0-9:\-]*)((?:[^<>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|(?=<)|\Z))", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
#: Ends of sentences, of several scripts.
_END = re.compile(r"[.!?…‽](?=[\s\"'»”’)\]]|$)|[。！？｡।॥؟۔։።]")
#: A wrapper that has or lacks a sidebar isn't one.
_WITHOUT = re.compile(r"(?:^|(?<=[\s_\-]))(?:with|has|no|without)[_\-]\S*")


class Block:
    __slots__ = ("parts", "linked", "main", "boiler", "heading", "parent", "text")

    def __init__(self, main: bool, boiler: bool, heading: bool, parent: int):
        self.parts: list[str] = []
        self.linked, self.main, self.boiler, self.heading, self.parent = 0, main, boiler, heading, parent


def _negative(attrs: str) -> bool:
    """The attributes name something that is not main text, or hide it."""
    if not attrs or attrs.isspace():
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            if NEGATIVE.search(_WITHOUT.sub("", value)):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in its order, with white space folded and references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open elements: name, negative, main, number
    now: Block | None = None
    links = boiler = main = headings = number = 0
    opened: Counter[str] = Counter()  # open elements by name
    holders: list[int] = [0]  # numbers of open elements that hold blocks
    endless: set[str] = set()  # raw elements that nothing closes from here on
    at, size = 0, len(page)

    def add(raw: str):
        nonlocal now
        if not raw:
            return
        if now is None:
            if raw.isspace():
                return
            now = Block(main > 0, boiler > 0, headings > 0, holders[-1])
            out.append(now)
        text = html.unescape(raw) if "&" in raw else raw
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def pop():
        nonlocal links, boiler, main, headings
        name, negative, is_main, _ = stack.pop()
        boiler -= negative
        main -= is_main
        links -= name == "a"
        headings -= name in _HEADINGS
        opened[name] -= 1
        if name in _HOLDERS:
            holders.pop()
        return name

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if opened[name] > 0:
                while True:
                    closed = pop()
                    if closed in BLOCKS:
                        now = None
                    if closed == name:
                        break
            elif name in BLOCKS:
                now = None
            continue
        if name in RAW:
            closes = not m[3].rstrip().endswith("/") and name not in endless
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at) if closes else None
            if closes and not end:
                endless.add(name)
            if end:
                at = end.end()
            elif not m[3].rstrip().endswith("/") and name in ("script", "style"):
                at = size
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            now = None
            # an open paragraph ends where a block begins, an item where the next does
            while stack and (stack[-1][0] == "p" or stack[-1][0] in _INLINE and any(s[0] == "p" for s in stack[-4:]) or name in _ITEMS and stack[-1][0] == name):
                if stack[-1][0] in _INLINE and stack[-1][0] == "a":
                    break
                pop()
        if name in VOID:
            continue
        negative = name in BOILER or _negative(m[3]) and name not in ("html", "body") or name == "header" and not main
        is_main = name in MAIN and not negative
        number += 1
        stack.append((name, negative, is_main, number))
        opened[name] += 1
        if name in _HOLDERS:
            holders.append(number)
        boiler += negative
        main += is_main
        links += name == "a"
        headings += name in _HEADINGS
    for b in out:
        b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
    return [b for b in out if b.text]


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HOLDERS = BLOCKS - _HEADINGS - {"p"}
_INLINE = frozenset("b i em strong span u s small font sub sup mark code".split())
_ITEMS = frozenset("li dt dd tr td th option".split())


def first_pass(b: Block, has_main: bool) -> int:
    """A block by itself."""
    if has_main and not b.main:
        return BAD
    size = len(b.text)
    density = b.linked / max(1, sum(map(len, b.parts)))
    if density > (LINKS_MAIN if b.main else LINKS) and not (b.main and b.heading):
        return BAD
    if b.main:
        # inside an article a block is main text unless it is short and half of it is links
        return OPEN if size < SHORT and density > 0.5 and not b.heading else GOOD
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if size < SHORT:
        return BAD if density > 0 and size < SHORT // 2 else OPEN
    if stops >= STOP_HIGH:
        return GOOD if size >= LONG or not b.linked else NEAR_GOOD
    if stops >= STOP_LOW:
        return NEAR_GOOD
    if not b.linked and len(_END.findall(b.text)) * SENTENCE >= size:
        return GOOD if size >= LONG else NEAR_GOOD  # prose in a language that isn't listed
    return OPEN if size < LONG else BAD


def second_pass(labels: list[int | None], headings: list[bool], parents: list[int] | None = None) -> list[int]:
    """Undecided blocks take the label of their nearest decided neighbours.

    A label of None is of a block that stands in a menu, footer or the like: bad
    by its place, and no neighbour of anything.  A good neighbour in the same
    parent decides by itself.  The ends of the page count as bad.
    """
    n = len(labels)
    parents = parents or list(range(n))
    decided = [k for k, x in enumerate(labels) if x in (GOOD, BAD)]
    before, after, last = [None] * n, [None] * n, None
    for k in range(n):
        before[k] = last
        last = k if labels[k] in (GOOD, BAD) else last
    last = None
    for k in reversed(range(n)):
        after[k] = last
        last = k if labels[k] in (GOOD, BAD) else last
    out = []
    for k, x in enumerate(labels):
        i, j = before[k], after[k]
        if x in (GOOD, BAD, None):
            out.append(GOOD if x == GOOD else BAD)
        elif not decided or any(m is not None and labels[m] == GOOD and parents[m] == parents[k] for m in (i, j)):
            out.append(GOOD)  # a page on which nothing is decided is its own main text
        else:
            left, right = (labels[i] if i is not None else BAD), (labels[j] if j is not None else BAD)
            to_left, to_right = (k - i if i is not None else k + 1), (j - k if j is not None else n - k)
            if left == right:
                out.append(left)
            elif x == NEAR_GOOD:
                out.append(GOOD)
            elif headings[k]:
                out.append(right)
            else:
                out.append(left if to_left < to_right else right if to_right < to_left else BAD)
    return out


def extract(page: str | None) -> str:
    """The main text of one page: its good blocks in order, one a line."""
    if not page:
        return ""
    found = blocks(page)
    has_main = any(b.main and not b.boiler for b in found)
    first = [None if b.boiler else first_pass(b, has_main) for b in found]
    labels = second_pass(first, [b.heading for b in found], [b.parent for b in found])
    return "\n".join(b.text for b, label in zip(found, labels) if label == GOOD)


def main_text(pages: DataFrame, page: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """carry columns, text and n_chars for every row of pages."""
    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [extract(p) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    picked = pages.select(*[F.col(c) for c in carry], F.col(page).alias("_page"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}text string, n_chars bigint")
