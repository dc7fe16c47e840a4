"""Main text of web pages: site templates are found by counting, and deleted.

Each element of a page has a hash of its subtree (tag, attributes, text, children). Spark counts
for each host in how many pages a subtree occurs; subtrees that recur across many pages of a
host are its template and are deleted. What a page marks itself as something else than its main
text (menus, footers, forms, adverts, comments, ...) is deleted as well, and a page that marks
its main text gives only that.

Inside marked main text only containers, named blocks and lists of links may be template, never
plain paragraphs and other prose. They are counted apart, as articles may be copies of each
other: a recurring block is template only if the main texts around it differ. These are compared by
minima of hashed word triples (min-hashes), which near copies share.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.llm.common import keyed_join, membership_filter, mixed, passes, ship_package, staged

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?=>)")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog "
    "dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html iframe legend li link main menu meta nav noscript ol optgroup option p "
    "pre script section select style summary table tbody td template textarea tfoot th thead title "
    "tr ul video audio canvas object svg".split()
)
#: A start tag ends these open elements, up to the nearest of the second set.
_P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_P_STOPS = frozenset("div td th li article section main body".split())
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that never hold main text.
DROPPED_TAGS = frozenset(
    "head script style title noscript template iframe nav aside footer form button select textarea "
    "input dialog svg canvas object menu noembed noframes".split()
)
#: Words of class and id, and roles, that mark other things than main text.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr "
    "notice notices disclaimer popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments commentlist disqus replies respond related recommended "
    "recommendations toolbar pagination pager widget search complementary contentinfo dialog alert "
    "form".split()
)
#: Words that may stand beside those in one name of class or id (``site-footer``, ``ad-slot``);
#: a name with any other word (``with-sidebar``, ``no-comments``) marks nothing.
NEUTRAL_WORDS = frozenset(
    "site page main primary secondary top bottom left right upper lower global box boxes bar block "
    "blocks area areas wrap wrapper container holder section list lists item items inner outer unit "
    "units slot slots button buttons btn link links text title icon icons body row col column group "
    "panel sticky fixed desktop mobile small large first last post posts entry article articles story "
    "stories news blog social media module component google div js thread count author meta reply".split()
)
#: These mark the head of a page, but inside the main text the head of the article.
HEAD_WORDS = frozenset("header masthead banner topbar".split())
_KNOWN_WORDS = DROPPED_WORDS | NEUTRAL_WORDS | HEAD_WORDS


class Element:
    __slots__ = ("tag", "attrs", "children", "words", "hash")

    def __init__(self, tag: str, attrs: str) -> None:
        self.tag = tag
        self.attrs = attrs
        self.children: list[Element | str] = []
        self.words: frozenset[str] | None = None
        self.hash = 0


class _Open:
    """The open elements, with the places of those of each tag, so that no search walks them."""

    def __init__(self, root: Element) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.stack))
        self.stack.append(element)

    def cut(self, at: int) -> None:
        for element in self.stack[at:]:
            self.places[element.tag].pop()
        del self.stack[at:]

    def close(self, tag: str) -> None:
        """Close the innermost element of ``tag``, if there is one."""
        places = self.places.get(tag)
        if places:
            self.cut(places[-1])

    def end(self, ended: Iterable[str], stop: Iterable[str]) -> None:
        """Close the outermost element of ``ended`` above the innermost one of ``stop``."""
        least = max((self.places[t][-1] for t in stop if self.places.get(t)), default=0)
        outer = len(self.stack)
        for tag in ended:
            places = self.places.get(tag)
            if places and places[-1] > least:
                outer = min(outer, places[bisect_right(places, least)])
        self.cut(outer)


class _Tags:
    """Finds the ends of tags. A ``>`` within quotes does not end one, unless no other does.

    A search for an end that comes to the end of the page is made once: a later one that would
    run into it outside of its quotes has no end either.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.failed: list[list[int]] = []  # begins and ends of the quoted parts that a search saw

    def end(self, at: int) -> int:
        """The place of the ``>`` of the tag whose attributes begin at ``at``, -1 if none."""
        plain = self.text.find(">", at)
        if plain < 0 or self.text.find('"', at, plain) < 0 and self.text.find("'", at, plain) < 0:
            return plain
        if any(at >= seen[0] and bisect_right(seen, at) % 2 for seen in self.failed):
            return plain
        found = _ATTRS.match(self.text, at)
        if found:
            return found.end()
        self.failed.append([at, *(x for q in _QUOTED.finditer(self.text, at) for x in q.span())])
        return plain


def parse(text: str) -> Element:
    """The element tree as browsers read it, in the parts that matter for text; in linear time."""
    root = Element("#root", "")
    opened = _Open(root)
    tags = _Tags(text)
    sections = True  # whether another CDATA section may end
    at = begin = 0

    def flush(end: int) -> None:
        if end > begin:
            opened.stack[-1].children.append(entities.unescape(text[begin:end]))

    while True:
        start = text.find("<", at)
        if start < 0:
            flush(len(text))
            return root
        if text.startswith("<!--", start):
            flush(start)
            end = text.find("-->", start + 4)
            at = begin = len(text) if end < 0 else end + 3
            continue
        if sections and text.startswith("<![CDATA[", start):
            end = text.find("]]>", start)
            if end >= 0:
                flush(start)
                opened.stack[-1].children.append(text[start + 9 : end])
                at = begin = end + 3
                continue
            sections = False
        if text.startswith(("<!", "<?"), start):
            end = text.find(">", start)
            if end < 0:
                flush(len(text))
                return root
            flush(start)
            at = begin = end + 1
            continue
        name = _NAME.match(text, start)
        if not name:
            at = start + 1
            continue
        end = tags.end(name.end())
        if end < 0:  # no tag ends any more
            flush(len(text))
            return root
        flush(start)
        at = begin = end + 1
        tag = name[1].lower()
        if text[start + 1] == "/":
            opened.close(tag)
            continue
        if tag in _P_ENDS:
            opened.end(("p",), _P_STOPS)
        if tag in _IMPLIED:
            opened.end(*_IMPLIED[tag])
        element = Element(tag, text[name.end() : end])
        opened.stack[-1].children.append(element)
        if tag in _VOID:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(text, at)
            element.children.append(text[at : close.start() if close else len(text)])
            at = begin = close.end() if close else len(text)
            continue
        opened.push(element)


def words_of(element: Element) -> frozenset[str]:
    """Words of class, id and role names that consist of known words alone, and ``#hidden`` and
    ``#main`` where the page says so."""
    if element.words is None:
        short = len(element.attrs) <= 256  # what is kept stays small
        element.words = (_words_in if short else _words_in.__wrapped__)(element.attrs)
    return element.words


@lru_cache(maxsize=1 << 14)
def _words_in(attrs: str) -> frozenset[str]:
    words: set[str] = set()
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = {p for p in re.split(r"[^a-z0-9]+", token) if not p.isdigit()} - {""}
                if parts <= _KNOWN_WORDS:
                    words |= parts
        if name == "hidden":
            words.add("#hidden")
        if name == "role" and value.strip() == "main" or name == "itemprop" and value == "articlebody":
            words.add("#main")
    return frozenset(words)


def dropped(element: Element, inside: bool, spared: set[int] | frozenset[int] = frozenset()) -> bool:
    """Whether the page marks the element as something else than main text. Words do not count
    for the elements of ``spared``."""
    tag = element.tag
    if tag in ("html", "body", "main", "#root"):
        return False
    words = words_of(element)
    if tag in DROPPED_TAGS or "#hidden" in words:
        return True
    by_words = id(element) not in spared
    if by_words and words & DROPPED_WORDS:
        return True
    return not inside and (tag == "header" or by_words and bool(words & HEAD_WORDS))


def mains(root: Element, spared: set[int] | frozenset[int] = frozenset()) -> list[Element]:
    """Outermost articles, else what is marked as main, that no dropped element holds."""
    found: dict[str, list[Element]] = {"article": [], "main": []}
    stack: list[tuple[Element, bool, bool]] = [(root, False, False)]
    while stack:
        element, in_article, in_main = stack.pop()
        if dropped(element, in_article or in_main, spared):
            continue
        if element.tag == "article" and not in_article:
            found["article"].append(element)
            in_article = True
        elif not in_main and (element.tag == "main" or "#main" in words_of(element)):
            found["main"].append(element)
            in_main = True
        for child in reversed(element.children):
            if isinstance(child, Element):
                stack.append((child, in_article, in_main))
    return found["article"] or found["main"]


def spared_elements(root: Element) -> set[int]:
    """Elements whose words must not drop them, as they hold a main element or most of the text
    of the page."""
    order: list[Element] = []
    stack = [root]
    while stack:
        element = stack.pop()
        if element.tag not in DROPPED_TAGS and "#hidden" not in words_of(element):
            order.append(element)
            stack += [c for c in element.children if isinstance(c, Element)]
    sizes: dict[int, int] = {}
    holders: set[int] = set()
    for element in reversed(order):
        size = 0
        for child in element.children:
            if isinstance(child, str):
                size += len("".join(child.split()))
            elif id(child) in sizes:
                size += sizes[id(child)]
                main = child.tag in ("article", "main") or "#main" in words_of(child)
                if id(child) in holders or main and not words_of(child) & DROPPED_WORDS:
                    holders.add(id(element))
        sizes[id(element)] = size
    return holders | {k for k, size in sizes.items() if 2 * size > sizes[id(root)]}


def choose(root: Element) -> tuple[list[Element], set[int]]:
    """The main elements, and the elements that words do not drop: none where there is main
    text without them."""
    chosen = mains(root)
    stack: list[Element | str] = list(chosen)
    tops = {id(c) for c in chosen}
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if item and not item.isspace():
                return chosen, set()
        elif id(item) in tops or not dropped(item, True):
            stack += item.children
    spared = spared_elements(root)
    return mains(root, spared), spared


def hash_subtrees(root: Element, seed: int = 0) -> None:
    """Give each element the hash of its tag, attributes, text and children; the host is the
    ``seed``, so that hashes of different hosts are different."""
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        order.append(element)
        stack += [c for c in element.children if isinstance(c, Element)]
    for element in reversed(order):
        h = xxhash.xxh3_64(f"{element.tag}\0{element.attrs.strip()}\0".encode("utf-8", "replace"), seed)
        for child in element.children:
            if isinstance(child, Element):
                h.update(b"\1" + child.hash.to_bytes(8))
            else:
                h.update(b"\2" + " ".join(child.split()).encode("utf-8", "replace"))
        element.hash = h.intdigest()


def deletable(root: Element, chosen: list[Element], spared: set[int]) -> set[int]:
    """Hashes of the subtrees outside the main elements ``chosen``, without those that hold
    one and what is dropped anyway."""
    holders = {id(m) for m in chosen}
    order: list[Element] = []
    stack = [root]
    while stack:
        element = stack.pop()
        if id(element) not in holders and not dropped(element, False, spared):
            order.append(element)
            stack += [c for c in element.children if isinstance(c, Element)]
    held: set[int] = set()
    for element in reversed(order):
        if any(isinstance(c, Element) and id(c) in holders for c in element.children):
            holders.add(id(element))
        elif element.tag not in ("html", "body", "#root"):
            held.add(element.hash)
    return held


#: Blocks of prose. In main text they are part of it, however often they recur, ...
PROSE_TAGS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption caption td th tr tbody thead tfoot "
    "table ul ol dl address summary hgroup hr br".split()
)
#: ... unless they are named, or are a list of links.
_NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=", re.IGNORECASE)


def structural(element: Element) -> bool:
    """Whether a block of main text may be template: a container such as ``div``, a block with a
    class, id or role, or one all of whose text is in links."""
    if element.tag not in PROSE_TAGS or _NAMED.search(element.attrs):
        return True
    stack: list[Element | str] = list(element.children)
    linked = False
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if item.strip():
                return False
        elif item.tag == "a":
            linked = True
        else:
            stack += item.children
    return linked


#: Tells hashes of blocks inside marked main text from those of subtrees outside.
INSIDE = 0x9E3779B97F4A7C15
#: Min-hashes of the main text around a block.
RESTS = ["r0", "r1", "r2", "r3"]


def main_blocks(chosen: list[Element], spared: set[int]) -> dict[int, list[int]]:
    """The `structural` blocks with text inside the main elements ``chosen``, by hash, each with the
    min-hashes of the main text around it; those with none around them are not given."""
    tops = {id(c) for c in chosen}
    pieces: list[list[bytes]] = []
    spans: list[tuple[int, int, int]] = []
    text: list[str] = []

    def flush() -> None:
        words = "".join(text).encode("utf-8", "replace").split()
        text.clear()
        if words:
            pieces.append(words)

    stack: list[Element | str | tuple[int | None, int]] = list(reversed(chosen))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            text.append(item)
        elif isinstance(item, tuple):
            flush()
            if item[0] is not None and len(pieces) > item[1]:
                spans.append((*item, len(pieces)))
        elif id(item) in tops:
            flush()
            stack += reversed(item.children)
        elif dropped(item, True, spared):
            text.append(" ")
        else:
            if item.tag in _BLOCK:
                flush()
                # A block of prose bounds the pieces, but is no candidate itself.
                stack.append((item.hash ^ INSIDE if structural(item) else None, len(pieces)))
            stack += reversed(item.children)
    flush()
    if len(pieces) < 2:
        return {}

    starts = np.cumsum([0, *(len(p) + 2 for p in pieces)])
    words = np.zeros(starts[-1] + 2, dtype=np.uint64)
    for at, piece in zip(starts, pieces):
        words[at : at + len(piece)] = [xxhash.xxh3_64_intdigest(w) for w in piece]
    triples = mixed(words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7))
    again = mixed(triples ^ np.uint64(0xD6E8FEB86659FD93))
    values = np.stack([triples, ~triples, again, ~again])
    for gap in (1, 2):  # between pieces
        values[:, starts[1:] - gap] = np.iinfo(np.uint64).max
    least = np.minimum.reduceat(values, starts[:-1], axis=1)
    before = np.minimum.accumulate(least, axis=1)
    after = np.minimum.accumulate(least[:, ::-1], axis=1)[:, ::-1]
    out = {}
    for key, first, end in spans:
        if first and end < len(pieces):
            rest = np.minimum(before[:, first - 1], after[:, end])
        elif first or end < len(pieces):
            rest = before[:, first - 1] if first else after[:, end]
        else:
            continue
        out[key] = rest.view(np.int64).tolist()
    return out


def main_text(root: Element, template: set[int]) -> str:
    """The text of the main elements, or of the page, without what is dropped or template.

    Where there is a template, the subtrees have been hashed by ``hash_subtrees``. Main text
    that would be template as a whole stays.
    """
    chosen, spared = choose(root)
    text = _text(root, chosen, spared, template)
    return text if text or not chosen or not template else _text(root, chosen, spared, set())


def _text(root: Element, chosen: list[Element], spared: set[int], template: set[int]) -> str:
    out: list[str] = []
    stack: list[Element | str] = list(reversed(chosen or [root]))
    inside = bool(chosen)
    tops = {id(c) for c in chosen}
    kind = INSIDE if inside else 0
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if id(item) not in tops and (
            dropped(item, inside, spared)
            or template
            and item.hash ^ kind in template
            and (not inside or item.tag in _BLOCK and structural(item))
        ):
            out.append(" ")
            continue
        if item.tag in _BLOCK:
            out.append(" ")
            stack.append(" ")
        stack += reversed(item.children)
    return " ".join("".join(out).split())


def host_of(url: Column) -> Column:
    """Lower-cased host of an absolute URL, empty if there is none."""
    return F.coalesce(
        F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")
    )


def _seed(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host.encode("utf-8", "replace"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_COLUMNS = ["page", "subtree", "body", *RESTS]
_SUBTREES = ", ".join(f"{c} long" for c in _COLUMNS)


def subtrees(rows: DataFrame) -> DataFrame:
    """The ``subtree`` hashes of each row of ``rows`` (host, page, html) that may be template.

    ``body`` is the hash of the page's element tree, for blocks of main text that of the main
    elements. Those have the min-hashes of ``main_blocks``, the others none.
    """

    def run(batches):
        for batch in batches:
            out = []
            hosts, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for host, page, html in zip(hosts, pages, batch.column(2)):
                root = parse(html.as_py())
                hash_subtrees(root, _seed(host))
                chosen, spared = choose(root)
                body = _signed(root.hash)
                out += [(page, _signed(h), body, *none) for h in deletable(root, chosen, spared)]
                body = hash(tuple(m.hash for m in chosen))
                out += [(page, _signed(h), body, *rest) for h, rest in main_blocks(chosen, spared).items()]
            columns = list(zip(*out)) if out else [()] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _COLUMNS)

    none = [None] * len(RESTS)

    return rows.select("host", "page", "html").mapInArrow(run, _SUBTREES)


def template_subtrees(found: DataFrame, min_pages: int) -> DataFrame:
    """``subtree`` hashes that recur on at least ``min_pages`` different pages of their host;
    blocks of main text, if for one of the min-hashes the main texts around them have as many
    values, and at least half as many as there are main texts."""
    each = found.select("subtree", "body").distinct()
    counted = staged(
        each.groupBy("subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages), "html-counted"
    )
    likely = _in_filter(found, membership_filter(counted, "subtree"), "subtree")
    around = likely.groupBy("subtree").agg(*[F.count_distinct(r).alias(r) for r in RESTS])
    most = F.greatest(*RESTS)
    return (
        counted.join(around, "subtree")
        .where((most == 0) | (most >= min_pages) & (2 * most >= F.col("n")))  # none outside main text
        .select("subtree")
    )


def _in_filter(df: DataFrame, only: np.ndarray, column: str) -> DataFrame:
    """The rows that the membership filter lets pass by ``column``."""
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(only, batch.column(at).to_numpy())))

    return df.mapInArrow(run, df.schema)


def extract(
    pages: DataFrame,
    min_pages: int = 5,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``page_id``, ``url`` and main ``text`` of every row of ``pages``.

    A subtree is template if at least ``min_pages`` different pages of the host hold it, however
    many pages the host has; inside marked main text only if the main texts around it differ
    (see ``template_subtrees``). Character references are decoded, runs of white space
    become one space, blocks are joined by one space in page order. Null html is empty and
    gives the empty text; a null or relative url belongs to the host "". Copies of a page count
    once and give equal texts; other columns are not read; an empty table gives no rows.

    One pass hashes the subtrees, a second one reads the text. Pages that hold no template are
    finished there; the others meet the template subtrees that they hold by a join first.
    """
    ship_package(pages.sparkSession)
    host, html = host_of(F.col(url_col)), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        host.alias("host"),
        F.xxhash64(host, html).alias("page"),
        html.alias("html"),
    )
    found = staged(subtrees(rows), "html-subtrees")
    template = staged(template_subtrees(found, min_pages), "html-template")
    may = _in_filter(found.select("page", "subtree"), membership_filter(template, "subtree"), "subtree")
    hits = keyed_join(may, template, ["subtree"], "page")
    gone = staged(hits.groupBy("page").agg(F.collect_set("subtree").alias("gone")), "html-gone")
    only = membership_filter(gone, "page")

    def texts(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            if "gone" not in at:
                batch = batch.filter(pa.array(~passes(only, batch.column(at["page"]).to_numpy())))
            lists = batch.column(at["gone"]).to_pylist() if "gone" in at else [None] * len(batch)
            out = []
            for host, html, hashes in zip(batch.column(at["host"]), batch.column(at["html"]), lists):
                root = parse(html.as_py())
                if hashes:
                    hash_subtrees(root, _seed(host.as_py()))
                out.append(main_text(root, {g & (1 << 64) - 1 for g in hashes or []}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(at["page_id"]), batch.column(at["url"]), pa.array(out, pa.string())],
                ["page_id", "url", "text"],
            )

    out = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    schema = f"{out}, text string"
    held = keyed_join(_in_filter(rows, only, "page"), gone, ["page"], "page_id", "left")
    return rows.mapInArrow(texts, schema).union(held.mapInArrow(texts, schema))


def extract_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
