"""Main text of web pages through wrappers inferred for each host.

A wrapper is a union-free regular expression over a host's pages: nested elements of which each may be optional
(``?``) or repeated (``+``), with texts that are either the same on all pages or slots. Pages are parsed into trees of
block elements, runs of equal siblings are folded into repeated groups, and a host's trees are aligned one after the
other: elements that only one side has become optional, texts that differ become slots.

For a host of any size, pages of one shape are merged where they are read, then the shapes of a host in an order fixed by
their digests, some at a time and in rounds, so no host is gathered; what few pages have is left out on the way. A page
is then fitted to its host's wrapper, which gives each of its texts the wrapper's place for it, and what the wrapper says
of texts is counted: on how many of the host's pages a place occurs, and on how many a text at that place. A place on
all pages is required, on fewer optional; a text on as good as all pages that have its place is fixed, else it is a
slot's. Outside article elements a fixed text goes even if its place has a slot as well, as one paragraph of many;
inside, only where the place has no slot. The counts are exact sums over pages. Texts are counted by the signatures from
the root down as well, which is the place of what the wrapper leaves out and tells no equal siblings apart.

The wrapper then says what of a page is the article: its article or main element where it has one, else all of the
body; without the parts that are named as menus, headers, footers, sidebars, notices, adverts, forms or comments; and
without the texts that the host's pages repeat, inside an article element too, unless nothing of the article would be left.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, sliced, stored
from .urls import host_and_path

#: Pages that must repeat a text before it counts as the host's: if their headings differ, and if not (they may be
#: copies of one article).
TEMPLATE_PAGES = 2
LIKE_PAGES = 5
#: Share of the pages with a place on which a fixed text is, in percent, so that odd pages of a host change nothing.
FIXED_PERCENT = 90

# Names of the HTML standard and common words in class and id attributes.
BLOCKS = frozenset(
    "html body main article section nav header footer aside div form fieldset p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd menu table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address details summary dialog center hr head title noscript".split()
)
RAW = "script|style|textarea|title|iframe|noframes|noembed|xmp|svg|math|template|noscript|object|audio|video|canvas|select|button"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("head title nav footer aside form fieldset dialog menu noscript".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert menu menus nav navbar navigation "
    "sidebar aside footer masthead breadcrumb breadcrumbs comment comments disqus reply replies respond responses discussion share sharing social related recommended newsletter subscribe "
    "subscription popup modal overlay login signup search pagination pager toolbar widget".split()
)
ARTICLE_WORDS = frozenset("article post entry story content".split())
#: Words that go with those in the name of a container.
CONTAINER_WORDS = ARTICLE_WORDS | frozenset("main body text page".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": frozenset()}
#: An open paragraph ends where one of these begins.
ENDS_P = BLOCKS - {"html", "body", "head", "title", "noscript"}

#: Attributes up to the ``>`` outside quoted values, which stand after ``=``; a quote that never ends is part of a bare value.
QUOTED = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+"
TOKEN = re.compile(rf"<!--(?:.*?-->|.*)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-z][a-z0-9:-]*)({QUOTED}>)", re.S | re.I)
CUT_OFF = re.compile(r"<[a-z/!?]", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
READ = frozenset("class id role hidden aria-hidden style itemprop".split())
#: Attributes of more characters and sequences of more signatures are read anew each time, so that the caches stay small.
CACHED_CHARS, CACHED_SIGNS = 1000, 1000
#: Elements below this depth are not part of a wrapper; pages are read to any depth, and their signatures are the places there.
WRAPPER_DEPTH = 100
#: Where two child sequences would need a larger table than this, what is between their equal ends is not part of the
#: wrapper either.
ALIGNED_CELLS = 1 << 16
#: Shapes aligned in one group, the parts that rows of one shape are dealt to before, characters of pages whose shapes a
#: task holds, and the share of a group's pages (one in so many) up to which an element is left out. A text must be on
#: more than half of the pages, so what is left out in some rounds cannot be such a text's.
GROUP, SPREAD, HELD_CHARS, RARE = 64, 64, 16 << 20, 16
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """A block element of a page: tag, what its attributes say, and children, which are elements or texts.

    ``dropped`` holds for what tag, role or style rule out; ``named`` for what only a word of class or id speaks against.
    """

    __slots__ = ("tag", "sign", "dropped", "named", "article", "container", "children")

    def __init__(self, tag: str, sign: str, dropped: bool, named: bool, article: bool, container: bool):
        self.tag, self.sign, self.dropped, self.named, self.article, self.container = tag, sign, dropped, named, article, container
        self.children: list[Element | str] = []


@lru_cache(maxsize=20_000)
def described(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Signature, whether the element is not part of an article, whether only its names say so, whether it is one, whether a name is a container's."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in READ:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = " ".join(found.get(k, "") for k in ("class", "id"))
    words = {w for w in re.split(r"[^a-z0-9]+", CAMEL.sub(" ", names).lower()) if w}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I) is not None
    dropped = tag in DROPPED_TAGS or role in DROPPED_ROLES or hidden
    banner = tag == "header" or tag not in ("html", "body", "main", "article") and ("header" in words or "banner" in words) and not words & ARTICLE_WORDS
    container = any(parts & ARTICLE_WORDS and parts <= CONTAINER_WORDS for parts in ({w for w in re.split(r"[^a-z0-9]+", CAMEL.sub(" ", n).lower()) if w} for n in names.split()))
    article = not dropped and (tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody")
    sign = ".".join([tag, *sorted(re.sub(r"\d+", "0", w) for w in words)])
    return sign + ("^" if banner else ""), dropped, bool(words & DROPPED_WORDS) and tag not in ("html", "body"), article, container


def parse(text: str) -> Element:
    """The tree of block elements of a page; inline tags vanish, scripts, styles and comments too."""
    root = Element("#page", "#page", False, False, False, False)
    stack, at, run = [root], 0, []
    places: dict[str, list[int]] = {}  # of each tag, where it is open in the stack

    def close_text() -> None:
        if run:
            words = html.unescape("".join(run)).split()
            run.clear()
            if words:
                stack[-1].children.append(" ".join(words))

    def pop_to(tag: str, barrier: frozenset | set) -> None:
        i = places[tag][-1] if places.get(tag) else 0
        if i and not any(places[b][-1] > i for b in barrier if places.get(b)):
            while len(stack) > i:
                places[stack.pop().tag].pop()

    end = text.rfind(">") + 1  # no tag ends beyond
    m = None
    for m in TOKEN.finditer(text, 0, end):
        if m.start() > at:
            run.append(text[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if m[1]:
            if m[1].lower() in BLOCKS:
                close_text()
            continue
        if not tag:
            continue
        if tag == "br":
            run.append(" ")
        if tag not in BLOCKS:
            continue
        close_text()
        if m[2]:
            pop_to(tag, {"article", "main", "body"} - {tag})
            continue
        if tag in ENDS_P and stack[-1].tag == "p":
            pop_to("p", frozenset())
        for other in CLOSES.get(tag, ()):
            pop_to(other, HOLDS[other])
        if tag == "body":
            pop_to("head", frozenset())
        element = Element(tag, *(described if len(m[4]) <= CACHED_CHARS else described.__wrapped__)(tag, m[4]))
        stack[-1].children.append(element)
        if tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(element)
    # What begins beyond the last end of a tag is cut off: an open comment, script or tag.
    if m is not None and at == end and open_ended(m):
        at = len(text)
    run.append(CUT_OFF.split(text[at:], maxsplit=1)[0])
    close_text()
    return root


def open_ended(m: re.Match) -> bool:
    """Whether a match is a comment or raw text that nothing closes."""
    if m[1]:
        return re.search(rf"</{m[1]}\s*>$", m[0], re.I) is None
    return m[0].startswith("<!--") and not m[0].endswith("-->")


# A wrapper node is [sign, pages, optional, repeated, children]; a text is ["#", pages, optional, repeated, digest],
# where an empty digest is a slot.


def digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def fold(nodes: list[list]) -> list[list]:
    """Fold runs of equal siblings into repeated groups."""
    out: list[list] = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1] = merged(out[-1], node, out[-1][1])
            out[-1][3] = True
        else:
            out.append(node)
    return out


def wrapper_of(element: Element, depth: int = 0) -> list:
    inner = element.children if depth < WRAPPER_DEPTH and not element.dropped else []
    return [element.sign, 1, False, False, fold([["#", 1, False, False, digest(c)] if isinstance(c, str) else wrapper_of(c, depth + 1) for c in inner])]


def merged(a: list, b: list, pages: int) -> list:
    """The least wrapper that covers two nodes of one signature."""
    rest = (a[4] if a[4] == b[4] else "") if a[0] == "#" else aligned(a[4], b[4])
    return [a[0], pages, a[2] or b[2], a[3] or b[3], rest]


def matched(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[list[tuple[int, int]], bool]:
    """Places of a longest common subsequence, and whether it is one: of too long sequences it is their equal ends alone."""
    return (common if len(a) + len(b) <= CACHED_SIGNS else common.__wrapped__)(a, b)


@lru_cache(maxsize=2000)
def common(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[list[tuple[int, int]], bool]:
    n, m, head, tail = len(a), len(b), 0, 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    x, y = a[head : n - tail], b[head : m - tail]
    whole = len(x) * len(y) <= ALIGNED_CELLS
    if whole and x and y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = 1 + best[i + 1][j + 1] if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i, j = 0, 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(n - k, m - k) for k in range(tail, 0, -1)], whole


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Align two child sequences; what only one side has becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merged(x, y, x[1] + y[1]) for x, y in zip(a, b, strict=True)]
    pairs, whole = matched(tuple(x[0] for x in a), tuple(x[0] for x in b))
    out, i, j = [], 0, 0
    for at, to in [*pairs, (len(a), len(b))]:
        if whole:
            out += [[x[0], x[1], True, *x[3:]] for x in (*a[i:at], *b[j:to])]
        if at < len(a):
            out.append(merged(a[at], b[to], a[at][1] + b[to][1]))
        i, j = at + 1, to + 1
    return fold(out)


def expression(node: list) -> str:
    """The wrapper as a regular expression to read: tags, ``=`` for a fixed text and ``*`` for a slot."""
    own = ("=" if node[4] else "*") if node[0] == "#" else f"<{node[0]}>{''.join(map(expression, node[4]))}</>"
    return f"({own}){'+' * node[3]}{'?' * node[2]}" if node[2] or node[3] else own


@lru_cache(maxsize=50_000)
def place_of(parent: int, sign: str) -> int:
    """The place of what has a signature (or, after ``=``, the digest of a text) at a place; the page's is 0."""
    return int.from_bytes(blake2b(f"{parent} {sign}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def text_key(place: int, text: str) -> int:
    return text_key_of(place, digest(text))


def text_key_of(place: int, digest: str) -> int:
    return place_of.__wrapped__(place, "=" + digest)


def shape(node: list) -> str:
    """What alike pages have in common: signatures and repeats, whatever the texts."""
    return f"{node[0]}{'+' * node[3]}{'?' * node[2]}({'' if node[0] == '#' else ''.join(map(shape, node[4]))})"


def trimmed(node: list, pages: int) -> list:
    """Without what one in RARE of the pages has at most."""
    if node[0] == "#":
        return node
    return [*node[:4], fold([trimmed(c, pages) for c in node[4] if c[1] * RARE > pages])]


def outlined(node: list) -> list | None:
    """A wrapper as the signatures of children with their outlines; None where none at all has an equal sibling."""
    inner = [None if c[0] == "#" else outlined(c) for c in node[4]]
    signs = [c[0] for c in node[4]]
    return [list(x) for x in zip(signs, inner, strict=True)] if any(inner) or len(set(signs)) < len(signs) else None


class Outline:
    """An outline to fit pages to: of its children signatures, the names of their places among siblings, and outlines."""

    __slots__ = ("signs", "names", "inner")

    def __init__(self, outline: list):
        self.signs = tuple(s for s, _ in outline)
        n = Counter(self.signs)
        self.names = [s if n[s] == 1 else f"{s}@{k}" for k, s in enumerate(self.signs)]
        self.inner = [Outline(x) if x else None for _, x in outline]


def fitted(element: Element, outline: Outline | None) -> Iterator[tuple[Element | str, str, Outline | None]]:
    """Each child with the name of its place, which is its signature where the wrapper says no more, and its outline."""
    signs = ["#" if isinstance(c, str) else c.sign for c in element.children]
    if outline is None:
        yield from zip(element.children, signs, [None] * len(signs), strict=True)
        return
    runs = tuple(s for k, s in enumerate(signs) if not k or s != signs[k - 1])
    found = dict(matched(runs, outline.signs)[0])
    run = -1
    for k, (child, sign) in enumerate(zip(element.children, signs, strict=True)):
        run += not k or sign != signs[k - 1]
        at = found.get(run)
        yield (child, sign, None) if at is None else (child, outline.names[at], outline.inner[at])


def places(page: Element, outline: Outline | None = None) -> Iterator[tuple[int, int, Element, str]]:
    """Place by signatures, place in the wrapper, element and text of each text that no tag, role or style rules out."""
    todo = [(page, 0, 0, outline)]
    while todo:
        element, place, fit, own = todo.pop()
        for child, name, inner in fitted(element, own):
            if isinstance(child, str):
                yield place, fit if name == "#" else place_of(fit, name), element, child
            elif not child.dropped:
                below_it = place_of(place, child.sign)
                todo.append((child, below_it, below_it if fit == place and name == child.sign else place_of(fit, name), inner))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``host, outline`` of rows of ``host, html``: the wrapper of all pages of each host that says more than signatures do.

    Pages without a text count for nothing.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        size = 0
        for batch in sliced(batches):
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                page = parse(text)
                if next(places(page), None):
                    tree = wrapper_of(page)
                    key = host, place_of.__wrapped__(2, shape(tree))
                    size += len(text) * (key not in held)
                    held[key] = merged(held[key], tree, held[key][1] + 1) if key in held else tree
                if size > HELD_CHARS:
                    yield rows([(*k, k[1], v) for k, v in held.items()])
                    held, size = {}, 0
        yield rows([(*k, k[1], v) for k, v in held.items()])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"host": h, "grp": g, "kind": k, "wrapper": json.dumps(w)} for h, g, k, w in found], schema=arrow)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kind, same, whole = None, None, None, None
        for batch in sliced(batches, 100):
            done = []
            for host, grp, k, wrapper in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                tree = json.loads(wrapper.as_py())
                if (host, grp, k) == (*(at or (None, None)), kind):
                    same = merged(same, tree, same[1] + tree[1])
                    continue
                if at is not None:
                    whole = same if whole is None else merged(whole, same, whole[1] + same[1])
                if at is not None and at != (host, grp):
                    done.append((*at, kind, trimmed(whole, whole[1])))
                    whole = None
                at, kind, same = (host, grp), k, tree
            yield rows(done)
        if at is not None:
            whole = same if whole is None else merged(whole, same, whole[1] + same[1])
            yield rows([(*at, kind, trimmed(whole, whole[1]))])

    def joined(trees: DataFrame) -> DataFrame:
        columns = ("host", "grp", "kind", "wrapper")
        return trees.select(*columns).repartition("host", "grp").sortWithinPartitions("host", "grp", "kind").mapInArrow(align, schema)

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            own = [outlined(json.loads(w)) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(x) if x else None for x in own], pa.string())], names=["host", "outline"])

    arrow = pa.schema({"host": pa.string(), "grp": pa.int64(), "kind": pa.int64(), "wrapper": pa.string()})
    schema = "host string, grp long, kind long, wrapper string"
    trees = pages.select("host", "html").mapInArrow(read, schema)
    # Rows of one shape are merged first, in parts; a merge of one shape is the same in any order.
    trees = stored(joined(trees.withColumn("grp", F.xxhash64("kind", F.spark_partition_id() % SPREAD))), "trees")
    while True:
        kinds = trees.groupBy("host").agg(F.count_distinct("kind").alias("kinds"))
        most = kinds.agg(F.max("kinds")).first()[0] or 0
        dealt = trees.join(kinds, "host").withColumn("grp", F.pmod(F.xxhash64("kind"), F.ceil(F.col("kinds") / GROUP)))
        # The next round's shapes are this one's groups.
        done = stored(joined(dealt).select("host", "grp", F.col("grp").alias("kind"), "wrapper"), "trees")
        release(trees)
        trees = done
        if most <= GROUP:
            return trees.select("host", "wrapper").mapInArrow(outline, "host string, outline string").where("outline is not null")


def fixed_texts(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` of rows of ``host, html, __outline``: the keys of the texts that the host's wrapper holds fixed,
    each with 1 if its place has no slot and else 0.

    Pages without a text count for nothing and equal pages once. A text is fixed if it is on FIXED_PERCENT of the pages
    that have its place, and on more than half of the host's pages, which bounds what is kept of a host by its pages' size.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for host, text, outline in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                found = list(places(parse(text.as_py() or ""), loaded(outline.as_py())))
                if found:
                    page = place_of.__wrapped__(0, " ".join(str(text_key(place, t)) for place, _, _, t in found))
                    heading = " ".join(t for _, _, e, t in found if e.tag in ("h1", "h2"))
                    texts = sorted({(at, text_key(at, t)) for place, fit, _, t in found for at in (place, fit)})
                    keys = [(*t, 1) for t in texts] + [(place, None, n) for place, n in Counter(place for place, _ in texts).items()]
                    rows.append({"host": host, "page": page, "heading": place_of.__wrapped__(1, heading) if heading else page, "keys": [{"place": a, "text": b, "texts": n} for a, b, n in keys]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema({"host": pa.string(), "page": pa.int64(), "heading": pa.int64(), "keys": pa.list_(pa.struct({"place": pa.int64(), "text": pa.int64(), "texts": pa.int64()}))})
    seen = pages.select("host", "html", "__outline").mapInArrow(read, "host string, page long, heading long, keys array<struct<place: long, text: long, texts: long>>")
    seen = stored(seen.groupBy("host", "page").agg(F.first("heading").alias("heading"), F.first("keys").alias("keys")), "places")
    heads = seen.groupBy("host", "heading").agg(F.count("*").alias("n"))
    hosts = heads.groupBy("host").agg(F.sum("n").alias("pages"), F.count("*").alias("headings"))
    hosts = hosts.where((F.col("headings") >= TEMPLATE_PAGES) | (F.col("pages") >= LIKE_PAGES)).select("host", "pages")
    counts = seen.select("host", F.explode("keys").alias("k")).groupBy("host", "k.place", "k.text").agg(F.count("*").alias("n"), F.sum("k.texts").alias("texts"))
    often = stored(counts.join(hosts, "host").where("2 * n > pages").select("host", "place", "text", "n", "texts"), "often")
    of_place = often.where("text is null").select("host", "place", F.col("n").alias("of_place"), F.col("texts").alias("all_texts"))
    fixed = often.where("text is not null").join(of_place, ["host", "place"]).where(F.col("n") * 100 >= F.col("of_place") * FIXED_PERCENT)
    other = F.first("all_texts") - F.sum("n")
    fixed = fixed.groupBy("host", "place").agg((other * 100 <= F.first("of_place") * (100 - FIXED_PERCENT)).cast("int").alias("no_slot"), F.collect_list("text").alias("texts"))
    fixed = fixed.select("host", "no_slot", F.explode("texts").alias("text"))
    return fixed.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "text", "no_slot"))), ",").alias("wrapper"))


@lru_cache(maxsize=256)
def loaded(outline: str | None) -> Outline | None:
    return Outline(json.loads(outline)) if outline else None


def fixed_keys(wrapper: list) -> dict[int, bool]:
    """The keys of the texts that a wrapper holds fixed on all of its pages, all in places of their own."""
    out: dict[int, bool] = {}

    def walk(node: list, place: int, outline: Outline | None) -> None:
        names = outline.names if outline else [c[0] for c in node[4]]
        for child, name, inner in zip(node[4], names, outline.inner if outline else [None] * len(names), strict=True):
            if child[0] != "#":
                walk(child, place_of(place, name), inner)
            elif child[4] and not child[2] and child[1] >= wrapper[1]:
                out[text_key_of(place if name == "#" else place_of(place, name), child[4])] = True

    if wrapper[1] >= TEMPLATE_PAGES and has_slot(wrapper):
        walk(wrapper, 0, outline_of(wrapper))
    return out


def outline_of(wrapper: list) -> Outline | None:
    own = outlined(wrapper)
    return Outline(own) if own else None


def has_slot(node: list) -> bool:
    return not node[4] if node[0] == "#" else any(map(has_slot, node[4]))


def below(element: Element) -> Iterator[tuple[Element, bool]]:
    """The element and the elements below it that nothing but a name can drop, each with whether it is within an article element."""
    todo = [(element, False)]
    while todo:
        e, within = todo.pop()
        if not e.dropped:
            yield e, within
            todo.extend((c, within or e.tag == "article") for c in e.children if isinstance(c, Element))


def left_out(page: Element) -> tuple[set[int], bool]:
    """The ids of the elements that are left out of the page on their names, and whether an article element is left.

    A name leaves out neither html, body, main and article elements (but parts of another article, as comments are) nor
    what holds the article. Where all article elements are in named elements, that is those that are not named
    themselves, if they have a first heading or at least as much text as what no name leaves out. Where there is none,
    it is a container by name or a first heading with paragraphs.
    """
    order = list(below(page))
    named = {id(e) for e, within in order if (e.named or e.sign.endswith("^") and not within) and (not e.article or e.tag == "article" and within)}
    articles = {id(e) for e, within in order if e.article and not within and (not e.named or e.container or e.tag == "main")}
    seen, todo, outside = False, [page], 0
    while todo:
        e = todo.pop()
        if not e.dropped and id(e) not in named:
            seen = seen or e.article
            outside += sum(len(c) for c in e.children if isinstance(c, str))
            todo.extend(c for c in e.children if isinstance(c, Element))
    if seen or not named:
        return named, seen
    holds: dict[int, tuple[set[str], int]] = {}
    inside = 0
    for e, _ in reversed(order):  # children come after their parents
        below_it = [holds[id(c)] for c in e.children if isinstance(c, Element) and id(c) in holds]
        found = ({e.tag} & {"h1", "p"}).union(*(x[0] for x in below_it))
        size = sum(len(c) for c in e.children if isinstance(c, str)) + sum(x[1] for x in below_it)
        if id(e) in articles:
            inside += size
            found.add("article")
        elif not articles and (e.container or {"h1", "p"} <= found) and e.tag != "header":
            found.add("article")
        holds[id(e)] = found, size if id(e) not in named else 0
    if articles and not (inside >= outside or any("h1" in holds[i][0] for i in articles)):
        return named, False
    return {i for i in named if "article" not in holds[i][0]}, bool(articles)


def main_blocks(page: Element, wrapper: list | tuple[Outline | None, dict[int, bool]] | None) -> list[str]:
    """The article's texts in page order, with the evidence of the host's wrapper, or of its outline and the keys of its fixed texts.

    Of the latter, those with False hold outside article elements alone.
    """
    outline, fixed = (outline_of(wrapper), fixed_keys(wrapper)) if isinstance(wrapper, list) else wrapper or (None, {})
    out: list[str] = []
    whole: list[str] = []
    out_by_name, only_article = left_out(page)
    todo: list[tuple] = [(page, 0, 0, outline, not only_article)]
    while todo:
        element, place, fit, own, inside = todo.pop()
        if isinstance(element, str):
            whole.append(element)
            slotless = [fixed[k] for k in (text_key(at, element) for at in {place, fit}) if k in fixed] if fixed else []
            if not slotless or only_article and not any(slotless):
                out.append(element)
        elif not element.dropped and id(element) not in out_by_name:
            inside = inside or element.article
            below_it = [(c, place, fit, None, inside) for c in element.children] if not fixed else [
                (c, place, fit if name == "#" else place_of(fit, name), None, inside) if isinstance(c, str) else (c, place_of(place, c.sign), place_of(fit, name), inner, inside)
                for c, name, inner in fitted(element, own)
            ]
            todo.extend(x for x in reversed(below_it) if inside or not isinstance(x[0], str))
    return out or (whole if only_article else [])


def extract(pages: DataFrame, *, url: str = "url", text: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text and its length in code points, ``n_chars``.

    Blocks are texts between block elements, white space as single spaces, joined by an empty line; a line break
    element is white space. Null or empty html gives an empty text; pages without a host share one wrapper, and a host
    of one page has none. Repeated rows get equal texts; an empty table stays empty. Columns of the new names are
    replaced.
    """
    kept = [c for c in pages.columns if c not in (text, out, "n_chars", "host", "wrapper")]
    hosted = pages.select(*kept, F.col(text).alias("html"), F.coalesce(host_and_path(F.col(url))[0], F.lit("")).alias("host"))
    outlines = stored(host_wrappers(hosted).withColumnRenamed("outline", "__outline"), "outlines")
    wrappers = stored(fixed_texts(hosted.select("host", "html").join(outlines, "host", "left")).join(outlines, "host", "left"), "wrappers")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lru_cache(maxsize=256)(lambda keys: {int(k[:-2]): k[-1] == "1" for k in keys.split(",")})
        for batch in batches:
            htmls, rules, outline = (batch.column(batch.schema.get_field_index(c)) for c in ("html", "wrapper", "__outline"))
            texts = ["\n\n".join(main_blocks(parse(h.as_py() or ""), (loaded(o.as_py()), load(w.as_py())) if w.is_valid else None)) for h, w, o in zip(htmls, rules, outline, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, out, "n_chars"])

    schema = T.StructType([*(f for f in pages.schema.fields if f.name in kept), T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])
    return hosted.join(wrappers, "host", "left").select(*kept, "html", "wrapper", "__outline").mapInArrow(scan, schema)
