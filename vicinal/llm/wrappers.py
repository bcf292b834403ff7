"""Main text of web pages by wrappers that are inferred per host.

A wrapper is a union-free regular expression over tags and texts, kept as a tree: every element has its symbol, whether it may
be missing, whether it may repeat, and for texts whether it is the same on every page or a slot. It starts as the token
stream of one page; every other page of the host is aligned with it, and a mismatch makes an element optional, a run of
equal elements a repeated group, and different strings a text slot. Every element knows on how many pages it stands, and every
slot which strings stand in it on all of them.

The wrapper locates the article and takes nothing out of it. Where pages have ``main`` or ``article`` elements, repeated groups of
articles beside or inside a single one are its comments or teasers. Where they have none, the article is the element around
all text that differs from page to page, and what is the same on all pages around that is the frame of the host.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.rows import slices, text_of
from vicinal.llm.urlfilter import address
from vicinal.session import stored

#: Wrappers (bytes of all hosts) below which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Groups that the wrappers of one host are merged in before they meet.
SALTS = 64
#: Hosts whose wrappers a task holds before it sends them on.
HOSTS_HELD = 1000
#: Wrappers are merged by functions that call themselves once per level of nesting; such calls take memory, not stack.
LEVELS = 10_000_000

RAW = "script|style|noscript|template|iframe|textarea|svg|title"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# HTML's void elements, elements shown as blocks, and which open element a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
# Elements and names in class, id and role that mark what does not belong to an article. A name of several words counts if all
# of them do, but for PLAIN ones: "cookie-notice" and "site-footer", not "has-sidebar" or "category-social".
OUTSIDE = frozenset("nav footer aside form head button select dialog menu object".split())
WORDS = frozenset(
    "ad ads advert advertisement adverts adsense banner sponsor sponsored promo promotion nav navbar navigation menu sidebar footer header masthead"
    " breadcrumb breadcrumbs cookie cookies consent notice notices gdpr comment comments disqus respond share sharing social related recommended"
    " newsletter subscribe popup modal complementary contentinfo search login pagination pager widget toolbar".split()
)
PLAIN = frozenset(
    "site page main global top bottom left right primary secondary box bar block list area container wrapper section inner outer post posts article"
    " articles story stories user users reader readers visitor slot unit space google content entry item items link links wp".split()
)
# Elements that hold blocks rather than being one.
HOLDERS = frozenset(" html body div section center td th article main".split(" "))
HEADERS = frozenset("header masthead banner".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """``outside`` by its tag, ``named`` so by class, id or role; ``header``: all such names are those of headers.

    An article or main element is ``called`` so instead, which counts if there is anything else. ``place`` is its element of the
    wrapper and ``places`` are those of its children.
    """

    __slots__ = ("tag", "symbol", "outside", "named", "called", "header", "children", "place", "places")

    def __init__(self, tag: str, symbol: str, names: list[set[str]]):
        self.tag, self.symbol, self.children, self.place, self.places = tag, symbol, [], None, []
        self.outside, self.called = tag in OUTSIDE, bool(names) and tag in ("article", "main")
        self.named = bool(names) and tag not in ("html", "body", "article", "main")
        self.header = self.named and all(n <= HEADERS | PLAIN for n in names)


def _outside_names(values: list[str]) -> list[set[str]]:
    """Words of each whole name that marks what is outside. Sizes such as 300x250 are no words."""
    parts = (re.sub(r"\d+x\d+", "", name) for value in values for name in value.split())
    names = [set(re.split(r"[^a-z]+", name)) - {""} for name in parts]
    return [n for n in names if n and n <= WORDS | PLAIN and not n <= PLAIN]


def _element(tag: str, attributes: str) -> Node:
    named = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    symbol = tag + "".join(f"[{k}={v}]" for k, v in sorted(named.items()) if k != "id")
    return Node(tag, symbol, _outside_names(list(named.values())))


def parse(page: str) -> Node:
    """Tree of elements and strings. End tags that are left out are supplied; stray ones are ignored."""
    root = Node("", "", [])
    stack, open_ = [root], Counter()

    def close(depth: int) -> None:
        open_.subtract(node.tag for node in stack[depth:])
        del stack[depth:]

    for token in TOKEN.finditer(page):
        raw, slash, tag, attributes, slash2, tag2, attributes2, text = token.groups()
        if text is not None:
            stack[-1].children.append(html.unescape(text))
            continue
        tag = tag or tag2
        if tag is None:
            continue
        tag, closing = tag.lower(), slash or slash2
        if closing:
            if open_[tag]:
                close(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].tag == tag))
            continue
        ends, fence = ENDS.get(tag, {"p"} if tag in BLOCK else frozenset()), FENCES.get(tag, HOLDERS | {"li"})
        for depth in range(len(stack) - 1, 0, -1) if any(open_[t] for t in ends) else ():
            if stack[depth].tag in ends:
                close(depth)
                break
            if stack[depth].tag in fence:
                break
        if tag == "br" or tag == "hr":
            stack[-1].children.append(" ")
        if tag in VOID:
            continue
        node = _element(tag, attributes or attributes2 or "")
        stack[-1].children.append(node)
        stack.append(node)
        open_[tag] += 1
    return root


# A wrapper node is [symbol, optional, repeated, text, children, pages, strings]; a text has the symbol "#" and as text the digest
# of its only value, or null for a slot. ``strings`` has the digests that stand in it on each of its pages and how often at most.


def _digest(value: str) -> str | None:
    words = " ".join(value.split())
    return hashlib.blake2b(words.encode(), digest_size=8).hexdigest() if words else None


def _text(value: str) -> list | None:
    digest = _digest(value)
    return ["#", False, False, digest, [], 1, {digest: 1}] if digest else None


def wrapper_of(node: Node) -> list:
    """The token stream of one page, runs of equal neighbours folded to repeated groups."""
    order, made = [node], {}
    for parent in order:
        order.extend(c for c in parent.children if isinstance(c, Node))
    sys.setrecursionlimit(max(sys.getrecursionlimit(), LEVELS))
    for parent in reversed(order):
        children = [_text(c) if isinstance(c, str) else made.pop(id(c)) for c in parent.children]
        made[id(parent)] = [parent.symbol, False, False, None, _folded([c for c in children if c]), 1, {}]
    return made[id(node)]


def dumped(wrapper: list) -> str:
    """JSON of all elements in order, each with the number of its children, however deep they are."""
    out, stack = [], [wrapper]
    while stack:
        one = stack.pop()
        out.append([*one[:4], len(one[4]), *one[5:]])
        stack.extend(reversed(one[4]))
    return json.dumps(out, separators=(",", ":"))


def loaded(value: str) -> list:
    root: list = []
    stack = [(root, 1)]
    for one in json.loads(value):
        while not stack[-1][1]:
            stack.pop()
        into, left = stack[-1]
        stack[-1] = into, left - 1
        children: list = []
        into.append([*one[:4], children, *one[5:]])
        stack.append((children, one[4]))
    return root[0]


def _folded(children: list[list]) -> list[list]:
    out: list[list] = []
    for child in children:
        if out and out[-1][0] == child[0]:
            out[-1] = _merged(out[-1], child, True)
            out[-1][2] = True
        else:
            out.append(child)
    return out


def _merged(a: list, b: list, same_pages: bool = False) -> list:
    """One element for two of the same symbol, of different pages or, in a repeated group, of the same ones."""
    if not same_pages:
        pages, strings = a[5] + b[5], {k: max(a[6][k], b[6][k]) for k in a[6] if k in b[6]}
    elif a[5] == b[5]:
        pages, strings = a[5], {k: a[6].get(k, 0) + b[6].get(k, 0) for k in sorted({*a[6], *b[6]})}
    else:
        pages, strings = max((a[5], a[6]), (b[5], b[6]), key=lambda x: x[0])
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] if a[3] == b[3] else None, align(a[4], b[4], same_pages), pages, strings]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``, the empty one first."""
    row = np.zeros(len(b) + 1, np.int64)
    for symbol in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == symbol))
        np.maximum.accumulate(row, out=row)
    return row


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, in the memory of one row: one half of ``a`` from each side."""
    found: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, k, j, m = stack.pop()
        while i < k and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            found.append((k, m))
        if k - i == 1:
            at = np.flatnonzero(b[j:m] == a[i])
            found += [(i, j + int(at[0]))] if len(at) else []
        elif i < k and j < m:
            half = (i + k) // 2
            cut = j + int((_lengths(a[i:half], b[j:m]) + _lengths(a[half:k][::-1], b[j:m][::-1])[::-1]).argmax())
            stack += [(i, half, j, cut), (half, k, cut, m)]
    return sorted(found)


def align(a: list[list], b: list[list], same_pages: bool = False) -> list[list]:
    """Longest common subsequence of two runs of elements; what is in one of them only becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_merged(x, y, same_pages) for x, y in zip(a, b)]
    number: dict[str, int] = {}
    runs = [np.array([number.setdefault(x[0], len(number)) for x in side], np.int64) for side in (a, b)]
    out, i, j = [], 0, 0
    for k, m in [*_common(*runs), (len(a), len(b))]:
        out += [[x[0], True, *x[2:]] for x in (*a[i:k], *b[j:m])]
        if k < len(a):
            out.append(_merged(a[k], b[m], same_pages))
        i, j = k + 1, m + 1
    return _folded(out)


def _placed(node: Node, pattern: list | None) -> Iterator[list | None]:
    """Places of a node's children in the wrapper."""
    at = 0
    for child in node.children:
        symbol, found = "#" if isinstance(child, str) else child.symbol, None
        if pattern is not None and (symbol != "#" or child.strip()):
            place = next((k for k in (*range(at, len(pattern[4])), *range(at)) if pattern[4][k][0] == symbol), None)
            if place is not None:
                at, found = place, pattern[4][place]
        yield found


def _lay(root: Node, wrapper: list) -> None:
    """Gives every element its place in the wrapper."""
    root.place = wrapper
    stack = [root]
    while stack:
        node = stack.pop()
        node.places = list(_placed(node, node.place))
        for child, found in zip(node.children, node.places):
            if isinstance(child, Node):
                child.place = found
                stack.append(child)


def _own(value: str, place: list | None) -> bool:
    """Is this text that does not stand in its place on every page that has the place?"""
    digest = _digest(value)
    return digest is not None and (place is None or place[5] < 2 or not (place[3] == digest or digest in place[6]))


class Page:
    """One page laid over the wrapper of its host. ``names``: do class, id and role count; ``called``: may articles be called so?"""

    def __init__(self, root: Node, names: bool, called: bool):
        self.root, self.names, self.called = root, names, called
        self.tops: list[Node] = []
        self.beside: set[int] = set()

    def skipped(self, node: Node) -> bool:
        return node.outside or self.names and node.named or not self.called and node.called or id(node) in self.beside

    def articles(self) -> list[Node]:
        """Outermost main and article elements. In them, repeated groups of articles beside or inside a single one are set aside."""
        found, single, grouped = [], False, []
        stack: list[tuple[Node, Node | None, bool]] = [(self.root, None, False)]
        while stack:
            node, top, inside = stack.pop()
            if self.skipped(node):
                continue
            article = node.tag == "article"
            if top is None and (article or node.tag == "main"):
                found.append(node)
                top = node
            if article:
                repeated = node.place is not None and node.place[2]
                single |= not inside and not repeated
                if repeated:
                    grouped.append((node, inside))
            stack.extend((c, top, inside or article) for c in reversed(node.children) if isinstance(c, Node))
        self.beside = {id(node) for node, inside in grouped if inside or single}
        return [node for node in found if id(node) not in self.beside]

    def located(self) -> list[Node]:
        """Without such elements: the element around all text that differs from page to page, and what goes with it."""
        path: list[tuple[Node, int]] | None = None
        own: set[int] = set()
        stack: list[list] = [[self.root, 0]]
        least = 1  # levels that have stayed open since the last such text
        while stack:
            node, i = stack[-1]
            if i == len(node.children):
                stack.pop()
                least = min(least, len(stack))
                continue
            stack[-1][1] += 1
            child = node.children[i]
            if isinstance(child, Node):
                if not self.skipped(child) and child.tag != "header":
                    stack.append([child, 0])
            elif child.strip() and _own(child, node.places[i]):
                path = [(n, k - 1) for n, k in stack] if path is None else path[:least]
                least = len(stack)
                for above, _ in reversed(stack):
                    if id(above) in own:
                        break
                    own.add(id(above))
        if path is None:
            return [self.root]
        paragraphs = self.paragraphs()
        before: list[Node] = []
        after: list[Node] = []
        for depth, (node, i) in enumerate(path):
            groups = {id(f) for c, f in zip(node.children, node.places) if f is not None and isinstance(c, Node) and id(c) in own}
            keep = [isinstance(c, Node) and (id(c) in own or f is not None and f[2] and id(f) in groups) for c, f in zip(node.children, node.places)]
            many = [isinstance(c, Node) and paragraphs.get(id(c), 0) > 1 for c in node.children]
            text = any(isinstance(c, str) and c.strip() and _own(c, f) for c, f in zip(node.children, node.places))
            child = node.children[i]
            last = depth + 1 == len(path) or not isinstance(child, Node) or child.tag not in HOLDERS
            if text or last and not any(keep):
                return [*before, node, *after]
            first = keep.index(True)
            while first and (not isinstance(c := node.children[first - 1], Node) and not c.strip() or isinstance(c, Node) and c.tag in HEADINGS):
                first -= 1
            end = len(keep) - 1 - keep[::-1].index(True)
            if last or sum(keep) > 1:
                kept = [c for k, c in enumerate(node.children) if isinstance(c, Node) and (first <= k <= end or many[k])]
                return [*before, *kept, *after]
            before += [c for k, c in enumerate(node.children[:i]) if isinstance(c, Node) and (k >= first or many[k])]
            after = [c for k, c in enumerate(node.children[i + 1 :], i + 1) if many[k]] + after
        return [*before, path[-1][0], *after]

    def paragraphs(self) -> dict[int, int]:
        """Paragraphs in every element that is not skipped."""
        order, found = [(self.root, None)], {}
        for node, _ in order:
            order.extend((c, node) for c in node.children if isinstance(c, Node) and not self.skipped(c))
        for node, above in reversed(order):
            found[id(node)] = found.get(id(node), 0) + (node.tag == "p")
            if above is not None:
                found[id(above)] = found.get(id(above), 0) + found[id(node)]
        return found

    def blocks(self, tops: list[Node], headers: bool) -> list[str]:
        """Texts of the blocks in these elements. ``headers``: header elements, and the headings in what is named so, belong to them."""
        out: list[str] = []
        held: list[str] = []

        def flush() -> None:
            words = " ".join("".join(held).split())
            if words:
                out.append(words)
            held.clear()

        for top in tops:
            stack: list[list] = [[top, 0, False]]
            flush()
            while stack:
                node, i, titles = stack[-1]
                if i == len(node.children):
                    stack.pop()
                    if node.tag in BLOCK:
                        flush()
                    continue
                stack[-1][1] += 1
                child = node.children[i]
                if isinstance(child, str):
                    if not titles:
                        held.append(child)
                    continue
                if titles and child.tag in HEADINGS and not child.outside:
                    titles = False
                elif self.skipped(child) or child.tag == "header" and not headers:
                    flush()
                    if not headers or child.outside or not child.header:
                        continue
                    titles = True
                if child.tag in BLOCK:
                    flush()
                stack.append([child, 0, titles])
            flush()
        return out


def main_text(page: str, wrapper: list | None, pages: int) -> str:
    """Blocks of the article, in page order. ``wrapper`` was inferred from ``pages`` pages; a page on its own is its own wrapper."""
    root = parse(page)
    _lay(root, wrapper if wrapper is not None and pages > 1 else wrapper_of(root))
    strict = Page(root, True, False)
    for view, located in ((strict, False), (strict, True), (Page(root, False, False), False), (Page(root, True, True), False)):
        found = view.located() if located else view.articles()
        if blocks := view.blocks(found, not located):
            return "\n\n".join(blocks)
    return ""


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host and task, or a few if there are many hosts."""
    known: dict[str, list] = {}
    counts: dict[str, int] = {}
    for batch in slices(batches, "html"):
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            own = wrapper_of(parse(page))
            counts[host] = counts.get(host, 0) + 1
            if host not in known:
                known[host] = own
            else:
                known[host] = _merged(known[host], own)
            if len(known) > HOSTS_HELD:
                yield _rows(known, counts)
    yield _rows(known, counts)


def _rows(known: dict[str, list], counts: dict[str, int]) -> pa.RecordBatch:
    """Takes all wrappers out."""
    hosts = sorted(known)
    values = [dumped(known.pop(h)) for h in hosts]
    columns = [pa.array(hosts, pa.string()), pa.array(values, pa.string()), pa.array([counts.pop(h) for h in hosts], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["host", "wrapper", "pages"])


def _join_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)).sort_by([("wrapper", "ascending"), ("pages", "ascending")])
    merged = None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), LEVELS))
    for value in table.column("wrapper"):
        one = loaded(value.as_py())
        merged = one if merged is None else _merged(merged, one)
    value = dumped(merged)
    yield pa.RecordBatch.from_arrays([table.column("host").combine_chunks()[:1], pa.array([value]), pa.array([pa.compute.sum(table.column("pages")).as_py()])], names=["host", "wrapper", "pages"])


def host_wrappers(pages: DataFrame, host: Column, html_col: str = "html") -> DataFrame:
    """(host, wrapper, pages), wrappers as JSON. Tasks merge their own pages first, then a few tasks' wrappers each, then those."""
    rows = pages.select(F.coalesce(host, F.lit("")).alias("host"), text_of(html_col).alias("html"))
    schema = "host string, wrapper string, pages bigint"
    each = rows.mapInArrow(_infer, schema)
    some = each.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")).applyInArrow(_join_wrappers, schema)
    return some.groupBy("host").applyInArrow(_join_wrappers, schema)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed: dict[str, list] = {}
    for batch in slices(batches, "html"):
        texts = []
        for page, wrapper, pages in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), batch.column("pages").to_pylist()):
            if wrapper is not None and wrapper not in parsed:
                if len(parsed) > 1000:
                    parsed.clear()
                parsed[wrapper] = loaded(wrapper)
            texts.append(main_text(page, parsed.get(wrapper), pages or 0))
        names = [n for n in batch.schema.names if n not in ("html", "wrapper", "pages")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, "main_text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per row of ``pages``.

    The article is what stands in ``main`` and ``article`` elements, without outside elements, articles that are called comments or
    the like, and repeated groups of articles inside or beside a single one. Pages without such elements: the element around all
    text that is not the same in its place on each of the host's pages that have the place. What is the same before and
    after it is the frame and goes, but headings directly before it and elements with several paragraphs stay. Nothing is
    taken out of the article because other pages hold it too; pages that are all alike keep all. If that leaves nothing, names of
    classes are ignored, and then what articles are called. Nesting has no limit. Null and empty pages have an empty text;
    pages without a host share the wrapper of the empty host. Repeated rows come back as often as they came; an empty
    table gives an empty result; other columns are not needed.
    """
    host, _ = address(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), text_of(html_col).alias("html"))
    wrappers = stored(host_wrappers(rows, F.col("host")), "wrappers").withColumnRenamed("host", "__host")
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    joined = rows.join(wrappers, F.col("host") == F.col("__host"), "left").select("id", "url", "html", "wrapper", "pages")
    id_type = rows.schema["id"].dataType.simpleString()
    texts = joined.mapInArrow(_extract, f"id {id_type}, url string, main_text string")
    return texts.select("id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))
