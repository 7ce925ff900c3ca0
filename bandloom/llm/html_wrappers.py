"""HTML extraction: union-free wrappers are inferred for each host by aligning its pages, and tell which text slots are content."""

from __future__ import annotations

import json
import re
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.common import bounded_batches, cut, discard, renamed, shuffle_width

# HTML elements by kind.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
    summary table tbody td tfoot th thead title tr ul br button textarea noscript iframe object template""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp noembed noframes textarea title".split())
#: What an opening tag closes, if it is open and nothing of the second set is open within.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "head", "body", "html", "option", "optgroup", "noscript", "button", "title"}
P_BOUNDS = frozenset("table td th caption button object html body template".split())

# Elements and roles that mark what is not the article.
NOT_CONTENT = frozenset("nav footer aside form script style noscript template iframe button select option textarea dialog menu svg canvas object head title search".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
# Words of class names and ids for what is not the article, and words for parts of a layout. A name counts if all
# its words are of these, and one of the first; ad-hoc, share-capital or related-work are no such names.
NOT_CONTENT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense breadcrumb breadcrumbs comment comments commentlist
    cookie cookies consent copyright disqus footer gdpr header login masthead menu nav navbar navigation newsletter notice
    notices outbrain pager pagination paywall popup promo promos promoted promotion recommendations related replies respond
    share sharing sidebar signup skiplink social sponsor sponsored subscribe subscription taboola toolbar widget widgets""".split()
)
LAYOUT_WORDS = frozenset(
    """site page main top bottom left right box list bar area section wrap wrapper container block link links button buttons
    posts banner form item items inner outer row col panel thread""".split()
)
# Words of the first kind that count inside articles even alone.
SURE_WORDS = frozenset("ad ads advert adverts advertisement advertisements comments commentlist disqus newsletter respond sidebar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLASS = re.compile(r"[^A-Za-z_-]+")

#: Items of a wrapper: optional, repeated; not aligned with any page yet; a level of items in any order; one where they are
#: compared by their tag alone.
OPTIONAL, REPEATED, FRESH, ANY_ORDER, LOOSE = 1, 2, 4, 8, 16
#: Different pages that must have the same text in a slot for it to be template text.
SAME_PAGES = 3
#: A level is generalised if mismatches have made it this many times, and by this many items, longer than on the widest page: a
#: bound for what one host's layouts may differ, at which the length of pages has no part.
GROWTH, SPARE = 4, 64
#: Nodes of the wrappers that a task holds, wrappers that a task merges in a round, and bytes of wrappers that tasks carry.
TASK_NODES, FAN, CARRIED = 400_000, 64, 32 << 20


def named(value: str, inside: bool) -> str:
    """The mark of an element by its names (classes, an id): '!' if one speaks of what is not the article, or '~', which needs the
    wrapper's word, if that is a single common word inside an article."""
    mark = ""
    for name in value.split():
        parts = [w.lower() for w in _WORDS.findall(name)]
        if not NOT_CONTENT_WORDS.isdisjoint(parts) and all(w in NOT_CONTENT_WORDS or w in LAYOUT_WORDS for w in parts):
            if not inside or len(parts) > 1 or parts[0] in SURE_WORDS:
                return "!"
            mark = "~"
    return mark


def _key(tag: str, attributes: str, inside: bool) -> tuple[str, str]:
    """(the name of an element in wrappers, its mark): tag and classes; the mark is ! if it is not content, ~ if it may not be."""
    mark = "!" if tag in NOT_CONTENT or (tag == "header" and not inside) else ""
    classes: list[str] = []
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                mark = "!"
            elif name == "style":
                mark = "!" if "display:none" in value.replace(" ", "").lower() else mark
            elif name == "role":
                mark = "!" if value.lower() in NOT_CONTENT_ROLES else mark
            else:
                if mark != "!" and tag not in ("html", "body", "main", "article"):
                    mark = named(value, inside) or mark
                if name == "class":
                    classes += [c for c in (_CLASS.sub("", c) for c in value.split()) if c]
    names = ".".join(sorted(set(classes)))
    names = xxhash.xxh3_64_hexdigest(names) if len(names) > 64 else names
    return (f"{tag}.{names}" if names else tag) + mark, mark


class Node:
    """An element, a group of elements '(...)' or a text slot '#' of a page or of a wrapper.

    text: of a slot, a hash of the text that it has on all pages, or 0. pages: hashes of SAME_PAGES different pages with the slot.
    widest: of a wrapper's element, how many items the page with the most of them has in it.
    """

    __slots__ = ("key", "flags", "kids", "text", "pages", "widest")

    def __init__(self, key: str, flags: int = 0, kids: list[Node] | None = None, text: int = 0, pages: tuple[int, ...] = (), widest: int = 0) -> None:
        self.key, self.flags, self.kids, self.text, self.pages, self.widest = key, flags, [] if kids is None else kids, text, pages, widest


class Slot:
    """A text of a page: its node, whether it is marked as no content, and whether it lies in an article or main element."""

    __slots__ = ("node", "text", "mark", "inside")

    def __init__(self, node: Node, text: str, mark: str, inside: bool) -> None:
        self.node, self.text, self.mark, self.inside = node, text, mark, inside


class Page:
    """A page's text slots in page order, and its tree. Inline elements belong to the text around them."""

    def __init__(self, html: str) -> None:
        self.slots: list[Slot] = []
        self.root = Node("")
        self._stack: list[tuple[str, str, Node, bool]] = [("", "", self.root, False)]  # tag, mark, node, in the main part
        self._open_tags: Counter[str] = Counter()
        self._text: list[str] = []
        at, last = 0, html.rfind(">")
        while at < len(html):
            m = _TAG.search(html, at) if at <= last else None
            if m is None:
                self._text.append(html[at:])
                break
            if m.start() > at:
                self._text.append(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._close(tag)
                continue
            self._open(tag, (m[3] if m[2] else m[6]) or "")
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                stop = end.start() if end else len(html)
                if tag in ("textarea", "title", "xmp"):
                    self._text.append(html[at:stop])
                self._close(tag)
                at = end.end() if end else len(html)
        self._flush()
        whole = xxhash.xxh3_64_intdigest("\n".join(s.text for s in self.slots)) >> 1
        for s in self.slots:
            s.node.pages = (whole,)

    def _flush(self) -> None:
        if self._text:
            text = "".join(self._text)
            self._text = []
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                _, mark, node, inside = self._stack[-1]
                node.kids.append(Node("#", text=(xxhash.xxh3_64_intdigest(text) >> 1) or 1))
                self.slots.append(Slot(node.kids[-1], text, mark, inside))

    def _push(self, entry: tuple[str, str, Node, bool]) -> None:
        self._stack.append(entry)
        self._open_tags[entry[0]] += 1

    def _cut(self, i: int) -> None:
        for tag, *_ in self._stack[i:]:
            self._open_tags[tag] -= 1
        del self._stack[i:]

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._flush()
            return
        if tag in VOID and tag != "hr":
            return
        key, mark = _key(tag, attributes, self._stack[-1][3])
        if tag not in BLOCKS and tag not in ("script", "style", "svg", "canvas", "xmp", "noembed", "noframes") and not mark:
            return
        self._flush()
        if tag in CLOSES_P:
            self._imply({"p"}, P_BOUNDS)
        if tag in CLOSES:
            self._imply(*CLOSES[tag])
        if tag == "hr":
            return
        _, outer, node, inside = self._stack[-1]
        mine = Node(key)
        node.kids.append(mine)
        self._push((tag, outer if outer == "!" else mark or outer, mine, inside or tag in ("article", "main")))

    def _imply(self, closed: Iterable[str], bounds: Iterable[str]) -> None:
        if not any(self._open_tags[t] for t in closed):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[i][0]
            if tag in closed:
                self._cut(i)
                if tag not in ("td", "th"):
                    return
            elif tag in bounds:
                return

    def _close(self, tag: str) -> None:
        if tag in ("body", "html"):
            return  # what follows still belongs to the page
        if self._open_tags[tag]:
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] == tag:
                    self._flush()
                    self._cut(i)
                    return
        if tag == "p":
            self._flush()


Run = tuple[str, list[Node]]


def _loose(key: str) -> str:
    return key if key[0] in "(#" else key.rstrip("!~").split(".")[0] + (key[-1] if key[-1] in "!~" else "")


def runs(items: list[Node], flags: int) -> list[Run]:
    """Equal neighbours together; all equal items where their order does not count."""
    out: list[Run] = []
    if flags & ANY_ORDER:
        sets: dict[str, list[Node]] = {}
        for x in items:
            sets.setdefault(_loose(x.key) if flags & LOOSE else x.key, []).append(x)
        return sorted(sets.items())
    for x in items:
        key = x.key
        if out and out[-1][0] == key:
            out[-1][1].append(x)
        else:
            out.append((key, [x]))
    return out


def squares(items: list[Run]) -> set[str]:
    """Names of the groups of two or three runs that stand twice in a row."""
    keys, out = [k for k, _ in items], set()
    for n in (2, 3):
        for i in range(len(keys) - 2 * n + 1):
            if keys[i] == keys[i + n] and keys[i : i + n] == keys[i + n : i + 2 * n] and not any(k[0] == "(" for k in keys[i : i + n]):
                out.add(f"({' '.join(keys[i : i + n])})")
    return out


def grouped(items: list[Run], groups: set[str]) -> list[Run]:
    """The runs with each of these groups as one item."""
    out: list[Run] = []
    i = 0
    while i < len(items):
        key, nodes, n = *items[i], 1
        for size in (2, 3):
            if (name := f"({' '.join(k for k, _ in items[i : i + size])})") in groups and i + size <= len(items):
                key, nodes, n = name, [Node(name, 0, [x for _, some in items[i : i + size] for x in some])], size
                break
        if out and out[-1][0] == key:
            out[-1][1].extend(nodes)
        else:
            out.append((key, list(nodes)))
        i += n
    return out


def common(a: list[str], b: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """A longest common subsequence in order: pairs of places, None where the other list has no match. Bit-parallel."""
    at: dict[str, int] = {}
    for j, key in enumerate(b):
        at[key] = at.get(key, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for key in a:
        hit = row & at.get(key, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j, back = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            back.append((None, j))
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
            back.append((i, None))
        else:
            i, j = i - 1, j - 1
            back.append((i, j))
    yield from ((k, None) for k in range(i))
    yield from ((None, k) for k in range(j))
    yield from reversed(back)


def alignment(w: list[Node], p: list[Node], flags: int) -> tuple[list[Run], list[Run], Iterable[tuple[int | None, int | None]]]:
    """Runs of a wrapper's level and of a page's, and how they match. Groups are formed only where the levels differ."""
    wi, pi = runs(w, flags), runs(p, flags)
    a, b = [k for k, _ in wi], [k for k, _ in pi]
    if a != b and not flags & ANY_ORDER and (groups := squares(wi) | squares(pi) | {k for k in (*a, *b) if k[0] == "("}):
        wi, pi = grouped(wi, groups), grouped(pi, groups)
        a, b = [k for k, _ in wi], [k for k, _ in pi]
    return wi, pi, ((i, i) for i in range(len(a))) if a == b else common(a, b)


def _repeats(key: str, *nodes: Node) -> bool:
    return key[0] == "(" or any(x.flags & REPEATED for x in nodes)


def level(w: list[Node], p: list[Node], flags: int) -> tuple[list[Node], list[tuple[Node, Node]]]:
    """(the items of a wrapper's level after a page's level is aligned with it, what is to be aligned below).

    Runs of equal length match item by item; others become one repeated item. Mismatches become optional.
    """
    wi, pi, matches = alignment(w, p, flags)
    fresh = flags & FRESH
    kids: list[Node] = []
    below: list[tuple[Node, Node]] = []

    def one(key: str, head: Node, rest: list[Node]) -> None:
        head.key = key
        head.flags |= REPEATED
        kids.append(head)
        below.extend((head, x) for x in rest)

    for i, j in matches:
        if j is None:
            key, nodes = wi[i]
            for x in nodes:
                x.flags |= OPTIONAL
            if _repeats(key, *nodes):
                one(key, nodes[0], nodes[1:])
            else:
                kids += nodes
        elif i is None:
            key, nodes = pi[j]
            new = [Node(key, FRESH | (0 if fresh else OPTIONAL)) for _ in nodes]
            if _repeats(key, *nodes):
                one(key, new[0], nodes)
            else:
                kids += new
                below += zip(new, nodes, strict=True)
        else:
            key, (ws, ps) = wi[i][0], (wi[i][1], pi[j][1])
            if len(ws) == len(ps) and not _repeats(key, *ws, *ps) and not flags & LOOSE:
                kids += ws
                below += zip(ws, ps, strict=True)
            else:
                one(key, ws[0], [*ws[1:], *ps])
    return kids, below


def too_long(w: Node) -> int:
    """The items of a level beyond which its order says nothing."""
    return GROWTH * w.widest + SPARE


def generalised(w: Node) -> list[tuple[Node, Node]]:
    """What is to be aligned for a level too varied for an order: then it holds any items of its kinds, in any number."""
    heads: dict[str, Node] = {}
    below = []
    for x in w.kids:
        x.flags |= REPEATED | OPTIONAL
        if (head := heads.setdefault(x.key, x)) is not x:
            below.append((head, x))
    w.kids = list(heads.values())
    w.flags |= ANY_ORDER | (LOOSE if len(heads) > too_long(w) else 0)
    return below


def absorb(wrapper: Node, page: Node) -> None:
    """Aligns a page's tree, or another wrapper, with a wrapper, which becomes the expression of both. Without recursion."""
    todo = [(wrapper, page)]
    while todo:
        w, p = todo.pop()
        flags = w.flags | p.flags & ~FRESH
        w.flags = flags & ~FRESH
        if w.key == "#":
            w.text = p.text if flags & FRESH or w.text == p.text else 0
            w.pages = tuple(sorted({*w.pages, *p.pages}))[:SAME_PAGES]
            continue
        w.widest = max(w.widest, p.widest or len(p.kids))
        w.kids, below = level(w.kids, p.kids, flags)
        if len(w.kids) > too_long(w):
            below += generalised(w)
        todo += reversed(below)


def placed(wrapper: Node, page: Node) -> Iterator[tuple[Node, Node | None]]:
    """(text node of a page, the wrapper's slot for it): the page is matched against the wrapper's expression."""
    todo: list[tuple[Node | None, Node]] = [(wrapper, page)]
    while todo:
        w, p = todo.pop()
        if p.key == "#":
            yield p, w
        elif w is None:
            todo += ((None, x) for x in p.kids)
        else:
            wi, pi, matches = alignment(w.kids, p.kids, w.flags)
            for i, j in matches:
                if i is None:
                    todo += ((None, x) for x in pi[j][1])
                elif j is not None:
                    ws, ps = wi[i][1], pi[j][1]
                    todo += zip(ws, ps, strict=True) if len(ws) == len(ps) else ((ws[min(k, len(ws) - 1)], x) for k, x in enumerate(ps))


def template_text(slot: Node | None) -> bool:
    """Whether a slot has the same text on several different pages and no other on any."""
    return slot is not None and slot.text != 0 and len(slot.pages) >= SAME_PAGES


def article(page: Page, wrapper: Node) -> str:
    """A page's text in the content slots of its host's wrapper.

    Text in elements that are not content never counts. Of a page with text in article or main elements, that text counts, but
    for template text in elements that may not be content by their names. Of other pages, whatever is not template text counts,
    or all if there is nothing else.
    """
    slot_of = {id(p): w for p, w in placed(wrapper, page.root)}
    own = [s for s in page.slots if s.mark != "!"]
    inside = [s for s in own if s.inside]
    kept = [s for s in inside or own if not (template_text(slot_of[id(s.node)]) and (s.mark or not inside))]
    return " ".join(s.text for s in kept or inside or own)


def expression(wrapper: Node) -> str:
    """The wrapper as a union-free regular expression over tags, template text ("") and text slots."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(wrapper.kids))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        end = ("", "?", "+", "*")[x.flags & 3]
        if x.key == "#":
            out.append(("#SAME" if template_text(x) else "#TEXT") + end)
        else:
            out.append("(" if x.key[0] == "(" else f"(<{x.key}>")
            todo += [(")" if x.key[0] == "(" else "</>)") + end, *reversed(x.kids)]
    return "".join(out)


def dumped(wrapper: Node) -> str:
    """A wrapper as a flat list of its nodes in order, each with its depth."""
    rows, todo = [], [(0, wrapper)]
    while todo:
        depth, x = todo.pop()
        rows.append((depth, x.key, x.flags, x.widest, x.text, *x.pages))
        todo += ((depth + 1, k) for k in reversed(x.kids))
    return json.dumps(rows, separators=(",", ":"))


def loaded(text: str) -> Node:
    line: list[Node] = []
    for depth, key, flags, widest, digest, *pages in json.loads(text):
        node = Node(key, flags, [], digest, tuple(pages), widest)
        if depth:
            line[depth - 1].kids.append(node)
        del line[depth:]
        line.append(node)
    return line[0]


def size(wrapper: Node) -> int:
    n, todo = 0, [wrapper]
    while todo:
        x = todo.pop()
        n += 1
        todo += x.kids
    return n


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper of each task's pages for each host: every page is aligned with what its host has so far."""
    held: dict[str, Node] = {}
    nodes = 0

    def told() -> pa.RecordBatch:
        hosts = list(held)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([dumped(held[h]) for h in hosts], pa.string())], ["host", "wrapper"])

    for b in batches:
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            page = Page(html or "").root
            nodes += size(page)
            absorb(held.setdefault(host, Node("", FRESH)), page)
            if nodes > TASK_NODES:  # that many at most; look how many they are
                nodes = sum(map(size, held.values()))
                if nodes > TASK_NODES // 2:
                    yield told()
                    held, nodes = {}, 0
    if held:
        yield told()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns wrappers, sorted by host and part, with each other: one for each host and part."""
    now: tuple[str, int] | None = None
    wrapper = Node("", FRESH)

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([dumped(wrapper)], pa.string())], ["host", "wrapper"])

    for b in batches:
        for host, part, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (host, part) != now:
                if now is not None:
                    yield told()
                now, wrapper = (host, part), Node("", FRESH)
            absorb(wrapper, loaded(text))
    if now is not None:
        yield told()


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """Rows (host, wrapper), one for each host, from pages (host, html); a table in the shared folder.

    Tasks align their own pages first and hold no more than their wrappers. The tasks' wrappers of a host are then aligned
    with each other, about FAN in a task and in a fixed order, round by round until one is left, so that a host with a third
    of all pages is the work of many tasks.
    """
    n = shuffle_width(pages.sparkSession)
    found = cut(pages.mapInArrow(_observe, "host string, wrapper string"), "wrappers")
    while (found.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        counts = found.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("parts"))
        dealt = found.join(counts, "host").select("host", F.pmod(F.xxhash64("wrapper"), "parts").alias("part"), "wrapper")
        merged = cut(dealt.repartition(n, "host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(_merge, "host string, wrapper string"), "wrappers")
        discard(found)
        found = merged
    return found


class _Extractor:
    """Texts of pages by their hosts' wrappers, of which the last few are kept in their loaded form."""

    def __init__(self, of: Callable[[str], str]) -> None:
        self.of, self.ready = of, OrderedDict()

    def text(self, host: str, html: str | None) -> str:
        if host not in self.ready:
            self.ready[host] = loaded(self.of(host))
            if len(self.ready) > 256:
                self.ready.popitem(last=False)
        self.ready.move_to_end(host)
        return article(Page(html or ""), self.ready[host])


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id_col, url_col, text), one for each row of pages: the article's text by the wrapper of the page's host.

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by one space. Every
    page is matched against its host's wrapper, which is inferred from all pages of the host; see article(). Wrappers of up to
    CARRIED bytes together go to the tasks; if they are larger, they and the pages are dealt by host, and hosts with many pages
    by host and page, so that a page meets its wrapper in a stream and neither is carried twice.

    Null and empty pages have empty text; null ids and urls and repeated rows are passed on (pages without a host in their url
    are aligned together); an empty table gives no rows; other columns are ignored. Depth and length of a page are not limited.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    wrappers = infer_wrappers(rows.select("host", "html"))
    schema = T.StructType([renamed(rows.schema["id"], "id"), renamed(rows.schema["url"], "url"), T.StructField("text", T.StringType())])
    if (wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) <= CARRIED:
        sent = spark.sparkContext.broadcast(dict(map(tuple, wrappers.collect())))

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = _Extractor(sent.value.__getitem__)
            for b in batches:
                texts = [by.text(*x) for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

        done = rows.mapInArrow(extract, schema)
    else:
        done = _dealt(rows, wrappers).mapInArrow(_extract_dealt, schema)
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def _dealt(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Rows (id, url, host, html, wrapper): in each partition, sorted by host, a row with the host's wrapper leads its pages."""
    n = shuffle_width(rows.sparkSession)
    counts = rows.groupBy("host").count()
    part = max(1, (counts.agg(F.sum("count")).first()[0] or 0) // (4 * n))
    large = F.broadcast(counts.where(F.col("count") > part).select("host", F.ceil(F.col("count") / part).cast("int").alias("parts")))  # 4 n hosts at most
    salted = rows.join(large, "host", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("html", "id"), "parts")).otherwise(0))
    leads = wrappers.join(large, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)))
    leads = leads.select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("id", "url")), "host", F.lit(None).cast("string").alias("html"), "wrapper", "part")
    both = salted.select("id", "url", "host", "html", F.lit(None).cast("string").alias("wrapper"), "part").unionByName(leads)
    return both.repartition(n, "host", "part").sortWithinPartitions("host", "part", F.col("wrapper").isNull()).drop("part")


def _extract_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrapper = Node("")
    for b in batches:
        texts, places = [], []
        for i, (html, lead) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
            if lead is not None:
                wrapper = loaded(lead)
            else:
                places.append(i)
                texts.append(article(Page(html or ""), wrapper))
        at = pa.array(places, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(texts, pa.string())], ["id", "url", "text"])
