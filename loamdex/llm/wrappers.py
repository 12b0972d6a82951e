"""Main text of web pages through wrappers: a union-free regular expression over tags for each host.

A page is a stream of tags and texts, nested by its elements. The streams of one host are aligned,
two at a time: what both have is kept, what one lacks becomes optional, neighbours that look alike
become a repeated group, and texts become slots that know how long they are, how much of them is
linked, and whether they differ between pages. The result is the host's wrapper. Its statistics
choose the element that holds the article; each page is then read along the wrapper.

Pages that have the same structure are merged inside of tasks first, so a host with a third of all
pages leaves one row for each structure and task. The distinct structures of a host are aligned in a
tree of groups of about FAN, in an order that depends on the structures alone.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.textops import checkpointed
from loamdex.llm.workers import map_texts

#: Structures that are aligned in one step of the tree.
FAN = 16
#: Hosts whose wrappers are sent to all tasks, and the longest of those: 16 MB at most. Pages of other hosts are joined with theirs.
SENT, LONGEST = 2_000, 8_192
#: Structures that a task keeps before it passes them on.
KEPT = 5_000
#: Distinct texts of a slot that are told apart, and the longest repeated group.
TEXTS, PERIOD = 4, 6

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption # ()".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an opening tag closes if it is still open: tag -> (closed ones, elements that it doesn't look beyond).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"}),
}
#: Elements that never hold the article, and words in class, id and role that say the same.
OTHER = set("head nav header footer aside form menu dialog button select option datalist script style template noscript textarea iframe object svg canvas audio video map title".split())
OTHER_WORDS = set(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets header masthead topbar footer copyright comment comments reply replies respond discussion disqus share sharing social related "
    "recommended recommendations pagination pager toolbar skip search hidden".split()
)
#: Elements that say nothing by their name.
GENERIC = {"div", "section", "center", "td", "()"}
HEADER_WORDS = {"header", "masthead", "topbar"}
#: Words that name the article, the surest first.
MAIN_WORDS = ({"article", "articlebody"}, {"post", "entry", "story"}, {"content", "main"})

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]|$))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element (sig: tag and the words that name it), or a text (sig #)."""

    __slots__ = ("sig", "tag", "kids", "text", "linked", "other", "_shape")

    def __init__(self, sig: str, tag: str, other: bool = False, text: str = "", linked: bool = False):
        self.sig, self.tag, self.kids, self.text, self.linked, self.other, self._shape = sig, tag, [], text, linked, other, None

    def shape(self) -> frozenset[str]:
        if self._shape is None:
            self._shape = frozenset(k.sig for k in self.kids)
        return self._shape


def words_of(attributes: str) -> list[str]:
    """Words of class, id, role and itemprop, lower-cased; hidden elements are called hidden."""
    found: list[str] = []
    for name, value in _NAMED.findall(attributes):
        value = value.strip("\"'")
        if name.lower() in ("hidden", "aria-hidden"):
            found += ["hidden"] if name.lower() == "hidden" or value.lower() == "true" else []
        else:
            found += [w.lower() for w in _WORDS.findall(value)]
    return found


def parse(page: str) -> Node:
    """The page's elements and texts; end tags that are missing or stray are put right as browsers do."""
    root = Node("()", "()")
    stack, link_at, at, n = [root], 0, 0, len(page)

    def put(text: str) -> None:
        if text:
            stack[-1].kids.append(Node("#", "#", text=text, linked=bool(link_at)))

    def close(depth: int) -> None:
        nonlocal link_at
        del stack[depth:]
        if link_at > depth:
            link_at = 0

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:  # a comment or declaration
            continue
        if m[1] or m[4]:
            if tag == "a":
                link_at = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        named = words_of(attributes) if attributes else []
        other = tag in OTHER or not OTHER_WORDS.isdisjoint(named)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in INLINE and not (other and tag not in VOID):
            if tag == "a":
                link_at = len(stack)
            elif tag == "br":
                put(" ")
            continue
        if tag not in INLINE:
            for depth in range(len(stack) - 1, 0, -1):  # paragraphs end where a block begins
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in ("td", "th", "li", "div", "article", "section", "table", "button"):
                    break
        closed, beyond = CLOSES.get(tag, ((), ()))
        for depth in range(len(stack) - 1, 0, -1) if closed else ():
            if stack[depth].tag in beyond:
                break
            if stack[depth].tag in closed:
                close(depth)
                break
        node = Node(".".join([tag, *sorted(set(named))]), tag, other)
        stack[-1].kids.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    return root


class Item:
    """A part of a wrapper: sig, kids; optional, many (repeated); and over all pages: characters, linked ones, pages, some distinct texts."""

    __slots__ = ("sig", "kids", "optional", "many", "chars", "linked", "pages", "texts", "_shape")

    def __init__(self, sig: str, kids: list[Item], optional: bool = False, many: bool = False, chars: int = 0, linked: int = 0, pages: int = 1, texts: tuple[str, ...] = ()):
        self.sig, self.kids, self.optional, self.many = sig, kids, optional, many
        self.chars, self.linked, self.pages, self.texts, self._shape = chars, linked, pages, texts, None

    @property
    def tag(self) -> str:
        return self.sig.split(".")[0]

    def shape(self) -> frozenset[str]:
        if self._shape is None:
            self._shape = frozenset(k.sig for k in self.kids)
        return self._shape

    def packed(self) -> list:
        return [self.sig, [k.packed() for k in self.kids], int(self.optional), int(self.many), self.chars, self.linked, self.pages, list(self.texts)]

    @classmethod
    def of(cls, x: list) -> Item:
        return cls(x[0], [cls.of(k) for k in x[1]], bool(x[2]), bool(x[3]), *x[4:7], tuple(x[7]))

    def regex(self) -> str:
        """The wrapper as it is read: tags, # for a slot, ? for optional, + and * for repeated."""
        inner = " ".join(k.regex() for k in self.kids)
        body = "#" if self.sig == "#" else f"({inner})" if self.sig == "()" else f"<{self.sig}>{inner}</{self.tag}>"
        mark = "*" if self.many and self.optional else "+" if self.many else "?" if self.optional else ""
        return f"({body}){mark}" if mark and self.sig != "()" else body + mark


def structure(item: Item) -> str:
    return item.regex()


def likeness(x: Item | Node, y: Item | Node) -> int:
    """2: the same tag and names, and contents of which two thirds or more are of the same kinds; 1: half or more, or the name alone says what it is; else 0."""
    if x.sig != y.sig:
        return 0
    a, b = x.shape(), y.shape()
    same, all_of = len(a & b), len(a | b)
    return 2 if not a or not b or 3 * same >= 2 * all_of else 1 if 2 * same >= all_of or x.sig not in GENERIC else 0


def twins(x: Item, y: Item) -> bool:
    return likeness(x, y) == 2


def merged(x: Item, y: Item, same_page: bool = False) -> Item:
    return Item(
        x.sig, align(x.kids, y.kids, same_page), x.optional or y.optional, x.many or y.many or same_page,
        x.chars + y.chars, x.linked + y.linked, max(x.pages, y.pages) if same_page else x.pages + y.pages, tuple(sorted({*x.texts, *y.texts})[:TEXTS]),
    )


def _optional(x: Item) -> Item:
    return Item(x.sig, x.kids, True, x.many, x.chars, x.linked, x.pages, x.texts)


def _grouped(items: list[Item], others: list[Item]) -> list[Item]:
    """items, with what occurs once here and as a repeated group in others put into such a group."""
    for group in others:
        if group.sig == "()" and not any(x.sig == "()" and x.shape() == group.shape() for x in items):
            wanted = [k.sig for k in group.kids]
            for i in range(len(items) - len(wanted) + 1):
                if [x.sig for x in items[i : i + len(wanted)]] == wanted:
                    items = [*items[:i], _group(items[i : i + len(wanted)]), *items[i + len(wanted) :]]
                    break
    return items


def _group(kids: list[Item]) -> Item:
    return Item("()", kids, False, False, sum(k.chars for k in kids), sum(k.linked for k in kids), max(k.pages for k in kids))


def align(xs: list[Item], ys: list[Item], same_page: bool = False) -> list[Item]:
    """What matches both lists in order: the most alike common subsequence; the other items are optional."""
    if len(xs) == len(ys) and all(map(twins, xs, ys)):
        return fold([merged(x, y, same_page) if not same_page else _once(x, y) for x, y in zip(xs, ys)])
    xs, ys = _grouped(xs, ys), _grouped(ys, xs)
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i in range(len(xs) - 1, -1, -1):
        for j in range(len(ys) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + likeness(xs[i], ys[j]))
    out, i, j = [], 0, 0
    while i < len(xs) and j < len(ys):
        if (like := likeness(xs[i], ys[j])) and best[i][j] == best[i + 1][j + 1] + like:
            out.append(merged(xs[i], ys[j], same_page) if not same_page else _once(xs[i], ys[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(xs[i]))
            i += 1
        else:
            out.append(_optional(ys[j]))
            j += 1
    return fold([*out, *map(_optional, xs[i:]), *map(_optional, ys[j:])])


def _once(x: Item, y: Item) -> Item:
    """Items inside of two neighbours that became one repeated item: they aren't repeated themselves."""
    one = merged(x, y, True)
    one.many = x.many or y.many
    return one


def fold(items: list[Item]) -> list[Item]:
    """Neighbours that are alike become one repeated item; sequences of up to PERIOD items that follow each other become a repeated group."""
    out: list[Item] = []
    for item in items:
        if out and twins(out[-1], item):
            both = out[-1].optional and item.optional
            out[-1] = merged(out[-1], item, True)
            out[-1].optional = both
        else:
            out.append(item)
    for period in range(2, PERIOD + 1):
        i = 0
        while i + 2 * period <= len(out):
            if all(map(twins, out[i : i + period], out[i + period : i + 2 * period])):
                group, end = _group(out[i : i + period]), i + period
                while end + period <= len(out) and all(map(twins, out[i : i + period], out[end : end + period])):
                    group = merged(group, _group(out[end : end + period]), True)
                    end += period
                out[i:end] = [group]
            i += 1
    return out


def described(node: Node) -> Item:
    """The wrapper of one page."""
    if node.sig == "#":
        text = " ".join(node.text.split())
        return Item("#", [], chars=len(text), linked=len(text) * node.linked, texts=(hashlib.md5(text.encode("utf-8", "replace")).hexdigest()[:12],))
    kids = fold([described(k) for k in node.kids if k.sig != "#" or k.text.strip()])
    return Item(node.sig, kids, chars=sum(k.chars for k in kids), linked=sum(k.linked for k in kids))


def named_other(item: Item) -> bool:
    tag, *named = item.sig.split(".")
    return tag in OTHER or not OTHER_WORDS.isdisjoint(named)


class Reader:
    """Reads the pages of one host along its wrapper."""

    def __init__(self, wrapper: Item):
        self.wrapper = wrapper
        self.dropped: set[int] = set()
        self.region: set[int] = set()
        self._choose()

    def _own(self, item: Item) -> int:
        """Characters that aren't linked, and none of what is never the article; texts that differ between pages count, where there are several."""
        if named_other(item):
            return 0
        if not item.kids:
            varied = len(item.texts) > 1 or self.wrapper.pages < 3
            return item.chars - item.linked if varied else 0
        return sum(map(self._own, item.kids))

    def _choose(self) -> None:
        whole = self._own(self.wrapper) or 1
        for says in (lambda i: i.tag == "article", lambda i: i.tag == "main" or "main" in i.sig.split(".")[1:] and i.tag == "div", *(lambda i, w=w: i.tag not in LEAVES and not w.isdisjoint(i.sig.split(".")[1:]) for w in MAIN_WORDS)):
            found = self._outermost(self.wrapper, says)
            if found and 5 * sum(map(self._own, found)) >= whole:
                self.region = {id(x) for x in found}
                return
        at = self.wrapper
        while True:
            inner = [k for k in at.kids if not named_other(k) and 5 * self._own(k) >= 3 * self._own(at)]
            if not inner or inner[0].tag in LEAVES - {"()"} or inner[0].many or not self._own(at):
                break
            at = inner[0]
        self.region = {id(at)}
        self._drop_around(at)

    def _outermost(self, item: Item, says) -> list[Item]:
        if item is not self.wrapper and named_other(item):
            return []
        return [item] if says(item) else [x for k in item.kids for x in self._outermost(k, says)]

    def _drop_around(self, item: Item) -> None:
        """In an element that only its statistics chose: lists of links, and texts that all pages share, aren't the article."""
        for kid in item.kids:
            if kid.chars and 10 * kid.linked >= 9 * kid.chars or self.wrapper.pages >= 3 and kid.pages >= 3 and kid.chars and not self._own(kid) and not kid.many:
                self.dropped.add(id(kid))
            else:
                self._drop_around(kid)

    def text(self, page: Node) -> str:
        self.blocks: list[str] = []
        self.open: list[str] = []
        self._read(page, self.wrapper, id(self.wrapper) in self.region, False)
        self._end()
        return "\n".join(self.blocks)

    def _end(self) -> None:
        block = " ".join("".join(self.open).split())
        self.open = []
        if block:
            self.blocks.append(block)

    def _read(self, node: Node, item: Item | None, inside: bool, headings_only: bool) -> None:
        along = Along(item.kids) if item else None
        for kid in node.kids:
            part = along.next(kid) if along else None
            if kid.sig == "#":
                if inside and not headings_only and not (part and id(part) in self.dropped):
                    self.open.append(html.unescape(kid.text))
                continue
            dropped = kid.other or part is not None and id(part) in self.dropped
            header = kid.other and inside and (kid.tag == "header" or not HEADER_WORDS.isdisjoint(kid.sig.split(".")[1:]))
            if dropped and not header:
                continue
            now = inside or part is not None and id(part) in self.region
            block = kid.tag not in INLINE
            if block:
                self._end()
            self._read(kid, part, now, header or headings_only and kid.tag not in HEADINGS)
            if block:
                self._end()


class Along:
    """Finds the item of a wrapper that each child of an element stands for, left to right."""

    def __init__(self, items: list[Item]):
        self.flat: list[Item] = []
        self.group: list[int] = []  # where the repeated group of each item begins
        self._flatten(items, -1)
        self.at = -1

    def _flatten(self, items: list[Item], begin: int) -> None:
        for item in items:
            if item.sig == "()":
                self._flatten(item.kids, len(self.flat) if item.many else begin)
            else:
                self.flat.append(item)
                self.group.append(begin)

    def next(self, node: Node) -> Item | None:
        if node.sig == "#" and not node.text.strip():
            return None
        at, again = self.at, self.at if self.at < 0 else self.group[self.at]
        ahead = [at] if at >= 0 and self.flat[at].many else []
        places = [*ahead, *range(at + 1, len(self.flat)), *(range(again, at + 1) if again >= 0 else ())]
        for fits in (twins, likeness, lambda x, y: x.sig == y.sig):
            for i in places:
                if fits(node, self.flat[i]):
                    self.at = i
                    return self.flat[i]
        return None


def read_page(page: str | None, reader: Reader | None) -> str:
    """The main text; a page of which its host's wrapper keeps nothing is read by a wrapper of its own."""
    if not page:
        return ""
    tree = parse(page)
    return (reader.text(tree) if reader else "") or Reader(described(tree)).text(tree)


def host_of(url: str = "url") -> Column:
    """The host of an address, lower-cased; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _same(x: str, y: str) -> str:
    return json.dumps(_summed(Item.of(json.loads(x)), Item.of(json.loads(y))).packed(), separators=(",", ":"))


def _summed(x: Item, y: Item) -> Item:
    """Two wrappers of the same structure."""
    return Item(x.sig, list(map(_summed, x.kids, y.kids)), x.optional, x.many, x.chars + y.chars, x.linked + y.linked, x.pages + y.pages, tuple(sorted({*x.texts, *y.texts})[:TEXTS]))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[tuple[str, str], Item] = {}

    def out() -> pa.RecordBatch:
        rows = [(host, hashlib.md5(s.encode("utf-8", "replace")).hexdigest(), json.dumps(x.packed(), separators=(",", ":"))) for (host, s), x in kept.items()]
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], pa.string()) for i in range(3)], ["host", "structure", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = page.as_py()
            if text:
                item = described(parse(text))
                key = (host, structure(item))
                kept[key] = _summed(kept[key], item) if key in kept else item
        if len(kept) > KEPT:
            yield out()
    yield out()


def wrappers(pages: DataFrame) -> DataFrame:
    """One row for each host with pages: host, pages, wrapper (JSON), regex (the same, to be read). No pages, or only null and empty ones: no rows."""
    found = map_texts(pages.select(host_of().alias("host"), "html"), _described, "host string, structure string, wrapper string")
    distinct = found.rdd.map(lambda r: ((r[0], r[1]), r[2])).reduceByKey(_same)
    distinct = checkpointed(pages.sparkSession.createDataFrame(distinct.map(lambda x: (*x[0], x[1])), "host string, structure string, wrapper string", verifySchema=False)).rdd
    most = distinct.map(lambda r: (r[0], 1)).reduceByKey(lambda x, y: x + y).map(lambda x: x[1]).fold(0, max)
    rounds = 0
    while FAN**rounds < most:
        rounds += 1

    def placed(r: tuple, buckets: int) -> tuple:
        return (r[0], int(r[1], 16) % buckets), (r[1], r[2])

    level = distinct.map(lambda r, n=FAN**rounds: placed(r, n))
    for _ in range(rounds + 1):
        level = level.groupByKey().map(lambda x: ((x[0][0], x[0][1] // FAN), (f"{x[0][1]:032x}", _aligned(x[1]))))
    rows = level.map(lambda x: (x[0][0], *(lambda w: (w.pages, x[1][1], w.regex()))(Item.of(json.loads(x[1][1])))))
    return pages.sparkSession.createDataFrame(rows, "host string, pages long, wrapper string, regex string", verifySchema=False)


def _aligned(found) -> str:
    first, *others = [w for _, w in sorted(found)]
    if not others:
        return first
    item = Item.of(json.loads(first))
    for other in others:
        item = merged(item, Item.of(json.loads(other)))
    return json.dumps(item.packed(), separators=(",", ":"))


def main_texts(pages: DataFrame, sent: int | None = None) -> DataFrame:
    """The article of each page: page_id, url, text, n_chars (code points).

    sent: hosts whose wrappers are sent to all tasks, those with the most pages (SENT). Null and empty pages have
    an empty text. Pages without a host share one wrapper. Repeated rows are read each; texts are kept whole; other
    columns are ignored. No pages give no rows.
    """
    spark, sent = pages.sparkSession, SENT if sent is None else sent
    found = checkpointed(wrappers(pages).select("host", "pages", "wrapper"))
    small = found.where(F.length("wrapper") <= LONGEST).orderBy(F.desc("pages"), "host").limit(sent).collect()
    by_host = spark.sparkContext.broadcast({r.host: r.wrapper for r in small})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Reader] = {}
        for batch in batches:
            texts = []
            for host, page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
                if host not in readers:
                    if len(readers) >= SENT:
                        readers.clear()
                    packed = wrapper or by_host.value.get(host)
                    readers[host] = Reader(Item.of(json.loads(packed))) if packed else None
                texts.append(read_page(page.as_py(), readers[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", host_of().alias("host"), "html")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long"
    hosts = [r.host for r in small]
    near = map_texts(rows.where(F.col("host").isin(hosts)).withColumn("wrapper", F.lit(None).cast("string")), run, schema)
    far = rows.where(~F.col("host").isin(hosts)).join(found.select("host", "wrapper"), "host", "left").select("page_id", "url", "host", "html", "wrapper")
    return near.unionByName(map_texts(far, run, schema))
