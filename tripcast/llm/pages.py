"""Main text of web pages by site style trees (Yi, Liu and Li, 2003).

The DOMs of one host are merged: nodes with the same path of tags, classes and
ids are one node of the site's tree. A node is important if it is presented in
many ways (the entropy of its sequences of children over the pages) or holds
different content on different pages (one minus the entropy of its texts over
the pages). Branches of low importance are removed from each page. Texts also go, node by
node, if their words tell little: a word's importance is one minus its entropy over the
pages of the site, and a node's text is measured by that of the whole site. Pages that share all
texts not marked off count once, so copies of an article don't look like a template.
Elements that HTML itself marks as no part of the article go by their names, which
also serves hosts with too few pages to compare.
"""

from __future__ import annotations

import html
import marshal
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.llm.arrow import long_rows, numbers

LOW = 0.4           # branches of less importance are removed
USUAL = 0.85        # texts go whose words tell less than this share of what the site's words do
MIN_PAGES = 10      # pages of a node before its importance is trusted
PART_BYTES = 4 << 20      # html of a host that is counted at a time
BUCKET_PARTS = 4          # parts whose counts would fill one bucket of styles, texts and words
TASK_BYTES = 64 << 20     # html that one task counts in all
GAMMA = 0.9         # weight of what lies below a node, as in the paper

# Elements by their role in HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var"}
NOT_TEXT = {
    "nav", "footer", "aside", "form", "button", "select", "svg", "dialog", "menu", "object", "canvas", "audio",
    "video", "head", "math"} | RAW
MAIN = {"article", "main"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
    "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"ul", "ol", "dl", "table", "select", "article", "main", "body", "html"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "overlay", "popup", "promo", "promotion", "related", "recommended",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}

COMMENTS = {"comment", "comments", "disqus"}     # often most of a page's text, and never around the article

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^<>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    """Running text between two block borders and where it stands."""

    text: str
    paths: tuple[int, ...]     # hashed paths of the nodes around it, outermost first
    marks: tuple[int, ...]     # marked elements around it, outermost first
    in_main: bool
    named_off: bool = False    # in an element whose name or class says it is no article text


@dataclass
class Mark:
    """An element that goes by its name, unless it turns out to wrap the article."""

    sure: bool                 # HTML itself says so, not a word of a class or id or a form
    wide: bool                 # a form, or its names are parts of longer ones: 'has-sidebar'
    around: tuple[int, ...]
    has_main: bool = False
    articles: int = 0


@dataclass
class Node:
    tag: str
    path: int
    marks: tuple[int, ...]
    in_main: bool
    inline: bool
    children: list[str] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def _named_off(tag: str, found: dict[str, str], in_main: bool) -> tuple[bool, bool] | None:
    """Of an element that its name, role, class or id marks off: ``sure, wide`` of its ``Mark``."""
    sure = True, False
    if tag in NOT_TEXT - {"form"} or (tag == "header" and not in_main):
        return sure
    form = (False, True) if tag == "form" else None
    if not found or tag in MAIN and "comment" not in found.get("class", "").lower() or tag in ("html", "body"):
        return form
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return sure
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return sure
    source = f"{found.get('class', '')} {found.get('id', '')}".lower()
    names = set(WORDS.split(source))
    off = names & (NAMES if in_main or tag in ("h1", "h2", "h3") else NAMES | {"header"})
    if not off:
        return form
    return tag in MAIN or tag in INLINE, not (off & set(source.split()) or off & COMMENTS)


def _settle(blocks: list[Block], marks: list[Mark]) -> None:
    """Set ``named_off``. A mark that is not sure is lifted, inner ones first, if
    its element holds the main element, or, on a page without an article elsewhere,
    the only article or, as a wide one, at least half of the text not marked off."""
    lifted: set[int] = set()

    def left(b: Block) -> list[int]:
        return [m for m in b.marks if m not in lifted]

    for e in range(len(marks) - 1, -1, -1):
        mark = marks[e]
        if mark.sure or not (mark.wide or mark.has_main or mark.articles):
            continue
        inside, outside, elsewhere = 0, 0, False
        free = {e, *(m for m in mark.around if not marks[m].sure)}
        for b in blocks:
            if free.issuperset(left(b)):
                if e in b.marks:
                    inside += len(b.text)
                else:
                    outside += len(b.text)
                    elsewhere = elsewhere or b.in_main
        if inside and (mark.has_main or not elsewhere and (mark.articles == 1 or mark.wide and inside >= outside)):
            lifted.add(e)
    for b in blocks:
        b.named_off = bool(left(b))


def parse(source: str) -> tuple[list[Block], dict[int, list[str]]]:
    """Blocks of a page in order, and for each node path the tags of its children."""
    blocks: list[Block] = []
    styles: dict[int, list[str]] = {}
    marks: list[Mark] = []
    stack = [Node("", 0, (), False, False)]
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(text, tuple(n.path for n in stack[1:] if not n.inline), top.marks, top.in_main))

    def close(depth: int) -> None:
        while len(stack) > depth:
            if not stack[-1].inline or stack[-1].marks != stack[-2].marks:
                flush()
            stack.pop()

    def close_open(tags: set[str], stop: set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                close(depth)
                return
            if stack[depth].tag in stop:
                return

    at, size = 0, len(source)
    while at < size:
        m = TOKEN.search(source, at)
        if not m:
            run.append(source[at:])
            break
        if m.start() > at:
            run.append(source[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "p" or tag in CLOSES_P:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if stack[depth].tag in MAIN and tag not in ("body", "html"):
                    break
            continue
        rest = m[3] if m[2] else m[6]
        top = stack[-1]
        if tag in VOID:
            if tag == "br" or tag == "hr":
                run.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            close_open({"p"}, CONTAINERS | {"div", "section", "td", "th", "li"})
        if tag in SIBLINGS:
            close_open(SIBLINGS[tag], CONTAINERS)
        top = stack[-1]
        found = _attributes(rest) if rest.strip(" /\t\r\n") else {}
        off = _named_off(tag, found, top.in_main)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            if end is None:
                break
            close_at = source.find(">", end.start())
            at = size if close_at < 0 else close_at + 1
            continue
        inline = tag in INLINE
        if not inline or off:
            flush()
        own = top.marks
        if off:
            own = (*own, len(marks))
            marks.append(Mark(*off, top.marks))
        elif tag in MAIN:
            for m in own:
                marks[m].has_main |= tag == "main"
                marks[m].articles += tag == "article"
        if inline:
            if off:
                stack.append(Node(tag, top.path, own, top.in_main, True))
            continue
        sign = f"{tag}.{DIGITS.sub('#', found.get('class', ''))}#{DIGITS.sub('#', found.get('id', ''))}"
        children = styles.setdefault(top.path, [])
        if not children or children[-1] != sign:       # a run of like siblings is one
            children.append(sign)
        path = xxhash.xxh64_intdigest(f"{top.path}/{sign}") >> 1
        styles.setdefault(path, [])
        stack.append(Node(tag, path, own, top.in_main or tag in MAIN, False))
    flush()
    _settle(blocks, marks)
    return blocks, styles


def _hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def host_of(url: Column) -> Column:
    """Host in lower case; pages without one share the host ''."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#:]*)", 1), F.lit("")))


def _packed(blocks: list[Block], signs: dict[int, list[str]]) -> bytes:
    """A page in little room: its texts, a line each, the paths and styles of its nodes, and as
    positions among these the parent of each node with text below it and the node of each text."""
    at = {path: i for i, path in enumerate(signs)}
    parents = [-1] * len(at)
    for paths in {b.paths for b in blocks}:
        for above, path in zip(paths, paths[1:]):
            parents[at[path]] = at[above]
    texts = "\n".join(b.text for b in blocks).encode("utf-8", "surrogatepass")
    return zstandard.compress(marshal.dumps((
        texts, array("q", signs).tobytes(), array("q", [_hashed("\n".join(c)) for c in signs.values()]).tobytes(),
        array("i", parents).tobytes(), array("i", [at[b.paths[-1]] if b.paths else -1 for b in blocks]).tobytes())))


def _unpacked(page: bytes) -> tuple[list[tuple[int, int]], list[tuple[bytes, tuple[int, ...]]]]:
    """``path, style`` of the nodes of a packed page, and its texts with the paths around them."""
    texts, *numbers = marshal.loads(zstandard.decompress(page))
    paths, styles, parents, ends = (array(kind, n) for kind, n in zip("qqii", numbers))
    around: dict[int, tuple[int, ...]] = {-1: ()}
    for end in set(ends) - {-1}:
        chain, node = [], end
        while node >= 0:
            chain.append(paths[node])
            node = parents[node]
        around[end] = tuple(reversed(chain))
    return list(zip(paths, styles)), [(text, around[end]) for text, end in zip(texts.split(b"\n"), ends)]


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, mark, page`` of the pages of a task that have text: what ``_count`` needs of a
    page, and a hash of its unmarked texts. Of pages of a host that share it, the first."""
    met: set[tuple[int, int]] = set()
    for batch in batches:
        rows, marks, found = [], [], []
        for i, (host, source) in enumerate(zip(batch.column("host_hash").to_pylist(), batch.column("html"))):
            blocks, signs = parse(source.as_py() or "")
            mark = _hashed("\n".join([b.text for b in blocks if not b.named_off] or [b.text for b in blocks]))
            if blocks and (host, mark) not in met:
                met.add((host, mark))
                rows.append(i)
                marks.append(mark)
                found.append(_packed(blocks, signs))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host").take(pa.array(rows, pa.int64())), pa.array(marks, pa.int64()), pa.array(found, pa.binary())],
            names=["host", "mark", "page"])


STYLE, TEXT, WORD, SITE = range(4)     # kinds of what is counted


def _count(pages: pa.Table) -> pa.Table:
    """``host, kind, key, held, path, n`` over some pages of one host, those with the same
    mark once: of every style, text and word, by its hash, on how many pages each node has it
    (a word: how often) and, once for a word, how many pages hold it. ``SITE`` counts the pages."""
    met: set[int] = set()
    counts: tuple[Counter[tuple[int, int]], ...] = (Counter(), Counter())
    own: dict[int, Counter[str]] = {}
    holders: Counter[str] = Counter()
    for mark, page in zip(pages.column("mark").to_pylist(), pages.column("page")):
        if mark in met:
            continue
        met.add(mark)
        signs, blocks = _unpacked(page.as_py())
        counts[STYLE].update((key, path) for path, key in signs)
        words: dict[int, list[str]] = {}
        texts = set()
        for text, paths in blocks:
            key = xxhash.xxh64_intdigest(text) >> 1
            texts.update((key, path) for path in paths)
            words.setdefault(paths[-1] if paths else 0, []).extend(text.decode("utf-8", "surrogatepass").lower().split())
        counts[TEXT].update(texts)
        for path, said in words.items():
            own.setdefault(path, Counter()).update(said)
        holders.update(set().union(*words.values()))
    parts = [np.array([[SITE], [0], [len(met)], [0], [0]], np.int64)]
    for kind, counted in enumerate(counts):
        key, path = np.array(list(counted), np.int64).reshape(-1, 2).T
        n = np.fromiter(counted.values(), np.int64, len(counted))
        parts.append(np.stack([np.full(len(n), kind), key, np.zeros(len(n), np.int64), path, n]))
    at = {word: i for i, word in enumerate(holders)}
    keys = np.array([_hashed(word) for word in holders], np.int64)
    left = np.fromiter(holders.values(), np.int64, len(holders))      # pages not yet told of a word
    for path, said in own.items():
        ids = np.fromiter(map(at.__getitem__, said), np.int64, len(said))
        n = np.fromiter(said.values(), np.int64, len(said))
        parts.append(np.stack([np.full(len(n), WORD), keys[ids], left[ids], np.full(len(n), path), n]))
        left[ids] = 0
    kind, key, held, path, n = np.concatenate(parts, axis=1)
    host = pa.array([pages.column("host")[0].as_py()], pa.string()).take(pa.array(np.zeros(len(n), np.int64)))
    return pa.table(
        [host, pa.array(kind.astype(np.int32)), *(pa.array(c) for c in (key, held, path, n))],
        names=["host", "kind", "key", "held", "path", "n"])


def _planes(values: np.ndarray) -> bytes:
    """Integers, their lowest bytes first, then all second bytes and so on: equal bytes stand together."""
    return np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _integers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8")[:, 0]


def _dealt(counts: pa.Table, buckets: int) -> pa.Table:
    """``host, bucket, counts``: the rows of ``_count`` dealt by key, those of a bucket in little room.
    A key stands once, as its distance from the one before, with how many nodes and pages have it."""
    kind, key, held, path, n = (numbers(counts, name) for name in ("kind", "key", "held", "path", "n"))
    bucket = key % buckets
    order = np.lexsort((path, key, kind, bucket))
    bucket, kind, key, held, path, n = (c[order] for c in (bucket, kind, key, held, path, n))
    ends = [*np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    packed = []
    for start, end in zip([0, *ends], ends):
        rows = slice(start, end)
        first = np.flatnonzero(np.r_[True, (key[rows][1:] != key[rows][:-1]) | (kind[rows][1:] != kind[rows][:-1])])
        paths, at = np.unique(path[rows], return_inverse=True)
        packed.append(zstandard.compress(marshal.dumps([_planes(c) for c in (
            kind[rows][first], np.diff(key[rows][first], prepend=0), np.diff(first, append=end - start),
            np.add.reduceat(held[rows], first), paths, at, n[rows])])))
    return pa.table(
        [counts.column("host").slice(0, len(ends)), pa.array(bucket[np.array(ends) - 1]), pa.array(packed, pa.binary())],
        names=["host", "bucket", "counts"])


def _count_part(pages: pa.Table) -> pa.Table:
    return _dealt(_count(pages), -(-pages.column("parts")[0].as_py() // BUCKET_PARTS))


SUMS = ["pages", "style_sum", "styles", "texts", "text_sum", "words", "spread_sum", "spread_squares", "site"]


def _add_up(dealt: pa.Table) -> pa.Table:
    """``host, path`` and ``SUMS`` over all keys of one bucket of a host: its counts are those
    of the whole site once the parts are added up by style, text and word."""
    found = [[_integers(c) for c in marshal.loads(zstandard.decompress(b.as_py()))] for b in dealt.column("counts")]
    kind, key, times, held, path, n = (np.concatenate(c) for c in zip(*(
        (kind, np.cumsum(steps), times, held, paths[at], n) for kind, steps, times, held, paths, at, n in found)))
    order = np.lexsort((key, kind))
    new = np.r_[True, (np.diff(key[order]) != 0) | (np.diff(kind[order]) != 0)]
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    kind, held = kind[order][new], np.bincount(ids, held)
    paths, at = np.unique(path, return_inverse=True)
    pairs, place = np.unique(np.repeat(ids, times) * len(paths) + at, return_inverse=True)
    ids, at = np.divmod(pairs, len(paths))
    n, kind, held = np.bincount(place, n), kind[ids], held[ids]
    n_log, spread = n * np.log(np.maximum(n, 1)), np.log(np.maximum(held, 1))

    def of(chosen: int, value: np.ndarray) -> pa.Array:
        return pa.array(np.bincount(at, np.where(kind == chosen, value, 0.0), len(paths)))

    return pa.table(
        [pa.array([dealt.column("host")[0].as_py()] * len(paths), pa.string()), pa.array(paths), of(STYLE, n), of(STYLE, n_log),
         of(STYLE, np.ones(len(n))), of(TEXT, n), of(TEXT, n_log), of(WORD, n), of(WORD, n * spread),
         of(WORD, n * spread * spread), of(SITE, held)], names=["host", "path", *SUMS])


def importance(pages: DataFrame, url_column: str, html_column: str) -> DataFrame:
    """``host, path, pages, importance, words, word_importance, word_error, usual`` of every
    node of the site trees.

    ``importance`` is that of the branch, from its styles and whole texts. ``word_importance``
    is that of the text a node holds itself: the mean over its words of one minus the
    entropy of the word over the site's pages, with its standard error; ``usual`` is the mean of the site,
    its nodes weighted by words and importance. Words are those between white space, in
    lower case. The word columns but ``usual`` are null where a node holds no text.

    All counts are those of the whole site. The pages of a host are dealt by their texts into
    parts of about ``PART_BYTES``; a task counts in a part, and the counts of the parts are dealt
    into buckets by style, text or word and added up there before any entropy is taken. So a host with a third
    of the pages is no hot group, and where the parts lie changes nothing. Pages and counts travel
    packed, and only these two are on disk.
    """
    sized = pages.select(host_of(F.col(url_column)).alias("host"), F.col(html_column).alias("html"))
    sizes = stored(sized.groupBy("host").agg(F.sum(F.octet_length("html")).alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    large = sizes.filter(F.col("size") > PART_BYTES).select(
        "host", F.ceil(F.col("size") / F.lit(PART_BYTES)).cast("long").alias("parts"))
    parsed = sized.filter(F.octet_length("html") > 0).select("host", F.xxhash64("host").alias("host_hash"), "html").mapInArrow(
        _parsed, "host string, mark long, page binary")
    parts = F.coalesce("parts", F.lit(1))
    dealt = parsed.join(large, "host", "left").select(
        "host", F.pmod(F.xxhash64("mark"), parts).alias("part"), parts.alias("parts"), "mark", "page")
    counted = dealt.repartition(tasks, "host", "part").groupBy("host", "part").applyInArrow(
        _count_part, "host string, bucket long, counts binary")
    added = counted.repartition(tasks, "host", "bucket").groupBy("host", "bucket").applyInArrow(
        _add_up, f"host string, path long, {', '.join(f'{name} double' for name in SUMS)}")
    sums = stored(added.groupBy("host", "path").agg(*(F.sum(name).alias(name) for name in SUMS)), "nodes")
    site = sums.groupBy("host").agg(F.sum("site").alias("site"))
    seen, whole = F.log(F.greatest("pages", F.lit(2.0))), F.log(F.greatest("site", F.lit(2.0)))
    sums = sums.drop("site").join(site, "host").withColumns({
        "style_sum": F.col("style_sum") / seen, "text_sum": F.col("text_sum") / seen,
        "spread_sum": F.col("spread_sum") / whole, "spread_squares": F.col("spread_squares") / (whole * whole)})
    held, words, spreads = F.col("words") > 0, F.col("words"), F.col("spread_sum")
    sites = sums.filter(held).groupBy("host").agg(
        F.sum(words - spreads).alias("told"), F.sum((words - spreads) * (words - spreads) / words).alias("told_squares"))
    mean = spreads / words
    error = F.sqrt(F.greatest(F.col("spread_squares") / words - mean * mean, F.lit(0.0)) / words)
    presented = 1 - F.col("style_sum") / F.greatest("pages", F.lit(1.0))
    content = F.when(F.col("texts") > 0, 1 - F.col("text_sum") / F.col("texts")).otherwise(0.0)
    below = F.pow(F.lit(GAMMA), F.col("styles"))
    return sums.join(sites, "host").select(
        "host", "path", "pages", F.when(F.col("styles") <= 1, content).otherwise(
            (1 - below) * presented + below * content).alias("importance"),
        "words", F.when(held, 1 - mean).alias("word_importance"), F.when(held, error).alias("word_error"),
        F.when(F.col("told") > 0, F.col("told_squares") / F.col("told")).otherwise(0.0).alias("usual"))


def low_nodes(nodes: DataFrame, low: float = LOW, usual: float = USUAL, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, low, own`` from the nodes of ``importance``: paths of branches of low
    importance, and of nodes whose own text says little, surely less (by two standard
    errors) than the share ``usual`` of what the site's text does."""
    branch = F.col("importance") < low
    own = F.col("word_importance") + 2 * F.col("word_error") < usual * F.col("usual")
    return nodes.filter((F.col("pages") >= min_pages) & (branch | F.coalesce(own, F.lit(False)))).groupBy("host").agg(
        F.collect_list(F.when(branch, F.col("path"))).alias("low"), F.collect_list(F.when(own, F.col("path"))).alias("own"))


def main_blocks(
    source: str, low: set[int], own: set[int] = frozenset(), names: bool = True,
) -> list[str]:
    """The texts of a page that stay without the branches ``low`` and the texts of the nodes
    ``own``. Article and main elements choose only where they hold at least half of the
    unmarked text: alone if the site tree names nothing, and if the article itself would go
    with what it names. Without ``names`` the site tree alone decides."""
    blocks = [b for b in parse(source)[0] if not (names and b.named_off)]
    kept = [b for b in blocks if low.isdisjoint(b.paths) and not (b.paths and b.paths[-1] in own)]
    inside = [b for b in blocks if names and b.in_main]
    if 2 * sum(len(b.text) for b in inside) < sum(len(b.text) for b in blocks):
        inside = []
    if inside and (not (low or own) or not any(b.in_main for b in kept)):
        kept = inside
    return [b.text for b in kept or blocks]


def _extract(names: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            "\n".join(main_blocks(source.as_py() or "", set(low.as_py() or ()), set(own.as_py() or ()), names))
            for source, low, own in zip(batch.column(2), batch.column(3), batch.column(4))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])


def extract(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    low: float = LOW, min_pages: int = MIN_PAGES, usual: float = USUAL, names: bool = True,
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, repeated ones included.

    Blocks of the main text are joined by a line break; white space within one is
    a single space. Null, empty or textless pages give an empty text. A null url
    belongs to the host ''. Broken markup is read as far as it goes: an unclosed
    tag or comment ends the text. Other columns are not read. Without ``names`` tags,
    classes and ids count for nothing and the site tree alone decides.
    """
    some = long_rows(pages).select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"),
        F.col(html_column).alias("html"))
    weak = stored(low_nodes(importance(some, "url", "html"), low, usual, min_pages), "weak")
    host = some.withColumn("host", host_of(F.col("url")))
    return host.join(weak, "host", "left").select("page_id", "url", "html", "low", "own").mapInArrow(
        partial(_extract, names), "page_id long, url string, text string, n_chars long")
