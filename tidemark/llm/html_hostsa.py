"""Main text of web pages, from a suffix array over each host's pages, with page structure as its guard.

A page is parsed into blocks. Inside of an article (or main part) they are content, which repetition never removes;
inside of menus, headers, footers, sidebars, notices, adverts, forms, comments and hidden parts they are boilerplate.
All blocks that aren't content form the page's token stream. The streams of a host are concatenated, and from their
suffix array come the long substrings (RUN tokens at least) that distinct pages share. What they cover is removed on
every page. Of what is left, structure then drops the blocks that it knows for boilerplate; the unique runs of those it
leaves open, on pages without an article element, stay.

A host of more than CHUNK_CHARS is dealt to chunks, each with an array of its own; windows of RUN tokens that none of
them found repeated are then told apart over the host's chunks by their codes. A shared substring is the union of its
windows, so both find the same. Streams hold no article text, and equal rows are read once.

Null html is empty and gives the empty text. A null url has the empty host. Rows that share a page_id are one page when
repetition is judged, and keep their own text; a null page_id is told apart by url and html. An empty table gives an
empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, bounded_batches, chunks_by_bytes, salted_join, through_table

RUN = 5
#: Characters of the streams that one suffix array is built over.
CHUNK_CHARS = 400_000
CONTENT, BOILERPLATE, OPEN = 0, 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object", "select", "canvas", "video", "audio"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_DROPPED = {"nav", "aside", "footer", "form", "dialog", "button", "menu", "head", "label", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "alerts", "newsletter", "subscribe", "signup", "social", "share", "sharing", "related", "comment", "comments", "reply", "replies", "discussion", "disqus", "popup", "modal", "widget", "pagination", "pager", "toolbar"}
_ARTICLES = {"article", "articlebody", "post", "entry", "story", "content", "maincontent", "main"}
_ABOUT = {"has", "with", "no", "without", "is"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t\r") else {}


def _is_boilerplate(tag: str, attributes: dict[str, str], in_root: bool) -> bool:
    if tag in _DROPPED or tag == "header" and not in_root:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    return tag not in ("article", "main") and not _NAMES.isdisjoint(_names(attributes))


def _names(attributes: dict[str, str]) -> set[str]:
    """Words of class names and of the id, without names that only say that something is there or not."""
    own = [_WORD.findall(n) for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()]
    return {w for words in own if words and words[0] not in _ABOUT for w in words}


def _is_article(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element says that it is the main part."""
    return tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"


def _is_named_article(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a class name or id suggests it; such an element doesn't settle what stands outside of it."""
    return bool(attributes) and tag in ("div", "section", "td") and not _ARTICLES.isdisjoint(_names(attributes))


class _Page:
    """The open elements of a page, and the text of the block at hand by the state of its parts."""

    def __init__(self):
        self.out: list[tuple[int, str]] = []
        self.held: dict[int, list[str]] = {}
        self.stack: list[tuple[str, bool, bool]] = []  # tag, inside boilerplate, inside an article
        self.blocks: Counter = Counter()  # open block elements
        self.inline: list[Counter] = [Counter()]  # open inline elements, by the block that holds them
        self.rooted = False

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def add(self, text: str) -> None:
        bad, root = self.state()
        self.held.setdefault(BOILERPLATE if bad else CONTENT if root else OPEN, []).append(text)

    def flush(self) -> None:
        """End the block; parts of one state are one text, even around an inline part of another."""
        for state, parts in self.held.items():
            if text := " ".join("".join(parts).split()):
                self.out.append((state, text))
        self.held = {}

    def push(self, tag: str, bad: bool, root: bool) -> None:
        self.stack.append((tag, bad, root))
        if tag in _BLOCKS:
            self.blocks[tag] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        if tag in _BLOCKS:
            self.blocks[tag] -= 1
            self.inline.pop()
        else:
            self.inline[-1][tag] -= 1
        return tag

    def end(self, tag: str) -> None:
        """Close the nearest such element and what it holds; an inline one never reaches out of its block."""
        if (self.blocks if tag in _BLOCKS else self.inline[-1])[tag] > 0:
            while self.pop() != tag:
                pass

    def end_implied(self, tag: str) -> None:
        """Close a paragraph, or an item, that the start of a block element ends."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == "p" or name in _CLOSES.get(tag, ()):
                while len(self.stack) > k:
                    self.pop()
                return
            if name in _BLOCKS or self.inline[-1].total() == 0:
                return


def blocks(page: str) -> list[tuple[int, str]]:
    """State and text of each block of a page, in order; white space is collapsed, empty blocks are left out."""
    own, at, size = _Page(), 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            own.add(entities.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ending = tag.lower(), bool(m[1] or m[4])
        if tag in _BLOCKS:
            own.flush()
        if ending:
            own.end(tag)
        elif tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            if tag == "iframe":
                own.flush()
        elif tag not in _VOID:
            if tag in _BLOCKS:
                own.end_implied(tag)
            bad, root = own.state()
            attributes = _attributes(m[3] or m[6] or "")
            bad = bad or _is_boilerplate(tag, attributes, root)
            if not bad and _is_article(tag, attributes):
                root = own.rooted = True
            own.push(tag, bad, root or not bad and _is_named_article(tag, attributes))
    own.flush()
    return [(BOILERPLATE if s == OPEN else s, t) for s, t in own.out] if own.rooted else own.out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes, and the ranks of their first 1, 2, 4, ... tokens, by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    order = np.argsort(rank, kind="stable")
    while step < n and int(rank.max(initial=0)) < n - 1:
        after = np.full(n, -1, np.int64)
        after[:-step] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, step = new, step * 2
        ranks.append(rank)
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Tokens that each suffix shares with the one before it in the order (0 for the first)."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(0, n - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        same &= np.maximum(a, b) + (1 << level) <= n
        a, b, shared = a + same * (1 << level), b + same * (1 << level), shared + same * (1 << level)
    return np.concatenate([[0], shared]) if n else shared


def _streams(rows: list[tuple[int, str, list[str]]]):
    """Words of all pages of a batch, hosts side by side: codes that no two hosts share, page and place of each."""
    codes, pages, places, gap = [], [], [], 0
    for page, host, texts in rows:
        words = [w for t in texts for w in t.split()]
        prefix = host.encode() + b"\0"
        codes += [xxhash.xxh3_64_intdigest(prefix + w.encode()) for w in words]
        gap += 1
        codes.append(gap)  # ends the page: no other token is like it
        pages += [page] * (len(words) + 1)
        places += range(len(words) + 1)
    return np.array(codes, np.uint64), np.array(pages, np.int64), np.array(places, np.int64)


def _run_codes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A code of the RUN tokens from each start."""
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(RUN):
            h = (h ^ codes[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def shared_starts(rows: list[tuple[int, str, list[str]]]) -> tuple[np.ndarray, ...]:
    """Over the (page, host, texts) of one array, for each token of the streams side by side: its code, its page, its
    place in the stream, whether RUN tokens of the stream start there, and whether another page shares them; and of each shared window one
    place, and the lowest and highest page that has it."""
    codes, pages, places = _streams(rows)
    order, ranks = suffix_array(codes)
    shared = common_prefixes(order, ranks)
    ends = np.flatnonzero(codes <= len(rows))  # stream ends have the smallest codes
    whole = ends[np.searchsorted(ends, np.arange(len(codes)))] - np.arange(len(codes)) >= RUN
    order, new = order[whole[order]], (shared < RUN)[whole[order]]
    repeated, known = np.zeros(len(codes), bool), tuple(np.zeros(0, np.int64) for _ in range(3))
    if len(order):
        new[0] = True
        at, page = np.flatnonzero(new), pages[order]
        low, high = np.minimum.reduceat(page, at), np.maximum.reduceat(page, at)
        several = low != high
        repeated[order] = np.repeat(several, np.diff([*at, len(order)]))
        known = order[at[several]], low[several], high[several]
    return codes, pages, places, whole, repeated, known


def spans_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """The maximal stretches that windows of RUN tokens from the sorted starts cover."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > RUN)
    return list(zip(starts[np.concatenate([[0], breaks + 1])].tolist(), (starts[np.concatenate([breaks, [len(starts) - 1]])] + RUN).tolist(), strict=True))


def parsed(pages: DataFrame) -> DataFrame:
    """row (code of the whole row), page (code of its identity), page_id, url, host and blocks of every page."""
    bounded_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("row", F.xxhash64("page_id", "url", "html")).withColumn("page", F.coalesce("page_id", "row"))
    kind = pa.list_(pa.struct([("state", pa.int32()), ("text", pa.string())]))

    def host(url: str | None) -> str:
        try:
            return urlsplit(url or "").netloc.lower()
        except ValueError:
            return ""

    def run(batch):
        names = ["row", "page", "page_id", "url", "host", "blocks"]

        def build(rows):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def rows():
            for row, page, i, url, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                yield row, page, i, url, host(url), [{"state": s, "text": t} for s, t in merged(blocks(text or ""))]

        return chunks_by_bytes(rows(), lambda r: 64 + sum(len(b["text"]) for b in r[5]), build)

    return arrow_map(own.select("row", "page", "page_id", "url", "html"), run, "row long, page long, page_id long, url string, host string, blocks array<struct<state: int, text: string>>")


def merged(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Neighbouring blocks of one settled state as one."""
    out: list[tuple[int, list[str]]] = []
    for state, text in found:
        if out and state != OPEN and out[-1][0] == state:
            out[-1][1].append(text)
        else:
            out.append((state, [text]))
    return [(s, " ".join(t)) for s, t in out]


_FOUND = "row long, page long, first int, past int, run long"


def _array_rows(group: list[tuple], chunks: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of one chunk (row, page, host, texts): shared substrings as row, page, first and past; and of a host of several
    chunks the windows that aren't shared here, as row, page, first and their code, and those that are, without a row."""
    rows = np.array([g[0] for g in group], np.int64)
    codes, pages, places, whole, repeated, known = shared_starts([(g[1], g[2], g[3]) for g in group])
    owner = np.cumsum(places == 0) - 1
    edges = np.searchsorted(owner, np.arange(len(rows) + 1))
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        found = spans_of(places[a:b][repeated[a:b]])
        if found:
            yield rows[k], pages[a], found, None
    if chunks > 1:
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            single = np.flatnonzero(whole[a:b] & ~repeated[a:b])
            if len(single):
                yield rows[k], pages[a], [(int(s), int(s) + RUN) for s in single], _run_codes(codes, a + single)
        for page in known[1:]:
            for c, p in zip(_run_codes(codes, known[0]), page, strict=True):
                yield None, p, [(0, RUN)], np.array([c])


def shared_spans(parsed_pages: DataFrame) -> DataFrame:
    """row, page and spans (first and past token of the stream) of what distinct pages of a host share."""
    outside = F.transform(F.filter("blocks", lambda b: b["state"] != CONTENT), lambda b: b["text"])
    own = parsed_pages.select("row", "page", "host", outside.alias("texts")).where("size(texts) > 0")
    sized = own.groupBy("row", "page").agg(F.first("host").alias("host"), F.first("texts").alias("texts"))
    sized = through_table(sized.withColumn("chars", F.char_length(F.array_join("texts", " "))), "streams")
    hosts = through_table(sized.groupBy("host").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n")), "hosts")
    chunks = hosts.select("host", F.ceil(F.col("chars") / CHUNK_CHARS).cast("int").alias("chunks"), "n")
    dealt = salted_join(sized, through_table(chunks, "chunks"), "host", "n").withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), "chunks"))
    dealt = dealt.select("row", "page", "host", "texts", "chunks", "chunk").repartition("host", "chunk").sortWithinPartitions("host", "chunk", "row")

    def run(batches):
        def build(rows):
            columns = ([], [], [], [], [])
            for row, page, spans, codes in rows:
                columns[0].extend([row] * len(spans))
                columns[1].extend([page] * len(spans))
                columns[2].extend(s for s, _ in spans)
                columns[3].extend(e for _, e in spans)
                columns[4].extend([None] * len(spans) if codes is None else codes.tolist())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["row", "page", "first", "past", "run"])

        def groups():
            held, now = [], None
            for batch in batches:
                for row, page, host, texts, count, chunk in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    if now is not None and now[:2] != (host, chunk):
                        yield from _array_rows(held, now[2])
                        held = []
                    now = (host, chunk, count)
                    held.append((row, page, host, texts))
            if held:
                yield from _array_rows(held, now[2])

        yield from chunks_by_bytes(groups(), lambda r: 40 * len(r[2]), build, 4 << 20)

    found = through_table(dealt.mapInArrow(run, _FOUND), "shared-substrings")
    windows = found.where("run is not null")
    again = through_table(windows.groupBy("run").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.count(F.lit(1)).alias("n")).where("low != high").select("run", "n"), "shared-windows")
    across = salted_join(windows, again, "run", "n").where("row is not null").select("row", "page", "first", "past")
    either = found.where("run is null").select("row", "page", "first", "past").unionAll(across)
    return either.groupBy("row", "page").agg(F.collect_set(F.struct("first", "past")).alias("spans"))


def kept_text(found: list[tuple[int, str]], spans: list[tuple[int, int]]) -> str:
    """The text of a page after its host's arrays: outside of articles, tokens of shared substrings go, whatever block
    they stand in. Then structure is checked: what the arrays leave there stays in open blocks only, and articles are
    whole, even where pages share their passages."""
    covered = {k for first, past in spans for k in range(first, past)}
    out, at = [], 0
    for state, text in found:
        if state == CONTENT:
            out.append(text)
            continue
        words = text.split()
        unique = [w for k, w in enumerate(words, at) if k not in covered]
        if state == OPEN:
            out += unique
        at += len(words)
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_shared of every page: the last counts the tokens outside of articles that the
    arrays found on other pages of the host, which is why they are not in the text.

    Every page meets its spans in one shuffle. Pages are parsed for the streams and again for the texts, as a table of
    parsed pages would take as much disk as that shuffle once more.
    """
    found = parsed(pages)
    met = found.join(shared_spans(found), ["row", "page"], "left").select("page_id", "url", "blocks", "spans")

    def run(batch):
        rows = [([(b["state"], b["text"]) for b in own], [(x["first"], x["past"]) for x in at or []]) for own, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        shared = [len({k for first, past in spans for k in range(first, past)}) for _, spans in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([kept_text(*r) for r in rows], pa.string()), pa.array(shared, pa.int64())], names=["page_id", "url", "text", "n_shared"])

    texts = arrow_map(met, run, "page_id long, url string, text string, n_shared long")
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")


def boilerplate_report(pages: DataFrame) -> DataFrame:
    """host, pages, tokens outside of articles, how many of them the host's suffix array finds shared, and the pages
    that have such tokens."""
    found = through_table(parsed(pages), "parsed-pages")
    words = F.aggregate(F.filter("blocks", lambda b: b["state"] != CONTENT), F.lit(0), lambda n, b: n + F.size(F.split(b["text"], " ")))
    spans = shared_spans(found)
    covered = spans.select("row", "page", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["past"] - 1))))).alias("shared"))
    each = found.select("row", "page", "host", words.alias("outside")).join(covered, ["row", "page"], "left")
    return each.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("outside").alias("outside_tokens"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared_tokens"), F.count("shared").alias("pages_with_shared"))
