"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared lower-case with white space collapsed. An item of m characters occurs in a document if
some stretch of it is within k = floor(m / 10) edits (fewer for items so short that the lemma would say nothing).
Such a stretch shares at least m - q + 1 - k q of the item's q-grams on diagonals that span at most k + 1, so shared
q-grams are counted in bands of 2 (k + 1) diagonals, each overlapping the next by half. Bands that reach the bound are
verified by banded alignment. Items shorter than q must occur exactly, between non-word characters.

Items are indexed in blocks of bounded size, one on the driver at a time, and written to the shared folder; tasks read
the documents once and load block after block for some megabytes of text. Documents are never joined with each other. Null and blank items and texts match nothing; repeated items count once; a null item_id or doc_id is
carried through. Every document row is judged by itself, so repeated rows give repeated results.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, hold, map_shared, release, shared_dir, text_of, write_shared

Q, SHARE, BLOCK_CHARS = 8, 0.1, 2_000_000
#: Shared q-grams (places in the text times places in items) that are counted at a time, and characters of text that a
#: task gathers before it goes through the blocks.
HITS, GATHERED = 2_000_000, 16_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def q_grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit code of the q-gram (q = 8) at each position, by doubling."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    h, power, size = codes.astype(np.uint64), _MIX, 1
    with np.errstate(over="ignore"):
        while size < Q:
            h = h[:-size] * power + h[size:]
            power, size = power * power, size * 2
    return h


def edit_budget(m: int) -> int:
    return max(0, min(int(m * SHARE), (m - Q) // Q))


def banded_end(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int]:
    """Least edits of the item against a stretch of text that starts anywhere and stays on diagonals low to high
    (text position minus item position); and where that stretch ends, the first such place. Edits over `most` are only
    known to be so: the least of a row never falls from one row to the next."""
    width, size = high - low + 1, len(item)
    offset = np.arange(width, dtype=np.int32)
    big = np.int32(size + len(text) + 1)
    padded = np.full(size + width, -1, np.int64)
    a, b = max(low, 0), min(low + len(padded), len(text))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    differ = (np.lib.stride_tricks.sliding_window_view(padded, width)[:size] != item.astype(np.int64)[:, None]).astype(np.int32)
    place = offset + low
    row = np.where((place >= 0) & (place <= len(text)), np.int32(0), big)
    edge = low < 0 or high + size > len(text)
    for i in range(size):
        step = row + differ[i]
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])
        if edge:
            outside = (place + i + 1 < 0) | (place + i + 1 > len(text))
            step[outside] = big
        row = np.minimum.accumulate(step - offset) + offset
        if edge:
            row[outside] = big
        if i & 7 == 7 and row.min() > most:
            return int(row.min()), low + size
    at = int(row.argmin())
    return int(row[at]), at + low + size


class ItemBlock:
    """The q-gram index of some benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        seen = {}
        for i, t in items:
            if t and (n := normal(t)):
                seen.setdefault((i, n))
        self.items = [(i, n, _codes(n), edit_budget(len(n))) for i, n in seen if len(n) >= Q]
        self.short = [(i, n, re.compile(rf"(?<!\w){re.escape(n)}(?!\w)")) for i, n in seen if len(n) < Q]
        grams = [q_grams(c) for _, _, c, _ in self.items]
        every = np.concatenate([np.zeros(0, np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(every, kind="stable")
        self.codes, self.begin, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order], place[order]
        self.bits = max(16, int(len(self.codes) * 64).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.codes)] = True
        self.k = np.array([k for *_, k in self.items], np.int64)
        size = np.array([len(n) for _, n, _, _ in self.items], np.int64)
        self.least = size - Q + 1 - self.k * Q

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Item and first diagonal of each band that reaches the item's bound."""
        if not len(self.items) or len(codes) < Q:
            return
        grams = q_grams(codes)
        at = np.flatnonzero(self.seen[self._slot(grams)])
        if len(at) < self.least.min():
            return
        found = np.minimum(np.searchsorted(self.codes, grams[at]), len(self.codes) - 1)
        same = self.codes[found] == grams[at]
        at, found = at[same], found[same]
        if not len(at):
            return
        span = len(codes) + int(self.place.max()) + 4
        keys, counts = self._cells(at, found, span)
        # A band is two cells side by side. One that starts at an empty cell holds no hit that the next doesn't hold.
        item, cell = keys // (2 * span), keys % (2 * span) - span
        after = np.zeros(len(keys), np.int64)
        after[:-1] = np.where(np.diff(keys) == 1, counts[1:], 0)
        good = counts + after >= self.least[item]
        for i, c in zip(item[good].tolist(), cell[good].tolist(), strict=True):
            yield i, c * (int(self.k[i]) + 1)

    def _cells(self, at: np.ndarray, found: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Item and cell of diagonals, as one number, and the shared q-grams in it; HITS at a time, as a q-gram that
        repeats in text and item has a hit for each pair of places."""
        total = np.cumsum(self.count[found])
        parts, first = [], 0
        while first < len(at):
            past = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + HITS, "right")))
            own, times = found[first:past], self.count[found[first:past]]
            entry = np.repeat(self.begin[own] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            owner = self.owner[entry]
            cell = (np.repeat(at[first:past], times) - self.place[entry]) // (self.k[owner] + 1)
            parts.append(np.unique(owner * (2 * span) + cell + span, return_counts=True))
            first = past
        if len(parts) == 1:
            return parts[0]
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)

    def matches(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """item_id, start, end (in the normal text) and edits of each verified occurrence, overlapping ones once."""
        own = normal(text)
        codes = _codes(own)
        out = [(i, m.start(), m.end(), 0) for i, _, pattern in self.short for m in pattern.finditer(own)]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for index, diagonal in self.candidates(codes):
            _, item, item_codes, k = self.items[index]
            low, high = diagonal - k, diagonal + 2 * (k + 1) - 1 + k
            exact = own.find(item, max(0, low), max(0, high) + len(item))
            if exact >= 0:
                found.setdefault(index, []).append((0, exact, exact + len(item)))
                continue
            edits, end = banded_end(item_codes, codes, low, high, k)
            if edits <= k:
                found.setdefault(index, []).append((edits, self._start(item_codes, codes, end, edits, k), end))
        for index, places in found.items():
            kept: list[tuple[int, int, int]] = []
            for edits, start, end in sorted(places):
                if all(end <= s or start >= e for _, s, e in kept):
                    kept.append((edits, start, end))
                    out.append((self.items[index][0], start, end, edits))
        return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))

    @staticmethod
    def _start(item: np.ndarray, codes: np.ndarray, end: int, edits: int, k: int) -> int:
        """The start nearest to the item's length of a stretch with these edits that ends at `end`."""
        for off in sorted(range(-k, k + 1), key=abs):
            start = end - len(item) - off
            if start >= 0 and start <= end and _distance(item, codes[start:end]) == edits:
                return start
        return max(0, end - len(item))


def _distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two whole strings."""
    offset = np.arange(len(b) + 1)
    row = offset.copy()
    for i, c in enumerate(a.tolist(), 1):
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (b != c))
        step[0] = i
        row = np.minimum.accumulate(step - offset) + offset
    return int(row[-1])


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[ItemBlock]:
    """The benchmark in blocks of about `limit` characters, one on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // limit))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield ItemBlock(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


_loaded: dict[str, ItemBlock] = {}


def _block(uri: str) -> ItemBlock:
    """A written block; a worker keeps the last one."""
    if uri not in _loaded:
        hold("qgrams", _loaded.clear)
        _loaded.clear()
        _loaded[uri] = pickle.loads(map_shared(uri).tobytes())
    return _loaded[uri]


def _written_blocks(docs: DataFrame, benchmark: DataFrame) -> list[str]:
    folder, out = shared_dir(docs.sparkSession, "benchmark"), []
    for k, block in enumerate(item_blocks(benchmark)):
        out.append(f"{folder}/block-{k}")
        write_shared(out[-1], pickle.dumps(block))
    return out


def _matched(docs: DataFrame, benchmark: DataFrame, text: int, emit, schema) -> DataFrame:
    """emit(batch, matches of each row) over batches of docs, whose column number `text` holds the texts."""
    bounded_batches(docs.sparkSession)
    blocks = _written_blocks(docs, benchmark)

    def go(held):
        texts = [[t or "" for t in b.column(text).to_pylist()] for b in held]
        found = [[[] for _ in ts] for ts in texts]
        for uri in blocks:
            block = _block(uri)
            for ts, rows in zip(texts, found, strict=True):
                for t, row in zip(ts, rows, strict=True):
                    row += block.matches(t)
        for batch, rows in zip(held, found, strict=True):
            yield emit(batch, rows)

    def run(batches):
        release("qgrams")
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(blocks) == 1 or size >= GATHERED:
                yield from go(held)
                held, size = [], 0
        yield from go(held)

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, past (characters of the normal text) and edits of every occurrence of an item."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def emit(batch, found):
        rows = [(i, *m) for i, ms in zip(batch.column(0).to_pylist(), found, strict=True) for m in ms]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "start", "past", "edits"])

    return _matched(own, benchmark, 1, emit, "doc_id long, item_id long, start long, past long, edits int")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item."""
    return _matched(docs, benchmark, docs.columns.index("text"), lambda batch, found: batch.filter(pa.array([not ms for ms in found], pa.bool_())), docs.schema)
