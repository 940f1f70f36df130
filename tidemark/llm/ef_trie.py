"""Language-model scoring with an Elias-Fano n-gram trie.

Words are the ASCII-lower-case stretches without white space, and every text ends with one end token. Level 1 holds
the words' 64-bit hashes in order, with their exact counts as a monotone running sum. A level n above it holds, for
each context (a node of level n - 1, named by its place), a monotone pointer to its first following word, and the
followers' ids made monotone over all contexts, both Elias-Fano coded; the nodes' counts as a running sum; and each
node's smoothed log10 probability and each context's back-off weight, quantised to 16 bits. Queries take a context's
two pointers, then search the successor of the word between them, relative to the context.

Probabilities are interpolated: p(w) = (c + 0.1) / (N + 0.1 (V + 1)), and above it absolute discounting,
p(w | h) = max(c(hw) - D, 0) / c(h) + weight(h) p(w | h'), where weight(h) is what the kept followers leave. An n-gram
is kept if it occurs LEAST_COUNT times, at any size of corpus, whatever its words. So the n-gram without its first or
its last word is kept too, and a word that occurs less often is in none. The order is a parameter, at least 2.

Counts are combined in each task, then packed and shuffled by a hash of the n-gram, and combined again. Every level is
cut into shards by ranges of contexts that hold about equal numbers of n-grams; a context's kept followers stay together
and have to fit a task. Tasks write shards to the shared folder; counting and scoring tasks memory-map them.

Null is the empty text: one end token. Rows are independent when scored; repeated training rows count again. A null
doc_id is not held out. With no training rows every word is unknown. Only doc_id and text are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, bounded_batches, chunks_by_bytes, map_shared, release, shared_dir, text_of, through_table, write_shared
from ._labels import held_out
from .elias_fano import EliasFano

FOLDS, HELD = 10, 0
ORDER, DISCOUNT, LEAST_COUNT = 3, 0.75, 2
SHARD_ROWS = 1 << 20
_STEP = 1 / 4000
_END = b"\n"
_P = np.uint64(0x9E3779B97F4A7C15)


def quantised(log10: np.ndarray) -> np.ndarray:
    """Log probabilities (at most 0) as 16-bit steps."""
    return np.clip(np.rint(-log10 / _STEP), 0, 65535).astype(np.uint16)


def _bits(rows: int) -> int:
    """log2 of the number of shards, at least two shards."""
    return max(1, (max(1, rows - 1) // SHARD_ROWS).bit_length())


def _join(*parts: bytes) -> bytes:
    """Parts with their sizes, each aligned to eight bytes."""
    out = [struct.pack("<Q", len(parts)), struct.pack(f"<{len(parts)}Q", *map(len, parts))]
    for p in parts:
        out += [p, bytes(-len(p) % 8)]
    return b"".join(out)


def _parts(data: np.ndarray) -> list[np.ndarray]:
    n = struct.unpack("<Q", data[:8].tobytes())[0]
    sizes = struct.unpack(f"<{n}Q", data[8 : 8 + 8 * n].tobytes())
    out, at = [], 8 + 8 * n
    for size in sizes:
        out.append(data[at : at + size])
        at += size + -size % 8
    return out


# ---------------------------------------------------------------- levels, read


class Words:
    """Level 1 over mapped shards: hash -> id, id -> count."""

    def __init__(self, folder: str, bits: int, starts: list[int], total: int, distinct: int):
        self.folder, self.bits, self.starts, self.total, self.distinct = folder, bits, np.array(starts, np.int64), total, distinct
        self.open: dict[int, tuple[EliasFano, EliasFano]] = {}

    def _part(self, s: int):
        if s not in self.open:
            hashes, counts = _parts(map_shared(f"{self.folder}/words-{s}"))
            self.open[s] = EliasFano.from_bytes(hashes), EliasFano.from_bytes(counts)
        return self.open[s]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 if unknown) and count of each hash."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        for s in np.unique(shard).tolist():
            if self.starts[s + 1] == self.starts[s]:
                continue
            own = np.flatnonzero(shard == s)
            part, sums = self._part(s)
            got = part.find(hashes[own] & np.uint64((1 << (64 - self.bits)) - 1))
            hit = got >= 0
            ids[own[hit]] = got[hit] + self.starts[s]
            before, after = sums.pair(got[hit])
            counts[own[hit]] = after - before
        return ids, counts

    def count(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.starts, ids, "right") - 1
        for s in np.unique(shard).tolist():
            own = np.flatnonzero(shard == s)
            before, after = self._part(s)[1].pair(ids[own] - self.starts[s])
            out[own] = after - before
        return out

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


class Level:
    """Level n over mapped shards: (context, word) -> node, with probability, count, and the contexts' weights. A shard
    is (name, first and last context, nodes); `width` is the number of words."""

    def __init__(self, folder: str, order: int, width: int, shards: tuple):
        self.folder, self.order, self.width, self.shards = folder, order, width, shards
        self.low = np.array([s[1] for s in shards], np.int64)
        self.high = np.array([s[2] for s in shards], np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum([s[3] for s in shards], dtype=np.int64)])
        self.open: dict[int, tuple] = {}

    def _part(self, s: int):
        if s not in self.open:
            p = _parts(map_shared(f"{self.folder}/{self.shards[s][0]}"))
            self.open[s] = (*(EliasFano.from_bytes(x) for x in p[:3]), np.asarray(p[3]).view("<u2"), np.asarray(p[4]).view("<u2"))
        return self.open[s]

    def find(self, context: np.ndarray, which: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs of a context, named by its place in `context`, and a word: node (-1 if there is none) and log10
        probability; and for each context its log10 weight. Contexts and words may be -1."""
        node, log, weight = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.zeros(len(context))
        if not len(self.shards) or not len(context):
            return node, log, weight
        shard = np.searchsorted(self.low, context, "right") - 1
        shard[context > self.high[shard]] = -1
        of_pair = np.where(word >= 0, shard[which], -1)
        order = np.argsort(of_pair, kind="stable") if len(self.shards) > 1 else np.flatnonzero(of_pair >= 0)
        cuts = np.searchsorted(of_pair[order], np.arange(len(self.shards) + 1))
        row = np.zeros(len(context), np.int64)
        for s in np.unique(shard[shard >= 0]).tolist():
            pointers, followers, _, q, weights = self._part(s)
            own = np.flatnonzero(shard == s)
            place = context[own] - self.low[s]
            weight[own] = weights[place] * -_STEP
            pairs = order[cuts[s] : cuts[s + 1]]
            if not len(pairs):
                continue
            first, past = pointers.pair(place)
            row[own] = np.arange(len(own))
            at = row[which[pairs]]
            some = past[at] > first[at]
            pairs, at = pairs[some], at[some]
            got = followers.find((place[at] * self.width + word[pairs]).view(np.uint64), first[at], past[at])
            hit = got >= 0
            node[pairs[hit]] = got[hit] + self.starts[s]
            log[pairs[hit]] = q[got[hit]] * -_STEP
        return node, log, weight

    def pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node and log10 probability of each pair."""
        each, which = _encoded(context)
        return self.find(each, which, word)[:2]

    def count(self, node: np.ndarray) -> np.ndarray:
        out = np.zeros(len(node), np.int64)
        shard = np.searchsorted(self.starts, node, "right") - 1
        for s in np.unique(shard).tolist():
            own = np.flatnonzero(shard == s)
            before, after = self._part(s)[2].pair(node[own] - self.starts[s])
            out[own] = after - before
        return out


class Trie:
    """The levels, each opened where it is first used."""

    def __init__(self, words: Words, levels: list[Level]):
        self.words, self.levels = words, levels


@lru_cache(maxsize=4)
def _opened(key: str, words: tuple, levels: tuple) -> Trie:
    del key
    return Trie(Words(*words[:2], list(words[2]), *words[3:]), [Level(*level) for level in levels])


# ---------------------------------------------------------------- texts


class Tokens:
    """The tokens of a batch of texts: hashes of the distinct ones, and per token its index and its text."""

    def __init__(self, texts: pa.Array):
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
        flat, owner = words.flatten(), pc.list_parent_indices(words).to_numpy()
        filled = pc.greater(pc.binary_length(flat), 0)
        flat, owner = flat.filter(filled).dictionary_encode(), owner[filled.to_numpy(zero_copy_only=False)]
        self.size = np.bincount(owner, minlength=len(texts)) + 1
        names = [*flat.dictionary.cast(pa.large_binary()).to_pylist(), _END]
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)
        self.index = np.full(int(self.size.sum()), len(names) - 1, np.int64)
        self.index[np.arange(len(owner)) + owner] = flat.indices.to_numpy()
        self.text = np.repeat(np.arange(len(texts)), self.size)


def _encoded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order of appearance, and where each key is among them."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy().astype(np.int64)


class Placed:
    """A batch's tokens in the trie, level by level. A state is a distinct context: at level 1 a distinct token."""

    def __init__(self, trie: Trie, tokens: Tokens):
        self.trie, self.tokens = trie, tokens
        self.ids, self.counts = trie.words.find(tokens.hashes)
        self.count = self.counts[tokens.index]
        self.first = np.concatenate([[True], np.diff(tokens.text) > 0]) if len(tokens.index) else np.zeros(0, bool)

    def levels(self, order: int):
        """For n = 2 to order: tokens that have a context at level n - 1 and may have a node at level n, the contexts'
        nodes, which of them each such token has, and its word; the receiver sends back the nodes it found, if any."""
        tokens, width = self.tokens, len(self.ids)
        states, of_token = self.ids, tokens.index
        often = (self.count >= LEAST_COUNT) & ~self.first
        for n in range(2, order + 1):
            at = np.flatnonzero(often)
            state = of_token[at - 1]
            good = (state >= 0) & (states[state] >= 0)
            at, state = at[good], state[good]
            keys, which = _encoded(state * width + tokens.index[at])
            nodes = yield n, at, states, keys // width, self.ids[keys % width], which
            states, of_token = nodes, np.full(len(tokens.index), -1, np.int64)
            of_token[at] = which


# ---------------------------------------------------------------- building


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of longs."""
    h = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c.view(np.uint64)) * _P
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h


def _merged(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of longs in order of their hash, equal ones as one; the last column has their counts, which add up."""
    h = _mixed(columns[:-1])
    order = np.argsort(h)
    for again in (False, True):
        if again:
            order = np.lexsort([*columns[:-1], h])
        hashes, rows = h[order], [c[order] for c in columns]
        new = np.any([np.diff(c) != 0 for c in rows[:-1]], axis=0)
        if not np.any(new & (hashes[1:] == hashes[:-1])):  # else different rows share a hash
            break
    if not len(order):
        return rows
    at = np.flatnonzero(np.concatenate([[True], new]))
    return [*(c[at] for c in rows[:-1]), np.add.reduceat(rows[-1], at)]


class _Counter:
    """Counts of rows of longs, merged when they grow, to be sent once per task."""

    def __init__(self, width: int, limit: int = 3_000_000):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(width + 1)]
        self.held, self.limit, self.width = 0, limit, width

    def add(self, columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part, c in zip(self.parts, [*columns, n], strict=True):
            part.append(c)
        self.held += len(n)
        if self.held > self.limit:
            self._merge()
            if self.held > self.limit // 2:
                yield from self.flush()

    def _merge(self) -> None:
        columns = _merged([np.concatenate(p) if p else np.zeros(0, np.int64) for p in self.parts])
        self.parts, self.held = [[c] for c in columns], len(columns[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        columns, held = [p[0] for p in self.parts], self.held
        self.parts, self.held = [[] for _ in self.parts], 0
        yield from self._sent(columns, held)

    def _sent(self, columns: list[np.ndarray], held: int) -> Iterator[pa.RecordBatch]:
        for k in range(0, held, 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 200_000]) for c in columns], names=[*(f"k{j}" for j in range(self.width)), "n"])


class _GramCounter(_Counter):
    """Counts of n-grams of word ids, sent as one packed piece for each shard of their hash."""

    def __init__(self, width: int, bits: int, limit: int = 1_500_000):
        super().__init__(width, limit)
        self.bits = bits

    def _sent(self, columns: list[np.ndarray], held: int) -> Iterator[pa.RecordBatch]:
        edges = np.searchsorted((_mixed(columns[:-1]) >> np.uint64(64 - self.bits)).astype(np.int64), np.arange((1 << self.bits) + 1)).tolist()
        pieces = ((s, _packed([c[a:b] for c in columns])) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b)
        yield from chunks_by_bytes(pieces, lambda x: len(x[1]), lambda x: pa.RecordBatch.from_arrays([pa.array([s for s, _ in x], pa.int64()), pa.array([d for _, d in x], pa.binary())], names=["shard", "grams"]), 4 << 20)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of longs (none negative) byte by byte, without the bytes that are zero in all rows."""
    width = [-(-int(c.max()).bit_length() // 8) for c in columns]
    planes = [np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, width, strict=True)]
    return b"".join([struct.pack(f"<QB{len(width)}B", len(columns[0]), len(width), *width), *planes])


def _unpacked(data: bytes) -> list[np.ndarray]:
    rows, columns = struct.unpack_from("<QB", data)
    at, out = 9 + columns, []
    for w in data[9 : 9 + columns]:
        grid = np.zeros((rows, 8), np.uint8)
        grid[:, :w] = np.frombuffer(data, np.uint8, rows * w, at).reshape(w, rows).T
        out.append(grid.view("<i8").ravel())
        at += rows * w
    return out


def _word_counts(texts: DataFrame) -> DataFrame:
    def run(batches):
        release()
        counter = _Counter(1)
        for batch in batches:
            t = Tokens(batch.column(0))
            yield from counter.add([t.hashes.view(np.int64)], np.bincount(t.index, minlength=len(t.hashes)))
        yield from counter.flush()

    return texts.mapInArrow(run, "k0 long, n long").groupBy("k0").agg(F.sum("n").alias("n"))


def _by_shard(df: DataFrame, shards: int, *order: str) -> DataFrame:
    return df.repartition(shards, "shard").sortWithinPartitions("shard", *order)


def _groups(batches, columns: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Shards of rows sorted by shard, each whole; a shard is bounded by SHARD_ROWS times its hash's unevenness."""
    held: list[list[np.ndarray]] = []
    now = None
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if now is not None and shard[a] != now:
                yield now, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            now = int(shard[a])
            held.append([v[a:b] for v in values])
    if now is not None:
        yield now, [np.concatenate(c) for c in zip(*held, strict=True)]


def _joined(batches, rows: int = 250_000) -> Iterator[pa.RecordBatch]:
    """Batches of numbers joined to larger ones; their usual size is meant for texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _meta(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["shard", "rows", "total"])


_META = "shard long, rows long, total long"
_LEVEL_META = "name string, low long, high long, rows long"


def _starts(meta: list, shards: int) -> tuple[int, ...]:
    """First id of each shard, and past the last."""
    size = np.zeros(shards + 1, np.int64)
    for r in meta:
        size[r.shard + 1] = r.rows
    return tuple(np.cumsum(size).tolist())


def _build_words(counts: DataFrame, folder: str) -> tuple:
    bits = _bits(counts.count())

    def run(batches):
        for s, (hashes, n) in _groups(batches, ["k0", "n"]):
            low = hashes.view(np.uint64) & np.uint64((1 << (64 - bits)) - 1)
            sums = np.concatenate([[0], np.cumsum(n)])
            write_shared(f"{folder}/words-{s}", _join(EliasFano.build(low).to_bytes(), EliasFano.build(sums).to_bytes()))
            yield _meta([(s, len(n), int(n.sum()))])

    sharded = counts.withColumn("shard", F.shiftrightunsigned("k0", 64 - bits))
    meta = _by_shard(sharded, 1 << bits, "k0").mapInArrow(run, _META).collect()
    return folder, bits, _starts(meta, 1 << bits), sum(r.total for r in meta), sum(r.rows for r in meta)


def _gram_counts(texts: DataFrame, order: int, words: tuple) -> DataFrame:
    """k0, k1, ... (word ids; -1 past the n-gram's end) and n of the kept n-grams, from one pass over the texts."""
    bits = _bits((order - 1) * words[3])
    names = [f"k{k}" for k in range(order)]

    def run(batches):
        table = _opened(words[0], words, ()).words
        counters = {n: _GramCounter(n, bits) for n in range(2, order + 1)}
        for batch in batches:
            tokens = Tokens(batch.column(0))
            ids, counts = table.find(tokens.hashes)
            known = np.where(counts >= LEAST_COUNT, ids, -1)[tokens.index]
            run_of = known >= 0
            for n, counter in counters.items():
                run_of[1:] = run_of[:-1] & (known[1:] >= 0) & (tokens.text[1:] == tokens.text[:-1])
                run_of[:1] = False
                place = np.flatnonzero(run_of)
                yield from counter.add([known[place - back] for back in range(n - 1, -1, -1)], np.ones(len(place), np.int64))
        for counter in counters.values():
            yield from counter.flush()

    def combined(batches):
        for _, (pieces,) in _groups(batches, ["grams"]):
            for n in range(2, order + 1):
                own = [_unpacked(x) for x in pieces if x[8] == n + 1]
                if not own:
                    continue
                columns = _merged([np.concatenate(c) for c in zip(*own, strict=True)])
                kept = columns[-1] >= LEAST_COUNT
                columns = [c[kept] for c in columns]
                columns[n:n] = [np.full(len(columns[0]), -1)] * (order - n)
                for k in range(0, len(columns[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 200_000]) for c in columns], names=[*names, "n"])

    found = texts.mapInArrow(run, "shard long, grams binary")
    return _by_shard(found, 1 << bits).mapInArrow(combined, ", ".join(f"{k} long" for k in [*names, "n"]))


def _placed_grams(grams: DataFrame, order: int, words: tuple, levels: tuple) -> DataFrame:
    """context (node of level order - 1), word, n and below (log10 p of the word after the shorter context)."""

    def place(batch):
        trie = _opened(words[0], words, levels)
        *grams, n = (batch.column(k).to_numpy() for k in range(order + 1))
        context, suffix = grams[0], grams[1]
        below = trie.words.log10(trie.words.count(grams[1])) if order == 2 else None
        for level, word, last in zip(trie.levels, grams[1:-1], grams[2:], strict=True):
            context = level.pairs(context, word)[0]
            suffix, below = level.pairs(suffix, last)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (context, grams[-1], n, below)], names=["context", "word", "n", "below"])

    end = F.lit(True) if f"k{order}" not in grams.columns else F.col(f"k{order}") < 0
    own = grams.where((F.col(f"k{order - 1}") >= 0) & end).select(*(f"k{k}" for k in range(order)), "n")

    def run(batches):
        release()
        for batch in _joined(batches):
            yield place(batch)

    return own.mapInArrow(run, "context long, word long, n long, below double")


def _build_level(grams: DataFrame, order: int, words: tuple, levels: tuple, folder: str) -> tuple:
    placed = through_table(_placed_grams(grams, order, words, levels), "placed-grams")
    shards = max(1, -(-placed.count() // SHARD_ROWS))

    def run(batches):
        parts = [[b.column(k).to_numpy() for k in range(4)] for b in batches if b.num_rows]
        if not parts:
            return
        context, word, n, below = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        trie = _opened(words[0], words, levels)
        each, first = np.unique(context, return_index=True)
        size = np.diff([*first, len(context)])
        total = trie.words.count(each) if order == 2 else trie.levels[-1].count(each)
        left = quantised(np.log10(np.maximum(1 - np.add.reduceat(n - DISCOUNT, first) / total, 1e-16)))
        p = (n - DISCOUNT) / np.repeat(total, size) + 10 ** (np.repeat(left, size) * -_STEP + below)
        low, high = int(each[0]), int(each[-1])
        pointers, weights = np.zeros(high - low + 2, np.int64), np.zeros(high - low + 1, np.uint16)
        pointers[each - low + 1], weights[each - low] = size, left
        coded = [EliasFano.build(x).to_bytes() for x in (np.cumsum(pointers), (context - low) * words[4] + word, np.concatenate([[0], np.cumsum(n)]))]
        name = f"level{order}-{low}"
        write_shared(f"{folder}/{name}", _join(*coded, quantised(np.log10(np.minimum(p, 1.0))).astype("<u2").tobytes(), weights.astype("<u2").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, low, high, len(n))], names=["name", "low", "high", "rows"])

    meta = placed.repartitionByRange(shards, "context").sortWithinPartitions("context", "word").mapInArrow(run, _LEVEL_META).collect()
    return folder, order, words[4], tuple(sorted(map(tuple, meta), key=lambda m: m[1]))


def train(texts: DataFrame, order: int = ORDER) -> tuple[tuple, tuple]:
    """Build the trie of the texts (column text, no nulls) in the shared folder; what it returns opens it
    anywhere."""
    spark: SparkSession = texts.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark, "trie")
    counts = through_table(_word_counts(texts), "word-counts")
    words = _build_words(counts, folder)
    grams = through_table(_gram_counts(texts, order, words), "grams")
    levels: tuple = ()
    for n in range(2, order + 1):
        levels += (_build_level(grams, n, words, levels, folder),)
    return words, levels


def score(docs: DataFrame, model: tuple[tuple, tuple]) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""
    bounded_batches(docs.sparkSession)
    words, levels = model

    def run(batch):
        trie, rows = _opened(words[0], words, levels), batch.num_rows
        tokens = Tokens(batch.column(1))
        placed = Placed(trie, tokens)
        add = lambda x: np.bincount(tokens.text, x, rows)
        total = trie.words.log10(placed.counts)[tokens.index]
        base = add(total)
        walk, found = placed.levels(len(levels) + 1), None
        before = tokens.index  # the state each token leaves behind, at the level at hand
        for level in trie.levels:
            n, at, states, state, word, which = walk.send(found)
            node, log, weight = level.find(states, state, word)
            after = np.append(weight, 0.0)[before[:-1]]  # a token without a state leaves -1 behind, the weight 0
            total[1:] += np.where(placed.first[1:], 0.0, after)
            hit = node[which] >= 0
            total[at[hit]] = log[which[hit]]
            found, before = node, np.full(len(total), -1, np.int64)
            before[at] = which
        columns = [batch.column(0), pa.array(tokens.size), pa.array(add(placed.count > 0).astype(np.int64)), pa.array(np.full(rows, trie.words.total)), pa.array(base), pa.array(add(total))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return arrow_map(docs, run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Train on the documents outside of the held-out fold and score all."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    held = held_out("doc_id", FOLDS, HELD)
    model = train(own.where(~held).select("text"), order)
    return score(own, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
