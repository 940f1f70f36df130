"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

For every prefix of a word exactly one token can stand last: the suffix that is compatible with the last token of
the prefix before it. A cell keeps that token for each position since the last emitted boundary. A token is emitted
once it lies on the chains of all positions from which a later token can still start, so output never changes;
`lookahead()` bounds, from the merge list, how far a merge can act to its left, and with it the cells held at once.
Decoding maps ids to bytes and feeds an incremental UTF-8 machine that keeps at most three pending bytes; malformed
sequences become U+FFFD as each maximal part.

Words of usual length come from a bounded cache of transducer results: they are shorter than the window, so the
transducer would emit nothing before their end. A long text is cut into words some thousands at a time, and its ids and
decoded text grow as compact arrays; beside them memory stays constant. The tokenizer file is a parameter; one that
asks for anything but plain byte-level BPE is refused.

Null is encoded as the empty text (no ids). Rows are independent: repeated rows, an empty table and other columns
need nothing special.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, bounded_batches, chunks_by_bytes, hold, text_of

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words of up to so many bytes are kept, in two generations of so many entries each.
_CACHED_LENGTH, _CACHE_ENTRIES = 48, 400_000
_NEVER = 1 << 60
#: Words of a text that are encoded at a time, and ids that are decoded at a time.
_STEP = 50_000
#: What a tokenizer file must say, by section, where it says anything.
_PLAIN = {
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "decoder": {"type": "ByteLevel"},
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _refuse_others(data: dict) -> None:
    """Raise for a tokenizer file whose results this module would not match."""
    for section, wanted in _PLAIN.items():
        own = data.get(section) or {}
        for key, value in wanted.items():
            if (own.get(key, value) or None) != (value or None) or key == "type" and key not in own:
                raise ValueError(f"tokenizer file: {section}.{key} is {own.get(key)!r}, only {value!r} is supported")
    if data.get("normalizer"):
        raise ValueError("tokenizer file: normalizers are not supported")
    if any(t.get(flag) for t in data.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("tokenizer file: added tokens may not be single words or strip white space")


class MergeList:
    """Vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, text: str):
        data = json.loads(text)
        _refuse_others(data)
        model, alphabet = data["model"], _byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        for content in self.special:
            self.ids.pop(content.encode(), None)
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            left, right = raw(left), raw(right)
            pair_ids, made = (self.ids[left], self.ids[right]), self.ids[left + right]
            if pair_ids in self.rank:
                continue
            self.rank[pair_ids] = r
            if made not in self.parts:
                self.parts[made], self.born[made] = pair_ids, r
        self.longest = max(map(len, self.ids))
        self._fits: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        # Tokens of which the merges never make the whole can't occur.
        self.usable = {b: i for b, i in self.ids.items() if len(b) == 1 or i in self.parts}
        #: All tokens that end at each position of a word.
        self.suffixes = ahocorasick.Automaton()
        for b, i in self.usable.items():
            self.suffixes.add_word(b.decode("latin-1"), (i, len(b)))
        self.suffixes.make_automaton()
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def lookahead(self) -> int:
        """Bytes after which a boundary can't change any more.

        A merge (t, u) is undone only by one of lower rank that takes u first, (u, v); the longest chain of such
        merges, each sharing an operand with the next, bounds how far an added byte acts to the left.
        """
        by_left: dict[int, int] = {}
        most = 0
        for (left, right), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            reach = len(self.bytes_of[left]) + len(self.bytes_of[right]) + by_left.get(right, 0)
            by_left[left] = max(by_left.get(left, 0), reach)
            most = max(most, reach)
        return most + self.longest

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outermost byte to the token: each part on its edge and the rank at which it is merged away."""
        known = self._spines[side]
        if token not in known:
            chain, at, until = [], token, _NEVER
            while True:
                chain.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.born[at], self.parts[at][side]
            known[token] = chain[::-1]
        return known[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side stay two: no merge across their border comes first."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 400_000:
                self._fits.clear()
            known = self._fits[key] = self._fits_now(left, right)
        return known

    def _fits_now(self, left: int, right: int) -> bool:
        a, b, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            at = self.rank.get((x, y), _NEVER)
            if at < x_until and at <= y_until:
                return at == _NEVER
            if x_until == y_until == _NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


class Encoder:
    """The transducer for one word: feed() bytes, take the ids that are settled, finish() for the rest."""

    def __init__(self, merges: MergeList, window: int | None = None):
        self.m, self.window = merges, window or 2 * merges.lookahead()
        self.data, self.last, self.start = bytearray(), [], []

    def feed(self, chunk: bytes) -> Iterator[int]:
        for k in range(0, len(chunk), self.window):
            self._extend(chunk[k : k + self.window])
            if len(self.data) >= self.window:
                yield from self._settle()

    def _extend(self, chunk: bytes) -> None:
        usable, fits, last, start, longest = self.m.usable, self.m.fits, self.last, self.start, self.m.longest
        begin = len(self.data)
        self.data += chunk
        data = bytes(self.data)
        for end in range(begin + 1, len(data) + 1):
            for at in range(max(0, end - longest), end):
                token = usable.get(data[at:end])
                if token is not None and (at == 0 or fits(last[at - 1], token)):
                    last.append(token)
                    start.append(at)
                    break
            else:
                raise ValueError("byte outside the vocabulary")

    def _chain(self, end: int) -> list[int]:
        out = []
        while end:
            out.append(self.last[end - 1])
            end = self.start[end - 1]
        return out[::-1]

    def _settle(self) -> Iterator[int]:
        """Emit up to the nearest boundary that all open positions share."""
        live = set(range(max(0, len(self.data) - self.m.longest + 1), len(self.data) + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(self.start[top - 1])
        shared = live.pop()
        if shared:
            yield from self._chain(shared)
            del self.data[:shared]
            self.last, self.start = self.last[shared:], [s - shared for s in self.start[shared:]]

    def finish(self) -> list[int]:
        out = self._chain(len(self.data))
        self.data, self.last, self.start = bytearray(), [], []
        return out


class Codec:
    """Whole-text encoding and decoding over one merge list."""

    def __init__(self, text: str):
        self.m = MergeList(text)
        self.window = 2 * self.m.lookahead()
        self.words: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self.texts = {}
        for i, b in self.m.bytes_of.items():
            try:
                self.texts[i] = b.decode()
            except UnicodeDecodeError:
                self.texts[i] = None

    def _word(self, piece: str) -> tuple[int, ...]:
        """The ids of a word that the young generation lacks."""
        ids = self._older.get(piece)
        if ids is None:
            data = piece.encode()
            if len(data) > _CACHED_LENGTH:
                encoder = Encoder(self.m, self.window)
                return (*encoder.feed(data), *encoder.finish())
            ids = self._short(data)
        if len(self.words) >= _CACHE_ENTRIES:
            self._older = dict(self.words)
            self.words.clear()
        self.words[piece] = ids
        return ids

    def _short(self, data: bytes) -> tuple[int, ...]:
        """The transducer over a word that fits the window, so nothing is emitted before its end."""
        if (whole := self.m.usable.get(data)) is not None:
            return (whole,)
        known, fits, last, start, done = self.m._fits.get, self.m.fits, [], [], -1
        for end, (token, size) in self.m.suffixes.iter(data.decode("latin-1")):
            if end == done:
                continue
            at = end + 1 - size
            if at:
                ok = known(last[at - 1] << 32 | token)
                if not (fits(last[at - 1], token) if ok is None else ok):
                    continue
            last.append(token)
            start.append(at)
            done = end
        if len(last) != len(data):
            raise ValueError("byte outside the vocabulary")
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end = start[end - 1]
        return tuple(out[::-1])

    def encode(self, text: str) -> array:
        """The ids of a text; the strings of special tokens become those tokens."""
        ids = array("I")
        parts = self.m._split.split(text) if self.m._split and any(s in text for s in self.m.special) else [text]
        known, word = self.words.get, self._word
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.m.special[part])
                continue
            pieces = _PIECES.findall(part) if len(part) <= 4 * _STEP else None
            cut = None if pieces is not None else (m[0] for m in _PIECES.finditer(part))
            while pieces := pieces if cut is None else list(islice(cut, _STEP)):
                found = list(map(known, pieces))
                if None in found:
                    found = [word(p) if f is None else f for p, f in zip(pieces, found, strict=True)]
                ids.extend(chain.from_iterable(found))
                if cut is None:
                    break
        return ids

    def decode_parts(self, ids: Iterator[int]) -> Iterator[str]:
        """The text of the ids, part by part: whole characters pass through, split ones go through the UTF-8 machine."""
        texts, machine, pending, ids = self.texts, codecs.getincrementaldecoder("utf-8")("replace"), False, iter(ids)
        while own := list(islice(ids, _STEP)):
            found = [texts[i] for i in own]
            if None not in found and not pending:
                yield "".join(found)
                continue
            out = []
            for i, piece in zip(own, found, strict=True):
                if piece is not None and not pending:
                    out.append(piece)
                    continue
                out.append(machine.decode(self.m.bytes_of[i]))
                pending = machine.getstate()[0] != b""
            yield "".join(out)
        yield machine.decode(b"", True)

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decode_parts(ids))


@lru_cache(maxsize=2)
def _codec(text_hash: str, path: str) -> Codec:
    with open(path, encoding="utf-8") as f:
        return Codec(f.read())


def default_tokenizer() -> str:
    """The public 50k byte-level vocabulary of this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, tokenizer: str | None = None, column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded text.

    `tokenizer`: path of the tokenizer file, readable on the driver; executors that don't have the same one get it as a Spark file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = tokenizer or default_tokenizer()
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    name = path.rpartition("/")[2]
    spark.sparkContext.addFile(path)

    def codec() -> Codec:
        for where in (path, SparkFiles.get(name)):
            try:
                with open(where, "rb") as f:
                    if hashlib.sha256(f.read()).hexdigest() == digest:
                        hold("bpe", _codec.cache_clear)
                        return _codec(digest, where)
            except OSError:
                continue
        raise FileNotFoundError(path)

    def build(rows):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_tokens", "ids", "decoded"])

    def run(batch):
        import numpy as np

        own = codec()

        def rows():
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.encode(text)
                yield i, len(ids), np.array(ids, "<u4").tobytes(), own.decode(ids)

        gc.disable()  # the cache is millions of small tuples without cycles, which the collector would walk over and over
        try:
            yield from chunks_by_bytes(rows(), lambda r: len(r[2]) + 4 * len(r[3]), build)
        finally:
            gc.enable()

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_of(column)), run, "doc_id long, n_tokens long, ids binary, decoded string", keeps="bpe")


def token_digest(tokens: DataFrame) -> DataFrame:
    """The digest row of each encoded document."""
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
