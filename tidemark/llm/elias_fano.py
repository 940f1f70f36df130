"""Elias-Fano coded monotone sequences, built and queried in bulk with numpy, over plain or memory-mapped bytes.

A value is split: its low bits are packed side by side, its high part is a one in a bit vector in which a zero ends
each high value. The ones before each word of that vector, and the word of every 32nd one and zero, are kept beside it,
so that a query looks at a word or two.
"""

from __future__ import annotations

import struct

import numpy as np

_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
_SAMPLE = 5
_FIVES, _THREES, _NIBBLES = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F))
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the k-th one of a byte, at byte * 8 + k.
_IN_BYTE = np.array([([p for p in range(8) if b >> p & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.int64)


def _select64(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one of each word: bytes are skipped by their running counts, the last one is looked up."""
    k = k.astype(np.uint64)
    with np.errstate(over="ignore"):
        s = word - ((word >> np.uint64(1)) & _FIVES)
        s = (s & _THREES) + ((s >> np.uint64(2)) & _THREES)
        sums = ((s + (s >> np.uint64(4))) & _NIBBLES) * _BYTES
        passed = np.bitwise_count((((k * _BYTES) | _TOPS) - sums) & _TOPS).astype(np.uint64) << np.uint64(3)
        before = ((sums << np.uint64(8)) >> passed) & np.uint64(255)
    byte = (word >> passed) & np.uint64(255)
    return passed.astype(np.int64) + _IN_BYTE[((byte << np.uint64(3)) + (k - before)).astype(np.int64)]


class EliasFano:
    """A sequence of n values that never fall, each below 2**63."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.rank, self.samples = n, low_bits, low, high, rank, (zeros, ones)
        self.all_zeros = (len(rank) - 1) * 64 - int(rank[-1])

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        words = (int(place[-1]) + 2 if n else 1) // 64 + 1
        bits = np.zeros(words * 64, np.uint8)
        bits[place] = 1
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(np.packbits(bits, bitorder="little").view(np.uint64)), dtype=np.uint32)]).astype(np.uint32)
        samples = [np.flatnonzero(bits == b)[:: 1 << _SAMPLE].astype(np.uint32) >> np.uint32(6) for b in (1, 0)]
        high = np.concatenate([np.packbits(bits, bitorder="little").view(np.uint64), np.zeros(2, np.uint64)])
        if low_bits and n:
            part = values & np.uint64((1 << low_bits) - 1)
            grid = ((part[:, None] >> np.arange(low_bits, dtype=np.uint64)) & _ONE).astype(np.uint8).ravel()
            fill = (-len(grid)) % 64 + 64
            low = np.packbits(np.concatenate([grid, np.zeros(fill, np.uint8)]), bitorder="little").view(np.uint64)
        else:
            low = np.zeros(2, np.uint64)
        return cls(n, low_bits, low, high, rank, *samples)

    def to_bytes(self) -> bytes:
        parts = (self.low, self.high, self.rank, self.samples[1], self.samples[0])
        out = [struct.pack("<7Q", self.n, self.low_bits, *map(len, parts))]
        for a in parts:
            data = np.ascontiguousarray(a, a.dtype.newbyteorder("<")).tobytes()
            out += [data, bytes(-len(data) % 8)]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: np.ndarray) -> EliasFano:
        """Over an array of bytes, aligned to eight, that may be a memory map."""
        n, low_bits, *sizes = struct.unpack("<7Q", data[:56].tobytes())
        at, parts = 56, []
        for size, kind in zip(sizes, ("<u8", "<u8", "<u4", "<u4", "<u4"), strict=True):
            width = size * int(kind[2])
            parts.append(np.asarray(data[at : at + width]).view(kind))
            at += width + -width % 8
        return cls(n, low_bits, *parts)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th one, or zero, in the high bits."""
        rank = self.rank
        word = self.samples[ones][k >> _SAMPLE].astype(np.int64)
        before = (lambda w: rank[w].astype(np.int64)) if ones else (lambda w: (w << 6) - rank[w])
        late = np.flatnonzero(before(word + 1) <= k)
        for _ in range(4):
            if not len(late):
                break
            word[late] += 1
            late = late[before(word[late] + 1) <= k[late]]
        if len(late):
            every = rank.astype(np.int64) if ones else np.arange(len(rank)) * 64 - rank
            word[late] = np.searchsorted(every, k[late], "right") - 1
        bits = self.high[word]
        return (word << 6) + _select64(bits if ones else ~bits, k - before(word))

    def _window(self, place: np.ndarray) -> np.ndarray:
        """64 bits of the high bits from each place on."""
        word, off = place >> 6, (place & 63).astype(np.uint64)
        return (self.high[word] >> off) | np.where(off > 0, self.high[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))

    @staticmethod
    def _zeros_below(x: np.ndarray) -> np.ndarray:
        """Zeros below the lowest one of each word: 64 if there is none."""
        with np.errstate(over="ignore"):
            return np.bitwise_count((x & (~x + _ONE)) - _ONE).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        got = self.low[word] >> off
        more = self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63))
        return (got | np.where(off > 0, more, np.uint64(0))) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at the places i and i + 1, as signed numbers."""
        if not len(i):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self._select(i, True)
        gap = self._zeros_below(self._window(at + 1))
        after = at + 1 + gap
        if len(far := np.flatnonzero(gap == 64)):
            after[far] = self._select(i[far] + 1, True)
        bits = np.int64(self.low_bits)
        return (at - i) << bits | self._low(i).view(np.int64), (after - i - 1) << bits | self._low(i + 1).view(np.int64)

    def find(self, value: np.ndarray, first: np.ndarray | None = None, past: np.ndarray | None = None) -> np.ndarray:
        """The place of each value within [first, past), or -1: its high part names a short run, whose low bits are
        searched for the successor."""
        value = np.asarray(value, np.uint64)
        out = np.full(len(value), -1, np.int64)
        if not self.n or not len(value):
            return out
        high = (value >> np.uint64(self.low_bits)).astype(np.int64)
        own = np.flatnonzero(high < self.all_zeros)
        if not len(own):
            return out
        h = high[own]
        at = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1, 0)
        begin = at - h
        run = self._zeros_below(~self._window(at))
        if len(far := np.flatnonzero(run == 64)):
            run[far] = self._select(h[far], False) - at[far]
        end = np.minimum(begin + run, self.n)
        if first is not None:
            begin, end = np.maximum(begin, first[own]), np.minimum(end, past[own])
        want = value[own] & np.uint64((1 << self.low_bits) - 1)
        low, high_end = begin.copy(), np.maximum(end, begin)
        active = np.flatnonzero(low < high_end)
        while len(active):
            mid = (low[active] + high_end[active]) >> 1
            less = self._low(mid) < want[active]
            low[active] = np.where(less, mid + 1, low[active])
            high_end[active] = np.where(less, high_end[active], mid)
            active = active[low[active] < high_end[active]]
        inside = np.flatnonzero(low < end)
        same = self._low(low[inside]) == want[inside]
        out[own[inside[same]]] = low[inside[same]]
        return out
