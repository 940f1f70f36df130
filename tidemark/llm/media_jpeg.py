"""Progressive JPEG media columns.

A payload of bytes is stored losslessly as the quantised DCT coefficients of a progressive JPEG, the unit in
which that format is exact. Decoding accumulates the spectral-selection and successive-approximation scans into
coefficient arrays, inverse-transforms them in numpy, upsamples the chroma planes and gives a full-resolution RGB
tensor; the payload comes back from the coefficients.

Layout: 4:2:0, one MCU = 4 luma + 1 Cb + 1 Cr blocks = 384 payload bytes, the last one filled with byte 32. A DC
coefficient holds byte - 128, an AC coefficient byte (128 to 255) or byte - 255 (-255 to -128), so it is never 0.
Each component is sent as DC scan, AC band scans with one bit held back, then the refinement scans.

Any progressive JPEG of 8-bit samples is read: sizes that are no whole number of MCUs are decoded over whole ones and
cropped, and restart intervals reset predictors and runs. Media that can't be decoded, nulls among them, give a row
with nulls and the reason in `error`; so do images of more than MOST_PIXELS.

Nulls and empty texts are the payload of 192 spaces. Equal texts give equal media. Rows are independent: repeated
rows give repeated results, an empty table an empty result, and other columns are not read.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, bounded_batches, chunks_by_bytes, text_of

UNIT = 192
BLANK = 32
_MCU_COLUMNS = 4095
_NOTE = b"payload"
#: A frame header may claim more than any file could hold.
MOST_PIXELS = 1 << 28

#: The zigzag order of an 8 x 8 block (row * 8 + column of each position) follows from its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))

# Huffman tables of our writer: number of codes of each length 1..16, then the symbols in code order.
_DC_TABLE = (bytes([0, 0, 0, 12, *[0] * 12]), bytes(range(12)))
_AC_FIRST = (bytes([1, 1, *[0] * 14]), bytes([0x07, 0x00]))
_AC_REFINE = (bytes([0, 0, 0, 15, *[0] * 12]), bytes(r << 4 for r in range(15)))
#: Bands of the luma component; each chroma component has one.
_BANDS = {0: ((1, 5), (6, 63)), 1: ((1, 63),), 2: ((1, 63),)}


def pad_payload(data: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of 192."""
    short = (-len(data)) % UNIT if data else UNIT
    return data + bytes([BLANK]) * short


# ---------------------------------------------------------------- writer


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _bits(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lowest `lengths` bits of each value, one after another, as an array of 0 and 1."""
    width = int(lengths.max(initial=0))
    place = np.arange(width - 1, -1, -1)
    grid = ((values[:, None] >> place) & 1).astype(np.uint8)
    return grid[place < lengths[:, None]]


def _packed(bits: np.ndarray) -> bytes:
    fill = (-len(bits)) % 8
    return np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)])).tobytes()


def _scan(component: int, start: int, end: int, high: int, low: int, tables: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component + 1, tables, start, end, high << 4 | low])) + data.replace(b"\xff", b"\xff\x00")


def _dc_first(blocks: np.ndarray) -> bytes:
    values = (blocks[:, 0].astype(np.int32) - 128) >> 1
    steps = np.diff(values, prepend=0)
    size = np.frexp(np.abs(steps).astype(np.float64))[1].astype(np.int64)
    extra = np.where(steps < 0, steps + (1 << size) - 1, steps)
    return _packed(_bits(size << size | extra, size + 4))


def _ac_refine(bits: np.ndarray, blocks: int) -> bytes:
    """End-of-band runs over all blocks, each followed by the correction bits of its coefficients."""
    parts, done, width = [], 0, bits.size // blocks
    while done < blocks:
        run = min(blocks - done, 32767)
        r = run.bit_length() - 1
        parts += [_bits(np.array([r << r | run - (1 << r)]), np.array([4 + r])), bits[done * width : (done + run) * width]]
        done += run
    return _packed(np.concatenate(parts))


@lru_cache(maxsize=1)
def _tables_head() -> bytes:
    out = _segment(0xDB, bytes([0]) + bytes([1] * 64))
    for slot, (counts, symbols) in ((0x00, _DC_TABLE), (0x10, _AC_FIRST), (0x11, _AC_REFINE)):
        out += _segment(0xC4, bytes([slot]) + counts + symbols)
    return out


def encode_progressive(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold the payload (a positive multiple of 64 bytes)."""
    mcus = max(1, -(-len(payload) // 384))
    columns = min(mcus, _MCU_COLUMNS)
    rows = -(-mcus // columns)
    mcus = rows * columns
    flat = np.frombuffer(payload + bytes([BLANK]) * (mcus * 384 - len(payload)), np.uint8).reshape(-1, 64)
    parts = {0: flat[: 4 * mcus], 1: flat[4 * mcus : 5 * mcus], 2: flat[5 * mcus :]}
    frame = struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, _NOTE + struct.pack(">Q", len(payload))), _tables_head(), _segment(0xC2, frame)]
    for c, blocks in parts.items():
        out.append(_scan(c, 0, 0, 0, 1, 0x00, _dc_first(blocks)))
    for c, blocks in parts.items():
        for start, end in _BANDS[c]:  # one code bit 0 and seven magnitude bits: a byte for each coefficient
            out.append(_scan(c, start, end, 0, 1, 0x00, (blocks[:, start : end + 1] >> 1).tobytes()))
    for c, blocks in parts.items():
        out.append(_scan(c, 0, 0, 1, 0, 0x00, _packed(np.ascontiguousarray(blocks[:, 0]) & 1)))
    for c, blocks in parts.items():
        for start, end in _BANDS[c]:
            band = blocks[:, start : end + 1]
            low = ((band & 1) ^ (band < 128)).astype(np.uint8).ravel()
            out.append(_scan(c, start, end, 1, 0, 0x01, _ac_refine(low, len(blocks))))
    out.append(b"\xff\xd9")
    return b"".join(out)


# ---------------------------------------------------------------- reader


@lru_cache(maxsize=64)
def _huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every window of 16 bits; length 0 where no code fits."""
    symbol, length, code, k = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int8), 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            low = code << (16 - size)
            symbol[low : low + (1 << (16 - size))] = symbols[k]
            length[low : low + (1 << (16 - size))] = size
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


class _Reader:
    """Bits of one scan, for the scalar path."""

    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data + b"\xff" * 4, "big"), len(data) * 8 + 32, 0

    def take(self, n: int) -> int:
        self.at += n
        if self.at > self.size:
            raise ValueError("scan ends early")
        return self.value >> (self.size - self.at) & (1 << n) - 1

    def symbol(self, table) -> int:
        window = self.value >> max(0, self.size - self.at - 16) & 0xFFFF
        size = int(table[1][window])
        if not size:
            raise ValueError("no such code")
        self.at += size
        return int(table[0][window])

    def extended(self, size: int) -> int:
        if not size:
            return 0
        got = self.take(size)
        return got if got >> (size - 1) else got - (1 << size) + 1


class _Chunked(_Reader):
    """As _Reader, over a window of the data, so that long scans don't shift long integers."""

    def __init__(self, data: bytes):
        self.data, self.base = data, 0
        super().__init__(data[:4096])

    def _slide(self) -> None:
        if self.at > 3000 * 8 and self.base + 4096 < len(self.data):
            step = self.at // 8
            self.base += step
            _Reader.__init__(self, self.data[self.base : self.base + 4096])
            self.at = 0

    def at_bit(self) -> int:
        return self.base * 8 + self.at


def _dc_first_fast(data: bytes, n: int, table, low: int) -> np.ndarray:
    """The DC values of one component: code lengths for all bit positions at once, then one hop for each value."""
    raw = np.frombuffer(data + b"\xff\xff\xff\xff", np.uint8).astype(np.int64)
    word = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    position = np.arange(len(data) * 8)
    window = (word[position >> 3] >> (16 - (position & 7))) & 0xFFFF
    size, length = table[0][window].astype(np.int64), table[1][window].astype(np.int64)
    hop, at, places = (position + length + size).tolist(), 0, []
    for _ in range(n):
        places.append(at)
        at = hop[at]
    spot = np.array(places)
    if not length[spot].all() or at > len(data) * 8:
        raise ValueError("bad DC scan")
    size, begin = size[spot], spot + length[spot]
    begin_word = word[np.minimum(begin >> 3, len(word) - 1)]
    got = (begin_word >> (32 - (begin & 7) - size)) & ((1 << size) - 1)
    steps = np.where((size > 0) & (got < (1 << np.maximum(size - 1, 0))), got - (1 << size) + 1, got)
    return np.cumsum(steps) << low


def _decode_scan(data: bytes, components: list[dict], header: tuple, interval: int, mcus: int) -> None:
    """One scan, as it stands in the file. An MCU of a scan of one component is a block, and blocks that only fill the
    last MCUs of the frame aren't sent in it."""
    if len(components) == 1:
        comp = components[0]
        grid = comp["coefs"].reshape(comp["high"], comp["wide"], 64)
        own = np.ascontiguousarray(grid[: comp["own_high"], : comp["own_wide"]]).reshape(-1, 64)
        for k, part in enumerate(_RESTART.split(data) if interval else [data]):
            blocks = own[k * interval : (k + 1) * interval] if interval else own
            if len(blocks):
                _decode_blocks(part.replace(b"\xff\x00", b"\xff"), comp | {"coefs": blocks}, header)
        grid[: comp["own_high"], : comp["own_wide"]] = own.reshape(comp["own_high"], comp["own_wide"], 64)
        return
    for k, part in enumerate(_RESTART.split(data) if interval else [data]):
        first, past = (k * interval, min(mcus, (k + 1) * interval)) if interval else (0, mcus)
        _scalar_scan(part.replace(b"\xff\x00", b"\xff"), components, header, range(first, past))


def _decode_blocks(data: bytes, comp: dict, header: tuple) -> None:
    """Blocks of one component between two restarts."""
    start, end, high, low = header
    coefs, n = comp["coefs"], len(comp["coefs"])
    if start == 0 and high == 0:
        try:
            coefs[:, 0] = _dc_first_fast(data, n, comp["dc"], low)
            return
        except (ValueError, IndexError):
            pass
    elif start == 0:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n)
        coefs[:, 0] |= bits.astype(np.int32) << low
        return
    elif high == 0 and _ac_first_fast(data, comp, start, end, low):
        return
    elif high and _ac_refine_fast(data, comp, start, end, low):
        return
    _scalar_scan(data, [comp], header, range(n))


def _ac_first_fast(data: bytes, comp: dict, start: int, end: int, low: int) -> bool:
    """A band of coefficients that all have the first one's symbol: true by induction if every code is that one."""
    coefs, symbols, lengths = comp["coefs"], *comp["ac"]
    n, width = len(coefs), end - start + 1
    if len(data) < 2:
        return False
    window = data[0] << 8 | data[1]
    symbol, length = int(symbols[window]), int(lengths[window])
    size = symbol & 15
    if not length or symbol >> 4 or not size or length + size != 8 or len(data) < n * width:
        return False
    raw = np.frombuffer(data, np.uint8, n * width).astype(np.int32)
    if (raw >> size != data[0] >> size).any():
        return False
    got = raw & (1 << size) - 1
    values = np.where(got < 1 << (size - 1), got - (1 << size) + 1, got)
    coefs[:, start : end + 1] = (values * (1 << low)).reshape(n, width)
    return True


def _ac_refine_fast(data: bytes, comp: dict, start: int, end: int, low: int) -> bool:
    """A band whose coefficients all have history, sent as runs of ended bands with correction bits only."""
    coefs = comp["coefs"]
    n, width = len(coefs), end - start + 1
    band = coefs[:, start : end + 1]
    if not band.all():
        return False
    symbols, lengths = comp["ac"]
    bits = np.unpackbits(np.frombuffer(data + b"\xff\xff\xff\xff", np.uint8))
    at, done, got = 0, 0, []
    while done < n:
        window = int(np.packbits(bits[at : at + 16]).tobytes().hex(), 16)
        symbol, length = int(symbols[window]), int(lengths[window])
        r = symbol >> 4
        if not length or symbol & 15 or r == 15:
            return False
        at += length
        run = 1 << r
        for b in bits[at : at + r].tolist():
            r -= 1
            run += b << r
        at += (symbol >> 4)
        if done + run > n or at + run * width > len(bits):
            return False
        got.append(bits[at : at + run * width])
        at, done = at + run * width, done + run
    step = np.concatenate(got).reshape(n, width).astype(np.int32) << low
    coefs[:, start : end + 1] = band + np.where(band > 0, step, -step)
    return True


def _scalar_scan(data: bytes, components: list[dict], header: tuple, mcus: range) -> None:
    """Any scan, coefficient by coefficient."""
    start, end, high, low = header
    bits = _Chunked(data)
    if start == 0:
        order = [(c, i) for c in components for i in range(len(c["coefs"]))] if len(components) == 1 else _interleaved(components, mcus)
        last = {id(c): 0 for c in components}
        for comp, i in order:
            bits._slide()
            if high:
                comp["coefs"][i, 0] |= bits.take(1) << low
            else:
                last[id(comp)] += bits.extended(bits.symbol(comp["dc"]))
                comp["coefs"][i, 0] = last[id(comp)] << low
        return
    comp, run, one = components[0], 0, 1 << low
    for block in comp["coefs"]:
        bits._slide()
        k = start
        if not high:
            if run:
                run -= 1
                continue
            while k <= end:
                symbol = bits.symbol(comp["ac"])
                r, size = symbol >> 4, symbol & 15
                if size:
                    k += r
                    block[k] = bits.extended(size) * one
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + (bits.take(r) if r else 0) - 1
                    break
            continue
        if not run:
            while k <= end:
                symbol = bits.symbol(comp["ac"])
                r, size, new = symbol >> 4, symbol & 15, 0
                if size:
                    new = one if bits.take(1) else -one
                elif r != 15:
                    run = (1 << r) + (bits.take(r) if r else 0)
                    break
                while k <= end:
                    if block[k]:
                        if bits.take(1):
                            block[k] += one if block[k] > 0 else -one
                    elif r == 0:
                        break
                    else:
                        r -= 1
                    k += 1
                if new and k <= end:
                    block[k] = new
                k += 1
        if run:
            for k in range(k, end + 1):
                if block[k] and bits.take(1):
                    block[k] += one if block[k] > 0 else -one
            run -= 1


def _interleaved(components: list[dict], mcus: range):
    """Blocks of an interleaved scan in MCU order."""
    for m in mcus:
        for c in components:
            wide, row, col = c["wide"], m // (c["wide"] // c["h"]), m % (c["wide"] // c["h"])
            for y in range(c["v"]):
                for x in range(c["h"]):
                    yield c, (row * c["v"] + y) * wide + col * c["h"] + x


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


def decode_coefficients(media: bytes) -> dict:
    """Parse a progressive JPEG and accumulate its scans; components' "coefs" are int32 (blocks, 64) in zigzag order."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, huff, frame, note, interval = 2, {}, {}, None, None, 0
    while at < len(media):
        if media[at] != 0xFF:
            raise ValueError("no marker")
        marker = media[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float32)
                body = body[1 + (128 if wide else 64) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE and body.startswith(_NOTE):
            note = struct.unpack(">Q", body[len(_NOTE) :])[0]
        elif marker == 0xC2:
            _, height, width, count = struct.unpack_from(">BHHB", body)
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(count)]
            most_h, most_v = max(c["h"] for c in parts), max(c["v"] for c in parts)
            across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            if not 0 < width * height <= MOST_PIXELS:
                raise ValueError("no such size")
            for c in parts:
                c |= {"wide": across * c["h"], "high": down * c["v"], "own_wide": -(-width * c["h"] // (8 * most_h)), "own_high": -(-height * c["v"] // (8 * most_v))}
                c["coefs"] = np.zeros((c["wide"] * c["high"], 64), np.int32)
            frame = {"height": height, "width": width, "components": parts, "mcus": across * down, "h": most_h, "v": most_v}
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xDA:
            n = body[0]
            chosen = []
            for i in range(n):
                comp = next(c for c in frame["components"] if c["id"] == body[1 + 2 * i])
                comp |= {"dc": huff.get(body[2 + 2 * i] >> 4), "ac": huff.get(0x10 | body[2 + 2 * i] & 15)}
                chosen.append(comp)
            start, end, approx = body[1 + 2 * n : 4 + 2 * n]
            found = _SCAN_END.search(media, at)
            stop = found.start() if found else len(media)
            _decode_scan(media[at:stop], chosen, (start, end, approx >> 4, approx & 15), interval, frame["mcus"])
            at = stop
    if frame is None:
        raise ValueError("no frame")
    return frame | {"quant": quant, "payload_bytes": note}


@lru_cache(maxsize=1)
def _inverse() -> np.ndarray:
    """Row k: the 64 samples of zigzag coefficient k."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)[:, None]
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)  # u: rows
    return np.ascontiguousarray(full[ZIGZAG], dtype=np.float32)


def to_rgb(frame: dict) -> np.ndarray:
    """Inverse transform, chroma upsampling and colour conversion: uint8 (height, width, 3)."""
    planes = []
    for c in frame["components"]:
        samples = c["coefs"].astype(np.float32) @ (_inverse() * frame["quant"][c["q"]][:, None])
        samples = np.clip(np.rint(samples + np.float32(128)), 0, 255).astype(np.int16)
        plane = samples.reshape(c["high"], c["wide"], 8, 8).swapaxes(1, 2).reshape(c["high"] * 8, c["wide"] * 8)
        planes.append(plane.repeat(frame["v"] // c["v"], 0).repeat(frame["h"] // c["h"], 1)[: frame["height"], : frame["width"]])
    if len(planes) == 1:
        planes = [planes[0], *[np.full_like(planes[0], 128)] * 2]
    y, cb, cr = planes
    cb, cr, out = cb.astype(np.int32) - 128, cr.astype(np.int32) - 128, np.empty((*y.shape, 3), np.uint8)
    # The colour matrix of JFIF in 16-bit fixed point.
    for k, part in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
        out[..., k] = np.clip(y + ((part + 32768) >> 16), 0, 255)
    return out


def payload_of(frame: dict) -> bytes:
    """The stored payload, from the coefficient arrays."""
    values = np.concatenate([c["coefs"] for c in frame["components"]])
    out = np.where(values > 0, values, values + 255)
    out[:, 0] = values[:, 0] + 128
    return out.astype(np.uint8).tobytes()[: frame["payload_bytes"]]


# ---------------------------------------------------------------- operators

_STORED = "doc_id long, n_bytes long, media binary"
_READ = "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary, error string"


def store_media(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_bytes and the progressive JPEG of each text's payload."""
    bounded_batches(docs.sparkSession)

    def build(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])

    def store(batch):
        rows = ((i, len(data := t.encode()), encode_progressive(pad_payload(data))) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        return chunks_by_bytes(rows, lambda r: len(r[2]), build)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_of(column)), store, _STORED)


def read_media(stored: DataFrame) -> DataFrame:
    """Decode the media column: adds the payload (null for media of others) and the RGB tensor (row-major bytes, with its
    height and width), or the error."""
    bounded_batches(stored.sparkSession)

    def build(rows):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "media", "payload", "height", "width", "rgb", "error"])

    def read(batch):
        def rows():
            for i, n, media in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    frame = decode_coefficients(media)
                    payload = payload_of(frame) if frame["payload_bytes"] is not None else None
                    yield i, n, media, payload, frame["height"], frame["width"], to_rgb(frame).tobytes(), None
                except (ArithmeticError, IndexError, KeyError, StopIteration, struct.error, TypeError, ValueError) as e:
                    yield i, n, media, None, None, None, None, f"{type(e).__name__}: {e}"

        return chunks_by_bytes(rows(), lambda r: sum(len(r[k] or b"") for k in (2, 3, 6)), build)

    return arrow_map(stored.select("doc_id", "n_bytes", "media"), read, _READ)


def media_digest(read: DataFrame) -> DataFrame:
    """The digest row of each stored document; the feature is the tensor's shape and a CRC of its samples."""
    payload = F.col("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "height", "width"), F.lower(F.hex(F.crc32("rgb")))).alias("feature"),
    )
