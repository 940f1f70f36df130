import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import media_jpeg as M


def test_zigzag_starts_as_the_standard_says():
    assert M.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert M.ZIGZAG[-3:].tolist() == [55, 62, 63]


@pytest.mark.parametrize("size", [1, 191, 192, 193, 384, 385, 5000, 70000])
def test_round_trip_is_exact(size):
    data = M.pad_payload(random.Random(size).randbytes(size))
    frame = M.decode_coefficients(M.encode_progressive(data))
    assert M.payload_of(frame) == data


def test_scalar_reader_agrees_with_the_fast_one(monkeypatch):
    data = M.pad_payload(random.Random(3).randbytes(3000))
    media = M.encode_progressive(data)
    fast = M.decode_coefficients(media)
    for name in ("_ac_first_fast", "_ac_refine_fast"):
        monkeypatch.setattr(M, name, lambda *a: False)
    monkeypatch.setattr(M, "_dc_first_fast", lambda *a: (_ for _ in ()).throw(ValueError()))
    slow = M.decode_coefficients(media)
    for a, b in zip(fast["components"], slow["components"], strict=True):
        assert (a["coefs"] == b["coefs"]).all()


def test_inverse_transform_against_the_definition():
    rng = np.random.default_rng(1)
    zz = rng.integers(-30, 30, 64)
    block = np.zeros(64)
    block[M.ZIGZAG] = zz
    block = block.reshape(8, 8)
    c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    want = [[sum(c(u) * c(v) / 4 * block[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for y in range(8)] for x in range(8)]
    assert np.allclose(zz.astype(np.float32) @ M._inverse(), np.array(want).ravel(), atol=1e-3)


def test_new_coefficients_in_a_refinement_scan():
    comp = {"coefs": np.zeros((1, 64), np.int32), "ac": M._huffman(bytes([0, 2, *[0] * 14]), bytes([0x01, 0x00]))}
    comp["coefs"][0, 1] = 2
    # symbol 0x01 (code 00), sign 1, correction bit 1 of coefficient 1, then symbol 0x00 (code 01)
    bits = [0, 0, 1, 1, 0, 1]
    M._scalar_scan(M._packed(np.array(bits, np.uint8)), [comp], (1, 5, 1, 0), range(1))
    assert comp["coefs"][0, :4].tolist() == [0, 3, 1, 0]


def foreign(rng, width, height, interval):
    """A 4:2:0 progressive JPEG of any size with restart intervals; and the coefficients that were sent."""
    frame = M.struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", M._tables_head(), M._segment(0xC2, frame), M._segment(0xDD, M.struct.pack(">H", interval))]
    sent = []
    for c, step in ((0, 8), (1, 16), (2, 16)):
        blocks = rng.integers(128, 256, (-(-height // step) * -(-width // step), 64)).astype(np.uint8)
        sent.append(blocks)
        parts = [blocks[k : k + interval] for k in range(0, len(blocks), interval)]

        def scan(start, end, high, low, tables, code, c=c, parts=parts):
            coded = [code(p).replace(b"\xff", b"\xff\x00") for p in parts]
            body = b"".join(x + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(coded) else b"") for k, x in enumerate(coded))
            out.append(M._scan(c, start, end, high, low, tables, b"") + body)

        scan(0, 0, 0, 1, 0, M._dc_first)
        scan(1, 63, 0, 1, 0, lambda p: (p[:, 1:] >> 1).tobytes())
        scan(0, 0, 1, 0, 0, lambda p: M._packed(np.ascontiguousarray(p[:, 0]) & 1))
        scan(1, 63, 1, 0, 1, lambda p: M._ac_refine((p[:, 1:] & 1 ^ (p[:, 1:] < 128)).astype(np.uint8).ravel(), len(p)))
    return b"".join([*out, b"\xff\xd9"]), sent


@pytest.mark.parametrize(("width", "height", "interval"), [(24, 15, 3), (33, 40, 1), (16, 16, 100), (7, 9, 2)])
def test_partial_units_and_restarts(width, height, interval):
    media, sent = foreign(np.random.default_rng(width), width, height, interval)
    frame = M.decode_coefficients(media)
    for comp, blocks in zip(frame["components"], sent, strict=True):
        got = comp["coefs"].reshape(comp["high"], comp["wide"], 64)[: comp["own_high"], : comp["own_wide"]].reshape(-1, 64)
        want = blocks.astype(np.int32)
        want[:, 0] -= 128
        assert (got == want).all()
    assert M.to_rgb(frame).shape == (height, width, 3)


def test_media_that_cannot_be_decoded_are_rows(spark):
    good = M.encode_progressive(M.pad_payload(b"x"))
    other, _ = foreign(np.random.default_rng(1), 20, 20, 5)
    huge = good[:2] + M._segment(0xC2, M.struct.pack(">BHHB", 8, 65535, 65535, 1) + bytes([1, 0x11, 0]))
    rows = [(1, 1, good), (2, 1, None), (3, 1, b""), (4, 1, b"no image"), (5, 1, good[:300]), (6, 1, other), (7, 1, huge), (8, 1, good[: len(good) // 2])]
    got = {r.doc_id: r for r in M.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(got) == 8 and got[1].error is None and got[6].error is None and got[6].payload is None and len(got[6].rgb) == 1200
    assert all(got[i].error and got[i].rgb is None for i in (2, 3, 4, 5, 7))


def test_query_rows(spark):
    texts = [None, "", "a" * 192, "é" * 500, os.urandom(50).hex(), "a" * 192]
    rows = [(i, t, "x", b"clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature string, media binary")
    got = {r["doc_id"]: r for r in M.media_digest(M.read_media(M.store_media(docs))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = M.pad_payload(raw)
        assert got[i]["n_bytes"] == len(raw) and got[i]["payload_bytes"] == len(data)
        assert got[i]["payload_sha256"] == hashlib.sha256(data).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(data[-16:])
    assert got[2]["media_sha256"] == got[5]["media_sha256"] and got[0]["feature"] == got[1]["feature"]
    assert M.media_digest(M.read_media(M.store_media(docs.limit(0)))).count() == 0
