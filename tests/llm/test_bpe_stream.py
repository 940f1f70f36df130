import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe_stream as B

PATH = B.default_tokenizer()


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return B.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    pools = ["abcdefgh ", "thereand inging", "aA'sdmrevl ", "éèüßñ çà ", "0123456789 ,.", "\n\t \r\x0b\x0c\x85\xa0 \x1c", "日本語テキスト漢字", "👍🏽é́‍😀", "!@#$%^&*()_+|", "".join(map(chr, range(256)))]
    out = ["", " ", "a" * 3000, "ab" * 2000, " " * 500, "<|endoftext|>", "x<|endoftext|> y<|endo", "'s's'll", "=" * 999 + "-" * 999, "1" * 700]
    for _ in range(600):
        out.append("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 60))))
        out.append("".join(rng.choice(pools[rng.randrange(3)]) for _ in range(rng.randrange(1, 200))))
    return out


def test_encoding_and_decoding_as_the_library(codec, library):
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert list(codec.encode(text)) == want, repr(text[:80])
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_decoding_of_broken_sequences(codec, library):
    rng = random.Random(2)
    for _ in range(400):
        ids = [rng.choice([*range(256), 50256, rng.randrange(50257)]) for _ in range(rng.randrange(12))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_small_windows_emit_the_same_and_hold_little(codec):
    rng = random.Random(9)
    for alphabet in ("a", "ab", "theing", "=-", " "):
        word = "".join(rng.choice(alphabet) for _ in range(20_000)).encode()
        whole = B.Encoder(codec.m, 1 << 30)
        want = [*whole.feed(word), *whole.finish()]
        part, got, held = B.Encoder(codec.m, 300), [], 0
        for k in range(0, len(word), 7):
            got += part.feed(word[k : k + 7])
            held = max(held, len(part.data))
        assert got + part.finish() == want
        assert held <= 2 * codec.m.lookahead() + 300


def test_query_rows(spark, library):
    rows = [(0, None, 1), (1, "", 2), (2, "Hello <|endoftext|> wörld", 3), (2, "Hello <|endoftext|> wörld", 3), (4, "x" * 100_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = B.token_digest(B.tokenize(docs)).collect()
    assert len(got) == 5
    for r in got:
        text = {i: t for i, t, _ in rows}[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert B.tokenize(docs.limit(0)).count() == 0


def test_long_texts_in_steps(codec, library, monkeypatch):
    import random

    rng = random.Random(5)
    text = "".join(rng.choice(("word ", "é", "漢字", " \n\n", "x" * 9, "'ll", " 12", "<|endoftext|>", "\U0001f600")) for _ in range(20_000))
    for step in (7, 50_000):
        monkeypatch.setattr(B, "_STEP", step)
        ids = codec.encode(text)
        assert list(ids) == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(list(ids), skip_special_tokens=False)


def test_other_tokenizer_files_are_refused():
    import json

    import pytest

    with open(B.default_tokenizer(), encoding="utf-8") as f:
        data = json.load(f)
    data["model"] |= {"vocab": {}, "merges": []}
    for section, key, value in (("model", "ignore_merges", True), ("model", "end_of_word_suffix", "</w>"), ("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "type", "Metaspace"), (None, "normalizer", {"type": "NFC"})):
        own = {**data, key: value} if section is None else {**data, section: {**data[section], key: value}}
        with pytest.raises(ValueError, match="tokenizer file"):
            B._refuse_others(own)
    B._refuse_others(data)
