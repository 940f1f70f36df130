import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import ef_trie as T
from tidemark.llm.elias_fano import EliasFano


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1, 2**62), (5, 6), (1000, 3000), (1000, 2**60), (5000, 100)])
def test_elias_fano_against_a_sorted_array(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    coded = EliasFano.from_bytes(np.frombuffer(EliasFano.build(values).to_bytes(), np.uint8))
    assert (coded.get(np.arange(n)) == values).all()
    if n > 1:
        before, after = coded.pair(np.arange(n - 1))
        assert (before == values[:-1].astype(np.int64)).all() and (after == values[1:].astype(np.int64)).all()
    query = np.concatenate([values, rng.integers(0, top, 500).astype(np.uint64), np.array([2**63 - 1], np.uint64)])
    got, known = coded.find(query), set(values.tolist())
    assert all((g >= 0) == (q in known) and (g < 0 or values[g] == q) for g, q in zip(got.tolist(), query.tolist(), strict=True))
    if n > 10:
        first, past = np.full(len(query), n // 3), np.full(len(query), n // 2)
        got = coded.find(query, first, past)
        inside = set(values[n // 3 : n // 2].tolist())
        assert all((g >= 0) == (q in inside) and (g < 0 or n // 3 <= g < n // 2) for g, q in zip(got.tolist(), query.tolist(), strict=True))


def test_elias_fano_with_wide_gaps_and_long_runs():
    values = np.array([*[5] * 3000, *range(10**6, 10**6 + 40), *[10**12] * 500, *(10**12 + 7 * np.arange(2000)), 2**62], np.uint64)
    coded = EliasFano.from_bytes(np.frombuffer(EliasFano.build(values).to_bytes(), np.uint8))
    assert (coded.get(np.arange(len(values))) == values).all()
    before, after = coded.pair(np.arange(len(values) - 1))
    assert (before.astype(np.uint64) == values[:-1]).all() and (after.astype(np.uint64) == values[1:]).all()
    got = coded.find(values)
    assert (values[got] == values).all() and (coded.find(values + np.uint64(3)) < 0).sum() > 2000


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


class Brute:
    """The model by its definition."""

    def __init__(self, texts, order):
        self.order, self.count = order, Counter()
        seqs = [words_of(t) for t in texts]
        for s in seqs:
            self.count.update(s)
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.grams = {}
        for k in range(2, order + 1):
            grams = Counter()
            for s in seqs:
                for i in range(len(s) - k + 1):
                    g = tuple(s[i : i + k])
                    grams[g] += 1
            self.grams[k] = {g: n for g, n in grams.items() if n >= T.LEAST_COUNT}
        self.mass = defaultdict(float)
        for k in self.grams:
            for g, n in self.grams[k].items():
                self.mass[g[:-1]] += n - T.DISCOUNT

    def p(self, context, w):
        if not context:
            return (self.count[w] + 0.1) / (self.n + 0.1 * (self.v + 1))
        low = self.p(context[1:], w)
        total = self.count[context[0]] if len(context) == 1 else self.grams[len(context)].get(context)
        if context not in self.mass:
            return low
        here = self.grams[len(context) + 1].get((*context, w), 0)
        return max(here - T.DISCOUNT, 0) / total + (1 - self.mass[context] / total) * low

    def score(self, text):
        s = words_of(text)
        return sum(math.log10(self.p(tuple(s[max(0, i - self.order + 1) : i]), w)) for i, w in enumerate(s))

    def base(self, text):
        return sum(math.log10(self.p((), w)) for w in words_of(text))


@pytest.mark.parametrize("order", [2, 3, 5])
def test_against_the_definition(spark, monkeypatch, order):
    monkeypatch.setattr(T, "SHARD_ROWS", 40)
    rng = random.Random(order)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "é", "Big", "big"]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(16)], k=rng.randrange(0, 40))) for _ in range(150)]
    texts += [None, "", " \t\n", "unknown word here", "w0 w1 " * 500, "w0 w1 w2", "w0 w1 w2"]
    rows = [(i, t, 1.0) for i, t in enumerate(texts)]
    model = Brute([t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10], order)
    got = {r.doc_id: r for r in T.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score double"), order).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r, own = got[i], words_of(t)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and r.train_tokens == model.n
        assert r.n_tokens == len(own) and r.n_known == sum(model.count[w] > 0 for w in own)
        assert r.base_score == pytest.approx(model.base(t), abs=1e-6)
        assert r.score == pytest.approx(model.score(t), abs=6e-4 * len(own)), (i, t)
    context = ("w0",)
    assert sum(model.p(context, w) for w in model.count) + model.p(context, "never") == pytest.approx(1)


def test_better_than_its_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = T.score_documents(docs).where("held_out").toPandas()
    print("held-out log10 a token: base", rows.base_score.sum() / rows.n_tokens.sum(), "model", rows.score.sum() / rows.n_tokens.sum())
    assert rows.score.sum() > rows.base_score.sum() and len(rows) > 800


def test_edge_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b")], "doc_id long, text string")
    assert T.score_documents(docs).count() == 2
    assert T.score_documents(docs.limit(0)).count() == 0


def test_repeated_ngrams_of_rare_words_are_kept(spark):
    """Words far below any share of the corpus, in n-grams that occur twice."""
    texts = ["common words here " * 60_000, "quokka numbat bilby", "a quokka numbat bilby", "numbat quokka", "once only potoroo"]
    texts = ["", *texts]
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    assert train == texts
    rows = T.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    model = Brute(texts, 3)
    assert ("quokka", "numbat", "bilby") in model.grams[3] and ("bilby", None) in model.grams[2]
    for r in rows:
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), abs=6e-4 * r.n_tokens), r.doc_id


def test_packed_grams():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, top, 500) for top in (1, 200, 70_000, 2**62)]
    assert all((a == b).all() for a, b in zip(columns, T._unpacked(T._packed(columns)), strict=True))
    keys = [rng.integers(-1, 4, 500) for _ in range(3)]
    got = T._merged([*keys, np.ones(500, np.int64)])
    assert Counter(zip(*(c.tolist() for c in keys), strict=True)) == {tuple(g): n for *g, n in zip(*(c.tolist() for c in got), strict=True)}
