import random

import numpy as np

from tidemark.llm import qgram_decontam as D


def brute(item, text, k):
    """Least edits of the item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def spoil(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyzq")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("xyzq"))
    return "".join(out)


def test_against_full_alignment():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    for trial in range(60):
        items = [(i, " ".join(word() for _ in range(rng.randrange(3, 30)))) for i in range(4)]
        block = D.ItemBlock(items)
        text = " ".join(word() for _ in range(rng.randrange(5, 40)))
        for i, item in items[:2]:
            noisy = spoil(rng, item, rng.randrange(0, int(len(item) * 0.14) + 1))
            text += " " + noisy + " " + " ".join(word() for _ in range(6))
        own = D.normal(text)
        got = {}
        for i, start, end, edits in block.matches(text):
            got[i] = min(edits, got.get(i, 99))
            assert D._distance(D._codes(dict((a, D.normal(b)) for a, b in items)[i]), D._codes(own[start:end])) == edits
        for i, item in items:
            n = D.normal(item)
            least = brute(n, own, 0)
            assert (i in got) == (least <= D.edit_budget(len(n))), (trial, i, least, D.edit_budget(len(n)))
            if i in got:
                assert got[i] == least


def test_repeated_characters_are_counted_in_parts(monkeypatch):
    block = D.ItemBlock([(1, "a" * 100), (2, "ab" * 40)])
    text = "x" * 50 + "a" * 3000 + "ab" * 50
    whole = block.matches(text)
    monkeypatch.setattr(D, "HITS", 1000)
    assert block.matches(text) == whole and {m[0] for m in whole} == {1, 2}


def test_exact_passages_in_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    items = [(r.item_id, D.normal(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in D.normal(r.text)}
    assert want and want <= got
    assert len(got - want) <= 0.2 * len(want) + 2
    kept = {r.doc_id for r in D.drop_contaminated(docs, bench).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_edge_rows(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog every day"), (1, "The quick brown fox jumps over the lazy dog every day"), (2, None), (3, ""), (None, "pi = 3"), (5, "ok!")], "item_id long, text string")
    long = "x y z " * 200_000 + "the QUICK brown  fox jumps over\nthe lazy dog every day"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, long, 1), (None, "so pi = 3 here", 1), (4, "look", 1), (5, "ok! then", 1), (5, "ok! then", 1)], "doc_id long, text string, edits int")
    rows = sorted(((r.doc_id or -1, r.item_id or -1, r.edits) for r in D.contaminated(docs, bench).collect()))
    assert rows == [(-1, -1, 0), (3, 1, 0), (5, 5, 0), (5, 5, 0)]
    assert {r.doc_id for r in D.drop_contaminated(docs, bench).collect()} == {1, 2, 4}
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0
    monkeypatch.setattr(D.item_blocks, "__defaults__", (20,))
    assert D.contaminated(docs, bench).count() == 4
