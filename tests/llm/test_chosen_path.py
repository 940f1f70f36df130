import random
import re

import numpy as np
import pytest

from tidemark.llm import chosen_path as C


def brute(docs):
    """Sets by the definition, all pairs, classes by search."""
    sets = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=12, copies=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((1, 2, 4, 5, 8, 40, 120, 300)))]
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(own) // 20) + 1)):
                own[rng.randrange(len(own))] = word()
            docs.append(rng.choice((" ", "\n ", "\t")).join(own).upper() if rng.random() < 0.2 else " ".join(own))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_classes_against_brute_force(spark):
    for seed in range(2):
        docs = [*corpus(seed), (900, None), (901, ""), (902, " \n "), (903, "É é"), (904, "é é")]
        want = brute(docs)
        df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, keys string")
        rows = C.near_duplicate_classes(df).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(docs)


@pytest.mark.parametrize(("leaf", "weight"), [(16, 400_000), (4, 400_000), (4, 3_000), (2, 600)])
def test_large_near_copy_group_and_stray_members(spark, monkeypatch, leaf, weight):
    monkeypatch.setattr(C, "LEAF", leaf)
    monkeypatch.setattr(C, "NODE_SHINGLES", weight)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    docs = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 12)):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    want = brute(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in C.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_same_step_with_the_probability_of_the_similarity():
    rng = np.random.default_rng(0)
    meet, total = 0, 0
    for _ in range(300):
        both, a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (80, 10, 10))
        x, y = C.base_keys(np.unique(np.concatenate([both, a]))), C.base_keys(np.unique(np.concatenate([both, b])))
        meet, total = meet + int((x == y).sum()), total + len(x)
    assert abs(meet / total - 0.8**3) < 0.03


def test_versions_of_one_page(spark):
    """Each version changes a little, so that only neighbours link: one class, however long the chain."""
    rng = random.Random(2)
    words, docs = [f"v{k}" for k in range(120)], []
    for i in range(60):
        for _ in range(2):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in C.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and {c for _, c in got.values()} == {0}


def test_edge_rows(spark):
    text, other = "one two three four five six", "other words are here now"
    docs = spark.createDataFrame([(None, text, 1), (5, text, 1), (5, text, 1), (5, other, 1), (7, other, 2), (8, "z " * 100_000, 1), (9, None, 1), (9, " \t", 1), (None, "only here, without an id", 3)], "doc_id long, text string, n int")
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in C.near_duplicate_classes(docs).collect()), key=str)
    assert rows == sorted([(None, 3, 5, False), (5, 3, 5, True), (5, 3, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 1, 8, True), (9, 0, 9, True), (9, 0, 9, True), (None, 2, None, True)], key=str)
    kept = C.keep_one_of_each(docs)
    assert kept.dtypes == docs.dtypes and sorted(((r.doc_id or 0, r.text and r.text[:5]) for r in kept.collect()), key=str) == sorted([(5, "one t"), (5, "other"), (8, "z z z"), (9, None), (9, " \t"), (0, "only ")], key=str)
    assert C.near_duplicate_classes(docs.limit(0)).count() == 0 and C.keep_one_of_each(docs.limit(0)).count() == 0


def test_rows_with_different_texts_stay_whatever_their_ids(spark):
    names = "doc_id long, text string, _row int, _kept string, row int, twin string, wordless int, `a.b` int"
    texts = ["alpha beta gamma delta epsilon", "some entirely different words here", "a third text of its own kind", "and the fourth one is unlike them"]
    docs = spark.createDataFrame([(i, t, 1, "k", 2, "t", 3, 4) for i, t in zip((None, None, 3, 3), texts, strict=True)], names)
    kept = C.keep_one_of_each(docs)
    assert kept.dtypes == docs.dtypes and sorted(r.text for r in kept.collect()) == sorted(texts)


def test_query_against_its_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    want = con.sql(C.ORACLE)
    found = C.near_duplicate_classes(spark.read.parquet(path))
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
