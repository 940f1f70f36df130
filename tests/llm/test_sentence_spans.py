import random

import pytest

from tidemark.llm import sentence_spans as S


def brute(docs):
    """The rule by definition, over lists of sentences."""
    def enough(s, k, e):
        return any(e - k >= least and sum(len(x.split()) for x in s[k:e]) >= size for least, size in S.RUNS)

    found, split = {}, {}
    for i, text in docs:
        starts, own = S.sentences(text or "")
        split[i] = (starts + [len(text or "")], own)
        n = len(own)
        for k in range(n):
            for e in range(k + 1, n + 1):
                if enough(own, k, e) and (not enough(own, k, e - 1) or not enough(own, k + 1, e)):
                    found.setdefault(tuple(own[k:e]), []).append((i, k, e))
    gone = {}
    for places in found.values():
        for i, k, e in sorted(places)[1:]:
            gone.setdefault(i, set()).update(range(k, e))
    out = {}
    for i, text in docs:
        starts, own = split[i]
        keep, text = [], text or ""
        out[i] = text if i not in gone else (text[: starts[0]] + "".join(text[starts[k] : starts[k + 1]] for k in range(len(own)) if k not in gone[i])).strip()
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 5, 9, 20, 55)))).capitalize() + rng.choice((".", "!", "?!", "."))
    shared = [[sentence() for _ in range(rng.randrange(1, 7))] for _ in range(6)]
    docs = []
    for i in range(n):
        own = [sentence() for _ in range(rng.randrange(0, 8))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(own) + 1)
            own[at:at] = rng.choice(shared)
        docs.append((i, rng.choice((" ", "\n", "  \n ")).join(own)))
    return docs


@pytest.mark.parametrize("hot", [5000, 30, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_RUNS", hot)
    for seed in range(3):
        docs = corpus(seed)
        want = brute(docs)
        df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hash string")
        got = {r.doc_id: r.text for r in S.remove_repeats(df).collect()}
        assert got == want
        rows = {r.doc_id: r for r in S.changed_documents(df).collect()}
        assert {i: r.text for i, r in rows.items()} == {i: t for i, t in want.items() if t != dict(docs)[i]}
        assert all(f <= i for i, r in rows.items() for f in r.first_doc_ids)


def test_edge_rows(spark):
    long = " ".join(f"Word{k} and more words stand here now." for k in range(20_000))
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, long, 1), (3, long, 2), (3, long, 2), (None, "A b. C d.", 3)], "doc_id long, text string, first int")
    rows = S.remove_repeats(docs).collect()
    assert len(rows) == 6 and [r.text for r in rows if r.doc_id == 3] == ["", ""]
    assert [r.text for r in rows if r.doc_id == 2] == [long]
    assert sorted(str(r.text) for r in rows if r.doc_id is None) == ["A b. C d.", "None"]
    assert S.remove_repeats(docs.limit(0)).count() == 0
    assert S.changed_documents(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    """Spans of one row never cut another; columns named like the operator's own pass through."""
    passage = " ".join(f"Sentence number {k} of the passage has some words." for k in range(9))
    other = " ".join(f"Quite another text, part {k}, stands in this row." for k in range(40))
    names = "doc_id long, text string, _key int, _spans string, spans int, row string, twin int, first int"
    rows = [(1, passage), (7, passage), (7, other), (None, "Own words. " + passage), (None, other + " End."), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "s", 2, "r", 3, 4) for i, t in rows], names)
    out = S.remove_repeats(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    # the rows without id come first: theirs stay, and what they hold goes from the others
    assert got == sorted([(1, ""), (7, ""), (7, ""), (0, "Own words. " + passage), (0, other + " End."), (0, "")])
    alone = spark.createDataFrame([(1, passage), (7, passage), (7, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in S.remove_repeats(alone).collect()) == sorted([(1, passage), (7, ""), (7, other)])
    assert [(r.doc_id, r.first_doc_ids, r.removed_chars) for r in S.changed_documents(alone).collect()] == [(7, [1], len(passage))]


def test_passages_of_over_fifty_words_are_caught(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    sentence = lambda: (" ".join(word() for _ in range(rng.randrange(3, 25))) + ".").capitalize()
    passage = []
    while sum(len(s.split()) for s in passage) <= 50:
        passage.append(sentence())
    rows = [(i, " ".join([*(sentence() for _ in range(5)), *(passage if i % 2 else []), *(sentence() for _ in range(5))])) for i in range(20)]
    got = {r.doc_id: r.text for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i % 2 == 0 or i == 1:
            assert got[i] == text
        else:
            assert not any(s in got[i] for s in passage) and len(got[i].split(". ")) == 10
