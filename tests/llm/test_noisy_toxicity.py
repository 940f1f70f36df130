import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import noisy_toxicity as N


@pytest.fixture(scope="module")
def restorer():
    words = Counter({"the": 50, "idiot": 5, "stupid": 5, "dilate": 3, "clown": 5, "little": 9, "old": 8, "lit": 4, "you": 30, "are": 30})
    return N.Restorer(N.CharacterModel(words), {"idiot", "stupid", "clown"})


@pytest.mark.parametrize(("noisy", "want"), [("1d10t", "idiot"), ("5tup1d", "stupid"), ("$tup!d", "stupid"), ("iiidiooot", "idiot"), ("cl0wn", "clown")])
def test_tokens_are_restored(restorer, noisy, want):
    assert restorer.restore(f"you are {noisy}!") == f"you are {want}!"


def test_spelled_out_words_are_restored(restorer):
    assert restorer.restore("you i d i o t are") == "you idiot are"
    assert restorer.restore("you c-l-o-w-n are") == "you clown are"
    assert restorer.restore("You are a Little old") == "you are a little old"


def test_viterbi_against_all_paths(restorer):
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("i1d0otl .s5") for _ in range(rng.randrange(2, 7)))
        best = -math.inf
        for path in itertools.product(*(restorer._options(text, k) for k in range(len(text)))):
            score, a, b, word = 0.0, "^", "^", ""
            for c, cost in path:
                score += cost
                if c is None:
                    continue
                if c == "^":
                    if b != "^":
                        score += restorer.model.log(a, b, "^") + (restorer.bonus if word in restorer.lexicon else 0)
                    a, b, word = "^", "^", ""
                else:
                    score += restorer.model.log(a, b, c)
                    a, b, word = b, c, word + c
            if b != "^":
                score += restorer.model.log(a, b, "^") + (restorer.bonus if word in restorer.lexicon else 0)
            best = max(best, score)
        got = restorer.decode(text)
        # the decoded string has a path of the best score
        reach = -math.inf
        for path in itertools.product(*(restorer._options(text, k) for k in range(len(text)))):
            out = re.sub(r"\^+", " ", "".join(c or "" for c, _ in path)).strip()
            if out != got:
                continue
            score, a, b, word = 0.0, "^", "^", ""
            for c, cost in path:
                score += cost
                if c is None:
                    continue
                if c == "^":
                    if b != "^":
                        score += restorer.model.log(a, b, "^") + (restorer.bonus if word in restorer.lexicon else 0)
                    a, b, word = "^", "^", ""
                else:
                    score += restorer.model.log(a, b, c)
                    a, b, word = b, c, word + c
            if b != "^":
                score += restorer.model.log(a, b, "^") + (restorer.bonus if word in restorer.lexicon else 0)
            reach = max(reach, score)
        assert abs(reach - best) < 1e-9, (text, got)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = N.toxicity_rows(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    bad, good = held[held.toxic == 1], held[held.toxic == 0]
    print("recall", bad.predicted.mean(), "false", good.predicted.mean(), "accuracy", (held.predicted == held.toxic).mean())
    assert bad.predicted.mean() > 0.9 and good.predicted.mean() < 0.02


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "you 1d10t " * 20_000, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = N.toxicity_rows(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
    assert N.toxicity_rows(docs.limit(0), labels).count() == 0
    assert N.toxicity_rows(docs, labels.limit(0)).count() == 4


FORMS = {"idio7": "idiot", "you idi07 now": "you idiot now", "gra33": "grae", "stuupid": "stupid", "m 0 r 0 n": "moron", "k 1 l l": "kill", "i d 1 o t": "idiot", "i.d.1.0.t": "idiot", "h€ll": "hell", "!diot": "idiot", "(lown": "clown", "$ t u p i d": "stupid"}


@pytest.mark.parametrize("noisy", FORMS)
def test_noise_is_decoded_wherever_the_lattice_has_it(noisy):
    """Look-alikes at any place, one doubled letter, spelled-out words: in a text without other noise."""
    toxic = {"idiot", "stupid", "clown", "moron", "kill", "hell"}
    words = Counter({"the": 50, "grace": 5, "great": 8, "you": 30, "now": 20, "dilate": 3, "little": 9} | dict.fromkeys(toxic, 5))
    assert N.Restorer(N.CharacterModel(words), toxic).restore(noisy) == FORMS[noisy]
    assert N.Restorer(N.CharacterModel(words), toxic).restore("(you) now! 1990 the little") == "(you) now! 1990 the little"


def test_every_look_alike_is_decoded_at_every_place(restorer):
    for like in N.LOOKALIKES:
        assert N._NOISY.search(f"ab{like}") and N._NOISY.search(f"{like}ab") and N._NOISY.search(f"a{like}b")
        assert all(N._SPELLED.fullmatch(sep.join(("a", like, "b"))) for sep in N.SEPARATORS)


def test_query_against_plain_loops(spark):
    """The query's rows from labels chosen by hand, with the noisy tokens found by splitting instead of by patterns."""
    import numpy as np
    import pandas as pd

    folder = "/root/testdata/sf0.001"
    docs, labels = (pd.read_parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    label = {i: y for i, y in zip(labels.doc_id, labels.toxic, strict=True) if zlib.crc32(str(i).encode()) % 3 != 1}
    own = sorted((i, t) for i, t in zip(docs.doc_id, docs.text, strict=True) if i in label)
    model = N.ToxicityModel([t for _, t in own], np.array([label[i] for i, _ in own], float))
    got = {r.doc_id: r for r in N.toxicity_rows(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        low = N._SPELLED.sub(lambda m: model.restorer.decode(m[0]), text.lower())
        words = []
        for token in low.split():
            noisy = any(c in N.LOOKALIKES for c in token) or any(a == b and a.isalpha() for a, b in zip(token, token[1:], strict=False))
            words += (model.restorer._token(re.match(r"[\s\S]*", token)) if noisy else token).split()
        found = set()
        for w in N.word_set(" ".join(words))[0]:
            found.add((w, max([model.weights.get(w, 0.0), *(model.weights.get(w[:k] + b"*", 0.0) for k in (4, 5, 6, 7) if len(w) > 4)])))
        best = [x for _, x in found if x]
        row = [1.0, max(best, default=0.0) / 8, min(len(best), 8) / 8, float(bool(best)), math.log1p(N.word_set(" ".join(words))[1]) / 10]
        score = 1 / (1 + math.exp(-sum(a * b for a, b in zip(row, model.coef, strict=True))))
        assert abs(got[i].score - score) < 1e-9, i
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(score >= 0.7)


def test_every_labelled_row_is_learnt_from(spark, monkeypatch):
    """More rows than a sample of 10,000: character weights, lexicon and coefficients are those of all texts at once."""
    import numpy as np

    monkeypatch.setattr(N, "COUNTED", 500, raising=False)  # tasks pass their counts on often
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeioust", k=rng.randrange(2, 8))) for _ in range(600)]
    rows, marks = [], []
    for i in range(16_000):
        toxic = int(rng.random() < 0.1)
        rows.append((i, " ".join([*rng.choices(words, k=5), f"own{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", *([rng.choice(["1d10t", "idiot", "clown"])] if toxic else ["t00"])])))
        marks.append((i, toxic))
    own = [(t, y) for (i, t), (_, y) in zip(rows, marks, strict=True) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(own) > 10_000
    want = N.ToxicityModel([t for t, _ in own], np.array([y for _, y in own], float))
    got = N.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert got.restorer.model.tri == want.restorer.model.tri and got.restorer.model.total == want.restorer.model.total
    assert got.weights == want.weights and b"idiot" in got.weights
    assert np.abs(got.coef - want.coef).max() < 1e-9
