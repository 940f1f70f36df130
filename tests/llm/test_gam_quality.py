import zlib

import numpy as np

from tidemark.llm import gam_quality as G


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = G.AdditiveModel(pairs=1).fit(x[:3000], y[:3000])
    assert list(model.grids) == [(0, 1)]
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.93


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((500, 2))
    y = (x[:, 0] + 0.2 * rng.random(500) > 0.6).astype(float)
    m = G.AdditiveModel(rounds=20, pairs=1, pair_rounds=5).fit(x, y)
    for row in x[:20]:
        total = m.base + sum(t[sum(c < v for c in cuts)] for t, cuts, v in zip(m.tables, m.cuts, row, strict=True))
        total += m.grids[0, 1][sum(c < row[0] for c in m.rough[0]), sum(c < row[1] for c in m.rough[1])]
        assert abs(m.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = G.quality_rows(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    pairs = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean()
    print("AUC", pairs, "accuracy", (held.predicted == held.quality).mean())
    assert pairs > 0.9 and (held.predicted == held.quality).mean() > 0.9


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "x " * 50_000, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    rows = G.quality_rows(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
    assert G.quality_rows(docs.limit(0), labels).count() == 0
    assert G.quality_rows(docs, labels.limit(0)).count() == 4
    assert set(G.accept(docs, labels).columns) == set(docs.columns)


def test_query_against_plain_loops(spark):
    """The query's rows from labels chosen by hand and table entries added one by one."""
    import bisect
    import math
    import zlib

    import pandas as pd

    folder = "/root/testdata/sf0.001"
    docs, labels = (pd.read_parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    label = {i: y for i, y in zip(labels.doc_id, labels.quality, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2}
    own = sorted((i, t) for i, t in zip(docs.doc_id, docs.text, strict=True) if i in label)
    model = G.AdditiveModel().fit(G.feature_matrix([t for _, t in own]), np.array([label[i] for i, _ in own], float))
    got = {r.doc_id: r for r in G.quality_rows(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        x, margin = G.features(text), model.base
        for value, cuts, table in zip(x, model.cuts, model.tables, strict=True):
            margin += table[bisect.bisect_left(cuts.tolist(), value)]
        for (a, b), grid in model.grids.items():
            margin += grid[bisect.bisect_left(model.rough[a].tolist(), x[a])][bisect.bisect_left(model.rough[b].tolist(), x[b])]
        score = 1 / (1 + math.exp(-margin))
        assert abs(got[i].score - score) < 1e-9 and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == int(score >= 0.7)
