import random

import pytest

from tidemark.operators.graph import components


def expected(links):
    parent = {v: v for e in links for v in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for e in links for v in e if e[0] != e[1]}


@pytest.mark.parametrize("shuffled", [False, True])
def test_chain_of_a_thousand(spark, shuffled):
    ids = list(range(1000))
    if shuffled:
        random.Random(1).shuffle(ids)
    rounds = []
    got = components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long"), rounds)
    assert {r.id: r["class"] for r in got.collect()} == dict.fromkeys(range(1000), 0) and len(rounds) <= 15


def test_against_a_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links += [(1000, k) for k in range(1001, 1200)] + [(5, 5), (2000, 2000), (7, 8), (8, 7)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r["class"] for r in got.collect()} == expected(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []


def test_rows_are_numbered_in_order(spark):
    from pyspark.sql import functions as F

    from tidemark.tables import numbered

    values = random.Random(3).sample(range(10_000), 500)
    rows = spark.createDataFrame([(v, v % 7) for v in values], "v int, w int").repartition(5)
    got = {r.v: r._number for r in numbered(rows, [F.desc("w"), F.col("v")]).collect()}
    assert got == {v: k + 1 for k, v in enumerate(sorted(values, key=lambda v: (-(v % 7), v)))}
    assert numbered(rows.limit(0), [F.col("v")]).count() == 0
