"""Connected components of a link table, in a number of rounds that grows with the logarithm of its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop_table, salted_join, through_table


def components(links: DataFrame, rounds: list | None = None) -> DataFrame:
    """id and class (the least id reachable) of every vertex of the links (a, b: long).

    Each round gives the vertices a new random order, and moves each to the first of itself and its neighbours; links
    within one vertex go. That leaves at most three quarters of the vertices on average, whatever the graph's shape or
    the order of its ids, so even a chain of n links takes about log2(n) rounds. The rounds' moves are composed
    backwards at the end. Every round is a written table; `rounds`, if given, gets the links left after each.
    """
    edges = through_table(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c, k=len(moves): F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("id"))
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        move = through_table(first.select(F.col("a").alias("from"), F.least(order("a"), "near")["id"].alias("to")), "moves")
        ends = [move.select(F.col("from").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        left = through_table(moved.where("a != b").distinct(), "links")
        drop_table(edges)
        edges = left
        moves.append(move)
        if rounds is not None:
            rounds.append(edges.count())
    if not moves:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("class"))
    label = moves.pop().select(F.col("from").alias("id"), F.col("to").alias("class"))
    while moves:
        move = moves.pop()
        onward = label.select(F.col("id").alias("to"), F.col("class").alias("_end"))
        label = through_table(move.join(onward, "to", "left").select(F.col("from").alias("id"), F.coalesce("_end", "to").alias("class")), "classes")
    least = through_table(label.groupBy("class").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "least-ids")
    return through_table(salted_join(label, least, "class", "n").select("id", F.col("least").alias("class")), "classes")
