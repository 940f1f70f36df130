import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import _common as C
from tidemark.llm._labels import held_out, labelled_sample


def test_salted_join_equals_a_join(spark):
    rng = random.Random(1)
    rows = [(rng.choice((1, 1, 1, 1, 2, 3, 4, None, 9)), i) for i in range(400)]
    left = spark.createDataFrame(rows, "k int, v int")
    keyed = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m")).where("k != 9")
    got = sorted(map(tuple, C.salted_join(left, C.through_table(keyed, "keyed"), "k", "n", hot_keys=3).select("k", "v", "n", "m").collect()))
    assert got == sorted(map(tuple, left.join(keyed, "k").select("k", "v", "n", "m").collect()))
    empty = C.through_table(keyed.limit(0), "keyed")
    assert C.salted_join(left, empty, "k", "n").count() == 0


def test_tables_in_the_shared_folder(spark):
    table = C.through_table(spark.range(5), "five")
    assert table.count() == 5 and os.path.isdir(C.local_path(table.shared_path))
    C.drop_table(table)
    assert not os.path.exists(C.local_path(table.shared_path))


def test_shared_files_are_whole(tmp_path):
    uri = f"file://{tmp_path}/a/b"
    C.write_shared(uri, b"12345678")
    C.write_shared(uri, b"abcdefgh")
    assert C.map_shared(uri).tobytes() == b"abcdefgh" and os.listdir(tmp_path / "a") == ["b"]
    assert isinstance(C.map_shared(uri), np.ndarray) and C.local_path("hdfs://x/y") is None


def test_freed_memory_goes_back():
    resident = lambda: int(open("/proc/self/statm").read().split()[1])
    held = [bytes(1000) for _ in range(200_000)]
    full = resident()
    del held
    C.trim()
    assert resident() < full - 20_000


def test_maps_without_batches(spark):
    assert C.arrow_map(spark.range(0), lambda batch: batch, "id long").count() == 0


def test_batches_are_bounded(spark):
    build = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows])], names=["x"])
    sizes = [b.num_rows for b in C.chunks_by_bytes(((i,) for i in range(10)), lambda r: 4, build, 12)]
    assert sizes == [3, 3, 3, 1]
    C.bounded_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= C.BATCH_ROWS


def test_labelled_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 4, 2, 50).collect()
    assert len(rows) == 50 and len({r.doc_id for r in rows}) == 50
    held = {r.doc_id for r in docs.where(held_out("doc_id", 4, 2)).collect()}
    assert held and not held & {r.doc_id for r in rows} and None not in held
    again = labelled_sample(docs, labels, "quality", 4, 2, 50).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_of_several_texts_under_one_id_the_least_is_used_and_bytes_are_bounded(spark):
    from tidemark.llm._labels import within_bytes

    docs = spark.createDataFrame([(1, "b" * 10), (1, "a" * 10), (1, "c"), (2, "x" * 30), (3, "y" * 30)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels, "toxic", 1, 9)
    assert sorted((r.doc_id, r.text) for r in sample.collect()) == [(1, "a" * 10), (2, "x" * 30), (3, "y" * 30)]
    assert 1 <= within_bytes(sample, 45).count() <= 2 and within_bytes(sample, 1000).count() == 3
