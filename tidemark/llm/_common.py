"""Helpers shared by the corpus operators: table access, Arrow batches, the shared folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import drop_table, salted_join, shared_dir, through_table

__all__ = ["arrow_map", "bounded_batches", "chunks_by_bytes", "drop_table", "hold", "local_path", "map_shared", "release", "salted_join", "shared_dir", "table", "text_of", "through_table", "trim", "write_shared"]

#: Rows of one Arrow batch that a Python worker holds; documents are a few KB each.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that long texts don't add up in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path; None for any other scheme."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_shared(uri: str, data: bytes) -> None:
    """Write one file of the shared folder from a task: a retried task replaces it whole."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(uri)
    store.create_dir(where.rpartition("/")[0], recursive=True)
    with store.open_output_stream(where) as out:
        out.write(data)


def map_shared(uri: str):
    """A read-only memory map (numpy bytes) of one file of the shared folder.

    A file in a remote store is fetched to an unlinked temporary file first, which leaves nothing behind.
    """
    import numpy as np

    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=np.uint8, mode="r")
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as keep, store.open_input_stream(where) as source:
        while chunk := source.read(1 << 22):
            keep.write(chunk)
        keep.flush()
        return np.memmap(keep, dtype=np.uint8, mode="r")


#: What a Python worker keeps between tasks, by operator, and how to let go of it.
_held: dict[str, Callable[[], object]] = {}


def hold(name: str, clear: Callable[[], object]) -> None:
    """Register something that this worker keeps for an operator's next tasks."""
    _held[name] = clear


def trim() -> None:
    """Give freed memory back to the system; allocators keep it otherwise, beside what the JVM and other workers use."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if give_back is not None:
        give_back(0)


def release(but: str | None = None) -> None:
    """Let go of what earlier operators kept, as workers go on from one operator to the next."""
    for name in [n for n in _held if n != but]:
        _held.pop(name)()
    trim()


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str, keeps: str | None = None) -> DataFrame:
    """mapInArrow with a function of one batch; `keeps` names what may stay in the worker."""

    def run(batches):
        release(keeps)
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        batch = out = None
        trim()

    return df.mapInArrow(run, schema)


def chunks_by_bytes(rows: Iterator[tuple], sizes: Callable[[tuple], int], build: Callable[[list[tuple]], pa.RecordBatch], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Group rows into record batches of about `limit` bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sizes(row)
        if weight >= limit:
            yield build(held)
            held, weight = [], 0
    if held:
        yield build(held)


def text_of(column: str = "text"):
    """A text column with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
