"""Removal of repeated passages by hashed runs of consecutive sentences.

A sentence ends after . ! ? followed by white space, or at a line break; it is compared lower-case with its white
space collapsed. Every run of several consecutive sentences is hashed: from each first sentence, and up to each last
one, the shortest run that has three sentences and 12 words, or two and 30, or one and 50. So each sentence of a
repeated passage of over 50 words lies in some hashed run inside of it. Runs are joined over all documents by hash; of
equal runs the first (lowest doc_id, then place in the text) stays, and sentences covered by any other go.

A document is told by its id and its text's hash. Null doc_ids order first; rows that share an id but not the text are
different documents, in order of that hash, and rows equal in both are one. Null texts are empty and have no runs.
Equal texts under different ids: the later one's runs are all repeated. An empty table gives an empty result. Only
doc_id and text are read; other columns, of any name, are passed through by remove_repeats().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, bounded_batches, text_of, through_table

#: A run is hashed once it has this many sentences and words.
RUNS = ((3, 12), (2, 30), (1, 50))
_BREAK = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NO_ID = -(1 << 63)
#: At most so many hot runs, those with more than 1 / HOT_RUNS of all repeated occurrences, are known to every task.
HOT_RUNS = 5000
#: Join key of the rows that carry a document's hot runs, dealt over SALTS copies.
_CARRIED, SALTS = 1, 64


def sentences(text: str) -> tuple[list[int], list[str]]:
    """Start of each sentence in the text, and the sentence lower-case with single spaces; empty ones are left out."""
    starts, out, at = [], [], 0
    for m in _BREAK.finditer(text):
        if piece := text[at : m.start()].strip():
            starts.append(at)
            out.append(piece)
        at = m.end()
    if piece := text[at:].strip():
        starts.append(at)
        out.append(piece)
    return starts, [" ".join(s.lower().split()) for s in out]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_bounds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end sentence of each hashed run, given the words of each sentence."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.arange(n)
    end = np.full(n, n + 1)
    last = np.arange(1, n + 1)
    begin = np.full(n, -1)
    for least, size in RUNS:
        end = np.minimum(end, np.maximum(first + least, np.searchsorted(total, total[:-1] + size, "left")))
        begin = np.maximum(begin, np.minimum(last - least, np.searchsorted(total, total[1:] - size, "right") - 1))
    ok, back = end <= n, begin >= 0
    pairs = np.unique(np.concatenate([first[ok] * (n + 1) + end[ok], begin[back] * (n + 1) + last[back]]))
    return pairs // (n + 1), pairs % (n + 1)


def run_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (characters, up to the next sentence) of every hashed run of a text."""
    starts, own = sentences(text)
    n = len(own)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.array([xxhash.xxh64_intdigest(s) for s in own], np.uint64)
    first, end = run_bounds(np.array([s.count(" ") + 1 for s in own]))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * _powers(n, _BASE), dtype=np.uint64)])
        mixed = (total[end] - total[first]) * _powers(n, _INVERSE)[first] + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    begin = np.array([*starts, len(text)])
    return mixed.view(np.int64), begin[first], begin[end]


def _identity() -> list:
    """doc_id and twin: what tells one document from another."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text_of()).alias("twin")]


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(*_identity(), text_of().alias("text"))


def all_runs(docs: DataFrame) -> DataFrame:
    """hash, doc_id, twin and first (character) of every hashed run of every document."""
    bounded_batches(docs.sparkSession)

    def run(batch):
        parts = [run_hashes(t) for t in batch.column(2).to_pylist()]
        size = [len(p[0]) for p in parts]
        ids = [np.repeat(batch.column(k).to_numpy(), size) for k in (0, 1)]
        columns = [np.concatenate([p[0] for p in parts]), *ids, np.concatenate([p[1] for p in parts]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "doc_id", "twin", "first"])

    return arrow_map(_identified(docs), run, "hash long, doc_id long, twin long, first int")


def _marked_runs(docs: DataFrame, hot: list) -> DataFrame:
    """As all_runs() without the hot runs; those of a document that have to go are carried by one row of it."""
    bounded_batches(docs.sparkSession)
    hot = sorted((r["hash"], r["first_doc_id"], r["first_twin"], r["first_at"]) for r in hot)
    known = [np.array([r[k] for r in hot], np.int64) for k in range(4)]

    def run(batch):
        rows: list[tuple] = []  # of each document: its runs that aren't hot
        carried: list[tuple] = []  # of a document with hot runs to remove: those
        for i, twin, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            code, begin, end = run_hashes(text)
            if len(hot) and len(code):
                at = np.minimum(np.searchsorted(known[0], code), len(hot) - 1)
                common = known[0][at] == code
                gone = common & ((known[1][at] != i) | (known[2][at] != twin) | (known[3][at] != begin))
                if gone.any():
                    carried.append((i, begin[gone], end[gone], np.unique(known[1][at[gone]]), twin))
                code, begin, end = code[~common], begin[~common], end[~common]
            rows.append((i, code, begin, end, twin))
        count = [len(r[1]) for r in rows]
        flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *(np.asarray(p, kind) for p in parts)])
        plain = np.arange(sum(count) + len(carried) + 1) < sum(count)  # rows without lists: null
        lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(sum(count) + 1, np.int32), np.cumsum(sizes, dtype=np.int32)]), mask=plain), values)
        none = np.zeros(len(carried), np.int32)
        spans = pa.array(flat((c[1].astype(np.int64) << 32 | c[2] for c in carried), np.int64))
        columns = [
            pa.array(flat([*(r[1] for r in rows), none + _CARRIED], np.int64)),
            *(pa.array(flat([np.repeat(np.array([r[k] for r in rows], np.int64), count), [c[k] for c in carried]], np.int64)) for k in (0, 4)),
            *(pa.array(flat([*(r[k] for r in rows), none], np.int32)) for k in (2, 3)),
            lists([len(c[1]) for c in carried], spans),
            lists([len(c[3]) for c in carried], pa.array(flat((c[3] for c in carried), np.int64))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["hash", "doc_id", "twin", "first", "past", "spans", "firsts"])

    return arrow_map(_identified(docs), run, "hash long, doc_id long, twin long, first int, past int, spans array<long>, firsts array<long>")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row for each document with sentences to remove: doc_id (null as the lowest long), twin, spans (start and end
    characters of runs whose first occurrence is elsewhere) and first_doc_ids, the documents that hold those.

    Counts are combined before they are shuffled. Hot runs, of which there are HOT_RUNS at most, are looked up where
    the documents are read, so their occurrences are never shuffled; all others are joined by hash.
    """
    firsts = (
        all_runs(docs)
        .groupBy("hash")
        .agg(F.min(F.struct("doc_id", "twin", "first")).alias("at"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("hash", F.col("at.doc_id").alias("first_doc_id"), F.col("at.twin").alias("first_twin"), F.col("at.first").alias("first_at"), "n")
    )
    firsts = through_table(firsts, "repeated-runs")
    many = max(1, (firsts.agg(F.sum("n")).first()[0] or 0) // HOT_RUNS)
    runs = _marked_runs(docs, firsts.where(F.col("n") > many).select("hash", "first_doc_id", "first_twin", "first_at").collect())
    carried = docs.sparkSession.range(SALTS).select(F.lit(_CARRIED).cast("long").alias("hash"), *(F.lit(None).cast("long").alias(c) for c in ("first_doc_id", "first_twin")), F.lit(-1).alias("first_at"), F.col("id").cast("int").alias("_salt"))
    known = firsts.where(F.col("n") <= many).select("hash", "first_doc_id", "first_twin", "first_at", F.lit(0).alias("_salt")).unionByName(carried)
    carries = F.col("spans").isNotNull()
    salt = F.when(carries, F.pmod(F.xxhash64("doc_id", "twin"), F.lit(SALTS)).cast("int")).otherwise(0)
    found = runs.withColumn("_salt", salt).join(known, ["hash", "_salt"]).where("spans is not null or doc_id != first_doc_id or twin != first_twin or first != first_at")
    # a span as one number, start before end, so that equal ones are told by a hash
    one = F.shiftleft(F.col("first").cast("long"), 32) + F.col("past")
    each = found.select("doc_id", "twin", F.when(carries, F.col("spans")).otherwise(F.array(one)).alias("spans"), F.when(carries, F.col("firsts")).otherwise(F.array("first_doc_id")).alias("firsts"))
    flat = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    rows = each.groupBy("doc_id", "twin").agg(flat("spans").alias("spans"), flat("firsts").alias("first_doc_ids"))
    span = lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("first"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("past"))
    return rows.select("doc_id", "twin", F.transform("spans", span).alias("spans"), "first_doc_ids")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (sorted by start), trimmed."""
    out, at = [], 0
    for first, past in spans:
        if first > at:
            out.append(text[at:first])
        at = max(at, past)
    return "".join([*out, text[at:]]).strip()


def _with_spans(docs: DataFrame, how: str) -> DataFrame:
    """The document rows, each as one column so that no name can clash, with spans and first_doc_ids."""
    packed = docs.select(F.struct("*").alias("row"), *_identity())
    return packed.join(repeated_spans(docs), ["doc_id", "twin"], how).select("row", "spans", "first_doc_ids")


def _left_of(text: str | None, spans: list | None) -> str | None:
    return text if not spans else cut(text or "", [(x["first"], x["past"]) for x in spans])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with repeated passages removed from their texts; a text may become empty."""
    bounded_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batch):
        columns = batch.column(0).flatten()
        own = [_left_of(t, s) for t, s in zip(columns[at].to_pylist(), batch.column(1).to_pylist(), strict=True)]
        columns[at] = pa.array(own, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(_with_spans(docs, "left").select("row", "spans"), run, schema)


def changed_documents(docs: DataFrame) -> DataFrame:
    """One row for each document that loses sentences: doc_id, first_doc_ids, spans, n_spans, removed_chars, text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = _with_spans(own, "inner")

    def run(batch):
        ids, texts = batch.column(0).flatten()
        before = texts.to_pylist()
        after = [_left_of(t, s) for t, s in zip(before, batch.column(1).to_pylist(), strict=True)]
        removed = pa.array([len(a) - len(b) for a, b in zip(before, after, strict=True)], pa.int64())
        return pa.RecordBatch.from_arrays([ids, batch.column(2), batch.column(1), pa.array(list(map(len, batch.column(1).to_pylist())), pa.int64()), removed, pa.array(after, texts.type)], names=["doc_id", "first_doc_ids", "spans", "n_spans", "removed_chars", "text"])

    return arrow_map(found, run, "doc_id long, first_doc_ids array<long>, spans array<struct<first: int, past: int>>, n_spans long, removed_chars long, text string")
