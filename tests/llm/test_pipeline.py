import hashlib
import re

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline as P
from tidemark.llm import bpe_stream, gam_quality, qgram_decontam

from .test_chosen_path import brute as brute_classes
from .test_qgram_decontam import brute as brute_edits
from .test_sentence_spans import brute as brute_repeats

FOLDER = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    got = {r.doc_id: r for r in P.run(spark, FOLDER).collect()}
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id")
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    model = gam_quality.fit_quality(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.createDataFrame(labels))
    left = [(int(i), t) for i, t in zip(docs.doc_id, docs.text, strict=True)]
    left = [d for d, s in zip(left, model.score(gam_quality.feature_matrix([t for _, t in left])), strict=True) if s >= 0.7]
    found = brute_classes(left)
    left = [(i, t) for i, t in left if found[i][1] == i]
    texts = brute_repeats(left)
    left = [(i, texts[i]) for i, _ in left]
    items = [qgram_decontam.normal(t) for t in pd.read_parquet(f"{FOLDER}/benchmark.parquet").text]

    def holds(text):
        """Whether an item occurs, with full alignment only where a piece of it that must be whole occurs."""
        own = qgram_decontam.normal(text)
        for item in items:
            k = qgram_decontam.edit_budget(len(item))
            width = len(item) // (k + 1)
            if any(item[j * width : (j + 1) * width] in own for j in range(k + 1)) and item in own:
                return True
            if any(item[j * width : (j + 1) * width] in own for j in range(k + 1)) and len(own) < 3000 and brute_edits(item, own, k) <= k:
                return True
        return False

    clean = {i: t for i, t in left if not holds(t)}
    assert set(got) == set(clean) and 50 < len(got) < len(docs)
    library = Tokenizer.from_file(bpe_stream.default_tokenizer())
    for i, text in clean.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(None, None, "x", 1), (1, "", "y", 2), (2, "A b c d. " * 10, "z", 3), (2, "A b c d. " * 10, "z", 3)], "doc_id long, text string, score string, n_chars long")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        out.collect()
    assert P.STAGES[-1][1](spark, docs, FOLDER).count() == 4


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "substrings", "decontaminate", "tokenize"]
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
