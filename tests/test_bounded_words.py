"""Python workers hold the words of a bounded part of their batch, whatever its size."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import terms
from quarry.operators import infer, sparse
from quarry.session import BATCH_BYTES


def test_slices_hold_every_text_once():
    texts = pa.array(["a " * n if n % 7 else None for n in range(700)] + ["x" * (3 << 20), "", "é" * 10])
    parts = list(terms._slices(texts, 64))
    assert [t for p in parts for t in p.to_pylist()] == texts.to_pylist()
    assert all(len(p) <= terms.TEXTS and (len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= terms.TEXT_BYTES) for p in parts)
    assert list(terms._slices(pa.array([], pa.string()), 64)) == []


def test_memory_of_a_large_batch():
    texts = pa.array([" ".join(f"w{j}" for j in range(i, i + 500)) for i in range(4000)])
    tracemalloc.start()
    dense = terms._dense_counts(texts, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dense.shape == (4000 * 64,) and (dense.reshape(4000, 64).sum(axis=1) == 500).all()
    assert peak < 40 << 20  # 2 million words were some 130 MB


def test_batches_are_bounded_and_slices_change_nothing(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 40))) for i in range(600)] + [(600, None), (601, "")]
    docs = spark.createDataFrame(texts, "article_id long, body string").coalesce(1)
    weights = np.linspace(0.5, 2.0, 32)
    got = {r.article_id: r.embedding for r in sparse.idf_encode(docs, "body", weights).collect()}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)
    for i, text in texts:
        counts = np.zeros(32)
        for w in (text or "").split():
            counts[terms._first_bits[w] % 32] += 1
        counts *= weights
        at = np.flatnonzero(counts)
        assert list(got[i].indices) == at.tolist()
        np.testing.assert_allclose(got[i].values, counts[at] / np.sqrt((counts ** 2).sum()) if len(at) else [])
    assert infer.hashing_encode(docs, "body", 16).where(F.size("embedding") != 16).count() == 0
    assert terms.term_counts(docs, "article_id", "body").agg(F.sum("tf")).first()[0] == sum(len((t or "").split()) for _, t in texts)
