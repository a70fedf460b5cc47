"""Index build: words hashed side by side, rankings by rough scores first, equal vectors once."""

import hashlib
import time

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from quarry.functions import terms
from quarry.functions.vectors import TOKEN_PATTERN
from quarry.operators import rank


def test_words_are_hashed_side_by_side():
    odd = ["", None, "x" * 7 + " " + "y" * 8 + "-" + "z" * 15 + " " + "a" * 16 + "_" + "b" * 55 + " " + "c" * 56 + " " + "d" * 200,
           "é漢字 ñandú x²½ ①", "a\x1cb c", "".join(map(chr, range(0x2010, 0x2060))) + "end", "日本 a", "å b"]
    r = np.random.default_rng(1)
    odd += ["".join(chr(c) for c in r.choice([32, 45, 95, 97, 48, 233, 0x3b1, 0x4e00, 0x2014, 0x1f600], 60)) for _ in range(200)]
    want = [regex.findall(TOKEN_PATTERN, t or "") for t in odd]
    assert [terms.words_of(t) for t in odd] == want
    bucket, counts = terms._buckets(pa.array(odd), 1 << 32)
    assert counts.tolist() == [len(w) for w in want]
    assert bucket.tolist() == [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for t in want for w in t]


def test_new_words_cost_little():
    texts = pa.array([" ".join(f"{i}q{j}" for j in range(1000)) for i in range(300)])
    began = time.process_time()
    terms._buckets(texts, 64)
    took = time.process_time() - began
    words = [w for t in texts.to_pylist() for w in t.split()]
    began = time.process_time()
    [hashlib.md5(w.encode()).digest() for w in words]
    assert took < time.process_time() - began  # one at a time, they cost that and more


def test_rough_scores_and_equal_vectors_change_nothing(spark):
    r = np.random.default_rng(4)
    vectors = r.integers(0, 3, (3000, 8)).astype(float)
    vectors = np.concatenate([vectors, np.repeat(vectors[:2], 500, axis=0), vectors[:50] + 1e-8])  # copies, and nearly equal ones
    ids = r.permutation(len(vectors))
    asked = r.integers(0, 4, (60, 8)).astype(float)
    articles = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "article_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    key = np.round(asked @ vectors.T, 9)
    want = {q: ids[np.lexsort((ids, -key[q]))[:12]].tolist() for q in range(60)}
    for size in (1 << 28, 1):
        got = rank.block_top_k(articles, queries, 12, block_bytes=size).collect()
        assert {q: [x.article_id for x in sorted((y for y in got if y.query_id == q), key=lambda y: y.rank)] for q in range(60)} == want
    assert len(rank._first_of_equals(ids, vectors, 12)) < 3100
    assert articles.where(F.size("embedding") == 8).count() == len(vectors)


def test_most_cells_are_scored_in_single_precision(monkeypatch):
    r = np.random.default_rng(2)
    vectors, asked = r.normal(size=(20_000, 32)), r.normal(size=(300, 32))
    exact = []
    add = rank._Best.add
    monkeypatch.setattr(rank._Best, "add", lambda self, places, scores, ids: (exact.append(scores.size), add(self, places, scores, ids))[1])
    best = rank._Best(300, 10)
    rank._Chunks(np.arange(20_000), vectors, 1000).score(asked, np.sqrt((asked ** 2).sum(axis=1)), best)
    assert best.id.tolist() == np.argsort(-(asked @ vectors.T), axis=1)[:, :10].tolist()
    assert sum(exact) < 0.2 * 300 * 20_000
