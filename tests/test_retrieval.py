"""BM25, IDF vectors, pair re-ranking, document expansion, inference on distinct texts and passage matching."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.terms import bucket_counts, sparse_weights
from quarry.operators import infer, rerank, sparse
from quarry.plans import expand
from quarry.sources.fixtures import containment_pairs

WORDS = ["alpha", "beta", "gamma", "delta", "Été", "42", "the", "of", "漢字", "x"]


def texts(n, seed, most=12):
    r = random.Random(seed)
    return [(i, None if i == 3 else " ".join(r.choice(WORDS) for _ in range(r.randint(0, most)))) for i in range(n)]


def words(t):
    return (t or "").lower().split()


def bm25(articles, queries, k):
    docs = {i: Counter(words(t)) for i, t in articles}
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    out = {}
    for q, t in queries:
        scores = {}
        for i, c in docs.items():
            s = sum(n * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2
                    / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, n in Counter(words(t)).items() if c[w])
            if s > 0:
                scores[i] = s
        out[q] = [(i, round(s, 6)) for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]
    return {q: r for q, r in out.items() if r}


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.article_id, round(r.score, 6)))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture()
def corpus(spark):
    a, q = texts(200, 1), texts(30, 2, 5)
    return (a, q, spark.createDataFrame(a, "article_id long, body string"), spark.createDataFrame(q, "query_id long, query_text string"))


def test_bm25_equals_brute_force(corpus):
    a, q, articles, queries = corpus
    assert ranked(sparse.bm25_ranker()(articles, queries, 7)) == bm25(a, q, 7)


def test_blocks_and_salted_terms_change_nothing(corpus, monkeypatch):
    a, q, articles, queries = corpus
    for name, value in (("ARTICLE_BLOCK", 9), ("QUERY_BLOCK", 4), ("SPLIT", 2)):
        monkeypatch.setattr(sparse, name, value)
    assert ranked(sparse.bm25_ranker()(articles, queries, 7)) == bm25(a, q, 7)


def test_bm25_makes_no_row_per_pair(corpus):
    _, _, articles, queries = corpus
    plan = sparse.bm25_ranker()(articles, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bm25_without_articles_or_words(spark, corpus):
    _, _, articles, queries = corpus
    none = articles.limit(0)
    assert sparse.bm25_ranker()(none, queries, 3).count() == 0
    assert sparse.bm25_ranker()(articles, spark.createDataFrame([(1, None), (2, " ?! ")], "query_id long, query_text string"), 3).count() == 0


def test_sparse_vectors_are_the_dense_ones(spark):
    rows = texts(60, 5)
    df = spark.createDataFrame(rows, "id long, t string").withColumn("d", bucket_counts("t", 16)).withColumn("s", sparse_weights("t", 16))
    for r in df.collect():
        dense = np.array(r.d)
        assert dense.sum() == len(words(r.t)) and len(dense) == 16
        assert list(r.s.indices) == np.flatnonzero(dense).tolist()
        assert np.allclose(r.s["values"], dense[dense > 0] / max(np.linalg.norm(dense), 1e-300))


def test_idf_ranking_equals_dense_products(spark, corpus):
    _, _, articles, queries = corpus
    w = sparse.idf_weights(articles, "body", 32)
    a, q = sparse.idf_encode(articles, "body", w), sparse.idf_encode(queries, "query_text", w)

    def matrix(df, key):
        out = {}
        for r in df.collect():
            v = np.zeros(32)
            v[list(r.embedding.indices)] = r.embedding["values"]
            out[r[key]] = v
        return out
    av, qv = matrix(a, "article_id"), matrix(q, "query_id")
    want = {}
    for i, v in qv.items():
        scores = sorted(((-round(float(v @ x), 9), j) for j, x in av.items() if v @ x > 0))[:5]
        if scores:
            want[i] = [(j, round(-s, 6)) for s, j in scores]
    got = ranked(sparse.sparse_ranker(a, q, 5))
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    pair = a.limit(1).crossJoin(q.select(F.col("embedding").alias("qe"), "query_id"))
    for r in pair.select("article_id", "query_id", sparse.sparse_dot("embedding", "qe").alias("s")).collect():
        assert abs(r.s - float(av[r.article_id] @ qv[r.query_id])) < 1e-12


# ---------------------------------------------------------------- pair model

def test_batches_hold_pairs_of_nearly_equal_length():
    r = random.Random(3)
    lengths = sorted(int(math.exp(r.uniform(0, 9))) for _ in range(4000))
    cuts = rerank.batches_by_length(lengths, chars=20_000, pairs=64)
    assert [c[0] for c in cuts] == [0] + [c[1] for c in cuts[:-1]] and cuts[-1][1] == len(lengths)
    padded = sum(lengths[b - 1] * (b - a) for a, b in cuts)
    assert all(lengths[b - 1] * (b - a) <= 20_000 or b - a == 1 for a, b in cuts) and padded < 1.15 * sum(lengths)
    assert rerank.batches_by_length([]) == []


def test_each_distinct_pair_is_scored_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def make():
        overlap = rerank.word_overlap()

        def score(q, a):
            with open(log, "a") as f:
                f.writelines(f"{x}|{y}\n" for x, y in zip(q, a))
            return overlap(q, a)
        return score
    articles = spark.createDataFrame([(i, ["the alpha", "beta of", None][i % 3]) for i in range(30)], "article_id long, body string")
    queries = spark.createDataFrame([(i, ["alpha", "Beta"][i % 2]) for i in range(10)], "query_id long, query_text string")
    pairs = queries.select("query_id").crossJoin(articles.select("article_id"))
    got = ranked(rerank.rerank(pairs.unionAll(pairs), queries, articles, make, k=4))
    with open(log) as f:
        calls = f.read().splitlines()
    assert len(calls) == len(set(calls)) == 6
    assert got[0] == [(0, 0.5), (3, 0.5), (6, 0.5), (9, 0.5)] and got[1] == [(1, 0.5), (4, 0.5), (7, 0.5), (10, 0.5)]


# ---------------------------------------------------------------- expansion

def test_variants_cover_the_whole_text(spark):
    rows = [(1, "".join(chr(97 + i % 26) for i in range(100))), (2, "ab"), (3, ""), (4, None)]
    got = expand.expand_articles(spark.createDataFrame(rows, "article_id long, body string"), infer.last_user_message, 3).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.variant):
        by.setdefault(r.article_id, []).append(r.generated_query)
    assert {k: "".join(v) for k, v in by.items()} == {i: t or "" for i, t in rows} and all(len(v) == 3 for v in by.values())


def test_best_variant_counts(spark):
    r = np.random.default_rng(1)
    variants = [(int(i), r.normal(size=4).tolist()) for i in range(20) for _ in range(r.integers(1, 5))]
    queries = [(i, r.normal(size=4).tolist()) for i in range(6)]
    v = spark.createDataFrame(variants, "article_id long, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    got = ranked(expand.best_variant_ranker(v, q, 5))
    for i, e in queries:
        best = {}
        for a, x in variants:
            best[a] = max(best.get(a, -9e9), float(np.dot(e, x)))
        assert [a for a, _ in got[i]] == [a for a, _ in sorted(best.items(), key=lambda z: (-z[1], z[0]))[:5]]


# ---------------------------------------------------------------- distinct texts, passages

def test_repeated_texts_are_encoded_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def make():
        encode = infer.hashing_encoder_factory(8)()

        def run(texts):
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return encode(texts)
        return run
    rows = [(i, ["hot", "cold", "", None][0 if i % 3 else i // 3 % 4]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t string")
    plain = {r.id: r.embedding for r in infer.embed_column(df, "t", infer.hashing_encoder_factory(8)).collect()}
    for hot_rows in (100_000, 7):
        got = infer.infer_distinct(df, "t", lambda t: infer.embed_column(t, "t", make), "embedding", hot_rows).collect()
        assert {r.id: r.embedding for r in got} == plain and len(got) == 120
    with open(log) as f:
        assert len(f.read().splitlines()) == 2 * 4


def test_passages_are_found_wherever_they_begin(spark):
    docs = ["so it began one two three four five and ended", "xone two three four fivey", "one two three", "ab cd", "tab\tsep one", "", None, "aXbYcdefghij"]
    passages = ["one two three four five", "three", "o t", " two  ", "cd", "b c", "", "\tsep", "two three four", "bYcdefgh", "zzz", None, "nd ended"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "pid long, ptext string")
    got = sorted((r.doc_id, r.pid) for r in containment_pairs(d, p).collect())
    assert got == sorted((i, j) for i, t in enumerate(docs) for j, x in enumerate(passages) if t is not None and x is not None and x in t)
