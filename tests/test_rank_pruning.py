"""Skipping chunks of articles by their balls: the same rankings, and chunks that are skipped on clustered vectors."""

import numpy as np
import pytest

from quarry.operators import rank


def rows(df):
    return sorted((r.query_id, r["rank"], r.article_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(20, 16)) * 4
    a = np.concatenate([c + 0.1 * r.normal(size=(200, 16)) for c in centres])
    order = r.permutation(len(a))
    articles = spark.createDataFrame([(int(i), a[i].tolist()) for i in order], "article_id long, embedding array<double>")
    q = centres[r.integers(0, 20, 30)] + 0.1 * r.normal(size=(30, 16))
    return a, q, articles, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")


def test_pruned_ranking_is_exact_and_skips(spark, clustered, monkeypatch):
    a, q, articles, queries = clustered
    monkeypatch.setattr(rank, "CELLS_PER_CHUNK", 100 * rank.QUERY_TILE)  # chunks of 100 articles
    want = []
    for i, v in enumerate(q):
        s = np.round(a @ v, 9)
        want += [(i, n + 1, int(j), float(round(float(a[j] @ v), 9))) for n, j in enumerate(np.lexsort((np.arange(len(a)), -s))[:10])]
    share = {}
    for name, table in (("shuffled", articles), ("clustered", rank.cluster_articles(articles, 120).coalesce(1))):
        counted = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        got = rows(rank.block_top_k(table, queries, 10, counted=counted))
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        share[name] = counted[1].value / counted[0].value
    assert share["clustered"] > 0.5 > share["shuffled"], share


def test_clustering_keeps_every_row(spark, clustered):
    _, _, articles, _ = clustered
    got = rank.cluster_articles(articles, 20)
    assert got.columns == articles.columns
    assert sorted(r.article_id for r in got.collect()) == sorted(r.article_id for r in articles.collect())
    assert rank.cluster_articles(articles.limit(0)).count() == 0


def test_queries_beyond_the_budget_take_one_job(spark, monkeypatch):
    r = np.random.default_rng(3)
    a, q = r.integers(-1, 2, (90, 4)).astype(float), r.integers(-1, 2, (40, 4)).astype(float)  # many ties
    articles = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "article_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    want = rows(rank.block_top_k(articles, queries, 7))
    assert [w[2] for w in want] == [int(j) for v in q for j in np.lexsort((np.arange(90), -(a @ v)))[:7]]
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value))
    monkeypatch.setattr(rank, "CELL_BYTES", 20 * 4 * 8)  # five cells
    assert rows(rank.block_top_k(articles, queries, 7, block_bytes=200)) == want
    assert not sent
    twice = queries.union(queries.limit(1))
    with pytest.raises(Exception, match="query ids must be unique"):
        rank.block_top_k(articles, twice, 7, block_bytes=200).collect()


def test_ties_cost_no_more_than_other_scores():
    best, ids = rank._Best(2, 3), np.arange(1000)
    best.add(np.array([0, 1]), np.ones((2, 1000)), ids + 1000)
    assert best.id.tolist() == [[1000, 1001, 1002]] * 2
    looked = []
    best.add(np.array([0, 1]), np.ones((2, 1000)), ids)  # smaller ids come first, whatever was there
    assert best.id.tolist() == [[0, 1, 2]] * 2
    lexsort, np.lexsort = np.lexsort, lambda keys: looked.append(len(keys[0])) or lexsort(keys)
    try:
        best.add(np.array([0, 1]), np.ones((2, 1000)), ids + 5000)
        best.add(np.array([0, 1]), np.ones((2, 1000)), ids - 5000)
    finally:
        np.lexsort = lexsort
    assert best.id.tolist() == [[-5000, -4999, -4998]] * 2 and looked == [12]
