"""Few queries are sent to the articles: the same rankings as through shuffled lists, and passages as before."""

import numpy as np
import pytest

from quarry.operators import sparse
from quarry.sources import fixtures


@pytest.fixture(scope="module")
def texts(spark):
    r = np.random.default_rng(7)
    share = 1 / np.arange(1, 301)
    docs = [(i, " ".join(f"w{j}" for j in r.choice(300, r.integers(0, 40), p=share / share.sum()))) for i in range(700)]
    docs += [(700, None), (701, ""), (3, docs[3][1]), (702, docs[5][1]), (703, docs[5][1])]
    asked = [(i, docs[i * 9][1][:60] + " w1 unknown") for i in range(40)] + [(100, None), (101, "none of them"), (2, docs[18][1][:60] + " w1 unknown")]
    return (spark.createDataFrame(docs, "article_id long, body string").repartition(3),
            spark.createDataFrame(asked, "query_id long, query_text string"))


def _rows(df):
    return sorted((r.query_id, r.rank, r.article_id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("k", [3, 50])
def test_few_queries_rank_as_many_do(texts, monkeypatch, k):
    articles, queries = texts
    weights = sparse.idf_weights(articles, "body", 64)
    a, q = (sparse.idf_encode(t, c, weights) for t, c in ((articles, "body"), (queries, "query_text")))
    shuffled = []
    whole = sparse.sparse_top_k
    monkeypatch.setattr(sparse, "sparse_top_k", lambda *args: (shuffled.append(1), whole(*args))[1])
    monkeypatch.setattr(sparse, "PRODUCTS", 500)
    monkeypatch.setattr(sparse, "CANDIDATES", 200)
    here = [_rows(sparse.bm25_ranker("body")(articles, queries, k)), _rows(sparse.sparse_ranker(a, q, k))]
    assert not shuffled and len(here[0]) > 100
    monkeypatch.setattr(sparse, "FEW_ENTRIES", 1)
    assert here == [_rows(sparse.bm25_ranker("body")(articles, queries, k)), _rows(sparse.sparse_ranker(a, q, k))]
    assert len(shuffled) == 2


def test_few_passages_are_found_by_their_longest_word(spark, monkeypatch):
    docs = [(1, "xx aa longest bb cc yy"), (2, "aa longest bb cc"), (3, "aa  longest bb cc"), (4, "aa longest bbcc"), (5, None), (6, ""),
            (2, "aa longest bb cc"), (7, "longest bb longest cc aa longest bb c"), (None, "aa longest bb cc")]
    passages = [(1, "a longest bb c"), (2, "aa longest bb cc"), (3, "longest"), (4, ""), (5, None), (6, " longest bb "), (2, "aa longest bb cc")]
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "pid long, ptext string")
    want = sorted((i, j) for i, t in docs for j, s in passages if i is not None and t is not None and s is not None and s in t)
    assert sorted(map(tuple, fixtures.containment_pairs(d, p).where("pid != 4 and pid != 3").collect())) == [x for x in want if x[1] not in (3, 4)]
    written = []
    monkeypatch.setattr(fixtures, "materialize", lambda df, name, m=fixtures.materialize: (written.append(name), m(df, name))[1])
    got = sorted(map(tuple, fixtures.containment_pairs(d, p).distinct().collect()))
    assert got == sorted(set(want)) and "match-words" not in written
    monkeypatch.setattr(fixtures, "PASSAGE_BYTES", 0)
    assert sorted(map(tuple, fixtures.containment_pairs(d, p).distinct().collect())) == got and "match-words" in written
