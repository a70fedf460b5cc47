"""Re-ranking of candidates by a model that reads a query and an article together (cross-encoder).

The model is injected as a factory, like the encoders of E1: a function without arguments that loads it and returns
``fn(query_texts, article_texts) -> scores``. Every distinct pair of texts is scored once, however often its rows repeat.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.terms import words_of
from quarry.operators.rank import Ranker, top_k_pairs
from quarry.session import bounded_batches, materialize

#: Characters of a batch, padding included, and pairs of a batch at most.
BATCH_CHARS, BATCH_PAIRS = 1 << 18, 256

Scorer = Callable[[list[str], list[str]], np.ndarray]

_loaded: dict[str, Scorer] = {}  # of the Python worker


def _model(key: str, make: Callable[[], Scorer]) -> Scorer:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = make()
    return _loaded[key]


def batches_by_length(lengths: list[int], chars: int = BATCH_CHARS, pairs: int = BATCH_PAIRS) -> list[tuple[int, int]]:
    """Cuts of a list of ascending lengths such that a batch, padded to its longest member, stays within ``chars``; a
    pair longer than that is a batch of its own."""
    out, start = [], 0
    for i, n in enumerate(lengths):
        if i > start and (n * (i + 1 - start) > chars or i - start >= pairs):
            out.append((start, i))
            start = i
    if len(lengths) > start:
        out.append((start, len(lengths)))
    return out


def score_text_pairs(pairs: DataFrame, make_scorer: Callable[[], Scorer], chars: int = BATCH_CHARS) -> DataFrame:
    """(query_hash, article_hash, query, article) -> (query_hash, article_hash, score).

    Rows are spread by their hashes and sorted by length inside a partition, so that a batch holds pairs of nearly
    equal length and padding wastes little.
    """
    key = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, make_scorer)
        for batch in batches:
            queries, articles = batch.column("query").to_pylist(), batch.column("article").to_pylist()
            scores = np.empty(batch.num_rows)
            for a, b in batches_by_length(batch.column("length").to_pylist(), chars):
                scores[a:b] = model(queries[a:b], articles[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("query_hash"), batch.column("article_hash"), pa.array(scores)],
                                             names=["query_hash", "article_hash", "score"])

    bounded_batches(pairs.sparkSession)
    sized = pairs.withColumn("length", (F.length("query") + F.length("article")).cast("long"))
    placed = sized.repartition("query_hash", "article_hash").sortWithinPartitions("length")
    return placed.mapInArrow(score, "query_hash string, article_hash string, score double")


def rerank(candidates: DataFrame, queries: DataFrame, articles: DataFrame, make_scorer: Callable[[], Scorer], k: int = 10,
           query_col: str = "query_text", text_col: str = "body", chars: int = BATCH_CHARS) -> DataFrame:
    """The best ``k`` of each query's candidates (query_id, article_id) by the pair model, as rankings.

    Null texts are scored as empty ones. Ids of ``queries`` and ``articles`` are unique. Candidates carry only the hashes of
    their texts until the distinct pairs are known; then each text is joined once per distinct pair.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    q = queries.select("query_id", F.md5(text(query_col)).alias("query_hash"), text(query_col).alias("query"))
    a = articles.select(F.col("article_id").cast("bigint").alias("article_id"), F.md5(text(text_col)).alias("article_hash"),
                        text(text_col).alias("article"))
    hashed = materialize(candidates.select("query_id", "article_id").distinct().join(q.drop("query"), "query_id")
                         .join(a.drop("article"), "article_id"), "rerank-candidates")
    distinct = hashed.select("query_hash", "article_hash").distinct()
    pairs = (distinct.join(q.select("query_hash", "query").dropDuplicates(["query_hash"]), "query_hash")
             .join(a.select("article_hash", "article").join(distinct.select("article_hash").distinct(), "article_hash", "left_semi")
                   .dropDuplicates(["article_hash"]), "article_hash"))
    scores = materialize(score_text_pairs(pairs, make_scorer, chars), "rerank-scores")
    return top_k_pairs(hashed.join(scores, ["query_hash", "article_hash"]).select("query_id", "article_id", "score"), k)


def cross_encoder_ranker(first: Ranker, make_scorer: Callable[[], Scorer], candidates: int = 50, query_col: str = "query_text",
                         text_col: str = "body") -> Ranker:
    """An R4 ranker over tables of texts: ``first`` finds ``candidates`` articles per query, the pair model orders them."""
    def rank(articles: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
        return rerank(first(articles, queries, max(candidates, k)), queries, articles, make_scorer, k, query_col, text_col)
    return rank


def word_overlap() -> Scorer:
    """A stand-in pair model without weights: shared distinct words over all distinct words of the two texts."""
    def score(queries: list[str], articles: list[str]) -> np.ndarray:
        out = np.zeros(len(queries))
        for i, (q, a) in enumerate(zip(queries, articles)):
            q, a = set(words_of(q.lower())), set(words_of(a.lower()))
            either = len(q | a)
            out[i] = len(q & a) / either if either else 0.0
        return out
    return score
