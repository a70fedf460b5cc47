"""Answer job on unlabelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.functions.text import with_prefix
from quarry.operators.infer import hashing_encode
from quarry.operators.rank import Ranker, dense_ranker, to_answer
from quarry.session import materialize
from quarry.sources.tables import write_answer


def hashing_embedder(dim: int = 64):
    """Default embedder for answer jobs: (df, text_col) -> df + embedding, with the JVM hashing encoder."""
    return lambda df, col: hashing_encode(df, col, dim)


def answer_queries(queries: DataFrame, articles: DataFrame, embed=None, ranker: Ranker = dense_ranker,
                   k: int = 10, article_vectors: DataFrame | None = None) -> DataFrame:
    """Prefix and encode the queries, encode article titles (no prefix), rank, build the answer table.

    ``embed(df, text_col)`` adds an ``embedding`` column (E1 with a model factory, or E1b); pass
    ``article_vectors`` to reuse stored title vectors instead of encoding titles again.
    """
    embed = embed or hashing_embedder()
    qv = embed(queries.select("query_id", with_prefix("query_text").alias("_t")), "_t").select("query_id", "embedding")
    if article_vectors is None:
        article_vectors = embed(articles.select("article_id", articles["title"].alias("_t")), "_t").select(
            "article_id", "embedding")
        article_vectors = materialize(article_vectors, "answer-articles")
    # written once: neither the ranker's look at the size nor a further block of queries runs the encoder again
    rankings = ranker(article_vectors, materialize(qv, "answer-queries"), k)
    return to_answer(rankings, queries)


def answer_to_csv(queries: DataFrame, articles: DataFrame, path: str, **kwargs) -> None:
    """R7 + S8."""
    write_answer(answer_queries(queries, articles, **kwargs), path)
