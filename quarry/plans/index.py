"""Index build: everything that ranking and the method suite read, prepared once and written.

articles -> cleaned text (T4 -> S4); titles without and bodies with the instruction prefix, queries and their rewrites with
it, generated titles without -> vectors (E1/E1b -> S6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import with_prefix
from quarry.plans.answer import hashing_embedder
from quarry.plans.enrich import generate_titles, rewrite_queries
from quarry.plans.prepare import prepare_articles
from quarry.sources import tables

#: Vector tables of an index: name -> id column.
VECTORS = {"titles": "article_id", "bodies": "article_id", "queries": "query_id", "rewritten": "query_id", "generated": "article_id"}


def build_index(articles: DataFrame, queries: DataFrame, path: str, embed=None, make_generator=None) -> None:
    """Write the index of ``articles`` (article_id, title, body as HTML) and ``queries`` (query_id, query_text).

    ``embed(df, text_col)`` adds ``embedding``; without a generator there are no rewritten queries and generated titles. Each
    text is encoded once; a second build replaces the first.
    """
    spark = articles.sparkSession
    embed = embed or hashing_embedder()
    tables.write_cleaned(prepare_articles(articles), f"{path}/articles")
    cleaned = tables.read_cleaned(spark, f"{path}/articles")
    texts = {"titles": (cleaned, F.col("title")), "bodies": (cleaned, with_prefix("body")),
             "queries": (queries, with_prefix("query_text"))}
    if make_generator is not None:
        tables.write_derived_text(rewrite_queries(queries, make_generator), f"{path}/rewritten_queries")
        tables.write_derived_text(generate_titles(cleaned, make_generator), f"{path}/generated_titles")
        texts["rewritten"] = (spark.read.parquet(f"{path}/rewritten_queries"), with_prefix("rewritten_text"))
        texts["generated"] = (spark.read.parquet(f"{path}/generated_titles"), F.col("generated_title"))
    for name, (df, text) in texts.items():
        encoded = embed(df.select(VECTORS[name], text.alias("_text")), "_text")
        tables.write_embeddings(encoded, f"{path}/vectors/{name}", VECTORS[name])


def read_vectors(spark: SparkSession, path: str, name: str, dim: int | None = None) -> DataFrame:
    return tables.read_embeddings(spark, f"{path}/vectors/{name}", dim=dim)
