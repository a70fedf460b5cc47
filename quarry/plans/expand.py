"""Document expansion: generated queries per article, encoded, and ranked by an article's best variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.prompts import expansion_prompt
from quarry.operators.infer import BATCH_GENERATE_TITLES, MAX_NEW_TOKENS_REWRITE, generate_column
from quarry.operators.rank import block_top_k, top_k_pairs

VARIANTS = 3


def text_part(text: Column, part: Column, parts: int) -> Column:
    """The ``part``-th (from 0) of ``parts`` consecutive pieces that make up the whole text, in characters."""
    n = F.length(text)
    start = F.floor(n * part / parts).cast("int")
    end = F.floor(n * (part + 1) / parts).cast("int")
    return F.substring(text, start + 1, end - start)


def expand_articles(articles: DataFrame, make_generator, n_variants: int = VARIANTS, text_col: str = "body",
                    max_new_tokens: int = MAX_NEW_TOKENS_REWRITE) -> DataFrame:
    """(article_id, variant, generated_query): ``n_variants`` queries that an article answers, each asked for by a prompt with
    another part of its text, so that the whole text is seen. A null text counts as an empty one."""
    part = F.explode(F.sequence(F.lit(0), F.lit(n_variants - 1))).alias("variant")
    rows = articles.select("article_id", F.coalesce(F.col(text_col), F.lit("")).alias("_text"), part)
    rows = rows.select("article_id", "variant", expansion_prompt(text_part(F.col("_text"), F.col("variant"), n_variants)).alias("_prompt"))
    out = generate_column(rows, "_prompt", make_generator, BATCH_GENERATE_TITLES, "generated_query", max_new_tokens)
    return out.select("article_id", "variant", "generated_query")


def best_variant_ranker(variants: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """An R4 ranker over several vectors per article (article_id, embedding): an article's score is that of its best vector.

    An article among the ``k`` best has its best vector among the first k * v vectors, v the most that any article has: only
    vectors of better articles come before it. So the block ranker finds that many, and a maximum per
    (query, article) is all that is left to aggregate.
    """
    most = variants.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    found = block_top_k(variants, queries, k * most)
    return top_k_pairs(found.groupBy("query_id", "article_id").agg(F.max("score").alias("score")), k)
