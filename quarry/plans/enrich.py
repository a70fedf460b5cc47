"""Rewrite-and-encode queries (E7) and generate-and-encode titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.prompts import rewrite_prompt, title_prompt
from quarry.functions.text import text_head, with_prefix
from quarry.operators.infer import (BATCH_GENERATE_TITLES, BATCH_QUERIES, BATCH_REWRITE, embed_column,
                                    MAX_NEW_TOKENS_REWRITE, MAX_NEW_TOKENS_TITLES, generate_column)


def rewrite_queries(queries: DataFrame, make_generator, max_new_tokens: int = MAX_NEW_TOKENS_REWRITE,
                    distinct: bool = False) -> DataFrame:
    """E5: (query_id, query_text, rewritten_text, ground_truth) with the generator's rewrite; ``distinct``: each distinct query
    is rewritten once."""
    p = queries.withColumn("_prompt", rewrite_prompt("query_text"))
    out = generate_column(p, "_prompt", make_generator, BATCH_REWRITE, "rewritten_text", max_new_tokens, distinct).drop("_prompt")
    cols = [c for c in ["query_id", "query_text", "rewritten_text", "ground_truth"] if c in out.columns]
    return out.select(*cols)


def rewrite_and_embed(queries: DataFrame, make_generator, make_encoder) -> DataFrame:
    """E5, then the instruction prefix (P1) and the encoder (E1) over the rewritten text."""
    rw = rewrite_queries(queries, make_generator)
    enc = embed_column(rw.withColumn("_in", with_prefix("rewritten_text")), "_in", make_encoder, BATCH_QUERIES)
    return enc.drop("_in")


def generate_titles(articles: DataFrame, make_generator, max_new_tokens: int = MAX_NEW_TOKENS_TITLES,
                    distinct: bool = False) -> DataFrame:
    """(article_id, generated_title) from the first 1500 characters of the body."""
    p = articles.select("article_id", title_prompt(text_head("body")).alias("_prompt"))
    out = generate_column(p, "_prompt", make_generator, BATCH_GENERATE_TITLES, "generated_title", max_new_tokens, distinct)
    return out.drop("_prompt")


def generate_and_embed(articles: DataFrame, make_generator, make_encoder) -> DataFrame:
    """E6 then the encoder over the generated title (no prefix, as for titles)."""
    gen = generate_titles(articles, make_generator)
    return embed_column(gen, "generated_title", make_encoder, BATCH_QUERIES).select(
        "article_id", "generated_title", F.col("embedding"))
