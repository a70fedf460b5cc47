"""Two-stage article preparation (T4) and its size statistics (T5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.html import clean_html
from quarry.operators.markdown import convert_dataframe, html_to_text


def prepare_articles(articles: DataFrame, column: str = "body", id_col: str = "article_id") -> DataFrame:
    """T4: stage 1 (HTML cleanup) then stage 2 (HTML -> text) on ``column``, one job."""
    return convert_dataframe(clean_html(articles, column, id_col), column, column)


def cleanup_stats(articles: DataFrame, column: str = "body", id_col: str = "article_id") -> DataFrame:
    """T5: article count and mean length in characters of the raw HTML, after stage 1, after stage 2."""
    stage1 = clean_html(articles.select(id_col, column), column, id_col).withColumnRenamed(column, "_s1")
    both = articles.select(id_col, F.length(column).alias("_l0")).join(stage1, id_col)
    return both.agg(F.count(F.lit(1)).cast("bigint").alias("n_articles"),
                    F.avg("_l0").alias("mean_raw"),
                    F.avg(F.length("_s1")).alias("mean_stage1"),
                    F.avg(F.length(html_to_text(F.col("_s1")))).alias("mean_stage2"))
