"""Failure analysis of AP = 0 queries (A1-A5), for any number of methods in one pass.

Input ``ap`` is the union of per-query AP tables with a ``method`` column (S9 layout). Everything is
grouped or windowed by method, so adding methods adds rows, not jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import char_length, parse_gt_lenient

# Body-length histogram edges (half-open bins, the last one open-ended).
LENGTH_EDGES = [0, 500, 1000, 2000, 5000, 10000, 20000, 50000]
N_EXAMPLES = 15


def zero_split(ap: DataFrame) -> DataFrame:
    """A1: per method, queries with AP exactly 0 against AP > 0, with the share in percent (1 decimal)."""
    g = ap.groupBy("method").agg(F.count(F.lit(1)).cast("bigint").alias("n_queries"),
                                 F.count_if(F.col("ap") == 0).cast("bigint").alias("n_zero"),
                                 F.count_if(F.col("ap") > 0).cast("bigint").alias("n_nonzero"))
    return g.select("method", "n_queries", "n_zero",
                    F.round(F.col("n_zero") * 100.0 / F.col("n_queries"), 1).alias("pct_zero"), "n_nonzero")


def zero_gt_lengths(ap: DataFrame, queries: DataFrame, articles: DataFrame) -> DataFrame:
    """(method, query_id, pos, article_id, body_len): one row per ground-truth id of every AP = 0 query.

    Ids come from the lenient parse (repeats kept); an id without an article has length 0. A query
    missing from the query table has no ids.
    """
    zero = ap.where(F.col("ap") == 0).select("method", "query_id")
    ids = (zero.join(queries.select("query_id", "ground_truth"), "query_id", "left")
           .select("method", "query_id", F.posexplode_outer(parse_gt_lenient("ground_truth")).alias("pos", "article_id"))
           .where(F.col("pos").isNotNull()))
    lens = articles.select(F.col("article_id").cast("bigint"), char_length("body").alias("_len"))
    return (ids.join(lens, "article_id", "left")
            .select("method", "query_id", "pos", "article_id", F.coalesce("_len", F.lit(0)).cast("bigint").alias("body_len")))


def gt_length_stats(lengths: DataFrame) -> DataFrame:
    """A2: count, mean, exact (interpolated) median, min and max of the lengths, per method.

    The exact median keeps a value -> count map per group, bounded by the number of distinct lengths.
    """
    return lengths.groupBy("method").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg("body_len").alias("mean_len"),
        F.median("body_len").cast("double").alias("median_len"),
        F.min("body_len").cast("bigint").alias("min_len"),
        F.max("body_len").cast("bigint").alias("max_len"))


def length_bin_lo(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    expr = F.lit(None).cast("bigint")
    for lo in LENGTH_EDGES:
        expr = F.when(c >= lo, F.lit(lo).cast("bigint")).otherwise(expr)
    return expr


def gt_length_histogram(lengths: DataFrame) -> DataFrame:
    """A3: (method, lo, hi, n) over [lo, hi) bins; hi is NULL for the open last bin; empty bins omitted."""
    his = {lo: hi for lo, hi in zip(LENGTH_EDGES, LENGTH_EDGES[1:] + [None])}
    hi_expr = F.lit(None).cast("bigint")
    for lo, hi in his.items():
        if hi is not None:
            hi_expr = F.when(F.col("lo") == lo, F.lit(hi).cast("bigint")).otherwise(hi_expr)
    return (lengths.withColumn("lo", length_bin_lo("body_len")).groupBy("method", "lo")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .select("method", "lo", hi_expr.alias("hi"), "n"))


def zero_examples(ap: DataFrame, queries: DataFrame, articles: DataFrame, n: int = N_EXAMPLES) -> DataFrame:
    """A4: the first n AP = 0 queries by id per method, one row per ground-truth id (or one row with no id).

    The row_number <= n filter becomes a partial per-task limit before the shuffle, so a method whose
    queries all fail still moves only n rows per task.
    """
    w = Window.partitionBy("method").orderBy("query_id")
    first = (ap.where(F.col("ap") == 0).select("method", "query_id")
             .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn"))
    q = queries.select("query_id", "query_text", "ground_truth")
    ex = first.join(q, "query_id", "left").select(
        "method", "query_id", F.coalesce("query_text", F.lit("?")).alias("query_text"),
        F.coalesce("ground_truth", F.lit("")).alias("ground_truth"),
        F.posexplode_outer(parse_gt_lenient("ground_truth")).alias("pos", "article_id"))
    arts = articles.select(F.col("article_id").cast("bigint"), F.col("title").alias("_t"), F.col("body").alias("_b"))
    return (ex.join(arts, "article_id", "left")
            .select("method", "query_id", "query_text", "ground_truth", F.col("pos").cast("bigint"), "article_id",
                    F.when(F.col("article_id").isNull(), F.lit(None))
                    .otherwise(F.coalesce("_t", F.lit("?"))).alias("title"),
                    F.when(F.col("article_id").isNull(), F.lit(None))
                    .otherwise(F.coalesce("_b", F.lit(""))).alias("body"),
                    F.when(F.col("article_id").isNull(), F.lit(None))
                    .otherwise(char_length("_b")).cast("bigint").alias("body_len")))


def analyze(ap: DataFrame, queries: DataFrame, articles: DataFrame, n_examples: int = N_EXAMPLES) -> dict[str, DataFrame]:
    """A5: the whole failure analysis for every method in ``ap`` (sections as DataFrames)."""
    lengths = zero_gt_lengths(ap, queries, articles)
    return {"zero_split": zero_split(ap), "gt_length_stats": gt_length_stats(lengths),
            "gt_length_histogram": gt_length_histogram(lengths),
            "zero_examples": zero_examples(ap, queries, articles, n_examples)}
