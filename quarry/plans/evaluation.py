"""Evaluation runs (V10) and the method suite.

A suite is one job: the rankings of all methods are one table keyed by method, which is judged, aggregated and windowed
once, whatever the number of methods. A run of one method is a suite of one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import evaluate as ev
from quarry.operators.lookup import title_source
from quarry.operators.rank import Ranker, dense_ranker
from quarry.session import materialize
from quarry.sources.tables import write_ap, write_run


@dataclass
class MethodConfig:
    """One suite entry: which articles (vectors, or texts for a ranker that reads texts) are ranked against which queries."""
    method: str
    article_vectors: DataFrame
    query_vectors: DataFrame
    ranker: Ranker = dense_ranker


def evaluate_suite(configs: list[MethodConfig], queries: DataFrame, articles: DataFrame, k: int = 10,
                   n_report: int = 10) -> dict[str, DataFrame]:
    """V10 for several methods: rank each, then every report section for all of them, keyed by ``method``.

    Written once: the queries, the rankings, AP and the article statistics; the sections read those. Sections: header (run, run_at, k), summary (run, map, n_queries), per_query_ap, worst_queries,
    best_queries, worst_by_fp, worst_by_missed, ap_distribution.
    """
    names = [c.method for c in configs]
    if len(set(names)) < len(names):
        raise ValueError("methods of a suite must have different names")
    queries = materialize(queries.select("query_id", "query_text", "ground_truth"), "suite-queries")
    gt = ev.ground_truth(queries)
    found = None
    for c in configs:
        one = c.ranker(c.article_vectors, c.query_vectors, k).select(F.lit(c.method).alias("method"), "query_id", "rank", "article_id")
        found = one if found is None else found.unionByName(one)
    rankings = materialize(found, "suite-rankings")
    judged = ev.judge(rankings, gt, k)
    ap = materialize(ev.average_precision(judged, gt, k, names), "suite-ap")
    stats = materialize(ev.article_stats(judged, gt, articles, names), "suite-stats")
    titles = _titles(configs, articles)
    return {
        "header": ap.groupBy("method").agg(F.first("method").alias("run")).select(
            "method", "run", F.current_timestamp().alias("run_at"), F.lit(k).cast("int").alias("k")),
        "summary": ev.mean_average_precision(ap).select("method", F.col("method").alias("run"), "map", "n_queries"),
        "per_query_ap": ap,
        "worst_queries": ev.query_report(ev.worst_queries(ap, n_report), queries, rankings, titles, k, n_report),
        "best_queries": ev.query_report(ev.best_queries(ap, n_report), queries, rankings, titles, k, n_report),
        "worst_by_fp": ev.worst_by_fp(stats, titles, n_report),
        "worst_by_missed": ev.worst_by_missed(stats, titles, n_report),
        "ap_distribution": ev.ap_distribution(ap),
    }


def _titles(configs: list[MethodConfig], articles: DataFrame) -> DataFrame:
    """Titles as P7 has them: of a table of article vectors that carries titles, else of the articles. Methods of one suite
    that disagree keep their own by method."""
    own = [title_source(c.article_vectors, articles) for c in configs if "title" in c.article_vectors.columns]
    if not own:
        return title_source(articles, articles)
    out = None
    for c in configs:
        one = title_source(c.article_vectors, articles).select(F.lit(c.method).alias("method"), "article_id", "title")
        out = one if out is None else out.unionByName(one)
    return out


def evaluate(ranker: Ranker, article_vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame,
             articles: DataFrame, method: str, k: int = 10, n_report: int = 10) -> dict[str, DataFrame]:
    """Rank, then every report section for ``method``."""
    report = evaluate_suite([MethodConfig(method, article_vectors, query_vectors, ranker)], queries, articles, k, n_report)
    return {name: df.drop("method") for name, df in report.items()}


def run_method(path: str, method: str, ranker: Ranker, article_vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame,
               articles: DataFrame, k: int = 10) -> DataFrame:
    """V10 + S9 + S10: evaluate, write every section and the AP table, return the summary as written."""
    run_suite([MethodConfig(method, article_vectors, query_vectors, ranker)], queries, articles, path, k)
    spark = queries.sparkSession
    return spark.read.parquet(f"{path}/runs/summary").where(F.col("method") == method)


def run_suite(configs: list[MethodConfig], queries: DataFrame, articles: DataFrame, path: str, k: int = 10) -> DataFrame:
    """All configurations as one run (V10), written by method, then compared (V11) from the written AP tables."""
    report = evaluate_suite(configs, queries, articles, k)
    write_run(report, f"{path}/runs")
    write_ap(report["per_query_ap"], f"{path}/ap")
    spark = queries.sparkSession
    ap = spark.read.parquet(f"{path}/ap").where(F.col("method").isin([c.method for c in configs]))
    return ev.compare_methods(ap)
