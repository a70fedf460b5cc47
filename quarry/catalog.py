"""Registered queries: one per operator of the inventory, each (spark, sf_dir) -> DataFrame.

Each query has a DuckDB twin in ``ORACLE`` (same column names, same rounding) unless it depends on an
injected model or writes files; those get the rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import WS_CLASS, parse_gt, parse_gt_lenient
from quarry.functions.text import QUERY_INSTRUCTION, char_length, text_head, with_prefix
from quarry.functions.vectors import TOKEN_PATTERN, l2_normalize
from quarry.operators import analyze as an
from quarry.operators import evaluate as ev
from quarry.operators.infer import hashing_encode
from quarry.operators import rank
from quarry.operators.lookup import title_source
from quarry.sources import fixtures, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _r6(x) -> F.Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


# ---------------------------------------------------------------- shared SQL fragments (DuckDB)

SQL_V = """
v_q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 10 = 0),
v_a AS (SELECT vec_id AS article_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 10 <> 0),
v_top AS (
  SELECT query_id, rank, article_id, score FROM (
    SELECT q.query_id, a.article_id, list_dot_product(q.e, a.e) AS score,
           row_number() OVER (PARTITION BY q.query_id
                              ORDER BY round(list_dot_product(q.e, a.e), 9) DESC, a.article_id) AS rank
    FROM v_q q, v_a a) WHERE rank <= 10),
v_gt AS (
  SELECT q.query_id, coalesce(string_agg(a.article_id::VARCHAR, ' ' ORDER BY a.article_id), '') AS ground_truth
  FROM v_q q LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(article_id::VARCHAR), article_id) AS r
                        FROM v_a) a ON a.label = q.label AND a.r <= 40 GROUP BY q.query_id),
v_queries AS (
  SELECT q.query_id, 'vector ' || q.query_id || ' label ' || q.label AS query_text, g.ground_truth
  FROM v_q q JOIN v_gt g USING (query_id)),
v_articles AS (
  SELECT article_id, 'vector ' || article_id || ' label ' || label AS title, '' AS body FROM v_a)
"""


def v_rankings(spark: SparkSession, sf_dir: str, k: int = 10):
    v = fixtures.vector_fixture(spark, sf_dir)
    return v, rank.block_top_k(v.article_vectors, v.query_vectors, k)


# ---------------------------------------------------------------- sources

@register("s5_read_embeddings", """
SELECT count(*)::BIGINT AS n_rows, min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim
FROM embeddings""")
def s5_read_embeddings(spark, sf_dir):
    return tables.embedding_summary(tables.read_embeddings(spark, f"{sf_dir}/embeddings.parquet"))


# ---------------------------------------------------------------- ranking

@register("r2_top_k", f"""
WITH {SQL_V}
SELECT query_id, rank::BIGINT AS rank, article_id, round(score, 6) AS score FROM v_top""")
def r2_top_k(spark, sf_dir):
    _, r = v_rankings(spark, sf_dir)
    return r.select("query_id", F.col("rank").cast("bigint"), "article_id", _r6("score").alias("score"))


@register("r3_block_ranker_small_blocks", f"""
WITH {SQL_V}
SELECT query_id, rank::BIGINT AS rank, article_id, round(score, 6) AS score FROM v_top""")
def r3_block_ranker_small_blocks(spark, sf_dir):
    """The same top-10 with a query side of many blocks, far beyond the broadcast budget (the beyond-budget path)."""
    v = fixtures.vector_fixture(spark, sf_dir)
    r = rank.block_top_k(v.article_vectors, v.query_vectors, 10, block_bytes=8 * 64 * 7)
    return r.select("query_id", F.col("rank").cast("bigint"), "article_id", _r6("score").alias("score"))


@register("r5_answer", f"""
WITH {SQL_V}
SELECT q.query_id, coalesce(string_agg(t.article_id::VARCHAR, ' ' ORDER BY t.rank), '') AS answer
FROM v_q q LEFT JOIN v_top t USING (query_id) GROUP BY q.query_id""")
def r5_answer(spark, sf_dir):
    v, r = v_rankings(spark, sf_dir)
    return rank.to_answer(r, v.queries)


@register("r6_check_answer", f"""
WITH {SQL_V},
ans AS (
  SELECT query_id, string_agg(article_id::VARCHAR, ' ' ORDER BY rank) AS answer FROM (
    SELECT query_id, rank, CASE WHEN query_id % 30 = 0 AND rank = 2 THEN article_id + 1000000 ELSE article_id END AS article_id
    FROM (SELECT query_id, rank, article_id FROM v_top UNION ALL
          SELECT query_id, 11 AS rank, article_id FROM v_top WHERE rank = 1 AND query_id % 20 = 0))
  GROUP BY query_id),
qs AS (SELECT query_id FROM v_q WHERE query_id % 40 <> 0
       UNION ALL SELECT 1000000 + query_id FROM v_q WHERE query_id % 70 = 0),
ids AS (SELECT query_id, unnest(string_split(answer, ' '))::BIGINT AS article_id FROM ans),
v AS (
  SELECT query_id, 'missing_query' AS violation FROM qs WHERE query_id NOT IN (SELECT query_id FROM ans)
  UNION SELECT query_id, 'unknown_query' FROM ans WHERE query_id NOT IN (SELECT query_id FROM qs)
  UNION SELECT query_id, 'too_many_ids' FROM ans WHERE len(string_split(answer, ' ')) > 10
  UNION SELECT query_id, 'repeated_ids' FROM ans
        WHERE len(list_distinct(string_split(answer, ' '))) < len(string_split(answer, ' '))
  UNION SELECT query_id, 'unknown_article' FROM ids WHERE article_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 0)),
checks AS (SELECT unnest(['missing_query','unknown_query','duplicate_query','too_many_ids','repeated_ids','unknown_article']) AS violation)
SELECT c.violation, count(v.query_id)::BIGINT AS n_queries FROM checks c LEFT JOIN v USING (violation) GROUP BY c.violation""")
def r6_check_answer(spark, sf_dir):
    """Answer checks on a deliberately damaged answer: extra repeated ids, unknown ids, missing and
    unknown queries, all derived from fixture V's ranking."""
    v, r = v_rankings(spark, sf_dir)
    extra = r.where((F.col("rank") == 1) & (F.col("query_id") % 20 == 0)).withColumn("rank", F.lit(11))
    damaged = r.unionByName(extra).withColumn(
        "article_id", F.when((F.col("query_id") % 30 == 0) & (F.col("rank") == 2), F.col("article_id") + 1000000)
        .otherwise(F.col("article_id")))
    answer = rank.to_answer(damaged)
    qs = v.query_vectors.select("query_id")
    qs = qs.where(F.col("query_id") % 40 != 0).unionByName(
        qs.where(F.col("query_id") % 70 == 0).select((F.col("query_id") + 1000000).alias("query_id")))
    return rank.answer_check_summary(rank.check_answer(answer, qs, v.articles))


# ---------------------------------------------------------------- evaluation

def sql_gt(src: str) -> str:
    """DuckDB twin of parse_gt."""
    return (f"list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(coalesce({src}, ''), "
            f"'{WS_CLASS}+'), lambda x: x <> ''), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL))")


def sql_tokens(src: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({src}, ''), '{WS_CLASS}+'), lambda x: x <> '')"


def sql_eval(p: str, top: str, queries: str, articles: str, k: int = 10) -> str:
    """DuckDB twin of ground_truth -> judge -> average_precision / article_stats, as CTEs named p_*."""
    return f"""
{p}_gt AS (SELECT query_id, {sql_gt('ground_truth')} AS gt FROM {queries}),
{p}_j AS (SELECT t.query_id, t.rank, t.article_id, list_contains(g.gt, t.article_id)::INT AS rel
          FROM {top} t JOIN {p}_gt g USING (query_id) WHERE t.rank <= {k}),
{p}_s AS (SELECT query_id, sum(CASE WHEN rel = 1 THEN hits / rank ELSE 0.0 END) AS s FROM (
          SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM {p}_j)
          GROUP BY query_id),
{p}_ap AS (SELECT g.query_id, CASE WHEN least(len(g.gt), {k}) > 0
                                   THEN coalesce(s.s, 0.0) / least(len(g.gt), {k}) ELSE 0.0 END AS ap
           FROM {p}_gt g LEFT JOIN {p}_s s USING (query_id)),
{p}_stats AS (
  SELECT a.article_id, coalesce(r.retrieved, 0)::BIGINT AS retrieved, coalesce(v.relevant, 0)::BIGINT AS relevant,
         coalesce(r.hits, 0)::BIGINT AS hits
  FROM {articles} a
  LEFT JOIN (SELECT article_id, count(*) AS retrieved, sum(rel) AS hits FROM {p}_j GROUP BY article_id) r USING (article_id)
  LEFT JOIN (SELECT article_id, count(*) AS relevant FROM (SELECT unnest(gt) AS article_id FROM {p}_gt)
             GROUP BY article_id) v USING (article_id))
"""


SQL_R = """
r_case AS (SELECT query_id, rank, article_id FROM v_top WHERE
             ((query_id // 10) % 5 = 0 AND rank IN (1)) OR ((query_id // 10) % 5 = 1 AND rank IN (1, 4)) OR
             ((query_id // 10) % 5 = 2 AND rank IN (10)) OR ((query_id // 10) % 5 = 3 AND rank IN (2, 3, 7))),
r_g AS (SELECT query_id, string_agg(article_id::VARCHAR, ' ' ORDER BY rank) AS gt FROM r_case GROUP BY query_id),
r_queries AS (
  SELECT q.query_id, q.query_text,
         CASE WHEN g.gt IS NOT NULL THEN g.gt WHEN (q.query_id // 50) % 2 = 0 THEN NULL ELSE '' END AS ground_truth
  FROM v_queries q LEFT JOIN r_g g USING (query_id))
"""

WITH_V = f"WITH {SQL_V}, {sql_eval('ve', 'v_top', 'v_queries', 'v_articles')}"
WITH_R = f"WITH {SQL_V}, {SQL_R}, {sql_eval('re', 'v_top', 'r_queries', 'v_articles')}"


class Eval:
    """One evaluated ranking: fixture, rankings, parsed ground truth, judged ranks, AP, article stats."""

    def __init__(self, fx: fixtures.Fixture, rankings, k: int = 10):
        self.fx, self.rankings, self.k = fx, rankings, k
        self.gt = ev.ground_truth(fx.queries)
        self.judged = ev.judge(rankings, self.gt, k)
        self.ap = ev.average_precision(self.judged, self.gt, k)

    @property
    def stats(self):
        return ev.article_stats(self.judged, self.gt, self.fx.articles)

    @property
    def titles(self):
        return title_source(self.fx.article_vectors if self.fx.article_vectors is not None else self.fx.articles,
                            self.fx.articles)


def eval_v(spark, sf_dir) -> Eval:
    v, r = v_rankings(spark, sf_dir)
    return Eval(v, r)


def eval_r(spark, sf_dir) -> Eval:
    v, r = v_rankings(spark, sf_dir)
    fx = fixtures.rank_fixture(spark, sf_dir, r)
    return Eval(fx, r)


def _ap_out(e: Eval):
    return e.ap.select("query_id", _r6("ap").alias("ap"))


@register("v1_ap_rank_cases", f"{WITH_R} SELECT query_id, round(ap, 6) AS ap FROM re_ap")
def v1_ap_rank_cases(spark, sf_dir):
    """AP on fixture R, whose answers are known: 1, 0.75, 0.1, 0.531746, 0."""
    return _ap_out(eval_r(spark, sf_dir))


@register("v1_ap_labels", f"{WITH_V} SELECT query_id, round(ap, 6) AS ap FROM ve_ap")
def v1_ap_labels(spark, sf_dir):
    return _ap_out(eval_v(spark, sf_dir))


@register("v2_map_labels", f"{WITH_V} SELECT round(avg(ap), 6) AS map, count(*)::BIGINT AS n_queries FROM ve_ap")
def v2_map_labels(spark, sf_dir):
    m = ev.mean_average_precision(eval_v(spark, sf_dir).ap)
    return m.select(_r6("map").alias("map"), "n_queries")


@register("v2_map_rank_cases", f"{WITH_R} SELECT round(avg(ap), 6) AS map, count(*)::BIGINT AS n_queries FROM re_ap")
def v2_map_rank_cases(spark, sf_dir):
    m = ev.mean_average_precision(eval_r(spark, sf_dir).ap)
    return m.select(_r6("map").alias("map"), "n_queries")


@register("v4_article_stats", f"{WITH_V} SELECT article_id, retrieved, relevant, hits FROM ve_stats")
def v4_article_stats(spark, sf_dir):
    return eval_v(spark, sf_dir).stats


@register("v4_article_stats_rank_cases", f"{WITH_R} SELECT article_id, retrieved, relevant, hits FROM re_stats")
def v4_article_stats_rank_cases(spark, sf_dir):
    return eval_r(spark, sf_dir).stats


def _sql_report(p: str, queries: str, titles: str, order: str, n: int = 10) -> str:
    """DuckDB twin of worst/best_queries + query_report."""
    sel_order = order
    list_order = "ap ASC, query_id ASC"
    return f"""
sel AS (SELECT query_id, ap, row_number() OVER (ORDER BY {list_order}) AS pos FROM (
          SELECT query_id, ap FROM {p}_ap ORDER BY {sel_order} LIMIT {n})),
exp_t AS (SELECT query_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (
          SELECT s.query_id, {sql_tokens('q.ground_truth')} AS toks FROM sel s JOIN {queries} q USING (query_id))),
exp AS (SELECT e.query_id, string_agg(e.tok || ' «' || coalesce(t.title, '?') || '»', ', ' ORDER BY e.i) AS expected
        FROM exp_t e LEFT JOIN {titles} t ON t.article_id = TRY_CAST(e.tok AS BIGINT) GROUP BY e.query_id),
got AS (SELECT r.query_id, string_agg(r.article_id || ' «' || coalesce(t.title, '?') || '»', ', ' ORDER BY r.rank) AS got
        FROM v_top r JOIN sel USING (query_id) LEFT JOIN {titles} t ON t.article_id = r.article_id GROUP BY r.query_id)
SELECT s.pos::BIGINT AS pos, s.query_id, round(s.ap, 6) AS ap, q.query_text, q.ground_truth,
       coalesce(exp.expected, '') AS expected, coalesce(got.got, '') AS got
FROM sel s JOIN {queries} q USING (query_id) LEFT JOIN exp USING (query_id) LEFT JOIN got USING (query_id)
"""


def _report_out(e: Eval, selected):
    rep = ev.query_report(selected, e.fx.queries, e.rankings, e.titles)
    return rep.select(F.col("pos").cast("bigint"), "query_id", _r6("ap").alias("ap"), "query_text", "ground_truth",
                      "expected", "got")


@register("v5_worst_queries", f"{WITH_V}, {_sql_report('ve', 'v_queries', 'v_articles', 'ap ASC, query_id ASC')}")
def v5_worst_queries(spark, sf_dir):
    e = eval_v(spark, sf_dir)
    return _report_out(e, ev.worst_queries(e.ap))


@register("v5_worst_queries_rank_cases", f"{WITH_R}, {_sql_report('re', 'r_queries', 'v_articles', 'ap ASC, query_id ASC')}")
def v5_worst_queries_rank_cases(spark, sf_dir):
    e = eval_r(spark, sf_dir)
    return _report_out(e, ev.worst_queries(e.ap))


@register("v6_best_queries", f"{WITH_R}, {_sql_report('re', 'r_queries', 'v_articles', 'ap DESC, query_id DESC')}")
def v6_best_queries(spark, sf_dir):
    e = eval_r(spark, sf_dir)
    return _report_out(e, ev.best_queries(e.ap))


@register("v6_best_queries_labels", f"{WITH_V}, {_sql_report('ve', 'v_queries', 'v_articles', 'ap DESC, query_id DESC')}")
def v6_best_queries_labels(spark, sf_dir):
    e = eval_v(spark, sf_dir)
    return _report_out(e, ev.best_queries(e.ap))


@register("v7_worst_by_fp", f"""{WITH_V}
SELECT row_number() OVER (ORDER BY fp DESC, article_id)::BIGINT AS pos, s.article_id, coalesce(a.title, '?') AS title,
       retrieved, relevant, hits, fp
FROM (SELECT *, retrieved - hits AS fp FROM ve_stats WHERE retrieved - hits > 0 ORDER BY fp DESC, article_id LIMIT 10) s
LEFT JOIN v_articles a USING (article_id)""")
def v7_worst_by_fp(spark, sf_dir):
    e = eval_v(spark, sf_dir)
    out = ev.worst_by_fp(e.stats, e.titles)
    return out.select("pos", "article_id", "title", "retrieved", "relevant", "hits", F.col("fp").cast("bigint"))


@register("v8_worst_by_missed", f"""{WITH_V}
SELECT row_number() OVER (ORDER BY missed DESC, article_id)::BIGINT AS pos, s.article_id, coalesce(a.title, '?') AS title,
       retrieved, relevant, hits, missed, round(recall, 6) AS recall
FROM (SELECT *, relevant - hits AS missed, CASE WHEN relevant > 0 THEN hits / relevant ELSE 0.0 END AS recall
      FROM ve_stats WHERE relevant - hits > 0 ORDER BY missed DESC, article_id LIMIT 10) s
LEFT JOIN v_articles a USING (article_id)""")
def v8_worst_by_missed(spark, sf_dir):
    e = eval_v(spark, sf_dir)
    out = ev.worst_by_missed(e.stats, e.titles)
    return out.select("pos", "article_id", "title", "retrieved", "relevant", "hits", F.col("missed").cast("bigint"),
                      _r6("recall").alias("recall"))


SQL_BUCKET = "floor(round(ap, 9) * 10) / 10"


@register("v9_ap_distribution", f"{WITH_V} SELECT {SQL_BUCKET} AS bucket, count(*)::BIGINT AS n_queries FROM ve_ap GROUP BY 1")
def v9_ap_distribution(spark, sf_dir):
    return ev.ap_distribution(eval_v(spark, sf_dir).ap)


@register("v9_ap_distribution_rank_cases", f"{WITH_R} SELECT {SQL_BUCKET} AS bucket, count(*)::BIGINT AS n_queries FROM re_ap GROUP BY 1")
def v9_ap_distribution_rank_cases(spark, sf_dir):
    return ev.ap_distribution(eval_r(spark, sf_dir).ap)


def sql_compare(union_sql: str) -> str:
    return f"""
SELECT method, round(avg(ap), 6) AS map, count(*)::BIGINT AS n_queries,
       count_if(ap = 0)::BIGINT AS n_zero, round(count_if(ap = 0) * 100.0 / count(*), 1) AS pct_zero,
       count_if({SQL_BUCKET} = 0)::BIGINT AS n_bucket0, round(count_if({SQL_BUCKET} = 0) * 100.0 / count(*), 1) AS pct_bucket0
FROM ({union_sql}) GROUP BY method"""


@register("v11_compare_methods", f"""{WITH_V}, {SQL_R}, {sql_eval('re', 'v_top', 'r_queries', 'v_articles')}
{sql_compare("SELECT 'labels' AS method, ap FROM ve_ap UNION ALL SELECT 'rank_cases' AS method, ap FROM re_ap")}""")
def v11_compare_methods(spark, sf_dir):
    apv = eval_v(spark, sf_dir).ap.withColumn("method", F.lit("labels"))
    apr = eval_r(spark, sf_dir).ap.withColumn("method", F.lit("rank_cases"))
    out = ev.compare_methods(apv.unionByName(apr))
    return out.select("method", _r6("map").alias("map"), "n_queries", "n_zero", "pct_zero", "n_bucket0", "pct_bucket0")


# ---------------------------------------------------------------- id parsing

@register("p3_parse_gt", f"""{WITH_R}
SELECT query_id, len(gt)::BIGINT AS n_ids, array_to_string(list_sort(gt), ' ') AS ids FROM re_gt""")
def p3_parse_gt(spark, sf_dir):
    q = eval_r(spark, sf_dir).fx.queries.select("query_id", parse_gt("ground_truth").alias("gt"))
    return q.select("query_id", F.size("gt").cast("bigint").alias("n_ids"),
                    F.array_join(F.array_sort("gt"), " ").alias("ids"))


@register("p4_parse_gt_lenient", f"""{WITH_R}
SELECT query_id, len(l)::BIGINT AS n_ids, array_to_string(l, ' ') AS ids FROM (
  SELECT query_id, list_transform(list_filter({sql_tokens('ground_truth')}, lambda x: regexp_full_match(x, '[0-9]+')),
                                  lambda x: x::BIGINT) AS l FROM r_queries)""")
def p4_parse_gt_lenient(spark, sf_dir):
    q = eval_r(spark, sf_dir).fx.queries.select("query_id", parse_gt_lenient("ground_truth").alias("gt"))
    return q.select("query_id", F.size("gt").cast("bigint").alias("n_ids"), F.array_join("gt", " ").alias("ids"))


# ---------------------------------------------------------------- text fixture T (hashing encoder)

HASH_DIM = 64

SQL_T = """
t_docs AS (SELECT doc_id AS article_id, source || ' #' || doc_id AS title, text AS body FROM documents),
t_pairs AS (SELECT b.item_id AS query_id, d.doc_id AS article_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
t_queries AS (
  SELECT b.item_id AS query_id, b.text AS query_text, coalesce(g.gt, '') AS ground_truth FROM benchmark b LEFT JOIN (
    SELECT query_id, string_agg(article_id::VARCHAR, ' ' ORDER BY article_id) AS gt FROM t_pairs GROUP BY query_id) g
  ON g.query_id = b.item_id)
"""


def sql_hash(name: str, table: str, id_col: str, text_expr: str, dim: int = HASH_DIM) -> str:
    """DuckDB twin of hashing_vector (E1b + E2): CTE ``name``(id, e)."""
    return f"""
{name}_b AS (SELECT {id_col} AS id, list_transform(regexp_extract_all(lower(coalesce({text_expr}, '')), '{TOKEN_PATTERN}'),
               lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim}) AS b FROM {table}),
{name}_c AS (SELECT id, list_transform(range({dim}), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS c FROM {name}_b),
{name} AS (SELECT id, list_transform(c, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0.0 END) AS e FROM (
             SELECT id, c, sqrt(list_sum(list_transform(c, lambda y: y * y))) AS n FROM {name}_c))
"""


def sql_stored(name: str, src: str) -> str:
    """Vectors as the embedding sink (S6) stores them: single precision."""
    return f"{name} AS (SELECT id, list_transform(e, lambda x: x::FLOAT::DOUBLE) AS e FROM {src})"


def sql_topk(name: str, qv: str, av: str, k: int = 10) -> str:
    return f"""
{name} AS (SELECT query_id, rank, article_id, score FROM (
  SELECT q.id AS query_id, a.id AS article_id, list_dot_product(q.e, a.e) AS score,
         row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.e, a.e), 9) DESC, a.id) AS rank
  FROM {qv} q, {av} a) WHERE rank <= {k})
"""


def sql_lenient(src: str) -> str:
    return f"list_transform(list_filter({sql_tokens(src)}, lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::BIGINT)"


SQL_T_METHODS = (SQL_T + ", " + sql_hash("t_qv", "t_queries", "query_id", f"'{QUERY_INSTRUCTION}' || query_text")
                 + ", " + sql_hash("t_bv", "t_docs", "article_id", f"'{QUERY_INSTRUCTION}' || body")
                 + ", " + sql_hash("t_hv", "t_docs", "article_id", "body")
                 + ", " + sql_topk("t_top_body", "t_qv", "t_bv") + ", " + sql_topk("t_top_head", "t_qv", "t_hv")
                 + ", " + sql_eval("tb", "t_top_body", "t_queries", "t_docs")
                 + ", " + sql_eval("th", "t_top_head", "t_queries", "t_docs")
                 + ", aps AS (SELECT 'hash_body' AS method, query_id, ap FROM tb_ap UNION ALL "
                   "SELECT 'hash_plain' AS method, query_id, ap FROM th_ap)")
WITH_T = f"WITH {SQL_T_METHODS}"


def text_methods(spark, sf_dir, dim: int = HASH_DIM):
    """Fixture T ranked two ways: prefixed query vs prefixed body, and vs the plain body (no prefix)."""
    fx = fixtures.text_fixture(spark, sf_dir)
    qv = hashing_encode(fx.queries.select("query_id", with_prefix("query_text").alias("t")), "t", dim)
    body = hashing_encode(fx.articles.select("article_id", with_prefix("body").alias("t")), "t", dim)
    plain = hashing_encode(fx.articles.select("article_id", F.col("body").alias("t")), "t", dim)
    qv = qv.select("query_id", "embedding")
    runs = {"hash_body": rank.block_top_k(body.select("article_id", "embedding"), qv, 10),
            "hash_plain": rank.block_top_k(plain.select("article_id", "embedding"), qv, 10)}
    return fx, runs


def text_ap(spark, sf_dir):
    fx, runs = text_methods(spark, sf_dir)
    aps = None
    for method, r in runs.items():
        ap = Eval(fx, r).ap.withColumn("method", F.lit(method))
        aps = ap if aps is None else aps.unionByName(ap)
    return fx, aps


@register("p1_with_prefix", f"SELECT item_id AS query_id, '{QUERY_INSTRUCTION}' || text AS text FROM benchmark")
def p1_with_prefix(spark, sf_dir):
    b = tables.read_table(spark, f"{sf_dir}/benchmark.parquet")
    return b.select(F.col("item_id").alias("query_id"), with_prefix("text").alias("text"))


@register("p2_text_head", "SELECT doc_id AS article_id, substr(text, 1, 1500) AS head FROM documents")
def p2_text_head(spark, sf_dir):
    d = tables.read_table(spark, f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("article_id"), text_head("text").alias("head"))


@register("p5_text_length", "SELECT doc_id AS article_id, coalesce(length(text), 0)::BIGINT AS n_chars FROM documents")
def p5_text_length(spark, sf_dir):
    d = tables.read_table(spark, f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("article_id"), char_length("text").alias("n_chars"))


@register("e1b_hashing_encode", f"""WITH {sql_hash('hv', 'documents', 'doc_id', 'text')}
SELECT id AS article_id, (i - 1)::BIGINT AS bucket, round(w, 6) AS weight FROM (
  SELECT id, unnest(e) AS w, generate_subscripts(e, 1) AS i FROM hv) WHERE w <> 0""")
def e1b_hashing_encode(spark, sf_dir):
    d = tables.read_table(spark, f"{sf_dir}/documents.parquet")
    v = hashing_encode(d.select(F.col("doc_id").alias("article_id"), "text"), "text", HASH_DIM)
    # posexplode_outer: a plain explode makes Catalyst infer size(embedding) > 0 below it, inlining the encoder.
    return (v.select("article_id", F.posexplode_outer("embedding").alias("bucket", "w")).where(F.col("w") != 0)
            .select("article_id", F.col("bucket").cast("bigint"), _r6("w").alias("weight")))


@register("e2_l2_normalize", """
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1], 6) AS first FROM (
  SELECT vec_id, list_transform(s, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0.0 END) AS v FROM (
    SELECT vec_id, s, sqrt(list_sum(list_transform(s, lambda x: x * x))) AS n FROM (
      SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * label) AS s FROM embeddings)))""")
def e2_l2_normalize(spark, sf_dir):
    """Vectors scaled by their label (label 0 gives the zero vector, which must stay zero), normalised."""
    e = tables.read_table(spark, f"{sf_dir}/embeddings.parquet")
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    v = e.select("vec_id", l2_normalize(scaled).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    return v.select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.element_at("v", 1), 6).alias("first"))


@register("fixture_t_ground_truth", f"WITH {SQL_T} SELECT query_id, query_text, ground_truth FROM t_queries")
def fixture_t_ground_truth(spark, sf_dir):
    """Fixture T's ground truth: documents containing each benchmark passage (Aho-Corasick scan)."""
    return fixtures.text_fixture(spark, sf_dir).queries


@register("v1_ap_text", f"{WITH_T} SELECT method, query_id, round(ap, 6) AS ap FROM aps")
def v1_ap_text(spark, sf_dir):
    _, aps = text_ap(spark, sf_dir)
    return aps.select("method", "query_id", _r6("ap").alias("ap"))


@register("r2_top_k_text", f"{WITH_T} SELECT query_id, rank::BIGINT AS rank, article_id, round(score, 6) AS score FROM t_top_body")
def r2_top_k_text(spark, sf_dir):
    _, runs = text_methods(spark, sf_dir)
    r = runs["hash_body"]
    return r.select("query_id", F.col("rank").cast("bigint"), "article_id", _r6("score").alias("score"))


@register("v11_compare_methods_text", f"{WITH_T} {sql_compare('SELECT method, ap FROM aps')}")
def v11_compare_methods_text(spark, sf_dir):
    _, aps = text_ap(spark, sf_dir)
    out = ev.compare_methods(aps)
    return out.select("method", _r6("map").alias("map"), "n_queries", "n_zero", "pct_zero", "n_bucket0", "pct_bucket0")


SQL_ZERO = f"""
zids AS (SELECT z.method, z.query_id, unnest({sql_lenient('q.ground_truth')}) AS article_id
         FROM (SELECT * FROM aps WHERE ap = 0) z LEFT JOIN t_queries q USING (query_id)),
zlen AS (SELECT zids.method, coalesce(length(d.body), 0)::BIGINT AS body_len FROM zids LEFT JOIN t_docs d USING (article_id))
"""


@register("a1_zero_split", f"""{WITH_T}
SELECT method, count(*)::BIGINT AS n_queries, count_if(ap = 0)::BIGINT AS n_zero,
       round(count_if(ap = 0) * 100.0 / count(*), 1) AS pct_zero, count_if(ap > 0)::BIGINT AS n_nonzero
FROM aps GROUP BY method""")
def a1_zero_split(spark, sf_dir):
    _, aps = text_ap(spark, sf_dir)
    return an.zero_split(aps)


@register("a2_gt_length_stats", f"""{WITH_T}, {SQL_ZERO}
SELECT method, count(*)::BIGINT AS n, round(avg(body_len), 6) AS mean_len, round(median(body_len)::DOUBLE, 6) AS median_len,
       min(body_len)::BIGINT AS min_len, max(body_len)::BIGINT AS max_len FROM zlen GROUP BY method""")
def a2_gt_length_stats(spark, sf_dir):
    fx, aps = text_ap(spark, sf_dir)
    st = an.gt_length_stats(an.zero_gt_lengths(aps, fx.queries, fx.articles))
    return st.select("method", "n", _r6("mean_len").alias("mean_len"), _r6("median_len").alias("median_len"),
                     "min_len", "max_len")


@register("a3_gt_length_histogram", f"""{WITH_T}, {SQL_ZERO}
SELECT method, lo::BIGINT AS lo, hi::BIGINT AS hi, count(*)::BIGINT AS n FROM (
  SELECT method, CASE WHEN body_len >= 50000 THEN 50000 WHEN body_len >= 20000 THEN 20000 WHEN body_len >= 10000 THEN 10000
                      WHEN body_len >= 5000 THEN 5000 WHEN body_len >= 2000 THEN 2000 WHEN body_len >= 1000 THEN 1000
                      WHEN body_len >= 500 THEN 500 ELSE 0 END AS lo,
         CASE WHEN body_len >= 50000 THEN NULL WHEN body_len >= 20000 THEN 50000 WHEN body_len >= 10000 THEN 20000
              WHEN body_len >= 5000 THEN 10000 WHEN body_len >= 2000 THEN 5000 WHEN body_len >= 1000 THEN 2000
              WHEN body_len >= 500 THEN 1000 ELSE 500 END AS hi FROM zlen)
GROUP BY method, lo, hi""")
def a3_gt_length_histogram(spark, sf_dir):
    fx, aps = text_ap(spark, sf_dir)
    return an.gt_length_histogram(an.zero_gt_lengths(aps, fx.queries, fx.articles))


@register("a4_zero_examples", f"""{WITH_T},
first_z AS (SELECT method, query_id FROM (
  SELECT method, query_id, row_number() OVER (PARTITION BY method ORDER BY query_id) AS rn FROM aps WHERE ap = 0) WHERE rn <= 15),
ex AS (SELECT f.method, f.query_id, coalesce(q.query_text, '?') AS query_text, coalesce(q.ground_truth, '') AS ground_truth,
              {sql_lenient('q.ground_truth')} AS ids FROM first_z f LEFT JOIN t_queries q USING (query_id)),
exu AS (SELECT method, query_id, query_text, ground_truth, unnest(ids) AS article_id, generate_subscripts(ids, 1) - 1 AS pos
        FROM ex WHERE len(ids) > 0
        UNION ALL SELECT method, query_id, query_text, ground_truth, NULL AS article_id, NULL AS pos FROM ex WHERE len(ids) = 0)
SELECT method, query_id, query_text, ground_truth, pos::BIGINT AS pos, article_id,
       CASE WHEN article_id IS NULL THEN NULL ELSE coalesce(d.title, '?') END AS title,
       CASE WHEN article_id IS NULL THEN NULL ELSE coalesce(d.body, '') END AS body,
       CASE WHEN article_id IS NULL THEN NULL ELSE coalesce(length(d.body), 0) END::BIGINT AS body_len
FROM exu LEFT JOIN t_docs d USING (article_id)""")
def a4_zero_examples(spark, sf_dir):
    fx, aps = text_ap(spark, sf_dir)
    return an.zero_examples(aps, fx.queries, fx.articles)


# ---------------------------------------------------------------- HTML cleanup and text conversion

from quarry import oracle_html as OH  # noqa: E402
from quarry.operators import html as H  # noqa: E402
from quarry.operators import markdown as MD  # noqa: E402
from quarry.plans.prepare import cleanup_stats, prepare_articles  # noqa: E402

STEP_IDS = {"images": "h1", "breaks": "h2", "inputs": "h3", "empty_labels": "h4", "links": "h5",
            "headline_chunk": "h6", "empty_tags": "h7", "factoids": "h8", "spoilers": "h9", "tabsets": "h10",
            "nested_tables": "h11", "empty_tables": "h12", "body": "h13"}


def _html_articles(spark, sf_dir):
    return fixtures.html_fixture(spark, sf_dir).articles


def _register_step(step: str):
    ctes, out = OH.clean_html_sql("h_src", "article_id", "body", "hs", [step])

    def run(spark, sf_dir):
        return H.clean_html(_html_articles(spark, sf_dir), "body", "article_id", [step]).select("article_id", "body")
    run.__doc__ = f"{STEP_IDS[step].upper()}: only the '{step}' step (plus comment/script/style removal) on fixture H."
    register(f"{STEP_IDS[step]}_{step}", f"WITH {OH.fixture_sql()}, {ctes} SELECT article_id, body FROM {out}")(run)


for _step in H.STEPS:
    _register_step(_step)

_ALL_CTES, _ALL_OUT = OH.clean_html_sql("h_src", "article_id", "body", "hc")
SQL_CLEAN = f"{OH.fixture_sql()}, {_ALL_CTES}"


@register("h14_clean_html", f"WITH {SQL_CLEAN} SELECT article_id, body FROM {_ALL_OUT}")
def h14_clean_html(spark, sf_dir):
    return H.clean_html(_html_articles(spark, sf_dir)).select("article_id", "body")


@register("t1_html_to_text", f"WITH {OH.fixture_sql()} SELECT article_id, {OH.html_to_text_sql('body')} AS body FROM h_src")
def t1_html_to_text(spark, sf_dir):
    """T1+T3 on raw fixture-H HTML (stage 2 alone)."""
    return MD.convert_dataframe(_html_articles(spark, sf_dir), "body", "body").select("article_id", "body")


@register("t2_collapse_whitespace", f"SELECT doc_id AS article_id, {OH.collapse_sql('text')} AS text FROM documents")
def t2_collapse_whitespace(spark, sf_dir):
    d = tables.read_table(spark, f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("article_id"), MD.collapse_whitespace("text").alias("text"))


@register("t3_convert_columns", f"""WITH {OH.fixture_sql()}
SELECT article_id, title, body, {OH.html_to_text_sql('body')} AS body_text FROM h_src""")
def t3_convert_columns(spark, sf_dir):
    """T3 with a separate output column: the HTML stays, the text lands in body_text."""
    return MD.convert_dataframe(_html_articles(spark, sf_dir), "body", "body_text")


@register("t4_prepare_articles", f"""WITH {SQL_CLEAN}
SELECT o.article_id, s.title, {OH.html_to_text_sql('o.body')} AS body FROM {_ALL_OUT} o JOIN h_src s USING (article_id)""")
def t4_prepare_articles(spark, sf_dir):
    return prepare_articles(_html_articles(spark, sf_dir)).select("article_id", "title", "body")


@register("t5_cleanup_stats", f"""WITH {SQL_CLEAN},
st AS (SELECT s.article_id, length(s.body) AS l0, length(o.body) AS l1, length({OH.html_to_text_sql('o.body')}) AS l2
       FROM h_src s JOIN {_ALL_OUT} o USING (article_id))
SELECT count(*)::BIGINT AS n_articles, round(avg(l0), 6) AS mean_raw, round(avg(l1), 6) AS mean_stage1,
       round(avg(l2), 6) AS mean_stage2 FROM st""")
def t5_cleanup_stats(spark, sf_dir):
    st = cleanup_stats(_html_articles(spark, sf_dir))
    return st.select("n_articles", _r6("mean_raw").alias("mean_raw"), _r6("mean_stage1").alias("mean_stage1"),
                     _r6("mean_stage2").alias("mean_stage2"))


# ---------------------------------------------------------------- prompts and injected models

from quarry.functions import prompts as PR  # noqa: E402
from quarry.operators import infer  # noqa: E402
from quarry.plans import answer as ANS  # noqa: E402
from quarry.plans import enrich  # noqa: E402
from quarry.plans import evaluation as EVR  # noqa: E402
from quarry.plans import index as IX  # noqa: E402
from quarry.session import materialize, scratch_path  # noqa: E402
from quarry.streaming import answer_stream  # noqa: E402


def _sql_prompt(system: str, shots, label: str, text_expr: str) -> str:
    n = 2 + 2 * len(shots)
    roles = ",".join(["system"] + ["user", "assistant"] * len(shots) + ["user"])
    fixed_chars = len(system) + sum(len(label + a) + len(b) for a, b in shots)
    return (f"{n}::BIGINT AS n_messages, '{roles}' AS roles, {OH.q(label)} || {text_expr} AS last_content, "
            f"({fixed_chars} + length({OH.q(label)} || {text_expr}))::BIGINT AS n_chars")


def _prompt_out(df, key: str, prompt_col: str = "prompt"):
    p = F.col(prompt_col)
    return df.select(key, F.size(p).cast("bigint").alias("n_messages"),
                     F.array_join(F.transform(p, lambda m: m["role"]), ",").alias("roles"),
                     F.element_at(p, -1)["content"].alias("last_content"),
                     F.aggregate(F.transform(p, lambda m: F.length(m["content"])), F.lit(0),
                                 lambda a, x: a + x).cast("bigint").alias("n_chars"))


SQL_NOISY = "noisy AS (SELECT conv_id * 1000000 + turn AS query_id, text AS query_text FROM conversations WHERE role = 'user')"


@register("e3_rewrite_prompt", f"WITH {SQL_NOISY} SELECT query_id, "
          f"{_sql_prompt(PR.REWRITE_SYSTEM, PR.REWRITE_SHOTS, PR.REWRITE_LABEL, 'query_text')} FROM noisy")
def e3_rewrite_prompt(spark, sf_dir):
    q = fixtures.noisy_queries(spark, sf_dir)
    return _prompt_out(q.withColumn("prompt", PR.rewrite_prompt("query_text")), "query_id")


@register("e4_title_prompt", "SELECT doc_id AS article_id, "
          + _sql_prompt(PR.TITLE_SYSTEM, PR.TITLE_SHOTS, PR.TITLE_LABEL, "substr(text, 1, 1500)") + " FROM documents")
def e4_title_prompt(spark, sf_dir):
    d = tables.read_table(spark, f"{sf_dir}/documents.parquet")
    return _prompt_out(d.select(F.col("doc_id").alias("article_id"), PR.title_prompt(text_head("text")).alias("prompt")),
                       "article_id")


def _sql_hash_digest(name: str) -> str:
    """Filled buckets of the vectors of CTE ``name``: exact whole numbers, whatever the float width."""
    return (f"(SELECT id, len(list_filter(e, lambda x: x <> 0))::BIGINT AS n_filled, "
            f"coalesce(list_sum(list_transform(range({HASH_DIM}), lambda i: CASE WHEN e[i + 1] <> 0 THEN i ELSE 0 END)), 0)::BIGINT "
            f"AS filled_sum FROM {name})")


def _hash_digest(col: str = "embedding"):
    at = F.filter(F.transform(F.col(col), lambda x, i: F.when(x != 0, i).otherwise(F.lit(-1))), lambda i: i >= 0)
    return [F.size(at).cast("bigint").alias("n_filled"),
            F.aggregate(at, F.lit(0), lambda a, i: a + i).cast("bigint").alias("filled_sum")]


_SQL_STRIP = OH.strip


@register("e1_embed_column", f"""WITH {sql_hash('e1_v', 'benchmark', 'item_id', f"'{QUERY_INSTRUCTION}' || text")}
SELECT id AS query_id, {HASH_DIM}::BIGINT AS dim, n_filled, filled_sum FROM {_sql_hash_digest('e1_v')}""")
def e1_embed_column(spark, sf_dir):
    """E1 through the injected-model path: a Python encoder factory run by predict_batch_udf."""
    b = tables.read_table(spark, f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"),
                                                                  with_prefix("text").alias("t"))
    enc = infer.embed_column(b, "t", infer.hashing_encoder_factory(HASH_DIM), infer.BATCH_QUERIES)
    return enc.select("query_id", F.size("embedding").cast("bigint").alias("dim"), *_hash_digest())


@register("e5_rewrite_queries", f"""WITH {SQL_NOISY}
SELECT query_id, query_text, {_SQL_STRIP("coalesce(query_text, '')")} AS rewritten_text FROM noisy""")
def e5_rewrite_queries(spark, sf_dir):
    """E5 with the deterministic stand-in generator (no model weights are available)."""
    return enrich.rewrite_queries(fixtures.noisy_queries(spark, sf_dir), infer.last_user_message)


@register("e6_generate_titles", f"""
SELECT doc_id AS article_id, {_SQL_STRIP("coalesce(substr(text, 1, 1500), '')")} AS generated_title FROM documents""")
def e6_generate_titles(spark, sf_dir):
    return enrich.generate_titles(fixtures.text_articles(spark, sf_dir), infer.last_user_message)


_SQL_REWRITTEN = f"rewritten AS (SELECT query_id, {_SQL_STRIP("coalesce(query_text, '')")} AS t FROM noisy)"


@register("e7_rewrite_and_embed", f"""WITH {SQL_NOISY}, {_SQL_REWRITTEN},
{sql_hash('e7_v', 'rewritten', 'query_id', f"'{QUERY_INSTRUCTION}' || t")}
SELECT r.query_id, r.t AS rewritten_text, {HASH_DIM}::BIGINT AS dim, n_filled, filled_sum
FROM rewritten r JOIN {_sql_hash_digest('e7_v')} v ON v.id = r.query_id""")
def e7_rewrite_and_embed(spark, sf_dir):
    out = enrich.rewrite_and_embed(fixtures.noisy_queries(spark, sf_dir), infer.last_user_message,
                                   infer.hashing_encoder_factory(HASH_DIM))
    return out.select("query_id", "rewritten_text", F.size("embedding").cast("bigint").alias("dim"), *_hash_digest())


@register("e8_generate_and_embed", f"""
WITH e8_t AS (SELECT doc_id, {_SQL_STRIP("coalesce(substr(text, 1, 1500), '')")} AS t FROM documents), {sql_hash('e8_v', 'e8_t', 'doc_id', 't')}
SELECT doc_id AS article_id, t AS generated_title, {HASH_DIM}::BIGINT AS dim, n_filled, filled_sum
FROM e8_t JOIN {_sql_hash_digest('e8_v')} v ON v.id = e8_t.doc_id""")
def e8_generate_and_embed(spark, sf_dir):
    out = enrich.generate_and_embed(fixtures.text_articles(spark, sf_dir), infer.last_user_message, infer.hashing_encoder_factory(HASH_DIM))
    return out.select("article_id", "generated_title", F.size("embedding").cast("bigint").alias("dim"), *_hash_digest())


# ---------------------------------------------------------------- pluggable ranker, evaluation runs, answer job

@register("r4_pluggable_ranker", f"{WITH_V} SELECT query_id, round(ap, 6) AS ap FROM ve_ap")
def r4_pluggable_ranker(spark, sf_dir):
    """Any (articles, queries, k) -> rankings callable plugs into evaluation; here one that takes three times as many
    candidates, scores those pairs anew and keeps the best of them."""
    def my_ranker(articles, queries, k):
        candidates = rank.block_top_k(articles, queries, 3 * k).select("query_id", "article_id")
        return rank.top_k_pairs(rank.score_pairs(candidates, queries, articles), k)
    v = fixtures.vector_fixture(spark, sf_dir)
    return _ap_out(Eval(v, my_ranker(v.article_vectors, v.query_vectors, 10)))


@register("v10_evaluate_run", f"""{WITH_V}
SELECT 'labels' AS method, 'labels' AS run, round(avg(ap), 6) AS map, count(*)::BIGINT AS n_queries FROM ve_ap""")
def v10_evaluate_run(spark, sf_dir):
    """V10 + S9 + S10: a full run written to the shared folder; the summary is read back from disk."""
    v = fixtures.vector_fixture(spark, sf_dir)
    summary = EVR.run_method(scratch_path(spark, "run"), "labels", ranker=rank.dense_ranker,
                             article_vectors=v.article_vectors, queries=v.queries, query_vectors=v.query_vectors,
                             articles=v.articles)
    return summary.select("method", "run", _r6("map").alias("map"), "n_queries")


def _run_section(spark, sf_dir, section):
    """Fixture V evaluated and written twice (the second run replaces the first), one section read back."""
    path = scratch_path(spark, "run")
    v = fixtures.vector_fixture(spark, sf_dir)
    for _ in range(2):
        EVR.run_method(path, "labels", ranker=rank.dense_ranker, article_vectors=v.article_vectors, queries=v.queries,
                       query_vectors=v.query_vectors, articles=v.articles)
    return tables.read_run(spark, f"{path}/runs", section, "labels")


@register("s10_header", f"{WITH_V} SELECT 'labels' AS run, 10::INT AS k, TRUE AS dated, 1::BIGINT AS n_headers")
def s10_header(spark, sf_dir):
    h = _run_section(spark, sf_dir, "header")
    return h.groupBy("run", "k", F.col("run_at").isNotNull().alias("dated")).agg(F.count(F.lit(1)).alias("n_headers"))


@register("s10_per_query_ap", f"{WITH_V} SELECT query_id, round(ap, 6) AS ap FROM ve_ap")
def s10_per_query_ap(spark, sf_dir):
    return _run_section(spark, sf_dir, "per_query_ap").select("query_id", _r6("ap").alias("ap"))


@register("s10_ap_distribution", ORACLE["v9_ap_distribution"])
def s10_ap_distribution(spark, sf_dir):
    return _run_section(spark, sf_dir, "ap_distribution").select("bucket", "n_queries")


@register("s10_worst_by_fp", ORACLE["v7_worst_by_fp"])
def s10_worst_by_fp(spark, sf_dir):
    out = _run_section(spark, sf_dir, "worst_by_fp")
    return out.select("pos", "article_id", "title", "retrieved", "relevant", "hits", F.col("fp").cast("bigint"))


@register("s10_worst_by_missed", ORACLE["v8_worst_by_missed"])
def s10_worst_by_missed(spark, sf_dir):
    out = _run_section(spark, sf_dir, "worst_by_missed")
    return out.select("pos", "article_id", "title", "retrieved", "relevant", "hits", F.col("missed").cast("bigint"),
                      _r6("recall").alias("recall"))


def _sql_suite() -> str:
    """Five methods over fixture T: (query side, article side) of each, by the hashing encoder and the stand-in generator."""
    prefix = f"'{QUERY_INSTRUCTION}' || "
    parts = [SQL_T, f"t_rw AS (SELECT query_id, {_SQL_STRIP('query_text')} AS t FROM t_queries)",
             f"t_gen AS (SELECT article_id, {_SQL_STRIP('substr(body, 1, 1500)')} AS t FROM t_docs)",
             sql_hash("t_qv", "t_queries", "query_id", prefix + "query_text"), sql_hash("t_rv", "t_rw", "query_id", prefix + "t"),
             sql_hash("t_tv", "t_docs", "article_id", "title"), sql_hash("t_bv", "t_docs", "article_id", prefix + "body"),
             sql_hash("t_gv", "t_gen", "article_id", "t")]
    parts += [sql_stored(f"t_{x}s", f"t_{x}v") for x in "qrtbg"]
    union = []
    for name, qv, av in SUITE:
        parts += [sql_topk(f"top_{name}", f"t_{qv}s", f"t_{av}s"), sql_eval(f"e_{name}", f"top_{name}", "t_queries", "t_docs")]
        union.append(f"SELECT '{name}' AS method, ap FROM e_{name}_ap")
    return "WITH " + ", ".join(p.strip() for p in parts) + " " + sql_compare(" UNION ALL ".join(union))


#: Method, query side (q: the query, r: its rewrite), article side (t: title, b: body, g: generated title).
SUITE = [("title", "q", "t"), ("body", "q", "b"), ("rewritten_title", "r", "t"), ("rewritten_body", "r", "b"),
         ("generated_title", "q", "g")]


@register("v12_method_suite", _sql_suite())
def v12_method_suite(spark, sf_dir):
    """V12 over fixture T: five methods run and compared from their written AP tables. Each side is encoded once and
    written (S6); titles and generated titles go without the prefix, queries, rewrites and bodies with it."""
    fx = fixtures.text_fixture(spark, sf_dir)
    fx.queries = materialize(fx.queries, "suite-queries")
    path = scratch_path(spark, "suite")
    rewritten = enrich.rewrite_queries(fx.queries, infer.last_user_message)
    generated = enrich.generate_titles(fx.articles, infer.last_user_message)
    sides = {"q": (fx.queries, "query_id", with_prefix("query_text")), "r": (rewritten, "query_id", with_prefix("rewritten_text")),
             "t": (fx.articles, "article_id", F.col("title")), "b": (fx.articles, "article_id", with_prefix("body")),
             "g": (generated, "article_id", F.col("generated_title"))}
    vectors = {}
    for name, (df, id_col, text) in sides.items():
        tables.write_embeddings(hashing_encode(df.select(id_col, text.alias("t")), "t", HASH_DIM), f"{path}/vectors-{name}", id_col)
        vectors[name] = tables.read_embeddings(spark, f"{path}/vectors-{name}", dim=HASH_DIM)
    configs = [EVR.MethodConfig(m, vectors[a], vectors[q]) for m, q, a in SUITE]
    out = EVR.run_suite(configs, fx.queries, fx.articles, path)
    return out.select("method", _r6("map").alias("map"), "n_queries", "n_zero", "pct_zero", "n_bucket0", "pct_bucket0")


SQL_R7 = (f"{SQL_NOISY}, h_pages AS (SELECT page_id AS article_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title "
          f"FROM pages), "
          + sql_hash("r7_qv", "noisy", "query_id", f"'{QUERY_INSTRUCTION}' || query_text") + ", "
          + sql_hash("r7_av", "h_pages", "article_id", "title") + ", " + sql_topk("r7_top", "r7_qv", "r7_av"))
SQL_R7_ANSWER = (f"WITH {SQL_R7} SELECT n.query_id, coalesce(string_agg(t.article_id::VARCHAR, ' ' ORDER BY t.rank), '') "
                 f"AS answer FROM noisy n LEFT JOIN r7_top t USING (query_id) GROUP BY n.query_id")


def _pages_titles(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/pages.parquet").select(
        F.col("page_id").alias("article_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@register("r7_answer_queries", SQL_R7_ANSWER)
def r7_answer_queries(spark, sf_dir):
    """Unlabelled queries (conversation user turns) answered against page titles, through the CSV sink."""
    path = scratch_path(spark, "answer")
    ANS.answer_to_csv(fixtures.noisy_queries(spark, sf_dir), _pages_titles(spark, sf_dir), path,
                      embed=ANS.hashing_embedder(HASH_DIM))
    return tables.read_answer(spark, path)


@register("r7_answer_stream", SQL_R7_ANSWER)
def r7_answer_stream(spark, sf_dir):
    """The same answers from the streaming job: query files are answered per micro-batch."""
    src = scratch_path(spark, "stream-in")
    fixtures.noisy_queries(spark, sf_dir).repartition(3).write.parquet(src)
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    q = answer_stream(spark, src, _pages_titles(spark, sf_dir), out, ckpt, embed=ANS.hashing_embedder(HASH_DIM))
    q.awaitTermination()
    return spark.read.parquet(out).select("query_id", "answer")


@register("index_build", f"""WITH {SQL_NOISY}, {OH.fixture_sql()}, {sql_hash('ix_qv', 'noisy', 'query_id', f"'{QUERY_INSTRUCTION}' || query_text")},
{sql_hash('ix_av', 'h_src', 'article_id', 'title')}, {sql_stored('ix_q', 'ix_qv')}, {sql_stored('ix_a', 'ix_av')},
{sql_topk('ix_top', 'ix_q', 'ix_a')}
SELECT n.query_id, coalesce(string_agg(t.article_id::VARCHAR, ' ' ORDER BY t.rank), '') AS answer
FROM noisy n LEFT JOIN ix_top t USING (query_id) GROUP BY n.query_id""")
def index_build(spark, sf_dir):
    """The whole index of fixture H built and written; conversation queries answered from its title and query vectors."""
    path, queries = scratch_path(spark, "index"), fixtures.noisy_queries(spark, sf_dir)
    IX.build_index(_html_articles(spark, sf_dir), queries, path, ANS.hashing_embedder(HASH_DIM), infer.last_user_message)
    ranked = rank.block_top_k(IX.read_vectors(spark, path, "titles", HASH_DIM), IX.read_vectors(spark, path, "queries", HASH_DIM))
    return rank.to_answer(ranked, queries)


# ---------------------------------------------------------------- sink / scan round trips

@register("s1_read_articles", f"""WITH {OH.fixture_sql()}
SELECT article_id, title, md5(body) AS body_md5 FROM h_src""")
def s1_read_articles(spark, sf_dir):
    path = scratch_path(spark, "articles")
    _html_articles(spark, sf_dir).write.parquet(path)
    return tables.read_articles(spark, path).select("article_id", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@register("s2_read_labelled_queries", f"WITH {SQL_T} SELECT query_id, query_text, ground_truth FROM t_queries")
def s2_read_labelled_queries(spark, sf_dir):
    path = scratch_path(spark, "calibration")
    fixtures.text_fixture(spark, sf_dir).queries.write.parquet(path)
    return tables.read_labelled_queries(spark, path)


@register("s3_read_queries", f"WITH {SQL_NOISY} SELECT query_id, query_text FROM noisy")
def s3_read_queries(spark, sf_dir):
    path = scratch_path(spark, "test")
    fixtures.noisy_queries(spark, sf_dir).write.parquet(path)
    return tables.read_queries(spark, path)


@register("s4_cleaned_round_trip", f"""WITH {SQL_CLEAN}
SELECT o.article_id, s.title, {OH.html_to_text_sql('o.body')} AS body FROM {_ALL_OUT} o JOIN h_src s USING (article_id)""")
def s4_cleaned_round_trip(spark, sf_dir):
    path = scratch_path(spark, "cleaned")
    tables.write_cleaned(prepare_articles(_html_articles(spark, sf_dir)), path)
    return tables.read_cleaned(spark, path)


@register("s6_embeddings_round_trip", """
SELECT vec_id AS article_id, 'vector ' || vec_id || ' label ' || label AS title, len(embedding)::BIGINT AS dim,
       round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last
FROM embeddings WHERE vec_id % 10 <> 0""")
def s6_embeddings_round_trip(spark, sf_dir):
    path = scratch_path(spark, "title-emb")
    v = fixtures.vector_fixture(spark, sf_dir)
    tables.write_embeddings(v.article_vectors.join(v.articles, "article_id"), path, "article_id", ("title",))
    e = tables.read_embeddings(spark, path)
    return e.select("article_id", "title", F.size("embedding").cast("bigint").alias("dim"),
                    F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"),
                    F.round(F.element_at("embedding", 64).cast("double"), 6).alias("last"))


@register("s7_derived_text", f"""WITH {SQL_NOISY}
SELECT query_id, query_text, {_SQL_STRIP("coalesce(query_text, '')")} AS rewritten_text FROM noisy""")
def s7_derived_text(spark, sf_dir):
    path = scratch_path(spark, "rewritten")
    tables.write_derived_text(enrich.rewrite_queries(fixtures.noisy_queries(spark, sf_dir),
                                                     infer.last_user_message), path)
    return spark.read.parquet(path)


@register("s8_answer_csv", f"""WITH {SQL_V}
SELECT q.query_id, coalesce(string_agg(t.article_id::VARCHAR, ' ' ORDER BY t.rank), '') AS answer
FROM v_q q LEFT JOIN v_top t USING (query_id) GROUP BY q.query_id""")
def s8_answer_csv(spark, sf_dir):
    path = scratch_path(spark, "answer-v")
    tables.write_answer(r5_answer(spark, sf_dir), path)
    return tables.read_answer(spark, path)


@register("s9_ap_round_trip", f"{WITH_V} SELECT 'labels' AS method, query_id, round(ap, 6) AS ap FROM ve_ap")
def s9_ap_round_trip(spark, sf_dir):
    path = scratch_path(spark, "ap")
    tables.write_ap(eval_v(spark, sf_dir).ap, path, "labels")
    return tables.read_ap(spark, path, ["labels"]).select("method", "query_id", _r6("ap").alias("ap"))


# ---------------------------------------------------------------- title lookup and rendering

from quarry.operators.lookup import render_ids, with_titles  # noqa: E402

SQL_PAGE_TITLES = "p_titles AS (SELECT page_id AS article_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"


@register("p6_title_lookup", f"""WITH {SQL_V}, {SQL_PAGE_TITLES}
SELECT t.query_id, t.rank::BIGINT AS rank, t.article_id, coalesce(p.title, '?') AS title
FROM v_top t LEFT JOIN p_titles p USING (article_id)""")
def p6_title_lookup(spark, sf_dir):
    """Fixture V's top 10 with titles looked up in the pages' titles; ids without a page get '?'."""
    _, r = v_rankings(spark, sf_dir)
    out = with_titles(r, _pages_titles(spark, sf_dir))
    return out.select("query_id", F.col("rank").cast("bigint"), "article_id", "title")


@register("p7_title_source", "SELECT vec_id AS article_id, 'vector ' || vec_id || ' label ' || label AS title FROM embeddings WHERE vec_id % 10 <> 0")
def p7_title_source(spark, sf_dir):
    """Titles come from the embedding table when it has them, else from the article table."""
    v = fixtures.vector_fixture(spark, sf_dir)
    with_title = v.article_vectors.join(v.articles.select("article_id", "title"), "article_id")
    a = title_source(with_title, v.articles)
    b = title_source(v.article_vectors, v.articles)
    return a.join(b, ["article_id", "title"])


@register("p8_render_ids", f"""WITH {SQL_V}, {SQL_PAGE_TITLES}
SELECT q.query_id, coalesce(string_agg(t.article_id || ' «' || coalesce(p.title, '?') || '»', ', ' ORDER BY t.rank), '') AS got
FROM v_q q LEFT JOIN v_top t USING (query_id) LEFT JOIN p_titles p ON p.article_id = t.article_id GROUP BY q.query_id""")
def p8_render_ids(spark, sf_dir):
    v, r = v_rankings(spark, sf_dir)
    ids = r.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_id"))),
                                                lambda x: x["article_id"]).alias("ids"))
    ids = v.query_vectors.select("query_id").join(ids, "query_id", "left")
    return render_ids(ids, "query_id", "ids", _pages_titles(spark, sf_dir), "got")


# ---------------------------------------------------------------- R1 pair scoring, V3, A5

@register("r1_score_pairs", f"""WITH {SQL_V}
SELECT query_id, article_id, round(score, 6) AS score, round(score, 6) AS gemm_score FROM v_top""")
def r1_score_pairs(spark, sf_dir):
    """R1 on given pairs: the top-10 pairs re-scored by the JVM dot product, beside the GEMM score."""
    v, r = v_rankings(spark, sf_dir)
    pairs = r.select("query_id", "article_id", F.col("score").alias("gemm_score"))
    scored = rank.score_pairs(pairs.select("query_id", "article_id"), v.query_vectors, v.article_vectors)
    return (scored.join(pairs, ["query_id", "article_id"])
            .select("query_id", "article_id", _r6("score").alias("score"), _r6("gemm_score").alias("gemm_score")))


@register("v3_per_query_ap", f"""{WITH_R}
SELECT query_id, round(ap, 6) AS ap, {SQL_BUCKET} AS bucket FROM re_ap""")
def v3_per_query_ap(spark, sf_dir):
    """V3: the per-query AP table (one row per query id; duplicate ids are rejected up front)."""
    ap = eval_r(spark, sf_dir).ap
    return ap.select("query_id", _r6("ap").alias("ap"), ev.ap_bucket().alias("bucket"))


@register("a5_analyze", f"""{WITH_T}, {SQL_ZERO},
z AS (SELECT method, count(*)::BIGINT AS n_queries, count_if(ap = 0)::BIGINT AS n_zero FROM aps GROUP BY method),
l AS (SELECT method, count(*)::BIGINT AS n_lengths, max(body_len)::BIGINT AS max_len,
             count(DISTINCT len(list_filter([500, 1000, 2000, 5000, 10000, 20000, 50000], lambda e: body_len >= e)))::BIGINT AS n_bins
      FROM zlen GROUP BY method),
x AS (SELECT method, sum(greatest(len({sql_lenient('ground_truth')}), 1))::BIGINT AS n_examples FROM (
        SELECT method, query_id FROM aps WHERE ap = 0 QUALIFY row_number() OVER (PARTITION BY method ORDER BY query_id) <= 15)
      JOIN t_queries USING (query_id) GROUP BY method)
SELECT z.method, z.n_queries, z.n_zero, coalesce(l.n_lengths, 0)::BIGINT AS n_lengths, l.max_len, coalesce(l.n_bins, 0)::BIGINT AS n_bins,
       coalesce(x.n_examples, 0)::BIGINT AS n_examples
FROM z LEFT JOIN l USING (method) LEFT JOIN x USING (method)""")
def a5_analyze(spark, sf_dir):
    """A5: the full analysis of both text methods in one pass; its four sections joined by method."""
    fx, aps = text_ap(spark, sf_dir)
    sec = an.analyze(materialize(aps, "a5-ap"), fx.queries, fx.articles)
    st = sec["gt_length_stats"].select("method", F.col("n").alias("n_lengths"), "max_len")
    bins = sec["gt_length_histogram"].groupBy("method").agg(F.count(F.lit(1)).alias("n_bins"))
    examples = sec["zero_examples"].groupBy("method").agg(F.count(F.lit(1)).alias("n_examples"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (sec["zero_split"].join(st, "method", "left").join(bins, "method", "left").join(examples, "method", "left")
            .select("method", "n_queries", "n_zero", none("n_lengths"), "max_len", none("n_bins"), none("n_examples")))


@register("e5_rewrite_distinct", ORACLE["e5_rewrite_queries"])
def e5_rewrite_distinct(spark, sf_dir):
    """E5 with each distinct query text rewritten once and joined back."""
    return enrich.rewrite_queries(fixtures.noisy_queries(spark, sf_dir), infer.last_user_message, distinct=True)


# k beyond the number of articles, over a small corpus: the names of all nations, for all passages
@register("r2_top_k_beyond_corpus", f"""WITH {sql_hash('n_qv', 'benchmark', 'item_id', 'text')}, {sql_hash('n_av', 'nation', 'n_nationkey::BIGINT', 'n_name')},
{sql_topk('n_top', 'n_qv', 'n_av', 100)}
SELECT query_id, rank::BIGINT AS rank, article_id, round(score, 6) AS score FROM n_top""")
def r2_top_k_beyond_corpus(spark, sf_dir):
    """k larger than the corpus returns every article: 25 nations for each passage, k = 100."""
    names = tables.read_table(spark, f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("article_id"), "n_name")
    texts = tables.read_table(spark, f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    r = rank.block_top_k(hashing_encode(names, "n_name", HASH_DIM), hashing_encode(texts, "text", HASH_DIM), k=100)
    return r.select("query_id", F.col("rank").cast("bigint"), "article_id", _r6("score").alias("score"))


@register("s10_worst_queries", ORACLE["v5_worst_queries"])
def s10_worst_queries(spark, sf_dir):
    return _run_report(spark, sf_dir, "worst_queries")


@register("s10_best_queries", ORACLE["v6_best_queries_labels"])
def s10_best_queries(spark, sf_dir):
    return _run_report(spark, sf_dir, "best_queries")


def _run_report(spark, sf_dir, section):
    out = _run_section(spark, sf_dir, section)
    return out.select(F.col("pos").cast("bigint"), "query_id", _r6("ap").alias("ap"), "query_text", "ground_truth", "expected", "got")


FLAGSHIP = "r5_answer"
