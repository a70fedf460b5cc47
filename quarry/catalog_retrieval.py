"""Registered queries of sparse and hybrid retrieval: BM25, pair re-ranking, document expansion, IDF weights.

All run over fixture T: the passages of ``benchmark`` are the queries, whole ``documents`` the articles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import (_SQL_STRIP, HASH_DIM, ORACLE, SQL_T, _r6, register, sql_compare, sql_eval, sql_hash, sql_stored,
                            sql_topk)
from quarry.functions.text import QUERY_INSTRUCTION, with_prefix
from quarry.functions.vectors import TOKEN_PATTERN
from quarry.operators import infer, rank, rerank, sparse
from quarry.plans import evaluation as EVR
from quarry.plans import expand
from quarry.session import materialize, scratch_path
from quarry.sources import fixtures, tables

#: Buckets of the IDF-weighted encoder, and candidates that the pair model orders.
IDF_DIM, CANDIDATES = 4096, 30


def _texts(spark, sf_dir):
    """Articles and queries of fixture T, without the work for its ground truth."""
    queries = tables.read_table(spark, f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return fixtures.text_articles(spark, sf_dir), queries


def _words(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{TOKEN_PATTERN}')"


def _ranked(name: str, scores: str, k: int = 10) -> str:
    return f"""{name} AS (SELECT query_id, rank, article_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, article_id) AS rank FROM {scores}) WHERE rank <= {k})"""


SQL_TEXTS = """
t_docs AS (SELECT doc_id AS article_id, source || ' #' || doc_id AS title, text AS body FROM documents),
t_queries AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"""

SQL_BM25 = f"""
bm_p AS (SELECT id, t, count(*) AS tf FROM (SELECT article_id AS id, unnest({_words('body')}) AS t FROM t_docs) GROUP BY ALL),
bm_l AS (SELECT id, sum(tf) AS len FROM bm_p GROUP BY id),
bm_g AS (SELECT (SELECT count(*) FROM t_docs) AS n, (SELECT sum(len) FROM bm_l) AS total),
bm_f AS (SELECT t, count(*) AS df FROM bm_p GROUP BY t),
bm_q AS (SELECT query_id, t, count(*) AS tf FROM (SELECT query_id, unnest({_words('query_text')}) AS t FROM t_queries) GROUP BY ALL),
bm_s AS (SELECT q.query_id, p.id AS article_id, sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * 2.2
                / (p.tf + 1.2 * (0.25 + 0.75 * len / (total / n)))) AS score
         FROM bm_q q JOIN bm_f USING (t) JOIN bm_p p USING (t) JOIN bm_l l ON l.id = p.id, bm_g GROUP BY ALL),
{_ranked('bm_top', 'bm_s')}, {_ranked('bm_many', 'bm_s', CANDIDATES)}"""

SQL_PAIRS = f"""
ce_d AS (SELECT article_id, list_distinct({_words('body')}) AS w FROM t_docs),
ce_q AS (SELECT query_id, list_distinct({_words('query_text')}) AS w FROM t_queries),
ce_s AS (SELECT query_id, article_id, CASE WHEN len(d.w) + len(q.w) > 0
                THEN len(list_intersect(q.w, d.w)) / len(list_distinct(list_concat(q.w, d.w)))::DOUBLE ELSE 0.0 END AS score
         FROM bm_many JOIN ce_d d USING (article_id) JOIN ce_q q USING (query_id)),
{_ranked('ce_top', 'ce_s')}"""

_PART = ("substr(coalesce(body, ''), (length(coalesce(body, '')) * j // 3 + 1)::INT, "
         "(length(coalesce(body, '')) * (j + 1) // 3 - length(coalesce(body, '')) * j // 3)::INT)")
SQL_EXPANDED = f"""
x_parts AS (SELECT article_id * 10 + j AS id, article_id, j AS variant, {_SQL_STRIP(_PART)} AS t FROM t_docs, (VALUES (0), (1), (2)) v(j)),
{sql_hash('x_v', 'x_parts', 'id', 't')}, {sql_hash('x_qv', 't_queries', 'query_id', f"'{QUERY_INSTRUCTION}' || query_text")},
{sql_stored('x_vs', 'x_v')}, {sql_stored('x_qs', 'x_qv')},
x_s AS (SELECT q.id AS query_id, v.id // 10 AS article_id, max(list_dot_product(q.e, v.e)) AS score FROM x_qs q, x_vs v GROUP BY ALL),
{_ranked('x_top', 'x_s')}"""


def _sql_idf(name: str, table: str, id_col: str, text: str) -> str:
    return f"""
{name}_c AS (SELECT id, b, count(*) AS c FROM (SELECT {id_col} AS id, unnest(list_transform({_words(text)},
               lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {IDF_DIM})) AS b FROM {table}) GROUP BY ALL)"""


def _sql_weighted(name: str) -> str:
    return f"""
{name} AS (SELECT id, b, c * w / sqrt(sum(c * w * c * w) OVER (PARTITION BY id)) AS v FROM {name}_c JOIN i_w USING (b))"""


SQL_IDF = f"""
{_sql_idf('i_a', 't_docs', 'article_id', 'body')}, {_sql_idf('i_q', 't_queries', 'query_id', 'query_text')},
i_df AS (SELECT b, count(*) AS df FROM i_a_c GROUP BY b),
i_w AS (SELECT b, ln((1 + (SELECT count(*) FROM t_docs)) / (1.0 + coalesce(df, 0))) + 1 AS w FROM range({IDF_DIM}) r(b) LEFT JOIN i_df USING (b)),
{_sql_weighted('i_a')}, {_sql_weighted('i_q')},
i_s AS (SELECT q.id AS query_id, a.id AS article_id, sum(q.v * a.v) AS score FROM i_q q JOIN i_a a USING (b) GROUP BY ALL),
{_ranked('i_top', 'i_s')}"""


def _rankings_out(r):
    return r.select("query_id", F.col("rank").cast("bigint"), "article_id", _r6("score").alias("score"))


@register("r3_clustered_articles", ORACLE["r2_top_k"])
def r3_clustered_articles(spark, sf_dir):
    """R3 over fixture V's articles written in clusters, so that chunks below a query's bar can be skipped."""
    v = fixtures.vector_fixture(spark, sf_dir)
    articles = materialize(rank.cluster_articles(v.article_vectors), "clustered")
    return _rankings_out(rank.block_top_k(articles, v.query_vectors, 10))


@register("r4_bm25", f"WITH {SQL_TEXTS}, {SQL_BM25} SELECT query_id, rank, article_id, round(score, 6) AS score FROM bm_top")
def r4_bm25(spark, sf_dir):
    """BM25 over article bodies as an R4 ranker, by postings in blocks."""
    articles, queries = _texts(spark, sf_dir)
    return _rankings_out(sparse.bm25_ranker("body")(articles, queries, 10))


@register("r4_cross_encoder", f"WITH {SQL_TEXTS}, {SQL_BM25}, {SQL_PAIRS} SELECT query_id, rank, article_id, round(score, 6) AS score FROM ce_top")
def r4_cross_encoder(spark, sf_dir):
    """BM25's candidates ordered by an injected pair model (the stand-in: overlap of distinct words)."""
    articles, queries = _texts(spark, sf_dir)
    ranker = rerank.cross_encoder_ranker(sparse.bm25_ranker("body"), rerank.word_overlap, CANDIDATES)
    return _rankings_out(ranker(articles, queries, 10))


def _expanded(spark, articles, path):
    """Variant vectors of all articles (the stand-in generator), written and read back."""
    variants = expand.expand_articles(articles, infer.last_user_message)
    tables.write_embeddings(infer.hashing_encode(variants, "generated_query", HASH_DIM).select("article_id", "embedding"), path, "article_id")
    return tables.read_embeddings(spark, path, dim=HASH_DIM)


def _query_vectors(spark, queries, path):
    prefixed = queries.select("query_id", with_prefix("query_text").alias("t"))
    tables.write_embeddings(infer.hashing_encode(prefixed, "t", HASH_DIM), path, "query_id")
    return tables.read_embeddings(spark, path, dim=HASH_DIM)


@register("e9_expand_articles", f"WITH {SQL_TEXTS}, {SQL_EXPANDED} SELECT article_id, variant::INT AS variant, t AS generated_query FROM x_parts")
def e9_expand_articles(spark, sf_dir):
    """Three generated queries per article, one for each third of its text (the stand-in generator)."""
    return expand.expand_articles(_texts(spark, sf_dir)[0], infer.last_user_message)


@register("r4_expanded", f"WITH {SQL_TEXTS}, {SQL_EXPANDED} SELECT query_id, rank, article_id, round(score, 6) AS score FROM x_top")
def r4_expanded(spark, sf_dir):
    """Articles ranked by the best of their generated queries' vectors."""
    articles, queries = _texts(spark, sf_dir)
    path = scratch_path(spark, "expanded")
    return _rankings_out(expand.best_variant_ranker(_expanded(spark, articles, f"{path}/a"), _query_vectors(spark, queries, f"{path}/q"), 10))


def _idf_sides(spark, articles, queries):
    weights = sparse.idf_weights(articles, "body", IDF_DIM)
    a = sparse.idf_encode(articles.select("article_id", "body"), "body", weights).select("article_id", "embedding")
    q = sparse.idf_encode(queries, "query_text", weights).select("query_id", "embedding")
    return materialize(a, "idf-articles"), materialize(q, "idf-queries")


@register("idf_encode", f"""WITH {SQL_TEXTS}, {SQL_IDF}
SELECT t_docs.article_id, count(v)::BIGINT AS n_filled, coalesce(round(sum(v), 6), 0.0) AS total, coalesce(round(sum(v * sqrt(b + 1)), 6), 0.0) AS weighted
FROM t_docs LEFT JOIN i_a ON i_a.id = article_id GROUP BY t_docs.article_id""")
def idf_encode(spark, sf_dir):
    """IDF-weighted sparse vectors of all article bodies, as digests of their indices and values."""
    a, _ = _idf_sides(spark, *_texts(spark, sf_dir))
    add = lambda col: F.coalesce(F.round(F.aggregate(col, F.lit(0.0), lambda s, x: s + x), 6), F.lit(0.0))
    weighted = F.zip_with("embedding.indices", "embedding.values", lambda i, v: v * F.sqrt((i + 1).cast("double")))
    return a.select("article_id", F.size("embedding.indices").cast("bigint").alias("n_filled"), add(F.col("embedding.values")).alias("total"),
                    add(weighted).alias("weighted"))


@register("r4_idf", f"""WITH {SQL_TEXTS}, {SQL_IDF}
SELECT query_id, rank, article_id, round(score, 6) AS score, round(score, 6) AS pair_score FROM i_top""")
def r4_idf(spark, sf_dir):
    """IDF vectors ranked through postings, and the ranked pairs scored anew by the sparse dot product."""
    a, q = _idf_sides(spark, *_texts(spark, sf_dir))
    ranked = materialize(sparse.sparse_ranker(a, q, 10), "idf-ranked")
    scored = (ranked.join(q.withColumnRenamed("embedding", "qe"), "query_id").join(a.withColumnRenamed("embedding", "ae"), "article_id")
              .withColumn("pair_score", _r6(sparse.sparse_dot("qe", "ae"))))
    return scored.select("query_id", F.col("rank").cast("bigint"), "article_id", _r6("score").alias("score"), "pair_score")


def _sql_retrieval_suite() -> str:
    parts = [SQL_T, SQL_BM25, SQL_PAIRS, SQL_EXPANDED, SQL_IDF,
             sql_hash("b_v", "t_docs", "article_id", f"'{QUERY_INSTRUCTION}' || body"), sql_stored("b_s", "b_v"), sql_topk("b_top", "x_qs", "b_s")]
    tops = {"body": "b_top", "bm25": "bm_top", "cross_encoder": "ce_top", "expanded": "x_top", "idf_body": "i_top"}
    parts += [sql_eval(f"e_{name}", top, "t_queries", "t_docs") for name, top in tops.items()]
    return ("WITH " + ", ".join(p.strip() for p in parts) + " "
            + sql_compare(" UNION ALL ".join(f"SELECT '{name}' AS method, ap FROM e_{name}_ap" for name in tops)))


@register("v12_retrieval_suite", _sql_retrieval_suite())
def v12_retrieval_suite(spark, sf_dir):
    """V12 over the retrieval methods: dense bodies, BM25, BM25 with re-ranking, expanded articles, IDF vectors."""
    fx = fixtures.text_fixture(spark, sf_dir)
    path = scratch_path(spark, "retrieval-suite")
    queries, articles = materialize(fx.queries, "retrieval-queries"), fx.articles
    qv = _query_vectors(spark, queries, f"{path}/q")
    tables.write_embeddings(infer.hashing_encode(articles.select("article_id", with_prefix("body").alias("t")), "t", HASH_DIM), f"{path}/b", "article_id")
    idf_a, idf_q = _idf_sides(spark, articles, queries)
    texts, asked = articles.select("article_id", "body"), queries.select("query_id", "query_text")
    many = materialize(sparse.bm25_ranker("body")(texts, asked, CANDIDATES), "retrieval-bm25")  # both BM25 methods start from it
    bm25 = lambda a, q, k: many.where(F.col("rank") <= k)
    configs = [EVR.MethodConfig("body", tables.read_embeddings(spark, f"{path}/b", dim=HASH_DIM), qv),
               EVR.MethodConfig("bm25", texts, asked, bm25),
               EVR.MethodConfig("cross_encoder", texts, asked, rerank.cross_encoder_ranker(bm25, rerank.word_overlap, CANDIDATES)),
               EVR.MethodConfig("expanded", _expanded(spark, articles, f"{path}/x"), qv, expand.best_variant_ranker),
               EVR.MethodConfig("idf_body", idf_a, idf_q, sparse.sparse_ranker)]
    out = EVR.run_suite(configs, queries, articles, path)
    return out.select("method", _r6("map").alias("map"), "n_queries", "n_zero", "pct_zero", "n_bucket0", "pct_bucket0")
