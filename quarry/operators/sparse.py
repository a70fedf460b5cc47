"""Sparse retrieval: BM25 over article texts and IDF-weighted hashed vectors, ranked through postings (R4 rankers).

Scoring sums, over the terms that a query and an article share, the product of two weights. It is done as a blocked
sparse matrix product without a row per (query, article) pair:

* postings are lists of (article, weight) per term and block of articles, so that a term in every article has many bounded
  lists, not a long one; the queries' terms are lists per term and block of queries;
* both meet by term. A term with more than ``SPLIT`` lists is salted: its lists are spread over as many keys as that
  takes, and its few query lists are repeated for each;
* the lists of one cell (article block x query block) are added up in a task as small dense matrices, and the cell
  gives its ``k`` best per query. A final window keeps the best of all cells.

Nothing is broadcast there and nothing passes through the driver but counts; cells are bounded whatever the table.

Few queries (within ``FEW_ENTRIES`` and ``FEW_PLACES``) are broadcast as lists per term instead, and the articles stay where they are: a task
adds up the scores of some articles at a time for all queries and keeps each query's ``k`` best, so nothing is shuffled but those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.terms import bucket_texts, known_counts, sparse_weights, term_counts
from quarry.operators.rank import TIE_DECIMALS, Ranker, top_k_pairs
from quarry.session import bounded_batches, materialize

#: Articles and queries in a block; lists of a term from which it is salted.
ARTICLE_BLOCK, QUERY_BLOCK, SPLIT = 4096, 1024, 64
#: Queries of a cell whose best are picked at a time.
QUERY_TILE = 64
#: Entries of the queries' terms, and places for their best, up to which queries are broadcast. Products that a task adds up,
#: cells of their sums, and candidates that it holds at a time.
FEW_ENTRIES, FEW_PLACES, PRODUCTS, CELLS, CANDIDATES = 1_000_000, 1_000_000, 250_000, 1_000_000, 200_000
#: The usual constants of BM25.
K1, B = 1.2, 0.75


class _Axis:
    """Places of ids in the order in which they were first seen."""

    def __init__(self):
        self.ids, self.place, self.order = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []

    def find(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, ids)
        known = at < len(self.ids)
        known[known] = self.ids[at[known]] == ids[known]
        if not known.all():
            new = np.unique(ids[~known])
            place = np.arange(len(self.ids), len(self.ids) + len(new))
            self.order.append(new)
            both, places = np.concatenate([self.ids, new]), np.concatenate([self.place, place])
            by_id = np.argsort(both, kind="stable")
            self.ids, self.place = both[by_id], places[by_id]
            at = np.searchsorted(self.ids, ids)
        return self.place[at]

    def all(self) -> np.ndarray:
        return np.concatenate(self.order)


class _Cell:
    """Scores of one block of queries against one block of articles."""

    def __init__(self):
        self.queries, self.articles, self.score = _Axis(), _Axis(), np.zeros((16, 256))

    def add(self, queries: np.ndarray, query_weights: np.ndarray, articles: np.ndarray, article_weights: np.ndarray) -> None:
        q, a = self.queries.find(queries), self.articles.find(articles)
        need = (len(self.queries.ids), len(self.articles.ids))
        if need[0] > self.score.shape[0] or need[1] > self.score.shape[1]:
            wider = np.zeros(tuple(max(2 * have if want > have else have, want) for have, want in zip(self.score.shape, need)))
            wider[:self.score.shape[0], :self.score.shape[1]] = self.score
            self.score = wider
        self.score[np.ix_(q, a)] += query_weights[:, None] * article_weights[None, :]

    def best(self, k: int) -> Iterator[pa.RecordBatch]:
        queries, articles = self.queries.all(), self.articles.all()
        for q in range(0, len(queries), QUERY_TILE):  # copies of a part of the scores at a time
            some = queries[q:q + QUERY_TILE]
            score = self.score[q:q + len(some), :len(articles)]
            key = np.round(score, TIE_DECIMALS)
            bar = np.full(len(some), 0.0)
            if len(articles) > k:  # ties with the k-th best stay: the window over all cells decides between them
                bar = np.maximum(-np.partition(-key, k - 1, axis=1)[:, k - 1], 0.0)
            r, c = np.nonzero((score > 0) & (key >= bar[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(some[r]), pa.array(articles[c]), pa.array(score[r, c])],
                                             names=["query_id", "article_id", "score"])


def _add_up(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, last = None, None
        for batch in batches:
            keys = list(zip(batch.column("block").to_pylist(), batch.column("query_block").to_pylist()))
            lists = {}
            for name in ("docs", "asked"):
                col = batch.column(name)
                flat = col.flatten()
                ids, weights = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                ends = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))])
                lists[name] = (ids, weights, ends)
            for row, key in enumerate(keys):
                if key != last:
                    if cell is not None:
                        yield from cell.best(k)
                    cell, last = _Cell(), key
                (ai, aw, ae), (qi, qw, qe) = lists["docs"], lists["asked"]
                a, q = slice(ae[row], ae[row + 1]), slice(qe[row], qe[row + 1])
                cell.add(qi[q], qw[q], ai[a], aw[a])
        if cell is not None:
            yield from cell.best(k)
    return run


def _blocks(df: DataFrame, id_col: str, size: int):
    """A block number by a hash of the id, so that blocks have about ``size`` ids each."""
    n = df.agg(F.approx_count_distinct(id_col).alias("n")).first()["n"]
    return F.pmod(F.xxhash64(id_col), F.lit(max(1, math.ceil(n / size)))).cast("int")


def sparse_top_k(article_terms: DataFrame, query_terms: DataFrame, k: int = 10) -> DataFrame:
    """Exact top ``k`` articles per query by the sum, over common terms, of the products of their weights.

    ``article_terms`` (article_id, term, weight) and ``query_terms`` (query_id, term, weight) hold a row per distinct
    term of an id, with positive weights. Order: score rounded to ``TIE_DECIMALS`` descending, then article_id.
    Articles without a common term are not ranked; a query without any gets no row.
    """
    bounded_batches(article_terms.sparkSession)
    asked = query_terms.select("query_id", "term", "weight")
    postings = article_terms.join(asked.select("term").distinct(), "term", "left_semi")
    lists = (postings.groupBy("term", _blocks(article_terms, "article_id", ARTICLE_BLOCK).alias("block"))
             .agg(F.collect_list(F.struct(F.col("article_id"), F.col("weight"))).alias("docs")))
    lists = materialize(lists, "sparse-lists")
    asked = (asked.groupBy("term", _blocks(asked, "query_id", QUERY_BLOCK).alias("query_block"))
             .agg(F.collect_list(F.struct(F.col("query_id"), F.col("weight"))).alias("asked")))
    hot = (lists.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT)
           .select("term", F.ceil(F.col("n") / SPLIT).cast("int").alias("salts")))
    lists = lists.join(hot, "term", "left").withColumn("salt", F.pmod("block", F.coalesce("salts", F.lit(1)))).drop("salts")
    asked = (asked.join(hot, "term", "left")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts"))
    cells = lists.join(asked, ["term", "salt"]).select("block", "query_block", "term", "docs", "asked")
    cells = cells.repartition("block", "query_block").sortWithinPartitions("block", "query_block", "term")
    found = cells.select("block", "query_block", "docs", "asked").mapInArrow(_add_up(k), "query_id bigint, article_id bigint, score double")
    return top_k_pairs(found, k)


# ---------------------------------------------------------------- few queries

class _Queries:
    """Queries as lists per term: ``ids``; ``terms`` (ascending); of the term at place p, the queries (places in ``ids``) and
    weights from ``start[p]`` to ``start[p + 1]``. A term that a query has twice counts once."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.ids, q = np.unique(query, return_inverse=True)
        self.terms, p = np.unique(term, return_inverse=True)
        cell, first = np.unique(p.astype(np.int64) * max(len(self.ids), 1) + q, return_index=True)
        self.query, self.weight = q[first].astype(np.int64), weight[first].astype(np.float64)
        self.start = np.searchsorted(cell, np.arange(len(self.terms) + 1, dtype=np.int64) * max(len(self.ids), 1))


class _BestOf:
    """The k best articles of each query so far, each article once: highest score, rounded, then smallest id."""

    def __init__(self, nq: int, k: int):
        self.k, self.bar, self.held, self.more, self.size = k, np.full(nq, -np.inf), [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)], [], 0

    def add(self, query: np.ndarray, score: np.ndarray, article: np.ndarray) -> None:
        near = score >= self.bar[query] - 10.0 ** -TIE_DECIMALS
        if near.any():
            self.more.append([query[near], score[near], article[near]])
            self.size += int(near.sum())
            if self.size > CANDIDATES or np.isneginf(self.bar).any():
                self.settle()

    def settle(self) -> None:
        query, score, article = (np.concatenate(x) for x in zip(self.held, *self.more))
        key = np.round(score, TIE_DECIMALS)
        order = np.lexsort((-key, article, query))
        once = np.ones(len(order), dtype=bool)
        once[1:] = (query[order][1:] != query[order][:-1]) | (article[order][1:] != article[order][:-1])
        order = order[once]
        order = order[np.lexsort((article[order], -key[order], query[order]))]
        at = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        last = order[at == self.k - 1]
        order = order[at < self.k]
        self.bar[query[last]] = key[last]
        self.held, self.more, self.size = [query[order], score[order], article[order]], [], 0


def _add_up_here(queries, k: int, weights):
    """Batches with id, places and what ``weights`` makes article weights of (batch -> an array) -> each query's best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        nq = len(asked.ids)
        best = _BestOf(nq, k)
        for batch in batches:
            column = batch.column("places")
            place = column.flatten().to_numpy(zero_copy_only=False)
            size = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            weight, ids = weights(batch, size), batch.column("id").to_numpy(zero_copy_only=False)
            lists = asked.start[place + 1] - asked.start[place]
            ends = np.concatenate([[0], np.cumsum(size)])
            total = np.concatenate([[0], np.cumsum(lists)])[ends]
            lo = 0
            while lo < len(ids):  # as many articles at a time as PRODUCTS and CELLS have room for, one at least
                hi = int(np.searchsorted(total, total[lo] + PRODUCTS, side="right")) - 1
                hi = max(lo + 1, min(hi, len(ids), lo + CELLS // max(nq, 1)))
                at = slice(ends[lo], ends[hi])
                n, first = lists[at], asked.start[place[at]]
                entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                article = np.repeat(np.repeat(np.arange(hi - lo), size[lo:hi]), n)
                score = np.bincount(article * nq + asked.query[entry], weights=np.repeat(weight[at], n) * asked.weight[entry],
                                    minlength=(hi - lo) * nq)
                found = np.flatnonzero(score > 0)
                best.add(found % nq, score[found], ids[lo + found // nq])
                lo = hi
        best.settle()
        query, score, article = best.held
        for a in range(0, len(query), 100_000):
            some = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[query[some]]), pa.array(article[some]), pa.array(score[some])],
                                             names=["query_id", "article_id", "score"])
    return run


def _few(asked: DataFrame, k: int) -> bool:
    """Whether the queries (query_id, ..), a row per term, are few enough to be broadcast."""
    n, queries = asked.agg(F.count(F.lit(1)), F.approx_count_distinct("query_id")).first()
    return n <= FEW_ENTRIES and queries * k <= FEW_PLACES


def _best_of_tasks(found: DataFrame, k: int) -> DataFrame:
    return top_k_pairs(found.groupBy("query_id", "article_id").agg(F.max("score").alias("score")), k)


_FOUND = "query_id bigint, article_id bigint, score double"


# ---------------------------------------------------------------- BM25

def bm25_terms(articles: DataFrame, queries: DataFrame, text_col: str = "body", query_col: str = "query_text",
               k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
    """(article_id, term, weight) and (query_id, term, weight) whose products add up to the BM25 score: the saturated,
    length-normed frequency, and the query's frequency times ln(1 + (N - df + 0.5) / (df + 0.5)). N counts all articles."""
    bounded_batches(articles.sparkSession)
    terms = materialize(term_counts(articles, "article_id", text_col), "bm25-terms")
    n = articles.count()
    total = terms.agg(F.sum("tf")).first()[0] or 0
    mean = max(total / n, 1e-9) if n else 1.0
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("length") / F.lit(mean))
    docs = terms.select(F.col("id").alias("article_id"), "term", (F.col("tf") * (k1 + 1.0) / (F.col("tf") + norm)).alias("weight"))
    asked = materialize(term_counts(queries, "query_id", query_col), "bm25-asked")
    df = terms.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return docs, asked.join(df, "term").select(F.col("id").alias("query_id"), "term", (F.col("tf") * idf).alias("weight"))


def bm25_ranker(text_col: str = "body", query_col: str = "query_text", k1: float = K1, b: float = B) -> Ranker:
    """An R4 ranker over tables of texts: articles (article_id, ``text_col``), queries (query_id, ``query_col``).
    Ids are unique. Texts that are null or without words match nothing."""
    def rank(articles: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
        bounded_batches(articles.sparkSession)
        asked = materialize(term_counts(queries, "query_id", query_col).withColumnRenamed("id", "query_id"), "bm25-few")
        if not _few(asked, k):
            return sparse_top_k(*bm25_terms(articles, queries, text_col, query_col, k1, b), k)
        return _bm25_of_few(articles, asked, k, text_col, k1, b)
    return rank


def _bm25_of_few(articles: DataFrame, asked: DataFrame, k: int, text_col: str, k1: float, b: float) -> DataFrame:
    """BM25 for queries (query_id, term, tf) that are broadcast: the texts are read once, for the words that are asked for."""
    spark = articles.sparkSession
    rows = asked.where(F.col("query_id").isNotNull()).select("query_id", "term", "tf").toArrow()
    terms, place = np.unique(np.array(rows.column("term").to_pylist(), dtype=object), return_inverse=True)
    known = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    counts = materialize(known_counts(articles, "article_id", text_col, known), "bm25-counts")
    n, total = counts.agg(F.count(F.lit(1)), F.sum("length")).first()
    mean = max((total or 0) / n, 1e-9) if n else 1.0

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(known.value), dtype=np.int64)
        for batch in batches:
            df += np.bincount(batch.column("places").flatten(), minlength=len(df))
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], names=["place", "df"])

    df = np.zeros(len(terms))
    for row in counts.select("places").mapInArrow(frequencies, "place bigint, df bigint").groupBy("place").agg(F.sum("df")).collect():
        df[row[0]] = row[1]  # at most as many as the queries have terms
    idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
    tf = rows.column("tf").to_numpy().astype(np.float64)
    queries = spark.sparkContext.broadcast(_Queries(rows.column("query_id").to_numpy().astype(np.int64), place, tf * idf[place]))

    def weights(batch: pa.RecordBatch, size: np.ndarray) -> np.ndarray:
        tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        norm = k1 * ((1.0 - b) + b * batch.column("length").to_numpy(zero_copy_only=False) / mean)
        return tf * (k1 + 1.0) / (tf + np.repeat(norm, size))

    held = counts.where(F.col("id").isNotNull())
    return _best_of_tasks(held.mapInArrow(_add_up_here(queries, k, weights), _FOUND), k)


# ---------------------------------------------------------------- IDF-weighted hashed vectors

def idf_weights(df: DataFrame, text_col: str, dim: int) -> np.ndarray:
    """First pass: ln((1 + N) / (1 + df)) + 1 for each of ``dim`` buckets, df the texts with a word in it, N all of them.
    ``dim`` numbers reach the driver, whatever the table."""
    bounded_batches(df.sparkSession)
    counts = bucket_texts(df, text_col, dim).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(dim)
    found[[r["bucket"] for r in counts]] = [r["n"] for r in counts]
    return np.log((1.0 + df.count()) / (1.0 + found)) + 1.0


def idf_encode(df: DataFrame, text_col: str, weights: np.ndarray, out: str = "embedding") -> DataFrame:
    """Second pass: add ``out``, the hashed bag of words weighted by ``weights`` and L2-normalised, as a sparse vector
    (indices ascending, values). A text without words is the empty vector."""
    bounded_batches(df.sparkSession)
    return df.withColumn(out, sparse_weights(text_col, len(weights), weights))


def sparse_dot(a, b):
    """Dot product of two sparse vectors (structs of indices and values): both are laid in one list, sorted by index, and
    neighbours with the same index are multiplied, so it takes the sum of their lengths and not the product."""
    def entries(v):
        v = F.col(v) if isinstance(v, str) else v
        return F.arrays_zip(v["indices"].alias("i"), v["values"].alias("v"))
    start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("v"), F.lit(0.0).alias("total"))
    both = F.array_sort(F.concat(entries(a), entries(b)))
    return F.aggregate(both, start, lambda acc, x: F.struct(
        x["i"].alias("i"), x["v"].alias("v"),
        (acc["total"] + F.when(acc["i"] == x["i"], acc["v"] * x["v"]).otherwise(F.lit(0.0))).alias("total")),
        lambda acc: acc["total"])


def _entries(df: DataFrame, id_col: str, emb_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias(id_col), F.explode(F.arrays_zip(f"{emb_col}.indices", f"{emb_col}.values")).alias("e")).select(
        id_col, F.col("e.indices").alias("term"), F.col("e.values").alias("weight"))


def sparse_ranker(articles: DataFrame, queries: DataFrame, k: int = 10, emb_col: str = "embedding") -> DataFrame:
    """An R4 ranker over sparse vectors: exact top k by dot product among articles with a common bucket."""
    asked = materialize(_entries(queries, "query_id", emb_col), "sparse-few")
    if not _few(asked, k):
        return sparse_top_k(_entries(articles, "article_id", emb_col), asked, k)
    bounded_batches(articles.sparkSession)
    rows = asked.where(F.col("query_id").isNotNull()).toArrow()
    few = _Queries(rows.column("query_id").to_numpy().astype(np.int64), rows.column("term").to_numpy().astype(np.int64),
                   rows.column("weight").to_numpy().astype(np.float64))
    shared = articles.sparkSession.sparkContext.broadcast(few)
    return _best_of_tasks(articles.select(F.col("article_id").cast("bigint").alias("id"), F.col(emb_col).alias("v"))
                          .where(F.col("id").isNotNull()).mapInArrow(_vectors_here(shared, k), _FOUND), k)


def _vectors_here(queries, k: int):
    """As ``_add_up_here``, for sparse vectors (id, v): indices that no query has are left out."""
    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = queries.value.terms
        for batch in batches:
            vectors = batch.column("v")
            lists, values = pc.struct_field(vectors, "indices"), pc.struct_field(vectors, "values")
            size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
            index, value = lists.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
            place = np.searchsorted(terms, index)
            there = place < len(terms)
            there[there] = terms[place[there]] == index[there]
            ends = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(size)])]
            ends = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(place[there].astype(np.int32))),
                                              pa.ListArray.from_arrays(ends, pa.array(value[there]))], names=["id", "places", "weights"])

    add_up = _add_up_here(queries, k, lambda batch, size: batch.column("weights").flatten().to_numpy(zero_copy_only=False))
    return lambda batches: add_up(known(batches))
