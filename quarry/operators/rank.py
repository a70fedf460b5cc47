"""Ranking: exact top-k by dot product.

Design
------
All-pairs scoring is never materialised as rows. The size of the query side is checked against a budget
(``quarry.rank.blockBytes``, default 256 MB of float64). Within it, the queries are shipped
to the executors once as a broadcast variable, and every article partition is scored against them with
one GEMM per Arrow chunk (``mapInArrow``). A task keeps only the running top-k per query, so what
leaves a task is ``|queries| x k`` rows however many articles it read. Beyond it nothing is broadcast: articles are dealt
into cells that a task can hold, and every cell is sent the queries, which pass it in blocks, all in one job. A final
``row_number`` window over ``query_id`` picks the global top-k; Catalyst inserts a partial
``WindowGroupLimit`` before that shuffle.

A chunk of articles is first looked at as a ball: its centre, and the radius that holds all of its vectors. No vector in it
scores above ``q . centre + |q| * radius``, so queries whose k-th best lies above that skip the chunk, exactly. On vectors
in no order the balls are wide and little is skipped; ``cluster_articles`` writes like vectors side by side.

Order: score descending, then article_id ascending. Scores are compared after rounding to
``TIE_DECIMALS`` decimals, so BLAS summation order (last-bit noise) can neither split exact ties
nor reorder them; the rounded key travels with each candidate so the task-level and the final
selection agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import dot
from quarry.session import materialize

TIE_DECIMALS = 9
TIE_STEP = 10.0 ** -TIE_DECIMALS
DEFAULT_BLOCK_BYTES = 256 << 20
# Score-matrix cells per GEMM call inside a task (float64 -> 32 MB).
CELLS_PER_CHUNK = 4_000_000
# Queries per GEMM call.
QUERY_TILE = 2048
#: Vectors shorter than this are compared in single precision first; cells are scored one by one if no more than 1 in FEW
#: is left.
ROUGH, FEW = 1e15, 50
#: Article vectors (float64) that a task holds for queries that pass by.
CELL_BYTES = 32 << 20

RANKING_SCHEMA = "query_id BIGINT, rank INT, article_id BIGINT, score DOUBLE"
_PARTIAL_SCHEMA = "query_id BIGINT, article_id BIGINT, score DOUBLE, tie_key DOUBLE"

Ranker = Callable[[DataFrame, DataFrame, int], DataFrame]
"""R4: a ranker maps (articles[article_id, embedding], queries[query_id, embedding], k) to a
rankings table (query_id, rank, article_id, score). Any callable of this shape plugs into
evaluation (quarry.plans.evaluation)."""


class _Best:
    """The k best candidates of each query so far, by (key desc, id asc); unfilled places have key -inf."""

    def __init__(self, nq: int, k: int):
        self.k = k
        self.score = np.full((nq, k), -np.inf)
        self.key = np.full((nq, k), -np.inf)
        self.id = np.full((nq, k), np.iinfo(np.int64).max)

    def add(self, places: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in the scores of some articles (columns, their ids ascending) for the queries at ``places`` (rows).

        Only cells that reach a query's k-th best are looked at any further; after the first articles these are few,
        so a cell costs a comparison. Of those that tie with it only the first k of a row can stay, and none whose id comes
        after that of the k-th best: articles with one score for many of them cost no more than others.
        """
        if not scores.shape[1]:
            return
        bar = self.key[places, -1]
        empty = np.isneginf(bar)
        if empty.any() and scores.shape[1] > self.k:
            bar[empty] = np.round(-np.partition(-scores[empty], self.k - 1, axis=1)[:, self.k - 1], TIE_DECIMALS)
        r, c = np.divmod(np.flatnonzero(scores >= self.floor(places, ids, bar)[:, None]), scores.shape[1])
        self.add_cells(places, r, c, scores[r, c], ids, bar)

    def floor(self, places: np.ndarray, ids: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """What a score of one of the articles has to reach to be looked at: scores are rounded only where they may reach the
        bar, from a little below it, or from above it where ties come too late."""
        size = np.abs(bar)
        floor = np.where(size < 1e290, bar - TIE_STEP - 1e-12 * size, -np.inf)
        late = (self.id[places, -1] < ids[0]) & (size < 1e3)
        floor[late] = bar[late] + 0.25 * TIE_STEP
        return floor

    def add_cells(self, places: np.ndarray, r: np.ndarray, c: np.ndarray, scores: np.ndarray, ids: np.ndarray, bar: np.ndarray) -> None:
        """Take in the scores of some cells (r: of ``places``, ascending; c: of ``ids``, ascending for an r) that hold all
        that reach their query's ``bar``."""
        edge = self.id[places, -1]
        keys, at_bar = np.round(scores, TIE_DECIMALS), bar[r]
        tied = (keys == at_bar) & (ids[c] < edge[r])
        if tied.any():
            so_far = np.cumsum(tied)
            first = np.searchsorted(r, r)
            tied &= so_far - (so_far[first] - tied[first]) <= self.k
        kept = (keys > at_bar) | tied
        r, c, keys, scores = r[kept], c[kept], keys[kept], scores[kept]
        if not len(r):
            return
        touched = np.unique(r)
        at = places[touched]
        owner = np.concatenate([np.repeat(touched, self.k), r])
        score = np.concatenate([self.score[at].ravel(), scores])
        key = np.concatenate([self.key[at].ravel(), keys])
        id_ = np.concatenate([self.id[at].ravel(), ids[c]])
        order = np.lexsort((id_, -key, owner))
        owner = owner[order]
        start = np.searchsorted(owner, touched)
        pick = order[start[:, None] + np.arange(self.k)]  # every touched query has at least k candidates
        self.score[at], self.key[at], self.id[at] = score[pick], key[pick], id_[pick]

    def rows(self, qids: np.ndarray):
        """(query_id, article_id, score, tie_key) of all filled places, in batches."""
        for q in range(0, len(qids), max(1, 200_000 // self.k)):
            some = slice(q, q + max(1, 200_000 // self.k))
            real = ~np.isneginf(self.key[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids[some], real.sum(axis=1))), pa.array(self.id[some][real]),
                 pa.array(self.score[some][real]), pa.array(self.key[some][real])],
                names=["query_id", "article_id", "score", "tie_key"])


class _Chunks:
    """Articles cut into chunks of neighbours, each with the ball that holds its vectors. Ids ascend within a chunk."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, step: int):
        if np.isnan(vectors).any():
            raise ValueError("NaN score: embeddings must not hold NaN")
        self.parts = []
        for s in range(0, len(ids), step):
            by_id = s + np.argsort(ids[s:s + step], kind="stable")
            self.parts.append((ids[by_id], vectors[by_id]))
        self.centres = np.stack([v.mean(axis=0) for _, v in self.parts], axis=1)
        self.radii = np.array([np.sqrt(((v - m) ** 2).sum(axis=1).max()) for (_, v), m in zip(self.parts, self.centres.T)])
        longest = [np.sqrt((v * v).sum(axis=1).max()) for _, v in self.parts]
        self.longest = max(longest, default=0.0)
        # scores in single precision are off by less than this times the query's length
        self.off = [(vectors.shape[1] + 8) * 2.0 ** -23 * x for x in longest]
        self.rough = [v.astype(np.float32) for _, v in self.parts] if self.longest < ROUGH else None

    def score(self, queries: np.ndarray, norms: np.ndarray, best: _Best, first: int = 0, counted=None) -> None:
        """Take the articles into ``best`` for the queries whose places begin at ``first``, a tile of them at a time."""
        for q in range(0, len(queries), QUERY_TILE):
            tile, norm = queries[q:q + QUERY_TILE], norms[q:q + QUERY_TILE, None]
            plain = self.rough is not None and bool((norm < ROUGH).all())  # no infinite values: no product is NaN
            rough = tile.astype(np.float32) if plain else None
            here = slice(first + q, first + q + len(tile))
            # a little more than the bound, for what rounding adds and for ties
            bound = tile @ self.centres + norm * self.radii
            bound += 1e-6 * (1.0 + norm * (self.radii + np.abs(self.centres).max(axis=0)))
            lead = bound.argmax(axis=1)
            for leads in (True, False):  # the chunk that promises most sets a query's bar for the others
                for c, (ids, vectors) in enumerate(self.parts):
                    turn = (lead == c) == leads
                    places = np.flatnonzero(turn & ~(bound[:, c] < best.key[here, -1]))
                    if counted is not None:
                        counted[0].add(int(turn.sum()))
                        counted[1].add(int(turn.sum()) - len(places))
                    if not len(places):
                        continue
                    if plain:
                        places = self._add_roughly(c, tile, rough, norm[:, 0], places, first + q, best)
                    if len(places):
                        block = (tile if len(places) == len(tile) else tile[places]) @ vectors.T
                        if not plain and np.isnan(block).any():
                            raise ValueError("NaN score: embeddings must not hold infinite values")
                        best.add(first + q + places, block, ids)

    def _add_roughly(self, c: int, tile: np.ndarray, rough: np.ndarray, norm: np.ndarray, places: np.ndarray, first: int, best: _Best) -> np.ndarray:
        """Take in chunk ``c`` for the queries that have a bar: scores in single precision tell which cells can reach it, and
        only those are scored exactly. Returns the places of queries that are left, for a product in double precision:
        those without a bar, or all if too many cells are found."""
        ids, vectors = self.parts[c]
        bar = best.key[first + places, -1]
        ready = ~np.isneginf(bar)
        some, bar = places[ready], bar[ready]
        if not len(some):
            return places
        floor = best.floor(first + some, ids, bar) - self.off[c] * norm[some]
        floor = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
        block = (rough if len(some) == len(tile) else rough[some]) @ self.rough[c].T
        found = np.flatnonzero(block >= floor[:, None])
        if len(found) * FEW > block.size:
            return places
        if len(found):
            row, col = np.divmod(found, block.shape[1])
            exact = np.einsum("ij,ij->i", tile[some[row]], vectors[col])
            best.add_cells(first + some, row, col, exact, ids, bar)
        return places[~ready]


def _matrix(vectors: pa.Array, dim: int, side: str) -> np.ndarray:
    lens = pc.list_value_length(vectors)
    if len(vectors) and (vectors.null_count or pc.min(lens).as_py() != dim or pc.max(lens).as_py() != dim):
        raise ValueError(f"{side} vectors must all have the query dimension {dim}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _gathered(batches, id_col: str, emb_col: str, dim: int):
    """Batches put together to (ids, vectors) of CELL_BYTES at most, so that there is more to tell equal vectors among."""
    held, rows = [], 0
    for rb in batches:
        if rb.num_rows:
            held.append((_ids(rb.column(id_col)), _matrix(rb.column(emb_col), dim, "article")))
            rows += rb.num_rows
        if rows * max(dim, 1) * 8 >= CELL_BYTES:
            yield np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
            held, rows = [], 0
    if held:
        yield np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])


def _first_of_equals(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places (ascending) of the articles that can be among the ``k`` best of any query: of articles with one and the same
    vector, which all have the same score, the first ``k`` by id."""
    if len(ids) <= k or not vectors.shape[1]:
        return np.arange(len(ids))
    rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1])))[:, 0]
    group = np.unique(rows, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((ids, group))
    group = group[order]
    start = np.searchsorted(group, group)
    return np.sort(order[np.arange(len(order)) - start < k])


def _without_surplus(k: int, dim: int):
    """Rows (id, v) less those that ``_first_of_equals`` leaves out, CELL_BYTES of them at a time."""
    def run(batches):
        held, rows = [], 0

        def kept():
            table = pa.Table.from_batches(held).combine_chunks()
            if not table.num_rows:
                return
            whole = table.to_batches()[0]
            keep = _first_of_equals(_ids(whole.column("id")), _matrix(whole.column("v"), dim, "article"), k)
            yield whole if len(keep) == whole.num_rows else whole.take(pa.array(keep))

        for rb in batches:
            held.append(rb)
            rows += rb.num_rows
            if rows * max(dim, 1) * 8 >= CELL_BYTES:
                yield from kept()
                held, rows = [], 0
        if held:
            yield from kept()
    return run


def _block_topk(bc, k: int, id_col: str, emb_col: str, counted=None):
    def run(batches):
        qids, qmat = bc.value
        nq, dim = qmat.shape
        step = CELLS_PER_CHUNK // QUERY_TILE
        best, seen = None, 0
        norms = np.sqrt((qmat * qmat).sum(axis=1))
        for ids, amat in _gathered(batches, id_col, emb_col, dim):
            if nq == 0:
                continue
            keep = _first_of_equals(ids, amat, k)
            ids, amat = ids[keep], amat[keep]
            seen += len(ids)
            if best is None or best.k < min(k, seen):  # places are made as articles come, so a large k costs no more than them
                best = _grown(best, nq, min(k, max(seen, 2 * (best.k if best else 0))))
            _Chunks(ids, amat, step).score(qmat, norms, best, counted=counted)
        if best is not None:
            yield from best.rows(qids)
    return run


def _cell_topk(k: int, dim: int, counted=None):
    """Rows (part, id, v) in the order of (part, id), part = 2 * cell for a cell's articles and one more for its queries: the
    articles of a cell are held, the queries go past them."""
    def run(batches):
        cell, held, chunks, last = None, [], None, None
        step = CELLS_PER_CHUNK // QUERY_TILE
        for rb in batches:
            parts = rb.column("part").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                ids, vectors = _ids(rb.column("id").slice(a, b - a)), rb.column("v").slice(a, b - a)
                if parts[a] // 2 != cell:
                    cell, held, chunks, last = parts[a] // 2, [], None, None
                if parts[a] % 2 == 0:
                    held.append((ids, _matrix(vectors, dim, "article")))
                    continue
                tile = _matrix(vectors, dim, "query")
                if np.isnan(tile).any():
                    raise ValueError("query vectors must not hold NaN")
                if (ids[1:] == ids[:-1]).any() or last == ids[0]:
                    raise ValueError("query ids must be unique")
                last = ids[-1]
                if held:
                    own, matrix = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                    keep = _first_of_equals(own, matrix, k)
                    chunks, held = _Chunks(own[keep], matrix[keep], step), []
                if chunks is None:
                    continue
                norms = np.sqrt((tile * tile).sum(axis=1))
                n = sum(len(i) for i, _ in chunks.parts)
                for q in range(0, len(ids), QUERY_TILE):
                    some = slice(q, q + QUERY_TILE)
                    best = _Best(len(ids[some]), min(k, n))
                    chunks.score(tile[some], norms[some], best, counted=counted)
                    yield from best.rows(ids[some])
    return run


def _dealt_top_k(articles: DataFrame, queries: DataFrame, k: int, dim: int, counted=None) -> DataFrame:
    """Candidates of queries that are too many for a broadcast, in one job however many blocks they make.

    The articles are dealt by id into cells that a task can hold, and each cell is sent all queries, which its task scores a
    tile at a time as they come. A cell gives its ``k`` best per query.
    """
    spark = articles.sparkSession
    same = articles.schema["embedding"].dataType == queries.schema["embedding"].dataType
    vector = F.col("embedding") if same else F.col("embedding").cast("array<double>")
    articles = articles.select(F.col("article_id").alias("id"), vector.alias("v"))
    articles = materialize(articles.mapInArrow(_without_surplus(k, dim), articles.schema), "top-k-articles")
    n = articles.count()
    cells = max(1, math.ceil(n * max(dim, 1) * 8 / CELL_BYTES),
                min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / (CELLS_PER_CHUNK // QUERY_TILE))))
    own = articles.select((F.pmod(F.xxhash64("id"), F.lit(cells)) * 2).cast("int").alias("part"), "id", "v")
    each = queries.select(F.explode(F.sequence(F.lit(1), F.lit(2 * cells - 1), F.lit(2))).alias("part"),
                          F.col("query_id").cast("bigint").alias("id"), vector.alias("v"))
    rows = own.unionByName(each).repartitionById(cells, F.expr("part div 2").cast("int")).sortWithinPartitions("part", "id")
    return rows.mapInArrow(_cell_topk(k, dim, counted), _PARTIAL_SCHEMA)


def _grown(best: _Best | None, nq: int, k: int) -> _Best:
    out = _Best(nq, k)
    if best is not None:
        for name in ("score", "key", "id"):
            getattr(out, name)[:, :best.k] = getattr(best, name)
    return out


def _query_size(queries: DataFrame, k: int) -> tuple[int, int, int]:
    """(rows, vector dimension, bytes) of the query side.

    One aggregate gives the row count and the vector dimension (min = max is checked when the vectors
    are read). No filter on the vector column: Catalyst would push it below the projections and
    inline the vector expression into it.
    """
    row = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n, dim = int(row["n"]), int(row["d"] or 0)
    # a query holds its vector and k (score, key, id) places
    return n, dim, n * (max(dim, 1) + 3 * min(k, 1000)) * 8


def _to_matrix(block: DataFrame, id_col: str, emb_col: str, dim: int):
    table = block.select(F.col(id_col).cast("bigint").alias("id"),
                         F.col(emb_col).cast("array<double>").alias("v")).toArrow()
    ids = table.column("id").to_numpy().astype(np.int64)
    mat = _matrix(table.column("v").combine_chunks(), dim, "query")
    if np.isnan(mat).any():
        raise ValueError("query vectors must not hold NaN")
    if len(np.unique(ids)) != len(ids):
        raise ValueError("query ids must be unique")
    return ids, mat


def block_top_k(articles: DataFrame, queries: DataFrame, k: int = 10, *, article_id: str = "article_id",
                query_id: str = "query_id", emb_col: str = "embedding", block_bytes: int | None = None,
                max_tasks: int | None = None, counted=None) -> DataFrame:
    """R1+R2+R3: exact top-k articles per query by dot product.

    Returns (query_id, rank, article_id, score); k > number of articles returns all of them.

    Every GEMM task emits |query block| x k candidates however much of the corpus it read, so the
    shuffle before the final top-k scales with the number of tasks. ``max_tasks`` (or the session
    setting ``quarry.rank.maxTasks``) merges input splits without a shuffle (``coalesce``) so that one
    task keeps one running top-k across many splits; leave it unset while splits are already large. ``counted``, two
    accumulators, learns how many (query, chunk) pairs there were and how many were skipped.
    """
    spark = articles.sparkSession
    if block_bytes is None:
        block_bytes = int(spark.conf.get("quarry.rank.blockBytes", str(DEFAULT_BLOCK_BYTES)))
    if max_tasks is None:
        conf = spark.conf.get("quarry.rank.maxTasks", None)
        max_tasks = int(conf) if conf else None
    arts = articles.select(F.col(article_id).cast("bigint").alias("article_id"),
                           F.col(emb_col).alias("embedding"))
    if max_tasks:
        arts = arts.coalesce(max_tasks)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(emb_col).alias("embedding"))
    n, dim, size = _query_size(asked, k)
    if n == 0:
        return spark.createDataFrame([], RANKING_SCHEMA)
    if size <= block_bytes:
        bc = spark.sparkContext.broadcast(_to_matrix(asked, "query_id", "embedding", dim))
        cand = arts.mapInArrow(_block_topk(bc, k, "article_id", "embedding", counted), _PARTIAL_SCHEMA)
    else:
        cand = _dealt_top_k(arts, asked, k, dim, counted)
    w = Window.partitionBy("query_id").orderBy(F.col("tie_key").desc(), F.col("article_id").asc())
    ranked = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = ranked.select("query_id", F.col("rank").cast("int"), "article_id", "score")
    return out.withColumnRenamed("query_id", query_id) if query_id != "query_id" else out


#: Sampled vectors that name the groups of ``cluster_articles``, at most.
PIVOTS = 1024


def cluster_articles(articles: DataFrame, pivots: int = 64, id_col: str = "article_id", emb_col: str = "embedding") -> DataFrame:
    """The articles in an order in which like vectors stand side by side: by the nearest of ``pivots`` sampled vectors (those
    first by a hash of their ids), which is a range partitioning. Written so, chunks of the ranker have small balls."""
    pivots = min(pivots, PIVOTS)
    sample = articles.select(F.col(emb_col).cast("array<double>").alias("v"), F.xxhash64(id_col).alias("h")).orderBy("h").limit(pivots)
    centres = np.array([r["v"] for r in sample.collect()], dtype=np.float64)  # bounded: PIVOTS vectors
    if not len(centres):
        return articles
    # like pivots get neighbouring numbers: each is followed by the nearest of those left
    square = (centres ** 2).sum(axis=1)
    apart = square[:, None] + square[None, :] - 2.0 * (centres @ centres.T)
    chain, left = [0], set(range(1, len(centres)))
    while left:
        chain.append(min(left, key=lambda j: apart[chain[-1], j]))
        left.remove(chain[-1])
    centres = centres[chain]
    half = square[chain] / 2

    def nearest(vectors: pa.Array) -> pa.Array:
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        return pa.array((matrix @ centres.T - half).argmax(axis=1).astype(np.int32)) if len(vectors) else pa.array([], pa.int32())

    group = F.arrow_udf(nearest, "int")(F.col(emb_col))
    order = ["_group", "_spread"]  # a large group is spread over several partitions
    grouped = articles.withColumn("_group", group).withColumn("_spread", F.xxhash64(id_col))
    return grouped.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)


def top_k_pairs(scored: DataFrame, k: int = 10) -> DataFrame:
    """R2 over an explicit table of scored pairs (query_id, article_id, score).

    For candidate sets that are already pairs (e.g. a re-ranking stage); the per-query window keeps k
    rows with a partial limit before the shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.round("score", TIE_DECIMALS).desc(), F.col("article_id").asc())
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "article_id", F.col("score").cast("double")))


def score_pairs(pairs: DataFrame, queries: DataFrame, articles: DataFrame, emb_col: str = "embedding") -> DataFrame:
    """R1 for given (query_id, article_id) pairs: joins both vectors by key and takes the dot product."""
    q = queries.select("query_id", F.col(emb_col).alias("_qv"))
    a = articles.select("article_id", F.col(emb_col).alias("_av"))
    return (pairs.join(q, "query_id").join(a, "article_id")
            .select("query_id", "article_id", dot("_qv", "_av").alias("score")))


def dense_ranker(articles: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The default R4 ranker: exact dot-product top-k."""
    return block_top_k(articles, queries, k)


def to_answer(rankings: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, answer) with article ids in rank order joined by spaces.

    Rankings come out of the top-k window partitioned by query_id, so this aggregate adds no shuffle.
    With ``queries`` given, queries without any ranked article get an empty answer.
    """
    ans = rankings.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_id"))),
                                 lambda x: x["article_id"].cast("string")), " ").alias("answer"))
    if queries is None:
        return ans
    return (queries.select("query_id").join(ans, "query_id", "left")
            .select("query_id", F.coalesce("answer", F.lit("")).alias("answer")))


ANSWER_CHECKS = ("missing_query", "unknown_query", "duplicate_query", "too_many_ids", "repeated_ids",
                 "unknown_article")


def check_answer(answer: DataFrame, queries: DataFrame, articles: DataFrame, k: int = 10) -> DataFrame:
    """One row per (query_id, violation) for every breach of the answer contract.

    Checks: every query answered, no unknown query, one row per query, at most k ids, no repeated ids,
    every id an existing article.
    """
    ids = F.filter(F.split(F.coalesce("answer", F.lit("")), " "), lambda t: t != "")
    # one row per answered id (or one for an answer without ids), each with its answer's own flags
    a = answer.select("query_id", ids.alias("ids")).select(
        "query_id", (F.size("ids") > k).alias("too_many"), (F.size(F.array_distinct("ids")) < F.size("ids")).alias("repeated"),
        F.posexplode_outer("ids").alias("pos", "tok"))
    known = articles.select(F.col("article_id").cast("bigint").alias("_known")).distinct()
    a = a.join(known, F.col("tok").try_cast("bigint") == F.col("_known"), "left")
    per_query = a.groupBy(F.col("query_id").alias("_answered")).agg(
        F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("n"), F.max("too_many").alias("too_many"),
        F.max("repeated").alias("repeated"), F.max(F.col("tok").isNotNull() & F.col("_known").isNull()).alias("unknown"))
    q = queries.select("query_id").distinct()
    both = q.join(per_query, F.col("query_id") == F.col("_answered"), "full")
    found = [(F.col("_answered").isNull(), "missing_query"), (F.col("query_id").isNull(), "unknown_query"),
             (F.col("n") > 1, "duplicate_query"), (F.col("too_many"), "too_many_ids"), (F.col("repeated"), "repeated_ids"),
             (F.col("unknown"), "unknown_article")]
    names = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in found]), lambda v: v.isNotNull())
    return both.select(F.coalesce("query_id", "_answered").alias("query_id"), F.explode(names).alias("violation"))


def answer_check_summary(violations: DataFrame) -> DataFrame:
    """Number of breaching queries per check, zeros included."""
    spark = violations.sparkSession
    checks = spark.createDataFrame([(c,) for c in ANSWER_CHECKS], "violation STRING")
    counts = violations.groupBy("violation").agg(F.countDistinct("query_id").alias("n_queries"))
    return (checks.join(counts, "violation", "left")
            .select("violation", F.coalesce("n_queries", F.lit(0)).cast("bigint").alias("n_queries")))
