"""Operator 4: approximate nearest neighbours by cross-polytope hashing, multiprobe and exact reranking.

A table rotates the unit vector pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and
names the nearest signed axis. A query ranks all signed axes of all tables by how far it points along them and probes
the best of them; whatever any probed bucket holds is a candidate, and candidates are ranked by their exact
distance. The index (vector and one code per table, for every row) is written once and stays where it is: bounded
blocks of queries with their probes go to the index, and each task returns its best per query.

How many buckets must be probed depends on the width and on the data, so it is measured: some queries are answered
exactly first, and the probes reach as far as the wanted share of their true neighbours lies. A query whose buckets
hold fewer than k rows is answered exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, columns, materialize, ordered_totals, read

TABLES = 32
#: Least share of all tables' buckets that a query probes (96 of 64-dimensional vectors).
PROBE_SHARE = 3 / 128
#: Share of the nearest rows that the probes are to find, and the queries answered exactly to measure it.
RECALL = 0.95
SAMPLE = 64
#: Queries in one broadcast block (2 MB of 64-dimensional vectors); fewer of them where there are more buckets.
BLOCK = 4096
BLOCK_BUCKETS = 1 << 25
SEED = 11


def signs(dim: int, tables: int, seed: int = SEED) -> np.ndarray:
    """tables x 3 x width random signs, the width being the next power of two."""
    width = 1 << max(0, dim - 1).bit_length()
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, width))


def rotate(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Three rounds of signs and Hadamard transform of each row, padded with zeros to the width of ``flips``."""
    width = flips.shape[1]
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = x
    for s in flips:
        y = y * s
        h = 1
        while h < width:
            pair = y.reshape(len(x), -1, 2, h)
            y = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), width)
            h *= 2
        y /= np.sqrt(width)
    return y


def codes(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Per row and table the nearest signed axis: axis, or axis + width where it points the other way."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.empty((len(x), len(flips)), dtype=np.uint16)
    for t, f in enumerate(flips):
        y = rotate(unit, f)
        axis = np.abs(y).argmax(axis=1)
        out[:, t] = axis + np.where(y[np.arange(len(y)), axis] < 0, y.shape[1], 0)
    return out


def probes(x: np.ndarray, flips: np.ndarray, count: int) -> np.ndarray:
    """Per row the ``count`` buckets (table * 2 * width + code) of all tables that it points to most."""
    count = min(count, buckets(x.shape[1], len(flips)))
    out = np.empty((len(x), count), dtype=np.int32)
    for lo in range(0, len(x), 64):  # bounds what wide vectors take
        out[lo:lo + 64] = np.argpartition(-_along(x[lo:lo + 64], flips), count - 1, axis=1)[:, :count]
    return out


def buckets(dim: int, tables: int) -> int:
    """Buckets of all tables."""
    return tables * 2 * (1 << max(0, dim - 1).bit_length())


def _along(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """How far each row points along the axis of every bucket."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([np.concatenate([y, -y], axis=1) for y in (rotate(unit, f) for f in flips)], axis=1)


def places(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Per row the place of every bucket in the order in which it is probed."""
    order = np.argsort(-_along(x, flips), axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.int32)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int32)[None, :], axis=1)
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: a non-null id, a vector of the table's most common length, all
    components finite numbers, not all zero."""
    v = columns(vectors, id_col, vec_col).select(F.col(id_col).cast("long").alias("vec_id"),
                                                 F.col(vec_col).cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    v = v.filter(F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda x: x != 0.0))
    common = F.broadcast(v.groupBy(F.size("embedding").alias("_d")).count().orderBy(F.desc("count"), "_d").limit(1))
    return v.join(common, F.size("embedding") == F.col("_d")).select("vec_id", "embedding")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = TABLES, probe: int | None = None, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest rows by Euclidean distance that the probes find for every row with ``is_query``, never a
    row with the query's own id: query_id, rank, vec_id, score.

    ``probe`` buckets are probed; without it, as many as find the share ``recall`` of the true neighbours of a
    sample of the queries. Every query gets ``k`` rows, or all other rows where there are fewer.

    Defined cases: vectors that are null, zero, of another length than most, or hold a null or a value that isn't
    finite take no part, nor do null ids; ties go to the smaller id; rows that repeat an id are rows of their
    own (a repeated query id is answered once per row); an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, rows=10_000)
    base = usable(vectors, id_col, vec_col)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding"))
            flips = signs(x.shape[1], tables) if flips is None else flips
            c = codes(x, flips)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"),
                                              pa.array([r.tobytes() for r in c], pa.binary())],
                                             names=["vec_id", "embedding", "codes"])

    index = materialize(base.mapInArrow(hash_rows, "vec_id long, embedding array<double>, codes binary"), "op4-index")
    asked = ordered_totals(index.filter(is_query).select("vec_id", "embedding"), ["vec_id"], [], name="op4-queries")
    asked = materialize(asked.select("vec_id", "embedding", "_row"), "op4-asked")
    found, total = None, asked.count()
    if total and probe is None:
        probe = _probe_count(index, asked, total, k, tables, recall)
    if total:
        block = min(block, max(1, BLOCK_BUCKETS // buckets(len(asked.first()["embedding"]), tables)))
    for lo in range(0, total, block):
        part = asked.filter((F.col("_row") >= lo) & (F.col("_row") < lo + block)).toArrow()
        q = _matrix(part.column("embedding").combine_chunks())
        own, row = part.column("vec_id").to_numpy(), part.column("_row").to_numpy()
        shared = spark.sparkContext.broadcast((q, own, row, probes(q, signs(q.shape[1], tables), probe)))
        best = materialize(_search(index, shared, k), "op4-found")
        shared.destroy()
        # every task returns up to k rows a query: fewer in all means that the probed buckets hold no more
        full = set(best.groupBy("_q").count().filter(F.col("count") >= k).toArrow().column("_q").to_pylist())
        short = np.array([r not in full for r in row.tolist()])
        if short.any():
            shared = spark.sparkContext.broadcast((q[short], own[short], row[short], None))
            exact = materialize(_search(index, shared, k), "op4-exact")
            shared.destroy()
            best = best.filter(~F.col("_q").isin(row[short].tolist())).union(exact)
        found = best if found is None else found.union(best)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("_q").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _probe_count(index: DataFrame, asked: DataFrame, total: int, k: int, tables: int, recall: float) -> int:
    """How many buckets a query has to probe: the place, in its order, of the first bucket that holds a true neighbour, at
    the share ``recall`` of the neighbours of evenly spaced queries; never less than PROBE_SHARE of the buckets."""
    part = asked.filter(F.col("_row") % -(-total // SAMPLE) == 0).toArrow()
    q = _matrix(part.column("embedding").combine_chunks())
    shared = index.sparkSession.sparkContext.broadcast(
        (q, part.column("vec_id").to_numpy(), part.column("_row").to_numpy(), None, places(q, signs(q.shape[1], tables))))
    order = Window.partitionBy("_q").orderBy("score", "vec_id")
    nearest_ = _search(index, shared, k, placed=True).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    at = np.sort(nearest_.select("place").toArrow().column("place").to_numpy())
    shared.destroy()
    least = int(np.ceil(PROBE_SHARE * buckets(q.shape[1], tables)))
    return max(least, int(at[max(0, int(np.ceil(recall * len(at))) - 1)]) + 1) if len(at) else least


def _search(index: DataFrame, shared, k: int, placed: bool = False) -> DataFrame:
    """Each task's best rows among those in the probed buckets, or among all rows where no probes are given; if
    ``placed``, also the place of the first of a row's buckets in the query's order."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own, row, probe, *order = shared.value
        best_d = np.full((len(q), k), np.inf)
        best_place = np.zeros((len(q), k), dtype=np.int32)
        best_id = np.full((len(q), k), np.iinfo(np.int64).max)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy(zero_copy_only=False)
            width = 2 * (1 << max(0, x.shape[1] - 1).bit_length())
            c = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint16).reshape(len(ids), -1)
            held = c + np.arange(c.shape[1]) * width
            bucket = held.ravel()
            rows = np.argsort(bucket, kind="stable")  # the buckets of this batch, one after another
            starts = np.searchsorted(bucket[rows], np.arange(c.shape[1] * width + 1))
            rows //= c.shape[1]
            for i in range(len(q)):
                hit = np.full(len(ids), probe is None)
                if probe is not None:  # the rows of all probed buckets, as one list of places
                    begin, n = starts[probe[i]], starts[probe[i] + 1] - starts[probe[i]]
                    hit[rows[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
                hit &= ids != own[i]
                at = np.flatnonzero(hit)
                d = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                if len(d) > k:  # all that are no farther than the k-th, ties included
                    close = d <= np.partition(d, k - 1)[k - 1]
                    at, d = at[close], d[close]
                d, n = np.concatenate([best_d[i], d]), np.concatenate([best_id[i], ids[at]])
                first = np.lexsort((n, d))[:k]
                best_d[i], best_id[i] = d[first], n[first]
                if placed:
                    place = order[0][i][held[at]].min(axis=1) if len(at) else np.zeros(0, dtype=np.int32)
                    best_place[i] = np.concatenate([best_place[i], place])[first]
        real = np.isfinite(best_d)
        which = np.repeat(np.arange(len(q)), real.sum(axis=1))
        for lo in range(0, len(which), 50_000):
            w = slice(lo, lo + 50_000)
            out = [pa.array(row[which[w]]), pa.array(own[which[w]]), pa.array(best_id[real][w]), pa.array(best_d[real][w])]
            yield pa.RecordBatch.from_arrays(out + [pa.array(best_place[real][w])] * placed, names=names)

    names = ["_q", "query_id", "vec_id", "score"] + ["place"] * placed
    return index.mapInArrow(search, "_q long, query_id long, vec_id long, score double" + ", place int" * placed)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
