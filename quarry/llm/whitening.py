"""Operator 13: principal components and whitening of embeddings by mixed-precision refinement.

Vectors are taken as integers (a fixed-point scale and an offset), so that counts, sums and deviations are exact. Each
distinct vector is fitted once. Spark makes the count and the sums, then the covariance: every task centres its vectors
and adds up their outer products, and tasks meet in a sum per matrix row, so what reaches the driver is one matrix of
width x width numbers, however many vectors there are.

The eigenvectors come from that matrix in two precisions. A float32 decomposition gives approximate vectors X. Each step
of Ogita and Aishima's iteration then forms, in higher precision, the residuals R = I - X'X and S = X'AX, reads the
eigenvalues off their diagonals and corrects X by X E, with E[i, j] = (S[i, j] + e[j] R[i, j]) / (e[j] - e[i]) where the two
eigenvalues are apart, and R[i, j] / 2 where they are not; the error squares with each step. Vectors whose
eigenvalues stay closer than their residuals (a cluster) are only found as a space by that: the matrix, shifted
by the cluster's mean eigenvalue and projected on the space, is decomposed on its own, the vectors are turned accordingly,
and the iteration goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import columns, materialize, read

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
STEPS = 12
#: Rows of a batch that are worked on together.
ROWS = 4096
#: Largest magnitude of a scaled entry (every double below it is an integer or is floored to one exactly).
LIMIT = 2 ** 62


# ---------------------------------------------------------------- eigenvectors

def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of eigenvalues that a chain of gaps of at most ``gap`` connects, of two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined_eigenvectors(a: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, float64: a float32 decomposition
    refined in extended precision."""
    n = len(a)
    wide = np.longdouble
    a = np.asarray(a, dtype=wide)
    scale = abs(a).max() if n else 0.0
    if not scale:
        return np.zeros(n), np.eye(n)
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    eye, turned = np.eye(n, dtype=wide), False
    values = np.zeros(n, dtype=wide)
    for _ in range(steps):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values) * (1 - np.diag(r))
        # both bounds of the iteration: how far S is from diagonal, and X from orthogonal
        delta = 2 * (np.linalg.norm(off.astype(np.float64)) + float(abs(values).max()) * np.linalg.norm(r.astype(np.float64)))
        apart = values[None, :] - values[:, None]
        near = abs(apart) <= delta
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
        x = x + x @ e
        size = float(abs(e).max())
        if size < 1e-18:
            break
        if size < 1e-6 and not turned:
            # spaces are found; vectors inside a cluster are not: solve each space on its own
            for places in _clusters(values, max(delta, 1e-9)):
                turned = True
                space = x[:, places]
                middle = values[places].mean()
                inner = space.T @ (a @ space - middle * space)
                inner = (inner + inner.T) / 2
                most = abs(inner).max()
                if most:
                    x[:, places] = space @ np.linalg.eigh((inner / most).astype(np.float64))[1].astype(wide)
    # last steps of orthogonalisation; eigenvalues as Rayleigh quotients
    for _ in range(3):
        x = x + x @ (eye - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


# ---------------------------------------------------------------- passes over the vectors

def _matrix(batch, name: str, width: int) -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column):
        raise ValueError(f"vectors must all have {width} entries")
    return flat.reshape(len(column), width)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def scaled(table: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(vec_id, x): floor(scale * c) + offset of every entry c, for rows whose vector is neither null nor empty nor holds null
    or non-finite entries."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    rows = columns(table, id_col, vector_col).filter(v.isNotNull() & (F.size(v) > 0) & ~bad)
    big = F.exists(v, lambda c: F.abs(c.cast("double")) * scale >= float(LIMIT))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(offset).cast("long"))
    x = F.when(big, F.raise_error(F.lit("entries too large for long integers")).cast("array<bigint>")).otherwise(x)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Count and exact sums of the fit list."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * width, [0] * width
        for batch in _pieces(batches):
            x = _matrix(batch, "x", width)
            n += len(x)  # in two parts, neither of which can pass 64 bits over a batch
            high = [a + int(b) for a, b in zip(high, (x >> 31).sum(axis=0))]
            low = [a + int(b) for a, b in zip(low, (x & (2 ** 31 - 1)).sum(axis=0))]
        if n:
            sums = [str((h << 31) + l) for h, l in zip(high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(sums), pa.array([n] * width, pa.int64())],
                                             names=["i", "s", "n"])

    parts = fit.mapInArrow(add, "i int, s string, n long")
    got = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (got[0]["n"], [int(r["s"]) for r in got]) if got else (0, [0] * width)


def _products(rows: DataFrame, width: int, centred) -> np.ndarray:
    """Sum of the outer products of ``centred(batch)``, rows of ``width`` numbers, over all rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _pieces(batches):
            z = centred(batch)
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                             names=["i", "row"])

    parts = rows.mapInArrow(add, "i int, row array<double>")
    # a sum per place of a matrix row; the matrix is the only thing that grows, and only with the width
    got = parts.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(width)]).orderBy("i").collect()
    return np.array([[r[f"c{j}"] for j in range(width)] for r in got], dtype=np.float64).reshape(width, width)


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S / n as whole parts and fractions, so that an integer less the mean loses nothing to its size."""
    whole = [s // n for s in sums]
    return np.array(whole, dtype=np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def fit(vectors: DataFrame, width: int, most: int = COMPONENTS) -> dict:
    """What whitening needs, from the distinct vectors of ``vectors`` (column x): n, sums, mean, components, e, trace."""
    distinct = materialize(vectors.select("x").distinct(), "op13-fit")
    n, sums = _sums(distinct, width)
    if not n:
        return {"n": 0}
    whole, part = _mean(n, sums)
    v = _products(distinct, width, lambda batch: (_matrix(batch, "x", width) - whole) - part) / n
    e, components = refined_eigenvectors(v)
    keep = min(most, width)
    return {"n": n, "sums": sums, "whole": whole, "part": part, "trace": float(np.trace(v)), "e": e[:keep],
            "components": components[:, :keep], "floor": max(e[0], 0.0) * width * 2.0 ** -52, "distinct": distinct}


def _project(x: np.ndarray, model: dict) -> np.ndarray:
    """Whitened vectors (nan where a component has no variance)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = np.where(model["e"] > model["floor"], 1.0 / np.sqrt(np.abs(model["e"])), np.nan)
        return (((x - model["whole"]) - model["part"]) @ model["components"]) * unit


def identity_error(model: dict, width: int) -> float:
    """Largest entry of the fit list's whitened covariance minus the identity, over the components that have variance."""
    small = {k: v for k, v in model.items() if k != "distinct"}
    which = np.flatnonzero(model["e"] > model["floor"])
    if not len(which):
        return 0.0

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(which))
        for batch in _pieces(batches):
            total = total + _project(_matrix(batch, "x", width), small)[:, which].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(which)), pa.int32()), pa.array(total)], names=["i", "t"])

    sums = model["distinct"].mapInArrow(totals, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).orderBy("i").collect()
    mean = np.array([r["t"] for r in sums]) / model["n"]
    cov = _products(model["distinct"], len(which),
                    lambda batch: _project(_matrix(batch, "x", width), small)[:, which] - mean) / model["n"]
    return float(np.abs(cov - np.eye(len(which))).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component (from 1), n, deviation, deviation_exact, whitened, explained, identity_error: a row for each usable
    vector and each of the first ``components`` components.

    ``deviation`` is the exact sum over dimensions of (n * x - S)^2, null if it passes 64 bits; ``deviation_exact`` has it with
    up to 38 digits (null beyond).

    Defined cases: null vectors, empty ones and those with null or non-finite entries give no rows; equal vectors are fitted once and
    all get their rows; null and repeated ids pass through; fewer dimensions than ``components`` give fewer rows; a component
    without variance (as all of them, if there is only one distinct vector) has a null ``whitened``, and ``explained`` is null
    if there is no variance at all; vectors of different lengths have no common covariance and are an error, as are
    entries whose scaled value passes 2^62; an empty table gives no rows.
    """
    schema = ("vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, "
              "explained double, identity_error double")
    spark = table.sparkSession
    rows = materialize(scaled(table, id_col, vector_col, scale, offset), "op13-rows")
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return spark.createDataFrame([], schema)
    model = fit(rows, width, components)
    error = identity_error(model, width)
    small = {k: v for k, v in model.items() if k != "distinct"}
    kept, n, trace = len(model["e"]), model["n"], model["trace"]
    explained = [float(e) / trace if trace > 0 else None for e in model["e"]]
    rest = np.array([s - w * n for s, w in zip(model["sums"], model["whole"].tolist())], dtype=object)

    def deviations(x: np.ndarray) -> list[int]:
        z = x - small["whole"]
        high = int(np.abs(z).max(initial=0)) + 1
        if high * high * width < 2 ** 62 and high * n * width < 2 ** 62:
            squares, across = (z * z).sum(axis=1).tolist(), (z @ rest.astype(np.int64)).tolist()
        else:
            wide = z.astype(object)
            squares, across = (wide * wide).sum(axis=1).tolist(), (wide @ rest).tolist()
        own = int((rest * rest).sum())
        return [n * n * s - 2 * n * a + own for s, a in zip(squares, across)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch, "x", width)
            white = _project(x, small)
            dev = [str(d) if d < 10 ** 38 else None for d in deviations(x) for _ in range(kept)]
            flat = white.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept))),
                 pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(dev, pa.string()),
                 pa.array(flat, mask=np.isnan(flat)), pa.array(explained * m, pa.float64())],
                names=["vec_id", "component", "d", "whitened", "explained"])

    out = rows.mapInArrow(emit, "vec_id long, component int, d string, whitened double, explained double")
    exact = F.col("d").cast("decimal(38,0)")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), exact.try_cast("long").alias("deviation"),
                      exact.alias("deviation_exact"), "whitened", "explained", F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
