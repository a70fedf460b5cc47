"""Operator 5: document quality from a linear-chain conditional random field over lines.

Every line gets a good/bad marginal by forward-backward; a document's score is the mean of its lines' marginals,
weighted by their lengths. A line is described by shares of byte classes, word statistics and the same figures of
the lines before and after it. The field is fitted on the driver to a bounded sample of labelled documents, each
line carrying its document's label; scoring is a map over partitions and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, columns, read, string_column

#: The training sample: labelled documents, the first in the order of a hash of their ids, none longer than this.
SAMPLE_DOCS = 3000
SAMPLE_BYTES = 50_000
STEPS = 150
THRESHOLD = 0.7
SEED = 5

# byte classes: 0 other, 1 lower case or beyond ASCII, 2 upper case, 3 digit, 4 white space, 5 punctuation, 6 symbol, 7 "|", 8 "!"
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[128:] = 1
for _chars, _c in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3),
                   (b" \t\r\x0b\x0c", 4), (b".,;:?'\"()-", 5), (b"#$%&*@^~=+<>{}[]\\/_`", 6), (b"|", 7), (b"!", 8)):
    _CLASS[list(_chars)] = _c
_N_CLASSES = 9
#: Words over which distinct words are counted, so that a long line is not held against its length.
_SPAN = 50


def _variety(line: str) -> tuple[float, int]:
    words = line.split()
    n = len(words)
    if n <= _SPAN:
        return (len(set(words)) / n if n else 1.0), n
    return sum(len(set(words[k:k + _SPAN])) for k in range(0, n, _SPAN)) / n, n


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, bytes per line, and lines per text (an empty text has one)."""
    lines = [t.split("\n") for t in texts]
    per_text = np.array([len(x) for x in lines], dtype=np.int64)
    flat = [x for own in lines for x in own]
    data = np.frombuffer("\n".join(flat).encode("utf-8", "surrogatepass") + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    size = np.diff(ends, prepend=-1) - 1
    line = np.repeat(np.arange(len(flat)), size + 1)
    counts = np.bincount(line * _N_CLASSES + _CLASS[data], minlength=len(flat) * _N_CLASSES).reshape(-1, _N_CLASSES)
    counts[:, 0] -= 1  # the line's own end
    per = np.maximum(size, 1)[:, None]
    share = counts / per
    words = np.array([_variety(x) for x in flat]).reshape(-1, 2)
    letters = counts[:, 1] + counts[:, 2]
    again = np.zeros(len(flat))
    k = 0
    for own in lines:
        if len(own) > 1:
            seen: set[str] = set()
            for x in own:
                again[k] = x in seen
                seen.add(x)
                k += 1
        else:
            k += 1
    own = np.stack([np.tanh(10 * share[:, 6]), np.tanh(20 * share[:, 7]), np.tanh(15 * share[:, 8]),
                    np.tanh(3 * counts[:, 2] / np.maximum(letters, 1)), np.tanh(5 * share[:, 3]), words[:, 0],
                    np.tanh((size - counts[:, 4]) / np.maximum(words[:, 1], 1) / 8.0)], axis=1)
    first = np.zeros(len(flat), dtype=bool)
    first[np.cumsum(per_text) - per_text] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = own[first], own[last]
    more = np.stack([np.log1p(size) / 8.0, again, share[:, 5], share[:, 0], (words[:, 1] == 0), first, last], axis=1)
    return np.concatenate([own, before, after, more, np.ones((len(flat), 1))], axis=1), size, per_text


@dataclass
class LineField:
    """Weights of the good state against the bad one, transition scores, and the features' scale."""
    weights: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def marginals(self, features: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return _forward_backward(((features - self.mean) / self.scale) @ self.weights, self.trans, per_text)[0]


def _padded(per_text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, lines as texts x longest, -1 beyond a text's end) for texts of like length together."""
    starts = np.cumsum(per_text) - per_text
    order = np.argsort(per_text, kind="stable")
    k = 0
    while k < len(order):
        longest = max(8, 2 * per_text[order[k]])
        j = k + np.searchsorted(per_text[order[k:]], longest, side="right")
        own = order[k:j]
        grid = starts[own][:, None] + np.arange(per_text[own].max())
        grid[np.arange(grid.shape[1]) >= per_text[own][:, None]] = -1
        yield own, grid
        k = j


def _forward_backward(unary: np.ndarray, trans: np.ndarray, per_text: np.ndarray, pairs: bool = False):
    """Marginals of the good state per line; if asked for, the expected transitions as well."""
    good = np.empty(len(unary))
    expected = np.zeros((2, 2))
    for own, grid in _padded(per_text):
        real = grid >= 0
        score = np.zeros((*grid.shape, 2))
        score[..., 1] = np.where(real, unary[np.maximum(grid, 0)], 0.0)
        emit = np.exp(score - score.max(axis=2, keepdims=True))
        move = np.exp(trans - trans.max())
        width = grid.shape[1]
        alpha, beta = np.empty_like(emit), np.ones_like(emit)
        a = emit[:, 0]
        alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, width):
            a = (alpha[:, t - 1] @ move) * emit[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        for t in range(width - 2, -1, -1):
            b = (beta[:, t + 1] * emit[:, t + 1]) @ move.T
            beta[:, t] = np.where(real[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        good[grid[real]] = post[..., 1][real]
        if pairs and width > 1:
            joint = alpha[:, :-1, :, None] * move * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
            joint /= joint.sum(axis=(2, 3), keepdims=True)
            expected += joint[real[:, 1:]].sum(axis=0)
    return good, expected


def fit(features: np.ndarray, per_text: np.ndarray, labels: np.ndarray, steps: int = STEPS, ridge: float = 1e-3) -> LineField:
    """Maximum conditional likelihood by Adam; each document weighs the same in the gradient."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    mean[-1], scale = 0.0, np.where(scale > 1e-9, scale, 1.0)
    x = (features - mean) / scale
    y = np.repeat(labels, per_text).astype(float)
    seen = np.zeros((2, 2))
    for c in (0, 1):
        seen[c, c] = (per_text[labels == c] - 1).sum()
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        p, expected = _forward_backward(x @ w, trans, per_text, pairs=True)
        g = np.concatenate([x.T @ (y - p), (seen - expected).ravel()]) / len(y) - ridge * np.concatenate([w, trans.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    return LineField(w, trans, mean, scale)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, max_bytes: int = SAMPLE_BYTES) -> LineField | None:
    """Fit to at most ``most`` labelled documents, labels as frequent as in the table; None when the sample lacks a label."""
    known = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~F.coalesce(held_out("doc_id"), F.lit(False)))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")))
    # at most `most` rows, so both the broadcast and what the driver gathers are bounded
    sample = F.broadcast(known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most))
    texts = (columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes).join(sample, "doc_id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, per = line_features(string_column(batch, "text"))
            cuts = np.cumsum(per)[:-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"),
                 pa.array([p.astype("<f4").tobytes() for p in np.split(x, cuts)], pa.binary()), pa.array(per)],
                names=["doc_id", "quality", "x", "lines"])

    rows = texts.select("doc_id", "quality", "text").mapInArrow(features, "doc_id long, quality int, x binary, lines long")
    rows = rows.orderBy("doc_id", "x").limit(most).toArrow()
    y = rows.column("quality").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    per = rows.column("lines").to_numpy()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype="<f4").astype(float).reshape(int(per.sum()), -1)
    return fit(x, per, y)


def document_scores(texts: list[str], field: LineField | None) -> np.ndarray:
    """Mean of the good marginals of each text's lines, weighted by their bytes (and one for the line's end)."""
    if field is None:
        return np.full(len(texts), 0.5)
    x, size, per = line_features(texts)
    weight, at = size + 1.0, np.cumsum(per) - per
    return (np.add.reduceat(field.marginals(x, per) * weight, at) / np.add.reduceat(weight, at)).clip(0.0, 1.0)


def score(docs: DataFrame, field: LineField | None, threshold: float = THRESHOLD, id_col: str = "doc_id",
          text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """doc_id, score, predicted (and the columns named by ``keep``) for every row.

    Defined cases: null and empty texts are one empty line; null and repeated ids are scored row by row; without a
    field (no labels) every score is 0.5; ties cannot arise, as a row's score depends on its text alone; an
    empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in keep if c not in (id_col,)]
    src = columns(docs, *dict.fromkeys([id_col, text_col, *keep]))
    src = src.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_k_{c}") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 200):
                batch = big.slice(k, 200)
                scores = document_scores(string_column(batch, "_text"), field)
                columns_out = [batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns_out + [batch.column(f"_k_{c}") for c in keep],
                                                 names=["doc_id", "score", "predicted", *keep])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = [f"doc_id {kinds[id_col]}", "score double", "predicted int", *[f"`{c}` {kinds[c]}" for c in keep]]
    chosen = ["doc_id", "_text", *[f"_k_{c}" for c in keep]]
    return src.select(*chosen).mapInArrow(run, ", ".join(out))


def keep_good(docs: DataFrame, field: LineField | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the field doesn't reject, all columns kept; without a field, all rows."""
    bounded_batches(docs.sparkSession)
    if field is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 200):
                batch = big.slice(k, 200)
                yield batch.filter(pa.array(document_scores(string_column(batch, text_col), field) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
