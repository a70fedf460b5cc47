"""Words of texts, counted once per text: the base of the hashing encoder (E1b), IDF weights and BM25.

A word is a run of letters or digits of the lower-cased text (``TOKEN_PATTERN``). The text is lower-cased by the JVM; the
words are counted by an Arrow pass, whose time grows with the words of a text and not with the width of a vector.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import TOKEN_PATTERN

#: Distinct words whose hash a Python worker remembers (some 20 MB), and cells of a slice's dense matrix.
REMEMBERED = 100_000
CELLS = 4_000_000
#: Texts, and bytes of text, whose words are held at a time: a worker's memory does not depend on the size of its batches.
TEXTS, TEXT_BYTES = 256, 1 << 20

#: ASCII letters in lower case and digits stay, other ASCII characters part words; bytes of further characters stay.
_KEPT = bytes(c if c >= 128 or chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_IS_KEPT = np.array([c != 32 for c in _KEPT])
#: Words that are hashed at a time.
HASHED = 16_384
#: Distinct characters beyond ASCII that may part the words of a text before it is searched by the pattern instead.
PARTING = 32


class _Parts(dict):
    """Character -> whether it is beyond ASCII and parts words."""

    def __missing__(self, char: str) -> bool:
        import regex
        parts = self[char] = not char.isascii() and not regex.match(TOKEN_PATTERN, char)  # no more entries than characters
        return parts


class _FirstBits(dict):
    """word -> the first 32 bits of its md5."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
        return h


_first_bits = _FirstBits()  # of the Python worker: Spark reuses workers, so later tasks find long words here
_parts = _Parts()


def _prepared(lowered: str | None) -> bytes:
    """A lower-cased text (null: none) as UTF-8 in which words are the runs of letters a-z, digits and bytes beyond ASCII."""
    if not lowered:
        return b""
    if not lowered.isascii():
        parting = [c for c in set(lowered) if _parts[c]]
        if len(parting) > PARTING:
            import regex
            return " ".join(regex.findall(TOKEN_PATTERN, lowered)).encode()
        for c in parting:
            lowered = lowered.replace(c, " ")
    return lowered.encode()


def words_of(lowered: str | None) -> list[str]:
    """Words of a lower-cased text (null: none)."""
    return _prepared(lowered).translate(_KEPT).decode().split()


_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_PLACES = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]


def _md5_first_bits(message: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of many short messages at a time: ``message`` has a row for each of the first words of
    their padded blocks (the others are 0 but the length in ``bits``)."""
    n = len(bits)
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t = np.empty(n, dtype=np.uint32)
    for i in range(61):  # the three last steps don't reach the first bits
        if i < 16:
            f = np.bitwise_xor(c, d)
            f &= b
            f ^= d
        elif i < 32:
            f = np.bitwise_xor(b, c)
            f &= d
            f ^= c
        elif i < 48:
            f = np.bitwise_xor(b, c)
            f ^= d
        else:
            f = np.invert(d)
            f |= b
            f ^= c
        a += f
        a += np.uint32(_ADDED[i])
        place = _PLACES[i]
        if place < len(message):
            a += message[place]
        elif place == 14:
            a += bits
        np.left_shift(a, _SHIFTS[i], out=t)
        a >>= np.uint32(32 - _SHIFTS[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of words of ``data``, which has room for a block behind the last of them."""
    out = np.empty(len(start), dtype=np.int64)
    low = 0
    for high in (8, 16, 56):  # words below so many bytes; what is padded to a block of its own has 55 at most
        some = np.flatnonzero((size >= low) & (size < high))
        for k in range(0, len(some), HASHED):
            part = some[k:k + HASHED]
            at, ends = np.arange(high), size[part, None]
            block = data[start[part, None] + at]
            block[at >= ends] = 0
            block[np.arange(len(part)), size[part]] = 128
            message = np.ascontiguousarray(block.view("<u4").T.astype(np.uint32, copy=False))
            out[part] = _md5_first_bits(message, (size[part] * 8).astype(np.uint32))
        low = high
    for i in np.flatnonzero(size >= low).tolist():
        out[i] = _first_bits[data[start[i]:start[i] + size[i]].tobytes().decode()]
    return out


def _buckets(texts: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word, number of words per text)."""
    parts = [_prepared(text) for text in texts.to_pylist()]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    data = np.frombuffer(b" ".join([*parts, bytes(64)]), dtype=np.uint8)
    inside = _IS_KEPT[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    start, stop = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return _hashes(data, start, stop - start) % dim, counts.astype(np.int64)


def _slices(texts: pa.Array, dim: int = 1) -> Iterator[pa.Array]:
    """The texts in slices within TEXTS, TEXT_BYTES and CELLS; a longer text is a slice of its own."""
    most = max(1, min(TEXTS, CELLS // dim))
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < len(texts):
        fits = int(np.searchsorted(ends, ends[start] - size[start] + TEXT_BYTES, side="right"))
        stop = min(max(fits, start + 1), start + most, len(texts))
        yield texts.slice(start, stop - start)
        start = stop


def _counted(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of numbers below ``n``, ascending, and how often each occurs."""
    if n > 16 * len(cells):
        return np.unique(cells, return_counts=True)
    often = np.bincount(cells, minlength=n)
    found = np.flatnonzero(often)
    return found, often[found]


def bucket_texts(df: DataFrame, text_col: str, dim: int) -> DataFrame:
    """(bucket, n): the texts that have a word in the bucket, as far as a task has read them; a task gives ``dim`` rows at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, dtype=np.int64)
        for batch in batches:
            for part in _slices(batch.column("text")):
                bucket, counts = _buckets(part, dim)
                cell, _ = _counted(np.repeat(np.arange(len(part)), counts) * dim + bucket, len(part) * dim)
                total += np.bincount(cell % dim, minlength=dim)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    return df.select(F.lower(F.col(text_col)).alias("text")).mapInArrow(count, "bucket int, n bigint")


def _dense_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """Words per (text, bucket), one row after another."""
    out, at = np.zeros(len(texts) * dim), 0
    for part in _slices(texts, dim):
        bucket, counts = _buckets(part, dim)
        out[at:at + len(part) * dim] = np.bincount(np.repeat(np.arange(len(part)), counts) * dim + bucket, minlength=len(part) * dim)
        at += len(part) * dim
    return out


def bucket_counts(text, dim: int) -> Column:
    """Hashed bag of words as a dense vector: ARRAY<DOUBLE> of length ``dim``. A null text has no words."""
    def count(texts: pa.Array) -> pa.Array:
        offsets = pa.array(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(_dense_counts(texts, dim)))
    return F.arrow_udf(count, "array<double>")(F.lower(F.col(text) if isinstance(text, str) else text))


def sparse_weights(text, dim: int, weights: np.ndarray | None = None) -> Column:
    """Hashed bag of words as a sparse vector STRUCT<indices: ARRAY<INT>, values: ARRAY<DOUBLE>>, indices ascending:
    the word counts of the buckets that occur, times ``weights`` if given, then L2-normalised."""
    def slice_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bucket, counts = _buckets(texts, dim)
        owner = np.repeat(np.arange(len(texts)), counts)
        cell, often = _counted(owner * dim + bucket, len(texts) * dim)
        owner, index = cell // dim, cell % dim
        value = often.astype(np.float64)
        if weights is not None:
            value *= weights[index]
        norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=len(texts)))
        value /= norm[owner]
        return np.bincount(owner, minlength=len(texts)), index.astype(np.int32), value

    def count(texts: pa.Array) -> pa.Array:
        sizes, indices, values = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for part in _slices(texts):
            for out, more in zip((sizes, indices, values), slice_counts(part)):
                out.append(more)
        offsets = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(indices))),
             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))], names=["indices", "values"])
    return F.arrow_udf(count, "indices array<int>, values array<double>")(F.lower(F.col(text) if isinstance(text, str) else text))


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, length): a row per distinct word of every text, ``length`` the number of all its words. A text
    without words gives no row. One pass, nothing is shuffled."""
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.lower(F.col(text_col)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = 0
            for texts in _slices(batch.column("text")):
                part = batch.slice(k, len(texts))
                k += len(texts)
                ids, terms, tf, lengths = [], [], [], []
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    words = words_of(text)
                    often = Counter(words)
                    ids += [i] * len(often)
                    terms += often.keys()
                    tf += often.values()
                    lengths += [len(words)] * len(often)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(tf, pa.int64()),
                                                  pa.array(lengths, pa.int64())], names=["id", "term", "tf", "length"])

    return src.mapInArrow(count, "id bigint, term string, tf bigint, length bigint")


def known_counts(df: DataFrame, id_col: str, text_col: str, known) -> DataFrame:
    """(id, length, places, tf): a row per text, ``length`` the number of its words; of the words in ``known`` (a broadcast
    dictionary word -> place) that occur, the places and how often. Nothing is shuffled."""
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.lower(F.col(text_col)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value
        for batch in batches:
            k = 0
            for texts in _slices(batch.column("text")):
                places, tf, lengths, sizes = [], [], [], [0]
                for text in texts.to_pylist():
                    words = words_of(text)
                    often = Counter(filter(place.__contains__, words))
                    places += map(place.__getitem__, often)
                    tf += often.values()
                    lengths.append(len(words))
                    sizes.append(len(places))
                ends = pa.array(sizes, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(k, len(texts)), pa.array(lengths, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(places, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))],
                    names=["id", "length", "places", "tf"])
                k += len(texts)

    return src.mapInArrow(count, "id bigint, length bigint, places array<int>, tf array<int>")
