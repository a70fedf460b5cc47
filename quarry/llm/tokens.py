"""Operator 2: token ids of every text in patched frame-of-reference files.

File format (one binary value per segment; Spark's Parquet writer carries the segments, so any store that Spark
writes to will do, and a lost task leaves nothing behind). All integers are little-endian::

    magic "PFR1"; u32 documents; u32 ids; u64 ids before this segment within its part
    three packed columns: doc ids (as u64 differences to the first, which follows as i64), ids per document, ids
    a packed column: u32 values; u32 blocks; per block u32 byte offset of the block (the index of block starts)
    a block of 512 values (the last one repeats its last value): u64 minimum; u8 width; u16 exceptions; the low
      `width` bits of each value less the minimum, high bits first; then the exceptions: u16 position and u64
      value less the minimum
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import columns, materialize, read, string_column

BLOCK = 512
#: Share of a block's values that fit the packed width; the others become exceptions.
PERCENTILE = 0.9
#: A segment is closed once it holds this many ids.
SEGMENT_IDS = 1 << 20
#: Distinct chunks, and distinct pieces, remembered by a worker (two generations of this size each).
MEMO = 500_000
MAGIC = b"PFR1"

#: Letters (all of Latin up to U+024F) and marks whose class is the same in every Unicode version (fixed values).
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-/:-@\\[-`{-~"
#: White space of Unicode as the tokenizer's own patterns have it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


# ---------------------------------------------------------------- patched frame of reference

def _bits(values: np.ndarray) -> np.ndarray:
    """Bits needed by each value (0 for 0)."""
    high = values >> np.uint64(32)
    bits = np.frexp(np.where(high > 0, high, values).astype(np.float64))[1]  # exact: both halves are below 2 ** 53
    return np.where(high > 0, bits + 32, bits).astype(np.int64)


def _word(width: int) -> np.dtype:
    """The smallest big-endian unsigned integer that holds ``width`` bits."""
    return np.dtype(f">u{1 if width <= 8 else 2 if width <= 16 else 4 if width <= 32 else 8}")


def _spread(starts: np.ndarray, size: int) -> np.ndarray:
    return starts[:, None] + np.arange(size)


def _exception_places(starts: np.ndarray, width: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Byte places of all exceptions, block by block."""
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(starts + _HEAD + width * (BLOCK // 8), count) + within * _EXC.itemsize


_EXC = np.dtype([("p", "<u2"), ("v", "<u8")])
_HEADER = np.dtype([("low", "<u8"), ("width", "u1"), ("exceptions", "<u2")])
_HEAD = _HEADER.itemsize


def pack_column(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Pack unsigned 64-bit integers; see the module's description of the format."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return struct.pack("<II", 0, 0)
    padded = np.concatenate([values, np.full(blocks * BLOCK - n, values[-1], dtype=np.uint64)]).reshape(blocks, BLOCK)
    low = padded.min(axis=1)
    rest = padded - low[:, None]
    need = _bits(rest)
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width, widest = np.partition(need, at, axis=1)[:, at], need.max(axis=1)
    # where packing everything at the widest is smaller than patching, the block has no exceptions
    patched = (need > width[:, None]).sum(axis=1) * _EXC.itemsize * 8 + width * BLOCK
    width = np.where(patched < widest * BLOCK, width, widest)
    over = need > width[:, None]
    header = np.zeros(blocks, dtype=_HEADER)
    header["low"], header["width"], header["exceptions"] = low, width, over.sum(axis=1)
    sizes = _HEAD + width * (BLOCK // 8) + header["exceptions"].astype(np.int64) * _EXC.itemsize
    starts = np.cumsum(sizes) - sizes
    body = np.zeros(int(sizes.sum()), dtype=np.uint8)
    body[_spread(starts, _HEAD)] = header.view(np.uint8).reshape(blocks, _HEAD)
    for w in np.unique(width).tolist():
        if w:
            which = np.flatnonzero(width == w)
            word = _word(w)
            bits = np.unpackbits(rest[which].astype(word).view(np.uint8).reshape(len(which), BLOCK, word.itemsize), axis=2)
            body[_spread(starts[which] + _HEAD, w * (BLOCK // 8))] = np.packbits(
                bits[:, :, word.itemsize * 8 - w:].reshape(len(which), -1), axis=1)
    block, place = np.nonzero(over)
    if len(block):
        exc = np.empty(len(block), dtype=_EXC)
        exc["p"], exc["v"] = place, rest[block, place]
        places = _exception_places(starts, width, header["exceptions"].astype(np.int64))
        body[_spread(places, _EXC.itemsize)] = exc.view(np.uint8).reshape(-1, _EXC.itemsize)
    return struct.pack("<II", n, blocks) + starts.astype("<u4").tobytes() + body.tobytes()


def unpack_column(data: memoryview, at: int, first: int = 0, count: int | None = None) -> tuple[np.ndarray, int]:
    """Values ``first`` .. ``first + count`` of the column at ``at``, reached by the block index, and where the last
    block read ends (the end of the column, when it is read whole)."""
    n, blocks = struct.unpack_from("<II", data, at)
    base = at + 8 + 4 * blocks
    if not n:
        return np.zeros(0, dtype=np.uint64), base
    stop = n if count is None else min(n, first + count)
    b0, b1 = first // BLOCK, max(-(-stop // BLOCK), first // BLOCK + 1)
    starts = base + np.frombuffer(data, "<u4", blocks, at + 8)[b0:b1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    header = raw[_spread(starts, _HEAD)].view(_HEADER)[:, 0]
    width, exceptions = header["width"].astype(np.int64), header["exceptions"].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), dtype=np.uint64)
    for w in np.unique(width).tolist():
        if w:
            which = np.flatnonzero(width == w)
            word = _word(w)
            bits = np.unpackbits(raw[_spread(starts[which] + _HEAD, w * (BLOCK // 8))], axis=1)
            wide = np.zeros((len(which), BLOCK, word.itemsize * 8), dtype=np.uint8)
            wide[:, :, word.itemsize * 8 - w:] = bits.reshape(len(which), BLOCK, w)
            out[which] = np.packbits(wide, axis=2).view(word)[:, :, 0]
    if exceptions.any():
        exc = raw[_spread(_exception_places(starts, width, exceptions), _EXC.itemsize)].view(_EXC)[:, 0]
        out[np.repeat(np.arange(len(starts)), exceptions), exc["p"]] = exc["v"]
    out += header["low"][:, None]
    end = int(starts[-1] + _HEAD + width[-1] * (BLOCK // 8) + exceptions[-1] * _EXC.itemsize)
    return out.ravel()[first - b0 * BLOCK:stop - b0 * BLOCK], end


def write_segment(doc_ids: list[int], counts: list[int], ids: np.ndarray, before: int) -> bytes:
    first = doc_ids[0]
    diffs = (np.array(doc_ids, dtype=np.int64) - first).astype(np.uint64)
    return b"".join([MAGIC, struct.pack("<IIQq", len(doc_ids), len(ids), before, first), pack_column(diffs),
                     pack_column(np.array(counts, dtype=np.uint64)), pack_column(ids)])


def read_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc ids, ids per document, all ids, ids before the segment within its part."""
    data = memoryview(payload)
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a token segment")
    _, _, before, first = struct.unpack_from("<IIQq", data, 4)
    diffs, at = unpack_column(data, 28)
    counts, at = unpack_column(data, at)
    ids, _ = unpack_column(data, at)
    return diffs.astype(np.int64) + first, counts.astype(np.int64), ids, before


# ---------------------------------------------------------------- encoding

class Memo(dict):
    """What ``learn`` gives for a key, remembered for the last ``size`` to ``2 * size`` distinct keys."""

    def __init__(self, learn, size: int):
        super().__init__()
        self.learn, self.size, self.old = learn, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.learn(key)
        self[key] = got
        return got


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, which sees every distinct piece once.

    A text of Latin letters, digits and ASCII marks is split whole by the tokenizer's pattern, with its classes spelled
    out, and its pieces go to the library's model. Any other text is taken chunk by chunk. A chunk is a run of white space with the run of other characters after it. The tokenizer's own splitting
    never joins a character to white space that follows it, and looks no further ahead than the next
    character that isn't white space, so the ids of a text are those of its chunks, one after another. A plain
    chunk (at most one space or newline, then letters, then marks other than an apostrophe) is split here as the
    tokenizer's pattern does, and its pieces go to the library's model; every other chunk goes through the whole of the
    library.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.added = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        # the library's name of every byte up to 0xDF; higher bytes are named by themselves
        some = "".join(map(chr, range(2048)))
        self.names = dict(zip(some.encode(), ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(some)[0][0]))
        byte_level = isinstance(self.tok.pre_tokenizer, ByteLevel) and self.tok.normalizer is None
        self.plain = re.compile(r"([ \n]?)([^\W\d_]*)((?:[^\w\s'\x1c-\x1f]|_)*)").fullmatch if byte_level else lambda chunk: None
        self.latin = re.compile(f"[\t\n\r {LETTERS}0-9{MARKS}]*").fullmatch if byte_level else lambda text: None
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|\\s+(?!\\S)|\\s+").findall
        self.pieces = Memo(self._piece, memo)
        self.known = Memo(self._chunk, memo // 2)
        self.chunks = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall

    def _piece(self, piece: str) -> bytes:
        name = piece.encode().decode("latin-1").translate(self.names)
        return array("I", [t.id for t in self.model.tokenize(name)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        m = self.plain(chunk)
        if m:
            first, word, marks = m.groups()
            if (word.isalpha() or not word and marks) and not any(map(chunk.__contains__, self.added)):
                got = b""
                if first == "\n":
                    got, first = self.pieces[first], ""
                if word:
                    got, first = got + self.pieces[first + word], ""
                return got + self.pieces[first + marks] if marks else got
        return array("I", self.tok.encode_batch_fast([chunk], add_special_tokens=False)[0].ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers of the machine (little-endian wherever Spark runs on x86 or ARM)."""
        if self.latin(text) and not any(map(text.__contains__, self.added)):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        return b"".join(map(self.known.__getitem__, self.chunks(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder: Spark reuses Python workers, so tasks after the first find it loaded, with its memo."""
    return ChunkEncoder(path)


def encode_to_segments(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
                       text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments (part, seq, n_ids, payload) of all texts in ascending id order, each text followed by ``end_id``.

    Texts are range-partitioned by id; a part is one partition in order, encoded as a stream, so a worker holds
    one segment, one batch and its memo. Rows that repeat an id are told apart by a hash of the text, so
    even a third of all rows under one id is spread.
    """
    src = columns(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    by = ["doc_id", "_h"]
    placed = src.withColumn("_h", F.xxhash64("text")).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = placed.select("doc_id", "text", F.spark_partition_id().alias("part"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ids, held, doc_ids, counts, seq, before, part = encoder(tokenizer), [], 0, [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            payload = write_segment(doc_ids, counts, flat, before)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()),
                                               "n_ids": pa.array([len(flat)], pa.int64()),
                                               "payload": pa.array([payload], pa.binary())})
        for batch in batches:
            for d, text, part in zip(batch.column("doc_id").to_pylist(), string_column(batch, "text"),
                                     batch.column("part").to_pylist()):
                got = enc.encode(text) + end
                ids.append(got)
                doc_ids.append(NULL_ID if d is None else d)
                counts.append(len(got) // 4)
                held += len(got) // 4
                if held >= segment_ids:
                    yield close()
                    seq, before, ids, doc_ids, counts, held = seq + 1, before + held, [], [], [], 0
        if doc_ids:
            yield close()

    return placed.mapInArrow(encode, "part int, seq long, n_ids long, payload binary")


#: Stands for a null doc_id inside a segment.
NULL_ID = -(2 ** 63)


def read_segments(segments: DataFrame) -> DataFrame:
    """Documents read back from segments: doc_id, start, n_tokens, ids_crc32.

    A part's offset is the sum of the ids of earlier parts (one row per part); a segment carries its own
    offset within the part.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (segments.groupBy("part").agg(F.sum("n_ids").alias("_n"))
               .select(F.col("part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload")):
                doc_ids, counts, ids, before = read_segment(payload.as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c):4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([None if d == NULL_ID else d for d in doc_ids.tolist()], pa.int64()),
                    "start": pa.array(before + ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array([part] * len(crc), pa.int32())})

    docs = segments.select("part", "payload").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")
    return (docs.join(offsets, F.col("part") == F.col("_p"))
            .select("doc_id", (F.col("start") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode all ``docs``, write the segments to the shared folder and read every document back from them.

    Defined cases: null and empty texts are the end id alone; null ids come first; repeated ids follow one
    another in a fixed order; a text longer than a segment gets a segment of its own length; an empty table
    gives no rows.
    """
    return read_segments(materialize(encode_to_segments(docs, tokenizer, end_id), "op2-segments"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
