"""Operator 11: pack documents into as few sequences of a fixed length as possible, by bin completion.

How full a set of sequences can get depends only on how many pieces there are of each length, and there are no more
lengths than a sequence has tokens. So Spark encodes and cuts the documents, counts the pieces by length, and numbers
them within their length; the packing itself is found on the counts, of which there are at most ``capacity`` whatever
the table, as runs: a filling (lengths and how often each is in it) and how many sequences have it. A piece then
finds its sequence and place by its length and number alone.

The counts are packed as follows:

* best-fit decreasing gives a first solution, the incumbent;
* bin completion fills one sequence at a time around the largest piece that is left. Fillings are taken by falling
  sum, those of the largest pieces first; one is skipped if it is dominated (some of its pieces could be replaced by a
  single larger piece that still fits, which leaves the others freer);
* a filling is first taken as often as the counts allow, then once, so that every solution can be reached;
* an incumbent of B sequences leaves (B - 1) * capacity - total tokens to waste: a branch that has wasted more can't
  beat it and is cut. The search ends when the incumbent meets the lower bound or after ``NODES`` nodes, and the best
  incumbent is taken; nothing is left out either way.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import columns, materialize, ordered_totals, read, string_column
from quarry.llm.tokens import encoder

CAPACITY, END_ID = 1024, 2
#: Fillings tried by the search, and fillings looked at per node.
NODES, FILLINGS = 6000, 40

Filling = tuple[tuple[int, int], ...]  # (length, how often), by falling length


# ---------------------------------------------------------------- packing of counts

def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: for every split k, pieces over capacity - k share with none of k or more, and
    what the others can't put beside them needs sequences of its own (Martello and Toth's second bound)."""
    n, size = np.zeros(capacity + 1, dtype=object), np.arange(capacity + 1)
    for length, count in counts.items():
        n[length] = count
    tokens = n * size
    count_upto, tokens_upto = np.cumsum(n), np.cumsum(tokens)
    best = 0
    for k in range(capacity // 2 + 1):
        huge = count_upto[capacity] - count_upto[capacity - k]
        large = count_upto[capacity - k] - count_upto[capacity // 2]
        large_tokens = tokens_upto[capacity - k] - tokens_upto[capacity // 2]
        small_tokens = tokens_upto[capacity // 2] - (tokens_upto[k - 1] if k else 0)
        beside = large * capacity - large_tokens
        best = max(best, huge + large + max(0, -(-(small_tokens - beside) // capacity)))
    return int(best)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing: every piece, longest first, goes to the fullest sequence that has room for it. Equal
    sequences are handled together."""
    runs: list[list] = []  # [filling, sequences, room]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for run in sorted((r for r in runs if r[2] >= length), key=lambda r: r[2]):
            if not left:
                break
            filling, sequences, room = run
            each = room // length
            whole = min(sequences, left // each)
            parts = [(whole, each)]
            left -= whole * each
            if left and whole < sequences and left < each:
                parts.append((1, left))
                left = 0
            run[1] -= sum(p for p, _ in parts)
            runs += [[(*filling, (length, e)), p, room - e * length] for p, e in parts if p]
        runs = [r for r in runs if r[1]]
        each = capacity // length
        if left // each:
            runs.append([((length, each),), left // each, capacity - each * length])
        if left % each:
            runs.append([((length, left % each),), 1, capacity - left % each * length])
    return [(filling, sequences) for filling, sequences, _ in runs]


def _sums(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For every place in ``lengths`` the sums that the pieces from there on can make, as a bit set."""
    mask = (1 << (room + 1)) - 1
    out = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        length, bits = lengths[i], out[i + 1]
        left, step = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... pieces at a time
            take = min(step, left)
            bits |= (bits << (take * length)) & mask
            left, step = left - take, step * 2
        out[i] = bits
    return out


def _dominated(filling: Filling, free: int, waste: int) -> bool:
    """Whether some of the filling's pieces could give way to one larger piece: ``free`` has a bit for every length of
    which a piece is left over."""
    one, more = 0, 0  # sums of one of the pieces, and of two or more
    for length, n in filling:
        for _ in range(n):
            more |= (one | more) << length
            one |= 1 << length
    better = 0
    for extra in range(waste + 1):
        better |= more << extra | (one << extra if extra else 0)
        if better & free:
            return True
    return False


def fillings(counts: dict[int, int], first: int, capacity: int, waste: int, most: int) -> list[Filling]:
    """Up to ``most`` undominated fillings around a piece of length ``first`` that waste no more than ``waste``: the
    least wasteful first, and among equals those of larger pieces."""
    rest = dict(counts)
    rest[first] -= 1
    room = capacity - first
    lengths = [x for x in sorted(rest, reverse=True) if rest[x] and x <= room]
    sums = _sums(lengths, rest, room)
    out: list[Filling] = []
    looked = 0

    def fill(i: int, left: int, taken: list) -> Iterator[list]:
        """Ways to make exactly ``left`` of the lengths from place ``i`` on."""
        if not left:
            yield taken
            return
        for j in range(bisect_left(lengths, -left, i, key=neg), len(lengths)):
            if not sums[j] >> left & 1:
                return
            length = lengths[j]
            for n in range(min(rest[length], left // length), 0, -1):
                if sums[j + 1] >> (left - n * length) & 1:
                    yield from fill(j + 1, left - n * length, [*taken, (length, n)])

    all_free = sum(1 << x for x in lengths)
    for total in range(room, max(room - waste, 0) - 1, -1):
        if not sums[0] >> total & 1:
            continue
        for found in fill(0, total, []):
            looked += 1
            free = all_free - sum(1 << x for x, n in found if rest[x] == n)
            if not _dominated(tuple(found), free, room - total):
                whole = dict(found)
                whole[first] = whole.get(first, 0) + 1
                out.append(tuple(sorted(whole.items(), reverse=True)))
                if len(out) == most:
                    return out
            if looked >= most * 5 and out:
                return out
        if looked >= most * 5:
            break
    return out


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Runs (filling, number of sequences) that hold exactly the counted pieces, in as few sequences as the search finds;
    the fewest possible if it ends by itself or meets the lower bound."""
    counts = {length: n for length, n in counts.items() if n}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    total = sum(length * n for length, n in counts.items())
    best = best_fit(counts, capacity)
    have, need = sum(n for _, n in best), lower_bound(counts, capacity)
    spent = 0
    # depth first: a frame holds the counts left, sequences so far, waste so far, the run that led here, and its branches
    stack: list[list] = [[dict(counts), 0, 0, None, None]]
    while stack and have > need and spent < nodes:
        left, sequences, wasted, _, branches = frame = stack[-1]
        allowed = (have - 1) * capacity - total - wasted
        if branches is None:
            if not left:
                best, have = [f[3] for f in stack[1:]], sequences
                stack.pop()
                continue
            first = max(left)
            frame[4] = branches = _branches(left, first, capacity, allowed) if allowed >= 0 else iter(())
        for filling, times in branches:
            waste = (capacity - sum(length * n for length, n in filling)) * times
            if waste > allowed or sequences + times >= have:
                continue
            spent += 1
            after = dict(left)
            for length, n in filling:
                after[length] -= n * times
                if not after[length]:
                    del after[length]
            stack.append([after, sequences + times, wasted + waste, (filling, times), None])
            break
        else:
            stack.pop()
    return best


def _branches(left: dict[int, int], first: int, capacity: int, waste: int) -> Iterator[tuple[Filling, int]]:
    for filling in fillings(left, first, capacity, waste, FILLINGS):
        most = min(left[length] // n for length, n in filling)
        slack = capacity - sum(length * n for length, n in filling)
        if slack:
            most = min(most, max(1, waste // slack))
        yield filling, most
        if most > 1:
            yield filling, 1


class Places:
    """Where the pieces of each length go: of a run, the number of the first piece of that length, how many of them a
    sequence holds, the first sequence, and their offset there."""

    def __init__(self, runs: list[tuple[Filling, int]]):
        rows: dict[int, list] = {}
        used: dict[int, int] = {}
        sequence = 0
        for filling, times in runs:
            offset = 0
            for length, n in filling:
                start = used.get(length, 0)
                rows.setdefault(length, []).append((start, n, sequence, offset))
                used[length] = start + n * times
                offset += length * n
            sequence += times
        self.sequences = sequence
        self.rows = {length: np.array(r, dtype=np.int64) for length, r in rows.items()}

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and number within the length."""
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for x in np.unique(length).tolist():
            at = np.flatnonzero(length == x)
            row = self.rows[x][np.searchsorted(self.rows[x][:, 0], number[at], side="right") - 1]
            within = number[at] - row[:, 0]
            sequence[at] = row[:, 2] + within // row[:, 1]
            offset[at] = row[:, 3] + within % row[:, 1] * x
        return sequence, offset


# ---------------------------------------------------------------- documents

def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as ids with ``end_id`` after them, cut where they are longer than ``capacity``: doc_id, piece, start,
    length, ids_crc32 (and ``ids``, little-endian unsigned 32-bit integers). All pieces but the first are whole
    sequences. A map: nothing is shuffled."""
    src = columns(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for big in batches:
            for k in range(0, big.num_rows, 256):  # bounds what a batch of long texts makes
                batch, out = big.slice(k, 256), []
                for d, text in zip(batch.column("doc_id").to_pylist(), string_column(batch, "text")):
                    ids = enc.encode(text) + end
                    n = len(ids) // 4
                    at = (n - 1) % capacity + 1  # the first piece takes what doesn't fill a sequence
                    for piece, (a, b) in enumerate(zip([0, *range(at, n, capacity)], range(at, n + 1, capacity))):
                        part = ids[4 * a:4 * b]
                        out.append((d, piece, a, b - a, zlib.crc32(part), part)[:len(names)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if name == "ids" else pa.int32() if name == "piece" else pa.int64())
                     for name, c in zip(names, zip(*out))], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return src.mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (columns doc_id, piece, start, length and any others).

    Pieces are numbered within their length by a range partitioning, so that a length that a third of all pieces have is
    spread as well. What goes through the driver are one count per length and the runs: no more than ``capacity`` lengths and
    no more runs than the search makes by using up a length with each, whatever the table.
    """
    cut = materialize(cut, "op11-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(solve(counts, capacity, nodes))
    order = ["doc_id", "piece", "start"] + [c for c in ("ids_crc32",) if c in cut.columns]
    numbered = ordered_totals(cut, order, [], group=["length"], name="op11-numbered")
    fields = cut.schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("_row").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + [pa.array(sequence), pa.array(offset)],
                                                 names=[f.name for f in fields] + ["sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return numbered.select(*cut.columns, "_row").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequence and place in it.

    Defined cases: null and empty texts are the end id alone; a text of more than ``capacity`` ids is cut, and only
    such a text; null and repeated ids are documents of their own (rows that agree in everything may trade places);
    an empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ``ids``: sequence_id, n_tokens, ids, and ``starts``, the place of each
    piece. A sequence is at most ``capacity`` ids, so its group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return out.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
