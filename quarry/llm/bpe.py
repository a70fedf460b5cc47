"""Operator 7: byte-pair encoding by a deterministic token automaton, and decoding by its arc labels.

The automaton reads tokens. It starts as one state with an arc for every base symbol; every merge (a, b) -> c, in
the order of the vocabulary, adds one gadget:

* the arcs labelled ``a`` are led to a fresh state, a copy of the one they led to without its arc ``b``, so that
  no path reads ``a`` and then ``b`` any more;
* every state with an arc ``a`` gets an arc ``c``, which leads where the arcs labelled ``b`` led.

The paths that are left are exactly the token sequences that the merges produce. Arcs of one label all lead
to one state, and a state only ever loses an arc by being copied, so the table needs three numbers a state
(the state it copies, the label it lacks, the merge that made it) and, for a label, its target, its left half
and its merge. Arcs that were looked up are remembered.

A part of a canonical token sequence is canonical, so each prefix of a word is reached by one path only: encoding
marks, from left to right, the one token that reaches each place of the word.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import columns, read, string_column
from quarry.llm.tokens import SPACE, Memo

#: Distinct words, and half as many distinct chunks, remembered by a worker (two generations of this size).
MEMO = 400_000
#: Letters that are lower-cased one by one and that no normalization changes, and ASCII marks (fixed values).
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0152\u0153", "!-/:-@\\[-`{-~"
#: Arcs remembered by a worker.
ARCS = 2_000_000


class TokenAutomaton:
    """The automaton of a list of merges over an alphabet of base symbols (strings)."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        self.label = {s: i for i, s in enumerate(base)}       # token string -> label
        n = len(base) + len(merges)
        self.left, self.made = [-1] * n, [-1] * n              # of a label: left half, merge
        self.target = [0] * n                                  # of a label: the state its arcs lead to
        self.parent, self.lacks, self.born = [-1], [-1], [-1]  # of a state
        self.arcs: dict[int, bool] = {}
        self.width = n
        for k, (a, b) in enumerate(merges):
            la, lb = self.label.get(a), self.label.get(b)
            if la is None or lb is None or a + b in self.label or not self._walk(self.target[la], lb):
                continue  # the pair never stands side by side, so the merge never applies
            label = len(self.label)
            self.label[a + b] = label
            self.left[label], self.made[label] = la, k
            self.target[label] = self.target[lb]
            self.parent.append(self.target[la])
            self.lacks.append(lb)
            self.born.append(k)
            self.target[la] = len(self.parent) - 1
        self._index()
        #: label of every token, and None for every string that only begins tokens
        self.prefixes: dict[str, int | None] = {t[:k]: None for t in self.label for k in range(1, len(t))}
        self.prefixes.update(self.label)

    def _walk(self, state: int, label: int) -> bool:
        """Whether the state has the arc, by walking back to the states that it copies."""
        left, made, parent, lacks, born = self.left, self.made, self.parent, self.lacks, self.born
        while state:
            if made[label] >= born[state]:
                label = left[label]  # added where its left half has an arc
            elif label == lacks[state]:
                return False
            else:
                state = parent[state]
        return True

    def _index(self) -> None:
        """Number the tree of copies in preorder and list, per label, the states that lack it, each with the
        nearest one above it, so that an arc is looked up without walking the tree."""
        n = len(self.parent)
        below = [1] * n
        for q in range(n - 1, 0, -1):  # a copy comes after what it copies
            below[self.parent[q]] += below[q]
        self.enter, free = [0] * n, [1] * n
        for q in range(1, n):
            p = self.parent[q]
            self.enter[q] = self.enter[p] + free[p]
            free[p] += below[q]
        self.leave = [e + b for e, b in zip(self.enter, below)]
        self.without: dict[int, tuple[list[int], list[int], list[int]]] = {}  # preorder numbers, states, nearest above
        for q in sorted(range(1, n), key=self.enter.__getitem__):
            numbers, states, above = self.without.setdefault(self.lacks[q], ([], [], []))
            up = len(states) - 1
            while up >= 0 and self.leave[states[up]] <= self.enter[q]:
                up = above[up]
            numbers.append(self.enter[q])
            states.append(q)
            above.append(up)

    def has_arc(self, state: int, label: int) -> bool:
        """Whether the state has the arc: neither the label nor, at the time it was made, its left half, and so on
        to the base symbol, is lacked by the state or by one that it copies."""
        here, before = self.enter[state], self.width
        while label >= 0:
            lists = self.without.get(label)
            if lists:
                numbers, states, above = lists
                k = bisect_right(numbers, here) - 1
                while k >= 0:
                    q = states[k]
                    if here < self.leave[q] and self.born[q] <= before:
                        return False
                    k = above[k]
            before, label = self.made[label], self.left[label]
        return True

    def encode(self, symbols: list[str]) -> list[str]:
        """The tokens of one word, given as base symbols."""
        n = len(symbols)
        begun, token, state = [-1] * (n + 1), [""] * (n + 1), [0] * (n + 1)  # of the token that reaches a place
        prefixes, target, arcs, width = self.prefixes, self.target, self.arcs, self.width
        begun[0] = 0
        for j in range(n):
            if begun[j] < 0:
                continue
            row, sub = state[j] * width, ""
            for i in range(j + 1, n + 1):
                sub += symbols[i - 1]
                label = prefixes.get(sub, -1)
                if label is None or begun[i] >= 0:
                    continue
                if label < 0:
                    break
                ok = arcs.get(row + label)
                if ok is None:
                    if len(arcs) > ARCS:
                        arcs.clear()
                    ok = arcs[row + label] = self.has_arc(state[j], label)
                if ok:
                    begun[i], token[i], state[i] = j, sub, target[label]
        if begun[n] < 0:
            raise ValueError("a base symbol of the word is not in the vocabulary")
        out = []
        while n:
            out.append(token[n])
            n = begun[n]
        return out[::-1]


class WordBpe:
    """Whole texts to ids and back, for a tokenizer file that lower-cases and marks word ends.

    A text of Latin letters, digits and ASCII marks is lower-cased and split whole by the tokenizer's pattern, with its classes
    spelled out; any other text is normalized and split by the library, chunk by chunk. Every distinct word goes through
    the automaton once."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        self.automaton = TokenAutomaton([t for t in self.vocab if t not in made], merges)
        lib = Tokenizer.from_file(path)  # its normalizer and its splitting are used as they are
        self.normalize, self.split = lib.normalizer.normalize_str, lib.pre_tokenizer.pre_tokenize_str
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        #: the label of every id: what the arcs with that label spell
        names = {**{i: t for t, i in self.vocab.items()}, **{i: t for t, i in self.added.items()}}
        self.labels = [names.get(i, "") for i in range(max(names) + 1)]
        self.chunks = re.compile(f"[^{SPACE}]+").findall
        self.latin = re.compile(f"[\t\n\r {LETTERS}0-9{MARKS}]*").fullmatch
        self.latin_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[{MARKS}]+").findall
        # the library's name of every byte up to 0xDF; higher bytes are named by themselves
        some = "".join(map(chr, range(2048)))
        self.names = dict(zip(some.encode(), ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(some)[0][0]))
        self.words = Memo(self._word, memo)
        self.named = Memo(self._named, memo // 2)
        self.known = Memo(self._chunk, memo // 2)

    def _named(self, name: str) -> bytes:
        """Ids of a word given by the library's names of its bytes."""
        tokens = self.automaton.encode([*name[:-1], name[-1] + self.end])
        return array("I", [self.vocab[t] for t in tokens]).tobytes()

    def _word(self, word: str) -> bytes:
        return self._named(word if word.isascii() else word.encode().decode("latin-1").translate(self.names))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space, split by the library."""
        got = []
        pieces = self.find_added.split(chunk) if self.find_added else [chunk]
        for k, piece in enumerate(pieces):
            if k % 2:
                got.append(array("I", [self.added[piece]]).tobytes())
            elif piece:
                got += [self.named[w] for w, _ in self.split(self.normalize(piece))]
        return b"".join(got)

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers of the machine."""
        if self.latin(text) and not any(map(text.__contains__, self.added)):
            return b"".join(map(self.words.__getitem__, self.latin_words(text.lower())))
        return b"".join(map(self.known.__getitem__, self.chunks(text)))

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs that ids stand for, one after another."""
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I")))


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The worker's automaton: Spark reuses Python workers, so tasks after the first find it built, with its memo."""
    return WordBpe(path)


def bpe_decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of ids (little-endian unsigned 32-bit integers): the labels of their arcs, with a space between
    two. Null ids have a null text; an id outside the vocabulary is an error."""
    def decode(ids: pa.Array) -> pa.Array:
        bpe = word_bpe(tokenizer)
        return pa.array([None if i is None else bpe.decode(i) for i in ids.to_pylist()], pa.string())
    return encoded.withColumn(out, F.arrow_udf(decode, "string")(F.col(ids_col)))


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256 (and, if asked
    for, ``ids``, the little-endian unsigned 32-bit integers, and ``decoded``).

    A map over partitions: nothing is shuffled. Text is split at white space, which the tokenizer drops and no
    token crosses; a worker remembers a bounded number of distinct chunks.

    Defined cases: null and empty texts have no ids and decode to the empty text; null and repeated ids pass
    through row by row; strings of added tokens in a text become those tokens, as the library does; an empty table gives
    no rows.
    """
    src = columns(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields += [("ids", pa.binary()), ("decoded", pa.string())]
    schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for big in batches:
            for k in range(0, big.num_rows, 256):  # bounds what a batch of long texts decodes to
                batch = big.slice(k, 256)
                rows = []
                for d, text in zip(batch.column("doc_id").to_pylist(), string_column(batch, "text")):
                    ids = bpe.encode(text)
                    decoded = bpe.decode(ids)
                    row = (d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append(row + (ids, decoded) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return src.mapInArrow(encode, out + (", ids binary, decoded string" if with_ids else ""))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe_encode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
