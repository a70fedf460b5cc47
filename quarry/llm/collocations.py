"""Operator 12: phrase collocations per language, by top-order marginalisation.

Every word starts one window: itself and the words after it (its lead columns), as many as the longest phrase has,
padded where the piece ends. Only these windows are counted. A phrase of k words occurs as often as windows begin with it,
so Spark's ROLLUP over (lang, w1, .., w5) gives the counts of all shorter phrases as sums over successively shorter
prefixes, with no explosion per length.

Only phrases with ``least`` occurrences matter, and every part of such a phrase has as many. Hashed counters that add up
the words, the pairs and then the triples of all documents therefore show where a window can be padded early: a
counter is never less than any count in it, so a part whose counter stays below ``least`` is surely in no phrase asked
for, and no phrase loses an occurrence. The counters' number follows the bytes of the table up to a bound; where they are
too few they only cut fewer windows.

Words travel as 64-bit hashes. A table of the words behind them tells whether two words share a hash; if so, all is done
again with another seed, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import columns, materialize, read, string_column
from quarry.llm.near_dedup import _ODD, _mix

LONGEST, LEAST, TOP, PERCENT, SCALE = 5, 100, 2000, 100, 1000
#: Bytes of text worked on together, distinct words remembered by a task, grams gathered before they are added up.
CHUNK, WORDS, GATHER = 2 << 20, 500_000, 3_000_000
#: Counters per byte of text, their number at least and at most, and counters in a part (which one task adds up).
PER_BYTE, FEWEST, MOST, PART = 1 / 48, 1 << 16, 1 << 28, 1 << 20
#: Bytes of text for a part of the windows (8 parts at least, 4096 at most).
PART_BYTES = 8 << 20

_U = np.uint64
#: Separators of pieces become 0xFF, which no text has; a tabulator becomes a space (fixed values of the contract).
_TABLE = bytes(0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))


# ---------------------------------------------------------------- words of texts

class _Words(dict):
    """word -> a small number of this task (0: the end of a piece), and the hash of every number."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[b"\xff"] = 0
        self.hashes = np.zeros(1 << 16, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(word, self.seed) or 1
        return n

    def numbers(self, blob: bytes) -> np.ndarray:
        words = blob.replace(b"\xff", b" \xff ").split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def _blobs(texts: list[str]) -> Iterator[bytes]:
    """The texts with A-Z lower-cased and separators marked, some ``CHUNK`` bytes at a time; only a piece is never cut."""
    held, size = [], 0
    for text in texts:
        data, at = text.encode("utf-8", "surrogatepass").lower().translate(_TABLE), 0
        while len(data) - at > CHUNK:
            cut = data.rfind(b"\xff", at, at + CHUNK)
            cut = cut if cut >= 0 else data.find(b"\xff", at + CHUNK)
            if cut < 0:
                break
            yield data[at:cut]
            at = cut + 1
        held.append(data[at:] if at else data)
        size += len(held[-1])
        if size >= CHUNK:
            yield b"\xff".join(held)
            held, size = [], 0
    if held:
        yield b"\xff".join(held)


def _runs(batches: Iterator[pa.RecordBatch], words: _Words) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, numbers of its words in order with a 0 after each piece)."""
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), string_column(batch, "text")):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for blob in _blobs(texts):
                yield lang, words.numbers(blob)


# ---------------------------------------------------------------- hashed counters

def _places(hashes: np.ndarray, at: np.ndarray, order: int, lang: str, size: int) -> np.ndarray:
    """Counters of the grams of ``order`` words that begin at the places ``at``."""
    with np.errstate(over="ignore"):
        total = np.full(len(at), _U(xxhash.xxh3_64_intdigest(lang, order)))
        for j in range(order):
            total = total + hashes[at + j] * _ODD[j]
        return _mix(total) & _U(size - 1)


def _reach(hashes: np.ndarray, lang: str, size: int, seen: dict[int, np.ndarray], longest: int) -> list[np.ndarray]:
    """For k = 1, 2, .. ``longest``: the places where a phrase of k words may begin, by the counters seen so far."""
    at = np.flatnonzero(hashes)
    out = []
    for k in range(1, longest + 1):
        if k > 1:  # both parts one shorter may be in a phrase
            alive = np.zeros(len(hashes) + 1, dtype=bool)
            alive[at] = True
            at = at[alive[at + 1]]
        bits = seen.get(k)
        if bits is not None and len(at):
            place = _places(hashes, at, k, lang, size)
            at = at[(bits[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1]
        out.append(at)
    return out


def _count_grams(src: DataFrame, orders: tuple[int, ...], size: int, seen, least: int, seed: int) -> dict[int, np.ndarray]:
    """For each order a bit per counter: whether the grams in it occur ``least`` times or more in all. Tasks add up
    their own grams first and send (counter, count) lists, one a part of the counters; a task adds up a part."""
    part = min(PART, size)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = _Words(seed), {k: [] for k in orders}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k, found in held.items():
                place, often = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
                often = np.minimum(often, least).astype("<u4" if least > 255 else "u1")
                cuts = np.searchsorted(place, np.arange(0, size + 1, part))
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k], pa.int32()), pa.array([p], pa.int32()),
                             pa.array([(place[a:b] - p * part).astype("<u4").tobytes()], pa.binary()),
                             pa.array([often[a:b].tobytes()], pa.binary())], names=["gram", "part", "place", "often"])
                found.clear()

        for lang, numbers in _runs(batches, words):
            hashes = words.hashes[numbers]
            reach = _reach(hashes, lang, size, seen.value, max(orders))
            for k in orders:
                place = _places(hashes, reach[k - 1], k, lang, size).astype(np.uint32)
                held[k].append(place)
                n += len(place)
            if n >= GATHER:
                yield from flush()
                n = 0
            if len(words) > WORDS:
                words.forget()
        yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None

        def close() -> pa.RecordBatch:
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.int32()),
                                               pa.array([bits], pa.binary())], names=["gram", "part", "bits"])
        for batch in batches:
            for k, p, place, often in zip(batch.column("gram").to_pylist(), batch.column("part").to_pylist(),
                                          batch.column("place"), batch.column("often")):
                if (k, p) != last:
                    if last is not None:
                        yield close()
                    last, total = (k, p), np.zeros(part, dtype=np.uint32)
                # a list names a counter once; sums stop at ``least``, so they can't pass 32 bits
                at = np.frombuffer(place.as_buffer(), "<u4")
                total[at] = np.minimum(total[at] + np.frombuffer(often.as_buffer(), "<u4" if least > 255 else "u1"), least)
        if last is not None:
            yield close()

    lists = src.mapInArrow(gather, "gram int, part int, place binary, often binary")
    parts = (lists.repartition("gram", "part").sortWithinPartitions("gram", "part")
             .mapInArrow(add, "gram int, part int, bits binary"))
    out = {k: np.zeros(max(size // 8, 1), dtype=np.uint8) for k in orders}
    for row in parts.toLocalIterator():  # size / 8 bytes an order in all, at most MOST / 8
        start = row["part"] * part // 8
        out[row["gram"]][start:start + part // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


# ---------------------------------------------------------------- windows

def _windows(src: DataFrame, size: int, seen, seed: int, longest: int, parts: int) -> DataFrame:
    """Counted windows (lang, w1 .. , c), with the words behind the hashes (w1, word) and the number of all words (lang, c) in
    rows of their own (``kind`` 0, 1 and 2). A task sends what it has counted as lists, dealt out by the hash of a window's
    first two words; a task that gets a part adds its lists up, so that ROLLUP sees a window about once."""
    lead = [f"w{j}" for j in range(1, longest + 1)]

    def sent(kind: int, part: int, lang: str | None, keys: np.ndarray, often: np.ndarray, text=()) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([lang], pa.string()),
             pa.array([keys.astype("<i8").tobytes()], pa.binary()), pa.array([often.astype("<i8").tobytes()], pa.binary()),
             pa.array([text], pa.list_(pa.string()))], names=["kind", "part", "lang", "keys", "often", "words"])

    def dealt(part_of: np.ndarray):
        order = np.argsort(part_of, kind="stable")
        cuts = np.searchsorted(part_of[order], np.arange(parts + 1))
        return ((p, order[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n, totals, used = _Words(seed), {}, 0, {}, np.zeros(0, dtype=np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                window, often = _distinct(np.concatenate(found), len(words))
                window = words.hashes[window]
                for part, at in dealt((_mix(window[:, 0] + _mix(window[:, min(1, longest - 1)])) % _U(parts)).astype(np.int64)):
                    yield sent(0, part, lang, window[at].view(np.int64), often[at])
            held.clear()

        def dictionary() -> Iterator[pa.RecordBatch]:
            by_number = list(words)  # in the order of their numbers
            which = np.unique(used)
            which = which[which > 0]
            for part, at in dealt((words.hashes[which] % _U(parts)).astype(np.int64)):
                text = [by_number[i].decode("utf-8", "surrogatepass") for i in which[at].tolist()]
                yield sent(1, part, None, words.hashes[which[at]].view(np.int64), np.zeros(0), text)

        for lang, numbers in _runs(batches, words):
            hashes = words.hashes[numbers]
            totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(numbers))
            reach = _reach(hashes, lang, size, seen.value, longest)
            window = np.zeros((len(reach[0]), longest), dtype=np.int32)
            row = np.zeros(len(numbers) + 1, dtype=np.int64)
            row[reach[0]] = np.arange(len(reach[0]))
            for j, at in enumerate(reach):
                window[row[at], j] = numbers[at + j]
            held.setdefault(lang, []).append(window)
            used = np.unique(np.concatenate([used, window[:, 0]]))  # every word of a window begins one
            n += len(window)
            if n >= GATHER or len(words) > WORDS:
                yield from flush()
                n = 0
            if len(words) > WORDS:
                yield from dictionary()
                words.forget()
                used = used[:0]
        yield from flush()
        yield from dictionary()
        for lang, total in totals.items():
            yield sent(2, 0, lang, np.zeros(0), np.array([total]))

    types = [pa.int32(), pa.string(), *[pa.int64()] * (longest + 1), pa.string()]
    names = ["kind", "lang", *lead, "c", "word"]

    def rows(kind: int, n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, t) if c == "kind" else given.get(c, pa.nulls(n, t))
                                           for c, t in zip(names, types)], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, often, n, texts, total = None, [], [], 0, {}, 0

        def merged() -> None:
            if len(keys) > 1:
                window, place = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
                keys[:], often[:] = [window], [np.bincount(place.ravel(), weights=np.concatenate(often)).astype(np.int64)]

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal keys, often, texts, total
            if keys:
                merged()
                cols = {name: pa.array(keys[0][:, j], pa.int64(), mask=keys[0][:, j] == 0) for j, name in enumerate(lead)}
                yield rows(0, len(keys[0]), lang=pa.array([last[2]] * len(keys[0]), pa.string()), c=pa.array(often[0]), **cols)
            if texts:
                yield rows(1, len(texts), w1=pa.array([h for h, _ in texts], pa.int64()), word=pa.array([w for _, w in texts], pa.string()))
            if total:
                yield rows(2, 1, lang=pa.array([last[2]], pa.string()), c=pa.array([total], pa.int64()))
            keys, often, texts, total = [], [], {}, 0

        for batch in batches:
            for kind, part, lang, k, c, w in zip(*[batch.column(x) if x in ("keys", "often") else batch.column(x).to_pylist()
                                                   for x in ("kind", "part", "lang", "keys", "often", "words")]):
                if (kind, part, lang) != last:
                    yield from close()
                    last, n = (kind, part, lang), 0
                k, c = np.frombuffer(k.as_buffer(), "<i8"), np.frombuffer(c.as_buffer(), "<i8")
                if kind == 0:
                    keys.append(k.reshape(-1, longest))
                    often.append(c)
                    n += len(c)
                    if n > GATHER:  # bounds what waits to be added up
                        merged()
                        n = 0
                elif kind == 1:
                    texts.update(dict.fromkeys(zip(k.tolist(), w)))
                else:
                    total += int(c.sum())
        yield from close()

    lists = src.mapInArrow(count, "kind int, part int, lang string, keys binary, often binary, words array<string>")
    by = ["kind", "part", "lang"]
    return (lists.repartition(*by).sortWithinPartitions(*by)
            .mapInArrow(add, f"kind int, lang string, {', '.join(f'{w} long' for w in lead)}, c long, word string"))


def _distinct(window: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs. Numbers are packed side by side where they fit, three to a key."""
    bits = max(1, int(words).bit_length())
    if 3 * bits > 63:
        return np.unique(window, axis=0, return_counts=True)
    keys = []
    for a in range(0, window.shape[1], 3):
        key = np.zeros(len(window), dtype=np.int64)
        for j in range(a, min(a + 3, window.shape[1])):
            key = key << bits | window[:, j]
        keys.append(key)
    rest = np.any([k != 0 for k in keys[1:]], axis=0) if len(keys) > 1 else np.zeros(len(window), dtype=bool)
    short, first, often = np.unique(keys[0][~rest], return_index=True, return_counts=True)
    out, counts = [window[~rest][first]], [often]
    if rest.any():
        part = [k[rest] for k in keys]
        order = np.lexsort(part[::-1])
        new = np.append(True, np.any([np.diff(k[order]) != 0 for k in part], axis=0))
        at = np.flatnonzero(new)
        out.append(window[rest][order[at]])
        counts.append(np.diff(np.append(at, len(order))))
    return np.concatenate(out), np.concatenate(counts)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text",
                  lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of 1 to ``longest`` words with ``least`` occurrences or more, their words as hashes;
    (w, word) behind the hashes; and (lang, n), the number of all word occurrences."""
    spark = docs.sparkSession
    src = columns(docs, *dict.fromkeys([text_col, lang_col]))
    src = src.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    src = src.filter("text is not null")
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(max(total // PART_BYTES, 8), 4096))
    size = int(min(max(1 << int(np.ceil(np.log2(max(total * PER_BYTE, 1)))), FEWEST), MOST))
    lead = [f"w{j}" for j in range(1, longest + 1)]
    seed = 0
    while True:
        seen: dict[int, np.ndarray] = {}
        for orders in ((1, 2), (3,)):
            orders = tuple(k for k in orders if k <= longest)
            if orders:
                shared = spark.sparkContext.broadcast(seen)
                seen = {**seen, **_count_grams(src, orders, size, shared, least, seed)}
        made = materialize(_windows(src, size, spark.sparkContext.broadcast(seen), seed, longest, parts), "op12-windows")
        words = made.filter("kind = 1").groupBy(F.col("w1").alias("w")).agg(
            F.min("word").alias("word"), (F.min("word") != F.max("word")).alias("shared"))
        words = materialize(words, "op12-words")
        if words.filter("shared").isEmpty():
            break
        seed += 1
    summed = made.filter("kind = 0").rollup("lang", *lead).agg(F.sum("c").alias("f"), F.grouping_id().alias("left_out"))
    # a prefix of k words leaves out longest - k columns; a window padded before that has no such phrase
    k = F.lit(longest) - F.bit_count("left_out")
    phrases = (summed.filter(F.col("f") >= least).withColumn("k", k).filter("k >= 1 and k <= " + str(longest))
               .withColumn("words", F.slice(F.array(*lead), F.lit(1), F.col("k")))
               .filter(F.element_at("words", -1).isNotNull()).select("lang", "words", "f"))
    totals = made.filter("kind = 2").groupBy("lang").agg(F.sum("c").alias("n"))
    return materialize(phrases, "op12-phrases"), words.select("w", "word"), totals


# ---------------------------------------------------------------- collocations

def _score(scale: int) -> Column:
    """floor(scale * a * n / (l * r)), whole numbers of up to 38 digits divided without a remainder's digits."""
    up = F.col("a").cast("decimal(18,0)") * (F.col("n") * scale).cast("decimal(19,0)")
    down = F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")
    return F.call_function("div", up, down)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, percent: int = PERCENT,
                 scale: int = SCALE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase with a >= ``least`` occurrences is cut in two where floor(scale * a * n / (l * r)) is lowest (ties: the first
    such cut). Phrases inside a longer one with 100 * f(longer) >= percent * a are dropped. Order: score, then a, falling,
    then the phrase in UTF-8 byte order.

    Defined cases: null and empty texts have no words; a null language is ``und``, together with rows that say so; repeated rows
    count as often as they occur; a text without separators is one piece, worked on as a whole; a language with no phrase, and an
    empty table, give no rows.
    """
    phrases, words, totals = phrase_counts(docs, longest, least, text_col, lang_col)
    candidates = phrases.filter(F.size("words") > 1).withColumnRenamed("f", "a")
    k = F.size("words")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), k - 1)))
    cuts = cuts.withColumn("left_words", F.slice("words", F.lit(1), F.col("cut"))).withColumn(
        "right_words", F.slice("words", F.col("cut") + 1, k - F.col("cut")))
    for side, name in (("left_words", "l"), ("right_words", "r")):
        part = phrases.select(F.col("lang").alias("_lang"), F.col("words").alias("_words"), F.col("f").alias(name))
        cuts = cuts.join(part, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_words"))).drop("_lang", "_words")
    cuts = cuts.join(F.broadcast(totals), "lang").withColumn("score", _score(scale).cast("long"))  # a row per language
    scored = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"), F.first("a").alias("a"),
                                               F.first("n").alias("n"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda size: F.transform(
        F.sequence(F.lit(1), k - size + 1), lambda start: F.slice("words", start, size))))
    inside = (phrases.filter(F.size("words") > 2).select("lang", "f", F.explode(inner).alias("words"))
              .groupBy("lang", "words").agg(F.max("f").alias("longer")))
    kept = (scored.join(inside, ["lang", "words"], "left")
            .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)))
    # those that can be among the first, ties included, get their words; only these are needed for the rest of the order
    by_score = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"))
    near = materialize(kept.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top), "op12-near")
    spelled = (near.select("lang", "words", F.posexplode("words").alias("pos", "w")).join(words, "w").groupBy("lang", "words")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
                    .alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    return (near.join(spelled, ["lang", "words"]).withColumn("rank", F.row_number().over(order).cast("long"))
            .filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
                    F.col("best.score").alias("score")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = {"op12_collocations": """
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
), q as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p
), g as (
  select lang, w[i:i + k - 1] as words, count(*) as f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from q, (values (1), (2), (3), (4), (5)) t(k) where len(w) >= k)
  group by all
), t as (select lang, sum(f)::BIGINT as n from g where len(words) = 1 group by all
), c as (select * from g where len(words) > 1 and f >= 100
), cut as (
  select c.lang, c.words, c.f as a, x.k, l.f as l, r.f as r, t.n,
         ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT as score
  from c join (values (1), (2), (3), (4)) x(k) on x.k < len(c.words)
  join g l on l.lang = c.lang and l.words = c.words[1:x.k] join g r on r.lang = c.lang and r.words = c.words[x.k + 1:]
  join t on t.lang = c.lang
), best as (select * from cut qualify row_number() over (partition by lang, words order by score, k) = 1
), inner_ as (
  select lang, words[i:i + k - 1] as words, max(f) as longer
  from (select lang, words, f, k, unnest(range(1, len(words) - k + 2)) as i
        from c, (values (2), (3), (4)) t(k) where k < len(words)) group by all
), kept as (
  select best.*, array_to_string(best.words, ' ') as phrase from best left join inner_ using (lang, words)
  where longer is null or 100 * longer < 100 * a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= 2000
"""}
