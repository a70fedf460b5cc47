"""Operator 3: near-duplicate documents by a chosen-path set similarity join, confirmed on full sets.

A document is the set of its distinct word shingles (64-bit hashes). Equal sets form one class, so copies are
never compared. The classes are joined by random trees:

* a class carries T minwise tokens (the set embedded in T coordinates). A node of a tree chooses one coordinate,
  and with probability 1/similarity - 1 a second one; a class goes down to the child named by its token
  there. Two sets of the wanted similarity thus meet in about one child per level, however deep the tree.
* a node with few members is a leaf: its members are compared exhaustively, first by their T tokens, which
  discards pairs far below the wanted similarity, then on the full sets.
* larger nodes branch again. A node that is still large at the last level is compared exhaustively too, in blocks.
* independent trees are repeated. The first few run alone: what they connect needs no further comparison,
  so the remaining trees look only at pairs from different components.
* a pair's chance in one tree falls with the level at which its node gets small. Classes that were in large nodes
  so deep that the trees so far miss the target recall go through further trees, as many as their depth needs.

A leaf returns links that connect its members (at most one a member), never all its pairs.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, columns, groups, materialize, read, string_column
from quarry.llm.graph import components

#: Coordinates of the embedding, trees of the first and second run, most trees of a further run, deepest level.
TOKENS = 128
TREES = (2, 10)
MORE_TREES = 10
LEVELS = 24
#: Chance to be found of a pair of just the wanted similarity, however deep the nodes that it stays in.
RECALL = 0.95
#: A leaf has at most this many members and shingles in all.
LEAF_ROWS = 1600
LEAF_SHINGLES = 2_000_000
#: Pairs whose share of equal tokens is this far below the wanted similarity are not compared in full (over five
#: standard deviations of the estimate at TOKENS = 128).
SLACK = 0.18
WORD_MEMO = 400_000

_U = np.uint64
_ODD = np.random.default_rng(7).integers(1, 2 ** 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_MUL = np.random.default_rng(8).integers(1, 2 ** 31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(9).integers(0, 2 ** 32, TOKENS, dtype=np.uint32)


def _mix(x):
    """A bijective scramble of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> _U(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str, k: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of the text with A-Z lower-cased; with fewer words the
    whole sequence is one shingle; without words there is none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    size = min(k, n)
    with np.errstate(over="ignore"):
        total = h[:n - size + 1] * _ODD[0]
        for j in range(1, size):
            total = total + h[j:n - size + 1 + j] * _ODD[j]
    return np.unique(_mix(total + _U(size)))


def min_tokens(values: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate, as 32-bit hash values."""
    x = (values >> _U(32)).astype(np.uint32)
    best = np.full(TOKENS, 2 ** 32 - 1, dtype=np.uint32)
    for k in range(0, len(x), 1024):
        best = np.minimum(best, (x[k:k + 1024, None] * _MUL + _ADD).min(axis=0))
    return best


# ---------------------------------------------------------------- trees

def _children(node: np.ndarray, tokens: np.ndarray, similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(member, child) pairs: the one or two coordinates that each node chooses, applied to its members."""
    rows = np.arange(len(node))
    first = (_mix(node + _U(1)) % _U(TOKENS)).astype(np.int64)
    second = (first + 1 + (_mix(node + _U(2)) % _U(TOKENS - 1)).astype(np.int64)) % TOKENS
    twice = _mix(node + _U(3)).astype(np.float64) / 2.0 ** 64 < 1.0 / similarity - 1.0

    def child(at, coord):
        name = (coord[at].astype(np.uint64) << _U(32)) | tokens[at, coord[at]].astype(np.uint64)
        return at, _mix(_mix(node[at]) ^ _mix(name))
    return [child(rows, first), child(rows[twice], second)]


@functools.lru_cache(maxsize=None)
def trees_needed(depth: int, similarity: float, recall: float = RECALL) -> int:
    """Trees until a pair of the wanted similarity has met at level ``depth`` of one of them with chance ``recall``.

    Both go on to a common child by the first coordinate and, in a share of nodes, by a second one, if their tokens
    are equal there; the share of equal tokens, the same for all trees, is binomial."""
    equal = np.arange(TOKENS + 1)
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, TOKENS + 1)))])
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = np.exp(log_fact[-1] - log_fact - log_fact[::-1] + equal * np.log(similarity)
                        + np.where(equal == TOKENS, 0.0, (TOKENS - equal) * np.log1p(-similarity)))
    share, lost = equal / TOKENS, np.zeros(TOKENS + 1)
    for _ in range(depth):
        lost = (1 - share * (1 - lost)) * (1 - min(1.0, 1 / similarity - 1) * share * (1 - lost))
    trees = 1
    while (chance * lost ** trees).sum() > 1 - recall + 1e-12:
        trees += 1
    return trees


def _token_matrix(column: pa.Array, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), TOKENS)


def _sketches(classes: DataFrame) -> DataFrame:
    """(cls, sketch): the low byte of every token, which is all that leaves compare."""
    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _token_matrix(batch.column("tokens")).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([t.tobytes() for t in tokens], pa.binary())],
                                             names=["cls", "sketch"])

    return materialize(classes.select("cls", "tokens").mapInArrow(low, "cls long, sketch binary"), "op3-sketches")


_NODE = pa.schema([("node", pa.int64()), ("cls", pa.int64()), ("n", pa.int64())])


def _node_batch(node, cls, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(cls), pa.array(n)], schema=_NODE)


def _first_level(classes: DataFrame, trees: range, similarity: float) -> DataFrame:
    roots = [int(_mix(_U(1000 + t))) for t in trees]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _token_matrix(batch.column("tokens"))
            cls, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "n"))
            for root in roots:
                for at, child in _children(np.full(len(cls), root, dtype=np.uint64), tokens, similarity):
                    yield _node_batch(child, cls[at], n[at])

    return classes.select("cls", "n", "tokens").mapInArrow(split, "node long, cls long, n long")


def _next_level(rows: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _token_matrix(batch.column("tokens"))
            node, cls, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "cls", "n"))
            for at, child in _children(node.view(np.uint64), tokens, similarity):
                yield _node_batch(child, cls[at], n[at])

    # large nodes hold a part of the classes: the tokens of the others stay where they are
    inside = _possible(classes.select("cls", "tokens"), rows.select("cls").distinct(), "cls")
    return (rows.join(inside, "cls").select("node", "cls", "n", "tokens")
            .mapInArrow(split, "node long, cls long, n long"))


def _leaves(classes: DataFrame, trees: range, similarity: float, deep: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, cls, n) of all leaves with two or more members, and (cls, depth) of the classes in nodes that branch to
    level ``deep`` or deeper, if there are any."""
    rows, leaves, far = _first_level(classes, trees, similarity), None, None
    for level in range(1, LEVELS + 1):
        rows = materialize(rows, f"op3-level{level}")
        sizes = (rows.groupBy("node").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_n")).filter("_rows > 1"))
        kept = materialize(rows.join(sizes, "node").withColumn(
            "leaf", ((F.col("_rows") <= LEAF_ROWS) & (F.col("_n") <= LEAF_SHINGLES)) | (F.col("_rows") == 2)),
            f"op3-nodes{level}")
        here = kept.filter("leaf").select("node", "cls", "n")
        leaves = here if leaves is None else leaves.union(here)
        large = kept.filter("not leaf")
        if large.isEmpty():
            return leaves, far
        depth = min(level + 1, LEVELS)
        if depth >= deep:
            here = large.select("cls", F.lit(depth).alias("depth")).distinct()
            far = here if far is None else far.union(here)
        rows = _next_level(large, classes, similarity)
    return leaves.union(_blocks(large)), far


def _blocks(large: DataFrame) -> DataFrame:
    """Nodes that did not get small: every pair of their blocks is a leaf of its own."""
    parts = F.greatest(F.ceil(F.col("_rows") * 2.0 / LEAF_ROWS), F.ceil(F.col("_n") * 2.0 / LEAF_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("cls"), F.col("_parts")).cast("int")
    pair = (large.withColumn("_parts", F.greatest(parts, F.lit(2))).withColumn("_own", own)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))))
    return pair.select(F.xxhash64("node", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("node"), "cls", "n")


# ---------------------------------------------------------------- leaves

def _close_members(rows: DataFrame, similarity: float) -> DataFrame:
    """Members of sorted leaves (node, cls, n, comp, sketch) that have, in another component, a partner whose size
    and tokens allow the wanted similarity, in the groups that such partners connect. A group is named by its members, so
    one that is met in several trees is compared in full once."""
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf in groups(batches, "node"):
            comp = leaf.column("comp").to_numpy()
            if len(comp) < 2 or (comp == comp[0]).all():
                continue
            n, cls = leaf.column("n").to_numpy(), leaf.column("cls").to_numpy()
            tokens = _token_matrix(leaf.column("sketch").combine_chunks(), "u1")
            hit, group = np.zeros(len(cls), dtype=bool), np.arange(len(cls))
            for i in range(len(cls) - 1):
                rest = slice(i + 1, None)
                near = ((np.minimum(n[rest], n[i]) >= similarity * np.maximum(n[rest], n[i]) - 1e-9)
                        & (comp[rest] != comp[i]))
                at = np.flatnonzero(near) + i + 1
                if len(at):
                    at = at[(tokens[at] == tokens[i]).mean(axis=1) >= similarity - SLACK]
                    if len(at):
                        hit[at] = hit[i] = True
                        joined = np.append(group[at], group[i])
                        if (joined != joined[0]).any():
                            group[np.isin(group, joined)] = joined.min()
            if hit.any():
                node, at = np.zeros(len(cls), dtype=np.int64), np.flatnonzero(hit)
                for g in np.unique(group[at]).tolist():
                    members = at[group[at] == g]
                    node[members] = xxhash.xxh3_64_intdigest(np.sort(cls[members]).tobytes()) - 2 ** 63
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(cls[at]), pa.array(comp[at])], names=["node", "cls", "comp"])

    return (rows.select("node", "cls", "n", "comp", "sketch").repartition("node").sortWithinPartitions("node")
            .mapInArrow(close, "node long, cls long, comp long"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    m = len(sets)
    out = np.zeros((m, m), dtype=np.float64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[token] > 1
    owner, token = owner[shared], token[shared]
    if not len(token):
        return out
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    kinds = int(token[-1]) + 1
    step = min(kinds, max(1, 4_000_000 // m))
    for lo in range(0, kinds, step):
        a, b = np.searchsorted(token, [lo, lo + step])
        has = np.zeros((m, min(step, kinds - lo)), dtype=np.float32)
        has[owner[a:b], token[a:b] - lo] = 1.0
        out += has @ has.T
    return out


def _confirmed_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the members of each leaf whose full sets meet 100 * both >= percent * either."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf in groups(batches, "node"):
            cls = leaf.column("cls").to_numpy()
            if len(cls) < 2:
                continue
            sets = [np.frombuffer(s, dtype="<u8") for s in leaf.column("shingles").to_pylist()]
            n = np.array([len(s) for s in sets], dtype=np.float64)
            both = overlaps(sets)
            linked = 100.0 * both >= percent * (n[:, None] + n[None, :] - both)
            np.fill_diagonal(linked, False)
            seen = np.zeros(len(cls), dtype=bool)
            a, b = [], []
            for i in range(len(cls)):  # breadth-first: a link for every member that is reached
                if seen[i]:
                    continue
                seen[i], queue = True, [i]
                while queue:
                    j = queue.pop()
                    new = np.flatnonzero(linked[j] & ~seen)
                    seen[new] = True
                    a += [cls[j]] * len(new)
                    b += cls[new].tolist()
                    queue += new.tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (rows.select("node", "cls", "shingles").repartition("node").sortWithinPartitions("node")
            .mapInArrow(confirm, "a long, b long"))


def _with_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(node, cls, shingles): ``wanted`` (node, cls) with the full sets, from the text of each class's first document. The sets
    are dealt by their keys, and ``wanted`` is sent to them: they move once more only, to their nodes."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            values = [shingle_set(t, k, hashes) for t in string_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(v) for v in values], pa.binary()), pa.array([v.astype("<u8").tobytes() for v in values], pa.binary())],
                names=["set_key", "shingles"])

    own = materialize(wanted.select("node", "cls").join(classes.select("cls", "set_key", "doc_id"), "cls"), "op3-wanted")
    # a text of any document with the set will do; the join on the set, which is as large as the text, is the first shuffle
    found = _possible(docs, own.select("cls", "doc_id").distinct(), "doc_id").select("text").mapInArrow(sets, "set_key binary, shingles binary")
    found = found.join(own.select("set_key").distinct(), "set_key").groupBy("set_key").agg(F.first("shingles").alias("shingles"))
    return found.join(own, "set_key").select("node", "cls", "shingles")


def _possible(rows: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """``rows`` less those whose ``key`` is not among those of ``own``, by a bit per hashed key, so that texts need no shuffle
    to meet ``own``: bitmaps of 4 KB, 16 bits per wanted key and 64 MB in all at most, so their broadcast is bounded. Rows that
    pass by chance cost time only: what they are joined with afterwards is exact."""
    maps = min(max(own.count() * 16 // 32768, 64), 16384)
    place = F.pmod(F.xxhash64(key), F.lit(maps * 32768))
    bits = own.select((F.floor(place / 32768)).cast("int").alias("_bucket"), F.pmod(place, F.lit(32768)).alias("_bit"))
    bitmaps = F.broadcast(bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap")))
    marked = rows.withColumn("_at", F.pmod(place, F.lit(32768)).cast("int")).withColumn("_in", F.floor(place / 32768).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(_bitmap, _at div 8 + 1, 1)")), 16, 10).cast("int")
    set_ = F.getbit(byte, F.pmod("_at", F.lit(8))) == 1
    return marked.join(bitmaps, F.col("_in") == F.col("_bucket")).filter(set_).select(*rows.columns)


def _key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """Link documents whose sets of ``k``-word shingles have at least ``percent`` % of their union in common, and
    return per row: doc_id, n_shingles, component_id (smallest id reachable), kept (it is that one), text_hash, and
    stays (it is the first row of its component, also where ids repeat). A pair of just ``percent`` % is found with a
    chance of at least ``recall`` (below 1), a closer one with a higher chance.

    Defined cases: null and empty texts and texts of white space have an empty set and stay alone; a text with
    fewer than ``k`` words is one shingle; rows with equal sets share a component; rows that repeat an id
    are documents of their own that report the same id (each whose id is the component's is kept); among null ids
    a component without any other id has a null component and is kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    similarity = percent / 100.0
    docs = columns(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                                                  text_hash(F.col(text_col)).alias("text_hash"))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t, k, hashes) for t in string_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_key(s) for s in sets], pa.binary()),
                 pa.array([min_tokens(s).astype("<u4").tobytes() for s in sets], pa.binary())],
                names=["doc_id", "text_hash", "n", "set_key", "tokens"])

    embedded = materialize(docs.mapInArrow(embed, "doc_id long, text_hash long, n long, set_key binary, tokens binary"),
                           "op3-sets")
    full = embedded.filter("n > 0")
    # the first document of a group: null ids last, then the smallest id, set and text
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_key", "text_hash")
    classes = materialize(full.groupBy("set_key").agg(F.min(first).alias("first"), F.first("n").alias("n"),
                                                      F.first("tokens").alias("tokens"))
                          .select("set_key", "first", F.col("first.doc_id").alias("doc_id"), "n", "tokens")
                          .withColumn("cls", F.monotonically_increasing_id()), "op3-classes")

    sketches = _sketches(classes)
    edges, comp, start, far = None, None, 0, None
    #: the least depth for which the trees of the first two runs are too few
    deep = next((d for d in range(1, LEVELS + 1) if trees_needed(d, similarity, recall) > sum(TREES)), LEVELS + 1)
    runs, part = list(TREES), classes
    while runs:
        trees = runs.pop(0)
        leaves, deeper = _leaves(part, range(start, start + trees), similarity, deep)
        start += trees
        members = leaves.join(sketches, "cls")
        if comp is not None:
            members = members.join(comp.select(F.col("v").alias("cls"), "label"), "cls", "left")
        label = F.coalesce("label", "cls") if comp is not None else F.col("cls")
        close = materialize(_close_members(members.withColumn("comp", label), similarity).distinct(), "op3-close")
        links = materialize(_confirmed_links(_with_sets(close, docs, classes, k), percent).distinct(), "op3-links")
        edges = links if edges is None else edges.union(links)
        comp = components(edges, "op3-comp")
        if deeper is not None:
            far = materialize((deeper if far is None else far.union(deeper)).groupBy("cls").agg(F.max("depth").alias("depth")),
                              "op3-deep")
        if not runs and far is not None:
            # a pair's common nodes are no deeper than either class was: both go on until that depth is paid for
            most = trees_needed(far.agg(F.max("depth")).first()[0], similarity, recall)
            if most > start:
                short = [d for d in range(deep, LEVELS + 1) if trees_needed(d, similarity, recall) > start]
                part = materialize(classes.join(far.filter(F.col("depth").isin(short)), "cls", "left_semi"), "op3-again")
                runs = [min(MORE_TREES, most - start)]

    named = classes.select("cls", "set_key", "first").join(comp, F.col("cls") == F.col("v"), "left")
    named = named.select("set_key", "first", F.coalesce("label", "cls").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("_first"))
    by_set = named.join(least, "label").select("set_key", F.col("_first.doc_id").alias("component_id"),
                                               F.col("_first.set_key").alias("_set"), F.col("_first.text_hash").alias("_text"))
    mine = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash"]
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    grouped = full.select("doc_id", "n", "set_key", "text_hash").join(by_set, "set_key").select(
        *mine, kept.alias("kept"), (kept & (F.col("set_key") == F.col("_set")) & (F.col("text_hash") == F.col("_text"))).alias("stays"))
    alone = embedded.filter("n = 0").withColumn("component_id", F.col("doc_id")).select(
        *mine, F.lit(True).alias("kept"), F.lit(True).alias("stays"))
    return grouped.union(alone).select("doc_id", "n_shingles", "component_id", "kept", "text_hash", "stays")


def text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns kept.

    The first row stays: by id, then by a hash of the set and of the text. Rows that repeat both id and text are one
    document; null ids are matched as values.
    """
    stays = near_duplicates(docs, k, percent, id_col, text_col).filter("stays").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    marked = docs.withColumn("_text_hash", text_hash(docs[text_col]))
    same = marked[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_h"))
    one = Window.partitionBy(id_col, "_text_hash").orderBy(id_col)
    return (marked.join(stays, same, "left_semi").withColumn("_n", F.row_number().over(one)).filter("_n = 1")
            .select(*[marked[c] for c in docs.columns]))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)
