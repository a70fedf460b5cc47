"""Odd rows and empty tables through the operators on documents; brute-force results on small tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, mixing, near_dedup, quality, search, sharding, tokens

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def source_rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


# ---------------------------------------------------------------- sharding

def test_shards_are_contiguous_and_balanced(odd_docs):
    got = sorted(rows_of(sharding.shard_by_bytes(odd_docs, 4)),
                 key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    want = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in source_rows(odd_docs))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in got] == want
    total, before = sum(r["size"] for r in got), 0
    slots = {}
    for r in got:
        assert r["shard"] == min(3, (2 * before + r["size"]) * 4 // (2 * total))
        assert r["slot"] == slots.get(r["shard"], 0)
        slots[r["shard"]] = r["slot"] + 1
        before += r["size"]


def test_shards_of_nothing(no_docs):
    assert rows_of(sharding.shard_by_bytes(no_docs)) == []


# ---------------------------------------------------------------- token files

@pytest.mark.parametrize("high", [0, 1, 200, 70_000, 2 ** 40, 2 ** 64 - 1])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_packed_column_round_trip(n, high):
    v = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64, endpoint=True)
    v[::97] = high
    data = tokens.pack_column(v)
    got, end = tokens.unpack_column(memoryview(data), 0)
    assert (got == v).all() and end == len(data)
    if n > 1000:
        assert (tokens.unpack_column(memoryview(data), 0, 700, 150)[0] == v[700:850]).all()


def test_exceptions_keep_blocks_narrow():
    v = np.full(512, 3, dtype=np.uint64)
    v[7] = 2 ** 50
    assert len(tokens.pack_column(v)) < 150


@pytest.mark.parametrize("segment", [50, 1 << 20])
def test_token_files_match_the_library(odd_docs, segment):
    path = public_tokenizers.path(BYTES)
    got = rows_of(tokens.read_segments(tokens.encode_to_segments(odd_docs, path, segment_ids=segment)))
    tok = library(BYTES)
    want = {}
    for i, t in source_rows(odd_docs):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == list(np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1])
    ids = [r["doc_id"] for r in ordered]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_token_files_of_nothing(no_docs):
    assert rows_of(tokens.token_files(no_docs, public_tokenizers.path(BYTES))) == []


ODD = ["it's we'll I'VE 'tis", "a<|endoftext|>b <|endoftext|> c<|endoftext", "tabs\t\tand\n\n\nlines \n x", "\x1cfoo\x1d bar", "İstanbul ΣΑΣ é ﬁ",
       "</w> a</w>", "123 4.5e6 ²½", "aaaaaaaa bababababab Llllllos", " lead", "trail ", "x​‍y", "́a ́", "_under_ __", "日本語 हिन्दी"]


def test_chunked_encoding_matches_the_library():
    enc, tok = tokens.ChunkEncoder(public_tokenizers.path(BYTES)), library(BYTES)
    for t in ODD:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


# ---------------------------------------------------------------- word BPE

def merged(word, ranks):
    """Plain byte-pair encoding: always merge the pair of lowest rank, leftmost first."""
    w = list(word)
    while len(w) > 1:
        rank, i = min((ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(w, w[1:])))
        if rank == 1 << 60:
            return w
        w[i:i + 2] = [w[i] + w[i + 1]]
    return w


def test_automaton_equals_merging():
    rng = random.Random(4)
    for _ in range(60):
        vocab, merges = list("abc"), []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice(vocab), rng.choice(vocab)
            if a + b not in vocab:
                merges.append((a, b))
                vocab.append(a + b)
        automaton, ranks = bpe.TokenAutomaton(list("abc"), merges), {m: k for k, m in enumerate(merges)}
        for _ in range(40):
            word = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            assert automaton.encode(word) == merged(word, ranks), (merges, word)
        for state in set(automaton.target):
            for label in range(len(automaton.label)):
                assert automaton.has_arc(state, label) == automaton._walk(state, label)


def test_words_match_the_library():
    mine, tok = bpe.WordBpe(public_tokenizers.path(WORDS)), library(WORDS)
    for t in ODD:
        ids = mine.encode(t)
        decoded = mine.decode(ids)
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert decoded == tok.decode(want, skip_special_tokens=False)


def test_bpe_operator(odd_docs, no_docs):
    path, tok = public_tokenizers.path(WORDS), library(WORDS)
    got = rows_of(bpe.bpe_encode(odd_docs, path))
    want = []
    for i, t in source_rows(odd_docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert rows_of(bpe.bpe_encode(no_docs, path)) == []


# ---------------------------------------------------------------- near duplicates

def components_by_hand(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)) if w else frozenset())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = [[rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None] for i in range(len(rows))]
    return [(rows[i][0], len(sets[i]), min(ids[i], default=None)) for i in range(len(rows))]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def near_copies(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocab) for _ in range(60)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(60)] = rng.choice(vocab)
        out.append((i, " ".join(words)))
    return out + [(n + i, " ".join(rng.choice(vocab) for _ in range(50))) for i in range(n // 2)]


@pytest.mark.parametrize("leaf", [800, 12])
def test_near_duplicates_by_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(near_dedup, "LEAF_ROWS", leaf)
    monkeypatch.setattr(near_dedup, "LEVELS", 24 if leaf > 100 else 3)  # the second run also reaches the block comparison
    rows = near_copies(60)
    got = rows_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85))
    assert order([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got]) == order(components_by_hand(rows, 3, 85))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_borderline_pairs_in_a_deep_node(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF_ROWS", 20)
    monkeypatch.setattr(near_dedup, "TREES", (1, 1))  # as much too few for six levels as (2, 10) are for 24
    monkeypatch.setattr(near_dedup, "LEVELS", 6)
    rows = []
    for pair in range(120):  # 168 words are everybody's, 10 the pair's, 22 the document's own: 178 of 222
        shared = [f"all{i}" for i in range(168)] + [f"pair{pair}x{i}" for i in range(10)]
        rows += [(2 * pair + j, " ".join(shared + [f"own{pair}x{j}x{i}" for i in range(22)])) for j in (0, 1)]
    got = rows_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=80))
    assert all(r["component_id"] == r["doc_id"] - r["doc_id"] % 2 for r in got if not r["kept"])
    assert sum(not r["kept"] for r in got) >= 0.95 * 120


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = source_rows(odd_docs)
    got = rows_of(near_dedup.near_duplicates(odd_docs, k=3, percent=85))
    assert order([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got]) == order(components_by_hand(rows, 3, 85))
    assert rows_of(near_dedup.near_duplicates(no_docs)) == []


def test_deduplicate_keeps_one_row_of_each_group(odd_docs):
    got = near_dedup.deduplicate(odd_docs, k=3, percent=85)
    assert got.columns == odd_docs.columns
    texts = [r.text for r in got.collect()]
    assert sum(t is not None and t.lower() == "a b c d e f g h" for t in texts) == 1
    assert None in texts and "" in texts and "one" in texts


# ---------------------------------------------------------------- quality

def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    per = np.array([1, 4, 6, 2])
    unary, trans = rng.normal(size=per.sum()), rng.normal(size=(2, 2))
    got, expected = quality._forward_backward(unary, trans, per, pairs=True)
    want, moves, at = [], np.zeros((2, 2)), 0
    for n in per:
        mass, good = 0.0, np.zeros(n)
        pair = np.zeros((2, 2))
        for code in range(2 ** n):
            y = [(code >> i) & 1 for i in range(n)]
            p = np.exp(sum(unary[at + i] for i in range(n) if y[i]) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            mass += p
            good += p * np.array(y)
            for a, b in zip(y, y[1:]):
                pair[a, b] += p
        want += (good / mass).tolist()
        moves += pair / mass
        at += n
    assert np.allclose(got, want) and np.allclose(expected, moves)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.train(docs, labels)
    scored = quality.score(docs, field).join(labels, "doc_id").filter(quality.held_out("doc_id")).collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.95
    good = [r.score for r in scored if r.quality == 1]
    bad = [r.score for r in scored if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    kept = quality.keep_good(docs, field)
    assert kept.columns == docs.columns
    assert kept.count() == quality.score(docs, field).filter("predicted = 1").count()


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (10, 0, 0), (11, 1, 0), (None, 1, 0), (3, None, 0), (999, 1, 0), (10, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    field = quality.train(odd_docs, labels)
    got = rows_of(quality.score(odd_docs, field))
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    none = quality.train(odd_docs, labels.limit(0))
    assert none is None and {r["score"] for r in rows_of(quality.score(odd_docs, none))} == {0.5}
    assert rows_of(quality.score(no_docs, field)) == []


# ---------------------------------------------------------------- mixing

def targets_by_hand(sizes):
    """Share by weight, cut what is above, reshare until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = budget - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2.0 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mix_meets_targets(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    got = rows_of(mixing.mix_rows(docs))
    again = rows_of(mixing.mix_rows(docs.repartition(7)))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_hash"], r["source"] or "", r["copies"])
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(again, key=key)]
    assert len(got) == docs.count()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    target = targets_by_hand(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s] for r in own)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in own)
        if sizes[s]:
            assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own) / 2 + 1


def test_mix_repeats_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs)
    assert got.columns == odd_docs.columns
    want = sum(r["copies"] for r in rows_of(mixing.mix_rows(odd_docs)))
    assert got.count() == want
    assert rows_of(mixing.mix_rows(no_docs)) == [] and mixing.mix(no_docs).count() == 0


def test_full_sets_move_once_and_tokens_of_large_nodes_only(spark, monkeypatch):
    written, write = {}, near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: (written.update({name: df.columns}), write(df, name))[1])
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o p {i // 2} {'z' * (i % 2)}") for i in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, k=1, percent=80).collect()}
    assert set(got) == set(range(40)) and all(got[i] == got[i - i % 2] for i in got)
    assert not [name for name, columns in written.items() if "shingles" in columns]

    classes = spark.createDataFrame([(c, 3, near_dedup.min_tokens(np.arange(c, c + 3, dtype=np.uint64) << np.uint64(40)).tobytes())
                                     for c in range(2000)], "cls long, n long, tokens binary")
    rows = spark.createDataFrame([(7, c, 3) for c in range(0, 2000, 100)], "node long, cls long, n long")
    inside = {r["cls"] for r in near_dedup._possible(classes, rows, "cls").collect()}
    assert set(range(0, 2000, 100)) <= inside and len(inside) < 200
    level = near_dedup._next_level(rows, classes, 0.85)
    assert {r["cls"] for r in level.collect()} == set(range(0, 2000, 100))
    assert "bitmap_construct_agg" in level._jdf.queryExecution().toString()


# ---------------------------------------------------------------- search

def test_search_by_brute_force(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 40)  # several shards a task
    monkeypatch.setattr(search, "BLOCK_TERMS", 300)
    rng = random.Random(6)
    vocab = [f"t{int(rng.paretovariate(0.6)) % 500}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    rows += [(i, t) for i, t in source_rows(odd_docs) if i is not None]
    queries = [(i, t) for i, t in rows if i % 50 == 0]
    got = rows_of(search.search(docs, spark.createDataFrame(queries, "query_id long, text string"), k=5))
    bags = [(i, (t or "").encode().lower().split()) for i, t in rows]
    n, mean = len(bags), sum(len(w) for _, w in bags) / len(bags)
    df = {}
    for _, w in bags:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    want = []
    for q, t in queries:
        score = []
        terms = (t or "").encode().lower().split()
        for i, w in bags:
            s = sum(np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean))
                    for x in terms if x in df and x in w)
            if s > 0:
                score.append((-round(float(s), 6), i))
        want += [(q, i, -s) for s, i in sorted(score)[:5]]
    key = lambda r: (r[0], -r[2], r[1])
    have = sorted([(r["query_id"], r["doc_id"], round(r["score"], 6)) for r in got], key=key)
    assert len(have) == len(want)
    assert np.allclose([r[2] for r in have], [r[2] for r in sorted(want, key=key)], atol=1e-5)
    assert rows_of(search.search(no_docs, no_docs, query_id_col="doc_id")) == []
    assert {r["rank"] for r in got} <= {1, 2, 3, 4, 5}
