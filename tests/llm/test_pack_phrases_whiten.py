"""Packing, collocations and whitening against brute force, with odd rows and empty tables."""

import random
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import collocations, packing, whitening

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- packing

def fewest(items, capacity):
    """Fewest bins by trying every place for every item."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {*bins}:
            if room >= items[i]:
                k = bins.index(room)
                bins[k] -= items[i]
                place(i + 1, bins)
                bins[k] += items[i]
        bins.append(capacity - items[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(150))
def test_bin_completion_finds_the_fewest(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 20, 30, 50])
    items = [r.randint(1, capacity) if seed % 2 else r.randint(capacity // 5, capacity // 2) for _ in range(r.randint(0, 12))]
    counts = Counter(items)
    runs, used = packing.solve(counts, capacity), Counter()
    for filling, times in runs:
        assert sum(length * n for length, n in filling) <= capacity and times > 0
        for length, n in filling:
            used[length] += n * times
    assert used == counts
    assert sum(times for _, times in runs) == fewest(items, capacity) >= packing.lower_bound(counts, capacity)


def test_search_improves_on_best_fit():
    worse = 0
    for seed in range(200):
        r = random.Random(seed)
        counts = Counter(r.randint(6, 25) for _ in range(14))
        worse += sum(t for _, t in packing.best_fit(counts, 50)) > sum(t for _, t in packing.solve(counts, 50))
    assert worse > 0


def test_many_pieces_are_packed_in_bounded_steps():
    r = np.random.default_rng(1)
    counts = Counter(np.minimum(1024, r.lognormal(5.5, 1, 200_000).astype(int) + 1).tolist())
    runs = packing.solve(counts)
    assert sum(t for _, t in runs) <= packing.lower_bound(counts, 1024) * 1.001 and len(runs) < 5000
    places = packing.Places(runs)
    for length, n in counts.items():
        sequence, offset = places.find(np.full(n, length), np.arange(n))
        assert len(set(zip(sequence.tolist(), offset.tolist()))) == n


def check_packed(rows, texts, capacity):
    lib = Tokenizer.from_file(BYTE_BPE)
    by_sequence, ids_of = {}, Counter()
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        ids_of[r.doc_id, bytes(r.ids)] += 1
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    for seq in by_sequence.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = Counter()
    for d, text in texts:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % capacity + 1
        for a, b in zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity)):
            want[d, array("I", ids[a:b]).tobytes()] += 1
    assert ids_of == want


def test_documents_are_packed_whole(spark, odd_docs):
    rows = packing.pack_documents(odd_docs, BYTE_BPE, capacity=64, with_ids=True).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()], 64)
    assert len({r.sequence_id for r in rows}) == packing.lower_bound(Counter(r.length for r in rows), 64)


def test_sequences_hold_the_pieces(spark, odd_docs):
    packed = packing.pack_documents(odd_docs, BYTE_BPE, capacity=128, with_ids=True)
    rows = packed.collect()
    for s in packing.sequences(packed).collect():
        mine = sorted((r for r in rows if r.sequence_id == s.sequence_id), key=lambda r: r.offset)
        assert s.n_tokens == sum(r.length for r in mine) and list(s.starts) == [r.offset for r in mine]


def test_no_documents_pack_to_nothing(no_docs):
    assert packing.pack_documents(no_docs, BYTE_BPE).count() == 0


# ---------------------------------------------------------------- collocations

def brute_collocations(rows, least, top, longest=5):
    import re
    n, f = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        kept = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < least:
                continue
            cuts = [(1000 * a * n[lang] // (counts[phrase[:k]] * counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            if any(len(p) > len(phrase) and b >= a and b >= least and any(p[i:i + len(phrase)] == phrase for i in range(len(p)))
                   for p, b in counts.items()):
                continue
            kept.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows(seed):
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "New", "york", "été", "漢字", "x\x1cy", "b-c", "Ünï"]
    rows = []
    for _ in range(160):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! "]) for _ in range(r.randint(0, 25)))
        rows.append((r.choice(["en", "en", "de", None, "und"]), r.choice([text, text, "in the new york of the east. " * 2])))
    return rows + [("en", None), ("en", ""), (None, " \t "), ("fr", "only once here")]


@pytest.mark.parametrize("seed", range(3))
def test_collocations_equal_brute_force(spark, seed):
    rows = phrase_rows(seed)
    df = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, words string, f long")
    got = collocations.collocations(df, least=4, top=30).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 4, 30)


def test_long_texts_are_counted_whole(spark):
    rows = [("en", "one two three, four five " * 3000), ("en", "one two three " * 50)]
    words = collocations._Words(0)
    blobs = list(collocations._blobs([t for _, t in rows]))
    assert sum(len(words.numbers(b)[words.numbers(b) > 0]) for b in blobs) == 15_150
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(df, least=40, top=20).collect())) == brute_collocations(rows, 40, 20)


def test_wide_numbers_are_counted_too():
    window = np.array([[1, 2, 3, 0, 0], [1, 2, 3, 0, 0], [1, 2, 3, 4, 5], [7, 0, 0, 0, 0], [1, 2, 3, 4, 5]], dtype=np.int32)
    for words in (10, 1 << 25):
        rows, often = collocations._distinct(window, words)
        assert sorted(zip(map(tuple, rows.tolist()), often.tolist())) == [((1, 2, 3, 0, 0), 2), ((1, 2, 3, 4, 5), 2), ((7, 0, 0, 0, 0), 1)]


def test_exact_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(4 * 10 ** 12, 9 * 10 ** 14, 5 * 10 ** 12, 4 * 10 ** 12)], "a long, n long, l long, r long")
    assert row.select(collocations._score(1000).alias("s")).first().s == 1000 * 4 * 10 ** 12 * 9 * 10 ** 14 // (5 * 10 ** 12 * 4 * 10 ** 12)


def test_no_documents_no_phrases(no_docs, odd_docs):
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(odd_docs, least=2).count() > 0


# ---------------------------------------------------------------- whitening

def expected_whitening(vectors, components=16):
    x = np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = (n * fit - s) / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    deviation = ((n * x.astype(object) - s) ** 2).sum(axis=1)
    return n, deviation, ((n * x - s) / n) @ v / np.sqrt(e), e / np.trace(z.T @ z / n)


def test_whitening_equals_a_direct_decomposition(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 24)) * np.linspace(0.2, 3, 24)
    v = np.concatenate([v, v[:50], v[:1].repeat(40, axis=0)]).astype(np.float32)
    rows = [(i, row.tolist(), "x") for i, row in enumerate(v)]
    bad = [(900, None, "x"), (901, [float("nan")] + [0.0] * 23, "x"), (902, [float("inf")] + [0.0] * 23, "x"), (903, [None] + [0.0] * 23, "x"), (904, [], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, component string")
    got = whitening.whiten(df).orderBy("vec_id", "component").collect()
    n, deviation, white, explained = expected_whitening(v)
    assert len(got) == len(v) * 16 and {r.n for r in got} == {n} == {300}
    assert [r.deviation for r in got[::16]] == deviation.tolist() == [int(r.deviation_exact) for r in got[::16]]
    mine = np.array([r.whitened for r in got]).reshape(-1, 16)
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9
    assert np.allclose([r.explained for r in got[:16]], explained, rtol=1e-9) and {r.identity_error for r in got}.pop() < 1e-9


def test_clustered_eigenvalues_are_resolved():
    r = np.random.default_rng(0)
    for values in (np.r_[[5, 5, 5 - 1e-9, 3, 3, 1], np.full(20, 0.1)], np.r_[1, 1 - 1e-5, 1 - 2e-5, 0.5, 0.5 - 1e-7, np.linspace(0.4, 0.1, 19)],
                   np.ones(8), np.geomspace(1, 1e-8, 12), np.zeros(5)):
        q = np.linalg.qr(r.normal(size=(len(values), len(values))))[0]
        a = (q * values) @ q.T
        e, x = whitening.refined_eigenvectors(a)
        assert np.abs(np.sort(values)[::-1] - e).max() < 1e-14 * max(values.max(), 1)
        assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14 and np.abs(a @ x - x * e).max() < 2e-15 * max(values.max(), 1)


def test_refinement_reaches_double_precision():
    r = np.random.default_rng(4)
    q = np.linalg.qr(r.normal(size=(40, 40)))[0]
    values = np.linspace(2, 1, 40)
    _, x = whitening.refined_eigenvectors((q * values) @ q.T)
    start = np.linalg.eigh(((q * values) @ q.T).astype(np.float32))[1].astype(np.float64)[:, ::-1]
    assert np.abs(x - q * np.sign((x * q).sum(axis=0))).max() < 1e-13 < np.abs(start - q * np.sign((start * q).sum(axis=0))).max()


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in same)
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0])], schema)).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: (r.vec_id, r.component))] == [False, True] * 3
    huge = whitening.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0])], schema)).collect()
    want = sum((2 * x - s) ** 2 for x, s in ((64 * 10 ** 15 + 10 ** 6, 2 * 10 ** 6), (10 ** 6, 2 * 10 ** 6 + 64)))
    assert {int(r.deviation_exact) for r in huge} == {want} and {r.deviation for r in huge} == {None}
    with pytest.raises(Exception, match="entries"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], schema)).count()
