import numpy as np

from quarry.operators import rank


def _brute(arts, qs, k):
    out = {}
    for qid, qv in qs:
        scores = [(round(float(np.dot(np.array(qv, dtype=np.float64), np.array(av, dtype=np.float64))), 9), aid)
                  for aid, av in arts]
        out[qid] = [aid for _, aid in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def _ranked(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.article_id)
    return got


def test_block_ranker_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 8))
    base[5] = base[17]          # exact duplicate vectors: tie broken by article_id
    base[23] = base[17]
    arts = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    qs = [(100 + j, [float(x) for x in rng.normal(size=8)]) for j in range(6)] + [(200, [float(x) for x in base[17]])]
    a = spark.createDataFrame(arts, "article_id long, embedding array<double>")
    q = spark.createDataFrame(qs, "query_id long, embedding array<double>")
    want = _brute(arts, qs, 5)
    assert _ranked(rank.block_top_k(a, q, 5)) == want
    # many small query blocks (the beyond-budget path) give the same answer
    assert _ranked(rank.block_top_k(a, q, 5, block_bytes=8 * 8 * 2)) == want
    # fewer, larger GEMM tasks (running top-k across merged splits) give the same answer
    assert _ranked(rank.block_top_k(a.repartition(6), q, 5, max_tasks=2)) == want
    ranked = _ranked(rank.block_top_k(a, q, 5))[200]
    tie = [i for i, x in enumerate(ranked) if x in (5, 17, 23)]
    assert [ranked[i] for i in tie] == [5, 17, 23] and tie == list(range(tie[0], tie[0] + 3))


def test_k_beyond_corpus_returns_all(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "article_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.5])], "query_id long, embedding array<float>")
    r = rank.block_top_k(a, q, 10).collect()
    assert [(x.rank, x.article_id) for x in sorted(r, key=lambda x: x.rank)] == [(1, 1), (2, 2)]


def test_answer_and_checks(spark):
    r = spark.createDataFrame([(1, 1, 5, 0.9), (1, 2, 6, 0.8), (2, 1, 6, 0.5)],
                              "query_id long, rank int, article_id long, score double")
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, query_text string")
    ans = {x.query_id: x.answer for x in rank.to_answer(r, q).collect()}
    assert ans == {1: "5 6", 2: "6", 3: ""}
    bad = spark.createDataFrame([(1, "5 5"), (4, "7"), (2, "1 2 3 4 5 6 7 8 9 10 11")], "query_id long, answer string")
    arts = spark.createDataFrame([(i,) for i in range(1, 12)], "article_id long")
    v = {(x.query_id, x.violation) for x in rank.check_answer(bad, q, arts).collect()}
    assert v == {(1, "repeated_ids"), (4, "unknown_query"), (3, "missing_query"), (2, "too_many_ids")}


def test_texts_are_encoded_once(spark, tmp_path):
    from quarry.operators import infer
    from quarry.plans.answer import answer_queries
    seen = str(tmp_path / "seen")

    def factory():
        def encode(texts):
            with open(seen, "a") as f:
                f.write(f"{len(texts)}\n")
            return np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)
        return encode
    q = spark.createDataFrame([(i, "q" * i) for i in range(1, 21)], "query_id long, query_text string")
    a = spark.createDataFrame([(i, "t" * i) for i in range(1, 41)], "article_id long, title string")
    for blocks in (1, 4):
        spark.conf.set("quarry.rank.blockBytes", str(20 * (2 + 30) * 8 // blocks))
        try:
            ans = answer_queries(q, a, embed=lambda df, col: infer.embed_column(df, col, factory), k=10)
            assert ans.count() == 20
        finally:
            spark.conf.unset("quarry.rank.blockBytes")
        with open(seen) as f:
            assert sum(map(int, f)) == 60
        import os
        os.remove(seen)


def test_every_violation_of_an_answer(spark):
    from quarry.operators.rank import check_answer
    q = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "query_id long")
    a = spark.createDataFrame([(1, "7 8"), (2, "7 7"), (3, "9 x"), (4, "7"), (4, ""), (9, "7 8 7")], "query_id long, answer string")
    art = spark.createDataFrame([(7,), (8,)], "article_id long")
    got = sorted((r.query_id, r.violation) for r in check_answer(a, q, art, k=2).collect())
    assert got == [(2, "repeated_ids"), (3, "unknown_article"), (4, "duplicate_query"), (5, "missing_query"),
                   (9, "repeated_ids"), (9, "too_many_ids"), (9, "unknown_query")]
