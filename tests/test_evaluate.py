import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate as ev
from quarry.sources import fixtures


def _ap(spark, rows_gt, rankings, k=10):
    q = spark.createDataFrame(rows_gt, "query_id long, query_text string, ground_truth string")
    r = spark.createDataFrame(rankings, "query_id long, rank int, article_id long, score double")
    gt = ev.ground_truth(q)
    return {row.query_id: row.ap for row in ev.average_precision(ev.judge(r, gt, k), gt, k).collect()}


def test_ap_hand_case(spark):
    ap = _ap(spark, [(1, "q", "1 2")], [(1, 1, 1, 0.9), (1, 2, 9, 0.8), (1, 3, 2, 0.7)])
    assert ap[1] == pytest.approx((1 + 2 / 3) / 2)


def test_ap_empty_gt_and_unranked_query(spark):
    ap = _ap(spark, [(1, "q", ""), (2, "q", None), (3, "q", "4")], [(1, 1, 1, 0.9)])
    assert ap == {1: 0.0, 2: 0.0, 3: 0.0}


def test_ap_divisor_is_min_gt_k(spark):
    gt = " ".join(str(i) for i in range(12))
    ap = _ap(spark, [(1, "q", gt)], [(1, i + 1, i, 1.0 - i / 100) for i in range(10)])
    assert ap[1] == pytest.approx(1.0)


def test_ap_ignores_ranks_beyond_k(spark):
    ap = _ap(spark, [(1, "q", "5")], [(1, 1, 1, 0.9), (1, 2, 5, 0.8)], k=1)
    assert ap[1] == 0.0


def test_buckets(spark):
    df = spark.createDataFrame([(0.09,), (0.1,), (1.0,), (0.7,), (0.3,)], "ap double")
    got = [r.b for r in df.select(ev.ap_bucket("ap").alias("b")).collect()]
    assert got == [0.0, 0.1, 1.0, 0.7, 0.3]


def test_duplicate_query_ids_rejected(spark):
    q = spark.createDataFrame([(1, "a", "1"), (1, "b", "2")], "query_id long, query_text string, ground_truth string")
    with pytest.raises(Exception):
        ev.ground_truth(q).collect()


def test_rank_fixture_known_answers_and_identities(spark):
    from quarry.operators.rank import block_top_k
    v = fixtures.vector_fixture(spark, "/root/testdata/sf0.001")
    r = block_top_k(v.article_vectors, v.query_vectors, 10).cache()
    fx = fixtures.rank_fixture(spark, "/root/testdata/sf0.001", r)
    gt = ev.ground_truth(fx.queries)
    judged = ev.judge(r, gt)
    ap = ev.average_precision(judged, gt).collect()
    expected = {0: 1.0, 1: 0.75, 2: 0.1, 3: (1 / 2 + 2 / 3 + 3 / 7) / 3, 4: 0.0}
    for row in ap:
        assert row.ap == pytest.approx(expected[(row.query_id // 10) % 5])
    stats = ev.article_stats(judged, gt, fx.articles)
    tot = stats.agg(F.sum("retrieved").alias("ret"), F.sum("relevant").alias("rel"), F.sum("hits").alias("hits")).first()
    n_q = fx.queries.count()
    assert tot.ret == 10 * n_q
    missed = ev.worst_by_missed(stats, fx.articles, n=10_000)
    assert missed.where(F.col("missed") != F.col("relevant") - F.col("hits")).count() == 0
    hist = ev.ap_distribution(ev.average_precision(judged, gt))
    assert hist.agg(F.sum("n_queries")).first()[0] == n_q
