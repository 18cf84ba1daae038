"""Hand-made edge cases (F4): ties, all-equal pairs, one class, n >= N, n < C, null seeds."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.tails import chi2_sf, nemenyi_cd
from tessera.operators import results as G
from tessera.operators import score as E
from tessera.operators import select as S
from tessera.operators import stats as H


def test_nemenyi_cd_reference_value():
    assert abs(nemenyi_cd(7, 67) - 1.100) < 1e-3
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9


def test_average_ranks_with_ties(spark):
    rows = [("d1", 1, "A", 0, 0.9), ("d1", 1, "B", 1, 0.9), ("d1", 1, "C", 2, 0.5),
            ("d2", 1, "A", 0, 0.7), ("d2", 1, "B", 1, 0.8), ("d2", 1, "C", 2, 0.8)]
    s = spark.createDataFrame(rows, "dataset string, c int, label string, label_order int, value double")
    got = {r.label: r.mean_rank for r in H.mean_ranks(s).collect()}
    assert got == {"A": (1.5 + 3) / 2, "B": (1.5 + 1.5) / 2, "C": (3 + 1.5) / 2}


def test_wilcoxon_all_equal_is_p_one(spark):
    rows = [("d%d" % i, 1, "A", "B", 0.5, 0.5, 0.0) for i in range(6)]
    d = spark.createDataFrame(rows, "dataset string, c int, label_a string, label_b string, value_a double, value_b double, d double")
    r = H.wilcoxon(d).first()
    assert r.n == 6 and r.p_value == 1.0


def test_bh_monotone(spark):
    rows = [(1, "m%d" % i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.2])]
    t = spark.createDataFrame(rows, "c int, label string, p_value double")
    q = {r.label: r.q_value for r in H.bh_adjust(t).collect()}
    # sorted p: .01 .03 .04 .2 -> raw .04 .06 .0533 .2 -> running min from the top
    assert q == pytest.approx({"m0": 0.04, "m1": 0.04 * 4 / 3, "m2": 0.04 * 4 / 3, "m3": 0.2}, rel=1e-9)


def test_null_seed_keys_are_distinct(spark):
    rows = [("d", 0, "Orig", "All", 100, None, "KNN", "AUC", 0.9),
            ("d", 0, "Orig", "All", 100, 42, "KNN", "AUC", 0.8)]
    df = spark.createDataFrame(rows, "dataset string, fold int, space string, method string, n_selected int, "
                                     "seed int, evaluator string, metric string, value double")
    assert G.run_means(df).count() == 2
    assert G.runs_to_do(df, df.limit(1)).count() == 1


def test_selection_edge_cases(spark):
    pool = spark.createDataFrame([(i, i % 3) for i in range(10)], "row_id long, label int")
    assert S.random_selection(pool, [50], [1]).count() == 10             # n >= N
    assert S.min_one_per_class(pool, 2, 1).count() == 2                  # n < C falls back to random
    got = S.min_one_per_class(pool, 4, 1).join(pool, "row_id")
    assert got.select("label").distinct().count() == 3
    sizes = spark.createDataFrame([(0, 1), (1, 5), (2, 5)], "label int, size int")
    assert {r.label: r.quota for r in S.balanced_quotas(sizes, 7, 1).collect()} == {0: 1, 1: 3, 2: 3}


def test_one_class_context(spark):
    ctx = spark.createDataFrame([(1, 2)], "row_id long, label int")
    test = spark.createDataFrame([(5, 2), (6, 3)], "row_id long, label int")
    p = E.one_class_predict(ctx, test)
    assert [r.prob for r in p.collect()] == [1.0, 1.0]


def test_auc_ties_and_single_label(spark):
    rows = [(1, 1, 1, 0.5), (1, 1, 0, 0.5), (2, 0, 1, 0.5), (2, 0, 0, 0.5)]
    pred = spark.createDataFrame(rows, "row_id long, y_true int, class int, prob double")
    assert E.auc(pred).first().AUC == 0.5
    single = pred.filter("y_true = 1")
    assert E.auc(single).first().AUC is None


def test_blocked_knn_equals_broadcast_knn(spark):
    from tessera.plans import fixtures as FX
    from tests.conftest import SF_SMALL
    pool = FX.embeddings_pool(spark, SF_SMALL)
    ctx = pool.filter("row_id % 3 = 0")
    test = pool.filter("row_id % 3 <> 0")
    a = E.knn_predict(ctx, test, 5).orderBy("row_id", "class").collect()
    b = E.knn_predict(ctx, test, 5, block=37).orderBy("row_id", "class").collect()
    assert [(r.row_id, r["class"], r.prob) for r in a] == [(r.row_id, r["class"], r.prob) for r in b]
    for block in (37, 4096):  # the classes asked for, whatever the context size
        got = E.knn_predict(ctx, test, 5, classes=list(range(12)), block=block)
        assert got.count() == 12 * test.count()
    small = E.knn_predict(ctx.limit(3), test, 5).groupBy("row_id").agg(F.sum("prob").alias("p")).select("p").distinct().collect()
    assert [round(r.p, 9) for r in small] == [1.0]


def test_logistic_penalty_matches_hand_solution(spark):
    # one feature, two classes at -1 and 1: with scores (-w x, w x) the stationary point is w = 2 (1 - p), p = sigmoid(2 w)
    ctx = spark.createDataFrame([(1, [-1.0], 0), (2, [1.0], 1)], "row_id long, features array<double>, label int")
    got = {(r.row_id, r["class"]): r.prob for r in E.logistic_predict(ctx, ctx).collect()}
    w = 0.5
    for _ in range(200):
        w = 2 * (1 - 1 / (1 + math.exp(-2 * w)))
    assert got[(2, 1)] == pytest.approx(1 / (1 + math.exp(-2 * w)), abs=1e-4)


def test_one_hot_encodes_every_level(spark):
    from tessera.operators import prep as P
    df = spark.range(10_001).select(F.format_string("v%05d", "id").alias("x"))
    enc = P.one_hot(df.withColumn("raw", F.col("x")), P.one_hot_levels(df, ["x"]), ["x"])
    got = enc.select("raw", F.explode("x").alias("e")).select("raw", "e.index").collect()
    assert len(got) == 10_000 and all(r.raw == f"v{r['index'] + 1:05d}" for r in got)
    odd = P.one_hot(spark.createDataFrame([(None,), ("new",), ("v00000",)], "x string"), P.one_hot_levels(df, ["x"]), ["x"])
    assert [len(r.x) for r in odd.collect()] == [0, 0, 0]


def test_missing_embedding_is_an_error(spark):
    from tessera.operators import space as R
    pool = spark.createDataFrame([(1,), (2,)], "row_id long")
    emb = spark.createDataFrame([(1, [0.5])], "row_id long, embedding array<float>")
    with pytest.raises(Exception, match="no embedding for row 2"):
        R.embedding_space(pool, emb).collect()
    assert [r.row_id for r in R.embedding_coverage(pool, emb).collect()] == [2]
