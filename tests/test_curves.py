"""Candidate curves from invented files: scan (S5), reduction (C2), fitness (C3), curve invariant (C11), as-of lookup (I16)."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import search as C
from tessera.operators import select as S
from tessera.sources.results_io import curve_json, scan_curves, write_curves

AUCS = {2: 0.70, 5: 0.74, 9: 0.74, 30: 0.81, 64: 0.90}


@pytest.fixture(scope="module")
def curves(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("curves"))
    rows = []
    for dataset in ("alpha", "beta gamma"):
        for fold in (0, 3):
            for size, auc in AUCS.items():
                value = auc + 0.01 * fold
                red = 0.5 * (1 - size / 500) + 0.5 * (0.5 + 0.5 * (1 - math.log(size / 2) / math.log(250)))
                rows.append((dataset, fold, size, 80, [1] * size + [0] * (80 - size), 2, value, red, 0.5 * value + 0.5 * red))
    df = spark.createDataFrame(rows, "dataset string, fold int, size int, n_genes int, genes array<int>, n_classes int, val_auc double, "
                                     "reduction double, fitness double")
    write_curves(curve_json(df), folder)
    return scan_curves(spark, folder + "/*.json").persist()


def test_scan(curves):
    assert curves.count() == 4 * len(AUCS)
    assert {(r.dataset, r.fold) for r in curves.collect()} == {(d, f) for d in ("alpha", "beta gamma") for f in (0, 3)}
    bad = curves.filter((F.col("size") != F.aggregate("genes", F.lit(0), lambda a, g: a + g))
                        | (F.size("genes") != F.col("n_genes")))
    assert bad.count() == 0


def test_reduction_and_fitness(curves):
    red = C.reduction(F.col("size").cast("double"), F.col("n_classes").cast("double"), 500)
    fit = C.fitness(F.col("val_auc"), red, 0.5, F.col("size"), F.lit(True))
    d = curves.select(F.max(F.abs(red - F.col("reduction"))).alias("r"),
                      F.max(F.abs(fit - F.col("fitness"))).alias("f")).first()
    assert d.r < 1e-9 and d.f < 1e-9
    capped = C.fitness(F.col("val_auc"), red, 0.5, F.col("size"), F.lit(True), max_size=20)
    assert curves.select(F.sum((capped == 0).cast("int")).alias("n")).first().n == 8


def test_curve_set_form(curves):
    w = curves.select("dataset", "fold", "size", "val_auc")
    assert C.best_curve(w).count() == w.count()  # a stored curve is a fixed point of the rule
    worse = w.unionByName(w.filter("size = 9").withColumns({"size": F.lit(12), "val_auc": F.lit(0.1)}))
    assert C.best_curve(worse).count() == w.count()


def test_asof_lookup(spark, curves):
    budgets = spark.createDataFrame([("alpha", 0, n) for n in (1, 2, 8, 63, 64, 500)], "dataset string, fold int, n_selected int")
    hit = {r.n_selected: r.val_auc for r in S.curve_lookup(curves.select("dataset", "fold", "size", "val_auc"), budgets).collect()}
    assert hit == {2: 0.70, 8: 0.74, 63: 0.81, 64: 0.90, 500: 0.90}


def test_shrink_and_mutate_keep_a_row_of_every_class(spark):
    pool = spark.createDataFrame([(i, i % 6) for i in range(60)], "row_id long, label int")
    cands = C.random_candidates(pool, 5, 30, 1)
    classes = lambda c: {r[0]: r[1] for r in c.join(pool, "row_id").groupBy("candidate_id").agg(
        F.count_distinct("label")).collect()}
    small = C.shrink(cands, pool, 4, 2)  # fewer than the classes: one row of each stays
    assert set(classes(small).values()) == {6} and {r["count"] for r in small.groupBy("candidate_id").count().collect()} == {6}
    two = spark.createDataFrame([(0, r) for r in range(12)], "candidate_id long, row_id long")
    for seed in range(5):  # ten removals of twelve rows in six classes
        assert classes(C.mutate(two, pool, {0: (0, 10)}, seed)) == {0: 6}
