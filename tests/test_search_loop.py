"""The search loop at a small scale: better or equal best fitness, sizes down the ladder, valid candidates, applied flips."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import score as E
from tessera.operators import search as C
from tessera.operators import search_loop as L
from tessera.operators.search_archive import CandidateArchive
from tessera.plans.queries_search import _score, _split_pool
from tests.conftest import SF_SMALL


def test_search_runs_down_the_ladder(spark):
    train, val = _split_pool(spark, SF_SMALL)
    score = lambda members: _score(members, train, val)
    run = L.search(train, score, [40, 20], population=4, patience=2, max_steps=2, local_attempts=3)
    first = [f for s, step, _, f in run.history if s == 40 and step == 0]
    last = [f for s, step, _, f in run.history if s == 40 and step == max(p for t, p, _, _ in run.history if t == 40)]
    assert len(first) == 4 and max(last) >= max(first)
    classes = train.select("label").distinct().count()
    got = run.population.join(train, "row_id").groupBy("candidate_id").agg(F.count_distinct("label").alias("c"), F.count("*").alias("n"))
    assert {r.c for r in got.collect()} == {classes}
    rows = run.curve().orderBy("size").collect()
    assert rows and all(a.val_auc <= b.val_auc for a, b in zip(rows, rows[1:]))

    # every candidate ever scored keeps the rows it was scored on: sizes and scores come out again
    members = {}
    for r in run.archive.members().collect():
        members.setdefault(r.candidate_id, []).append(r.row_id)
    assert all(len(v) == len(set(v)) for v in members.values())
    assert len({i for _, _, _, i in run.entries}) == len(run.entries) and all(len(members[i]) == s for s, _, _, i in run.entries)
    again = {r.candidate_id: r.val_auc or 0.0 for r in score(run.archive.members()).collect()}
    assert all(abs(again[i] - a) < 1e-12 for _, a, _, i in run.entries)
    assert {i for _, _, i, _ in run.history} <= {i for _, _, _, i in run.entries}

    points = run.curve_members()
    test = L.evaluate_curve(points, lambda m: E.all_metrics(E.knn_predict_grouped(m.join(train, "row_id"), val, 5), by=("candidate_id",)))
    test = test.collect()
    assert {(r["size"], r.metric) for r in test} == {(p["size"], m) for p in rows for m in ("AUC", "ACC", "F1", "BalACC")}
    assert all(abs(r.value - r.val_auc) < 1e-12 for r in test if r.metric == "AUC")
    with pytest.raises(Exception, match="rows instead of"):
        L.evaluate_curve(points.filter(f"row_id <> {points.first().row_id}"), lambda m: m.select("candidate_id", F.lit("x").alias("metric"), F.lit(1.0).alias("value"))).collect()


def test_children_of_a_pair_share_out_its_genes(spark):
    cands = spark.createDataFrame([(1, r) for r in range(40)] + [(2, r) for r in range(30, 80)], "candidate_id long, row_id long")
    pairs = spark.createDataFrame([(10, 1, 2, 10), (11, 2, 1, 10)], "child_id long, parent_a long, parent_b long, coin_id long")
    kids = {}
    for r in C.crossover(cands, pairs, 3, 1.0).collect():
        kids.setdefault(r.candidate_id, set()).add(r.row_id)
    assert kids[10] & kids[11] == set(range(30, 40)) and kids[10] | kids[11] == set(range(80))
    assert all(0 < len(kids[k] & set(range(30))) < 30 for k in (10, 11))


def test_archive_keeps_batches_apart(spark):
    store = CandidateArchive(spark)
    assert store.members().count() == 0
    rows = lambda x: spark.createDataFrame(x, "candidate_id long, row_id long")
    store.add(rows([(0, 5), (1, 6)]))
    ids = store.add(store.members([1]).unionByName(rows([(1, 9)])), {1: 0})
    assert ids == {1: 1 << 20}
    assert sorted(map(tuple, store.members().collect())) == [(0, 5), (1, 6), (1 << 20, 6), (1 << 20, 9)]
    assert sorted(map(tuple, store.members([1 << 20]).collect())) == [(1 << 20, 6), (1 << 20, 9)]


def test_genes_of_a_stored_curve_are_its_members(spark):
    pool = spark.createDataFrame([("d", 0, r) for r in (7, 3, 11, 5)] + [("e", 1, r) for r in (4, 2)], "dataset string, fold int, row_id long")
    members = spark.createDataFrame([("d", 0, 2, 3), ("d", 0, 2, 11), ("e", 1, 1, 4)], "dataset string, fold int, candidate_id long, row_id long")
    genes = L.curve_genes(members, pool)
    assert {(r.dataset, tuple(r.genes)) for r in genes.collect()} == {("d", (1, 0, 0, 1)), ("e", (0, 1))}
    curve = genes.withColumn("size", F.expr("aggregate(genes, 0, (a, g) -> a + g)")).withColumn("val_auc", F.lit(0.5))
    back = L.stored_curve_members(curve, pool).select("dataset", "size", "row_id").collect()
    assert sorted(map(tuple, back)) == [("d", 2, 3), ("d", 2, 11), ("e", 1, 4)]


def test_local_search_never_lowers_the_fitness(spark):
    train, val = _split_pool(spark, SF_SMALL)
    score = lambda members: _score(members, train, val)
    cands = C.random_candidates(train, 3, 20, 5).withColumn("candidate_id", F.col("candidate_id").cast("long")).persist()
    before = {r.candidate_id: r.fitness for r in score(cands).collect()}
    after = {r.candidate_id: r.fitness for r in score(L.local_search(cands, train, score, 4, 1)).collect()}
    assert before.keys() == after.keys() and all(after[c] >= before[c] - 1e-12 for c in before)
