"""Genetic steps (C4, C5, C6, C10) against plain-Python versions of their rules, and the logistic scorer (E2) against a gradient."""

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import score as E
from tessera.operators import search as C


def lot(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16)


def members(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.candidate_id, set()).add(r.row_id)
    return out


def table(spark, sets):
    return spark.createDataFrame([(c, r) for c, rows in sets.items() for r in sorted(rows)], "candidate_id long, row_id long")


def pool_of(spark, n, classes, seed=0):
    rng = random.Random(seed)
    labels = {r: rng.randrange(classes) for r in range(n)}
    return labels, spark.createDataFrame(list(labels.items()), "row_id long, label int")


def test_crossover(spark):
    rng = random.Random(1)
    sets = {c: set(rng.sample(range(60), 20)) for c in range(4)}
    plan = [(10 + k, rng.randrange(4), rng.randrange(4)) for k in range(12)]
    got = members(C.crossover(table(spark, sets), spark.createDataFrame(plan, "child_id long, parent_a long, parent_b long"), 9, 0.6))
    crossed = 0
    for child, a, b in plan:
        cross = lot("9:x", child) / 2.0 ** 32 < 0.6
        crossed += cross
        assert got[child] == {r for r in range(60) if r in sets[b if cross and lot(f"9:{child}", r) % 2 == 0 else a]}
    assert 0 < crossed < 12


def test_mutation(spark):
    labels, pool = pool_of(spark, 80, 3)
    rng = random.Random(2)
    sets = {c: set(rng.sample(range(80), 15)) for c in range(6)}
    sets[6] = {min(r for r in labels if labels[r] == k) for k in range(3)}  # one row a class: nothing can go
    counts = {c: (rng.randrange(4), rng.randrange(6)) for c in sets} | {6: (2, 5)}
    got = members(C.mutate(table(spark, sets), pool, counts, 4))
    for c, own in sets.items():
        order = sorted(own, key=lambda r: (lot(f"4r:{c}", r), r))
        last = {max((r for r in own if labels[r] == k), key=lambda r: (lot(f"4r:{c}", r), r)) for k in {labels[r] for r in own}}
        gone = [r for r in order if r not in last][:counts[c][1]]
        more = sorted((r for r in labels if r not in own), key=lambda r: (lot(f"4a:{c}", r), r))[:counts[c][0]]
        assert got[c] == own - set(gone) | set(more)
        assert {labels[r] for r in got[c]} >= {labels[r] for r in own}


def test_mutation_counts():
    sizes = {c: s for c, s in enumerate([0, 1, 2, 9, 40, 500] * 50)}
    counts = C.mutation_counts(len(sizes), sizes, 2000, 0.01, 3)
    assert all(a <= min(10, sizes[c] // 2) and r <= min(10, sizes[c] // 2) for c, (a, r) in counts.items())
    big = [counts[c] for c, s in sizes.items() if s == 500]
    assert abs(np.mean([a for a, _ in big]) - 4) < 0.7 and abs(np.mean([r for _, r in big]) - 6) < 0.7


def test_tournament_and_replacement(spark):
    rng = random.Random(3)
    fit = {c * 7: round(rng.random(), 2) for c in range(9)}
    ids = sorted(fit)
    metrics = spark.createDataFrame(list(fit.items()), "candidate_id long, fitness double")
    got = {r.slot: r.winner for r in C.tournament(metrics, 30, 5).collect()}
    for slot in range(60):
        i = lot("5:ta", slot) % 9
        a, b = ids[i], ids[(i + 1 + lot("5:tb", slot) % 8) % 9]
        assert a != b and got[slot] == (b if fit[b] > fit[a] else a)
    new = spark.createDataFrame([(100 + k, v) for k, v in enumerate([0.0, 0.5, 1.0, max(fit.values())])], "candidate_id long, fitness double")
    kept = [(r.fitness, -r.candidate_id) for r in C.elitist_replacement(metrics, new, 6).collect()]
    every = [(f, -c) for c, f in fit.items()] + [(0.0, -100), (0.5, -101), (1.0, -102), (max(fit.values()), -103)]
    assert sorted(kept, reverse=True) == sorted(every, reverse=True)[:6]


def test_logistic_meets_its_gradient(spark):
    """The penalised loss has no slope at the fitted model: probabilities of the context satisfy the optimality condition."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    y = np.digitize(x[:, 0] + 0.5 * rng.normal(size=60), [-0.4, 0.5])
    frame = spark.createDataFrame(pd.DataFrame({"row_id": range(60), "features": [list(map(float, r)) for r in x], "label": y}),
                                  "row_id long, features array<double>, label int")
    got = {(r.row_id, r["class"]): r.prob for r in E.logistic_predict(frame, frame).collect()}
    p = np.array([[got[i, k] for k in range(3)] for i in range(60)])
    # at the optimum w_k = -c * sum_i (p_ik - y_ik) x_i, and the intercepts make the residuals sum to zero
    residual = p - (y[:, None] == np.arange(3))
    w = -residual.T @ x
    logits = x @ w.T
    b = np.log(p) - logits
    b -= b.mean(axis=1, keepdims=True)
    assert np.abs(residual.sum(axis=0)).max() < 1e-3
    assert np.abs(b - b.mean(axis=0)).max() < 1e-2  # what the weights do not explain is the same for every row
    one = frame.withColumn("label", F.lit(2))
    assert {(r["class"], r.prob) for r in E.logistic_predict(one, frame).collect()} == {(2, 1.0)}  # E5
