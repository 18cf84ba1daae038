"""Coverage scores against a brute-force version: exact medians, draws, one pool block and several."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import zcore as Z


def brute(ids, x, draws, redund_nn, power):
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    s = np.zeros(len(ids))
    for b in range(draws.blocks):
        for dims, point in zip(*draws.block(b)):
            dist = np.abs(x[:, dims] - point).sum(axis=1)
            a = int(np.lexsort((ids, dist))[0])
            s[a] += 1
            to = np.abs(x[:, dims] - x[a, dims]).sum(axis=1)
            near = [i for i in np.lexsort((ids, to)) if i != a][:redund_nn]
            if not near:
                continue
            if to[near[0]] == 0:
                s[near[0]] -= 1
            else:
                w = to[near] ** -power
                s[near] -= w / w.sum()
    return dict(zip(ids, (s - s.min()) / ((s.max() - s.min()) or 1.0)))


def pool_of(spark, x, kind="double"):
    ids = np.random.default_rng(len(x)).permutation(10 * len(x))[:len(x)]
    pdf = pd.DataFrame({"row_id": ids, "features": [list(map(float, r)) for r in x]})
    return ids, spark.createDataFrame(pdf, f"row_id long, features array<{kind}>").repartition(3)


def test_exact_medians(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        x = np.column_stack((rng.normal(size=n), np.round(rng.normal(size=n)), -np.abs(rng.normal(size=n)) * 1e-200, rng.integers(-3, 3, n) * 1e300))
        _, pool = pool_of(spark, x)
        got = Z.dimension_stats(pool)
        assert got[0] == n and np.array_equal(got[1], x.min(axis=0)) and np.array_equal(got[3], x.max(axis=0))
        assert np.allclose(got[2], np.median(x, axis=0), rtol=1e-15, atol=0)
    x = rng.normal(size=(51, 3)).astype(np.float32)
    assert np.array_equal(Z.dimension_stats(pool_of(spark, x, "float")[1])[2], np.median(x, axis=0).astype(float))


def test_draws_pick_different_dimensions():
    draws = Z.Draws(5000, np.zeros(4), np.full(4, 0.2), np.ones(4), 3, 1, "triangular", 2000)
    dims = np.concatenate([draws.block(b)[0] for b in range(draws.blocks)])
    assert len(dims) == 5000 and all(len(set(d)) == 3 for d in dims)
    assert abs(np.bincount(dims.ravel()) / 5000 - 0.75).max() < 0.03
    assert 0.35 < np.concatenate([draws.block(b)[1] for b in range(draws.blocks)]).mean() < 0.45  # (0 + 0.2 + 1) / 3


@pytest.mark.parametrize("pool_block", [1 << 16, 17])
def test_scores_against_brute_force(spark, pool_block):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 5)), 1)  # ties and duplicates in two dimensions
    x[:, 3] = 2.5
    ids, pool = pool_of(spark, x)
    for nn in (7, 1000):
        got = {r.row_id: r.score for r in Z.zcore_scores(pool, n_sample=300, redund_nn=nn, batch=40, pool_block=pool_block).collect()}
        _, lo, med, hi = Z.dimension_stats(pool)
        want = brute(ids, x, Z.Draws(300, lo, med, hi, 2, 0, "triangular", 40), nn, 4)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_guards(spark):
    _, pool = pool_of(spark, np.ones((6, 3)))
    assert {r.score for r in Z.zcore_scores(pool).collect()} == {1.0}
    ids, pool = pool_of(spark, np.column_stack((np.ones(8), np.arange(8.0))))  # one dimension left: draws shrink to it
    got = {r.row_id: r.score for r in Z.zcore_scores(pool, n_sample=100, redund_nn=2, sampler="uniform").collect()}
    _, lo, med, hi = Z.dimension_stats(pool)
    want = brute(ids, np.column_stack((np.ones(8), np.arange(8.0))), Z.Draws(100, lo, med, hi, 2, 0, "uniform"), 2, 4)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert [r.score for r in Z.zcore_scores(pool.limit(1).select("row_id", F.col("features")), n_sample=10).collect()] == [1.0]


def test_bounds_of_the_reach():
    rng = np.random.default_rng(5)
    for want, step, ranks in ((10, 1, 8), (40, 3, 6), (7, 2, 32), (60, 5, 32)):
        lists = [[np.sort(np.round(rng.random(m), 2)) for m in (30, 25, 0, 41)] for _ in range(20)]
        top = step * ranks
        rungs, n = np.full((20, 4, ranks), np.inf), np.zeros((20, 4), np.int64)
        for i, blocks in enumerate(lists):
            for k, d in enumerate(blocks):
                n[i, k] = min(top, len(d))
                if len(d):
                    rungs[i, k] = d[np.minimum(step * np.arange(1, ranks + 1), n[i, k]) - 1]
        low, high = Z._bounds(rungs, n, step, want)
        for i, blocks in enumerate(lists):
            d = np.sort(np.concatenate(blocks))
            assert (d < low[i]).sum() <= want and (high[i] == np.inf or (d <= high[i]).sum() >= want)
            assert low[i] <= d[want - 1] <= high[i]


def test_a_task_sends_few_neighbours(spark, monkeypatch):
    """Several pool blocks: only rows near the edge of a draw's neighbours leave a task, not the lists themselves."""
    sent = []
    kept = Z.cut_lineage
    monkeypatch.setattr(Z, "cut_lineage", lambda df: sent.append(df) or kept(df))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 4))
    ids, pool = pool_of(spark, x)
    got = {r.row_id: r.score for r in Z.zcore_scores(pool, n_sample=60, redund_nn=400, batch=20, pool_block=300).collect()}
    _, lo, med, hi = Z.dimension_stats(pool)
    want = brute(ids, x, Z.Draws(60, lo, med, hi, 2, 0, "triangular", 20), 400, 4)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    ends = next(df for df in sent if "high" in df.columns).toPandas()
    held = 0
    by_id = {i: r for i, r in zip(ids, x)}
    for r in ends.itertuples():
        dims, _ = Z.Draws(60, lo, med, hi, 2, 0, "triangular", 20).block(r.draw // 20)
        d = np.abs(x[:, dims[r.draw % 20]] - by_id[r.row_id][dims[r.draw % 20]]).sum(axis=1)
        d = d[ids != r.row_id]
        assert (d < r.low).sum() <= 400 <= (d <= r.high).sum()
        held += ((d >= r.low) & (d <= r.high)).sum()
    assert held / len(ends) < 150
