"""K-medoids against a brute-force NumPy alternate algorithm from the same seeding."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.hashing import seeded_order, seeded_unit
from tessera.operators import kmedoids as K
from tessera.plans import fixtures as FX
from tests.conftest import SF_SMALL


def _dist(x, metric):
    if metric == "cosine":
        xn = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.clip(1 - xn @ xn.T, 0, 2)
    return np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))


def _brute(d, ids, init):
    pos = {v: i for i, v in enumerate(ids)}
    m = [pos[i] for i in init]
    for _ in range(300):
        lab = d[:, m].argmin(1)
        new = []
        for c in range(len(m)):
            mem = np.where(lab == c)[0]
            s = d[np.ix_(mem, mem)].sum(1)
            cands = mem[np.isclose(s, s.min(), atol=1e-9)]
            new.append(min(cands, key=lambda i: ids[i]))
        if new == m:
            break
        m = new
    return [int(ids[i]) for i in m]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_kmedoids_matches_brute_force(spark, metric):
    pool = FX.embeddings_pool(spark, SF_SMALL).select("row_id", "features")
    pdf = pool.toPandas()
    x = np.vstack(pdf.features.to_numpy()).astype(float)
    ids = pdf.row_id.to_numpy()
    med, info = K.kmedoids(pool, 6, 7, metric)
    init = K.init_kmedoidspp(pool, 6, 7, metric)
    assert med == _brute(_dist(x, metric), ids, init)
    assert len(set(med)) == 6


def test_heuristic_init_is_exact(spark):
    pool = FX.embeddings_pool(spark, SF_SMALL).select("row_id", "features")
    pdf = pool.toPandas()
    x = np.vstack(pdf.features.to_numpy()).astype(float)
    ids = pdf.row_id.to_numpy()
    s = _dist(x, "euclidean").sum(1)
    want = [int(ids[i]) for i in np.lexsort((ids, s))[:5]]
    assert K.init_heuristic(pool, 5, "euclidean") == want


def test_whole_pool_when_budget_exceeds(spark):
    pool = FX.embeddings_pool(spark, SF_SMALL).select("row_id", "features").limit(7)
    med, info = K.kmedoids(pool, 10, 1)
    assert info.get("whole_pool") and len(med) == 7


def test_partition_count_does_not_change_result(spark):
    pool = FX.embeddings_pool(spark, SF_SMALL).select("row_id", "features")
    a, _ = K.kmedoids(pool.repartition(1), 4, 3)
    b, _ = K.kmedoids(pool.repartition(7), 4, 3)
    assert a == b


def test_sums_by_broadcast_and_by_blocks(spark, monkeypatch):
    """Few candidates are broadcast, more meet the members in blocks of their cluster; both give every pair of a cluster once."""
    rng = np.random.default_rng(4)
    x, cl = rng.normal(size=(700, 3)).astype(np.float32), rng.choice([0, 1, 1, 1, 3], 700)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(cl[i])) for i in range(700)], "row_id long, features array<float>, cluster int").repartition(3)
    d = _dist(x.astype(float), "euclidean")
    for sent in (K.SENT, 9):
        monkeypatch.setattr(K, "SENT", sent)
        monkeypatch.setattr(K, "TILE", 64)
        monkeypatch.setattr(K, "TILE_LEAST", 64)
        got = K._tile_sums(rows.where("row_id % 3 = 0 and cluster <> 3"), rows, 4, np.bincount(cl, minlength=4), 3).collect()
        assert sorted(r.row_id for r in got) == [i for i in range(0, 700, 3) if cl[i] != 3]
        for r in got:
            assert abs(r.total - d[r.row_id, cl == cl[r.row_id]].sum()) < 1e-6


def test_distances_are_held_a_few_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    x, m, w, seen = rng.normal(size=(900, 5)), rng.normal(size=(9000, 5)), rng.random(9000), []
    want = np.sqrt(((x[:, None] - m[None]) ** 2).sum(-1))
    kept = K.V.pairwise
    monkeypatch.setattr(K.V, "pairwise", lambda *a: seen.append(a[0].shape[0] * a[1].shape[0]) or kept(*a))
    assert np.allclose(K._summed(x, m), want.sum(1)) and np.allclose(K._summed(x, m, w), want @ w)
    assert max(seen) <= K.HELD[0] * K.HELD[1]


class _Here:
    """Stands for a pool: hands back the function that Spark would run, with broadcast values kept here."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))

    def mapInPandas(self, fn, schema):
        return fn


def test_full_batches_take_no_more_memory_than_small_ones():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20_000, 32)).astype(np.float32)
    pdf = pd.DataFrame({"row_id": np.arange(len(x)), "features": list(x)})
    fn = K.assign(_Here(), [], medoid_vectors=x[:10].astype(float))

    def peak(rows):
        kept = []
        tracemalloc.start()
        for out in fn(iter([pdf.iloc[:rows]])):
            kept.append((len(out), out["dist"].sum()))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top, kept
    peak(2000)  # imports
    (small, _), (full, got) = peak(2000), peak(20_000)
    assert sum(n for n, _ in got) == 20_000 and full < 2 * small
    assert np.isclose(sum(v for _, v in got), np.sqrt(((x[:, None].astype(float) - x[None, :10]) ** 2).sum(-1)).min(1).sum())


def test_cells_leave_few_candidates_on_nearly_one_dimension(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.column_stack((rng.random(3000) * 1000, rng.random(3000) * 50, rng.random(3000) * 0.1)).astype(np.float32)
    pool = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<float>").repartition(4)
    monkeypatch.setattr(K, "FEW_PAIRS", 0)
    a = K.assign(pool, [5, 900, 2000]).persist()
    n, s = K._cluster_sums(a, "euclidean", 3)
    lbs = K._lower_bounds(a, n, s, "euclidean")
    d, lab = _dist(x.astype(float), "euclidean"), np.zeros(3000, int)
    for r in a.collect():
        lab[r.row_id] = r.cluster
    old = {r.row_id: r.lb for r in lbs.collect()}
    new = {r.row_id: r.lb for r in K._cell_bounds(lbs, a, n, s).collect()}
    total = np.array([d[i, lab == lab[i]].sum() for i in range(3000)])
    assert all(old[i] <= new[i] <= total[i] + 1e-6 for i in range(3000))
    best = [total[lab == c].min() for c in range(3)]
    assert sum(new[i] < best[lab[i]] for i in range(3000)) * 2 < sum(old[i] < best[lab[i]] for i in range(3000))
    got, _, _ = K._best_members_euclidean(a, 3, [5, 900, 2000], np.array([total[5], total[900], total[2000]]), sums=(n, s))
    assert got == [int(np.flatnonzero(lab == c)[total[lab == c].argmin()]) for c in range(3)]


def _unit_pool(spark, rng, n, d):
    x = rng.normal(size=(n, d)) + np.linspace(0.6, 0, d)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[n - n // 100:] = x[0]  # copies, the last rows
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<float>").repartition(4)


def test_moments_leave_few_candidates_in_many_dimensions(spark, monkeypatch):
    """Distances are alike in many dimensions, so that those to the mean and to cells exclude next to no member."""
    x, pool = _unit_pool(spark, np.random.default_rng(2), 3000, 32)
    a = K.assign(pool, [5, 900, 2000]).persist()
    n, s = K._cluster_sums(a, "euclidean", 3)
    lbs = K._lower_bounds(a, n, s, "euclidean")
    lab = np.zeros(3000, int)
    for r in a.collect():
        lab[r.row_id] = r.cluster
    d = _dist(x.astype(float), "euclidean")
    total = np.array([d[i, lab == lab[i]].sum() for i in range(3000)])
    best = np.array([total[lab == c].min() for c in range(3)])
    old = {r.row_id: r.lb for r in K._cell_bounds(lbs, a, n, s).collect()}
    new = {r.row_id: r.lb for r in K._moment_bounds(lbs, a, n, s).collect()}
    assert all(new[i] <= total[i] + 1e-6 for i in range(3000))
    assert sum(old[i] < best[lab[i]] for i in range(3000)) > 2500 and sum(new[i] < best[lab[i]] for i in range(3000)) < 300
    monkeypatch.setattr(K, "FEW_PAIRS", 0)
    got, _, scored = K._best_members_euclidean(a, 3, [5, 900, 2000], total[[5, 900, 2000]], sums=(n, s))
    assert got == [int(np.flatnonzero(lab == c)[total[lab == c].argmin()]) for c in range(3)] and scored < 350


def test_heuristic_init_scores_few_rows(spark, monkeypatch):
    x, pool = _unit_pool(spark, np.random.default_rng(3), 3000, 32)
    s = _dist(x.astype(float), "euclidean").sum(1).round(6)
    want, scored, kept = [int(i) for i in np.lexsort((np.arange(3000), s))[:6]], [], K._tile_sums
    monkeypatch.setattr(K, "_tile_sums", lambda cands, *a: scored.append(cands.count()) or kept(cands, *a))
    monkeypatch.setattr(K, "FEW_PAIRS", 0)
    assert K.init_heuristic(pool, 6) == want
    assert scored[-1] < 300


def test_moment_bounds_hold_for_any_vectors(spark, monkeypatch):
    """Far from the origin, with outliers, with equal rows and in clusters of one."""
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(size=(200, 4)) + 500, rng.standard_cauchy((100, 4)) * 10, np.ones((40, 4)), [[9e4, 0, 0, 1]])).astype(np.float32)
    cl = np.repeat([0, 1, 2, 3], (200, 100, 40, 1))
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(c), 0.0) for i, (r, c) in enumerate(zip(x, cl))],
                                 "row_id long, features array<float>, cluster int, dist double").repartition(3)
    n, s = K._cluster_sums(rows, "euclidean", 4)
    z = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    got = {r.row_id: r.lb for r in K._moment_bounds(K._lower_bounds(rows, n, s, "euclidean"), rows, n, s).collect()}
    assert len(got) == len(x) and all(got[i] <= z[i, cl == cl[i]].sum() * (1 + 1e-9) + 1e-6 for i in range(len(x)))
    lbs = K._lower_bounds(rows, n, s, "euclidean")
    monkeypatch.setattr(K, "SENT", 9)
    assert K._moment_bounds(lbs, rows, n, s) is lbs


def test_grid_has_no_more_cells_than_asked():
    for extent in ([8000, 50, 0.1, 0.08], [1, 1, 1, 1, 1], [0, 0], [5, 0, 0], [1e-9, 1e9]):
        for cells in (64, 5000):
            wide, edge, bins = K._grid(np.zeros(len(extent)), np.array(extent, float), cells)
            assert 1 <= np.prod(bins) <= cells and np.allclose(np.where(np.array(extent)[wide] > 0, edge * bins, 0), np.array(extent)[wide])


def _line_pool(spark, rng, n):
    """Nearly one dimension, as prices are beside quantities."""
    x = np.column_stack((rng.random(n) * 1000, rng.random(n) * 50, rng.random(n) * 0.1)).astype(np.float32)
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<float>").repartition(4)


def test_an_update_takes_few_jobs(spark, monkeypatch):
    """Each is a pass over the pool, so that their number is what a large pool waits for."""
    x, pool = _line_pool(spark, np.random.default_rng(11), 3000)
    monkeypatch.setattr(K, "FEW_PAIRS", 0)
    sc, jobs = spark.sparkContext, []
    for turns in (1, 2):
        sc.setJobGroup(f"turns-{turns}", "k-medoids")
        K.kmedoids(pool, 3, 5, max_iter=turns)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"turns-{turns}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 8


def test_seeding_draws_as_the_row_hash_says(spark):
    x, pool = _line_pool(spark, np.random.default_rng(12), 400)
    d, k, seed = _dist(x.astype(float), "euclidean"), 5, 7
    chosen = [pool.orderBy(seeded_order(seed, F.col("row_id")), "row_id").head().row_id]
    for r in range(1, k):
        u = np.array([v.u for v in pool.select("row_id", seeded_unit(F.lit(f"{seed}:{r}"), F.col("row_id")).alias("u")).orderBy("row_id").collect()])
        near = d[:, chosen].min(1)
        keys = np.where(near > 0, -np.log(u) / np.maximum(near, 1e-9) ** 2, np.inf)
        drawn = np.argsort(keys)[:2 + int(np.log(k))]
        chosen.append(int(drawn[np.argmin([(np.minimum(near, d[:, j]) ** 2).sum() for j in drawn])]))
    assert K.init_kmedoidspp(pool, k, seed) == chosen


def test_packed_rows_come_back_and_odd_vectors_are_errors(spark):
    x, pool = _line_pool(spark, np.random.default_rng(13), 500)
    packed = K._packed(pool)
    assert packed.count() < 10 and {r.row_id: tuple(r.features) for r in K._rows(packed).collect()} == {i: tuple(map(float, v)) for i, v in enumerate(x)}
    a = {r.row_id: (r.cluster, r.dist) for r in K.assign(pool, [3, 8]).collect()}
    got = K._rows(K.assign(packed, [3, 8])).collect()
    assert {r.row_id: r.cluster for r in got} == {i: c for i, (c, _) in a.items()}
    assert np.allclose(K._cluster_sums(K.assign(packed, [3, 8]), "euclidean", 2, True)[2], [sum(v for c, v in a.values() if c == i) for i in (0, 1)])
    for odd in ([(1, [1.0, 2.0]), (2, [1.0])], [(1, [1.0]), (2, None)], [(None, [1.0]), (2, [2.0])]):
        with pytest.raises(Exception, match="vectors must be|without a key"):
            K._packed(spark.createDataFrame(odd, "row_id long, features array<float>").coalesce(1)).count()


def test_cells_bound_sums_from_both_sides(spark, monkeypatch):
    x, pool = _line_pool(spark, np.random.default_rng(14), 2000)
    a = K.assign(K._packed(pool), [5, 900, 1500]).persist()
    n, s, cost, ends = K._cluster_sums(a, "euclidean", 3, True, True)
    lab = np.zeros(2000, int)
    for r in K._rows(a).collect():
        lab[r.row_id] = r.cluster
    d = _dist(x.astype(float), "euclidean")
    total = np.array([d[i, lab == lab[i]].sum() for i in range(2000)])
    for spread in (K._spread(a, n, s), K._corners(n, s, ends)):
        bounds = [K._Reverse(n, s, spread), K._Cells(n, s, spread)]
        K._tables(a, bounds)
        for bound in bounds:
            assert (bound.lower(lab, x.astype(float)) <= total + 1e-6).all()
        for c in range(3):
            assert (bounds[1].upper(c, x[lab == c].astype(float)) >= total[lab == c] - 1e-6).all()
    monkeypatch.setattr(K, "FEW_PAIRS", 0)
    for sent in (K.SENT, 9):  # on the driver, and with too many rows for it
        monkeypatch.setattr(K, "SENT", sent)
        got, vals, _ = K._best_members_euclidean(a, 3, [5, 900, 1500], cost, (n, s, ends), {})
        assert got == [int(np.flatnonzero(lab == c)[total[lab == c].argmin()]) for c in range(3)]


def test_keys_that_repeat_do_not_hide_the_best_row(spark, monkeypatch):
    """Rows of one key count together, so that none of them wins; the others are found as if there were no bounds."""
    x, pool = _line_pool(spark, np.random.default_rng(15), 1500)
    total = _dist(x.astype(float), "euclidean").sum(1)
    order = np.argsort(total)
    twice = pool.where(F.col("row_id").isin([int(i) for i in order[:20]]))
    a = K.assign(K._packed(pool.unionByName(twice).repartition(3)), [int(order[-1])]).persist()
    n, s, cost, ends = K._cluster_sums(a, "euclidean", 1, True, True)
    monkeypatch.setattr(K, "FEW_PAIRS", 0)
    got, _, _ = K._best_members_euclidean(a, 1, [int(order[-1])], cost, (n, s, ends), {})
    want = total + _dist(x.astype(float), "euclidean")[:, order[:20]].sum(1)
    want[order[:20]] *= 2
    assert got == [int(want.argmin())]
