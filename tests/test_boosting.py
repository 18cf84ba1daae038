"""Boosted trees against a plain recursive version, and scorers over many runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting as B
from tessera.operators import score as E
from tessera.operators import space as R


def plain(x, y, test, rounds, depth, rate=0.3, l2=1.0, min_child=1.0):
    """The same boosting, node by node and threshold by threshold."""
    labels = sorted(set(y))
    classes = [1] if len(labels) == 2 else list(range(len(labels)))
    score, out = np.zeros((len(x), len(classes))), np.zeros((len(test), len(classes)))

    def grow(rows, g, h, left):
        total = g[rows].sum(), h[rows].sum()
        leaf = -total[0] / (total[1] + l2)
        best = (1e-6, None)
        if left:
            for j in range(x.shape[1]):
                values = np.unique(x[:, j])
                for t in (values[1:] + values[:-1]) / 2:
                    a, b = rows[x[rows, j] < t], rows[x[rows, j] >= t]
                    if len(a) and len(b) and min(h[a].sum(), h[b].sum()) >= min_child - 1e-9:
                        gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - total[0] ** 2 / (total[1] + l2)
                        if round(gain, 9) > round(best[0], 9):
                            best = (gain, (j, t, a, b))
        if best[1] is None:
            return lambda r: leaf
        j, t, a, b = best[1]
        lo, hi = grow(a, g, h, left - 1), grow(b, g, h, left - 1)
        return lambda r: lo(r) if r[j] < t else hi(r)
    for _ in range(rounds):
        p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True) if len(classes) > 1 else 1 / (1 + np.exp(-score))
        trees = []
        for k, c in enumerate(classes):
            g = p[:, k] - (np.array(y) == labels[c])
            trees.append(grow(np.arange(len(x)), g, (2 if len(classes) > 1 else 1) * p[:, k] * (1 - p[:, k]), depth))
        for k, tree in enumerate(trees):
            score[:, k] += [rate * tree(r) for r in x]
            out[:, k] += [rate * tree(r) for r in test]
    if len(classes) > 1:
        return np.exp(out) / np.exp(out).sum(axis=1, keepdims=True)
    p = 1 / (1 + np.exp(-out[:, 0]))
    return np.column_stack((1 - p, p))


@pytest.mark.parametrize("n_classes", [2, 4])
def test_trees_against_plain_version(n_classes):
    rng = np.random.default_rng(n_classes)
    x, test = np.round(rng.normal(size=(60, 3)), 1), np.round(rng.normal(size=(40, 3)), 1)
    y = (np.digitize(x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.1 * rng.normal(size=60), [-0.5, 0.3, 1][:n_classes - 1]) * 3).tolist()
    frame = lambda m, label: pd.DataFrame({"features": list(m), "label": label})
    got, labels = B.boosted_trees(rounds=12, depth=3)(frame(x, y), frame(test, 0))
    assert labels.tolist() == sorted(set(y))
    assert np.allclose(got, plain(x, y, test, 12, 3), atol=1e-9)


def test_trees_learn_and_bins_bound_the_cuts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = (np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] > 0).astype(int)
    frame = pd.DataFrame({"features": list(x), "label": y})
    p, _ = B.boosted_trees(bins=32)(frame[:1500], frame[1500:])
    assert (p.argmax(axis=1) == y[1500:]).mean() > 0.85
    assert all(len(c) < 32 for c in B.cuts_of(x, 32))


def test_runs_of_one_job(spark):
    """Runs with null keys, one class, unlike classes, several test blocks, and no context."""
    rng = np.random.default_rng(2)
    point = lambda: [float(v) for v in rng.normal(size=3)]
    contexts = [("a", None, i, point(), int(i % 3)) for i in range(20)] + [("b", 1, i, point(), 7) for i in range(4)]
    tests = [(*run, 100 + i, point(), int(i % 4)) for run in (("a", None), ("b", 1), ("c", 2)) for i in range(30)]
    schema = "run string, seed int, row_id long, features array<float>, label int"
    c, t = spark.createDataFrame(contexts, schema), spark.createDataFrame(tests, schema).withColumn("_b", F.lit("clash"))
    for rows in (100_000, 7):
        got = E.score_runs(c, t, ["run", "seed"], E.knn_votes(5), test_rows=rows).collect()
        by = {}
        for r in got:
            by.setdefault((r.run, r.seed, r.row_id), {})[r["class"]] = r.prob
        assert len(by) == 60 and {k[0] for k in by} == {"a", "b"}
        assert all(set(p) == {0, 1, 2, 3} and abs(sum(p.values()) - 1) < 1e-12 and p[3] == 0 for k, p in by.items() if k[0] == "a")
        assert all(p == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0, 7: 1.0} for k, p in by.items() if k[0] == "b")
        want = E.knn_predict(c.where("run = 'a'"), t.where("run = 'a'"), 5).collect()
        assert all(abs(by["a", None, r.row_id][r["class"]] - r.prob) < 1e-12 for r in want)


def test_encoder_is_loaded_once_a_worker_and_checked(spark):
    pool = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") * 2).cast("double").alias("x")).repartition(4)
    got = {r.row_id: list(r.embedding) for r in R.encode(pool, lambda: lambda pdf: pdf[["x", "x"]].to_numpy() + [[0, 1]], ["x"], "twice-1").collect()}
    assert got == {i: [2.0 * i, 2.0 * i + 1] for i in range(100)}
    with pytest.raises(Exception, match="gave 1 rows"):
        R.encode(pool, lambda: lambda pdf: np.zeros((1, 2)), ["x"], "short").collect()
    assert R.encode(pool.where("false"), lambda: None, ["x"], "none").count() == 0


def test_a_tree_costs_a_comparison_a_split():
    """Leaves by nested choices equal a walk from the root; a tree with one split looks at one column."""
    rng = np.random.default_rng(11)
    for depth in (1, 3, 6):
        tree = B.Tree(depth)
        for node in range((1 << depth) - 1):
            if (node == 0 or tree.feature[(node - 1) // 2] >= 0) and rng.random() < 0.8:
                tree.feature[node], tree.bin[node] = rng.integers(4), rng.integers(20)
        tree.weight[:] = rng.normal(size=len(tree.weight))
        bins = rng.integers(0, 20, (500, 4))
        want = []
        for row in bins:
            node = 0
            while tree.feature[node] >= 0:
                node = 2 * node + 1 + (row[tree.feature[node]] > tree.bin[node])
            want.append(tree.weight[node])
        assert np.array_equal(tree.leaves(bins), want) and np.array_equal(tree.leaves(np.asfortranarray(bins.astype(np.uint8))), want)

    class Counted:
        shape, seen = (5, 3), []

        def __len__(self):
            return 5

        @property
        def T(self):
            return self

        def __getitem__(self, f):
            self.seen.append(int(f))
            return np.arange(5)
    tree = B.Tree(6)
    tree.feature[0], tree.bin[0], tree.weight[1:3] = 2, 1, (3.0, 4.0)
    rows = Counted()
    assert tree.leaves(rows).tolist() == [3, 3, 4, 4, 4] and rows.seen == [2]


def test_runs_with_keys_that_are_never_null(spark):
    """One aggregate over the test rows gives a run's blocks and classes; key types with and without nulls pass."""
    rows = [(0, "a", i, [float(i % 7)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "one int, two string, row_id long, features array<float>, label int").withColumn("run", F.lit(0))
    keys = ["run", "one", "two"]
    out = E.score_runs(df.where("row_id < 10"), df.where("row_id >= 10"), keys, E.knn_votes(3), test_rows=7)
    got = out.collect()
    assert len(got) == 60 and {(r.run, r.one, r.two) for r in got} == {(0, 0, "a")} and {r["class"] for r in got} == {0, 1}
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
