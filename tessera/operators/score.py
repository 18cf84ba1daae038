"""Scorers and metrics.

Predictions are long: (run key..., row_id, y_true, class, prob): one row per test
row and class.  Metrics are grouped aggregates per run, so many runs score in one job.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.joins import fresh, null_safe_on
from tessera.functions.tiles import BLOCK_ROWS, meet

TEST_ROWS = 100_000  # test rows of a run that a user scorer gets at once


# ---------------------------------------------------------------- E1 k-NN
def knn_predict(context: DataFrame, test: DataFrame, k: int = 5, metric: str = "euclidean",
                classes: list[int] | None = None, block: int = BLOCK_ROWS, by: tuple = ()) -> DataFrame:
    """K-NN vote shares, k = clamp(k, 1, n_context), one path for every context size.

    Blocks of test rows meet blocks of context rows on the executors (``tiles.meet``); each block keeps a test row's k
    nearest, and a window group limit merges the partial lists.  Ties in distance go to the lower row_id.  Output
    (by..., row_id, y_true, class, prob): one row per test row and class, absent classes 0 (E6).  ``classes`` is the
    list asked for, by default the labels of context and test.  With ``by``, contexts of several groups are scored at
    once, each against its own test rows.
    """
    g = list(by)

    def nearest(t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        names = g + ["row_id", "y_true", "ctx_id", "dist", "ctx_label"]
        if not len(t) or not len(c):
            return pd.DataFrame({n: [] for n in names})
        ids, labels = c["row_id"].to_numpy(), c["label"].to_numpy()
        x, m = V.stack(t["features"]), V.stack(c["features"])
        d = V.pairwise(V.normalise(x), V.normalise(m), metric) if metric == "cosine" else V.pairwise(x, m, metric)
        kk = min(k, len(ids))
        order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :kk]
        out = {n: np.repeat(t[n].iloc[0], len(t) * kk) for n in g}
        return pd.DataFrame(out | {
            "row_id": np.repeat(t["row_id"].to_numpy(), kk), "y_true": np.repeat(t["label"].to_numpy(), kk), "ctx_id": ids[order].ravel(),
            "dist": np.take_along_axis(d, order, 1).ravel(), "ctx_label": labels[order].ravel()})[names]

    k = max(1, k)
    types = dict(test.dtypes)
    keys = "".join(f"{n} {types[n]}, " for n in g)
    parts = meet(test.select(*g, "row_id", "features", "label"), context.select(*g, "row_id", "features", "label"), nearest,
                 f"{keys}row_id long, y_true int, ctx_id long, dist double, ctx_label int", block, block, by=by)
    w = Window.partitionBy(*g, "row_id").orderBy("dist", "ctx_id")
    top = parts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.lit(k))
    votes = top.groupBy(*g, "row_id", "y_true", F.col("ctx_label").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    # a context of fewer than k rows gives every test row that many votes
    total = top.groupBy(*g, "row_id").agg(F.count(F.lit(1)).alias("of"))
    if classes is None:
        seen = context.select("label").unionByName(test.select("label")).distinct()
        wanted = seen.select(F.array_sort(F.collect_set(F.col("label").cast("int")))).scalar()  # class list, bounded
    else:
        wanted = F.array(*[F.lit(int(c)) for c in classes])
    grid = test.select(*g, "row_id", F.col("label").cast("int").alias("y_true")).withColumn("class", F.explode(wanted))
    out = grid.join(total, g + ["row_id"], "left").join(votes, g + ["row_id", "y_true", "class"], "left")
    return out.select(*g, "row_id", "y_true", "class", F.coalesce(F.col("n") / F.col("of"), F.lit(0.0)).alias("prob"))


# ---------------------------------------------------------------- E2, E3, E4, E5
def logistic_predict(context: DataFrame, test: DataFrame, max_iter: int = 1000, c: float = 1.0) -> DataFrame:
    """Multinomial logistic regression (pyspark.ml) fitted on the context with an L2 penalty of strength 1 / ``c``:
    sum of losses + |w|^2 / (2 c), i.e. regParam = 1 / (c n) on the mean loss, without feature scaling."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array
    if (one := one_class_predict(context, test)) is not None:  # E5
        return one
    tr = context.select(array_to_vector("features").alias("fv"), F.col("label").cast("double").alias("y"))
    n = tr.count()
    model = LogisticRegression(featuresCol="fv", labelCol="y", maxIter=max_iter, tol=1e-8, family="multinomial",
                               regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False).fit(tr)
    te = test.select("row_id", F.col("label").alias("y_true"), array_to_vector("features").alias("fv"))
    pr = model.transform(te).select("row_id", "y_true", vector_to_array("probability").alias("p"))
    return pr.select("row_id", "y_true", F.posexplode("p").alias("class", "prob"))


def gbt_predict(context: DataFrame, test: DataFrame, max_iter: int = 100) -> DataFrame:
    """E3 for a context too large for one task (``boosting.boosted_trees`` is the scorer of selections): one binary
    pyspark.ml GBT per class (one-vs-rest), probabilities normalised per row."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    classes = sorted(r[0] for r in context.select("label").distinct().collect())  # bounded class list
    te = test.select("row_id", F.col("label").alias("y_true"), array_to_vector("features").alias("fv"))
    out = None
    for c in classes:
        tr = context.select(array_to_vector("features").alias("fv"),
                            (F.col("label") == c).cast("double").alias("y"))
        m = GBTClassifier(featuresCol="fv", labelCol="y", maxIter=max_iter, seed=42).fit(tr)
        p = m.transform(te).select("row_id", "y_true", F.lit(c).alias("class"),
                                   vector_to_array("probability")[1].alias("prob"))
        out = p if out is None else out.unionByName(p)
    s = F.sum("prob").over(Window.partitionBy("row_id"))
    return out.withColumn("prob", F.when(s > 0, F.col("prob") / s).otherwise(1.0 / len(classes)))


def user_scorer(context: DataFrame, test: DataFrame, fit_predict, classes: list[int]) -> DataFrame:
    """User scorer hook.  ``fit_predict(ctx_pdf, test_pdf) -> probs (n_test x n_classes)``; the
    context (a selection of at most ``V.MAX_CONTEXT_ROWS`` rows, checked before it is read) is broadcast and test rows
    are scored per Arrow batch."""
    if context.limit(V.MAX_CONTEXT_ROWS + 1).count() > V.MAX_CONTEXT_ROWS:
        raise ValueError(f"a user scorer takes a context of at most {V.MAX_CONTEXT_ROWS} rows")
    ctx = context.toPandas()
    b = test.sparkSession.sparkContext.broadcast(ctx)
    cls = np.asarray(classes)

    def fn(it):
        c = b.value
        for pdf in it:
            if len(pdf):
                p = np.asarray(fit_predict(c, pdf), dtype=np.float64)
                yield pd.DataFrame({"row_id": np.repeat(pdf["row_id"].to_numpy(), len(cls)),
                                    "y_true": np.repeat(pdf["label"].to_numpy(), len(cls)),
                                    "class": np.tile(cls, len(pdf)), "prob": p.ravel()})
    return test.mapInPandas(fn, "row_id long, y_true int, class long, prob double").withColumn(
        "class", F.col("class").cast("int"))


def one_class_predict(context: DataFrame, test: DataFrame) -> DataFrame | None:
    """E5: a context with one class predicts that class with probability 1 (None otherwise)."""
    cls = context.select("label").distinct().limit(2).collect()
    if len(cls) != 1:
        return None
    c = cls[0][0]
    return test.select("row_id", F.col("label").alias("y_true"), F.lit(c).cast("int").alias("class"),
                       F.lit(1.0).alias("prob"))


def score_runs(contexts: DataFrame, tests: DataFrame, run_key, fit_predict: Callable, test_rows: int = TEST_ROWS) -> DataFrame:
    """E4 for many runs in one job: (run key..., row_id, y_true, class, prob), one row per test row and class of its run.

    ``contexts`` and ``tests`` are (run key..., row_id, features, label).  ``fit_predict(context, test) -> (probabilities,
    labels)`` gets two pandas frames and returns a row per test row and a column per label it knows.  A context with one
    class predicts it with probability 1 and never reaches the scorer (E5); classes of the run (seen in its context or its
    test rows) that a scorer does not know get 0 (E6).  A run without context rows gives none.

    Runs meet by key; the test rows of a run are cut into blocks of about ``test_rows`` by a hash and its context, at most
    ``V.MAX_CONTEXT_ROWS`` rows (an error in the task beyond), goes to each, so one large run is many tasks.  Null keys are
    equal."""
    g = list(run_key)
    run = F.struct(*[F.col(c).alias(c) for c in g]).alias("_run")
    cols = ["row_id", "features", F.col("label").cast("int").alias("label")]
    c, t = contexts.select(run, *cols), tests.select(run, *cols)
    label_set = F.collect_set("label")  # without nulls
    seen = t.groupBy("_run").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(test_rows)), F.lit(1)).cast("int").alias("_n"), label_set.alias("_tested"))
    own = c.groupBy("_run").agg(label_set.alias("_given"))
    known = seen.join(own, "_run").select("_run", "_n", F.array_sort(F.array_union("_tested", "_given")).alias("_classes")).where("size(_classes) > 0")
    known = F.broadcast(known)  # one row a run with its classes
    c = c.join(known, "_run").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    t = t.join(F.broadcast(seen.select("_run", "_n")), "_run").withColumn("_b", F.pmod(F.xxhash64("row_id"), F.col("_n")).cast("int")).drop("_n")
    c, t = fresh(c, c.columns), fresh(t, t.columns)
    types = dict(tests.dtypes)
    names = ["row_id", "y_true", "class", "prob"]

    def scored(tested: pa.Table, given: pa.Table) -> pa.Table:
        if not len(tested) or not len(given):
            at, classes, p = np.zeros(0, np.int64), [], np.zeros((0, 0))
        elif len(given) > V.MAX_CONTEXT_ROWS:
            raise ValueError(f"a user scorer takes a context of at most {V.MAX_CONTEXT_ROWS} rows")
        else:
            own, rows = (x.select(["row_id", "features", "label"]).to_pandas().sort_values("row_id") for x in (given, tested))
            classes, at = given["_classes"][0].as_py(), rows.index.to_numpy()
            only = own["label"].unique()
            probs, labels = (np.ones((len(rows), 1)), only) if len(only) == 1 else fit_predict(own, rows)
            p = np.zeros((len(rows), len(classes)))
            for j, k in enumerate(labels):
                p[:, classes.index(int(k))] = np.asarray(probs, dtype=np.float64)[:, j]
        at = pa.array(np.repeat(at, len(classes)))
        keys = tested["_run"].combine_chunks()
        keys = pa.StructArray.from_arrays(keys.flatten(), [f.name for f in keys.type])  # fields may be null in the result's type
        values = [c.take(at) for c in (keys, tested["row_id"].combine_chunks(), tested["label"].combine_chunks())]  # run keys never become Python objects
        return pa.table([*values, pa.array(np.tile(np.array(classes, np.int32), len(p))), pa.array(p.ravel())], ["_run", *names])

    run_type = ", ".join(f"`{c}`: {types[c]}" for c in g)
    out = t.groupBy("_run", "_b").cogroup(c.groupBy("_run", "_b")).applyInArrow(
        scored, f"_run struct<{run_type}>, row_id {types['row_id']}, y_true int, class int, prob double")
    return out.select("_run.*", *names)


def knn_votes(k: int = 5) -> Callable:
    """A scorer for ``score_runs``: vote shares of the k nearest context rows, ties in distance to the lower row_id."""
    def fit_predict(context: pd.DataFrame, test: pd.DataFrame):
        labels = np.unique(context["label"])
        d = V.pairwise(V.stack(test["features"]), V.stack(context["features"]), "euclidean")
        near = np.lexsort((np.broadcast_to(context["row_id"].to_numpy(), d.shape), d), axis=1)[:, :max(1, min(k, len(context)))]
        votes = context["label"].to_numpy()[near]
        return np.column_stack([(votes == c).mean(axis=1) for c in labels]), labels
    return fit_predict


def predict_through(store, contexts: DataFrame, tests: DataFrame, fit_predict: Callable) -> DataFrame:
    """The predictions of every run of ``contexts`` (with the store's run key) through a prediction store.  A stored run
    is taken only if it has one row per test row and class of the run; only the others are scored."""
    g = store.run_key
    run = F.struct(*[F.col(c).alias(c) for c in g]).alias("_run")
    classes = contexts.select(run, "label").unionByName(tests.select(run, "label")).groupBy("_run").agg(F.count_distinct("label").alias("_c"))
    sizes = tests.groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    wanted = contexts.select(run).distinct().join(classes, "_run").join(sizes, "_run").select("_run.*", (F.col("_c") * F.col("_n")).alias("n_rows"))

    def compute(todo: DataFrame) -> DataFrame:
        def own(df):
            keys = fresh(todo, g)
            return df.join(keys, null_safe_on(df, keys, g), "left_semi")
        return score_runs(own(contexts), own(tests), g, fit_predict)
    return store.get_or_compute(wanted, compute)


def align_probs(pred: DataFrame, classes: DataFrame, by=()) -> DataFrame:
    """One row per (row, class) of the class table; absent classes get probability 0."""
    cls = [r[0] for r in classes.select("class").distinct().orderBy("class").collect()]  # bounded class list
    rows = pred.select(*by, "row_id", "y_true").distinct().withColumn(
        "class", F.explode(F.array(*[F.lit(int(c)) for c in cls])))
    return rows.join(pred, list(by) + ["row_id", "y_true", "class"], "left").fillna(0.0, subset=["prob"])


# ---------------------------------------------------------------- E7, E8 AUC
AUC_BUCKETS = 4096


def auc(pred: DataFrame, by=(), restrict_to_test_labels: bool = True) -> DataFrame:
    """One-vs-rest AUC per class by the Mann-Whitney form with average ranks (ties share).

    Exact and skew-safe: scores are first reduced to distinct values per (run, class) with
    positive / negative counts (a partial aggregate).  Probabilities are cut into fixed buckets
    of [0, 1]; rows below a bucket come from a cumulative sum over at most AUC_BUCKETS + 2
    bucket totals, rows below a score inside its bucket from a window over that bucket only,
    so one run with very many test rows is spread over many tasks.

    Binary (2 labels): the AUC of the larger label's column.  More labels: macro mean over
    the labels seen in test (E8: over all classes with both positives and negatives).
    Fewer than two labels in test: NULL.
    """
    g = list(by)
    pos = (F.col("y_true") == F.col("class")).cast("long")
    cnt = pred.groupBy(*g, "class", "prob").agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    b = F.when(F.col("prob") < 0, -1).when(F.col("prob") >= 1, AUC_BUCKETS) \
         .otherwise(F.floor(F.col("prob") * AUC_BUCKETS).cast("int"))
    cnt = cnt.withColumn("bucket", b).withColumn("t", F.col("p") + F.col("n"))
    tot = cnt.groupBy(*g, "class", "bucket").agg(F.sum("t").alias("bt"))
    wb = Window.partitionBy(*g, "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("before_bucket", F.coalesce(F.sum("bt").over(wb), F.lit(0)))
    wi = Window.partitionBy(*g, "class", "bucket").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (cnt.join(tot.select(*g, "class", "bucket", "before_bucket"), g + ["class", "bucket"])
              .withColumn("below", F.col("before_bucket") + F.coalesce(F.sum("t").over(wi), F.lit(0)))
              # average rank of the tied block = rows below + (block size + 1) / 2
              .withColumn("avg_rank", F.col("below") + (F.col("t") + 1) / 2.0))
    per = ranked.groupBy(*g, "class").agg(F.sum(F.col("p") * F.col("avg_rank")).alias("R"),
                                          F.sum("p").alias("P"), F.sum("n").alias("N"))
    per = per.withColumn("auc", F.when((F.col("P") > 0) & (F.col("N") > 0),
                                       (F.col("R") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * F.col("N"))))
    labels = pred.groupBy(*g).agg(F.count_distinct("y_true").alias("n_labels"),
                                  F.max("y_true").alias("max_label"))
    j = per.join(labels, g, "inner") if g else per.withColumn("n_labels", labels.select("n_labels").scalar()) \
        .withColumn("max_label", labels.select("max_label").scalar())
    keep = F.col("P") > 0 if restrict_to_test_labels else F.lit(True)
    out = j.filter(keep).groupBy(*g).agg(
        F.first("n_labels").alias("n_labels"),
        F.max(F.when(F.col("class") == F.col("max_label"), F.col("auc"))).alias("binary_auc"),
        F.avg("auc").alias("macro_auc"))
    return out.select(*g, F.when(F.col("n_labels") < 2, F.lit(None).cast("double"))
                      .when(F.col("n_labels") == 2, F.col("binary_auc"))
                      .otherwise(F.col("macro_auc")).alias("AUC"))


# ---------------------------------------------------------------- E9, E10, E11
def hard_predictions(pred: DataFrame, by=()) -> DataFrame:
    """Argmax class per row; ties go to the lowest class."""
    return (pred.groupBy(*by, "row_id", "y_true")
            .agg(F.max_by("class", F.struct(F.col("prob"), -F.col("class"))).alias("y_pred")))


def accuracy(hard: DataFrame, by=()) -> DataFrame:
    """E9."""
    return hard.groupBy(*by).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("ACC"))


def confusion(hard: DataFrame, by=()) -> DataFrame:
    """Per (run, class): tp, fp, fn over the union of true and predicted labels."""
    t = hard.select(*by, F.col("y_true").alias("class"),
                    (F.col("y_true") == F.col("y_pred")).cast("long").alias("tp"),
                    F.lit(0).cast("long").alias("fp"), (F.col("y_true") != F.col("y_pred")).cast("long").alias("fn"))
    p = hard.select(*by, F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("tp"),
                    (F.col("y_true") != F.col("y_pred")).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    return t.unionByName(p).groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                                      F.sum("fn").alias("fn"))


def macro_f1(hard: DataFrame, by=()) -> DataFrame:
    """Macro F1 over the label union; 0 where undefined."""
    c = confusion(hard, by)
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(den > 0, 2 * F.col("tp") / den).otherwise(0.0)
    return c.groupBy(*by).agg(F.avg(f1).alias("F1"))


def balanced_accuracy(hard: DataFrame, by=()) -> DataFrame:
    """Mean recall over the classes present in y_true."""
    c = confusion(hard, by).filter(F.col("tp") + F.col("fn") > 0)
    return c.groupBy(*by).agg(F.avg(F.col("tp") / (F.col("tp") + F.col("fn"))).alias("BalACC"))


def all_metrics(pred: DataFrame, by=()) -> DataFrame:
    """AUC, ACC, F1, BalACC per run, long: (by..., metric, value) (G1 shape).

    ACC, macro F1 and balanced accuracy come from one confusion aggregate (ACC = sum tp /
    sum (tp + fn), since every row is a tp or an fn of its true class); the AUC rows are
    unioned in long form, so no join is needed.
    """
    g = list(by)
    conf = confusion(hard_predictions(pred, by), by)
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    sup = F.col("tp") + F.col("fn")
    cls = conf.groupBy(*g).agg(
        (F.sum("tp") / F.sum(sup)).alias("ACC"),
        F.avg(F.when(den > 0, 2 * F.col("tp") / den).otherwise(0.0)).alias("F1"),
        F.avg(F.when(sup > 0, F.col("tp") / sup)).alias("BalACC"))
    a = auc(pred, by).select(*g, F.lit("AUC").alias("metric"), F.col("AUC").alias("value"))
    stack = "stack(3, 'ACC', ACC, 'F1', F1, 'BalACC', BalACC) as (metric, value)"
    return a.unionByName(cls.selectExpr(*g, stack))


def class_discovery(pool: DataFrame, selected: DataFrame, by=()) -> DataFrame:
    """Classes selected / classes in the pool."""
    from tessera.operators.select import class_coverage
    return class_coverage(pool, selected, by=by)


def knn_predict_grouped(contexts: DataFrame, test: DataFrame, k: int = 5, metric: str = "euclidean",
                        group: str = "candidate_id") -> DataFrame:
    """E1 for many contexts at once (one per candidate): every context against the whole test table.
    Output (group, row_id, y_true, class, prob)."""
    ids = contexts.select(F.array_sort(F.collect_set(group))).scalar()  # candidate ids: the population, bounded
    return knn_predict(contexts, test.withColumn(group, F.explode(ids)), k, metric, by=(group,))
