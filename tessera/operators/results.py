"""Result-table operators (G1-G29) on the long result fact.

Long fact columns: dataset, fold, space, method, n_selected, seed (nullable),
evaluator, metric, value.  The key is every column but ``value``; a NULL seed is
a key value of its own, so every key join is null-safe.

Aggregates stay long internally: (dataset, c, space, method, evaluator, metric,
value).  ``to_wide`` pivots only at the sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import null_safe_on, small_broadcast

BASE_SEED = 42
C_MULTIPLIERS = (1, 2, 4, 8, 16, 32)
METRICS = ("AUC", "ACC", "F1")
BASELINE_METHOD = "All"
# methods whose runs do not follow the seed window; callers add their own (e.g. a supervised search)
EXEMPT_METHODS = (BASELINE_METHOD,)
KEY = ["dataset", "fold", "space", "method", "n_selected", "seed", "evaluator", "metric"]
RUN_KEY = ["dataset", "fold", "space", "method", "evaluator", "n_selected", "seed", "metric"]
FOLD_KEY = ["dataset", "fold", "space", "method", "evaluator", "n_selected", "metric"]
CELL_KEY = ["dataset", "c", "space", "method", "evaluator", "metric"]
# decimals used to decide ties between averaged doubles (summation order differs by engine)
TIE_DECIMALS = 9


def _runs_table(spark, runs_per_method: dict) -> DataFrame:
    return spark.createDataFrame(sorted(runs_per_method.items()), "method string, runs int")


# ---------------------------------------------------------------- G1, G2, G3, G4, G5
def metric_rows(df: DataFrame, metrics_col: str = "metrics") -> DataFrame:
    """G1: a map<metric, value> column becomes one row per metric."""
    others = [c for c in df.columns if c != metrics_col]
    return df.select(*others, F.explode(metrics_col).alias("metric", "value"))


def key_condition(left: DataFrame, right: DataFrame, key=KEY) -> Column:
    """Normalised key match; NULL seed equals NULL seed only."""
    return null_safe_on(left, right, key)


def runs_to_do(expected: DataFrame, existing: DataFrame, key=KEY) -> DataFrame:
    """Expected (run key x metric) rows with no stored row yet (null-safe anti join).

    Keys use the *target* budget on both sides (the reference compares the
    selected count against the stored target, which never matches after clamping).
    """
    ex = existing.select(*key).dropDuplicates()
    return expected.join(ex, key_condition(expected, ex, key), "left_anti")


def dedupe_batch(batch: DataFrame, order_col: str, key=KEY, keep: str = "last") -> DataFrame:
    """One row per key; ``keep='last'`` keeps the row with the highest ``order_col``.

    An aggregate (``max_by`` / ``min_by`` of the whole row), so it combines map-side and a key
    holding a large share of the rows never sits in one task.
    """
    others = [c for c in batch.columns if c not in key]
    pick = F.max_by if keep == "last" else F.min_by
    return (batch.groupBy(*key).agg(pick(F.struct(*others), F.col(order_col)).alias("_r"))
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in others]))


def duplicate_keys(batch: DataFrame, key=KEY) -> DataFrame:
    """G4 check: keys that occur more than once in a batch."""
    return batch.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def null_report(df: DataFrame) -> DataFrame:
    """Per column, the number of NULL values (one pass, one row per column)."""
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return agg.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, n_null)")


# ---------------------------------------------------------------- G6, G7, G8
def summarize_values(col: Column, max_values: int = 5) -> Column:
    """G8: "a,b,c (+n more)" over a sorted distinct array column."""
    arr = F.array_sort(col)
    head = F.concat_ws(",", F.slice(arr, 1, max_values))
    extra = F.size(arr) - F.lit(max_values)
    return F.when(extra > 0, F.concat(head, F.lit(" (+"), extra.cast("string"), F.lit(" more)"))).otherwise(head)


def duplicate_key_report(df: DataFrame, key=KEY, value_col: str = "value",
                         file_col: str | None = None) -> DataFrame:
    """Per duplicated key: rows, distinct values (NULL counts as one), conflicting flag, files."""
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            (F.count_distinct(value_col) + F.max(F.col(value_col).isNull().cast("int"))).alias("n_values")]
    if file_col:
        aggs.append(summarize_values(F.collect_set(file_col)).alias("files"))
    rep = df.groupBy(*key).agg(*aggs).filter("n_rows > 1")
    return rep.withColumn("conflicting", F.col("n_values") > 1)


def duplicate_summary(report: DataFrame, by=("space", "method")) -> DataFrame:
    """Duplicate keys per method: duplicated keys, conflicting keys, surplus rows."""
    return (report.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("duplicate_keys"),
                 F.count_if("conflicting").alias("conflicting_keys"),
                 F.sum(F.col("n_rows") - 1).alias("surplus_rows")))


# ---------------------------------------------------------------- G9, G10
def seed_window(df: DataFrame, runs_per_method: dict, base_seed: int = BASE_SEED,
                exempt=EXEMPT_METHODS) -> DataFrame:
    """Keep base <= seed < base + runs(method); exempt methods pass; NULL seeds of others drop.

    Methods missing from the table count one run.  The runs table is tiny
    (one row per configured method) and broadcast.
    """
    runs = small_broadcast(_runs_table(df.sparkSession, runs_per_method))
    j = df.join(runs, "method", "left")
    n = F.coalesce(F.col("runs"), F.lit(1))
    keep = (F.col("method").isin(*exempt)
            | ((F.col("seed") >= base_seed) & (F.col("seed") <= F.lit(base_seed) + n - 1)))
    return j.filter(keep).drop("runs")


def missing_runs(runs_df: DataFrame, runs_per_method: dict, base_seed: int = BASE_SEED,
                 exempt=EXEMPT_METHODS) -> DataFrame:
    """Groups (dataset, fold, space, method, evaluator) with fewer distinct in-window seeds than expected."""
    g = ["dataset", "fold", "space", "method", "evaluator"]
    methods = runs_df.filter(~F.col("method").isin(*exempt))
    expected = methods.select(*g).distinct()
    kept = seed_window(methods, runs_per_method, base_seed, exempt)
    have = kept.groupBy(*g).agg(F.count_distinct("seed").alias("n_runs"))
    runs = small_broadcast(_runs_table(runs_df.sparkSession, runs_per_method))
    return (expected.join(have, g, "left").join(runs, "method", "left")
            .select(*g, F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
                    F.coalesce("runs", F.lit(1)).alias("expected_runs"))
            .filter("n_runs < expected_runs"))


# ---------------------------------------------------------------- G11, G12, G13, G14, G15
def missing_datasets(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """Catalog datasets with no result row."""
    return catalog.select("dataset").distinct().join(results.select("dataset").distinct(), "dataset", "left_anti")


def filter_by_catalog(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keep result rows whose dataset the (filtered) catalog allows."""
    return results.join(catalog.select("dataset").distinct(), "dataset", "left_semi")


def suite_covering(results: DataFrame, suites: DataFrame) -> DataFrame:
    """Suites (suite, dataset) that contain every result dataset, smallest first."""
    ds = results.select("dataset").distinct()
    n_needed = ds.count()
    hit = suites.join(ds, "dataset", "left_semi").groupBy("suite").agg(F.count_distinct("dataset").alias("n"))
    size = suites.groupBy("suite").agg(F.count_distinct("dataset").alias("suite_size"))
    return hit.filter(F.col("n") == n_needed).join(size, "suite").select("suite", "suite_size")


def budget_filter(results: DataFrame, catalog: DataFrame, multipliers=C_MULTIPLIERS,
                  keep_baseline: bool = True) -> DataFrame:
    """Keep rows whose budget is c x n_classes with c in ``multipliers``; add column c.

    Baseline rows are kept with c NULL.  Datasets missing from the catalog drop
    (``unknown_budget_datasets`` lists them).
    """
    cat = catalog.select("dataset", "n_classes")
    j = results.join(cat, "dataset", "inner")
    c = F.expr("cast(n_selected div n_classes as int)")
    ok = (F.col("n_selected") % F.col("n_classes") == 0) & c.isin(*multipliers)
    base = F.col("method") == BASELINE_METHOD
    cond = (base | ok) if keep_baseline else (ok & ~base)
    return j.filter(cond).withColumn("c", F.when(base, F.lit(None).cast("int")).otherwise(c)).drop("n_classes")


def unknown_budget_datasets(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """G14 report: result datasets without a class count."""
    return results.select("dataset").distinct().join(catalog.select("dataset"), "dataset", "left_anti")


def slice_results(df: DataFrame, triples=None, metric_pairs=None, folds=None) -> DataFrame:
    """Keep configured (space, method, evaluator) triples, evaluator->metric pairs and folds,
    then add the baseline rows of any evaluator, distinct.

    ``triples`` / ``metric_pairs`` are small config lists and are broadcast.
    """
    spark = df.sparkSession
    base = df.filter(F.col("method") == BASELINE_METHOD)
    sel = df.filter(F.col("method") != BASELINE_METHOD)
    if triples is not None:
        t = small_broadcast(spark.createDataFrame(list(triples), "space string, method string, evaluator string"))
        sel = sel.join(t, ["space", "method", "evaluator"], "left_semi")
    if metric_pairs is not None:
        m = small_broadcast(spark.createDataFrame(list(metric_pairs), "evaluator string, metric string"))
        sel = sel.join(m, ["evaluator", "metric"], "left_semi")
        base = base.join(small_broadcast(m.select("metric").distinct()), "metric", "left_semi")
    out = sel.unionByName(base)
    if folds is not None:
        out = out.filter(F.col("fold").isin(*folds))
    return out.distinct()


# ---------------------------------------------------------------- G16, G17, G18
def run_means(df: DataFrame) -> DataFrame:
    """G16 first stage: mean over duplicate rows of one run (NULL seed stays a group)."""
    return (df.filter(F.col("value").isNotNull())
            .groupBy(*RUN_KEY).agg(F.avg("value").alias("value")))


def seed_means(run_df: DataFrame) -> DataFrame:
    """G16 second stage: mean over seeds per fold."""
    return run_df.groupBy(*FOLD_KEY).agg(F.avg("value").alias("value"))


def run_and_seed_means(df: DataFrame, runs_per_method: dict, base_seed: int = BASE_SEED,
                       exempt=EXEMPT_METHODS) -> DataFrame:
    """G16 with G9 in between: run mean -> seed window -> seed mean (per fold)."""
    return seed_means(seed_window(run_means(df), runs_per_method, base_seed, exempt))


def metrics_side_by_side(fold_df: DataFrame, metrics=METRICS) -> DataFrame:
    """One column per metric (pivot with a fixed value list: one pass, no join)."""
    key = [c for c in fold_df.columns if c not in ("metric", "value")]
    return fold_df.groupBy(*key).pivot("metric", list(metrics)).agg(F.first("value"))


def missing_metrics(fold_df: DataFrame, metrics=METRICS) -> DataFrame:
    """(dataset, space, method, evaluator, n_selected, metric) with a metric absent in some folds,
    with the sorted list of folds where it is absent.  Baseline rows are left out."""
    g = ["dataset", "space", "method", "evaluator", "n_selected"]
    fold_df = fold_df.filter(F.col("method") != BASELINE_METHOD)
    expected = fold_df.select(*g, "fold").distinct().withColumn(
        "metric", F.explode(F.array(*[F.lit(x) for x in metrics])))
    missing = expected.join(fold_df.select(*g, "fold", "metric").distinct(), g + ["fold", "metric"], "left_anti")
    return missing.groupBy(*g, "metric").agg(F.array_sort(F.collect_set("fold")).alias("missing_folds"))


# ---------------------------------------------------------------- G19, G20, G21, G22
def baseline(fold_df: DataFrame, folds=None, per_evaluator: bool = True) -> DataFrame:
    """Mean of baseline rows per fold, then over folds (equal weight per fold).

    ``per_evaluator=False`` mixes evaluators as the reference does.
    """
    b = fold_df.filter(F.col("method") == BASELINE_METHOD)
    if folds is not None:
        b = b.filter(F.col("fold").isin(*folds))
    g = ["dataset", "evaluator", "metric"] if per_evaluator else ["dataset", "metric"]
    per_fold = b.groupBy(*g, "fold").agg(F.avg("value").alias("value"))
    return per_fold.groupBy(*g).agg(F.avg("value").alias("baseline"), F.count(F.lit(1)).alias("n_folds"))


def fold_means(fold_df: DataFrame, catalog: DataFrame, multipliers=C_MULTIPLIERS, folds=None) -> DataFrame:
    """G20 (long form): mean over folds per (dataset, c, space, method, evaluator, metric), n = c x C."""
    df = fold_df.filter(F.col("method") != BASELINE_METHOD)
    if folds is not None:
        df = df.filter(F.col("fold").isin(*folds))
    b = budget_filter(df, catalog, multipliers, keep_baseline=False)
    return b.groupBy(*CELL_KEY).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_folds"))


def aggregate(results: DataFrame, catalog: DataFrame, runs_per_method: dict,
              multipliers=C_MULTIPLIERS, folds=None, base_seed: int = BASE_SEED):
    """G9 -> G16 -> G20 (+G19): returns (long cell means, baselines)."""
    fold_df = run_and_seed_means(results, runs_per_method, base_seed)
    return fold_means(fold_df, catalog, multipliers, folds), baseline(fold_df, folds)


def with_improvability(long_df: DataFrame, base_df: DataFrame, per_evaluator: bool = True) -> DataFrame:
    """improvability = (1 - value / baseline) * 100; NULL when the baseline is missing or 0."""
    on = ["dataset", "evaluator", "metric"] if per_evaluator else ["dataset", "metric"]
    b = base_df.select(*on, "baseline")
    return (long_df.join(b, on, "left")
            .withColumn("improvability", (F.lit(1.0) - F.try_divide(F.col("value"), F.col("baseline"))) * 100))


def with_dense_rank(long_df: DataFrame, value_col: str = "value") -> DataFrame:
    """Dense rank of methods within (dataset, c, evaluator, metric), higher better, NULL unranked."""
    v = F.round(F.col(value_col), TIE_DECIMALS)
    w = Window.partitionBy("dataset", "c", "evaluator", "metric").orderBy(v.desc())
    ranked = long_df.filter(F.col(value_col).isNotNull()).withColumn("rank", F.dense_rank().over(w))
    nulls = long_df.filter(F.col(value_col).isNull()).withColumn("rank", F.lit(None).cast("int"))
    return ranked.unionByName(nulls)


# ---------------------------------------------------------------- wide sink and reader: G20 pivot, G23, G28
def wide_column_name() -> Column:
    return F.concat(F.col("c").cast("string"), F.lit("C_"), F.col("space"), F.lit("_"), F.col("method"),
                    F.lit("_"), F.col("evaluator"), F.lit("_"), F.col("metric"))


def to_wide(long_df: DataFrame, catalog: DataFrame, base_df: DataFrame | None = None,
            columns: list[str] | None = None) -> DataFrame:
    """G20 sink: one row per dataset, ``{c}C_{space}_{method}_{evaluator}_{metric}`` columns,
    catalog metadata joined; baseline columns ``Orig_All_{evaluator}_{metric}``.

    Pass ``columns`` (the expected wide columns) to spare the distinct pass.
    """
    named = long_df.select("dataset", wide_column_name().alias("col"), "value")
    if base_df is not None:
        named = named.unionByName(base_df.select(
            "dataset", F.concat(F.lit("Orig_All_"), F.col("evaluator"), F.lit("_"), F.col("metric")).alias("col"),
            F.col("baseline").alias("value")))
    wide = named.groupBy("dataset").pivot("col", columns).agg(F.first("value"))
    meta = catalog.select("dataset", "n_samples", "n_features", "n_classes", "imbalance_ratio")
    return meta.join(wide, "dataset", "right")


WIDE_COLUMN_REGEX = r"^(\d+)C_([^_]+)_([^_]+)_([^_]+)_([^_]+?)(?:_(I|RANK))?$"


def wide_to_long(wide: DataFrame, id_cols=("dataset",)) -> DataFrame:
    """Unpivot a wide table and decode each column name into c, space, method, evaluator, metric, suffix."""
    value_cols = [c for c in wide.columns if c not in id_cols and c[:1].isdigit()]
    u = wide.select(*id_cols, *[F.col(f"`{c}`").cast("double").alias(c) for c in value_cols]).unpivot(
        list(id_cols), value_cols, "col", "value")
    r = WIDE_COLUMN_REGEX
    return u.select(*id_cols,
                    F.regexp_extract("col", r, 1).cast("int").alias("c"),
                    F.regexp_extract("col", r, 2).alias("space"),
                    F.regexp_extract("col", r, 3).alias("method"),
                    F.regexp_extract("col", r, 4).alias("evaluator"),
                    F.regexp_extract("col", r, 5).alias("metric"),
                    F.nullif(F.regexp_extract("col", r, 6), F.lit("")).alias("suffix"),
                    "value")


def missing_cells(long_df: DataFrame, catalog: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per wide column, the catalog datasets with no value (sorted).  ``columns`` is the configured list of wide
    columns; one without any value is listed with every dataset.  By default the columns that have a row.

    The grid of datasets and columns is exploded from the column list and anti-joined, so no dataset list is
    gathered before the groups of missing ones.
    """
    have = long_df.filter(F.col("value").isNotNull()).select(wide_column_name().alias("col"), "dataset").distinct()
    names = F.array(*[F.lit(c) for c in columns]) if columns else \
        long_df.select(F.collect_set(wide_column_name())).scalar()  # column names: the configuration, bounded
    grid = catalog.select("dataset").distinct().withColumn("col", F.explode(names))
    gone = grid.join(have, ["col", "dataset"], "left_anti")
    return gone.groupBy("col").agg(F.array_sort(F.collect_list("dataset")).alias("datasets")).withColumn(
        "n_missing", F.size("datasets"))


# ---------------------------------------------------------------- G24, G25, G26, G27, G29
def compact_long(long_df: DataFrame, base_df: DataFrame) -> DataFrame:
    """G24 input: values, improvabilities and ranks as rows of ``kind`` value / improvability / rank."""
    ranked = with_improvability(with_dense_rank(long_df), base_df)
    return ranked.select(*CELL_KEY, F.expr(
        "stack(3, 'value', value, 'improvability', improvability, 'rank', cast(rank as double)) as (kind, value)"))


def compact_table(long_df: DataFrame, multipliers=C_MULTIPLIERS) -> DataFrame:
    """Mean over datasets per (space, method, evaluator, metric[, kind]); budgets as columns.  With
    ``compact_long`` the table also holds improvabilities and ranks."""
    key = ["space", "method", "evaluator", "metric"] + (["kind"] if "kind" in long_df.columns else [])
    return long_df.groupBy(*key).pivot("c", list(multipliers)).agg(F.avg("value"))


def best_flags(compact_long: DataFrame, lower_is_better: bool = False, decimals: int = 4) -> DataFrame:
    """Best (1) / second best (2) per (evaluator, metric, c), near-equal values tie.

    Input is long: (space, method, evaluator, metric, c, value).
    """
    v = F.round("value", decimals)
    w = Window.partitionBy("evaluator", "metric", "c").orderBy(v.asc() if lower_is_better else v.desc())
    return (compact_long.filter(F.col("value").isNotNull())
            .withColumn("place", F.dense_rank().over(w))
            .withColumn("flag", F.when(F.col("place") == 1, "best").when(F.col("place") == 2, "second")))


def metric_lower_is_better(metric: Column) -> Column:
    """Metric direction (ranks and improvability are lower-is-better)."""
    m = F.upper(metric)
    return m.contains("RANK") | m.endswith("_I")


def display_order(df: DataFrame, names: DataFrame) -> DataFrame:
    """Display names and order: random first, then by space, k-medoids last.

    ``names`` is (space, method, display_name, method_order) — a config table, broadcast.
    """
    j = df.join(small_broadcast(names), ["space", "method"], "left")
    is_random = F.lower(F.col("method")).contains("random")
    is_km = F.lower(F.col("method")).contains("kmedoids")
    return j.withColumn("display_name", F.coalesce("display_name", F.concat_ws("/", "space", "method"))) \
        .orderBy(F.when(is_random, 0).when(is_km, 2).otherwise(1), "space", F.coalesce("method_order", F.lit(99)), "method")


def evaluator_slices(long_df: DataFrame, evaluator: str) -> DataFrame:
    """Slice of the long table for one evaluator."""
    return long_df.filter(F.col("evaluator") == evaluator)


def fold_coverage(fold_df: DataFrame, n_folds: int, expected_cells: DataFrame | None = None) -> DataFrame:
    """Cells and baselines with fewer folds than expected, with the missing folds.  ``expected_cells`` is the
    configured grid (the cell key columns); its cells without any fold are listed with all folds missing."""
    g = ["dataset", "space", "method", "evaluator", "n_selected", "metric"]
    expected = F.sequence(F.lit(0), F.lit(n_folds - 1))
    rows = fold_df.select(*g, "fold")
    if expected_cells is not None:
        rows = rows.unionByName(expected_cells.select(*g).withColumn("fold", F.lit(None).cast("int")))
    return (rows.groupBy(*g).agg(F.array_sort(F.collect_set("fold")).alias("folds"))
            .filter(F.size("folds") < n_folds)
            .withColumn("missing_folds", F.array_except(expected, "folds")))


def combination_coverage(long_df: DataFrame, catalog: DataFrame, combinations: list[tuple] | None = None) -> DataFrame:
    """(space, method, evaluator) combinations with the datasets that have no row.  ``combinations`` is the configured
    list; one without any row is listed with every dataset.  By default the combinations that have a row."""
    names = ["space", "method", "evaluator"]
    have = long_df.select("dataset", *names).distinct()
    if combinations:
        combos = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c)]) for c in combinations])
    else:
        combos = long_df.select(F.collect_set(F.struct(*names))).scalar()  # the configuration, bounded
    grid = catalog.select("dataset").distinct().withColumn("_k", F.explode(combos)).select("dataset", *[F.col(f"_k.{n}").alias(n) for n in names])
    gone = grid.join(have, ["dataset", *names], "left_anti")
    return gone.groupBy(*names).agg(F.array_sort(F.collect_list("dataset")).alias("datasets"))
