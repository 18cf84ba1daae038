"""Statistics over aggregated scores.

Input of most operators is a *score table*: one row per (dataset, c, label)
with ``value`` (mean over folds) for one metric and evaluator, built by
``label_scores`` (H1).  Everything is DataFrame work; only distribution tails
run in Arrow-batched pandas UDFs (``tessera.functions.tails``).

Rank rules: average ranks with shared ties (H2, H4, H13, H15), dense (G22),
ordinal (H6).  Values are rounded to ``TIE_DECIMALS`` before ties are decided,
so engines that sum in different orders agree on ties.

Wilcoxon and Mann-Whitney p-values follow SciPy's automatic choice: the exact
distribution for small samples without ties (signed rank: at most 50 differences,
none zero; rank sum: one side of at most 8), else the tie-corrected normal form
(rank sum: with continuity correction).
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import seeded_order
from tessera.functions.joins import small_broadcast
from tessera.functions.tails import (chi2_sf_udf, mann_whitney_p_udf, nemenyi_cd, normal_p_udf, range_sf_udf,
                                     signed_rank_p_udf)

TIE_DECIMALS = 9
C_BUDGETS = (1, 2, 4, 8, 16, 32)
EXACT_PAIRS, EXACT_SIDE = 50, 8


def _r(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, TIE_DECIMALS)


# ---------------------------------------------------------------- H1
def label_scores(long_df: DataFrame, labels: DataFrame, metric: str, evaluator: str | None = None) -> DataFrame:
    """H1: (dataset, c, label, label_order, value) for one metric (and evaluator).

    ``labels`` is the (space, method, label, label_order) config table; rows of other
    methods drop.
    """
    df = long_df.filter(F.col("metric") == metric)
    if evaluator is not None:
        df = df.filter(F.col("evaluator") == evaluator)
    return (df.join(small_broadcast(labels), ["space", "method"], "inner")
            .select("dataset", "c", "label", "label_order", "value"))


def active_labels(scores: DataFrame) -> DataFrame:
    """H1: labels with at least one value."""
    return scores.filter(F.col("value").isNotNull()).groupBy("label", "label_order").count().drop("count")


def _active_scores(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("value").isNotNull()).join(active_labels(scores).select("label"), "label", "left_semi")


# ---------------------------------------------------------------- H2
def complete_case_ranks(scores: DataFrame) -> DataFrame:
    """Average ranks (1 = best, ties share) per (dataset, c) over datasets where every active label has a value."""
    act = _active_scores(scores)
    k = active_labels(scores).select(F.count(F.lit(1))).scalar()
    w_cell = Window.partitionBy("dataset", "c")
    complete = act.withColumn("_n", F.count(F.lit(1)).over(w_cell)).filter(F.col("_n") == k).drop("_n")
    rv = _r("value")
    w_rank = Window.partitionBy("dataset", "c").orderBy(rv.desc())
    w_tie = Window.partitionBy("dataset", "c", rv)
    return complete.withColumn(
        "rank", F.rank().over(w_rank) + (F.count(F.lit(1)).over(w_tie) - 1) / 2.0)


def mean_ranks(scores: DataFrame) -> DataFrame:
    """H2: mean of average ranks per (c, label) on complete datasets, with the number of datasets."""
    ranks = complete_case_ranks(scores)
    n = ranks.groupBy("c").agg(F.count_distinct("dataset").alias("n_datasets"))
    return (ranks.groupBy("c", "label").agg(F.avg("rank").alias("mean_rank"))
            .join(n, "c"))


# ---------------------------------------------------------------- H3
def critical_distance(n_methods: int, n_datasets: int, alpha: float = 0.05) -> float:
    """H3: Nemenyi critical distance (driver scalar from two counts)."""
    return nemenyi_cd(n_methods, n_datasets, alpha)


# ---------------------------------------------------------------- H4, H5 (paired Wilcoxon)
def pair_differences(scores: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Paired differences value(a) - value(b) per (c, dataset) for the given label pairs.

    Labels are pivoted to columns (fixed list), then the configured pairs are stacked:
    no self-join.  Rows where either side is missing drop (pairwise complete).
    """
    labels = sorted({x for p in pairs for x in p})
    wide = scores.groupBy("dataset", "c").pivot("label", labels).agg(F.first("value"))
    stack = ", ".join(f"'{a}', '{b}', `{a}`, `{b}`" for a, b in pairs)
    return (wide.selectExpr("dataset", "c", f"stack({len(pairs)}, {stack}) as (label_a, label_b, value_a, value_b)")
            .filter("value_a is not null and value_b is not null")
            .withColumn("d", F.col("value_a") - F.col("value_b")))


def wilcoxon(diffs: DataFrame, group=("c", "label_a", "label_b"), zero_method: str = "zsplit",
             min_pairs: int = 5) -> DataFrame:
    """H4/H5: two-sided paired Wilcoxon signed-rank test per group.

    zsplit: zero differences are ranked and their ranks split between W+ and W-;
    wilcox: zero differences are dropped first.  Output: n, w_plus, w_minus,
    statistic = min(W+, W-), z (tie-corrected normal form), p.  Groups with fewer
    than ``min_pairs`` pairs get NULL statistics.
    """
    g = list(group)
    d = diffs.withColumn("d", _r("d"))
    d = d.withColumn("zeros", F.count_if(F.col("d") == 0).over(Window.partitionBy(*g)))
    if zero_method == "wilcox":
        d = d.filter(F.col("d") != 0)
    a = F.abs(F.col("d"))
    w = Window.partitionBy(*g).orderBy(a)
    wt = Window.partitionBy(*g, a)
    ranked = d.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0) \
              .withColumn("t", F.count(F.lit(1)).over(wt))
    agg = ranked.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.max("zeros").alias("zeros"),
        (F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0))
         + F.sum(F.when(F.col("d") == 0, F.col("r")).otherwise(0.0)) / 2).alias("w_plus"),
        (F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0))
         + F.sum(F.when(F.col("d") == 0, F.col("r")).otherwise(0.0)) / 2).alias("w_minus"),
        # sum over tie groups of (t^3 - t): each row of a group of size t adds (t^2 - 1)
        F.sum(F.col("t") * F.col("t") - 1).alias("tie_term"))
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    stat = F.least("w_plus", "w_minus")
    z = F.when(var > 0, (stat - mean) / F.sqrt(var))
    ok = F.col("n") >= min_pairs
    exact = (n <= EXACT_PAIRS) & (F.col("zeros") == 0) & (F.col("tie_term") == 0)
    # the functions see rows of the other branch too, so their arguments are made harmless there
    p_exact = signed_rank_p_udf(F.when(exact, F.col("n")).otherwise(F.lit(1)), F.when(exact, F.col("stat")).otherwise(F.lit(0.0)))
    p_normal = F.when(F.col("z").isNull(), F.lit(1.0)).otherwise(normal_p_udf("z"))
    return agg.withColumn("stat", stat).withColumn("z", F.when(ok, z)) \
              .withColumn("p_value", F.when(ok, F.when(exact, p_exact).otherwise(p_normal))) \
              .select(*g, "n", "w_plus", "w_minus", F.when(ok, F.col("stat")).alias("statistic"), "z", "p_value")


def all_pairs(labels: list[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(labels, 2))


# ---------------------------------------------------------------- H6, H7, H8
def bh_adjust(tests: DataFrame, group=("c",), p_col: str = "p_value") -> DataFrame:
    """H6: Benjamini-Hochberg q-values per group: least(1, p n / i), then running min from the top."""
    g = list(group)
    valid = tests.filter(F.col(p_col).isNotNull() & ~F.isnan(p_col))
    w_i = Window.partitionBy(*g).orderBy(F.col(p_col))
    w_n = Window.partitionBy(*g)
    w_top = Window.partitionBy(*g).orderBy(F.col(p_col).desc(), F.col("_i").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    q = (valid.withColumn("_i", F.row_number().over(w_i))
         .withColumn("_n", F.count(F.lit(1)).over(w_n))
         .withColumn("_raw", F.least(F.lit(1.0), F.col(p_col) * F.col("_n") / F.col("_i")))
         .withColumn("q_value", F.min("_raw").over(w_top))
         .drop("_i", "_n", "_raw"))
    invalid = tests.filter(F.col(p_col).isNull() | F.isnan(p_col)).withColumn("q_value", F.lit(None).cast("double"))
    return q.unionByName(invalid)


def stars(q: Column) -> Column:
    """H7: significance stars at .05/.01/.001 (empty when NULL or not significant)."""
    return (F.when(q.isNull(), "").when(q < 0.001, "***").when(q < 0.01, "**")
            .when(q < 0.05, "*").otherwise(""))


def vs_reference_tests(scores: DataFrame, reference: str, labels: list[str]) -> DataFrame:
    """H4+H6: Wilcoxon of every label against ``reference`` per budget, BH-corrected per budget."""
    pairs = [(lab, reference) for lab in labels if lab != reference]
    t = wilcoxon(pair_differences(scores, pairs))
    return bh_adjust(t.withColumnRenamed("label_a", "label").drop("label_b"))


def with_band(ranks: DataFrame, cd) -> DataFrame:
    """H8: in_band = mean_rank <= best + CD; is_best = within 0.005 of the best."""
    w = Window.partitionBy("c")
    best = F.min("mean_rank").over(w)
    return (ranks.withColumn("best_rank", best)
            .withColumn("is_best", F.abs(F.col("mean_rank") - F.col("best_rank")) < 0.005)
            .withColumn("in_band", F.col("mean_rank") <= F.col("best_rank") + (cd if isinstance(cd, Column) else F.lit(cd))))


# ---------------------------------------------------------------- H9, H10, H11
def rank_table(scores: DataFrame, reference: str, labels: list[str], alpha: float = 0.05) -> DataFrame:
    """H9: mean rank per (c, label) with best / in-band / star flags.  ``labels`` is the configured list; labels
    without values take no part.

    The CD uses the number of active labels and the number of datasets in the scores; both are scalar
    subqueries, so building the plan runs no job.
    """
    ranks = mean_ranks(scores)
    k = active_labels(scores).select(F.count(F.lit(1))).scalar()
    n_ds = scores.select(F.count_distinct("dataset")).scalar()
    # quantile part of the critical distance for 0..len(labels) methods
    unit = F.array(*[F.lit(critical_distance(m, 1, alpha) if m >= 2 else float("nan")) for m in range(len(labels) + 1)])
    cd = F.get(unit, k.cast("int")) / F.sqrt(n_ds)
    tests = vs_reference_tests(scores, reference, labels).select("c", "label", "p_value", "q_value")
    return (with_band(ranks, cd).join(tests, ["c", "label"], "left")
            .withColumn("stars", stars(F.col("q_value")))
            .withColumn("cd", cd))


def rank_table_check(table: DataFrame) -> DataFrame:
    """H9 self-check: budgets whose number of best flags is not at least one."""
    return table.groupBy("c").agg(F.count_if("is_best").alias("n_best")).filter("n_best < 1")


def friedman(scores: DataFrame, min_datasets: int = 5) -> DataFrame:
    """Friedman chi-square per budget on complete datasets (tie-corrected), p from chi2(k-1)."""
    ranks = complete_case_ranks(scores)
    rv = _r("value")
    ties = (ranks.groupBy("c", "dataset", rv.alias("v")).agg(F.count(F.lit(1)).alias("t"))
            .groupBy("c").agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("tie_sum")))
    per = ranks.groupBy("c", "label").agg(F.sum("rank").alias("R"), F.count(F.lit(1)).alias("N"))
    agg = per.groupBy("c").agg(F.sum(F.col("R") ** 2).alias("sum_r2"), F.max("N").alias("n_datasets"),
                               F.count(F.lit(1)).alias("n_methods")).join(ties, "c")
    n, k = F.col("n_datasets").cast("double"), F.col("n_methods").cast("double")
    chi = 12.0 / (n * k * (k + 1)) * F.col("sum_r2") - 3 * n * (k + 1)
    corr = 1 - F.col("tie_sum") / (n * k * (k * k - 1))
    out = agg.withColumn("friedman_chi2", F.when(corr > 0, chi / corr)) \
             .filter((F.col("n_datasets") >= min_datasets) & (F.col("n_methods") >= 2))
    return out.select("c", "n_datasets", "n_methods", "friedman_chi2",
                      chi2_sf_udf("friedman_chi2", F.col("n_methods") - 1).alias("friedman_p"))


def nemenyi_pairs(scores: DataFrame) -> DataFrame:
    """Nemenyi pairwise p-values from mean ranks (studentized range, df = inf)."""
    mr = mean_ranks(scores)
    k = mr.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    a = mr.select("c", F.col("label").alias("label_a"), F.col("mean_rank").alias("rank_a"), "n_datasets")
    b = mr.select("c", F.col("label").alias("label_b"), F.col("mean_rank").alias("rank_b"))
    # pairs of methods per budget: bounded by the method list (k*(k-1)/2 rows)
    j = a.join(b, "c").filter(F.col("label_a") < F.col("label_b")).join(k, "c")
    se = F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n_datasets")))
    q = F.abs(F.col("rank_a") - F.col("rank_b")) / se * math.sqrt(2.0)
    return j.withColumn("q", q).withColumn("p_value", range_sf_udf("q", "k"))


# ---------------------------------------------------------------- H12, H13
def gain_decomposition(scores: DataFrame, target: str, orig: str, random: str) -> DataFrame:
    """Selector gain = orig - random, representation gain = target - orig, per budget:
    means and paired Wilcoxon p (zsplit) on datasets where the three labels have values."""
    wide = (scores.groupBy("dataset", "c").pivot("label", [target, orig, random]).agg(F.first("value"))
            .dropna(subset=[target, orig, random]))
    diffs = wide.selectExpr("dataset", "c", f"stack(2, 'selector', `{orig}` - `{random}`, "
                                             f"'representation', `{target}` - `{orig}`) as (gain, d)")
    means = diffs.groupBy("c", "gain").agg(F.avg("d").alias("mean_gain"), F.count(F.lit(1)).alias("n"))
    tests = wilcoxon(diffs, group=("c", "gain")).select("c", "gain", "p_value")
    return means.join(tests, ["c", "gain"], "left")


def mann_whitney(values: DataFrame, group=("c",), side_col: str = "side", value_col: str = "d",
                 min_each: int = 3) -> DataFrame:
    """Two-sided Mann-Whitney U between side 0 and side 1: exact without ties if a side has at most EXACT_SIDE values, else
    the normal form with tie and continuity correction."""
    g = list(group)
    v = _r(value_col)
    w = Window.partitionBy(*g).orderBy(v)
    wt = Window.partitionBy(*g, v)
    r = values.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0) \
              .withColumn("t", F.count(F.lit(1)).over(wt))
    agg = r.groupBy(*g).agg(
        F.count_if(F.col(side_col) == 0).alias("n0"), F.count_if(F.col(side_col) == 1).alias("n1"),
        F.sum(F.when(F.col(side_col) == 0, F.col("r"))).alias("r0"),
        F.sum(F.col("t") * F.col("t") - 1).alias("tie_term"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    u0 = F.col("r0") - n0 * (n0 + 1) / 2
    n = n0 + n1
    var = n0 * n1 / 12.0 * ((n + 1) - F.col("tie_term") / (n * (n - 1)))
    z = (F.greatest(u0, n0 * n1 - u0) - n0 * n1 / 2 - 0.5) / F.sqrt(var)
    ok = (F.col("n0") >= min_each) & (F.col("n1") >= min_each) & (var > 0)
    exact = ok & (F.least(n0, n1) <= EXACT_SIDE) & (F.col("tie_term") == 0)
    one = F.lit(1)
    p_exact = mann_whitney_p_udf(F.when(exact, F.col("n0")).otherwise(one), F.when(exact, F.col("n1")).otherwise(one),
                                 F.when(exact, F.col("u")).otherwise(F.lit(0.0)))
    p_normal = F.when(F.col("z") <= 0, F.lit(1.0)).otherwise(normal_p_udf("z"))
    return agg.withColumn("u", u0).withColumn("z", F.when(ok, z)) \
              .withColumn("p_value", F.when(ok, F.when(exact, p_exact).otherwise(p_normal)))


def rescue_boost(scores: DataFrame, target: str, orig: str, random: str) -> DataFrame:
    """Split datasets by sign of (orig - random): rescue (< 0) vs boost; mean representation
    gain (target - orig) per group, their difference and a Mann-Whitney p per budget."""
    wide = (scores.groupBy("dataset", "c").pivot("label", [target, orig, random]).agg(F.first("value"))
            .dropna(subset=[target, orig, random]))
    d = wide.select("dataset", "c", (F.col(f"`{target}`") - F.col(f"`{orig}`")).alias("d"),
                    F.when(F.col(f"`{orig}`") - F.col(f"`{random}`") < 0, 0).otherwise(1).alias("side"))
    means = d.groupBy("c").agg(
        F.count_if(F.col("side") == 0).alias("rescue_n"),
        F.avg(F.when(F.col("side") == 0, F.col("d"))).alias("rescue_mean"),
        F.count_if(F.col("side") == 1).alias("boost_n"),
        F.avg(F.when(F.col("side") == 1, F.col("d"))).alias("boost_mean"))
    mw = mann_whitney(d).select("c", F.col("p_value").alias("mwu_p"))
    return means.withColumn("delta_diff", F.col("rescue_mean") - F.col("boost_mean")).join(mw, "c", "left")


# ---------------------------------------------------------------- H14, H15
def mean_score_table(scores: DataFrame, reference: str, labels: list[str]) -> DataFrame:
    """Mean value per (c, label) over the datasets that have it, with BH stars vs reference."""
    means = scores.filter(F.col("value").isNotNull()).groupBy("c", "label").agg(
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
    tests = vs_reference_tests(scores, reference, labels).select("c", "label", "q_value")
    return means.join(tests, ["c", "label"], "left").withColumn("stars", stars(F.col("q_value")))


def cross_metric_spearman(scores_by_metric: dict[str, DataFrame], min_methods: int = 5) -> DataFrame:
    """Spearman correlation of the mean-rank vectors of two metrics per budget, averaged over budgets."""
    ranked = None
    for m, s in scores_by_metric.items():
        mr = mean_ranks(s).select("c", "label", F.lit(m).alias("metric"), "mean_rank")
        ranked = mr if ranked is None else ranked.unionByName(mr)
    mr = _r("mean_rank")
    w = Window.partitionBy("metric", "c").orderBy(mr)
    wt = Window.partitionBy("metric", "c", mr)
    rr = ranked.withColumn("rr", F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0)
    a = rr.select("c", "label", F.col("metric").alias("m1"), F.col("rr").alias("r1"))
    b = rr.select("c", "label", F.col("metric").alias("m2"), F.col("rr").alias("r2"))
    # metric pairs: bounded by the metric list
    per_c = (a.join(b, ["c", "label"]).filter(F.col("m1") < F.col("m2"))
             .groupBy("m1", "m2", "c").agg(F.corr("r1", "r2").alias("rho"), F.count(F.lit(1)).alias("n_methods"))
             .filter(F.col("n_methods") >= min_methods))
    return per_c.groupBy("m1", "m2").agg(F.avg("rho").alias("spearman_rho"), F.count(F.lit(1)).alias("n_budgets"))


# ---------------------------------------------------------------- H16, H17, H18
def leave_one_dataset_out(scores: DataFrame, target: str, margin: float = 0.01) -> DataFrame:
    """Per budget, how many left-out datasets make the target lose first place (> best + margin)
    and the largest shift of its mean rank.

    Algebraic, no recompute: without dataset d the mean rank of a label is
    (S - own) / (N - 1) when d is complete at that budget; otherwise nothing
    changes, so those configurations take the full-data outcome.
    """
    ranks = complete_case_ranks(scores)
    tot = ranks.groupBy("c", "label").agg(F.sum("rank").alias("S"), F.count(F.lit(1)).alias("N"))
    n_all = scores.select(F.count_distinct("dataset")).scalar()
    lodo = (ranks.join(tot, ["c", "label"])
            .withColumn("lodo_rank", (F.col("S") - F.col("rank")) / (F.col("N") - 1))
            .withColumn("base_rank", F.col("S") / F.col("N")))
    w = Window.partitionBy("dataset", "c")
    per_ds = (lodo.withColumn("best", F.min("lodo_rank").over(w)).filter(F.col("label") == target)
              .groupBy("c").agg(
                  F.count(F.lit(1)).alias("n_complete"),
                  F.count_if(F.col("lodo_rank") > F.col("best") + margin).alias("loses_complete"),
                  F.max(F.abs(F.col("lodo_rank") - F.col("base_rank"))).alias("max_rank_shift")))
    base = tot.withColumn("base_rank", F.col("S") / F.col("N"))
    wb = Window.partitionBy("c")
    base_flag = (base.withColumn("best", F.min("base_rank").over(wb)).filter(F.col("label") == target)
                 .select("c", (F.col("base_rank") > F.col("best") + margin).cast("int").alias("base_loses")))
    return (per_ds.join(base_flag, "c")
            .select("c", n_all.alias("n_configs"),
                    (F.col("loses_complete") + (n_all - F.col("n_complete")) * F.col("base_loses"))
                    .cast("bigint").alias("target_loses_top"),
                    "max_rank_shift"))


def removal_fractions(n_fracs: int = 9):
    """0.1, 0.2, ... 0.9 as produced by repeated float addition (so int(N * (1 - f)) matches)."""
    return [0.1 + i * 0.1 for i in range(n_fracs)]


def progressive_removal(scores: DataFrame, target: str, n_seeds: int = 20, base_seed: int = 42,
                        fractions=None, min_keep: int = 5, margin: float = 0.01) -> DataFrame:
    """For each seed and removal fraction keep the first int(N (1 - f)) datasets in seeded hash
    order and ask whether the target stays first (<= best + margin) at every budget.

    One grouped job over (seed, fraction); datasets x seeds come from ``explode``, not a join.
    Output per fraction: datasets kept, seeds where the target stays top, and the drop point
    (first fraction where fewer than half the seeds keep it on top; 1.0 if none).
    """
    fractions = list(fractions or removal_fractions())
    datasets = scores.select("dataset").distinct()
    # int(N (1 - f)) per fraction, N as a scalar subquery
    keeps = [F.floor(scores.select(F.count_distinct("dataset")).scalar() * F.lit(1 - f)).cast("int") for f in fractions]
    ranks = complete_case_ranks(scores).select("dataset", "c", "label", "rank")
    pos = (datasets.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))))
           .withColumn("pos", F.row_number().over(
               Window.partitionBy("seed").orderBy(seeded_order(F.col("seed") + base_seed, F.col("dataset")), "dataset"))))
    kept = (pos.withColumn("fi", F.explode(F.sequence(F.lit(0), F.lit(len(fractions) - 1))))
            .withColumn("n_keep", F.array(*keeps)[F.col("fi")])
            .filter((F.col("pos") <= F.col("n_keep")) & (F.col("n_keep") >= min_keep)))
    mr = (kept.join(ranks, "dataset").groupBy("seed", "fi", "c", "label").agg(F.avg("rank").alias("mean_rank")))
    w = Window.partitionBy("seed", "fi", "c")
    top = (mr.withColumn("best", F.min("mean_rank").over(w)).filter(F.col("label") == target)
           .groupBy("seed", "fi").agg(F.bool_and(F.col("mean_rank") <= F.col("best") + margin).alias("top")))
    per_f = top.groupBy("fi").agg(F.count_if("top").alias("seeds_target_top"))
    fr = scores.sparkSession.createDataFrame(
        [(i, float(round(f, 1))) for i, f in enumerate(fractions)], "fi int, fraction_removed double")
    fr = fr.withColumn("datasets_kept", F.array(*keeps)[F.col("fi")])
    out = small_broadcast(fr).join(per_f, "fi", "left").withColumn(
        "seeds_target_top", F.coalesce("seeds_target_top", F.lit(0)).cast("bigint")) \
        .withColumn("n_seeds", F.lit(n_seeds))
    below = F.col("seeds_target_top") < F.lit(n_seeds * 0.5)
    drop = F.min(F.when(below, F.col("fraction_removed"))).over(Window.partitionBy())
    return out.withColumn("drop_point", F.coalesce(drop, F.lit(1.0))).drop("fi")


def robustness_summary(spearman: DataFrame, lodo: DataFrame, removal: DataFrame) -> DataFrame:
    """One text row per robustness check."""
    a = spearman.select(F.lit("cross-metric spearman").alias("check"),
                        F.format_string("%s~%s rho=%.3f", "m1", "m2", "spearman_rho").alias("result"))
    b = lodo.groupBy().agg(F.sum("target_loses_top").alias("l"), F.sum("n_configs").alias("n"),
                           F.max("max_rank_shift").alias("s")) \
        .select(F.lit("leave-one-dataset-out").alias("check"),
                F.format_string("%d of %d configs lose top; max shift=%.2f", "l", "n", "s").alias("result"))
    c = removal.groupBy().agg(F.max("drop_point").alias("d")) \
        .select(F.lit("progressive removal").alias("check"),
                F.format_string("retains top until >%d%% removed", (F.col("d") * 100).cast("int")).alias("result"))
    return a.unionByName(b).unionByName(c)


# ---------------------------------------------------------------- H19 - H26
def first_failure(scores: DataFrame, a: str, b: str, budgets=C_BUDGETS) -> DataFrame:
    """First budget where label a scores below label b, per dataset; counts per budget,
    cumulative count and shares, and a Never row (survival 0 there, as in the reference)."""
    wide = scores.groupBy("dataset", "c").pivot("label", [a, b]).agg(F.first("value"))
    fail = wide.filter(F.col(f"`{a}`") < F.col(f"`{b}`")).groupBy("dataset").agg(F.min("c").alias("first_fail"))
    datasets = scores.select("dataset").distinct()
    per_ds = datasets.join(fail, "dataset", "left")
    total = F.count(F.lit(1)).over(Window.partitionBy())
    counts = per_ds.groupBy(F.coalesce(F.col("first_fail").cast("string"), F.lit("Never")).alias("budget")).count()
    bt = scores.sparkSession.createDataFrame([(str(c), i) for i, c in enumerate(budgets)] + [("Never", len(budgets))],
                                            "budget string, budget_order int")
    j = small_broadcast(bt).join(counts, "budget", "left").withColumn("first_fail_count", F.coalesce("count", F.lit(0)))
    n = F.sum("first_fail_count").over(Window.partitionBy())
    cum = F.sum("first_fail_count").over(Window.orderBy("budget_order").rowsBetween(Window.unboundedPreceding, 0))
    return (j.withColumn("cumulative_failed", cum).withColumn("n_datasets", n)
            .withColumn("cumulative_pct", F.col("cumulative_failed") / F.col("n_datasets") * 100)
            .withColumn("survival_pct", F.when(F.col("budget") == "Never", F.lit(0.0))
                        .otherwise((1 - F.col("cumulative_failed") / F.col("n_datasets")) * 100))
            .select("budget", "budget_order", "first_fail_count", "cumulative_failed", "cumulative_pct", "survival_pct"))


def improvability_curve(scores: DataFrame, baselines: DataFrame) -> DataFrame:
    """Mean of (1 - value / baseline) * 100 per (c, label); baselines is (dataset, baseline)."""
    j = scores.join(baselines.select("dataset", "baseline"), "dataset")
    imp = (F.lit(1.0) - F.try_divide(F.col("value"), F.col("baseline"))) * 100
    return j.groupBy("c", "label").agg(F.avg(imp).alias("improvability"), F.count(imp).alias("n"))


def curve_with_spread(scores: DataFrame) -> DataFrame:
    """Per (c, label): mean, sample std (0 with one value) and N with a value."""
    v = scores.filter(F.col("value").isNotNull())
    return v.groupBy("c", "label").agg(F.avg("value").alias("mean"),
                                       F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
                                       F.count(F.lit(1)).alias("n"))


def win_loss_matrix(scores: DataFrame, a: str, b: str, budgets=C_BUDGETS) -> DataFrame:
    """A - b per dataset (rows) x budget (columns); all-NULL rows dropped; ordered by the
    mean over budgets with NULL as 0 (descending)."""
    d = (scores.groupBy("dataset", "c").pivot("label", [a, b]).agg(F.first("value"))
         .select("dataset", "c", (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("d")))
    wide = d.groupBy("dataset").pivot("c", list(budgets)).agg(F.first("d"))
    cols = [str(c) for c in budgets]
    wide = wide.dropna(how="all", subset=cols)
    key = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cols), F.lit(0.0)) / len(cols)
    return wide.withColumn("sort_key", key).orderBy(F.col("sort_key").desc(), "dataset")


def _paired(scores: DataFrame, a: str, b: str) -> DataFrame:
    return (scores.groupBy("dataset", "c").pivot("label", [a, b]).agg(F.first("value"))
            .select("dataset", "c", F.col(f"`{a}`").alias("value_a"), F.col(f"`{b}`").alias("value_b"))
            .filter("value_a is not null and value_b is not null")
            .withColumn("d", F.col("value_a") - F.col("value_b")))


def paired_summary(scores: DataFrame, a: str, b: str) -> DataFrame:
    """N, mean of both, mean and median gain (a - b) per budget."""
    p = _paired(scores, a, b)
    return p.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg("value_a").alias("mean_a"),
                              F.avg("value_b").alias("mean_b"), F.avg("d").alias("mean_gain"),
                              F.median("d").alias("median_gain"))


def scatter_summary(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference and points above / below the diagonal per budget."""
    p = _paired(scores, a, b).withColumn("d", _r("d"))
    return p.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"),
                              F.count_if(F.col("d") > 0).alias("n_above"),
                              F.count_if(F.col("d") < 0).alias("n_below"))


def box_summary(scores: DataFrame, a: str, b: str, eps: float = 1e-12) -> DataFrame:
    """Quartiles (exact), mean of paired differences and Wilcoxon p (zeros dropped; 1 if all ~0)."""
    p = _paired(scores, a, b)
    q = p.groupBy("c").agg(F.percentile("d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
                           F.avg("d").alias("mean"), F.count(F.lit(1)).alias("n"),
                           F.max(F.abs("d")).alias("max_abs"))
    t = wilcoxon(p, group=("c",), zero_method="wilcox", min_pairs=1).select("c", F.col("p_value").alias("p"))
    return (q.join(t, "c", "left")
            .select("c", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
                    "mean", F.when(F.col("max_abs") <= eps, F.lit(1.0)).otherwise(F.col("p")).alias("p_value")))


def gain_histogram(values: DataFrame, col: str = "d", lo: float = -0.12, hi: float = 0.22, bins: int = 34) -> DataFrame:
    """Counts on fixed bins [lo, hi) split in ``bins`` (0 below, bins+1 above)."""
    return (values.groupBy(F.width_bucket(F.col(col), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_lo", F.lit(lo) + (F.col("bucket") - 1) * F.lit((hi - lo) / bins)))
