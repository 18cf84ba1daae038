"""Registered queries: name -> (Spark builder, oracle SQL or None, float columns).

Each builder takes (spark, sf_dir) and returns a DataFrame over the given tables.
Double columns are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import results as G
from tessera.operators import stats as H
from tessera.plans import analysis as A
from tessera.plans import fixtures as FX
from tessera.plans import oracle as O


@dataclass
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    floats: list = field(default_factory=list)


def round_floats(df: DataFrame, digits: int = O.ROUND) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double") + F.lit(O.ROUND_OFFSET), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


REGISTRY: dict[str, Query] = {}


def register(name, sql=None, floats=()):
    def deco(fn):
        REGISTRY[name] = Query(fn, O.rounded(sql, list(floats)) if sql else None, list(floats))
        return fn
    return deco


W = O.with_base
LABELS = A.label_names()
TARGET, ORIG, RANDOM = FX.TARGET_LABEL, FX.ORIG_LABEL, FX.RANDOM_LABEL


# ============================================================ result tables (G)
@register("result_fact_scan", f"{FX.all_results_sql()}", ["value"])
def q_result_fact(spark, sf):
    return A.fact(spark, sf)


@register("null_report", W() + """
select 'dataset' as column_name, count(*) - count(dataset) as n_null from fact
union all select 'seed', count(*) - count(seed) from fact
union all select 'value', count(*) - count(value) from fact""")
def q_null_report(spark, sf):
    return G.null_report(A.fact(spark, sf).select("dataset", "seed", "value"))


@register("duplicate_keys", W() + """
select dataset, fold, space, method, n_selected, seed, evaluator, metric, count(*) as n_rows,
       count(distinct value) + max(case when value is null then 1 else 0 end) as n_values,
       count(distinct value) + max(case when value is null then 1 else 0 end) > 1 as conflicting
from fact group by all having count(*) > 1""")
def q_duplicate_keys(spark, sf):
    return G.duplicate_key_report(A.fact(spark, sf))


@register("duplicate_summary", W() + """
select space, method, count(*) as duplicate_keys, cast(count_if(nv > 1) as bigint) as conflicting_keys,
       cast(sum(n - 1) as bigint) as surplus_rows
from (select space, method, count(*) as n, count(distinct value) + max(case when value is null then 1 else 0 end) as nv
      from fact group by dataset, fold, space, method, n_selected, seed, evaluator, metric having count(*) > 1) d
group by all""")
def q_duplicate_summary(spark, sf):
    return G.duplicate_summary(G.duplicate_key_report(A.fact(spark, sf)))


@register("run_means", W() + "select * from run", ["value"])
def q_run_means(spark, sf):
    return G.run_means(A.fact(spark, sf))


@register("seed_window", W() + "select * from win", ["value"])
def q_seed_window(spark, sf):
    return G.seed_window(G.run_means(A.fact(spark, sf)), FX.RUNS_PER_METHOD, exempt=FX.EXEMPT)


@register("seed_means", W() + "select * from foldt", ["value"])
def q_seed_means(spark, sf):
    return A.fold_table(spark, sf)


@register("missing_runs", W() + f"""
select e.dataset, e.fold, e.space, e.method, e.evaluator, coalesce(h.n_runs, 0) as n_runs,
       coalesce(u.runs, 1) as expected_runs
from (select distinct dataset, fold, space, method, evaluator from run where method not in {FX.EXEMPT_SQL}) e
left join (select dataset, fold, space, method, evaluator, count(distinct seed) as n_runs from win
           where method not in {FX.EXEMPT_SQL} group by all) h using (dataset, fold, space, method, evaluator)
left join {O.runs_values()} on e.method = u.method
where coalesce(h.n_runs, 0) < coalesce(u.runs, 1)""")
def q_missing_runs(spark, sf):
    return G.missing_runs(G.run_means(A.fact(spark, sf)), FX.RUNS_PER_METHOD, exempt=FX.EXEMPT)


@register("budget_filter", W() + """
select f.dataset, f.space, f.method, f.evaluator, f.n_selected, f.metric, f.fold, f.value,
       case when f.method = 'All' then null else cast(f.n_selected // k.n_classes as int) end as c
from foldt f join catalog k on f.dataset = k.dataset
where f.method = 'All' or (f.n_selected % k.n_classes = 0 and f.n_selected // k.n_classes in (1, 2, 4, 8, 16, 32))""",
          ["value"])
def q_budget_filter(spark, sf):
    return G.budget_filter(A.fold_table(spark, sf), A.catalog(spark, sf))


@register("catalog", W() + "select * from catalog", ["imbalance_ratio"])
def q_catalog(spark, sf):
    return A.catalog(spark, sf)


@register("cell_means", W() + "select * from cells", ["value"])
def q_cell_means(spark, sf):
    return A.cells(spark, sf)


@register("baselines", W() + "select * from base", ["baseline"])
def q_baselines(spark, sf):
    return A.baselines(spark, sf)


@register("improvability", W() + """
select c.*, b.baseline, (1.0 - c.value / b.baseline) * 100 as improvability
from cells c left join base b using (dataset, evaluator, metric)""", ["value", "baseline", "improvability"])
def q_improvability(spark, sf):
    return G.with_improvability(A.cells(spark, sf), A.baselines(spark, sf).select("dataset", "evaluator", "metric", "baseline"))


@register("dense_ranks", W() + """
select *, cast(dense_rank() over (partition by dataset, c, evaluator, metric order by round(value, 9) desc) as int) as rank
from cells""", ["value"])
def q_dense_ranks(spark, sf):
    return G.with_dense_rank(A.cells(spark, sf))


@register("metrics_side_by_side", W() + """
select dataset, fold, space, method, evaluator, n_selected,
       max(case when metric = 'AUC' then value end) as AUC, max(case when metric = 'ACC' then value end) as ACC,
       max(case when metric = 'F1' then value end) as F1
from foldt group by all""", ["AUC", "ACC", "F1"])
def q_side_by_side(spark, sf):
    return G.metrics_side_by_side(A.fold_table(spark, sf))


@register("missing_metrics", W() + """
select e.dataset, e.space, e.method, e.evaluator, e.n_selected, e.metric, list_sort(list(distinct e.fold)) as missing_folds
from (select distinct dataset, space, method, evaluator, n_selected, fold, m.metric
      from foldt, (values ('AUC'), ('ACC'), ('F1')) m(metric) where method <> 'All') e
anti join (select distinct dataset, space, method, evaluator, n_selected, fold, metric from foldt) h
  using (dataset, space, method, evaluator, n_selected, fold, metric)
group by all""")
def q_missing_metrics(spark, sf):
    return G.missing_metrics(A.fold_table(spark, sf))


@register("fold_coverage", W() + """
select dataset, space, method, evaluator, n_selected, metric, folds,
       list_filter([0, 1, 2], lambda x: not list_contains(folds, x)) as missing_folds
from (select dataset, space, method, evaluator, n_selected, metric,
             coalesce(list_sort(list(distinct fold) filter (where fold is not null)), []) as folds
      from (select dataset, space, method, evaluator, n_selected, metric, fold from foldt union all
            select dataset, 'Emb', 'NeverRun', 'KNN', n_classes, 'AUC', null from catalog) r group by all) g where len(folds) < 3""")
def q_fold_coverage(spark, sf):
    # configured cells: one method of the configuration has no run at all
    want = A.catalog(spark, sf).select("dataset", F.lit("Emb").alias("space"), F.lit("NeverRun").alias("method"), F.lit("KNN").alias("evaluator"),
                                       F.col("n_classes").alias("n_selected"), F.lit("AUC").alias("metric"))
    return G.fold_coverage(A.fold_table(spark, sf), 3, want)


def _wide_columns():
    cols = []
    for c in G.C_MULTIPLIERS:
        for s, m, _ in FX.METHOD_LABELS:
            for met in G.METRICS:
                cols.append(f"{c}C_{s}_{m}_KNN_{met}")
    return cols + [f"Orig_All_KNN_{met}" for met in G.METRICS]


WIDE_COLS = _wide_columns()


def _wide_sql():
    parts = []
    for col in WIDE_COLS:
        if col.startswith("Orig_All_"):
            met = col.split("_")[-1]
            parts.append(f"max(case when src = 'b' and metric = '{met}' then value end) as \"{col}\"")
        else:
            c, s, m, e, met = col.split("_")[0][:-1], *col.split("_")[1:]
            parts.append(f"max(case when src = 'c' and c = {c} and space = '{s}' and method = '{m}' and metric = '{met}' "
                         f"then value end) as \"{col}\"")
    return W() + f"""
select k.dataset, k.n_samples, k.n_features, k.n_classes, k.imbalance_ratio, {', '.join(parts)}
from (select 'c' as src, dataset, c, space, method, metric, value from cells
      union all select 'b', dataset, null, null, null, metric, baseline from base) v
join catalog k using (dataset)
group by all"""


@register("wide_table", _wide_sql(), ["imbalance_ratio"] + [f'"{c}"' for c in WIDE_COLS])
def q_wide(spark, sf):
    return G.to_wide(A.cells(spark, sf), A.catalog(spark, sf), A.baselines(spark, sf), WIDE_COLS)


@register("wide_decode", W() + """
select dataset, c, space, method, evaluator, metric, cast(null as varchar) as suffix, value from cells""", ["value"])
def q_wide_decode(spark, sf):
    wide = G.to_wide(A.cells(spark, sf), A.catalog(spark, sf), None,
                     [c for c in WIDE_COLS if not c.startswith("Orig_")])
    return G.wide_to_long(wide).filter(F.col("value").isNotNull())


CONFIGURED_COLS = [c for c in WIDE_COLS if not c.startswith("Orig_All")] + ["64C_Emb_KMedoids_KNN_AUC"]


@register("missing_cells", W() + f"""
select col, list_sort(list(dataset)) as datasets, cast(count(*) as int) as n_missing from
 (select * from (select g.col, k.dataset from (values {", ".join(f"('{c}')" for c in CONFIGURED_COLS)}) g(col)
  cross join (select dataset from catalog) k) gk
  anti join (select concat(cast(c as varchar), 'C_', space, '_', method, '_', evaluator, '_', metric) as col, dataset
             from cells where value is not null) h using (col, dataset)) m
group by col""")
def q_missing_cells(spark, sf):
    return G.missing_cells(A.cells(spark, sf), A.catalog(spark, sf), CONFIGURED_COLS)


_BUDGET_AVGS = ", ".join(f'avg(case when c = {c} then value end) as "{c}"' for c in G.C_MULTIPLIERS)


@register("compact_table", W() + f"""
, imp as (select cells.*, (1.0 - value / baseline) * 100 as improvability from cells
          left join (select dataset, evaluator, metric, baseline from base) b using (dataset, evaluator, metric)),
rk as (select *, case when value is not null then dense_rank() over (partition by dataset, c, evaluator, metric, value is null
                                                                     order by round(value, 9) desc) end as rank from imp),
kinds as (select space, method, evaluator, metric, c, 'value' as kind, value from rk union all
          select space, method, evaluator, metric, c, 'improvability', improvability from rk union all
          select space, method, evaluator, metric, c, 'rank', cast(rank as double) from rk)
select space, method, evaluator, metric, kind, {_BUDGET_AVGS}
from kinds group by space, method, evaluator, metric, kind""", [f'"{c}"' for c in G.C_MULTIPLIERS])
def q_compact(spark, sf):
    return G.compact_table(G.compact_long(A.cells(spark, sf), A.baselines(spark, sf)))


@register("best_flags", W() + """
select *, case when place = 1 then 'best' when place = 2 then 'second' end as flag from
 (select *, cast(dense_rank() over (partition by evaluator, metric, c order by round(value, 4) desc) as int) as place from
  (select space, method, evaluator, metric, c, avg(value) as value from cells group by all) a) x""", ["value"])
def q_best_flags(spark, sf):
    cl = A.cells(spark, sf).groupBy("space", "method", "evaluator", "metric", "c").agg(F.avg("value").alias("value"))
    return G.best_flags(cl)


# ============================================================ statistics (H)
@register("mean_ranks", W(O.scores_cte(), O.ranks_cte()) + """
select c, label, avg(rank) as mean_rank, n_datasets from ranks
join (select c, count(distinct dataset) as n_datasets from ranks group by c) n using (c)
group by c, label, n_datasets""", ["mean_rank"])
def q_mean_ranks(spark, sf):
    return H.mean_ranks(A.scores(spark, sf))


def _pair_sql(pairs):
    return " union all ".join(
        f"select a.dataset, a.c, '{x}' as label_a, '{y}' as label_b, a.value - b.value as d "
        f"from scores a join scores b on a.dataset = b.dataset and a.c = b.c "
        f"where a.label = '{x}' and b.label = '{y}' and a.value is not null and b.value is not null" for x, y in pairs)


ALL_PAIRS = H.all_pairs(LABELS)


@register("wilcoxon_pairs", W(O.scores_cte(), f"diffs as ({_pair_sql(ALL_PAIRS)})") +
          "select * from " + O.wilcoxon_sql("diffs", "c, label_a, label_b"),
          ["w_plus", "w_minus", "statistic", "z"])
def q_wilcoxon_pairs(spark, sf):
    return H.wilcoxon(H.pair_differences(A.scores(spark, sf), ALL_PAIRS)).drop("p_value")


def WR(*ctes):
    """W with the recursive counts of the exact tests."""
    return W(*ctes, O.SIGNED_RANK_CTE).replace("with ", "with recursive ", 1)


VS_RANDOM = [(x, RANDOM) for x in LABELS if x != RANDOM]
_VS_SQL = O.bh_sql(f"(select * rename (label_a as label) from {O.wilcoxon_p_sql('diffs', 'c, label_a')})")


def _vs_ctes():
    return O.scores_cte(), f"diffs as ({_pair_sql(VS_RANDOM)})"


@register("wilcoxon_vs_random", WR(*_vs_ctes()) + f"select * from {_VS_SQL}",
          ["w_plus", "w_minus", "statistic", "z", "p_value", "q_value"])
def q_wilcoxon_vs_random(spark, sf):
    return H.vs_reference_tests(A.scores(spark, sf), RANDOM, LABELS)


def _bh_p_sql():
    return ("(('0x' || substr(md5(concat('bh', '|', dataset || label || cast(c as varchar))), 1, 8))::BIGINT % 1000) / 1000.0")


@register("bh_adjust", W(O.scores_cte()) + f"""
select c, dataset, label, p_value,
       min(least(1.0, p_value * n / i)) over (partition by c order by p_value desc, i desc
                                               rows between unbounded preceding and current row) as q_value
from (select c, dataset, label, p_value, row_number() over (partition by c order by p_value, dataset, label) as i,
             count(*) over (partition by c) as n
      from (select c, dataset, label, {_bh_p_sql()} as p_value from scores) s) x""", ["p_value", "q_value"])
def q_bh(spark, sf):
    from tessera.functions.hashing import seeded_order
    s = A.scores(spark, sf)
    key = F.concat(F.col("dataset"), F.col("label"), F.col("c").cast("string"))
    t = s.select("c", "dataset", "label", ((seeded_order("bh", key) % 1000) / 1000.0).alias("p_value"))
    return H.bh_adjust(t)


def _cd_sql():
    units = ", ".join(f"({m}, {H.critical_distance(m, 1)!r})" for m in range(2, len(LABELS) + 1))
    return f"units as (select * from (values {units}) u(k, unit))"


@register("rank_table", WR(*_vs_ctes(), O.ranks_cte(), _cd_sql()) + f"""
, cd as (select unit / sqrt((select count(distinct dataset) from scores)) as cd from units
         where k = (select count(distinct label) from scores where value is not null)),
mr as (select c, label, avg(rank) as mean_rank, n_datasets from ranks
       join (select c, count(distinct dataset) as n_datasets from ranks group by c) n using (c) group by c, label, n_datasets),
mb as (select *, min(mean_rank) over (partition by c) as best_rank from mr)
select mb.*, abs(mean_rank - best_rank) < 0.005 as is_best, mean_rank <= best_rank + cd as in_band, p_value, q_value, {O.STARS_SQL} as stars, cd
from mb join cd on true left join {_VS_SQL} v using (c, label)""", ["mean_rank", "best_rank", "p_value", "q_value", "cd"])
def q_rank_table(spark, sf):
    return H.rank_table(A.scores(spark, sf), RANDOM, LABELS)


@register("rank_table_check", W(O.scores_cte()) + "select c, count(*) as n_best from scores where false group by c")
def q_rank_table_check(spark, sf):
    return H.rank_table_check(H.rank_table(A.scores(spark, sf), RANDOM, LABELS))


_FRIEDMAN_SQL = W(O.scores_cte(), O.ranks_cte()) + """
select c, n_datasets, n_methods,
       (12.0 / (n_datasets * n_methods * (n_methods + 1)) * sum_r2 - 3.0 * n_datasets * (n_methods + 1))
       / (1 - tie_sum / (n_datasets * n_methods * (n_methods * n_methods - 1.0))) as friedman_chi2
from (select c, sum(R * R) as sum_r2, max(N) as n_datasets, count(*) as n_methods
      from (select c, label, sum(rank) as R, count(*) as N from ranks group by c, label) p group by c) a
join (select c, sum(t * t * t - t) as tie_sum from (select c, dataset, round(value, 9), count(*) as t from ranks group by all) x
      group by c) b using (c)
where n_datasets >= 5 and n_methods >= 2"""


@register("friedman_statistic", _FRIEDMAN_SQL, ["friedman_chi2"])
def q_friedman_stat(spark, sf):
    return H.friedman(A.scores(spark, sf)).drop("friedman_p")


# upper tail of chi-square with n_methods - 1 degrees of freedom: Simpson's rule on [x, x + 200]
_CHI2_P = ("list_sum(list_transform(range(0, 8001), lambda i: (case when i in (0, 8000) then 1 when i % 2 = 1 then 4 else 2 end) "
           "* power(greatest(friedman_chi2 + i * 0.025, 1e-300), (n_methods - 1) / 2.0 - 1) * exp(-(friedman_chi2 + i * 0.025) / 2))) * 0.025 / 3 "
           "/ (power(2, (n_methods - 1) / 2.0) * gamma((n_methods - 1) / 2.0))")


@register("friedman_test", f"select *, {_CHI2_P} as friedman_p from ({_FRIEDMAN_SQL}) f", ["friedman_chi2", "friedman_p"])
def q_friedman(spark, sf):
    return H.friedman(A.scores(spark, sf))


# The studentised range with infinite degrees of freedom, P(R > q) = 1 - k * integral of phi(z) (Phi(z + q) - Phi(z))^(k-1):
# Phi on a fine grid by the trapezoid rule with its end correction, between grid points by Taylor's series; the outer
# integral by the trapezoid rule, which is exact to rounding for a smooth integrand that vanishes at both ends.
_RANGE_CTES = """fine as (select i, -9 + i * 0.002 as x, exp(-0.5 * power(-9 + i * 0.002, 2)) / sqrt(2 * pi()) as phi from range(0, 9001) r(i)),
cum as (select i, x, phi, 0.002 * (sum(phi) over (order by i) - phi / 2) + 0.002 * 0.002 / 12 * x * phi as cdf from fine),
steps as (select x as z, phi, cdf from cum where i % 25 = 0),
mr as (select c, label, avg(rank) as mean_rank, count(distinct dataset) as n_datasets from ranks group by c, label),
pairs as (select a.c, a.label as label_a, a.mean_rank as rank_a, a.n_datasets, b.label as label_b, b.mean_rank as rank_b, k.k,
            abs(a.mean_rank - b.mean_rank) / sqrt(k.k * (k.k + 1) / (6.0 * a.n_datasets)) * sqrt(2) as q
          from mr a join mr b on a.c = b.c and a.label < b.label join (select c, count(*) as k from mr group by c) k on k.c = a.c),
inner_ as (select p.*, s.phi, s.cdf, s.z + p.q as y, cast(least(round((s.z + p.q + 9) / 0.002), 9000) as bigint) as at from pairs p, steps s),
upper as (select n.*, case when y >= 9 then 1.0 else g.cdf + g.phi * ((y - g.x) - g.x * power(y - g.x, 2) / 2 + (g.x * g.x - 1) * power(y - g.x, 3) / 6) end as top
          from inner_ n join cum g on g.i = n.at)"""


@register("nemenyi_pairs", W(O.scores_cte(), O.ranks_cte()) + ", " + _RANGE_CTES + """
select * exclude (s), case when q <= 0 then 1.0 else 1 - least(1.0, k * 0.05 * s) end as p_value
from (select c, label_a, rank_a, n_datasets, label_b, rank_b, k, q, sum(phi * power(greatest(least(top - cdf, 1.0), 0.0), k - 1)) as s from upper group by all) x""", ["rank_a", "rank_b", "q", "p_value"])
def q_nemenyi(spark, sf):
    return H.nemenyi_pairs(A.scores(spark, sf))


def _three_sql():
    return (f"three as (select dataset, c, max(case when label = '{TARGET}' then value end) as t, "
            f"max(case when label = '{ORIG}' then value end) as o, max(case when label = '{RANDOM}' then value end) as r "
            f"from scores group by dataset, c having t is not null and o is not null and r is not null)")


@register("gain_decomposition", W(O.scores_cte(), _three_sql()) + """
select c, gain, avg(d) as mean_gain, count(*) as n from
 (select c, 'selector' as gain, o - r as d from three union all select c, 'representation', t - o from three) x
group by all""", ["mean_gain"])
def q_gain(spark, sf):
    return H.gain_decomposition(A.scores(spark, sf), TARGET, ORIG, RANDOM).drop("p_value")


@register("gain_decomposition_tests", WR(O.scores_cte(), _three_sql(), """gd as (
 select dataset, c, 'selector' as gain, o - r as d from three union all select dataset, c, 'representation', t - o from three)""") + f"""
select c, gain, avg(d) as mean_gain, count(*) as n, any_value(p_value) as p_value from gd
left join (select c, gain, p_value from {O.wilcoxon_p_sql('gd', 'c, gain')}) t using (c, gain) group by c, gain""", ["mean_gain", "p_value"])
def q_gain_tests(spark, sf):
    return H.gain_decomposition(A.scores(spark, sf), TARGET, ORIG, RANDOM)


@register("rescue_boost", W(O.scores_cte(), _three_sql()) + """
select c, cast(count_if(o - r < 0) as bigint) as rescue_n, avg(case when o - r < 0 then t - o end) as rescue_mean,
       cast(count_if(not (o - r < 0)) as bigint) as boost_n, avg(case when not (o - r < 0) then t - o end) as boost_mean,
       avg(case when o - r < 0 then t - o end) - avg(case when not (o - r < 0) then t - o end) as delta_diff
from three group by c""", ["rescue_mean", "boost_mean", "delta_diff"])
def q_rescue(spark, sf):
    return H.rescue_boost(A.scores(spark, sf), TARGET, ORIG, RANDOM).drop("mwu_p")


@register("rescue_boost_test", W(O.scores_cte(), _three_sql(), O.RANK_SUM_CTE).replace("with ", "with recursive ", 1) + f"""
, v as (select c, round(t - o, 9) as d, case when o - r < 0 then 0 else 1 end as side, t - o as raw from three),
rk as (select *, rank() over (partition by c order by d) + (count(*) over (partition by c, d) - 1) / 2.0 as rk,
              count(*) over (partition by c, d) as ties from v),
g as (select c, count_if(side = 0) as n0, count_if(side = 1) as n1, sum(case when side = 0 then rk end) as r0, sum(ties * ties - 1) as tie_term,
             avg(case when side = 0 then raw end) as rescue_mean, avg(case when side = 1 then raw end) as boost_mean from rk group by c),
u as (select *, greatest(r0 - n0 * (n0 + 1) / 2.0, n0 * n1 - (r0 - n0 * (n0 + 1) / 2.0)) as top,
             n0 * n1 / 12.0 * ((n0 + n1 + 1) - tie_term / ((n0 + n1) * (n0 + n1 - 1.0))) as var from g),
z as (select *, (top - n0 * n1 / 2.0 - 0.5) / sqrt(case when var > 0 then var end) as z from u)
select c, cast(n0 as bigint) as rescue_n, rescue_mean, cast(n1 as bigint) as boost_n, boost_mean, rescue_mean - boost_mean as delta_diff,
       case when n0 >= 3 and n1 >= 3 and var > 0 then case when least(n0, n1) <= 8 and tie_term = 0 then least(1.0, rsp.p)
            when z <= 0 then 1.0 else {O.normal_p_sql('z')} end end as mwu_p
from z left join rsp on rsp.m = n0 + n1 and rsp.k = n0 and rsp.u = cast(round(top) as int)""",
          ["rescue_mean", "boost_mean", "delta_diff", "mwu_p"])
def q_rescue_test(spark, sf):
    return H.rescue_boost(A.scores(spark, sf), TARGET, ORIG, RANDOM)


@register("mean_score_table", W(O.scores_cte()) + """
select c, label, avg(value) as mean_value, count(*) as n from scores where value is not null group by all""",
          ["mean_value"])
def q_mean_scores(spark, sf):
    return H.mean_score_table(A.scores(spark, sf), RANDOM, LABELS).select("c", "label", "mean_value", "n")


@register("mean_score_stars", WR(*_vs_ctes()) + f"""
select c, label, mean_value, n, q_value, {O.STARS_SQL} as stars
from (select c, label, avg(value) as mean_value, count(*) as n from scores where value is not null group by all) m
left join (select c, label, q_value from {_VS_SQL}) v using (c, label)""", ["mean_value", "q_value"])
def q_mean_scores_stars(spark, sf):
    return H.mean_score_table(A.scores(spark, sf), RANDOM, LABELS)


def _mr_metric(m):
    return (f"{O.scores_cte(m, 's_' + m)},\n{O.ranks_cte('s_' + m, 'r_' + m)},\n"
            f"mr_{m} as (select '{m}' as metric, c, label, avg(rank) as mean_rank from r_{m} group by c, label)")


@register("cross_metric_spearman", W(_mr_metric("AUC"), _mr_metric("ACC"), _mr_metric("F1")) + """
, rr as (select *, rank() over (partition by metric, c order by round(mean_rank, 9))
                 + (count(*) over (partition by metric, c, round(mean_rank, 9)) - 1) / 2.0 as rr
         from (select * from mr_AUC union all select * from mr_ACC union all select * from mr_F1) u)
select m1, m2, avg(rho) as spearman_rho, count(*) as n_budgets from
 (select a.metric as m1, b.metric as m2, a.c, corr(a.rr, b.rr) as rho, count(*) as n_methods
  from rr a join rr b on a.c = b.c and a.label = b.label and a.metric < b.metric group by all having count(*) >= 5) x
group by all""".replace("\n, rr", ", rr"), ["spearman_rho"])
def q_spearman(spark, sf):
    return H.cross_metric_spearman({m: A.scores(spark, sf, m) for m in ("AUC", "ACC", "F1")})


@register("leave_one_dataset_out", W(O.scores_cte(), O.ranks_cte()) + f""",
tot as (select c, label, sum(rank) as S, count(*) as N from ranks group by all),
lodo as (select r.dataset, r.c, r.label, (S - rank) / (N - 1) as lodo_rank, S / N as base_rank
         from ranks r join tot using (c, label)),
per as (select c, count(*) as n_complete, count_if(lodo_rank > best + 0.01) as loses, max(abs(lodo_rank - base_rank)) as max_rank_shift
        from (select *, min(lodo_rank) over (partition by dataset, c) as best from lodo) x where label = '{TARGET}' group by c),
bf as (select c, cast(base > best + 0.01 as int) as base_loses from
        (select c, label, S / N as base, min(S / N) over (partition by c) as best from tot) y where label = '{TARGET}')
select c, (select count(distinct dataset) from scores) as n_configs,
       cast(loses + ((select count(distinct dataset) from scores) - n_complete) * base_loses as bigint) as target_loses_top,
       max_rank_shift
from per join bf using (c)""".replace("\n,\ntot", ",\ntot"), ["max_rank_shift"])
def q_lodo(spark, sf):
    return H.leave_one_dataset_out(A.scores(spark, sf), TARGET)


def _removal_sql():
    fr = H.removal_fractions()
    vals = ", ".join(f"({i}, cast({round(f, 1)} as double), cast({f!r} as double))" for i, f in enumerate(fr))
    return W(O.scores_cte(), O.ranks_cte()) + f""",
ds as (select distinct dataset from scores),
nall as (select count(*) as n from ds),
fr as (select fi, fraction_removed, cast(floor(n * (1 - cast(f as double))) as int) as datasets_kept
       from (values {vals}) v(fi, fraction_removed, f), nall),
pos as (select dataset, seed, row_number() over (partition by seed order by
          ('0x' || substr(md5(concat(cast(seed + 42 as varchar), '|', dataset)), 1, 8))::BIGINT, dataset) as pos
        from ds, range(0, 20) s(seed)),
kept as (select p.seed, f.fi, p.dataset from pos p join fr f on p.pos <= f.datasets_kept where f.datasets_kept >= 5),
mr as (select k.seed, k.fi, r.c, r.label, avg(r.rank) as mean_rank from kept k join ranks r using (dataset) group by all),
top as (select seed, fi, bool_and(mean_rank <= best + 0.01) as top from
         (select *, min(mean_rank) over (partition by seed, fi, c) as best from mr) x where label = '{TARGET}' group by all),
per_f as (select fi, count_if(top) as seeds_target_top from top group by fi),
out as (select fr.fraction_removed, fr.datasets_kept, cast(coalesce(seeds_target_top, 0) as bigint) as seeds_target_top, 20 as n_seeds
        from fr left join per_f using (fi))
select *, coalesce((select min(fraction_removed) from out where seeds_target_top < 10.0), 1.0) as drop_point from out"""


@register("progressive_removal", _removal_sql().replace("\n,\nds", ",\nds"), ["fraction_removed", "drop_point"])
def q_removal(spark, sf):
    return H.progressive_removal(A.scores(spark, sf), TARGET)


@register("robustness_summary", f"""select 'cross-metric spearman' as "check", format('{{}}~{{}} rho={{:.3f}}', m1, m2, spearman_rho) as result from ({REGISTRY["cross_metric_spearman"].sql}) a
union all select 'leave-one-dataset-out', format('{{}} of {{}} configs lose top; max shift={{:.2f}}', cast(sum(target_loses_top) as bigint), cast(sum(n_configs) as bigint), max(max_rank_shift))
  from ({REGISTRY["leave_one_dataset_out"].sql}) b
union all select 'progressive removal', format('retains top until >{{}}% removed', cast(floor(max(drop_point) * 100 + 1e-6) as integer)) from ({REGISTRY["progressive_removal"].sql}) d""")
def q_robust(spark, sf):
    s = {m: A.scores(spark, sf, m) for m in ("AUC", "ACC", "F1")}
    return H.robustness_summary(H.cross_metric_spearman(s), H.leave_one_dataset_out(s["AUC"], TARGET),
                                H.progressive_removal(s["AUC"], TARGET))


@register("first_failure", W(O.scores_cte()) + f""",
w as (select dataset, c, max(case when label = '{ORIG}' then value end) as a, max(case when label = '{RANDOM}' then value end) as b
      from scores group by dataset, c),
ff as (select d.dataset, f.first_fail from (select distinct dataset from scores) d
       left join (select dataset, min(c) as first_fail from w where a < b group by dataset) f using (dataset)),
cnt as (select coalesce(cast(first_fail as varchar), 'Never') as budget, count(*) as n from ff group by 1),
bt as (select * from (values ('1', 0), ('2', 1), ('4', 2), ('8', 3), ('16', 4), ('32', 5), ('Never', 6)) v(budget, budget_order)),
j as (select budget, budget_order, coalesce(n, 0) as first_fail_count from bt left join cnt using (budget))
select budget, budget_order, first_fail_count,
       cast(sum(first_fail_count) over (order by budget_order rows between unbounded preceding and current row) as bigint) as cumulative_failed,
       cumulative_failed / sum(first_fail_count) over () * 100 as cumulative_pct,
       case when budget = 'Never' then 0.0 else (1 - cumulative_failed / sum(first_fail_count) over ()) * 100 end as survival_pct
from j""".replace("\n,\nw as", ",\nw as"), ["cumulative_pct", "survival_pct"])
def q_first_failure(spark, sf):
    return H.first_failure(A.scores(spark, sf), ORIG, RANDOM)


@register("improvability_curve", W(O.scores_cte()) + """
select c, label, avg((1.0 - value / baseline) * 100) as improvability, count((1.0 - value / baseline) * 100) as n
from scores join (select dataset, baseline from base where evaluator = 'KNN' and metric = 'AUC') b using (dataset)
group by all""", ["improvability"])
def q_imp_curve(spark, sf):
    b = A.baselines(spark, sf).filter("evaluator = 'KNN' and metric = 'AUC'")
    return H.improvability_curve(A.scores(spark, sf), b)


@register("curve_with_spread", W(O.scores_cte()) + """
select c, label, avg(value) as mean, coalesce(stddev_samp(value), 0.0) as std, count(*) as n
from scores where value is not null group by all""", ["mean", "std"])
def q_curve(spark, sf):
    return H.curve_with_spread(A.scores(spark, sf))


@register("win_loss_matrix", W(O.scores_cte()) + f""",
d as (select dataset, c, max(case when label = '{TARGET}' then value end) - max(case when label = '{RANDOM}' then value end) as d
      from scores group by dataset, c)
select * from (
select dataset, max(case when c = 1 then d end) as "1", max(case when c = 2 then d end) as "2",
       max(case when c = 4 then d end) as "4", max(case when c = 8 then d end) as "8",
       max(case when c = 16 then d end) as "16", max(case when c = 32 then d end) as "32"
from d group by dataset) x
where coalesce("1", "2", "4", "8", "16", "32") is not null""".replace("\n,\nd as", ",\nd as") .replace(
    "select * from (", "select *, (coalesce(\"1\", 0) + coalesce(\"2\", 0) + coalesce(\"4\", 0) + coalesce(\"8\", 0) "
    "+ coalesce(\"16\", 0) + coalesce(\"32\", 0)) / 6.0 as sort_key from ("),
          ['"1"', '"2"', '"4"', '"8"', '"16"', '"32"', "sort_key"])
def q_win_loss(spark, sf):
    return H.win_loss_matrix(A.scores(spark, sf), TARGET, RANDOM)


def _paired_sql(a, b):
    return (f"p as (select dataset, c, max(case when label = '{a}' then value end) as value_a, "
            f"max(case when label = '{b}' then value end) as value_b from scores group by dataset, c "
            f"having value_a is not null and value_b is not null)")


@register("paired_summary", W(O.scores_cte(), _paired_sql(TARGET, RANDOM)) + """
select c, count(*) as n, avg(value_a) as mean_a, avg(value_b) as mean_b, avg(value_a - value_b) as mean_gain,
       median(value_a - value_b) as median_gain from p group by c""", ["mean_a", "mean_b", "mean_gain", "median_gain"])
def q_paired(spark, sf):
    return H.paired_summary(A.scores(spark, sf), TARGET, RANDOM)


@register("scatter_summary", W(O.scores_cte(), _paired_sql(TARGET, ORIG)) + """
select c, count(*) as n, avg(round(value_a - value_b, 9)) as mean_diff, cast(count_if(round(value_a - value_b, 9) > 0) as bigint) as n_above,
       cast(count_if(round(value_a - value_b, 9) < 0) as bigint) as n_below from p group by c""", ["mean_diff"])
def q_scatter(spark, sf):
    return H.scatter_summary(A.scores(spark, sf), TARGET, ORIG)


@register("box_summary", W(O.scores_cte(), _paired_sql(TARGET, RANDOM)) + """
select c, count(*) as n, quantile_cont(value_a - value_b, 0.25) as q1, quantile_cont(value_a - value_b, 0.5) as median,
       quantile_cont(value_a - value_b, 0.75) as q3, avg(value_a - value_b) as mean from p group by c""",
          ["q1", "median", "q3", "mean"])
def q_box(spark, sf):
    return H.box_summary(A.scores(spark, sf), TARGET, RANDOM).drop("p_value")


@register("box_summary_test", WR(O.scores_cte(), _paired_sql(TARGET, RANDOM), "pd as (select dataset, c, value_a - value_b as d from p)") + f"""
select c, count(*) as n, quantile_cont(d, 0.25) as q1, quantile_cont(d, 0.5) as median, quantile_cont(d, 0.75) as q3, avg(d) as mean,
       case when max(abs(d)) <= 1e-12 then 1.0 else any_value(p_value) end as p_value
from pd left join (select c, p_value from {O.wilcoxon_p_sql('pd', 'c', True, 1)}) t using (c) group by c""",
          ["q1", "median", "q3", "mean", "p_value"])
def q_box_test(spark, sf):
    return H.box_summary(A.scores(spark, sf), TARGET, RANDOM)


@register("gain_histogram", W(O.scores_cte(), _paired_sql(TARGET, ORIG)) + """
select bucket, count(*) as n, -0.12 + (bucket - 1) * (0.34 / 34) as bin_lo from
 (select case when value_a - value_b < -0.12 then 0 when value_a - value_b >= 0.22 then 35
              else cast(floor((value_a - value_b + 0.12) / 0.34 * 34) as bigint) + 1 end as bucket from p where c = 8) x
group by bucket""", ["bin_lo"])
def q_hist(spark, sf):
    s = A.scores(spark, sf).filter(F.col("c") == 8)
    return H.gain_histogram(H._paired(s, TARGET, ORIG))


from tessera.plans import queries_select  # noqa: E402,F401  (registers more queries)
from tessera.plans import queries_search  # noqa: E402,F401
from tessera.plans import queries_more  # noqa: E402,F401
from tessera.plans import queries_stores  # noqa: E402,F401
