"""DuckDB oracle SQL for the registered queries (independent relational text).

Every statement runs on the pre-registered views (lineitem, part, ...).  Float
outputs are rounded to 6 decimals by ``rounded`` on both sides.
"""

from __future__ import annotations

from tessera.plans import fixtures as FX

ROUND = 6
# Rounding boundaries are moved off "nice" decimals: means of 3-decimal values often land
# exactly on ...5e-7, where engines that sum in a different order round differently.
ROUND_OFFSET = 7.31e-10


def rounded(sql: str, float_cols) -> str:
    if not float_cols:
        return sql
    rep = ", ".join(f"round({c} + {ROUND_OFFSET}, {ROUND}) as {c}" for c in float_cols)
    return f"select * replace ({rep}) from ({sql}) q"


def runs_values() -> str:
    rows = ", ".join(f"('{m}', {n})" for m, n in sorted(FX.RUNS_PER_METHOD.items()))
    return f"(values {rows}) as u(method, runs)"


BASE = f"""
fact as ({FX.all_results_sql()}),
run as (select dataset, fold, space, method, evaluator, n_selected, seed, metric, avg(value) as value
        from fact where value is not null group by all),
win as (select r.* from run r left join {runs_values()} on r.method = u.method
        where r.method in {FX.EXEMPT_SQL} or (r.seed >= 42 and r.seed <= 42 + coalesce(u.runs, 1) - 1)),
foldt as (select dataset, fold, space, method, evaluator, n_selected, metric, avg(value) as value
          from win group by all),
catalog as ({FX.CATALOG_SQL}),
cells as (select f.dataset, cast(f.n_selected // k.n_classes as int) as c, space, method, evaluator, metric,
                 avg(value) as value, count(*) as n_folds
          from foldt f join catalog k on f.dataset = k.dataset
          where method <> 'All' and f.n_selected % k.n_classes = 0
            and f.n_selected // k.n_classes in (1, 2, 4, 8, 16, 32)
          group by all),
lab as (select * from {FX.labels_sql()}),
base as (select dataset, evaluator, metric, avg(value) as baseline, count(*) as n_folds from
           (select dataset, evaluator, metric, fold, avg(value) as value from foldt where method = 'All' group by all) b
         group by all)
"""


def scores_cte(metric: str = "AUC", name: str = "scores") -> str:
    return (f"{name} as (select dataset, c, label, label_order, value from cells join lab using (space, method) "
            f"where metric = '{metric}' and evaluator = 'KNN')")


def with_base(*ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"with {BASE}{extra}\n"


# complete-case average ranks over the active labels of a score table
def ranks_cte(src: str = "scores", name: str = "ranks") -> str:
    return f"""{name}_act as (select * from {src} where value is not null
                and label in (select label from {src} where value is not null)),
{name}_k as (select count(distinct label) as k from {name}_act),
{name}_cc as (select a.* from {name}_act a join (select dataset, c from {name}_act group by dataset, c
              having count(*) = (select k from {name}_k)) cc using (dataset, c)),
{name} as (select dataset, c, label, value,
             rank() over (partition by dataset, c order by round(value, 9) desc)
             + (count(*) over (partition by dataset, c, round(value, 9)) - 1) / 2.0 as rank
           from {name}_cc)"""


# two-sided normal tail p of a z value: Simpson's rule on [|z|, |z| + 12]
def normal_p_sql(z: str) -> str:
    return (f"list_sum(list_transform(range(0, 4001), lambda i: (case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end) "
            f"* exp(-0.5 * power(abs({z}) + i * 0.003, 2)))) * 0.001 * 2 / sqrt(2 * pi())")


# exact signed-rank tail: 2 P(W <= s) for n untied differences, by counting the sign choices rank by rank
SIGNED_RANK_CTE = """sr as (select 0 as n, 0 as s, 1.0::double as ways union all
       select n + 1, s + step, sum(ways) from (select n, s, ways, unnest([0, n + 1]) as step from sr where n < 50) x group by n, s + step),
srp as (select n, s, 2 * sum(ways) over (partition by n order by s) / power(2.0, n) as p from sr)"""

# exact rank-sum counts: ranks taken one by one, k of them chosen, u = unchosen ones below the chosen
RANK_SUM_CTE = """rs as (select 0 as m, 0 as k, 0 as u, 1.0::double as ways union all
       select m + 1, k + step, u + step * (m - k), sum(ways)
       from (select m, k, u, ways, unnest([0, 1]) as step from rs where m < 24) x group by m, k + step, u + step * (m - k)),
rsp as (select m, k, u, 2 * sum(ways) over (partition by m, k order by u desc) / sum(ways) over (partition by m, k) as p from rs)"""


def wilcoxon_p_sql(diffs: str, group: str, zero_drop: bool = False, min_pairs: int = 5) -> str:
    """As ``wilcoxon_sql`` with p_value; needs SIGNED_RANK_CTE in a ``with recursive``."""
    base = wilcoxon_sql(diffs, group, zero_drop, min_pairs)
    return f"""(select w.*, case when w.n >= {min_pairs} then case
          when w.n <= 50 and zeros = 0 and distinct_abs = n_all then least(1.0, srp.p)
          when z is null then 1.0 else {normal_p_sql("z")} end end as p_value
   from {base} w join (select {group}, count(*) as n_all, count_if(round(d, 9) = 0) as zeros, count(distinct abs(round(d, 9))) as distinct_abs
                       from {diffs} group by {group}) t using ({group})
   left join srp on srp.n = w.n and srp.s = cast(round(least(w_plus, w_minus)) as int))"""


def bh_sql(tests: str, group: str = "c") -> str:
    """The relation ``tests`` plus q_value (Benjamini-Hochberg per group; p_value may be null)."""
    return f"""(select * exclude (i, m), case when p_value is not null then min(least(1.0, p_value * m / i)) over (
          partition by {group}, p_value is null order by p_value desc, i desc rows between unbounded preceding and current row) end as q_value
   from (select *, row_number() over (partition by {group}, p_value is null order by p_value) as i,
                count(*) over (partition by {group}, p_value is null) as m from {tests}) b)"""


STARS_SQL = "case when q_value is null then '' when q_value < 0.001 then '***' when q_value < 0.01 then '**' when q_value < 0.05 then '*' else '' end"


def wilcoxon_sql(diffs: str, group: str, zero_drop: bool = False, min_pairs: int = 5) -> str:
    """statistic, z of the paired signed-rank test over a relation (group cols..., d)."""
    flt = "where d <> 0" if zero_drop else ""
    return f"""(select {group}, n, w_plus, w_minus,
        case when n >= {min_pairs} then least(w_plus, w_minus) end as statistic,
        case when n >= {min_pairs} and var > 0 then (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(var) end as z
   from (select {group}, count(*) as n,
           sum(case when d > 0 then r else 0.0 end) + sum(case when d = 0 then r else 0.0 end) / 2 as w_plus,
           sum(case when d < 0 then r else 0.0 end) + sum(case when d = 0 then r else 0.0 end) / 2 as w_minus,
           count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - sum(t * t - 1) / 48.0 as var
         from (select *, rank() over (partition by {group} order by abs(d))
                         + (count(*) over (partition by {group}, abs(d)) - 1) / 2.0 as r,
                         count(*) over (partition by {group}, abs(d)) as t
               from (select {group}, round(d, 9) as d from {diffs}) x {flt}) y
         group by {group}) z)"""
