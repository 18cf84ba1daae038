"""Registered queries for preparation, selection, k-medoids and scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.hashing import seeded_order
from tessera.operators import kmedoids as K
from tessera.operators import prep as P
from tessera.operators import results as G
from tessera.operators import score as E
from tessera.operators import select as S
from tessera.plans import analysis as A
from tessera.plans import fixtures as FX
from tessera.plans import oracle as O
from tessera.plans.queries import register
from tessera.session import ensure_checkpoint_dir
from tessera.sources.tables import read_table

POOL_SQL = f"pool as ({FX.lineitem_pool_sql()})"
EMB_SQL = "emb as (select vec_id as row_id, embedding as features, label from embeddings)"


def H(seed_sql, key_sql):
    return f"('0x' || substr(md5(concat({seed_sql}, '|', {key_sql})), 1, 8))::BIGINT"


# ============================================================ preparation (P)
@register("imbalance_ratio", f"with {POOL_SQL} select max(c) / min(c) as imbalance_ratio from "
          "(select label, count(*) as c from pool group by label) x", ["imbalance_ratio"])
def q_ir(spark, sf):
    return P.imbalance_ratio(FX.lineitem_pool(spark, sf))


NULLY = [("case when l_orderkey % 7 = 0 then null else l_quantity end", "quantity"),
         ("case when l_partkey % 7 = 0 then null else l_discount end", "discount"),
         ("l_tax", "tax"),
         ("case when l_suppkey % 7 = 0 then null else l_returnflag end", "returnflag")]


def _nully(spark, sf):
    return read_table(spark, sf, "lineitem").selectExpr(*[f"{e} as {a}" for e, a in NULLY],
                                                        "l_orderkey", "l_linenumber")


NULLY_SQL = "nl as (select " + ", ".join(f"{e} as {a}" for e, a in NULLY) + ", l_orderkey, l_linenumber from lineitem)"


@register("missing_ratio", f"with {NULLY_SQL} select (avg(case when quantity is null then 1.0 else 0.0 end) + "
          "avg(case when discount is null then 1.0 else 0.0 end) + avg(case when tax is null then 1.0 else 0.0 end) + "
          "avg(case when returnflag is null then 1.0 else 0.0 end)) / 4 as missing_ratio from nl", ["missing_ratio"])
def q_missing_ratio(spark, sf):
    return P.missing_ratio(_nully(spark, sf), ["quantity", "discount", "tax", "returnflag"])


@register("constant_columns", """
select 'p_size' as column_name, min(p_size) = max(p_size) as is_constant from part
union all select 'p_brand', min(p_brand) = max(p_brand) from part
union all select 'p_constant', true from part limit 3""")
def q_constant(spark, sf):
    part = read_table(spark, sf, "part").withColumn("p_constant", F.lit(1))
    return P.constant_columns(part, ["p_size", "p_brand", "p_constant"])


@register("column_types", """
select 'p_brand' as column_name, case when count(distinct p_brand) <= 2 and coalesce(bool_and(lower(p_brand) in ('yes','no','true','false','t','f','1','0')), true) then 'bin' else 'cat' end as column_type from part
union all select 'p_size', case when count(*) > 0 then 'num' end from part
union all select 'p_even', case when count(distinct p_size % 2) <= 2 then 'num' end from part
union all select 'p_code', case when count(distinct p_size % 2) <= 2 then 'bin' else 'cat' end from part
union all select 'p_flag', case when count(distinct p_flag) <= 2 and coalesce(bool_and(lower(p_flag) in ('yes','no','true','false','t','f','1','0')), true) then 'bin' else 'cat' end
  from (select case when p_size % 2 = 0 then 'Yes' else 'no' end as p_flag from part) f""")
def q_types(spark, sf):
    part = read_table(spark, sf, "part").withColumn("p_flag", F.expr("case when p_size % 2 = 0 then 'Yes' else 'no' end"))
    part = part.withColumns({"p_even": F.expr("p_size % 2"), "p_code": F.expr("p_size % 2")})
    return P.column_types(part, ["p_brand", "p_size", "p_even", "p_code", "p_flag"], categorical=["p_code"])


@register("label_encoding", "select c_custkey, cast(dense_rank() over (order by c_mktsegment) - 1 as int) as label from customer")
def q_label_enc(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    return P.encode_labels(c)


@register("fold_assignment", f"with {POOL_SQL} select row_id, cast({H("'0'", 'row_id')} % 10 as int) as fold from pool")
def q_folds(spark, sf):
    return P.fold_assignment(FX.lineitem_pool(spark, sf).select("row_id"), 10)


@register("subsample", f"with {POOL_SQL} select row_id, label from pool order by {H("'7'", 'row_id')}, row_id limit 1000")
def q_subsample(spark, sf):
    return P.subsample(FX.lineitem_pool(spark, sf).select("row_id", "label"), 1000, 7)


@register("ordinal_encoding", f"""
with p as (select p_partkey, p_brand, p_type, cast({H("'0'", 'p_partkey')} % 5 as int) as fold from part),
tr as (select * from p where fold <> 0),
cb as (select p_brand as category, cast(dense_rank() over (order by p_brand) - 1 as double) as code from (select distinct p_brand from tr) x),
ct as (select p_type as category, cast(dense_rank() over (order by p_type) - 1 as double) as code from (select distinct p_type from tr) x)
select t.p_partkey, coalesce(cb.code, -1.0) as p_brand, coalesce(ct.code, -1.0) as p_type
from (select * from p where fold = 0) t left join cb on t.p_brand = cb.category left join ct on t.p_type = ct.category""")
def q_ordinal(spark, sf):
    p = P.fold_assignment(read_table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_brand", "p_type"), 5)
    train, test = P.split_fold(p, 0)
    codes = P.fit_ordinal(train, ["p_brand", "p_type"])
    return P.apply_ordinal(test, codes, ["p_brand", "p_type"]).select(
        F.col("row_id").alias("p_partkey"), "p_brand", "p_type")


@register("imputation", f"""
with {NULLY_SQL},
p as (select *, cast({H("'0'", "concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar))")} % 5 as int) as fold from nl),
m as (select avg(quantity) as q, avg(discount) as d from p where fold <> 0),
md as (select returnflag from p where fold <> 0 and returnflag is not null group by returnflag order by count(*) desc, returnflag limit 1)
select l_orderkey, l_linenumber, fold, coalesce(quantity, (select q from m)) as quantity, coalesce(discount, (select d from m)) as discount,
       coalesce(returnflag, (select returnflag from md)) as returnflag from p""", ["quantity", "discount"])
def q_impute(spark, sf):
    nl = _nully(spark, sf)
    p = nl.withColumn("fold", (seeded_order(0, F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                                                         F.col("l_linenumber").cast("string"))) % 5).cast("int"))
    fills = P.fit_imputer(p.filter("fold <> 0"), ["quantity", "discount"], ["returnflag"])
    return P.apply_imputer(p, fills).select("l_orderkey", "l_linenumber", "fold", "quantity", "discount", "returnflag")


@register("budget_grid", O.with_base() + """
select dataset, n_selected from (select distinct dataset, least(greatest(cast(n_classes as bigint) * m, 1), n_samples) as n_selected
  from catalog, (values (1), (2), (4), (8), (16), (32)) v(m)) x""")
def q_budget_grid(spark, sf):
    return P.budget_grid_df(A.catalog(spark, sf))


@register("train_validation_split", f"with {POOL_SQL} select row_id, label, case when cast({H("'42'", 'row_id')} as double) "
          "/ 4294967296.0 < 0.2 then 'val' else 'train' end as split from pool")
def q_split(spark, sf):
    return P.train_validation_split(FX.lineitem_pool(spark, sf).select("row_id", "label"))


# ============================================================ selection (I)
BUDGETS = [3, 6, 12, 24, 48, 96]
SEEDS = [42, 43, 44, 45, 46]


@register("random_selection", f"""
with {POOL_SQL},
r as (select s.seed, p.row_id, row_number() over (partition by s.seed order by {H('cast(s.seed as varchar)', 'p.row_id')}, p.row_id) as pos
      from pool p, (values {', '.join(f'({s})' for s in SEEDS)}) s(seed))
select r.seed, b.n_selected, r.row_id, r.pos from r join (values {', '.join(f'({b})' for b in BUDGETS)}) b(n_selected)
  on r.pos <= b.n_selected""")
def q_random(spark, sf):
    return S.random_selection(FX.lineitem_pool(spark, sf), BUDGETS, SEEDS).withColumn("seed", F.col("seed").cast("int")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


@register("min_one_per_class", f"""
with {POOL_SQL},
f as (select arg_min(row_id, ({H("'42'", 'row_id')}, row_id)) as row_id from pool group by label),
r as (select row_id from pool where row_id not in (select row_id from f) order by {H("'42'", 'row_id')}, row_id limit 9)
select row_id from f union all select row_id from r""")
def q_min_one(spark, sf):
    return S.min_one_per_class(FX.lineitem_pool(spark, sf), 12, 42)


@register("balanced_selection", f"""
with {POOL_SQL}
select row_id, label from (select row_id, label, row_number() over (partition by label order by {H("'42'", 'row_id')}, row_id) as pos
  from pool) x where pos <= 8""")
def q_balanced(spark, sf):
    return S.balanced_selection(FX.lineitem_pool(spark, sf), 24, 42)


QUOTA_LABEL = "case when p_partkey <= 3 then 0 when p_partkey <= 10 then 1 when p_partkey <= 40 then 2 else 3 + p_partkey % 2 end"


@register("balanced_rounds", f"""
with p as (select p_partkey as row_id, cast({QUOTA_LABEL} as int) as label from part),
sizes as (select label, count(*) as size, least(count(*), 128 // (select count(distinct label) from p)) as share from p group by label),
seats as (select label, r, row_number() over (order by r, size - share - r desc, {H("'42'", "label")}, label) as seat
          from (select *, unnest(range(0, least(size - share, 128))) as r from sizes) x),
quota as (select s.label, s.share + count(seats.seat) as quota from sizes s left join seats on seats.label = s.label
          and seat <= 128 - (select sum(share) from sizes) group by s.label, s.share)
select row_id, label from (select *, row_number() over (partition by label order by {H("'42'", "row_id")}, row_id) as pos from p) x
join quota using (label) where pos <= quota""")
def q_balanced_rounds(spark, sf):
    """I5 with classes of 3, 7 and 30 rows: the seats they leave go to the others over many rounds."""
    part = read_table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.expr(QUOTA_LABEL).cast("int").alias("label"))
    return S.balanced_selection(part, 128, 42)


SCORE_EXPR = "cast(l_extendedprice * (1 - l_discount) as double)"


@register("top_by_score", f"""
with s as (select {FX.LINEITEM_ROW_ID_SQL} as row_id, {SCORE_EXPR} as score from lineitem),
t as (select row_id, score, row_number() over (order by score desc, row_id) as pos from s)
select b.n_selected, t.row_id, t.score, t.pos from t join (values {', '.join(f'({b})' for b in BUDGETS)}) b(n_selected)
  on t.pos <= b.n_selected""", ["score"])
def q_top(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.expr(FX.LINEITEM_ROW_ID).alias("row_id"),
                                                  F.expr(SCORE_EXPR).alias("score"))
    return S.top_by_score(li, BUDGETS).withColumn("pos", F.col("pos").cast("bigint"))


@register("curve_lookup", O.with_base() + """,
curve as (select dataset, fold, n_selected as size, value from foldt where method = 'KMedoids' and space = 'Emb' and metric = 'AUC'),
bud as (select distinct f.dataset, f.fold, k.n_classes * m - 1 as n_selected from foldt f join catalog k using (dataset),
        (values (1), (2), (4), (8), (16), (32)) v(m) where f.method = 'KMedoids')
select b.dataset, b.fold, b.n_selected, max(c.size) as size, arg_max(c.value, c.size) as value
from bud b join curve c on b.dataset = c.dataset and b.fold = c.fold and c.size <= b.n_selected
group by all""".replace("\n,\ncurve", ",\ncurve"), ["value"])
def q_curve_lookup(spark, sf):
    ft = A.fold_table(spark, sf)
    curve = ft.filter("method = 'KMedoids' and space = 'Emb' and metric = 'AUC'").select(
        "dataset", "fold", F.col("n_selected").alias("size"), "value")
    cat = A.catalog(spark, sf).select("dataset", "n_classes")
    bud = (ft.filter("method = 'KMedoids'").select("dataset", "fold").distinct().join(F.broadcast(cat), "dataset")
           .withColumn("m", F.explode(F.array(*[F.lit(m) for m in G.C_MULTIPLIERS])))
           .select("dataset", "fold", (F.col("n_classes") * F.col("m") - 1).alias("n_selected")))
    return S.curve_lookup(curve, bud)


@register("class_coverage", f"""
with {EMB_SQL},
sel as (select row_id from emb order by {H("'42'", 'row_id')}, row_id limit 15)
select count(distinct label) as selected_classes, (select count(distinct label) from emb) as pool_classes,
       count(distinct label) / (select count(distinct label) from emb) as class_discovery
from emb where row_id in (select row_id from sel)""", ["class_discovery"])
def q_coverage(spark, sf):
    pool = FX.embeddings_pool(spark, sf)
    sel = S.random_selection(pool, [15], [42]).select("row_id")
    return S.class_coverage(pool, sel)


@register("apply_selection", f"""
with {POOL_SQL},
sel as (select row_id from pool order by {H("'42'", 'row_id')}, row_id limit 30)
select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem where {FX.LINEITEM_ROW_ID_SQL} in (select row_id from sel)""")
def q_apply(spark, sf):
    pool = FX.lineitem_pool(spark, sf)
    sel = S.normalise_selection(S.random_selection(pool, [30], [42]).select("row_id"), pool)
    orig = read_table(spark, sf, "lineitem").withColumn("row_id", F.expr(FX.LINEITEM_ROW_ID))
    return S.apply_selection(orig, sel).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


# ============================================================ k-medoids
@register("kmedoids_embeddings")
def q_km(spark, sf):
    pool = FX.embeddings_pool(spark, sf)
    med, _ = K.kmedoids(pool, 10, 42, "euclidean")
    return K.kmedoids_summary(pool, med, "euclidean")


@register("kmedoids_cosine_embeddings")
def q_km_cos(spark, sf):
    pool = FX.embeddings_pool(spark, sf)
    med, _ = K.kmedoids(pool, 10, 42, "cosine")
    return K.kmedoids_summary(pool, med, "cosine")


@register("kmedoids_heuristic_embeddings")
def q_km_heur(spark, sf):
    pool = FX.embeddings_pool(spark, sf)
    med, _ = K.kmedoids(pool, 10, 42, "euclidean", init="heuristic")
    return K.kmedoids_summary(pool, med, "euclidean")


def _rand_medoids_sql(k=10):
    return f"med as (select row_id as medoid, features as mf, row_number() over (order by {H("'42'", 'row_id')}, row_id) - 1 as cluster from emb order by {H("'42'", 'row_id')}, row_id limit {k})"


ASSIGN_SQL = f"""with {EMB_SQL},
{_rand_medoids_sql()},
d as (select e.row_id, m.cluster, list_distance(cast(e.features as double[]), cast(m.mf as double[])) as dist from emb e, med m)
select row_id, cast(arg_min(cluster, (dist, cluster)) as int) as cluster, min(dist) as dist from d group by row_id"""


@register("kmedoids_assign_step", ASSIGN_SQL, ["dist"])
def q_assign(spark, sf):
    pool = FX.embeddings_pool(spark, sf)
    med = K.init_random(pool.select("row_id", "features"), 10, 42)
    return K.assign(pool.select("row_id", "features"), med).select("row_id", "cluster", "dist")


UPDATE_SQL = f"""with {EMB_SQL},
{_rand_medoids_sql()},
d as (select e.row_id, m.cluster, list_distance(cast(e.features as double[]), cast(m.mf as double[])) as dist from emb e, med m),
a as (select row_id, cast(arg_min(cluster, (dist, cluster)) as int) as cluster from d group by row_id),
s as (select a.cluster, a.row_id, sum(list_distance(cast(e1.features as double[]), cast(e2.features as double[]))) as total
      from a join emb e1 on a.row_id = e1.row_id join a b on a.cluster = b.cluster join emb e2 on b.row_id = e2.row_id
      group by a.cluster, a.row_id)
select cluster, arg_min(row_id, (round(total, 9), row_id)) as medoid, min(total) as total from s group by cluster"""


@register("kmedoids_update_step", UPDATE_SQL, ["total"])
def q_update(spark, sf):
    pool = FX.embeddings_pool(spark, sf).select("row_id", "features")
    med = K.init_random(pool, 10, 42)
    a = K.assign(pool, med).persist()
    cost = {r["cluster"]: r["c"] for r in a.groupBy("cluster").agg(F.sum("dist").alias("c")).collect()}
    import numpy as np
    new, vals, _ = K._best_members_euclidean(a, 10, med, np.array([cost.get(i, 0.0) for i in range(10)]))
    rows = [(i, int(m), float(v)) for i, (m, v) in enumerate(zip(new, vals))]
    return spark.createDataFrame(rows, "cluster int, medoid long, total double")


@register("duplicate_medoids", f"""with p as (select {FX.LINEITEM_ROW_ID_SQL} as row_id, [l_quantity, l_discount, l_tax] as v from lineitem),
med as (select * from p order by {H("'42'", 'row_id')}, row_id limit 400)
select m.medoid, m.n_medoids, o.pool_count from (select v, min(row_id) as medoid, count(*) as n_medoids from med group by v) m
join (select v, count(*) as pool_count from p group by v) o using (v)""")
def q_dup(spark, sf):
    """I11 over vectors that repeat: quantity, discount and tax of lineitem, 400 medoids."""
    pool = FX.lineitem_pool(spark, sf).withColumn("features", F.array(*[F.col("features")[i] for i in (0, 2, 3)]))
    return K.duplicate_medoids(pool, K.init_random(pool, 400, 42))


@register("kmedoids_lineitem")
def q_km_li(spark, sf):
    pool = FX.lineitem_pool(spark, sf)
    # nearly 1-D data (price dominates): stop at < 1e-4 relative cost gain per iteration
    med, _ = K.kmedoids(pool, 12, 42, "euclidean", tol=1e-4)
    return K.kmedoids_summary(pool, med, "euclidean")


# ============================================================ scoring (E)
F3_SCORE = f"(({H("'p'", 'doc_id')} % 100) / 100.0)"


def _f3(spark, sf):
    lab = read_table(spark, sf, "labels")
    s = ((seeded_order("p", F.col("doc_id")) % 100) / 100.0)
    return lab.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("y_true"),
                      F.explode(F.array(F.struct(F.lit(0).alias("class"), (1 - s).alias("prob")),
                                        F.struct(F.lit(1).alias("class"), s.alias("prob")))).alias("x")) \
        .select("row_id", "y_true", "x.class", "x.prob")


AUC_SQL = """select (sum(case when y = 1 then r end) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
        / (count_if(y = 1) * count_if(y = 0)) as AUC
from (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from p) x"""


@register("auc_binary", f"with p as (select quality as y, {F3_SCORE} as s from labels) " + AUC_SQL, ["AUC"])
def q_auc(spark, sf):
    return E.auc(_f3(spark, sf))


def _events_pred(spark, sf):
    ev = read_table(spark, sf, "events")
    codes = ev.select("event_type").distinct().withColumn("y_true", (F.dense_rank().over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("event_type")) - 1).cast("int"))
    e = ev.join(F.broadcast(codes), "event_type").select(F.col("event_id").alias("row_id"), "y_true")
    x = e.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(4))))
    w = (seeded_order(F.concat(F.lit("w"), F.col("class").cast("string")), F.col("row_id")) % 1000 + 1).cast("double")
    x = x.withColumn("w", w)
    tot = x.groupBy("row_id").agg(F.sum("w").alias("tw"))
    return x.join(tot, "row_id").select("row_id", "y_true", "class", (F.col("w") / F.col("tw")).alias("prob"))


EVENTS_SQL = f"""ev as (select e.event_id as row_id, c.y_true from events e join
  (select event_type, cast(dense_rank() over (order by event_type) - 1 as int) as y_true from (select distinct event_type from events) d) c using (event_type)),
x as (select row_id, y_true, cls as class, cast({H("concat('w', cast(cls as varchar))", 'row_id')} % 1000 + 1 as double) as w
      from ev, range(0, 5) r(cls)),
pr as (select row_id, y_true, class, w / sum(w) over (partition by row_id) as prob from x),
hard as (select row_id, y_true, arg_max(class, (prob, -class)) as y_pred from pr group by row_id, y_true),
conf as (select class, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (
   select y_true as class, case when y_true = y_pred then 1 else 0 end as tp, 0 as fp, case when y_true <> y_pred then 1 else 0 end as fn from hard
   union all select y_pred, 0, case when y_true <> y_pred then 1 else 0 end, 0 from hard) u group by class),
aucs as (select class, (sum(case when y_true = class then r end) - count_if(y_true = class) * (count_if(y_true = class) + 1) / 2.0)
          / (count_if(y_true = class) * count_if(y_true <> class)) as auc
         from (select *, rank() over (partition by class order by prob) + (count(*) over (partition by class, prob) - 1) / 2.0 as r from pr) z
         group by class)"""


@register("metrics_events", f"""with {EVENTS_SQL}
select 'AUC' as metric, (select avg(auc) from aucs) as value
union all select 'ACC', (select avg(case when y_true = y_pred then 1.0 else 0.0 end) from hard)
union all select 'F1', (select avg(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end) from conf)
union all select 'BalACC', (select avg(tp / (tp + fn)) from conf where tp + fn > 0)""", ["value"])
def q_metrics_events(spark, sf):
    return E.all_metrics(_events_pred(spark, sf))


KNN_SQL = """nn as (select t.row_id, t.label as y_true, c.label as cl,
              row_number() over (partition by t.row_id order by list_distance(cast(t.features as double[]), cast(c.features as double[])), c.row_id) as r
       from te t, ctx c),
cls as (select distinct label as class from (select label from ctx union all select label from te) u),
pr as (select n.row_id, n.y_true, cast(cls.class as int) as class, count_if(n.cl = cls.class and n.r <= 5) / 5.0 as prob
       from nn n, cls group by all)"""
METRIC_CTES = EVENTS_SQL[EVENTS_SQL.index("hard as"):].replace("as auc\n", "as auc, count_if(y_true = class) as p, count_if(y_true <> class) as n\n") \
    .replace("/ (count_if(y_true = class) * count_if(y_true <> class))", "/ nullif(count_if(y_true = class) * count_if(y_true <> class), 0)")
METRICS_SQL = """select 'AUC' as metric, (select avg(auc) from aucs where p > 0) as value
union all select 'ACC', (select avg(case when y_true = y_pred then 1.0 else 0.0 end) from hard)
union all select 'F1', (select avg(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end) from conf)
union all select 'BalACC', (select avg(tp / (tp + fn)) from conf where tp + fn > 0)"""
SEL20_SQL = f"""{EMB_SQL},
ctx as (select * from emb order by {H("'42'", 'row_id')}, row_id limit 20),
te as (select * from emb where row_id not in (select row_id from ctx))"""


@register("knn_predictions", f"with {SEL20_SQL}, {KNN_SQL} select * from pr", ["prob"])
def q_knn(spark, sf):
    pool = FX.embeddings_pool(spark, sf)
    sel = S.random_selection(pool, [20], [42]).select("row_id")
    ctx = pool.join(sel, "row_id", "left_semi")
    test = pool.join(sel, "row_id", "left_anti")
    return E.knn_predict(ctx, test, 5)


@register("knn_metrics", f"with {SEL20_SQL}, {KNN_SQL}, {METRIC_CTES} {METRICS_SQL}", ["value"])
def q_knn_metrics(spark, sf):
    return E.all_metrics(q_knn(spark, sf))


@register("auc_all_classes", f"with {EVENTS_SQL} select avg(auc) as AUC from (select class, (sum(case when y_true = class then r end) - p * (p + 1) / 2.0) / (p * n) as auc "
          "from (select *, count_if(y_true = class) over (partition by class) as p, count_if(y_true <> class) over (partition by class) as n from "
          "(select *, rank() over (partition by class order by prob) + (count(*) over (partition by class, prob) - 1) / 2.0 as r from pr) a) b "
          "where p > 0 and n > 0 group by class, p, n) c", ["AUC"])
def q_auc_all(spark, sf):
    """The search's AUC, over all classes and not only those seen in test."""
    return E.auc(_events_pred(spark, sf), restrict_to_test_labels=False)


@register("one_per_class_short", f"with {POOL_SQL} select row_id from pool order by {H("'42'", 'row_id')}, row_id limit 2")
def q_short(spark, sf):
    """Fewer rows than classes, so plain random selection."""
    return S.min_one_per_class(FX.lineitem_pool(spark, sf), 2, 42)


@register("random_whole_pool", f"with {EMB_SQL} select s.seed, 1000000 as n_selected, row_id from emb, (values (42), (43)) s(seed)")
def q_whole(spark, sf):
    """A budget beyond the pool takes all of it."""
    return S.random_selection(FX.embeddings_pool(spark, sf), [1_000_000], [42, 43]).drop("pos")


@register("logistic_predictions")
def q_lr(spark, sf):
    pool = FX.embeddings_pool(spark, sf)
    sel = S.balanced_selection(pool, 40, 42).select("row_id")
    return E.logistic_predict(pool.join(sel, "row_id", "left_semi"), pool.join(sel, "row_id", "left_anti"))


@register("full_pool_reference", f"""with {EMB_SQL}, ctx as (select * from emb where {H("'0'", 'row_id')} % 5 <> 0),
te as (select * from emb where {H("'0'", 'row_id')} % 5 = 0), {KNN_SQL}, {METRIC_CTES} {METRICS_SQL}""", ["value"])
def q_full(spark, sf):
    pool = P.fold_assignment(FX.embeddings_pool(spark, sf), 5)
    train, test = P.split_fold(pool, 0)
    return E.all_metrics(E.knn_predict(train, test, 5))


# ============================================================ RDSS, ZCore
@register("rdss_embeddings")
def q_rdss(spark, sf):
    from tessera.operators.herding import rdss
    pool = FX.embeddings_pool(spark, sf)
    picks = rdss(pool, 20)
    order = spark.createDataFrame([(int(i), p) for p, i in enumerate(picks)], "row_id long, pick int")
    return pool.join(F.broadcast(order), "row_id").select("pick", "row_id", "label")


@register("zcore_top_embeddings")
def q_zcore(spark, sf):
    """The method's 1,000,000 draws and 1,000 neighbours, through the score store."""
    from tessera.operators.zcore import zcore_scores
    from tessera.sources.results_io import score_store
    pool = FX.embeddings_pool(spark, sf)
    store = score_store(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/zcore-{uuid.uuid4().hex}")
    wanted = spark.createDataFrame([("embeddings", 0, "Emb")], "dataset string, fold int, space string").withColumn(
        "n_rows", pool.select(F.count(F.lit(1))).scalar())
    scores = store.get_or_compute(wanted, lambda todo: zcore_scores(pool).withColumns({c: F.lit(v) for c, v in todo.first().asDict().items() if c in store.run_key}))
    return S.top_by_score(scores, [10, 20, 40, 80])
