"""Registered queries for the batch subset search."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tessera.functions.hashing import sql_seeded_order
from tessera.operators import prep as P
from tessera.operators import score as E
from tessera.operators import search as C
from tessera.operators import search_loop as L
from tessera.plans import analysis as A
from tessera.plans import fixtures as FX
from tessera.plans import oracle as O
from tessera.plans.queries import register
from tessera.session import cut_lineage, ensure_checkpoint_dir
from tessera.sources.results_io import curve_json, scan_curves, write_curves

POP, SIZE = 8, 20


def _order_sql(prefix: str, cand: str = "candidate_id", key: str = "row_id") -> str:
    return sql_seeded_order(f"concat('{prefix}:', {cand})", key)


def _train_sql() -> str:
    return f"""emb as (select vec_id as row_id, embedding as features, cast(label as int) as label, {sql_seeded_order("'42'", "vec_id")} / 4294967296.0 as u
        from embeddings), train as (select row_id, features, label from emb where u >= 0.2), val as (select row_id, features, label from emb where u < 0.2)"""


def _cands_sql(n: int, size: int, seed: int, pool: str = "train") -> str:
    """C1 as SQL: ``cands`` (candidate_id, row_id, label)."""
    return f"""cx as (select cast(c.id as int) as candidate_id, t.row_id, t.label, {_order_sql(seed, "c.id", "t.row_id")} as h from {pool} t, range(0, {n}) c(id)),
firsts as (select * from cx qualify row_number() over (partition by candidate_id, label order by h, row_id) = 1),
rest as (select *, row_number() over (partition by candidate_id order by h, row_id) as pos from (select * from cx anti join firsts using (candidate_id, row_id)) a),
cands as (select candidate_id, row_id, label from firsts union all
  select rest.candidate_id, row_id, label from rest join (select candidate_id, count(*) as n_cls from firsts group by candidate_id) k using (candidate_id)
  where pos <= {size} - n_cls)"""


def _split_pool(spark, sf):
    pool = P.train_validation_split(FX.embeddings_pool(spark, sf))
    return pool.filter("split = 'train'").drop("split"), pool.filter("split = 'val'").drop("split")


def _score(cands, train, val):
    ctx = cands.join(train, "row_id")
    pred = cut_lineage(E.knn_predict_grouped(ctx, val, 5))  # read several times by the metric
    auc = E.auc(pred, by=("candidate_id",)).withColumnRenamed("AUC", "val_auc")
    return C.candidate_metrics(cands, train, auc)


def generation(spark, sf, seed=42):
    """One search generation: C1 population -> C3 fitness -> C10 tournament -> C4 crossover ->
    C5 mutation -> C6 repair -> C3 -> C10 elitist replacement."""
    train, val = _split_pool(spark, sf)
    train = train.persist()
    pop = C.random_candidates(train, POP, SIZE, seed).persist()
    m0 = _score(pop, train, val).persist()
    win = C.tournament(m0, POP // 2, seed).collect()  # POP winners, bounded
    pairs = spark.createDataFrame([(POP + i, int(win[2 * i].winner), int(win[2 * i + 1].winner)) for i in range(POP // 2)],
                                  "child_id long, parent_a long, parent_b long")
    kids = C.crossover(pop, pairs, seed)
    sizes = {r[0]: r[1] for r in kids.groupBy("candidate_id").count().collect()}
    n_genes = train.count()
    counts = C.mutation_counts(POP + POP // 2, sizes, n_genes, 0.01, seed)
    counts = {c: v for c, v in counts.items() if c >= POP}
    kids = C.repair(C.mutate(kids, train, counts, seed), train, seed).persist()
    m1 = _score(kids, train, val)
    keep = ["candidate_id", "size", "n_cls", "val_auc", "reduction", "fitness"]
    return C.elitist_replacement(m0.select(*keep), m1.select(*keep), POP)


@register("search_generation")
def q_generation(spark, sf):
    return generation(spark, sf)


@register("random_candidates", f"with {_train_sql()}, {_cands_sql(POP, SIZE, 42)} select * from cands")
def q_random_candidates(spark, sf):
    train, _ = _split_pool(spark, sf)
    c = C.random_candidates(train, POP, SIZE, 42)
    return c.join(train.select("row_id", "label"), "row_id").select("candidate_id", "row_id", "label")


@register("shrink_candidates", f"""with {_train_sql()}, {_cands_sql(POP, 40, 42)},
s as (select *, {_order_sql('7s')} as h2 from cands),
p as (select *, row_number() over (partition by candidate_id, label order by h2, row_id) as within from s)
select candidate_id, row_id from p
qualify within = 1 or row_number() over (partition by candidate_id order by case when within = 1 then 0 else 1 end, h2, row_id) <= 15""")
def q_shrink(spark, sf):
    train, _ = _split_pool(spark, sf)
    return C.shrink(C.random_candidates(train, POP, 40, 42), train, 15, 7)


@register("repair_candidates", f"""with {_train_sql()}, {_cands_sql(POP, 40, 42)},
cut as (select * from cands where label > 1),
miss as (select i.candidate_id, c.label from (select distinct candidate_id from cut) i, (select distinct label from train) c
         anti join cut on cut.candidate_id = i.candidate_id and cut.label = c.label),
pick as (select m.candidate_id, t.row_id from miss m join train t using (label)
         qualify row_number() over (partition by m.candidate_id, m.label order by {_order_sql('5p', 'm.candidate_id', 't.row_id')}, t.row_id) = 1)
select candidate_id, row_id from cut union all select candidate_id, row_id from pick""")
def q_repair(spark, sf):
    train, _ = _split_pool(spark, sf)
    c = C.random_candidates(train, POP, 40, 42).join(train.select("row_id", "label"), "row_id").filter("label > 1").select("candidate_id", "row_id")
    return C.repair(c, train, 5)


@register("flip_neighbours", f"""with {_train_sql()}, {_cands_sql(4, SIZE, 42)},
free as (select * from (select *, count(*) over (partition by candidate_id, label) as n from cands) a where n > 1),
rm as (select candidate_id, row_id, cast(row_number() over (partition by candidate_id order by {_order_sql('3f')}, row_id) - 1 as int) as flip_id, 'remove' as op from free),
off as (select cast(c.id as int) as candidate_id, t.row_id from train t, range(0, 4) c(id) anti join cands k on k.candidate_id = c.id and k.row_id = t.row_id),
ad as (select candidate_id, row_id, cast(row_number() over (partition by candidate_id order by {_order_sql('3g')}, row_id) + 6 as int) as flip_id, 'add' as op from off)
select * from rm where flip_id < 7 union all select * from ad where flip_id < 10""")
def q_flips(spark, sf):
    train, _ = _split_pool(spark, sf)
    c = C.random_candidates(train, 4, SIZE, 42)
    return C.flip_neighbours(c, train, 10, 3)


def _curve_entries(spark, sf):
    ft = A.fold_table(spark, sf)
    return ft.filter("method = 'KMedoids' and space = 'Emb' and metric = 'AUC'").select(
        "dataset", "fold", F.col("n_selected").alias("size"), F.col("value").alias("val_auc"))


CURVE_SQL = O.with_base() + """,
e as (select dataset, fold, n_selected as size, value as val_auc from foldt
      where method = 'KMedoids' and space = 'Emb' and metric = 'AUC' and value > 0)
select dataset, fold, size, val_auc from (
  select *, max(val_auc) over (partition by dataset, fold order by size rows between unbounded preceding and current row) as m
  from (select * from e qualify row_number() over (partition by dataset, fold, size order by val_auc desc) = 1) b) x
where val_auc >= m""".replace("\n,\ne as", ",\ne as")


@register("best_curve", CURVE_SQL, ["val_auc"])
def q_best_curve(spark, sf):
    return C.best_curve(_curve_entries(spark, sf))


def _candidates(spark, sf):
    """Curve candidates with the stored fields; the first ``size`` of as many genes as the dataset has rows are on."""
    cat = A.catalog(spark, sf).select("dataset", "n_classes", F.col("n_samples").cast("int").alias("n_genes"))
    c = C.best_curve(_curve_entries(spark, sf)).join(cat, "dataset")
    red = C.reduction(F.col("size").cast("double"), F.col("n_classes").cast("double"))
    return c.withColumn("genes", F.expr("transform(sequence(1, n_genes), i -> int(i <= size))")).withColumn("reduction", red) \
        .withColumn("fitness", C.fitness(F.col("val_auc"), red, 0.5, F.col("size"), F.lit(True)))


_CAND_SQL = CURVE_SQL.replace("select dataset, fold, size, val_auc from (", "select dataset, fold, size, val_auc, n_classes, n_samples from (", 1) \
    .replace("where val_auc >= m", "join (select dataset, n_classes, n_samples from catalog) k using (dataset) where val_auc >= m")
_RED_SQL = ("0.5 * (1 - size / 500.0) + 0.5 * (0.5 + 0.5 * (1 - (log2(size) - log2(n_classes)) / (log2(500) - log2(n_classes))))")


@register("curve_scan", f"select dataset, cast(fold as int) as fold, cast(size as int) as size, val_auc, n_classes, "
          f"cast(n_samples as int) as n_genes, cast(least(size, n_samples) as int) as n_on from ({_CAND_SQL}) x", ["val_auc"])
def q_curve_scan(spark, sf):
    """Curve files written to the shared folder and read back."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/curves-{uuid.uuid4().hex}"
    write_curves(curve_json(_candidates(spark, sf)), folder)
    return scan_curves(spark, folder).select("dataset", "fold", "size", "val_auc", "n_classes", "n_genes",
                                             F.aggregate("genes", F.lit(0), lambda a, g: a + g).alias("n_on"))


@register("reduction", f"select dataset, fold, size, {_RED_SQL} as reduction from ({_CAND_SQL}) x", ["reduction"])
def q_reduction(spark, sf):
    return _candidates(spark, sf).select("dataset", "fold", "size", "reduction")


@register("fitness", f"select dataset, fold, size, case when size < 2 then 0.0 else 0.5 * val_auc + 0.5 * ({_RED_SQL}) end as fitness "
          f"from ({_CAND_SQL}) x", ["fitness"])
def q_fitness(spark, sf):
    return _candidates(spark, sf).select("dataset", "fold", "size", "fitness")


HIST_SQL = O.with_base() + """
select dataset, n_selected as initial_size, fold as step, avg(value) as mean_fitness, stddev_pop(value) as std_fitness,
       max(value) as best_fitness, arg_max(seed, (round(value, 9), -seed)) as best_candidate
from run where metric = 'AUC' and method <> 'All'
group by dataset, n_selected, fold"""


@register("history_summary", HIST_SQL, ["mean_fitness", "std_fitness", "best_fitness"])
def q_history(spark, sf):
    from tessera.operators import results as G
    run = G.run_means(A.fact(spark, sf)).filter("metric = 'AUC' and method <> 'All'")
    # run means are averages: rounded, so that equal ones are equal in any engine
    h = run.select("dataset", F.col("n_selected").alias("initial_size"), F.col("fold").alias("step"),
                   F.col("seed").alias("candidate_id"), F.round("value", 9).alias("fitness"))
    return C.history_summary(h, by=("dataset",))


SMOOTH_SQL = O.with_base() + """,
pts as (select dataset, log10(n_selected) as lx, value as y from foldt where method = 'KMedoids' and space = 'Emb' and metric = 'AUC'),
rng as (select dataset, min(lx) as lo, max(lx) as hi from pts group by dataset),
g as (select dataset, gi, lo + gi * (hi - lo) / 199 as gx from rng, range(0, 200) t(gi)),
w as (select g.dataset, g.gi, g.gx, exp(-0.5 * power((g.gx - p.lx) / (log10(k.n_samples) / 100.0), 2)) as w, p.y
      from g join pts p using (dataset) join catalog k using (dataset))
select dataset, gi, power(10.0, gx) as size, sum(w * y) / sum(w) as mean,
       sqrt(greatest(sum(w * y * y) / sum(w) - power(sum(w * y) / sum(w), 2), 0.0)) as std
from w group by dataset, gi, gx""".replace("\n,\npts", ",\npts")


@register("kernel_smoother", SMOOTH_SQL, ["size", "mean", "std"])
def q_smoother(spark, sf):
    ft = A.fold_table(spark, sf).filter("method = 'KMedoids' and space = 'Emb' and metric = 'AUC'")
    points = ft.join(A.catalog(spark, sf).select("dataset", F.col("n_samples").alias("n_train")), "dataset").select(
        "dataset", "n_train", F.col("n_selected").alias("size"), F.col("value").alias("auc"))
    return C.kernel_smoother(points).withColumn("gi", F.col("gi").cast("bigint"))


_PAIR_SQL = CURVE_SQL.replace("select dataset, fold, size, val_auc from (", """, curve as (select dataset, fold, size, val_auc from (""", 1) + """),
rnd as (select dataset, fold, n_selected as size, avg(value) as random_auc from foldt where metric = 'AUC' and method = 'Random' group by all),
bud as (select distinct r.dataset, r.fold, k.n_classes * m as n_selected from (select distinct dataset, fold from rnd) r
        join catalog k using (dataset), (values (1), (2), (4), (8), (16), (32)) v(m)),
a as (select b.*, r.size as random_size, r.random_auc from bud b asof join rnd r
      on b.dataset = r.dataset and b.fold = r.fold and b.n_selected >= r.size)
select a.*, c.size as curve_size, c.val_auc from a asof join curve c on a.dataset = c.dataset and a.fold = c.fold and a.n_selected >= c.size"""


@register("pair_random_and_curve", _PAIR_SQL, ["random_auc", "val_auc"])
def q_pair(spark, sf):
    ft = A.fold_table(spark, sf).filter("metric = 'AUC'")
    rnd = ft.filter("method = 'Random'").groupBy("dataset", "fold", F.col("n_selected").alias("size")).agg(
        F.avg("value").alias("random_auc"))
    curve = C.best_curve(_curve_entries(spark, sf))
    cat = A.catalog(spark, sf).select("dataset", "n_classes")
    bud = (rnd.select("dataset", "fold").distinct().join(F.broadcast(cat), "dataset")
           .withColumn("m", F.explode(F.array(*[F.lit(m) for m in (1, 2, 4, 8, 16, 32)])))
           .select("dataset", "fold", (F.col("n_classes") * F.col("m")).alias("n_selected")))
    return C.pair_random_and_curve(rnd, curve, bud)


def _flip_scores(cands, flips, train, val):
    members = C.flipped_members(cands, flips)
    keyed = members.withColumn("candidate_id", F.col("candidate_id") * 1000 + F.col("flip_id"))
    m = _score(keyed.select("candidate_id", "row_id"), train, val)
    return m.select((F.col("candidate_id") / 1000).cast("long").alias("candidate_id"),
                    (F.col("candidate_id") % 1000).alias("flip_id"), "fitness")


CURVE_SIZES, CURVE_FOLD = (10, 20, 40, 80), 0


def _sized_cands_sql(size: int) -> str:
    return re.sub(r"\b(cx|firsts|rest|cands)\b", rf"\1_{size}", _cands_sql(POP, size, 42))


def _knn_metrics_sql(name: str, members: str, rows: str) -> str:
    """CTEs ``<name>_*``: k-NN with 5 neighbours of ``rows`` (row_id, features, label) in each candidate of ``members``
    (cand, row_id, label), and the metrics of every candidate in ``<name>`` (cand, metric, value)."""
    return f"""{name}_nn as (select m.cand, t.row_id, t.label as y_true, m.label as cl, row_number() over (partition by m.cand, t.row_id
   order by list_distance(cast(t.features as double[]), cast(e.features as double[])), m.row_id) as r
   from {members} m join train e on e.row_id = m.row_id, {rows} t),
{name}_pr as (select n.cand, n.row_id, n.y_true, c.class, count_if(n.cl = c.class and n.r <= 5) / 5.0 as prob
   from {name}_nn n, (select distinct label as class from emb) c group by all),
{name}_hard as (select cand, row_id, y_true, arg_max(class, (prob, -class)) as y_pred from {name}_pr group by all),
{name}_conf as (select cand, class, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (
   select cand, y_true as class, cast(y_true = y_pred as int) as tp, 0 as fp, cast(y_true <> y_pred as int) as fn from {name}_hard
   union all select cand, y_pred, 0, cast(y_true <> y_pred as int), 0 from {name}_hard) u group by all),
{name}_auc as (select cand, class, (sum(case when y_true = class then r end) - count_if(y_true = class) * (count_if(y_true = class) + 1) / 2.0)
    / nullif(count_if(y_true = class) * count_if(y_true <> class), 0) as auc, count_if(y_true = class) as p
   from (select *, rank() over (partition by cand, class order by prob) + (count(*) over (partition by cand, class, prob) - 1) / 2.0 as r from {name}_pr) z
   group by all),
{name} as (select cand, 'AUC' as metric, avg(auc) as value from {name}_auc where p > 0 group by cand
   union all select cand, 'ACC', avg(cast(y_true = y_pred as double)) from {name}_hard group by cand
   union all select cand, 'F1', avg(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end) from {name}_conf group by cand
   union all select cand, 'BalACC', avg(tp / (tp + fn)) from {name}_conf where tp + fn > 0 group by cand)"""


FLIPS, FLIP_REMOVES = 6, 4
LOCAL_SQL = f"""with {_train_sql()}, {_cands_sql(4, SIZE, 42)},
free as (select * from (select *, count(*) over (partition by candidate_id, label) as n from cands) a where n > 1),
rm as (select candidate_id, row_id, row_number() over (partition by candidate_id order by {_order_sql('3f')}, row_id) - 1 as flip_id, 'remove' as op from free),
off as (select cast(c.id as int) as candidate_id, t.row_id from train t, range(0, 4) c(id) anti join cands k on k.candidate_id = c.id and k.row_id = t.row_id),
ad as (select candidate_id, row_id, row_number() over (partition by candidate_id order by {_order_sql('3g')}, row_id) - 1 + {FLIP_REMOVES} as flip_id, 'add' as op from off),
fl as (select * from rm where flip_id < {FLIP_REMOVES} union all select * from ad where flip_id < {FLIPS}),
mem as (select c.candidate_id * 1000 + i.flip_id as cand, c.row_id, c.label from cands c join (select distinct candidate_id, flip_id from fl) i using (candidate_id)
          where not exists (select 1 from fl r where r.op = 'remove' and r.candidate_id = c.candidate_id and r.flip_id = i.flip_id and r.row_id = c.row_id)
        union all select candidate_id * 1000 + flip_id, row_id, t.label from fl join train t using (row_id) where op = 'add'
        union all select candidate_id * 1000 + 999, row_id, label from cands),
{_knn_metrics_sql("v", "mem", "val")},
sizes as (select cand, cast(count(*) as double) as size, count(distinct label) as n_cls, (select count(distinct label) from train) as n_classes from mem group by cand),
fit as (select cand // 1000 as candidate_id, cand % 1000 as flip_id, round(case when size < 2 or n_cls < n_classes then 0.0 else 0.5 * value + 0.5 * ({_RED_SQL}) end, 9) as f
        from sizes join v using (cand) where metric = 'AUC'),
best as (select candidate_id, arg_max(flip_id, (f, -flip_id)) as flip_id, max(f) as f from fit where flip_id < 999 group by candidate_id)
select cast(b.candidate_id as bigint) as candidate_id, case when b.f > o.f then cast(b.flip_id as bigint) end as flip_id
from best b join fit o on o.candidate_id = b.candidate_id and o.flip_id = 999"""


@register("local_search_step", LOCAL_SQL)
def q_local_search(spark, sf):
    """Score 6 flips of each of 4 candidates in one job, keep the improving ones."""
    train, val = _split_pool(spark, sf)
    train = train.persist()
    cands = C.random_candidates(train, 4, SIZE, 42).persist()
    m0 = _score(cands, train, val)
    flips = C.flip_neighbours(cands, train, FLIPS, 3)
    return C.local_search_step(cands, m0, _flip_scores(cands, flips, train, val)).select(F.col("candidate_id").cast("long"), F.col("flip_id").cast("long"))


CURVE_EVAL_SQL = f"""with emb as (select vec_id as row_id, embedding as features, cast(label as int) as label from embeddings),
te as (select * from emb where {sql_seeded_order("'0'", "row_id")} % 5 = {CURVE_FOLD}),
val as (select * from emb where {sql_seeded_order("'0'", "row_id")} % 5 <> {CURVE_FOLD} and {sql_seeded_order("'42'", "row_id")} / 4294967296.0 < 0.2),
train as (select * from emb where {sql_seeded_order("'0'", "row_id")} % 5 <> {CURVE_FOLD} and {sql_seeded_order("'42'", "row_id")} / 4294967296.0 >= 0.2),
{", ".join(_sized_cands_sql(s) for s in CURVE_SIZES)},
members as ({" union all ".join(f"select {s} as size, {s} * 100 + candidate_id as cand, row_id, label from cands_{s}" for s in CURVE_SIZES)}),
{_knn_metrics_sql("v", "members", "val")},
entries as (select m.size, m.cand, round(v.value, 9) as val_auc from (select distinct size, cand from members) m join v using (cand)
            where v.metric = 'AUC' and v.value > 0 qualify row_number() over (partition by m.size order by round(v.value, 9) desc, cand) = 1),
curve as (select * from (select *, max(val_auc) over (order by size rows between unbounded preceding and current row) as m from entries) x where val_auc >= m),
chosen as (select m.* from members m join curve using (cand)),
{_knn_metrics_sql("t", "chosen", "te")}
select cast(curve.size as int) as size, val_auc, n.n_members, metric, value
from curve join t using (cand) join (select cand, count(distinct row_id) as n_members from chosen group by cand) n using (cand)"""


@register("curve_evaluation", CURVE_EVAL_SQL, ["val_auc", "value"])
def q_curve_eval(spark, sf):
    """Candidates of several sizes are scored on the validation rows, the best-so-far curve is stored as a
    curve file and read back, and every point is refitted on its own rows and scored on the test fold."""
    pool = P.fold_assignment(FX.embeddings_pool(spark, sf), 5)
    rest, test = P.split_fold(pool, CURVE_FOLD)
    split = P.train_validation_split(rest)
    key = lambda df: df.withColumns({"dataset": F.lit("embeddings"), "fold": F.lit(CURVE_FOLD)})
    train, val = key(split.filter("split = 'train'").drop("split")), split.filter("split = 'val'").drop("split")
    cands = None
    for size in CURVE_SIZES:
        part = C.random_candidates(train, POP, size, 42).select((F.col("candidate_id") + size * 100).cast("long").alias("candidate_id"), "row_id")
        cands = part if cands is None else cands.unionByName(part)
    cands = cut_lineage(key(cands))
    scored = cut_lineage(key(_score(cands.select("candidate_id", "row_id"), train, val)).withColumn("val_auc", F.round("val_auc", 9)))
    best = C.best_curve(scored, tie="candidate_id")
    chosen = cands.join(best.select("dataset", "fold", "candidate_id"), ["dataset", "fold", "candidate_id"], "left_semi")
    entries = best.join(L.curve_genes(chosen, train), ["dataset", "fold", "candidate_id"]).select(
        "dataset", "fold", "size", "genes", F.size("genes").alias("n_genes"), "val_auc", "fitness", "reduction")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/curves-{uuid.uuid4().hex}"
    write_curves(curve_json(entries), folder)
    points = cut_lineage(L.stored_curve_members(scan_curves(spark, folder), train))
    found = L.evaluate_curve(points.drop("dataset", "fold"), lambda members: E.all_metrics(
        E.knn_predict_grouped(members.join(train, "row_id"), test, 5), by=("candidate_id",)))
    counts = points.groupBy("candidate_id").agg(F.count_distinct("row_id").alias("n_members"))
    return found.join(counts, "candidate_id").select("size", "val_auc", "n_members", "metric", "value")


SEARCH = dict(targets=[40, 20], population=20, patience=2, max_steps=2)


@register("search_run")
def q_search_run(spark, sf):
    """A whole search down the ladder; the curve with the rows of each point counted again, and scored again, from the
    archive.  Patience and steps are shorter than the operator's defaults (70, 500)."""
    train, val = _split_pool(spark, sf)
    run = L.search(train, lambda members: _score(members, train, val), **SEARCH)
    points = cut_lineage(run.curve_members())
    again = _score(points.select("candidate_id", "row_id"), train, val)
    counts = points.groupBy("candidate_id", F.col("size").alias("curve_size"), F.col("val_auc").alias("curve_auc")).agg(
        F.count_distinct("row_id").alias("n_members"))
    return counts.join(again.select("candidate_id", "val_auc", "fitness", "n_cls"), "candidate_id")
