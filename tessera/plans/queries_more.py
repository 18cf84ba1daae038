"""More registered queries: result-table housekeeping (G1, G3, G4, G11-G13, G15, G26), P6, R1, R3, E3."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import seeded_order, sql_seeded_order
from tessera.operators import prep as P
from tessera.operators import results as G
from tessera.operators import score as E
from tessera.operators.boosting import boosted_trees
from tessera.operators import select as S
from tessera.operators import space as R
from tessera.plans import analysis as A
from tessera.plans import fixtures as FX
from tessera.plans import oracle as O
from tessera.plans.queries import register
from tessera.session import cut_lineage
from tessera.sources.tables import read_table


@register("metric_rows", O.with_base() + "select dataset, fold, space, method, evaluator, n_selected, metric, value from foldt",
          ["value"])
def q_metric_rows(spark, sf):
    side = G.metrics_side_by_side(A.fold_table(spark, sf))
    m = side.select("dataset", "fold", "space", "method", "evaluator", "n_selected",
                    F.create_map(*[x for k in G.METRICS for x in (F.lit(k), F.col(k))]).alias("metrics"))
    return G.metric_rows(m).filter(F.col("value").isNotNull())


@register("runs_to_do", O.with_base() + """
select * from (select distinct dataset, fold, space, method, n_selected, cast(s.seed as int) as seed, evaluator, m.metric
  from fact, range(42, 47) s(seed), (values ('AUC'), ('ACC'), ('F1')) m(metric) where method <> 'All') e
where not exists (select 1 from fact f where f.dataset = e.dataset and f.fold = e.fold and f.space = e.space
  and f.method = e.method and f.n_selected = e.n_selected and f.seed is not distinct from e.seed
  and f.evaluator = e.evaluator and f.metric = e.metric)""")
def q_runs_to_do(spark, sf):
    fact = A.fact(spark, sf)
    expected = (fact.filter("method <> 'All'").select("dataset", "fold", "space", "method", "n_selected", "evaluator")
                .distinct()
                .withColumn("seed", F.explode(F.sequence(F.lit(42), F.lit(46))))
                .withColumn("metric", F.explode(F.array(*[F.lit(m) for m in G.METRICS]))))
    return G.runs_to_do(expected.select(*G.KEY), fact)


_SEQ_SQL = sql_seeded_order("'seq'", "cast(round(value * 1e6) as bigint)")


@register("dedupe_batch", O.with_base() + """
select dataset, fold, space, method, n_selected, seed, evaluator, metric, value from (
  select *, row_number() over (partition by dataset, fold, space, method, n_selected, seed, evaluator, metric
                               order by """ + _SEQ_SQL + """ desc) as rn from fact) x where rn = 1""", ["value"])
def q_dedupe(spark, sf):
    # the last row of the batch by a sequence that has nothing to do with the value's size
    seq = seeded_order("seq", F.round(F.col("value") * 1e6).cast("bigint"))
    return G.dedupe_batch(A.fact(spark, sf).withColumn("seq", seq), "seq").drop("seq")


@register("missing_datasets", O.with_base() + """
select dataset from (select dataset from catalog union all select 'ds_extra') c
where dataset not in (select dataset from fact)""")
def q_missing_ds(spark, sf):
    cat = A.catalog(spark, sf).select("dataset").unionByName(spark.range(1).select(F.lit("ds_extra").alias("dataset")))
    return G.missing_datasets(cat, A.fact(spark, sf))


@register("filter_by_catalog", O.with_base() + """
select dataset, count(*) as n_rows from fact where dataset in (select dataset from catalog where n_classes <= 6)
group by dataset""")
def q_filter_catalog(spark, sf):
    cat = P.filter_datasets(A.catalog(spark, sf), max_classes=6)
    return G.filter_by_catalog(A.fact(spark, sf), cat).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))


@register("suite_covering", O.with_base() + """,
suites as (select 'all' as suite, dataset from catalog union all
           select 'small', dataset from catalog where n_classes <= 5)
select suite, count(distinct dataset) as suite_size from suites group by suite
having count(distinct case when dataset in (select dataset from fact) then dataset end)
       = (select count(distinct dataset) from fact)""".replace("\n,\nsuites", ",\nsuites"))
def q_suite(spark, sf):
    cat = A.catalog(spark, sf)
    suites = cat.select(F.lit("all").alias("suite"), "dataset").unionByName(
        cat.filter("n_classes <= 5").select(F.lit("small").alias("suite"), "dataset"))
    return G.suite_covering(A.fact(spark, sf), suites)


@register("slice_results", O.with_base() + """
select distinct * from (
  select * from fact where method <> 'All' and (space, method, evaluator) in
      (select * from (values ('Emb', 'KMedoids', 'KNN'), ('Orig', 'Random', 'KNN')) t(space, method, evaluator))
    and metric = 'AUC' and fold in (0, 1)
  union all select * from fact where method = 'All' and metric = 'AUC' and fold in (0, 1)) x""", ["value"])
def q_slice(spark, sf):
    return G.slice_results(A.fact(spark, sf), [("Emb", "KMedoids", "KNN"), ("Orig", "Random", "KNN")],
                           [("KNN", "AUC")], [0, 1])


@register("display_order", O.with_base() + """,
nm as (select * from (values ('Orig', 'Random', 'Random (unsupervised)', 0), ('Orig', 'KMedoids', 'K-Medoids', 3),
        ('Emb', 'KMedoids', 'K-Medoids (emb)', 3)) v(space, method, display_name, method_order))
select space, method, coalesce(display_name, concat_ws('/', space, method)) as display_name, method_order, n
from (select space, method, count(*) as n from cells group by all) c left join nm using (space, method)""".replace(
    "\n,\nnm", ",\nnm"))
def q_display(spark, sf):
    names = spark.createDataFrame([("Orig", "Random", "Random (unsupervised)", 0), ("Orig", "KMedoids", "K-Medoids", 3),
                                   ("Emb", "KMedoids", "K-Medoids (emb)", 3)],
                                  "space string, method string, display_name string, method_order int")
    c = A.cells(spark, sf).groupBy("space", "method").agg(F.count(F.lit(1)).alias("n"))
    return G.display_order(c, names).select("space", "method", "display_name", "method_order", "n")


@register("dataset_filter", O.with_base() + """
select * from catalog where task_type = 'Supervised Classification' and n_samples >= 80 and n_samples < 120
  and n_classes <= 8""", ["imbalance_ratio"])
def q_dataset_filter(spark, sf):
    return P.filter_datasets(A.catalog(spark, sf), "Supervised Classification", 80, 120, None, 8)


@register("original_space", f"""select {FX.LINEITEM_ROW_ID_SQL} as row_id,
  [cast(l_quantity as float), cast(l_extendedprice as float), cast(l_discount as float), cast(l_tax as float)] as features
from lineitem""")
def q_original_space(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumn("row_id", F.expr(FX.LINEITEM_ROW_ID))
    return R.original_space(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("row_id", "features")


@register("pca_embeddings")
def q_pca(spark, sf):
    return R.pca_2d(FX.embeddings_pool(spark, sf)).select("row_id", "label", "pca")


@register("gbt_predictions")
def q_gbt(spark, sf):
    """100 rounds of softmax boosting on a balanced selection, every other row scored."""
    pool = FX.lineitem_pool(spark, sf).withColumn("run", F.lit(0))
    sel = F.broadcast(cut_lineage(S.balanced_selection(pool, 30, 42).select("row_id")))  # 30 rows, selected once
    ctx = pool.join(sel, "row_id", "left_semi")
    return E.score_runs(ctx, pool.join(sel, "row_id", "left_anti"), ["run"], boosted_trees()).drop("run")


@register("one_hot", f"""
with p as (select p_partkey, p_brand, cast({"('0x' || substr(md5(concat('0', '|', p_partkey)), 1, 8))::BIGINT"} % 5 as int) as fold from part),
lv as (select v, cast(row_number() over (order by v) - 2 as int) as index from (select distinct p_brand as v from p where fold <> 0) x)
select p_partkey, p_brand, index, case when index is not null then cast(1.0 as double) end as indicator
from (select * from p where fold = 0) t left join (select * from lv where index >= 0) l on p_brand = v""")
def q_one_hot(spark, sf):
    p = P.fold_assignment(read_table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_brand"), 5)
    train, test = P.split_fold(p, 0)
    enc = P.one_hot(test.withColumn("hot", F.col("p_brand")), P.one_hot_levels(train.select(F.col("p_brand").alias("hot")), ["hot"]), ["hot"])
    return enc.select(F.col("row_id").alias("p_partkey"), "p_brand", F.explode_outer("hot").alias("e")).select(
        "p_partkey", "p_brand", F.col("e.index").alias("index"), F.col("e.value").alias("indicator"))


@register("embedding_space", """
select e.vec_id as row_id, cast(len(e.embedding) as bigint) as dims from embeddings e""")
def q_embedding_space(spark, sf):
    pool = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"))
    emb = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    return R.embedding_space(pool, emb).select("row_id", F.size("features").cast("bigint").alias("dims"))


@register("embedding_coverage", """
select c_custkey as row_id from customer where c_custkey not in (select vec_id from embeddings)""")
def q_embedding_coverage(spark, sf):
    pool = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"))
    emb = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"))
    return R.embedding_coverage(pool, emb)


@register("znorm_embeddings", """
with e as (select vec_id as row_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
s as (select i, avg(x) as mu, stddev_pop(x) as sd from e group by i)
select row_id, cast(i as int) as dim, cast(cast((x - mu) / sd as float) as double) as value from e join s using (i) where sd > 0""", ["value"])
def q_znorm(spark, sf):
    z = P.preprocess_vectors(FX.embeddings_pool(spark, sf), znorm=True, drop_constant=True)
    return z.select("row_id", F.posexplode("features").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@register("align_probs", f"""
with p as (select doc_id as row_id, quality as y_true, (({"('0x' || substr(md5(concat('p', '|', doc_id)), 1, 8))::BIGINT"} % 100) / 100.0) as s from labels)
select row_id, y_true, c.class, case when c.class = 1 then s when c.class = 0 then 1 - s else 0.0 end as prob
from p, (values (0), (1), (2)) c(class)""", ["prob"])
def q_align(spark, sf):
    from tessera.plans.queries_select import _f3
    classes = spark.createDataFrame([(0,), (1,), (2,)], "class int")
    return E.align_probs(_f3(spark, sf), classes)


@register("evaluator_slice", O.with_base() + "select * from cells where evaluator = 'KNN'", ["value"])
def q_eval_slice(spark, sf):
    return G.evaluator_slices(A.cells(spark, sf), "KNN")


COMBINATIONS = [(sp, m, "KNN") for sp, m, _ in FX.METHOD_LABELS] + [("Emb", "NeverRun", "KNN")]


@register("combination_coverage", O.with_base() + f""",
want as (select dataset, space, method, evaluator from (select dataset from catalog union all select 'ds_extra') d,
         (values {", ".join(str(c) for c in COMBINATIONS)}) k(space, method, evaluator))
select space, method, evaluator, list_sort(list(dataset)) as datasets
from (select * from want anti join (select distinct dataset, space, method, evaluator from cells) h using (dataset, space, method, evaluator)) g
group by all""".replace("\n,\nwant", ",\nwant"))
def q_combo_cov(spark, sf):
    cat = A.catalog(spark, sf).select("dataset")
    extra = cat.unionByName(spark.range(1).select(F.lit("ds_extra").alias("dataset")))
    return G.combination_coverage(A.cells(spark, sf), extra, COMBINATIONS)


@register("runs_with_curve", O.with_base() + """
select distinct dataset, fold from foldt where method = 'KMedoids' and space = 'Emb' and metric = 'AUC'
  and n_selected > 0 and value > 0""")
def q_runs_curve(spark, sf):
    from tessera.operators import search as C
    ft = A.fold_table(spark, sf).filter("method = 'KMedoids' and space = 'Emb' and metric = 'AUC'")
    curve = C.best_curve(ft.select("dataset", "fold", F.col("n_selected").alias("size"), F.col("value").alias("val_auc")))
    return S.runs_with_curve(curve)
