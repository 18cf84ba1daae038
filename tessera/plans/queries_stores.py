"""Registered queries for files, stores, sinks and scorers that read through them."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.hashing import sql_seeded_order
from tessera.operators import prep as P
from tessera.operators import results as G
from tessera.operators import score as E
from tessera.operators import select as S
from tessera.operators import space as R
from tessera.plans import analysis as A
from tessera.plans import fixtures as FX
from tessera.plans import oracle as O
from tessera.plans.queries import WIDE_COLS, _wide_sql, register
from tessera.plans.queries_search import _knn_metrics_sql
from tessera.session import cut_lineage, ensure_checkpoint_dir
from tessera.sources import results_io as IO
from tessera.sources.tables import read_table
from tessera.streaming.result_sink import read_results, result_stream, start_result_sink


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ============================================================ files
@register("result_files", f"""select dataset, case when fold = 2 then 2 else fold end as fold, space, method, n_selected,
  case when fold = 2 then null else seed end as seed, evaluator, case when fold = 2 then 'AUC' else metric end as metric,
  case when fold = 0 and seed = 47 then null else value end as value from ({FX.all_results_sql()}) where fold <> 2 or metric = 'AUC'""", ["value"])
def q_result_files(spark, sf):
    """Result files of three layouts, written to the shared folder, read in one scan: the present layout (fold 0, with
    values that are no numbers), stored names in another order and no fold column (fold 1), the old layout (fold 2)."""
    folder, fact = _folder(spark, "results"), A.fact(spark, sf)
    text = fact.select(*[F.col(c).cast("string").alias(c) for c in IO.REQUIRED])
    new = text.where("fold = '0'").withColumn("value", F.when(F.col("seed") == "47", "not a number").otherwise(F.col("value")))
    back = {v: k for k, v in IO.LONG_NAMES.items()}
    named = text.where("fold = '1'").withColumnsRenamed(back).select("value", "metric", back["seed"], back["n_selected"], "dataset", back["method"], back["space"], "evaluator")
    old = text.where("fold = '2' and metric = 'AUC'").withColumnsRenamed(back | {"evaluator": "evaluation_method", "value": "AUC"}).select(
        "dataset", back["space"], back["method"], back["n_selected"], "evaluation_method", "AUC")
    names = {}
    for k, part in enumerate((new, named, old)):
        part.write.option("header", True).csv(f"{folder}/raw{k}")
        names[k] = f"{folder}/named{k}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in names:  # the fold is in the file's name
        fs.mkdirs(hadoop(names[k]))
        for i, st in enumerate(f for f in fs.listStatus(hadoop(f"{folder}/raw{k}")) if f.getPath().getName().startswith("part-")):
            fs.rename(st.getPath(), hadoop(f"{names[k]}/run{i}_f{k}.csv"))
    return IO.scan_result_files(spark, f"{folder}/named*/*.csv", folds=[0, 1, 2]).drop("source_file")


@register("catalog_files", O.with_base() + "select dataset, n_classes, n_samples, imbalance_ratio, f.format from catalog, (values ('parquet'), ('csv')) f(format)",
          ["imbalance_ratio"])
def q_catalog_files(spark, sf):
    """The catalog written as Parquet and as CSV, and read by the catalog reader."""
    out, folder = None, _folder(spark, "catalog")
    for fmt in ("parquet", "csv"):
        A.catalog(spark, sf).write.format(fmt).option("header", True).save(f"{folder}/{fmt}")
        part = IO.read_catalog(spark, f"{folder}/{fmt}", fmt).select("dataset", F.col("n_classes").cast("int"), F.col("n_samples").cast("long"),
                                                                       "imbalance_ratio", F.lit(fmt).alias("format"))
        out = part if out is None else out.unionByName(part)
    return out


@register("wide_files", _wide_sql(), ["imbalance_ratio"] + [f'"{c}"' for c in WIDE_COLS])
def q_wide_files(spark, sf):
    """The wide table through its CSV sink and reader."""
    wide, folder = G.to_wide(A.cells(spark, sf), A.catalog(spark, sf), A.baselines(spark, sf), WIDE_COLS), _folder(spark, "wide")
    IO.write_wide(wide, folder)
    read = IO.read_wide(spark, folder)
    return read.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in wide.dtypes])


# ============================================================ sink
SINK_SQL = O.with_base() + """
select dataset, fold, space, method, n_selected, seed, evaluator, metric,
       case when coalesce(seed, 0) % 3 = 0 then value when coalesce(seed, 0) % 3 = 1 then value + 1 else value + 2 end as value from run"""


@register("result_sink", SINK_SQL, ["value"])
def q_result_sink(spark, sf):
    """A stream of result rows with recompute.  One checkpoint takes two rounds of files and is restarted without new
    ones; a second checkpoint, whose batches count from 0 again, takes the last round, which wins."""
    run = cut_lineage(G.run_means(A.fact(spark, sf)).select(*IO.REQUIRED))
    third, folder = F.coalesce(F.col("seed"), F.lit(0)) % 3, _folder(spark, "sink")

    def drop(into, rows, more):
        rows.withColumn("value", F.col("value") + more).coalesce(1).write.mode("append").parquet(f"{folder}/{into}")

    def stream(source, checkpoint):
        start_result_sink(result_stream(spark, f"{folder}/{source}"), f"{folder}/out", f"{folder}/{checkpoint}", recompute=True).awaitTermination()

    drop("first", run, 2)
    stream("first", "one")
    drop("first", run.where(third < 2), 1)
    stream("first", "one")
    stream("first", "one")
    drop("second", run.where(third == 0), 0)
    stream("second", "two")
    return read_results(spark, f"{folder}/out")


# ============================================================ stores (S7, S8, S9, S11), scorers per run
SEEDS, BUDGETS = [42, 43], [1, 10, 20]
EMB = "emb as (select vec_id as row_id, embedding as features, cast(label as int) as label from embeddings)"
HASH0 = sql_seeded_order("'0'", "row_id")
PICKS_SQL = f"""{EMB}, tr as (select * from emb where {HASH0} % 5 <> 0), te as (select * from emb where {HASH0} % 5 = 0),
picks as (select s.seed, n.n_selected, t.row_id, t.label from (select *, row_number() over (partition by seed order by {sql_seeded_order("seed", "row_id")}, row_id) as pos
  from tr, (values {", ".join(f"({s})" for s in SEEDS)}) s(seed)) t join (values {", ".join(f"({n})" for n in BUDGETS)}) n(n_selected) on pos <= n_selected
  join (values {", ".join(f"({s})" for s in SEEDS)}) s(seed) on s.seed = t.seed)"""
KEY = ["dataset", "fold", "space", "method", "n_selected", "seed"]


def _runs(df, **more):
    fixed = {"dataset": "embeddings", "fold": 0, "space": "Emb", "method": "Random"} | more
    return df.withColumns({k: F.lit(v) for k, v in fixed.items()})


def _folds(spark, sf):
    return tuple(df.drop("fold") for df in P.split_fold(P.fold_assignment(FX.embeddings_pool(spark, sf), 5), 0))


@register("selection_store", f"with {PICKS_SQL} select seed, n_selected, row_id, (select count(*) from tr) as pool_size from picks")
def q_selection_store(spark, sf):
    """Selections through the store: first for a pool that has lost rows, then for the whole one, whose runs replace the
    stale ones, then read back without computing."""
    train, _ = _folds(spark, sf)
    path, size = _folder(spark, "selections"), train.count()

    def through(pool, n):
        wanted = _runs(spark.createDataFrame([(s, k) for s in SEEDS for k in BUDGETS], "seed int, n_selected int"))
        make = lambda todo: _runs(S.random_selection(pool, BUDGETS, SEEDS)).withColumn("pool_size", F.lit(n).cast("long"))
        return IO.SelectionStore(spark, path, n).get_or_compute(wanted, make)
    through(train.where("row_id % 3 > 0"), size - 1)
    through(train, size)
    return through(None, size).select("seed", "n_selected", "row_id", "pool_size")


PRED_SQL = f"""with {PICKS_SQL}, train as (select * from emb), members as (select seed * 1000 + n_selected as cand, row_id, label from picks),
{_knn_metrics_sql("t", "members", "te")}
select cast(cand // 1000 as int) as seed, cast(cand % 1000 as int) as n_selected, metric, value from t"""


@register("prediction_store", PRED_SQL, ["value"])
def q_prediction_store(spark, sf):
    """K-NN as a user scorer over six runs, the smallest with one row and so one class, through the prediction
    store: two budgets first, then all, of which only the third is scored, then all again; metrics of the stored rows."""
    train, test = _folds(spark, sf)
    store = IO.prediction_store(spark, _folder(spark, "predictions"))
    picks = cut_lineage(S.random_selection(train, BUDGETS, SEEDS).drop("pos"))
    contexts = cut_lineage(_runs(picks.join(train, "row_id"), evaluator="KNN").select(*store.run_key, "row_id", "features", "label"))
    grid = test.withColumns({"seed": F.explode(F.array(*[F.lit(s) for s in SEEDS]))})
    grid = grid.withColumn("n_selected", F.explode(F.array(*[F.lit(n) for n in BUDGETS])))
    tests = _runs(grid, evaluator="KNN").select(*store.run_key, "row_id", "features", "label")  # every run scores the one test fold
    E.predict_through(store, contexts.where("n_selected < 20"), tests.where("n_selected < 20"), E.knn_votes(5))
    for _ in range(2):
        found = E.predict_through(store, contexts, tests, E.knn_votes(5))
    return E.all_metrics(cut_lineage(found.select("n_selected", "seed", "row_id", "y_true", "class", "prob")), by=("seed", "n_selected"))


ENC_DIMS = 4


def _toy_encoder():
    """Random-feature-like map of (size, price): cosines of fixed combinations."""
    k = np.arange(ENC_DIMS)
    return lambda pdf: np.cos(pdf["p_size"].to_numpy()[:, None] * (k + 1) / 10.0 + pdf["p_retailprice"].to_numpy()[:, None] / 1000.0 * k)


@register("embedding_store", f"""select p_partkey as row_id, case when {sql_seeded_order("'0'", "p_partkey")} % 5 = 0 then 'test' else 'train' end as split,
  d.dim, cast(cos(p_size * (d.dim + 1) / 10.0 + p_retailprice / 1000.0 * d.dim) as float)::double as value from part, (select unnest(range(0, {ENC_DIMS}))::int as dim) d""", ["value"])
def q_embedding_store(spark, sf):
    """A user encoder over the part table, split by split through the embedding store; the pool then takes its
    features from the stored rows, and a second call encodes nothing."""
    pool = P.fold_assignment(read_table(spark, sf, "part").withColumnRenamed("p_partkey", "row_id"), 5).select(
        F.lit("part").alias("dataset"), F.lit(0).alias("fold"), F.when(F.col("fold") == 0, "test").otherwise("train").alias("split"), "row_id", "p_size", "p_retailprice")
    store, inputs = IO.embedding_store(spark, _folder(spark, "embeddings")), ["p_size", "p_retailprice"]
    R.encode_through(store, pool.where("split = 'train'"), _toy_encoder, inputs, "cosines-1")
    R.encode_through(store, pool, _toy_encoder, inputs, "cosines-1")
    stored = R.encode_through(store, pool, None, inputs, "cosines-1")
    encoded = R.embedding_space(pool.select("row_id", "split"), stored)
    return encoded.select("row_id", "split", F.posexplode("features").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


SCORE_SQL = f"""with {EMB}, m as (select i, avg(x) as mu from (select unnest(features)::double as x, generate_subscripts(features, 1) as i from emb) group by i)
select e.row_id, e.space, sqrt(sum(case when e.space = 'Emb' then power(x - mu, 2) else power(x, 2) end)) as score
from (select row_id, unnest(features)::double as x, generate_subscripts(features, 1) as i, s.space from emb, (values ('Emb'), ('Orig')) s(space)) e join m using (i)
group by e.row_id, e.space"""


@register("score_store", SCORE_SQL, ["score"])
def q_score_store(spark, sf):
    """Row scores of two spaces (distance from the mean, and from the origin) through the score store: one space first,
    then both, of which only the other is computed."""
    pool = FX.embeddings_pool(spark, sf).select("row_id", F.posexplode("features").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    mean = pool.groupBy("i").agg(F.avg("x").alias("mu"))
    store, n = IO.score_store(spark, _folder(spark, "scores")), FX.embeddings_pool(spark, sf).count()
    wanted = spark.createDataFrame([("embeddings", 0, s, n) for s in ("Emb", "Orig")], "dataset string, fold int, space string, n_rows long")

    def compute(todo):
        x = F.when(F.col("space") == "Emb", F.col("x") - F.col("mu")).otherwise(F.col("x"))
        spaces = [r.space for r in todo.collect()]
        return pool.join(mean, "i").withColumn("space", F.explode(F.array(*[F.lit(s) for s in spaces]))).groupBy("row_id", "space").agg(
            F.sqrt(F.sum(x * x)).alias("score")).withColumns({"dataset": F.lit("embeddings"), "fold": F.lit(0)})
    store.get_or_compute(wanted.where("space = 'Emb'"), compute)
    store.get_or_compute(wanted, compute)
    return store.get_or_compute(wanted, None).select("row_id", "space", "score")


# ============================================================ grids and splits without a query so far
@register("search_sizes", O.with_base() + """, t as (select dataset, n_classes as c, cast(ceil(n_samples * 4 / 5.0) as bigint) as n from catalog),
s as (select *, least(40, cast(floor(0.25 * n) as bigint)) as start from t),
w as (select dataset, c, n, start, unnest([start, 40, 20, 10, c, 2 * c, 4 * c, 8 * c, 16 * c, 32 * c, 64 * c]) as size from s),
q as (select dataset, c, n, least(cast(ceil(0.25 * n) as bigint), 250) as top from t)
select distinct dataset, 'search' as grid, cast(size as bigint) as size from w where size between c and start
union all select dataset, 'comparison', cast(c * power(2, i) as bigint) from q, range(0, 20) r(i) where c * power(2, i) <= top""".replace("\n, t as", ", t as"))
def q_search_sizes(spark, sf):
    """Size grids of every dataset of the catalog (40, 20 and 10 configured, five folds)."""
    rows = []
    for r in A.catalog(spark, sf).collect():  # the catalog, a config table
        n = P.train_size(r.n_samples, 5)
        rows += [(r.dataset, "search", int(k)) for k in P.search_sizes([40, 20, 10], n, r.n_classes)]
        rows += [(r.dataset, "comparison", int(k)) for k in P.comparison_sizes(n, r.n_classes)]
    return spark.createDataFrame(rows, "dataset string, grid string, size long")


@register("transductive_znorm", f"""with e as (select vec_id as row_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i,
  case when {sql_seeded_order("'0'", "vec_id")} % 5 = 0 then 'test' else 'train' end as part from embeddings),
s as (select i, avg(x) as mu, stddev_pop(x) as sd from e group by i)
select row_id, part, cast(i as int) as dim, cast(cast((x - mu) / sd as float) as double) as value from e join s using (i) where sd > 0""", ["value"])
def q_transductive(spark, sf):
    """Train and test rows are normalised together and split again."""
    train, test = _folds(spark, sf)
    parts = P.transductive(train, test, lambda both: P.preprocess_vectors(both, znorm=True, drop_constant=True))
    both = parts[0].withColumn("part", F.lit("train")).unionByName(parts[1].withColumn("part", F.lit("test")))
    return both.select("row_id", "part", F.posexplode("features").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@register("run_matrix", O.with_base() + """, todo as (select k.dataset, sp.space, m.method, b.b * k.n_classes as n_selected, 42 + i.i as seed, f.fold
  from catalog k, (values ('Emb'), ('Orig')) sp(space), (values ('KMedoids', 2), ('Random', 3)) m(method, runs), (values (1), (2)) b(b), (values (0), (1)) f(fold),
  range(0, 3) i(i) where i.i < m.runs)
select cast(n_selected as int) as n_selected, space, method, cast(seed as int) as seed, fold, count(*) as n_datasets from todo group by all""".replace("\n, todo", ", todo"))
def q_run_matrix(spark, sf):
    """The task table of every dataset's own budgets, counted over the catalog."""
    out = None
    for r in A.catalog(spark, sf).select("dataset", "n_classes").collect():  # the catalog, a config table
        part = S.run_matrix(spark, ["Emb", "Orig"], ["KMedoids", "Random"], [r.n_classes, 2 * r.n_classes], {"KMedoids": 2, "Random": 3}, folds=(0, 1)).withColumn(
            "dataset", F.lit(r.dataset))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("n_selected", "space", "method", "seed", "fold").agg(F.count(F.lit(1)).alias("n_datasets"))
