"""Fixtures derived from the given tables (never written back).

Every fixture is a list of ``(sql expression, alias)`` pairs evaluated on one
input table, so that the Spark plan and the DuckDB oracle read the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import read_table

# long result fact derived from lineitem (3 methods in space Emb, 4 in Orig).
RESULT_FACT_EXPRS = [
    ("concat('ds', cast(l_partkey % 20 as varchar(8)))", "dataset"),
    ("cast(l_linenumber % 3 as int)", "fold"),
    ("case when l_suppkey % 7 in (0, 1, 2) then 'Emb' else 'Orig' end", "space"),
    ("case l_suppkey % 7 when 0 then 'KMedoids' when 1 then 'RDSS' when 2 then 'ZCore' "
     "when 3 then 'KMedoids' when 4 then 'RDSS' when 5 then 'ZCore' else 'Random' end", "method"),
    ("cast(case l_orderkey % 6 when 0 then 1 when 1 then 2 when 2 then 4 "
     "when 3 then 8 when 4 then 16 else 32 end * (2 + (l_partkey % 20) % 9) as int)", "n_selected"),
    ("cast(42 + cast(l_quantity as int) % 6 as int)", "seed"),
    ("'KNN'", "evaluator"),
    ("case l_returnflag when 'A' then 'AUC' when 'N' then 'ACC' else 'F1' end", "metric"),
    ("cast((500 + cast(round(l_extendedprice * 100) as bigint) % 500) / 1000.0 as double)", "value"),
]

# Full-pool baseline rows (space Orig, method All, null seed) derived from part.
BASELINE_FACT_EXPRS = [
    ("concat('ds', cast(p_partkey % 20 as varchar(8)))", "dataset"),
    ("cast(p_partkey % 3 as int)", "fold"),
    ("'Orig'", "space"),
    ("'All'", "method"),
    ("cast(100 as int)", "n_selected"),
    ("cast(null as int)", "seed"),
    ("'KNN'", "evaluator"),
    ("case p_size % 3 when 0 then 'AUC' when 1 then 'ACC' else 'F1' end", "metric"),
    ("cast((900 + p_partkey % 100) / 1000.0 as double)", "value"),
]

RESULT_COLUMNS = [a for _, a in RESULT_FACT_EXPRS]
RESULT_KEY = [c for c in RESULT_COLUMNS if c != "value"]


def exprs_sql(exprs) -> str:
    return ",\n       ".join(f"{e} as {a}" for e, a in exprs)


def result_fact_sql() -> str:
    return f"select {exprs_sql(RESULT_FACT_EXPRS)} from lineitem"


def baseline_fact_sql() -> str:
    return f"select {exprs_sql(BASELINE_FACT_EXPRS)} from part"


def all_results_sql() -> str:
    return f"({result_fact_sql()}) union all ({baseline_fact_sql()})"


def _select(df: DataFrame, exprs) -> DataFrame:
    return df.selectExpr(*[f"{e} as {a}" for e, a in exprs])


def result_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read_table(spark, sf_dir, "lineitem"), RESULT_FACT_EXPRS)


def baseline_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read_table(spark, sf_dir, "part"), BASELINE_FACT_EXPRS)


def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_fact(spark, sf_dir).unionByName(baseline_fact(spark, sf_dir))


# Dataset catalog derived from part: one row per dataset d = p_partkey % 20,
# n_classes = 2 + d % 9, n_samples = rows of the group, labels = p_size % n_classes.
CATALOG_SQL = """
select dataset, n_classes, cast(n_samples as bigint) as n_samples, cast(4 as int) as n_features,
       'Supervised Classification' as task_type,
       cast(max_c as double) / cast(min_c as double) as imbalance_ratio
from (
  select dataset, n_classes, sum(cnt) as n_samples, max(cnt) as max_c, min(cnt) as min_c
  from (
    select concat('ds', cast(p_partkey % 20 as varchar(8))) as dataset,
           cast(2 + (p_partkey % 20) % 9 as int) as n_classes,
           p_size % (2 + (p_partkey % 20) % 9) as cls, count(*) as cnt
    from part group by 1, 2, 3
  ) g group by dataset, n_classes
) c
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    d = F.col("p_partkey") % 20
    per_class = (part.select(
        F.concat(F.lit("ds"), d.cast("string")).alias("dataset"),
        (F.lit(2) + d % 9).cast("int").alias("n_classes"),
        (F.col("p_size") % (F.lit(2) + d % 9)).alias("cls"))
        .groupBy("dataset", "n_classes", "cls").count())
    return (per_class.groupBy("dataset", "n_classes")
            .agg(F.sum("count").cast("bigint").alias("n_samples"),
                 F.max("count").alias("max_c"), F.min("count").alias("min_c"))
            .select("dataset", "n_classes", "n_samples", F.lit(4).cast("int").alias("n_features"),
                    F.lit("Supervised Classification").alias("task_type"),
                    (F.col("max_c").cast("double") / F.col("min_c").cast("double")).alias("imbalance_ratio")))


# Runs per method for the seed window (G9): every stochastic method of F1 ran 5 seeds.
EXEMPT = ("All",)
EXEMPT_SQL = "(" + ", ".join(f"'{m}'" for m in EXEMPT) + ")"
RUNS_PER_METHOD = {"KMedoids": 5, "RDSS": 5, "ZCore": 5, "Random": 5}

# Display labels (H1): (space, method) -> label.  Emb-KM is the target method.
METHOD_LABELS = [
    ("Emb", "KMedoids", "Emb-KM"),
    ("Orig", "KMedoids", "Orig-KM"),
    ("Orig", "Random", "Random"),
    ("Orig", "RDSS", "RDSS-Orig"),
    ("Orig", "ZCore", "ZCore-Orig"),
    ("Emb", "RDSS", "RDSS-Emb"),
    ("Emb", "ZCore", "ZCore-Emb"),
]
TARGET_LABEL, ORIG_LABEL, RANDOM_LABEL = "Emb-KM", "Orig-KM", "Random"


def labels_sql() -> str:
    rows = ", ".join(f"('{s}', '{m}', '{l}', {i})" for i, (s, m, l) in enumerate(METHOD_LABELS))
    return f"(values {rows}) as lab(space, method, label, label_order)"


def labels_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, m, l, i) for i, (s, m, l) in enumerate(METHOD_LABELS)],
                                 "space string, method string, label string, label_order int")


# pools (row_id, features array<float>, label int).
def embeddings_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"), F.col("label").cast("int"))


LINEITEM_ROW_ID = ("cast(conv(substr(md5(concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), "
                   "cast(l_partkey as string), cast(l_suppkey as string), "
                   "cast(cast(round(l_extendedprice * 100) as bigint) as string))), 1, 15), 16, 10) as bigint)")
LINEITEM_ROW_ID_SQL = ("('0x' || substr(md5(concat_ws('|', cast(l_orderkey as varchar), cast(l_linenumber as varchar), "
                       "cast(l_partkey as varchar), cast(l_suppkey as varchar), "
                       "cast(cast(round(l_extendedprice * 100) as bigint) as varchar))), 1, 15))::BIGINT")


def lineitem_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric lineitem pool: quantity, extendedprice, discount, tax; label = returnflag code (A=0, N=1, R=2)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.expr(LINEITEM_ROW_ID).alias("row_id"),
        F.array(*[F.col(c).cast("float") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]).alias("features"),
        F.expr("case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end").cast("int").alias("label"))


def lineitem_pool_sql() -> str:
    return (f"select {LINEITEM_ROW_ID_SQL} as row_id, "
            "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as label from lineitem")
