"""End-to-end aggregation and analysis over the derived result fact.

scan (F1 + F1b) -> run mean -> seed window -> seed mean -> budget filter -> fold mean
(long cells) -> labels -> statistics.  Catalog and config tables are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import results as G
from tessera.operators import stats as H
from tessera.plans import fixtures as FX

EVALUATOR = "KNN"


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.all_results(spark, sf_dir)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.catalog(spark, sf_dir)


def fold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.run_and_seed_means(fact(spark, sf_dir), FX.RUNS_PER_METHOD, exempt=FX.EXEMPT)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fold_means(fold_table(spark, sf_dir), catalog(spark, sf_dir))


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.baseline(fold_table(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str, metric: str = "AUC") -> DataFrame:
    return H.label_scores(cells(spark, sf_dir), FX.labels_df(spark), metric, EVALUATOR)


def label_names() -> list[str]:
    return [lab for _, _, lab in FX.METHOD_LABELS]
