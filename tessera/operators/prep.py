"""Profiling and preparation (P1-P18) on a pool DataFrame.

A pool has an explicit ``row_id`` (long), feature columns and an optional
``label`` column.  Position is never identity.  Every random split uses the
seeded hash order of ``row_id``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import seeded_order
from tessera.functions.ranks import dense_codes

# The words (lower case) that a binary column may hold.
BINARY_WORDS = ("yes", "no", "true", "false", "t", "f", "1", "0")


def imbalance_ratio(pool: DataFrame, label: str = "label", by=()) -> DataFrame:
    """Max class count / min class count (per ``by`` group)."""
    counts = pool.groupBy(*by, label).count()
    return counts.groupBy(*by).agg((F.max("count") / F.min("count")).alias("imbalance_ratio"))


def missing_ratio(pool: DataFrame, features) -> DataFrame:
    """Mean over feature columns of the per-column NULL/NaN rate (one pass)."""
    floats = {f.name for f in pool.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    rates = [F.avg(_missing(c, c in floats).cast("double")) for c in features]
    return pool.agg((sum(rates, F.lit(0.0)) / len(features)).alias("missing_ratio"))


def _missing(c: str, is_float: bool) -> Column:
    """NULL, or NaN for floating columns (pandas reads both as missing)."""
    col = F.col(c)
    return (col.isNull() | F.isnan(col)) if is_float else col.isNull()


def constant_columns(pool: DataFrame, features, nulls_count: bool = False) -> DataFrame:
    """Columns with at most one distinct non-null value.

    ``nulls_count=True`` is the selection check: NULL counts as a value, so a
    column holding one value plus NULLs is not constant.
    """
    aggs = []
    for c in features:
        same = F.min(c).eqNullSafe(F.max(c))
        if nulls_count:
            has_null, all_null = F.max(F.col(c).isNull().cast("int")) == 1, F.count(c) == 0
            same = all_null | (same & ~has_null)
        aggs.append(same.alias(c))
    row = pool.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in features)
    return row.selectExpr(f"stack({len(features)}, {stack}) as (column_name, is_constant)")


def column_types(pool: DataFrame, features, categorical=()) -> DataFrame:
    """Num / cat / bin per column.  Numeric columns are num unless named in ``categorical``; the others are
    cat, or bin if they have at most 2 distinct values and every lowercased value is in the binary word list.

    Distinct values are collected only among the listed words (a handful), so no column's values are gathered."""
    numeric = {f.name for f in pool.schema.fields if isinstance(f.dataType, T.NumericType)} - set(categorical)
    aggs = []
    for c in features:
        word = F.lower(F.col(c).cast("string")).isin(*BINARY_WORDS)
        values = F.size(F.collect_set(F.when(word, F.col(c).cast("string"))))
        is_bin = (values <= 2) & F.coalesce(F.bool_and(word), F.lit(True))
        kind = F.lit("num") if c in numeric else F.when(is_bin, F.lit("bin")).otherwise(F.lit("cat"))
        aggs.append((F.first(kind) if c in numeric else kind).alias(c))
    row = pool.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in features)
    return row.selectExpr(f"stack({len(features)}, {stack}) as (column_name, column_type)")


def encode_labels(pool: DataFrame, label: str = "label", out: str = "label") -> DataFrame:
    """P5: labels in sorted order -> 0..C-1 (codes of the distinct labels, joined back)."""
    codes = dense_codes(pool.select(F.col(label).alias("_raw")), "_raw", out="_code").withColumn("_code", F.col("_code").cast("int"))
    j = pool.join(codes, pool[label].eqNullSafe(codes["_raw"]), "left")
    return j.drop(label).withColumnRenamed("_code", out).drop("_raw")


def filter_datasets(catalog: DataFrame, task_type: str | None = None, min_samples: int | None = None,
                    max_samples: int | None = None, max_features: int | None = None,
                    max_classes: int | None = None) -> DataFrame:
    """Catalog filter (n_samples >= min, n_samples < max strictly) ordered by size."""
    df = catalog
    if task_type is not None:
        df = df.filter(F.col("task_type") == task_type)
    if min_samples is not None:
        df = df.filter(F.col("n_samples") >= min_samples)
    if max_samples is not None:
        df = df.filter(F.col("n_samples") < max_samples)
    if max_features is not None:
        df = df.filter(F.col("n_features") <= max_features)
    if max_classes is not None:
        df = df.filter(F.col("n_classes") <= max_classes)
    return df.orderBy("n_samples", "dataset")


def fold_assignment(pool: DataFrame, n_folds: int, seed: int = 0, key: str = "row_id") -> DataFrame:
    """fold = seeded hash mod n_folds (where no stored split exists)."""
    return pool.withColumn("fold", (seeded_order(seed, F.col(key)) % n_folds).cast("int"))


def split_fold(pool_with_fold: DataFrame, fold: int):
    """(train, test) of one fold; the split table is a column, so this is two filters."""
    return (pool_with_fold.filter(F.col("fold") != fold), pool_with_fold.filter(F.col("fold") == fold))


def subsample(pool: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """Seeded subsample of n rows (TakeOrdered on the hash; no full sort)."""
    return pool.orderBy(seeded_order(seed, F.col(key)), F.col(key)).limit(n)


def fit_ordinal(train: DataFrame, columns) -> DataFrame:
    """P9 fit: (column_name, category, code) with sorted categories -> 0.. (NULL is not a category)."""
    parts = [train.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category"))
             .filter(F.col("category").isNotNull()).distinct() for c in columns]
    cats = parts[0]
    for p in parts[1:]:
        cats = cats.unionByName(p)
    return dense_codes(cats, "category", ["column_name"]).withColumn("code", F.col("code").cast("double"))


def apply_ordinal(df: DataFrame, codes: DataFrame, columns) -> DataFrame:
    """P9 apply: categories -> codes; unseen -> -1; NULL stays NULL.  One broadcast join per column
    (code tables are bounded by the categories seen in train; checked before broadcast)."""
    out = df
    for c in columns:
        m = codes.filter(F.col("column_name") == c).select(F.col("category").alias(f"_cat_{c}"),
                                                           F.col("code").alias(f"_code_{c}"))
        out = out.join(m, out[c].cast("string") == F.col(f"_cat_{c}"), "left")
        out = out.withColumn(c, F.when(F.col(c).isNull(), F.lit(None).cast("double"))
                             .otherwise(F.coalesce(F.col(f"_code_{c}"), F.lit(-1.0)))).drop(f"_cat_{c}", f"_code_{c}")
    return out


def fit_imputer(train: DataFrame, numeric, categorical) -> dict:
    """P10 fit: mean for numeric, mode (lowest value on ties) for categorical; one aggregate pass."""
    aggs = [F.avg(c).alias(c) for c in numeric] + [F.mode(c, True).alias(c) for c in categorical]
    if not aggs:
        return {}
    row = train.agg(*aggs).first()  # one row of fill values
    return {c: row[c] for c in list(numeric) + list(categorical)}


def apply_imputer(df: DataFrame, fills: dict) -> DataFrame:
    return df.fillna({k: v for k, v in fills.items() if v is not None})


def one_hot_levels(train: DataFrame, columns) -> DataFrame:
    """P11 fit: (column_name, level, index) of every level seen in train but the first (sorted) of its column; indices
    count from 0 within a column.  One row per level, however many there are."""
    parts = [train.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level"))
             .filter(F.col("level").isNotNull()).distinct() for c in columns]
    levels = parts[0]
    for p in parts[1:]:
        levels = levels.unionByName(p)
    return dense_codes(levels, "level", ["column_name"], "index").withColumn("index", (F.col("index") - 1).cast("int")).filter("index >= 0")


def one_hot(df: DataFrame, levels: DataFrame, columns) -> DataFrame:
    """P11 apply: each column becomes a sparse vector: array of (index, value 1.0), empty for the first level, for
    levels not seen in train and for missing values.  No column per level is made and no level is left out."""
    out = df
    for c in columns:
        m = levels.filter(F.col("column_name") == c).select(F.col("level").alias("_level"), F.col("index").alias("_index"))
        hit = F.array(F.struct(F.col("_index").alias("index"), F.lit(1.0).alias("value")))
        out = out.join(m, out[c].cast("string") == m["_level"], "left")
        out = out.withColumn(c, F.when(F.col("_index").isNull(), F.filter(hit, lambda x: F.lit(False))).otherwise(hit)).drop("_level", "_index")
    return out


def preprocess_vectors(pool: DataFrame, col: str = "features", zero_nulls: bool = True,
                       znorm: bool = False, drop_constant: bool = False) -> DataFrame:
    """NULL -> 0, z-normalisation per dimension, drop zero-variance dimensions.

    Statistics come from one aggregate over ``posexplode`` (d rows of sums), so
    nothing per row reaches the driver.
    """
    v = F.col(col)
    out = pool
    if zero_nulls:
        out = out.withColumn(col, F.transform(v, lambda x: F.coalesce(x, F.lit(0.0)).cast("float")))
    if not (znorm or drop_constant):
        return out
    stats = (out.select(F.posexplode(col).alias("i", "x"))
             .groupBy("i").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
             .orderBy("i").collect())  # d rows: one per dimension
    mus = [r.mu for r in stats]
    sds = [r.sd or 0.0 for r in stats]
    keep = [i for i, s in enumerate(sds) if not (drop_constant and s == 0.0)]
    mu_arr = F.array(*[F.lit(float(mus[i])) for i in keep])
    sd_arr = F.array(*[F.lit(float(sds[i]) if sds[i] > 0 else 1.0) for i in keep])
    idx = F.array(*[F.lit(i) for i in keep])
    vals = F.transform(idx, lambda i: F.element_at(F.col(col), i + 1))
    if znorm:
        vals = F.zip_with(F.zip_with(vals, mu_arr, lambda x, m: x - m), sd_arr, lambda x, s: (x / s).cast("float"))
    return out.withColumn(col, vals)


def budget_grid(n_train: int, n_classes: int, percentages=(), multipliers=(1, 2, 4, 8, 16, 32)) -> list[int]:
    """round(pct * n) and multiplier * C, half to even, clamped to [1, n], distinct, descending."""
    sizes = [round(p * n_train) for p in percentages] + [m * n_classes for m in multipliers]
    return sorted({min(max(int(s), 1), n_train) for s in sizes}, reverse=True)


def budget_grid_df(catalog: DataFrame, multipliers=(1, 2, 4, 8, 16, 32), percentages=()) -> DataFrame:
    """P13 over a catalog (dataset, n_samples, n_classes): one row per (dataset, n_selected)."""
    sizes = [F.bround(F.col("n_samples") * F.lit(p)).cast("long") for p in percentages] + \
            [F.col("n_classes").cast("long") * F.lit(m) for m in multipliers]
    arr = F.array(*[F.least(F.greatest(s, F.lit(1)), F.col("n_samples").cast("long")) for s in sizes])
    return (catalog.select("dataset", F.explode(F.array_distinct(arr)).alias("n_selected"))
            .orderBy("dataset", F.col("n_selected").desc()))


def train_size(n: int, n_folds: int) -> int:
    return math.ceil(n * (n_folds - 1) / n_folds)


def search_sizes(sizes: list[int], n_train: int, n_classes: int) -> list[int]:
    """The configured sizes and C * 2^i (i < 7) within [C, start], descending and distinct, where start is
    the smaller of the first configured size and 25% of train (always part of the list)."""
    start = min(sizes[0], int(0.25 * n_train))
    wanted = {start, *sizes, *(n_classes * 2 ** i for i in range(7))}
    return sorted((s for s in wanted if n_classes <= s <= start), reverse=True)


def comparison_sizes(n_train: int, n_classes: int, cap: int = 250) -> list[int]:
    """C * 2^i up to min(ceil(25% of train), cap)."""
    top = min(math.ceil(0.25 * n_train), cap)
    out, i = [], 0
    while n_classes * 2 ** i <= top:
        out.append(n_classes * 2 ** i)
        i += 1
    return out


def train_validation_split(pool: DataFrame, val_fraction: float = 0.2, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Split column 'train' / 'val' by seeded hash (stable under repartitioning)."""
    u = seeded_order(seed, F.col(key)).cast("double") / F.lit(4294967296.0)
    return pool.withColumn("split", F.when(u < val_fraction, "val").otherwise("train"))


def transductive(train: DataFrame, test: DataFrame, transform) -> tuple[DataFrame, DataFrame]:
    """Encode train and test together (union with a split tag), then split again."""
    both = train.withColumn("_split", F.lit("train")).unionByName(test.withColumn("_split", F.lit("test")))
    enc = transform(both)
    return (enc.filter("_split = 'train'").drop("_split"), enc.filter("_split = 'test'").drop("_split"))
