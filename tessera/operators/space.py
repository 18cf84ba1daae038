"""Representation spaces."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.joins import fresh, null_safe_on


def original_space(pool: DataFrame, features, out: str = "features") -> DataFrame:
    """All feature columns as one float array (the vector the selectors read)."""
    return pool.withColumn(out, F.array(*[F.col(c).cast("float") for c in features]))


def embedding_space(pool: DataFrame, embeddings: DataFrame, key: str = "row_id", vec: str = "embedding",
                    out: str = "features") -> DataFrame:
    """R2: join a supplied embedding table on the row key; a pool row without an embedding is an error (raised when the
    query runs), never dropped.  ``embedding_coverage`` lists such rows beforehand."""
    e = embeddings.select(F.col(key), F.col(vec).alias(out))
    checked = F.coalesce(F.col(out), F.raise_error(F.concat(F.lit("no embedding for row "), F.col(key).cast("string"))))
    return pool.join(e, key, "left").withColumn(out, checked)


def embedding_coverage(pool: DataFrame, embeddings: DataFrame, key: str = "row_id") -> DataFrame:
    """R2 length check: pool rows without an embedding (must be empty)."""
    return pool.select(key).join(embeddings.select(key), key, "left_anti")


def encode(pool: DataFrame, load: Callable, inputs, name: str, keep=("row_id",), dim_type: str = "float") -> DataFrame:
    """R2 as a user function: (keep..., embedding) for every pool row.  ``load()`` returns the encoder, a function from a
    pandas frame of the ``inputs`` to a matrix with one row per pool row; it is called once per Python worker (kept there
    under ``name``, which must name the encoder and its version), and rows stream through it in Arrow batches.  An encoder
    that returns another number of rows is an error."""
    keep, inputs = list(keep), list(inputs)
    types = dict(pool.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", embedding array<{dim_type}>"

    def run(batches):
        loaded = sys.modules.setdefault("_tessera_encoders", ModuleType("_tessera_encoders")).__dict__
        if name not in loaded:
            loaded[name] = load()
        for pdf in batches:
            if len(pdf):
                made = np.asarray(loaded[name](pdf[inputs]))
                if len(made) != len(pdf):
                    raise ValueError(f"encoder {name} gave {len(made)} rows for {len(pdf)}")
                yield pdf[keep].assign(embedding=list(made))

    return pool.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, schema)


def encode_through(store, pool: DataFrame, load: Callable, inputs, name: str) -> DataFrame:
    """Embeddings of the pool through an embedding store.  ``pool`` has dataset, fold, split and row_id; a stored split is
    taken only if it has as many rows as the pool's, and only the other splits are encoded."""
    g = ["dataset", "fold", "split"]
    wanted = pool.groupBy(*g).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("encoder", F.lit(name))

    def compute(todo: DataFrame) -> DataFrame:
        keys = fresh(todo, g)
        own = pool.join(keys, null_safe_on(pool, keys, g), "left_semi")
        return encode(own, load, inputs, name, [*g, "row_id"]).withColumn("encoder", F.lit(name))
    return store.get_or_compute(wanted, compute)


def pca_2d(df: DataFrame, col: str = "features", k: int = 2) -> DataFrame:
    """K-component PCA fitted on all given rows (train, val and test together)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = df.withColumn("_vec", array_to_vector(F.col(col)))
    model = PCA(k=k, inputCol="_vec", outputCol="_pca").fit(v)
    return model.transform(v).withColumn("pca", vector_to_array("_pca")).drop("_vec", "_pca")
