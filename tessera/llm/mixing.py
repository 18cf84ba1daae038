"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Documents are aggregated to cells (source x language x topic) with their token counts.  Raking multiplies the cell
factors so that, one dimension after the other, the weighted tokens of every value reach its target; sweeps over the
dimensions repeat until all marginals hold.  A document is then sampled with probability factor / largest factor:
the largest sample in which every marginal is met in expectation and no document is needed twice.

Only cells are raked (one row per combination that occurs), never documents; the cell table is stored in the shared
folder between groups of sweeps.  Documents meet their factor by a join that Spark plans by the stored table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.hashing import seeded_unit
from tessera.llm.common import columns_of, stored, text_or_empty, whole_rows

DIMENSIONS = ("source", "lang", "topic")
# Powers of the present token shares that serve as targets: under 1 draws hot values down and rare ones up.
SMOOTHING = {"source": 0.7, "lang": 0.8, "topic": 0.9}
SWEEPS, SWEEPS_A_JOB = 12, 3
TOKEN = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of the text."""
    return (F.when(F.contains(text, F.lit(" | ")), "table").when(text.rlike(r"[#$%&*]{3}"), "signs")
            .when(F.contains(F.lower(text), F.lit("licen")), "legal").when(F.contains(text, F.lit("@")), "contact").otherwise("prose"))


def with_dimensions(docs: DataFrame, dims=DIMENSIONS, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``__<dim>`` for every dimension (null counts as the empty value; ``topic`` is derived from the text
    unless it is a column, any other dimension that is not a column is empty) and ``__tokens``."""
    text = text_or_empty(text_col)
    value = {d: F.col(d) if d in docs.columns else topic_of(text) if d == "topic" else F.lit("") for d in dims}
    return docs.withColumns({f"__{d}": F.coalesce(v.cast("string"), F.lit("")) for d, v in value.items()}
                            | {"__tokens": F.regexp_count(text, F.lit(TOKEN)).cast("bigint")})


def smoothed_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(value, target): the tokens of each value of the dimension raised to ``power``; only ratios matter."""
    return cells.groupBy(F.col(f"__{dim}").alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (``__<dim>`` columns and tokens) plus ``factor``.

    ``targets`` maps a dimension to (value, target >= 0); targets of a dimension need not add up to anything.  Values
    without a target are left out of the mix (factor 0); targets of values that do not occur are ignored.
    """
    for d, t in targets.items():
        t = t.groupBy(F.col("value").alias(f"__{d}")).agg(F.max("target").alias(f"__target_{d}"))
        cells = cells.join(t, f"__{d}", "left").withColumn(f"__target_{d}", F.coalesce(f"__target_{d}", F.lit(0.0)))
    cells = stored(cells.withColumn("factor", F.lit(1.0)), "cells")
    for s in range(sweeps):
        for d in targets:
            mass = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(f"__{d}"))
            cells = cells.withColumn("factor", F.when(F.col(f"__target_{d}") <= 0, 0.0).when(mass > 0, F.col("factor") * (
                F.col(f"__target_{d}") / mass)).otherwise(F.col("factor")))
        if s % SWEEPS_A_JOB == SWEEPS_A_JOB - 1 or s == sweeps - 1:
            cells = stored(cells, "cells")
    return cells


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, dims=DIMENSIONS, id_col: str = "doc_id",
        text_col: str = "text", seed: int = 17, sweeps: int = SWEEPS) -> DataFrame:
    """``docs`` plus ``__<dim>`` columns, ``__tokens``, ``probability`` and ``sampled``.

    Without ``targets`` the smoothed present shares are used.  The draw is a seeded hash of the id, so rows that repeat
    an id share their lot and a rerun draws the same sample.  A document without words gets its cell's factor.
    """
    rows = with_dimensions(docs, dims, text_col)
    keys = [f"__{d}" for d in dims]
    cells = stored(rows.groupBy(*keys).agg(F.sum("__tokens").alias("tokens")), "cells")
    targets = targets or {d: smoothed_targets(cells, d, SMOOTHING.get(d, 1.0)) for d in dims}
    factors = rake(cells, targets, sweeps).select(*keys, "tokens", "factor")
    top = factors.where("tokens > 0").agg(F.max("factor")).first()[0] or 1.0  # one number
    factors = factors.select(*keys, F.round(F.least(F.col("factor") / F.lit(top), F.lit(1.0)), 9).alias("probability"))
    out = rows.drop("probability", "sampled").join(factors, keys)
    lot = seeded_unit(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return out.withColumn("sampled", lot < F.col("probability"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with their columns, of whatever names, and ``probability`` (a column of that name is
    replaced, and so is ``sampled``)."""
    plain = docs.drop("probability", "sampled")
    used = {options.get("id_col", "doc_id"), options.get("text_col", "text"), *options.get("dims", DIMENSIONS)}
    drawn = mix(plain.select(whole_rows(plain), *[F.col(f"`{c}`") for c in plain.columns if c in used]), **options).where("sampled")
    return drawn.select(*columns_of(plain), "probability")
