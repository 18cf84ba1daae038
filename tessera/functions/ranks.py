"""Dense codes of sorted values without a window over a whole column.

The distinct values are range-partitioned and sorted; a value's code is its place in its partition plus the rows of the
partitions before.  The only window runs over one row per partition and group, and the sorted table is cut off with a
reliable checkpoint, so a lost executor does not renumber it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def dense_codes(values: DataFrame, value: str, by=(), out: str = "code") -> DataFrame:
    """The distinct (by..., value) with ``out``: 0, 1, ... in the order of ``value`` within each group, nulls first."""
    g = list(by)
    rows = values.select(*g, value).distinct().repartitionByRange(*g, value).sortWithinPartitions(*g, value)
    rows = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*g, "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)) - F.col("_low")).drop("_low", "_n")
    parts = parts.select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col("_part").alias("_p"), "_before")
    on = rows["_part"] == parts["_p"]
    for c in g:
        on = on & rows[c].eqNullSafe(parts[f"_g_{c}"])
    return rows.join(parts, on).select(*g, value, (F.col("_before") + F.col("_at")).cast("long").alias(out))
