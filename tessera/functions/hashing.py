"""Seeded hash order used by every random operator.

``seeded_order(seed, key)`` is the first 32 bits of ``md5(seed || '|' || key)``
read as a non-negative integer.  The same value is produced by DuckDB with
``('0x' || substr(md5(concat(seed, '|', key)), 1, 8))::BIGINT`` so every random
choice is reproducible in SQL, and it depends only on the row key and the seed,
never on partitioning or row order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def seeded_hex(seed, key) -> Column:
    """The 8 hexadecimal digits of ``seeded_order``: the same order, as text, without the conversion."""
    s = F.lit(str(seed)) if isinstance(seed, (int, str)) and not isinstance(seed, Column) else _as_col(seed).cast("string")
    k = _as_col(key).cast("string")
    return F.substring(F.md5(F.concat(s, F.lit("|"), k)), 1, 8)


def seeded_order(seed, key) -> Column:
    """bigint in [0, 2^32) derived from md5(seed|key); seed and key may be columns or literals."""
    return F.conv(seeded_hex(seed, key), 16, 10).cast("bigint")


def seeded_unit(seed, key) -> Column:
    """Uniform double in (0, 1): (order + 0.5) / 2^32."""
    return (seeded_order(seed, key).cast("double") + F.lit(0.5)) / F.lit(TWO_POW_32)


def sql_seeded_order(seed_sql: str, key_sql: str) -> str:
    """DuckDB text for the same order (used by oracle queries)."""
    return f"('0x' || substr(md5(concat({seed_sql}, '|', {key_sql})), 1, 8))::BIGINT"
