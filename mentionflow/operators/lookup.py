"""Lookups in a dimension table whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
LITERAL_ROWS = 2_000
SALTS = 16


def fits(dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``dim`` stays within both bounds. Reads at most ``max_rows + 1`` rows."""
    width = F.octet_length(F.to_json(F.struct(*dim.columns)))
    rows, size = (
        dim.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0)))
        .first()
    )
    return rows <= max_rows and size <= max_bytes


def bounded_values(dim: DataFrame, column: str, max_rows: int = LITERAL_ROWS) -> list | None:
    """The distinct values of a small dimension column, or None if there are too many."""
    found = [row[0] for row in dim.select(column).distinct().limit(max_rows + 1).collect()]
    return None if len(found) > max_rows else sorted(v for v in found if v is not None)


def lookup_join(
    rows: DataFrame,
    dim: DataFrame,
    key: Column,
    dim_key: str,
    how: str,
    spread: Column,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``rows`` with ``dim`` on ``key`` = ``dim_key``; ``how`` is left_semi, left or inner.

    A dimension within the bounds is broadcast. A larger one is repeated once per salt and
    ``rows`` are spread over the salts by ``spread``, so a hot key is shared by many tasks.
    """
    named = dim.withColumnRenamed(dim_key, "_dim_key")
    keyed = rows.withColumn("_key", key)
    if fits(dim, max_rows, max_bytes):
        joined = keyed.join(F.broadcast(named), F.col("_key") == F.col("_dim_key"), how)
        return joined.drop("_key", "_dim_key")
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = named.withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    condition = (F.col("_key") == F.col("_dim_key")) & (F.col("_salt") == F.col("_dim_salt"))
    return salted.join(repeated, condition, how).drop("_key", "_salt", "_dim_key", "_dim_salt")
