"""Joins against a small side: broadcast only below checked bounds.

A "small" side here is a dimension, a per-user or per-key summary, or a set of
keys. No join hints that it is small: the planner takes the size of a stored table from its
files and AQE that of a finished stage; above the bounds the join stays a shuffle join, and AQE's skew-join split
(on in ``session.DEFAULT_CONF``) cuts a hot key of the big side into several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row bound of a broadcast that is measured on request.
DIM_BROADCAST_MAX_ROWS = 2_000_000
DIM_BROADCAST_MAX_BYTES = 64 << 20


def dimension_size(dim: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a dimension in one small aggregate; bytes are the UTF-8 text
    length of every value plus 8 bytes per value, an upper bound of its in-memory
    hashed size order of magnitude."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.lit(8) for c in dim.columns),
                F.lit(0))
    r = dim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return int(r["n"]), int(r["b"])


def dim_join(big: DataFrame, dim: DataFrame, on, how: str = "left", max_rows: int = DIM_BROADCAST_MAX_ROWS,
             max_bytes: int | None = None) -> DataFrame:
    """Join ``big`` to a small side without assuming that it is small.

    By default nothing is measured while the plan is built. A stored dimension is a Parquet table, so the
    planner knows its size and broadcasts it below ``spark.sql.autoBroadcastJoinThreshold``; a side
    that is computed is measured by AQE when its shuffle stage is done. Both leave a shuffle join above
    their bound, with skewed keys split. ``max_bytes`` asks for the exact measure of rows and bytes
    instead, in one aggregate, fresh for every call.
    """
    if max_bytes is None:
        return big.join(dim, on, how)
    rows, size = dimension_size(dim)
    return big.join(F.broadcast(dim) if rows <= max_rows and size <= max_bytes else dim, on, how)
