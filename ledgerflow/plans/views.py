"""SQL access: register the star and the KPI store as temporary views.

Users of the original application wrote their analytics as SQL over the star
tables; with the views registered the same kind of query runs through
``spark.sql`` and Catalyst plans it like the DataFrame code (pushdown, broadcast
of small dimensions by measured size, AQE).
"""

from __future__ import annotations

from ledgerflow.plans.etl_load import Star


def register_star_views(star: Star, prefix: str = "") -> list[str]:
    """Create or replace one temporary view per star table; returns the view names."""
    names = []
    for name, df in star.tables().items():
        view = f"{prefix}{name}"
        df.createOrReplaceTempView(view)
        names.append(view)
    return names

