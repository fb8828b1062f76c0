"""Composed load jobs: full star rebuild, incremental upload, KPI refresh and merge.

``rebuild_star`` is the standalone rebuild (all seven dimensions built from the
ledger, lenient fact keys). ``load_upload`` is the upload path: date, owner,
counterparty and project dimensions are extended insert-only; department,
transaction-type and expense-type dimensions are only read, and facts that miss
any key are skipped and counted.
"""

from __future__ import annotations

import datetime as _dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import clean as C
from ledgerflow.operators import refresh as R
from ledgerflow.operators import star as St
from ledgerflow.operators import store as K
from ledgerflow.operators.places import place_rows
from ledgerflow.session import mark_stored, materialize


@dataclass
class Star:
    dims: dict[str, DataFrame]
    facts: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {**self.dims, "fact_transactions": self.facts}


def materialize_all(frames: dict, workers: int = 8) -> dict[str, DataFrame]:
    """Build and materialize independent frames concurrently.

    Each dimension is a handful of small jobs (aggregate, range sample, checkpoint);
    submitting them from several threads lets the scheduler run them side by side
    instead of leaving the cluster idle between small jobs. Values may be frames or
    zero-argument builders (building itself may run jobs).
    """
    def one(item):
        name, v = item
        return name, materialize(v() if callable(v) else v)

    with ThreadPoolExecutor(max_workers=min(workers, len(frames))) as pool:
        return dict(pool.map(one, frames.items()))


def rebuild_star(ledger: DataFrame) -> Star:
    """Full rebuild from a cleaned ledger (ids 1..n everywhere).

    The cleaned rows and each dimension are materialized once: they feed several
    jobs each (seven dimension builds, then seven key joins).
    """
    ledger = materialize(ledger)
    dims = materialize_all(St.build_dimensions(ledger))
    return Star(dims, St.facts_from_resolved(place_rows(ledger, dims, strict=False, owner_by_name=True), 1))


@dataclass
class LoadResult:
    star: Star
    resolved: DataFrame  # cleaned valid rows as places in their dimensions (``places.place_rows``), with a ``resolved`` flag
    members: dict[str, DataFrame]  # what the load added to the dimensions


def extend_dimensions(dims: dict[str, DataFrame], ledger: DataFrame, owner_key: tuple[str, ...] = ("owner", "department")
                      ) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(all dimensions after an upload, the members that it added). Only the added members are written."""
    members = materialize_all({
        "dim_date": lambda: St.new_dates(dims["dim_date"], ledger),
        "dim_owner": lambda: St.new_owners(dims["dim_owner"], ledger, owner_key),
        "dim_counterparty": lambda: St.new_counterparties(dims["dim_counterparty"], ledger),
        "dim_project": lambda: St.new_projects(dims["dim_project"], ledger),
    })
    return dims | {k: mark_stored(dims[k].unionByName(m)) for k, m in members.items()}, members


def load_upload(star: Star, ledger: DataFrame, replace: bool = True,
                owner_key: tuple[str, ...] = ("owner", "department")) -> LoadResult:
    """Incremental load of one cleaned upload into an existing star. ``owner_key``: owners are one per
    (name, department), or one per name with ``("owner",)``."""
    ledger = materialize(ledger)
    dims, members = extend_dimensions(star.dims, ledger, owner_key)
    resolved = place_rows(ledger, dims, strict=True, owner_by_name=owner_key == ("owner",))  # the load, an append and the counters read it
    facts = St.load_facts(star.facts, resolved, replace=replace)  # the new rows are stored once, the old ones stay where they are
    return LoadResult(Star(dims, facts), resolved, members)


def refresh_from_star(star: Star) -> DataFrame:
    return R.refresh_kpis(St.kpi_base(star.facts, star.dims))


def refresh_and_merge(existing_store: DataFrame, star: Star, created_at: _dt.datetime) -> tuple[DataFrame, DataFrame]:
    """KPI refresh of a star merged into the store with replace (name, period)."""
    return K.merge_kpis(existing_store, refresh_from_star(star), True, created_at)


def quality_report(cleaned: DataFrame, star: Star | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """Quality counters of loading a cleaned upload (``clean_ledger(..., with_copies=True)``,
    all rows) into ``star``: one aggregate after the key joins, or without a join where the load's own
    ``resolved`` rows (the valid ones, with their flag) are given."""
    if resolved is not None:
        return C.quality_counters(cleaned, loaded=resolved)
    resolved = St.resolve_keys(cleaned, star.dims, strict=True)
    return C.quality_counters(resolved.withColumn("resolved", F.coalesce("resolved", F.lit(False))), "resolved")
