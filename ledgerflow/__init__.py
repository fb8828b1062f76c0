"""ledgerflow: business-ledger analytics written as Spark DataFrame jobs.

Layers
------
functions/  Column expressions (amount parsing, text normalising, calendar, labels).
sources/    Readers and writers (ledger CSV, Parquet tables, test-data binding).
operators/  DataFrame -> DataFrame building blocks (cleaning, star schema, KPIs,
            KPI store, users, import history, keyword answers).
plans/      Composed jobs (clean-and-load, KPI report, KPI refresh) and the
            catalogue of registered queries with their SQL oracles.
streaming/  The incremental load driven by Structured Streaming over an upload folder.
"""

from ledgerflow.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
