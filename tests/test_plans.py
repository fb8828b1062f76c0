"""Plan checks: no Python UDFs, no Cartesian products, pushdown reaches the scan."""

import pytest

import __spark_entry__ as entry
from ledgerflow.operators import kpi as K
from ledgerflow.plans.catalog import QUERIES
from ledgerflow.sources.tables import read_clean, write_clean
from tests.conftest import SF_SMALL

FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_or_cartesian(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    for op in FORBIDDEN:
        assert op not in plan, (name, op)


def test_period_filter_pushed_to_parquet(spark, tmpdir_path):
    from ledgerflow.plans.catalog import ledger
    path = f"{tmpdir_path}/clean"
    write_clean(ledger(spark, SF_SMALL), path)
    df = K.in_period(read_clean(spark, path), "1996-03")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(txn_date), GreaterThanOrEqual(txn_date" in plan
    assert "PartitionFilters" in plan


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["month", "revenue", "expenses", "running_balance"]


def test_hot_key_is_split_across_tasks(spark):
    """One key holding a third of all rows: the numbering's range partitioning still
    spreads it (the order key has further columns), and first_per_key pre-aggregates."""
    from pyspark.sql import functions as F

    from ledgerflow.operators.ids import assign_ids, first_per_key
    n = 30000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("key"), F.col("id"))
    out = assign_ids(df, ["key", "id"], "rid", num_partitions=8)
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 3
    ids = out.agg(F.min("rid"), F.max("rid"), F.countDistinct("rid")).first()
    assert tuple(ids) == (1, n, n)
    first = first_per_key(df, ["key"], "id", ["id"]).where("key = 'HOT'").first()
    assert first.id == 0
    plan = _plan(first_per_key(df, ["key"], "id", ["id"]))
    hashed = [line for line in plan.splitlines() if "HashAggregate(" in line and "partial_min(id" in line]
    assert hashed and not any("SortAggregate" in line and "partial_min(id" in line for line in plan.splitlines())


def test_dimensions_are_broadcast_after_size_check(spark):
    plan = _plan(entry.queries()["star_flatten"](spark, SF_SMALL))
    assert plan.count("BroadcastHashJoin") >= 7
    assert "SortMergeJoin" not in plan


def test_dim_join_respects_byte_bound(spark):
    from ledgerflow.operators.joins import dim_join, dimension_size
    big = spark.range(100).withColumnRenamed("id", "k")
    dim = spark.range(100).withColumnRenamed("id", "k").selectExpr("k", "repeat('x', 100) AS v")
    rows, size = dimension_size(dim)
    assert rows == 100 and size >= 100 * 100
    assert "BroadcastHashJoin" in _plan(dim_join(big, dim, "k", max_bytes=1 << 20))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in _plan(dim_join(big, dim, "k", max_bytes=1000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32MB")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
