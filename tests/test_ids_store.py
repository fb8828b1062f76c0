"""Surrogate keys, first-row-per-key, KPI merge and evolution rules."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.operators import refresh as R
from ledgerflow.operators import store as S
from ledgerflow.operators.ids import assign_ids, first_per_key


def test_assign_ids_gap_free_and_partition_independent(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    for parts in (1, 3, 16):
        out = assign_ids(df.repartition(parts), ["k"], "rid", num_partitions=parts)
        got = sorted((r.k, r.rid) for r in out.collect())
        assert [rid for _, rid in got] == list(range(1, 5001))


def test_assign_ids_without_order_is_gap_free(spark):
    df = spark.range(0, 3000, 1, 7).select((F.col("id") * 31).alias("k"))
    out = assign_ids(df, None, "rid")
    ids = sorted(r.rid for r in out.collect())
    assert ids == list(range(1, 3001))
    plan = out._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "RangePartitioning" not in plan


def test_rows_are_stored_once_and_keep_their_ids(spark):
    """Ids come from the place of a row in its file: the stored rows hold none, any reading resolves the same ones."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.lit("x").alias("v"))
    out = assign_ids(df, ["k"], "rid", start=100, num_partitions=12, stored=["k", "v"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    first = sorted(map(tuple, out.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # files are then read by several tasks each
    try:
        again = sorted(map(tuple, out.select("*").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert first == again and [r[2] for r in first] == list(range(100, 20_100))
    assert "RangePartitioning" not in _executed(out) and len(out.inputFiles()) >= 12


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_numbering_a_stored_table_in_its_own_order_copies_nothing(spark, tmpdir_path):
    from ledgerflow.session import mark_stored
    spark.range(0, 5_000, 1, 9).write.parquet(f"{tmpdir_path}/t")
    out = assign_ids(mark_stored(spark.read.parquet(f"{tmpdir_path}/t")), None, "rid")
    assert f"{tmpdir_path}/t" in _executed(out)
    assert [(r["id"] + 1) for r in out.orderBy("rid").collect()] == list(range(1, 5_001))


def test_assign_ids_lazy_start(spark):
    existing = spark.createDataFrame([(5,), (9,)], "id long")
    start = existing.agg((F.max("id") + 1).alias("s"))
    out = assign_ids(spark.createDataFrame([("b",), ("a",)], "x string"), ["x"], "id", start)
    assert sorted((r.x, r.id) for r in out.collect()) == [("a", 10), ("b", 11)]


def test_first_per_key(spark):
    df = spark.createDataFrame([("o1", "D2", 2), ("o1", "D1", 1), ("o2", "D3", 5)], "k string, v string, o int")
    got = sorted(tuple(r) for r in first_per_key(df, ["k"], "o", ["v"]).collect())
    assert got == [("o1", "D1"), ("o2", "D3")]


def _batch(spark, rows):
    return spark.createDataFrame(rows, "kpi_name string, period string, value double, part int, position string")


EMPTY = "id long, kpi_name string, period string, value double, evolution double, department_id int, " \
        "source string, stat_type string, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_kpi_merge_replace(spark):
    existing = spark.createDataFrame([], EMPTY)
    batch = _batch(spark, [("A", "global", 1.0, 0, "0"), ("A", "global", 2.0, 0, "1"), ("  ", "global", 3.0, 0, "2")])
    store, counts = S.merge_kpis(existing, batch, True, dt.datetime(2024, 1, 1))
    assert [(r.kpi_name, r.value) for r in store.collect()] == [("A", 2.0)]
    c = counts.first()
    assert (c.inserted, c.replaced) == (2, 1)


def test_kpi_merge_append(spark):
    existing = spark.createDataFrame([], EMPTY)
    batch = _batch(spark, [("A", "global", 1.0, 0, "0"), ("A", "global", 2.0, 0, "1")])
    store, counts = S.merge_kpis(existing, batch, False, dt.datetime(2024, 1, 1))
    assert store.count() == 2
    c = counts.first()
    assert (c.inserted, c.replaced) == (2, 0)


def test_kpi_merge_replaces_stored_rows(spark):
    first = S.initial_store(_batch(spark, [("A", "global", 1.0, 0, "0"), ("B", "global", 5.0, 0, "1")]),
                            dt.datetime(2024, 1, 1))
    store, counts = S.merge_kpis(first, _batch(spark, [("A", "global", 7.0, 0, "0")]), True, dt.datetime(2024, 2, 1))
    got = sorted((r.id, r.kpi_name, r.value) for r in store.collect())
    assert got == [(2, "B", 5.0), (3, "A", 7.0)]
    assert tuple(counts.first()) == (1, 1)


def test_monthly_evolution_rules(spark):
    base = spark.createDataFrame(
        [("2024-01", 100.0), ("2024-03", 150.0), ("2024-04", 0.0), ("2024-05", 10.0)], "year_month string, a double"
    ).select("year_month", F.col("a").cast("decimal(18,3)").alias("amount"),
             F.col("a").cast("decimal(18,3)").alias("signed_amount"), F.lit(2024).alias("year"),
             F.lit(1).alias("quarter"), F.lit("D").alias("department"), F.lit(1).alias("department_id"),
             F.lit("Revenu").alias("txn_type"), F.lit("N/A").alias("expense_type"))
    got = sorted((r.period, r.evolution) for r in R.monthly_evolution(base).collect())
    assert got == [("2024-01", 0.0), ("2024-03", 50.0), ("2024-04", -100.0), ("2024-05", 0.0)]
