"""Round 4's findings on disk: loads, uploads and the duplicate drop shuffle and write few bytes a row, with the same rows."""

import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import clean as C
from ledgerflow.operators import history as H
from ledgerflow.operators import joins
from ledgerflow.operators import star as St
from ledgerflow.operators.ids import first_per_key
from ledgerflow.operators.places import _packed, place_rows
from ledgerflow.schemas import LEDGER_RAW, UPLOAD_TO_LEDGER
from ledgerflow.session import materialize
from ledgerflow.sources.ledger_csv import read_uploads, write_ledger_csv


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def _raw(spark, n=300):
    r = random.Random(3)
    rows = [(f"2024-0{r.randrange(1, 10)}-05", r.choice(["DEPT001", "DEPT002", None]), r.choice(["Ventes", "Achat ", "B"]), r.choice(["Revenu", "Depense"]),
             r.choice([None, "x"]), str(r.randrange(4)), r.choice(["Ann", "Bob", " "]), r.choice(["c1", "c2", "c10", None]), f"P{r.randrange(2)}")
            for _ in range(n)]
    return spark.createDataFrame(rows, LEDGER_RAW).withColumn("ordinal", F.monotonically_increasing_id())


def test_stored_tables_are_compressed_well(spark):
    assert all(".zstd." in f for f in materialize(spark.range(9)).inputFiles())


def test_duplicates_of_a_stored_upload(spark, monkeypatch):
    """Only rows that may have a copy are shuffled whole; the rows are those of the plain drop."""
    raw = materialize(_raw(spark))
    plain = sorted(map(str, C.drop_exact_duplicates(raw, C.COPIES).select(*raw.columns, C.COPIES).collect()))
    few = C.drop_stored_duplicates(raw, C.COPIES)
    assert sorted(map(str, few.select(*raw.columns, C.COPIES).collect())) == plain and len(plain) < 300
    assert "LeftAnti" in _plan(C.clean_ledger(raw, day_first=False, with_copies=True))
    monkeypatch.setattr(C, "REPEATED_MAX_ROWS", 0)
    many = C.drop_stored_duplicates(raw, C.COPIES)
    assert "LeftAnti" not in _plan(many)
    assert sorted(map(str, many.select(*raw.columns, C.COPIES).collect())) == plain


def test_first_per_key_reads_its_rows_once(spark):
    rows = [("a", "y", 3), ("a", "x", 3), ("a", "w", None), ("b", None, 1), ("b", "z", 2), (None, "q", 0), ("c", "v", None)]
    df = spark.createDataFrame(rows, "k string, v string, o long")
    first = first_per_key(df, ["k"], "o", ["v"])
    assert sorted(map(tuple, first.collect())) == [("a", "x"), ("b", None)]
    assert "Join" not in _plan(first)


@pytest.mark.parametrize("bound", [2_000_000, 3, 0])
@pytest.mark.parametrize("strict", [True, False])
def test_facts_by_places_equal_facts_by_names(spark, monkeypatch, bound, strict):
    """With all, some and none of the dimensions small."""
    led, _ = C.split_valid(C.clean_ledger(_raw(spark), day_first=False))
    own = F.when(F.col("ordinal") % 5 == 0, F.lit(Decimal("1.5"))).when(F.col("ordinal") % 5 != 1, F.col("signed_amount"))
    led = materialize(led.withColumns({"signed_amount": own.cast("decimal(28,6)"), "upload": (F.col("ordinal") % 2).cast("int")}))
    dims = {k: materialize(v()) for k, v in St.build_dimensions(led.drop("upload")).items()}
    if strict:  # some rows miss a member, ids do not follow the names
        dims["dim_txn_type"] = materialize(dims["dim_txn_type"].where("txn_type = 'Revenu'"))
        dims["dim_counterparty"] = materialize(dims["dim_counterparty"].withColumn("counterparty_id", 9 - F.col("counterparty_id")))
    named = St.resolve_keys(led, dims, strict=strict, owner_by_name=True)
    monkeypatch.setattr(joins, "DIM_BROADCAST_MAX_ROWS", bound)
    placed = place_rows(led, dims, strict=strict, owner_by_name=True, upload="upload")
    for column in ("upload", "resolved"):
        assert sorted(map(str, placed.groupBy(column).count().collect())) == sorted(map(str, named.groupBy(column).count().collect()))
    want = St.facts_from_resolved(named, 5)
    got = St.facts_from_resolved(placed, 5)
    assert got.dtypes == want.dtypes and got.count() > 50
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert not {"department", "owner", "project"} & set(placed.columns) or bound == 0


def test_places_over_several_numbers():
    fields = _packed({"a": 40, "b": 20, "c": 10, "d": 63})
    assert fields == {"a": ("_places_0", 20, 40), "b": ("_places_0", 0, 20), "c": ("_places_1", 0, 10), "d": ("_places_2", 0, 63)}


def test_uploads_are_numbered_where_they_are_read(spark, tmpdir_path):
    """In the order of files, parts and lines, compressed or not, without dealing the rows to ranges."""
    names = {own: name for name, own in UPLOAD_TO_LEDGER.items()}
    rows = spark.range(0, 400, 1, 5).select(*(F.concat(F.lit(f"{own[:2]}-"), F.col("id").cast("string")).alias(names[own]) for own in names))
    paths = [f"{tmpdir_path}/b", f"{tmpdir_path}/a"]
    write_ledger_csv(rows, paths[0], compression="gzip")
    write_ledger_csv(rows.limit(150).repartition(2), paths[1])
    assert any(f.endswith(".csv.gz") for f in os.listdir(paths[0]))
    for size in ("2k", "128MB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            found = read_uploads(spark, paths).rows.orderBy("ordinal").select("ordinal", "upload", "owner").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [r["ordinal"] for r in found] == list(range(1, 551)) and [r["upload"] for r in found] == [0] * 400 + [1] * 150
        assert [r["owner"] for r in found[:400]] == [f"ow-{k}" for k in range(400)]
        second = [r["owner"] for r in found[400:]]
        lines = []
        for part in sorted(f for f in os.listdir(paths[1]) if f.endswith(".csv")):
            with open(f"{paths[1]}/{part}", encoding="utf-8") as f:
                lines += f.read().splitlines()[1:]
        place = list(UPLOAD_TO_LEDGER.values()).index("owner")
        assert second == [line.split(",")[place] for line in lines]
    assert not any("_row" in f for f in read_uploads(spark, paths).rows.columns)


def test_first_rows_of_each_import(spark):
    rows = [(u, d, k) for u in (0, 1) for d in (None, "b", "a") for k in range(3)] + [(2, "z", 1)]
    df = spark.createDataFrame(rows, "u int, d string, k int")
    data = {r["u"]: r["data"] for r in H.audit_data_by(df, "u", ["d", "k"], ["d", "k"], "/f", 4).collect()}
    shown = '[{"d":null,"k":0},{"d":null,"k":1},{"d":null,"k":2},{"d":"a","k":0}]'
    assert [shown in data[u] for u in (0, 1)] == [True, True] and '"rows_count":9' in data[1] and '"rows_count":1' in data[2]


def test_folders_are_written_without_a_sort(spark):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    df = spark.range(0, 2_000, 1, 2).withColumn("f", (F.col("id") % 40).cast("int"))  # more folders than open files
    out = materialize(df, partition_by=["f"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_the_upload_keeps_days_and_numbers_of_its_lines(spark, tmpdir_path):
    """Which are one number while lines are shuffled, nulls and far values included."""
    import datetime as dt

    from ledgerflow.sources import binding as B

    lines = [(1, 1, 1, 1, 2.5, "N", dt.datetime(2024, 1, 5)), (1, 1, 1, None, 3.0, "A", dt.datetime(1, 1, 1)), (1, 1, 1, -(1 << 31), None, "R", None),
             (1, 1, 1, (1 << 31) - 1, 1.005, None, dt.datetime(9999, 12, 31)), (1, 1, 1, 2, 7.0, "N", dt.datetime(1969, 12, 31, 23))]
    tables = {"lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, "
                                  "l_shipdate timestamp"),
              "orders": ([(1, 1)], "o_orderkey long, o_custkey long"), "customer": ([(1, "C", 0)], "c_custkey long, c_name string, c_nationkey int"),
              "nation": ([(0, "N_0")], "n_nationkey int, n_name string"), "supplier": ([(1, "S")], "s_suppkey long, s_name string"),
              "part": ([(1, "T", "B")], "p_partkey long, p_type string, p_brand string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmpdir_path}/{name}")
    few = B.ledger_raw(spark, tmpdir_path, ordinal=True)
    got = few.select("date_raw", "txn_type", "expense_type", "amount_raw", "counterparty", "ordinal")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("2024-01-05", "Revenu", None, "€ 2.50", "C", 19), ("0001-01-01", "Dépense", "T", "3.00", "S", None),
        (None, "depense", "T", None, "S", (8 - (1 << 31)) * 2 + 1), ("9999-12-31", "depense", "T", "1.01", "S", (8 + (1 << 31) - 1) * 2 + 1),
        ("1969-12-31", "Revenu", None, "-7.00 $", "C", 21)], key=str)
