"""Rules that the test tables alone do not show: ids of large dimensions, department codes, files, dates, amounts, JSON."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import calendar as D
from ledgerflow.functions import jsonval as J
from ledgerflow.functions import money as M
from ledgerflow.operators import clean as C
from ledgerflow.operators import history as H
from ledgerflow.operators import refresh as R
from ledgerflow.operators import star as St
from ledgerflow.operators import store as S
from ledgerflow.operators.ids import assign_ids
from ledgerflow.plans import etl_load as E
from ledgerflow.schemas import REQUIRED_COLUMNS
from ledgerflow.session import materialize
from ledgerflow.sources.ledger_csv import read_ledger_csv, write_ledger_csv


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("parts", [None, 13])
def test_ids_of_a_large_dimension_have_no_gap_and_no_repeat(spark, aqe, parts):
    n = 400_000
    df = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.repeat(F.lit("x"), 20).alias("payload"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        out = materialize(assign_ids(df, ["k"], "rid", num_partitions=parts))
        row = out.agg(F.count_distinct("rid").alias("d"), F.min("rid").alias("a"), F.max("rid").alias("b"),
                      F.max(F.length("payload")).alias("p")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert tuple(row) == (n, 1, n, 20)


LEDGER = ("date_raw string, department_code string, department string, txn_type string, expense_type string, "
          "amount_raw string, owner string, counterparty string, project string")


def ledger(spark, rows):
    return C.clean_valid(spark.createDataFrame(rows, LEDGER))


def test_a_name_with_several_codes_loads_every_row_once(spark):
    rows = [("2024-01-01", code, name, "Revenu", None, amount, "o", "c", "p") for code, name, amount in
            [("DEPT001", "A", "52"), ("DEPT002", "A", "52.5"), (None, "A", "52.50"), ("DEPT002", "B", "1"), ("none", "C", "2"),
             ("DEPT99999999999", "D", "3")]]
    led = ledger(spark, rows)
    dim = {r["department"]: r["department_id"] for r in St.build_dim_department(led).collect()}
    assert dim["A"] == 2 and dim["C"] is None and dim["D"] == 99999999999 and dim["B"] == 100000000000
    facts = E.rebuild_star(led).facts
    assert facts.count() == len(rows) and float(facts.agg(F.sum("amount")).first()[0]) == 163.0


def test_files_of_any_encoding_order_and_quoting(spark, tmpdir_path):
    def put(name, text, encoding):
        with open(os.path.join(tmpdir_path, name), "w", encoding=encoding, newline="") as f:
            f.write(text)
    put("a.csv", "Date,Département\n2024-01-01,Ventes été\n", "utf-8")
    put("b.csv", "Département,Date\nabc,2024-01-02\n", "latin-1")
    put("c.csv", 'Date,Département\n2024-01-03,"x ""q"" y"\n2024-01-04,"two\nlines, here"\n', "utf-8")
    put("d.csv", "Date,Département\n2024-01-05,mark \ufffd kept é\n", "utf-8")
    put("e.csv", "Date,Département\n2024-01-06,hôtel\n", "latin-1")
    df = read_ledger_csv(spark, f"{tmpdir_path}/*.csv")
    assert df.columns == ["Date", "Département"]
    assert {r["Date"]: r["Département"] for r in df.collect()} == {
        "2024-01-01": "Ventes été", "2024-01-02": "abc", "2024-01-03": 'x "q" y', "2024-01-04": "two\nlines, here",
        "2024-01-05": "mark \ufffd kept é", "2024-01-06": "hôtel"}


def test_written_quotes_come_back(spark, tmpdir_path):
    df = spark.createDataFrame([('a "b" c', " x "), ("1\n2", None)], "a string, b string")
    write_ledger_csv(df, f"{tmpdir_path}/w")
    assert sorted(map(tuple, read_ledger_csv(spark, f"{tmpdir_path}/w/*.csv").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_stream_matches_columns_by_name_and_records_failures(spark, tmpdir_path):
    from ledgerflow.streaming.uploads import read_star, start_upload_loader
    up, star, hist, ck = (os.path.join(tmpdir_path, x) for x in ("up", "star", "hist", "ck"))
    os.makedirs(up)
    order = ["Montant", *(c for c in REQUIRED_COLUMNS if c != "Montant")]
    row = dict(zip(REQUIRED_COLUMNS, ["2024-01-05", "DEPT001", "Département", "Revenu", "", "100", "Ann", "Client", "P1"]))
    with open(os.path.join(up, "good.csv"), "w", encoding="latin-1") as f:
        f.write(",".join(order) + "\n" + ",".join(row[c] for c in order) + "\n")
    start_upload_loader(spark, up, star, hist, ck).awaitTermination(120)
    with open(os.path.join(up, "bad.csv"), "w", encoding="utf-8") as f:
        f.write("a,b\n1,2\n")
    start_upload_loader(spark, up, star, hist, ck).awaitTermination(120)
    facts = read_star(spark, star).facts.collect()
    assert [float(r["amount"]) for r in facts] == [100.0]
    audit = {r["file_name"]: r for r in spark.read.parquet(hist).collect()}
    assert audit["good.csv"]["status"] == "succes" and audit["good.csv"]["n_rows"] == 1 and "Ann" in audit["good.csv"]["data"]
    assert audit["bad.csv"]["status"] == "echec" and "Colonnes manquantes" in audit["bad.csv"]["details"][0]


def test_amounts_keep_their_digits_until_they_are_stored(spark):
    df = spark.createDataFrame([("1.0049",), ("9999999999999999.99",), ("-0,005",), ("1.00499999",)], "a string")
    got = [(str(r["p"]), str(r["s"])) for r in df.select(M.parse_amount("a").alias("p"), F.round(M.parse_amount("a"), 2).alias("s")).collect()]
    assert got == [("1.004900", "1.00"), ("9999999999999999.990000", "9999999999999999.99"), ("-0.005000", "-0.01"), ("1.004999", "1.00")]


@pytest.mark.parametrize("texts, day_first", [(["13/02/2024", "05/03/2024"], True), (["02/13/2024", "05/03/2024"], False),
                                              (["05/03/2024", "01/02/2024"], False), ([None, "x"], False)])
def test_one_order_of_day_and_month_for_an_upload(spark, texts, day_first):
    df = spark.createDataFrame([(t,) for t in texts], "date_raw string")
    assert D.detect_day_first(df) is day_first
    got = [r[0] for r in df.select(D.parse_date("date_raw", D.date_formats(day_first))).collect()]
    if "05/03/2024" in texts:
        assert got[texts.index("05/03/2024")] == (dt.date(2024, 3, 5) if day_first else dt.date(2024, 5, 3))


def test_times_behind_a_date(spark):
    texts = ["2024-01-05T10:00:00.123", "2024-01-05 10:00", "2024/1/5 1:02:03", "05.01.2024", "2024-01-05T10:00:00Z",
             "2024-01-05T10:00:00+01:00", "20240105", "01/05/24", "5 Jan 2024", "5-jan-2024", "January 5, 2024", "Jan 5 2024 10:00", "05.01.24", "2024-01-05 noon"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(D.parse_date("t")).collect()] == [dt.date(2024, 1, 5)] * (len(texts) - 1) + [None]
    old = spark.createDataFrame([("05/01/69",), ("05/01/68",), ("20241305",), ("5 Foo 2024",), ("99 Jan 2024",)], "t string")
    got = [r[0] for r in old.select(D.parse_date("t", D.date_formats(True))).collect()]
    assert got == [dt.date(1969, 1, 5), dt.date(2068, 1, 5), None, None, None]


def test_json_values_keep_their_types(spark):
    df = spark.createDataFrame([(1, '[{"b": 1, "a": true, "c": {"x": 1.5}, "d": null}]')], "id long, data string")
    full = df.select("*", *(F.lit(None).cast("string").alias(c) for c in ("file_name", "status", "department", "imported_by")),
                     F.lit(None).cast("timestamp").alias("imported_at"), F.lit(1).alias("n_rows"), F.lit(0).alias("n_errors"))
    r = H.history_detail(full).first()
    assert r["columns"] == ["b", "a", "c", "d"] and r["preview"] == '[{"b":1,"a":true,"c":{"x":1.5},"d":null}]'


def test_json_safe_microseconds_and_lists(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1, 2, 3, 45), [1.0, float("nan")]), (dt.datetime(2024, 1, 1), None)],
                               "t timestamp, l array<double>")
    assert [tuple(r) for r in J.json_safe(df).collect()] == [("2024-01-01T01:02:03.000045", [1.0, None]), ("2024-01-01T00:00:00", None)]


EMPTY = ("id long, kpi_name string, period string, value double, evolution double, department_id long, source string, "
         "stat_type string, created_at timestamp_ntz, updated_at timestamp_ntz")


def test_a_plain_batch_is_saved_in_its_order(spark):
    batch = spark.createDataFrame([("A", "p", 1.0), ("B", "p", 2.0), ("A", "p", 3.0)], "kpi_name string, period string, value double").coalesce(1)
    store, counts = S.merge_kpis(spark.createDataFrame([], EMPTY), batch, True, dt.datetime(2024, 1, 1))
    assert sorted((r["id"], r["kpi_name"], r["value"]) for r in store.collect()) == [(1, "B", 2.0), (2, "A", 3.0)]
    assert tuple(counts.first()) == (3, 1)


def test_an_unfinished_version_is_not_read(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "kpi")
    S.write_version(spark.createDataFrame([(1,)], "id long"), base)
    os.makedirs(os.path.join(base, "v000002"))
    assert S.read_current(spark, base).first()["id"] == 1


def test_legacy_cleaner_keeps_the_company_and_compares_parsed_dates(spark):
    rows = [("Soc", "2024-1-5", "D1", "d", "Revenu", None, "1", "o", "c", "p"), ("Soc", "2024-01-05", "D1", "d", "Revenu", None, "1", "o", "c", "p")]
    names = ["Entreprise", "Date", "DepartementID", "Département", "TypeTransaction", "TypeDépense", "Montant", "Responsable",
             "Client_Fournisseur", "Projet"]
    df = C.upload_to_ledger(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)))
    out = C.legacy_clean(df).collect()
    assert len(out) == 1 and out[0]["company"] == "Soc"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_stored_tables_are_pruned_and_filtered(spark):
    from ledgerflow.plans import catalog as Q
    from tests.conftest import SF_SMALL
    plan = _plan(Q.QUERIES["period_filter"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(txn_date), GreaterThanOrEqual(txn_date" in plan
    assert "counterparty" not in plan.split("ReadSchema")[1].split("\n")[0]
    for name in ("kpi_lookup", "kpi_keyword_total", "message_intent"):
        assert "expense_type" not in _plan(Q.QUERIES[name](spark, SF_SMALL)), name


def test_single_parts_aggregate_their_own_key(spark):
    from ledgerflow.plans import catalog as Q
    from tests.conftest import SF_SMALL
    base = Q.kpi_base2(spark, SF_SMALL)
    whole = R.refresh_kpis(base)
    for part, fn in enumerate([R.refresh_global, R.refresh_quarter, R.refresh_department, R.refresh_txn_type,
                               R.refresh_expense_type, R.monthly_evolution]):
        own = fn(base)
        assert sorted(map(str, own.collect())) == sorted(map(str, whole.where(F.col("part") == part).collect()))
