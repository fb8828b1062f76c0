"""Round 3's findings, third pass: the cleaned rows are stored narrow, records with line ends are put together where they lie."""

from pyspark.sql import functions as F

from ledgerflow.functions import text as T
from ledgerflow.operators import clean as C
from ledgerflow.plans import catalog as Q
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001


def _stored_columns(spark, df) -> set[str]:
    return set(spark.read.parquet(*sorted({f.rpartition("/")[0] for f in df.inputFiles()})).columns)


def test_cleaned_rows_are_stored_without_what_follows_from_them(spark):
    """And read as the cleaner gives them, types included."""
    cleaned, raw = Q.cleaned(spark, SF_SMALL), Q.raw_ordered(spark, SF_SMALL)
    assert not set(C.derived_columns()) & _stored_columns(spark, cleaned)
    direct = C.clean_ledger(raw, with_copies=True)
    assert dict(cleaned.dtypes) == dict(direct.dtypes) and cleaned.columns == direct.columns
    assert cleaned.exceptAll(direct).count() == 0 and direct.exceptAll(cleaned).count() == 0


def test_a_column_of_the_ledger_is_read_alone(spark):
    plan = Q.ledger(spark, SF_SMALL).select("expense_type")._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "ReadSchema: struct<expense_type:string>" in plan


def test_normalised_text_needs_no_column_beside_it(spark):
    texts = ["  a b\t", " \x1c ", "", "x", "a  b", "　", "​", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize_text("t").alias("n"))
    assert "_common_expr" not in _plan(df)
    assert [r[0] for r in df.collect()] == [" ".join(t.split()) or None if t is not None else None for t in texts]


def test_derived_columns_of_a_rejected_row(spark):
    row = {"date_raw": "x", "department_code": "D", "department": " ", "txn_type": "Revenu", "expense_type": None, "amount_raw": "1,5", "owner": "o",
           "counterparty": "c", "project": "p"}
    raw = spark.createDataFrame([row], ", ".join(f"{c} string" for c in row))
    got = C.clean_ledger(raw, day_first=False).select("reasons", "year", F.col("signed_amount").cast("double")).first()
    assert tuple(got) == (["txn_date", "department"], None, 1.5)


def test_records_with_line_ends_over_many_blocks(spark, tmpdir_path):
    """Records of one line, of several and over several blocks, as the parser has them for whole files."""
    from ledgerflow.sources.ledger_csv import read_ledger_csv

    for name, shift in (("a", 0), ("b", 3)):
        lines = ["x,y"]
        for i in range(18):
            k = (i + shift) % 6
            lines.append({0: f"{i},plain", 1: f'{i},"two\nlines"', 2: f'"{i}","a ""q""\n\n, {"long " * 30}\nend"', 3: f'{i},"one, line"',
                          4: f'{i},"{chr(10) * 40}"', 5: f'"{i}\n",z'}[k])
        with open(f"{tmpdir_path}/{name}.csv", "w", encoding="utf-8", newline="") as f:
            f.write("\n".join(lines) + "\n")
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmpdir_path}/*.csv").collect()
    for size in ("150", "128MB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = read_ledger_csv(spark, f"{tmpdir_path}/*.csv", ordinal=True).orderBy("ordinal").select("x", "y").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len(got) == 36 and got == want


def test_lines_are_dealt_by_block_once(spark, tmpdir_path):
    from ledgerflow.sources.ledger_csv import read_records

    with open(f"{tmpdir_path}/a.csv", "w", encoding="utf-8", newline="") as f:
        f.write('x,y\n1,"a\nb"\n2,c\n3,"d\ne"\n')
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        records = read_records(spark, [f"{tmpdir_path}/a.csv"], True, False, ["x", "y"])
        plan = records._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        assert sorted((r._r.x, r._r.y) for r in records.collect()) == [("1", "a\nb"), ("2", "c"), ("3", "d\ne")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len([line for line in plan.splitlines() if "FileScan parquet" in line and "value#" in line]) == 1
