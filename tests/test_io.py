"""Sources and sinks: CSV encoding fallback, export lines, versioned store, streaming loads."""

import os

from pyspark.sql import functions as F

from ledgerflow.operators import store as S
from ledgerflow.operators import users as U
from ledgerflow.schemas import EXPORT_HEADER, REQUIRED_COLUMNS
from ledgerflow.sources import binding as B
from ledgerflow.sources.ledger_csv import preview, read_ledger_csv, stage
from ledgerflow.sources.tables import write_lines
from tests.conftest import SF_SMALL


def test_csv_utf8_then_latin1(spark, tmpdir_path):
    a, b = os.path.join(tmpdir_path, "a.csv"), os.path.join(tmpdir_path, "b.csv")
    with open(a, "w", encoding="utf-8") as f:
        f.write("Date,Département\n2024-01-01,Ventes été\n")
    with open(b, "w", encoding="latin-1") as f:
        f.write("Date,Département\n2024-01-02,Achats hôtel\n")
    got = sorted(r["Département"] for r in read_ledger_csv(spark, [a, b]).collect())
    assert got == ["Achats hôtel", "Ventes été"]


def test_preview_and_stage(spark):
    df = B.ledger_raw(spark, SF_SMALL)
    cols, n, first = preview(df, 5)
    assert cols[0] == "date_raw" and n > 5 and first.count() == 5
    assert stage(df, first, "after") is first


def test_export_lines_written_with_header(spark, tmpdir_path):
    lines = U.export_lines(B.users(spark, SF_SMALL))
    path = os.path.join(tmpdir_path, "export")
    write_lines(lines, path, header=EXPORT_HEADER)
    text = []
    for name in sorted(n for n in os.listdir(path) if n.startswith("part-")):
        with open(os.path.join(path, name), encoding="utf-8") as f:
            text += f.read().splitlines()
    assert text[0] == EXPORT_HEADER and len(text) == lines.count() + 1
    assert text[1:] == [r.line for r in lines.collect()]


def test_versioned_store(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "kpi")
    df1 = spark.createDataFrame([(1, "A")], "id long, kpi_name string")
    S.write_version(df1, base)
    S.write_version(S.read_current(spark, base).withColumn("id", F.col("id") + 1), base)
    assert S.read_current(spark, base).first().id == 2


def test_streaming_upload_loader(spark, tmpdir_path):
    from ledgerflow.streaming.uploads import read_star, start_upload_loader
    up = os.path.join(tmpdir_path, "uploads")
    os.makedirs(up)
    header = ",".join(REQUIRED_COLUMNS)
    rows1 = ["2024-01-05,DEPT001,Ventes,Revenu,,100,Ann,Client A,P1",
             "2024-01-06,DEPT001,Ventes,Dépense,Achat,-40,Ann,Fourn B,P1"]
    with open(os.path.join(up, "u1.csv"), "w", encoding="utf-8") as f:
        f.write(header + "\n" + "\n".join(rows1) + "\n")
    star_base = os.path.join(tmpdir_path, "star")
    hist = os.path.join(tmpdir_path, "history")
    ck = os.path.join(tmpdir_path, "ck")
    q = start_upload_loader(spark, up, star_base, hist, ck, replace=False)
    q.awaitTermination(120)
    star = read_star(spark, star_base)
    assert star.facts.count() == 2
    with open(os.path.join(up, "u2.csv"), "w", encoding="utf-8") as f:
        f.write(header + "\n2024-02-01,DEPT001,Ventes,Revenu,,10,Bob,Client C,P2\n")
    q = start_upload_loader(spark, up, star_base, hist, ck, replace=False)
    q.awaitTermination(120)
    star = read_star(spark, star_base)
    assert star.facts.count() == 3
    assert star.dims["dim_owner"].count() == 2
    assert spark.read.parquet(hist).count() == 2


def test_streaming_replace_mode(spark, tmpdir_path):
    from ledgerflow.streaming.uploads import read_star, start_upload_loader
    up = os.path.join(tmpdir_path, "uploads")
    os.makedirs(up)
    header = ",".join(REQUIRED_COLUMNS)
    with open(os.path.join(up, "u1.csv"), "w", encoding="utf-8") as f:
        f.write(header + "\n2024-01-05,DEPT001,Ventes,Revenu,,100,Ann,Client A,P1\n"
                "2024-01-06,DEPT001,Ventes,Revenu,,5,Ann,Client A,P1\n")
    star_base, hist, ck = (os.path.join(tmpdir_path, x) for x in ("star", "history", "ck"))
    start_upload_loader(spark, up, star_base, hist, ck).awaitTermination(120)
    with open(os.path.join(up, "u2.csv"), "w", encoding="utf-8") as f:
        f.write(header + "\n2024-02-01,DEPT001,Ventes,Revenu,,10,Bob,Client C,P1\n")
    start_upload_loader(spark, up, star_base, hist, ck).awaitTermination(120)
    star = read_star(spark, star_base)
    facts = star.facts.collect()
    assert [(r.transaction_id, float(r.amount)) for r in facts] == [(1, 10.0)]
    assert star.dims["dim_date"].count() == 3


def test_write_star_round_trip(spark, tmpdir_path):
    from ledgerflow.operators import clean as C
    from ledgerflow.plans import etl_load as E
    from ledgerflow.sources.tables import write_star
    star = E.rebuild_star(C.clean_valid(B.ledger_raw(spark, SF_SMALL)))
    base = os.path.join(tmpdir_path, "star")
    write_star(star.tables(), base)
    for name, df in star.tables().items():
        back = spark.read.parquet(os.path.join(base, name))
        assert back.count() == df.count(), name
        assert back.exceptAll(df.select(*back.columns)).count() == 0, name
