"""Golden cases for users, history and keyword answers."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.operators import assistant as A
from ledgerflow.operators import history as H
from ledgerflow.operators import kpi as K
from ledgerflow.operators import users as U

USERS = "id long, firstname string, lastname string, email string, role string, login_type string, " \
        "created_at timestamp_ntz"


def _users(spark):
    rows = [(1, "Ann", "Lee", "ann@x.org", "admin", "google", dt.datetime(2024, 1, 2, 9, 0)),
            (2, None, None, "bob@x.org", None, None, dt.datetime(2024, 1, 1, 9, 0)),
            (3, "Cy", None, None, "user", "", dt.datetime(2023, 12, 1, 9, 0)),
            (4, "Di", "Nom4", "di@x.org", None, "email", dt.datetime(2023, 12, 27, 0, 0))]
    return spark.createDataFrame(rows, USERS)


def test_user_stats_one_pass(spark):
    r = U.user_stats(_users(spark), dt.datetime(2024, 1, 2, 18, 0)).first()
    assert tuple(r) == (4, 1, 3, 1, 3, 1)


def test_export_lines_print_none(spark):
    lines = [r.line for r in U.export_lines(_users(spark)).collect()]
    assert lines[1] == "2,None,None,bob@x.org,user,email,2024-01-01 09:00"


def test_paging(spark):
    page = U.search_users(_users(spark), "X.ORG", page=2, per_page=2)
    assert [r.id for r in page.collect()] == [4]
    t = U.search_total(_users(spark), "x.org", per_page=2).first()
    assert (t.total, t.pages) == (3, 2)


def test_message_intents_and_answers(spark):
    msgs = spark.createDataFrame([(1, "  "), (2, "Quel est le CA ?"), (3, "nos coûts"), (4, "combien de membres"),
                                  (5, "bonjour")], "id long, text string")
    kpis = spark.createDataFrame([("Revenus", 1234.5), ("Vol_Revenu", 10.0), ("Dépenses", 99.0)],
                                 "kpi_name string, value double")
    out = {r.id: (r.intent, r.answer) for r in A.answer_messages(msgs, kpis, _users(spark)).collect()}
    assert out[1] == ("empty", "Posez-moi une question sur vos données !")
    assert out[2] == ("revenue", "Le revenu total détecté est de 1,244.50 €.")
    assert out[3] == ("expense", "Les dépenses s'élèvent à 99.00 €.")
    assert out[4] == ("users", "Il y a actuellement 4 utilisateurs enregistrés.")
    assert out[5][0] == "help"


def test_keyword_total_is_case_and_accent_insensitive(spark):
    kpis = spark.createDataFrame([("DÉPENSES", 1.0), ("Dep_x", 2.0), ("depense_y", 4.0)], "kpi_name string, value double")
    assert A.kpi_keyword_total(kpis, "depense").first().total == 5.0


def test_history_groups_long_form(spark):
    h = spark.createDataFrame(
        [(1, 1, dt.datetime(2024, 1, 1)), (2, 1, dt.datetime(2024, 3, 1)), (3, 2, dt.datetime(2024, 2, 1)),
         (4, 9, dt.datetime(2024, 2, 1))],
        "id long, user_id long, imported_at timestamp_ntz").withColumns({
            "file_name": F.lit("f.csv"), "n_rows": F.lit(1).cast("long"), "n_errors": F.lit(0).cast("long"),
            "status": F.lit(None).cast("string"), "department": F.lit(None).cast("string"),
            "imported_by": F.lit(None).cast("string"), "details": F.array()})
    g = H.history_groups(H.history_with_users(h, _users(spark)))
    got = sorted((r.user_name, r.item_no, r.id, r.status) for r in g.collect())
    assert got == [("Ann Lee", 1, 2, "succes"), ("Ann Lee", 2, 1, "succes"), ("User 9", 1, 4, "succes"),
                   ("bob@x.org", 1, 3, "succes")]


def test_period_bounds():
    assert K.period_bounds("2024-05") == (dt.date(2024, 5, 1), dt.date(2024, 6, 1))
    assert K.period_bounds("2024-12") == (dt.date(2024, 12, 1), dt.date(2025, 1, 1))
    assert K.period_bounds("2024") == (dt.date(2024, 1, 1), dt.date(2025, 1, 1))
