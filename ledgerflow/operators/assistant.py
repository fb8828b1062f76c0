"""Keyword questions over messages, answered from stored KPI totals.

Re-aimed as a table job: every message of a message table gets its intent and
answer in one projection. The totals are global aggregates of the KPI store and
the user table, inlined as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.schemas import (
    ANSWER_EMPTY, ANSWER_EXPENSE, ANSWER_HELP, ANSWER_REVENUE, ANSWER_USERS, INTENT_RULES,
    KPI_KEYWORD_EXPENSE, KPI_KEYWORD_REVENUE,
)

CI_AI = "UNICODE_CI_AI"


def name_matches(col: str, keyword: str) -> Column:
    """Case- and accent-insensitive substring test (the store's SQL collation)."""
    return F.contains(F.collate(F.col(col), CI_AI), F.lit(keyword))


def kpi_keyword_total(kpis: DataFrame, keyword: str) -> DataFrame:
    """Sum of every stored KPI value whose name contains ``keyword`` (0 when none).

    Totals, per-type and other rows all match, so they add up together, as in the
    original query.
    """
    return kpis.agg(F.coalesce(F.sum(F.when(name_matches("kpi_name", keyword), F.col("value"))),
                               F.lit(0.0)).alias("total"))


def answer_totals(kpis: DataFrame, users: DataFrame) -> dict[str, Column]:
    """Revenue total, expense total and user count as scalar subqueries.

    Each is a global aggregate evaluated once and inlined into the message
    projection: no join, nothing collected to the driver.
    """
    def kw_sum(keyword: str) -> Column:
        return kpis.agg(F.sum(F.when(name_matches("kpi_name", keyword), F.col("value")))).scalar()

    return {"revenue_total": kw_sum(KPI_KEYWORD_REVENUE), "expense_total": kw_sum(KPI_KEYWORD_EXPENSE),
            "n_users": users.agg(F.count(F.lit(1))).scalar()}


def message_intent(text: Column) -> Column:
    """``empty`` / ``revenue`` / ``expense`` / ``users`` / ``help`` by ordered plain-substring rules."""
    # Whitespace of any kind counts as blank (a message of newlines is empty).
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", " ")))
    out = F.when(t == "", F.lit("empty"))
    for intent, words in INTENT_RULES:
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(t, F.lit(w))
        out = out.when(cond, F.lit(intent))
    return out.otherwise(F.lit("help"))


def _money_text(c: Column) -> Column:
    # A missing or zero total prints as 0; thousands commas, 2 decimals.
    return F.format_number(F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(0.0)), 2)


def answer_messages(messages: DataFrame, kpis: DataFrame, users: DataFrame, text_col: str = "text") -> DataFrame:
    """Each message with its intent and answer text."""
    totals = answer_totals(kpis, users)
    df = messages.withColumn("intent", message_intent(F.col(text_col)))
    rev = F.replace(F.lit(ANSWER_REVENUE), F.lit("{total}"), _money_text(totals["revenue_total"]))
    dep = F.replace(F.lit(ANSWER_EXPENSE), F.lit("{total}"), _money_text(totals["expense_total"]))
    usr = F.replace(F.lit(ANSWER_USERS), F.lit("{n}"), totals["n_users"].cast("string"))
    i = F.col("intent")
    answer = (F.when(i == "empty", F.lit(ANSWER_EMPTY)).when(i == "revenue", rev).when(i == "expense", dep)
              .when(i == "users", usr).otherwise(F.lit(ANSWER_HELP)))
    return df.select(*messages.columns, "intent", answer.alias("answer"))
