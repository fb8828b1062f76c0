"""Derived labels and keys: department id, expense category, kinds, names, status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.schemas import (
    DEFAULT_LOGIN_TYPE, DEFAULT_ROLE, DISPLAY_NAME_FALLBACK, EXPENSE_CATEGORY_DEFAULT, EXPENSE_CATEGORY_RULES,
    KIND_CLIENT, KIND_SUPPLIER, MISSING_TEXT, REVENUE_TYPE, STATUS_FAILED, STATUS_OK, STATUS_PARTIAL,
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def department_id(code) -> Column:
    """Digits of a department code as BIGINT (``DEPT001`` -> 1); null when none."""
    digits = F.regexp_extract(_c(code), r"(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("long")


def _any_substring(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(text, F.lit(w))
    return cond


def expense_category(col) -> Column:
    """Ordered keyword rules on the lower-cased text; the first match wins."""
    t = F.lower(F.coalesce(_c(col).cast("string"), F.lit("none")))
    out = None
    for words, label in EXPENSE_CATEGORY_RULES:
        cond = _any_substring(t, words)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(EXPENSE_CATEGORY_DEFAULT))


def counterparty_kind(txn_type, exact: bool = False) -> Column:
    """``Client`` for a revenue transaction type, else ``Fournisseur``.

    ``exact=True`` is the full-rebuild test (exactly ``Revenu``); the default is
    the incremental loader's trimmed, case-insensitive test.
    """
    t = _c(txn_type)
    cond = (t == F.lit("Revenu")) if exact else (F.lower(F.trim(t)) == F.lit(REVENUE_TYPE))
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(KIND_CLIENT)).otherwise(F.lit(KIND_SUPPLIER))


def display_name(firstname, lastname, email, imported_by=None, user_id=None) -> Column:
    """First + last name, else e-mail, else importer, else ``User <id>``."""
    full = F.trim(F.concat_ws(" ", F.coalesce(_c(firstname), F.lit("")),
                              F.coalesce(_c(lastname), F.lit(""))))
    parts = [F.nullif(full, F.lit("")), F.nullif(_c(email), F.lit(""))]
    if imported_by is not None:
        parts.append(F.nullif(_c(imported_by), F.lit("")))
    if user_id is not None:
        user = F.coalesce(_c(user_id).cast("string"), F.lit(MISSING_TEXT))
        parts.append(F.concat(F.lit(DISPLAY_NAME_FALLBACK), user))
    return F.coalesce(*parts)


def import_status(n_errors, failed=None) -> Column:
    """``echec`` on failure, ``partiel`` with errors, ``succes`` otherwise."""
    out = F.when(F.coalesce(_c(n_errors), F.lit(0)) > 0, F.lit(STATUS_PARTIAL)).otherwise(F.lit(STATUS_OK))
    if failed is not None:
        out = F.when(F.coalesce(_c(failed), F.lit(False)), F.lit(STATUS_FAILED)).otherwise(out)
    return out


def login_type_or_default(col) -> Column:
    return F.coalesce(_c(col), F.lit(DEFAULT_LOGIN_TYPE))


def role_or_default(col) -> Column:
    return F.coalesce(_c(col), F.lit(DEFAULT_ROLE))
