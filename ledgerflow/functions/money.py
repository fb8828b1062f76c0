"""Money columns: parsing, signing, rounding. All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.schemas import EXPENSE_TYPES, LEGACY_REVENUE, LEGACY_SIGN_LABELS, MONEY


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_amount(col) -> Column:
    """Free-text amount -> DECIMAL (``MONEY``), null when it does not parse.

    A comma becomes a dot, every character other than digits, dot and minus goes (currency
    signs and whitespace among them); what is left is cast with ``try_cast`` so that
    ``1,234.56`` (two dots), ``5-`` or ``n/d`` give null instead of an error.
    """
    s = F.replace(_c(col).cast("string"), F.lit(","), F.lit("."))
    s = F.regexp_replace(s, r"[^0-9.\-]+", "")
    # Digits past those that are kept are cut, not rounded: rounding happens once, when a fact is stored.
    return F.regexp_replace(s, r"(\.[0-9]{6})[0-9]+$", "$1").try_cast(MONEY)


def signed_amount(amount, txn_type, rule: str = "abs") -> Column:
    """Signed amount.

    ``rule="abs"``: expense types (``depense``/``dépense`` after trim + lower) give
    ``-abs(amount)``, everything else ``abs(amount)``.
    ``rule="legacy"``: exactly ``Revenu`` keeps the value, anything else negates it.
    Null amount gives null.
    """
    a, t = _c(amount), _c(txn_type)
    if rule == "abs":
        # The usual spellings are known without lower-casing, which is slow for text with accents.
        text = F.coalesce(t, F.lit(""))
        is_expense = text.isin(*EXPENSE_TYPES, *(e.capitalize() for e in EXPENSE_TYPES)) | F.lower(F.trim(text)).isin(*EXPENSE_TYPES)
        return F.when(a.isNull(), F.lit(None).cast(MONEY)) \
            .when(is_expense, -F.abs(a)).otherwise(F.abs(a)).cast(MONEY)
    if rule == "legacy":
        return F.when(a.isNull(), F.lit(None).cast(MONEY)) \
            .when(t == F.lit(LEGACY_REVENUE), a).otherwise(-a).cast(MONEY)
    raise ValueError(f"unknown sign rule {rule!r}")


def sign_label(txn_type) -> Column:
    """Legacy cleaner label: ``Positif`` for exactly ``Revenu``, ``Négatif`` otherwise."""
    t = _c(txn_type)
    return F.when(F.coalesce(t == F.lit(LEGACY_REVENUE), F.lit(False)), F.lit(LEGACY_SIGN_LABELS[0])) \
        .otherwise(F.lit(LEGACY_SIGN_LABELS[1]))


def revenue_part(signed) -> Column:
    s = _c(signed)
    return F.when(s > 0, s).otherwise(F.lit(0).cast(MONEY))


def expense_part(signed) -> Column:
    """Positive expense contribution of a signed amount."""
    s = _c(signed)
    return F.when(s < 0, -s).otherwise(F.lit(0).cast(MONEY))
