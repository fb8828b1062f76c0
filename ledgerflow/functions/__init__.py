"""Column-level functions. Every function returns a JVM ``Column`` expression."""

from ledgerflow.functions.calendar import calendar_columns, parse_date, ts_label, with_calendar
from ledgerflow.functions.jsonval import finite_or_null, json_safe, to_json_record
from ledgerflow.functions.labels import (
    counterparty_kind, department_id, display_name, expense_category, import_status,
    login_type_or_default, role_or_default,
)
from ledgerflow.functions.money import (
    expense_part, parse_amount, revenue_part, sign_label, signed_amount,
)
from ledgerflow.functions.text import (
    email_user, normalize_email, normalize_text, null_token, null_tokens,
)

__all__ = [
    "calendar_columns", "parse_date", "ts_label", "with_calendar",
    "finite_or_null", "json_safe", "to_json_record",
    "counterparty_kind", "department_id", "display_name", "expense_category", "import_status",
    "login_type_or_default", "role_or_default",
    "expense_part", "parse_amount", "revenue_part", "sign_label", "signed_amount",
    "email_user", "normalize_email", "normalize_text", "null_token", "null_tokens",
]
