"""Text columns: missing tokens, whitespace normalising, encoding repair, e-mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.schemas import NULL_TOKENS

# Python's str.split() whitespace: Unicode White_Space plus the four separators
# U+001C..U+001F. Java's plain \s is ASCII only, hence the (?U) flag.
_WS = r"(?U)[\s\x{1c}-\x{1f}]+"
# Text that collapsing leaves as it is: visible characters with single blanks between them. No whitespace lies in the two
# ranges (U+0085, U+00A0 and U+1680 are outside), and plain ranges are matched faster than Unicode classes.
_TIDY = r"^[!-~\x{a1}-\x{167f}]++(?: [!-~\x{a1}-\x{167f}]++)*+\z"
_VISIBLE = r"(?U)[^\s\x{1c}-\x{1f}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_whitespace(col) -> Column:
    """Collapse whitespace runs to one space and trim; only text that has such runs is rewritten."""
    s = _c(col).cast("string")
    return F.when(s.rlike(_TIDY), s).otherwise(F.trim(F.regexp_replace(s, _WS, " ")))


def normalize_text(col) -> Column:
    """Collapse whitespace runs to one space, trim, and turn empty into null.

    Text is empty then if it has no visible character. Asked beforehand, this needs no second column for each text beside the row, as a
    comparison of the collapsed text would.
    """
    s = _c(col).cast("string")
    return F.when(s.rlike(_TIDY), s).when(s.rlike(_VISIBLE), F.trim(F.regexp_replace(s, _WS, " ")))


def null_token(col) -> Column:
    """Null when the whole value is one of the CSV missing-value tokens."""
    c = _c(col)
    return F.when(c.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def null_tokens(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Apply :func:`null_token` to every string column (or the given ones)."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: null_token(c) for c in cols})


def _ascii(c: Column) -> Column:
    """Only one-byte characters: Latin-1 and UTF-8 agree on them, so that a repair changes nothing."""
    return F.is_valid_utf8(c) & (F.octet_length(c) == F.length(c))


def repairable_mojibake(col) -> Column:
    """True when ``col`` is Latin-1-encodable and those bytes are valid UTF-8.

    ``encode`` raises on a character outside Latin-1, so it only ever sees values
    that passed the Latin-1 test (the inner CASE guards it).
    """
    c = _c(col)
    latin1 = c.rlike(r"^[\x{00}-\x{FF}]*$")
    guarded = F.when(latin1, c)
    return F.when(c.isNull(), F.lit(None).cast("boolean")) \
        .when(_ascii(c), F.lit(True)) \
        .when(latin1, F.is_valid_utf8(F.encode(guarded, "ISO-8859-1").cast("string"))) \
        .otherwise(F.lit(False))


def repair_mojibake_value(col) -> Column:
    """Latin-1 bytes read back as UTF-8 (``DÃ©partement`` -> ``Département``)."""
    c = _c(col)
    return F.when(_ascii(c), c).otherwise(F.decode(F.encode(c, "ISO-8859-1"), "UTF-8"))


def normalize_email(col) -> Column:
    return F.lower(F.trim(_c(col)))


def email_user(col) -> Column:
    """Part of the address before ``@``."""
    return F.substring_index(_c(col), "@", 1)
