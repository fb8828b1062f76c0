"""Rows of a load as places in the order of their dimensions, so that the joins and the ordering of facts shuffle little.

A member's place is its rank among the members of its dimension in the order of their names, so places compare as the names do. A
row's names are replaced by places while it lies where it was read: dimensions whose measured size is small go to every task,
and their places are packed into one or more BIGINTs by the bits that the number of members asks for. Only a dimension that
is not small costs a shuffle of the rows, which then hold those numbers, the names of the large dimensions and the amount. Ids of small
dimensions are looked up again after the rows are dealt to their ranges, before they are sorted.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import joins
from ledgerflow.operators.ids import ordered_table, read_numbered
from ledgerflow.schemas import MONEY
from ledgerflow.session import mark_stored, materialize

# Dimensions in the order in which they order ledger rows: (table, columns of its key, id).
ORDERED_BY = [("dim_date", ["date"], "date_id"), ("dim_department", ["department"], "department_id"), ("dim_txn_type", ["txn_type"], "txn_type_id"),
              ("dim_expense_type", ["expense_type"], "expense_type_id"), ("dim_owner", ["owner", "department"], "owner_id"),
              ("dim_counterparty", ["counterparty"], "counterparty_id"), ("dim_project", ["project"], "project_id")]
BITS = 63  # of a BIGINT that is never negative
SIGN = "sign"


@dataclass
class Members:
    """A dimension's members with their ``place`` (1, 2, ...)."""
    id_col: str
    key: list[str]
    rows: DataFrame
    number: int
    small: bool


@dataclass
class Places:
    """How to read the places of narrow rows."""
    members: dict[str, Members]
    fields: dict[str, tuple[str, int, int]]  # name -> column, lowest bit, bits
    upload: str | None

    def field(self, name: str) -> Column:
        column, low, bits = self.fields[name]
        return F.shiftrightunsigned(F.col(column), low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    def place(self, name: str) -> Column:
        return self.field(name) if name in self.fields else F.coalesce(F.col(f"_place_{name}"), F.lit(0).cast("long"))

    def signed(self) -> Column:
        """The signed amount: the amount, the negative of it, or a number of its own."""
        sign = self.field(SIGN)
        return F.when(sign == 0, F.col("amount")).when(sign == 1, (-F.col("amount")).cast(MONEY)).otherwise(F.col("_signed"))

    def order(self) -> list[Column]:
        """What orders the rows as their names, exact and signed amounts do. Rows equal on all of it give equal facts."""
        first = [self.field(self.upload)] if self.upload else []
        return [*first, *(self.place(name) for name in self.members), F.col("amount"), self.signed()]

    def with_ids(self, rows: DataFrame) -> DataFrame:
        """The ids of the dimensions that are small, by broadcast joins: every row stays where it is."""
        for name, m in self.members.items():
            if name in self.fields:
                ids = m.rows.select(F.col("_place").alias("_of"), m.id_col)
                rows = rows.join(F.broadcast(ids), self.field(name) == F.col("_of"), "left").drop("_of")  # measured
        return rows


def _members(dim: DataFrame, key: list[str], id_col: str) -> Members:
    rows = read_numbered(*ordered_table(dim.select(*key, id_col), key), "_place")
    number, size = joins.dimension_size(rows)
    return Members(id_col, key, rows, number, number <= joins.DIM_BROADCAST_MAX_ROWS and size <= joins.DIM_BROADCAST_MAX_BYTES)


def _packed(widths: dict[str, int]) -> dict[str, tuple[str, int, int]]:
    """Fields in order, each in the first column that has room for it."""
    columns: list[list[str]] = [[]]
    for name, bits in widths.items():
        if sum(widths[n] for n in columns[-1]) + bits > BITS:
            columns.append([])
        columns[-1].append(name)
    fields = {}
    for k, names in enumerate(columns):
        low = sum(widths[n] for n in names)
        for n in names:
            low -= widths[n]
            fields[n] = (f"_places_{k}", low, widths[n])
    return fields


def place_rows(ledger: DataFrame, dims: dict[str, DataFrame], strict: bool = True, owner_by_name: bool = False,
               upload: str | None = None) -> DataFrame:
    """The rows of a load, stored as places, exact amounts and a ``resolved`` flag; :func:`places` says how to read them.

    For dimensions that hold every name of the rows, and for ``strict`` loads, whose rows without one of the ids give no fact. ``strict``:
    resolved means every id was found; lenient: only a missing date id drops the row. ``upload``: a column that
    comes first in the order and is kept (a small number).
    """
    keys = {name: key for name, key, _ in ORDERED_BY}
    if owner_by_name or "department" not in dims["dim_owner"].columns:
        keys["dim_owner"] = ["owner"]
    with ThreadPoolExecutor(max_workers=len(ORDERED_BY)) as pool:  # small jobs side by side
        built = pool.map(lambda d: _members(dims[d[0]], keys[d[0]], d[2]), ORDERED_BY)
        members = dict(zip(keys, built))
    widths = {}
    if upload:
        widths[upload] = max(1, int(ledger.agg(F.coalesce(F.max(upload), F.lit(0)).cast("long")).first()[0]).bit_length())
    widths |= {name: max(1, m.number.bit_length()) for name, m in members.items() if m.small} | {SIGN: 2}
    how = Places(members, _packed(widths), upload)

    columns = dict.fromkeys([*([upload] if upload else []), *(c for m in members.values() for c in m.key if c != "date"), "amount", "signed_amount"])
    df = ledger.select(F.col("txn_date").alias("date"), *columns)
    found = {name: F.col(f"_place_{name}") for name in members}

    def with_place(rows: DataFrame, name: str, small: bool) -> DataFrame:
        m = members[name]
        place = F.when(F.col(m.id_col).isNotNull(), F.col("_place")) if strict else F.col("_place")
        side = m.rows.select(*m.key, place.alias(f"_place_{name}"), *([] if small else [m.id_col]))
        return rows.join(F.broadcast(side), m.key, "left") if small else joins.dim_join(rows, side, m.key)

    for name in (n for n, m in members.items() if m.small):
        df = with_place(df, name, True)
    amount, signed_amount = F.col("amount").cast(MONEY), F.col("signed_amount").cast(MONEY)
    sign = F.when(signed_amount.eqNullSafe(amount), 0).when(signed_amount.eqNullSafe((-amount).cast(MONEY)), 1).otherwise(2)
    values = {**found, SIGN: sign} | ({upload: F.col(upload)} if upload else {})
    packed = {}
    for name, (column, low, _) in how.fields.items():
        shifted = F.shiftleft(F.coalesce(values[name].cast("long"), F.lit(0).cast("long")), low)
        packed[column] = packed[column].bitwiseOR(shifted) if column in packed else shifted
    large = [n for n, m in members.items() if not m.small]
    names = dict.fromkeys(c for n in large for c in members[n].key)
    df = df.select(*(c.alias(n) for n, c in packed.items()), *names, amount.alias("amount"),
                   F.when(sign == 2, signed_amount).alias("_signed"))
    for name in large:  # the rows are narrow now
        df = with_place(df, name, False)
    needed = [how.place(n) > 0 for n in (members if strict else ["dim_date"])]
    resolved = needed[0]
    for test in needed[1:]:
        resolved = resolved & test
    kept = [*packed, *(c for n in large for c in (f"_place_{n}", members[n].id_col)), "amount", "_signed"]
    first = [how.field(upload).cast(dict(ledger.dtypes)[upload]).alias(upload)] if upload else []
    return as_placed(mark_stored(materialize(df.select(*kept, resolved.alias("resolved"))).select(*first, *kept, "resolved")), how)


def as_placed(df: DataFrame, how: Places | None) -> DataFrame:
    df._lf_places = how
    return df


def places(df: DataFrame) -> Places | None:
    """How rows of :func:`place_rows` are read; None for any other rows."""
    return getattr(df, "_lf_places", None)
