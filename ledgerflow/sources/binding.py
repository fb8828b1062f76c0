"""Bindings of the application's tables onto the driver's TPC-H-like test data.

The rules are fixed (see FIXTURES.md §5): the ledger upload is the line items
joined to their order, customer, nation, supplier and part, with dirt added by
rule; users come from the event stream, import history from orders, messages from
conversations. Every frame is lazy and grows with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators.joins import DIM_BROADCAST_MAX_BYTES, DIM_BROADCAST_MAX_ROWS, dimension_size
from ledgerflow.sources.tables import read_table

def ledger_raw(spark: SparkSession, sf_dir: str, ordinal: bool = False) -> DataFrame:
    """The dirty ledger upload, all columns as strings (``LEDGER_RAW`` schema).

    ``ordinal`` adds the place of a row in the upload, which lists line items by order and line
    (so not by date), a repeated row right behind its original.

    Join order: the line items, the biggest input, meet part (and supplier, unless its measured size is small enough for it to be sent to
    every task at the end) while they are narrow, and only what a row shows is carried on; their
    orders, joined to customer and the 25-row nation table first (nation is broadcast: its size
    is fixed by definition), come last.
    Exact duplicates are injected with ``explode`` in the same pass instead of a
    second scan and a union.
    """
    # An expense shows part and supplier, a revenue (0) its customer. While it is shuffled a line's amount is a number, and its number, day and kind
    # are one: 33 bits, 28 (every day of a timestamp) and 2, where 0 is no number and no day.
    flag, spent = F.col("l_returnflag"), F.col("l_line").bitwiseAND(3) != 0
    kind = F.when(flag == "N", 0).when(flag == "A", 1).otherwise(2)
    day = F.coalesce(F.unix_date(F.col("l_shipdate").cast("date")) + F.lit(1 << 27), F.lit(0))
    number = F.coalesce(F.col("l_linenumber").cast("long") + F.lit((1 << 31) + 1), F.lit(0))
    line = F.shiftleft(number, 30).bitwiseOR(F.shiftleft(day.cast("long"), 2)).bitwiseOR(kind.cast("long"))
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("l_amount"), line.alias("l_line"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")

    ocn = (orders.join(customer, orders.o_custkey == customer.c_custkey)
           .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
           .select("o_orderkey", "c_name", "n_nationkey", "n_name"))
    narrow = li.join(part, li.l_partkey == part.p_partkey).drop("l_partkey", "p_partkey").withColumn("p_type", F.when(spent, F.col("p_type")))
    suppliers, size = dimension_size(supplier)
    few = suppliers <= DIM_BROADCAST_MAX_ROWS and size <= DIM_BROADCAST_MAX_BYTES
    if not few:
        narrow = narrow.join(supplier, narrow.l_suppkey == supplier.s_suppkey).drop("l_suppkey", "s_suppkey").withColumn("s_name", F.when(spent, F.col("s_name")))
    # Line items x orders is a fact-to-fact join: a shuffle join on the order key at every scale, whose tasks hash their part of the
    # orders and sort nothing. Left to size estimates, a small test set makes the
    # planner broadcast the line items and stream single-file orders in one task.
    base = narrow.join(ocn.hint("shuffle_hash"), narrow.l_orderkey == ocn.o_orderkey)
    if few:
        base = base.join(F.broadcast(supplier), F.col("l_suppkey") == F.col("s_suppkey"))

    days, lines = F.shiftright("l_line", 2).bitwiseAND((1 << 28) - 1), F.shiftrightunsigned("l_line", 30)
    base = base.select("*", F.when(days > 0, F.date_from_unix_date((days - (1 << 27)).cast("int"))).alias("l_shipdate"),
                       F.when(lines > 0, lines - ((1 << 31) + 1)).cast("int").alias("l_linenumber"), F.col("l_line").bitwiseAND(3).alias("l_kind"))
    k, ln = F.col("l_orderkey"), F.col("l_linenumber")
    amt = F.col("l_amount").cast("string")
    tt = F.when(F.col("l_kind") == 0, F.lit("Revenu")).when(F.col("l_kind") == 1, F.lit("Dépense")).otherwise(F.lit("depense"))
    nn = F.col("n_name")
    dirty = base.select(
        F.when(k % 89 == 0, F.lit("pas une date"))
         .otherwise(F.col("l_shipdate").cast("string")).alias("date_raw"),
        F.concat(F.lit("DEPT"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 3, "0")).alias("department_code"),
        F.when(ln == 2, F.concat(F.lit("  "), F.replace(nn, F.lit("_"), F.lit("  ")), F.lit(" ")))
         .otherwise(F.replace(nn, F.lit("_"), F.lit(" "))).alias("department"),
        tt.alias("txn_type"),
        F.when(tt == "Revenu", F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("expense_type"),
        F.when(k % 97 == 0, F.lit("n/d"))
         .when(ln % 4 == 0, F.replace(amt, F.lit("."), F.lit(",")))
         .when(ln % 4 == 1, F.concat(F.lit("€ "), amt))
         .when(ln % 4 == 2, F.concat(F.lit("-"), amt, F.lit(" $")))
         .otherwise(amt).alias("amount_raw"),
        F.when(k % 103 == 0, F.lit("   "))
         .otherwise(F.concat(F.lit("Owner "), (F.col("o_orderkey") % 40).cast("string"))).alias("owner"),
        F.when(tt == "Revenu", F.col("c_name")).otherwise(F.col("s_name")).alias("counterparty"),
        F.col("p_brand").alias("project"),
        (k * 8 + ln).cast("long").alias("ordinal"),
        F.explode(F.when(k % 101 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    placed = dirty.withColumn("ordinal", F.col("ordinal") * 2 + F.col("_copy"))
    return placed.drop("_copy") if ordinal else placed.drop("_copy", "ordinal")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users derived from the event stream: one per ``user_id``, created at its first event.

    Names and e-mails are made up by rule; some are left empty so that every
    display-name fallback is exercised.
    """
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts")
    u = ev.groupBy("user_id").agg(F.min("ts").alias("created_at"))
    i = F.col("user_id")
    return u.select(
        i.alias("id"),
        F.when(i % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("Prenom"), i.cast("string"))).alias("firstname"),
        F.when(i % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("Nom"), i.cast("string"))).alias("lastname"),
        F.when(i % 11 == 0, F.lit(None))
         .otherwise(F.concat(F.lit("user"), i.cast("string"), F.lit("@example.org"))).alias("email"),
        F.when(i % 50 == 0, F.lit("admin")).alias("role"),
        F.when(i % 3 == 0, F.lit("google")).when(i % 3 == 1, F.lit(None)).otherwise(F.lit("email")).alias("login_type"),
        F.col("created_at"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User activity stream: ``(user_id, ts)`` from events."""
    return read_table(spark, sf_dir, "events").select("user_id", "ts")


def import_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import audit rows derived from orders (``IMPORT_HISTORY`` schema).

    ``data`` holds a JSON array of 0 to 6 row objects, as the application stores
    an import's cleaned rows.
    """
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    n_errors = (k % 4)
    n_rows = F.floor(F.col("o_totalprice") / 100).cast("long")
    row_obj = F.struct(k.alias("order"), F.col("o_orderstatus").alias("status"),
                       F.col("o_orderpriority").alias("priority"))
    failed = F.col("o_orderstatus") == "F"
    return o.select(
        k.alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("import_"), k.cast("string"), F.lit(".csv")).alias("file_name"),
        F.col("o_orderdate").alias("imported_at"),
        n_rows.alias("n_rows"),
        n_errors.alias("n_errors"),
        F.when(failed, F.lit("echec")).when(n_errors > 0, F.lit("partiel")).otherwise(F.lit("succes")).alias("status"),
        F.col("o_orderpriority").alias("department"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit(None))
         .otherwise(F.concat(F.lit("importer"), (F.col("o_custkey") % 17).cast("string"))).alias("imported_by"),
        F.array(F.concat(F.lit("rows "), n_rows.cast("string")),
                F.concat(F.lit("errors "), n_errors.cast("string"))).alias("details"),
        F.to_json(F.array_repeat(row_obj, (k % 7).cast("int"))).alias("data"),
        failed.alias("failed"),
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored forecasts derived from events; ``results`` is the event's JSON text."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("type"),
        F.to_date("ts").alias("start_date"),
        F.date_add(F.to_date("ts"), 30).alias("end_date"),
        F.col("props").alias("results"),
        ((F.col("user_id") % 25) + 1).cast("int").alias("department_id"),
        F.col("user_id").alias("created_by"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
