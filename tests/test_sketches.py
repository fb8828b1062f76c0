"""Stored sketches against exact values."""

import bisect
import random

from pyspark.sql import functions as F

from ledgerflow.operators import sketches as S
from ledgerflow.session import materialize


def test_distinct_counts_of_any_range(spark):
    r = random.Random(4)
    rows = [(r.randrange(60), r.randrange(40_000) if r.random() > 0.01 else None) for _ in range(80_000)]
    df = spark.createDataFrame(rows, "day int, user int")
    daily = materialize(S.distinct_sketches(df, {"day": F.col("day")}, "user"))
    weekly = {x["week"]: x["n_distinct"] for x in S.distinct_counts(daily, {"week": F.floor(F.col("day") / 7)}).collect()}
    whole = S.distinct_counts(daily.where("day >= 3"), {}).first()["n_distinct"]
    for week, n in weekly.items():  # below the entries of a sketch: exact
        assert n == len({u for d, u in rows if d // 7 == week and u is not None})
    exact = len({u for d, u in rows if d >= 3 and u is not None})
    assert exact > 30_000 and abs(whole - exact) < 4 * exact / 2 ** (S.LG_ENTRIES / 2)
    assert S.distinct_counts(daily.limit(0), {"day": F.col("day")}).count() == 0


def test_quantiles_of_merged_sketches(spark):
    r = random.Random(5)
    rows = [(r.randrange(24), r.choice("ab"), r.lognormvariate(3, 2) if r.random() > 0.01 else None) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "month int, dep string, amount double")
    monthly = materialize(S.quantile_sketches(df, {"month": F.col("month"), "dep": F.col("dep")}, F.col("amount")))
    ranks = [0.01, 0.25, 0.5, 0.9, 0.99]
    for x in S.quantiles(monthly, {"dep": F.col("dep")}, ranks).collect():
        values = sorted(v for _, d, v in rows if d == x["dep"] and v is not None)
        assert x["n"] == len(values)
        for q, v in zip(ranks, x["quantiles"]):
            low, high = bisect.bisect_left(values, v) / len(values), bisect.bisect_right(values, v) / len(values)
            assert low - 0.02 <= q <= high + 0.02
    small = S.quantiles(S.quantile_sketches(df.where("month = 0").limit(50), {}, F.col("amount")), {}, [0.0, 1.0]).first()
    values = [x["amount"] for x in df.where("month = 0").limit(50).collect() if x["amount"] is not None]
    assert small["quantiles"] == [min(values), max(values)]  # few values: exact
