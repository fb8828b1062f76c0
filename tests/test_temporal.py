"""As-of and overlap joins and stored pages against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators.pages import paged
from ledgerflow.operators.temporal import as_of_join, overlap_join

DAY = dt.date(2020, 1, 1)


def day(r, span=400):
    return DAY + dt.timedelta(days=r.randrange(span)) if r.random() > 0.05 else None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


@pytest.mark.parametrize("bin_days", [1, 10, 1000])
def test_as_of_join(spark, bin_days):
    r = random.Random(bin_days)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", "c", None]), day(r)) for i in range(600)]
    changes = [(r.choice(["hot", "hot", "b", "d", None]), day(r), f"v{i % 9}", i) for i in range(60)] + [("hot", None, "x", 1)]
    left = spark.createDataFrame(rows, "id int, k string, at date")
    right = spark.createDataFrame(changes, "k string, since date, v string, w int")
    out = as_of_join(left, right, ["k"], "at", "since", ["v", "w"], bin_days)

    def expected(k, at):
        found = [(s, v, w) for kk, s, v, w in changes if kk == k and k is not None and s is not None and at is not None and s <= at]
        return max(found)[1:] if found else (None, None)
    assert sorted(map(str, (tuple(x) for x in out.collect()))) == sorted(str((i, k, at, *expected(k, at))) for i, k, at in rows)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_as_of_join_of_nothing(spark):
    none = spark.createDataFrame([], "k string, at date")
    changes = spark.createDataFrame([("a", DAY, "v")], "k string, since date, v string")
    assert as_of_join(none, changes, ["k"], "at", "since", ["v"]).count() == 0
    rows = spark.createDataFrame([("a", DAY), ("a", DAY)], "k string, at date")
    assert [x["v"] for x in as_of_join(rows, changes.limit(0), ["k"], "at", "since", ["v"]).collect()] == [None, None]
    assert [x["v"] for x in as_of_join(rows, changes, ["k"], "at", "since", ["v"]).collect()] == ["v", "v"]


@pytest.mark.parametrize("bin_days", [1, 16, 1000])
def test_overlap_join(spark, bin_days):
    r = random.Random(bin_days)

    def spans(n, tag):
        out = []
        for i in range(n):
            a = day(r)
            out.append((f"{tag}{i}", r.choice(["hot", "hot", "b", None]), a, a and a + dt.timedelta(days=r.choice([0, 0, 3, 40, 200, -2]))))
        return out
    left, right = spans(120, "l"), spans(80, "r")
    frames = [spark.createDataFrame(x, "id string, k string, a date, b date") for x in (left, right)]
    out = overlap_join(*frames, ["k"], ("a", "b"), ("a", "b"), bin_days)
    good = [[x for x in side if None not in x and x[2] <= x[3]] for side in (left, right)]
    expected = sorted((x[0], y[0]) for x in good[0] for y in good[1] if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((p["left"]["id"], p["right"]["id"]) for p in out.collect()) == expected and len(expected) > 100
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_pages_at_any_depth(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k"), F.lit("x").alias("v"))
    pages = paged(df.repartition(7), ["k"], num_partitions=12)
    keys = sorted(i * 7919 % 10_007 for i in range(10_000))
    for number, size in ((1, 10), (2, 10), (500, 20), (501, 20), (4, 3_000), (0, 7), (-3, 7)):
        got = pages.page(number, size)
        first = (max(number, 1) - 1) * size
        assert [x["k"] for x in got.collect()] == keys[first:first + size]
    stored = set(pages.rows.inputFiles())
    assert len(stored) == 12 and len(stored & set(pages.page(700, 10).inputFiles())) <= 2
    assert pages.total() == 10_000 and pages.page(10_000, 10).count() == 0
    assert paged(df.limit(0), ["k"]).page(1, 10).count() == 0
