"""Ordered scans equal plain windows, also when one key holds most rows and spans are small."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.operators import ordered as o


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}"
        data.append((key, i * rng.choice([1, 1, 3]) + i, i, rng.randrange(-20, 50), rng.random() < 0.2))
    return spark.createDataFrame(data, "k string, p long, t int, v long, f boolean").dropDuplicates(["k", "p"]).cache()


@pytest.mark.parametrize("span", [1, 13, 100_000])
def test_scan_equals_plain_window(rows, span):
    w = Window.partitionBy("k").orderBy("p")
    flagged = F.when(F.col("f"), F.col("v"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    plain = rows.select(
        "*", F.row_number().over(w).cast("long").alias("rn"), F.sum("v").over(w).alias("s"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("sx"), F.max("v").over(before).alias("m"),
        F.last(flagged, True).over(before).alias("l"), F.first(flagged, True).over(after).alias("n"),
        F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"),
        F.sum("v").over(Window.partitionBy("k")).alias("gs"), F.first("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("gf"),
    )
    plain = plain.withColumn("peak", F.max(F.when(F.col("f"), F.col("s"))).over(w))
    mine = o.scan(
        rows, ["k"], "p",
        {
            "rn": o.row_number(), "s": o.running_sum(F.col("v")), "sx": o.running_sum(F.col("v"), inclusive=False),
            "m": o.running_max(F.col("v"), inclusive=False), "l": o.last_value(flagged), "n": o.next_value(flagged),
            "lag": o.lag(F.col("v")), "lead": o.lead(F.col("v")), "gs": o.group_sum(F.col("v")), "gf": o.group_first(F.col("v")),
            "peak": o.running_peak(F.col("v"), F.col("f")),
        },
        span=span,
    )
    columns = plain.columns
    assert sorted(map(tuple, mine.select(columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_scan_does_not_put_a_key_into_one_partition(rows):
    plan = o.scan(rows, ["k"], "p", {"rn": o.row_number()}, span=10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and "__span" in plan


def test_spread_join_equals_join(spark, rows):
    small = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, x int")
    for how in ("left", "inner"):
        mine = o.spread_join(rows, small, ["k"], "p", how, span=10)
        plain = rows.join(small, ["k"], how)
        assert sorted(map(tuple, mine.select(plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
