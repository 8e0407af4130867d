import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.operators.skew import heavy_keys, lower_median_rows


def brute(rows):
    groups = defaultdict(set)
    for k, v, w, i in rows:
        if None not in (k, v, w, i):
            groups[k, v].add((w, i))
    return {(k, *sorted(g)[(len(g) - 1) // 2]) for k, g in ((k, g) for k, g in groups.items())}


def run(spark, rows, share):
    df = spark.createDataFrame(rows, "k string, v string, w long, i long").withColumn("__h", F.lit("mine"))
    return {((r.k, r.v), r.w, r.i) for r in lower_median_rows(df, ["k", "v"], ["w", "i"], share).collect()}


@pytest.mark.parametrize("share", [0.001, 0.05, 0.9])
def test_equals_brute_force(spark, share):
    r = random.Random(1)
    rows = [(r.choice(["a"] * 6 + ["b", "c", None]), r.choice("xy"), r.choice([1, 1, 1, 2, 3, None]), r.randrange(400)) for _ in range(3000)]
    assert run(spark, rows + rows[:50], share) == brute(rows)


def test_one_key_holds_all_rows_with_ties(spark):
    rows = [("a", "x", 5, i) for i in range(1000)]
    assert run(spark, rows, 0.01) == {(("a", "x"), 5, 499)}


def test_empty(spark):
    assert run(spark, [], 0.01) == set()
    assert run(spark, [(None, None, None, None)], 0.01) == set()


def test_heavy_keys_are_bounded(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).cast("long").alias("h"))
    got = heavy_keys(df, "h", 0.01).collect()
    assert [r.h for r in got] == [1] and abs(got[0].rows - 4000) < 100
    with pytest.raises(ValueError):
        heavy_keys(df, "h", 1e-9)


def test_light_keys_are_ranked_by_a_sort_that_spills(spark):
    """Keys just under the share of heavy ones, with repeated rows; no aggregate gathers a key's rows."""
    r = random.Random(7)
    rows = [(k, "x", r.randrange(9), r.randrange(5000)) for k in "abcde" for _ in range(4000)]
    assert run(spark, rows + rows[::3], 0.25) == brute(rows)
    df = spark.createDataFrame(rows[:50], "k string, v string, w long, i long")
    plan = lower_median_rows(df, ["k", "v"], ["w", "i"], 0.25)._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and "Window" in plan
