"""Ordered computations against plain Python, with keys that reach over many ranges and chunks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from riskspan.operators.ordered import ranked, rolling_least
from riskspan.operators.selection import at_rank


def test_ranks_of_hot_null_and_single_keys(spark):
    rng = random.Random(5)
    rows = [("hot", rng.randrange(10**6), i) for i in range(4_000)] + [(None, rng.randrange(50), 10_000 + i) for i in range(300)]
    rows += [(f"k{i % 97}", rng.randrange(20), 20_000 + i) for i in range(1_000)]
    df = spark.createDataFrame(rows, "k string, v long, id long")
    got = ranked(df, ["k"], ["v", "id"], "r", parts=13).collect()
    want = {}
    for k in {r[0] for r in rows}:
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]), 1):
            want[i] = n
    assert {r["id"]: r["r"] for r in got} == want and len(got) == len(rows)


def test_ranks_without_a_key_with_ties_and_of_nothing(spark):
    df = spark.createDataFrame([(i // 7,) for i in range(500)], "v long")
    assert sorted(r["r"] for r in ranked(df, [], ["v"], "r", parts=9).collect()) == list(range(1, 501))
    assert ranked(df.where("v < 0"), [], ["v"], "r").count() == 0


def _walk(n, seed, step=60, wiggle=1):
    rng = random.Random(seed)
    at, out = 1_700_000_000, []
    for _ in range(n):
        out.append((at, round(rng.gauss(0, 1), 3)))
        at += step * rng.choice([1, 1, 1, 2, wiggle])
    return out


@pytest.mark.parametrize("width", [60, 3_600, 50_000, 10_000_000])
def test_rolling_least(spark, width):
    rows = [(k, t, v) for k, seed in (("a", 1), ("b", 2)) for t, v in _walk(300, seed, wiggle=40)]
    got = {(r["k"], r["t"]): r["low"] for r in rolling_least(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", width, "v", "low").collect()}
    assert got == {(k, t): min(w for j, u, w in rows if j == k and t - width <= u <= t) for k, t, _ in rows}


def test_rolling_least_takes_no_more_time_for_wider_windows(spark):
    """A frame that is scanned anew for each row costs rows times width: 168 times more here."""
    df = spark.range(200_000).selectExpr("'s' AS k", "id * 60 AS t", "cast(hash(id) AS double) AS v").cache()
    df.count()
    took = []
    for minutes in (60, 60, 10_080):
        began = time.perf_counter()
        rolling_least(df, ["k"], "t", minutes * 60, "v", "low").write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    df.unpersist()
    assert took[2] < 8 * took[1] + 2


@pytest.mark.parametrize("digit", [2, 5, 16])
def test_selection_by_rank(spark, digit):
    rng = random.Random(6)
    rows = [("hot", rng.randrange(-(10**6), 10**6)) for _ in range(3_000)] + [("same", 7)] * 500 + [("one", -5), ("none", None), ("two", 1), ("two", None), ("two", 9)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r["k"]: (r["n"], r["m"]) for r in at_rank(df, ["k"], "v", lambda n: F.floor(n / 2), "m", digit).collect()}
    values = {k: sorted(v for j, v in rows if j == k and v is not None) for k in ("hot", "same", "one", "two")}
    assert got == {k: (len(v), v[len(v) // 2]) for k, v in values.items()}
    assert at_rank(df.where("v > 10000000"), ["k"], "v", lambda n: n - 1, "m").count() == 0
