"""The keyed store: look-ups, runs, filters, compaction, and what is read."""

import hashlib

import pytest
from pyspark.sql import functions as F

from riskspan.operators import keyed_store as K


def _key(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def _rows(spark, ids, text):
    return spark.createDataFrame([(_key(i), f"{text}{i}") for i in ids], "key string, text string")


def test_runs_filters_and_compaction(spark, tmp_path):
    folder = str(tmp_path / "store")
    asked = spark.createDataFrame([(_key(i),) for i in (1, 5, 5, 250, 999, 1_000)] + [(None,)], "key string")
    assert K.lookup(asked, folder) is None and K.missing(asked.dropna(), folder).count() == 5
    K.append(_rows(spark, range(200), "a"), folder)
    K.append(_rows(spark, range(100, 300), "b"), folder)
    K.append(_rows(spark, [], "c"), folder)
    assert K.runs(spark, folder)[0] == 2
    want = {_key(1): "a1", _key(5): "a5", _key(250): "b250"}
    both = spark.createDataFrame([(_key(150),)], "key string")
    for _ in range(2):  # in two runs and in one
        assert {r.key: r.text for r in K.lookup(asked, folder).collect()} == want
        assert [r.text for r in K.lookup(both, folder).collect()] == ["a150"]  # the oldest
        assert {r.key for r in K.missing(asked, folder).dropna().collect()} == {_key(999), _key(1_000)}
        K.compact(spark, folder)
        K.drop_old(spark, folder)
    assert len(K.runs(spark, folder)[1]) == 1 and len(list((tmp_path / "store/data").iterdir())) == 1


def test_the_filter_spares_prefixes_and_a_lost_race_fails(spark, tmp_path):
    folder = str(tmp_path / "store")
    K.append(_rows(spark, range(2_000), "a"), folder)
    name = K.runs(spark, folder)[1][0]
    others = spark.createDataFrame([(_key(i),) for i in range(5_000, 6_000)], "key string").withColumn("prefix", F.substring("key", 1, 2))
    held = spark.createDataFrame([(_key(i),) for i in range(1_000)], "key string").withColumn("prefix", F.substring("key", 1, 2))
    assert K._may_hold(others, folder, name).count() < 60 and K._may_hold(held, folder, name).count() == 1_000
    one = K.lookup(others.limit(1).select("key"), folder)
    assert one.count() == 0
    files = K.lookup(held.limit(1).select("key"), folder)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in files and "prefix" in files.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(Exception, match="exist"):
        K._commit(spark, folder, 1, ["lost"])
