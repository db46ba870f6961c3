"""Costly steps run once, on parts of one size, and send no more through Python than they must."""

import base64
import random
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from oracle import SMALL
from riskspan.operators import model, ordered
from riskspan.operators import rules as R
from riskspan.plans import code_queries as C
from riskspan.plans import report_queries as Q

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks do not import test modules

@pytest.mark.parametrize("query", [C.evaluation_overall, C.ranked_metrics, C.control_fp, C.run_summary, Q.run_table])
def test_an_evaluation_reads_written_findings(spark, query):
    plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "mapinarrow" not in plan.lower() and "run(" not in plan


def test_texts_become_strings_a_part_at_a_time():
    texts = pa.array(["x" * 1_000] * 5_000 + ["y" * (3 << 20)])
    ids = pa.array([str(i) for i in range(5_001)])
    parts = list(R._cut(ids, texts))
    assert sum((p[1] for p in parts), []) == texts.to_pylist() and sum((p[0] for p in parts), []) == ids.to_pylist()
    assert max(len(p[0]) for p in parts) < 1_000 and len(parts) > 3
    assert list(R._cut(pa.array([], pa.string()))) == []


def test_texts_do_not_come_back_from_python(spark):
    texts = spark.createDataFrame([(1, "call(a) the b"), (2, None), (3, "nothing")], "id long, code string")
    rules = [R.Rule("A", must_call=("call",), must_lack=("guard",)), R.Rule("B", must_call=("the ",), must_have_patterns=("[0-9]",))]
    out = R.static_baseline(texts, rules)
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["class_id"], r["detected"]) for r in out.collect()) == [(1, "A", True), (1, "B", False)]
    parted = R.static_baseline(texts, rules, most_bytes=1)
    assert sorted((r["id"], r["class_id"], r["detected"]) for r in parted.collect()) == [(1, "A", True), (1, "B", False)]


def test_a_larger_table_goes_to_more_tasks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert C._spread(docs).rdd.getNumPartitions() == cores
    monkeypatch.setattr(C, "SPREAD_BYTES", 10_000)
    assert C._spread(docs).rdd.getNumPartitions() > 2 * cores


def test_a_tree_of_files_has_more_files_for_more_tasks(spark, monkeypatch):
    seen, scan = [], Q.files.scan
    monkeypatch.setattr(Q.files, "scan", lambda s, root, *a, **k: seen.append(root) or scan(s, root, *a, **k))
    monkeypatch.setattr(C, "SPREAD_BYTES", 10_000)
    wanted = spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null and doc_id % 5 < 3").count()
    assert Q.file_scan(spark, SMALL).count() == wanted
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(seen[0]).count() > 100


def test_samples_that_wait_are_read_and_written_as_one():
    """A call of the state store for each sample made the time of a long series."""
    from riskspan.streaming.warnings import _Warner

    calls = []

    class Listed(list):
        def get(self):
            calls.append("get")
            return iter(tuple(self))

        def put(self, rows):
            calls.append("put")
            self[:] = rows

        def clear(self):
            self[:] = []

    class Counted:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

        def clear(self):
            self.row = None

    class Handle:
        timers: list = []

        def getListState(self, *_):
            return Listed()

        def getMapState(self, *_):
            raise AssertionError("a map is asked sample by sample")

        def getValueState(self, *_):
            return Counted()

        def listTimers(self):
            return tuple(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    import pandas as pd

    warner = _Warner({"depeg": 0.99, "severe": 0.95, "failure": 0.8}, 600, 2, 1, 86_400)
    warner.init(Handle())
    rows = pd.DataFrame({"ts": [60 * i for i in range(1_000)], "value": [1.0] * 500 + [0.9] * 500})
    assert list(warner.handleInputRows(("s",), iter([rows, rows.head(10)]), At(0))) == []
    fired = list(warner.handleExpiredTimer(("s",), At(1_000_000_000), None))
    assert [tuple(r) for f in fired for r in f.itertuples(index=False)] == [("s", 60 * 500, "active_depeg", 0.9)]
    assert len(calls) <= 8


RULES = [R.Rule("V1", layer="implementation", must_call=("mint(",)), R.Rule("V2", must_call=("rate",)), R.Rule("V3", must_call=("rate",))]


def _slices(spark, rows):
    return spark.createDataFrame([(i, "p", "C", "f()", "", "", c) for i, c in rows], "id string, protocol string, contract string, signature string, solc_version string, context string, code string")


def _moved(spark, run):
    """What run() returns, and the bytes that its stages shuffled, spilled and wrote."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found, out = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None).iterator(), {}
        while found.hasNext():
            s = found.next()
            out[s.stageId()] = s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes()
        return out

    before = stages()
    got = run()
    return got, sum(n for k, n in stages().items() if k not in before)


def test_an_analysis_moves_each_text_once(spark):
    """Texts are dealt and written once; prompts, which repeat a text for each class and attempt, are neither shuffled nor written."""
    draw = random.Random(17)
    codes = [(str(i), f"mint( rate {base64.b64encode(draw.randbytes(75_000)).decode()}") for i in range(30)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, moved = _moved(spark, lambda: model.analyse(_slices(spark, codes), RULES, [model.Offline()], model.Settings(parts=4)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == 90 and all(r["detected"] and r["calls"] == 2 for r in found)
    assert moved < 3 * sum(len(c) for _, c in codes)


def test_slices_of_one_id_are_apart(spark):
    found = model.analyse(_slices(spark, [("a", "mint( 1"), ("a", "mint( 2"), (None, "mint( 3")]), RULES[:1], [model.Offline()]).collect()
    assert sorted((r["id"], r["statements"], r["calls"], r["detected"]) for r in found) == [("a", ["mint( 1"], 2, True), ("a", ["mint( 2"], 2, True)]


class _Down:
    name, model, available = "down", "m", True

    def complete(self, system, user, temperature):
        return model.Reply("", "down", "m", "HTTP 500")


def test_a_dead_endpoint_stops_an_analysis_of_many_small_tasks(spark):
    with pytest.raises(Exception, match="calls failed and none worked"):
        model.analyse(_slices(spark, [(str(i), f"mint( {i}") for i in range(12)]), RULES[:1], [_Down()], model.Settings(parts=12))


def test_a_dealt_table_is_read_by_bucket_and_joined_where_it_lies(spark):
    rows = spark.range(1_000).withColumn("v", F.col("id") % 7)
    table = ordered.dealt(rows, 5, "id")
    assert table.count() == table.select("_row").distinct().count() == 1_000 and not [t for t in spark.catalog.listTables() if t.name.startswith("dealt_")]
    with ordered.by_bucket(spark):
        assert table.rdd.getNumPartitions() == 5
    assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == "true"
    plan = table.join(ordered.stored(rows.select("id", "v")).hint("shuffle_hash"), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
