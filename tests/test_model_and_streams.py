"""Router, cache, fail-fast and pair analysis; streaming forms against batch ones."""

import hashlib
import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from riskspan.operators import keyed_store, model, tables
from riskspan.operators import prompts as P
from riskspan.operators import rules as R
from riskspan.operators import series as S
from riskspan.streaming import series as live

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks do not import test modules


class Scripted:
    """A provider that answers by a function of the prompt; limits and failures as asked."""

    available = True

    def __init__(self, name, answer, limited=0):
        self.name, self.answer, self.limited, self.model = name, answer, limited, "m"

    def complete(self, system, user, temperature):
        if self.limited:
            self.limited -= 1
            raise model.RateLimited("HTTP 429")
        text = self.answer(system, user, temperature)
        return model.Reply(text, self.name, "m") if text else model.Reply("", self.name, "m", "HTTP 500: down")


def test_providers_retry_and_fall_through():
    good = Scripted("good", lambda *a: "yes")
    assert model.complete([Scripted("limited", lambda *a: "later", 2), good], "", "", 0, 4, 0).provider == "limited"
    assert model.complete([Scripted("limited", lambda *a: "later", 9), good], "", "", 0, 3, 0).provider == "good"
    assert model.complete([Scripted("down", lambda *a: ""), good], "", "", 0, 3, 0).provider == "good"
    gone = model.complete([Scripted("down", lambda *a: "")], "", "", 0, 3, 0)
    assert (gone.ok, gone.provider, gone.error) == (False, "none", "HTTP 500: down")


def test_endpoint_replies(monkeypatch):
    import io
    import urllib.error

    end = model.ChatEndpoint("e", "http://x/v1", "m")
    body = lambda content, finish="stop": io.BytesIO(json.dumps({"choices": [{"message": {"content": content}, "finish_reason": finish}]}).encode())
    monkeypatch.setattr(model.urllib.request, "urlopen", lambda *a, **k: body("hello"))
    assert end.complete("s", "u", 0.1).text == "hello"
    monkeypatch.setattr(model.urllib.request, "urlopen", lambda *a, **k: body("", "length"))
    assert "empty content (finish_reason=length" in end.complete("s", "u", 0.1).error
    monkeypatch.setattr(model.urllib.request, "urlopen", lambda *a, **k: io.BytesIO(b"{}"))
    assert end.complete("s", "u", 0.1).error.startswith("KeyError")

    def fails(code):
        def run(*a, **k):
            raise urllib.error.HTTPError("u", code, "m", None, None)

        return run

    monkeypatch.setattr(model.urllib.request, "urlopen", fails(429))
    with pytest.raises(model.RateLimited):
        end.complete("s", "u", 0.1)
    monkeypatch.setattr(model.urllib.request, "urlopen", fails(400))
    assert end.complete("s", "u", 0.1).error == "HTTP 400"
    assert model.ChatEndpoint("e", "http://x", "m", "NO_SUCH_KEY_HERE").available is False


def test_cache_and_fail_fast(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "s", "a", 0.0), (2, "s", "a", 0.0), (3, "s", "b", 0.5)], "id int, system string, user string, temperature double")
    cache = str(tmp_path / "cache")
    provider = Scripted("p", lambda s, u, t: f"{u}{t}" if u == "a" else "")
    first = {r["id"]: r for r in model.ask(prompts, [provider], cache, backoff=0).collect()}
    assert (first[1]["text"], first[2]["text"], first[3]["error"]) == ("a0.0", "a0.0", "HTTP 500: down") and not first[1]["cached"]
    assert keyed_store.runs(spark, cache)[0] == 1
    again = {r["id"]: r for r in model.ask(prompts, [Scripted("p", lambda s, u, t: "new")], cache, backoff=0).collect()}
    assert again[1]["cached"] and again[1]["text"] == "a0.0" and again[3]["text"] == "new" and not again[3]["cached"]
    many = spark.range(40).select(F.lit("s").alias("system"), F.col("id").cast("string").alias("user"), F.lit(0.0).alias("temperature")).coalesce(1)
    with pytest.raises(Exception, match="calls failed and none worked"):
        model.ask(many, [Scripted("down", lambda *a: "")], backoff=0, fail_fast=8)
    with pytest.raises(RuntimeError, match="no usable provider"):
        model.ask(many, [])


RULES = [R.Rule("V1", layer="implementation", must_call=("mint(",), title="Mint", severity="critical"), R.Rule("V2", layer="economic", must_call=("rate",), must_lack=("cap",), title="Rate")]


def _slices(spark, codes):
    rows = [(str(i), "p", "C", f"f{i}()", "", "(none extracted)", c) for i, c in enumerate(codes)]
    return spark.createDataFrame(rows, "id string, protocol string, contract string, signature string, solc_version string, context string, code string")


def test_offline_analysis_by_hand(spark):
    out = model.analyse(_slices(spark, ["  mint(rate);\nmore", "rate cap", "none"]), RULES, [model.Offline()])
    got = {(r["id"], r["class_id"]): r for r in out.collect()}
    assert set(got) == {("0", "V1"), ("0", "V2"), ("1", "V2")}
    one = got["0", "V1"]
    draw = random.Random(int(hashlib.sha256(("V1" + "\n  mint(rate);\nmore\n"[:200]).encode()).hexdigest()[:8], 16)).random()
    assert one["confidence"] == round(0.55 + 0.35 * draw, 2) and one["score"] == round(one["confidence"] * 0.6, 4) and one["detected"]
    assert (one["statements"], one["key_variables"], one["rubric"], one["severity"]) == (["mint(rate);"], ["mint("], "implementation", "high")
    two = got["1", "V2"]
    assert (two["detected"], two["confidence"], two["score"], two["severity"], two["rubric"], two["parse_failed"]) == (False, 0.0, 0.0, "low", None, False)


def test_auditors_critics_and_failures(spark):
    """The most confident matching auditor counts; a contradicting critic, prose and dead calls are told apart."""

    def answer(system, user, temperature):
        if '"correctness"' in system:
            return json.dumps({"correctness": 10, "profitability": 9, "severity": 8, "verdict": "rejected" if "contra" in user else "confirmed"})
        if "prose" in user:
            return "I think so."
        if "dead" in user:
            return ""
        return json.dumps({"property_match": True, "confidence": 0.4 if temperature < 0.5 else 0.8, "severity": "medium", "key_variables": ["k"] * 12, "attack_path": "x" * 1000})

    found = model.analyse(_slices(spark, ["mint( ok", "mint( contra", "mint( prose", "mint( dead"]), RULES[:1], [Scripted("s", answer)], model.Settings(auditors=3))
    got = {r["id"]: r for r in found.collect()}
    assert (got["0"]["confidence"], got["0"]["score"], got["0"]["detected"], len(got["0"]["key_variables"]), len(got["0"]["attack_path"])) == (0.8, round(0.8 * 27 / 30, 4), True, 10, 900)
    assert got["1"]["inconsistent"] and not got["1"]["detected"]
    assert got["2"]["parse_failed"] and got["2"]["provider_error"] == "" and not got["2"]["detected"]
    assert not got["3"]["parse_failed"] and got["3"]["provider_error"] == "HTTP 500: down" and got["3"]["provider"] is None
    plain = model.analyse(_slices(spark, ["mint( ok"]), RULES[:1], [Scripted("s", answer)], model.Settings(use_critic=False, auditors=1)).first()
    assert plain["score"] == round(0.4 * 25 / 30, 4) and plain["rubric"] is None


def test_prompts_hold_what_they_should(spark):
    slices = _slices(spark, ["mint(1)"])
    pairs = slices.withColumns({"class_id": F.lit("V1"), "passed": F.lit(True), "told": F.array(F.lit("suicidal"))})
    pool = spark.createDataFrame([("positive", "V1", "q", "g()", "c" * 2000, "{}"), ("negative", "V2", "r", "h()", "d", "{}"), ("positive", "V1", "p", "own()", "o", "{}")], "kind string, class_id string, protocol string, signature string, code string, verdict string")
    chosen = tables.exemplars(pool.select("kind", "class_id", "protocol", "signature"), pairs.select("protocol", "class_id"))
    shown = P.with_exemplars(pairs, chosen, pool).select(P.auditor_prompt(RULES, analyser="told", exemplars="exemplars").alias("u")).first()["u"]
    assert "## WORKED EXAMPLES\n### positive example: V1 in g()\n" + "c" * 900 + "\nanswer" in shown and "own()" not in shown and "negative example: V2" in shown
    assert "## STATIC ANALYSIS SIGNALS\nsuicidal" in shown and "static_precheck" not in shown and "compiler: unknown" in shown
    bare = pairs.select(P.auditor_prompt(RULES, scaffold=True).alias("u")).first()["u"]
    assert "WORKED" not in bare and "static_precheck: true\nmust_call_hint: mint(" in bare


def test_streamed_episodes_over_several_batches(spark, tmp_path):
    """Batches that cut runs, gaps and repeated instants; the last versions equal the batch operator."""
    rng = random.Random(3)
    rows = []
    for s in ("a", "b"):
        ts, value = 1_700_000_000, 1.0
        for _ in range(900):
            ts += rng.choice([60, 60, 60, 60, 60, 60, 600])
            value = rng.choice([value, value, value, 1.0, 0.97, 0.9, 0.7])
            rows.append((s, ts, value))
    rows.sort(key=lambda r: r[1])
    for k in range(6):
        spark.createDataFrame(rows[k * 300 : (k + 1) * 300], "series_id string, ts bigint, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, ts bigint, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.latest(live.run_available(live.episodes(stream, S.TIERS, 60, 3, 2), str(tmp_path / "run")))
    want = S.episodes(spark.createDataFrame(rows, "series_id string, ts bigint, value double"), S.TIERS, 3, 2, step_seconds=60)
    key = lambda df: sorted(tuple(r[c] for c in ("series_id", "kind", "start_ts", "end_ts", "duration_min", "min_value", "samples")) for r in df.collect())
    assert key(got) == key(want) and got.count() > 20


def test_streamed_warnings_with_late_and_repeated_rows_and_a_restart(spark, tmp_path):
    """Two runs on one checkpoint over six files; rows up to half an hour late, some again; equal to the batch operator up to the watermark."""
    from riskspan.streaming import warnings as W

    rng = random.Random(8)
    rows = []
    for s in ("a", "b", "c"):
        ts, value = 1_700_000_000, 1.0
        for _ in range(900):
            ts += rng.choice([60, 60, 60, 120])
            value = rng.choice([value, value, value, value, 1.0, 0.97, 0.9, 0.7])
            rows.append((s, ts, value))
    sent = sorted([(ts + rng.choice([0, 0, 900, 1_799]), s, ts, v) for s, ts, v in rows] + [(ts + 600, s, ts, v) for s, ts, v in rows if ts % 7 == 0])
    schema = "series_id string, ts bigint, value double"
    size = -(-len(sent) // 6)
    options = {"minutes": 4, "warmup_hours": 2, "every_minutes": 10}
    for part in (range(0, 3), range(3, 6)):
        for k in part:
            df = spark.createDataFrame([r[1:] for r in sent[k * size : (k + 1) * size]], schema).withColumn("time", F.timestamp_seconds("ts")).drop("ts")
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("series_id string, value double, time timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = live.run_available(W.alerts(stream, 60, late_minutes=30, **options), str(tmp_path / "run"))
    known = spark.createDataFrame([r for r in rows if r[1] <= max(r[1] for r in rows) - 1_800], schema)
    want = S.alerts(known, None, step_seconds=60, **options)
    key = lambda df: sorted((r["series_id"], r["ts"], r["state"], tuple(r["reasons"])) for r in df.collect())
    assert key(got) == key(want) and got.count() > 20


def test_an_idle_series_starts_anew(spark, tmp_path):
    """After the idle time its counters are gone: the warm-up begins again, and nothing is judged in it."""
    from riskspan.streaming import warnings as W

    day, t0 = 86_400, 1_700_000_000
    batches = [[("a", t0 + 60 * i, 0.5) for i in range(10)], [("b", t0 + 9 * day, 1.0)], [("b", t0 + 10 * day, 1.0)], [("a", t0 + 11 * day + 60 * i, 0.5) for i in range(4)], [("b", t0 + 20 * day, 1.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "series_id string, ts bigint, value double").withColumn("time", F.timestamp_seconds("ts")).drop("ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, value double, time timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for days, fired in ((5, 1), (30, 1)):
        out = live.run_available(W.alerts(stream, 60, warmup_hours=0, every_minutes=1, late_minutes=1, idle_days=days), str(tmp_path / f"run{days}"))
        found = [r["ts"] for r in out.where("series_id = 'a'").collect()]
        assert len(found) == (2 if days == 5 else 1), found
