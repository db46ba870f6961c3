"""Episodes on hand-made series: dips, holes and slow prints."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from oracle import SMALL, assert_matches
from riskspan.operators import reports
from riskspan.operators import series as S
from riskspan.plans import series_queries as Q

T0 = 1_700_006_400


def _series(spark, values, step=60, at=None):
    rows = [("s", at[i] if at else T0 + i * step, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts long, value double")


@pytest.mark.parametrize(
    "low, before, dip, after, step, least, found",
    [
        (0.97, 4, 4, 6, 60, 1, 0),  # four minutes are under the five that count
        (0.97, 4, 5, 6, 60, 1, 1),
        (0.99, 4, 9, 6, 60, 1, 0),  # not below the threshold
        (0.5, 2, 1, 3, 7_200, 1, 1),  # one print every two hours
        (0.5, 2, 1, 3, 7_200, 2, 0),
        (0.5, 0, 2, 0, 7_200, 2, 1),  # the whole series
    ],
)
def test_a_dip_counts_by_its_minutes_and_samples(spark, low, before, dip, after, step, least, found):
    values = [1.002] * before + [low] * dip + [1.001] * after
    out = S.episodes(_series(spark, values, step), {"depeg": 0.99}, 5, least).collect()
    assert len(out) == found and all((r["samples"], r["min_value"]) == (dip, low) for r in out)


def test_a_hole_in_the_data_ends_an_episode(spark):
    at = [T0 + 60 * i for i in range(8)] + [T0 + 40_000 + 60 * i for i in range(9)]
    out = S.episodes(_series(spark, [0.9] * 17, at=at), {"depeg": 0.99}, 5, 1).collect()
    assert sorted((r["start_ts"], r["samples"]) for r in out) == [(T0, 8), (T0 + 40_000, 9)]


def test_empty_series(spark):
    assert S.episodes(_series(spark, []), {"depeg": 0.99}, 5, 1).count() == 0


def test_alert_texts(spark):
    from pyspark.sql import functions as F

    cases = [(0.7512, 0.61, 1.234, 0.81), (0.995, float("nan"), None, 0.7), (0.95, 0.5, 1.5, float("nan"))]
    df = spark.createDataFrame(cases, "low double, growth double, backing double, share double")
    got = [r[0] for r in df.select(S.reasons(F.col("low"), F.col("growth"), F.col("backing"), F.col("share"))).collect()]
    assert got == [["price touched 0.7512 (< 0.99)", "absorbing supply +61.0% in window", "backing ratio 1.23 < 1.5", "pool imbalance 81% > 70%"], [], ["price touched 0.9500 (< 0.99)"]]
    state = [r[0] for r in df.select(S.state_of(F.col("low"), F.col("growth"), F.col("backing"))).collect()]
    assert state == ["collapse", "normal", "stressed"]


def _runs(samples, threshold, step, limit=3):
    out, run = [], []
    for t, v in samples:
        if run and (v >= threshold or t - run[-1][0] > limit * step):
            out.append(run)
            run = []
        if v < threshold:
            run.append((t, v))
    return [*out, run] if run else out


@pytest.mark.parametrize("step", [None, 60])
def test_nested_thresholds_over_many_days_equal_plain_runs(spark, step):
    """Runs over several midnights, holes, equal thresholds and a threshold that nothing reaches, all in one pass."""
    rng = random.Random(12)
    tiers = {"a": 0.9, "b": 0.5, "same": 0.5, "c": 0.2, "never": -1.0}
    rows, want = [], []
    for s in range(6):
        at, level, samples = T0 + 17 * s, 0.5, []
        for _ in range(4_000):
            at += 300 if rng.random() < 0.99 else 20_000
            level = min(1.0, max(0.0, level + rng.gauss(0, 0.03)))
            samples.append((at, level))
        rows += [(f"s{s}", t, v) for t, v in samples]
        used = 300 if step is None else step
        for kind, threshold in tiers.items():
            for run in _runs(samples, threshold, used):
                if len(run) >= max(2, -(-300 // used)):
                    want.append((f"s{s}", kind, run[0][0], run[-1][0], max(1, (run[-1][0] - run[0][0] + used) // 60), min(v for _, v in run), len(run)))
    df = spark.createDataFrame(rows, "series_id string, ts long, value double")
    assert sorted(tuple(r) for r in S.episodes(df, tiers, step_seconds=step).collect()) == sorted(want)


def test_lead_times_equal_plain_counting_and_join_on_equality_only(spark):
    rng = random.Random(4)
    spans, warned, want = [], [], []
    for s in ("x", "y", "z"):
        at, prev = T0, None
        alerts = sorted({T0 + rng.randrange(40 * 86_400) for _ in range(300)}) if s != "z" else []
        for _ in range(60):
            start = at + rng.choice([60, 5_000, 90_000])
            at = start + rng.randrange(20_000)
            floor = max(start - 36_000, prev + 1 if prev else 0)
            near = [t for t in alerts if floor <= t < start]
            spans.append((s, start, at))
            want.append((s, start, at, (start - near[0]) // 60 if near else None, len(near)))
            prev = at
        warned += [(s, t) for t in alerts]
    found = S.lead_times(spark.createDataFrame(spans, "series_id string, start_ts long, end_ts long"), spark.createDataFrame(warned, "series_id string, ts long"), 600)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        found.explain("formatted")
    assert "NestedLoop" not in plan.getvalue() and "Join condition: None" in plan.getvalue() and not [x for x in plan.getvalue().splitlines() if "Join condition" in x and "None" not in x]


def test_the_lead_table_needs_no_product_of_tables(spark):
    from riskspan.operators import reports

    leads = spark.createDataFrame([("s", 10), ("s", 20), ("s", 40), ("t", None)], "series_id string, lead_minutes long")
    alerts = spark.createDataFrame([("s",)] * 7, "series_id string")
    spark.conf.set("spark.sql.crossJoin.enabled", "false")
    try:
        told = {r["metric"]: r["value"] for r in reports.lead(S.lead_summary(leads), alerts).collect()}
        none = {r["metric"]: r["value"] for r in reports.lead(S.lead_summary(leads.limit(0)), alerts.limit(0)).collect()}
    finally:
        spark.conf.unset("spark.sql.crossJoin.enabled")
    assert told == {"Alerts raised": "7", "Episodes": "4", "Episodes preceded by an alert": "3", "Episodes warned": "75.0%", "Median lead (minutes)": "20", "Look-back (minutes)": "2880"}
    assert none == told | {"Alerts raised": "0", "Episodes": "0", "Episodes preceded by an alert": "0", "Episodes warned": "—", "Median lead (minutes)": "—"}


def test_lead_times_of_the_whole_look_back(spark):
    sql = f"WITH {Q._S}, {Q._G}, {Q._LT.replace('36000', str(2_880 * 60))} SELECT * FROM lt"
    assert_matches(spark, lambda s, d: Q.leads_and_alerts(s, d, 2_880)[0], sql)
    leads, warned = Q.leads_and_alerts(spark, SMALL, 2_880)
    short, _ = Q.leads_and_alerts(spark, SMALL)
    counted = [x.agg(F.sum("admissible"), F.count("lead_minutes"), F.count(F.lit(1))).first() for x in (leads, short)]
    assert [tuple(r) for r in counted] == [(33, 6, 7), (5, 4, 7)]
    told = {r["metric"]: r["value"] for r in reports.lead(S.lead_summary(leads), warned).collect()}
    assert (told["Episodes preceded by an alert"], told["Median lead (minutes)"], told["Look-back (minutes)"]) == ("6", "2579", "2880")
