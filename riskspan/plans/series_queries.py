"""Series queries over the events table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import bits_sql
from ..operators import series as S
from ..operators.ordered import stored
from ..session import scratch
from ..sources import archives as arc
from ..sources import series as src

#: Severities on the scale of the events' values.
TIERS = {"depeg": 35.0, "severe": 10.0, "failure": 5.0}
SYNTHETIC_START = 1_704_067_200
GRID = (35.0, 20.0, 10.0, 5.0, 0.5)
#: Minutes before a failure in which the queries' SQL counts alerts; the reference's are lead_times()'s own 2,880.
LOOKBACK = 600


def _series(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    return src.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), by)


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals of each series, dated at the start of the day."""
    daily = _series(spark, sf_dir).withColumn("ts", F.floor(F.col("ts") / S.DAY) * S.DAY)
    return daily.groupBy("series_id", "ts").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))


def series_dedup(spark, sf_dir):
    return _series(spark, sf_dir)


def series_median_step(spark, sf_dir):
    return S.median_step(S.gap_table(_series(spark, sf_dir, "user_id")))


def episodes(spark, sf_dir):
    return S.episodes(_series(spark, sf_dir, "user_id"), {"depeg": 35.0})


def episodes_tiers(spark, sf_dir):
    out = S.episodes(_series(spark, sf_dir), TIERS)
    return out.withColumns({"start_iso": src.iso_utc("start_ts"), "end_iso": src.iso_utc("end_ts")})


def episode_sensitivity(spark, sf_dir):
    return S.sensitivity(_series(spark, sf_dir), GRID)


def rolling_min_state(spark, sf_dir):
    return S.indicators(_series(spark, sf_dir), None, TIERS, minutes=60).select("series_id", "ts", "value", "low", "deviation", "state")


def supply_growth_asof(spark, sf_dir):
    return S.supply_growth(_supply(spark, sf_dir))


def _alerts(spark, sf_dir):
    return S.alerts(_series(spark, sf_dir), _supply(spark, sf_dir), TIERS, minutes=60, every_minutes=60)


def early_warning_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "; "))


def _pool(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Of each series' days, dated at their start: total over forty times the samples, as backing ratio, and the largest value's
    share of the total of the hour that holds most, as imbalance."""
    hourly = _series(spark, sf_dir).withColumn("hour", F.floor(F.col("ts") / 3_600)).groupBy("series_id", "hour").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"))
    day = (F.floor(F.col("hour") / 24) * S.DAY).alias("ts")
    daily = hourly.groupBy("series_id", day).agg((F.sum(F.col("total").cast("decimal(18,4)")).cast("double") / (40 * F.sum("n"))).alias("backing"), F.max(F.try_divide("most", "total")).alias("imbalance"))
    return tuple(daily.select("series_id", "ts", F.col(c).alias("value")) for c in ("backing", "imbalance"))


def pool_alerts(spark, sf_dir):
    """Early warnings with all four reasons: price, supply, backing ratio and pool imbalance."""
    backing, imbalance = _pool(spark, sf_dir)
    out = S.alerts(_series(spark, sf_dir), _supply(spark, sf_dir), TIERS, minutes=60, every_minutes=60, backing=backing, imbalance=imbalance)
    return out.withColumn("reasons", F.array_join("reasons", "; "))


def leads_and_alerts(spark, sf_dir, lookback_minutes: int = LOOKBACK) -> tuple[DataFrame, DataFrame]:
    """Lead times of the failures and the alerts behind them, which are written once for all who read them."""
    gaps = S.gap_table(_series(spark, sf_dir))
    steps = stored(S.median_step(gaps))
    failures = S.episodes(gaps, {"failure": TIERS["failure"]}, gaps=gaps, steps=steps)
    warned = stored(S.alerts(gaps, _supply(spark, sf_dir), TIERS, minutes=60, every_minutes=60, gaps=gaps, steps=steps))
    return S.lead_times(failures, warned, lookback_minutes), warned


def _leads(spark, sf_dir):
    return leads_and_alerts(spark, sf_dir)[0]


def lead_time(spark, sf_dir):
    return _leads(spark, sf_dir)


def lead_time_pooled(spark, sf_dir):
    return S.lead_summary(_leads(spark, sf_dir))


def lead_time_by_series(spark, sf_dir):
    return S.lead_summary(_leads(spark, sf_dir), ["series_id"])


def episode_kind_counts(spark, sf_dir):
    return S.kind_counts(S.episodes(_series(spark, sf_dir), TIERS), list(TIERS))


def severe_events(spark, sf_dir):
    return S.severe_only(S.episodes(_series(spark, sf_dir), TIERS))


def best_view(spark, sf_dir):
    """Each event type seen per event and per hour (the hour's least value): the view the report shows."""
    fine = _series(spark, sf_dir)
    coarse = src.dedup(fine.withColumn("ts", F.floor(F.col("ts") / 3_600) * 3_600))
    views = []
    for name, view in (("1m", fine), ("1h", coarse)):
        counts = S.episodes(view, TIERS).groupBy("series_id").agg(F.count(F.lit(1)).alias("events"))
        views.append(S.median_step(S.gap_table(view)).join(counts, "series_id", "left").select("series_id", F.lit(name).alias("resolution"), "step", F.coalesce("events", F.lit(0)).alias("events"), "samples"))
    return S.best_view(views[0].unionByName(views[1]))


def kline_parse(spark, sf_dir):
    """Events as exchange CSV lines with millisecond stamps and a header, parsed back."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = raw.select(F.concat_ws(",", src.epoch_seconds("ts") * 1_000, F.lit("o"), F.lit("h"), F.lit("l"), F.col("value").cast("string")).alias("value"))
    header = spark.createDataFrame([("open_time,open,high,low,close",), ("x,1,2,3,4",), ("17,1,2,3,bad",)], "value string")
    return src.parse_klines(lines.unionByName(header), "all")


def archive_days(spark, sf_dir):
    """The events written as daily archives, one of them then cut off, and those of the month's second half read back: samples,
    least value and sum of each, and the failed one as a row."""
    folder = f"{scratch(spark)}/archives"
    arc.write_archives(_series(spark, sf_dir), folder, "yyyy-MM-dd").write.format("noop").mode("overwrite").save()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    broken = hadoop.Path(f"{folder}/broken/broken-2024-01-20.zip")
    with_file = broken.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(broken)
    with_file.write(bytearray(b"PK\x03\x04 cut off"))
    with_file.close()
    half = arc.archives(spark, folder).where(F.col("period") >= "2024-01-16")
    daily = half.groupBy("series_id", "period").agg(F.count("value").alias("samples"), F.min("value").alias("least"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"), F.max("error").alias("error"))
    return daily.withColumn("error", F.split("error", ":")[0])


def missing_months(spark, sf_dir):
    months = spark.createDataFrame([("2023-12",), ("2024-01",), ("2024-02",)], "month string")
    return src.missing_months(months, _series(spark, sf_dir))


def synthetic_minutes(spark, sf_dir):
    """The events' minutes of each type with synthetic values over 31 days, noise by type and minute, and the episodes in them."""
    minute = F.floor((F.col("ts") - SYNTHETIC_START) / 60)
    at = _series(spark, sf_dir).select("series_id", minute.alias("at")).distinct().withColumn("ts", SYNTHETIC_START + F.col("at") * 60)
    keyed = at.withColumn("_key", F.col("at") * 256 + F.ascii("series_id"))
    return S.episodes(src.synthetic_values(keyed, "at", 31 * 1_440, 7, "_key"), S.TIERS)


_S = """s AS (SELECT event_type AS series_id, floor(epoch(ts))::BIGINT AS ts, min(value) AS value FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL)"""
_U = _S.replace("event_type AS", "user_id::VARCHAR AS").replace("event_type IS", "user_id IS")
_G = """g AS (SELECT *, lag(ts) OVER w AS prev_ts, lag(value) OVER w AS prev_value FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
st AS (SELECT series_id, greatest(1, coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY ts - prev_ts DESC), 60))::BIGINT AS step, count(*) AS samples FROM g GROUP BY series_id)"""


def _episodes_sql(tiers: dict, name: str = "ep") -> str:
    values = ", ".join(f"('{k}', {v:.4f}::DOUBLE)" for k, v in tiers.items())
    return f"""t_{name}(kind, threshold) AS (VALUES {values}),
f_{name} AS (SELECT g.*, kind, threshold, step, value < threshold AS below, CASE WHEN value < threshold AND (NOT coalesce(prev_value < threshold, false) OR ts - prev_ts > 3 * step) THEN 1 ELSE 0 END AS brk FROM g JOIN st USING (series_id), t_{name}),
i_{name} AS (SELECT *, sum(brk) OVER (PARTITION BY series_id, kind ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f_{name}),
{name} AS (SELECT series_id, kind, min(ts) AS start_ts, max(ts) AS end_ts, greatest(1, (max(ts) - min(ts) + any_value(step)) // 60)::BIGINT AS duration_min, min(value) AS min_value, count(*) AS samples
  FROM i_{name} WHERE below GROUP BY series_id, kind, island HAVING count(*) >= greatest(1, ceil(300.0 / any_value(step)), 2))"""


_EP = _episodes_sql(TIERS)
_STATE = "CASE WHEN low < 5.0 THEN 'collapse' WHEN low < 10.0 THEN 'active_depeg' WHEN low < 35.0 THEN 'stressed' ELSE 'normal' END"
_LOW = "lo AS (SELECT *, min(value) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS low FROM s)"
_SUP = """sup AS (SELECT series_id, (ts // 86400) * 86400 AS ts, sum(value::DECIMAL(18,4))::DOUBLE AS value FROM s GROUP BY ALL),
gr AS (SELECT series_id, ts, value, baseline, CASE WHEN ts > head_ts AND baseline > 0 THEN (value - baseline) / baseline END AS growth FROM (
  SELECT a.series_id, a.ts, a.value, h.ts AS head_ts, coalesce((SELECT b.value FROM sup b WHERE b.series_id = a.series_id AND b.ts <= a.ts - 86400 ORDER BY b.ts DESC LIMIT 1), h.value) AS baseline
  FROM sup a JOIN (SELECT series_id, min(ts) AS ts, arg_min(value, ts) AS value FROM sup GROUP BY series_id) h USING (series_id)))"""
_AL = f"""{_LOW}, {_SUP},
rn AS (SELECT lo.*, growth, row_number() OVER (PARTITION BY lo.series_id ORDER BY lo.ts) AS rn FROM lo ASOF LEFT JOIN gr ON lo.series_id = gr.series_id AND lo.ts >= gr.ts),
ev AS (SELECT rn.*, CASE WHEN {_STATE} = 'normal' AND growth > 0.5 THEN 'active_depeg' ELSE {_STATE} END AS state FROM rn JOIN st USING (series_id)
  WHERE samples >= 2 AND rn >= greatest(1, ceil(86400.0 / step)) AND rn < samples AND (rn - greatest(1, ceil(86400.0 / step))::BIGINT) % greatest(1, ceil(3600.0 / step))::BIGINT = 0),
pr AS (SELECT *, lag(state, 1, 'normal') OVER (PARTITION BY series_id ORDER BY ts) AS before FROM ev),
al AS (SELECT series_id, ts, state, low, growth FROM pr WHERE state <> 'normal' AND before <> state)"""
_LT = f"""{_episodes_sql({"failure": TIERS["failure"]})}, {_AL},
sp AS (SELECT series_id, start_ts, end_ts, greatest(start_ts - 36000, coalesce(lag(end_ts) OVER (PARTITION BY series_id ORDER BY start_ts) + 1, start_ts - 36000)) AS floor_ts FROM ep),
lf AS (SELECT sp.series_id, start_ts, end_ts, min(al.ts) AS first_ts, count(al.ts) AS admissible FROM sp LEFT JOIN al ON al.series_id = sp.series_id AND al.ts >= floor_ts AND al.ts < start_ts GROUP BY ALL),
lt AS (SELECT series_id, start_ts, end_ts, (start_ts - first_ts) // 60 AS lead_minutes, admissible FROM lf)"""
_STATE4 = f"CASE WHEN ({_STATE}) = 'normal' AND growth > 0.5 THEN 'active_depeg' ELSE {_STATE} END"
_POOL = f"""hh AS (SELECT series_id, ts // 3600 AS hour, sum(value::DECIMAL(18,4))::DOUBLE AS total, max(value) AS most, count(*) AS n FROM s GROUP BY ALL),
po AS (SELECT series_id, hour // 24 * 86400 AS ts, sum(total::DECIMAL(18,4))::DOUBLE / (40 * sum(n)) AS backing, max(CASE WHEN total <> 0 THEN most / total END) AS imbalance FROM hh GROUP BY ALL)"""
_AL4 = (
    _AL.replace("ASOF LEFT JOIN gr ON lo.series_id = gr.series_id AND lo.ts >= gr.ts", "ASOF LEFT JOIN gr ON lo.series_id = gr.series_id AND lo.ts >= gr.ts ASOF LEFT JOIN po ON lo.series_id = po.series_id AND lo.ts >= po.ts")
    .replace("SELECT lo.*, growth,", "SELECT lo.*, growth, backing, imbalance,")
    .replace(f"CASE WHEN {_STATE} = 'normal' AND growth > 0.5 THEN 'active_depeg' ELSE {_STATE} END", f"CASE WHEN ({_STATE4}) IN ('normal', 'stressed') AND backing < 1.5 THEN 'active_depeg' ELSE {_STATE4} END")
    .replace("SELECT series_id, ts, state, low, growth FROM pr", "SELECT series_id, ts, state, low, growth, backing, imbalance FROM pr")
)
_ISO = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_LS = "count(*) AS total, count(lead_minutes) AS detected, percentile_disc(0.5) WITHIN GROUP (ORDER BY lead_minutes DESC) AS median_lead FROM lt"

QUERIES = {
    f.__name__: f
    for f in (series_dedup, series_median_step, episodes, episodes_tiers, episode_sensitivity, rolling_min_state, supply_growth_asof, early_warning_alerts, pool_alerts, lead_time, lead_time_pooled, lead_time_by_series, episode_kind_counts, severe_events, best_view, kline_parse, archive_days, missing_months, synthetic_minutes)
}
ORACLE_SQL = {
    "series_dedup": f"WITH {_S} SELECT * FROM s",
    "series_median_step": f"WITH {_U}, {_G} SELECT * FROM st",
    "episodes": f"WITH {_U}, {_G}, {_episodes_sql({'depeg': 35.0})} SELECT * FROM ep",
    "episodes_tiers": f"WITH {_S}, {_G}, {_EP} SELECT *, {_ISO.format('start_ts')} AS start_iso, {_ISO.format('end_ts')} AS end_iso FROM ep",
    "episode_sensitivity": f"""WITH {_S}, {_G}, {_episodes_sql({f'{t:g}': t for t in GRID})},
        c AS (SELECT series_id, kind AS threshold, count(*) AS events, sum(duration_min)::BIGINT AS minutes, min(min_value) AS min_value FROM ep GROUP BY ALL)
        SELECT series_id, kind AS threshold, coalesce(events, 0)::BIGINT AS events, coalesce(minutes, 0)::BIGINT AS minutes, min_value FROM (SELECT DISTINCT series_id FROM s) CROSS JOIN t_ep LEFT JOIN c ON c.series_id = s.series_id AND c.threshold = kind""".replace("(SELECT DISTINCT series_id FROM s) CROSS JOIN t_ep LEFT JOIN c ON c.series_id = s.series_id AND c.threshold = kind", "(SELECT DISTINCT series_id, kind FROM s, t_ep) LEFT JOIN (SELECT series_id, threshold AS kind, events, minutes, min_value FROM c) USING (series_id, kind)"),
    "rolling_min_state": f"WITH {_S}, {_LOW} SELECT series_id, ts, value, low, round(abs(value - 1), 6) AS deviation, {_STATE} AS state FROM lo",
    "supply_growth_asof": f"WITH {_S}, {_SUP} SELECT * FROM gr",
    "early_warning_alerts": f"""WITH {_S}, {_G}, {_AL} SELECT series_id, ts, state, concat_ws('; ', CASE WHEN low < 35.0 THEN printf('price touched %.4f (< 35.0)', low) END, CASE WHEN growth > 0.5 THEN printf('absorbing supply +%.1f%% in window', growth * 100) END) AS reasons FROM al""",
    "pool_alerts": f"""WITH {_S}, {_G}, {_POOL}, {_AL4} SELECT series_id, ts, state, concat_ws('; ', CASE WHEN low < 35.0 THEN printf('price touched %.4f (< 35.0)', low) END, CASE WHEN growth > 0.5 THEN printf('absorbing supply +%.1f%% in window', growth * 100) END,
        CASE WHEN backing < 1.5 THEN printf('backing ratio %.2f < 1.5', backing) END, CASE WHEN imbalance > 0.7 THEN printf('pool imbalance %.0f%% > 70%%', imbalance * 100) END) AS reasons FROM al""",
    "lead_time": f"WITH {_S}, {_G}, {_LT} SELECT * FROM lt",
    "lead_time_pooled": f"WITH {_S}, {_G}, {_LT} SELECT {_LS}",
    "lead_time_by_series": f"WITH {_S}, {_G}, {_LT} SELECT series_id, {_LS} GROUP BY series_id",
    "episode_kind_counts": f"WITH {_S}, {_G}, {_EP} SELECT series_id, count(*) FILTER (kind = 'depeg') AS depeg, count(*) FILTER (kind = 'severe') AS severe, count(*) FILTER (kind = 'failure') AS failure, min(min_value) AS floor_value FROM ep GROUP BY series_id",
    "severe_events": f"WITH {_S}, {_G}, {_EP} SELECT * FROM ep WHERE kind <> 'depeg' OR NOT EXISTS (SELECT 1 FROM ep WHERE kind <> 'depeg') ORDER BY start_ts, series_id, kind LIMIT 20",
    "best_view": f"""WITH {_S}, {_G}, {_EP}, fine AS (SELECT series_id, '1m' AS resolution, step, (SELECT count(*) FROM ep WHERE ep.series_id = st.series_id) AS events, samples FROM st),
        h AS (SELECT series_id, (ts // 3600) * 3600 AS ts FROM s GROUP BY ALL), hg AS (SELECT series_id, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS gap FROM h),
        hs AS (SELECT series_id, greatest(1, coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY gap DESC), 60)) AS step FROM hg GROUP BY series_id)
        SELECT series_id, CASE WHEN fine.step < hs.step THEN '1m' ELSE '1h' END AS resolution FROM fine JOIN hs USING (series_id)""",
    "kline_parse": "SELECT 'all' AS series_id, floor(epoch(ts))::BIGINT AS ts, min(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "archive_days": f"WITH {_S} SELECT series_id, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS period, count(*) AS samples, min(value) AS least, sum(value::DECIMAL(18,4))::DOUBLE AS total, NULL::VARCHAR AS error FROM s WHERE ts >= epoch(TIMESTAMP '2024-01-16') GROUP BY ALL UNION ALL SELECT 'broken', '2024-01-20', 0, NULL, NULL, 'BadZipFile'",
    "synthetic_minutes": f"""WITH e AS (SELECT DISTINCT event_type AS series_id, floor((floor(epoch(ts)) - {SYNTHETIC_START}) / 60)::BIGINT AS m FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
        k AS (SELECT *, m / {31 * 1_440}::DOUBLE AS x, m * 256 + ascii(series_id) AS key FROM e),
        u AS (SELECT *, ({bits_sql(7, "key", "1")} + 1) / {float(1 << 32)}::DOUBLE AS u1, {bits_sql(7, "key", "2")} / {float(1 << 32)}::DOUBLE AS u2 FROM k),
        s AS (SELECT series_id, {SYNTHETIC_START} + m * 60 AS ts, round(greatest(0.01::DOUBLE, CASE WHEN x < 0.5 THEN 1.0::DOUBLE WHEN x < 0.7 THEN 1.0::DOUBLE - (x - 0.5::DOUBLE) * 0.1::DOUBLE WHEN x < 0.85 THEN 0.98::DOUBLE - (x - 0.7::DOUBLE) * 2 ELSE 0.6::DOUBLE - (x - 0.85::DOUBLE) * 3 END
          + sqrt(-2 * ln(u1)) * cos(u2 * 2 * pi()) * CASE WHEN x < 0.5 THEN 0.0006::DOUBLE ELSE 0.004::DOUBLE END), 6) AS value FROM u),
        {_G}, {_episodes_sql(S.TIERS)} SELECT * FROM ep""",
    "missing_months": "SELECT m AS month FROM (VALUES ('2023-12'), ('2024-01'), ('2024-02')) v(m) WHERE NOT EXISTS (SELECT 1 FROM events WHERE strftime(ts, '%Y-%m') = m)",
}
