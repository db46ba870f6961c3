"""Time-series risk: episodes below thresholds, rolling state, early-warning alerts and their lead time.

A series table has series_id string, ts bigint (epoch seconds) and value double, one row per instant (see sources.series).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import rolling_least, stored, with_previous, with_running_sum
from .selection import upper_median

DAY = 86_400
#: Severities and their thresholds on a unit peg.
TIERS = {"depeg": 0.99, "severe": 0.95, "failure": 0.80}
SWEEP = (0.995, 0.99, 0.98, 0.97, 0.95, 0.90)


def with_gaps(series: DataFrame) -> DataFrame:
    """prev_ts and prev_value of the sample before, and the gap in seconds."""
    chunked = series.withColumn("_chunk", F.floor(F.col("ts") / DAY))
    out = with_previous(chunked, ["series_id"], "ts", {"ts": "prev_ts", "value": "prev_value"}, "_chunk")
    return out.withColumn("gap", F.col("ts") - F.col("prev_ts"))


def gap_table(series: DataFrame) -> DataFrame:
    """with_gaps(), written once for all who read it."""
    return stored(with_gaps(series).select("series_id", "ts", "value", "prev_value", "gap", "_chunk"))


def median_step(gaps: DataFrame) -> DataFrame:
    """Sampling step of each series in seconds, at least 1: the upper median gap, 60 for a single sample; and its samples.

    A series of n samples has n - 1 gaps, so series with a gap need no second count.
    """
    medians = upper_median(gaps, ["series_id"], "gap", "_gap").select("series_id", "_gap", (F.col("n") + 1).alias("_n"))
    single = gaps.where("gap IS NULL").select("series_id").join(medians, "series_id", "left")
    return single.select("series_id", F.greatest(F.lit(1).cast("bigint"), F.coalesce("_gap", F.lit(60)).cast("bigint")).alias("step"), F.coalesce("_n", F.lit(1)).cast("bigint").alias("samples"))


PIECES = "series_id string, kind string, start_ts long, end_ts long, min_value double, samples long, step long, joined boolean, open boolean"


def _pieces(tiers: dict[str, float], min_minutes: int, min_samples: int, max_gap_steps: int):
    """Runs below each threshold inside the chunks of a batch. Thresholds fall, so each looks only at the samples of the one before."""
    falling = sorted(tiers.items(), key=lambda kv: -kv[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ts, value, chunk, step = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ts", "value", "_chunk", "step"))
            prev, gap = (batch.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in ("prev_value", "gap"))
            series = batch.column("series_id").dictionary_encode()
            code = np.asarray(series.indices)
            first = np.ones(len(ts), bool)
            first[1:] = (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])
            last = np.append(first[1:], True)
            cut = gap > max(1, max_gap_steps) * step
            need = np.maximum(np.maximum(1, min_samples), np.ceil(min_minutes * 60 / step))
            at, out = np.arange(len(ts)), []
            for kind, threshold in falling:
                at = at[value[at] < threshold]
                if not len(at):
                    break
                new = first[at] | cut[at]
                new[1:] |= at[1:] != at[:-1] + 1
                new[0] = True
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(at)))
                a, z = at[begin], at[begin + size - 1]
                joined, open_ = first[a] & (prev[a] < threshold) & ~cut[a], last[z]
                kept = joined | open_ | (size >= need[a])
                cells = (code[a], ts[a], ts[z], np.minimum.reduceat(value[at], begin), size, step[a], joined, open_)
                out.append((kind, *(c[kept] for c in cells)))
            if out:
                names = pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.string())
                code, *cells = (np.concatenate([o[k] for o in out]) for k in range(1, 9))
                cells = [pa.array(c, pa.int64()) if c.dtype.kind in "iu" else pa.array(c) for c in cells]
                yield pa.RecordBatch.from_arrays([series.dictionary.take(pa.array(code)), names, *cells], names=[f.split()[0] for f in PIECES.split(", ")])

    return run


def episodes(series: DataFrame, tiers: dict[str, float], min_minutes: int = 5, min_samples: int = 2, max_gap_steps: int = 3, step_seconds: int | None = None, gaps: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """Runs of samples below a threshold: series_id, kind, start_ts, end_ts, duration_min, min_value, samples.

    A run ends at a sample at or above the threshold, or where samples are more than max_gap_steps steps apart. It counts if
    it has at least ceil(min_minutes * 60 / step) and min_samples samples.

    Who calls this and alerts() for one series can give both its gap_table() and median_step(), so that they are computed once.

    All thresholds share one pass, in which no sample is multiplied: each chunk of a series yields its runs below all of them,
    those of a lower threshold found inside those of the next higher. Runs that neither reach over their chunk's end nor go on
    from the chunk before are done; the others, at most two for each chunk and threshold, are joined at the borders.
    """
    gaps = gap_table(series) if gaps is None else gaps
    if step_seconds is None:
        steps = median_step(gaps) if steps is None else steps
        # Told to each chunk, as a series' samples must not meet in one task.
        steps = gaps.select("series_id", "_chunk").distinct().join(steps.select("series_id", "step"), "series_id")
        rows = gaps.join(steps, ["series_id", "_chunk"])
    else:
        rows = gaps.withColumn("step", F.lit(step_seconds).cast("bigint")).repartition("series_id", "_chunk")
    pieces = stored(rows.sortWithinPartitions("series_id", "_chunk", "ts").mapInArrow(_pieces(tiers, min_minutes, min_samples, max_gap_steps), PIECES))
    edges = pieces.where("joined OR open").withColumn("_island", F.sum((~F.col("joined")).cast("long")).over(Window.partitionBy("series_id", "kind").orderBy("start_ts")))
    edges = edges.groupBy("series_id", "kind", "_island").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.min("min_value").alias("min_value"), F.sum("samples").alias("samples"), F.max("step").alias("step")).drop("_island")
    runs = pieces.where("NOT joined AND NOT open").drop("joined", "open").unionByName(edges)
    need = F.greatest(F.lit(1), F.ceil(F.lit(min_minutes * 60) / F.col("step")), F.lit(min_samples))
    minutes = F.greatest(F.lit(1).cast("bigint"), F.floor((F.col("end_ts") - F.col("start_ts") + F.col("step")) / 60))
    return runs.where(F.col("samples") >= need).select("series_id", "kind", "start_ts", "end_ts", minutes.alias("duration_min"), "min_value", "samples")


def sensitivity(series: DataFrame, grid: tuple[float, ...] = SWEEP, **rules) -> DataFrame:
    """Episodes, minutes and least value for each threshold of a grid; thresholds without an episode have zeros and null."""
    names = {f"{t:g}": t for t in grid}
    found = episodes(series, names, **rules).groupBy("series_id", F.col("kind").alias("threshold")).agg(F.count(F.lit(1)).alias("events"), F.sum("duration_min").alias("minutes"), F.min("min_value").alias("min_value"))
    every = series.select("series_id").distinct().withColumn("threshold", F.explode(F.array(*map(F.lit, names))))
    return every.join(found, ["series_id", "threshold"], "left").select("series_id", "threshold", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("minutes", F.lit(0)).alias("minutes"), "min_value")


def rolling_low(series: DataFrame, minutes: int = 1_440) -> DataFrame:
    """Add low: the least value of the last `minutes`, both ends included."""
    return rolling_least(series, ["series_id"], "ts", minutes * 60, "value", "low")


def supply_growth(supply: DataFrame, hours: int = 24) -> DataFrame:
    """Growth of each supply sample against the last one at least `hours` older, else the first; null where undefined.

    Undefined: fewer than two samples so far, or a baseline of zero or less. An as-of join of the table with itself: baseline
    rows, moved `hours` later, and the samples are one ordered table in which the last baseline so far is looked up.
    """
    span = hours * 3_600
    shifted = supply.select("series_id", (F.col("ts") + span).alias("ts"), F.col("value").alias("base"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("value"))
    samples = supply.select("series_id", "ts", F.lit(None).cast("double").alias("base"), F.lit(1).alias("_kind"), "value")
    both = as_of(shifted.unionByName(samples), "base").where("_kind = 1")
    heads = supply.groupBy("series_id").agg(F.min_by("value", "ts").alias("head"), F.min("ts").alias("head_ts"))
    joined = both.join(heads, "series_id")
    base = F.coalesce("base", "head")
    growth = F.when((F.col("ts") > F.col("head_ts")) & (base > 0), (F.col("value") - base) / base)
    return joined.select("series_id", "ts", "value", base.alias("baseline"), growth.alias("growth"))


def as_of(rows: DataFrame, column: str) -> DataFrame:
    """Fill `column` with its last non-null value so far, by (ts, _kind) within the series (baselines are of kind 0).

    Chunked like everything ordered here: the last value of a day comes from the day's rows, older ones from the days' table.
    """
    rows = rows.withColumn("_chunk", F.floor(F.col("ts") / DAY))
    inside = Window.partitionBy("series_id", "_chunk").orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    days = rows.groupBy("series_id", "_chunk").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct("ts", "_kind"))).alias("_day"))
    before = Window.partitionBy("series_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("series_id", "_chunk", F.last("_day", ignorenulls=True).over(before).alias("_before"))
    filled = rows.withColumn(column, F.last(column, ignorenulls=True).over(inside)).join(days, ["series_id", "_chunk"])
    return filled.withColumn(column, F.coalesce(column, "_before")).drop("_before", "_chunk")


def state_of(low: Column, growth: Column | None = None, backing: Column | None = None, tiers: dict[str, float] = TIERS, growth_alert: float = 0.5, backing_alert: float = 1.5) -> Column:
    """normal, stressed, active_depeg or collapse by the rolling low; fast supply growth or thin backing lift it to active_depeg.

    Undefined inputs (null or NaN) never alert.
    """
    state = F.when(low < tiers["failure"], "collapse").when(low < tiers["severe"], "active_depeg").when(low < tiers["depeg"], "stressed").otherwise("normal")
    if growth is not None:
        state = F.when((state == "normal") & _defined(growth) & (growth > growth_alert), "active_depeg").otherwise(state)
    if backing is not None:
        state = F.when(state.isin("normal", "stressed") & _defined(backing) & (backing < backing_alert), "active_depeg").otherwise(state)
    return state


def _defined(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def reasons(low: Column, growth: Column, backing: Column | None = None, imbalance: Column | None = None, tiers: dict[str, float] = TIERS, growth_alert: float = 0.5, backing_alert: float = 1.5, imbalance_alert: float = 0.7) -> Column:
    """Alert texts in a fixed order, without those that do not apply. Undefined inputs (null or NaN) say nothing."""
    nothing = F.lit(None).cast("double")
    backing, imbalance = nothing if backing is None else backing, nothing if imbalance is None else imbalance
    # The texts.
    parts = [
        F.when(low < tiers["depeg"], F.format_string(f"price touched %.4f (< {tiers['depeg']})", low)),
        F.when(_defined(growth) & (growth > growth_alert), F.format_string("absorbing supply +%.1f%% in window", growth * 100)),
        F.when(_defined(backing) & (backing < backing_alert), F.format_string(f"backing ratio %.2f < {backing_alert}", backing)),
        F.when(_defined(imbalance) & (imbalance > imbalance_alert), F.format_string(f"pool imbalance %.0f%% > {imbalance_alert * 100:.0f}%%", imbalance * 100)),
    ]
    return F.array_compact(F.array(*parts))


def with_last(samples: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Add `name`: the value of `known` (series_id, ts, value) that stood at each sample's instant. An undefined value replaces an
    older one too; null before the first."""
    told = known.select("series_id", "ts", F.struct(F.col("value").cast("double").alias("v")).alias(name), F.lit(0).alias("_kind"))
    both = told.unionByName(samples.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    return as_of(both, name).where("_kind = 1").withColumn(name, F.col(f"{name}.v")).drop("_kind")


def indicators(series: DataFrame, supply: DataFrame | None = None, tiers: dict[str, float] = TIERS, minutes: int = 1_440, backing: DataFrame | None = None, imbalance: DataFrame | None = None) -> DataFrame:
    """Every sample with its rolling low, deviation from 1, as-of supply growth, backing ratio and pool imbalance, and state; numbers
    have six digits, state has all.

    backing (value of the absorbing asset over the supply) and imbalance (largest share of the pool) are series too; the last
    known value counts.
    """
    out = rolling_low(series, minutes)
    known = {"growth": None if supply is None else supply_growth(supply).select("series_id", "ts", F.col("growth").alias("value")), "backing": backing, "imbalance": imbalance}
    for name, table in known.items():
        out = out.withColumn(name, F.lit(None).cast("double")) if table is None else with_last(out, table, name)
    state = state_of(F.col("low"), F.col("growth"), F.col("backing"), tiers=tiers).alias("state")
    rounded = [F.round("low", 6).alias("low"), F.round("growth", 6).alias("growth"), F.col("low").alias("low_raw"), F.col("growth").alias("growth_raw")]
    return out.select("series_id", "ts", "value", F.round(F.abs(F.col("value") - 1), 6).alias("deviation"), *rounded, "backing", "imbalance", state)


def alerts(series: DataFrame, supply: DataFrame | None = None, tiers: dict[str, float] = TIERS, minutes: int = 1_440, warmup_hours: int = 24, every_minutes: int = 60, step_seconds: int | None = None, backing: DataFrame | None = None, imbalance: DataFrame | None = None, gaps: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """Early warnings: series_id, ts, state, reasons, at evaluated samples whose state is not normal and differs from that of
    the sample evaluated before.

    A series is evaluated every ceil(every_minutes / step) samples from its ceil(warmup_hours / step)-th on, but not at its
    last sample; only data up to the sample count. Series of fewer than two samples give nothing. The step is the median one
    unless step_seconds is given.
    """
    gaps = gap_table(series) if gaps is None else gaps
    series = gaps.select("series_id", "ts", "value")  # as written, not computed again
    steps = median_step(gaps) if steps is None else steps
    if step_seconds is not None:
        steps = steps.withColumn("step", F.lit(step_seconds).cast("bigint"))
    numbered = with_running_sum(gaps.select("series_id", "ts", "value", "_chunk"), ["series_id"], "ts", F.lit(1).cast("bigint"), "rn", "_chunk").select("series_id", "ts", "rn")
    window = F.greatest(F.lit(1), F.ceil(F.lit(warmup_hours * 3_600) / F.col("step")))
    stride = F.greatest(F.lit(1), F.ceil(F.lit(every_minutes * 60) / F.col("step")))
    evaluated = numbered.join(steps, "series_id").where((F.col("samples") >= 2) & (F.col("rn") >= window) & (F.col("rn") < F.col("samples")) & ((F.col("rn") - window) % stride == 0)).select("series_id", "ts")
    seen = indicators(series, supply, tiers, minutes, backing, imbalance).join(evaluated, ["series_id", "ts"]).withColumn("_chunk", F.floor(F.col("ts") / DAY))
    seen = with_previous(seen, ["series_id"], "ts", {"state": "before"}, "_chunk")
    fired = seen.where((F.col("state") != "normal") & (F.coalesce("before", F.lit("normal")) != F.col("state")))
    return fired.select("series_id", "ts", "state", reasons(F.col("low_raw"), F.col("growth_raw"), F.col("backing"), F.col("imbalance"), tiers=tiers).alias("reasons"))


def lead_times(events: DataFrame, warned: DataFrame, lookback_minutes: int = 2_880) -> DataFrame:
    """For every episode of one kind: lead_minutes of the first admissible alert (null if none) and their number.

    Admissible alerts come before the start, within the lookback and after the previous episode's end. With alerts numbered along
    their series, the numbers of the last alert before the floor and of the last one before the start, two as-of look-ups, tell
    how many are admissible; the first of them is the one after the former. No alert is ever paired with an episode.
    """
    spans = with_previous(events.select("series_id", "start_ts", "end_ts", F.floor(F.col("start_ts") / DAY).alias("_chunk")), ["series_id"], "start_ts", {"end_ts": "prev_end"}, "_chunk")
    lookback = F.col("start_ts") - lookback_minutes * 60
    spans = stored(spans.select("series_id", "start_ts", "end_ts", F.greatest(lookback, F.coalesce(F.col("prev_end") + 1, lookback)).alias("floor_ts")))
    alerts_ = with_running_sum(warned.select("series_id", "ts", F.floor(F.col("ts") / DAY).alias("_chunk")), ["series_id"], "ts", F.lit(1).cast("bigint"), "number", "_chunk")
    alerts_ = stored(alerts_.select("series_id", "ts", "number"))
    known = alerts_.select("series_id", "ts", "number", F.lit(1).alias("_kind"))
    none = F.lit(None).cast("bigint")
    # A probe stands before an alert of its own instant: it sees earlier ones only.
    probes = spans.select("series_id", F.explode(F.array(F.struct(F.col("floor_ts").alias("at"), F.lit("floor").alias("end")), F.struct(F.col("start_ts").alias("at"), F.lit("start").alias("end")))).alias("_p"), "start_ts", "end_ts")
    probes = probes.select("series_id", F.col("_p.at").alias("ts"), none.alias("number"), F.lit(0).alias("_kind"), "start_ts", "end_ts", F.col("_p.end").alias("end"))
    seen = as_of(known.unionByName(probes, allowMissingColumns=True), "number").where("_kind = 0")
    seen = seen.groupBy("series_id", "start_ts", "end_ts").agg(*[F.coalesce(F.max(F.when(F.col("end") == e, F.col("number"))), F.lit(0)).alias(e) for e in ("floor", "start")])
    counted = seen.withColumn("admissible", F.col("start") - F.col("floor")).withColumn("number", F.when(F.col("admissible") > 0, F.col("floor") + 1))
    first = alerts_.select("series_id", "number", F.col("ts").alias("first"))
    return counted.join(first, ["series_id", "number"], "left").select("series_id", "start_ts", "end_ts", F.expr("(start_ts - first) div 60").alias("lead_minutes"), "admissible")


def lead_summary(leads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Episodes, those preceded by an alert, and the upper median lead: per `by` columns, or pooled over all."""
    counts = [F.count(F.lit(1)).alias("total"), F.count("lead_minutes").alias("detected")]
    leads = stored(leads)
    if by:
        medians = upper_median(leads, by, "lead_minutes", "median_lead").drop("n")
        return leads.groupBy(*by).agg(*counts).join(medians, by, "left")
    medians = upper_median(leads.withColumn("_all", F.lit(0)), ["_all"], "lead_minutes", "median_lead").select("median_lead")
    # One row and at most one, put beside each other without a join.
    return leads.agg(*counts).unionByName(medians, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("total", "detected", "median_lead")])


def best_view(views: DataFrame) -> DataFrame:
    """Of a series' views (series_id, resolution, step, events, samples) the finest, then that with most events, then samples."""
    return views.groupBy("series_id").agg(F.min_by("resolution", F.struct("step", -F.col("events"), -F.col("samples"), "resolution")).alias("resolution"))


def kind_counts(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Episodes of each kind and the least value, per series."""
    return events.groupBy("series_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.min("min_value").alias("floor_value"))


def severe_only(events: DataFrame, most: int = 20) -> DataFrame:
    """The report's event list: what is not of the mildest kind, or all if nothing is; the first `most` by start."""
    marked = events.withColumn("_severe", F.col("kind") != "depeg")
    any_severe = marked.agg(F.coalesce(F.max("_severe"), F.lit(False)).alias("_any"))
    return marked.join(F.broadcast(any_severe)).where(~F.col("_any") | F.col("_severe")).drop("_any", "_severe").orderBy("start_ts", "series_id", "kind").limit(most)
