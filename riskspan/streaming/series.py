"""Streaming forms of the series operators: episodes with carried state, and windowed lows with a watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EPISODES = "series_id string, kind string, start_ts bigint, end_ts bigint, duration_min bigint, min_value double, samples bigint"


def episodes(stream: DataFrame, tiers: dict[str, float], step_seconds: int, min_minutes: int = 5, min_samples: int = 2, max_gap_steps: int = 3) -> DataFrame:
    """Versions of the episodes of a stream (series_id, ts, value): a row each time an episode that counts was extended.

    State is one open run per series and threshold, whatever the length of the series. Samples of a series must not come in a
    later batch than newer ones; older ones are dropped, and of several at one instant in a batch the least counts. An episode
    is the latest version of its series, kind and start: see latest().
    """
    needed = max(1, -(-min_minutes * 60 // step_seconds), min_samples)
    longest = max_gap_steps * step_seconds

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, runs = json.loads(state.get[0]) if state.exists else (None, {})
        rows = pd.concat(list(batches)).sort_values(["ts", "value"]).drop_duplicates("ts")
        grown: dict[tuple[str, int], tuple] = {}
        for ts, value in zip(rows["ts"].tolist(), rows["value"].tolist(), strict=True):
            if seen is not None and ts <= seen:
                continue
            for kind, threshold in tiers.items():
                run = runs.get(kind)
                if run and (value >= threshold or ts - seen > longest):
                    run = runs.pop(kind) and None
                if value < threshold:
                    start, low, n = run or (ts, value, 0)
                    runs[kind] = (start, min(low, value), n + 1)
                    if n + 1 >= needed:
                        grown[kind, start] = (key[0], kind, start, ts, max(1, int((ts - start + step_seconds) / 60)), min(low, value), n + 1)
            seen = ts
        state.update((json.dumps((seen, runs)),))
        if grown:
            yield pd.DataFrame(list(grown.values()), columns=[c.split()[0] for c in EPISODES.split(", ")])

    rows = stream.select("series_id", "ts", "value").dropna()
    return rows.groupBy("series_id").applyInPandasWithState(advance, EPISODES, "state string", "append", GroupStateTimeout.NoTimeout)


def latest(versions: DataFrame) -> DataFrame:
    """Each episode once, as its last version has it."""
    rest = ("end_ts", "duration_min", "min_value", "samples")
    return versions.groupBy("series_id", "kind", "start_ts").agg(F.max(F.struct(*rest)).alias("v")).select("series_id", "kind", "start_ts", *[f"v.{c}" for c in rest])


def lows(stream: DataFrame, minutes: int = 60, late_minutes: int = 60) -> DataFrame:
    """The least value and number of samples of each series in windows of `minutes`, once a window is `late_minutes` past.

    Stream: series_id, time (timestamp), value. Later samples are dropped; state is bounded by the watermark.
    """
    timely = stream.withWatermark("time", f"{late_minutes} minutes")
    out = timely.groupBy(F.window("time", f"{minutes} minutes"), "series_id").agg(F.min("value").alias("low"), F.count("value").alias("samples"))
    return out.select("series_id", F.unix_timestamp("window.start").alias("start_ts"), F.unix_timestamp("window.end").alias("end_ts"), "low", "samples")


def run_available(out: DataFrame, folder: str) -> DataFrame:
    """Run a streaming table over what is there now, and read what it gave. A run that is cut off goes on from its checkpoint."""
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")
