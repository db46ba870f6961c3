"""Early warnings as a stream: late and repeated samples are put in order by the watermark, then judged one by one.

State of a series, each part on its own: samples that wait for the watermark (a list), the samples that can still be the least of a
window (a list too, the deque of a rolling minimum), and a few counters. Lists are read and written as a whole, once for each call:
a call to the state store for each sample would cost more than all else. An event-time timer wakes a series when the
watermark passes its next waiting sample, and once more when it has been idle for long enough to be forgotten.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.series import TIERS, reasons

FIRED = "series_id string, ts bigint, state string, low double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _write(state, rows) -> None:
    """Replace a list in the state store; an empty one is none."""
    rows = [(int(ts), float(value)) for ts, value in rows]
    if rows:
        state.put(rows)
    else:
        state.clear()


class _Warner(StatefulProcessor):
    """One series. The sample before the newest is judged when the newest comes, as a last sample is never judged."""

    def __init__(self, tiers: dict[str, float], width: int, warmup: int, stride: int, idle: int) -> None:
        self.limits = [(tiers["failure"], "collapse"), (tiers["severe"], "active_depeg"), (tiers["depeg"], "stressed")]
        self.width, self.warmup, self.stride, self.idle = width, warmup, stride, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, value double")
        self.window = handle.getListState("window", "ts bigint, value double")
        self.counts = handle.getValueState("counts", "seen bigint, last_ts bigint, low double, before string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [s for batch in rows for s in zip(batch["ts"].tolist(), batch["value"].tolist(), strict=True)]
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), [])

    def _advance(self, key, watermark_ms: int, new: list[tuple[int, float]]) -> Iterator[pd.DataFrame]:
        """Judge all waiting samples up to the watermark, in order, and set the next timer. Of several at one instant the least counts."""
        waiting: dict[int, float] = {}
        for ts, value in (*(tuple(r) for r in self.waiting.get()), *new):
            if ts not in waiting or value < waiting[ts]:
                waiting[ts] = value
        ready = sorted(ts for ts in waiting if ts * 1_000 <= watermark_ms)
        seen, last_ts, low, before = self.counts.get() if self.counts.exists() else (0, None, None, "normal")
        window, fired = deque(tuple(r) for r in self.window.get()) if ready else deque(), []
        for ts in ready:
            value = waiting.pop(ts)
            if last_ts is not None and ts <= last_ts:
                continue
            if seen >= self.warmup and (seen - self.warmup) % self.stride == 0:
                state = next((name for limit, name in self.limits if low < limit), "normal")
                if state != "normal" and state != before:
                    fired.append((key[0], last_ts, state, low))
                before = state
            while window and window[-1][1] >= value:
                window.pop()
            window.append((ts, value))
            while window[0][0] < ts - self.width:
                window.popleft()
            seen, last_ts, low = seen + 1, ts, window[0][1]
        if ready:
            _write(self.window, window)
            self.counts.update((seen, last_ts, low, before))
        if ready or new:
            _write(self.waiting, waiting.items())
        self._wake(watermark_ms, last_ts, min(waiting, default=None))
        if fired:
            yield pd.DataFrame(fired, columns=["series_id", "ts", "state", "low"])

    def _wake(self, watermark_ms: int, last_ts: int | None, pending: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if pending is not None:
            self.handle.registerTimer(pending * 1_000)
        elif last_ts is not None and watermark_ms >= (last_ts + self.idle) * 1_000:
            self.waiting.clear()
            self.window.clear()
            self.counts.clear()
        elif last_ts is not None:
            self.handle.registerTimer((last_ts + self.idle) * 1_000)

    def close(self) -> None:
        pass


def alerts(stream: DataFrame, step_seconds: int, tiers: dict[str, float] = TIERS, minutes: int = 1_440, warmup_hours: int = 24, every_minutes: int = 60, late_minutes: int = 60, idle_days: int = 30) -> DataFrame:
    """series_id, ts, state and reasons of the early warnings of a stream (series_id, time, value), as operators.series.alerts()
    gives them for the samples up to the watermark.

    Samples may come up to `late_minutes` late and more than once. A series that is idle for `idle_days` starts anew: its state,
    bounded by the window and the lateness, is dropped. Rows with a null are ignored.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ceil = lambda a, b: max(1, -(-a // b))
    warner = _Warner(tiers, minutes * 60, ceil(warmup_hours * 3_600, step_seconds), ceil(every_minutes * 60, step_seconds), idle_days * 86_400)
    timely = stream.select("series_id", "time", "value").dropna().withWatermark("time", f"{late_minutes} minutes").dropDuplicatesWithinWatermark(["series_id", "time", "value"])
    rows = timely.select("series_id", "time", F.unix_timestamp("time").alias("ts"), "value")
    fired = rows.groupBy("series_id").transformWithStateInPandas(warner, FIRED, "Append", "EventTime")
    none = F.lit(None).cast("double")
    return fired.select("series_id", "ts", "state", reasons(F.col("low"), none, tiers=tiers).alias("reasons"))


def in_batches(rows: DataFrame, folder: str, batches: int, by) -> DataFrame:
    """The rows as a file stream of so many micro-batches, dealt by the number `by` (0 to batches - 1), in that order."""
    spark: SparkSession = rows.sparkSession
    numbered = rows.withColumn("_batch", by).repartition(batches, "_batch")
    numbered = numbered.persist()
    for k in range(batches):
        numbered.where(F.col("_batch") == k).drop("_batch").coalesce(1).write.mode("append").parquet(folder)
    numbered.unpersist()
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
