"""Series sources: CSV series, exchange klines, price and supply JSON, and the views that choose among them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import normal


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))") / 1_000_000)


def iso_utc(ts: str) -> Column:
    """Epoch seconds as ISO-8601 text with +00:00."""
    return F.expr(f"date_format(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {ts}), \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\")")


def dedup(series: DataFrame) -> DataFrame:
    """One sample per series and instant, the least value: ordered work must not depend on ties."""
    return series.groupBy("series_id", "ts").agg(F.min("value").alias("value"))


def from_events(events: DataFrame, series: str = "event_type") -> DataFrame:
    """Event rows as series: one per value of `series`, nulls dropped, one sample a second."""
    rows = events.select(F.col(series).cast("string").alias("series_id"), epoch_seconds("ts").alias("ts"), F.col("value").cast("double").alias("value"))
    return dedup(rows.dropna())


def read_csv(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """CSV with ts and price, else circulating; rows that do not parse are skipped."""
    raw = spark.read.option("header", True).csv(path)
    name = "price" if "price" in raw.columns else "circulating"
    rows = raw.select(F.lit(series_id).alias("series_id"), F.col("ts").try_cast("bigint").alias("ts"), F.col(name).try_cast("double").alias("value"))
    return rows.dropna()


def write_csv(series: DataFrame, path: str, column: str = "price") -> None:
    series.select("ts", F.col("value").alias(column)).orderBy("ts").write.mode("overwrite").option("header", True).csv(path)


def normalise_epoch(raw: Column) -> Column:
    """Micro- or milliseconds to seconds: values above 10^13 are microseconds."""
    return F.when(raw > 10**13, F.floor(raw / 1_000_000)).otherwise(F.floor(raw / 1_000))


def parse_klines(lines: DataFrame, series_id: str) -> DataFrame:
    """Minute klines, one CSV line in `value`: field 0 is the open time, field 4 the close; header and bad lines are skipped.

    Times may have a fraction or an exponent; they are cut to whole numbers.
    """
    parts = F.split("value", ",")
    raw = F.try_element_at(parts, F.lit(1)).try_cast("double").try_cast("bigint")
    rows = lines.select(raw.alias("raw"), F.try_element_at(parts, F.lit(5)).try_cast("double").alias("value")).dropna()
    return dedup(rows.select(F.lit(series_id).alias("series_id"), normalise_epoch(F.col("raw")).alias("ts"), "value"))


def read_kline_archives(spark: SparkSession, path: str) -> DataFrame:
    """Lines (archive, value) of the CSV members of all ZIP files below a folder; damaged archives give none."""
    import io
    import zipfile

    def lines(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        members = [archive.read(m).decode("utf-8", "replace").splitlines() for m in archive.namelist() if m.endswith(".csv")]
                except zipfile.BadZipFile:
                    continue
                for member in members:
                    yield pd.DataFrame({"archive": name, "value": member})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(lines, "archive string, value string")


def parse_prices(documents: DataFrame, series_id: str) -> DataFrame:
    """Hourly prices from {"coins": {name: {"prices": [{"timestamp", "price"}]}}} in `value`; the first coin counts."""
    parsed = F.from_json("value", "coins map<string, struct<prices: array<struct<timestamp: bigint, price: double>>>>")
    rows = documents.select(F.explode(F.try_element_at(F.map_values(parsed["coins"]), F.lit(1))["prices"]).alias("p"))
    return dedup(rows.select(F.lit(series_id).alias("series_id"), F.col("p.timestamp").alias("ts"), F.col("p.price").alias("value")).dropna())


def parse_supply(documents: DataFrame, series_id: str) -> DataFrame:
    """Daily supply from rows {"date", "totalCirculating": {"peggedUSD"}} in `value`; rows without a number are dropped."""
    parsed = F.from_json("value", "date string, totalCirculating struct<peggedUSD: double>")
    rows = documents.select(F.lit(series_id).alias("series_id"), parsed["date"].try_cast("bigint").alias("ts"), parsed["totalCirculating"]["peggedUSD"].alias("value"))
    return dedup(rows.dropna())


def missing_months(requested: DataFrame, series: DataFrame) -> DataFrame:
    """Requested months (month "yyyy-MM") of which the series has no sample: the fetch sidecar."""
    got = series.select(F.substring(iso_utc("ts"), 1, 7).alias("month")).distinct()
    return requested.join(got, "month", "left_anti")


def prefer_finest(series: DataFrame) -> DataFrame:
    """Of several resolutions (column resolution, "1m" before "1h") of a series, the finest that has a sample."""
    rank = F.when(F.col("resolution") == "1m", 0).when(F.col("resolution") == "1h", 1).otherwise(2)
    best = series.groupBy("series_id").agg(F.min(F.struct(rank.alias("r"), "resolution")).alias("b")).select("series_id", F.col("b.resolution").alias("resolution"))
    return series.join(best, ["series_id", "resolution"])


def synthetic_values(rows: DataFrame, at: str, span: int, seed: int = 7, key: str = "ts") -> DataFrame:
    """Add value: a seeded series in four regimes, calm, drift, break and collapse, over `span` steps of the number `at`.

    The noise of a row is a function of the seed and of the row's own `key`, whatever task computes it.
    """
    x = F.col(at) / span
    level = F.when(x < 0.5, 1.0).when(x < 0.7, 1.0 - (x - 0.5) * 0.1).when(x < 0.85, 0.98 - (x - 0.7) * 2).otherwise(0.6 - (x - 0.85) * 3)
    noise = normal(seed, F.col(key)) * F.when(x < 0.5, 0.0006).otherwise(0.004)
    return rows.withColumn("value", F.round(F.greatest(F.lit(0.01), level + noise), 6))


def synthetic_minutes(spark: SparkSession, days: int = 8, seed: int = 7, start: int = 1_651_881_600, series_id: str = "demo") -> DataFrame:
    """synthetic_values() at every minute of `days` days."""
    minutes = spark.range(days * 1_440).select(F.lit(series_id).alias("series_id"), (F.lit(start) + F.col("id") * 60).alias("ts"), F.col("id").alias("_at"))
    return synthetic_values(minutes, "_at", days * 1_440, seed).drop("_at")


def first_by_ordinal(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key by `ordinal`."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).where("_r = 1").drop("_r")
