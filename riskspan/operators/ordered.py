"""Ordered computations over long series without gathering a series in one task.

A series is cut into chunks (of time, say). Windows run inside a chunk; what a chunk needs from before it comes from a table
of one row per chunk, over which a second window runs. So a series that holds a third of all rows still spreads over as many
tasks as it has chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to a scratch folder and read it back: what it holds is fixed, whatever a retry would compute."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, parts: int, by: str) -> DataFrame:
    """Like stored(), with a number `_row` for each row, in buckets by a column: a join on it moves the other side's rows only."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    rows = df.repartition(parts, by).withColumn("_row", F.monotonically_increasing_id())
    rows.write.bucketBy(parts, by).option("path", scratch(spark)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: what lies under a path of its own stays
    return table


@contextmanager
def by_bucket(spark: SparkSession) -> Iterator[None]:
    """Inside, a task reads one bucket of a dealt table even where no join asks for it, instead of as many files as fill a split."""
    conf = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], out: str = "rank", parts: int | None = None, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """Add the rank (from 1, without gaps) of each row within its `keys`, by `order`, without gathering a large key in one task.

    Rows are dealt by ranges of (keys, order), whose bounds Spark samples, sorted inside their range and stored. So a key of many
    rows spreads over many ranges; a row's rank is its number among the key's rows in its own range and those in the ranges before.
    The second is a table of one row for each range, small enough for every task. Rows that tie on all of `order` are ranked in
    any order, once for all. A null key is a key like others.
    """
    spark = df.sparkSession
    by = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = store(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    heads = rows.groupBy("_range").agg(F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_last"))
    tails = rows.join(F.broadcast(heads.select("_range", "_last")), "_range").where(key.eqNullSafe(F.col("_last"))).groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    sums = heads.join(tails, "_range").withColumn("_sum", F.sum("_n").over(Window.partitionBy("_last").orderBy("_range")))
    sums = sums.withColumn("_prev", F.lag(F.struct("_last", "_sum")).over(Window.orderBy("_range")))
    open_ = sums.where(F.col("_prev._last").eqNullSafe(F.col("_first"))).select("_range", "_first", F.col("_prev._sum").alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy("_at"))
    before = F.when(key.eqNullSafe(F.col("_first")), F.col("_before")).otherwise(0)
    numbered = rows.withColumn("_i", inside).join(F.broadcast(open_), "_range", "left")
    return numbered.withColumn(out, F.col("_i") + before).drop("_at", "_range", "_i", "_first", "_before")


def with_previous(df: DataFrame, keys: list[str], order: str, columns: dict[str, str], chunk: str) -> DataFrame:
    """Add the columns' values of the row before, by `order` within `keys`; null for the first. `columns` maps to new names.

    `chunk` must rise with `order`. `order` must be unique within `keys`.
    """
    inside = Window.partitionBy(*keys, chunk).orderBy(order)
    last = df.groupBy(*keys, chunk).agg(F.max_by(F.struct(*columns), order).alias("_last"))
    carried = last.select(*keys, chunk, F.lag("_last").over(Window.partitionBy(*keys).orderBy(chunk)).alias("_carry"))
    out = df.withColumn("_n", F.row_number().over(inside))
    out = out.withColumns({new: F.lag(c).over(inside) for c, new in columns.items()}).join(carried, [*keys, chunk])
    first = F.col("_n") == 1
    return out.withColumns({new: F.when(first, F.col(f"_carry.{c}")).otherwise(F.col(new)) for c, new in columns.items()}).drop("_n", "_carry")


def with_running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], chunk: str) -> DataFrame:
    """Add the sums of columns over all rows up to this one, by `order` within `keys`. `sums` maps columns to new names.

    `chunk` must rise with `order`. `order` must be unique within `keys`.
    """
    inside = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, chunk).agg(*[F.sum(c).alias(f"_s_{new}") for c, new in sums.items()])
    totals = totals.select(*keys, chunk, *[F.coalesce(F.sum(f"_s_{new}").over(before), F.lit(0)).alias(f"_b_{new}") for new in sums.values()])
    out = df.withColumns({new: F.sum(c).over(inside) for c, new in sums.items()}).join(totals, [*keys, chunk])
    return out.withColumns({new: F.col(new) + F.col(f"_b_{new}") for new in sums.values()}).drop(*[f"_b_{new}" for new in sums.values()])


def with_running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str, chunk: str) -> DataFrame:
    """Add the sum of `value` (a number) over all rows up to this one, by `order` within `keys`."""
    return with_running_sums(df.withColumn("_v", value), keys, order, {"_v": out}, chunk).drop("_v")


def rolling_least(df: DataFrame, keys: list[str], order: str, width: int, value: str, out: str) -> DataFrame:
    """Add the least `value` of the rows whose order value is in [own - width, own], with constant work a row for any width.

    In blocks of `width` such a window is the head of its own block and the tail of the one before. The least value of the head is
    a running minimum. Rows of the block before, moved on by `width`, stand in the own block, and those that are still in the
    window are the ones at or after the row: a running minimum from the block's end. Neither frame is ever scanned anew.
    """
    block = F.floor(F.col(order) / F.lit(width))
    own = df.withColumns({"_block": block, "_own": F.lit(True)})
    moved = df.select(*keys, (F.col(order) + width).alias(order), F.col(value).alias("_moved"), (block + 1).alias("_block"))
    both = own.unionByName(moved, allowMissingColumns=True)
    at = Window.partitionBy(*keys, "_block")
    head, tail = F.min(F.when(F.col("_own"), F.col(value))).over(at.orderBy(order)), F.min("_moved").over(at.orderBy(F.desc(order)))
    return both.withColumn(out, F.least(head, tail)).where("_own").drop("_block", "_own", "_moved")
