"""Exact selection by rank without sorting or gathering a key's values: rounds of histograms over the digits of the values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import stored

#: Bits of a digit: a round's histogram has at most 2^DIGIT rows for each key.
DIGIT = 16


def at_rank(df: DataFrame, keys: list[str], value: str, rank: Callable[[Column], Column], out: str, digit: int = DIGIT) -> DataFrame:
    """Keys, n (values that are not null) and `out`: the value that has `rank(n)` (from 0) values before it in ascending order.

    `value` must be an integer column. Equal values of a key are summed first, on the map side; what is left is dealt by key and
    value. Each round counts one digit of the values, the highest first, and keeps the values of the bucket that holds the rank.
    So a task sees at most one histogram of a key, however many values the key has. Null values do not count; keys without other
    values, and keys that are null, are left out.
    """
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("long").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    least, most = counts.agg(F.min("_v"), F.max("_v")).first()
    offset = F.col("_v") - F.lit(least or 0)
    rounds = max(1, -(-((most or 0) - (least or 0)).bit_length() // digit))
    per_key, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    chosen = None
    for k in reversed(range(rounds)):
        rows = counts.withColumn("_bucket", F.shiftright(offset, k * digit))
        if chosen is not None:
            rows = rows.withColumn("_prefix", F.shiftright("_bucket", digit)).join(chosen, [*keys, "_prefix"])
        told = [] if chosen is None else [F.first(c).alias(c) for c in ("_want", "n")]
        found = rows.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_c"), *told)
        if chosen is None:
            found = found.withColumn("n", F.sum("_c").over(per_key)).withColumn("_want", rank(F.col("n")).cast("long"))
        found = found.withColumn("_upto", F.sum("_c").over(ordered)).where((F.col("_want") < F.col("_upto")) & (F.col("_want") >= F.col("_upto") - F.col("_c")))
        chosen = found.select(*keys, F.col("_bucket").alias("_prefix"), (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_want"), "n")
    return chosen.select(*keys, "n", (F.col("_prefix") + F.lit(least or 0)).alias(out))


def upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Keys, n and the element at n // 2 of the sorted values: the upper of the two middle ones."""
    return at_rank(df, keys, value, lambda n: F.floor(n / 2), out)
