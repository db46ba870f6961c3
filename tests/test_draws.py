"""Draws as functions of their counters: the same in SQL, in arrays and in every partitioning, and spread like random ones."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from riskspan.functions import draws as D


def test_columns_arrays_and_sql_draw_the_same(spark):
    rows = [(0, 0), (1, 2), (2, 1), (-1, 5), (10**12, -(10**15)), (2**62, 2**33 + 1)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = {(r.a, r.b): r.x for r in df.repartition(3).select("a", "b", D.bits(9, F.col("a"), F.col("b")).alias("x")).collect()}
    a, b = (np.array(c) for c in zip(*rows))
    assert [got[r] for r in rows] == D.bits_of(9, a, b).tolist()
    assert [duckdb.sql(f"SELECT {D.bits_sql(9, str(x), str(y))}").fetchall()[0][0] for x, y in rows] == [got[r] for r in rows]
    assert got[1, 2] != got[2, 1]


def test_draws_are_spread_evenly_and_normally(spark):
    n = 40_000
    r = spark.range(n).select(D.uniform(3, F.col("id")).alias("u"), D.normal(3, F.col("id")).alias("z")).toPandas()
    assert np.abs(np.histogram(r.u, 20, (0, 1))[0] / n - 0.05).max() < 0.006
    assert abs(r.z.mean()) < 0.02 and abs(r.z.std() - 1) < 0.02 and abs((r.z.abs() > 1.96).mean() - 0.05) < 0.005
    assert abs(np.corrcoef(r.u[1:], r.u[:-1])[0, 1]) < 0.02
