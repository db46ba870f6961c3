"""A store of rows by key on plain files: look-ups read only what can hold the keys that are asked for.

Rows lie in runs, one for each append, and in a run by the first two digits of their key (a hexadecimal hash). Beside each run
lies a Bloom filter of its keys, as bitmaps of 32,768 bits for each prefix. A manifest names the runs that count; it is written
last, under a number that nobody else can take, so an append or compaction that is cut off leaves the store as it was.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits that a key sets, and bits of a filter for each key (about one false look-up in a hundred).
PROBES, BITS_A_KEY = 4, 10
_PAGE = 32_768


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def runs(spark: SparkSession, folder: str) -> tuple[int, list[str]]:
    """Number of the last manifest, and the runs it names, oldest first; 0 and none before the first append."""
    files, at = _files(spark, f"{folder}/manifest")
    if not files.exists(at):
        return 0, []
    last = max((int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit()), default=0)
    if not last:
        return 0, []
    lines = spark.read.text(f"{folder}/manifest/{last:08d}").collect()  # a line for each run
    return last, [r["value"] for r in lines if r["value"]]


def _commit(spark: SparkSession, folder: str, number: int, names: list[str]) -> None:
    """Make `names` the runs that count. Fails if another writer has taken the number, as then its runs would be lost."""
    files, at = _files(spark, f"{folder}/manifest/{number:08d}")
    out = files.create(at, False)
    out.write(bytearray("\n".join(names), "utf-8"))
    out.close()


def _prefix(key: Column) -> Column:
    return F.substring(key, 1, 2)


def _probes(key: Column, bits: Column) -> Column:
    """The bits of a key in a filter of so many bits."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), bits) for i in range(PROBES)])


def _write(spark: SparkSession, folder: str, rows: DataFrame) -> str | None:
    """A new run of the rows and its filter; None if there are no rows."""
    name = uuid.uuid4().hex
    data = f"{folder}/data/{name}"
    rows.withColumn("prefix", _prefix(F.col("key"))).repartition("prefix").write.partitionBy("prefix").parquet(data)
    kept = spark.read.schema(rows.schema.add("prefix", "string")).parquet(data).select("key", "prefix")
    counts = kept.groupBy("prefix").agg((F.ceil(F.count(F.lit(1)) * BITS_A_KEY / _PAGE) * _PAGE).alias("bits"))  # at most 256 rows
    bits = kept.join(F.broadcast(counts), "prefix").select("prefix", "bits", F.explode(_probes(F.col("key"), F.col("bits"))).alias("bit"))
    pages = bits.groupBy("prefix", "bits", F.floor(F.col("bit") / _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % _PAGE).alias("bitmap"))
    pages.write.parquet(f"{folder}/filter/{name}")
    return name if counts.limit(1).count() else None


def append(rows: DataFrame, folder: str) -> None:
    """Add rows (key and any other columns, the same at each append). A key that is there already keeps its oldest row."""
    spark = rows.sparkSession
    number, names = runs(spark, folder)
    name = _write(spark, folder, rows.dropDuplicates(["key"]))
    if name:
        _commit(spark, folder, number + 1, [*names, name])


def _may_hold(asked: DataFrame, folder: str, name: str) -> DataFrame:
    """Those of the keys (key, prefix) whose bits are all set in a run's filter."""
    pages = asked.sparkSession.read.parquet(f"{folder}/filter/{name}")
    sizes = pages.select("prefix", "bits").distinct()  # at most 256 rows
    probes = asked.join(F.broadcast(sizes), "prefix").select("key", "prefix", F.explode(_probes(F.col("key"), F.col("bits"))).alias("bit"))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") % _PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = probes.withColumn("page", F.floor(F.col("bit") / _PAGE)).join(pages.drop("bits"), ["prefix", "page"])
    held = found.where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
    return held.groupBy("key", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == PROBES).select("key", "prefix")


def lookup(keys: DataFrame, folder: str) -> DataFrame | None:
    """The rows of the distinct `keys` (column key) that the store holds; None if it is empty.

    Of a run only the prefixes with a key that its filter lets pass are read.
    """
    spark = keys.sparkSession
    found = []
    asked = keys.select("key").where("key IS NOT NULL").distinct().withColumn("prefix", _prefix(F.col("key")))
    for age, name in enumerate(runs(spark, folder)[1]):
        maybe = _may_hold(asked, folder, name)
        prefixes = [r["prefix"] for r in maybe.select("prefix").distinct().collect()]  # at most 256
        rows = spark.read.parquet(f"{folder}/data/{name}").where(F.col("prefix").isin(prefixes))
        found.append(rows.join(maybe, ["key", "prefix"], "left_semi").withColumn("_age", F.lit(age)))
    if not found:
        return None
    columns = [c for c in found[0].columns if c not in ("key", "prefix", "_age")]
    oldest = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.min_by(F.struct(*columns), "_age").alias("_row"))
    return oldest.select("key", *[F.col(f"_row.{c}").alias(c) for c in columns])


def missing(keys: DataFrame, folder: str) -> DataFrame:
    """The distinct keys that the store does not hold."""
    asked, held = keys.select("key").distinct(), lookup(keys, folder)
    return asked if held is None else asked.join(held.select("key"), "key", "left_anti")


def compact(spark: SparkSession, folder: str) -> None:
    """One run in place of all. Readers of older manifests keep their files until drop_old()."""
    number, names = runs(spark, folder)
    if len(names) > 1:
        rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/data/{n}").drop("prefix").withColumn("_age", F.lit(age)) for age, n in enumerate(names)])
        columns = [c for c in rows.columns if c not in ("key", "_age")]
        one = rows.groupBy("key").agg(F.min_by(F.struct(*columns), "_age").alias("_row")).select("key", *[F.col(f"_row.{c}").alias(c) for c in columns])
        _commit(spark, folder, number + 1, [_write(spark, folder, one)])


def drop_old(spark: SparkSession, folder: str) -> None:
    """Delete the runs that the last manifest does not name: only while nobody writes or reads an older manifest."""
    names = set(runs(spark, folder)[1])
    for kind in ("data", "filter"):
        files, at = _files(spark, f"{folder}/{kind}")
        for status in files.listStatus(at) if files.exists(at) else []:
            if status.getPath().getName() not in names:
                files.delete(status.getPath(), True)
