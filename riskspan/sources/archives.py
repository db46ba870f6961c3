"""Exchange archives as a data source: one ZIP for each series and period, `{folder}/{series}/{series}-{period}.zip`.

A reader is planned for each archive, so a filter on series_id or period opens no other one. The CSV inside is read as a stream,
a member at a time; an archive that cannot be read is a row that says so (one leg that fails does not fail the others). The
stream form goes through the same reader, in the order of periods.

The folder is any that pyarrow's file systems open (local paths and URIs such as file:, s3:, gs: and hdfs:).
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FORMAT = "kline_archives"
SCHEMA = "series_id string, period string, ts bigint, value double, error string"
_ARROW = pa.schema([("series_id", pa.string()), ("period", pa.string()), ("ts", pa.int64()), ("value", pa.float64()), ("error", pa.string())])
_NAME = re.compile(r"(?P<series>[^/]+)/(?P=series)-(?P<period>\d{4}-\d{2}(?:-\d{2})?)\.zip$")
#: Samples of one batch.
BATCH = 50_000


def _listed(folder: str) -> list[tuple[str, str, str]]:
    """(period, series, path) of the archives below a folder, by period and series."""
    files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    found = [(m["period"], m["series"], i.path) for i in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if (m := _NAME.search(i.path))]
    return sorted(found)


class Archive(InputPartition):
    def __init__(self, period: str, series: str, path: str) -> None:
        self.period, self.series, self.path = period, series, path


def _samples(source) -> Iterator[tuple[int, float]]:
    """(ts, value) of the CSV members of an open archive; headers and bad lines are skipped, as parse_klines() does."""
    with zipfile.ZipFile(source) as archive:
        for member in archive.namelist():
            if member.endswith(".csv"):
                with archive.open(member) as raw:
                    for line in io.TextIOWrapper(raw, "utf-8", errors="replace"):
                        cells = line.rstrip("\r\n").split(",")
                        try:
                            at, value = int(float(cells[0])), float(cells[4])
                        except (ValueError, IndexError, OverflowError):
                            continue
                        yield at // (1_000_000 if at > 10**13 else 1_000), value


def _batch(part: Archive, rows: list[tuple[int, float]], error: str | None = None) -> pa.RecordBatch:
    n = max(1, len(rows)) if error else len(rows)
    cells = [[part.series] * n, [part.period] * n, [r[0] for r in rows] or [None] * n, [r[1] for r in rows] or [None] * n, [error] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _ARROW, strict=True)], schema=_ARROW)


def _read(folder: str, part: Archive) -> Iterator[pa.RecordBatch]:
    files = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
    try:
        with files.open_input_file(part.path) as source:
            samples = _samples(source)
            while rows := list(islice(samples, BATCH)):
                yield _batch(part, rows)
    except pa.ArrowInvalid as e:  # too short for what every archive ends with
        yield _batch(part, [], f"BadZipFile: {e}"[:200])
    except (OSError, zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError) as e:  # damaged, cut off, encrypted, unknown compression
        yield _batch(part, [], f"{type(e).__name__}: {e}"[:200])


_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.conditions = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on series_id and period choose archives; all others are left to Spark."""
        for f in filters:
            if type(f) in _TESTS and getattr(f, "attribute", None) in (("series_id",), ("period",)):
                self.conditions.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        """At least one: Spark takes no partitions for one whole read."""
        chosen = [Archive(*x) for x in _listed(self.folder) if all(_TESTS[kind](x[1] if column == "series_id" else x[0], value) for column, kind, value in self.conditions)]
        return chosen or [Archive("", "", "")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition) if partition.path else iter(())


class ArchiveStream(DataSourceStreamReader):
    """Offsets are numbers of archives in the order of periods, so archives must arrive in that order; one that comes late is not read."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"archives": 0}

    def latestOffset(self) -> dict:
        return {"archives": len(_listed(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[Archive]:
        return [Archive(*x) for x in _listed(self.folder)[start["archives"] : end["archives"]]]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition)


class KlineArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(self.options["path"])


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of all archives below a folder, and a row with `error` for each that cannot be read."""
    _register(spark)
    return spark.read.format(FORMAT).option("path", folder).load()


def archive_stream(spark: SparkSession, folder: str) -> DataFrame:
    _register(spark)
    return spark.readStream.format(FORMAT).option("path", folder).load()


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KlineArchives)


def write_archives(series: DataFrame, folder: str, period: str = "yyyy-MM") -> DataFrame:
    """Write a series table (series_id, ts, value) as archives of millisecond klines; returns (series_id, period, samples) of each.

    A group is one series in one period: at most as many rows as the period has seconds.
    """

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        own, when = (k.as_py() for k in key)
        files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        files.create_dir(f"{root}/{own}", recursive=True)
        table = table.sort_by("ts")
        with files.open_output_stream(f"{root}/{own}/{own}-{when}.zip") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(f"{own}-{when}.csv", "w") as out:
            out.write(b"open_time,open,high,low,close\n")
            for ts, value in zip(table.column("ts").to_pylist(), table.column("value").to_pylist(), strict=True):
                out.write(f"{ts * 1_000},,,,{value!r}\n".encode())
        return pa.table({"series_id": [own], "period": [when], "samples": pa.array([table.num_rows], pa.int64())})

    dated = series.select("series_id", F.date_format(F.timestamp_seconds("ts"), period).alias("period"), "ts", "value")
    return dated.groupBy("series_id", "period").applyInArrow(pack, "series_id string, period string, samples long")
