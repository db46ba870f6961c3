"""Archives written and read back, with pruning, damaged legs and a stream over several runs."""

import io
import zipfile

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains

from riskspan.sources import archives as A
from riskspan.streaming import series as live


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(s, 1_704_067_200 + 86_400 * d + 60 * i, d + i / 10) for s in ("x", "y") for d in range(40) for i in range(5)]
    assert A.write_archives(spark.createDataFrame(rows, "series_id string, ts bigint, value double"), str(tmp_path / "a")).count() == 4
    (tmp_path / "a/x/x-2024-03.zip").write_bytes(b"PK\x03\x04 cut off")
    (tmp_path / "a/x/readme.txt").write_text("no archive")
    return str(tmp_path / "a")


def test_only_chosen_archives_are_opened(spark, folder):
    reader = A.ArchiveReader(folder)
    left = list(reader.pushFilters([EqualTo(("series_id",), "x"), GreaterThanOrEqual(("period",), "2024-02"), StringContains(("error",), "z")]))
    assert [type(f) for f in left] == [StringContains]
    assert [(p.series, p.period) for p in reader.partitions()] == [("x", "2024-02"), ("x", "2024-03")]
    got = A.archives(spark, folder).where("series_id = 'y' AND period = '2024-02'").collect()
    assert len(got) == 45 and {r.period for r in got} == {"2024-02"} and A.archives(spark, folder).where("period > '2030'").count() == 0


def test_a_damaged_archive_is_a_row_and_others_are_read(spark, folder):
    rows = A.archives(spark, folder).collect()
    assert [(r.series_id, r.period, r.ts) for r in rows if r.error] == [("x", "2024-03", None)]
    assert sum(r.error is None for r in rows) == 400


def test_headers_bad_lines_and_microseconds():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("a.csv", "open_time,o,h,l,close\n1704067200000,1,1,1,0.5\nbad\n1704067260000000,1,1,1,0.25\n1,2\n")
        z.writestr("notes.txt", "1704067200000,1,1,1,9\n")
    assert list(A._samples(sink)) == [(1_704_067_200, 0.5), (1_704_067_260, 0.25)]


def test_the_stream_goes_on_where_it_stopped(spark, folder, tmp_path):
    first = live.run_available(A.archive_stream(spark, folder), str(tmp_path / "run")).count()
    rows = spark.createDataFrame([("x", 1_712_000_000, 1.0)], "series_id string, ts bigint, value double")
    A.write_archives(rows, folder).collect()
    again = live.run_available(A.archive_stream(spark, folder), str(tmp_path / "run"))
    assert first == 401 and again.count() == 402 and again.where("period = '2024-04'").count() == 1
