"""Shared helpers: materialised tables, gapless numbering and block-wise word scans."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that a task turns into word arrays at a time (a longer single document is one block).
BLOCK_BYTES = 2 << 20
#: Bytes hashed at a time, which bounds the prefix sums.
HASH_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only local mode, where all is one machine, does without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="riskspan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that materialise() wrote and that nobody has dropped yet, in order.
_written: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors.

    Who asked for the result owns the tables behind it and drops them with drop_tables() once the result itself is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many tables of materialise() there are: a place for drop_tables()."""
    return len(_written)


def drop_tables(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Delete the tables that materialise() wrote after the first `since`, all or all but the last.

    Results that are still to be computed from them fail afterwards; written results do not.
    """
    gone = _written[since : len(_written) - 1 if but_last else None]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in gone:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def number_within(df: DataFrame, key: str, order: list[str], out: str, few: bool = False, rows_per_task: int = 500) -> DataFrame:
    """Gapless numbers from 0 within each `key`, without gathering a large key in one task.

    A key of more than rows_per_task rows is dealt over ceil(count / rows_per_task) parts by the hash of its order columns. A
    window inside the part numbers its rows, the counts of the parts before it give its first number. Counts are summed on the
    map side; keys with one part need none, and the tables of parts are joined without a hint, so that their measured size
    decides how. `few` says that the key has a proven, small number of values: the table of keys is then broadcast. Ties on
    all of `order` are numbered in any order.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task)
    parts = counts.select(F.col(key).alias("_k"), F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_c"))
    dealt = df.join(F.broadcast(parts) if few else parts, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    dealt = dealt.withColumn("_p", F.pmod(F.xxhash64(*order), F.coalesce("_c", F.lit(1))).cast("int"))
    sizes = dealt.where("_c is not null").groupBy(key, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(key).alias("_k"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(key, "_p").orderBy(*order)
    numbered = dealt.withColumn("_i", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, (F.col(key).eqNullSafe(F.col("_k"))) & (F.col("_p") == F.col("_q")), "left")
    return joined.withColumn(out, (F.coalesce("_from", F.lit(0)) + F.col("_i")).cast("long")).drop("_k", "_q", "_p", "_i", "_from", "_c")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes of text; every row is in exactly one run.

    The runs are copies, not views: some kernels misread arrays that start inside another's buffers.
    """
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    block = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.take(pa.array(range(a, b), pa.int64()))


def returning_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run`, after whose last batch the Python worker gives freed memory back: Spark keeps idle workers beside the next stage's."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others give memory back by themselves
            if trim:
                trim(0)

    return lean


def text_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The rows' UTF-8 bytes with one newline after each, and the n + 1 offsets of the rows in them (null: empty)."""
    texts = column.fill_null("").cast(pa.large_binary())
    joined = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    buffers, n = joined.buffers(), len(joined)
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[joined.offset : joined.offset + n + 1]
    return buffers[2].to_pybytes()[offsets[0] : offsets[-1]] if buffers[2] else b"", offsets - offsets[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        for k, b in enumerate((int(_BASE), inverse)):
            step = np.full(n, b, dtype=np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def scan_words(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of the rows: first byte, end byte, row number and a 64-bit hash of each word's bytes.

    Hashes are prefix sums of byte codes times powers of an odd base, so all words of a block are hashed at once; blocks are
    cut between words, which bounds the temporary arrays for texts of any length.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES)))
        first, end = int(starts[at]), int(ends[last - 1])
        up, down = _power_tables(end - first + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw[first:end]] * up[: end - first])))
        s, e = starts[at:last] - first, ends[at:last] - first
        hashes[at:last] = (total[e] - total[s]) * down[s]
        at = last
    lengths = (ends - starts).astype(np.uint64)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, mix(hashes + lengths * np.uint64(0xD6E8FEB86659FD93))


_WINDOW = np.uint64(0xA0761D6478BD642F)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every k consecutive words (len - k + 1 of them), rolled from the words' hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = h * _WINDOW + words[i : i + n]
    return mix(h)


def starts_of(row: np.ndarray, n_rows: int) -> np.ndarray:
    """n_rows + 1 positions: where each row's words start in the word arrays."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def count_codepoints(raw: np.ndarray) -> np.ndarray:
    """1 for each byte that starts a code point."""
    return (raw & 0xC0) != 0x80
