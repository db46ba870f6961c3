"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector o is rotated and only the signs of its components are kept, packed to bits: x, the corner of the cube nearest to
it. With the scalar <x, o>, kept beside the code, <x, q> / <x, o> estimates the cosine of o and a query q without bias; its error
is below `bound` times sqrt((1 - <x, o>^2) / (<x, o>^2 (d - 1))) but for a chance that falls with the square of `bound`. A query
looks its inner products up byte by byte, and only vectors whose upper bound reaches the fifth best cosine found so far are
compared exactly, on the original vectors.

Queries meet vectors in a grid: vectors are dealt over columns, queries over rows, and a cell holds its row's queries, whose
number is bounded, while its column's vectors stream by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import materialise, table

#: Error bound in standard deviations of the estimate.
BOUND = 3.5
#: Queries that a cell of the grid holds at most on average, and vectors that it reads.
QUERIES_A_CELL = 1 << 16
VECTORS_A_CELL = 1 << 20
#: Seed of the rotation.
SEED = 20_240_611
#: Vectors that one query meets at a time.
STEP = 4_096

INDEX = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("code", BinaryType()), StructField("factor", DoubleType())])
FOUND = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])

_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if dim not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
        _rotations[dim] = q * np.sign(np.diag(r))
    return _rotations[dim]


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1. Each is scaled by its largest component first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, [vector, byte], and the scalars <x, o>."""
    turned = units(vectors) @ rotation(vectors.shape[1]).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


#: [bit, value of a byte]: the signs that the byte's bits stand for.
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1).T


def turned_bytes(queries: np.ndarray) -> np.ndarray:
    """[query, byte of a code, bit]: the components that each bit of a code signs, scaled so that a code's corner has length 1."""
    n, dim = queries.shape
    padded = np.zeros((n, -(-dim // 8) * 8))
    padded[:, :dim] = units(queries) @ rotation(dim).T / np.sqrt(dim)
    return padded.reshape(n, -1, 8)


def lookup(turned: np.ndarray) -> np.ndarray:
    """Of one query, for each byte of a code and each value of the byte: its share of <x, q>, one after the other."""
    return (turned @ _SIGNS).reshape(-1)


def spread(factor: np.ndarray, dim: int) -> np.ndarray:
    """Standard deviation of the estimated cosine."""
    return np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, dim - 1)))


def _cosines(query: np.ndarray, query_norm: float, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Each score depends on its own two vectors only, not on what is computed beside it."""
    return (vectors * query).sum(axis=1) / (norms * query_norm)


def _rows(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch by number of components: vectors that are null, zero or hold null or non-finite ones are left out."""
    column = batch.column("embedding")
    lengths = np.asarray(pc.list_value_length(column).fill_null(0))
    out = []
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        values = pc.cast(column.take(pa.array(rows)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
        fine = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
        if fine.any():
            out.append((rows[fine], values[fine]))
    return out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(INDEX)
    for batch in batches:
        for rows, vectors in _rows(batch):
            code, factor = encode(vectors)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.reshape(-1)))
            cells = [batch.column("vec_id").take(pa.array(rows)), flat.cast(schema.field("embedding").type), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor)]
            yield pa.RecordBatch.from_arrays(cells, schema=schema)


class _Cell:
    """The queries of one cell, of vectors of one length, and the best that each has found so far."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k = dim, k
        self.ids: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.turned: np.ndarray | None = None

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)

    def close(self) -> None:
        self.id, self.vector = np.concatenate(self.ids), np.concatenate(self.vectors)
        self.norm = np.sqrt((self.vector * self.vector).sum(axis=1))
        self.turned = turned_bytes(self.vector)
        self.best = [(np.empty(0), np.empty(0, np.int64))] * len(self.id)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, code: np.ndarray, factor: np.ndarray, bound: float) -> None:
        if self.turned is None:
            self.close()
        norms, error = np.sqrt((vectors * vectors).sum(axis=1)), bound * spread(factor, self.dim)
        at = code.T + 256 * np.arange(code.shape[1])[:, None]
        for i, own in enumerate(self.id):
            upper = lookup(self.turned[i])[at].sum(axis=0) / factor + error
            upper[ids == own] = -np.inf
            score, who = self.best[i]
            if len(score) < self.k:
                # The first look: the vectors with the best estimates give a threshold.
                first = np.argpartition(-upper, self.k)[: self.k] if len(upper) > self.k else np.arange(len(upper))
                first = first[upper[first] > -np.inf]
                seen = -np.sort(-np.concatenate((score, _cosines(self.vector[i], self.norm[i], vectors[first], norms[first]))))
                least = seen[self.k - 1] if len(seen) >= self.k else -np.inf
            else:
                least = score[-1]
            near = np.flatnonzero((upper >= least) & (upper > -np.inf))
            if len(near):
                exact = _cosines(self.vector[i], self.norm[i], vectors[near], norms[near])
                score, who = np.concatenate((score, exact)), np.concatenate((who, ids[near]))
                order = np.lexsort((who, -score))[: self.k]
                self.best[i] = (score[order], who[order])

    def found(self) -> pa.RecordBatch:
        if self.turned is None:
            self.close()
        size = [len(s) for s, _ in self.best]
        cells = [np.repeat(self.id, size), np.concatenate([w for _, w in self.best]), np.concatenate([s for s, _ in self.best])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], schema=to_arrow_schema(FOUND))


def _search(k: int, bound: float):
    """A cell's rows come together, its queries first. Only queries and their best are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            cells = np.stack([np.asarray(batch.column(c)) for c in ("_row", "_column")], axis=1)
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for lo in range(a, b, STEP):
                    part = batch.slice(lo, min(STEP, b - lo))
                    if cell != (now := tuple(cells[a])):
                        yield from (x.found() for x in held.values())
                        cell, held = now, {}
                    asks, all_ids = np.asarray(part.column("_kind")) == 0, np.asarray(part.column("vec_id"))
                    for rows, vectors in _rows(part):
                        dim, ask = vectors.shape[1], asks[rows]
                        if ask.any():
                            held.setdefault(dim, _Cell(dim, k)).add(all_ids[rows[ask]], vectors[ask])
                        if not ask.all() and dim in held:
                            data = rows[~ask]
                            code = np.frombuffer(b"".join(part.column("code").take(pa.array(data)).to_pylist()), np.uint8).reshape(len(data), -1).astype(np.int64)
                            held[dim].meet(all_ids[data], vectors[~ask], code, np.asarray(part.column("factor"))[data], bound)
        yield from (x.found() for x in held.values())

    return run


def build_index(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, code and factor of every vector that takes part: the written index.

    One row for each id: of several vectors of an id the least, in the order of arrays, stays. Null ids take no part.
    """
    source = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    single = source.where(usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return materialise(single.mapInArrow(_encode, INDEX), "one-bit-codes")


def nearest(index: DataFrame, asking: DataFrame, k: int = 5, bound: float = BOUND) -> DataFrame:
    """query_id, rank, vec_id and score: the k vectors of the index with the largest cosine to each row of `asking` (a part of it).

    A row is no candidate of its own; vectors of another number of components are none either. Fewer than k candidates are all
    returned; ties go to the smaller id. Grid: with R rows and C columns every vector is sent R times and every query C times.
    """
    spark = index.sparkSession
    n, queries = index.count(), asking.count()
    across = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // VECTORS_A_CELL))
    down = max(1, -(-queries // QUERIES_A_CELL))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int").alias("_column")
    asked = asking.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(down)).cast("int").alias("_row"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_column"), F.lit(0).alias("_kind"), "vec_id", "embedding", "code", "factor")
    stored = index.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_row"), part, F.lit(1).alias("_kind"), "vec_id", "embedding", "code", "factor")
    dealt = asked.unionByName(stored).repartition(min(across * down, 100_000), "_row", "_column").sortWithinPartitions("_row", "_column", "_kind", "vec_id")
    found = dealt.mapInArrow(_search(k, bound), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast(IntegerType())).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = 5, every: int = 50, bound: float = BOUND) -> DataFrame:
    """The k nearest of each vector whose id is divisible by `every`, among all others.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id. Rows
    repeated whole count once; of several vectors of an id the least stays. Ids must be integers; other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    index = build_index(vectors)
    return nearest(index, index.where(F.col("vec_id") % every == 0), k, bound)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


_ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON len(q.e) = len(v.e) AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op11_nearest_neighbours": op11}
ORACLE_SQL = {"op11_nearest_neighbours": _ORACLE}
