"""Centroid clustering by ball-tree filtering.

Every partition builds metric trees over its own vectors, once, and writes them: a node stores its ball's radius, the number
of its vectors and their integer sum. A round sends the centroids (k times the dimension, all that ever reaches the driver)
through the trees: a centroid that another one beats for every point of a ball, by the triangle inequality, is struck off for
the whole subtree; a ball with one centroid left goes to it as a whole, with its count and sum; what reaches a leaf with more
than one is compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import materialise, table

#: Vectors of a tree (2 MB at 64 components) and of a leaf.
TREE = 4_096
LEAF = 24
#: Components are multiplied by this and rounded down.
SCALE = 1_024
#: Larger components would carry squared distances beyond 64 bits.
MOST = 1 << 27

TREES = StructType([
    StructField("ids", ArrayType(LongType())), StructField("points", BinaryType()),
    StructField("lo", ArrayType(IntegerType())), StructField("hi", ArrayType(IntegerType())), StructField("parent", ArrayType(IntegerType())), StructField("leaf", ArrayType(IntegerType())),
    StructField("radius", ArrayType(DoubleType())), StructField("sums", BinaryType()),
])


def quantised(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept (exactly `dim` components, none null, non-finite or beyond MOST) and their integer components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(np.asarray(pc.equal(pc.list_value_length(column), dim).fill_null(False)))
    values = pc.cast(column.take(pa.array(rows)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(values * SCALE)
    fine = (np.isfinite(values) & (np.abs(whole) <= MOST)).all(axis=1)
    return rows[fine], whole[fine].astype(np.int64)


def build_tree(points: np.ndarray, leaf: int = LEAF):
    """A metric tree: the order of the points and, level by level, each node's range in it, parent, whether it is a leaf, radius and
    integer sum. A ball is split between a point far from its centre and the point farthest from that one."""
    order = np.arange(len(points))
    lo, hi, parent, ends, radius, sums = [0], [len(points)], [-1], [], [], []
    k = 0
    while k < len(lo):
        a, b = lo[k], hi[k]
        own = points[order[a:b]]
        total = own.sum(axis=0)
        away = np.sqrt(((own - total / (b - a)) ** 2).sum(axis=1))
        radius.append(float(away.max()) * (1 + 1e-9) + 1e-6)
        sums.append(total)
        cut = 0
        if b - a > leaf:
            one = own[int(away.argmax())]
            to_one = ((own - one) ** 2).sum(axis=1)
            two = own[int(to_one.argmax())]
            near = to_one <= ((own - two) ** 2).sum(axis=1)
            cut = int(near.sum())
            if 0 < cut < b - a:
                order[a:b] = np.concatenate((order[a:b][near], order[a:b][~near]))
                lo += [a, a + cut]
                hi += [a + cut, b]
                parent += [k, k]
            else:  # copies of one vector stay together: their ball has no extent
                cut = 0
        ends.append(int(cut == 0))
        k += 1
    return order, np.array(lo), np.array(hi), np.array(parent), np.array(ends), np.array(radius), np.stack(sums)


def _trees(dim: int):
    schema = to_arrow_schema(TREES)

    def row(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        order, lo, hi, parent, leaf, radius, sums = build_tree(points)
        cells = [pa.array([ids.take(pa.array(order)).to_pylist()], schema.field("ids").type), pa.array([points[order].tobytes()], pa.binary())]
        cells += [pa.array([x.tolist()], schema.field(n).type) for n, x in (("lo", lo), ("hi", hi), ("parent", parent), ("leaf", leaf), ("radius", radius))]
        return pa.RecordBatch.from_arrays([*cells, pa.array([sums.tobytes()], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0
        for batch in batches:
            rows, whole = quantised(batch.column("embedding"), dim)
            own = batch.column("vec_id").take(pa.array(rows))
            at = 0
            while at < len(rows):
                n = min(TREE - held, len(rows) - at)
                ids.append(own.slice(at, n))
                points.append(whole[at : at + n])
                held, at = held + n, at + n
                if held == TREE:
                    yield row(pa.concat_arrays(ids), np.concatenate(points))
                    ids, points, held = [], [], 0
        if held:
            yield row(pa.concat_arrays(ids), np.concatenate(points))

    return run


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances, [point, centre]."""
    out = np.empty((len(points), len(centres)), np.int64)
    for k, c in enumerate(centres):
        d = points - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def filter_tree(points, lo, hi, parent, leaf, radius, sums, centres):
    """Which nodes go to one centroid as a whole (node, centroid), and for the points of the leaves that are left their numbers and
    centroids. A struck-off centroid is farther than another one from every point of the ball, by more than rounding."""
    mean = sums / (hi - lo)[:, None]
    away = np.sqrt(((mean[:, None, :] - centres[None, :, :].astype(np.float64)) ** 2).sum(axis=2))
    slack = 1e-6 + 1e-9 * away
    least, most = away - radius[:, None] - slack, away + radius[:, None] + slack
    mine = np.ones((len(lo), len(centres)), bool)
    whole = np.full(len(lo), -1)
    done = np.zeros(len(lo), bool)
    up = np.maximum(parent, 0)
    # Parents come before children, and a level's nodes follow each other: one step a level.
    depth = np.zeros(len(lo), np.int64)
    for k in range(1, len(lo)):
        depth[k] = depth[parent[k]] + 1
    for level in range(int(depth.max()) + 1):
        at = np.flatnonzero(depth == level)
        if level:
            mine[at] = mine[up[at]]
            done[at] = done[up[at]] | (whole[up[at]] >= 0)
        bound = np.where(mine[at], most[at], np.inf).min(axis=1)
        mine[at] &= least[at] <= bound[:, None]
        one = at[(mine[at].sum(axis=1) == 1) & ~done[at]]
        whole[one] = mine[one].argmax(axis=1)
    balls = np.flatnonzero(whole >= 0)
    rest = np.flatnonzero((leaf == 1) & ~done & (whole < 0))
    size = (hi - lo)[rest]
    ends = np.cumsum(size)
    loose = np.repeat(lo[rest] - (ends - size), size) + np.arange(int(size.sum()))
    exact = np.where(np.repeat(mine[rest], size, axis=0), _squared(points[loose], centres), np.iinfo(np.int64).max)
    return balls, whole[balls], loose, exact.argmin(axis=1)


def _unpacked(batch: pa.RecordBatch, dim: int):
    """The trees of a batch: ids, points, nodes."""
    for r in range(batch.num_rows):
        cell = {n: batch.column(n)[r] for n in batch.schema.names}
        arrays = [cell[n].values.to_numpy(zero_copy_only=False) for n in ("lo", "hi", "parent", "leaf", "radius")]
        yield cell["ids"].values, np.frombuffer(cell["points"].as_buffer(), np.int64).reshape(-1, dim), *arrays, np.frombuffer(cell["sums"].as_buffer(), np.int64).reshape(-1, dim)


def _round(centres: np.ndarray):
    """Counts and sums of each centroid's vectors, one row for each centroid and task."""
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for _, points, lo, hi, parent, leaf, radius, sums in _unpacked(batch, dim):
                balls, to, loose, of = filter_tree(points, lo, hi, parent, leaf, radius, sums, centres)
                np.add.at(count, to, (hi - lo)[balls])
                np.add.at(total, to, sums[balls])
                count += np.bincount(of, minlength=k)
                np.add.at(total, of, points[loose])
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assign(centres: np.ndarray):
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, lo, hi, parent, leaf, radius, sums in _unpacked(batch, dim):
                balls, to, loose, of = filter_tree(points, lo, hi, parent, leaf, radius, sums, centres)
                cluster = np.empty(len(points), np.int32)
                for b, c in zip(balls, to, strict=True):
                    cluster[lo[b] : hi[b]] = c
                cluster[loose] = of
                d = points - centres[cluster]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(cluster), pa.array(np.einsum("ij,ij->i", d, d))], names=["vec_id", "cluster", "distance"])

    return run


def starts(vectors: DataFrame, k: int, dim: int) -> np.ndarray:
    """The kept vectors with the k smallest SHA-256 hashes of `3:<vec_id>`, in that order. Equal ids go by their components; null ids are no starts."""

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole = quantised(batch.column("embedding"), dim)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(whole.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("_hash").take(pa.array(rows)), flat], names=["hash", "point"])

    hashed = vectors.where(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256).alias("_hash"), "embedding")
    first = hashed.mapInArrow(integers, "hash string, point array<bigint>").orderBy("hash", "point").limit(k).collect()  # k rows
    return np.array([r["point"] for r in first], np.int64).reshape(-1, dim)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of exactly `dim` components, none null or non-finite; each component x becomes floor(1024 * x). Components
    of more than 2^27 in size after that take the vector out, as its distances would not fit 64 bits. `rounds` times all vectors
    go to the nearest centroid (ties: smaller number) and non-empty centroids move to the rounded-down mean; then vectors are
    assigned once more. Fewer than k kept vectors give as many centroids; no kept vectors (an empty table too) no rows. Repeated
    rows and rows that share an id are vectors of their own; rows with a null id are clustered too. Other columns are ignored,
    whatever their names.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    trees = materialise(source.mapInArrow(_trees(dim), TREES), "ball-trees")
    centres = starts(source, k, dim)
    out = StructType([StructField("vec_id", LongType()), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    if not len(centres):
        # No vector has an id to start from: nothing can be assigned.
        empty = spark.createDataFrame([], out)
        return empty.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        parts = trees.mapInArrow(_round(centres), "cluster int, n long, sums array<bigint>").where("n > 0")
        sums = [F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)]
        moved = centres.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # at most k rows
            moved[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dim)]
        if np.array_equal(moved, centres):
            break  # further rounds would repeat this one
        centres = moved
    found = materialise(trees.mapInArrow(_assign(centres), out), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    own = spark.createDataFrame([(c, s, sum(inertia.values()), names[c]) for c, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    parts = [f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, q FROM kept),
f AS MATERIALIZED (SELECT r, unnest(range(1, {dim + 1})) AS j, unnest(q) AS x FROM v),
h AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), q) - 1 AS c, q FROM v WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT c, unnest(range(1, {dim + 1})) AS j, unnest(q) AS x FROM h WHERE c < {k})"""]  # fmt: skip
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT f.r, c, sum((f.x - c{i}.x) * (f.x - c{i}.x))::BIGINT AS d FROM f JOIN c{i} USING (j) GROUP BY f.r, c), a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY r)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM f JOIN a{i} USING (r) GROUP BY c, j), c{i + 1} AS MATERIALIZED (SELECT c, j, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{i} LEFT JOIN m{i} USING (c, j))")
    return "WITH " + ",\n".join(parts) + f""",
names AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY j)) AS sha FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN names USING (c)"""  # fmt: skip


QUERIES = {"op13_centroid_clustering": op13}
ORACLE_SQL = {"op13_centroid_clustering": _oracle()}
