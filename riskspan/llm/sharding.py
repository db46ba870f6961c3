"""Sharding: best-fit-decreasing packing of indivisible groups into a fixed number of shards.

Groups of equal texts are the items, and groups of one size are interchangeable: the driver packs the histogram of group
sizes, largest first, each run of equal groups at once. A total of T bytes has at most sqrt(2 T) different sizes (there are
about 30,000 in 0.5 GB of documents), so no group is bundled, cut or sampled to keep the driver's work small. Groups then take
their shards by their number within their size.
"""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, number_within, table

#: Groups with at least 1 / HOT of all rows or of a shard go to every task as a table; there are at most HOT + HOT * shards of them.
HOT = 1_000


class _Tree:
    """A treap of (remaining capacity, bin): insert, delete and the least entry at or above a value in O(log n)."""

    def __init__(self) -> None:
        self.root, self.rng = None, random.Random(7)

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            t[3] = a
            return t, b
        a, b = self._split(t[2], key)
        t[2] = b
        return a, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self.rng.random(), None, None]), b)

    def drop(self, key) -> None:
        a, b = self._split(self.root, key)
        _, c = self._split(b, (key[0], key[1] + 1))
        self.root = self._merge(a, c)

    def ceiling(self, key):
        t, best = self.root, None
        while t is not None:
            if t[0] >= key:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best

    def last(self):
        t = self.root
        while t is not None and t[3] is not None:
            t = t[3]
        return t and t[0]


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]]:
    """Pack (size, count) items, largest first, each into the bin with the least room that still holds it.

    Returns runs (size, count, bin) in packing order. With `bins` None a new bin opens when none fits (fewest fixed-capacity
    bins). With a fixed number of bins an item that fits nowhere goes to the emptiest bin. Ties: the lower bin first. Equal
    items fill a bin one after the other, as its room stays the least, so a run is placed at once.
    """
    tree, runs = _Tree(), []
    for b in range(bins or 0):
        tree.add((capacity, b))
    opened = bins or 0
    for size, count in sorted(sizes, reverse=True):
        while count:
            slot = tree.ceiling((size, -1))
            if slot is None and bins is None:
                slot, opened = (max(capacity, size), opened), opened + 1
                tree.add(slot)
            times = min(count, slot[0] // size if size else count) if slot else 1
            slot = slot or tree.last()
            tree.drop(slot)
            tree.add((slot[0] - times * size, slot[1]))
            runs.append((size, times, slot[1]))
            count -= times
    return runs


def shard(docs: DataFrame, shards: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Assign every row a shard of near-equal bytes and a gapless slot in it.

    Returns doc_id (the column id_col), size, text_crc32, shard, slot. Size: UTF-8 bytes plus 8 (null text: 8). Equal texts
    share a shard as long as they fit one; a group above a shard's fair share (at most `shards` of them) is cut into runs that
    fill a shard each, as no other way keeps the sizes near equal. Null texts are one group, empty ones another. Repeated rows
    each get a slot; an empty table gives an empty result; null ids are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.when(F.col(text).isNull(), F.lit("")).otherwise(F.md5(text)).alias("_g"),
        ),
        "shard-items",
    )
    groups = materialise(slim.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "shard-groups")
    of = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    rows, capacity = of["n"] or 0, max(1, -(-(of["bytes"] or 0) // shards))

    large = groups.where(F.col("bytes") > capacity).orderBy("_g").collect()  # fewer than `shards`
    items: Counter[int] = Counter()
    pieces: dict[int, list[tuple[str, int, int]]] = {}  # of large groups, by size: group, piece, rows in a piece
    for g in large:
        one = g["bytes"] // g["n"]
        run = max(1, capacity // one)
        for p in range(-(-g["n"] // run)):
            size = min(run, g["n"] - p * run) * one
            pieces.setdefault(size, []).append((g["_g"], p, run))
            items[size] += 1
    whole = groups.where(F.col("bytes") <= capacity)
    for r in whole.groupBy("bytes").count().toLocalIterator():
        items[r["bytes"]] += r["count"]
    taken: Counter[int] = Counter()
    of_piece, of_size = [], []
    for size, times, to in best_fit_decreasing(list(items.items()), capacity, shards):
        while times and pieces.get(size):
            of_piece.append((*pieces[size].pop(), to))
            times -= 1
        if times:
            of_size.append((size, taken[size], taken[size] + times, to))
            taken[size] += times
    runs = spark.createDataFrame(of_size, "_size long, _from long, _to long, shard int")
    ranked = number_within(whole, "bytes", ["_g"], "_rank")
    placed = ranked.join(runs, (F.col("bytes") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    placed = materialise(placed.select("_g", "shard", ((F.col("n") * HOT >= rows) | (F.col("bytes") * HOT >= capacity)).alias("hot")), "shard-of-group")

    known = placed.where("hot").select("_g", F.col("shard").alias("_s"), F.lit(None).cast("long").alias("_run"))
    cut = {(g, run) for g, _, run, _ in of_piece}
    known = known.unionByName(spark.createDataFrame([(g, None, run) for g, run in sorted(cut)], "_g string, _s int, _run long"))
    tagged = materialise(slim.join(F.broadcast(known), "_g", "left"), "shard-rows")
    out = ("doc_id", "size", "text_crc32", "shard")
    hot = tagged.where("_s is not null").withColumn("shard", F.col("_s")).select(*out)
    cold = tagged.where("_s is null and _run is null").join(placed.where("not hot"), "_g").select(*out)
    parts = hot.unionByName(cold)
    if cut:  # rows of groups that fill more than one shard are numbered, so that each run takes its share
        over = number_within(tagged.where("_run is not null"), "_g", ["doc_id"], "_rank", few=True)
        over = over.withColumn("_piece", F.expr("cast(_rank div _run as int)"))
        to = F.broadcast(spark.createDataFrame([(g, p, s) for g, p, _, s in of_piece], "_g string, _piece int, shard int"))
        parts = parts.unionByName(over.join(to, ["_g", "_piece"]).select(*out))
    return number_within(materialise(parts, "shard-parts"), "shard", ["doc_id", "text_crc32", "size"], "slot", few=True)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: shards of near-equal bytes, equal texts together."""
    out = shard(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_sharding": op4}
ORACLE_SQL: dict[str, str] = {}
