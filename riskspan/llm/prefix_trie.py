"""Conversation prefix trie from mergeable partial tries.

A node is a sequence of turns. Its key is the number of turns and four sums, one for each 32 bits of the MD5 hashes of (place,
turn): sums of a prefix grow by one term a turn, so they come from running sums over chunks of a conversation, and a long
conversation is never gathered. Every task combines its rows to one for each node, the partial trie; partial tries meet in two
rounds keyed by node, the first within groups of tasks, where members, least members and ends are summed. The rollup goes
bottom-up: what a node adds to its ancestors is given to its least member, summed along that conversation from its end upwards,
and the members' sums meet in each node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..operators.ordered import ranked, with_running_sums
from .common import materialise, table

#: Turns of a conversation that are summed in one task.
CHUNK = 1_024
#: Groups of tasks whose partial tries meet in the first round.
GROUPS = 32
#: Bytes of decimal ids in one block of an end list.
BLOCK = 1 << 14
EVERY, HEADS = 100, 6

KEY = ["w0", "w1", "w2", "w3", "depth"]
BLOCKS = StructType([*[StructField(c, LongType()) for c in KEY], StructField("first", LongType()), StructField("ids", BinaryType())])
HASHES = StructType([*[StructField(c, LongType()) for c in KEY], StructField("ends_sha256", StringType())])
_EMPTY = hashlib.sha256(b"").hexdigest()


def head_length(conv_id: Column) -> Column:
    """How many turns conversation `conv_id` takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place from 0, symbol, chars, chunk) of the rebuilt conversations, and conversations (conv_id, length).

    A conversation is ordered by `turn`, nulls first, and rows of equal turn by the MD5 hash of role and text.
    """
    c, role, text = F.col("conv_id"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    symbol = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where("conv_id is not null").select(c.cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), symbol.alias("symbol"), F.length(text).cast("long").alias("chars"))
    own = ranked(turns, ["conv_id"], ["turn", "symbol"], "rank", store=lambda df: materialise(df, "ranked-turns"))
    own = own.select("conv_id", (F.col("rank") - 1).alias("pos"), "symbol", "chars")
    counts = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("base", c - c % EVERY).withColumn("h", head_length(c))
    bases = counts.where(c % EVERY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = counts.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = materialise(convs.select("conv_id", "base", "h", "k", "n", "length"), "rebuilt-conversations")
    own = own.withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    # Where a conversation's own turns go on depends on the length of its head: told to each of its chunks.
    told = own.select("conv_id", "chunk").distinct().join(convs.select("conv_id", "h", "k"), "conv_id")
    tail = own.join(told, ["conv_id", "chunk"]).where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("place"), "symbol", "chars", "chunk")
    heads = own.where((F.col("pos") < HEADS) & (c % EVERY == 0)).select(c.alias("base"), F.col("pos").alias("place"), "symbol", "chars")
    head = convs.join(heads, "base").where("place < h").select("conv_id", "place", "symbol", "chars", F.lit(-1).cast("long").alias("chunk"))
    return head.unionByName(tail), convs.select("conv_id", "length")


def keyed(turns: DataFrame) -> DataFrame:
    """Turns with the key of the node they end in (w0 to w3, depth) and that of its parent (p0 to p3)."""
    term = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("symbol")).cast("binary"))
    words = {f"t{i}": F.conv(F.substring(term, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)}
    out = with_running_sums(turns.withColumns(words), ["conv_id"], "place", {f"t{i}": f"w{i}" for i in range(4)}, chunk="chunk")
    parents = {f"p{i}": F.col(f"w{i}") - F.col(f"t{i}") for i in range(4)}
    return out.withColumns(parents).select("conv_id", *KEY[:4], (F.col("place") + 1).alias("depth"), *parents, "chars")


def merge(members: DataFrame) -> DataFrame:
    """Nodes (key, parent's sums, chars, least member, n_convs) from member rows: partial tries of each task, then two rounds."""
    what = [F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), *[F.max(f"p{i}").alias(f"p{i}") for i in range(4)]]
    partial = members.withColumn("_group", F.spark_partition_id() % GROUPS).groupBy(*KEY, "_group").agg(*what, F.count(F.lit(1)).alias("n_convs"))
    return partial.groupBy(*KEY).agg(*what, F.sum("n_convs").alias("n_convs"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of rows of one key."""
    keys = np.stack([np.asarray(batch.column(c)) for c in KEY], axis=1)
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def _end_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a key as blocks of text, the first id of each beside it."""

    def block(rows: list) -> pa.RecordBatch:
        cells = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(5)]
        return pa.RecordBatch.from_arrays([*cells, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], schema=to_arrow_schema(BLOCKS))

    key, first, text = None, 0, b""
    for batch in batches:
        out = []
        for now, rows in _runs(batch):
            ids = rows.column("conv_id").to_pylist()
            more = ",".join(map(str, ids)).encode()
            if key == now and len(text) < BLOCK:
                text += b"," + more
                continue
            if key is not None:
                out.append((key, first, text))
            key, first, text = now, ids[0], more
        if out:
            yield block(out)
    if key is not None:
        yield block([(key, first, text)])


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's blocks, which come in order; one hash state is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for now, rows in _runs(batch):
            if now != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state, comma = now, hashlib.sha256(), b""
            for ids in rows.column("ids"):
                state.update(comma)
                state.update(ids.as_buffer())
                comma = b","
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out]) for i in range(6)], schema=to_arrow_schema(HASHES))
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], schema=to_arrow_schema(HASHES))


def end_hashes(ends: DataFrame) -> DataFrame:
    """ends_sha256 of each key of `ends` (key, conv_id).

    A list of any length is sorted by ranges of (key, id) over many tasks and goes on as blocks of text; one task reads the
    blocks of a key in order, as such a hash must be computed, and holds one of them.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = ends.select(*KEY, "conv_id")
    blocks = ends.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_end_blocks, BLOCKS)
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_end_hashes, HASHES)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    Conversation c is rebuilt from the first h turns of conversation c - c % 100 (h = crc32 of c's decimal form, modulo 6; all
    turns if it has fewer, none if there is no such conversation) and its own turns after its first h. A null role or text is
    empty; rows without a conv_id take no part; rows of equal turn are ordered by the hash of role and text; rows repeated whole
    are turns of their own. An empty table has no node, not even a root. conv_id and turn must be integers; other columns are
    ignored, whatever their names.
    """
    turns, convs = rebuilt(conversations)
    rows = keyed(turns)
    root = convs.select("conv_id", *[F.lit(0).cast("long").alias(f"w{i}") for i in range(4)], F.lit(0).cast("long").alias("depth"), *[F.lit(None).cast("long").alias(f"p{i}") for i in range(4)], F.lit(0).cast("long").alias("chars"))
    members = materialise(root.unionByName(rows), "members")
    merged = materialise(merge(members), "merged-trie")

    children = merged.where("depth > 0").groupBy(*[F.col(f"p{i}").alias(f"w{i}") for i in range(4)], (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    adds = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    given = members.join(adds, ["conv_id", "depth"], "left").withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in ("saves", "leaf")})
    # From the end upwards: the running sum over falling depth.
    given = given.select("conv_id", *KEY, (-F.col("depth")).alias("_up"), F.floor(-F.col("depth") / CHUNK).alias("chunk"), "saves", "leaf")
    summed = with_running_sums(given, ["conv_id"], "_up", {"saves": "saved_tokens", "leaf": "n_leaves"}, chunk="chunk")
    rolled = summed.groupBy(*KEY).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    # A conversation ends where it has all its turns.
    ends = members.join(convs, (members["conv_id"] == convs["conv_id"]) & (members["depth"] == convs["length"]), "left_semi")
    parents = merged.select(*[F.col(f"w{i}").alias(f"p{i}") for i in range(4)], (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, ["p0", "p1", "p2", "p3", "depth"], "left").join(rolled, KEY).join(end_hashes(ends), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 in SQL: the table of 256 remainders by doubling the polynomial, then one step for each byte.
_CRC = """bits AS (SELECT range AS i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256)),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits)"""
_ORACLE = f"""
WITH {_CRC},
c AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a & 255, b) + 1)::BIGINT])), 4294967295::UBIGINT) % 6)::BIGINT AS h FROM c, tab),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1 : h.h], h.own[h.h + 1 : ]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r),
k AS MATERIALIZED (SELECT conv_id, d, len(s) = d AS ends, CASE WHEN d > 0 THEN length(s[d][2]) ELSE 0 END AS chars, md5(s[1 : d]::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(s[1 : d - 1]::VARCHAR) END AS p FROM m),
n AS MATERIALIZED (SELECT d, k, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM k GROUP BY d, k),
ch AS (SELECT d - 1 AS d, p AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (d, k)),
up AS (SELECT a.d, a.k, sum((w.n_convs - 1) * w.chars)::BIGINT AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves FROM w JOIN k b ON b.conv_id = w.conv_id AND b.d = w.d JOIN k a ON a.conv_id = w.conv_id AND a.d <= w.d GROUP BY a.d, a.k)
SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN up ON up.d = w.d AND up.k = w.k LEFT JOIN w q ON q.d = w.d - 1 AND q.k = w.p
"""

QUERIES = {"op12_prefix_trie": op12}
ORACLE_SQL = {"op12_prefix_trie": _ORACLE}
