"""Substring dedup: seed and extend over winnowed anchors.

Of the nine seeds of five words in a window of thirteen, the one with the least hash is the window's anchor (winnowing), so
equal windows have equal anchors, and the consecutive windows of one anchor form a run. Documents are joined on the anchors
that several of them hold. Where all runs of an anchor are equal, the match extends both ways over the whole run. Elsewhere
the seed is extended word by word to the left and to the right, against all earlier documents of the anchor at once: postings
that agree on a side stay in one class, and a maximal repeat ends where the class holds no earlier document any more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, ByteType, IntegerType, LongType, StringType, StructField, StructType

from .bitmap import build, test
from .common import _WINDOW, _power_tables, materialise, mix, scan_words, slices, starts_of, table, text_bytes, window_hashes

LENGTH = 13
SEED = 5
#: Anchors with at least 1 / HOT of all postings (so at most HOT of them) are known to every task and never shuffled by anchor.
HOT = 2_000
#: Postings of an anchor that one task extends together; the windows of larger groups are compared by their hashes instead.
GROUP = 50_000
#: Postings that one call extends.
BUCKET = 50_000

RUNS = StructType([StructField("anchor", LongType()), StructField("run", LongType()), StructField("doc", LongType())])
#: way: 0 to be joined, 1 repeats an earlier document as a whole, 2 anchor of very many documents. The text around the seed (`left` words before it) comes with anchors of unequal runs.
POSTINGS = StructType([
    StructField("anchor", LongType()), StructField("doc", LongType()), StructField("at", IntegerType()), StructField("n", IntegerType()),
    StructField("left", IntegerType()), StructField("way", ByteType()), StructField("words", BinaryType()),
])
#: A window is known by two hashes of its words.
WINDOWS = StructType([StructField("window", LongType()), StructField("second", LongType()), StructField("doc", LongType()), StructField("at", IntegerType())])
SPANS = StructType([StructField("doc", LongType()), StructField("at", IntegerType()), StructField("n", IntegerType())])


def runs_of(hashes: np.ndarray, row: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Anchor hash, first window and number of windows of each run."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    seeds = window_hashes(hashes, seed)
    least, arg = seeds[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, length - seed + 1):
        other = seeds[j : j + n]
        better = other < least
        np.copyto(least, other, where=better)
        arg[better] = j
    anchor = np.arange(n) + arg
    valid = row[:n] == row[length - 1 :]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    total = np.concatenate(([0], np.cumsum(valid)))
    count = total[np.append(first[1:], n)] - total[first]
    return least[first], anchor[first], first, count


def span_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(hashes) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _WINDOW) * up[: len(hashes)])))
    return mix((total[end] - total[begin]) * down[begin])


def _blocks(batches: Iterator[pa.RecordBatch]):
    for whole in batches:
        for batch in slices(whole):
            data, offsets = text_bytes(batch.column("text"))
            begin, end, row, hashes = scan_words(data, offsets)
            docs = np.asarray(batch.column("doc_id").fill_null(0), dtype=np.int64)
            yield hashes, row, docs, starts_of(row, batch.num_rows), (data, begin, end)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(RUNS)
    for hashes, row, docs, _, _ in _blocks(batches):
        least, anchor, first, count = runs_of(hashes, row)
        cells = (least.view(np.int64), _whole(hashes, anchor, first, count).view(np.int64), docs[row[first]])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], schema=schema)


def _whole(hashes: np.ndarray, anchor: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of all words of each run and of the anchor's place in it."""
    return mix(span_hashes(hashes, first, first + count + LENGTH - 1) + (anchor - first).astype(np.uint64) * np.uint64(31) + count.astype(np.uint64))


def _postings(shared, unequal, hot):
    schema = to_arrow_schema(POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_anchor, hot_lo, hot_unequal = hot.value
        for hashes, row, docs, start, (data, begin, end) in _blocks(batches):
            least, anchor, first, count = runs_of(hashes, row)
            picked = test(shared.value, least)
            least, anchor, first, count = least[picked], anchor[picked], first[picked], count[picked]
            doc, way, open_ = docs[row[first]], np.zeros(len(least), np.int8), test(unequal.value, least)
            if len(hot_anchor):
                key = least.view(np.int64)
                at = np.minimum(np.searchsorted(hot_anchor, key), len(hot_anchor) - 1)
                known = hot_anchor[at] == key
                way[known] = np.where(hot_unequal[at[known]], 2, 1)
                kept = ~known | (way == 2) | (doc > hot_lo[at])
                least, anchor, first, count, doc, way, open_ = (x[kept] for x in (least, anchor, first, count, doc, way, open_))
            open_ &= way != 1
            size = np.where(open_, end[first + count + LENGTH - 2] - begin[first], 0) if len(first) else np.empty(0, np.int64)
            ends = np.cumsum(size)
            at = np.repeat(begin[first] - (ends - size), size) + np.arange(int(size.sum()))
            text = np.frombuffer(data, np.uint8)[at].tobytes()
            offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes())
            valid = pa.array(open_).buffers()[1] if len(open_) else None
            context = pa.Array.from_buffers(pa.binary(), len(least), [valid, offsets, pa.py_buffer(text)])
            cells = (least.view(np.int64), doc, (first - start[row[first]]).astype(np.int32), count.astype(np.int32), (anchor - first).astype(np.int32), way)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cells), context], schema=schema)

    return run


def _words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of a column of texts, equal for equal words only; the n + 1 positions where the rows' words start; hashes."""
    array = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint64)
    data, offsets = text_bytes(array)
    begin, end, row, hashes = scan_words(data, offsets)
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[begin] += 1
    inside[end] -= 1
    joined = raw[np.cumsum(inside[:-1]) > 0].tobytes()
    edges = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(joined)])
    return np.asarray(words.dictionary_encode().indices).astype(np.int64), starts_of(row, len(array)), hashes


def _classes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Class numbers of (class before, next word); -1 where either has ended (-1)."""
    out = np.full(len(before), -1, np.int64)
    live = np.flatnonzero((before >= 0) & (word >= 0))
    order = live[np.lexsort((word[live], before[live]))]
    new = np.ones(len(order), bool)
    new[1:] = (before[order[1:]] != before[order[:-1]]) | (word[order[1:]] != word[order[:-1]])
    out[order] = np.cumsum(new) - 1
    return out


def extend(anchor: np.ndarray, doc: np.ndarray, left: np.ndarray, words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """[posting, words before the seed]: whether the window with so many words before the seed stands in an earlier document.

    Posting i holds the words start[i] to start[i + 1], its seed at left[i]. Postings of an anchor whose seeds are equal word for
    word are extended word by word: those that agree so far share a class on each side, and windows are equal where both
    classes are.
    """
    reach = LENGTH - SEED
    side = []
    seeds = _classes(np.zeros(len(anchor), np.int64), np.unique(anchor, return_inverse=True)[1].astype(np.int64))
    for i in range(SEED):
        seeds = _classes(seeds, words[start[:-1] + left + i].astype(np.int64) if len(words) else seeds)
    for step in (-1, 1):
        classes = [seeds]
        for i in range(1, reach + 1):
            at = left - i if step < 0 else left + SEED - 1 + i
            inside = (at >= 0) & (start[:-1] + at < start[1:])
            word = np.where(inside, words[np.where(inside, start[:-1] + at, 0)].astype(np.int64) if len(words) else -1, -1)
            classes.append(_classes(classes[-1], word))
        side.append(classes)
    out = np.zeros((len(anchor), reach + 1), bool)
    for before in range(reach + 1):
        window = _classes(side[0][before], side[1][reach - before])
        live = np.flatnonzero(window >= 0)
        least = np.full(len(live), np.iinfo(np.int64).max)
        np.minimum.at(least, window[live], doc[live])
        out[live, before] = doc[live] > least[window[live]]
    return out


def maximal(repeated: np.ndarray, doc: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, at, n) of repeats: windows of a posting that follow each other are one repeat."""
    grid = repeated[:, ::-1]  # windows from left to right: most words before the seed first
    edge = np.diff(np.pad(grid, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    p, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    begin = at[p] + left[p] - (LENGTH - SEED - first)
    return doc[p], begin.astype(np.int32), (last - first + LENGTH - 1).astype(np.int32)


def _extend_bucket(t: pa.Table) -> pa.Table:
    words, start, _ = _words(t.column("words"))
    anchor, doc, left, at = (np.asarray(t.column(c)).astype(np.int64) for c in ("anchor", "doc", "left", "at"))
    cells = maximal(extend(anchor, doc, left, words, start), doc, at, left)
    return pa.Table.from_arrays([pa.array(c) for c in cells], schema=to_arrow_schema(SPANS))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of postings by two hashes of their words."""
    schema = to_arrow_schema(WINDOWS)
    for batch in batches:
        _, start, words = _words(batch.column("words"))
        count = np.asarray(batch.column("n")).astype(np.int64)
        total = np.cumsum(count)
        k = np.arange(int(count.sum())) - np.repeat(total - count, count)
        place = np.repeat(start[:-1], count) + k
        both = [window_hashes(w, LENGTH)[place].view(np.int64) if len(k) else np.empty(0, np.int64) for w in (words, mix(words ^ _WINDOW))]
        doc, at = np.asarray(batch.column("doc")), np.asarray(batch.column("at")).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*map(pa.array, both), pa.array(np.repeat(doc, count)), pa.array((np.repeat(at, count) + k).astype(np.int32))], schema=schema)


def _known(hot):
    """Windows of the hot table are decided here; the others go on with `known` false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, second, least = hot.value
        for batch in batches:
            window, other, doc = (np.asarray(batch.column(c)) for c in ("window", "second", "doc"))
            known, kept = np.zeros(len(window), bool), np.ones(len(window), bool)
            if len(key):
                at = np.minimum(np.searchsorted(key, window), len(key) - 1)
                known = (key[at] == window) & (second[at] == other)
                kept = ~known | (doc > least[at])
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(known)], names=[*batch.schema.names, "known"])
            yield whole.filter(pa.array(kept))

    return run


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated spans (doc, at, n): n words from word `at` on are covered by windows that an earlier document holds.

    Every document text is read whole, twice. The first reading sums anchors to one row each (least and greatest document and
    run, on the map side first). The second writes the postings of anchors that several documents hold, known by a bitmap of
    bounded size that lets some others pass; postings meet the sums again by a join. Anchors with many postings land nowhere
    together: at most HOT of them go to every task, and the windows of groups above GROUP are summed by two hashes (128 bits).
    Elsewhere words are compared as such: postings carry the text around their seeds.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    sums = source.mapInArrow(_runs, RUNS).groupBy("anchor")
    sums = sums.agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("run").alias("r0"), F.max("run").alias("r1"))
    shared = materialise(sums.where("lo < hi").select("anchor", "c", "lo", (F.col("r0") != F.col("r1")).alias("unequal")), "shared-anchors")
    of = shared.agg(F.sum("c").alias("c"), F.sum(F.when(F.col("unequal") & (F.col("c") <= GROUP), F.col("c"))).alias("grouped")).first()
    total, grouped = of["c"] or 0, of["grouped"] or 0
    hot = shared.where((F.col("c") > GROUP) & (F.col("c") * HOT >= total))
    rows = sorted(tuple(r) for r in hot.select("anchor", "lo", "unequal").collect())  # at most HOT rows
    known = tuple(np.array([r[k] for r in rows], dtype=t) for k, t in enumerate((np.int64, np.int64, bool)))

    bits = [spark.sparkContext.broadcast(build(x.select("anchor"))) for x in (shared, shared.where("unequal"))]
    postings = materialise(source.mapInArrow(_postings(*bits, spark.sparkContext.broadcast(known)), POSTINGS), "postings")
    cold = shared.where(~((F.col("c") > GROUP) & (F.col("c") * HOT >= total)))
    met = postings.where("way = 0").join(cold, "anchor").where(F.col("unequal") | (F.col("doc") > F.col("lo")))
    met = materialise(met.select(*POSTINGS.names, (F.col("unequal") & (F.col("c") > GROUP)).alias("large"), "unequal"), "met")

    span = ("doc", "at", (F.col("n") + (LENGTH - 1)).alias("n"))
    whole = postings.where("way = 1").select(*span).unionByName(met.where("not unequal").select(*span))
    buckets = max(1, grouped // BUCKET)
    seeds = met.where("unequal and not large").select("anchor", "doc", "at", "left", "words", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"))
    extended = seeds.groupBy("bucket").applyInArrow(_extend_bucket, SPANS)

    many = postings.where("way = 2").select("n", "doc", "at", "words").unionByName(met.where("large").select("n", "doc", "at", "words"))
    windows = materialise(many.mapInArrow(_windows, WINDOWS), "windows")
    least = windows.groupBy("window", "second").agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    least = materialise(least.select("window", "second", "c", "least"), "least-windows")
    n = windows.count()
    often = sorted(tuple(r) for r in least.where((F.col("c") > GROUP) & (F.col("c") * HOT >= n)).select("window", "second", "least").collect())  # at most HOT rows
    table_ = spark.sparkContext.broadcast(tuple(np.array([r[k] for r in often], dtype=np.int64) for k in (0, 1, 2)))
    tagged = windows.mapInArrow(_known(table_), StructType([*WINDOWS.fields, StructField("known", BooleanType())]))
    seldom = tagged.where("not known").join(least, ["window", "second"]).where("doc > least")
    single = tagged.where("known").select("doc", "at").unionByName(seldom.select("doc", "at"))
    return whole.unionByName(extended).unionByName(single.select("doc", "at", F.lit(LENGTH).alias("n")))


def _finish(columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha = [], [], []
            texts, ats, ns = batch.column("text"), batch.column("ats"), batch.column("ns")
            for r in range(batch.num_rows):
                words = (texts[r].as_buffer().to_pybytes() if texts[r].is_valid else b"").split()
                if ats[r].is_valid:
                    at, n = np.asarray(ats[r].values), np.asarray(ns[r].values)
                    edges = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n, minlength=len(words) + 1)
                    kept = np.flatnonzero(np.cumsum(edges[: len(words)]) == 0).tolist()
                    n_removed.append(len(words) - len(kept))
                    sha.append(hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest())
                else:
                    n_removed.append(0)
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                n_words.append(len(words))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], schema=schema)

    return run


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document, without the words that repeat an earlier document.

    A word goes if a window of LENGTH words that covers it also starts in a document with a smaller doc_id; windows are those
    of the input. Null and empty texts have no words, shorter texts no window. Rows repeated whole share their result; an id
    must not stand for different texts. Null ids neither remove nor lose words. Ids must be integers; other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    spans = repeats(docs).groupBy("doc").agg(F.collect_list("at").alias("ats"), F.collect_list("n").alias("ns"))
    joined = docs.select("doc_id", "text").join(spans.hint("shuffle_hash"), F.col("doc_id") == F.col("doc"), "left").drop("doc")
    schema = StructType([docs.schema["doc_id"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])
    return joined.mapInArrow(_finish(["doc_id"], to_arrow_schema(schema)), schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


_ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p : p + 12], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)),
least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT win.doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN least USING (k) WHERE win.doc_id > d) GROUP BY doc_id),
left_words AS (SELECT doc_id, string_agg(ws[i], ' ' ORDER BY i) AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) LEFT JOIN (SELECT doc_id, unnest(qs) AS i, true AS g FROM gone) USING (doc_id, i) WHERE g IS NULL GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN left_words USING (doc_id)
"""

QUERIES = {"op10_substring_dedup": op10}
ORACLE_SQL = {"op10_substring_dedup": _ORACLE}
