"""Benchmark decontamination: sorted training suffixes, searched for every benchmark suffix.

What a search finds is one interval of the sorted suffixes for each test window: the words in it are marked and the items named
from the intervals. Matches with their places are listed only on request, and only maximal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from types import SimpleNamespace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import materialise, scan_words, slices, starts_of, table, text_bytes

WINDOW = 10
#: Bytes that are not part of a word become spaces, A-Z become a-z; bytes of other code points stay.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: The benchmark goes to the tasks in parts of at most so many words; documents are searched for one part after the other.
PART_WORDS = 2_000_000
#: Bytes of benchmark text that the tasks hold at a time. More take further passes over the documents.
MOST_BYTES = 64 << 20


def _words(column: pa.Array):
    """Words of the rows: hash of each word, and the n + 1 positions where the rows' words start."""
    data, offsets = text_bytes(column)
    _, _, row, hashes = scan_words(data.translate(_FOLD), offsets)
    return hashes, starts_of(row, len(column))


class TestSuffixes:
    """Windows of benchmark items, ready to be searched for in sorted training suffixes.

    Item words are replaced by their rank in the benchmark's vocabulary. `pairs` are the vocabulary's adjacent word pairs
    inside an item: a training suffix can only match where all its pairs are among them, so others are never sorted.
    """

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW) -> None:
        hashes, first = _words(pa.array(texts, pa.string()))
        self.ids, self.window = ids, window
        self.vocabulary = np.unique(hashes)
        self.rank = rank = np.searchsorted(self.vocabulary, hashes).astype(np.int64) + 1
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        self.place = np.arange(len(hashes)) - first[item] if len(hashes) else np.empty(0, np.int64)  # word position in its item
        self.end = first[item + 1] if len(hashes) else np.empty(0, np.int64)
        inside = item[:-1] == item[1:] if len(item) else np.zeros(0, bool)
        self.base = len(self.vocabulary) + 2
        self.pairs = np.unique(rank[:-1][inside] * self.base + rank[1:][inside])
        before = np.where(self.place > 0, np.concatenate(([0], rank[:-1])) if len(rank) else rank, -1)
        self.by_length: dict[int, SimpleNamespace] = {}
        lengths = np.diff(first)
        for m in np.unique(np.minimum(lengths, window)).tolist():
            own = np.flatnonzero(lengths == m if m < window else lengths >= window)
            if not m or not len(own):
                continue
            at = np.concatenate([np.arange(first[i], first[i + 1] - m + 1) for i in own])
            keys, of = np.unique(_keys(rank, at, m), return_inverse=True)
            named = np.unique(np.stack([of, item[at]], axis=1), axis=0)  # items of each distinct window
            order = np.lexsort((before[at], of))
            self.by_length[m] = SimpleNamespace(
                keys=keys, head=np.ascontiguousarray(keys).view(">u4").reshape(len(keys), m)[:, 0].astype(np.int64),
                items=named[:, 1], items_from=np.searchsorted(named[:, 0], np.arange(len(keys) + 1)),
                at=at[order], item=item[at[order]], code=of[order] * self.base + before[at[order]] + 1, at_from=np.searchsorted(of[order], np.arange(len(keys) + 1)),
            )


def _keys(rank: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """The m ranks from each position on as fixed-width byte strings that sort like the rank sequences."""
    cells = rank[at[:, None] + np.arange(m)].astype(">u4") if len(at) else np.empty((0, m), ">u4")
    return np.ascontiguousarray(cells).view(f"S{4 * m}").ravel()


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the intervals [low, high), and the interval of each."""
    size = np.maximum(high - low, 0)
    of = np.repeat(np.arange(len(size)), size)
    return low[of] + np.arange(int(size.sum())) - (np.cumsum(size) - size)[of], of


class Found(NamedTuple):
    """Words of a shard where windows of m words start that the benchmark holds, and the number of each one's window."""

    m: int
    at: np.ndarray
    key: np.ndarray


def ranks(tests: TestSuffixes, hashes: np.ndarray) -> np.ndarray:
    """Rank of each word in the benchmark's vocabulary, 0 if it is not in it."""
    if not len(tests.vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
    return np.where(tests.vocabulary[at] == hashes, at + 1, 0).astype(np.int64)


def search(tests: TestSuffixes, rank: np.ndarray, first: np.ndarray) -> list[Found]:
    """Where test windows occur in a shard of training rows: each place once, however many items hold its window.

    The shard's suffix array holds the suffixes whose word pairs all occur in the benchmark; every test window whose first word
    starts one of them is searched in it by bisection, which gives its interval.
    """
    found: list[Found] = []
    n = len(rank)
    if not n or not len(tests.vocabulary):
        return found
    joined = np.zeros(n, dtype=bool)  # the pair (i, i + 1) occurs in the benchmark, inside one row
    if n > 1 and len(tests.pairs):
        maybe = np.flatnonzero((rank[:-1] > 0) & (rank[1:] > 0))
        code = rank[maybe] * tests.base + rank[maybe + 1]
        at = np.minimum(np.searchsorted(tests.pairs, code), len(tests.pairs) - 1)
        joined[maybe[tests.pairs[at] == code]] = True
    joined[first[1:-1][(first[1:-1] > 0) & (first[1:-1] <= n)] - 1] = False
    joined[-1] = False
    breaks = np.flatnonzero(~joined)
    run = breaks[np.searchsorted(breaks, np.arange(n))] - np.arange(n)  # joined pairs from here on
    for m, windows in tests.by_length.items():
        at = np.flatnonzero(run >= m - 1) if m > 1 else np.flatnonzero(rank > 0)
        if not len(at):
            continue
        suffixes = _keys(rank, at, m)
        order = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        starts = np.zeros(tests.base, bool)
        starts[rank[at]] = True
        asked = np.flatnonzero(starts[windows.head])
        low, high = np.searchsorted(suffixes, windows.keys[asked], "left"), np.searchsorted(suffixes, windows.keys[asked], "right")
        place, of = _expand(low, high)
        if len(place):
            found.append(Found(m, at[order[place]], asked[of]))
    return found


_MATCH = StructType([StructField("item_id", StringType()), StructField("at", LongType()), StructField("item_at", LongType()), StructField("n", LongType())])
MATCHES = ArrayType(_MATCH)
ADDED = (("n_words", LongType()), ("n_hit", LongType()), ("n_items", LongType()), ("items_sha256", StringType()), ("contaminated", BooleanType()))
PLACES = (("longest_match", LongType()), ("matches", MATCHES))
#: What a pass finds in a document: hit words as runs, items, matches.
PASS = StructType([StructField("_row", LongType()), StructField("begin", ArrayType(IntegerType())), StructField("end", ArrayType(IntegerType())), StructField("items", ArrayType(StringType())), StructField("matches", MATCHES)])


def _maximal(tests: TestSuffixes, found: Found, rank: np.ndarray, first: np.ndarray, row_of: np.ndarray) -> list[np.ndarray]:
    """Row, item, first word in the row and in the item, and length of the maximal matches that begin with these windows.

    A match begins where the words before differ: of a window's places in the benchmark, sorted by the word before, all are
    taken but those with the document's own word before. Each is extended word by word.
    """
    windows = tests.by_length[found.m]
    alone = found.at == first[row_of[found.at]]
    before = np.where(alone, 0, np.where(found.at > 0, rank[found.at - 1], 0))
    low, high = windows.at_from[found.key], windows.at_from[found.key + 1]
    code = found.key * tests.base + before + 1
    same_low, same_high = np.searchsorted(windows.code, code, "left"), np.searchsorted(windows.code, code, "right")
    same_low, same_high = np.where(before > 0, same_low, low), np.where(before > 0, same_high, low)
    parts = [_expand(low, same_low), _expand(same_high, high)]
    at, occurrence = found.at[np.concatenate([p[1] for p in parts])], windows.at[place := np.concatenate([p[0] for p in parts])]
    n, end, live = np.full(len(at), found.m), first[row_of[at] + 1], np.arange(len(at))
    while len(live):
        a, b = at[live] + n[live], occurrence[live] + n[live]
        live, a, b = (x[(a < end[live]) & (b < tests.end[occurrence[live]])] for x in (live, a, b))
        live = live[rank[a] == tests.rank[b]]
        n[live] += 1
    return [row_of[at], windows.item[place], at - first[row_of[at]], tests.place[occurrence], n]


def locate(parts, hashes: np.ndarray, first: np.ndarray, places: bool):
    """Which words are hit, (row, item id) of the items that a row holds windows of, and (row, item id, at, item_at, n) of matches."""
    n, row_of = len(hashes), np.repeat(np.arange(len(first) - 1), np.diff(first))
    edges, items, matches = np.zeros(n + 1, np.int64), set(), []
    for part in parts:
        tests = part.value
        rank = ranks(tests, hashes)
        for found in search(tests, rank, first):
            edges += np.bincount(found.at, minlength=n + 1) - np.bincount(found.at + found.m, minlength=n + 1)
            windows = tests.by_length[found.m]
            seen = np.unique(np.stack([row_of[found.at], found.key], axis=1), axis=0)
            at, of = _expand(windows.items_from[seen[:, 1]], windows.items_from[seen[:, 1] + 1])
            named = np.unique(np.stack([seen[of, 0], windows.items[at]], axis=1), axis=0)
            items |= {(r, tests.ids[i]) for r, i in named.tolist() if tests.ids[i] is not None}
            if places:
                matches += [(r, tests.ids[i], *rest) for r, i, *rest in zip(*(x.tolist() for x in _maximal(tests, found, rank, first, row_of)), strict=True)]
    return np.cumsum(edges[:n]) > 0, items, matches


def _columns(first: np.ndarray, hit: np.ndarray, items, matches, places: bool) -> list[pa.Array]:
    """The columns ADDED, and PLACES on request, of the rows whose words start at `first`."""
    rows = len(first) - 1
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[first[1:]] - total[first[:-1]]
    by_row: list[set[str]] = [set() for _ in range(rows)]
    for r, name in items:
        by_row[r].add(name)
    out = [
        pa.array(np.diff(first), pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([len(s) for s in by_row], pa.int64()),
        pa.array([hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in by_row], pa.string()),
        pa.array(n_hit > 0),
    ]
    if places:
        listed: list[list[dict]] = [[] for _ in range(rows)]
        for r, name, at, item_at, n in sorted(matches, key=lambda x: (x[0], x[1] is None, x[1] or "", *x[2:])):
            listed[r].append({"item_id": name, "at": at, "item_at": item_at, "n": n})
        out += [pa.array([max((x["n"] for x in own), default=0) for own in listed], pa.int64()), pa.array(listed, to_arrow_type(MATCHES))]
    return out


def _scan(parts, columns: list[str], schema: pa.Schema, places: bool):
    """Search every part of the benchmark in each shard of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                hashes, first = _words(batch.column("text"))
                out = [batch.column(c) for c in columns] + _columns(first, *locate(parts, hashes, first, places), places)
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _pass(parts, places: bool):
    """What one pass finds, for the documents in which it finds something."""
    schema = to_arrow_schema(PASS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                hashes, first = _words(batch.column("text"))
                hit, items, matches = locate(parts, hashes, first, places)
                rows = []
                for r in sorted({r for r, _ in items} | set(np.repeat(np.arange(batch.num_rows), np.diff(first))[hit].tolist())):
                    edge = np.diff(np.concatenate(([0], hit[first[r] : first[r + 1]].astype(np.int8), [0])))
                    own = [{"item_id": m[1], "at": m[2], "item_at": m[3], "n": m[4]} for m in matches if m[0] == r]
                    rows.append((batch.column("_row")[r].as_py(), np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), [i for q, i in items if q == r], own))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def _merge(columns: list[str], schema: pa.Schema, places: bool):
    """Documents with what all passes found in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                _, first = _words(batch.column("text"))
                edges, items, matches = np.zeros(int(first[-1]) + 1, np.int64), set(), []
                for r, passes in enumerate(batch.column("found").to_pylist()):
                    for x in passes or ():
                        np.add.at(edges, first[r] + np.array(x["begin"], np.int64), 1)
                        np.add.at(edges, first[r] + np.array(x["end"], np.int64), -1)
                        items |= {(r, i) for i in x["items"]}
                        matches += [(r, *m.values()) for m in x["matches"]]
                out = [batch.column(c) for c in columns] + _columns(first, np.cumsum(edges[:-1]) > 0, items, matches, places)
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _passes(items: DataFrame, window: int, most_bytes: int) -> Iterator[list]:
    """Broadcast parts of the benchmark, as many at a time as the tasks may hold. The driver holds one part's texts."""
    spark, parts, ids, texts, words, held = items.sparkSession, [], [], [], 0, 0

    def part():
        return spark.sparkContext.broadcast(SimpleNamespace(**vars(TestSuffixes(ids, texts, window))))

    for row in items.toLocalIterator():
        size = len((row["text"] or "").encode())
        if ids and held + size > most_bytes:
            yield [*parts, part()]
            parts, ids, texts, words, held = [], [], [], 0, 0
        elif words > PART_WORDS:
            parts.append(part())
            ids, texts, words = [], [], 0
        ids.append(row["item"])
        texts.append(row["text"])
        words, held = words + size // 2, held + size
    yield [*parts, part()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, most_bytes: int = MOST_BYTES, places: bool = False) -> DataFrame:
    """Mark what each document shares verbatim with the benchmark.

    Returns the columns `keep` of docs (text among them or not) and n_words, n_hit, n_items, items_sha256 and contaminated. With
    `places` also longest_match (words) and matches: every maximal verbatim match of at least a window, as item_id, first word in
    the document, first word in the item and number of words. A window is `window` consecutive item words, or the whole of a
    shorter item; items without words match nothing. Null and empty texts have no words. Repeated rows are judged each. Items
    that share an id count once; words of items without an id are hit, but such items are neither counted nor named. Other
    columns of both tables are ignored; kept columns must not be named like a result, `_row` or `found`. An empty table gives an
    empty result, an empty benchmark marks nothing.

    The benchmark goes to the tasks in parts of at most PART_WORDS words, up to `most_bytes` of text at a time: documents are
    neither shuffled nor joined with it. A larger benchmark takes a pass over the documents for each `most_bytes`, and what the
    passes found in a document meets by its row number.
    """
    spark = docs.sparkSession
    added = [*ADDED, *PLACES] if places else ADDED
    schema = StructType([docs.schema[c] for c in keep] + [StructField(n, t) for n, t in added])
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    passes = list(_passes(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), window, most_bytes))
    if len(passes) == 1:
        return source.mapInArrow(_scan(passes[0], keep, to_arrow_schema(schema), places), schema)
    rows = materialise(source.withColumn("_row", F.monotonically_increasing_id()), "numbered-documents")
    found = reduce(DataFrame.unionByName, [rows.select("_row", "text").mapInArrow(_pass(parts, places), PASS) for parts in passes])
    found = found.groupBy("_row").agg(F.collect_list(F.struct(*PASS.names[1:])).alias("found"))  # at most one for each pass
    return rows.join(found, "_row", "left").mapInArrow(_merge(keep, to_arrow_schema(schema), places), schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


QUERIES = {"op9_decontamination": op9}
ORACLE_SQL = {
    "op9_decontamination": r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM iw WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM iwin),
dwin AS (SELECT doc_id, p, m, array_to_string(w[p : p + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, ms WHERE len(w) >= m)),
hits AS (SELECT doc_id, p, m, item_id FROM dwin JOIN iwin USING (m, k)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
}
