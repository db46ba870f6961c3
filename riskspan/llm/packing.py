"""Best-fit packing: Martello and Toth's dominance reduction on the histogram of lengths, best fit for the rest.

Lengths are at most the sequence length, so the whole corpus is one histogram of at most that many counts. Packing works on
counts: a pattern (lengths that share a sequence) is repeated as often as its lengths last. The driver therefore handles a
few thousand patterns for any number of documents, and documents take their places by their number within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialise, number_within, slices, table

Pattern = tuple[int, ...]


def dominating(counts: dict[int, int], lengths: list[int], j: int, capacity: int) -> Pattern | None:
    """A set with length j that dominates every other sequence with j, by Martello and Toth's tests; None where none is proved.

    `counts` are the items left, `lengths` their lengths in order. A set dominates another if the other's items can be dealt
    over places of the set that hold them: swapping both then keeps any packing valid. With room r = capacity - j:
    - nothing else fits in r: j alone;
    - an item fills r exactly: j with it, as any other company of j has room in its place;
    - no two others fit: j with the largest that does;
    - two others fit but no three: j with the largest k that fits, if no two that fit weigh more than k. Else, with (a, b) the
      heaviest two that fit: j, a and b, if a is also the largest that fits and no two items above b fit. A single company
      then has room in a, and of two the larger in a, the smaller in b.
    """
    room = capacity - j

    def left(n: int) -> int:
        return counts[n] - (n == j)

    def smallest(k: int, above: int = 0) -> int | None:
        """Sum of the k smallest items above a length; None with fewer items."""
        total = 0
        for n in lengths[bisect_left(lengths, above + 1) :]:
            take = min(k, max(0, left(n)))
            total, k = total + take * n, k - take
            if not k:
                return total
        return None

    def fits(k: int, above: int = 0) -> bool:
        total = smallest(k, above)
        return total is not None and total <= room

    if not fits(1):
        return (j,)
    i = bisect_left(lengths, room + 1) - 1
    while left(lengths[i]) <= 0:
        i -= 1
    k = lengths[i]
    if k == room or not fits(2):
        return j, k
    if fits(3):
        return None
    pair = heaviest_pair(lengths, left, room)
    if sum(pair) <= k:
        return j, k
    if pair[0] == k and not fits(2, above=pair[1]):
        return j, *pair
    return None


def heaviest_pair(lengths: list[int], left, room: int) -> tuple[int, int]:
    """The two items (larger first) with the largest sum of at most room; (0, 0) if no two fit."""
    best, a, b = (0, 0), 0, bisect_left(lengths, room) - 1
    while a <= b:
        low, high = lengths[a], lengths[b]
        if left(low) <= 0:
            a += 1
        elif left(high) <= 0 or low + high > room or (a == b and left(low) < 2):
            b -= 1
        else:
            best = max(best, (high, low), key=sum)
            a += 1
    return best


def dominance(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix sequences that belong to some best packing (see dominating()), and take their lengths out of `counts`.

    A proof lasts as long as the set's items do: taking items away only leaves less company for j. So a set is fixed as often
    as its scarcest length allows. The passes over all lengths end when one fixes nothing.
    """
    fixed: list[tuple[Pattern, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    found = True
    while found:
        found = False
        for j in sorted(left, reverse=True):
            lengths = sorted(left)
            while left.get(j):
                pattern = dominating(left, lengths, j, capacity)
                if pattern is None:
                    break
                need = Counter(pattern)
                times = min(left[n] // c for n, c in need.items())
                for n, c in need.items():
                    left[n] -= times * c
                    if not left[n]:
                        del left[n]
                        lengths.remove(n)
                fixed.append((pattern, times))
                found = True
    counts.clear()
    counts.update(left)
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: every length goes to the sequences with the least room that still hold it."""
    by_room: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, times: int, room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((pattern, times))

    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[n]
        while left:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                each = capacity // n
                full, rest = divmod(left, each)
                if full:
                    put((n,) * each, full, capacity - n * each)
                if rest:
                    put((n,) * rest, 1, capacity - n * rest)
                left = 0
                break
            room = rooms[i]
            pattern, times = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(i)
            each = min(room // n, left)
            use = min(times, left // each)
            put(pattern + (n,) * each, use, room - n * each)
            if times > use:
                put(pattern, times - use, room)
            left -= use * each
    return [p for room in rooms for p in by_room[room]]


def fullest(left: dict[int, int], room: int) -> list[int]:
    """Items of `left` with the largest sum of at most `room`, by reachable sums kept as bits; long items are tried first."""
    steps: list[tuple[int, int, int]] = []
    sums, mask = 1, (1 << (room + 1)) - 1
    for n in sorted(left, reverse=True):
        copies, k = min(left[n], room // n), 1
        while copies and not sums >> room:
            k = min(k, copies)
            steps.append((sums, n, k))
            sums |= (sums << n * k) & mask
            copies, k = copies - k, 2 * k
    at, out = sums.bit_length() - 1, []
    for before, n, k in reversed(steps):
        if not before >> at & 1:
            out += [n] * k
            at -= n * k
    return out


def best_fill(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Sequence by sequence: the longest item left, with the company that leaves the least room."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        j = max(left)
        left[j] -= 1
        pattern = (j, *fullest({n: c for n, c in left.items() if c}, capacity - j))
        left[j] += 1
        need = Counter(pattern)
        times = min(left[n] // c for n, c in need.items())
        for n, c in need.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
        out.append((pattern, times))
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; together they hold every item of `counts` once.

    What the reduction leaves is packed best-fit decreasing, item by item. If that takes more sequences than the sum of the
    lengths needs, it is also packed with the best fit for each sequence, and the plan of fewer sequences is taken.
    """
    rest = {n: c for n, c in counts.items() if c > 0}
    fixed = dominance(rest, capacity)
    loose = best_fit(rest, capacity)
    used = sum(times for _, times in loose)
    if used > -(-sum(n * c for n, c in rest.items()) // capacity):
        filled = best_fill(rest, capacity)
        if sum(times for _, times in filled) < used:
            loose = filled
    return fixed + loose


#: Entries of a task's memory of encoded words; it starts afresh when full.
KNOWN_WORDS = 200_000


def _byte_names() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def word_encoder(tokenizer):
    """ids of one text without ASCII white space, as little-endian 32-bit bytes.

    Words of letters below U+0180 (but U+0130) are single pre-tokens in lower case and normal form, so they go straight to
    the tokenizer's model; everything else takes the tokenizer's whole path. Both give the tokenizer's ids.
    """
    model, names = tokenizer.model, _byte_names()

    def encode(word: str) -> bytes:
        if word.isalpha() and max(word) < "\u0180" and "\u0130" not in word:
            word = word.lower()
            ids = [t.id for t in model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(names))]
        else:
            ids = tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    return encode


def _tokens(path: str, capacity: int, columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        encode, known = word_encoder(tokenizer), {}
        for whole in batches:
            for batch in slices(whole):
                if len(known) > KNOWN_WORDS:
                    known = {}
                texts = batch.column("text").fill_null("").cast(pa.large_string())
                # Pre-tokens never cross white space and end between a letter and a mark, so parts are encoded alone.
                parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([!-@\[-`{-~])", r"\1 \2"))
                coded = parts.flatten().dictionary_encode()
                encoded = []
                for w in coded.dictionary.to_pylist():
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encode(w)
                    encoded.append(ids)
                size = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
                flat = np.frombuffer(b"".join(encoded), "<u4")
                begin = np.cumsum(size) - size
                word = np.asarray(coded.indices, dtype=np.int64)
                n = size[word]
                ends = np.cumsum(n)
                bounds = np.concatenate(([0], ends))[np.asarray(parts.offsets) - parts.offsets[0].as_py()]
                ids = flat[np.repeat(begin[word] - (ends - n), n) + np.arange(int(n.sum()))] if len(word) else np.empty(0, "<u4")
                special = np.flatnonzero(np.asarray(pc.match_substring(texts, "<|")))  # may hold special tokens
                whole_text = {r: np.array(tokenizer.encode(texts[r].as_py(), add_special_tokens=False).ids, "<u4") for r in special.tolist()}
                pick, piece, start, length, crc = [], [], [], [], []
                for r in range(batch.num_rows):
                    own = np.append(whole_text.get(r, ids[bounds[r] : bounds[r + 1]]), np.uint32(0)).astype("<u4")
                    for p, a in enumerate(range(0, len(own), capacity)):
                        cut = own[a : a + capacity]
                        pick.append(r)
                        piece.append(p)
                        start.append(a)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut))
                kept = [batch.column(c).take(pa.array(pick, pa.int64())) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], schema=schema)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, keep: list[str]) -> DataFrame:
    """Token pieces of every document: `keep` columns, piece, start, length, ids_crc32. See pack()."""
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    added = [StructField("piece", IntegerType())] + [StructField(c, LongType()) for c in ("start", "length", "ids_crc32")]
    schema = StructType([source.schema[c] for c in keep] + added)
    return source.mapInArrow(_tokens(tokenizer_path, capacity, keep, to_arrow_schema(schema)), schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pack documents, as token ids with a closing 0, into few sequences of at most `capacity` tokens.

    Returns one row per piece: the `keep` columns, piece, start, length, ids_crc32, sequence_id and offset. Documents longer
    than a sequence are cut into full ones, the last piece may be shorter. Null and empty texts are the closing 0 alone.
    Repeated rows are packed each, null ids too; equal lengths are interchangeable, and their numbers follow `keep`. Columns
    outside `keep` are ignored. An empty table gives an empty result. The driver holds the histogram of lengths, at most
    `capacity` counts.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer_path, capacity, list(keep)), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places, taken, first = [], dict.fromkeys(counts, 0), 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for n in pattern:
            places.append((n, taken[n], taken[n] + times, first, offset))
            taken[n] += times
            offset += n
        first += times
    assert taken == counts
    # One row per length of each pattern: patterns number a few times the lengths, whatever the corpus holds.
    where = F.broadcast(spark.createDataFrame(places, "_n long, _from long, _to long, _first long, _offset long"))
    ranked = number_within(cut, "length", [*keep, "piece"], "_rank", few=True)  # at most `capacity` lengths
    placed = ranked.join(where, (F.col("length") == F.col("_n")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(*keep, "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op7_packing": op7}
ORACLE_SQL: dict[str, str] = {}
