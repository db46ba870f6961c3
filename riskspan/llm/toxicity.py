"""Toxicity: a lexicon trie met with Levenshtein automata, and the words around each hit.

Terms are found exactly or misspelled (one edit from five letters on, two from nine); stems match the words that go on after
them, misspelled stems too. Both are learned from labelled documents and joined by a few seed terms. Each hit is read in a window of words:
quotation marks and reporting verbs speak for quotation, second-person address and further hits for abuse. A logistic model
over these counts, trained on a bounded sample of labelled documents, gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import materialise, scan_words, slices, starts_of, table, text_bytes

# Terms of abuse that need no labels.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting")
# Words that report speech, and words that address the reader.
REPORTING = ("said", "says", "called", "quoted", "quote", "wrote", "writes", "term", "word", "slur", "insult", "phrase")
ADDRESS = ("you", "your", "youre", "u", "ur", "yourself")

CONTEXT = 6
FEATURES = ("exact", "misspelled", "quoted", "reported", "addressed", "clustered", "density")
#: Labelled documents that the model and the learned terms are fitted on, at most, half of them of each label; and terms that
#: are learned, at most, the commonest first. Both are parameters of score().
SAMPLE = 8_000
LEARNED_TERMS = 300

# Letters, digits, bytes of other scripts and the marks that stand for letters stay; A-Z become a-z; the rest is space.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 or c in b"@$" else 0x20 for c in range(256))


def edits_allowed(term: str) -> int:
    """Edits of letters (code points), by the number of letters."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie that a word's Levenshtein automaton walks, of terms and of stems (written with a final *) that words go on from."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = sorted({t for t in terms if not t.endswith("*")})
        self.stems = sorted({t[:-1] for t in terms if t.endswith("*")}, key=len)
        self.root: dict = {}
        for end, entries in (("", self.terms), ("*", self.stems)):
            for t in entries:
                node = self.root
                for c in t:
                    node = node.setdefault(c, {})
                node[end] = t

    def match(self, word: str, most: int = 2) -> tuple[str, int] | None:
        """The nearest term or stem within the edits that its length allows, and the distance. Ties: the first by spelling.

        The automaton of `word` with up to `most` edits is run along the trie: its state after a trie path is the row of edit
        distances between the path and every prefix of the word, and a branch ends where no entry is within `most`. A term
        needs the entry of the whole word, a stem that of any prefix after which the word goes on.
        """
        for stem in self.stems:
            if len(word) > len(stem) and word.startswith(stem):
                return stem + "*", 0
        best: tuple[int, str] | None = None
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, state = stack.pop()
            term = node.get("")
            if term is not None and state[-1] <= edits_allowed(term):
                best = min(best or (99, ""), (state[-1], term))
            stem = node.get("*")
            if stem is not None and word != stem and min(state[1:-1], default=99) <= edits_allowed(stem):
                best = min(best or (99, ""), (min(state[1:-1]), stem + "*"))
            for c, child in node.items():
                if c not in ("", "*"):
                    row = [state[0] + 1]
                    for i, w in enumerate(word, 1):
                        row.append(min(row[i - 1] + 1, state[i] + 1, state[i - 1] + (w != c)))
                    if min(row) <= most:
                        stack.append((child, row))
        return best and (best[1], best[0])


def _letters(word: str) -> int:
    mask = 0
    for b in word.encode():
        mask |= 1 << (b & 63)
    return mask


class Matcher:
    """Finds lexicon hits among all distinct words of a block.

    Words that cannot match skip the automaton, by conditions that every match meets. A match with one edit has one half of
    the term unchanged, so its first or last two bytes; with two edits one of three parts is unchanged, so the first or last
    three bytes, or the fourth to sixth letter, moved by two letters at most. An edit changes two letters of the word's letter
    set (up to five bits where a letter of several bytes is involved, eight where the term has such letters) and its length by
    one (four) at most. A word that goes on from a stem has these parts of the stem too (the last part wherever the edits
    moved it to) and lacks one letter of it for each edit (up to four bits if the stem has letters of several bytes).
    """

    def __init__(self, terms: list[str]) -> None:
        self.lexicon = Lexicon(terms)
        self.terms = []
        for t in self.lexicon.terms:
            raw = t.encode()
            self.terms.append((np.uint64(_letters(t)), len(raw), edits_allowed(t), raw, t.isascii()))
        self.heads = np.unique([int.from_bytes(t.encode()[:4].ljust(4), "little") for t in self.lexicon.stems] or [0]).astype(np.uint32)
        self.stems = []
        for t in self.lexicon.stems:
            edits = edits_allowed(t)
            if edits:
                cuts = [len(t[:k].encode()) for k in ((2,) if edits == 1 else (3, 6))]
                self.stems.append((np.uint64(_letters(t)), edits, t.encode(), cuts, t.isascii()))
        self.known: dict[bytes, int] = {}
        self.marks = [{w.encode() for w in REPORTING}, {w.encode() for w in ADDRESS}]

    def candidates(self, masks: np.ndarray, lengths: np.ndarray, raw: np.ndarray, begin: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """raw: the text's bytes and some padding on both sides; begin: where the words start in it; plain: ASCII words."""

        def part(at: np.ndarray, k: int) -> np.ndarray:
            return sum(raw[at + i].astype(np.uint32) << np.uint32(8 * i) for i in range(k))

        code = lambda b: int.from_bytes(b, "little")
        head, tail, end = part(begin, 4), part(begin + lengths - 3, 3), begin + lengths

        def moved(near: np.ndarray, term: bytes, cut: int, edits: int, simple: np.ndarray) -> np.ndarray:
            """Whether the three bytes of the term from `cut` on stand in the word, moved by the edits (in bytes: four each)."""
            out = np.zeros(len(near), bool)
            for which, far in ((np.flatnonzero(simple), edits), (np.flatnonzero(~simple), 4 * edits)):
                at, last = begin[near[which]], end[near[which]]
                for d in range(max(0, cut - far), cut + far + 1):
                    stop = at + d + 3 <= last
                    out[which[stop]] |= part(at[stop] + d, 3) == code(term[cut : cut + 3])
            return out

        found = np.isin(head, self.heads)
        for mask, size, edits, term, ascii_term in self.terms:
            if edits < 2:
                near = np.flatnonzero((head & np.uint32(0xFFFF) == code(term[:2])) | (tail >> np.uint32(8) == code(term[-2:])))
            else:
                near = np.flatnonzero(np.abs(lengths - size) <= 4 * edits)
                same = (head[near] & np.uint32(0xFFFFFF) == code(term[:3])) | (tail[near] == code(term[-3:]))
                same |= moved(near, term, len(term.decode()[:3].encode()), 2, plain[near] & ascii_term)
                near = near[same]
            simple = plain[near] & ascii_term
            gap = np.abs(lengths[near] - size) <= np.where(simple, edits, 4 * edits)
            near, simple = near[gap], simple[gap]
            found[near[np.bitwise_count(masks[near] ^ mask) <= np.where(simple, 2 * edits, (5 if ascii_term else 8) * edits)]] = True
        for mask, edits, stem, cuts, ascii_stem in self.stems:
            near = np.flatnonzero(np.bitwise_count(mask & ~masks) <= (1 if ascii_stem else 4) * edits)
            same = head[near] & np.uint32(0xFFFF if edits == 1 else 0xFFFFFF) == code(stem[: edits + 1])
            for cut in cuts:
                same |= moved(near, stem, cut, edits, plain[near] & ascii_stem)
            found[near[same]] = True
        return found

    def kind(self, word: bytes) -> int:
        """0 nothing, 1 exact, 2 misspelled."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known = {}
            hit = self.lexicon.match(word.decode("utf-8", "replace"))
            got = self.known[word] = 0 if hit is None else 1 if hit[1] == 0 else 2
        return got


#: Opening and closing quotation marks that differ.
_QUOTES = (("\u201c", "\u201d"), ("\u201e", "\u201c"), ("\u00ab", "\u00bb"))


def quoted(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which spans lie inside quotation marks of their line.

    Straight marks: an odd number of them from the start of the line to the span, and another after it. Marks that differ: one
    opened before the span and is not closed before it, but after it, in the line.
    """
    def at(mark: str) -> np.ndarray:
        return np.array([m.start() for m in re.finditer(re.escape(mark.encode()), data)], dtype=np.int64)

    def last(marks: np.ndarray) -> np.ndarray:
        return np.concatenate(([-1], marks))[np.searchsorted(marks, begin)]

    def following(marks: np.ndarray) -> np.ndarray:
        return np.append(marks, len(data))[np.searchsorted(marks, end)]

    breaks, straight = at("\n"), at('"')
    line, stop = last(breaks), following(breaks)
    before = np.searchsorted(straight, begin) - np.searchsorted(straight, line, side="right")
    out = (before % 2 == 1) & (following(straight) < stop)
    for opening, closing in _QUOTES:
        opens, closes = at(opening), at(closing)
        out |= (last(opens) > np.maximum(line, last(closes))) & (following(closes) < stop)
    return out


def features(matcher: Matcher, column: pa.Array) -> np.ndarray:
    """FEATURES of each text as float64 [row, feature] (null: zeros)."""
    rows = len(column)
    data, offsets = text_bytes(column)
    # Marks of several bytes part words like those of one byte.
    raw_folded = re.sub(rb"\xe2\x80[\x90-\xbf]|\xc2[\xab\xbb]", lambda m: b" " * len(m[0]), data).translate(_FOLD)
    starts, ends, row, hashes = scan_words(raw_folded, offsets)
    out = np.zeros((rows, len(FEATURES)))
    if not len(starts):
        return out
    first = starts_of(row, rows)
    distinct, example, code = np.unique(hashes, return_index=True, return_inverse=True)
    bits = np.uint64(1) << (np.frombuffer(raw_folded, np.uint8) & 63).astype(np.uint64)
    bits[np.frombuffer(raw_folded, np.uint8) == 32] = 0
    masks = np.bitwise_or.reduceat(bits, starts)[example]
    kinds = np.zeros(len(distinct), np.int8)
    padded = np.frombuffer(b"  " + raw_folded + b"        ", np.uint8)
    plain = ~np.logical_or.reduceat(padded[2 : 2 + len(data)] >= 0x80, starts)[example]
    for i in np.flatnonzero(matcher.candidates(masks, (ends - starts)[example], padded, starts[example] + 2, plain)).tolist():
        at = example[i]
        kinds[i] = matcher.kind(raw_folded[starts[at] : ends[at]])
    # Context words are short ASCII words: compare them by hash.
    marks = [np.isin(distinct, scan_words(b" ".join(sorted(m)), np.array([0, 1 << 30]))[3]) for m in matcher.marks]
    hit = np.flatnonzero(kinds[code] > 0)
    if not len(hit):
        return out
    word_kind, reported, addressed = kinds[code], marks[0][code], marks[1][code]
    inside = quoted(data, starts[hit], ends[hit])
    for p, in_quotes in zip(hit.tolist(), inside.tolist(), strict=True):
        r = row[p]
        a, b = max(first[r], p - CONTEXT), min(first[r + 1], p + CONTEXT + 1)
        out[r, 0 if word_kind[p] == 1 else 1] += 1
        out[r, 2] += in_quotes
        out[r, 3] += reported[a:b].any()
        out[r, 4] += addressed[a:b].any()
        out[r, 5] += (word_kind[a:b] > 0).sum() > 1
    hits = out[:, 0] + out[:, 1]
    out[:, 6] = hits / np.maximum(1, np.diff(first))
    out[:, :6] = np.log1p(out[:, :6])
    out[:, 6] = np.log1p(100 * out[:, 6])
    return out


def _scan(terms: list[str], columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for whole in batches:
            for batch in slices(whole):
                f = features(matcher, batch.column("text"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(len(FEATURES)))], schema=schema)

    return run


def document_features(docs: DataFrame, terms: list[str], keep: list[str]) -> DataFrame:
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = StructType([source.schema[c] for c in keep] + [StructField(c, DoubleType()) for c in FEATURES])
    return source.mapInArrow(_scan(terms, keep, to_arrow_schema(schema)), schema)


def learn_terms(docs: DataFrame, sample: DataFrame, most: int = LEARNED_TERMS, least: int = 6, least_share: float = 0.01, times: float = 30.0) -> list[str]:
    """Words and stems (with a final *) that toxic documents of the sample (doc_id, label) hold and others hardly ever do.

    Near copies, known by three equal minimum hashes over their words, count once. A word counts once per document; a stem,
    the first four to twelve letters, counts with the words that go on after it. Learned is what at least `least` toxic
    documents and `least_share` of them hold, at `times` the rate of the others. Words stay beside the stems that cover
    them, as a stem does not find their misspellings alike. The `most` commonest stay.
    """
    folded = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}@$]+", " ")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    texts = texts.select("label", F.array_distinct(F.split(folded, " ")).alias("ws"))

    def low(seed: int):
        return F.array_min(F.transform("ws", lambda w: F.xxhash64(w, F.lit(seed)))).alias(f"low{seed}")

    lows = [low(k) for k in range(3)]
    texts = texts.select("*", *lows).groupBy("low0", "low1", "low2").agg(F.max_by("ws", F.size("ws")).alias("ws"), F.max("label").alias("label"))
    words = texts.select("label", F.explode("ws").alias("w")).where("length(w) >= 4")
    counts = words.groupBy("w").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    counts = materialise(counts, "toxic-words")
    n = texts.agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).first()
    if not n["bad"] or not n["good"]:
        return []
    heads = F.transform(F.sequence(F.lit(4), F.least(F.lit(12), F.length("w") - 1)), lambda k: F.concat(F.substring("w", F.lit(1), k), F.lit("*")))
    stems = counts.where("length(w) > 4").select(F.explode(heads).alias("w"), "bad", "good").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate = F.col("bad") / F.lit(float(n["bad"])) / ((F.col("good") + 0.5) / F.lit(n["good"] + 1.0))
    chosen = counts.unionByName(stems).where((F.col("bad") >= max(least, least_share * n["bad"])) & (rate >= times)).orderBy(F.col("bad").desc(), "w").limit(4 * most)
    bad = {r["w"]: r["bad"] for r in chosen.collect()}
    # A stem that a longer term nearly always goes on to is that term.
    names = [w for w in bad if not (w.endswith("*") and any(len(v) > len(w) - (not v.endswith("*")) and v.startswith(w[:-1]) and v != w and bad[v] >= 0.9 * bad[w] for v in bad))]
    return sorted(names, key=lambda w: (-bad[w], w))[:most]


def train(x: np.ndarray, y: np.ndarray, share: float | None = None, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton's method; weights with the intercept last. One class or no row: the seed model.

    The classes weigh as if a `share` of the rows were 1 (none given: as they are).
    """
    if not len(y) or y.min() == y.max():
        return np.array([3.0, 2.0, -1.0, -1.0, 0.5, 0.5, 0.5, -3.0])
    z = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(y)) if share is None else np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.full(len(w), ridge * len(y) / 100)
        penalty[-1] = 1e-6
        g = z.T @ (weight * (p - y)) + penalty * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of all ids labelled 0 or 1, once each; 1 if either label says so."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def balanced_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` labelled ids, at most half of them of each label, by the hash of the id (the same on every run)."""
    known = labelled_ids(labels, label)
    halves = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for v in (0, 1)]
    rows = [tuple(r) for h in halves for r in h.collect()]
    return labels.sparkSession.createDataFrame(rows, StructType([labels.schema["doc_id"], StructField("label", known.schema["label"].dataType)]))


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE, terms: int = LEARNED_TERMS) -> DataFrame:
    """Toxicity score in [0, 1] of every document, by a model learned from `labels` (doc_id, toxic).

    Returns the `keep` columns, score, predicted (score >= 0.5) and exact and misspelled (hits, as log(1 + n)). Null and empty texts score as texts without
    hits. Repeated rows are scored each; labels of ids that are not in docs are unused; an id labelled twice counts as toxic
    if either label says so. At most `sample` labelled documents are used for training and at most `terms` terms are learned,
    documented bounds; the documents weigh by the classes' shares of all labelled ids, so the bound does not move the scores.
    Every document is scored. Columns outside `keep` are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    inner = {c: f"_keep{i}" for i, c in enumerate(keep)}
    docs = docs.select("doc_id", "text", *[F.col(c).alias(i) for c, i in inner.items()])
    chosen = balanced_sample(labels, "toxic", sample)
    lexicon = sorted({*SEED_TERMS, *learn_terms(docs, chosen, terms)})
    counted = materialise(document_features(docs, lexicon, ["doc_id", *inner.values()]), "toxicity-features")
    rows = counted.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select("label", *FEATURES).collect()
    data = np.array([tuple(r) for r in rows], dtype=float).reshape(len(rows), 1 + len(FEATURES))
    data = data[np.lexsort(data.T)]
    share = labelled_ids(labels, "toxic").agg(F.avg("label")).first()[0]
    w = train(data[:, 1:], data[:, 0], share)
    logit = sum((F.col(f) * float(k) for f, k in zip(FEATURES, w, strict=False)), F.lit(float(w[-1])))
    value = 1 / (1 + F.exp(-logit))
    return counted.select(*[F.col(i).alias(c) for c, i in inner.items()], value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), "exact", "misspelled")


def held_out(doc_id, parts: int, part: int):
    """True for the fold of ids that labels are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    out = score(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1}
ORACLE_SQL: dict[str, str] = {}
