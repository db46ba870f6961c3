"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad; its own and its neighbours' features and the label of the line before speak for either. The
marginals of forward-backward, weighted by line length, add up to the document's quality, which a logistic curve turns into
a probability. Labels exist for documents only, so in training a document's label stands for its lines; a line can still
come out the other way, as the weights are shared by all lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import returning_memory, scan_words, slices, table, text_bytes
from .toxicity import balanced_sample, held_out

LINE_FEATURES = ("length", "words", "word_length", "upper", "digits", "marks", "symbols", "pipes", "stutter", "variety", "repeated_line", "stop", "shouts")
#: Labelled documents the model is fitted on, at most; half of each label.
SAMPLE = 4_000


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_UPPER, _LOWER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789")
_MARKS, _SYMBOLS, _PIPE, _SHOUT = _class(b".,;:!?\"'()-"), _class(b"#*$%&<>=+^~@\\/_{}[]"), _class(b"|"), _class(b"!")


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features [line, feature] of all lines with a word, their lengths in bytes, and the n + 1 first lines of the rows."""
    rows = len(column)
    data, offsets = text_bytes(column)
    raw = np.frombuffer(data, np.uint8)
    begins = np.concatenate(([0], np.flatnonzero(raw == 10) + 1))
    begins, ends = begins[:-1], begins[1:] - 1  # every row ends with a line break of its own
    starts, word_ends, row, hashes = scan_words(data, offsets)
    line_of = np.searchsorted(begins, starts, side="right") - 1
    first_word = np.searchsorted(line_of, np.arange(len(begins) + 1))
    n_words = np.diff(first_word)
    kept = np.flatnonzero(n_words > 0)
    begins, ends, words = begins[kept], ends[kept], n_words[kept].astype(float)
    size = (ends - begins).astype(float)

    def share(of: np.ndarray, total: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(of[raw], dtype=np.int64)))
        return (sums[ends] - sums[begins]) / np.maximum(total, 1)

    def of_words(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.float64)))
        return sums[first_word[kept + 1]] - sums[first_word[kept]]

    letters = share(_UPPER | _LOWER, np.ones_like(size))
    same = np.zeros(len(row), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    order = np.lexsort((hashes, line_of))
    new = np.ones(len(row), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (line_of[order[1:]] != line_of[order[:-1]])
    distinct = np.bincount(line_of[order[new]], minlength=len(n_words))[kept]
    with np.errstate(over="ignore"):
        mixed = hashes * (np.arange(len(hashes), dtype=np.uint64) - first_word[line_of].astype(np.uint64) + np.uint64(1)) if len(hashes) else hashes
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
        line_hash = sums[first_word[kept + 1]] - sums[first_word[kept]]
    line_row = np.searchsorted(offsets, begins, side="right") - 1
    order = np.lexsort((np.arange(len(kept)), line_hash, line_row))
    seen = np.zeros(len(kept), bool)
    seen[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (line_row[order[1:]] == line_row[order[:-1]])
    closing = raw[np.maximum(word_ends[first_word[kept + 1] - 1] - 1, 0)] if len(kept) else np.zeros(0, np.uint8)
    features = np.column_stack([
        np.log1p(size) / 6,
        np.log1p(words) / 5,
        np.minimum(of_words(word_ends - starts) / words / 10, 3),
        share(_UPPER, letters),
        share(_DIGIT, size),
        share(_MARKS, size) * 5,
        np.minimum(share(_SYMBOLS, size) * 5, 3),
        np.minimum(share(_PIPE, size) * 10, 3),
        of_words(same) / words,
        distinct / words,
        seen,
        np.isin(closing, np.frombuffer(b".!?", np.uint8)),
        np.minimum(share(_SHOUT, size) * 10, 3),
    ]).astype(np.float32)
    return features, size, np.searchsorted(line_row, np.arange(rows + 1))


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, its predecessor's and its successor's (zeros at the ends of a document), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    heads, lasts = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
    before[heads] = 0
    after[lasts] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1), x.dtype)])


def marginals(emission: np.ndarray, transition: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for all documents at once.

    `emission` is the log-odds of good for each line, `transition` [from, to] the log weights. Returns P(good) per line, the
    summed pair marginals [from, to] per document's line (0 for first lines), and the log partition per document. Documents
    step together: step t handles the t-th line of every document that has one, longest documents first.
    """
    n, lengths = len(emission), np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    score = np.stack([np.zeros(n), emission], axis=1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    counts = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    for t, live in enumerate(counts.tolist()):
        at = first[order[:live]] + t
        alpha[at] = score[at] if t == 0 else score[at] + np.logaddexp.reduce(alpha[at - 1][:, :, None] + transition, axis=1)
    for t in range(len(counts) - 2, -1, -1):
        at = first[order[: counts[t + 1]]] + t
        beta[at] = np.logaddexp.reduce(transition + (score[at + 1] + beta[at + 1])[:, None, :], axis=2)
    last = np.maximum(first[1:] - 1, 0)
    log_z = np.where(lengths > 0, np.logaddexp.reduce(alpha[last], axis=1) if n else 0.0, 0.0)
    z = np.repeat(log_z, lengths)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - z, 0))
    pairs = np.zeros((n, 2, 2))
    if n > 1:
        pairs[1:] = np.exp(np.minimum(alpha[:-1, :, None] + transition + (score[1:] + beta[1:])[:, None, :] - z[1:, None, None], 0))
    pairs[first[:-1][lengths > 0]] = 0
    return good, pairs, log_z


def train(x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 150, ridge: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Conditional likelihood by Adam on the whole sample: emission weights and 2 x 2 transition weights.

    x holds line features with neighbours, y the line labels. Documents weigh the same whatever their number of lines.
    """
    weights, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
    lengths = np.diff(first)
    weight = np.repeat(1 / np.maximum(lengths, 1), lengths)
    docs = max(1, int((lengths > 0).sum()))
    y = y.astype(float)
    seen = np.zeros((len(y), 2, 2))
    if len(y) > 1:
        seen[np.arange(1, len(y)), y[:-1].astype(int), y[1:].astype(int)] = 1
    seen[first[:-1][lengths > 0]] = 0
    m, v = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for t in range(1, rounds + 1):
        good, pairs, _ = marginals(x @ weights, transition, first)
        g = np.concatenate([((good - y) * weight) @ x / docs + ridge * weights, np.einsum("n,nab->ab", weight, pairs - seen).ravel() / docs + ridge * transition.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights, transition = weights - step[:-4], transition - step[-4:].reshape(2, 2)
    return weights, transition


def document_quality(x: np.ndarray, size: np.ndarray, first: np.ndarray, weights: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Length-weighted mean of P(good) over a document's lines; 0.5 without lines."""
    good, _, _ = marginals(with_neighbours(x, first).astype(np.float64) @ weights, transition, first)
    total = lambda a: np.diff(np.concatenate(([0], np.cumsum(a)))[first])
    bytes_of = total(size)
    return np.where(bytes_of > 0, total(good * size) / np.maximum(bytes_of, 1), 0.5)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p) - np.log1p(-p)


def curve(q: np.ndarray, y: np.ndarray, share_good: float) -> tuple[float, float]:
    """Slope and intercept of a logistic curve from document quality to the label, at the labels' true share of good."""
    z = np.column_stack([logit(q), np.ones(len(q))])
    w = np.array([1.0, 0.0])
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    weight = np.where(y == 1, share_good / y.mean(), (1 - share_good) / (1 - y.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + 1e-3 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-3
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0]), float(w[1])


def _sample_lines(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                x, size, first = line_features(batch.column("text"))
                xs, sizes = [], []
                for r in range(batch.num_rows):
                    a, b = first[r], first[r + 1]
                    xs.append(x[a:b].tobytes())
                    sizes.append(size[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(xs, pa.binary()), pa.array(sizes, pa.binary())], schema=schema)

    return run


class Model:
    def __init__(self, weights: np.ndarray, transition: np.ndarray, slope: float, intercept: float) -> None:
        self.weights, self.transition, self.slope, self.intercept = weights, transition, slope, intercept


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the field and the curve on at most `sample` labelled documents (`labels`: doc_id, quality)."""
    chosen = balanced_sample(labels, "quality", sample)
    shares = {r["quality"]: r["count"] for r in labels.where(F.col("quality").isin(0, 1)).groupBy("quality").count().collect()}
    share_good = shares.get(1, 1) / max(1, sum(shares.values()) or 1)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")
    schema = StructType([picked.schema["doc_id"], picked.schema["label"], StructField("x", BinaryType()), StructField("size", BinaryType())])
    rows = sorted(picked.mapInArrow(_sample_lines(to_arrow_schema(schema)), schema).collect(), key=lambda r: (str(r["doc_id"]), len(r["size"]), bytes(r["size"])))
    rows = [r for r in rows if r["size"]]
    if not rows:
        return Model(np.zeros(3 * len(LINE_FEATURES) + 1), np.zeros((2, 2)), 1.0, 0.0)
    first = np.concatenate(([0], np.cumsum([len(r["size"]) // 8 for r in rows])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, len(LINE_FEATURES))
    size = np.frombuffer(b"".join(bytes(r["size"]) for r in rows))
    y = np.array([r["label"] for r in rows])
    weights, transition = train(with_neighbours(x, first).astype(np.float64), np.repeat(y, np.diff(first)), first)
    q = document_quality(x, size, first, weights, transition)
    return Model(weights, transition, *curve(q, y, share_good))


def _score(model: tuple, columns: list[str], schema: pa.Schema):
    weights, transition, slope, intercept = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                x, size, first = line_features(batch.column("text"))
                q = document_quality(x, size, first, weights, transition)
                p = 1 / (1 + np.exp(-np.clip(slope * logit(q) + intercept, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(p)], schema=schema)

    return run


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    """Quality score in [0, 1] of every document: the `keep` columns (none of them named score) and score.

    Null and empty texts have no lines and score by the curve at 0.5. Repeated rows are scored each. Without usable labels
    every document scores 0.5. Training uses at most `sample` labelled documents, half of each label, a documented bound, and
    every line of them; scoring uses every line of every document. Columns outside `keep` are ignored, whatever their names;
    an empty table gives an empty result.
    """
    m = learn(docs, labels, sample)
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = StructType([source.schema[c] for c in keep] + [StructField("score", DoubleType())])
    return source.mapInArrow(returning_memory(_score((m.weights, m.transition, m.slope, m.intercept), list(keep), to_arrow_schema(schema))), schema)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8}
ORACLE_SQL: dict[str, str] = {}
