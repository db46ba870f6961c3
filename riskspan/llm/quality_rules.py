"""Quality rules: weak supervision over rules that vote good, vote bad or abstain.

Rules are labelling functions, each with an abstain band. The hidden class of a document is good or one of a few kinds of
defect (KINDS); a kind is what several rules look at, so no rule alone defines it. Expectation-maximisation estimates from all
documents, without labels, how often each rule votes bad on good documents and on those of each kind: its accuracies. The
posterior probability of the good class replaces all-must-pass filtering, so a rule that often accuses alone is outvoted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import count_codepoints, materialise, scan_words, slices, starts_of, table, text_bytes, window_hashes

REPEAT_WINDOW = 8
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_same_next", "n_distinct", "n_marked_words", "n_shouts", "n_open_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that words of prose are made of besides letters of any script: digits and common marks.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), *b".,;:!?'\"()-"]] = True
_CLOSING = (b".", b"!", b"?", b":", b";", b'"', b"'", b")")


def _covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of the positions `at`."""
    edges = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + k, minlength=n + 1)[: n + 1]
    return np.cumsum(edges[:n]) > 0


def document_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of _STATS for each text (null: zeros)."""
    rows = len(column)
    data, offsets = text_bytes(column)
    raw = np.frombuffer(data, np.uint8)
    starts, ends, row, hashes = scan_words(data, offsets)
    first = starts_of(row, rows)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[offsets[1:]] - total[offsets[:-1]]

    def per_row_words(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[first[1:]] - total[first[:-1]]

    points = np.concatenate(([0], np.cumsum(count_codepoints(raw), dtype=np.int64)))
    chars = points[ends] - points[starts]
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    same = np.zeros(len(row), bool)
    same[:-1] = (hashes[:-1] == hashes[1:]) & (row[:-1] == row[1:])

    windows = window_hashes(hashes, REPEAT_WINDOW)
    n = len(windows)
    inside = row[:n] == row[REPEAT_WINDOW - 1 :] if n else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    order = at[np.lexsort((windows[at], row[at]))]
    twin = (windows[order[1:]] == windows[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    repeated = np.zeros(len(order), bool)
    repeated[1:] |= twin
    repeated[:-1] |= twin
    covered = _covered(order[repeated], REPEAT_WINDOW, len(row))

    order = np.lexsort((hashes, row))
    new = np.ones(len(row), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    distinct = np.bincount(row[order[new]], minlength=rows)

    odd = np.concatenate(([0], np.cumsum(~_PLAIN[raw], dtype=np.int64)))
    marked = odd[ends] > odd[starts]

    n_lines, dup_lines, open_lines = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for r in range(rows):
        seen: set[bytes] = set()
        for line in data[offsets[r] : offsets[r + 1] - 1].split(b"\n"):
            if line and not line.isspace():
                n_lines[r] += 1
                open_lines[r] += not line.rstrip().endswith(_CLOSING)
                if line in seen:
                    dup_lines[r] += 1
                seen.add(line)
    values = (np.diff(first), per_row_words(chars), per_row(_SYMBOL[raw]), dup_lines, per_row_words(covered), n_lines, per_row(upper), per_row(upper | lower), per_row_words(same), distinct, per_row_words(marked), per_row(raw == 33), open_lines)
    return dict(zip(_STATS, values, strict=True))


def _scan(columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                stats = document_statistics(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(stats[s], pa.int64()) for s in _STATS)], schema=schema)

    return run


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = StructType([source.schema[c] for c in keep] + [StructField(s, LongType()) for s in _STATS])
    return source.mapInArrow(_scan(keep, to_arrow_schema(schema)), schema)


#: The rules by the kind of defect that they look at.
KINDS = {
    "symbols": ("symbols", "marked_words", "open_lines"),
    "repetition": ("repeats", "stutter", "variety", "same_lines"),
    "shouting": ("capitals", "shouts"),
    "stub": ("length", "word_length"),
}
RULES = tuple(r for rules in KINDS.values() for r in rules)


def votes() -> dict[str, Column]:
    """The rules, as columns over the statistics: 1 votes good, 0 votes bad, null abstains. Texts without words get no vote but length's."""
    words, lines = F.col("n_words"), F.col("n_lines")

    def rule(value: Column, bad_above: float, good_below: float, needs: Column) -> Column:
        return F.when(needs, F.when(value > bad_above, 0).when(value < good_below, 1))

    def per(count: str, total: str) -> Column:
        return F.col(count) / F.greatest(total, F.lit(1))

    size = per("word_chars", "n_words")
    variety = per("n_distinct", "n_words")
    return {
        "symbols": rule(per("n_symbols", "n_words"), 0.15, 0.05, words > 0),
        "marked_words": rule(per("n_marked_words", "n_words"), 0.2, 0.05, words > 0),
        "open_lines": rule(per("n_open_lines", "n_lines"), 0.5, 0.2, lines > 0),
        "repeats": rule(per("n_repeat_words", "n_words"), 0.3, 0.1, words >= 8),
        "stutter": rule(per("n_same_next", "n_words"), 0.2, 0.05, words > 1),
        "variety": F.when(words >= 50, F.when(variety < 0.2, 0).when(variety > 0.35, 1)),
        "same_lines": rule(per("n_dup_lines", "n_lines"), 0.5, 0.25, lines >= 4),
        "capitals": rule(per("n_upper", "n_letters"), 0.5, 0.2, F.col("n_letters") >= 20),
        "shouts": rule(per("n_shouts", "n_words"), 0.3, 0.1, words > 0),
        "length": F.when(words < 20, 0).when(words >= 40, 1),
        "word_length": F.when(words > 0, F.when((size < 2.5) | (size > 14), 0).when((size >= 3) & (size <= 9), 1)),
    }


class Fit(NamedTuple):
    """share [class] and bad [rule, class]: P(bad vote | class, the rule votes). Class 0 is good, the others are KINDS."""

    share: np.ndarray
    bad: np.ndarray

    def accuracy(self) -> np.ndarray:
        """[rule, 2]: how often a rule's votes are right on good documents and on documents with a defect of any kind."""
        return np.stack([1 - self.bad[:, 0], self.bad[:, 1:] @ self.share[1:] / self.share[1:].sum()], axis=1)


def fit(patterns: np.ndarray, counts: np.ndarray, kinds: dict[str, tuple[str, ...]] = KINDS, rounds: int = 500) -> Fit:
    """EM over vote patterns (0 bad, 1 good, 2 abstain; a column for each rule of `kinds`, in order) with their counts.

    Votes are independent given the class, and abstaining says nothing. What the classes mean is fixed by where the rounds
    start, not by bounds: rules mostly vote good on good documents, and bad on their own kind. A prior of two votes a cell
    (one of each) keeps rates off 0 and 1. Deterministic; an empty table gives the start.
    """
    names = [r for rules in kinds.values() for r in rules]
    bad = np.full((len(names), 1 + len(kinds)), 0.1)
    for k, rules in enumerate(kinds.values()):
        for r in rules:
            bad[names.index(r), k + 1] = 0.8
    model = Fit(np.array([0.8] + [0.2 / len(kinds)] * len(kinds)), bad)
    for _ in range(rounds if len(patterns) else 0):
        weight = responsibility(patterns, model) * counts[:, None]
        accused, voted = (patterns == 0).T @ weight, (patterns != 2).T @ weight
        new = Fit((weight.sum(0) + 1) / (counts.sum() + len(model.share)), (accused + 1) / (voted + 2))
        moved = max(np.abs(new.share - model.share).max(), np.abs(new.bad - model.bad).max())
        model = new
        if moved < 1e-9:
            break
    return model


def responsibility(patterns: np.ndarray, model: Fit) -> np.ndarray:
    """P(class | votes) as [pattern, class]."""
    log = np.log(model.share) + (patterns == 0) @ np.log(model.bad) + (patterns == 1) @ np.log1p(-model.bad)
    p = np.exp(log - log.max(1, keepdims=True)) if len(patterns) else np.empty((0, len(model.share)))
    return p / p.sum(1, keepdims=True)


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """Rule statistics, base_failed, kept and the posterior probability of quality for every document.

    base_failed: fewer than 20 words, or over 30 % of the words repeated. kept: not base_failed and a posterior of at least
    `threshold`. Null and empty texts have no words, so fail the base. Repeated rows are judged each, null ids too; an empty
    table gives an empty result; other columns are ignored. The driver and every task see one row per vote pattern that
    occurs, at most 3 ** 11 (177,147) for any input; accuracies come from the counts of all documents.
    """
    spark = docs.sparkSession
    rules = votes()
    stats = statistics(docs, list(keep)).withColumns({f"_v_{r}": F.coalesce(v, F.lit(2)).cast("int") for r, v in rules.items()})
    stats = materialise(stats.withColumn("_pattern", F.concat(*[F.col(f"_v_{r}").cast("string") for r in rules])).drop(*[f"_v_{r}" for r in rules]), "rule-votes")
    seen = stats.groupBy("_pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("_pattern").collect()
    patterns = np.array([[int(c) for c in r["_pattern"]] for r in seen], dtype=np.int64).reshape(len(seen), len(rules))
    good = responsibility(patterns, fit(patterns, np.array([r["n"] for r in seen], dtype=float)))[:, 0]
    scored = [(r["_pattern"], float(p)) for r, p in zip(seen, good, strict=True)]
    by_pattern = F.broadcast(spark.createDataFrame(scored, "_p string, posterior double"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = stats.join(by_pattern, F.col("_pattern") == F.col("_p")).withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    return judged.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op3_quality_rules": op3}
ORACLE_SQL: dict[str, str] = {}
