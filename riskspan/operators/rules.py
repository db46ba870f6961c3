"""Rules over code: which risk classes a text may concern (retrieval), and which static conditions hold (confirmation).

A rule base is a table that the tasks hold, so the plan is the same for six rules and for twenty thousand terms. Retrieval looks
a text's distinct q-grams up in an inverted index of the terms, each term under its rarest q-gram, and confirms what it finds on
the text. Confirmation runs a pair's own conditions only. A base above MOST_BYTES goes to the tasks part by part.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .ordered import stored

#: Characters of the terms and patterns of rules that a task holds at a time.
MOST_BYTES = 32 << 20
#: Bytes of texts that a task turns into Python strings at a time.
CUT_BYTES = 1 << 20
#: Characters of the q-grams: a term is indexed by the longest that it holds.
GRAMS = (12, 6, 3)


def well_formed(pattern: str, rule: str = "") -> bool:
    """Whether a pattern compiles. One that does not is left out with a warning: a slip in the rule base must not stop a run."""
    try:
        re.compile(pattern)
    except re.error as e:
        warnings.warn(f"rule {rule}: pattern {pattern!r} is left out: {e}", stacklevel=3)
        return False
    return True


@dataclass(frozen=True)
class Rule:
    """One risk class. Literals are matched without case; patterns are regular expressions, also without case."""

    id: str
    severity: str = "high"
    layer: str = "economic"
    mitigation: str | None = None
    applies_to: tuple[str, ...] = ("all",)
    must_call: tuple[str, ...] = ()
    must_call_patterns: tuple[str, ...] = ()
    must_lack: tuple[str, ...] = ()
    must_lack_patterns: tuple[str, ...] = ()
    must_have: tuple[str, ...] = ()
    must_have_patterns: tuple[str, ...] = ()
    captures: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()
    checks: tuple[str, ...] = field(default=())
    title: str = ""
    category: str = ""
    scenario: str = ""
    property: str = ""
    evidence: str = ""
    invariants: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in ("must_call_patterns", "must_lack_patterns", "must_have_patterns", "captures"):
            object.__setattr__(self, name, tuple(p for p in getattr(self, name) if well_formed(p, self.id)))

    def terms(self) -> list[str]:
        """Retrieval terms; repeats stay. Terms lose brackets and blanks at their ends after empty ones are dropped."""
        return [t.strip("(").strip().lower() for t in (*self.must_call, *self.must_have, *self.hints) if t]


def dimension(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.id, r.severity, r.layer, r.mitigation, list(r.applies_to)) for r in rules]
    return spark.createDataFrame(rows, "class_id string, severity string, layer string, mitigation string, applies_to array<string>")


def without_mitigation(classes: DataFrame, mitigations: DataFrame) -> DataFrame:
    """Classes whose mitigation is unknown: empty for a rule base of integrity."""
    return classes.join(mitigations.select("mitigation"), "mitigation", "left_anti").select("class_id", "mitigation")


def parts_of(rules: list[Rule], most_bytes: int) -> list[list[Rule]]:
    """The rules in runs of at most `most_bytes` characters of terms and patterns (a larger single rule is its own run)."""
    out: list[list[Rule]] = [[]]
    held = 0
    for r in rules:
        size = sum(len(x) for x in (*r.terms(), *r.must_call, *r.must_lack, *r.must_have, *r.must_call_patterns, *r.must_lack_patterns, *r.must_have_patterns, *r.captures))
        if out[-1] and held + size > most_bytes:
            out.append([])
            held = 0
        out[-1].append(r)
        held += size
    return out


class TermIndex:
    """An inverted index of the rules' terms: q-gram to terms, term to (rule, how often the rule lists it)."""

    def __init__(self, rules: list[Rule]) -> None:
        self.ids = [r.id for r in rules]
        self.sizes = [len(r.terms()) for r in rules]
        self.rules: dict[str, list[tuple[int, int]]] = {}
        for k, r in enumerate(rules):
            for term, n in Counter(r.terms()).items():
                self.rules.setdefault(term, []).append((k, n))

    @cached_property
    def grams(self) -> tuple[list[str], dict[int, dict[str, list[str]]]]:
        """Terms shorter than a q-gram, and for each length the others by their q-gram that fewest terms hold. Built once a task."""
        cuts = {t: {t[i : i + q] for i in range(len(t) - q + 1)} for t in self.rules for q in [self._length(t)] if q}
        often = Counter(g for own in cuts.values() for g in own)
        index: dict[int, dict[str, list[str]]] = {}
        for term, own in cuts.items():
            rarest = min(own, key=lambda g: (often[g], g))
            index.setdefault(len(rarest), {}).setdefault(rarest, []).append(term)
        return [t for t in self.rules if t not in cuts], index

    @staticmethod
    def _length(term: str) -> int:
        return next((q for q in GRAMS if q <= len(term)), 0)

    def scores(self, low: str) -> dict[int, float]:
        """Of each rule with a term in the text: terms found over the square root of their number."""
        short, index = self.grams
        asked = list(short)
        for q, terms in index.items():
            for g in {low[i : i + q] for i in range(len(low) - q + 1)} & terms.keys():
                asked += terms[g]
        hits: Counter = Counter()
        for term in asked:
            if term in low:
                for k, n in self.rules[term]:
                    hits[k] += n
        return {k: n / self.sizes[k] ** 0.5 for k, n in hits.items()}


RANKED = ArrayType(StructType([StructField("class_id", StringType()), StructField("score", DoubleType())]))


def _cut(*columns: pa.Array) -> Iterator[list[list]]:
    """The columns of a batch as Python lists, so many rows at a time that they hold about CUT_BYTES (a larger row stands alone)."""
    n, at = len(columns[0]), 0
    sizes = sum(c.nbytes for c in columns) // max(1, n)
    while at < n:
        rows = max(1, CUT_BYTES // max(1, sizes))
        yield [c.slice(at, rows).to_pylist() for c in columns]
        at += rows


def _computed(kind, compute, *inputs: str) -> Column:
    """A column that a function makes of the inputs' rows, a list of results for lists of values. Only the inputs go to Python and
    only the results come back. Marked as not deterministic, so that no filter above computes it a second time."""
    arrow = to_arrow_schema(StructType([StructField("c", kind)])).field("c").type

    def run(*columns: pa.Array) -> pa.Array:
        parts = [pa.array(compute(*part), arrow) for part in _cut(*columns)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR).asNondeterministic()(*inputs)


def retrieve(texts: DataFrame, rules: list[Rule], code: str = "code", top_k: int = 4, min_score: float = 0.0, forced: tuple[str, ...] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """The top_k classes of each text with a score above min_score, best first and by id on ties, then forced ones at score 0.

    Score: terms found over the square root of the number of terms. Adds class_id, score and rank (from 1). Null text is empty.
    Rules of several parts are ranked part by part; a rule is in one of them.
    """
    columns = texts.columns
    out = texts.withColumn("_low", F.lower(F.coalesce(F.col(code), F.lit(""))))
    parts = parts_of(rules, most_bytes)
    for at, part in enumerate(parts):
        index = texts.sparkSession.sparkContext.broadcast(TermIndex(part))

        def ranked(lows: list[str], befores: list | None = None, index=index) -> list[list[dict]]:
            found = []
            for low, before in zip(lows, befores or [[]] * len(lows), strict=True):
                scores = index.value.scores(low)
                if min_score < 0:  # then rules without a term in the text count too
                    scores = dict.fromkeys(range(len(index.value.ids)), 0.0) | scores
                own = [{"class_id": index.value.ids[k], "score": s} for k, s in scores.items() if s > min_score]
                found.append(sorted(before + own, key=lambda x: (-x["score"], x["class_id"]))[:top_k])
            return found

        out = out.withColumn("_ranked", _computed(RANKED, ranked, "_low", *(["_ranked"] if at else [])))
        if at < len(parts) - 1:
            out = stored(out)  # the next part's index must not stand beside this one's
    best = F.col("_ranked")
    if forced:
        extra = F.array(*[F.struct(F.lit(c).alias("class_id"), F.lit(0.0).alias("score")) for c in forced])
        best = F.concat(best, F.filter(extra, lambda e: ~F.exists("_ranked", lambda s: s["class_id"] == e["class_id"])))
    return out.select(*columns, F.posexplode(best).alias("_at", "_hit")).select(*columns, "_hit.class_id", "_hit.score", (F.col("_at") + 1).alias("rank"))


#: Kinds of conditions, and what their hits are called.
_HITS = (("must_call", "must_call_hits"), ("must_lack", "guards_present"), ("must_have", "must_have_hits"))
_STRINGS = "array<string>"
_LIST = ArrayType(StringType())
SEEN = StructType([*(StructField(kind, _LIST) for kind, _ in _HITS), StructField("numbers", _LIST), StructField("checks", _LIST)])


class Conditions:
    """What a rule looks for in a text."""

    def __init__(self, rule: Rule) -> None:
        self.kinds = [(getattr(rule, kind), getattr(rule, f"{kind}_patterns")) for kind, _ in _HITS]
        self.captures, self.checks = rule.captures, list(rule.checks)

    def seen(self, body: str, low: str) -> dict:
        """Literals and, marked re:, patterns that the text holds, in their order; null if there are none to look for."""
        out = {}
        for (kind, _), (literals, patterns) in zip(_HITS, self.kinds, strict=True):
            held = [t for t in literals if t.lower() in low] + [f"re:{p}" for p in patterns if re.search(p, body, re.IGNORECASE)]
            out[kind] = held if literals or patterns else None
        numbers = [m[min(1, m.re.groups)] or "" for p in self.captures for m in re.finditer(p, body)]
        return {**out, "numbers": numbers, "checks": self.checks}


def confirm(pairs: DataFrame, rules: list[Rule], code: str = "code", analyser: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds passed, reason, guards, captured, checks and hits to rows of a text and a class_id.

    A condition with nothing to look for does not exist; passed: all that exist hold. checks tells of each condition whether it
    holds, hits what was found. With `analyser`, a column of the external analyser's checks for the text, the rule's own checks
    among them are recorded as slither; they do not gate. Unknown classes get nulls; null text is empty.
    """
    columns = pairs.columns
    body = F.coalesce(F.col(code), F.lit(""))
    out = pairs.withColumns({"_body": body, "_lower": F.lower(body)})
    parts = parts_of(rules, most_bytes)
    for at, part in enumerate(parts):
        base = pairs.sparkSession.sparkContext.broadcast({r.id: Conditions(r) for r in reversed(part)})

        def seen(ids: list, bodies: list, lows: list, befores: list | None = None, base=base) -> list[dict | None]:
            cells = zip(ids, bodies, lows, befores or [None] * len(ids), strict=True)
            return [base.value[i].seen(body, low) if i in base.value else before for i, body, low, before in cells]

        out = out.withColumn("_seen", _computed(SEEN, seen, "class_id", "_body", "_lower", *(["_seen"] if at else [])))
        if at < len(parts) - 1:
            out = stored(out)
    known = F.col("_seen").isNotNull()
    call, lack, have = (F.col(f"_seen.{kind}") for kind, _ in _HITS)
    holds = {"must_call": F.size(call) > 0, "must_lack": F.size(lack) == 0, "must_have": F.size(have) > 0}
    exists = {"must_call": call.isNotNull(), "must_lack": lack.isNotNull(), "must_have": have.isNotNull()}
    passed = F.lit(True)
    for kind, h in holds.items():
        passed = passed & (~exists[kind] | h)
    # The texts of a verdict.
    said = F.concat_ws(
        "; ",
        F.when(exists["must_call"] & ~holds["must_call"], "no scenario call pattern found"),
        F.when(exists["must_lack"] & ~holds["must_lack"], F.concat(F.lit("guard present: "), F.array_join(F.slice(lack, 1, 4), ", "))),
        F.when(exists["must_have"] & ~holds["must_have"], "required feature not found"),
    )
    checks = [(kind, exists[kind], holds[kind]) for kind, _ in _HITS]
    hits = [(name, exists[kind], F.col(f"_seen.{kind}")) for kind, name in _HITS] + [("numbers", F.size("_seen.numbers") > 0, F.col("_seen.numbers"))]
    if analyser:
        told = F.filter("_seen.checks", lambda c: F.array_contains(F.coalesce(F.col(analyser), F.array().cast(_STRINGS)), c))
        asked = F.col(analyser).isNotNull() & (F.size("_seen.checks") > 0)
        checks.append(("slither", asked, F.size(told) > 0))
        hits.append(("slither_hits", asked, told))

    def mapped(entries: list[tuple[str, Column, Column]], kind: str) -> Column:
        cells = [F.when(there, F.struct(F.lit(name).alias("k"), value.alias("v")).cast(f"struct<k:string,v:{kind}>")) for name, there, value in entries]
        return F.map_from_entries(F.array_compact(F.array(*cells)))

    return out.select(
        *columns,
        F.when(known, passed).alias("passed"),
        F.when(known, F.when(passed, "all static conditions satisfied").otherwise(said)).alias("reason"),
        F.when(known, F.coalesce(lack, F.array().cast(_STRINGS))).alias("guards"),
        F.col("_seen.numbers").alias("captured"),
        F.when(known, mapped(checks, "boolean")).alias("checks"),
        F.when(known, mapped(hits, _STRINGS)).alias("hits"),
    )


def all_pairs(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    return texts.withColumn("class_id", F.explode(F.array(*[F.lit(r.id) for r in rules])))


def static_baseline(texts: DataFrame, rules: list[Rule], code: str = "code", **options) -> DataFrame:
    """Retrieval and confirmation without a model: detected where the conditions hold, confidence and score 1 or 0."""
    out = confirm(retrieve(texts, rules, code, **options).withColumnRenamed("score", "retrieval_score"), rules, code)
    out = out.drop("checks", "hits")
    sure = F.when(F.col("passed"), 1.0).otherwise(0.0)
    return out.withColumns({"detected": F.col("passed"), "confidence": sure, "score": sure})


def decide(findings: DataFrame, use_static: bool = True, require: bool = True, use_critic: bool = True, least: tuple[int, int] = (5, 3)) -> DataFrame:
    """Adds inconsistent, accepted, detected and score to findings with confidence, passed and the critic's reply.

    The reply: verdict, correctness, profitability and severity_score; missing numbers count as 0, 0 and 5. A reply is
    inconsistent if it confirms below or rejects at or above the least correctness and profitability. Without a critic,
    correctness and profitability are 10 and severity 5.
    """
    low_c, low_p = least
    if use_critic:
        right, gain, harm = (F.coalesce(F.col(c), F.lit(d)) for c, d in (("correctness", 0), ("profitability", 0), ("severity_score", 5)))
        enough = (right >= low_c) & (gain >= low_p)
        torn = F.coalesce(((F.col("verdict") == "confirmed") & ~enough) | ((F.col("verdict") == "rejected") & enough), F.lit(False))
        accepted = ~torn & enough
    else:
        right, gain, harm, torn, accepted = F.lit(10), F.lit(10), F.lit(5), F.lit(False), F.lit(True)
    confirmed = F.coalesce(F.col("passed"), F.lit(False))
    weight = F.when(confirmed, 1.0).otherwise(0.35) if use_static else F.lit(1.0)
    gate = confirmed if use_static and require else F.lit(True)
    score = F.round(F.coalesce("confidence", F.lit(0.0)) * (right + gain + harm) / 30 * weight, 4)
    return findings.withColumns({"inconsistent": torn, "accepted": accepted, "detected": accepted & gate, "score": score})


def best_reply(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Of the auditors' replies to one pair (attempt, confidence, property_match) the most confident that matches, the first on ties."""
    matching = replies.where("property_match")
    return matching.groupBy(*keys).agg(F.max_by(F.struct("attempt", "confidence"), F.struct("confidence", -F.col("attempt"))).alias("_best")).select(*keys, "_best.attempt", "_best.confidence")
