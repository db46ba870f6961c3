"""Findings against labels: cells, per-class and ranked metrics, coverage, bootstrap.

Findings: protocol, file, contract, function, class_id, detected, score, ordinal (order in the run), parse_failed, inconsistent.
Labels: label_id, protocol, file_contains, function, class_id. Both may carry group columns (`by`: a run, a layer); each group is
then judged on its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import bits_of
from ..functions.text import path_contains
from .ordered import stored
from .selection import at_rank

KEY = ["protocol", "file", "function", "class_id"]
TEXT = ["protocol", "file", "contract", "function"]


def match_labels(findings: DataFrame, labels: DataFrame, by: list[str] = []) -> DataFrame:
    """Labels with the file of their first finding, and retrieved: whether there is one.

    A label fits findings of its protocol, function and class whose path holds file_contains.
    """
    same = [*by, "protocol", "function", "class_id"]
    right = findings.select(*[F.col(c).alias(f"_{c}") for c in same], F.col("file").alias("_file"), F.col("ordinal").alias("_ordinal"))
    on = path_contains(F.col("_file"), F.col("file_contains"))
    for c in same:
        on = on & (F.col(c) == F.col(f"_{c}"))
    joined = labels.join(right, on, "left")
    first = F.min_by("_file", "_ordinal").alias("file")
    return joined.groupBy(*by, "label_id", "protocol", "file_contains", "function", "class_id").agg(first, F.count("_file").alias("_hits")).withColumn("retrieved", F.col("_hits") > 0).drop("_hits")


def truth_keys(matched: DataFrame, by: list[str] = []) -> DataFrame:
    """Keys that count as true. A label without a finding keeps a key of its own, so that it counts as missed."""
    return matched.select(*by, "protocol", F.coalesce("file", "file_contains").alias("file"), "function", "class_id").distinct()


def key_cells(findings: DataFrame, truth: DataFrame, by: list[str] = []) -> DataFrame:
    """One row per key with predicted, considered and true. A union and one aggregate in place of a full outer join."""
    seen = findings.select(*by, *KEY, F.coalesce("detected", F.lit(False)).alias("predicted"), F.lit(True).alias("considered"), F.lit(False).alias("true"))
    told = truth.select(*by, *KEY, F.lit(False).alias("predicted"), F.lit(False).alias("considered"), F.lit(True).alias("true"))
    return seen.unionByName(told).groupBy(*by, *KEY).agg(*[F.max(c).alias(c) for c in ("predicted", "considered", "true")])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_prf(cells: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 of tp, fp and fn, to four digits; 0 where undefined."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return cells.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(_ratio(2 * p * r, p + r), 4)})


def _counts() -> list[Column]:
    p, c, t = F.col("predicted"), F.col("considered"), F.col("true")
    return [F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(c & ~p & ~t).alias("tn")]


def overall(findings: DataFrame, labels: DataFrame, by: list[str] = []) -> DataFrame:
    """Cells, P/R/F1 and accuracy over distinct keys; coverage and effective F1 over rows; label counts.

    One row per group of `by` that has findings or labels; without `by`, one row even for empty tables.
    """
    matched = match_labels(findings, labels, by)
    cells = key_cells(findings, truth_keys(matched, by), by).groupBy(*by).agg(*_counts(), F.count_if("considered").alias("considered"))
    rows = findings.groupBy(*by).agg(F.count(F.lit(1)).alias("findings"), F.count_if("parse_failed").alias("parse_failures"), F.count_if("inconsistent").alias("contradictions"))
    kept = matched.groupBy(*by).agg(F.count(F.lit(1)).alias("labels"), F.count_if("retrieved").alias("labels_matched"), (F.count(F.lit(1)) - F.count_distinct(F.struct("protocol", "file_contains", "function", "class_id"))).alias("labels_duplicated"))
    if by:
        out = cells.join(rows, by, "left").join(kept, by, "left")
    else:
        one = F.lit(1).alias("_one")
        out = cells.select("*", one).join(rows.select("*", one), "_one").join(kept.select("*", one), "_one").drop("_one")
    out = with_prf(out.fillna(0))
    n = F.col("findings")
    unretrieved = F.col("labels") - F.col("labels_matched")
    coverage = F.when(n > 0, 1 - (F.col("parse_failures") + F.col("contradictions")) / n).otherwise(0.0)
    return out.select(
        *by, "tp", "fp", "fn", "tn", "precision", "recall", "f1",
        F.round(_ratio(F.col("tp") + F.col("tn"), F.col("considered") + unretrieved), 4).alias("accuracy"),
        "findings", "parse_failures", "contradictions", F.round(coverage, 4).alias("coverage"), F.round(F.col("f1") * coverage, 4).alias("effective_f1"),
        "labels", "labels_matched", "labels_duplicated", unretrieved.alias("labels_unretrieved"),
    )


def per_class(findings: DataFrame, labels: DataFrame, by: list[str] = []) -> DataFrame:
    """P/R/F1 of every class that findings or labels name."""
    cells = key_cells(findings, truth_keys(match_labels(findings, labels, by), by), by).groupBy(*by, "class_id").agg(*_counts())
    return with_prf(cells.drop("tn"))


def with_truth(findings: DataFrame, truth: DataFrame, by: list[str] = []) -> DataFrame:
    marks = truth.select(*[F.col(c).alias(f"_{c}") for c in (*by, *KEY)], F.lit(True).alias("_true"))
    on = F.lit(True)
    for c in (*by, *KEY):
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return findings.join(marks, on, "left").withColumn("is_true", F.coalesce("_true", F.lit(False))).select(*findings.columns, "is_true")


def ranked(findings: DataFrame, labels: DataFrame, by: list[str] = []) -> DataFrame:
    """top_1, top_3, top_5 and mrr over contracts with a true finding: where the first true one stands by falling score.

    The place is one more than the number of findings ahead of the best true one, so no contract is sorted as a whole.
    """
    marked = with_truth(findings, truth_keys(match_labels(findings, labels, by), by), by)
    unit = [*by, "protocol", "file", "contract"]
    marked = marked.withColumn("_at", F.struct((-F.col("score")).alias("s"), F.col("ordinal").alias("o")))
    best = marked.where("is_true").groupBy(*unit).agg(F.min("_at").alias("_best")).select(*[F.col(c).alias(f"_{c}") for c in unit], "_best")
    on = F.lit(True)
    for c in unit:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = marked.join(best, on).groupBy(*unit).agg((F.count_if(F.col("_at") < F.col("_best")) + 1).alias("place"))
    top = [F.coalesce(F.round(F.avg((F.col("place") <= k).cast("int")), 4), F.lit(0.0)).alias(f"top_{k}") for k in (1, 3, 5)]
    return place.groupBy(*by).agg(*top, F.coalesce(F.round(F.avg(1 / F.col("place")), 4), F.lit(0.0)).alias("mrr"), F.count(F.lit(1)).alias("units"))


def layers_of(tier: Column, algorithmic: Column) -> Column:
    """Layers of a protocol: control, or its algorithmic kind; and study_combined if it is studied."""
    own = F.when(tier == "control", "control").otherwise(F.coalesce(algorithmic, F.lit("none")))
    return F.array_compact(F.array(own, F.when(tier == "study", "study_combined")))


def by_layer(findings: DataFrame, labels: DataFrame, protocols: DataFrame, layers: tuple[str, ...] = ("pure", "partial", "control", "study_combined")) -> DataFrame:
    """The evaluation of each layer. Layers overlap, so rows are repeated for each layer of their protocol."""
    layer = protocols.select("protocol", F.explode(layers_of(F.col("tier"), F.col("algorithmic"))).alias("layer")).where(F.col("layer").isin(*layers))
    return overall(findings.join(layer, "protocol"), labels.join(layer, "protocol"), ["layer"])


def compare_runs(runs: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """Evaluation of each named run (column run of the findings) with error "not run" where it has no findings."""
    each = F.explode(F.array(*map(F.lit, names)))
    asked = runs.sparkSession.range(1).select(each.alias("run"))
    found = overall(runs.where(F.col("run").isin(*names)), labels.withColumn("run", each), ["run"]).where("findings > 0")
    return asked.join(found, "run", "left").withColumn("error", F.when(F.col("findings").isNull(), "not run"))


def control_false_positives(findings: DataFrame, labels: DataFrame, protocols: DataFrame, by: list[str] = []) -> DataFrame:
    """Detected findings on control protocols that no label covers, counted per group."""
    controls = protocols.where(F.col("tier") == "control").select("protocol")
    named = labels.select(*by, "protocol", "function", "class_id").distinct()
    wrong = findings.where("detected").join(controls, "protocol", "left_semi").join(named, [*by, "protocol", "function", "class_id"], "left_anti")
    return wrong.groupBy(*by).agg(F.count(F.lit(1)).alias("control_fp"))


#: Draws that one call makes.
DRAWS = 1 << 20


def bootstrap_f1(findings: DataFrame, labels: DataFrame, iterations: int = 2_000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """F1 with a percentile interval: f1, lo, hi, n, iterations.

    Units are the rows of findings and one missed unit per label without a finding. Draw j of iteration i takes the unit that a
    hash of (seed, i, j) names, units lying in the order true and false positives, false and true negatives; so anyone can draw
    the same resamples. An iteration's draws are counted in blocks, and the interval's ends are selected by rank.
    """
    matched = match_labels(findings, labels)
    marked = with_truth(findings, truth_keys(matched))
    d, t = F.coalesce("detected", F.lit(False)), F.col("is_true")
    got = marked.agg(F.count_if(d & t).alias("tp"), F.count_if(d & ~t).alias("fp"), F.count_if(~d & t).alias("fn"), F.count_if(~d & ~t).alias("tn")).first()
    missed = matched.where("NOT retrieved").count()
    upto = np.cumsum([got.tp, got.fp, got.fn + missed, got.tn])
    n, spark = int(upto[-1]), findings.sparkSession
    if n == 0:
        return spark.createDataFrame([(0.0, 0.0, 0.0, 0, iterations)], "f1 double, lo double, hi double, n bigint, iterations int")

    def draw(batches):
        for b in batches:
            rows = []
            for i, block in zip(b["i"], b["block"], strict=True):
                j = np.arange(block * DRAWS, min(n, (block + 1) * DRAWS))
                unit = (bits_of(seed, int(i), j) * np.uint64(n)) >> np.uint64(32)
                rows.append((i, *np.bincount(np.searchsorted(upto, unit.astype(np.int64), "right"), minlength=4)[:3].tolist()))
            yield pd.DataFrame(rows, columns=["i", "tp", "fp", "fn"])

    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((n - 1) // DRAWS).cast("bigint"))).alias("block")
    drawn = spark.range(iterations).select(F.col("id").alias("i"), blocks).repartition("i", "block").mapInPandas(draw, "i bigint, tp bigint, fp bigint, fn bigint")
    totals = drawn.groupBy("i").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    scores = stored(totals.select(F.lit(0).alias("g"), F.round(_f1("tp", "fp", "fn") * 10_000).cast("bigint").alias("s")))
    tail = (1 - level) / 2
    ends = [at_rank(scores, ["g"], "s", lambda _, q=q: F.lit(min(iterations - 1, int(q * iterations))), name).select("g", (F.col(name) / 10_000).alias(name)) for q, name in ((tail, "lo"), (1 - tail, "hi"))]
    point = spark.createDataFrame([(0, int(upto[0]), int(upto[1] - upto[0]), int(upto[2] - upto[1]), n, iterations)], "g int, tp bigint, fp bigint, fn bigint, n bigint, iterations int")
    return point.join(ends[0], "g").join(ends[1], "g").select(F.round(_f1("tp", "fp", "fn"), 4).alias("f1"), "lo", "hi", "n", "iterations")


def _f1(tp: str, fp: str, fn: str) -> Column:
    """2 p r / (p + r) is 2 tp / (2 tp + fp + fn); 0 without true positives."""
    return F.coalesce(F.try_divide(2.0 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn)), F.lit(0.0))


def run_summary(findings: DataFrame, by: list[str] = []) -> DataFrame:
    """Totals of a run: distinct texts with a pair, pairs, detected, by_class (class and number of its detected, by class), parse failures,
    provider errors (of findings that have provider_error, empty where there is none) and contradictions.

    Classes are counted first and texts beside them. A union and one aggregate put them together, for null groups too.
    """
    failed = F.count_if(F.col("provider_error") != "") if "provider_error" in findings.columns else F.count_if(F.lit(False))
    counts = {"pairs": F.count(F.lit(1)), "detected": F.count_if("detected"), "parse_failures": F.count_if("parse_failed"), "provider_errors": failed, "contradictions": F.count_if("inconsistent")}
    classes = findings.groupBy(*by, "class_id").agg(*[x.alias(c) for c, x in counts.items()])
    texts = findings.select(*by, *TEXT).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("texts"))
    both = classes.unionByName(texts, allowMissingColumns=True)
    each = F.sort_array(F.collect_list(F.when(F.col("detected") > 0, F.struct("class_id", "detected")))).alias("by_class")
    total = {c: F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("texts", *counts)}
    return both.groupBy(*by).agg(total["texts"], total["pairs"], total["detected"], each, *[total[c] for c in ("parse_failures", "provider_errors", "contradictions")])
