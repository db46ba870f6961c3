"""Tables between stages, and the small files around them: labels, rule bases, incidents, analyser output, outside benchmarks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Rule
from ..operators.tables import enclosing_span
from .config import dimension, read_yaml

LABELS = "ordinal bigint, protocol string, file_contains string, function string, class_id string, source string, note string"
ANALYSER = "results struct<detectors:array<struct<check:string,elements:array<struct<name:string>>>>>"


def load_table(spark: SparkSession, path: str, schema: str, stage: str) -> DataFrame:
    """A table that an earlier stage wrote as a JSON array (or lines, or a folder of them); an error that names the stage without it."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} is missing: run the stage {stage!r} first")
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def load_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, but no rows where the file is missing."""
    return load_table(spark, path, schema, "") if os.path.exists(path) else spark.createDataFrame([], schema)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth from a YAML list under `labels`, numbered in order; no rows without the file."""
    rows = read_yaml(path).get("labels") or []
    return dimension(spark, [{"ordinal": i, **r, "class_id": r.get("vuln_id"), "source": r.get("source", ""), "note": r.get("note", "")} for i, r in enumerate(rows)], LABELS)


def rule_base(rules_path: str, mitigations_path: str) -> tuple[list[Rule], dict[str, dict]]:
    """Rules and mitigations of two YAML files, with defaults. A rule that names an unknown mitigation is an error."""
    mitigations = {k: {"id": k, "actions": [], **m, "patch": (m.get("patch") or "").strip()} for k, m in read_yaml(mitigations_path).items()}
    rules = []
    for name, r in read_yaml(rules_path).items():
        checks = r.get("static_checks") or {}
        lists = {k: tuple(checks.get(k) or ()) for k in ("must_call", "must_call_patterns", "must_lack", "must_lack_patterns", "must_have", "must_have_patterns")}
        rules.append(
            Rule(
                name, r.get("severity", "medium"), r.get("layer", ""), r.get("mitigation", ""), tuple(r.get("applies_to") or ("all",)), **lists,
                captures=tuple(checks.get("capture_numbers") or ()), hints=(*(r.get("key_variables") or ()), *(r.get("retrieval_hints") or ())), checks=tuple(checks.get("slither") or ()),
                title=r["title"], category=r.get("report_category", ""), scenario=r["scenario"].strip(), property=r["property"].strip(), evidence=(r.get("evidence") or "").strip(),
                invariants=tuple(r.get("invariants") or ()),
            )
        )
    unknown = {r.mitigation for r in rules} - set(mitigations)
    if unknown:
        raise ValueError(f"rules name unknown mitigations: {sorted(unknown)}")
    return rules, mitigations


def incidents(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of incidents as it is."""
    return spark.read.option("multiLine", "true").json(path)


def analyser_elements(reports: DataFrame) -> DataFrame:
    """Elements of an analyser's reports (protocol, file, report: its JSON): protocol, file, function, check, one row for each
    element of each detector. Reports that are not JSON, and those without detectors, give none."""
    parsed = F.from_json("report", ANALYSER)
    found = reports.select("protocol", "file", F.explode(parsed["results"]["detectors"]).alias("d"))
    return found.select("protocol", "file", F.col("d.check").alias("check"), F.explode("d.elements").alias("e")).select("protocol", "file", F.coalesce("e.name", F.lit("")).alias("function"), F.coalesce("check", F.lit("")).alias("check"))


def import_benchmark(entries: DataFrame, spans: DataFrame, classes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Labels of an outside benchmark, and how many of its entries were left out and why.

    Entries: entry_id, file, category, lines (array). An entry becomes a label if its category has a class and one of its lines
    lies in a function of `spans` (file, start_line, end_line, function). Labels: entry_id, file, function, class_id.
    """
    mapping = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    known = entries.withColumn("class_id", F.try_element_at(mapping, F.col("category")))
    placed = enclosing_span(known.where("class_id is not null").select("entry_id", "file", "lines"), spans).withColumnRenamed("entry_id", "_id")
    judged = known.join(placed, F.col("entry_id") == F.col("_id"), "left").drop("_id")
    judged = judged.withColumn("dropped", F.when(F.col("class_id").isNull(), "no class").when(F.col("function").isNull(), "no function"))
    kept = judged.where("dropped is null").select("entry_id", "file", "function", "class_id")
    return kept, judged.where("dropped is not null").groupBy("dropped").agg(F.count(F.lit(1)).alias("entries"))


def fetch_quality(legs: DataFrame, series: DataFrame) -> DataFrame:
    """What became of each leg of a fetch (protocol, leg, series_id, error): failed, empty or ok, with its samples.

    A leg's failure does not touch the others; an empty series counts as missing, never as a series without events.
    """
    counts = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("samples"))
    joined = legs.join(counts, "series_id", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("samples") == 0, "empty").otherwise("ok")
    return joined.select("protocol", "leg", "series_id", "samples", status.alias("status"))
