"""The tables of a report, as DataFrames in reading order, and the lookups around a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fixed, path_contains
from .rules import Rule


def shown(x: Column, digits: int = 3) -> Column:
    """A number with so many digits, a dash where there is none."""
    return F.coalesce(fixed(x, digits), F.lit("—"))


def class_order(class_id: Column) -> Column:
    """Classes by their number: V2 before V10."""
    return F.substring(class_id, 2, 10).cast("int")


def classes(spark: SparkSession, rules: list[Rule], categories: dict[str, str] = {}) -> DataFrame:
    """Class, category as shown, layer, severity, mitigation and title, by the number of the class."""
    rows = [(r.id, categories.get(r.category, r.category), r.layer, r.severity, r.mitigation, r.title) for r in rules]
    return spark.createDataFrame(rows, "class_id string, category string, layer string, severity string, mitigation string, title string").orderBy(class_order(F.col("class_id")))


def corpus(slices: DataFrame, protocols: DataFrame) -> DataFrame:
    """Slices of each protocol with its mechanism, role, family and date of incident, largest first; dashes for unknown protocols.

    Slices: protocol, tier. Protocols: name, display, algorithmic, family, incident_date. Ties by the protocol's name.
    """
    counts = slices.groupBy("protocol").agg(F.count(F.lit(1)).alias("slices"), F.max("tier").alias("role"))
    meta = protocols.select(F.col("name").alias("_name"), "display", "algorithmic", "family", "incident_date")
    joined = counts.join(meta, F.col("protocol") == F.col("_name"), "left")
    known = lambda c: F.coalesce(F.col(c), F.lit("—")).alias(c)
    return joined.orderBy(F.desc("slices"), "protocol").select(F.coalesce("display", "protocol").alias("protocol"), known("algorithmic"), "role", known("family"), known("incident_date"), "slices")


def overall(evaluation: DataFrame, ranked: DataFrame | None = None, interval: DataFrame | None = None, level: float = 0.95) -> DataFrame:
    """Metric and value of one evaluation (a row of evaluate.overall(), and of ranked() and bootstrap_f1()), in order of `place`."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    cells = [
        ("True positives", whole("tp")), ("False positives", whole("fp")), ("False negatives", whole("fn")), ("True negatives", whole("tn")),
        ("Precision", shown(F.col("precision"))), ("Recall", shown(F.col("recall"))), ("F1", shown(F.col("f1"))), ("Effective F1", shown(F.col("effective_f1"))),
        ("Accuracy", shown(F.col("accuracy"))), ("Output coverage", shown(F.col("coverage"))), ("Unparseable outputs", whole("parse_failures")),
        ("Labels retrieved", F.concat(whole("labels_matched"), F.lit("/"), whole("labels"))), ("Labels never retrieved", whole("labels_unretrieved")), ("Findings scored", whole("findings")),
    ]
    table, rows = evaluation, [*cells]
    if interval is not None:
        table = table.join(interval.select("lo", "hi", "iterations"))  # one row each
        rows.append((f"F1 {level:.0%} interval", F.concat(F.lit("["), shown(F.col("lo")), F.lit(", "), shown(F.col("hi")), F.lit("]"))))
    if ranked is not None:
        table = table.join(ranked.select("top_1", "top_3", "top_5", "mrr"))
        rows += [(c.replace("_", "-").upper(), shown(F.col(c))) for c in ("top_1", "top_3", "top_5", "mrr")]
    cell = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("metric"), value.alias("value")) for i, (name, value) in enumerate(rows, 1)])
    return table.select(F.inline(cell)).orderBy("place")


#: Layers in the order of the report, with their names.
LAYERS = {"pure": "Purely algorithmic", "partial": "Partially algorithmic", "study_combined": "Study set (pure + partial)", "control": "Controls"}


def layers(evaluations: DataFrame, members: DataFrame) -> DataFrame:
    """Layer, protocols, labels, precision, recall, f1 and fp in the report's order. Controls have no labels, so only their
    false positives mean something. Members: layer, protocol."""
    n = members.groupBy("layer").agg(F.countDistinct("protocol").alias("protocols"))
    control = F.col("layer") == "control"
    scores = [F.when(control, "—").otherwise(shown(F.col(c))).alias(c) for c in ("precision", "recall", "f1")]
    place = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv]), F.col("layer"))
    out = evaluations.join(n, "layer", "left").where(place > 0).orderBy(place)
    return out.select(name.alias("layer"), F.coalesce("protocols", F.lit(0)).alias("protocols"), "labels", *scores, "fp")


def runs(compared: DataFrame, control_fp: DataFrame) -> DataFrame:
    """Runs side by side (evaluate.compare_runs()) with their false positives on controls (evaluate.control_false_positives())."""
    return compared.join(control_fp, "run", "left").withColumn("control_fp", F.when(F.col("error").isNull(), F.coalesce("control_fp", F.lit(0))))


def sensitivity(swept: DataFrame) -> DataFrame:
    """A sweep as shown, thresholds from high to low: series_id, threshold, events, minutes, min_value."""
    cell = F.concat(F.lit("$"), "threshold").alias("threshold")
    return swept.orderBy("series_id", F.desc(F.col("threshold").cast("double"))).select("series_id", cell, "events", "minutes", shown(F.col("min_value"), 4).alias("min_value"))


def lead(pooled: DataFrame, alerts: DataFrame, lookback_minutes: int = 2_880) -> DataFrame:
    """Place, metric and value of the early warnings: alerts, episodes, those warned of, their share and the median lead."""
    # One row each, put beside each other without a join.
    both = pooled.unionByName(alerts.agg(F.count(F.lit(1)).alias("alerts")), allowMissingColumns=True)
    table = both.agg(*[F.max(c).alias(c) for c in ("alerts", "total", "detected", "median_lead")])
    # The argument of a Python function is computed before the condition around it.
    share = F.when(F.col("total") > 0, F.concat(fixed(F.try_divide(100 * F.col("detected"), F.col("total")), 1), F.lit("%"))).otherwise("—")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    cells = [("Alerts raised", text("alerts")), ("Episodes", text("total")), ("Episodes preceded by an alert", text("detected")), ("Episodes warned", share), ("Median lead (minutes)", text("median_lead")), ("Look-back (minutes)", F.lit(str(lookback_minutes)))]
    return table.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("metric"), v.alias("value")) for i, (n, v) in enumerate(cells, 1)])))


def first_alerts(alerts: DataFrame, most: int = 40) -> DataFrame:
    """The first alerts by time, as a chart marks them."""
    return alerts.orderBy("ts", "series_id", "state").limit(most)


def confirm_rate(confirmed: DataFrame, by: str = "language") -> DataFrame:
    """Share of (text, class) pairs whose conditions hold, for each language, to four digits."""
    return confirmed.groupBy(by).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("rate"))


def in_scope(slices: DataFrame, protocols: list[str] | None = None) -> DataFrame:
    """Slices of the named protocols; without names all but those of benchmarks."""
    return slices.where(F.col("protocol").isin(protocols)) if protocols else slices.where(F.coalesce("tier", F.lit("")) != "benchmark")


def labelled(slices: DataFrame, labels: DataFrame) -> DataFrame:
    """Slices (protocol, file, function) that a label names, once each, with the least ordinal of its labels."""
    named = labels.select(F.col("protocol").alias("_p"), F.col("function").alias("_f"), "file_contains", "ordinal")
    on = (F.col("protocol") == F.col("_p")) & (F.col("function") == F.col("_f")) & path_contains(F.col("file"), F.col("file_contains"))
    return slices.join(named, on).groupBy(*slices.columns).agg(F.min("ordinal").alias("ordinal"))


def pick(slices: DataFrame, labels: DataFrame, function: str | None = None, protocol: str | None = None, id: str | None = None) -> DataFrame:
    """One slice: that of an id, else the first of a function or protocol, else the first that a label names, else the first.

    First is by the label's ordinal, then protocol, file and start_line. No row if nothing fits.
    """
    order = ("protocol", "file", "start_line", "id")
    if id:
        return slices.where(F.col("id") == id).orderBy(*order).limit(1)
    if function or protocol:
        for column, value in (("protocol", protocol), ("function", function)):
            slices = slices.where(F.col(column) == value) if value else slices
        return slices.orderBy(*order).limit(1)
    best = labelled(slices, labels).orderBy("ordinal", *order).limit(1).withColumn("_k", F.lit(0)).drop("ordinal")
    return best.unionByName(slices.orderBy(*order).limit(1).withColumn("_k", F.lit(1))).orderBy("_k").limit(1).drop("_k")


def by_size(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Groups by falling size, equal ones in the order of their first row: key, size, place."""
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min(ordinal).alias("_first"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("size"), "_first"))).drop("_first")
