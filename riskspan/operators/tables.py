"""Joins and tables around findings: spans, analyser hits, exemplars, recommendations, shares and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import show_score
from .rules import Rule


def enclosing_span(entries: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """The function that encloses an entry's first listed line that lies in any: entry_id, function (null if no line does).

    Entries: entry_id, file, lines (array). Spans: file, start_line, end_line, function; of several around a line, the first by
    start, end and name counts. A range join by blocks of `width` lines: a span stands in every block it touches, so the join
    is on (file, block) and a long file spreads over its blocks.
    """
    asked = entries.select("entry_id", "file", F.posexplode("lines").alias("at", "line")).withColumn("_b", F.floor(F.col("line") / width))
    blocks = F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))
    cut = spans.where("start_line <= end_line").select(F.col("file").alias("_file"), "start_line", "end_line", F.col("function").alias("_function"), F.explode(blocks).alias("_block"))
    hit = asked.join(cut, (F.col("file") == F.col("_file")) & (F.col("_b") == F.col("_block")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    first = hit.groupBy("entry_id").agg(F.min(F.struct("at", "start_line", "end_line", "_function")).alias("_first")).select(F.col("entry_id").alias("_id"), F.col("_first._function").alias("function"))
    return entries.join(first, F.col("entry_id") == F.col("_id"), "left").select("entry_id", "function")


def analyser_hits(elements: DataFrame, slices: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Classes that an external analyser's checks name per slice: id, classes, checks. Elements (protocol, file, function, check)
    go to every slice of that name; checks without a class count as checks only."""
    mapping = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    named = elements.select("protocol", "file", "function", "check", F.try_element_at(mapping, F.col("check")).alias("_class"))
    joined = slices.select("id", "protocol", "file", "function").join(named, ["protocol", "file", "function"])
    return joined.groupBy("id").agg(F.array_sort(F.collect_set("_class")).alias("classes"), F.array_sort(F.collect_set("check")).alias("checks"))


def analyser_baseline(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """Pairs (id, class_id) are detected where the analyser named their class."""
    found = hits.select(F.col("id").alias("_id"), "classes")
    joined = pairs.join(found, F.col("id") == F.col("_id"), "left")
    return joined.select(*pairs.columns, F.coalesce(F.array_contains("classes", F.col("class_id")), F.lit(False)).alias("detected"))


def exemplars(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """One exemplar of each kind for every target (protocol, class_id), never of the target's own protocol: same class first,
    by protocol and signature, else another class by class, protocol and signature.

    Only a class's first exemplar and its first of a second protocol can ever be chosen. These are at most two per kind and
    class, whatever the size of the pool, and are kept as one array per kind.
    """
    own = ["kind", "class_id"]
    entry = F.struct("protocol", "signature")
    first = pool.groupBy(*own).agg(F.min(entry).alias("one"))
    others = pool.join(first, own).where(F.col("protocol") != F.col("one.protocol")).groupBy(*own).agg(F.min(entry).alias("two"))
    best = first.join(others, own, "left").select("kind", "class_id", F.explode(F.array_compact(F.array("one", "two"))).alias("e"))
    kinds = best.groupBy("kind").agg(F.collect_list(F.struct("class_id", F.col("e.protocol").alias("protocol"), F.col("e.signature").alias("signature"))).alias("all"))
    asked = targets.select(F.col("protocol").alias("target_protocol"), F.col("class_id").alias("target_class"), F.explode(F.array(F.lit("positive"), F.lit("negative"))).alias("kind"))
    usable = F.filter("all", lambda e: e["protocol"] != F.col("target_protocol"))
    keyed = F.transform(usable, lambda e: F.struct((e["class_id"] != F.col("target_class")).alias("other"), e["class_id"].alias("class_id"), e["protocol"].alias("protocol"), e["signature"].alias("signature")))
    out = asked.join(kinds, "kind").withColumn("e", F.array_min(keyed)).where(F.col("e").isNotNull())
    return out.select("target_protocol", "target_class", "kind", F.col("e.class_id").alias("class_id"), F.col("e.protocol").alias("protocol"), F.col("e.signature").alias("signature"))


def first_negatives(slices: DataFrame, labelled: DataFrame, controls: DataFrame, min_chars: int = 120) -> DataFrame:
    """For every class its first control slice, by protocol, file and start_line, that fails the class's conditions.

    Slices: with class_id (the best retrieved one), passed and n_chars. Functions that a label names are left out.
    """
    free = slices.join(controls.select("protocol"), "protocol", "left_semi").join(labelled.select("protocol", "function").distinct(), ["protocol", "function"], "left_anti")
    fit = free.where(~F.col("passed") & (F.col("n_chars") >= min_chars))
    first = fit.groupBy("class_id").agg(F.min(F.struct("protocol", "file", "start_line", "signature")).alias("f"))
    return first.select("class_id", "f.protocol", "f.signature", F.lit("negative").alias("kind"))


def recommendations(findings: DataFrame, classes: DataFrame, most: int = 25) -> DataFrame:
    """Detected findings with their class's mitigation, the best `most` sites of each class, and the class's number of sites.

    Classes without a known mitigation are dropped.
    """
    sites = findings.where("detected").join(classes.select("class_id", "severity", "mitigation"), "class_id").where(F.col("mitigation").isNotNull())
    counts = sites.groupBy("class_id").agg(F.count(F.lit(1)).alias("sites"))
    best = Window.partitionBy("class_id").orderBy(F.desc("score"), "ordinal")
    top = sites.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    return top.join(counts, "class_id").select("class_id", "severity", "mitigation", "place", "protocol", "function", "score", "sites")


def applicability(rules: list[Rule], protocols: DataFrame, families: list[str]) -> DataFrame:
    """For every class the number of protocols in each family it applies to, 0 in the others; "all" stands for every family."""
    counted = protocols.agg(*[F.count_if(F.col("family") == f).alias(f) for f in families])
    rows = [F.struct(F.lit(r.id).alias("class_id"), *[(F.col(f) if {f, "all"} & set(r.applies_to) else F.lit(0).cast("bigint")).alias(f) for f in families]) for r in rules]
    return counted.select(F.inline(F.array(*rows)))


def shares(slices: DataFrame, by: str) -> DataFrame:
    """Slices, lines and tokens per group, and the group's share of all slices to four digits."""
    sums = slices.groupBy(by).agg(F.count(F.lit(1)).alias("slices"), F.sum("n_lines").alias("lines"), F.sum("tokens").alias("tokens"))
    return sums.withColumn("share", F.round(F.col("slices") / F.sum("slices").over(Window.partitionBy(F.lit(1))), 4))


def class_table(scores: DataFrame, classes: DataFrame) -> DataFrame:
    """The report's table of classes in numeric order with scores as shown."""
    shown = [show_score(F.col(c)).alias(c) for c in ("precision", "recall", "f1")]
    out = classes.join(scores, "class_id", "left").fillna(0)
    number = F.substring("class_id", 2, 10).cast("int")
    return out.orderBy(number).select("class_id", "severity", "layer", "tp", "fp", "fn", *shown)


def in_run_order(name: Column, canonical: list[str]) -> list[Column]:
    """Sort columns: the canonical runs in their order, then the others by name."""
    place = F.array_position(F.array(*map(F.lit, canonical)), name)
    return [F.when(place == 0, len(canonical) + 1).otherwise(place), name]


def skipped(protocols: DataFrame) -> DataFrame:
    """Why a protocol's series is not scored: its peg, no series or an empty one; null if it is scored."""
    reason = F.when(F.coalesce("peg_target", F.lit("")) != "usd", "peg is not the dollar").when(F.col("samples").isNull(), "no series").when(F.col("samples") == 0, "empty series")
    return protocols.withColumn("reason", reason)


def uncached(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts whose key the response cache (key, reply) does not hold, one row per key."""
    return prompts.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
