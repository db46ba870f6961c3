"""Queries of sources, sinks, reports, prompts, the pair analysis and the streams, with their SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import keyed_store, model, reports, slicing, tables
from ..operators import prompts as P
from ..operators import rules as R
from ..operators import series as S
from ..operators.ordered import ranked
from ..session import scratch
from ..sinks import writers
from ..sources import config, files
from ..sources import series as src
from ..sources import tables as src_tables
from ..streaming import series as live
from ..streaming import warnings as warn
from . import code_queries as C
from . import series_queries as Q

CATEGORIES = {"web": "R1", "tor": "R3"}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C._docs(spark, sf_dir)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return C._read(spark, sf_dir, name)


# Sources.
def file_measures(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.encode("text", "utf-8").alias("content"))
    out = files.measured(docs)
    return out.select("doc_id", "sha256", "n_lines", "n_bytes", F.length("text").cast("bigint").alias("n_chars"))


def file_scan(spark, sf_dir):
    """A tree of files written from the documents, scanned with a glob, excluded folders and a size limit."""
    root = scratch(spark)
    docs = _docs(spark, sf_dir).where("text is not null and doc_id is not null")
    named = docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("\n"), F.regexp_replace("text", "[\r\n]", " ")).alias("value"), (F.col("doc_id") % 5).alias("d"), (F.col("doc_id") % 3).alias("k"))
    # Every task writes its own files: their number grows with the table, their size does not.
    named.where("d < 4").write.partitionBy("d", "k").text(root)
    found = files.scan(spark, root, ["d=*/k=*/*.txt"], (".txt",), exclude_dirs=["/d=3/"], max_bytes=1 << 30)
    lines = files.measured(found).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.col("line").rlike("^f[0-9]+$")).select(F.substring("line", 2, 20).cast("bigint").alias("doc_id"))


def analyser_report(spark, sf_dir):
    element = F.struct(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"))
    detectors = F.array(F.struct(F.col("lang").alias("check"), F.array(element, F.struct(F.col("source").alias("name"))).alias("elements")), F.struct(F.lit("none").alias("check"), F.array().cast("array<struct<name:string>>").alias("elements")))
    body = F.to_json(F.struct(F.struct(detectors.alias("detectors")).alias("results")))
    reports_ = _read(spark, sf_dir, "documents").select(F.col("source").alias("protocol"), F.col("doc_id").cast("string").alias("file"), F.when(F.col("doc_id") % 7 == 0, "not json {").otherwise(body).alias("report"))
    return src_tables.analyser_elements(reports_)


def _benchmark(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    spans = docs.select(F.col("protocol").alias("file"), F.col("doc_id").alias("start_line"), (F.col("doc_id") + 2).alias("end_line"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("function"))
    kind = F.element_at(F.array(*map(F.lit, ("web", "tor", "other"))), (F.col("doc_id") % 3 + 1).cast("int"))
    entries = docs.where("protocol is not null").select(F.col("doc_id").alias("entry_id"), F.col("protocol").alias("file"), kind.alias("category"), F.array(-F.col("doc_id") - 1, F.col("doc_id") + F.when(F.col("doc_id") % 4 == 0, 2).otherwise(-100_000_000)).alias("lines"))
    return src_tables.import_benchmark(entries, spans, CATEGORIES)


def benchmark_labels(spark, sf_dir):
    return _benchmark(spark, sf_dir)[0]


def benchmark_dropped(spark, sf_dir):
    return _benchmark(spark, sf_dir)[1]


def fetch_quality(spark, sf_dir):
    series = Q._series(spark, sf_dir)
    legs = [("a", "prices", "click", None), ("a", "supply", "nowhere", None), ("b", "prices", "purchase", "HTTP 500"), ("c", "prices", None, None)]
    return src_tables.fetch_quality(spark.createDataFrame(legs, "protocol string, leg string, series_id string, error string"), series)


def series_csv(spark, sf_dir):
    """Events written as a CSV series and read back."""
    path = scratch(spark)
    src.write_csv(src.dedup(Q._series(spark, sf_dir).withColumn("series_id", F.lit("all"))), path)
    return src.dedup(src.read_csv(spark, path, "all"))


def price_json(spark, sf_dir):
    """Part prices as price documents of a hundred parts at most and of two coins each, of which the first counts."""
    point = F.struct(F.col("p_partkey").cast("bigint").alias("timestamp"), F.col("p_retailprice").cast("double").alias("price"))
    pages = _read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.collect_list(point).alias("ps"))
    coins = F.create_map(F.lit("one"), F.struct(F.col("ps").alias("prices")), F.lit("two"), F.struct(F.slice("ps", 1, 2).alias("prices")))
    return src.parse_prices(pages.select(F.to_json(F.struct(coins.alias("coins"))).alias("value")), "part")


def supply_json(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("date"), F.struct(F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal").cast("double")).alias("peggedUSD")).alias("totalCirculating"))).alias("value"))
    return src.parse_supply(rows, "bal")


def finest_series(spark, sf_dir):
    series = Q._series(spark, sf_dir)
    hourly = series.withColumn("ts", F.floor(F.col("ts") / 3600) * 3600).groupBy("series_id", "ts").agg(F.min("value").alias("value")).withColumn("resolution", F.lit("1h"))
    fine = series.where("series_id in ('click', 'view')").withColumn("resolution", F.lit("1m"))
    return src.prefer_finest(hourly.unionByName(fine)).groupBy("series_id", "resolution").agg(F.count(F.lit(1)).alias("samples"))


def _dimension(spark, sf_dir):
    base = C._protocols(spark, sf_dir).withColumnRenamed("protocol", "name")
    number = F.substring("name", 4, 10).cast("int")
    market = F.when(number % 2 == 0, F.struct(F.when(number % 6 == 0, "eur").otherwise("USD").alias("peg_target"), F.col("name").alias("binance_symbol")))
    return base.withColumn("market", market)


def protocol_filter(spark, sf_dir):
    found = config.chosen(_dimension(spark, sf_dir), "primary", ["none", "pure"])
    return found.select("name", "tier", F.coalesce("algorithmic", F.lit("none")).alias("algorithmic"))


def market_protocols(spark, sf_dir):
    return config.with_market(_dimension(spark, sf_dir), depeggable_only=True).select("name", "market.binance_symbol")


def unavailable_protocols(spark, sf_dir):
    asked = spark.createDataFrame([("src1",), ("src2",), ("nosuch",), ("nosuch",)], "name string")
    return config.unavailable(asked, _dimension(spark, sf_dir).where("tier = 'study'"))


def skip_reasons(spark, sf_dir):
    counts = _docs(spark, sf_dir).groupBy(F.col("protocol").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    specs = _dimension(spark, sf_dir).join(counts, "name").select("name", F.lower("market.peg_target").alias("peg_target"), F.when(F.col("n") % 3 > 0, F.col("n") % 2).alias("samples"))
    return tables.skipped(specs).select("name", "reason")


# Scopes and lookups.
def benchmark_scope(spark, sf_dir):
    slices = _docs(spark, sf_dir).withColumn("tier", F.when(F.col("contract") == "en", "benchmark").otherwise("study"))
    return reports.in_scope(slices).select("doc_id")


def labelled_slices(spark, sf_dir):
    doc = F.col("doc_id").cast("string")
    slices = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "protocol", F.concat_ws("/", "contract", doc, F.lit("text")).alias("file"), F.concat(F.lit("f"), doc).alias("function"), F.col("doc_id").alias("start_line"))
    labels = C._labels(spark, sf_dir).withColumn("ordinal", F.regexp_extract("label_id", "^[0-9]+", 0).cast("bigint") % 1000)
    return reports.labelled(slices, labels).select("id", "function", "ordinal")


def picked_slice(spark, sf_dir):
    doc = F.col("doc_id").cast("string")
    slices = _docs(spark, sf_dir).select(doc.alias("id"), "protocol", F.concat_ws("/", "contract", doc, F.lit("text")).alias("file"), F.concat(F.lit("f"), doc).alias("function"), F.col("doc_id").alias("start_line"))
    labels = C._labels(spark, sf_dir).withColumn("ordinal", -F.regexp_extract("label_id", "^[0-9]+", 0).cast("bigint"))
    return reports.pick(slices, labels).select("id")


def confirm_rate(spark, sf_dir):
    out = R.confirm(R.all_pairs(_docs(spark, sf_dir), C.RULES), C.RULES, "text")
    return reports.confirm_rate(out.withColumnRenamed("contract", "language"))


def analyser_record(spark, sf_dir):
    """Confirmation with an analyser's checks beside it: they are recorded and do not gate."""
    rules = [R.Rule("A1", must_call=("password",), checks=("en", "de")), R.Rule("A2", must_lack_patterns=("[0-9]{4,}", "(unclosed"), must_have=(" ",))]
    out = R.confirm(R.all_pairs(_docs(spark, sf_dir).withColumn("told", F.when(F.col("contract").isNotNull(), F.array("contract"))), rules), rules, "text", "told")
    hit = lambda k: F.array_join(F.try_element_at("hits", F.lit(k)), ",")
    return out.select("doc_id", "class_id", "passed", "reason", F.try_element_at("checks", F.lit("slither")).alias("slither"), hit("slither_hits").alias("told"), hit("guards_present").alias("present"), hit("must_have_hits").alias("have"))


def group_sizes(spark, sf_dir):
    out = reports.by_size(_docs(spark, sf_dir).where("protocol is not null"), "protocol", "doc_id")
    return out.withColumn("place", F.col("place").cast("bigint"))


def run_order(spark, sf_dir):
    """The orders' customers as runs, two of them canonical, in the report's order."""
    runs = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run")).distinct()
    kinds = tables.in_run_order(F.col("run"), ["7", "4"])
    return ranked(runs.select("run", kinds[0].alias("kind")), [], ["kind", "run"], "place").select("run", "place")


def best_reply(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("attempt"), (F.length("text") % 7 / 8).alias("confidence"), (F.length("text") % 3 > 0).alias("property_match"))
    return R.best_reply(turns, ["conv_id"])


def uncached_prompts(spark, sf_dir):
    """The prompts without a reply in a store that has those of the first turns, in two runs and then in one."""
    folder = f"{scratch(spark)}/replies"
    turns = _read(spark, sf_dir, "conversations").select(T.prompt_key(F.lit("mock"), F.col("role"), F.col("text"), F.lit("0.3")).alias("key"), "turn", "text", "conv_id")
    first = turns.where("turn = 1")
    for part in (0, 1):
        keyed_store.append(first.where(F.pmod("conv_id", F.lit(2)) == part).select("key", "text"), folder)
    keyed_store.compact(spark, folder)
    return keyed_store.missing(turns, folder)


def commit_refs(spark, sf_dir):
    refs = _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper(F.substring(F.sha2("text", 256), F.lit(1), (F.col("doc_id") % 50).cast("int")))).otherwise(F.col("contract")).alias("ref"))
    return refs.select("doc_id", T.is_commit(F.col("ref")).alias("commit"))


# Texts and prompts.
def prompt_context(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    out = T.prompt_context(F.when(F.col("page_id") % 3 > 0, F.col("url")), F.when(F.col("page_id") % 5 > 0, F.substring("html", 1, 50)), F.when(F.col("page_id") % 4 > 0, F.slice(F.split("html", " "), 1, 60)).otherwise(F.array().cast("array<string>")))
    return pages.select("page_id", F.sha2(out, 256).alias("sha"), F.length(out).cast("bigint").alias("n"))


def sections(spark, sf_dir):
    doc = F.concat(F.lit("intro\n## ONE\nid: V7\n"), F.coalesce("text", F.lit("")), F.lit("\n## TWO\nlast"))
    return _docs(spark, sf_dir).select("doc_id", T.section(doc, "## ONE").alias("one"), T.section(doc, "## TWO").alias("two"), T.section(doc, "## NONE").alias("none"), T.extracted(doc, r"^id:\s*(V\d+)", "V1").alias("id"), T.extracted(doc, r"^nothing: (x)", "V1").alias("nothing"))


def first_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.first_line(F.coalesce("text", F.lit(""))).alias("line"))


def reply_fields(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations")
    body = F.to_json(F.struct((F.col("turn") % 2 == 0).alias("property_match"), (F.col("turn") / 16).alias("confidence"), F.col("text").alias("attack_path"), F.array("role").alias("key_variables"), F.col("turn").alias("severity")))
    reply = F.when(F.col("turn") % 5 == 4, "no object here").otherwise(F.concat(F.lit("Here is it:\n"), body, F.lit("\nthat is all {}")))
    f = T.reply_fields(T.repair_json(reply))
    return rows.select("conv_id", "turn", f["property_match"].alias("property_match"), f["confidence"].alias("confidence"), f["attack_path"].alias("path"), F.array_join(f["key_variables"], ",").alias("variables"), f["severity"].alias("severity"), f["verdict"].alias("verdict"))


def pair_analysis(spark, sf_dir):
    """Auditors, critic and decision for every document, with the offline stand-in. The analysis deals the documents itself."""
    docs = C._docs(spark, sf_dir, spread=False)
    slices = docs.select(F.col("doc_id").cast("string").alias("id"), "protocol", "contract", F.lit("f()").alias("signature"), F.lit("").alias("solc_version"), F.lit("(none extracted)").alias("context"), F.coalesce("text", F.lit("")).alias("code"))
    out = model.analyse(slices, C.RULES, [model.Offline()], model.Settings(top_k=4, parts=C._parts(docs)))
    return out.select(
        F.col("id").cast("bigint").alias("doc_id"), "class_id", "detected", "severity", F.array_join("key_variables", ",").alias("variables"), F.array_join("statements", "|").alias("statements"), "rubric", "inconsistent",
        F.round(F.try_divide("score", "confidence"), 1).alias("weight"), ((F.col("confidence") >= 0.55) & (F.col("confidence") <= 0.9)).alias("sure"), "provider", "parse_failed", "provider_error", "calls",
    )


#: The small rule base with the texts that prompts show.
TITLED = [dataclasses.replace(r, title=f"Class {r.id}", scenario=f"someone calls\n{r.must_call[:1]}", property=f"no guard\nin {r.layer}") for r in C.RULES]


def audit_prompts(spark, sf_dir):
    """The auditor's and the critic's prompts of every retrieved pair: their hashes, lengths and the critic's rubric. The finding
    under review names the document's first words as variables and its lines as statements."""
    words, lines = F.split(F.coalesce("text", F.lit("")), " "), F.split(F.coalesce("text", F.lit("")), "\n")
    docs = _docs(spark, sf_dir).select(
        "doc_id", "protocol", "contract", F.concat(F.lit("f"), "doc_id", F.lit("()")).alias("signature"), F.when(F.col("doc_id") % 3 == 0, "^0.8.0").alias("solc_version"),
        F.lit("(none extracted)").alias("context"), F.col("text").alias("code"), F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("timestamp"), F.lit("suicidal"))).alias("told"),
        words.alias("key_variables"), F.when(F.col("doc_id") % 5 > 0, lines).alias("vulnerable_statements"), F.concat(F.lit("path "), "contract").alias("attack_path"),
    )
    pairs = R.retrieve(docs, TITLED, "code")
    auditor, critic, system = P.auditor_prompt(TITLED, "code", "told"), P.critic_prompt(TITLED), P.critic_system(TITLED)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return pairs.select("doc_id", "class_id", sha(auditor).alias("auditor"), F.length(auditor).cast("bigint").alias("n_auditor"), sha(critic).alias("critic"), F.length(critic).cast("bigint").alias("n_critic"), sha(system).alias("system"), P.rubric_of(TITLED).alias("rubric"))


# Reports.
def corpus_table(spark, sf_dir):
    meta = C._protocols(spark, sf_dir)
    slices = _docs(spark, sf_dir).where("protocol is not null").select("protocol", F.lit("study").alias("tier"))
    names = meta.where("tier = 'study'").select(F.col("protocol").alias("name"), F.upper("protocol").alias("display"), "algorithmic", "family", F.when(F.col("family") == "b", "2022-05-09").alias("incident_date"))
    return reports.corpus(slices, names)


def overall_table(spark, sf_dir):
    found, labels = C._findings(spark, sf_dir), C._labels(spark, sf_dir)
    return reports.overall(E.overall(found, labels), E.ranked(found, labels)).withColumn("place", F.col("place").cast("bigint"))


def layer_table(spark, sf_dir):
    protocols = C._protocols(spark, sf_dir)
    members = protocols.select("protocol", F.explode(E.layers_of(F.col("tier"), F.col("algorithmic"))).alias("layer"))
    return reports.layers(C.layered_eval(spark, sf_dir), members)


def run_table(spark, sf_dir):
    runs = C._runs(spark, sf_dir)
    return reports.runs(C.run_compare(spark, sf_dir, runs), C.control_fp(spark, sf_dir, runs)).select("run", "tp", "fp", "f1", "control_fp", "error")


def sensitivity_table(spark, sf_dir):
    return reports.sensitivity(S.sensitivity(Q._series(spark, sf_dir), Q.GRID, **{}))


def lead_table(spark, sf_dir):
    leads, warned = Q.leads_and_alerts(spark, sf_dir)
    out = reports.lead(S.lead_summary(leads), warned)
    return out.withColumn("place", F.col("place").cast("bigint"))


def alerts_head(spark, sf_dir):
    return reports.first_alerts(Q.early_warning_alerts(spark, sf_dir).select("series_id", "ts", "state"))


def report_lines(spark, sf_dir):
    """A table's rows as Markdown, LaTeX and CSV."""
    rows = _docs(spark, sf_dir).select("doc_id", "protocol", F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), "[\r\n]", " ").alias("head"), F.lit("50%_a").alias("mark"))
    columns = ["protocol", "mark", "head"]
    return rows.select("doc_id", writers.markdown_row(columns).alias("md"), writers.latex_row(columns).alias("tex"), writers.csv_row(columns).alias("csv"))


def prevention_lines(spark, sf_dir):
    found = C._findings(spark, sf_dir).where("detected")
    kb = R.dimension(spark, C.RULES).where("mitigation is not null").select("class_id", "mitigation")
    sites = found.join(kb, "class_id").withColumns({
        "title": F.concat(F.lit("title "), "class_id"), "category": F.lit("A1"), "mitigation_title": F.lower("mitigation"), "actions": F.array(F.lit("one"), F.lit("two")), "patch": F.lit("p;"), "line": F.lit(7),
    })
    out = writers.site_lines(sites, 10)
    return out.select("class_id", "sites", F.col("section").cast("bigint").alias("section"), F.col("line_no").cast("bigint").alias("line_no"), "line")


# Streams.
def stream_episodes(spark, sf_dir):
    """Episodes of the events as a stream; equal to those of the table."""
    path = scratch(spark)
    Q._series(spark, sf_dir, "user_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("series_id string, ts bigint, value double").parquet(f"{path}/in")
    return live.latest(live.run_available(live.episodes(stream, {"depeg": 35.0}, step_seconds=86_400), path))


def stream_lows(spark, sf_dir):
    path = scratch(spark)
    Q._series(spark, sf_dir).withColumn("time", F.timestamp_seconds("ts")).select("series_id", "time", "value").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("series_id string, time timestamp, value double").parquet(f"{path}/in")
    return live.run_available(live.lows(stream), path)


#: Step of the streamed warnings, and how late their samples may come.
WARN_STEP, WARN_LATE = 1_200, 60


def stream_alerts(spark, sf_dir):
    """Early warnings of the events as a stream of four micro-batches, in which every fifth sample comes up to an hour late and
    every seventh comes again; those up to the watermark equal the table's."""
    path = scratch(spark)
    rows = Q._series(spark, sf_dir).withColumn("time", F.timestamp_seconds("ts"))
    least, span = rows.agg(F.min("ts"), F.max("ts") - F.min("ts") + 1).first()
    late = F.when(F.col("ts") % 5 == 0, F.lit(WARN_LATE * 60 - 1)).otherwise(0)
    again = F.explode(F.when(F.col("ts") % 7 == 0, F.array(F.lit(0), F.lit(1_800))).otherwise(F.array(F.lit(0))))
    sent = rows.withColumn("_again", again).select("series_id", "time", "value", (F.floor((F.col("ts") + late + F.col("_again") - least) * 4 / span)).alias("_at"))
    stream = warn.in_batches(sent, f"{path}/in", 4, F.least(F.col("_at"), F.lit(3)).cast("int")).drop("_at")
    out = live.run_available(warn.alerts(stream, WARN_STEP, Q.TIERS, minutes=60, late_minutes=WARN_LATE), path)
    return out.withColumn("reasons", F.array_join("reasons", "; "))


_LBL = "coalesce(CASE WHEN {0} IS NULL THEN '—' ELSE printf('%.3f', {0}) END, '—')"
_OVERALL = [
    ("True positives", "tp::VARCHAR"), ("False positives", "fp::VARCHAR"), ("False negatives", "fn::VARCHAR"), ("True negatives", "tn::VARCHAR"),
    ("Precision", _LBL.format("precision")), ("Recall", _LBL.format("recall")), ("F1", _LBL.format("f1")), ("Effective F1", _LBL.format("effective_f1")), ("Accuracy", _LBL.format("accuracy")), ("Output coverage", _LBL.format("coverage")),
    ("Unparseable outputs", "parse_failures::VARCHAR"), ("Labels retrieved", "labels_matched || '/' || labels"), ("Labels never retrieved", "labels_unretrieved::VARCHAR"), ("Findings scored", "findings::VARCHAR"),
    *[(c.replace("_", "-").upper(), _LBL.format(c)) for c in ("top_1", "top_3", "top_5", "mrr")],
]
_STEP = 86_400


def _cte(sql: str) -> str:
    return f"({sql})"


def _prompts_sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    by = lambda f: "CASE class_id " + " ".join(f"WHEN '{r.id}' THEN {quote(f(r))}" for r in TITLED) + " END"
    flat = lambda t: t.replace("\n", " ")
    auditor = " || ".join([
        quote("## TARGET\nprotocol: "), "coalesce(protocol, '')", quote("   contract: "), "coalesce(contract, '')", quote("\nfunction: f"), "doc_id", quote("()   compiler: "), "CASE WHEN doc_id % 3 = 0 THEN '^0.8.0' ELSE 'unknown' END",
        quote(f"\n\n{P.CODE_HEAD}\n"), "body", quote("\n\n## CONTEXT\n(none extracted)\n\n## STATIC ANALYSIS SIGNALS\n"), "CASE WHEN doc_id % 4 = 0 THEN 'timestamp, suicidal' ELSE 'none' END", quote(f"\n\n{P.CLASS_HEAD}\nid: "), "class_id",
        quote("\ntitle: "), by(lambda r: r.title), quote("\nscenario: "), by(lambda r: flat(r.scenario)), quote("\nproperty: "), by(lambda r: flat(r.property)),
        quote("\n\n## TASK\nDecide whether the function implements the scenario and whether it has the property; name variables, statements and a path to profit."),
    ])
    critic = " || ".join([
        quote(f"{P.CODE_HEAD}\n"), "body", quote("\n\n## FINDING\nid: "), "class_id", quote("\ntitle: "), by(lambda r: r.title), quote("\nlayer: "), by(lambda r: r.layer), quote("\nproperty: "), by(lambda r: flat(r.property)),
        quote("\nvariables: "), "array_to_string(string_split(body, ' ')[1:8], ', ')", quote("\nstatements: "), "CASE WHEN doc_id % 5 > 0 THEN array_to_string(string_split(body, chr(10))[1:4], ' | ') ELSE '' END", quote("\npath: "), "coalesce('path ' || contract, '')",
    ])
    rubric = by(lambda r: P.CRITIC["implementation" if r.layer == "implementation" else "design"])
    return f"WITH {C._BASE}, p AS (SELECT doc_id, class_id, {auditor} AS a, {critic} AS c, {rubric} AS s, {by(lambda r: 'implementation' if r.layer == 'implementation' else 'design')} AS rubric FROM rk JOIN (SELECT doc_id, body FROM t) USING (doc_id)) SELECT doc_id, class_id, sha256(a) AS auditor, length(a) AS n_auditor, sha256(c) AS critic, length(c) AS n_critic, sha256(s) AS system, rubric FROM p"


def _sql() -> dict[str, str]:
    code, ser = C.ORACLE_SQL, Q.ORACLE_SQL
    tex = lambda c: f"replace(replace(coalesce({c}, 'None'), '_', '\\_'), '%', '\\%')"
    csv = lambda c: f"CASE WHEN regexp_matches(coalesce({c}, ''), '[\",\\r\\n]') THEN '\"' || replace(coalesce({c}, ''), '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END"
    hint = "CASE class_id " + " ".join(f"WHEN '{r.id}' THEN '{','.join(r.must_call[:3])}'" for r in C.RULES) + " END"
    layer = "CASE class_id " + " ".join(f"WHEN '{r.id}' THEN '{'implementation' if r.layer == 'implementation' else 'design'}'" for r in C.RULES) + " END"
    trimmed = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
    ctx = [("'// state variables' || chr(10) || url", "page_id % 3 > 0 AND length(url) > 0"), ("'// modifiers' || chr(10) || substr(html, 1, 50)", "page_id % 5 > 0 AND length(html) > 0"), ("'// callees: ' || names", "page_id % 4 > 0 AND length(names) > 0")]
    return {
        "file_measures": "SELECT doc_id, sha256(text) AS sha256, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS n_lines, coalesce(strlen(text), 0)::BIGINT AS n_bytes, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents",
        "file_scan": "SELECT doc_id FROM documents WHERE doc_id % 5 < 3 AND text IS NOT NULL",
        "analyser_report": "SELECT source AS protocol, doc_id::VARCHAR AS file, unnest(['f' || doc_id, coalesce(source, '')]) AS function, coalesce(lang, '') AS check FROM documents WHERE doc_id % 7 <> 0",
        "benchmark_labels": "SELECT doc_id AS entry_id, source AS file, (SELECT arg_min('f' || s.doc_id, s.doc_id) FROM documents s WHERE s.source = d.source AND d.doc_id + 2 BETWEEN s.doc_id AND s.doc_id + 2) AS function, CASE doc_id % 3 WHEN 0 THEN 'R1' ELSE 'R3' END AS class_id FROM documents d WHERE source IS NOT NULL AND doc_id % 3 < 2 AND doc_id % 4 = 0",
        "benchmark_dropped": "SELECT CASE WHEN doc_id % 3 = 2 THEN 'no class' ELSE 'no function' END AS dropped, count(*) AS entries FROM documents WHERE source IS NOT NULL AND (doc_id % 3 = 2 OR doc_id % 4 <> 0) GROUP BY 1",
        "fetch_quality": "WITH n AS (SELECT event_type AS s, count(DISTINCT floor(epoch(ts))) AS c FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT protocol, leg, series_id, coalesce(c, 0)::BIGINT AS samples, CASE WHEN error IS NOT NULL THEN 'failed' WHEN coalesce(c, 0) = 0 THEN 'empty' ELSE 'ok' END AS status FROM (VALUES ('a', 'prices', 'click', NULL), ('a', 'supply', 'nowhere', NULL), ('b', 'prices', 'purchase', 'HTTP 500'), ('c', 'prices', NULL, NULL)) v(protocol, leg, series_id, error) LEFT JOIN n ON s = series_id",
        "series_csv": "SELECT 'all' AS series_id, floor(epoch(ts))::BIGINT AS ts, min(value) AS value FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL",
        "price_json": "SELECT 'part' AS series_id, p_partkey::BIGINT AS ts, min(p_retailprice::DOUBLE) AS value FROM part GROUP BY ALL",
        "supply_json": "SELECT 'bal' AS series_id, c_custkey::BIGINT AS ts, min(c_acctbal::DOUBLE) AS value FROM customer WHERE c_custkey % 3 > 0 GROUP BY ALL",
        "finest_series": "WITH s AS (SELECT event_type AS series_id, floor(epoch(ts))::BIGINT AS ts FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL) SELECT series_id, CASE WHEN series_id IN ('click', 'view') THEN '1m' ELSE '1h' END AS resolution, CASE WHEN series_id IN ('click', 'view') THEN count(*) ELSE count(DISTINCT ts // 3600) END AS samples FROM s GROUP BY series_id",
        "protocol_filter": f"WITH {C._FI} SELECT protocol AS name, tier, coalesce(algorithmic, 'none') AS algorithmic FROM pt WHERE tier = 'study' AND coalesce(algorithmic, 'none') IN ('none', 'pure')",
        "market_protocols": f"WITH {C._FI} SELECT protocol AS name, protocol AS binance_symbol FROM pt WHERE k % 2 = 0 AND k % 6 <> 0",
        "unavailable_protocols": f"WITH {C._FI} SELECT name FROM (VALUES ('src1'), ('src2'), ('nosuch')) v(name) WHERE name NOT IN (SELECT protocol FROM pt WHERE tier = 'study')",
        "skip_reasons": f"WITH {C._FI}, n AS (SELECT source AS protocol, count(*) AS n FROM documents GROUP BY 1) SELECT protocol AS name, CASE WHEN k % 2 <> 0 OR k % 6 = 0 THEN 'peg is not the dollar' WHEN n % 3 = 0 THEN 'no series' WHEN n % 2 = 0 THEN 'empty series' END AS reason FROM pt JOIN n USING (protocol)",
        "benchmark_scope": "SELECT doc_id FROM documents WHERE lang IS NULL OR lang <> 'en'",
        "labelled_slices": "SELECT DISTINCT doc_id AS id, 'f' || doc_id AS function, doc_id % 1000 AS ordinal FROM labels JOIN documents USING (doc_id) WHERE (toxic = 1 OR quality = 0) AND source IS NOT NULL",
        "picked_slice": "SELECT max(doc_id)::VARCHAR AS id FROM labels JOIN documents USING (doc_id) WHERE (toxic = 1 OR quality = 0) AND source IS NOT NULL",
        "confirm_rate": f"WITH {C._BASE} SELECT contract AS language, count(*) AS pairs, round(avg(passed::INT), 4) AS rate FROM v GROUP BY contract",
        "analyser_record": """WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS body, lower(coalesce(text, '')) AS low FROM documents)
            SELECT doc_id, 'A1' AS class_id, contains(low, 'password') AS passed, CASE WHEN contains(low, 'password') THEN 'all static conditions satisfied' ELSE 'no scenario call pattern found' END AS reason, CASE WHEN lang IS NOT NULL THEN lang IN ('en', 'de') END AS slither, CASE WHEN lang IN ('en', 'de') THEN lang WHEN lang IS NOT NULL THEN '' END AS told, NULL AS present, NULL AS have FROM t
            UNION ALL SELECT doc_id, 'A2', g IS FALSE AND h, CASE WHEN g IS FALSE AND h THEN 'all static conditions satisfied' ELSE concat_ws('; ', CASE WHEN g THEN 'guard present: re:[0-9]{4,}' END, CASE WHEN NOT h THEN 'required feature not found' END) END, NULL, NULL, CASE WHEN g THEN 're:[0-9]{4,}' ELSE '' END, CASE WHEN h THEN ' ' ELSE '' END FROM (SELECT doc_id, regexp_matches(body, '[0-9]{4,}') AS g, contains(low, ' ') AS h FROM t)""",
        "group_sizes": "SELECT source AS protocol, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS place FROM documents WHERE source IS NOT NULL GROUP BY source",
        "run_order": "SELECT run, row_number() OVER (ORDER BY coalesce(list_position(['7', '4'], run), 3), run) AS place FROM (SELECT DISTINCT o_custkey::VARCHAR AS run FROM orders)",
        "best_reply": "WITH r AS (SELECT conv_id, turn::BIGINT AS attempt, (length(text) % 7) / 8.0::DOUBLE AS confidence FROM conversations WHERE length(text) % 3 > 0) SELECT conv_id, arg_max(attempt, confidence * 1000000 - attempt) AS attempt, max(confidence) AS confidence FROM r GROUP BY conv_id",
        "uncached_prompts": "WITH p AS (SELECT sha256(concat_ws('|', 'mock', role, text, '0.3')) AS key, turn FROM conversations) SELECT DISTINCT key FROM p WHERE key NOT IN (SELECT key FROM p WHERE turn = 1)",
        "commit_refs": "SELECT doc_id, coalesce(regexp_full_match(lower(CASE WHEN doc_id % 2 = 0 THEN substr(sha256(text), 1, (doc_id % 50)::INT) ELSE lang END), '[0-9a-f]{7,40}'), false) AS commit FROM documents",
        "prompt_context": f"WITH n AS (SELECT page_id, url, html, array_to_string(list_sort(list_distinct(list_slice(string_split(html, ' '), 1, 60)))[1:25], ', ') AS names FROM pages), c AS (SELECT page_id, coalesce(nullif(concat_ws(chr(10) || chr(10), {', '.join(f'CASE WHEN {w} THEN {x} END' for x, w in ctx)}), ''), '(none extracted)') AS t FROM n) SELECT page_id, sha256(t) AS sha, length(t)::BIGINT AS n FROM c",
        "sections": "SELECT doc_id, chr(10) || 'id: V7' || chr(10) || CASE WHEN strpos(chr(10) || coalesce(text, ''), chr(10) || '## ') > 0 THEN substr(coalesce(text, ''), 1, greatest(0, strpos(chr(10) || coalesce(text, ''), chr(10) || '## ') - 2)) ELSE coalesce(text, '') END AS one, chr(10) || 'last' AS two, '' AS none, 'V7' AS id, 'V1' AS nothing FROM documents",
        "audit_prompts": _prompts_sql(),
        "first_lines": rf"SELECT doc_id, substr(regexp_extract({trimmed}, '^[^\r\n]*'), 1, 120) AS line FROM documents",
        "reply_fields": "SELECT conv_id, turn, CASE WHEN ok THEN turn % 2 = 0 END AS property_match, CASE WHEN ok THEN turn / 16.0::DOUBLE END AS confidence, CASE WHEN ok THEN text END AS path, CASE WHEN ok THEN role END AS variables, CASE WHEN ok THEN turn::VARCHAR END AS severity, NULL::VARCHAR AS verdict FROM (SELECT *, turn % 5 <> 4 AS ok FROM conversations)",
        "pair_analysis": f"WITH {C._BASE}, x AS (SELECT rk.*, t.body FROM rk JOIN t USING (doc_id)) SELECT doc_id, class_id, passed AS detected, CASE WHEN passed THEN 'high' ELSE 'low' END AS severity, CASE WHEN passed THEN {hint} ELSE '' END AS variables, CASE WHEN passed THEN substr(regexp_extract(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), '^[^\\r\\n]*'), 1, 120) ELSE '' END AS statements, CASE WHEN passed THEN {layer} END AS rubric, false AS inconsistent, CASE WHEN passed THEN 0.6::DOUBLE END AS weight, passed AS sure, 'mock' AS provider, false AS parse_failed, '' AS provider_error, 2::BIGINT AS calls FROM x",
        "corpus_table": f"WITH {C._FI}, n AS (SELECT source AS protocol, count(*) AS slices FROM documents WHERE source IS NOT NULL GROUP BY 1), m AS (SELECT *, CASE k % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS family FROM pt WHERE tier = 'study') SELECT CASE WHEN m.protocol IS NULL THEN n.protocol ELSE upper(n.protocol) END AS protocol, coalesce(algorithmic, '—') AS algorithmic, 'study' AS role, coalesce(family, '—') AS family, CASE WHEN family = 'b' THEN '2022-05-09' ELSE '—' END AS incident_date, slices FROM n LEFT JOIN m ON m.protocol = n.protocol",
        "overall_table": f"WITH o AS {_cte(code['evaluation_overall'])}, r AS {_cte(code['ranked_metrics'])}, x AS (SELECT * FROM o, r) " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS place, '{m}' AS metric, {v} AS value FROM x" for i, (m, v) in enumerate(_OVERALL, 1)),
        "layer_table": f"WITH e AS {_cte(code['layered_eval'])}, {C._FI}, n AS (SELECT g, count(DISTINCT protocol) AS protocols FROM {C._LY} GROUP BY g) SELECT CASE layer {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in reports.LAYERS.items())} END AS layer, coalesce(protocols, 0)::BIGINT AS protocols, labels, {', '.join(f'CASE WHEN layer = {"control"!r} THEN {"—"!r} ELSE printf({"%.3f"!r}, {c}) END AS {c}' for c in ('precision', 'recall', 'f1'))}, fp FROM e LEFT JOIN n ON g = layer",
        "run_table": f"WITH r AS {_cte(code['run_compare'])}, c AS {_cte(code['control_fp'])} SELECT run, tp, fp, f1, CASE WHEN error IS NULL THEN coalesce(control_fp, 0) END::BIGINT AS control_fp, error FROM r LEFT JOIN c USING (run)",
        "sensitivity_table": f"WITH e AS {_cte(ser['episode_sensitivity'])} SELECT series_id, '$' || threshold AS threshold, events, minutes, coalesce(CASE WHEN min_value IS NOT NULL THEN printf('%.4f', min_value) END, '—') AS min_value FROM e",
        "lead_table": f"WITH p AS {_cte(ser['lead_time_pooled'])}, a AS (SELECT count(*) AS alerts FROM {_cte(ser['early_warning_alerts'])}), x AS (SELECT * FROM p, a) SELECT 1::BIGINT AS place, 'Alerts raised' AS metric, alerts::VARCHAR AS value FROM x UNION ALL SELECT 2, 'Episodes', total::VARCHAR FROM x UNION ALL SELECT 3, 'Episodes preceded by an alert', detected::VARCHAR FROM x UNION ALL SELECT 4, 'Episodes warned', CASE WHEN total > 0 THEN printf('%.1f%%', 100 * detected / total::DOUBLE) ELSE '—' END FROM x UNION ALL SELECT 5, 'Median lead (minutes)', coalesce(median_lead::VARCHAR, '—') FROM x UNION ALL SELECT 6, 'Look-back (minutes)', '2880' FROM x",
        "alerts_head": f"SELECT series_id, ts, state FROM {_cte(ser['early_warning_alerts'])} ORDER BY ts, series_id, state LIMIT 40",
        "report_lines": rf"WITH r AS (SELECT doc_id, source AS protocol, '50%_a' AS mark, regexp_replace(substr(coalesce(text, ''), 1, 60), '[\r\n]', ' ', 'g') AS head FROM documents) SELECT doc_id, '| ' || coalesce(protocol, 'None') || ' | ' || mark || ' | ' || head || ' |' AS md, {tex('protocol')} || ' & ' || {tex('mark')} || ' & ' || {tex('head')} || ' \\' AS tex, {csv('protocol')} || ',' || {csv('mark')} || ',' || {csv('head')} AS csv FROM r",
        "prevention_lines": f"""WITH {C._FI}, s AS (SELECT f0.*, mitigation, row_number() OVER (PARTITION BY class_id ORDER BY score DESC, ordinal) AS place FROM f0 JOIN {C._DIM} USING (class_id) WHERE detected AND mitigation IS NOT NULL),
            h AS (SELECT class_id, any_value(mitigation) AS mi, count(*) AS sites FROM s GROUP BY class_id), b AS (SELECT class_id, score AS bs, ordinal AS bo FROM s WHERE place = 1),
            g AS (SELECT class_id, mi, sites, row_number() OVER (ORDER BY sites DESC, bs DESC, bo) AS section FROM h JOIN b USING (class_id)),
            x AS (SELECT class_id, sites, section, ['## ' || class_id || ' — title ' || class_id, '*Category:* A1 · *Mitigation:* ' || mi || ' — ' || lower(mi), '', '**Actions**', '- one', '- two', '', '**Patch template**', '```solidity', 'p;', '```', '', '**Affected sites (' || sites || ')**', ''] AS ls FROM g)
            SELECT class_id, sites, section, (k - 1)::BIGINT AS line_no, ls[k] AS line FROM x, range(1, 15) r(k)
            UNION ALL SELECT class_id, sites, section, place + 10000, printf('- `%s` %s:7 → `%s` (score %.3f)', protocol, file, function, score) FROM s JOIN g USING (class_id) WHERE place <= 10
            UNION ALL SELECT class_id, sites, section, 99999, '- ...and ' || (sites - 10) || ' more' FROM g WHERE sites > 10""",
        "stream_episodes": f"WITH {Q._U}, g AS (SELECT *, lag(ts) OVER w AS prev_ts, lag(value) OVER w AS prev_value FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts)), st AS (SELECT DISTINCT series_id, {_STEP}::BIGINT AS step FROM s), {Q._episodes_sql({'depeg': 35.0})} SELECT * FROM ep",
        "stream_alerts": f"""WITH {Q._S.replace("s AS (", "s0 AS (", 1)}, s AS (SELECT * FROM s0 WHERE ts <= (SELECT floor(epoch(max(ts)))::BIGINT - {WARN_LATE * 60} FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL)),
            st AS (SELECT series_id, {WARN_STEP}::BIGINT AS step, count(*) AS samples FROM s GROUP BY series_id), {Q._LOW}, gr AS (SELECT series_id, ts, NULL::DOUBLE AS growth FROM s), {Q._AL[Q._AL.index("rn AS (") :]}
            SELECT series_id, ts, state, CASE WHEN low < 35.0 THEN printf('price touched %.4f (< 35.0)', low) ELSE '' END AS reasons FROM al""",
        "stream_lows": f"WITH {Q._S}, h AS (SELECT series_id, ts // 3600 * 3600 AS hour, min(value) AS low, count(*) AS samples FROM s GROUP BY series_id, ts // 3600 * 3600) SELECT series_id, hour::BIGINT AS start_ts, (hour + 3600)::BIGINT AS end_ts, low, samples FROM h WHERE hour + 3600 <= (SELECT max(ts) - 3600 FROM s)",
    }


QUERIES = {
    f.__name__: f
    for f in (
        file_measures, file_scan, analyser_report, benchmark_labels, benchmark_dropped, fetch_quality, series_csv, price_json, supply_json, finest_series, protocol_filter, market_protocols, unavailable_protocols, skip_reasons,
        benchmark_scope, labelled_slices, picked_slice, confirm_rate, analyser_record, group_sizes, run_order, best_reply, uncached_prompts, commit_refs, prompt_context, sections, first_lines, reply_fields, pair_analysis, audit_prompts,
        corpus_table, overall_table, layer_table, run_table, sensitivity_table, lead_table, alerts_head, report_lines, prevention_lines, stream_episodes, stream_lows, stream_alerts,
    )
}
ORACLE_SQL = _sql()
