"""Rule, decision, evaluation and table queries, with documents standing for code, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.draws import bits_sql
from ..operators import evaluate as E
from ..operators import rules as R
from ..operators import slicing, tables
from ..operators.ordered import stored

#: A small rule base whose terms occur in the documents.
RULES = [
    R.Rule("R1", "critical", "implementation", "M1", ("a", "b"), must_call=("password", "token", "api_key", "AKIA"), must_lack=("example", "licen"), hints=("secret",)),
    R.Rule("R2", "high", "governance", "M2", ("b",), must_call=("@",), must_have=("mail", ".com"), hints=("phone(", "")),
    R.Rule("R3", "high", "economic", "M3", must_call=("#", "*", "|"), must_lack_patterns=("[0-9]{4,}",)),
    R.Rule("R4", "critical", "economic", "M4", ("c", "d"), must_call=(" the ", " of "), must_lack=(" der ", " die "), must_have_patterns=("[a-z]+tion",)),
    R.Rule("R5", "high", "oracle", None, must_call=(" der ", " die ", " und "), captures=("(ge[a-z]+)",)),
    R.Rule("R10", "high", "oracle", "M10", ("d",), must_call_patterns=("[0-9]{3,}",), hints=("%", "0"), captures=("([0-9]{3,})",)),
]
FAMILIES = ["a", "b", "c", "d"]
CHECKS = {"abuse": "R4", "low-quality": "R3"}
RUNS = ["static", "retrieval", "absent"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir, spread: bool = True):
    """The documents as code. Who needs no texts reads them as they lie."""
    docs = _read(spark, sf_dir, "documents")
    return (_spread(docs) if spread else docs).select("doc_id", "text", F.col("source").alias("protocol"), F.col("lang").alias("contract"))


#: Bytes of files whose rows go to one task: so a task's work and memory are the same for a table of any size.
SPREAD_BYTES = 8 << 20


def _parts(table: DataFrame) -> int:
    spark = table.sparkSession
    files = spark.read.format("binaryFile").load(table.inputFiles()).select("length")  # lengths are known without reading the files
    parts = -(-(files.agg(F.sum("length")).first()[0] or 0) // SPREAD_BYTES)
    return max(spark.sparkContext.defaultParallelism, parts)


def _spread(table: DataFrame) -> DataFrame:
    """A table is dealt by its first column, an id, to all cores and to parts of about SPREAD_BYTES before work in Python."""
    return table.repartition(_parts(table), table.columns[0])


def retrieve_topk(spark, sf_dir):
    out = R.retrieve(_docs(spark, sf_dir).select("doc_id", "text"), RULES, "text", forced=("R2",))
    return out.select("doc_id", "class_id", "score", F.col("rank").cast("bigint").alias("rank"))


#: Syllables of the documents' invented words, of which a large rule base is generated.
SYLLABLES = ("th", "an", "er", "tion", "ou", "wh", "in", "ed", "st", "or", "re", "ha", "he", "nd", "ea", "ing", "ble", "ly", "sh", "of")
MANY = 20_000


def many_rules() -> list[R.Rule]:
    """2,000 classes of ten terms each: the numbers to 20,000 written in syllables, the last digit first."""

    def term(k: int) -> str:
        out = ""
        for _ in range(4):
            out, k = out + SYLLABLES[k % 20], k // 20
        return out

    return [R.Rule(f"G{c:04d}", hints=tuple(term(10 * c + i) for i in range(10))) for c in range(MANY // 10)]


def retrieve_many_terms(spark, sf_dir):
    out = R.retrieve(_docs(spark, sf_dir).select("doc_id", "text"), many_rules(), "text")
    return out.select("doc_id", "class_id", "score", F.col("rank").cast("bigint").alias("rank"))


def rule_confirm(spark, sf_dir):
    out = R.confirm(R.all_pairs(_docs(spark, sf_dir), RULES), RULES, "text")
    return out.select("doc_id", "class_id", "passed", "reason", F.array_join("guards", ", ").alias("guards"))


def guard_capture(spark, sf_dir):
    out = R.confirm(R.all_pairs(_docs(spark, sf_dir), RULES), RULES, "text").where(F.col("class_id").isin("R5", "R10"))
    return out.select("doc_id", "class_id", F.array_join("captured", "|").alias("captured"))


def static_baseline(spark, sf_dir):
    return R.static_baseline(_docs(spark, sf_dir), RULES, "text").select("doc_id", "class_id", "detected", "confidence", "score")


def _replied(spark, sf_dir, fixed: bool):
    """Retrieved and confirmed pairs with a mock model's replies, drawn from a hash of the pair."""
    pairs = R.confirm(R.retrieve(_docs(spark, sf_dir), RULES, "text"), RULES, "text").drop("score")
    h = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "class_id"), 256)
    digits = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("int")
    right, gain = (F.lit(7), F.lit(6)) if fixed else (digits(4, 1) % 11, digits(5, 1) % 11)
    verdict = F.lit("confirmed") if fixed else F.when(digits(6, 1) < 8, "confirmed").otherwise("rejected")
    return pairs.withColumns({"confidence": digits(1, 3) / 4096, "correctness": right, "profitability": gain, "severity_score": F.lit(5), "verdict": verdict})


def mock_detect(spark, sf_dir):
    return R.decide(_replied(spark, sf_dir, True)).select("doc_id", "class_id", "confidence", "detected", "score")


def critic_gate(spark, sf_dir):
    return R.decide(_replied(spark, sf_dir, False)).select("doc_id", "class_id", "inconsistent", "accepted", "detected", "score")


def _findings(spark, sf_dir):
    """The findings, written once without their texts for all who read them: an evaluation names them several times."""
    out = R.decide(_replied(spark, sf_dir, False))
    doc = F.col("doc_id").cast("string")
    found = out.select(
        "protocol", F.concat_ws("/", "contract", doc, F.lit("text")).alias("file"), "contract", F.concat(F.lit("f"), doc).alias("function"), "class_id", "detected", "score",
        (F.col("doc_id") * 100 + F.col("rank")).alias("ordinal"), (F.col("confidence") < 0.05).alias("parse_failed"), "inconsistent",
    )
    return stored(found)


def _labels(spark, sf_dir):
    told = _read(spark, sf_dir, "labels").join(_docs(spark, sf_dir, False).select("doc_id", "protocol"), "doc_id")
    doc = F.col("doc_id").cast("string")
    classes = F.array_compact(F.array(F.when(F.col("toxic") == 1, "R4"), F.when(F.col("quality") == 0, "R3")))
    out = told.select("protocol", F.concat(F.lit("\\"), doc, F.lit("\\")).alias("file_contains"), F.concat(F.lit("f"), doc).alias("function"), F.explode(classes).alias("class_id"), doc.alias("_d"))
    return out.select("*", F.concat_ws(":", "_d", "class_id").alias("label_id")).drop("_d")


def _protocols(spark, sf_dir):
    number = F.substring("protocol", 4, 10).cast("int")
    names = _docs(spark, sf_dir, False).select("protocol").where(F.col("protocol").isNotNull()).distinct()
    kind = F.when(number % 5 == 0, F.lit(None)).when(number % 2 == 1, "pure").otherwise("partial")
    return names.select("protocol", F.when(number % 4 == 0, "control").otherwise("study").alias("tier"), kind.alias("algorithmic"), F.element_at(F.array(*map(F.lit, FAMILIES)), number % 4 + 1).alias("family"))


def evaluation_overall(spark, sf_dir):
    return E.overall(_findings(spark, sf_dir), _labels(spark, sf_dir))


def per_class_prf(spark, sf_dir):
    return E.per_class(_findings(spark, sf_dir), _labels(spark, sf_dir))


def ranked_metrics(spark, sf_dir):
    return E.ranked(_findings(spark, sf_dir), _labels(spark, sf_dir))


def layered_eval(spark, sf_dir):
    return E.by_layer(_findings(spark, sf_dir), _labels(spark, sf_dir), _protocols(spark, sf_dir))


def _runs(spark, sf_dir):
    found = _findings(spark, sf_dir)
    return found.withColumn("run", F.lit("static")).unionByName(found.withColumns({"run": F.lit("retrieval"), "detected": F.lit(True)}))


def run_compare(spark, sf_dir, runs: DataFrame | None = None):
    runs = _runs(spark, sf_dir) if runs is None else runs
    return E.compare_runs(runs, _labels(spark, sf_dir), RUNS).select("run", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "effective_f1", "error")


def control_fp(spark, sf_dir, runs: DataFrame | None = None):
    runs = _runs(spark, sf_dir) if runs is None else runs
    labels = _labels(spark, sf_dir).withColumn("run", F.explode(F.array(*map(F.lit, RUNS))))
    return E.control_false_positives(runs, labels, _protocols(spark, sf_dir), ["run"])


def run_summary(spark, sf_dir):
    return E.run_summary(_runs(spark, sf_dir), ["run"]).select("run", "pairs", "detected", "parse_failures", "contradictions")


def label_path_match(spark, sf_dir):
    return E.match_labels(_findings(spark, sf_dir), _labels(spark, sf_dir)).select("label_id", "file", "retrieved")


def bootstrap_f1(spark, sf_dir):
    return E.bootstrap_f1(_findings(spark, sf_dir), _labels(spark, sf_dir))


def recommendations(spark, sf_dir):
    return tables.recommendations(_findings(spark, sf_dir), R.dimension(spark, RULES)).withColumn("place", F.col("place").cast("bigint"))


def applicability_matrix(spark, sf_dir):
    return tables.applicability(RULES, _protocols(spark, sf_dir).where("tier = 'study'"), FAMILIES)


def _measured(spark, sf_dir):
    body = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).withColumns({"n_lines": T.lines_of(body), "tokens": T.tokens_of(body)})


def corpus_share(spark, sf_dir):
    return tables.shares(_measured(spark, sf_dir), "protocol")


def token_budget(spark, sf_dir):
    kept = F.length(T.cut(F.coalesce("text", F.lit("")), 500)).cast("bigint")
    return _measured(spark, sf_dir).select("doc_id", "n_lines", "tokens", kept.alias("kept_chars"))


def slice_id(spark, sf_dir):
    key = T.slice_id(F.col("protocol"), F.concat(F.col("contract"), F.lit(".txt")), F.col("contract"), F.lit("f()"), F.col("doc_id"))
    return _docs(spark, sf_dir).select("doc_id", key.alias("id"))


def callees(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.array_join(T.callees(F.coalesce("html", F.lit(""))), ",").alias("callees"))


def exclude_filter(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    files = docs.select("doc_id", F.concat_ws("/", "protocol", "contract", F.format_string("Doc%d.txt", "doc_id")).alias("file"), "n_bytes")
    return slicing.kept_files(files, ["/src1/", "/src2/"], ["doc7"], [".txt"], 2_000)


def stride_sample(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("protocol", F.col("contract").alias("file"), F.col("doc_id").alias("start_line"), F.col("doc_id").alias("id"))
    marked = _read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return slicing.stride_sample(docs, 60, marked)


def line_to_span(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    spans = docs.select(F.col("protocol").alias("file"), F.col("doc_id").alias("start_line"), (F.col("doc_id") + 9).alias("end_line"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("function"))
    lines = F.array(F.col("doc_id") * 7, F.col("doc_id") + 3)
    return tables.enclosing_span(docs.select(F.col("doc_id").alias("entry_id"), F.col("protocol").alias("file"), lines.alias("lines")), spans)


def analyser_map(spark, sf_dir):
    pairs = R.retrieve(_docs(spark, sf_dir), RULES, "text")
    doc = F.col("doc_id").cast("string")
    at = lambda df: df.withColumns({"file": doc, "function": F.concat(F.lit("f"), doc), "id": F.col("doc_id")})
    told = _read(spark, sf_dir, "labels").join(_docs(spark, sf_dir, False).select("doc_id", "protocol"), "doc_id")
    checks = F.explode(F.array_compact(F.array(F.when(F.col("toxic") == 1, "abuse"), F.when(F.col("quality") == 0, "low-quality"), F.lit("style"))))
    hits = tables.analyser_hits(at(told).select("protocol", "file", "function", checks.alias("check")), at(_docs(spark, sf_dir)), CHECKS)
    return tables.analyser_baseline(pairs.select(F.col("doc_id").alias("id"), "class_id"), hits)


def loo_exemplars(spark, sf_dir):
    positive = _labels(spark, sf_dir).select("class_id", "protocol", F.col("function").alias("signature"), F.lit("positive").alias("kind"))
    best = R.confirm(R.retrieve(_docs(spark, sf_dir), RULES, "text", top_k=1), RULES, "text")
    doc = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    slices = stored(best.select("protocol", F.col("contract").alias("file"), F.col("doc_id").alias("start_line"), doc.alias("function"), doc.alias("signature"), "class_id", "passed", F.length("text").alias("n_chars")))
    negative = tables.first_negatives(slices, _labels(spark, sf_dir), _protocols(spark, sf_dir).where("tier = 'control'"))
    targets = R.all_pairs(_protocols(spark, sf_dir).select("protocol"), RULES)
    return tables.exemplars(positive.unionByName(negative), targets)


def class_table(spark, sf_dir):
    return tables.class_table(per_class_prf(spark, sf_dir), R.dimension(spark, RULES))


def json_repair(spark, sf_dir):
    """Conversation turns, whole, inside a wordy reply, with a lesser object around the wanted one."""
    rows = _read(spark, sf_dir, "conversations")
    wanted = F.to_json(F.struct("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(' a } and a " in text')).alias("why")))
    reply = F.concat(F.lit('Notes {a note} and {"x": 1}, then '), wanted, F.lit(" done {"))
    fixed = T.repair_json(reply)
    return rows.select("conv_id", "turn", F.get_json_object(fixed, "$.why").alias("why"), F.get_json_object(fixed, "$.turn").cast("bigint").alias("told"))


def _flat(column: str, gone: str = "[\\r\\n]") -> Column:
    return F.regexp_replace(F.coalesce(column, F.lit("")), gone, " ")


def strip_comments(spark, sf_dir):
    """Pages, whole, in a line comment, in a string and in a block comment of one text."""
    body = F.coalesce("html", F.lit(""))
    code = F.concat(F.lit("f(); // "), _flat("html"), F.lit('\n"'), _flat("html", '[\\r\\n"\\\\]'), F.lit('"; /* '), F.replace(F.regexp_replace(body, "\r", ""), F.lit("*/"), F.lit("")), F.lit(" */ g(a / b);"))
    return _read(spark, sf_dir, "pages").select("page_id", T.strip_comments(code).alias("code"))


def normalize_identifiers(spark, sf_dir):
    """Identifiers of whole pages (their ASCII part): how many there are after renaming, and the text around them."""
    name = r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b"
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"[^\x00-\x7F]", " ")
    out = T.normalize_identifiers(plain)
    names = F.filter(F.array_distinct(F.regexp_extract_all(out, F.lit(name), F.lit(0))), lambda n: ~n.isin(T.RESERVED))
    pages = _read(spark, sf_dir, "pages")
    return pages.select("page_id", F.size(names).cast("bigint").alias("names"), F.md5(F.regexp_replace(out, name, "N")).alias("around"))


def function_slices(spark, sf_dir):
    """A contract for every page, with the whole page in comments and in a string of its function, cut into its functions."""
    head = F.format_string("pragma solidity ^0.8.0;\ncontract C%d {\n  uint256 public rate = 0;\n  function only(uint a);\n  function pay%d(address to) public onlyOwner {\n", "page_id", "page_id")
    code = F.concat(head, F.lit("    // } "), _flat("html"), F.lit('\n    note("{'), _flat("html", '[\\r\\n"\\\\]'), F.lit('");\n    send(to, rate);\n  }\n}\n'))
    name = F.format_string("c%d.sol", "page_id")
    files = _spread(_read(spark, sf_dir, "pages")).select(F.lit("pages").alias("protocol"), F.lit("study").alias("tier"), F.lit("solidity").alias("language"), name.alias("file"), code.alias("text"))
    out = slicing.function_slices(files, max_tokens=10**9)
    return out.select("file", "contract", "function", "signature", "start_line", "end_line", "state_vars", "modifiers", "n_chars", "solc_version")


def _page_files(spark, sf_dir):
    """Each page as a file in one of three languages, its text in comments and strings; every second file is of a benchmark.

    The Solidity ones have a modifier and, like the others, a function too short to count.
    """
    i, flat, text = F.col("page_id").cast("string"), _flat("html"), _flat("html", '[\\r\\n"\\\\]')
    lit = F.lit
    solidity = F.concat(lit("pragma solidity ^0.8.0;\ncontract C"), i, lit(" {\n  uint256 public rate = 0;\n  modifier only"), i, lit("() { require(rate > 0); _; }\n  function tiny() public { x(); }\n  function pay"), i, lit("(address to) public only"), i, lit(" {\n    // } "), flat, lit('\n    note("{'), text, lit('");\n    send(to, rate);\n  }\n}\n'))
    go = F.concat(lit("package p\nfunc tiny() { x() }\nfunc (k Keeper) Pay"), i, lit("(to string) error {\n\t// } "), flat, lit('\n\tnote("{'), text, lit('")\n\treturn nil\n}\n'))
    ride = F.concat(lit("{-# STDLIB_VERSION 5 #-}\nfunc tiny() = { 1 }\n@Callable(i)\nfunc pay"), i, lit('(to: String) = {\n  let x = "{'), text, lit('"\n  [StringEntry("to", x)]\n}\n'))
    kind = F.col("page_id") % 3
    choose = lambda a, b, c: F.when(kind == 0, a).when(kind == 1, b).otherwise(c)
    return _spread(_read(spark, sf_dir, "pages")).select(
        lit("pages").alias("protocol"), F.when(F.col("page_id") % 2 == 0, "benchmark").otherwise("study").alias("tier"),
        choose(lit("solidity"), lit("go"), lit("ride")).alias("language"), F.concat(lit("p"), i, choose(lit(".sol"), lit(".go"), lit(".ride"))).alias("file"), choose(solidity, go, ride).alias("text"),
    )


def lateral_slices(spark, sf_dir):
    """Files of three languages cut by a lateral join in SQL: budget, short functions, modifiers and benchmark comments act."""
    slicing.register(spark)
    files = _page_files(spark, sf_dir)
    return spark.sql(
        "SELECT f.file, f.tier, s.contract, s.signature, s.start_line, s.end_line, s.code, s.state_vars, s.modifiers, array_join(s.callees, ',') AS callees, s.approx_tokens, s.solc_version "
        "FROM {files} f, LATERAL slice_functions(f.protocol, f.tier, f.language, f.file, f.text, 500, 60) s",
        files=files,
    )


def _any_sql(code: list[str]) -> str:
    return "(" + " OR ".join(code) + ")"


def _rule_sql(r: R.Rule) -> dict[str, str]:
    """SQL of a rule's verdict over body and low."""
    has = lambda t: f"contains(low, '{t.lower()}')"
    rex = lambda p: f"regexp_matches(body, '{p}', 'i')"
    call = [*map(has, r.must_call), *map(rex, r.must_call_patterns)]
    lack = dict(zip((*r.must_lack, *(f"re:{p}" for p in r.must_lack_patterns)), [*map(has, r.must_lack), *map(rex, r.must_lack_patterns)], strict=True))
    have = [*map(has, r.must_have), *map(rex, r.must_have_patterns)]
    hard = [_any_sql(call)] * bool(call) + [f"NOT {_any_sql(list(lack.values()))}"] * bool(lack) + [_any_sql(have)] * bool(have)
    guards = "concat_ws(', ', " + ", ".join([f"CASE WHEN {c} THEN '{g}' END" for g, c in lack.items()] or ["NULL"]) + ")"
    said = [f"CASE WHEN NOT {_any_sql(call)} THEN 'no scenario call pattern found' END"] * bool(call)
    said += [f"CASE WHEN {_any_sql(list(lack.values()))} THEN 'guard present: ' || {guards} END"] * bool(lack)
    said += [f"CASE WHEN NOT {_any_sql(have)} THEN 'required feature not found' END"] * bool(have)
    terms = r.terms()
    score = f"({' + '.join(f'CASE WHEN {has(t)} THEN 1 ELSE 0 END' for t in terms)}) / sqrt({float(len(terms))}::DOUBLE)" if terms else "0.0::DOUBLE"
    passed = " AND ".join(hard) or "true"
    return {"passed": passed, "guards": guards, "score": score, "reason": f"CASE WHEN {passed} THEN 'all static conditions satisfied' ELSE concat_ws('; ', {', '.join(said) or 'NULL'}) END"}


_V = "v AS (" + " UNION ALL ".join(f"SELECT doc_id, protocol, contract, n, '{r.id}' AS class_id, {', '.join(f'{x} AS {c}' for c, x in _rule_sql(r).items())} FROM t" for r in RULES) + ")"
_T = "t AS (SELECT doc_id, source AS protocol, lang AS contract, length(text) AS n, coalesce(text, '') AS body, lower(coalesce(text, '')) AS low FROM documents)"
_RK = "rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class_id) AS rank FROM v WHERE score > 0) WHERE rank <= 4)"
_BASE = f"{_T}, {_V}, {_RK}"
_D = lambda at: f"(strpos('0123456789abcdef', substr(h, {at}, 1)) - 1)"
_RP = f"""rp AS (SELECT *, ({_D(1)} * 256 + {_D(2)} * 16 + {_D(3)}) / 4096.0::DOUBLE AS confidence, {_D(4)} % 11 AS c, {_D(5)} % 11 AS p, {_D(6)} < 8 AS yes FROM (SELECT *, sha256(doc_id || ':' || class_id) AS h FROM rk)),
dc AS (SELECT *, (yes AND NOT (c >= 5 AND p >= 3)) OR (NOT yes AND c >= 5 AND p >= 3) AS inconsistent FROM rp),
de AS (SELECT * EXCLUDE (score), NOT inconsistent AND c >= 5 AND p >= 3 AS accepted, round(confidence * (c + p + 5) / 30 * CASE WHEN passed THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END, 4) AS score FROM dc)"""
_FI = f"""{_BASE}, {_RP},
f0 AS (SELECT protocol, contract || '/' || doc_id || '/text' AS file, contract, 'f' || doc_id AS function, class_id, accepted AND passed AS detected, score, doc_id * 100 + rank AS ordinal, confidence < 0.05 AS parse_failed, inconsistent FROM de),
l0 AS (SELECT d.source AS protocol, '/' || l.doc_id || '/' AS file_contains, '\\' || l.doc_id || '\\' AS raw_contains, 'f' || l.doc_id AS function, x.class_id, l.doc_id || ':' || x.class_id AS label_id FROM labels l JOIN documents d USING (doc_id)
  JOIN (VALUES ('R4'), ('R3')) x(class_id) ON (x.class_id = 'R4' AND toxic = 1) OR (x.class_id = 'R3' AND quality = 0)),
pd AS (SELECT DISTINCT source AS protocol, substr(source, 4)::INT AS k FROM documents WHERE source IS NOT NULL),
pt AS (SELECT protocol, k, CASE WHEN k % 4 = 0 THEN 'control' ELSE 'study' END AS tier, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 1 THEN 'pure' ELSE 'partial' END AS algorithmic FROM pd)"""


def _eval_sql(findings: str, labels: str) -> str:
    return f"""{_FI}, f AS ({findings}), lab AS ({labels}),
m AS (SELECT l.g, l.label_id, l.protocol, l.raw_contains, l.function, l.class_id, arg_min(f.file, f.ordinal) AS hit FROM lab l LEFT JOIN f ON f.g = l.g AND f.protocol = l.protocol AND f.function = l.function AND f.class_id = l.class_id AND contains(lower(f.file), lower(l.file_contains)) GROUP BY ALL),
tr AS (SELECT DISTINCT g, protocol, coalesce(hit, raw_contains) AS file, function, class_id FROM m),
k AS (SELECT g, protocol, file, function, class_id, bool_or(p) AS p, bool_or(c) AS c, bool_or(t) AS t FROM (SELECT g, protocol, file, function, class_id, detected AS p, true AS c, false AS t FROM f UNION ALL SELECT g, protocol, file, function, class_id, false, false, true FROM tr) GROUP BY ALL)"""


_CELLS = "count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (c AND NOT p AND NOT t) AS tn"
_PRF = "round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1"
_PR = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS re"
_OV = f"""cc AS (SELECT g, {_CELLS}, count(*) FILTER (c) AS considered FROM k GROUP BY g), c2 AS (SELECT *, {_PR} FROM cc),
fr AS (SELECT g, count(*) AS findings, count(*) FILTER (parse_failed) AS parse_failures, count(*) FILTER (inconsistent) AS contradictions FROM f GROUP BY g),
lr AS (SELECT g, count(*) AS labels, count(hit) AS labels_matched, count(*) - count(DISTINCT (protocol, raw_contains, function, class_id)) AS labels_duplicated FROM m GROUP BY g),
ov AS (SELECT g, tp, fp, fn, tn, {_PRF}, round((tp + tn) / (considered + labels - labels_matched)::DOUBLE, 4) AS accuracy, findings, parse_failures, contradictions, 1 - (parse_failures + contradictions) / findings::DOUBLE AS cov, labels, labels_matched, labels_duplicated, labels - labels_matched AS labels_unretrieved
  FROM (SELECT g, tp, fp, fn, tn, pr, re, considered, coalesce(findings, 0) AS findings, coalesce(parse_failures, 0) AS parse_failures, coalesce(contradictions, 0) AS contradictions, coalesce(labels, 0) AS labels, coalesce(labels_matched, 0) AS labels_matched, coalesce(labels_duplicated, 0) AS labels_duplicated FROM c2 LEFT JOIN fr USING (g) LEFT JOIN lr USING (g)))"""
_ALL = _eval_sql("SELECT 1 AS g, * FROM f0", "SELECT 1 AS g, * FROM l0")
_LY = "(SELECT protocol, CASE WHEN tier = 'control' THEN 'control' ELSE coalesce(algorithmic, 'none') END AS g FROM pt UNION ALL SELECT protocol, 'study_combined' FROM pt WHERE tier = 'study')"
_RUN = "SELECT 'static' AS g, * FROM f0 UNION ALL SELECT 'retrieval', * REPLACE (true AS detected) FROM f0"
_OVC = "tp, fp, fn, tn, precision, recall, f1, accuracy, findings, parse_failures, contradictions, round(cov, 4) AS coverage, round(f1 * cov, 4) AS effective_f1, labels, labels_matched, labels_duplicated, labels_unretrieved"
_PC = f"SELECT class_id, tp, fp, fn, {_PRF} FROM (SELECT *, {_PR} FROM (SELECT class_id, {_CELLS} FROM k GROUP BY class_id))"
_SHOW = "CASE WHEN coalesce({0}, 0) = 0 THEN '0.00' WHEN {0} < 0.01 THEN '<0.01' WHEN {0} < 0.1 THEN printf('%.3f', {0}) ELSE printf('%.2f', {0}) END AS {0}"
_DIM = "(VALUES " + ", ".join(f"('{r.id}', '{r.severity}', '{r.layer}', {repr(r.mitigation) if r.mitigation else 'NULL'})" for r in RULES) + ") kb(class_id, severity, layer, mitigation)"
_LAST = [f"SELECT '{r.id}' AS class_id, " + ", ".join(f"count(*) FILTER (k % 4 = {i})::BIGINT AS {f}" if {f, "all"} & set(r.applies_to) else f"0::BIGINT AS {f}" for i, f in enumerate(FAMILIES)) + " FROM pt WHERE tier = 'study'" for r in RULES]

QUERIES = {
    f.__name__: f
    for f in (
        retrieve_topk, retrieve_many_terms, rule_confirm, guard_capture, static_baseline, mock_detect, critic_gate, evaluation_overall, per_class_prf, ranked_metrics, layered_eval, run_compare, control_fp,
        run_summary, label_path_match, bootstrap_f1, recommendations, applicability_matrix, corpus_share, token_budget, slice_id, callees, exclude_filter, stride_sample, line_to_span,
        analyser_map, loo_exemplars, class_table, json_repair, strip_comments, normalize_identifiers, function_slices, lateral_slices,
    )
}
ORACLE_SQL = {
    "retrieve_topk": f"WITH {_BASE} SELECT doc_id, class_id, score, rank FROM rk UNION ALL SELECT doc_id, 'R2', 0.0::DOUBLE, 1 + (SELECT count(*) FROM rk WHERE rk.doc_id = t.doc_id) FROM t WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.doc_id = t.doc_id AND rk.class_id = 'R2')",
    "retrieve_many_terms": f"""WITH y AS (SELECT {list(SYLLABLES)!r} AS s), k AS (SELECT range AS k FROM range({MANY})),
        g AS (SELECT 'G' || lpad((k // 10)::VARCHAR, 4, '0') AS class_id, s[k % 20 + 1] || s[k // 20 % 20 + 1] || s[k // 400 % 20 + 1] || s[k // 8000 + 1] AS term FROM k, y),
        d AS MATERIALIZED (SELECT doc_id, lower(text) AS low FROM documents),
        h AS (SELECT doc_id, class_id, count(*) / sqrt(10.0::DOUBLE) AS score FROM d, g WHERE contains(low, term) GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class_id) AS rank FROM h) WHERE rank <= 4""",
    "rule_confirm": f"WITH {_BASE} SELECT doc_id, class_id, passed, reason, guards FROM v",
    "guard_capture": f"WITH {_T} SELECT doc_id, 'R5' AS class_id, array_to_string(regexp_extract_all(body, '(ge[a-z]+)', 1), '|') AS captured FROM t UNION ALL SELECT doc_id, 'R10', array_to_string(regexp_extract_all(body, '([0-9]{{3,}})', 1), '|') FROM t",
    "static_baseline": f"WITH {_BASE} SELECT doc_id, class_id, passed AS detected, passed::INT::DOUBLE AS confidence, passed::INT::DOUBLE AS score FROM rk",
    "mock_detect": f"WITH {_BASE}, {_RP} SELECT doc_id, class_id, confidence, passed AS detected, round(confidence * 18 / 30 * CASE WHEN passed THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END, 4) AS score FROM rp",
    "critic_gate": f"WITH {_BASE}, {_RP} SELECT doc_id, class_id, inconsistent, accepted, accepted AND passed AS detected, score FROM de",
    "evaluation_overall": f"WITH {_ALL}, {_OV} SELECT {_OVC} FROM ov",
    "per_class_prf": f"WITH {_ALL} {_PC}",
    "ranked_metrics": f"""WITH {_ALL}, x AS (SELECT f.*, tr.file IS NOT NULL AS t, row_number() OVER (PARTITION BY f.protocol, f.file, f.contract ORDER BY score DESC, ordinal) AS pos FROM f LEFT JOIN tr USING (protocol, file, function, class_id)),
        u AS (SELECT min(pos) AS place FROM x WHERE t GROUP BY protocol, file, contract)
        SELECT coalesce(round(avg((place <= 1)::INT), 4), 0) AS top_1, coalesce(round(avg((place <= 3)::INT), 4), 0) AS top_3, coalesce(round(avg((place <= 5)::INT), 4), 0) AS top_5, coalesce(round(avg(1.0::DOUBLE / place), 4), 0) AS mrr, count(*) AS units FROM u""",
    "layered_eval": f"WITH {_eval_sql(f'SELECT y.g, f0.* FROM f0 JOIN {_LY} y USING (protocol)', f'SELECT y.g, l0.* FROM l0 JOIN {_LY} y USING (protocol)')}, {_OV} SELECT g AS layer, {_OVC} FROM ov WHERE g <> 'none'",
    "run_compare": f"WITH {_eval_sql(_RUN, "SELECT r.g, l0.* FROM l0, (VALUES ('static'), ('retrieval')) r(g)")}, {_OV} SELECT g AS run, tp, fp, fn, tn, precision, recall, f1, round(f1 * cov, 4) AS effective_f1, NULL::VARCHAR AS error FROM ov UNION ALL SELECT 'absent', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not run'",
    "control_fp": f"WITH {_FI}, f AS ({_RUN}) SELECT g AS run, count(*) AS control_fp FROM f WHERE detected AND protocol IN (SELECT protocol FROM pt WHERE tier = 'control') AND NOT EXISTS (SELECT 1 FROM l0 WHERE l0.protocol = f.protocol AND l0.function = f.function AND l0.class_id = f.class_id) GROUP BY g",
    "run_summary": f"WITH {_FI}, f AS ({_RUN}) SELECT g AS run, count(*) AS pairs, count(*) FILTER (detected) AS detected, count(*) FILTER (parse_failed) AS parse_failures, count(*) FILTER (inconsistent) AS contradictions FROM f GROUP BY g",
    "label_path_match": f"WITH {_ALL} SELECT label_id, hit AS file, hit IS NOT NULL AS retrieved FROM m",
    "recommendations": f"WITH {_FI}, s AS (SELECT f0.*, severity, mitigation, row_number() OVER (PARTITION BY class_id ORDER BY score DESC, ordinal) AS place, count(*) OVER (PARTITION BY class_id) AS sites FROM f0 JOIN {_DIM} USING (class_id) WHERE detected AND mitigation IS NOT NULL) SELECT class_id, severity, mitigation, place, protocol, function, score, sites FROM s WHERE place <= 25",
    "applicability_matrix": f"WITH {_FI} {' UNION ALL '.join(_LAST)}",
    "corpus_share": f"WITH {_T} SELECT protocol, count(*) AS slices, sum(length(body) - length(replace(body, chr(10), '')) + 1)::BIGINT AS lines, sum(greatest(1, length(body) // 4))::BIGINT AS tokens, round(count(*) / (SELECT count(*) FROM t)::DOUBLE, 4) AS share FROM t GROUP BY protocol",
    "token_budget": f"WITH {_T} SELECT doc_id, (length(body) - length(replace(body, chr(10), '')) + 1)::BIGINT AS n_lines, greatest(1, length(body) // 4)::BIGINT AS tokens, CASE WHEN length(body) // 4 > 500 THEN 2018 ELSE length(body) END::BIGINT AS kept_chars FROM t",
    "slice_id": "SELECT doc_id, substr(sha256(concat_ws(':', source, lang || '.txt', lang, 'f()', doc_id)), 1, 16) AS id FROM documents",
    "bootstrap_f1": f"""WITH {_ALL}, x AS (SELECT coalesce(f.detected, false) AS d, tr.file IS NOT NULL AS t FROM f LEFT JOIN tr USING (protocol, file, function, class_id)),
        q AS (SELECT count(*) FILTER (d AND t) AS tp, count(*) FILTER (d AND NOT t) AS fp, count(*) FILTER (NOT d AND t) + (SELECT count(*) FROM m WHERE hit IS NULL) AS fn, count(*) FILTER (NOT d AND NOT t) AS tn FROM x),
        w AS (SELECT *, tp + fp + fn + tn AS n FROM q),
        z AS (SELECT i.range AS i, tp, fp, fn, ({bits_sql(0, "i.range", "j.range")} * n) >> 32 AS unit FROM w, range(2000) i, range((SELECT n FROM w)) j),
        b AS (SELECT i, count(*) FILTER (unit < tp) AS a, count(*) FILTER (unit >= tp AND unit < tp + fp) AS b, count(*) FILTER (unit >= tp + fp AND unit < tp + fp + fn) AS c FROM z GROUP BY i),
        l AS (SELECT list(s ORDER BY s) AS l FROM (SELECT CASE WHEN a = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * a / (2 * a + b + c), 4) END AS s FROM b))
        SELECT CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) END AS f1, l[51] AS lo, l[1951] AS hi, n, 2000::INTEGER AS iterations FROM w, l""",
    "callees": r"SELECT page_id, coalesce((SELECT string_agg(c, ',' ORDER BY k) FROM (SELECT unnest(n) AS c, generate_subscripts(n, 1) AS k FROM (SELECT regexp_extract_all(coalesce(html, ''), '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS n)) WHERE c NOT IN (" + ", ".join(f"'{w}'" for w in T.RESERVED) + ")), '') AS callees FROM pages",
    "exclude_filter": "SELECT * FROM (SELECT doc_id, concat_ws('/', source, lang, 'Doc' || doc_id || '.txt') AS file, strlen(text)::BIGINT AS n_bytes FROM documents) WHERE n_bytes BETWEEN 1 AND 2000 AND NOT contains('/' || lower(file), '/src1/') AND NOT contains('/' || lower(file), '/src2/') AND NOT contains(lower(file), '/doc7')",
    "stride_sample": "WITH x AS (SELECT source AS protocol, lang AS file, doc_id AS start_line, doc_id AS id, row_number() OVER (ORDER BY source, lang, doc_id) - 1 AS r, greatest(1, count(*) OVER () // 60) AS s, count(*) OVER () AS n FROM documents) SELECT protocol, file, start_line, id FROM x WHERE n <= 60 OR (r % s = 0 AND r // s < 60) OR id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "line_to_span": "WITH e AS (SELECT doc_id AS entry_id, source AS file, k AS pos, CASE k WHEN 0 THEN doc_id * 7 ELSE doc_id + 3 END AS line FROM documents, (VALUES (0), (1)) v(k)), h AS (SELECT entry_id, arg_min('f' || d.doc_id, pos * 10000000000 + d.doc_id) AS function FROM e JOIN documents d ON d.source = e.file AND line BETWEEN d.doc_id AND d.doc_id + 9 GROUP BY entry_id) SELECT doc_id AS entry_id, function FROM documents LEFT JOIN h ON h.entry_id = doc_id",
    "analyser_map": f"WITH {_BASE} SELECT rk.doc_id AS id, class_id, coalesce((class_id = 'R4' AND toxic = 1) OR (class_id = 'R3' AND quality = 0), false) AS detected FROM rk LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)",
    "loo_exemplars": f"""WITH {_FI}, ng AS (SELECT class_id, protocol, 'f' || doc_id AS signature, row_number() OVER (PARTITION BY class_id ORDER BY protocol, contract, doc_id) AS k FROM rk
          WHERE rank = 1 AND NOT passed AND n >= 120 AND protocol IN (SELECT protocol FROM pt WHERE tier = 'control') AND NOT EXISTS (SELECT 1 FROM l0 WHERE l0.protocol = rk.protocol AND l0.function = 'f' || rk.doc_id)),
        po AS (SELECT 'positive' AS kind, class_id, protocol, function AS signature FROM l0 UNION ALL SELECT 'negative', class_id, protocol, signature FROM ng WHERE k = 1),
        o AS (SELECT pt.protocol AS target_protocol, kb.class_id AS target_class, po.*, row_number() OVER (PARTITION BY pt.protocol, kb.class_id, kind ORDER BY po.class_id <> kb.class_id, po.class_id, po.protocol, signature) AS k FROM pt, {_DIM}, po WHERE po.protocol <> pt.protocol)
        SELECT target_protocol, target_class, kind, class_id, protocol, signature FROM o WHERE k = 1""",
    "class_table": f"WITH {_ALL}, s AS ({_PC}) SELECT class_id, severity, layer, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, {', '.join(_SHOW.format(c) for c in ('precision', 'recall', 'f1'))} FROM {_DIM} LEFT JOIN s USING (class_id)",
    "json_repair": """SELECT conv_id, turn, coalesce(text, '') || ' a } and a " in text' AS why, turn::BIGINT AS told FROM conversations""",
    "strip_comments": r"""WITH p AS (SELECT page_id, regexp_replace(coalesce(html, ''), '[\r\n"\\]', ' ', 'g') AS s, replace(regexp_replace(coalesce(html, ''), '\r', '', 'g'), '*/', '') AS b FROM pages) SELECT page_id, 'f();' || chr(10) || '"' || s || '";' || CASE WHEN contains(b, chr(10)) THEN repeat(chr(10), (length(b) - length(replace(b, chr(10), '')))::INT) || ' g(a / b);' ELSE '  g(a / b);' END AS code FROM p""",
    "normalize_identifiers": r"""WITH p AS (SELECT page_id, regexp_replace(coalesce(html, ''), '[^\x00-\x7F]', ' ', 'g') AS t FROM pages) SELECT page_id, len(list_filter(list_distinct(regexp_extract_all(t, '\b[A-Za-z_][A-Za-z0-9_]{2,}\b')), lambda n: n NOT IN (""" + ", ".join(f"'{w}'" for w in T.RESERVED) + r""")))::BIGINT AS names, md5(regexp_replace(t, '\b[A-Za-z_][A-Za-z0-9_]{2,}\b', 'N', 'g')) AS around FROM p""",
    "lateral_slices": r"""WITH p AS (SELECT page_id, page_id % 3 AS k, page_id % 2 = 0 AS bench, page_id::VARCHAR AS i, regexp_replace(coalesce(html, ''), '[\r\n]', ' ', 'g') AS flat, regexp_replace(coalesce(html, ''), '[\r\n"\\]', ' ', 'g') AS txt FROM pages),
        r AS (SELECT *, CASE k WHEN 0 THEN '  function pay' || i || '(address to) public only' || i || ' {' WHEN 1 THEN 'func (k Keeper) Pay' || i || '(to string) error {' ELSE '@Callable(i)' || chr(10) || 'func pay' || i || '(to: String) = {' END || chr(10)
          || CASE WHEN k = 2 THEN '' ELSE CASE WHEN bench THEN '' ELSE CASE k WHEN 0 THEN '    // } ' ELSE chr(9) || '// } ' END || flat END || chr(10) END
          || CASE k WHEN 0 THEN '    note("{' || txt || '");' || chr(10) || '    send(to, rate);' || chr(10) || '  }' WHEN 1 THEN chr(9) || 'note("{' || txt || '")' || chr(10) || chr(9) || 'return nil' || chr(10) || '}' ELSE '  let x = "{' || txt || '"' || chr(10) || '  [StringEntry("to", x)]' || chr(10) || '}' END AS code FROM p),
        c AS (SELECT *, CASE WHEN greatest(1, length(code) // 4) > 500 THEN code[1:2000] || chr(10) || '// ...[truncated]' ELSE code END AS cut,
          CASE k WHEN 0 THEN '  function pay' || i || '(address to) public only' || i || ' {' || chr(10) || '    // } ' || flat || chr(10) || '    note("{' || txt || '");' || chr(10) || '    send(to, rate);' || chr(10) || '  }'
            WHEN 1 THEN 'func (k Keeper) Pay' || i || '(to string) error {' || chr(10) || chr(9) || '// } ' || flat || chr(10) || chr(9) || 'note("{' || txt || '")' || chr(10) || chr(9) || 'return nil' || chr(10) || '}' ELSE code END AS raw FROM r),
        n AS (SELECT *, list_filter(regexp_extract_all(raw, '\b([A-Za-z_][0-9A-Za-z_]*)\s*\(', 1), lambda x: x NOT IN (@RESERVED@))[1:40] AS calls FROM c)
        SELECT 'p' || i || CASE k WHEN 0 THEN '.sol' WHEN 1 THEN '.go' ELSE '.ride' END AS file, CASE WHEN bench THEN 'benchmark' ELSE 'study' END AS tier, CASE WHEN k = 0 THEN 'C' || i ELSE 'p' || i END AS contract,
          CASE k WHEN 0 THEN 'pay' || i || '(address to)' WHEN 1 THEN 'Pay' || i || '(to string)' ELSE 'pay' || i || '(to: String)' END AS signature, CASE k WHEN 0 THEN 6 ELSE 3 END::BIGINT AS start_line, CASE k WHEN 0 THEN 10 WHEN 1 THEN 7 ELSE 7 END::BIGINT AS end_line,
          cut AS code, CASE WHEN k = 0 THEN 'uint256 public rate = 0;' ELSE '' END AS state_vars, CASE WHEN k = 0 THEN 'modifier only' || i || '() { require(rate > 0); _; }' ELSE '' END AS modifiers,
          array_to_string(calls, ',') AS callees, greatest(1, length(cut) // 4)::BIGINT AS approx_tokens, CASE WHEN k = 0 THEN '^0.8.0' ELSE '' END AS solc_version FROM n""".replace("@RESERVED@", ", ".join(f"'{w}'" for w in T.RESERVED)),
    "function_slices": r"""SELECT 'c' || page_id || '.sol' AS file, 'C' || page_id AS contract, 'pay' || page_id AS function, 'pay' || page_id || '(address to)' AS signature, 5::BIGINT AS start_line, 9::BIGINT AS end_line, 'uint256 public rate = 0;' AS state_vars, '' AS modifiers, (length('  function pay' || page_id || '(address to) public onlyOwner {') + 10 + 8 + length(coalesce(html, '')) * 2 + 3 + 4 + 24)::BIGINT AS n_chars, '^0.8.0' AS solc_version FROM pages""",
}
