"""Secret scans, with DataFrame functions only.

Base patterns find assignments, access keys and long hexadecimal runs. Two character Markov models, of random strings and of
ordinary identifiers, then compare the log-likelihood of every token of eight characters or more: a ratio above the threshold
for its length is a secret too.
The models are tables of character pairs, counted from labelled samples and read as literals by an expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

# The base patterns, whose failing matches are dropped by the lengths below.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Tokens that the models compare: at least 8 characters, of whatever kinds.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}"
KINDS = ("assign", "access", "hex", "markov")
#: Evidence above which a token counts as random: bits per character pair, and bits in all. The second is what outweighs the
#: odds of one secret in a million tokens, so short tokens need more bits per pair than long ones.
THRESHOLD = 0.75
BITS = 20.0
#: Documents whose words, and matched secrets, join the labelled samples, at most, unless the caller says otherwise.
SAMPLE = 2_000
#: Alphabets of keys, tokens and digests.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (DIGITS + "abcdef", LOWER + DIGITS, UPPER + DIGITS, LOWER + UPPER, LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS + "_-")
#: Random strings that are drawn for the samples, and numbers, dates and short numbered names each.
DRAWN = 8_000
_CODES = 128


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, zero: int, step) -> Column:
    """What `step` makes, from `zero`, of all values before each one: a list as long as `values`.

    `step` is associative. The list is cut into blocks of about the root of its length, so that appending to a growing list
    costs n ** 1.5 copies instead of n ** 2.
    """
    kind = "struct<at:int,out:array<int>>"

    def walk(block: Column, use) -> Column:
        start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out")).cast(kind)
        return F.aggregate(block, start, lambda acc, x: F.struct(step(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), use)

    def in_blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / w).cast("int") - 1), lambda i: F.slice(v, i * w + 1, w)))
        walked = F.transform(blocks, lambda block: walk(block, lambda acc: acc))
        return _let(walked, lambda bs: F.flatten(F.zip_with(bs, walk(F.transform(bs, lambda x: x["at"]), lambda acc: acc["out"]), lambda x, before: F.transform(x["out"], lambda at: step(before, at).cast("int")))))

    return _let(values, lambda v: F.when(F.size(v) > 0, in_blocks(v)).otherwise(F.array().cast("array<int>")))


_EMPTY = "array<struct<start:int,end:int,m:string>>"


def _spans(text: Column, pattern: str) -> Column:
    """start, end and match of every leftmost non-overlapping match, in code points: what lies between matches gives the places."""

    def placed(found: Column, between: Column) -> Column:
        skips = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("skip"), m.alias("m")))

        def with_starts(parts: Column) -> Column:
            before = _running(F.transform(parts, lambda x: x["skip"] + F.length(x["m"])), 0, lambda a, b: a + b)
            return F.zip_with(parts, before, lambda x, at: F.struct((at + x["skip"]).alias("start"), (at + x["skip"] + F.length(x["m"])).alias("end"), x["m"].alias("m")))

        return _let(skips, with_starts)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: placed(found, F.split(text, pattern, -1)))


def _value(match: Column) -> Column:
    """Group 2 of an assignment."""
    return F.regexp_extract(match, "(?s)" + PATTERNS["assign"], 2)


def base_spans(text: Column, kind: str) -> Column:
    """Matches of one base kind that are long enough. Texts without a possible match skip the scan for places."""
    size = {"assign": lambda m: F.length(_value(m)), "access": F.length, "hex": F.length}[kind]
    # Only a long enough run can pass, and dropped short runs do not move the others, so these two are matched with their least length.
    pattern = {"assign": PATTERNS["assign"], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}[kind]
    spans = F.filter(_spans(text, pattern), lambda s: size(s["m"]) >= LEAST[kind])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_EMPTY))


def _neighbours(token: Column, use) -> Column:
    """use(character, next character) for all neighbours of a token of ASCII characters, as codes; a start mark of code 0 comes first."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) % _CODES)
    return _let(codes, lambda c: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(c, 1, F.size(c) - 1)), c, use))


def _pairs(samples: DataFrame) -> DataFrame:
    """Counts of neighbouring characters by label, as codes below _CODES, in the column token."""
    pairs = _neighbours(F.col("token"), lambda a, b: a * _CODES + b)
    return samples.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio, in bits, of each character pair: random strings against ordinary identifiers.

    `labelled` has token (at least one character) and random (boolean). Additive smoothing of one half over 64 characters. The
    result is a table of _CODES * _CODES numbers, whatever the sample. No sample of a kind: uniform for that kind.
    """
    rows = _pairs(labelled.where(F.length("token") > 0)).collect()  # at most 2 * _CODES * _CODES
    counts = {kind: {r["pair"]: r["count"] for r in rows if r["random"] == kind} for kind in (True, False)}
    totals = {k: {} for k in counts}
    for k, c in counts.items():
        for pair, n in c.items():
            totals[k][pair // _CODES] = totals[k].get(pair // _CODES, 0) + n
    out = []
    for pair in range(_CODES * _CODES):
        log = [math.log2((counts[k].get(pair, 0) + 0.5) / (totals[k].get(pair // _CODES, 0) + 32)) for k in (True, False)]
        out.append(log[0] - log[1])
    return out


def evidence(token: Column, ratios: list[float]) -> Column:
    """Mean bits per character pair that speak for a random string; tokens of ASCII characters, not empty."""
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal by the optimizer
    bits = _neighbours(token, lambda a, b: F.element_at(weights, a * _CODES + b + 1))
    return F.aggregate(bits, F.lit(0.0), lambda acc, x: acc + x) / F.length(token)


def _drawn(bound: Column | int, *of: Column | int) -> Column:
    """A number from 0 below `bound`, a function of what it is drawn for: every run and retry draws the same. Numbers are literals."""
    return F.pmod(F.xxhash64(*[x if isinstance(x, Column) else F.lit(x) for x in of]), bound if isinstance(bound, Column) else F.lit(bound))


def _string(alphabet: Column, size: Column, *of: Column | int) -> Column:
    """`size` characters of `alphabet`, drawn one by one."""
    one = lambda i: F.substring(alphabet, _drawn(F.length(alphabet), i, *of).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), one), "")


def random_strings(spark: SparkSession, many: int = DRAWN, seed: int = 1) -> DataFrame:
    """token: `many` random strings of 16 to 48 characters, of each of ALPHABETS in turn."""
    alphabet = F.element_at(F.array(*map(F.lit, ALPHABETS)), (F.col("id") % len(ALPHABETS) + 1).cast("int"))
    return spark.range(many).select(_string(alphabet, 16 + _drawn(33, F.col("id"), seed), F.col("id"), seed).alias("token"))


def _styles(words: Column, number: Column) -> list[Column]:
    """The identifiers that code makes of some lower-case words: snake, capitals, camel, path, kebab, numbered."""
    head, snake, pascal = F.element_at(words, 1), F.array_join(words, "_"), F.array_join(F.transform(words, F.initcap), "")
    camel = F.concat(head, F.substring(pascal, F.length(head) + 1, F.length(pascal)))
    return [snake, F.upper(snake), camel, pascal, F.array_join(words, "/"), F.array_join(words, "-"), F.concat_ws("_", snake, number), F.concat(head, number)]


def identifiers(spark: SparkSession, many: int = DRAWN) -> DataFrame:
    """token: distinct names and words of code, from the session's own settings, their explanations and its functions, then
    what the usual styles make of neighbouring words in these, and numbers, dates, short numbered names and runs of alphabets.

    A table of fixed size for one version of Spark; values that users set are not read.
    """
    told = spark.sql("SET -v").select(F.concat_ws(" ", "key", "meaning").alias("t")).unionByName(spark.sql("SHOW SYSTEM FUNCTIONS").select(F.col("function").alias("t")))
    names = told.select(F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9+/_-]{3,}"), F.lit(0))).alias("token"))
    words = told.select(F.regexp_extract_all(F.lower("t"), F.lit(r"[a-z]{2,}"), F.lit(0)).alias("w")).where(F.size("w") > 1)
    some = words.select("w", F.explode(F.sequence(F.lit(1), F.size("w") - 1, F.lit(3))).alias("i"))
    some = some.select(F.slice("w", F.col("i"), 2 + _drawn(3, F.col("i"), F.col("w"))).alias("w"), _drawn(F.pow(F.lit(10), 1 + _drawn(4, F.col("w"), F.col("i"))).cast("bigint"), F.col("i"), F.col("w")).cast("string").alias("n"))
    made = some.select(F.explode(F.array(*_styles(F.col("w"), F.col("n")))).alias("token"))
    two = lambda k, base, size: F.lpad((base + _drawn(size, F.col("id"), k)).cast("string"), 2, "0")
    date = F.concat((1970 + _drawn(70, F.col("id"), 1)).cast("string"), F.lit("-"), two(2, 1, 12), F.lit("-"), two(3, 1, 28), F.lit("/"), two(4, 0, 24), F.lit("-"), two(5, 0, 60))
    number = _string(F.lit(DIGITS), 8 + _drawn(12, F.col("id"), 6), F.col("id"), 7)
    cells = F.array_join(F.transform(F.sequence(F.lit(1), (2 + _drawn(2, F.col("id"), 8)).cast("int")), lambda i: F.concat(_string(F.lit(LOWER), F.lit(1), F.col("id"), i, 9), _string(F.lit(DIGITS), F.lit(1), F.col("id"), i, 10))), "")
    figures = spark.range(many).select(F.explode(F.array(date, number, F.when(F.col("id") % 4 == 0, cells))).alias("token")).where("token is not null")
    run = spark.range(26).select("id", F.explode(F.sequence(F.lit(8), F.lit(26))).alias("n"))  # places and lengths in an alphabet
    runs = run.select(F.explode(F.array(*[F.when(F.col("id") + F.col("n") <= len(a), F.substring(F.lit(a), (F.col("id") + 1).cast("int"), F.col("n").cast("int"))) for a in (LOWER, UPPER, DIGITS)])).alias("token")).where("token is not null")
    return names.unionByName(made).unionByName(figures).unionByName(runs).distinct()


def samples(docs: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Labelled samples (token, random): random strings and identifiers of code, values that the base patterns matched, and the
    distinct plain words of some documents without a match.

    Values have at least 16 characters (what follows "token:" in prose is a short word) and at most `sample` of them, the
    least by hash, are taken, so that one kind of key does not become the model. Plain words come from the documents of at
    most `sample` ids, the least by hash, so every run takes the same: ids are chosen first, from those under a hash cut that
    keeps about twice as many, and only their texts are read. Documents without an id are never among them. An empty table
    leaves the samples that need no documents.
    """
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    hit = text.rlike("|".join([PATTERNS["assign"], r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"]))
    matched = docs.where(hit).select(F.explode(F.concat(F.transform(base_spans(text, "assign"), lambda s: _value(s["m"])), *[F.transform(base_spans(text, k), lambda s: s["m"]) for k in ("access", "hex")])).alias("token"))
    matched = matched.where("length(token) >= 16").distinct().orderBy(F.xxhash64("token"), "token").limit(sample)
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(id_col).alias("_h")).distinct()
    n = ids.count()
    cut = ids.where(F.pmod("_h", F.lit(1 << 20)) < (1 << 20) * min(1.0, 2 * sample / max(1, n)))
    chosen = cut.orderBy("_h", "_id").limit(sample).select("_id")
    plain = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).where(~hit).select(text.alias("_t"))
    words = plain.select(F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(r"[A-Za-z0-9+/_-]{4,}"), F.lit(0)))).alias("token")).distinct()
    # Ordinary identifiers also hold digits: a word with a number, and words joined by a mark.
    joined = F.concat("token", F.lit("_"), F.lower("token"), F.pmod(F.xxhash64("token"), F.lit(1000)).cast("string"))
    ordinary = words.select(F.explode(F.array("token", joined)).alias("token")).unionByName(identifiers(spark))
    return matched.unionByName(random_strings(spark)).withColumn("random", F.lit(True)).unionByName(ordinary.withColumn("random", F.lit(False)))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span, by one walk along both in order: what ends last before a token, what starts first after it."""

    def alone(events: Column) -> Column:
        ends = _running(F.transform(events, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(F.lit(-1))), -1, F.greatest)
        back = F.reverse(events)
        starts = F.reverse(_running(F.transform(back, lambda e: F.when(e["own"] == 0, e["start"]).otherwise(F.lit(2**31 - 1))), 2**31 - 1, F.least))
        near = F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("before"), b.alias("after")))
        pairs = F.zip_with(events, near, lambda e, x: F.struct(e.alias("e"), x.alias("x")))
        free = F.filter(pairs, lambda p: (p["e"]["own"] == 1) & (p["x"]["before"] <= p["e"]["start"]) & (p["x"]["after"] >= p["e"]["end"]))
        return F.transform(free, lambda p: F.struct(p["e"]["start"].alias("start"), p["e"]["end"].alias("end"), p["e"]["m"].alias("m")))

    def event(own: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["m"].alias("m"))

    both = F.array_sort(F.concat(F.transform(base, event(0)), F.transform(tokens, event(1))))
    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(_let(both, alone))


def find(docs: DataFrame, ratios: list[float], keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, bits: float = BITS) -> DataFrame:
    """The `keep` columns and all spans of secrets: assign, access, hex, markov (arrays of start, end, match).

    Null and empty texts have none. Markov spans are tokens with evidence above `threshold` per character pair and `bits` in
    all that no base span overlaps. Only texts with such a token are searched for its place.
    Repeated rows are scanned each; an empty table gives an empty result. Work grows a little faster than the length of a text
    or token, never with its square. Kept columns named like a result would give two columns of that name.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], text.alias("_t"), *[base_spans(text, k).alias(k) for k in KINDS[:3]])

    def is_random(token: Column) -> Column:
        return evidence(token, ratios) > F.greatest(F.lit(threshold), bits / F.length(token))

    some = F.exists(F.array_distinct(F.regexp_extract_all("_t", F.lit(TOKEN), F.lit(0))), is_random)
    tokens = F.filter(_spans(F.col("_t"), TOKEN), lambda s: is_random(s["m"]))
    tokens = _let(tokens, lambda t: _apart(t, F.concat("assign", "access", "hex")))
    found = base.withColumn("markov", F.when(some, tokens).otherwise(F.array().cast(_EMPTY)))
    return found.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], *KINDS)


def _joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then by kind as listed."""
    def named(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("name")))

    every = F.concat(*[named(i, k) for i, k in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(every), lambda s: s["name"]), ",")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", sample: int = SAMPLE, labelled: DataFrame | None = None) -> DataFrame:
    """Spans of all documents, with models trained on `labelled` (token, random) or, without it, on samples(): see find()."""
    return find(docs, train(materialise(samples(docs, id_col, sample) if labelled is None else labelled, "secret-samples")), keep)


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with all spans (start, end) masked; spans that overlap or touch inside each other become one.

    The text is cut into chunks of about the root of its length, so that taking a piece never walks over the whole text.
    """

    def pieces(spans: Column, chunks: Column, width: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / width).cast("int")
            some = F.slice(chunks, first + 1, F.floor((b - 1) / width).cast("int") - first + 1)
            return F.when(b > a, F.substring(F.array_join(some, ""), a - first * width + 1, b - a)).otherwise(F.lit(""))

        reached = _running(F.transform(spans, lambda s: s["end"]), 0, F.greatest)
        heads = F.zip_with(spans, reached, lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.lit(mask))).otherwise(F.lit("")))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(heads, ""), _let(end, lambda e: piece(e, F.length(text))))

    width = F.greatest(F.lit(256), F.ceil(F.sqrt(F.length(text))).cast("int"))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / w).cast("int")), lambda i: F.substring(text, i * w + 1, w))
    return _let(spans, lambda s: _let(width, lambda w: _let(cut(w), lambda c: pieces(s, c, w))))


def redact(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", sample: int = SAMPLE, ratios: list[float] | None = None) -> DataFrame:
    """The documents with every secret span replaced by `mask`; overlapping spans become one. Columns and rows stay.

    Null and empty texts stay as they are, repeated rows are masked each, columns named like the kinds of spans are safe, and
    an empty table gives an empty result. Models are trained as in scan(), unless `ratios` of train() are given.
    """
    ratios = ratios or train(materialise(samples(docs, id_col, sample), "secret-samples"))
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*inner).withColumn("text", F.col(inner[docs.columns.index("text")]))
    found = find(renamed, ratios, (*inner, "text"))
    spans = F.array_sort(F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))
    many = F.size("assign") + F.size("access") + F.size("hex") + F.size("markov")
    masked = F.when(many > 0, _masked(F.col("text"), spans, mask)).otherwise(F.col("text"))
    return found.select(*[masked.alias(c) if c == "text" else F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *sizes, F.sha2(_joined(KINDS[:3]), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))


QUERIES = {"op2_secret_scans": op2}
ORACLE_SQL: dict[str, str] = {}
