"""Scans, slicing, decisions and evaluation on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from riskspan.functions import scan
from riskspan.functions import text as T
from riskspan.operators import evaluate as E
from riskspan.operators import rules as R
from riskspan.operators import slicing, tables


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("a();\n// gone\n/* also\n gone */\nb();", "a();\n\n\n\nb();"),
        ('s = "https://x.y"; // note', 's = "https://x.y";'),
        (r's = "a \" // kept"; // gone', r's = "a \" // kept";'),
        ("x = a / b; y = c / d;", "x = a / b; y = c / d;"),
        ("f(); /* never closed\n", "f();\n"),
        ("'open // string", "'open // string"),
        ("", ""),
    ],
)
def test_comments_go_and_lines_stay(code, want):
    assert scan.without_remarks(code) == want


@pytest.mark.parametrize(
    ("statement", "name"),
    [("uint256 public rate = 0;", "rate"), ("mapping(address => uint256) balances;", "balances"), ("mapping(address => uint) public b = x == y;", "b"), ("12;", "")],
)
def test_declared_names(statement, name):
    assert scan.declared(statement) == name


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('Notes {x} {"a": 1} then {"a": 2, "b": "}"}', {"a": 2, "b": "}"}),
        ('{"a": 1} and {"b": 2}', {"a": 1}),
        ("[1, 2]", None),
        ("no object", None),
        ("", None),
        (None, None),
    ],
)
def test_replies_are_repaired(reply, want):
    got = scan.repaired(reply)
    assert (json.loads(got) if got else None) == want


def test_renaming_is_by_first_appearance():
    assert scan.renamed("foo(bar, foo); if x1 _a return zed") == "id000(id001, id000); if x1 _a return id002"


def test_slices_of_each_language(spark):
    go = "package x\nfunc (k Keeper) Get(a int) int {\n return other(a) + 1111111111111111111111111111111111111111\n}\n"
    ride = "@Callable(i)\nfunc pay(a: Int) = {\n let x = invoke(a)\n 12345678901234567890123456789012345678901234567890\n}\n"
    files = [("p", "study", "go", "d/keep.go", go), ("p", "study", "ride", "r.ride", ride), ("p", "study", "vyper", "v.vy", "def f(): pass"), ("p", "study", "go", "n.go", None), ("p", "study", "go", "e.go", "")]
    rows = slicing.function_slices(spark.createDataFrame(files, "protocol string, tier string, language string, file string, text string")).collect()
    assert sorted((r.contract, r.signature, r.start_line, r.end_line, r.callees) for r in rows) == [("keep", "Get(a int)", 2, 4, ["Get", "other"]), ("r", "pay(a: Int)", 1, 5, ["Callable", "pay", "invoke"])]


def test_benchmark_slices_lose_comments(spark):
    code = "contract C {\n function f(uint a) public {\n  // ACCESS\n  require(msg.sender == owner, 'x'); done(a); done(a);\n }\n}"
    files = [(t, t, "solidity", "c.sol", code) for t in ("benchmark", "study")]
    rows = {r.tier: r for r in slicing.function_slices(spark.createDataFrame(files, "protocol string, tier string, language string, file string, text string")).collect()}
    assert "ACCESS" not in rows["benchmark"].code and "ACCESS" in rows["study"].code
    assert rows["benchmark"].end_line == rows["study"].end_line == 5


def test_critic_gate(spark):
    cases = [(1.0, True, "confirmed", 7, 6, 5), (1.0, True, "confirmed", 4, 6, 5), (1.0, True, "rejected", 7, 6, 5), (1.0, False, "confirmed", 10, 10, 10), (None, None, None, None, None, None)]
    df = spark.createDataFrame(cases, "confidence double, passed boolean, verdict string, correctness int, profitability int, severity_score int")
    got = [tuple(r) for r in R.decide(df).select("inconsistent", "accepted", "detected", "score").collect()]
    assert got == [(False, True, True, 0.6), (True, False, False, 0.5), (True, False, False, 0.6), (False, True, False, 0.35), (False, False, False, 0.0)]


def _tables(spark, findings, labels):
    f = spark.createDataFrame(findings, "protocol string, file string, contract string, function string, class_id string, detected boolean, score double, ordinal bigint, parse_failed boolean, inconsistent boolean")
    return f, spark.createDataFrame(labels, "label_id string, protocol string, file_contains string, function string, class_id string")


def test_missed_labels_count(spark):
    f, lab = _tables(spark, [("p", "src/A.sol", "A", "f", "V1", True, 0.9, 1, False, False), ("p", "src/A.sol", "A", "g", "V1", True, 0.95, 2, False, True)], [("1", "p", "a.SOL", "f", "V1"), ("2", "p", "b", "h", "V2")])
    r = E.overall(f, lab).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.recall, r.labels_unretrieved, r.coverage) == (1, 1, 1, 0, 0.5, 1, 0.5)
    k = E.ranked(f, lab).first()
    assert (k.top_1, k.top_3, k.mrr, k.units) == (0.0, 1.0, 0.5, 1)
    b = E.bootstrap_f1(f, lab, 200).first()
    assert b.f1 == 0.5 and b.lo <= b.f1 <= b.hi and b.n == 3


def test_evaluation_of_nothing(spark):
    f, lab = _tables(spark, [], [])
    r = E.overall(f, lab).first()
    assert (r.tp, r.fp, r.fn, r.f1, r.findings, r.coverage) == (0, 0, 0, 0.0, 0, 0.0)
    assert E.bootstrap_f1(f, lab, 10).first().n == 0
    assert E.ranked(f, lab).first().units == 0


def test_cells_add_up(spark):
    rows = [("p", "a", "a", f"f{i}", "V1", i % 3 == 0, i / 100, i, False, False) for i in range(30)]
    f, lab = _tables(spark, rows, [(str(i), "p", "a", f"f{i}", "V1") for i in range(0, 30, 2)])
    r = E.overall(f, lab).first()
    assert r.tp + r.fp + r.fn + r.tn == 30 and r.tp == 5


def test_small_functions(spark):
    row = spark.range(1).select(
        T.is_commit(F.lit("ABCDEF1")).alias("sha"), T.is_commit(F.lit("main")).alias("branch"), T.prompt_context(F.lit(""), F.lit(""), F.array().cast("array<string>")).alias("none"),
        T.prompt_context(F.lit("s"), F.lit(""), F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("some"), T.show_score(F.lit(0.004)).alias("low"), T.show_score(F.lit(0.05)).alias("mid"), T.show_score(F.lit(0.5)).alias("high"),
        T.path_contains(F.lit("A\\b/C.sol"), F.lit("a/B")).alias("path"),
    ).first()
    assert tuple(row) == (True, False, "(none extracted)", "// state variables\ns\n\n// callees: a, b", "<0.01", "0.050", "0.50", True)


def test_skips_cache_and_integrity(spark):
    p = spark.createDataFrame([("a", "usd", 5), ("b", "eur", 5), ("c", "usd", None), ("d", "usd", 0)], "protocol string, peg_target string, samples bigint")
    assert [r.reason for r in tables.skipped(p).orderBy("protocol").collect()] == [None, "peg is not the dollar", "no series", "empty series"]
    prompts = spark.createDataFrame([("k1", "x"), ("k1", "x"), ("k2", "y")], "key string, prompt string")
    assert [r.key for r in tables.uncached(prompts, spark.createDataFrame([("k2", "r")], "key string, reply string")).collect()] == ["k1"]
    classes = R.dimension(spark, [R.Rule("V1", mitigation="M1"), R.Rule("V2", mitigation="M9")])
    assert [r.class_id for r in R.without_mitigation(classes, spark.createDataFrame([("M1",)], "mitigation string")).collect()] == ["V2"]


def _rules(n):
    return [R.Rule(f"C{k:05d}", must_call=(f"call{k}(",), must_lack_patterns=(f"guard{k}\\b",), hints=(f"t{k}", "ab", "a long enough term of many characters")) for k in range(n)]


def test_a_large_rule_base_is_found_as_by_looking_for_every_term(spark):
    import random

    rng, base = random.Random(2), _rules(400)
    texts = [(i, " ".join(rng.choice([f"T{rng.randrange(500)}", f"call{rng.randrange(500)}(", "ab", "x", "a long enough term of many characters"]) for _ in range(rng.randrange(60)))) for i in range(80)] + [(90, None), (91, ""), (92, "ab" * 60_000)]
    df = spark.createDataFrame(texts, "i int, code string")
    want = []
    for i, text in texts:
        low = (text or "").lower()
        scores = [(sum(t in low for t in r.terms()) / len(r.terms()) ** 0.5, r.id) for r in base]
        want += [(i, c, s, k) for k, (s, c) in enumerate(sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1]))[:4], 1)]
    for most in (R.MOST_BYTES, 6_000):  # whole, and part by part
        got = [(r.i, r.class_id, r.score, r["rank"]) for r in R.retrieve(df, base, top_k=4, most_bytes=most).collect()]
        assert sorted(got) == sorted(want)
    one, parts = (sorted(map(str, R.confirm(R.retrieve(df, base), base, most_bytes=most).drop("code").collect())) for most in (R.MOST_BYTES, 6_000))
    assert one == parts and len(one) == len(want)


def test_the_plan_does_not_grow_with_the_rule_base(spark):
    df = spark.createDataFrame([(1, "x")], "i int, code string")
    size = [len(R.static_baseline(df, _rules(n))._jdf.queryExecution().optimizedPlan().toString()) for n in (3, 3_000)]
    assert abs(size[0] - size[1]) < 200


def test_slices_by_lateral_join(spark):
    slicing.register(spark)
    text = "contract C {\n  modifier only() { require(x); _; }\n  function f(uint a) only { // why\n    g(a); " + "x; " * 40 + "}\n}\n"
    files = spark.createDataFrame([("p", "benchmark", "solidity", "c.sol", text), ("p", "study", None, "n.txt", text), ("p", None, None, None, None)], "protocol string, tier string, language string, file string, text string")
    cut = "SELECT f.file, s.* FROM {files} f, LATERAL slice_functions(protocol, tier, language, f.file, text, @, 60) s"
    whole = spark.sql(cut.replace("@", "4000"), files=files).collect()
    same = slicing.function_slices(files).collect()
    assert [(r.id, r.code, r.modifiers, r.callees) for r in whole] == [(r.id, r.code, r.modifiers, r.callees) for r in same] and len(whole) == 1
    assert "why" not in whole[0].code and whole[0].modifiers.startswith("modifier only()")
    assert spark.sql(cut.replace("@", "20"), files=files).first().code.endswith("\n// ...[truncated]")
    with pytest.raises(Exception, match="constant of at least 0"):
        spark.sql(cut.replace("@", "-1"), files=files)


def test_a_run_is_summed_up_with_its_texts_classes_and_provider_errors(spark):
    columns = "run string, protocol string, file string, contract string, function string, class_id string, detected boolean, parse_failed boolean, inconsistent boolean, provider_error string"
    rows = [
        ("a", "p", "x", None, "f", "R1", True, False, False, ""), ("a", "p", "x", None, "f", "R2", True, False, True, ""), ("a", "p", "y", "C", "f", "R1", True, False, False, ""),
        ("a", "p", "y", "C", "g", "R3", False, True, False, "HTTP 500"), (None, "q", "x", None, "f", "R2", None, None, None, None),
    ]
    found = spark.createDataFrame(rows, columns)
    got = {r["run"]: tuple(r)[1:] for r in E.run_summary(found, ["run"]).collect()}
    assert got == {"a": (3, 4, 3, [("R1", 2), ("R2", 1)], 1, 1, 1), None: (1, 1, 0, [], 0, 0, 0)}
    assert [tuple(r) for r in E.run_summary(found).collect()] == [(4, 5, 3, [("R1", 2), ("R2", 1)], 1, 1, 1)]
    assert [tuple(r) for r in E.run_summary(found.drop("provider_error").limit(0)).collect()] == [(0, 0, 0, [], 0, 0, 0)]
    assert E.run_summary(found).columns == ["texts", "pairs", "detected", "by_class", "parse_failures", "provider_errors", "contradictions"]
