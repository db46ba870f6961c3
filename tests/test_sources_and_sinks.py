"""Files, configuration, rule bases, labels, writers and report documents on small cases."""

import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from riskspan.functions import text as T
from riskspan.operators import reports, slicing
from riskspan.operators import rules as R
from riskspan.sinks import writers
from riskspan.sources import config, files
from riskspan.sources import series as src
from riskspan.sources import tables as st


def test_settings(tmp_path):
    assert config.read_yaml(str(tmp_path / "none.yaml")) == {}
    (tmp_path / "a.yaml").write_text("corpus: {max_file_bytes: 7}\n")
    settings = config.read_yaml(str(tmp_path / "a.yaml"))
    assert config.lookup(settings, "corpus.max_file_bytes") == 7
    assert config.lookup(settings, "corpus.nothing.more", "d") == "d" and config.lookup(settings, "corpus.max_file_bytes.x", 1) == 1


def test_protocol_dimension(spark):
    rows = [
        {"name": "a", "tier": "study", "algorithmic": "pure", "market": {"peg_target": "usd", "llama_start": 5}, "incident": {"date": "2022-05-09", "loss_usd": 1}},
        {"name": "b", "tier": "control", "market": None, "paths": ["x/*.sol"]},
        {"name": "c", "tier": "study", "market": {"peg_target": "eur"}, "extra": 1},
    ]
    p = config.protocols(spark, {"protocols": rows})
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(config.chosen(p, "primary")) == ["a", "c"] and names(config.chosen(p, None, ["none"])) == ["b", "c"]
    assert names(config.with_market(p)) == ["a", "c"] and names(config.with_market(p, True)) == ["a"]
    assert config.market_of(p, "a").first()["llama_start"] == 5 and config.market_of(p, "b").count() == 0
    assert names(config.unavailable(spark.createDataFrame([("a",), ("z",)], "name string"), p)) == ["z"]


def test_file_scan(spark, tmp_path):
    for path, content in {
        "src/A.sol": b"contract A {}\nok", "src/test/T.sol": b"t", "lib/deep/B.sol": b"\xff\xfe bad \xc3\xa9", "src/n.txt": b"text", "src/empty.sol": b"", "src/MockX.sol": b"m", "big.sol": b"x" * 50,
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    limits = {"exclude_dirs": ["/test/"], "exclude_names": ["mock"], "max_bytes": 40}
    got = lambda globs: sorted(r["file"] for r in files.scan(spark, str(tmp_path), globs, **limits).collect())
    assert got(["src/**/*.sol"]) == ["src/A.sol"] and got(["**/*.sol"]) == ["lib/deep/B.sol", "src/A.sol"]
    assert got(["nothing/*.go"]) == got([]) == ["lib/deep/B.sol", "src/A.sol"]  # no match: every source file
    rows = {r["file"]: r for r in files.measured(files.scan(spark, str(tmp_path), [], **limits)).collect()}
    assert rows["src/A.sol"]["n_lines"] == 2 and rows["lib/deep/B.sol"]["text"].endswith(" bad é") and "�" in rows["lib/deep/B.sol"]["text"]
    assert rows["lib/deep/B.sol"]["n_bytes"] == 9 and len(rows["src/A.sol"]["sha256"]) == 64
    out = files.corpus(spark, str(tmp_path), [{"name": "src", "language": "solidity"}, {"name": "missing"}], **limits)
    assert [(r["protocol"], r["file"], r["language"], r["tier"]) for r in out.collect()] == [("src", "A.sol", "solidity", "study")]
    assert files.corpus(spark, str(tmp_path), []).count() == 0


def test_stage_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="slice"):
        st.load_table(spark, str(tmp_path / "slices.json"), "id string", "slice")
    assert st.load_optional(spark, str(tmp_path / "slices.json"), "id string").count() == 0
    table = spark.createDataFrame([("b", 2.0, ["x"]), ("a", None, [])], "id string, score double, tags array<string>")
    assert writers.write_json_array(table, str(tmp_path / "t.json"), ["id"]) == 2
    assert json.loads((tmp_path / "t.json").read_text()) == [{"id": "a", "score": None, "tags": []}, {"id": "b", "score": 2.0, "tags": ["x"]}]
    back = st.load_table(spark, str(tmp_path / "t.json"), "id string, score double, tags array<string>", "slice")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()), key=str) or back.count() == 2
    writers.write_json(table, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2


RULES = """
V1:
  title: First
  scenario: " mints "
  property: no cap
  mitigation: M1
  static_checks: {must_call: [mint(], must_lack_patterns: ["only\\\\w+", "(open"], slither: [suicidal]}
  key_variables: [supply]
  retrieval_hints: [rebase]
V2: {title: Second, scenario: s, property: p, mitigation: M1, severity: high, applies_to: [rebase]}
"""


def test_rule_base(spark, tmp_path):
    (tmp_path / "v.yaml").write_text(RULES)
    (tmp_path / "m.yaml").write_text("M1: {for: V1, title: Cap, actions: [limit]}\n")
    with pytest.warns(UserWarning, match="left out"):
        rules, mitigations = st.rule_base(str(tmp_path / "v.yaml"), str(tmp_path / "m.yaml"))
    assert [(r.id, r.severity, r.applies_to, r.scenario) for r in rules] == [("V1", "medium", ("all",), "mints"), ("V2", "high", ("rebase",), "s")]
    assert rules[0].terms() == ["mint", "supply", "rebase"] and rules[0].must_lack_patterns == ("only\\w+",) and mitigations["M1"]["patch"] == ""
    (tmp_path / "m.yaml").write_text("M2: {for: V1, title: Cap}\n")
    with pytest.raises(ValueError, match="M1"), pytest.warns(UserWarning):
        st.rule_base(str(tmp_path / "v.yaml"), str(tmp_path / "m.yaml"))
    (tmp_path / "l.yaml").write_text("labels:\n- {protocol: p, file_contains: a, function: f, vuln_id: V1}\n")
    assert [tuple(r)[:5] for r in st.labels(spark, str(tmp_path / "l.yaml")).collect()] == [(0, "p", "a", "f", "V1")]
    assert st.labels(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "h.json").write_text('[{"name": "x", "amount": 3}]')
    assert st.incidents(spark, str(tmp_path / "h.json")).first()["amount"] == 3


def test_confirmation_by_hand(spark):
    """Verdicts worked out by hand: hits keep their order, patterns are marked, an analyser's silence does not gate."""
    rule = R.Rule("V1", must_call=("mint(", "burn("), must_call_patterns=("set\\w+Rate",), must_lack=("onlyOwner",), must_lack_patterns=("require\\s*\\(",), must_have=("supply",), captures=("(\\d+) days",), checks=("suicidal", "timestamp"))
    rows = [
        (1, "function f() { BURN(x); setMintRate(1); supply = 2; wait(3 days, 14 days); }", ["timestamp", "other"]),
        (2, "function f() onlyowner { require (a); mint(b); }", []),
        (3, "nothing", None),
    ]
    df = R.confirm(spark.createDataFrame([(i, c, a, "V1") for i, c, a in rows], "id int, code string, told array<string>, class_id string"), [rule], "code", "told")
    one, two, three = df.orderBy("id").collect()
    assert one["passed"] and one["reason"] == "all static conditions satisfied" and one["captured"] == ["3", "14"]
    assert one["hits"] == {"must_call_hits": ["burn(", "re:set\\w+Rate"], "guards_present": [], "must_have_hits": ["supply"], "numbers": ["3", "14"], "slither_hits": ["timestamp"]}
    assert one["checks"] == {"must_call": True, "must_lack": True, "must_have": True, "slither": True}
    assert not two["passed"] and two["reason"] == "guard present: onlyOwner, re:require\\s*\\(; required feature not found"
    assert two["checks"] == {"must_call": True, "must_lack": False, "must_have": False, "slither": False}
    assert three["reason"] == "no scenario call pattern found; required feature not found" and "slither" not in three["checks"]
    empty = R.confirm(spark.createDataFrame([(None, "V9"), ("x", "none")], "code string, class_id string"), [R.Rule("V9")], "code").orderBy(F.col("class_id").desc()).collect()
    assert (empty[1]["passed"], empty[1]["reason"]) == (True, "all static conditions satisfied") and empty[0]["passed"] is None


def test_slices_know_state_and_modifiers(spark):
    code = (
        "pragma solidity ^0.8.1;\ncontract Bank {\n  uint256 public rate = 2;\n  address owner;\n  mapping(address => uint256) balances;\n"
        "  modifier guarded() {\n    require(msg.sender == owner);\n    _;\n  }\n"
        "  function pay(address to, uint256 n) public guarded returns (bool) {\n    balances[to] += n * rate;\n    return true; // done, all of it\n  }\n}\n"
        "interface I {\n  function only(uint a) external;\n}\nlibrary L {\n  function low(uint a) internal {\n    helper(a); helper(a); helper(a); helper(a); helper(a);\n  }\n}\n"
    )
    df = spark.createDataFrame([("p", "study", "solidity", "b.sol", code)], "protocol string, tier string, language string, file string, text string")
    pay, low = slicing.function_slices(df).orderBy("start_line").collect()
    assert (pay["contract"], pay["signature"], pay["start_line"], pay["end_line"]) == ("Bank", "pay(address to, uint256 n)", 10, 13)
    assert pay["state_vars"] == "uint256 public rate = 2;\nmapping(address => uint256) balances;"
    assert pay["modifiers"].startswith("modifier guarded() {") and pay["modifiers"].endswith("}") and pay["solc_version"] == "^0.8.1"
    assert low["contract"] == "L" and low["state_vars"] == "" and low["callees"] == ["low"] + ["helper"] * 5
    assert "id000" in pay["normalized_code"] and pay["n_chars"] == len(pay["code"])


def test_report_documents(spark, tmp_path):
    rows = spark.createDataFrame([("b_1", "50%", 'say "x", y'), ("a", None, "plain")], "name string, share string, note string")
    t = writers.ReportTable("t2_corpus", "What is in it", {"name": "Name", "share": "Share %", "note": "Note"}, rows, ("name",))
    assert t.markdown() == '| Name | Share % | Note |\n|---|---|---|\n| a | None | plain |\n| b_1 | 50% | say "x", y |'
    assert t.latex().split("\n")[3:8] == ["\\begin{tabular}{lll}", "\\hline", "Name & Share % & Note \\\\", "\\hline", "a & None & plain \\\\"] and "b\\_1 & 50\\% &" in t.latex()
    assert list(csv.reader(io.StringIO(t.csv()))) == [["Name", "Share %", "Note"], ["a", "", "plain"], ["b_1", "50%", 'say "x", y']]
    t.write(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t2_corpus.csv", "t2_corpus.md", "t2_corpus.tex"]
    other = writers.ReportTable("t10_layers", "Layers", {"name": "N"}, rows, ("name",))
    page = writers.report([other, t], ["mock"], ["a note"])
    assert page.index("## Table 2 — What is in it") < page.index("## Table 10 — Layers") and "not a language model" in page and page.endswith("> a note")
    assert writers.trace_document({"Slice": "code  ", "Verdict": True}).count("=" * 78) == 4


def test_prevention_document(spark):
    sites = [(c, f"t{c}", "A1", "M1", "fix", ["do"], "p;", "pr", "f.sol", i, f"f{i}", 0.5385 if i == 0 else i / 100, i) for c, n in (("V2", 3), ("V10", 30)) for i in range(n)]
    df = spark.createDataFrame(sites, "class_id string, title string, category string, mitigation string, mitigation_title string, actions array<string>, patch string, protocol string, file string, line int, function string, score double, ordinal int")
    page = writers.prevention_document(df, 0.25)
    assert page.index("## V10") < page.index("## V2") and "Affected sites (30)" in page and "- ...and 5 more" in page and "**0.250**" in page
    assert page.count("(score ") == 28 and "(score 0.538)" in page


def test_orders_and_lookups(spark):
    slices = spark.createDataFrame([("1", "p", "b.sol", "f", 5, "study"), ("2", "p", "a.sol", "g", 9, "study"), ("3", "q", "a.sol", "g", 1, "benchmark")], "id string, protocol string, file string, function string, start_line int, tier string")
    labels = spark.createDataFrame([(0, "q", "A.SOL", "g"), (1, "p", "b", "f"), (2, "p", "b.sol", "f")], "ordinal long, protocol string, file_contains string, function string")
    pick = lambda **k: [r["id"] for r in reports.pick(slices, labels, **k).collect()]
    assert pick() == ["3"] and pick(protocol="p") == ["2"] and pick(function="g") == ["2"] and pick(id="1") == ["1"] and pick(id="9") == []
    assert [r["id"] for r in reports.pick(slices, labels.limit(0)).collect()] == ["2"]
    assert sorted((r["id"], r["ordinal"]) for r in reports.labelled(slices, labels).collect()) == [("1", 1), ("3", 0)]
    assert reports.in_scope(slices).count() == 2 and reports.in_scope(slices, ["q"]).count() == 1
    assert [r["class_id"] for r in reports.classes(spark, [R.Rule("V10"), R.Rule("V2")]).collect()] == ["V2", "V10"]


def test_kline_archives_and_series_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "m1.zip", "w") as z:
        z.writestr("m1.csv", "open_time,o,h,l,close\n1650000000000,1,1,1,0.99\n1.65000006e12,1,1,1,0.98\nbad,1,1,1,x\n1650000000000,1,1,1,0.97\n")
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    lines = src.read_kline_archives(spark, str(tmp_path))
    assert sorted((r["ts"], r["value"]) for r in src.parse_klines(lines, "s").collect()) == [(1650000000, 0.97), (1650000060, 0.98)]
    demo = src.synthetic_minutes(spark, days=1)
    assert demo.count() == 1440 and demo.agg(F.min("value")).first()[0] < 0.8 < 0.99 < demo.agg(F.max("value")).first()[0]
    assert demo.collect() == src.synthetic_minutes(spark, days=1).collect()


def test_display_rounds_the_binary_value(spark):
    df = spark.createDataFrame([(0.5385,), (0.0625,), (None,), (0.0074,)], "x double")
    assert [r[0] for r in df.select(T.fixed(F.col("x"), 3)).collect()] == ["0.538", "0.062", None, "0.007"]
    assert [r[0] for r in df.select(T.show_score(F.col("x"))).collect()] == ["0.54", "0.062", None, "<0.01"]
