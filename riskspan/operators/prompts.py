"""Prompts of the two reviewers, as columns: an auditor looks at one function for one class, a critic at the auditor's finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import Rule

# Heads that the sections of a prompt are found by.
CODE_HEAD, CLASS_HEAD = "## FUNCTION UNDER AUDIT", "## VULNERABILITY CLASS"
#: Layers whose findings are judged as defects of the code, not of the design.
IMPLEMENTATION = ("implementation",)
AUDITOR = "You audit one function of a stablecoin protocol for one class of vulnerability. Justify a finding by a line of the code. Answer with one JSON object and nothing else."
CRITIC = {
    "implementation": 'You are an adversarial reviewer of code defects. Try to refute the finding. Score "correctness", "severity" and "profitability" from 0 to 10, give a verdict (confirmed or rejected) and a rebuttal, as one JSON object.',
    "design": 'You are an adversarial reviewer of economic designs. Try to refute the finding by its incentives. Score "correctness", "severity" and "profitability" from 0 to 10, give a verdict (confirmed or rejected) and a rebuttal, as one JSON object.',
}
# How much of an exemplar, and of an auditor's lists, a prompt shows.
EXEMPLAR_CHARS, MOST_VARIABLES, MOST_STATEMENTS, MOST_HINTS = 900, 8, 4, 6


def _line(text: str) -> str:
    return text.replace("\n", " ")


def _by_class(rules: list[Rule], value) -> Column:
    """value(rule) for the row's class_id; empty for unknown classes."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.id, value(r))]), F.col("class_id")), F.lit(""))


def exemplar_block(exemplars: Column) -> Column:
    """Worked examples (kind, class_id, signature, code, verdict) in front of the task; nothing without any."""
    one = lambda e: F.concat(
        F.lit("### "), e["kind"], F.lit(" example: "), e["class_id"], F.lit(" in "), e["signature"], F.lit("\n"), F.substring(e["code"], 1, EXEMPLAR_CHARS), F.lit("\nanswer: "), e["verdict"], F.lit("\n")
    )
    return F.when(F.size(exemplars) > 0, F.concat(F.lit("## WORKED EXAMPLES\n"), F.array_join(F.transform(exemplars, one), "\n"), F.lit("\n"))).otherwise("")


def auditor_prompt(rules: list[Rule], code: str = "code", analyser: str | None = None, exemplars: str | None = None, scaffold: bool = False) -> Column:
    """The auditor's prompt for a row with protocol, contract, signature, solc_version, context, class_id and the code.

    `scaffold` adds what only the offline stand-in reads: the row's passed, and the class's first terms. A model never sees it.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    hits = F.coalesce(F.nullif(F.array_join(F.col(analyser), ", "), F.lit("")), F.lit("none")) if analyser else F.lit("none")
    hint = F.concat(F.lit("\nstatic_precheck: "), F.coalesce(F.col("passed"), F.lit(False)).cast("string"), F.lit("\nmust_call_hint: "), _by_class(rules, lambda r: ",".join(r.must_call[:MOST_HINTS]))) if scaffold else F.lit("")
    return F.concat(
        F.lit("## TARGET\nprotocol: "), text("protocol"), F.lit("   contract: "), text("contract"), F.lit("\nfunction: "), text("signature"),
        F.lit("   compiler: "), F.coalesce(F.nullif(F.col("solc_version"), F.lit("")), F.lit("unknown")),
        F.lit(f"\n\n{CODE_HEAD}\n"), text(code), F.lit("\n\n## CONTEXT\n"), text("context"), F.lit("\n\n## STATIC ANALYSIS SIGNALS\n"), hits,
        F.lit(f"\n\n{CLASS_HEAD}\nid: "), text("class_id"), F.lit("\ntitle: "), _by_class(rules, lambda r: r.title), F.lit("\nscenario: "), _by_class(rules, lambda r: _line(r.scenario)),
        F.lit("\nproperty: "), _by_class(rules, lambda r: _line(r.property)), hint, F.lit("\n\n"), exemplar_block(F.col(exemplars)) if exemplars else F.lit(""),
        F.lit("## TASK\nDecide whether the function implements the scenario and whether it has the property; name variables, statements and a path to profit."),
    )


def rubric_of(rules: list[Rule]) -> Column:
    return _by_class(rules, lambda r: "implementation" if r.layer in IMPLEMENTATION else "design")


def critic_system(rules: list[Rule]) -> Column:
    return F.when(rubric_of(rules) == "implementation", CRITIC["implementation"]).otherwise(CRITIC["design"])


def critic_prompt(rules: list[Rule], code: str = "code") -> Column:
    """The critic's prompt for a row with class_id, the code and the auditor's key_variables, vulnerable_statements and attack_path."""
    joined = lambda c, n, by: F.array_join(F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, n), by)
    return F.concat(
        F.lit(f"{CODE_HEAD}\n"), F.coalesce(F.col(code), F.lit("")), F.lit("\n\n## FINDING\nid: "), F.col("class_id"), F.lit("\ntitle: "), _by_class(rules, lambda r: r.title), F.lit("\nlayer: "), _by_class(rules, lambda r: r.layer),
        F.lit("\nproperty: "), _by_class(rules, lambda r: _line(r.property)), F.lit("\nvariables: "), joined("key_variables", MOST_VARIABLES, ", "), F.lit("\nstatements: "), joined("vulnerable_statements", MOST_STATEMENTS, " | "),
        F.lit("\npath: "), F.coalesce(F.col("attack_path"), F.lit("")),
    )


def with_exemplars(pairs: DataFrame, chosen: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds to pairs (protocol, class_id) the exemplars chosen for them (tables.exemplars()) with the pool's code and verdict."""
    full = chosen.join(pool.select("kind", "class_id", "protocol", "signature", "code", "verdict").dropDuplicates(["kind", "class_id", "protocol", "signature"]), ["kind", "class_id", "protocol", "signature"])
    entry = F.struct("kind", "class_id", "signature", F.substring("code", 1, EXEMPLAR_CHARS).alias("code"), "verdict")
    lists = full.groupBy("target_protocol", "target_class").agg(F.sort_array(F.collect_list(entry), asc=False).alias("exemplars"))  # at most one of each kind
    lists = lists.withColumnsRenamed({"target_protocol": "_p", "target_class": "_c"})
    return pairs.join(lists, (F.col("protocol") == F.col("_p")) & (F.col("class_id") == F.col("_c")), "left").drop("_p", "_c")
