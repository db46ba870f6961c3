"""Scalar functions on code and model replies. Columns in, columns out; Arrow UDFs only where a scan needs state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import RESERVED, declared, renamed, repaired, without_remarks


def norm_path(path: Column) -> Column:
    """Lower case, with forward slashes."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def path_contains(path: Column, fragment: Column) -> Column:
    return F.contains(norm_path(path), norm_path(fragment))


def tokens_of(code: Column) -> Column:
    """About four characters to a token, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(code) / 4)).cast("bigint")


def lines_of(code: Column) -> Column:
    return (F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def callees(code: Column, most: int = 40) -> Column:
    """Names followed by a bracket in order, without reserved words; repeats stay."""
    names = F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    return F.slice(F.filter(names, lambda n: ~n.isin(RESERVED)), 1, most)


def slice_id(protocol: Column, path: Column, contract: Column, signature: Column, offset: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the five parts, joined by colons. The offset counts characters."""
    return F.substring(F.sha2(F.concat_ws(":", protocol, path, contract, signature, offset.cast("string")), 256), 1, 16)


def prompt_key(provider: Column, system: Column, user: Column, temperature: Column) -> Column:
    return F.sha2(F.concat_ws("|", provider, system, user, temperature.cast("string")), 256)


def is_commit(ref: Column) -> Column:
    """Whether a ref is a commit (7 to 40 hex digits) rather than a branch."""
    return F.coalesce(F.lower(ref).rlike("^[0-9a-f]{7,40}$"), F.lit(False))


def cut(code: Column, max_tokens: int = 4_000) -> Column:
    """Code over the token budget, cut to it and marked."""
    over = tokens_of(code) > max_tokens
    return F.when(over, F.concat(F.substring(code, 1, max_tokens * 4), F.lit("\n// ...[truncated]"))).otherwise(code)


def prompt_context(state: Column, modifiers: Column, called: Column) -> Column:
    """What a prompt says around a slice: state, modifiers and the first 25 distinct callees in order, each under its head."""
    names = F.array_join(F.slice(F.array_sort(F.array_distinct(called)), 1, 25), ", ")
    # The heads.
    heads = (("// state variables\n", state), ("// modifiers\n", modifiers), ("// callees: ", names))
    parts = F.array_compact(F.array(*[F.when(F.length(x) > 0, F.concat(F.lit(head), x)) for head, x in heads]))
    return F.when(F.size(parts) == 0, "(none extracted)").otherwise(F.array_join(parts, "\n\n"))


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes, in hex."""
    return F.sha2(content, 256)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, with each invalid sequence replaced; null and no bytes: empty."""
    return F.coalesce(F.make_valid_utf8(content.cast("string")), F.lit(""))


def first_line(code: Column, most: int = 120) -> Column:
    """The first line of the text without blanks around it, cut; empty if there is none."""
    return F.substring(F.element_at(F.split(F.trim(F.regexp_replace(code, r"^\s+|\s+$", "")), r"\r\n|\r|\n"), 1), 1, most)


def section(document: Column, head: str) -> Column:
    """What stands between a head and the next line that starts with "## "; empty without the head."""
    at = F.locate(head, document)
    rest = F.substring(document, at + len(head), F.length(document))
    stop = F.locate("\n## ", rest)
    return F.when(at == 0, "").when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest)


def extracted(document: Column, pattern: str, default: str = "") -> Column:
    """Group 1 of the pattern's first match, with ^ and $ at lines; the default without one."""
    return F.when(document.rlike(f"(?m){pattern}"), F.regexp_extract(document, f"(?m){pattern}", 1)).otherwise(default)


#: Fields that a reply may hold, with their types.
REPLY = "vuln_id string, scenario_match boolean, property_match boolean, confidence double, key_variables array<string>, vulnerable_statements array<string>, attack_path string, severity string, correctness double, profitability double, verdict string, rebuttal string"


def reply_fields(reply: Column) -> Column:
    """The repaired reply as typed fields; null without an object. Missing fields are null, wrong types too."""
    return F.from_json(reply, REPLY)


def fixed(x: Column, digits: int = 3) -> Column:
    """A number with so many digits, rounded from its exact binary value (0.5385 is below the tie, so 0.538); null stays null.

    The JVM's own formats round the shortest decimal form instead. Meant for the few rows of a report.
    """

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}").astype(object)

    return F.pandas_udf(run, "string")(x.cast("double"))


def show_score(x: Column) -> Column:
    """A score for a table: 0.00, <0.01, three digits below 0.1, else two."""
    return F.when(x == 0, "0.00").when(x < 0.01, "<0.01").when(x < 0.1, fixed(x, 3)).otherwise(fixed(x, 2))


def _row_by_row(scan: Callable[[str], str | None], code: Column) -> Column:
    """A plain scan of each text, in Arrow batches; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else scan(t))

    return F.pandas_udf(run, "string")(code)


def strip_comments(code: Column) -> Column:
    """Code without // and /* */ comments; strings, line count and everything else stay, trailing blanks go."""
    return _row_by_row(without_remarks, code)


def normalize_identifiers(code: Column) -> Column:
    return _row_by_row(renamed, code)


def declared_name(statement: Column) -> Column:
    return _row_by_row(declared, statement)


def repair_json(reply: Column) -> Column:
    return _row_by_row(repaired, reply)
