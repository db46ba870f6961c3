"""Plain scans of one text, used inside tasks: comments, braces, identifiers, JSON objects. No Spark here."""

from __future__ import annotations

import json
import re

# Words that are never renamed and never count as called functions.
RESERVED = (
    "require assert revert if for while return emit function returns memory storage calldata public private internal external "
    "view pure payable uint uint256 int address bool bytes string mapping struct enum new this super msg block tx abi keccak256 type "
    "func var const package import range make len err nil true false let case match then else"
).split()

_QUOTED = r'"(?:\\.|[^"\\])*+(?:"|\\?\Z)' + "|" + r"'(?:\\.|[^'\\])*+(?:'|\\?\Z)"
_REMARK = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\*?\Z)"
_LEX = re.compile(f"(?P<quoted>{_QUOTED})|(?P<remark>{_REMARK})", re.S)
_BRACES = re.compile(f"(?:{_QUOTED})|(?:{_REMARK})|(?P<brace>[{{}}])", re.S)
_OBJECT_PARTS = re.compile(r'"(?:\\.|[^"\\])*+(?:"|\\?\Z)|(?P<brace>[{}])', re.S)
_NAME = re.compile(r"\b[A-Za-z_]\w{2,}\b")


def without_remarks(code: str) -> str:
    kept = _LEX.sub(lambda m: m[0] if m["quoted"] else "\n" * m[0].count("\n"), code)
    return "\n".join(line.rstrip() for line in kept.split("\n"))


def block_end(code: str, at: int) -> int:
    """Offset after the brace that closes the one at `at`; the end of the text if none does."""
    depth = 0
    for m in _BRACES.finditer(code, at):
        if m["brace"]:
            depth += 1 if m["brace"] == "{" else -1
            if depth == 0:
                return m.end()
    return len(code)


def renamed(code: str) -> str:
    """Identifiers of three or more characters become id000, id001 and so on by first appearance."""
    names = {w: w for w in RESERVED}
    return _NAME.sub(lambda m: names.setdefault(m[0], f"id{len(names) - len(RESERVED):03d}"), code)


def declared(statement: str) -> str:
    """Name that a state declaration declares: the last identifier before a top-level assignment; empty if none."""
    depth, head = 0, statement.strip().rstrip(";")
    for m in re.finditer(r"[(\[]|[)\]]|(?<![=!<>])=(?!>)", head):
        if m[0] == "=" and depth == 0:
            head = head[: m.start()]
            break
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(m[0], 0)
    return (re.findall(r"[A-Za-z_]\w*", head) or [""])[-1]


def _loads(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return _loads  # no JSON value at all


def repaired(reply: str | None) -> str | None:
    """The object in a model reply as JSON text; null if there is none.

    A reply that is JSON as a whole must be an object. Otherwise the balanced object with most keys counts, the first on ties.
    """
    body = (reply or "").strip()
    if body.startswith("```"):
        body = re.sub(r"\A```[A-Za-z]*\n?|```\s*\Z", "", body).strip()
    whole = _loads(body)
    if whole is not _loads:
        return json.dumps(whole, ensure_ascii=False) if isinstance(whole, dict) else None
    found, depth, begin = [], 0, 0
    for m in _OBJECT_PARTS.finditer(body):
        if m["brace"] == "{":
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif m["brace"] and depth:
            depth -= 1
            if depth == 0:
                value = _loads(body[begin : m.end()])
                if isinstance(value, dict):
                    found.append(value)
    return json.dumps(max(found, key=len), ensure_ascii=False) if found else None
