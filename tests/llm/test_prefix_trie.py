"""The trie of rebuilt conversations against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from riskspan.llm import prefix_trie as T

COLUMNS = "conv_id long, turn long, role string, text string, depth string, n_convs long, w0 double"


def _brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    below = {p: [] for p in members}
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    kids = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in members}
    for p, cs in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(full[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], sum(kids[q] == 0 for q in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7, 0.5) for r in rows], COLUMNS)
    return sorted((tuple(r) for r in T.prefix_trie(df).collect()), key=str)


def test_mixed_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "héé", None, "long " * 3])) for c in [*range(0, 12), *range(100, 112), 250, 251, 300, 7_001] for t in range(rng.randrange(1, 7))]
    rows += [(400, None, "user", "null first"), (400, None, "user", "another"), (400, 5, None, None), (400, 5, None, None)]  # nulls, ties, repeated rows
    rows += [(None, 1, "user", "no conversation"), (401, 0, "user", "x" * 50_000)]  # no id, a very long text
    rows += [(c, t, "user", "copy") for c in range(500, 540) for t in range(8)]  # copies
    assert _found(spark, rows) == _brute(rows)


def test_a_conversation_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 4)
    monkeypatch.setattr(T, "BLOCK", 8)
    rows = [(c, t, "user", f"{t * t % 7}") for c in (0, 1, 2, 3, 50, 99) for t in range(30 + c % 3)]
    assert _found(spark, rows) == _brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")]])
def test_nothing(spark, rows):
    assert _found(spark, rows) == []
