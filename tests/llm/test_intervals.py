"""op9 by intervals: repeated words, maximal matches and several passes against plain comparison."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from riskspan.llm import decontam as D


def _located(texts, items, places, window=10):
    tests = D.TestSuffixes([i for i, _ in items], [t for _, t in items], window)
    hashes, first = D._words(pa.array(texts))
    return D.locate([SimpleNamespace(value=tests)], hashes, first, places), first


def test_one_repeated_word_costs_no_pairs():
    """20,000 words against 1,000 of the same word: 19.8 million pairs of places, one interval."""
    tracemalloc.start()
    (hit, items, _), _ = _located(["a " * 20_000, "b a a"], [("x", "a " * 1_000)], False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hit.sum() == 20_000 and items == {(0, "x")} and peak < 50 << 20
    (_, _, matches), _ = _located(["a " * 3_000], [("x", "a " * 100)], True)
    assert len(matches) == 3_000 - 10 + 1 + 100 - 10  # the diagonals, each one match


def _plain(texts, items, window):
    hit, named, matches = set(), set(), set()
    for r, text in enumerate(texts):
        w = text.split()
        for i, (name, item) in enumerate(items):
            t = item.split()
            m = min(window, len(t))
            for a in range(len(w) - m + 1 if m else 0):
                for b in range(len(t) - m + 1):
                    if w[a : a + m] == t[b : b + m]:
                        hit |= {(r, a + k) for k in range(m)}
                        named.add((r, name))
                        if a == 0 or b == 0 or w[a - 1] != t[b - 1]:
                            n = m
                            while a + n < len(w) and b + n < len(t) and w[a + n] == t[b + n]:
                                n += 1
                            matches.add((r, name, a, b, n))
    return hit, named, matches


@pytest.mark.parametrize("seed", range(6))
def test_maximal_matches_equal_plain_comparison(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    texts, items = [text(rng.randrange(40)) for _ in range(12)], [(f"i{k}", text(rng.choice([0, 1, 2, 3, 9, 15]))) for k in range(8)]
    (hit, named, matches), first = _located(texts, items, True, window=4)
    want = _plain(texts, items, 4)
    row_of = np.repeat(np.arange(len(texts)), np.diff(first))
    assert {(int(row_of[p]), int(p - first[row_of[p]])) for p in np.flatnonzero(hit)} == want[0]
    assert named == want[1] and sorted(matches) == sorted(want[2])


def test_passes_give_what_one_pass_gives(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(8)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(60)), "x") for k in range(80)], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame([(f"i{k}" if k % 5 else None, " ".join(rng.choice(words) for _ in range(rng.choice([2, 4, 12])))) for k in range(30)], "item_id string, text string")
    rows = [sorted(map(str, D.decontaminate(docs, items, ["doc_id"], 5, most, True).collect())) for most in (1 << 20, 60)]
    assert rows[0] == rows[1] and len(rows[0]) == 80
