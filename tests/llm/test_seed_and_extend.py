"""op10 against plain counting: extension both ways, large groups and hot anchors."""

import hashlib
import random

import numpy as np
import pytest

from riskspan.llm import substrings


def brute(rows, k=substrings.LENGTH):
    first = {}
    for i, text in rows:
        words = (text or "").split()
        for p in range(len(words) - k + 1):
            key = tuple(words[p : p + k])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in rows:
        words = (text or "").split()
        gone = {p + j for p in range(len(words) - k + 1) if first[tuple(words[p : p + k])] < i for j in range(k)}
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def passages(seed, n=150):
    """Texts of a small vocabulary that quote pieces of each other, and of one passage that most of them hold."""
    rng = random.Random(seed)
    hot = [f"h{rng.randrange(30)}" for _ in range(40)]
    texts = []
    for _ in range(n):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            source = rng.choice([*texts, hot, hot])
            a = rng.randrange(max(1, len(source)))
            piece = source[a : a + rng.choice([8, 12, 13, 14, 20, 30])]
            p = rng.randrange(len(words) + 1)
            words[p:p] = piece
        texts.append(words)
    return [(i + 1, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("group, hot", [(5_000, 2_000), (4, 50), (4, 10**9)])
def test_repeats_equal_plain_counting(spark, monkeypatch, group, hot):
    """Groups extended together, groups above the bound, and hot anchors give the same words."""
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = passages(group) + [(1000, None), (1001, "")]
    out = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == brute(rows)


def test_extension_stops_where_the_words_differ():
    """A seed of two documents: three equal words before it, six after it; no window of thirteen fits before the sixth."""
    a, b = list(range(10, 31)), list(range(10, 31))
    b[4], b[19] = 99, 98
    words = np.array(a + b, np.uint32)
    out = substrings.extend(np.array([7, 7]), np.array([1, 2]), np.array([8, 8]), words, np.array([0, 21, 42]))
    assert out[0].sum() == 0 and np.flatnonzero(out[1]).tolist() == [2, 3]
    doc, at, n = substrings.maximal(out, np.array([1, 2]), np.array([100, 200]), np.array([8, 8]))
    assert (doc.tolist(), at.tolist(), n.tolist()) == ([2], [205], [14])


def test_words_that_share_half_a_hash_stay_apart(spark):
    """Words whose 64-bit hashes agree in 32 bits, in texts that repeat no window of thirteen words."""
    tokens = [f"tok{i}" for i in range(600_000)]
    data = " ".join(tokens).encode()
    hashes = substrings.scan_words(data, np.array([0, len(data)]))[3]
    rng, rows = random.Random(1), []
    for shift in (0, 32):
        half = (hashes >> np.uint64(shift)).astype(np.uint32)
        order = np.argsort(half, kind="stable")
        same = np.flatnonzero(half[order][1:] == half[order][:-1])[:20]
        assert len(same) == 20
        for k, at in enumerate(same):
            around = [f"{shift}-{k}-{rng.randrange(10**9)}" for _ in range(20)]
            for word in (tokens[order[at]], tokens[order[at + 1]]):
                rows += [(len(rows) + 1, " ".join([*around[:6], word, *around[6:12]])), (len(rows) + 2, " ".join([*around[:8], word, *around[8:]]))]
    out = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == brute(rows)
