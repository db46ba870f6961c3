"""Ball-tree clustering against plain integer k-means."""

import hashlib
import math
import random

import numpy as np
import pytest

from riskspan.llm import centroids as C


def _brute(rows, k, rounds, dim):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(1024 * x) for x in v]
            if max(map(abs, q)) <= C.MOST:
                kept.append((i, q))
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centres = [q for _, q in first]
    if not centres:
        return []
    assign = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(assign(q)[1], []).append(q)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *assign(q)[::-1]) for i, q in kept]
    inertia = {n: sum(d for _, m, d in found if m == n) for n in range(len(centres))}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, n, d in found), key=str)


def _found(spark, rows, k, rounds, dim):
    df = spark.createDataFrame([(i, v, "c", 1.0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, sums double")
    return sorted((tuple(r) for r in C.cluster(df, k, rounds, dim).collect()), key=str)


def test_blobs_ties_copies_and_bad_vectors(spark):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(i % 5, 0.3) for _ in range(3)]) for i in range(700)]
    rows += [(1_000 + i, [2.0, 2.0, 2.0]) for i in range(150)]  # copies in many balls
    rows += [(5, [0.5, 0.25, -0.125]), (5, [0.5, 0.25, -0.125]), (None, [1.0, 1.0, 1.0])]  # repeated rows, no id
    rows += [(2_000, None), (2_001, []), (2_002, [1.0, 2.0]), (2_003, [1.0, None, 2.0]), (2_004, [1.0, float("nan"), 2.0]), (2_005, [float("inf"), 0.0, 0.0]), (2_006, [1e30, 0.0, 0.0])]
    assert _found(spark, rows, 6, 7, 3) == _brute(rows, 6, 7, 3)


@pytest.mark.parametrize("rows", [[], [(None, [1.0])], [(1, [1.0]), (2, [3.0])], [(i, [0.0]) for i in range(40)]])
def test_few_vectors(spark, rows):
    assert _found(spark, rows, 4, 3, 1) == _brute(rows, 4, 3, 1)


def test_filtering_is_exact_and_assigns_whole_balls():
    rng = np.random.default_rng(2)
    points = np.floor(1024 * (rng.standard_normal((4_000, 8)) * 0.2 + rng.integers(0, 4, (4_000, 1)))).astype(np.int64)
    order, *tree = C.build_tree(points)
    centres = points[rng.choice(len(points), 5, replace=False)]
    balls, to, loose, of = C.filter_tree(points[order], *tree, centres)
    want = C._squared(points[order], centres).argmin(axis=1)
    got = np.full(len(points), -1)
    for b, c in zip(balls, to):
        assert (got[tree[0][b] : tree[1][b]] == -1).all()
        got[tree[0][b] : tree[1][b]] = c
    got[loose] = of
    assert (got == want).all() and len(loose) < len(points) // 2
