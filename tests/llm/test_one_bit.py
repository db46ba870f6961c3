"""One-bit codes: estimates, bounds, and the search against brute force."""

import math

import numpy as np

from riskspan.llm import one_bit as O


def _brute(rows, k, every):
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for q, a in kept.items():
        if q % every == 0:
            near = sorted((-np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)), i) for i, b in kept.items() if i != q and len(a) == len(b))
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(near[:k])]
    return out


def _found(spark, rows, k=5, every=10):
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, code int")
    out = {}
    for r in O.search(df, k, every).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_odd_vectors_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(12)]) for i in range(300)]
    rows += [(500 + i, [1.0] * 12) for i in range(30)]  # ties: smaller ids first
    rows += [(700, None), (710, []), (720, [0.0] * 12), (730, [1.0, None] * 6), (740, [float("nan")] * 12), (750, [float("inf")] * 12), (None, [1.0] * 12)]
    rows += [(760, [2.0, 1.0, 3.0]), (761, [2.0, 1.0, 3.5]), (770, [1.0])]  # other lengths: two of one kind, one alone
    rows += [(10, rows[10][1]), (20, [9.0] * 12)]  # a repeated row; a second vector of an id
    got, want = _found(spark, rows), _brute(rows, 5, 10)
    want = {q: near for q, near in want.items() if near}
    assert got.keys() == want.keys() and 770 not in got
    for q, near in want.items():
        assert [x[:2] for x in got[q]] == [x[:2] for x in near]
        assert np.allclose([x[2] for x in got[q]], [x[2] for x in near], rtol=0, atol=1e-12)


def test_nothing(spark):
    assert _found(spark, []) == {} and _found(spark, [(0, [1.0, 2.0])]) == {}


def test_recall_and_work_on_random_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 64))
    vectors = centres[rng.integers(0, 20, 3_000)] + 0.7 * rng.standard_normal((3_000, 64))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got, want = _found(spark, rows, 5, 50), _brute(rows, 5, 50)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))


def test_the_bound_holds_and_spares_most_vectors():
    rng = np.random.default_rng(9)
    data, asks = rng.standard_normal((4_000, 64)), rng.standard_normal((40, 64))
    code, factor = O.encode(data)
    assert code.shape == (4_000, 8)
    turned = O.turned_bytes(asks)
    at = code.T.astype(np.int64) + 256 * np.arange(8)[:, None]
    estimate = np.stack([O.lookup(t)[at].sum(axis=0) for t in turned]) / factor
    true = O.units(asks) @ O.units(data).T
    off = (estimate - true) / O.spread(factor, 64)
    assert 0.9 < off.std() < 1.1 and (np.abs(off) > O.BOUND).mean() < 1e-3
    fifth = np.sort(true, axis=1)[:, -5:-4]
    assert (estimate + O.BOUND * O.spread(factor, 64) >= fifth).mean() < 0.5
