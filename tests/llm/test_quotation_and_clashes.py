"""Quotation in op1, and extra columns named like results in the operators and in the pipeline's stages."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskspan.llm import crf, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text, inside",
    [
        ('"idiot" he said', True),
        ('He said "you idiot"', True),
        ('x "a" idiot "b" y', False),
        ("she wrote \u201csuch an idiot\u201d there", True),
        ("er sagt \u201eidiot\u201c dazu", True),
        ("\u00ab a \u00bb idiot \u00ab b \u00bb", False),
        ('"idiot\nnext line"', False),
        ("idiot", False),
    ],
)
def test_quotation(text, inside):
    f = toxicity.features(toxicity.Matcher(["idiot"]), pa.array(["other", text, None]))
    assert (f[1, toxicity.FEATURES.index("quoted")] > 0) == inside and f[1, 0] > 0 and not f[[0, 2]].any()


def test_columns_named_like_results(spark):
    names = ["label", "score", "contaminated", "n_words", "access", "markov", "exact", "quality", "hits", "kept"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    n = docs.count()
    assert toxicity.score(docs, labels).count() == crf.score(docs, labels).count() == n
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= n


def brute_marginals(emission, transition):
    """Sums over all labellings of one document."""
    n = len(emission)
    weight, good = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> k & 1 for k in range(n)]
        w = np.exp(sum(e for e, v in zip(emission, y) if v) + sum(transition[a, b] for a, b in zip(y, y[1:])))
        weight += w
        good += w * np.array(y)
    return good / weight, np.log(weight)


def test_marginals_equal_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    lengths = [3, 0, 1, 7, 5]
    first = np.concatenate(([0], np.cumsum(lengths)))
    emission, transition = rng.normal(size=first[-1]) * 2, rng.normal(size=(2, 2))
    good, pairs, log_z = crf.marginals(emission, transition, first)
    for i, n in enumerate(lengths):
        if n:
            want, z = brute_marginals(emission[first[i] : first[i + 1]], transition)
            assert np.allclose(good[first[i] : first[i + 1]], want) and np.isclose(log_z[i], z)
    assert np.allclose(pairs[1:3].sum((1, 2)), 1)
