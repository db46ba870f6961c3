"""op3: what expectation-maximisation estimates, against votes drawn with known accuracies and against labels."""

import numpy as np

from riskspan.llm import quality_rules as q


def drawn(rng, n, share, bad, abstain=0.1):
    kind = rng.choice(len(share), n, p=share)
    votes = np.where(rng.random((n, len(bad))) < bad[:, kind].T, 0, 1)
    votes[rng.random(votes.shape) < abstain] = 2
    return kind, votes


def test_known_accuracies_are_recovered():
    rng = np.random.default_rng(4)
    share = np.array([0.7, 0.1, 0.1, 0.06, 0.04])
    bad = rng.uniform(0.01, 0.15, (len(q.RULES), 5))
    for k, rules in enumerate(q.KINDS.values()):
        for r in rules:
            bad[q.RULES.index(r), k + 1] = rng.uniform(0.75, 0.95)
    bad[q.RULES.index("open_lines"), 0] = 0.3  # a rule that often accuses good documents
    kind, votes = drawn(rng, 60_000, share, bad)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = q.fit(patterns, counts.astype(float))
    true = np.stack([1 - bad[:, 0], bad[:, 1:] @ share[1:] / share[1:].sum()], axis=1)
    assert np.abs(model.accuracy() - true).max() < 0.03
    assert np.abs(model.share - share).max() < 0.02
    good = q.responsibility(votes, model)[:, 0] >= 0.5
    best = q.responsibility(votes, q.Fit(share, bad))[:, 0] >= 0.5  # what knowing the true rates gives
    assert (good == best).mean() > 0.98
    passed, clean = ~(votes == 0).any(1), kind == 0
    assert (good == clean).mean() > (passed == clean).mean() + 0.2  # all-must-pass drops most good documents here


def test_empty_table_and_certain_votes():
    model = q.fit(np.empty((0, len(q.RULES)), np.int64), np.empty(0))
    assert np.isfinite(model.bad).all() and q.responsibility(np.empty((0, len(q.RULES)), np.int64), model).shape == (0, 5)


def test_posterior_replaces_all_must_pass(spark):
    """A lone bad vote can be outvoted, and labelled documents come out as labelled."""
    sf_dir = "/root/testdata/sf0.1"
    judged = q.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",)).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = judged.merge(labels, on="doc_id")
    assert not both.kept[both.quality == 0].any()
    assert both.kept[(both.quality == 1) & ~both.base_failed].all()
    votes = q.statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]).select("doc_id", *[v.alias(r) for r, v in q.votes().items()]).toPandas()
    votes = votes.merge(judged, on="doc_id")
    passed = ~votes.base_failed & ~(votes[list(q.RULES)] == 0).any(axis=1)
    assert (passed & ~votes.kept).sum() == 0 and (votes.kept & ~passed).sum() > 0
