import random

import numpy as np
import pyarrow as pa

from riskspan.llm import toxicity


def test_automaton_walks_stems_and_accented_terms():
    lexicon = toxicity.Lexicon(["bomente*", "réeuxment", "größe"])
    assert lexicon.match("bomxnteado") == ("bomente*", 1)
    assert lexicon.match("bomenteado") == ("bomente*", 0)
    assert lexicon.match("réxuxmxnt") == ("réeuxment", 2)
    assert lexicon.match("grösse") is None and lexicon.match("grüße") == ("größe", 1)
    assert lexicon.match("bomente") is None and lexicon.match("xbxmxnteado") is None


def test_no_match_is_lost_before_the_automaton():
    """Words picked by conditions hold every match of the automaton over random edits, letters of several bytes included."""
    rng = random.Random(3)
    terms = ["bomente*", "achlichung", "réeuxment", "größenwahn*", "ставленник", "ставле*", "éàüöß", "stupid", "disgusting"]
    words = set()
    for t in terms:
        for _ in range(400):
            w = list(t.rstrip("*"))
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
                p = rng.randrange(len(w))
                w[p : p + rng.randrange(2)] = rng.choice(["", "x", "é", "ш", "漢", "🙂"])
                w = w or ["x"]
            words.add("".join(w) + rng.choice(["", "", "ado", "ê"]) * t.endswith("*"))
    words = sorted(words)
    lexicon = toxicity.Lexicon(terms)
    hits = np.array([[(m := lexicon.match(w)) is not None and m[1] == 0, m is not None and m[1] > 0] for w in words])
    got = toxicity.features(toxicity.Matcher(terms), pa.array(words))[:, :2]
    assert hits.any(0).all() and not hits.any(1).all()
    assert ((got > 0) == hits).all()


def test_words_under_a_stem_stay_and_the_commonest_come_first(spark):
    forms = ["bomenteado", "bomentezar", "bomentelar"]
    rows = [(i, f"alpha{i} beta{i} " + (f"{forms[i % 3]} klomp" if i < 60 else "klompt other")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, label int")
    terms = toxicity.learn_terms(docs, sample)
    assert any(t.endswith("*") and forms[0].startswith(t[:-1]) for t in terms) and {*forms, "klomp"} <= set(terms)
    assert toxicity.learn_terms(docs, sample, most=2) == terms[:2] and "klomp" in terms[:2]


def test_scores_do_not_lean_with_the_bound_on_the_sample(spark):
    """A sample cut to as many clean as toxic documents gives the scores of the whole: one text in twenty is toxic, and one in four of those with a hit."""
    rows = [(i, f"they said idiot number{i}" if i % 10 < 2 else f"plain words number{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(600)], "doc_id long, toxic int")
    mean = {}
    for bound in (60, 2000):
        out = toxicity.score(docs, labels, sample=bound).collect()
        mean[bound] = sum(r["score"] for r in out) / len(out)
        assert abs(mean[bound] - 0.05) < 0.02
    assert abs(mean[60] - mean[2000]) < 0.02
