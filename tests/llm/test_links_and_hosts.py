"""op6's components beyond one task, its lists and its chances of a lost link; op5's hierarchy of hosts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspan.llm import near_dedup, urls


def test_components_of_many_tasks_equal_union_find(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CONTRACT", 5)
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i + 1000, i + 1001) for i in range(60)]
    links = [(max(p), min(p)) for p in links if p[0] != p[1]]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in links:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    table = near_dedup.materialise(spark.createDataFrame(links, "x long, y long").repartition(12), "links")
    got = {r["class"]: r["comp"] for r in near_dedup.components(table).collect()}
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("percent", [80, 85])
def test_links_at_the_threshold_are_found(percent):
    """200,000 pairs of large sets exactly at the threshold, as sketches: none without a common list, none dropped by the estimate."""
    rng, run, least, k = np.random.default_rng(percent), *near_dedup.LISTS[percent], near_dedup.K
    lost = dropped = 0
    for _ in range(20):
        kind = rng.random((10_000, 3 * k))  # the least hashes of the union in order: shared, of one set only, of the other
        a, b = kind < (1 + percent / 100) / 2, (kind < percent / 100) | (kind >= (1 + percent / 100) / 2)
        held = (np.cumsum(a, axis=1) <= k) & (np.cumsum(b, axis=1) <= k) & a & b
        streak = held.copy()
        for i in range(1, run):
            streak[:, i:] &= held[:, :-i]
            streak[:, :i] = False
        lost += (~streak.any(1)).sum()
        dropped += (held[:, :k].sum(1) < least).sum()
    assert (lost, dropped) == (0, 0)


@pytest.mark.parametrize("percent", [80, 85])
def test_forms_of_one_template_equal_all_pairs(spark, percent, monkeypatch):
    """Filled-in forms of one long template, most of them a little under the limit: open lists, searched in several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    rng = random.Random(percent)
    base, texts = [f"t{i}" for i in range(300)], []
    for _ in range(150):
        words, at = list(base), rng.randrange(200)
        for p in rng.sample(range(300), rng.choice([0, 2, 4, 5, 6, 8])):
            words[p] = f"z{rng.randrange(40)}"
        words[at : at + rng.choice([0, 5, 12])] = [f"own{rng.randrange(30)}"] * rng.randrange(3)
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    least = list(range(len(sets)))
    for _ in sets:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert 1 < len(set(least)) < len(sets)
    out = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == dict(enumerate(least))


def test_rarest_shingles_lose_no_pair(spark):
    """Every pair of sets of different components at 85 % meets in a list of rarest shingles."""
    rng = random.Random(3)
    rows = []
    for c in range(120):
        core = 1000 * (c % 6)
        kept = [core + i for i in range(60) if rng.random() > 0.06]
        rows.append((c, c % 40, sorted({*kept, *(9000 + rng.randrange(200) for _ in range(rng.randrange(6)))})))
    live = spark.createDataFrame([(c, len(s), comp, s) for c, comp, s in rows], "class long, n long, comp long, shingles array<long>")
    lists: dict[int, set[int]] = {}
    for r in near_dedup._rarest(live, F.expr("(85 * n + 99) div 100")).collect():
        lists.setdefault(r["key"], set()).add(r["class"])
    met = {(a, b) for members in lists.values() for a in members for b in members}
    alike = [(a, b) for a, x, s in rows for b, y, t in rows if x != y and 100 * len(set(s) & set(t)) >= 85 * len(set(s) | set(t))]
    assert len(alike) > 50 and set(alike) <= met and len(met) < len(rows) ** 2 / 2


def test_hierarchy_of_hosts(spark):
    hosts = ["a.b.co.uk", "b.co.uk:8080", "co.uk", "x.example.com:81", "localhost", "", "uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = urls.hierarchy(F.col("host"), ("co.uk",))
    got = [tuple(r) for r in df.select(domain, suffix).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.com", "com"), ("localhost", "localhost"), ("", ""), ("uk", "uk")]


def test_the_posterior_bound_blocks_hosts_that_no_rule_names(spark):
    """Labelled outcomes of pages: a bad host, new hosts of a bad and of a good domain, a mixed host, an unknown one."""
    seen = [(f"h{i}.bad.net", False) for i in range(40) for _ in range(5)] + [(f"h{i}.good.net", True) for i in range(40) for _ in range(5)]
    seen += [("spam.mixed.net", False)] * 40 + [("fine.mixed.net", True)] * 40 + [("half.mixed.net", i % 2 == 0) for i in range(40)]
    seen += [("new.bad.net", None), ("new.good.net", None)]
    hosts = ["h3.bad.net", "new.bad.net", "spam.mixed.net", "fine.mixed.net", "half.mixed.net", "new.good.net", "unknown.io"]
    pages = spark.createDataFrame([(i, f"https://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    out = urls.judge(pages, outcomes=spark.createDataFrame(seen, "host string, good boolean")).collect()
    assert all(r["rule"] is None for r in out)
    assert {r["host"] for r in out if r["verdict"] == "block"} == {"h3.bad.net", "new.bad.net", "spam.mixed.net"}
