"""op4: runs of equal items against item-by-item best fit, and groups that stay whole."""

import random
from collections import Counter, defaultdict

from riskspan.llm import sharding


def item_by_item(items, capacity, bins):
    rooms, out = [capacity] * bins, Counter()
    for size in sorted(items, reverse=True):
        fitting = [(rooms[b], b) for b in range(bins) if rooms[b] >= size]
        b = min(fitting)[1] if fitting else max((rooms[b], b) for b in range(bins))[1]
        rooms[b] -= size
        out[size, b] += 1
    return out, rooms


def test_runs_equal_item_by_item_best_fit():
    rng = random.Random(1)
    for _ in range(300):
        items = [rng.randint(1, 12) for _ in range(rng.randint(1, 80))]
        bins = rng.randint(1, 6)
        capacity = -(-sum(items) // bins)
        want, rooms = item_by_item(items, capacity, bins)
        got = Counter()
        for size, times, b in sharding.best_fit_decreasing(list(Counter(items).items()), capacity, bins):
            got[size, b] += times
        assert got == want
        assert max(rooms) - min(rooms) <= max(items)


def test_groups_stay_whole_and_sizes_near_equal(spark):
    """A third of all rows are null, many texts are copied, one text alone weighs more than a shard."""
    rng = random.Random(2)
    texts = [None] * 400 + ["copy " * rng.randint(1, 9) for _ in range(300)] + [f"text {rng.randrange(10**6)} " * rng.randint(1, 40) for _ in range(500)] + ["large " * 400] * 30
    rng.shuffle(texts)
    out = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).collect()
    size, shards = Counter(), defaultdict(set)
    for r in out:
        size[r["shard"]] += r["size"]
        shards[texts[r["doc_id"]]].add(r["shard"])
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 8
    assert len(out) == len(texts) and max(size.values()) - min(size.values()) <= 2_500
    assert all(len(s) == 1 for t, s in shards.items() if t is None or len(t) < 2_000)
    for s in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
