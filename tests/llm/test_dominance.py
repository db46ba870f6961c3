"""op7: sets that the reduction fixes never cost the optimum."""

import random
from collections import Counter

import pytest

from riskspan.llm import packing


def optimum(items, capacity):
    """Fewest sequences, by trying all places of each item (small instances only)."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - items[i]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("lengths, want", [({50: 1, 40: 1, 20: 4, 15: 1, 14: 1}, 2), ({11: 1, 8: 1, 4: 3, 3: 3}, 2)])
def test_three_small_companions_are_not_overlooked(lengths, want):
    capacity = 100 if 50 in lengths else 20
    assert sum(t for _, t in packing.plan(dict(lengths), capacity)) == want


def test_fixed_sets_keep_the_optimum():
    rng = random.Random(2)
    triples = 0
    for case in range(2_000):
        capacity = rng.choice([20, 30, 100])
        low = rng.choice([1, capacity // 5, capacity // 4])
        items = [rng.randint(low, rng.choice([capacity // 2, capacity])) for _ in range(rng.randint(1, 9))]
        counts = dict(Counter(items))
        fixed = packing.dominance(counts, capacity)
        used = Counter()
        for pattern, times in fixed:
            assert sum(pattern) <= capacity
            triples += len(pattern) == 3
            for n in pattern:
                used[n] += times
        assert used + Counter(counts) == Counter(items)
        rest = [n for n, c in counts.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + optimum(rest, capacity) == optimum(items, capacity), (items, capacity, fixed)
    assert triples > 20


def test_plan_places_everything_once():
    rng = random.Random(3)
    counts = {rng.randint(1, 2048): rng.randint(1, 10**6) for _ in range(800)}
    held = Counter()
    for pattern, times in packing.plan(dict(counts), 2048):
        assert sum(pattern) <= 2048
        for n in pattern:
            held[n] += times
    assert held == Counter(counts)
