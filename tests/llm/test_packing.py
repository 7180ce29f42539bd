"""Packings of many short or equal lengths, against the bound by total length."""

import random
from collections import Counter

import pytest

from loomgrid.llm import packing


def checked(counts, capacity=packing.CAPACITY):
    """Sequences of a packing that holds every item once and no sequence over capacity."""
    patterns, held = packing.complete_bins(counts, capacity), Counter()
    for filling, times in patterns:
        assert times > 0 and sum(filling) <= capacity
        for n, k in Counter(filling).items():
            held[n] += k * times
    assert held == Counter({n: c for n, c in counts.items() if c})
    return sum(t for _, t in patterns)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
def test_many_short_items_fill_sequences(n):
    assert checked({n: 100_000}) == -(-100_000 // (packing.CAPACITY // n))


def test_a_third_of_all_texts_is_empty():
    random.seed(1)
    counts = Counter(random.randint(20, 500) for _ in range(60_000))
    counts[1] = 30_000
    assert checked(counts) == -(-sum(n * c for n, c in counts.items()) // packing.CAPACITY)


def test_fillings_are_maximal_when_the_nodes_end():
    counts = {3: 50, 5: 40, 1: 7}
    for nodes in (0, 1, 2, 5, 50):
        for filling in packing.fillings(100, counts, [1, 3, 5], 1, nodes):
            left = Counter(counts) - Counter(filling)
            assert not any(n <= 100 - sum(filling) for n in left)


def test_branch_and_bound_runs_at_any_size():
    random.seed(5)
    counts = Counter(min(2048, int(random.expovariate(1 / 300)) + 30) for _ in range(2_000))
    greedy = sum(t for _, t in packing._greedy(counts, packing.CAPACITY))
    assert checked(counts) == packing.lower_bound(counts, packing.CAPACITY) < greedy


def test_lower_bound_tries_every_length():
    # 1548 shares with nothing from 501 on, which 64 shorter lengths must not hide
    counts = {n: 1 for n in range(1, 101)} | {n: 50 for n in range(500, 520)} | {1548: 900}
    assert packing.lower_bound(counts, packing.CAPACITY) == 900 + -(-50 * sum(range(501, 520)) // packing.CAPACITY)


def test_best_fit_decreasing():
    random.seed(4)
    for _ in range(50):
        items = [random.randint(1, 50) for _ in range(60)]
        rooms = []
        for n in sorted(items, reverse=True):
            fits = [r for r in rooms if r >= n]
            rooms.append(50) if not fits else None
            r = min(fits, default=50)
            rooms[rooms.index(r)] -= n
        got = packing.best_fit_decreasing(Counter(items), 50)
        assert sorted(50 - sum(f) for f, t in got for _ in range(t)) == sorted(rooms)
