"""Lookups in memory against all pairs."""

from itertools import combinations

import numpy as np

from tabveil.operators import neighbours


def test_sets_in_memory_find_what_all_pairs_find():
    _, search, compared = neighbours._in_memory(neighbours._layout([5]))
    rng, values = np.random.default_rng(1), (3, 5, 9, 20, 2, 4)  # the last column agrees in any case
    mine, theirs = ([rng.integers(0, v, n).astype(np.uint64) for v in values] for n in (200, 300))
    levels = [list(combinations(range(5), d)) for d in range(5)]
    for bits in (12, 64):
        for a, b in zip(search(mine, theirs, 5, levels, bits), compared(mine, theirs, 5)):
            assert (a == b).all()
