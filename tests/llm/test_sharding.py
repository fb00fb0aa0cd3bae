"""Cuts around groups that outweigh a fair share."""

import random

import numpy as np
import pytest

from loomlake.llm.sharding import cuts_for


def loads_of(sizes, shards):
    bound, place = cuts_for(sizes, shards)
    assert list(place) == sorted(place) and int(place.max()) < shards
    loads = np.bincount(place, sizes, shards).astype(int)
    assert loads.max() == bound
    return loads


@pytest.mark.parametrize("at", [[0], [50], [100], [20, 70], [0, 1], [40, 60, 99]])
def test_rows_beside_hot_groups_spread(at):
    sizes = [1] * 100
    for k in at:
        sizes.insert(k, 100)
    loads = loads_of(sizes, 40)
    assert sorted(loads)[-len(at) :] == [100] * len(at)
    rest = sorted(loads)[: -len(at)]
    assert min(rest) >= 1 and max(rest) <= 4  # a stretch of three ones has two shards


def test_hot_group_among_many():
    sizes = np.random.default_rng(5).integers(500, 1500, 1 << 16)
    sizes[30_000] = sizes.sum() // 2
    rest = sorted(loads_of(sizes, 40))[:-1]
    assert max(rest) < 1.1 * min(rest)


def test_cuts_stay_minimax_and_no_shard_is_empty():
    rnd = random.Random(3)
    for _ in range(400):
        sizes = [rnd.choice([1, 1, 2, 3, 9, 30]) for _ in range(rnd.randrange(1, 12))]
        shards = rnd.randrange(1, 6)
        best = {(len(sizes), n): 0 for n in range(shards + 1)}
        for n in range(shards + 1):
            for k in range(len(sizes)):
                best[k, n] = min((max(sum(sizes[k:j]), best[j, n - 1]) for j in range(k + 1, len(sizes) + 1)), default=0) if n else 10**9
        loads = loads_of(sizes, shards)
        assert loads.max() == best[0, shards]
        assert np.count_nonzero(loads) == min(shards, len(sizes))
