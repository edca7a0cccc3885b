"""Packing: never more sequences than best-fit decreasing, every rank placed once."""

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest

from hotzone.llm.pack import plan_runs


def decreasing(lengths, cap):
    rooms = []
    for x in sorted(lengths, reverse=True):
        k = bisect_left(rooms, x)
        insort(rooms, (rooms.pop(k) if k < len(rooms) else cap) - x)
    return len(rooms)


def used(plan, hist):
    room = defaultdict(int)
    for k, (length, at, copies, seq, off) in enumerate(plan.tolist()):
        last = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else hist[length]
        for d in range(last - at):
            assert off + (d % copies + 1) * length <= 4096
            room[seq + d // copies] += length
    return room


def cases():
    rng = np.random.default_rng(5)
    yield rng.integers(1400, 2700, 30_000)
    yield np.repeat([1366, 1365, 2049, 2047, 700], [5000, 7000, 4000, 6000, 900])
    yield np.clip(rng.lognormal(6.5, 1.0, 20_000).astype(int) + 1, 1, 4096)
    yield rng.integers(1, 4097, 5000)
    yield np.repeat([1, 4096, 2048], [10_000, 10, 3])
    yield rng.choice([37, 1000, 1024, 1023, 3000, 4095], 4000)
    for n in (0, 1, 2, 17):
        yield rng.integers(1, 4097, n)


@pytest.mark.parametrize("x", list(cases()), ids=str)
def test_never_more_than_best_fit_decreasing(x):
    hist = dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True))))
    plan = plan_runs(hist, 4096)
    room = used(plan, hist)
    assert sum(room.values()) == x.sum() and max(room.values(), default=0) <= 4096
    assert sorted(room) == list(range(len(room)))
    assert len(room) <= decreasing(x.tolist(), 4096)
