"""Snapshot differences against plain sets, and the lookup table on its own."""

import random

import numpy as np
import pytest

from shelfmark.operators.snapdiff import LookupTable, difference, snapshot_changes

SCHEMA = "volume_id long, snap_no int, delivery_no int, file_ref long, parent_ref long, name string, size long, modified_at long, attrs long, key string"


def plain(rows):
    last = {}
    for r in rows:
        if None not in r[:3]:
            last[r[:2]] = max(last.get(r[:2], 0), r[2])
    out = set()
    for v in {k[0] for k in last}:
        snaps = sorted(k[1] for k in last if k[0] == v)
        side = lambda s: {r[3]: r[4:9] for r in rows if r[0] == v and r[1] == s and r[2] == last[(v, s)] and r[3] is not None}  # noqa: E731, B023
        for a, b in zip(snaps, snaps[1:]):
            x, y = side(a), side(b)
            for k in x.keys() | y.keys():
                if k not in x or k not in y or x[k] != y[k]:
                    out.add((v, b, k, "inserted" if k not in x else "deleted" if k not in y else "moved" if x[k][:2] != y[k][:2] else "updated"))
    return out


@pytest.mark.parametrize("bucket_rows,spare", [(4096, 1.5), (20, 0.02), (50, 0.8)])
def test_random_snapshots(spark, bucket_rows, spare):
    rnd, rows = random.Random(bucket_rows), []
    for v in (1, 2):
        state = {i - 50: [rnd.choice([None, 1, 2]), f"n{i}", i, None, 32] for i in range(120)}
        for s in (1, 2, 4, 5):
            for d in range(1, rnd.choice([2, 3]) + 0):
                rows += [(v, s, d, k, *x, "x") for k, x in state.items() if d > 1 or rnd.random() < 0.9]
            for k in rnd.sample(list(state), 25):
                if rnd.random() < 0.3:
                    del state[k]
                else:
                    state[k][rnd.randrange(5)] = rnd.choice([None, 5, 6]) if rnd.random() < 2 else 0
                    state[k][1] = str(state[k][1]) if state[k][1] is not None else None
            for _ in range(6):
                state[rnd.randrange(1000, 2000)] = [1, "new", None, 3, None]
    rows += rnd.sample(rows, 60) + [(1, 1, 1, None, 1, "z", 1, 1, 1, ""), (None, 1, 1, 5, 1, "z", 1, 1, 1, ""), (1, None, 9, 5, 1, "z", 1, 1, 1, "")]
    rnd.shuffle(rows)
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), bucket_rows=bucket_rows, spare=spare)
    assert {tuple(r) for r in got.collect()} == plain(rows)


def test_empty_and_single(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert snapshot_changes(spark.createDataFrame([(1, 1, 1, 5, 1, "a", 1, 1, 1, "")], SCHEMA)).count() == 0


def test_lookup_table_finds_every_difference():
    rng = np.random.default_rng(3)
    same = rng.integers(0, 2**63, (3, 500), dtype=np.uint64)
    for n in (0, 1, 7, 400):
        a, b = rng.integers(0, 2**63, (3, n), dtype=np.uint64), rng.integers(0, 2**63, (3, n // 2), dtype=np.uint64)
        width, seed, got = 6, 1, None
        while got is None:
            x, y = LookupTable(width, seed), LookupTable(width, seed)
            x.add(np.hstack([same, a]), 1)
            y.add(np.hstack([same, b]), 1)
            x, y = (LookupTable.unpack(t.pack(), width, seed) for t in (x, y))
            with np.errstate(over="ignore"):
                gap = b.sum(axis=1, dtype=np.uint64) - a.sum(axis=1, dtype=np.uint64)
            got, width, seed = difference(x, y, gap), width * 2, seed + 1
        assert width <= 2000  # it follows the differences, not the 500 rows that are alike
        e, s = got
        assert {tuple(x) for x in e[:, s < 0].T.tolist()} == {tuple(x) for x in a.T.tolist()}
        assert {tuple(x) for x in e[:, s > 0].T.tolist()} == {tuple(x) for x in b.T.tolist()}


def test_sums_must_agree():
    x, y = LookupTable(30, 1), LookupTable(30, 1)
    y.add(np.array([[1], [2], [3]], np.uint64), 1)
    assert difference(x, y, np.array([1, 2, 3], np.uint64)) is not None and difference(x, y, np.array([1, 2, 4], np.uint64)) is None
