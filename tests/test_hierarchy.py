"""Paths, depths, roots and counts against a walk in Python, with loops, long chains and missing parents."""

import random

import pytest

from shelfmark.operators.hierarchy import closure, hierarchy


def plain(rows):
    par = {i: (p, n or "") for i, p, n in rows}
    out = {}
    for i in par:
        way, at = [], i
        while at in par and at not in way:
            way.append(at)
            at = par[at][0]
        if at in way:
            out[i] = (min(way[way.index(at) :]), -1, "", -1)
        else:
            out[i] = (way[-1], len(way) - 1, "\\".join(par[x][1] for x in reversed(way) if par[x][1]), 0)
    for i, (_, d, _, _) in list(out.items()):
        at = par[i][0]
        while d > 0 and at in par:
            r, dd, p, n = out[at]
            out[at] = (r, dd, p, n + 1)
            at = par[at][0]
    return {(i, *v) for i, v in out.items()}


@pytest.mark.parametrize("hot", [2_000_000, 3])
def test_random_forest(spark, hot):
    rnd = random.Random(hot)
    rows = [(i, rnd.choice([None, 9999, *range(max(0, i - 12), i + 3)]), rnd.choice(["a", "b", "", None])) for i in range(1, 220)]
    rows += [(500 + i, 499 + i if i else None, "c") for i in range(150)]  # a long chain
    rows += [(700 + i, 700 + (i + 1) % 17, "l") for i in range(17)] + [(720, 703, "t"), (721, 720, "t"), (730, 730, "self")]
    rows += [(800 + i, 510, "w") for i in range(80)]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:30]], "id long, parent_id long, name string, kids string")
    got = {tuple(r) for r in hierarchy(df, hot_rows=hot).select("id", "root_id", "depth", "path", "n_below").collect()}
    assert got == plain(rows)


def test_closure_and_empty(spark):
    df = spark.createDataFrame([(1, None, ""), (2, 1, "a"), (3, 2, "b")], "id long, parent_id long, name string")
    assert {tuple(r) for r in closure(df).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}
    empty = spark.createDataFrame([], "id long, parent_id long, name string")
    assert hierarchy(empty).count() == 0
    assert hierarchy(spark.createDataFrame([(None, 1, "x")], "id long, parent_id long, name string")).count() == 0
