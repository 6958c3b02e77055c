"""The replay against a plain state machine, over random feeds with repeats, hot keys and nulls."""

import random

import pytest

from shelfmark.operators.changefeed import before_position, replay

SCHEMA = "volume_id long, journal_id long, usn long, file_ref long, parent_ref long, reason long, name string, size long, extra string"


def plain(rows):
    state, done = {}, {}
    for v, j, u, f, p, r, n, s, _ in sorted({x[:8] + (None,) for x in rows if None not in (x[0], x[1], x[2], x[3])}, key=lambda x: (x[0], x[3], x[1], x[2])):
        if done.get((v, f)) == (j, u):
            continue
        done[(v, f)] = (j, u)
        r = r or 0
        if r & 512:
            state.pop((v, f), None)
        elif r & 256:
            state[(v, f)] = [p, n, s, u]
        elif (v, f) in state:
            old = state[(v, f)]
            state[(v, f)] = [p if p is not None else old[0], n if n is not None else old[1], s if s is not None else old[2], u]
    return {(*k, *x) for k, x in state.items()}


@pytest.mark.parametrize("seed,keys", [(1, 40), (2, 1), (3, 7)])
def test_random_feeds(spark, seed, keys):
    rnd = random.Random(seed)
    rows, usn = [], 0
    for _ in range(600):
        usn += rnd.randint(1, 3)
        f = rnd.choice([0, rnd.randrange(keys)])  # half of all records are of one file
        rows.append((rnd.randrange(2), rnd.choice([5, 6]), usn, f, rnd.choice([None, 1, 2]), rnd.choice([256, 512, 768, 0, 8192, None, 0, 2147483648]), rnd.choice([None, "a", "b"]), rnd.choice([None, 1, 9]), "x"))
    rows += rnd.sample(rows, 100)
    rows += [(None, 5, 1, 1, 1, 256, "n", 1, ""), (1, None, 1, 1, 1, 256, "n", 1, ""), (1, 5, None, 1, 1, 256, "n", 1, ""), (1, 5, 1, None, 1, 256, "n", 1, "")]
    rnd.shuffle(rows)
    got = replay(spark.createDataFrame(rows, SCHEMA).repartition(5), values=("parent_ref", "name", "size"))
    assert {tuple(r) for r in got.select("volume_id", "file_ref", "parent_ref", "name", "size", "usn").collect()} == plain(rows)


def test_one_hot_key_over_many_partitions(spark):
    rows = [(1, 1, u, 7, u, 256 if u == 1 else 512 if u == 5000 else 256 if u == 5001 else 0, "n" if u % 1000 == 2 else None, None, "") for u in range(1, 9001)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = replay(spark.createDataFrame(rows, SCHEMA), values=("parent_ref", "name")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(r["parent_ref"], r["name"], r["usn"]) for r in got] == [(9000, "n", 9000)]


def test_empty_and_positions(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert replay(empty, values=("name",)).count() == 0
    rows = [(1, 5, 10, 1, 1, 256, "a", 1, ""), (1, 5, 20, 1, 1, 0, "b", 1, ""), (2, 5, 20, 1, 1, 256, "c", 1, ""), (3, 4, 99, 1, 1, 256, "d", 1, "")]
    pos = spark.createDataFrame([(1, 5, 20), (2, None, 20), (3, 5, 1)], "id long, journal_id long, next_usn long")
    got = replay(before_position(spark.createDataFrame(rows, SCHEMA), pos), values=("name",))
    assert {(r["volume_id"], r["name"]) for r in got.collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_clashing_column_names(spark):
    df = spark.createDataFrame([(1, 1, 1, 256, "a", 5, 6)], "k0 long, s0 long, v0 long, reason long, state string, edge long, r long")
    assert [tuple(r) for r in replay(df, ["k0"], ["s0"], ["state", "edge", "r", "v0"]).collect()] == [(1, "a", 5, 6, 1, 1)]
