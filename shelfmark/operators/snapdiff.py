"""What changed between full snapshots, by subtracting invertible Bloom lookup tables.

Rows are reduced to a key and two digests where they stand. Every snapshot's rows of a hash bucket become lookup
tables of a size that follows the number of differences, not of rows; two snapshots never meet but as tables. The
table of the earlier is subtracted from that of the later, the differing key-digest pairs are peeled off, the sums of
both sides must agree with what was recovered, and only for buckets that don't peel are rows read again, into tables
twice as large. The recovered keys are classified by which side, and which digest, they differ in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Scratch, small_side

HASHES = 3  # cells of a table that hold one element
KINDS = np.array(["inserted", "deleted", "moved", "updated"])
SAMPLE = 32  # of so many keys one serves to estimate how many differ; an estimate too low costs another round, never a row


def _digest(cols: list[str], seed: int):
    """64 bits over the values, nulls told apart from every value."""
    parts = []
    for c in cols:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(F.lit(seed), *parts)


def snapshot_changes(
    snapshots: DataFrame, source: str = "volume_id", snap: str = "snap_no", delivery: str = "delivery_no", key: str = "file_ref",
    place: tuple[str, ...] = ("parent_ref", "name"), content: tuple[str, ...] = ("size", "modified_at", "attrs"), bucket_rows: int = 4096, spare: float = 1.5,
) -> DataFrame:
    """`source, snap, key, change_kind` for every key that differs between a snapshot and the one before it.

    Of a snapshot delivered more than once only the rows of the highest delivery count, so a last delivery without
    usable rows is an empty snapshot. Rows with a null source, snap, delivery or key are left out. Repeated rows count
    once; of different rows with one key the greatest digests hold. `moved`: a place column differs, else `updated`: a
    content column differs; null is a value of its own. The first snapshot of a source, a single one and an empty
    table give no rows. Digests have 64 bits each: two different rows are taken as equal with probability 2^-64.
    `bucket_rows`: rows of the largest snapshot per bucket; `spare`: cells of a table for each difference expected.
    """
    spark = snapshots.sparkSession
    scratch = Scratch(spark, "snapdiff")
    usable = snapshots.where(F.col(source).isNotNull() & F.col(snap).isNotNull() & F.col(delivery).isNotNull())
    runs = usable.groupBy(F.col(source).alias("src"), F.col(snap).alias("snap"), F.col(delivery).alias("deliv")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("src", "snap")
    last = runs.withColumn("_top", F.max("deliv").over(w)).where("deliv = _top")
    order = Window.partitionBy("src").orderBy("snap")
    last = scratch.save(last.select("src", "snap", "deliv", "n", F.row_number().over(order).alias("nth")))
    n_last, largest = last.agg(F.count("*"), F.max("n")).first()
    buckets = max(1, math.ceil((largest or 0) / bucket_rows))
    rows = usable.where(F.col(key).isNotNull()).select(
        F.col(source).alias("src"), F.col(snap).alias("snap"), F.col(delivery).alias("deliv"), F.col(key).cast("long").alias("key"), _digest(list(place), 7).alias("d1"), _digest(list(content), 11).alias("d2")
    )
    rows = scratch.save(rows.join(small_side(last.select("src", "snap", "deliv", "nth"), n_last), ["src", "snap", "deliv"]).select("src", "nth", F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(buckets)).cast("int").alias("bucket"), "key", "d1", "d2"))

    # how many key-digest pairs differ, for each pair of neighbours (named by the later), from a share of the keys
    some = rows.where(F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(SAMPLE)) == 0).groupBy("src", "nth", "key").agg(F.max(F.struct("d1", "d2")).alias("d"))
    sides = F.explode(F.array(F.struct(F.col("nth").alias("pair"), F.lit(1).alias("sign")), F.struct((F.col("nth") + 1).alias("pair"), F.lit(-1).alias("sign")))).alias("x")
    differ = some.select("src", "key", "d", sides).groupBy("src", "x.pair", "key", "d").agg(F.sum("x.sign").alias("s")).where("s <> 0").groupBy("src", "pair").agg((F.count("*") * SAMPLE / buckets).alias("expected"))
    differ = scratch.save(differ)
    kind = rows.schema["src"].dataType.simpleString()
    table = f"src {kind}, bucket int, pair int, later boolean, width int, seed int, cells binary, sums array<long>"
    # expected differences of a snapshot's own pair and of the next one; null where there is no such pair
    at = ["src", "nth"]
    own = differ.select("src", F.col("pair").alias("nth"), F.col("expected").alias("e"))
    nxt = differ.select("src", (F.col("pair") - 1).alias("nth"), F.col("expected").alias("x"))
    ends = last.groupBy("src").agg(F.max("nth").alias("end"))
    sizes = last.select(*at).join(own, at, "left").join(nxt, at, "left").join(ends, "src")
    zero = lambda c, there: F.when(there, F.coalesce(c, F.lit(0.0))).cast("float")
    sizes = scratch.save(sizes.select(*at, zero("e", F.col("nth") > 1).alias("own"), zero("x", F.col("nth") < F.col("end")).alias("next")))
    found: list[DataFrame] = []
    todo, grown = rows.join(small_side(sizes, n_last), at), 1
    while True:
        tables = todo.groupBy("src", "nth", "bucket").applyInArrow(_tables(spare * grown, grown), table)
        got = scratch.save(tables.groupBy("src", "bucket", "pair").applyInArrow(_differ, f"src {kind}, bucket int, nth int, key long, change_kind string"))
        found.append(got.where("change_kind IS NOT NULL"))
        failed = got.where("change_kind IS NULL").select("src", "bucket", "nth")
        n_failed = failed.count()
        if not n_failed:
            break
        # the rows of both sides of what failed
        side = F.explode(F.array(F.struct("nth", F.lit(True).alias("as_own")), F.struct((F.col("nth") - 1).alias("nth"), F.lit(False).alias("as_own")))).alias("s")
        both = failed.select("src", "bucket", side).groupBy("src", "bucket", F.col("s.nth").alias("nth")).agg(F.max("s.as_own").alias("as_own"), F.max(~F.col("s.as_own")).alias("as_next"))
        again = rows.join(small_side(both, 2 * n_failed), ["src", "bucket", "nth"]).join(small_side(sizes, n_last), at)
        todo, grown = again.select(*rows.columns, F.when(F.col("as_own"), F.col("own")).alias("own"), F.when(F.col("as_next"), F.col("next")).alias("next")), grown * 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = out.join(small_side(last.select("src", "nth", "snap"), n_last), ["src", "nth"])
    return out.select(F.col("src").alias(source), F.col("snap").alias(snap), F.col("key").alias(key), "change_kind")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class LookupTable:
    """Cells with count, xor of keys, digests and checks; HASHES disjoint regions of `width` cells."""

    def __init__(self, width: int, seed: int):
        self.width, self.seed = width, seed
        self.count = np.zeros(width * HASHES, np.int64)
        self.sums = np.zeros((4, width * HASHES), np.uint64)

    def _check(self, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix(_mix(_mix(e[0] + np.uint64(self.seed)) + e[1]) + e[2])

    def _cells(self, check: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            return [(_mix(check + np.uint64(i + 1)) % np.uint64(self.width)).astype(np.int64) + i * self.width for i in range(HASHES)]

    def add(self, e: np.ndarray, sign: np.ndarray | int) -> None:
        """Adds elements (rows: key, digest, digest); with sign -1 it takes them away."""
        check = self._check(e)
        both = np.vstack([e, check])
        for c in self._cells(check):
            np.add.at(self.count, c, sign)
            for i in range(4):
                np.bitwise_xor.at(self.sums[i], c, both[i])

    def pack(self) -> bytes:
        return self.count.astype(np.int32).tobytes() + self.sums.tobytes()

    @classmethod
    def unpack(cls, raw: bytes, width: int, seed: int) -> "LookupTable":
        t, n = cls(width, seed), width * HASHES
        t.count = np.frombuffer(raw, np.int32, n).astype(np.int64)
        t.sums = np.frombuffer(raw, np.uint64, 4 * n, 4 * n).reshape(4, n).copy()
        return t

    def subtract(self, other: "LookupTable") -> "LookupTable":
        d = LookupTable(self.width, self.seed)
        d.count, d.sums = self.count - other.count, self.sums ^ other.sums
        return d

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Elements and their signs; None if cells are left over."""
        got, signs = [np.zeros((3, 0), np.uint64)], [np.zeros(0, np.int64)]
        while True:
            c = np.flatnonzero(np.abs(self.count) == 1)
            c = c[self.sums[3, c] == self._check(self.sums[:3, c])]
            if not len(c):
                break
            e, first = np.unique(self.sums[:3, c], axis=1, return_index=True)
            s = self.count[c][first]
            self.add(e, -s)
            got.append(e)
            signs.append(s)
        if self.count.any() or self.sums.any():
            return None
        return np.hstack(got), np.concatenate(signs)


def difference(earlier: LookupTable, later: LookupTable, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Elements in one of two sets only, with +1 for the later, if the tables peel and the sums (later less earlier) agree."""
    got = later.subtract(earlier).peel()
    if got is None:
        return None
    e, s = got
    with np.errstate(over="ignore"):
        agree = e[:, s > 0].sum(axis=1, dtype=np.uint64) - e[:, s < 0].sum(axis=1, dtype=np.uint64) == gap
    return (e, s) if agree.all() else None


def _once(e: np.ndarray) -> np.ndarray:
    """Of equal keys the one with the greatest digests."""
    e = e[:, np.lexsort((e[2], e[1], e[0]))]
    last = np.ones(e.shape[1], bool)
    last[:-1] = e[0, 1:] != e[0, :-1]
    return e[:, last]


def _elements(t: pa.Table) -> np.ndarray:
    return np.vstack([t[c].to_numpy().view(np.uint64) for c in ("key", "d1", "d2")])


def _tables(spare: float, seed: int):
    """The tables of one snapshot's bucket: as the later side of its own pair, as the earlier side of the next one."""

    def run(t: pa.Table) -> pa.Table:
        src, nth, bucket, own, nxt = (t[c][0].as_py() for c in ("src", "nth", "bucket", "own", "next"))
        e = _once(_elements(t))
        sums = e.sum(axis=1, dtype=np.uint64).view(np.int64).tolist()
        rows = []
        for pair, later, expected in ((nth, True, own), (nth + 1, False, nxt)):
            if expected is None:
                continue
            # room for the usual deviation of a bucket from the mean, too
            width = math.ceil(spare * (expected + 4 * math.sqrt(expected) + 8) / HASHES)
            table = LookupTable(width, seed)
            table.add(e, 1)
            rows.append((src, bucket, pair, later, width, seed, table.pack(), sums))
        cols = list(zip(*rows)) or [[] for _ in range(8)]
        kinds = [t.schema.field("src").type, pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["src", "bucket", "pair", "later", "width", "seed", "cells", "sums"])

    return run


def _differ(t: pa.Table) -> pa.Table:
    """The changes of one bucket between two snapshots, or one row without a kind if the tables don't peel; a side without rows is empty."""
    width, seed = t["width"][0].as_py(), t["seed"][0].as_py()
    side = {True: LookupTable(width, seed), False: LookupTable(width, seed)}
    sums = {True: np.zeros(3, np.uint64), False: np.zeros(3, np.uint64)}
    for later, cells, total in zip(t["later"].to_pylist(), t["cells"], t["sums"].to_pylist()):
        side[later] = LookupTable.unpack(cells.as_py(), width, seed)
        sums[later] = np.array(total, np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        got = difference(side[False], side[True], sums[True] - sums[False])
    src, bucket, pair = (t[c][0].as_py() for c in ("src", "bucket", "pair"))
    if got is None:
        key, kind = np.zeros(1, np.int64), [None]
    else:
        d, s = got
        o = np.lexsort((s, d[0]))
        d, s = d[:, o], s[o]
        both = np.zeros(len(s), bool)  # the earlier version of a key, followed by its later one
        both[:-1] = d[0, 1:] == d[0, :-1]
        second = np.zeros(len(s), bool)
        second[1:] = both[:-1]
        moved = np.zeros(len(s), bool)
        moved[:-1] = both[:-1] & (d[1, 1:] != d[1, :-1])
        what = np.where(both, np.where(moved, 2, 3), np.where(s > 0, 0, 1))[~second]
        key, kind = d[0][~second].view(np.int64), KINDS[what].tolist()
    n = len(key)
    return pa.table({"src": pa.array([src] * n, t.schema.field("src").type), "bucket": pa.array([bucket] * n, pa.int32()), "nth": pa.array([pair] * n, pa.int32()), "key": pa.array(key), "change_kind": pa.array(kind, pa.string())})
