"""Replaying a feed of inserts, updates and deletes into the rows present in the end.

Records are range-partitioned by key and sequence, so that a key of any size spreads over as many tasks as it needs,
and sorted within partitions. Each task runs the state machine over its stretch of every key and emits one net
transition per key; keys that lie wholly inside one partition are final, and only the at most two keys at a
partition's ends are composed with their neighbours' transitions in a second, tiny step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import Scratch

#: Fixed values of the journal: bits of `reason`.
CREATE_BIT = 256
DELETE_BIT = 512

OPEN, LIVE, GONE = 0, 1, 2  # a stretch without creation or deletion; ending present; ending deleted


def before_position(changes: DataFrame, positions: DataFrame, volume: str = "volume_id") -> DataFrame:
    """Records before the saved position of their volume.

    `positions` has `id, journal_id, next_usn`. A volume without a row there, or with a null in either column, has no
    position: all its records count. Of several positions of one volume the furthest holds.
    """
    p = positions.where(F.col("journal_id").isNotNull() & F.col("next_usn").isNotNull()).groupBy(F.col("id").alias(volume)).agg(F.max(F.struct("journal_id", "next_usn")).alias("_at"))
    at = F.col("_at")
    keep = at.isNull() | (F.col("journal_id") < at["journal_id"]) | ((F.col("journal_id") == at["journal_id"]) & (F.col("usn") < at["next_usn"]))
    return changes.join(p, volume, "left").where(keep).drop("_at")


def replay(changes: DataFrame, key: Iterable[str] = ("volume_id", "file_ref"), sequence: Iterable[str] = ("journal_id", "usn"), values: Iterable[str] = ("parent_ref", "name", "size", "modified_at", "attrs")) -> DataFrame:
    """The rows present after applying `changes` in order: key, values and the last applied sequence.

    Per key, records apply in the order of `sequence`. The delete bit of `reason` removes the row; otherwise the
    create bit sets all values anew; any other record (a null reason too) replaces the values it carries (non-null)
    and does nothing while the row is absent. A sequence already applied is skipped, so repeated and late deliveries
    change nothing. Records with a null in key or sequence cannot be placed and never count. An empty feed gives no
    rows; other columns of `changes`, whatever their names, are not read.
    """
    key, sequence, values = list(key), list(sequence), list(values)
    spark = changes.sparkSession
    known = None
    for c in key + sequence:
        known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
    # positional names: a value column may share its name with anything
    picked = changes.where(known).select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(key)],
        *[F.col(c).alias(f"s{i}") for i, c in enumerate(sequence)],
        F.coalesce(F.col("reason"), F.lit(0)).cast("long").alias("r"),
        *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)],
    )
    ks, ss, vs = [f"k{i}" for i in range(len(key))], [f"s{i}" for i in range(len(sequence))], [f"v{i}" for i in range(len(values))]
    placed = picked.repartitionByRange(*ks, *ss).sortWithinPartitions(*ks, *ss)
    fields = {f.name: f for f in picked.schema.fields}
    out = T.StructType([*[fields[k] for k in ks], *[fields[s] for s in ss], *[T.StructField(v, fields[v].dataType) for v in vs], T.StructField("state", T.IntegerType()), T.StructField("edge", T.BooleanType())])
    nets = Scratch(spark, "replay").save(placed.mapInArrow(_machine(ks, ss, vs), out))
    whole = nets.where(~F.col("edge")).select(*ks, *ss, *vs)
    rows = whole.unionByName(_compose(nets.where("edge"), ks, ss, vs))
    return rows.select(*[F.col(a).alias(b) for a, b in zip(ks + vs + ss, key + values + sequence)])


def _compose(edges: DataFrame, ks: list[str], ss: list[str], vs: list[str]) -> DataFrame:
    """Composes the transitions of keys cut by partition bounds; at most two rows per partition come here."""
    seq = F.struct(*ss)
    last = F.max(F.when(F.col("state") != OPEN, seq)).over(Window.partitionBy(*ks))
    since = edges.withColumn("_last", last).where(seq >= F.col("_last"))
    end = F.max(seq)
    g = since.groupBy(*ks).agg(
        end.alias("_end"),
        F.max_by("state", F.when(F.col("state") != OPEN, seq)).alias("state"),
        *[F.max_by(v, F.when(F.col(v).isNotNull(), seq)).alias(v) for v in vs],
    )
    return g.where(F.col("state") == LIVE).select(*ks, *[F.col("_end")[s].alias(s) for s in ss], *vs)


def _machine(ks: list[str], ss: list[str], vs: list[str]):
    def differs(col: pa.Array) -> np.ndarray:
        return pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict | None = None
        schema = None
        first = True  # the first key of the partition may continue one of the partition before

        def row(c: dict, edge: bool) -> pa.RecordBatch:
            cols = [pa.array([x], type=schema.field(n).type) for n, x in zip(ks + ss + vs, [*c["key"], *c["seq"], *c["val"]])]
            return pa.RecordBatch.from_arrays([*cols, pa.array([c["state"]], pa.int32()), pa.array([edge])], names=ks + ss + vs + ["state", "edge"])

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            schema = b.schema
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            fresh = np.ones(n, bool)
            if n > 1:
                fresh[1:] = np.logical_or.reduce([differs(col[k]) for k in ks])
            again = np.zeros(n, bool)  # this sequence was applied just before
            if n > 1:
                again[1:] = ~fresh[1:] & ~np.logical_or.reduce([differs(col[s]) for s in ss])
            head = tuple(col[k][0].as_py() for k in ks)
            joined = carry is not None and carry["key"] == head
            if joined and tuple(col[s][0].as_py() for s in ss) == carry["seq"]:
                stop = 1 + (int(np.argmin(again[1:])) if n > 1 and not again[1:].all() else n - 1)
                again[:stop] = True
            starts = np.flatnonzero(fresh)
            sizes = np.diff(np.append(starts, n))
            at = np.arange(n)
            reason = col["r"].to_numpy(zero_copy_only=False)
            marks = ~again & ((reason & (CREATE_BIT | DELETE_BIT)) != 0)
            last_mark = np.maximum.reduceat(np.where(marks, at, -1), starts)
            last = np.maximum.reduceat(np.where(again, -1, at), starts)
            state = np.where(last_mark < 0, OPEN, np.where((reason[last_mark] & DELETE_BIT) != 0, GONE, LIVE)).astype(np.int32)
            floor = np.repeat(last_mark, sizes)
            takes = []
            for v in vs:
                has = ~again & (at >= floor) & col[v].is_valid().to_numpy(zero_copy_only=False)
                i = np.maximum.reduceat(np.where(has, at, -1), starts)
                takes.append(col[v].take(pa.array(i, mask=i < 0)))
            keys = [col[k].take(pa.array(starts)) for k in ks]
            seqs = [col[s].take(pa.array(np.maximum(last, 0))) for s in ss]

            def summary(i: int) -> dict:
                return {"key": tuple(k[i].as_py() for k in keys), "seq": tuple(s[i].as_py() for s in seqs), "val": [t[i].as_py() for t in takes], "state": int(state[i])}

            if joined:
                if last[0] >= 0:
                    s = summary(0)
                    if s["state"] == OPEN:
                        carry["val"] = [a if a is not None else c for a, c in zip(s["val"], carry["val"])]
                        carry["seq"] = s["seq"]
                    else:
                        carry = s
                lo = 1
            else:
                if carry is not None:
                    if first or carry["state"] == LIVE:
                        yield row(carry, first)
                    first = False
                carry = summary(0)
                lo = 1
            hi = len(starts) - 1  # the last key may go on in the next batch
            if lo <= hi:
                if first or carry["state"] == LIVE:
                    yield row(carry, first)
                first = False
                if lo < hi:
                    live = pa.array(np.flatnonzero(state[lo:hi] == LIVE) + lo)
                    if len(live):
                        yield pa.RecordBatch.from_arrays([*[x.take(live) for x in keys + seqs + takes], pa.array(np.full(len(live), LIVE, np.int32)), pa.array(np.zeros(len(live), bool))], names=ks + ss + vs + ["state", "edge"])
                carry = summary(hi)
        if carry is not None:
            yield row(carry, True)

    return run
