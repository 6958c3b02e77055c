"""Filling containers of a fixed capacity, by hierarchical residual packing.

Partitions pack their items by best fit, largest first. Nearly full containers are final; underfull ones meet, a few
partitions together, as items of the next round, until one partition is left. Best fit leaves a partition at most one
container that is half full or less, so a round of `fan` partitions places at most `fan` containers, each in one other;
of the many containers with the same fill only as many go on as all later rounds could use, which bounds a task
without losing a placement.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Bin of each item, and what remains free in each bin; items go largest first into the fullest bin with room."""
    of, free = np.zeros(len(sizes), np.int64), []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin with r free exists
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = by_free[r].pop()
            if not by_free[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        free[b] = r = r - s
        of[i] = b
        if r:
            by_free[r].append(b)
            mask |= 1 << r
    return of, free


def _pack(capacity: int, slack: int, level: int, keep: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("item")  # the result doesn't depend on the order of arrival
        part = t["part"][0].as_py()
        of, free = best_fit(t["size"].to_numpy(), capacity)
        left = np.array(free, np.int64)
        order = np.argsort(left, kind="stable")
        run_start = np.maximum.accumulate(np.where(np.append(True, np.diff(left[order]) != 0), np.arange(len(left)), 0))
        goes = np.zeros(len(left), bool)
        goes[order] = np.arange(len(left)) - run_start < keep
        goes &= left > slack
        lead = np.zeros(len(of), bool)  # one row stands for each container
        lead[np.unique(of, return_index=True)[1]] = True
        # numbers of bins: level, partition and bin side by side
        return pa.table({"item": t["item"], "whole": t["whole"], "size": t["size"], "bin": pa.array((level << 57) + (part << 32) + of), "fill": pa.array(capacity - left[of]), "part": pa.array(np.full(len(of), part)), "goes": pa.array(lead & goes[of])})

    return run


def pack(items: DataFrame, id: str, size: str, capacity: int, slack: int = 8, task_items: int = 10_000, fan: int = 8, least_parts: int = 8) -> DataFrame:
    """`id, part_no, start_at, size, container`: every item, or part of one that exceeds the capacity, with its container.

    An item larger than `capacity` is cut into parts of full capacity, each filling a container, and a rest that is
    packed like an item. Items of size 0 or null take no room and have no row. Ids (BIGINT) must be unique; rows with
    a null id are left out. An empty table gives no rows. `slack`: free room with which a container counts as nearly
    full; `task_items`: items that a partition packs on average, of which there are at least `least_parts`; `fan`:
    partitions that meet in one round.
    """
    scratch = Scratch(items.sparkSession, "pack")
    base = scratch.save(items.where(F.col(id).isNotNull() & (F.col(size) > 0)).select(F.col(id).cast("long").alias("item"), F.col(size).cast("long").alias("size")))
    whole = F.floor(F.col("size") / capacity)
    # the container of a full part is its own, named by item and part
    full = base.where(F.col("size") >= capacity).select("item", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part_no"))
    full = full.select("item", "part_no", (F.col("part_no") * capacity).alias("start_at"), F.lit(capacity).cast("long").alias("size"), F.concat_ws("-", F.lit("full"), "item", "part_no").alias("container"))
    rest = base.where(F.col("size") % capacity > 0)
    parts = max(least_parts, -(-rest.count() // task_items))
    rounds_left = math.ceil(math.log(parts, fan) - 1e-9)
    schema = "item long, whole long, size long, bin long, fill long, part long, goes boolean"
    now = rest.select("item", whole.alias("whole"), (F.col("size") % capacity).alias("size"), F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part"))
    rounds: list[DataFrame] = []
    while True:
        rounds.append(scratch.save(now.groupBy("part").applyInArrow(_pack(capacity, slack, len(rounds) + 1, fan * rounds_left), schema)))
        if not rounds_left:
            break
        rounds_left -= 1
        now = rounds[-1].where("goes").select(F.col("bin").alias("item"), F.lit(0).cast("long").alias("whole"), F.col("fill").alias("size"), F.floor(F.col("part") / fan).alias("part"))
    final = rounds[-1].select("item", "bin")
    for r in reversed(rounds[1:-1]):
        up = final.select(F.col("item").alias("bin"), F.col("bin").alias("_up"))
        final = r.select("item", "bin").join(up, "bin", "left").select("item", F.coalesce("_up", "bin").alias("bin"))
    first = rounds[0]
    if len(rounds) > 1:
        up = final.select(F.col("item").alias("bin"), F.col("bin").alias("_up"))
        first = first.join(up, "bin", "left").withColumn("bin", F.coalesce("_up", "bin"))
    packed = first.select("item", F.col("whole").alias("part_no"), (F.col("whole") * capacity).alias("start_at"), "size", F.concat_ws("-", F.lit("bin"), "bin").alias("container"))
    return full.unionByName(packed).withColumnRenamed("item", id)
