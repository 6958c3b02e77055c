"""The N first items of every group, by lower bounds that partitions find on their own.

The N-th best item of a group within one partition is a valid bound: the group has N items at least as good. A
partition applies its own bound where the rows stand, so of a group of any size at most N rows leave it; the best
bound of each group that has one filters these again, and the survivors are ranked. Bounds are whole sort keys, so
items with equal scores don't slip through in millions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Scratch


def top_n(items: DataFrame, group: str, item: str, score: str, tie: str, n: int = 5, bound_rows: int = 100_000) -> DataFrame:
    """`group, item, pos`: the `n` items with the largest score; equal scores by `tie` (UTF-8 bytes), then by item.

    `items` has a BIGINT group, item and score and a STRING tie. Rows with a null group, item or score are left out;
    a null tie counts as empty; a repeated item of a group counts once, with its best place. Groups with fewer items
    give them all; an empty table gives no rows. Other columns are not read. `bound_rows`: groups whose bounds are
    broadcast, those that most partitions know a bound of; the bounds of the others meet their rows, at most n for
    each of the few partitions that hold them, where the ranking brings them together anyway.
    """
    known = F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull()
    rows = items.where(known).select(F.col(group).cast("long").alias("g"), F.bitwise_not(F.col(score).cast("long")).alias("s"), F.coalesce(F.col(tie), F.lit("")).alias("t"), F.col(item).cast("long").alias("i"))
    # ascending: the complement of a score falls as it rises
    local = Scratch(items.sparkSession, "topn").save(rows.sortWithinPartitions("g", "s", "t", "i").mapInArrow(_first(n), "g long, s long, t string, i long, nth boolean"))
    place = F.struct("s", "t", "i")
    bounds = local.where("nth").groupBy("g").agg(F.min(place).alias("bound"), F.count("*").alias("parts")).where("parts > 1")
    most = bounds.groupBy("parts").count().orderBy(F.desc("parts")).limit(bound_rows).collect()  # at most as many rows as there are partitions
    room, bar = bound_rows, None
    for r in most:
        room -= r["count"]
        if room < 0:
            break
        bar = r["parts"]
    left = local.select("g", "s", "t", "i")
    if bar is not None:
        left = left.join(F.broadcast(bounds.where(F.col("parts") >= bar).select("g", "bound")), "g", "left").where(F.col("bound").isNull() | (place <= F.col("bound"))).drop("bound")
    once = left.groupBy("g", "i").agg(F.min(F.struct("s", "t")).alias("p"))
    ranked = once.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("p", "i")).cast("long"))
    return ranked.where(F.col("pos") <= n).select(F.col("g").alias(group), F.col("i").alias(item), "pos")


def _first(n: int):
    """Of sorted rows the first n items of each group, and which of them is the n-th; items are told apart, as they may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None  # the group of the row before, and its items so far
        seen: set[int] = set()
        for b in batches:
            if not b.num_rows:
                continue
            g, i = b.column(0).to_numpy(), b.column(3).to_numpy()
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            sizes = np.diff(np.append(starts, len(g)))
            # groups with fewer rows than n that lie within the batch are whole and short: all of them go on
            keep = np.repeat(sizes < n, sizes)
            nth = np.zeros(len(g), bool)
            look = np.flatnonzero((sizes >= n) | (starts == 0) | (starts + sizes == len(g)))
            for k in look.tolist():
                lo, hi = int(starts[k]), int(starts[k] + sizes[k])
                if last != int(g[lo]):
                    last, seen = int(g[lo]), set()
                keep[lo:hi] = False
                for at in range(lo, hi):
                    if len(seen) == n:
                        break
                    if int(i[at]) not in seen:
                        seen.add(int(i[at]))
                        keep[at] = True
                        nth[at] = len(seen) == n
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([*[pc.take(c, at) for c in b.columns], pa.array(nth[keep])], names=["g", "s", "t", "i", "nth"])

    return run
