"""Groups of everything linked directly or through others, on a two-dimensional grid of edge partitions.

Vertices are hashed into blocks; the edges between two blocks form one cell. Each round runs a local union-find in
every cell, takes for every vertex the least representative that its row and column of cells know, and replaces the
ends of all edges by it. Edges inside a group vanish, so each round's graph is a fraction of the one before; when none
is left the parents are stable, and the rounds' parent tables are composed from the last to the first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch, lookup_join


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges a-b, each with the least vertex of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while True:
        pu, pv = parent[u], parent[v]
        if (pu == pv).all():
            return ids, ids[parent]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))  # both ends are roots here
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up


def _cell(t: pa.Table) -> pa.Table:
    v, rep = union_find(t["a"].to_numpy(), t["b"].to_numpy())
    return pa.table({"v": v, "rep": rep})


def components(pairs: DataFrame, a: str, b: str, cell_edges: int = 50_000, hot_rows: int = 2_000_000) -> DataFrame:
    """`v, group_id`: each id (BIGINT) linked to another one, with the least id of its group.

    Pairs with a null or with twice the same id link nothing; order, repeats and other columns of `pairs` don't
    matter; no pairs give no rows. The grid has ceil(sqrt(edges / cell_edges)) blocks a side, so a cell holds some
    `cell_edges` edges; a vertex that has a third of all edges spreads over a whole row of cells and fills none with
    more than blocks / 3 times that. `hot_rows`: edges of one vertex beyond which its parent is looked up by
    broadcast (see lookup_join).
    """
    scratch = Scratch(pairs.sparkSession, "components")

    def edges(x, y) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    now = scratch.save(pairs.where(F.col(a) != F.col(b)).select(*edges(F.col(a).cast("long"), F.col(b).cast("long"))).distinct())
    rounds: list[DataFrame] = []
    while n := now.count():
        side = math.ceil(math.sqrt(n / cell_edges))
        block = lambda c: F.pmod(F.xxhash64(F.lit(len(rounds)), c), F.lit(side)).alias(f"of_{c}")  # noqa: E731, B023
        local = now.select("a", "b", block("a"), block("b")).groupBy("of_a", "of_b").applyInArrow(_cell, "v long, rep long")
        parent = scratch.save(local.groupBy("v").agg(F.min("rep").alias("rep")))
        rounds.append(parent)
        if side == 1:
            break  # one cell has seen all edges
        moved = lookup_join(now, parent.select(F.col("v").alias("a"), F.col("rep").alias("ra")), "a", "inner", hot_rows, n)
        moved = lookup_join(moved, parent.select(F.col("v").alias("b"), F.col("rep").alias("rb")), "b", "inner", hot_rows, n)
        after = scratch.save(moved.where("ra <> rb").select(*edges(F.col("ra"), F.col("rb"))).distinct())
        scratch.drop(now)
        now = after
    if not rounds:
        return now.select(F.col("a").alias("v"), F.col("b").alias("group_id"))
    final = rounds[-1]
    for parent in reversed(rounds[:-1]):
        up = final.select(F.col("v").alias("rep"), F.col("rep").alias("_top"))
        final = lookup_join(parent, up, "rep", hot_rows=hot_rows).select("v", F.coalesce("_top", "rep").alias("rep"))
    return final.select("v", F.col("rep").alias("group_id"))
