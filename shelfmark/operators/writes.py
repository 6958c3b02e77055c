"""Changes to catalog tables as new versions of them: operation logs, upserts, removals, deletion plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_ops(entries: DataFrame, ops: DataFrame, columns: list[str]) -> DataFrame:
    """`entries` after a log of ops (seq, op, id and the columns): insert, update, move, delete.

    Per id the ops apply in the order of seq: a delete ends the row, an insert sets all columns, an update or move
    replaces the columns it carries; as aggregates, so an id with very many ops is reduced before it is shuffled. Ops
    on absent rows do nothing, except inserts. Deletes name every row of a subtree.
    """
    seq = F.col("seq")
    mark = F.max(F.when(F.col("op").isin("insert", "delete"), seq)).alias("_mark")
    last = F.max_by("op", F.when(F.col("op").isin("insert", "delete"), seq)).alias("_op")
    # a value counts if it came with or after the mark; both are known once the group is
    g = ops.groupBy("id").agg(mark, last, *[F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(f"_{c}") for c in columns])
    j = entries.select("id", *columns, F.lit(True).alias("_was")).join(g, "id", "full_outer")
    fresh = F.col("_op") == "insert"
    alive = F.when(F.col("_op").isNull(), F.col("_was")).otherwise(fresh)

    def value(c: str) -> Column:
        new, v = F.col(f"_{c}"), F.col(f"_{c}")[c]
        return F.when(F.col("_mark").isNotNull(), F.when(new["seq"] >= F.col("_mark"), v)).otherwise(F.coalesce(v, F.col(c))).alias(c)

    return j.where(F.coalesce(alive, F.lit(False))).select("id", *[value(c) for c in columns])


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key; of several new ones the greatest `order`.

    With `existing` (one column, named like the first key) only rows whose entry still exists are taken.
    """
    if existing is not None:
        new = new.join(existing, key[0], "left_semi")
    if order:
        rest = [c for c in old.columns if c not in key]
        new = new.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def remove_volume(entries: DataFrame, volume: int) -> DataFrame:
    return entries.where(~F.col("volume_id").eqNullSafe(F.lit(volume)))


def update_volumes(volumes: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Volumes with the non-null columns of `changes` (one row per id) in place."""
    c = changes.select("id", *[F.col(x).alias(f"_{x}") for x in columns])
    j = volumes.join(c, "id", "left")
    return j.withColumns({x: F.coalesce(f"_{x}", x) for x in columns}).drop(*[f"_{x}" for x in columns])


def prune(readings: DataFrame, before_ms: int) -> DataFrame:
    return readings.where(F.col("at_ms") >= before_ms)


def deletion_plan(wanted: DataFrame, disk: DataFrame) -> DataFrame:
    """`id, outcome`: done, skipped_missing or skipped_changed for every chosen file, by what the disk holds now (id, size, modified)."""
    d = disk.select("id", F.col("size").alias("s"), F.col("modified").alias("m"), F.lit(True).alias("there"))
    j = wanted.select("id", "size", "modified").dropDuplicates(["id"]).join(d, "id", "left")
    same = (F.col("s") == F.col("size")) & F.col("m").eqNullSafe(F.col("modified"))
    return j.select("id", F.when(F.col("there").isNull(), "skipped_missing").when(same, "done").otherwise("skipped_changed").alias("outcome"))


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def subtree_deletes(paths: DataFrame, ops: DataFrame) -> DataFrame:
    """A log of ops for `apply_ops` in which every `delete_subtree` names each entry at or below its id; `paths` as of `tree.with_paths`."""
    cut = ops.where("op = 'delete_subtree'").select(F.col("id").alias("_top"), "seq")
    rows = paths.select("id", F.explode(F.concat("ancestors", F.array("id"))).alias("_top")).join(cut, "_top").select("seq", F.lit("delete").alias("op"), "id")
    return ops.where("op <> 'delete_subtree'").unionByName(rows, allowMissingColumns=True)


def put_volume(volumes: DataFrame, new: DataFrame) -> DataFrame:
    """Volumes with new ones (without id) added after the greatest id, in the order of their columns."""
    last = volumes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    w = Window.orderBy(*[F.col(c) for c in new.columns])  # a handful of disks
    return volumes.unionByName(new.withColumn("id", F.row_number().over(w).cast("long") + last), allowMissingColumns=True)


def set_volumes(volumes: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Volumes with the columns of `changes` (one row per id) in place, nulls too: labels, the journal position, the address of a share."""
    c = changes.select("id", F.lit(True).alias("_set"), *[F.col(x).alias(f"_{x}") for x in columns])
    j = volumes.join(c, "id", "left")
    return j.withColumns({x: F.when(F.col("_set"), F.col(f"_{x}")).otherwise(F.col(x)) for x in columns}).drop("_set", *[f"_{x}" for x in columns])


def reset_catalog(tables: dict[str, DataFrame], keep: tuple[str, ...] = ("settings", "actions_log")) -> dict[str, DataFrame]:
    """All tables of a catalog emptied but the settings and the log."""
    return {n: t if n in keep else t.limit(0) for n, t in tables.items()}
