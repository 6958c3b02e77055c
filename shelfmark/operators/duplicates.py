"""Exact duplicates: groups, filters, which copies to keep, what a deletion would leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import category, extension, fold, fold_text

KEY = ["size", "full"]


def members(files: DataFrame, min_size: int = 1) -> DataFrame:
    """The files (id, size, full...) whose content another file has, with `copies`; empty files never group."""
    known = files.where((F.col("size") >= max(1, min_size)) & F.col("full").isNotNull())
    groups = known.groupBy(*KEY).agg(F.count("*").alias("copies")).where("copies > 1")
    return known.join(groups, KEY)


def summary(dups: DataFrame) -> DataFrame:
    """Per group: copies, bytes to recover, copies online and offline, and the least id."""
    g = dups.groupBy(*KEY).agg(F.count("*").alias("copies"), F.count_if("online").alias("online"), F.min("id").alias("first_id"))
    return g.withColumn("recoverable", F.col("size") * (F.col("copies") - 1)).withColumn("offline", F.col("copies") - F.col("online"))


def totals(dups: DataFrame) -> DataFrame:
    return summary(dups).agg(F.count("*").alias("groups"), F.coalesce(F.sum("copies"), F.lit(0)).alias("files"), F.coalesce(F.sum("recoverable"), F.lit(0)).alias("recoverable"))


def filtered(dups: DataFrame, min_size: int = 1, of_category: str | None = None, volume: int | None = None, path_part: str | None = None) -> DataFrame:
    """Keys of groups: of a least size, whose first member (least id) is of the category, with a member on the volume, and one whose path has the text (on that volume, if one is given)."""
    on = F.lit(True) if volume is None else F.col("volume_id") == volume
    with_text = on if path_part is None else on & F.contains(fold(F.col("path")), F.lit(fold_text(path_part)))
    g = dups.where(F.col("size") >= min_size).groupBy(*KEY).agg(F.min_by("name", "id").alias("first_name"), F.max(on).alias("on_volume"), F.max(with_text).alias("has_text"))
    g = g.where("on_volume AND has_text")
    return (g if of_category is None else g.where(category(extension(F.col("first_name"))) == of_category)).select(*KEY)


def largest_groups(dups: DataFrame, n: int = 300) -> DataFrame:
    return summary(dups).orderBy(F.desc("recoverable"), F.desc("size"), "full").limit(n)


def selected(dups: DataFrame, rules: list[tuple]) -> DataFrame:
    """Ids chosen for deletion, as the rules narrow who is kept, in their order.

    Rules: ("keep_on_volume", id), ("keep_oldest",), ("keep_newest",), ("keep_shortest_path",), ("never_in", text). A
    rule that fits none of those left is skipped; of those left in the end the least id is kept. Copies that are
    offline, or whose path has the text of a `never_in`, are never chosen. Where all times are unknown, every copy
    fits an oldest or newest rule. What the rules narrow down to is the least copy in the order that compares by one rule
    after the other, so one mergeable aggregate per group finds it and no group is held in one task.
    """
    order = []
    for n, rule in enumerate(rules):
        if rule[0] == "keep_on_volume":
            key = F.when(F.col("volume_id") == rule[1], 0).otherwise(1).cast("long")
        elif rule[0] == "keep_oldest":
            key = F.coalesce("modified", F.lit((1 << 63) - 1))
        elif rule[0] == "keep_newest":
            key = F.coalesce(-F.col("modified"), F.lit((1 << 63) - 1))
        elif rule[0] == "keep_shortest_path":
            key = F.coalesce(F.char_length("path"), F.lit(1 << 31)).cast("long")
        elif rule[0] == "never_in":
            continue
        else:
            raise ValueError(f"unknown rule {rule[0]}")
        order.append(key.alias(f"k{n}"))
    keeper = dups.groupBy(*KEY).agg(F.min(F.struct(*order, F.col("id").alias("keeper"))).alias("_k")).select(*KEY, "_k.keeper")
    chosen = dups.join(keeper, KEY).where(F.col("online") & (F.col("id") != F.col("keeper")))
    for rule in rules:
        if rule[0] == "never_in":
            chosen = chosen.where(~F.contains(fold(F.col("path")), F.lit(fold_text(rule[1]))))
    return chosen.select("id", *KEY)


def last_copies(files: DataFrame, doomed: DataFrame, allow_offline: bool = False) -> DataFrame:
    """`id, verdict` of every doomed file: ok, last_copy, only_offline or no_hash."""
    d = doomed.select("id", F.lit(True).alias("doomed")).distinct()
    known = files.where(F.col("full").isNotNull() & (F.col("size") > 0)).join(d, "id", "left")
    kept = F.col("doomed").isNull()
    g = known.groupBy(*KEY).agg(F.count_if(kept).alias("kept"), F.count_if(kept & F.col("online")).alias("kept_online"))
    j = d.join(known.select("id", *KEY), "id", "left").join(g, KEY, "left")
    verdict = F.when(F.col("full").isNull(), "no_hash").when(F.col("kept") == 0, "last_copy")
    if not allow_offline:
        verdict = verdict.when(F.col("kept_online") == 0, "only_offline")
    return j.select("id", verdict.otherwise("ok").alias("verdict"))


def kept_copies(files: DataFrame, doomed: DataFrame) -> DataFrame:
    """`id, kept_id`: for each doomed file the least id among the copies that stay, and how many there are."""
    d = doomed.select("id").distinct()
    known = files.where(F.col("full").isNotNull())
    stay = known.join(d, "id", "left_anti").groupBy(*KEY).agg(F.min("id").alias("kept_id"), F.count("*").alias("kept"))
    return known.join(d, "id", "left_semi").select("id", *KEY).join(stay, KEY).select("id", "kept_id", "kept")


def can_select(dups: DataFrame, chosen: DataFrame) -> DataFrame:
    """`id, can_select` of every copy: it is connected, and chosen already or not the last copy of its content that isn't."""
    d = dups.join(chosen.select("id", F.lit(True).alias("_c")).distinct(), "id", "left")
    left = d.groupBy(*KEY).agg(F.count_if(F.col("_c").isNull()).alias("_left"))
    return d.join(left, KEY).select("id", (F.coalesce("online", F.lit(False)) & (F.col("_c").isNotNull() | (F.col("_left") > 1))).alias("can_select"))


def only_offline_left(dups: DataFrame, chosen: DataFrame) -> DataFrame:
    """Contents of which something is chosen and something stays, but only on disks that aren't connected."""
    d = dups.join(chosen.select("id", F.lit(True).alias("_c")).distinct(), "id", "left")
    stays = F.col("_c").isNull()
    g = d.groupBy(*KEY).agg(F.count_if(~stays).alias("c"), F.count_if(stays).alias("l"), F.count_if(stays & F.coalesce("online", F.lit(False))).alias("o"))
    return g.where("c > 0 AND l > 0 AND o = 0").select(*KEY)


def same_file(a: DataFrame, b: DataFrame) -> DataFrame:
    """`a, b` that are one file on disk: id, serial (of the volume), number (64 bits), server (of a connected share, else null).

    The same number on the same volume, or on one server the same low 32 bits of it that aren't all zero, as one disk
    may be shown under two shares. The OR is a union of two equi-joins.
    """
    low = F.col("number").bitwiseAND(0xFFFFFFFF)
    side = lambda d, to: d.select(F.col("id").alias(to), "serial", "number", fold(F.col("server")).alias("server"), low.alias("low"))
    x, y = side(a, "a"), side(b, "b")
    by_number = x.select("a", "serial", "number").join(y.select("b", "serial", "number"), ["serial", "number"]).select("a", "b")
    by_server = x.where("low <> 0").select("a", "server", "low").join(y.select("b", "server", "low"), ["server", "low"]).select("a", "b")
    return by_number.union(by_server).distinct()
