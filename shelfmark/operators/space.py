"""Where the space goes: folder contents, largest files, statistics by type and size, treemap."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import BANDS, CATEGORIES, band, category, extension, kind_of
from ..shared import Scratch


def folder_items(entries: DataFrame, stats: DataFrame, parent: int | None = None) -> DataFrame:
    """Children with the size and number of files a view shows: a folder's totals, a file's own; sort by size desc, name."""
    e = entries.where(F.col("parent_id") == parent) if parent is not None else entries.where("parent_id IS NOT NULL")
    j = e.join(stats.select(F.col("entry_id").alias("id"), "total_size", "file_count"), "id", "left")
    return j.select(
        "parent_id", "id", "name", kind_of(F.col("is_dir"), F.col("name")).alias("kind"),
        F.when(F.col("is_dir"), F.coalesce("total_size", F.lit(0))).otherwise(F.col("size")).alias("size"),
        F.when(F.col("is_dir"), F.coalesce("file_count", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("files"),
    )


def folder_page(items: DataFrame, rows: int = 1000) -> DataFrame:
    """`parent_id, id, pos, more`: the `rows` largest children of each folder (then by name, id) and how many there are besides; unknown sizes come last."""
    n = items.groupBy("parent_id").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("parent_id").orderBy(F.coalesce("size", F.lit(-1)).desc(), "name", "id")).cast("long")
    shown = items.withColumn("pos", at).where(F.col("pos") <= rows)
    return shown.join(n, "parent_id").select("parent_id", "id", "pos", F.greatest(F.col("n") - rows, F.lit(0)).alias("more"))


def largest_files(entries: DataFrame, n: int) -> DataFrame:
    """The `n` largest files, ties by id; pass a subtree or a volume's entries for a narrower question."""
    return entries.where("NOT is_dir AND size IS NOT NULL").orderBy(F.desc("size"), "id").limit(n)


def type_stats(entries: DataFrame, top: int) -> DataFrame:
    """`what, key, files, bytes` over the files: total, all categories, all size bands, the `top` extensions by bytes and the others.

    One pass aggregates by extension and band; the constant categories and bands without files give zeros.
    """
    spark = entries.sparkSession
    f = entries.where("NOT is_dir").select(extension(F.col("name")).alias("ext"), band(F.coalesce("size", F.lit(0))).alias("band"), F.coalesce("size", F.lit(0)).alias("size"))
    base = f.groupBy("ext", "band").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    sums = [F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes")]
    total = base.agg(*sums).select(F.lit("total").alias("what"), F.lit("").alias("key"), "files", "bytes")
    cats = spark.createDataFrame([(c,) for c in CATEGORIES], "key string")
    by_cat = F.broadcast(cats).join(base.select(category(F.col("ext")).alias("key"), "files", "bytes"), "key", "left").groupBy("key").agg(*sums).select(F.lit("category").alias("what"), "key", "files", "bytes")
    bands = spark.createDataFrame([(i,) for i in range(len(BANDS))], "band long")
    by_band = F.broadcast(bands).join(base.select("band", "files", "bytes"), "band", "left").groupBy("band").agg(*sums).select(F.lit("band").alias("what"), F.col("band").cast("string").alias("key"), "files", "bytes")
    exts = base.groupBy("ext").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    first = exts.orderBy(F.desc("bytes"), "ext").limit(top)
    by_ext = first.select(F.lit("extension").alias("what"), F.col("ext").alias("key"), "files", "bytes")
    rest = exts.join(F.broadcast(first.select("ext")), "ext", "left_anti").agg(*sums).select(F.lit("other_extensions").alias("what"), F.lit("").alias("key"), "files", "bytes")
    return total.unionByName(by_cat).unionByName(by_band).unionByName(by_ext).unionByName(rest)


def treemap(paths: DataFrame, stats: DataFrame, root: int, budget: int = 12_000, min_fraction: float = 0.00002, levels: int = 64) -> DataFrame:
    """`id, parent_id, name, size, is_dir, depth, other`: the nodes that a treemap of `root` draws, the root with depth 0 included.

    Folders open largest first (of equal ones the shallower, then the lesser id), at most `levels` deep, and show their
    children of at least `min_fraction` of the root, largest first (then by name, id), until `budget` nodes below the
    root are shown. `other` is what an opened folder holds besides, all of it where no child is large enough. A child is never larger than its folder, so this
    order is a global one: the folders that open are the first ones by size until their children fill the budget; only
    as many folders, and as many children of each, as the budget are ever ranked.
    """
    c = F.col
    size = F.when(c("is_dir"), F.coalesce("total_size", F.lit(0))).otherwise(F.coalesce("size", F.lit(0)))
    inside = paths.where((c("id") == root) | F.array_contains("ancestors", F.lit(root).cast("long")))
    inside = inside.join(stats.select(c("entry_id").alias("id"), "total_size"), "id", "left").select("id", "parent_id", "name", "is_dir", size.alias("size"), c("depth").cast("int").alias("depth"))
    top = inside.where(c("id") == root).select("size", "depth").first()
    if top is None:
        return inside.withColumn("other", F.lit(0).cast("long")).limit(0)
    inside = Scratch(paths.sparkSession, "treemap").save(inside.withColumn("depth", c("depth") - top["depth"]))
    below = inside.where((c("id") != root) & (c("depth") <= levels))
    shown = below.where(c("size") >= max(1, math.ceil((top["size"] or 0) * min_fraction)))
    per = shown.groupBy(c("parent_id").alias("id")).agg(F.count("*").alias("n"))
    order = [c("size").desc(), c("depth"), c("id")]
    first = inside.where("is_dir").join(per, "id").orderBy(*order).limit(budget)
    before = F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = Scratch(paths.sparkSession, "treemap").save(first.select("id", "size", "depth", "n", before.alias("before")).where(c("before") < budget))
    last = opened.where(c("before") + c("n") >= budget).first()  # where the budget ends
    opened = F.broadcast(opened.select(c("id").alias("parent_id"), "before"))  # at most `budget` rows
    at = F.row_number().over(Window.partitionBy("parent_id").orderBy(c("size").desc(), "name", "id"))
    kids = shown.join(opened, "parent_id").withColumn("at", at).where(c("at") <= budget).where(c("before") + c("at") <= budget)
    kids = Scratch(paths.sparkSession, "treemap").save(kids.select("id", "parent_id", "name", "size", "is_dir", "depth"))
    # folders that open, but hold nothing large enough
    hollow = kids.where("is_dir").select("id", "size", "depth").unionByName(inside.where(c("id") == root).select("id", "size", "depth")).join(opened.select(c("parent_id").alias("id")), "id", "left_anti").where(c("depth") < levels)
    if last is not None:
        hollow = hollow.where(F.struct(-c("size"), "depth", "id") < F.struct(*[F.lit(x).cast(k) for x, k in ((-last["size"], "long"), (last["depth"], "int"), (last["id"], "long"))]))
    everything = opened.select("parent_id").unionByName(F.broadcast(hollow.select(c("id").alias("parent_id"))))  # at most twice the budget
    held = below.join(everything, "parent_id").groupBy(c("parent_id").alias("id")).agg(F.sum("size").alias("held"))
    drawn = kids.groupBy(c("parent_id").alias("id")).agg(F.sum("size").alias("drawn"))
    nodes = inside.where(c("id") == root).select("id", F.lit(None).cast("long").alias("parent_id"), "name", "size", "is_dir", "depth").unionByName(kids)
    return nodes.join(held, "id", "left").join(drawn, "id", "left").select("id", "parent_id", "name", "size", "is_dir", "depth", (F.coalesce("held", F.lit(0)) - F.coalesce("drawn", F.lit(0))).alias("other"))
