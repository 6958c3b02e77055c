"""Content hashes: validity, work lists of the hashing passes, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import local_content
from ..shared import numbered


def quick_hash(content: Column, ends: int = 65_536) -> Column:
    """Digest of the size (eight bytes, the least first) and both ends of a binary content, which don't overlap."""
    n = F.octet_length(content)
    tail = F.greatest(n - ends, F.lit(ends))
    size = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(8)]))
    return F.sha2(F.concat(size, F.substring(content, 1, ends), F.when(n > ends, F.substring(content, tail + 1, ends)).otherwise(F.lit(b""))), 256)


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def with_hashes(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """Entries (id, size, modified...) with the hashes that are valid for them: same size and same time, null equal to null."""
    h = hashes.select(F.col("entry_id").alias("id"), F.col("size").alias("_s"), F.col("modified").alias("_m"), "quick", "full")
    valid = (F.col("size") == F.col("_s")) & F.col("modified").eqNullSafe(F.col("_m"))
    j = entries.join(h, "id", "left")
    return j.withColumns({"quick": F.when(valid, F.col("quick")), "full": F.when(valid, F.col("full"))}).drop("_s", "_m")


def workable(entries: DataFrame) -> DataFrame:
    return entries.where((F.col("size") > 0) & local_content(F.col("attrs")))


def quick_work(hashed: DataFrame) -> DataFrame:
    """Files without a valid quick hash whose size another file has; largest first."""
    sizes = hashed.where("size > 0").groupBy("size").count().where("count > 1").select("size")
    return workable(hashed).where("quick IS NULL").join(sizes, "size", "left_semi").select("id", "size").orderBy(F.desc("size"), "id")


def shared_quick(hashed: DataFrame) -> DataFrame:
    """(size, quick hash) of more than one file."""
    return hashed.where("quick IS NOT NULL").groupBy("size", "quick").agg(F.count("*").alias("n")).where("n > 1")


def full_pending(hashed: DataFrame) -> DataFrame:
    """`id, size, candidate`: files without a valid full hash, and whether another file shares their size and quick hash."""
    c = shared_quick(hashed).select("size", "quick", F.lit(True).alias("candidate"))
    return workable(hashed).where("full IS NULL").join(c, ["size", "quick"], "left").select("id", "size", F.coalesce("candidate", F.lit(False)).alias("candidate"))


def full_order() -> list[Column]:
    """Candidates largest first, then the others smallest first, ties by id."""
    return [F.col("candidate").desc(), F.when(F.col("candidate"), -F.col("size")).otherwise(F.col("size")).asc(), F.col("id").asc()]


def full_work(hashed: DataFrame) -> DataFrame:
    """Files without a valid full hash in the order of the pass."""
    return full_pending(hashed).orderBy(*full_order())


def hash_order(hashed: DataFrame) -> DataFrame:
    """`id, pos`: the place of every pending file in the full pass, from 1."""
    return numbered(full_pending(hashed), full_order(), "pos").select("id", "pos")


def progress(hashed: DataFrame, by: str = "volume_id") -> DataFrame:
    """Per volume: files to hash, with a valid full hash, and pending ones."""
    g = workable(hashed).groupBy(by).agg(F.count("*").alias("files"), F.count("full").alias("hashed"))
    return g.withColumn("pending", F.col("files") - F.col("hashed"))


def passes(hashed: DataFrame) -> DataFrame:
    """Which pass reads each file first: 1 the ends, for a shared size; 2 all, for a shared quick hash; 3 all, the rest; 0 done."""
    q = quick_work(hashed).select("id", F.lit(1).alias("quick_pass"))
    f = full_work(hashed).select("id", F.when(F.col("candidate"), 2).otherwise(3).alias("full_pass"))
    j = workable(hashed).select("id").join(q, "id", "left").join(f, "id", "left")
    return j.select("id", F.coalesce("quick_pass", "full_pass", F.lit(0)).cast("long").alias("pass"))


def changed_recently(modified_ms: Column, now_ms: int, window_ms: int = 600_000) -> Column:
    """Files changed within the window around now are left for later."""
    return (modified_ms > now_ms - window_ms) & (modified_ms < now_ms + window_ms)


def work_state(entries: DataFrame, hashes: DataFrame, prints: DataFrame) -> DataFrame:
    """`id, has_quick, has_full, has_print`: what is known of each file as it is now; prints: entry_id, size, modified."""
    valid = (F.col("size") == F.col("_s")) & F.col("modified").eqNullSafe(F.col("_m"))
    p = prints.select(F.col("entry_id").alias("id"), F.col("size").alias("_s"), F.col("modified").alias("_m"))
    ok = entries.select("id", "size", "modified").join(p, "id").where(valid).select("id", F.lit(True).alias("_p")).distinct()
    j = with_hashes(entries, hashes).join(ok, "id", "left")
    return j.select("id", F.col("quick").isNotNull().alias("has_quick"), F.col("full").isNotNull().alias("has_full"), F.col("_p").isNotNull().alias("has_print"))


def waiting(paused: bool) -> Column:
    """Why the analysis of a volume isn't running, from left (files without a hash), running, excluded, busy, skipped (files that couldn't be read); null if it runs or has nothing to do."""
    c = F.col
    why = F.when(c("excluded"), "excluded")
    why = why.when(F.lit(paused), "paused").when(c("busy"), "busy").when(c("skipped") >= c("left"), "skipped").otherwise("next")
    return F.when(~c("running") & (c("left") > 0), why)


def only_skipped_left() -> Column:
    """Whether all that is left of files, images and videos are ones that couldn't be read: files, hashed, images, printed, videos, videos_printed, skipped_files, skipped_prints."""
    less = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    files, prints = less("files", "hashed"), less("images", "printed") + less("videos", "videos_printed")
    return (files + prints > 0) & (F.col("skipped_files") >= files) & (F.col("skipped_prints") >= prints)


def hash_percent(hashed: Column, total: Column) -> Column:
    return F.when(total <= 0, 100).otherwise(F.least(F.lit(100), F.floor(hashed * 100 / total))).cast("long")


def read_contents(spark, path: str, expected: DataFrame) -> DataFrame:
    """`id, content, state` of files read whole from a folder: expected has id, path (as read), size, modified_ms.

    state: ok, missing, or changed where size or time of what was read isn't what the catalog expects; then content is
    null. The size and time are those of the file as it was listed for reading. An empty file has nothing to read and
    counts as missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("_size"), F.unix_millis("modificationTime").alias("_ms"), "content")
    j = expected.select("id", "path", "size", "modified_ms").join(files, "path", "left")
    same = (F.col("_size") == F.col("size")) & F.col("_ms").eqNullSafe(F.col("modified_ms"))
    return j.select("id", F.when(same, F.col("content")).alias("content"), F.when(F.col("_size").isNull(), "missing").when(same, "ok").otherwise("changed").alias("state"))
