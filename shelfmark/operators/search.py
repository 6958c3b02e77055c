"""Running a search: the parsed query becomes column conditions, matches are scored and ranked.

The name index is a projection (folded name, size, time) that callers may persist; volumes are pruned first, and
conditions are ordered from cheap to dear: kind, size, time, words, types, pattern, path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import category, extension, fold, fold_text, match_score
from ..plans.search_query import Query


class UnknownDisk(ValueError):
    """A `disk:` filter that names no volume."""


def name_index(entries: DataFrame) -> DataFrame:
    """What a search reads of an entry; roots never match, so they are left out."""
    return entries.where("parent_id IS NOT NULL").select("id", "volume_id", "parent_id", "name", fold(F.col("name")).alias("folded"), "is_dir", "size", "modified_ms")


def _volumes(q: Query, volumes: DataFrame) -> list[int] | None:
    """Ids of the volumes that take part (volumes are few: one row per disk); None for all."""
    if not q.disks and not q.online:
        return None
    rows = volumes.select("id", "user_name", "os_label", "last_mount", "online").collect()
    left = {r["id"] for r in rows}
    for d in q.disks:
        want = fold_text(d.rstrip("\\"))
        hit = {r["id"] for r in rows if any(n and fold_text(n.rstrip("\\")) == want for n in (r["user_name"], r["os_label"], r["last_mount"]))}
        if not hit:
            raise UnknownDisk(d)
        left &= hit
    for on in q.online:
        left &= {r["id"] for r in rows if r["online"] == on}
    return sorted(left)


def matches(index: DataFrame, volumes: DataFrame, q: Query, paths: DataFrame | None = None) -> DataFrame:
    """The rows of the index that the query asks for, with `score`; an empty query asks for nothing.

    `paths` (id, path) is needed for `path:` only, and is joined to the rows that the other conditions leave.
    """
    if q.empty():
        return index.where(F.lit(False)).withColumn("score", F.lit(0).cast("long"))
    df = index
    vols = _volumes(q, volumes)
    if vols is not None:
        df = df.where(F.col("volume_id").isin(vols))
    if q.is_dir is not None:
        df = df.where(F.col("is_dir") == q.is_dir)
    if q.sizes or q.exts or q.types:
        df = df.where(~F.col("is_dir"))
    for lo, hi in q.sizes:
        if lo is not None:
            df = df.where(F.col("size") >= lo)
        if hi is not None:
            df = df.where(F.col("size") <= hi)
    for lo, hi in q.times:
        df = df.where(F.col("modified_ms").isNotNull())
        if lo is not None:
            df = df.where(F.col("modified_ms") >= lo)
        if hi is not None:
            df = df.where(F.col("modified_ms") < hi)
    for t in sorted(q.terms, key=len, reverse=True):
        df = df.where(F.contains("folded", F.lit(t)))
    ext = extension(F.col("folded"))
    if q.exts:
        df = df.where(ext.isin(sorted(set.intersection(*q.exts))))
    if q.types:
        df = df.where(category(ext).isin(sorted(set.intersection(*q.types))))
    for r in q.regexes:
        df = df.where(F.col("folded").rlike(f"(?iu){r}"))
    if q.paths:
        folder = paths.select(F.col("id").alias("parent_id"), fold(F.col("path")).alias("_p"))
        df = df.join(folder, "parent_id")
        for p in q.paths:
            df = df.where(F.contains("_p", F.lit(p)))
        df = df.drop("_p")
    score = match_score(F.col("folded"), q.terms[0]) if q.terms else F.lit(3)
    return df.withColumn("score", (score * 1000 + F.least(F.octet_length("folded"), F.lit(999))).cast("long"))


def ranked(found: DataFrame, limit: int = 200) -> DataFrame:
    """The best matches: least score, then volume, then entry."""
    return found.orderBy("score", "volume_id", "id").limit(limit)


def capped_total(found: DataFrame, cap: int = 10_000) -> int:
    return found.limit(cap).count()


def hits(best: DataFrame, paths: DataFrame, volumes: DataFrame, stats: DataFrame) -> DataFrame:
    """Ranked matches with folder path, kind, shown size, disk name and state."""
    c = F.col
    p = paths.select(c("id").alias("parent_id"), c("path").alias("folder"))
    v = volumes.select(c("id").alias("volume_id"), F.coalesce(F.nullif(F.trim("user_name"), F.lit("")), F.nullif(F.trim("os_label"), F.lit("")), F.nullif(F.trim("last_mount"), F.lit("")), F.concat(F.lit("#"), c("id").cast("string"))).alias("disk"), "online", "location")
    s = stats.select(c("entry_id").alias("id"), "total_size")
    j = best.join(p, "parent_id").join(v, "volume_id").join(s, "id", "left")
    kind = F.when(c("is_dir"), "dir").otherwise(category(extension(c("folded"))))
    return j.select("id", "score", "name", "folder", kind.alias("kind"), F.when(c("is_dir"), F.coalesce("total_size", F.lit(0))).otherwise(c("size")).alias("size"), "modified_ms", "disk", "online", "location")


def trigrams(entries: DataFrame) -> DataFrame:
    """`gram, id`: every run of three characters of a folded name, once for each name; shorter names have none."""
    e = entries.select("id", fold(F.col("name")).alias("n")).where(F.char_length("n") >= 3).distinct()
    grams = F.transform(F.sequence(F.lit(1), F.char_length("n") - 2), lambda i: F.substring("n", i, F.lit(3)))
    return e.select(F.explode(F.array_distinct(grams)).alias("gram"), "id").distinct()


class LiveIndex:
    """A name index kept as a table under `path`, a folder for each volume; volumes that changed are written anew, at most every `interval_ms`.

    A volume that has no index yet is due at once. Only due volumes are read and rewritten; readers of the others are
    not disturbed.
    """

    def __init__(self, path: str, interval_ms: int):
        self.path, self.interval_ms = path, interval_ms
        self.dirty: set[int] = set()
        self.built: dict[int, int] = {}

    def touch(self, *volumes: int) -> None:
        self.dirty |= set(volumes)

    def due(self, now_ms: int) -> list[int]:
        return sorted(v for v in self.dirty if v not in self.built or now_ms - self.built[v] >= self.interval_ms)

    def refresh(self, entries: DataFrame, now_ms: int) -> list[int]:
        """Rebuilds what is due and says which volumes that were."""
        volumes = self.due(now_ms)
        if volumes:
            index = name_index(entries.where(F.col("volume_id").isin(volumes))).repartition("volume_id")
            index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("volume_id").parquet(self.path)
            self.dirty -= set(volumes)
            self.built |= dict.fromkeys(volumes, now_ms)
        return volumes
