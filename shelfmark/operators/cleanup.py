"""Proposals for cleaning up: temporary and old files, empty folders, caches; what no proposal may touch."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fold, fold_text
from .tree import top_empty

#: Folders no proposal touches, from any volume's root; `*` is any one name.
PROTECTED = [
    "Windows", "Program Files", "Program Files (x86)", "ProgramData", "Recovery", "PerfLogs", "Boot", "EFI", "$Recycle.Bin", "System Volume Information",
    "$WinREAgent", "WindowsApps", "inetpub", "Users\\*\\AppData", "Users\\Default", "Users\\All Users",
]
#: Cache folders of browsers, by layout: directly in the browser's folder, and in each profile.
CACHES = {"chromium": (["ShaderCache", "GrShaderCache", "GraphiteDawnCache"], ["Cache", "Code Cache", "GPUCache"]), "firefox": ([], ["cache2"])}
#: Attribute bits hidden, system, reparse point.
GUARDED_BITS = 0x2 | 0x4 | 0x400


def protected(path: Column, patterns: list[str]) -> Column:
    """Whether the path is, or lies below, one of the patterns (any case, `*` for one name)."""
    out = F.lit(False)
    for p in patterns:
        names = [x for x in re.split(r"[\\/]", p) if x]
        body = r"\\".join(r"[^\\]+" if n == "*" else f"\\Q{fold_text(n)}\\E" for n in names)
        out = out | fold(path).rlike(rf"^{body}(\\|$)")
    return out


def guarded(paths: DataFrame) -> DataFrame:
    """Ids of entries that are hidden, system or a link, or start with `.` or `$`, and of all below such folders (roots set aside)."""
    own = paths.where(F.col("parent_id").isNotNull() & ((F.coalesce("attrs", F.lit(0)).bitwiseAND(GUARDED_BITS) != 0) | F.col("name").rlike(r"^[.$]"))).select("id")
    below = paths.select("id", F.explode("ancestors").alias("a")).join(own.select(F.col("id").alias("a")), "a", "left_semi").select("id")
    return own.union(below).distinct()


def excluded(paths: DataFrame, names: list[str], folders: list[str]) -> DataFrame:
    """Entries with an excluded folder name anywhere on their path, or at or below an excluded path; whole names in any case."""
    parts = F.split(fold(F.col("path")), r"\\")
    hit = F.arrays_overlap(parts, F.array(*[F.lit(fold_text(n)) for n in names])) if names else F.lit(False)
    return paths.where(hit | protected(F.col("path"), folders))


def inside_holders(paths: DataFrame, like: str = "%.dll") -> DataFrame:
    """Entries in (or being) a folder, not a root, that directly holds a file whose name is like that, in any case of letters."""
    holders = paths.where(~F.col("is_dir") & F.lower("name").like(like.lower())).select(F.col("parent_id").alias("a")).distinct()
    roots = paths.where("parent_id IS NULL").select(F.col("id").alias("a"))
    holders = holders.join(roots, "a", "left_anti")
    hit = paths.select("id", F.explode(F.concat("ancestors", F.array("id"))).alias("a")).join(holders, "a", "left_semi").select("id").distinct()
    return paths.join(hit, "id", "left_semi")


def large_old(entries: DataFrame, time: str, least: int, before: int) -> DataFrame:
    """Files of at least that size not changed since; largest first. Files of unknown time are left out."""
    return entries.where(~F.col("is_dir") & (F.col("size") >= least) & (F.col(time) < before)).orderBy(F.desc("size"), "id")


def known_children(paths: DataFrame, parents: DataFrame, names: list[str]) -> DataFrame:
    """Folders in one of the `parents` (parent_id) with one of the `names`: the exact name, or else the first by name that differs in case only."""
    c = F.col
    exact = F.create_map(*[F.lit(x) for n in names for x in (fold_text(n), n)])
    kids = paths.withColumn("_k", fold(c("name"))).where(c("_k").isin([fold_text(n) for n in names])).join(parents.select("parent_id").distinct(), "parent_id", "left_semi")
    kids = kids.withColumn("_o", F.struct((c("name") != exact[c("_k")]).alias("other"), "name"))
    best = kids.groupBy("parent_id", "_k").agg(F.min("_o").alias("_b"))
    return kids.join(best, ["parent_id", "_k"]).where("is_dir AND _o = _b").select(*paths.columns)


def browser_caches(paths: DataFrame, stats: DataFrame, folder: str, layout: str) -> DataFrame:
    """Known cache folders of a browser on each volume, with their total `_t`: in its folder (a path, any case) and in each profile there; never profiles themselves, nor empty caches."""
    direct, inner = CACHES[layout]
    at = paths.where(fold(F.col("path")) == fold_text(folder)).groupBy("volume_id").agg(F.min("id").alias("parent_id")).select("parent_id")
    profiles = paths.where("is_dir").join(at, "parent_id", "left_semi").select(F.col("id").alias("parent_id"))
    found = known_children(paths, profiles, inner)
    if direct:
        found = found.unionByName(known_children(paths, at, direct))
    return found.join(stats.select(F.col("entry_id").alias("id"), F.col("total_size").alias("_t")), "id").where("_t > 0")


def scan(paths: DataFrame, stats: DataFrame, temp: list[str], temp_before: int, large: int, large_before: int, keep: list[str] | None = None, time: str = "modified_ms", browsers: list[tuple[str, str]] | None = None) -> DataFrame:
    """`category, owner, id, path, size` of all proposals for the entries of volumes; owner is the browser of a cache, else null.

    temp: files below the temporary folders older than a moment. empty_folders: top-most folders without files.
    large_old: large files not changed for long, outside the temporary folders. browser_caches: known cache folders of
    the `browsers` (folder, layout). Empty folders and large files leave
    out the `keep` patterns (default: the fixed list), what is guarded, and program folders.
    """
    keep = PROTECTED if keep is None else keep
    free = paths.where(~protected(F.col("path"), keep)).join(guarded(paths), "id", "left_anti").join(inside_holders(paths).select("id"), "id", "left_anti")
    total = stats.select(F.col("entry_id").alias("id"), F.col("total_size").alias("_t"))
    say = lambda df, what, size, owner=None: df.select(F.lit(what).alias("category"), F.lit(owner).cast("string").alias("owner"), "id", "path", size.alias("size"))
    out = say(free.join(top_empty(paths, stats).select("id"), "id", "left_semi").join(total, "id"), "empty_folders", F.col("_t"))
    out = out.unionByName(say(large_old(free.where(~protected(F.col("path"), temp)), time, large, large_before), "large_old", F.col("size")))
    if temp:
        out = out.unionByName(say(paths.where(~F.col("is_dir") & protected(F.col("path"), temp) & (F.col(time) < temp_before)), "temp", F.col("size")))
    for folder, layout in browsers or []:
        out = out.unionByName(say(browser_caches(paths, stats, folder, layout), "browser_caches", F.col("_t"), layout))
    return out


def totals(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("category").agg(F.count("*").alias("items"), F.sum("size").alias("bytes"))


def groups(proposals: DataFrame, running: list[str]) -> DataFrame:
    """`category, owner, items, bytes, blocked, pos`: the groups as shown, largest first, those of a `running` browser last."""
    blocked = F.coalesce(F.col("owner").isin(running), F.lit(False)) if running else F.lit(False)
    g = proposals.groupBy("category", "owner").agg(F.count("*").alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("blocked", blocked)
    return g.withColumn("pos", F.row_number().over(Window.orderBy("blocked", F.desc("bytes"), "category", "owner")).cast("long"))  # one row for each category and browser


def default_selection(proposals: DataFrame, running: list[str]) -> DataFrame:
    """The proposals that are selected at first: never large old files, which are the user's own, nor anything of a running browser."""
    blocked = F.coalesce(F.col("owner").isin(running), F.lit(False)) if running else F.lit(False)
    return proposals.where((F.col("category") != "large_old") & ~blocked)
