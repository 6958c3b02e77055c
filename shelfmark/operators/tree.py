"""Operators over the tree of folders: paths, roll-ups, subtrees, chains, lookups, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fold, fold_text
from ..shared import Scratch
from .hierarchy import hierarchy


def with_paths(entries: DataFrame) -> DataFrame:
    """`entries` with path, depth and ancestors (top first); entries at loops are left out.

    Written once as a table: whatever asks about paths, chains and subtrees scans it instead of walking the tree again.
    """
    h = hierarchy(entries, below=False, ancestors=True).where("depth >= 0").select("id", "path", "depth", "ancestors")
    return Scratch(entries.sparkSession, "paths").save(entries.join(h, "id"))


def roll_up(paths: DataFrame) -> DataFrame:
    """Per folder what lies below it: entry_id, total_size, total_alloc, file_count, dir_count; an unknown allocation counts as the size.

    Each entry is pre-aggregated into its parent first, so only folders spread over their ancestors.
    """
    c = F.col
    own = paths.where("parent_id IS NOT NULL").groupBy(c("parent_id").alias("folder")).agg(
        F.sum("size").alias("s"), F.sum(F.coalesce("alloc_size", "size")).alias("a"), F.count_if(~c("is_dir")).alias("f"), F.count_if(c("is_dir")).alias("d"))
    folders = paths.where("is_dir").select(c("id").alias("folder"), "ancestors")
    up = folders.join(own, "folder").select(F.explode(F.concat("ancestors", F.array("folder"))).alias("folder"), "s", "a", "f", "d")
    sums = up.groupBy("folder").agg(F.sum("s").alias("s"), F.sum("a").alias("a"), F.sum("f").alias("f"), F.sum("d").alias("d"))
    z = lambda n, to: F.coalesce(n, F.lit(0)).cast("long").alias(to)
    return folders.select("folder").join(sums, "folder", "left").select(c("folder").alias("entry_id"), z("s", "total_size"), z("a", "total_alloc"), z("f", "file_count"), z("d", "dir_count"))


def refresh_roll_up(old: DataFrame, paths: DataFrame, seeds: DataFrame) -> DataFrame:
    """`old` totals with those of the `seeds` (id) and of all their ancestors computed anew.

    A touched folder's totals are its own children's and those of its folders: of touched ones anew, of all others as
    they are in `old`, which are right. So only the children of touched folders are read, and what they add up to
    spreads along the touched folders' chains.
    """
    c = F.col
    names = ["total_size", "total_alloc", "file_count", "dir_count"]
    chain = paths.join(seeds.select("id").distinct(), "id", "left_semi").select(F.explode(F.concat("ancestors", F.array("id"))).alias("id")).distinct()
    touched = Scratch(paths.sparkSession, "touched").save(paths.where("is_dir").join(chain, "id", "left_semi").select("id", "ancestors"))
    kids = paths.where("parent_id IS NOT NULL").join(touched.select(c("id").alias("parent_id")), "parent_id", "left_semi")
    kids = kids.join(touched.select("id", F.lit(True).alias("_t")), "id", "left").join(old.select(c("entry_id").alias("id"), *[c(n).alias(f"_{n}") for n in names]), "id", "left")
    known = lambda n: F.when(c("_t").isNull(), F.coalesce(f"_{n}", F.lit(0))).otherwise(0)
    own = kids.groupBy(c("parent_id").alias("id")).agg(
        F.sum(F.coalesce("size", F.lit(0)) + known("total_size")).alias("s"), F.sum(F.coalesce("alloc_size", "size", F.lit(0)) + known("total_alloc")).alias("a"),
        F.sum((~c("is_dir")).cast("long") + known("file_count")).alias("f"), F.sum(c("is_dir").cast("long") + known("dir_count")).alias("d"))
    up = touched.join(own, "id").select(F.explode(F.concat("ancestors", F.array("id"))).alias("id"), "s", "a", "f", "d")
    sums = up.groupBy("id").agg(*[F.sum(x).alias(x) for x in "safd"])
    fresh = touched.select("id").join(sums, "id", "left").select(c("id").alias("entry_id"), *[F.coalesce(x, F.lit(0)).cast("long").alias(n) for x, n in zip("safd", names)])
    return old.join(fresh.select("entry_id"), "entry_id", "left_anti").unionByName(fresh)


def subtree(paths: DataFrame, root: int) -> DataFrame:
    """The entries below `root` and itself."""
    return paths.where((F.col("id") == root) | F.array_contains("ancestors", F.lit(root).cast("long")))


def chain(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """`id, pos, ancestor_id, name`: the way from the top to each id, itself included, pos from 0."""
    steps = paths.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.posexplode(F.concat("ancestors", F.array("id"))).alias("pos", "ancestor_id"))
    return steps.join(paths.select(F.col("id").alias("ancestor_id"), "name"), "ancestor_id").select("id", F.col("pos").cast("long").alias("pos"), "ancestor_id", "name")


def overlapping(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """`a, b, overlap`: whether one folder of the pair is, or lies in, the other."""
    anc = paths.select("id", "ancestors")
    both = pairs.join(anc.select(F.col("id").alias("a"), F.col("ancestors").alias("up_a")), "a").join(anc.select(F.col("id").alias("b"), F.col("ancestors").alias("up_b")), "b")
    return both.select("a", "b", ((F.col("a") == F.col("b")) | F.array_contains("up_a", F.col("b")) | F.array_contains("up_b", F.col("a"))).alias("overlap"))


def drop_nested(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct ids that lie in no other of them."""
    chosen = ids.select("id").distinct()
    inner = paths.join(chosen, "id", "left_semi").select("id", F.explode("ancestors").alias("a")).join(chosen.select(F.col("id").alias("a")), "a", "left_semi").select("id")
    return chosen.join(inner, "id", "left_anti")


def child_by_name(entries: DataFrame, parent: int, name: str) -> DataFrame:
    """The child of that exact name, or else the first by name that differs in case only."""
    same = entries.where((F.col("parent_id") == parent) & (fold(F.col("name")) == fold_text(name)))
    return same.orderBy((F.col("name") == name).desc(), "name", "id").limit(1)


def resolve(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """`volume_id, rel, id`: the entry at each relative path, in any case; of several the least id."""
    at = paths.select("volume_id", "id", fold(F.col("path")).alias("k"))
    w = wanted.select("volume_id", "rel", fold(F.regexp_replace("rel", "/", "\\\\")).alias("k"))
    return w.join(at, ["volume_id", "k"]).groupBy("volume_id", "rel").agg(F.min("id").alias("id"))


def locate(paths: DataFrame, mounts: DataFrame, absolute: DataFrame) -> DataFrame:
    """`path, volume_id, id, rest`: the longest mount that begins each absolute path, the deepest catalogued folder on it, and what is left.

    Mounts are few; the paths' prefixes meet folders by equality, so nothing is compared pair by pair.
    """
    c = F.col
    a = absolute.select("path", F.regexp_replace("path", "/", "\\\\").alias("p")).distinct()
    parts = F.split("p", r"\\")
    heads = a.select("path", "p", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).withColumn("head", F.array_join(F.slice(parts, 1, c("n")), "\\"))
    m = mounts.where("last_mount IS NOT NULL").select(c("id").alias("volume_id"), fold(F.regexp_replace("last_mount", r"\\+$", "")).alias("k"))
    best = heads.withColumn("k", fold(c("head"))).join(m, "k").groupBy("path", "p").agg(F.max_by(F.struct("volume_id", "head"), "n").alias("m"))
    inner = best.select("path", "p", c("m.volume_id").alias("volume_id"), F.expr("ltrim('\\\\', substring(p, length(m.head) + 1))").alias("rel"))
    rp = F.split("rel", r"\\")
    tries = inner.select("path", "volume_id", "rel", F.explode(F.sequence(F.lit(0), F.size(rp))).alias("n")).withColumn("k", fold(F.array_join(F.slice(rp, 1, c("n")), "\\")))
    folders = paths.where("is_dir").select("volume_id", "id", fold(c("path")).alias("k"))
    hit = tries.join(folders, ["volume_id", "k"]).groupBy("path", "volume_id", "rel").agg(F.max_by(F.struct("id", "n"), F.struct(c("n"), -c("id"))).alias("h"))
    return hit.select("path", "volume_id", c("h.id").alias("id"), F.array_join(F.slice(F.split("rel", r"\\"), c("h.n") + 1, F.greatest(F.size(F.split("rel", r"\\")) - c("h.n"), F.lit(0))), "\\").alias("rest"))


def without_files(paths: DataFrame, ids: Column | None = None) -> DataFrame:
    """Folders without a file at any depth: id."""
    full = paths.where("NOT is_dir").select(F.explode("ancestors").alias("id")).distinct()
    return paths.where("is_dir").select("id").join(full, "id", "left_anti")


def top_empty(entries: DataFrame, stats: DataFrame) -> DataFrame:
    """The top-most folders without any file below: their parent is a root or has files."""
    c = F.col
    e = entries.where("is_dir AND parent_id IS NOT NULL").join(stats.where("file_count = 0").select(c("entry_id").alias("id")), "id", "left_semi")
    p = entries.select(c("id").alias("parent_id"), c("parent_id").isNull().alias("is_top"))
    s = stats.select(c("entry_id").alias("parent_id"), c("file_count").alias("n"))
    return e.join(p, "parent_id").join(s, "parent_id", "left").where(c("is_top") | (F.coalesce("n", F.lit(0)) > 0)).select("id", "volume_id", "parent_id", "name")


def canonical(paths: DataFrame) -> DataFrame:
    """Rows that don't depend on ids, to compare two catalogs: volume_id, path, is_dir, size, modified."""
    return paths.select("volume_id", "path", "is_dir", F.when(F.col("is_dir"), 0).otherwise(F.col("size")).alias("size"), F.when(~F.col("is_dir"), F.col("modified_ms")).alias("modified_ms"))


def reduced(rows: DataFrame) -> DataFrame:
    """One row per id, as in `hierarchy`: of different rows with one id the greatest (parent, name, the rest) holds."""
    rest = [n for n in rows.columns if n not in ("id", "parent_id", "name")]
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("parent_id", "name", *rest)).alias("_r")).select("id", "_r.*")


def stats_differ(entries: DataFrame, stats: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """Ids of folders with stored totals other than those recomputed from the entries below them.

    As in the reference only folders reached from a root are recomputed, over entries whose parent is a folder of their
    volume; sizes of folders themselves don't count. Of several stored rows of a folder all must be right. `ways`: the
    entries' hierarchy with ancestors, if it is there already.
    """
    c = F.col
    if ways is None:
        ways = hierarchy(entries, below=False, ancestors=True)
    p = entries.where("is_dir").select(c("id").alias("parent_id"), c("volume_id").alias("p_vol"))
    hung = entries.join(p, "parent_id").where("p_vol = volume_id").drop("p_vol")
    folders = entries.where("is_dir").select("id", "parent_id", "volume_id", "name", "is_dir")
    cut = folders.where("parent_id IS NOT NULL").join(hung.select("id"), "id", "left_anti").select("id")
    tops = folders.where("parent_id IS NULL").select(c("id").alias("top"))
    at = ways.where("depth >= 0").select("id", "ancestors")
    paths = folders.join(at, "id").withColumn("top", F.coalesce(F.get("ancestors", F.lit(0)), "id")).join(tops, "top", "left_semi").drop("top")
    # at or below a folder that doesn't hang where it says, nothing is reached
    off = paths.select("id", F.explode(F.concat("ancestors", F.array("id"))).alias("a")).join(cut.select(c("id").alias("a")), "a", "left_semi").select("id").distinct()
    zero = F.lit(0).cast("long")
    reached = paths.join(off, "id", "left_anti").withColumns({"size": zero, "alloc_size": zero})
    reached = reached.unionByName(hung.where("NOT is_dir").select("id", "parent_id", "volume_id", "name", "is_dir", c("size").cast("long"), c("alloc_size").cast("long")), allowMissingColumns=True)  # a file counts through its folder and needs no path
    names = ["total_size", "total_alloc", "file_count", "dir_count"]
    right = roll_up(Scratch(entries.sparkSession, "reached").save(reached)).select(c("entry_id").alias("id"), *[c(n).alias(f"_{n}") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & c(n).eqNullSafe(c(f"_{n}"))
    return stats.select(c("entry_id").alias("id"), *names).join(right, "id").where(~same).select("id").distinct()


def problems(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """`problem, id`: every entry that breaks a rule of the tree.

    duplicate_id, two_roots, root_name, no_parent, parent_is_file, other_volume, same_name, no_stats, file_stats,
    stats_differ, parked_name, loop. The id of a problem of several entries is the least. `rows` and `stats` come as
    they are stored: repeated rows count once, different rows with one id are a duplicate_id, and the rules are then
    checked with one of them.
    """
    c = F.col
    rows = rows.where("id IS NOT NULL").distinct()
    e = Scratch(rows.sparkSession, "problems").save(reduced(rows))
    p = e.select(c("id").alias("pid"), c("is_dir").alias("p_dir"), c("volume_id").alias("p_vol"))
    has = stats.select(c("entry_id").alias("id"), F.lit(True).alias("has")).distinct()
    j = e.join(p, c("parent_id") == c("pid"), "left").join(has, "id", "left")
    hung, there = c("parent_id").isNotNull(), c("has").isNotNull()
    rules = {
        "root_name": ~hung & (c("name") != ""), "no_parent": hung & c("pid").isNull(), "parent_is_file": ~c("p_dir"), "other_volume": c("p_vol") != c("volume_id"),
        "no_stats": c("is_dir") & ~there, "file_stats": ~c("is_dir") & there, "parked_name": c("name").startswith("\u0001"),
    }
    own = j.select(F.explode(F.array_compact(F.array(*[F.when(rule, what) for what, rule in rules.items()]))).alias("problem"), "id")
    say = lambda df, what: df.select(F.lit(what).alias("problem"), "id")
    several = lambda df, *by: df.groupBy(*by).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1")
    ways = hierarchy(e, below=False, ancestors=True)
    found = [
        own,
        say(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_id"),
        say(several(e.where(~hung), "volume_id"), "two_roots"),
        say(several(e.where(hung), "parent_id", "name"), "same_name"),
        say(stats_differ(e, stats, ways), "stats_differ"),
        say(ways.where("depth < 0"), "loop"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
