"""Backup checks: is every file of a source somewhere in the destinations, and how do two folders differ.

Sides are tables of rel, size, modified (100 ns), full.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fold
from ..shared import Scratch

#: Fixed: times nearer than this are the same, in 100 ns.
TOLERANCE = 20_000_000


def same_time(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= TOLERANCE, a.isNull() & b.isNull())


def _name(rel: Column) -> Column:
    return fold(F.element_at(F.split(rel, r"\\"), -1))


def verify(source: DataFrame, destinations: DataFrame) -> DataFrame:
    """`rel, size, evidence`: content (same size and hash), metadata (same name, size and time where a hash is missing on a side), or missing."""
    s = source.select("rel", "size", "modified", "full", _name(F.col("rel")).alias("name"))
    content = destinations.where("full IS NOT NULL").select("size", "full").distinct().withColumn("c", F.lit(True))
    left = s.join(content, ["size", "full"], "left")
    # times of one name and size are compared within ranges as wide as the tolerance, so no group is paired with itself
    cell = lambda m: F.coalesce(F.floor(m / TOLERANCE), F.lit(-(1 << 62)))
    meta = destinations.select(_name(F.col("rel")).alias("name"), "size", "modified", F.col("full").isNotNull().alias("hashed"))
    meta = meta.groupBy("name", "size", cell(F.col("modified")).alias("cell"), "hashed").agg(F.min("modified").alias("lo"), F.max("modified").alias("hi"))
    probe = left.where("c IS NULL").select("rel", "size", "name", "modified", "full", F.explode(F.array(cell(F.col("modified")) - 1, cell(F.col("modified")), cell(F.col("modified")) + 1)).alias("cell"))
    # in the own cell any time is near; in a neighbour's only its nearest end counts
    near = (F.col("cell") == cell(F.col("modified"))) | same_time(F.col("modified"), F.col("lo")) | same_time(F.col("modified"), F.col("hi"))
    hit = probe.join(meta, ["name", "size", "cell"]).where(near & (F.col("full").isNull() | ~F.col("hashed"))).select("rel", F.lit(True).alias("m")).distinct()
    return left.join(hit, "rel", "left").select("rel", "size", F.when(F.col("c"), "content").when(F.col("m"), "metadata").otherwise("missing").alias("evidence"))


def tallies(items: DataFrame, by: str) -> DataFrame:
    return items.groupBy(by).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def coverage(checked: DataFrame) -> DataFrame:
    """Files and bytes found and their share in whole percent, rounded down; nothing to check is wholly covered."""
    ok = F.col("evidence") != "missing"
    g = checked.agg(F.count("*").alias("files"), F.count_if(ok).alias("found"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("found_bytes"))
    share = lambda a, b: F.when(F.col(b) == 0, 100).otherwise(F.floor(F.col(a) * 100 / F.col(b))).cast("long")
    return g.withColumns({"files_percent": share("found", "files"), "bytes_percent": share("found_bytes", "bytes")})


def _judge(j: DataFrame) -> tuple[Column, Column]:
    both = F.col("fa").isNotNull() & F.col("fb").isNotNull()
    equal = (F.col("sa") == F.col("sb")) & F.col("fa").eqNullSafe(F.col("fb"))
    status = F.when(F.when(both, equal).when(F.col("sa") != F.col("sb"), False).otherwise(same_time(F.col("ma"), F.col("mb"))), "same").otherwise("different")
    return status, F.when(both | (F.col("sa") != F.col("sb")), "content").otherwise("metadata")


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda d, s: d.select(F.col("rel").alias(f"r{s}"), F.col("size").alias(f"s{s}"), F.col("modified").alias(f"m{s}"), F.col("full").alias(f"f{s}"), fold(F.col("rel")).alias("k"))
    return side(a, "a"), side(b, "b")


def compare_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """`rel, other, size, status, evidence` by folded path; of several paths of `b` that fold alike the last counts for every one of `a`."""
    x, y = _sides(a, b)
    last = y.groupBy("k").agg(F.max_by(F.struct("rb", "sb", "mb", "fb"), "rb").alias("y")).select("k", "y.*")
    j = x.join(last, "k", "left")
    status, evidence = _judge(j)
    got = F.col("rb").isNotNull()
    left = j.select(F.col("ra").alias("rel"), F.lit(None).cast("string").alias("other"), F.col("sa").alias("size"), F.when(got, status).otherwise("only_a").alias("status"), F.when(got, evidence).alias("evidence"))
    used = j.where(got).select("rb").distinct()
    right = y.join(used, "rb", "left_anti").select(F.col("rb").alias("rel"), F.lit(None).cast("string").alias("other"), F.col("sb").alias("size"), F.lit("only_b").alias("status"), F.lit(None).cast("string").alias("evidence"))
    return left.unionByName(right)


def _near_in_time(x: DataFrame, y: DataFrame) -> DataFrame:
    """`ra, rb`: pairs of files of one name and size whose times are the same, where at least one has no hash; each file once.

    The times of a name and size fall into stretches that are further apart than the tolerance (found on the distinct
    ranges of time, not on the files); every stretch is gone through in order of time, remembering only files within
    the tolerance that still wait.
    """
    side = lambda d, s: d.select(_name(F.col(f"r{s}")).alias("name"), F.col(f"s{s}").alias("size"), F.col(f"m{s}").alias("t"), F.lit(s).alias("side"), F.col(f"r{s}").alias("rel"), F.col(f"f{s}").isNotNull().alias("hashed"))
    a, b, key = side(x, "a"), side(y, "b"), ["name", "size"]
    both = a.join(b.select(*key).distinct(), key, "left_semi").unionByName(b.join(a.select(*key).distinct(), key, "left_semi"))
    both = Scratch(x.sparkSession, "near").save(both.withColumn("cell", F.coalesce(F.floor(F.col("t") / TOLERANCE), F.lit(-(1 << 62)))))
    w = Window.partitionBy(*key).orderBy("cell")
    cells = both.select(*key, "cell").distinct().withColumn("_new", (F.col("cell") - F.lag("cell").over(w) > 1).cast("int"))
    cells = cells.select(*key, "cell", F.coalesce(F.sum("_new").over(w), F.lit(0)).alias("stretch"))
    placed = both.join(cells, [*key, "cell"]).repartition(*key, "stretch").sortWithinPartitions(*key, "stretch", F.asc_nulls_first("t"), "side", "rel")
    return placed.select(*key, "stretch", "t", "side", "rel", "hashed").mapInArrow(_partners, "ra string, rb string")


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, waiting = None, {}
    for b in batches:
        ra, rb = [], []
        for name, size, stretch, t, side, rel, hashed in zip(*(c.to_pylist() for c in b.columns)):
            if (name, size, stretch) != at:
                at, waiting = (name, size, stretch), {(s, h): deque() for s in "ab" for h in (False, True)}
            other = "b" if side == "a" else "a"
            # a file with a hash can only go with one without; one without takes first what has no other choice
            for h in (False,) if hashed else (True, False):
                free = waiting[other, h]
                while free and t is not None and free[0][0] is not None and free[0][0] < t - TOLERANCE:
                    free.popleft()
                if free and (free[0][0] is None) == (t is None):
                    found = free.popleft()[1]
                    ra.append(rel if side == "a" else found)
                    rb.append(found if side == "a" else rel)
                    break
            else:
                waiting[side, hashed].append((t, rel))
        yield pa.RecordBatch.from_arrays([pa.array(ra, pa.string()), pa.array(rb, pa.string())], names=["ra", "rb"])


def compare_contents(a: DataFrame, b: DataFrame) -> DataFrame:
    """Like compare_paths, but a file moved or renamed is the same file: `other` is then its path in `b`.

    First equal files at the same path, then one-to-one by content in the order of paths, then one-to-one by name,
    size and time where a hash is missing, then what is left at the same path is different. A content with very many
    copies is ranked, not multiplied. Paths must be unique on a side. Content goes before names for all files, so a
    file without a hash never takes the counterpart that another one has by content; of files that could be each
    other's by name and time none is left without a partner while one is free.
    """
    scratch = Scratch(a.sparkSession, "compare")
    x, y = (scratch.save(d) for d in _sides(a, b))
    out = []
    none = F.lit(None).cast("string")

    def emit(j, other, status, evidence):
        out.append(j.select(F.col("ra").alias("rel"), other.alias("other"), F.col("sa").alias("size"), status.alias("status"), evidence.alias("evidence")))

    def rest(d, used, col):
        return scratch.save(d.join(used.select(col), col, "left_anti"))

    last = y.groupBy("k").agg(F.max_by(F.struct("rb", "sb", "mb", "fb"), "rb").alias("y")).select("k", "y.*")
    j = x.join(last, "k")
    status, evidence = _judge(j)
    same = j.where(status == "same")
    emit(same, none, F.lit("same"), evidence)
    x, y = rest(x, same, "ra"), rest(y, same, "rb")

    def ranked(d, keys, col, known):
        return d.where(known).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(col)))

    u = ranked(x.withColumns({"size": F.col("sa"), "full": F.col("fa")}), ["size", "full"], "ra", F.col("fa").isNotNull())
    v = ranked(y.withColumns({"size": F.col("sb"), "full": F.col("fb")}).drop("k"), ["size", "full"], "rb", F.col("fb").isNotNull())
    moved = scratch.save(u.join(v, ["size", "full", "n"]))
    emit(moved, F.col("rb"), F.lit("same"), F.lit("content"))
    x, y = rest(x, moved, "ra"), rest(y, moved, "rb")
    meta = scratch.save(_near_in_time(x, y))
    emit(x.join(meta, "ra"), F.col("rb"), F.lit("same"), F.lit("metadata"))
    x, y = rest(x, meta, "ra"), rest(y, meta, "rb")
    lastly = y.groupBy("k").agg(F.max_by(F.struct("rb", "sb", "mb", "fb"), "rb").alias("y")).select("k", "y.*")
    j = x.join(lastly, "k")
    _, evidence = _judge(j)
    emit(j, none, F.lit("different"), evidence)
    x, y = rest(x, j, "ra"), rest(y, j, "rb")
    emit(x, none, F.lit("only_a"), none)
    out.append(y.select(F.col("rb").alias("rel"), none.alias("other"), F.col("sb").alias("size"), F.lit("only_b").alias("status"), none.alias("evidence")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def folder_level(items: DataFrame, folder: str, by: str) -> DataFrame:
    """One level of a result: per sub-folder of `folder` ('' for the top) and class its files and bytes; own files under name ''."""
    prefix = folder + "\\" if folder else ""
    inner = items.where(F.startswith(F.col("rel"), F.lit(prefix))).withColumn("rest", F.substring("rel", len(prefix) + 1, 1 << 20))
    parts = F.split("rest", r"\\", 2)
    return inner.groupBy(F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("name"), by).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def copy_preview(items: DataFrame, free: DataFrame) -> DataFrame:
    """Per target volume: files and bytes to copy there and whether they fit."""
    g = items.groupBy("volume_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return g.join(free, "volume_id").select("volume_id", "files", "bytes", (F.col("bytes") <= F.col("free_space")).alias("fits"))
