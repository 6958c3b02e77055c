"""Similar pictures and videos: joins by Hamming distance and duration, groups, representatives."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import hamming, local_content, mean_distance
from ..shared import Scratch


def print_of_pixels(grays: Column) -> Column:
    """The 64-bit difference print of 72 gray values, 9 a row in 8 rows: bit = left < right, first bit highest."""
    bit = lambda i: F.when(F.element_at(grays, (i + F.floor(i / 8) + 1).cast("int")) < F.element_at(grays, (i + F.floor(i / 8) + 2).cast("int")), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.when(F.size(grays) == 72, F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: F.shiftleft(s, 1).bitwiseOR(bit(i))))


def masks(blocks: int, bits: int, radius: int) -> list[int]:
    """All patterns of up to `radius` flipped bits in a block."""
    out = [0]
    for k in range(1, radius + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(bits), k)]
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _layout(limit: int, prints: int) -> list[int]:
    """Blocks of bits of which any two prints within the limit share all but `limit`; none if there is no good choice.

    The number m of blocks is the least whose m - limit equal ones tell the prints apart but for some 32 by chance.
    """
    bits = max(8, prints.bit_length() - 5)
    for m in range(limit + 1, limit + 5):
        width = 64 // m
        if (m - limit) * width >= bits or m == limit + 4:
            return [((1 << width) - 1) << (width * i) for i in range(m)] if math.comb(m, limit) <= 300 else []
    return []


def _choices(blocks: list[int], limit: int, groups: int) -> dict[tuple[int, ...], list[tuple[int, ...]]]:
    """By its first blocks, every choice of blocks that two prints may share first; as few first blocks as have a value for each of `groups`."""
    most, width = len(blocks) - limit, blocks[0].bit_length()
    first = min(most, max(1, -(-(groups - 1).bit_length() // width)))
    out: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
    for c in combinations(range(len(blocks)), most):
        out.setdefault(c[:first], []).append(c)
    return out


def _slots(p: np.ndarray, blocks: list[int], first: tuple[int, ...], groups: int) -> np.ndarray:
    """The group of each print by its first blocks, whose values are dealt out evenly."""
    width, v = blocks[0].bit_length(), np.zeros(len(p), np.uint64)
    for i in first:
        v = v << np.uint64(width) | p >> np.uint64(width * i) & np.uint64(blocks[0])
    bits = width * len(first)
    high = min(bits, 32)  # so that the product with the groups has at most 64
    v = v * np.uint64(0x9E3779B97F4A7C15) & np.uint64((1 << bits) - 1)
    return ((v >> np.uint64(bits - high)) * np.uint64(groups) >> np.uint64(high)).astype(np.int64)


def _pieces(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One of n pieces for each print, by all of its bits."""
    p = (p ^ p >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    p = (p ^ p >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((p ^ p >> np.uint64(31)) % n.astype(np.uint64)).astype(np.int64)


def _counted(blocks: list[int], firsts: list[tuple[int, ...]], groups: int):
    """The number of prints for each slot (place of the first blocks x groups + group) that has any, of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(firsts) * groups, np.int64)
        for b in batches:
            p = b["p"].to_numpy().view(np.uint64)
            for k, c in enumerate(firsts):
                n[k * groups : (k + 1) * groups] += np.bincount(_slots(p, blocks, c, groups), minlength=groups)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["slot", "n"])

    return run


def _packed(blocks: list[int], firsts: list[tuple[int, ...]], groups: int, hot: dict[int, int], some: int = 500_000):
    """`slot, own, pieces, asks, prints`: some prints at a time by slot and piece (of as many as `hot` has for the slot) as the bytes of an array.

    A row for each print and slot would be three times as large in the shuffle as the print.
    """

    def packed(p: np.ndarray, asks: bool | None, pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, c in enumerate(firsts):
            slot = _slots(p, blocks, c, groups) + k * groups
            own = _pieces(p, pieces[slot])
            order = np.lexsort((own, slot))
            slot, own = slot[order], own[order]
            at = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (own[1:] != own[:-1])))
            offsets = pa.py_buffer((np.append(at, len(p)) * 8).astype(np.int32))
            prints = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(p[order])])
            yield pa.RecordBatch.from_arrays([pa.array(slot[at]), pa.array(own[at].astype(np.int32)), pa.array(pieces[slot[at]]), pa.array([asks] * len(at), pa.bool_()), prints], names=["slot", "own", "pieces", "asks", "prints"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.ones(len(firsts) * groups, np.int32)
        pieces[list(hot.keys())] = list(hot.values())
        held: list[pa.RecordBatch] = []

        def sides() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            p = t["p"].to_numpy().view(np.uint64)
            asks = t["asks"].to_numpy() if "asks" in t.column_names else None
            for a, x in [(None, p)] if asks is None else [(True, p[asks]), (False, p[~asks])]:
                if len(x):
                    yield from packed(x, a, pieces)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= some:
                yield from sides()
                held = []
        if held:
            yield from sides()

    return run


def _apart(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    d = x ^ y
    return (np.bitwise_count(d) <= limit) & (d != 0)


def _sharing(x: np.ndarray, y: np.ndarray | None, mask: int, limit: int, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of x and y (of x itself where y is None) that are equal in the mask and near, some `pairs` at a time compared."""
    m = np.uint64(mask)
    x = x[np.argsort(x & m)]
    kx = x & m
    if y is None:
        y, lo = x, np.arange(1, len(x) + 1)
        ends = np.append(np.flatnonzero(kx[1:] != kx[:-1]) + 1, len(x))
        hi = np.repeat(ends, np.diff(ends, prepend=0))
    else:
        y = y[np.argsort(y & m)]
        lo, hi = np.searchsorted(y & m, kx, "left"), np.searchsorted(y & m, kx, "right")
    some = np.flatnonzero(hi > lo)
    x, lo, n = x[some], lo[some], (hi - lo)[some]
    until = np.cumsum(n)
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + pairs, "right")))
        k = n[at:to]
        u = np.repeat(x[at:to], k)
        v = y[np.arange(len(u)) + np.repeat(lo[at:to] - (until[at:to] - k) + (until[at - 1] if at else 0), k)]
        near = _apart(u, v, limit)
        yield u[near], v[near]
        at = to


def _meet(blocks: list[int], limit: int, choices: list[list[tuple[int, ...]]], groups: int, forest: bool, pairs: int = 500_000):
    """Near pairs within a group of prints of one number of first blocks, each only where its choice has the first blocks that it shares."""

    def found(c: int, x: np.ndarray, y: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for choice in choices[c]:
            for u, v in _sharing(x, y, sum(blocks[i] for i in choice), limit, pairs):
                d = u ^ v
                own = np.ones(len(d), bool)
                for i in set(range(choice[-1])) - set(choice):
                    own &= (d & np.uint64(blocks[i])) != 0
                if own.any():
                    yield u[own].view(np.int64), v[own].view(np.int64)

    def batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v, rep = least_linked(a, b)
        return rep[v != rep], v[v != rep]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[bool | None, list[bytes]] = {None: [], True: [], False: []}
        for b in batches:
            for asks, prints in zip(b["asks"].to_pylist(), b["prints"].to_pylist()):
                packed[asks].append(prints)
        own, x, y = (np.frombuffer(b"".join(v), np.uint64) for v in packed.values())
        x, y = (own, None) if packed[None] else (x, y)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in found(key[0].as_py() // groups, x, y):
            if not forest:
                yield batch(a, b)
                continue
            kept.append((a, b))
            if sum(len(k[0]) for k in kept) > pairs:
                kept = [tree(*map(np.concatenate, zip(*kept)))]
        if kept:
            yield batch(*tree(*map(np.concatenate, zip(*kept))))

    # the types by value: as texts they would be looked up among this module's names
    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _near(queries: DataFrame | None, all_: DataFrame, limit: int, hot_rows: int, forest: bool = False) -> DataFrame:
    """`a, b` of different prints at most `limit` bits apart, each pair once: a of `queries`, b of `all_` (both distinct, column p).

    Without queries all meet all, and of a pair either may be a. `forest`: instead of these pairs fewer that link the
    same prints. A print goes to one group for each choice of first blocks, packed with others; groups of more than `hot_rows` prints
    (blank regions) are dealt out to cells in which each piece of the group meets each other.
    """
    scratch = Scratch(all_.sparkSession, "near")
    all_ = scratch.save(all_)
    scratch.settle()
    n = all_.count()
    blocks = _layout(limit, n)
    if not blocks:
        return _flipped(all_ if queries is None else queries, all_, limit, queries is None)
    groups = -(-n // hot_rows * 2) or 1
    choices = _choices(blocks, limit, groups)
    by = blocks, list(choices), groups
    rows = all_ if queries is None else all_.withColumn("asks", F.lit(False)).union(queries.select("p", F.lit(True)))
    counts = rows.select("p").mapInArrow(_counted(*by), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    hot = {r["slot"]: -(-r["n"] // hot_rows) for r in counts.where(F.col("n") > hot_rows).collect()}  # at most (prints x choices) / hot_rows
    cells = rows.mapInArrow(_packed(*by, hot), "slot long, own int, pieces int, asks boolean, prints binary")
    cells = cells.select("slot", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"), "asks", "prints")
    if queries is None:
        cells = cells.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).withColumn("asks", F.when(F.col("x") != F.col("y"), F.col("own") == F.col("x")))
    else:
        cells = cells.withColumns({"x": F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")), "y": F.when(F.col("asks"), F.col("other")).otherwise(F.col("own"))})
    return cells.drop("own", "other").groupBy("slot", "x", "y").applyInArrow(_meet(blocks, limit, list(choices.values()), groups, forest), "a long, b long")


def _flipped(queries: DataFrame, all_: DataFrame, limit: int, once: bool) -> DataFrame:
    """The pairs of _near for limits that leave no good choice: by four blocks of 16 bits, of which one has at most a fourth of the limit changed."""
    block = [0xFFFF << (16 * k) for k in range(4)]
    part = lambda x, v: x.bitwiseAND(F.lit(_signed(v)).cast("long")).alias("v")
    build = all_.select(F.col("p").alias("b"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), part(F.col("p"), v)) for k, v in enumerate(block)])).alias("key")).select("b", "key.*")
    flips = F.array(*[F.struct(F.lit(k).alias("k"), part(F.col("p").bitwiseXOR(F.call_function("shiftleft", F.lit(m).cast("long"), F.lit(16 * k))), v)) for k, v in enumerate(block) for m in masks(4, 16, limit // 4)])
    probe = queries.select(F.col("p").alias("a"), F.explode(flips).alias("key")).select("a", "key.*")
    near = (F.col("a") < F.col("b") if once else F.col("a") != F.col("b")) & (hamming(F.col("a"), F.col("b")) <= limit)
    # Spark takes an exploded table for no larger than what it came from, and would send it to the driver
    return probe.join(build.hint("merge"), ["k", "v"]).where(near).select("a", "b").distinct()


def near_prints(prints: DataFrame, limit: int, column: str = "print", hot_rows: int = 100_000) -> DataFrame:
    """`a, b, distance` of different prints (a < b) at most `limit` bits apart.

    Prints meet in groups by equality of some of their bits (see _layout), or for larger limits by four blocks of 16
    bits probed with up to a fourth of the limit flipped. Exact, and no pair is compared that shares no such bits.
    Files with equal prints are one row here.
    """
    p = prints.where(F.col(column).isNotNull()).select(F.col(column).alias("p")).distinct()
    return _near(None, p, limit, hot_rows).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), hamming(F.col("a"), F.col("b")).alias("distance"))


def similar(queries: DataFrame, prints: DataFrame, limit: int, id: str = "id", column: str = "print", hot_rows: int = 100_000) -> DataFrame:
    """`id, near_id, distance`: for every row of `queries` all other rows of `prints` at most `limit` bits away, equal prints with distance 0."""
    q = queries.where(F.col(column).isNotNull()).select(F.col(id).alias("id"), F.col(column).alias("a"))
    scratch = Scratch(prints.sparkSession, "similar")
    p = scratch.save(prints.where(F.col(column).isNotNull()).select(F.col(id).alias("near_id"), F.col(column).alias("b")))
    q = scratch.save(q)
    scratch.settle()
    asked = q.select("a").distinct()
    met = _near(asked.withColumnRenamed("a", "p"), p.select(F.col("b").alias("p")).distinct(), limit, hot_rows)
    met = met.unionByName(asked.select("a", F.col("a").alias("b"))).hint("merge")  # Spark can't foresee how many pairs there are
    return q.join(met, "a").hint("merge").join(p, "b").where("id <> near_id").select("id", "near_id", hamming(F.col("a"), F.col("b")).alias("distance"))


def least_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vertices of the edges a-b, each with the least one it is linked to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    least = np.arange(len(ids))
    while True:
        x, y = least[u], least[v]
        if np.array_equal(x, y):
            return ids, ids[least]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := least[least], least):
            least = up


def _stretch(t: pa.Table) -> pa.Table:
    v, rep = least_linked(t["a"].to_numpy(), t["b"].to_numpy())
    return pa.table({"v": v, "rep": rep})


def linked(pairs: DataFrame, task_edges: int = 200_000) -> DataFrame:
    """`v, group_id`: every vertex with the least one it is linked to, directly or through others.

    Edges are dealt out to tasks of some `task_edges` by their hash, so a vertex with very many spreads over all; each
    task finds the least vertex of its pieces, and where tasks disagree about a vertex their representatives are the
    edges of the next round. When one task has seen all edges, the rounds are composed backwards.
    """
    scratch = Scratch(pairs.sparkSession, "linked")
    e = scratch.save(pairs.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while True:
        parts = max(1, -(-e.count() // task_edges))
        dealt = e.withColumn("part", F.pmod(F.xxhash64(F.lit(len(rounds)), "a", "b"), F.lit(parts)))
        local = scratch.save(dealt.groupBy("part").applyInArrow(_stretch, "v long, rep long"))
        if parts == 1:
            final = local
            break
        parent = scratch.save(local.groupBy("v").agg(F.min("rep").alias("least")))
        rounds.append(parent)
        e = scratch.save(local.join(parent, "v").where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct())
    final = final.select("v", F.col("rep").alias("group_id"))
    for parent in reversed(rounds):
        up = final.select(F.col("v").alias("least"), "group_id")
        final = parent.join(up, "least", "left").select("v", F.coalesce("group_id", "least").alias("group_id"))
    return final


def print_groups(prints: DataFrame, limit: int, id: str = "id", column: str = "print", hot_rows: int = 100_000) -> DataFrame:
    """`id, group_id`: files joined directly or through others; group_id is the least id. Files with equal prints are joined too."""
    scratch = Scratch(prints.sparkSession, "groups")
    rows = scratch.save(prints.where(F.col(column).isNotNull()).select(F.col(id).alias("id"), F.col(column).alias("p")))
    rep = scratch.save(rows.groupBy("p").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    scratch.settle()
    r = rep.select("p", "rep")
    near = scratch.save(_near(None, rep.select("p"), limit, hot_rows, forest=True))
    scratch.settle()
    links = near.join(r.withColumnsRenamed({"p": "a", "rep": "ra"}), "a").join(r.withColumnsRenamed({"p": "b", "rep": "rb"}), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    g = scratch.save(linked(links))
    scratch.drop(near)
    scratch.settle()
    of = rep.join(g, rep.rep == g.v, "left").select("p", "n", F.coalesce("group_id", "rep").alias("group_id"), F.col("group_id").isNotNull().alias("far"))
    return rows.join(of, "p").where("far OR n > 1").select("id", "group_id")


def close_durations(a: Column, b: Column) -> Column:
    """At most two seconds or three in a hundred of the longer (whole milliseconds) apart."""
    longer = F.greatest(a, b) * 3
    return F.abs(a - b) <= F.greatest((longer - longer % 100) / 100, F.lit(2000))


def near_videos(videos: DataFrame, limit: float) -> DataFrame:
    """`a, b` (a < b) of close durations whose frames are at most `limit` bits apart on average.

    Durations fall into buckets as wide as the tolerance; a video meets its own bucket and both neighbours' two.
    """
    step = 200_000 / 3
    d = F.col("duration_ms")
    bucket = F.when(d < step, F.floor(d / 2000)).otherwise(math.floor(step / 2000) + 1 + F.floor(F.log(d / step) / math.log(1.03))).cast("long")
    v = videos.where("duration_ms >= 0 AND size(frames) > 0").select("id", "duration_ms", "frames", bucket.alias("k"))
    x = v.select(F.col("id").alias("a"), d.alias("da"), F.col("frames").alias("fa"), F.explode(F.sequence(F.col("k") - 2, F.col("k") + 2)).alias("k"))
    y = v.select(F.col("id").alias("b"), d.alias("db"), F.col("frames").alias("fb"), "k")
    return x.join(y, "k").where((F.col("a") < F.col("b")) & close_durations(F.col("da"), F.col("db")) & (mean_distance(F.col("fa"), F.col("fb")) <= limit)).select("a", "b")


def video_groups(videos: DataFrame, limit: float) -> DataFrame:
    """`id, group_id, links`: near videos joined directly or through others; group_id is the least id, links the number of videos near to this one.

    Videos of equal duration and frames are one representative, so only representatives meet in a bucket.
    """
    c = F.col
    key = ["duration_ms", "frames"]
    v = videos.where("duration_ms >= 0 AND size(frames) > 0")
    scratch = Scratch(videos.sparkSession, "videos")
    rep = scratch.save(v.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    pairs = scratch.save(near_videos(rep.select(c("rep").alias("id"), *key), limit))
    both = pairs.union(pairs.select("b", "a"))
    near = both.join(rep.select(c("rep").alias("b"), "n"), "b").groupBy(c("a").alias("rep")).agg(F.sum("n").alias("others"))
    g = linked(pairs).select(c("v").alias("rep"), "group_id")
    of = rep.join(near, "rep", "left").join(g, "rep", "left").select(*key, F.coalesce("group_id", "rep").alias("group_id"), (F.coalesce("others", F.lit(0)) + c("n") - 1).alias("links"))
    return v.join(of, key).where("links > 0").select("id", "group_id", "links")


def representatives(groups: DataFrame, prints: DataFrame) -> DataFrame:
    """Per group its largest picture (then least id), how many files, and each file's distance to it."""
    area = F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0))
    scratch = Scratch(prints.sparkSession, "representatives")
    j = scratch.save(groups.join(prints, "id").select("group_id", "id", "print", area.alias("area")))  # the groups are found once
    scratch.settle()
    rep = j.groupBy("group_id").agg(F.min_by(F.struct(F.col("id").alias("rep_id"), F.col("print").alias("rep_print")), F.struct(-F.col("area"), F.col("id"))).alias("r"), F.count("*").alias("files"))
    return j.join(rep, "group_id").select("group_id", "id", F.col("r.rep_id").alias("rep_id"), "files", hamming(F.col("print"), F.col("r.rep_print")).alias("distance"))


def print_states(entries: DataFrame, prints: DataFrame) -> DataFrame:
    """`id, name, printed` of every non-empty file whose content is local: whether a print of its present size and time is there."""
    p = prints.select(F.col("entry_id").alias("id"), F.col("size").alias("_s"), F.col("modified_at").alias("_m"))
    files = entries.where(~F.col("is_dir") & (F.col("size") > 0) & local_content(F.col("attrs"))).select("id", "name", "size", "modified_at")
    ok = files.join(p, "id").where((F.col("_s") == F.col("size")) & F.col("_m").eqNullSafe(F.col("modified_at"))).select("id", F.lit(True).alias("_p")).distinct()
    return files.join(ok, "id", "left").select("id", "name", F.col("_p").isNotNull().alias("printed"))


def print_pass(files: DataFrame, grays, skip: DataFrame | None = None) -> DataFrame:
    """`id, print, error` of files (id, content): `grays(content)` gives the 72 gray values of a picture, on the executors.

    What it can't read has no print and the kind of its error, and the pass goes on. `skip` (id): files that brought a
    worker down before; they are left out of the pass, with the error `skipped`.
    """
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            values, errors = [], []
            for content in b.column(1).to_pylist():
                try:
                    g = [int(x) for x in grays(content)]
                    if len(g) != 72:
                        raise ValueError("not 72 values")
                    values.append(g)
                    errors.append(None)
                except Exception as e:  # whatever a decoder throws at a broken file
                    values.append(None)
                    errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.list_(pa.int32())), pa.array(errors, pa.string())], names=["id", "grays", "error"])

    todo = files if skip is None else files.join(skip.select("id").distinct(), "id", "left_anti")
    kind = files.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("grays", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType())])
    out = todo.select("id", "content").mapInArrow(run, schema).select("id", print_of_pixels(F.col("grays")).alias("print"), "error")
    if skip is None:
        return out
    left = files.join(skip.select("id").distinct(), "id", "left_semi").select("id", F.lit(None).cast("long").alias("print"), F.lit("skipped").alias("error"))
    return out.unionByName(left)
