"""Bringing a catalog in line with a new listing, and grouping journal records into work.

The reconciler matches nodes of a listing with entries of the catalog by entry, not by path, so what lies below a
renamed or moved folder keeps its entries. References match in one join whatever the depth; what has none is matched
by the names on its way down from the nearest folder that is matched, and these ways come from `hierarchy`, so a tree
600 deep takes no more rounds than its doublings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fold
from ..shared import Scratch, numbered
from .changefeed import CREATE_BIT
from .hierarchy import hierarchy

#: How much of a folder's content a listing has: all of it; what could be read; only children whose files changed; nothing.
STATES = ("complete", "incomplete", "partial", "not_listed")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _paired(a: DataFrame, b: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Rows of `a` and `b` with equal keys, one to one, in the order of id and node."""
    rank = lambda d, by: d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    some = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return rank(a.where(some), "id").join(rank(b.where(some), "node"), [*keys, "_n"]).select("id", "node", *(extra or []))


def match(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """`id, node`: which entry each node of the listing is; nodes that are new and entries that are gone are left out.

    catalog: volume_id, id, parent_id, name, is_dir, file_ref. listing: volume_id, node, parent_node (null for the
    root of a listed tree), name, is_dir, file_ref and, if it has them, target (the entry that a root is; null for the
    volume's root). Ids and nodes are unique BIGINTs. A node takes, of the same volume and kind: the only entry with its reference,
    if no other node has that; else, in its folder, the same reference and name, the same reference, or the same name
    where the references don't contradict; else the same reference anywhere. Equal claims pair in the order of id and
    node. A reference that only one node and one entry have is stronger than any name.
    """
    scratch = Scratch(catalog.sparkSession, "match")
    pick = ["volume_id", "name", "is_dir", "file_ref"]
    target = F.col("target").cast("long") if "target" in listing.columns else F.lit(None).cast("long")
    old = scratch.save(catalog.select(F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id"), *pick))
    new = scratch.save(listing.select(F.col("node").cast("long").alias("node"), F.col("parent_node").cast("long").alias("parent_node"), *pick, target.alias("target")))
    roots = new.where("parent_node IS NULL").select("volume_id", "node", "target")
    tops = old.where("parent_id IS NULL").groupBy("volume_id").agg(F.min("id").alias("top"))
    given = roots.where("target IS NOT NULL").select(F.col("target").alias("id"), "node")
    own = roots.where("target IS NULL").groupBy("volume_id").agg(F.min("node").alias("node")).join(tops, "volume_id").select(F.col("top").alias("id"), "node")
    done = [scratch.save(given.unionByName(own))]
    left, rest = old, new.where("parent_node IS NOT NULL")

    def take(m: DataFrame) -> DataFrame:
        nonlocal left, rest
        m = scratch.save(m)
        done.append(m)
        left, rest = left.join(m.select("id"), "id", "left_anti"), rest.join(m.select("node"), "node", "left_anti")
        return m

    left = left.join(done[0].select("id"), "id", "left_anti")
    key = ["volume_id", "is_dir", "file_ref"]
    only = lambda d, what: d.where("file_ref IS NOT NULL").groupBy(*key).agg(F.min(what).alias(what), F.count("*").alias("n")).where("n = 1").drop("n")
    take(only(left, "id").join(only(rest, "node"), key).select("id", "node"))
    left, rest = scratch.save(left), scratch.save(rest)
    compatible = F.col("r0").isNull() | F.col("r1").isNull() | (F.col("r0") == F.col("r1"))
    while True:
        placed = _union(done)
        take(_by_ways(left.where("is_dir"), rest.where("is_dir"), placed, compatible))
        places = _union(done).select(F.col("node").alias("parent_node"), F.col("id").alias("place"))
        here = scratch.save(rest.join(places, "parent_node"))
        there = scratch.save(left.withColumnRenamed("parent_id", "place"))
        for keys in (["place", "file_ref", "is_dir", "name"], ["place", "file_ref", "is_dir"]):
            m = take(_paired(there, here, keys))
            here, there = here.join(m.select("node"), "node", "left_anti"), there.join(m.select("id"), "id", "left_anti")
        a, b = there.withColumnRenamed("file_ref", "r0"), here.withColumnRenamed("file_ref", "r1")
        take(_paired(a, b, ["place", "is_dir", "name"], ["r0", "r1"]).where(compatible).select("id", "node"))
        left, rest = scratch.save(left), scratch.save(rest)
        moved = take(_paired(left, rest, key, ["is_dir"]))
        if moved.where("is_dir").isEmpty():
            return _union([d.select("id", "node") for d in done])
        left, rest = scratch.save(left), scratch.save(rest)


def _by_ways(left: DataFrame, rest: DataFrame, placed: DataFrame, compatible: Column) -> DataFrame:
    """Folders that have the same names on their way down from a pair of matched folders, with no contradiction on it."""
    if left.isEmpty() or rest.isEmpty():
        return placed.limit(0)
    scratch = Scratch(left.sparkSession, "ways")

    def ways(d: DataFrame, id: str, parent: str, ref: str, place: DataFrame) -> DataFrame:
        h = hierarchy(d, id, parent, "name", below=False, ancestors=True).where("depth >= 0").withColumnRenamed("id", id)
        starts = d.select(F.col(id).alias("root_id"), F.col(parent).alias("_from")).join(place, "_from").select("root_id", "place")
        return h.join(starts, "root_id").join(d.select(id, F.col("file_ref").alias(ref)), id).select(id, "place", "path", "ancestors", ref)

    a = ways(left, "id", "parent_id", "r0", placed.select(F.col("id").alias("_from"), F.col("id").alias("place"))).drop("ancestors")
    b = ways(rest, "node", "parent_node", "r1", placed.select(F.col("node").alias("_from"), F.col("id").alias("place")))
    met = scratch.save(_paired(a, b, ["place", "path"], ["r0", "r1", "ancestors"]))
    broken = met.where(~compatible).select("node")
    good = met.where(compatible)
    if not broken.isEmpty():
        below = good.select("node", F.explode("ancestors").alias("a")).join(broken.select(F.col("node").alias("a")), "a", "left_semi").select("node").distinct()
        good = good.join(below, "node", "left_anti")
    return good.select("id", "node")


def reconcile(catalog: DataFrame, listing: DataFrame, candidates: DataFrame | None = None, meta: tuple[str, ...] = ("size", "modified")) -> DataFrame:
    """`op, volume_id, id, node, parent_id, parent_node`: what turns the catalog into what was listed.

    Both sides as in `match`, with the `meta` columns; the listing may have several roots (targets) and the column
    `state` (see STATES; null is complete). insert: a new node, below the entry parent_id or, if that is new too, null
    and parent_node. move: the entry has another parent or name (and maybe other values); update: other values only;
    unchanged; delete: an entry with all below it that no node has claimed, named by its top. Of a complete folder
    what was not seen is deleted; of an incomplete one only entries whose name another node has taken; of a partial
    one also the `candidates` (id); of one that is not listed nothing. What lies outside the listed trees stays. A
    move, insert or delete of a folder counts once for all that only moves with it.
    """
    scratch = Scratch(catalog.sparkSession, "reconcile")
    pick = ["volume_id", "name", "is_dir", *meta]
    old = catalog.select("id", "parent_id", *pick)
    state = F.coalesce("state", F.lit("complete")) if "state" in listing.columns else F.lit("complete")
    new = scratch.save(listing.withColumn("state", state).select("node", "parent_node", *pick, "state"))
    m = scratch.save(match(catalog, listing))
    places = m.select(F.col("node").alias("parent_node"), F.col("id").alias("place"))
    n = new.join(m, "node", "left").join(places, "parent_node", "left")
    o = old.select("id", F.col("parent_id").alias("_p"), F.col("name").alias("_name"), *[F.col(c).alias(f"_{c}") for c in meta], F.lit(True).alias("_was"))
    j = n.join(o, "id", "left")
    root = F.col("parent_node").isNull()
    other = ~root & (~F.col("place").eqNullSafe(F.col("_p")) | ~F.col("name").eqNullSafe(F.col("_name")))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in meta], F.lit(True))
    op = F.when(F.col("_was").isNull(), "insert").when(other, "move").when(same | (root & (F.col("state") == "partial")), "unchanged").otherwise("update")
    seen = j.select(op.alias("op"), "volume_id", "id", "node", F.when(root, F.col("_p")).otherwise(F.col("place")).alias("parent_id"), "parent_node")

    over = m.join(new.select("node", "state"), "node").select(F.col("id").alias("parent_id"), F.col("node").alias("_folder"), "state")
    gone = old.join(m.select("id"), "id", "left_anti").join(over, "parent_id").select("volume_id", "id", "parent_id", "name", "_folder", "state")
    taken = new.where("parent_node IS NOT NULL").select(F.col("parent_node").alias("_folder"), "name", F.lit(True).alias("_taken")).distinct()
    gone = gone.join(taken, ["_folder", "name"], "left")
    goes = (F.col("state") == "complete") | ((F.col("state") != "not_listed") & F.col("_taken").isNotNull())
    if candidates is not None:
        gone = gone.join(candidates.select("id", F.lit(True).alias("_asked")).distinct(), "id", "left")
        goes = goes | ((F.col("state") == "partial") & F.col("_asked").isNotNull())
    none = F.lit(None).cast("long")
    return seen.unionByName(gone.where(goes).select(F.lit("delete").alias("op"), "volume_id", "id", none.alias("node"), "parent_id", none.alias("parent_node")))


def apply_reconciled(catalog: DataFrame, listing: DataFrame, ops: DataFrame, meta: tuple[str, ...] = ("size", "modified")) -> DataFrame:
    """The catalog after the ops of `reconcile`: id, parent_id, volume_id, name, is_dir, file_ref and the meta columns.

    New entries get the ids after the greatest one, in the order of node. Below a deleted entry goes whatever was not
    claimed by a node. A root keeps its name; a null reference in the listing leaves the known one.
    """
    scratch = Scratch(catalog.sparkSession, "apply")
    cols = ["id", "parent_id", "volume_id", "name", "is_dir", "file_ref", *meta]
    ops = scratch.save(ops)
    last = catalog.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    born = numbered(ops.where("op = 'insert'").select("node"), [F.col("node")], "_k").select("node", (F.col("_k") + last).alias("new_id"))
    born = scratch.save(born)
    now = ops.where("op <> 'delete'").join(born, "node", "left").join(born.select(F.col("node").alias("parent_node"), F.col("new_id").alias("new_parent")), "parent_node", "left")
    now = now.select("node", "op", F.coalesce("id", "new_id").alias("id"), F.coalesce("parent_id", "new_parent").alias("parent_id"))
    known = catalog.select("id", F.col("name").alias("_name"), F.col("file_ref").alias("_ref"), *[F.col(c).alias(f"_{c}") for c in meta])
    state = F.coalesce("state", F.lit("complete")) if "state" in listing.columns else F.lit("complete")
    mine = listing.select("node", F.col("parent_node").isNull().alias("_root"), (F.col("parent_node").isNull() & (state == "partial")).alias("_keep"), "volume_id", "name", "is_dir", "file_ref", *meta)
    fresh = now.join(mine, "node").join(known, "id", "left")
    value = lambda c: F.when(F.col("_keep"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    fresh = fresh.select("id", "parent_id", "volume_id", F.when(F.col("_root") & F.col("_name").isNotNull(), F.col("_name")).otherwise(F.col("name")).alias("name"), "is_dir", F.coalesce("file_ref", "_ref").alias("file_ref"), *[value(c) for c in meta])
    rest = scratch.save(catalog.select(*cols).join(now.select("id"), "id", "left_anti"))
    dead = ops.where("op = 'delete'").select(F.col("id").alias("root_id"))
    tops = rest.join(dead.select(F.col("root_id").alias("id")), "id", "left_semi").count()
    if tops:
        # a deleted entry is the top of its own stretch of entries that no node has
        cut = rest.join(dead.select(F.col("root_id").alias("id"), F.lit(True).alias("_dead")), "id", "left").withColumn("parent_id", F.when(F.col("_dead").isNull(), F.col("parent_id")))
        below = hierarchy(cut, below=False).join(dead, "root_id", "left_semi").select("id")
        rest = rest.join(below, "id", "left_anti")
    return rest.select(*cols).unionByName(fresh.select(*cols))


def graft(tree: DataFrame, other: DataFrame, top: int, under: int) -> DataFrame:
    """A listing with a copy of another one's subtree at node `top` below its node `under`; nodes of the copy follow the greatest node."""
    last = tree.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0]
    h = hierarchy(other, "node", "parent_node", below=False, ancestors=True).select(F.col("id").alias("node"), "ancestors")
    inside = other.join(h.where((F.col("node") == top) | F.array_contains("ancestors", F.lit(top).cast("long"))).select("node"), "node")
    ids = Scratch(tree.sparkSession, "graft").save(numbered(inside.select("node"), [F.col("node")], "_k").select("node", (F.col("_k") + last).alias("_id")))
    up = ids.select(F.col("node").alias("parent_node"), F.col("_id").alias("_up"))
    copy = inside.join(ids, "node").join(up, "parent_node", "left").withColumns({"parent_node": F.when(F.col("node") == top, F.lit(under).cast("long")).otherwise(F.col("_up")), "node": F.col("_id")})
    return tree.unionByName(copy.select(*tree.columns))


def changes_listing(changed: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a journal tells, as a listing for `reconcile`: (listing, candidates, lost).

    changed: volume_id, file_ref, parent_ref, name, is_dir, size, modified, gone; one row per changed file, as it is now. entries: the
    catalog. Every changed file that is there is one node, below the node of its folder if that has changed too, else
    below a root for its catalogued folder; the folders changed files were catalogued in are roots as well, so that
    what left them is missed. All these folders are partial; a folder that is itself new has in the journal whatever it holds.
    `candidates`: entries of changed files. `lost`: files (volume_id, file_ref) whose folders don't reach the catalog,
    for which the volume must be read in full.
    """
    scratch = Scratch(entries.sparkSession, "changes")
    key = ["volume_id", "file_ref"]
    changed = scratch.save(changed.where("volume_id IS NOT NULL AND file_ref IS NOT NULL").dropDuplicates(key))
    known = entries.where("file_ref IS NOT NULL").groupBy(*key).agg(F.min(F.struct("id", "parent_id", "is_dir")).alias("e")).select(*key, "e.*")
    known = scratch.save(known)
    held = scratch.save(entries.join(changed.select(*key), key, "left_semi").select("volume_id", "id", "parent_id"))
    here = changed.where("NOT coalesce(gone, false)")
    above = here.select("volume_id", F.col("file_ref").alias("parent_ref"), F.lit(True).alias("_node"))
    folder = known.where("is_dir").select("volume_id", F.col("file_ref").alias("parent_ref"), F.col("id").alias("_folder"))
    gone = changed.where("coalesce(gone, false)").select("volume_id", F.col("file_ref").alias("parent_ref"), F.lit(True).alias("_gone"))
    at = here.join(above, ["volume_id", "parent_ref"], "left").join(folder, ["volume_id", "parent_ref"], "left").join(gone, ["volume_id", "parent_ref"], "left")
    at = scratch.save(at.withColumn("_folder", F.when(F.col("_node").isNull() & F.col("_gone").isNull(), F.col("_folder"))))
    # files whose way up ends outside the catalog, or runs in a circle
    lost_tops = at.where("_node IS NULL AND _folder IS NULL").select(*key)
    numbers = scratch.save(numbered(at.select(*key), [F.col("volume_id"), F.col("file_ref")], "node"))
    up = numbers.select("volume_id", F.col("file_ref").alias("parent_ref"), F.col("node").alias("parent_node"))
    nodes = scratch.save(at.join(numbers, key).join(up, ["volume_id", "parent_ref"], "left").withColumn("parent_node", F.when(F.col("_node"), F.col("parent_node"))))
    ways = hierarchy(nodes, "node", "parent_node", below=False).select(F.col("id").alias("node"), "root_id", "depth")
    tops = nodes.join(lost_tops, key, "left_semi").select(F.col("node").alias("root_id"), F.lit(True).alias("_lost"))
    ways = scratch.save(ways.join(tops, "root_id", "left").withColumn("_lost", F.coalesce("_lost", F.lit(False)) | (F.col("depth") < 0)))
    good = nodes.join(ways.where("NOT _lost").select("node"), "node")
    lost = nodes.join(ways.where("_lost").select("node"), "node", "left_semi").select(*key)
    # roots: catalogued folders of nodes, and those that changed files were catalogued in, if they are no nodes and not gone
    was = held.select(F.col("parent_id").alias("target")).where("target IS NOT NULL").distinct()
    targets = good.where("_folder IS NOT NULL").select(F.col("_folder").alias("target")).union(was).distinct()
    targets = targets.join(held.select(F.col("id").alias("target")), "target", "left_anti")
    n = numbers.count()
    roots = numbered(targets, [F.col("target")], "_k").select((F.col("_k") + n).alias("node"), "target")
    roots = scratch.save(roots.join(entries.select(F.col("id").alias("target"), "volume_id", "name", "is_dir", "file_ref", "size", "modified"), "target"))
    cols = ["volume_id", "node", "parent_node", "target", "state", "name", "is_dir", "file_ref", "size", "modified"]
    no = F.lit(None).cast("long")
    listed = good.join(roots.select(F.col("target").alias("_folder"), F.col("node").alias("_root")), "_folder", "left").withColumns({"parent_node": F.coalesce("parent_node", "_root"), "target": no, "state": F.lit("partial")})
    listing = roots.withColumns({"parent_node": no, "state": F.lit("partial")}).select(*cols).unionByName(listed.select(*cols))
    return scratch.save(listing), held.select("id"), lost


def refresh_listing(children: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders listed again without what lies below them, as a listing for `reconcile`: (listing, to_read).

    children: target (the catalogued folder listed), volume_id, name, is_dir, file_ref, size, modified. Subfolders that
    the catalog knows in that folder (by reference, else by name) are not listed, so their content stays; new ones are
    `to_read` (node and what they are) in full, and count as not listed until they have been.
    """
    scratch = Scratch(entries.sparkSession, "refresh")
    no = F.lit(None).cast("long")
    kids = scratch.save(numbered(children, [F.col("target"), F.col("name"), F.col("file_ref")], "node"))
    n = kids.count()
    roots = numbered(children.select("target").distinct(), [F.col("target")], "_k").select((F.col("_k") + n).alias("node"), "target")
    roots = scratch.save(roots.join(entries.select(F.col("id").alias("target"), "volume_id", "name", "is_dir", "file_ref", "size", "modified"), "target"))
    cols = ["volume_id", "node", "parent_node", "target", "state", "name", "is_dir", "file_ref", "size", "modified"]
    up = roots.select("target", F.col("node").alias("parent_node"))
    below = kids.join(up, "target").withColumns({"target": no, "state": F.when(F.col("is_dir"), "not_listed").otherwise("complete")})
    listing = scratch.save(roots.withColumns({"parent_node": no, "state": F.lit("complete")}).select(*cols).unionByName(below.select(*cols)))
    met = match(entries, listing)
    return listing, listing.where("is_dir AND parent_node IS NOT NULL").join(met.select("node"), "node", "left_anti")


def grouped_changes(records: DataFrame) -> DataFrame:
    """One row per file: whether it was created in the records, and the distinct parents seen, in order of their first record."""
    r = records.where("volume_id IS NOT NULL AND file_ref IS NOT NULL")
    seen = r.groupBy("volume_id", "file_ref", "parent_ref").agg(F.min(F.struct("journal_id", "usn")).alias("first"), F.max((F.col("reason").bitwiseAND(CREATE_BIT) != 0)).alias("c"), F.count("*").alias("n"))
    parents = F.transform(F.array_sort(F.collect_list(F.when(F.col("parent_ref").isNotNull(), F.struct("first", "parent_ref")))), lambda x: x["parent_ref"])
    return seen.groupBy("volume_id", "file_ref").agg(F.max("c").alias("created"), F.sum("n").alias("records"), parents.alias("parents"))


def affected_folders(records: DataFrame, entries: DataFrame) -> DataFrame:
    """`volume_id, folder_ref`: parents named by the records, and the folder each changed file is catalogued in."""
    named = records.where("parent_ref IS NOT NULL").select("volume_id", F.col("parent_ref").alias("folder_ref"))
    where = entries.where("file_ref IS NOT NULL").select("volume_id", "file_ref", F.col("parent_id").alias("id"))
    up = entries.where("file_ref IS NOT NULL").select("id", F.col("file_ref").alias("folder_ref"))
    held = records.select("volume_id", "file_ref").distinct().join(where, ["volume_id", "file_ref"]).join(up, "id").select("volume_id", "folder_ref")
    return named.unionByName(held).distinct()


def claimed_twice(state: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Names that two files of one folder claim (of one volume, or of what `within` names): the records must be read again."""
    by = [*(within or ["volume_id"]), "parent_ref", "name"]
    return state.where("parent_ref IS NOT NULL AND name IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def folders_to_refresh(paths: DataFrame, changed: DataFrame) -> DataFrame:
    """`volume_id, id`: for changed paths (volume_id, path) the nearest catalogued folder, and the path itself if it is one."""
    parts = F.split("path", r"\\")
    heads = changed.select("volume_id", "path").distinct().select("volume_id", "path", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("n")).withColumn("k", fold(F.array_join(F.slice(parts, 1, F.col("n")), "\\")))
    folders = paths.where("is_dir").select("volume_id", "id", fold(F.col("path")).alias("k"))
    hit = heads.join(folders, ["volume_id", "k"])
    own = hit.where(F.col("n") == F.size(parts)).select("volume_id", "id")
    near = hit.where(F.col("n") < F.size(parts)).groupBy("volume_id", "path").agg(F.max_by("id", "n").alias("id")).select("volume_id", "id")
    return own.union(near).distinct()
