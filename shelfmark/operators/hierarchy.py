"""Parent-child rows of unknown depth turned into paths, depths, roots, ancestors and descendant counts.

Frontier joins from the tops, with a stride that doubles: round k reaches the levels 2^k to 2^(k+1)-1, since every
node not yet reached keeps the stretch of ancestors and names up to the ancestor 2^k steps above it. A depth of 600
takes ten rounds instead of 600. Only nodes that have children take part in the rounds; the others look their parent
up once at the end. A node that meets an ancestor again hangs from a loop, and its stretch holds that whole loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch, lookup_join

SEPARATOR = "\\"


def _joined(*parts):
    """Names joined by the separator, without empty ones."""
    return F.concat_ws(SEPARATOR, *[F.nullif(p, F.lit("")) for p in parts])


def hierarchy(entries: DataFrame, id: str = "id", parent: str = "parent_id", name: str = "name", below: bool = True, ancestors: bool = False, hot_rows: int = 2_000_000) -> DataFrame:
    """One row per id: `id, root_id, depth, path` and, as asked, `n_below` and `ancestors` (top first, parent last).

    A top is a node whose parent is null or no node. A node on a loop or hanging from one has the smallest id of the
    loop as root_id, depth -1, path '', n_below -1 and no ancestors. Rows with a null id are left out. Repeated rows
    count once; of different rows with one id the greatest (parent, name) holds. A null name counts as empty. An
    empty table gives no rows. Other columns of `entries` are not read. `hot_rows`: children of one parent beyond
    which it is looked up by broadcast (see lookup_join).
    """
    scratch = Scratch(entries.sparkSession, "hierarchy")
    one = F.max(F.struct(F.col(parent).alias("parent"), F.coalesce(F.col(name), F.lit("")).alias("name")))
    nodes = entries.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(one.alias("_r")).select("id", "_r.parent", "_r.name")
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    nodes = scratch.save(nodes.join(kids, "id", "left").select("id", "parent", "name", F.coalesce("kids", F.lit(0)).alias("kids")))
    n_nodes = nodes.count()  # from the files' footers
    folders = nodes.where(F.col("kids") > 0)

    # round 0: tops are reached, every other folder knows one step
    known = folders.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    known = lookup_join(folders, known, "parent", hot_rows=hot_rows, left_rows=n_nodes)
    top = F.col("_known").isNull()
    step = known.select(
        "id", "kids", top.alias("done"), F.when(~top, F.col("parent")).alias("jump"), F.col("name").alias("path"),
        F.when(top, F.expr("CAST(array() AS ARRAY<BIGINT>)")).otherwise(F.array(F.col("parent").cast("long"))).alias("up"),
        F.when(top, F.col("id")).alias("root_id"), F.when(top, F.lit(0)).alias("depth"),
    )
    steps = [scratch.save(step)]
    reached, ahead = steps[0].where("done"), steps[0].where("NOT done")
    left = ahead.count()
    while left:
        target = reached.unionByName(ahead).select(F.col("id").alias("jump"), F.struct("done", F.col("jump").alias("to"), "path", "up", "root_id", "depth").alias("t"))
        j = lookup_join(ahead.select("id", "kids", "jump", "path", "up"), target, "jump", "inner", hot_rows, left)
        t = F.col("t")
        j = j.select("id", "kids", "t", "path", F.concat("up", t["up"]).alias("up"))
        # a stretch that ends where it has been before has gone round a loop
        back = F.expr("array_position(up, element_at(up, -1))")
        loop = ~t["done"] & (back < F.size("up"))
        lost = t["done"] & (t["depth"] < 0)
        j = j.select(
            "id", "kids", (t["done"] | loop).alias("done"), F.when(~t["done"] & ~loop, t["to"]).alias("jump"),
            F.when(loop | lost, F.lit("")).otherwise(_joined(t["path"], F.col("path"))).alias("path"),
            F.when(loop | lost, F.expr("CAST(array() AS ARRAY<BIGINT>)")).otherwise(F.col("up")).alias("up"),
            F.when(loop, F.expr("array_min(slice(up, CAST(array_position(up, element_at(up, -1)) AS INT) + 1, size(up)))")).otherwise(t["root_id"]).alias("root_id"),
            F.when(loop | lost, F.lit(-1)).when(t["done"], F.size("up")).alias("depth"),
        )
        steps.append(scratch.save(j))
        reached, ahead = scratch.together(*steps).where("done"), steps[-1].where("NOT done")
        left = ahead.count()

    more = []
    if ancestors:
        more.append(F.reverse("up").alias("ancestors"))
    at = reached.select("id", "kids", "root_id", "depth", "path", "up")
    inner = at
    if below:
        sums = at.where("depth >= 0").select("kids", F.explode(F.concat("up", F.array("id"))).alias("id")).groupBy("id").agg(F.sum("kids").alias("n_below"))
        inner = at.join(sums, "id", "left")
        more.insert(0, F.when(F.col("depth") < 0, F.lit(-1)).otherwise(F.col("n_below")).cast("long").alias("n_below"))
    inner = inner.select("id", F.col("root_id").cast("long").alias("root_id"), F.col("depth").cast("long").alias("depth"), "path", *more)

    leaves = nodes.where(F.col("kids") == 0).select("id", "parent", "name")
    over = at.select(F.col("id").alias("parent"), F.struct("root_id", "depth", "path", "up").alias("t"))
    t = F.col("t")
    free, lost = t.isNull(), t["depth"] < 0
    more = []
    if below:
        more.append(F.when(lost, F.lit(-1)).otherwise(F.lit(0)).cast("long").alias("n_below"))
    if ancestors:
        more.append(F.when(free | lost, F.expr("CAST(array() AS ARRAY<BIGINT>)")).otherwise(F.concat(F.reverse(t["up"]), F.array("parent"))).alias("ancestors"))
    outer = lookup_join(leaves, over, "parent", hot_rows=hot_rows, left_rows=n_nodes).select(
        "id", F.coalesce(t["root_id"], F.col("id")).cast("long").alias("root_id"), F.when(free, F.lit(0)).when(lost, F.lit(-1)).otherwise(t["depth"] + 1).cast("long").alias("depth"),
        F.when(free, F.col("name")).when(lost, F.lit("")).otherwise(_joined(t["path"], F.col("name"))).alias("path"), *more,
    )
    return inner.unionByName(outer)


def closure(entries: DataFrame, **names: str) -> DataFrame:
    """`ancestor_id, id, distance`: every node with each of its ancestors; nodes at loops have none."""
    h = hierarchy(entries, below=False, ancestors=True, **names)
    n = F.size("ancestors")
    return h.select("id", n.alias("_n"), F.posexplode("ancestors").alias("_p", "ancestor_id")).select("ancestor_id", "id", (F.col("_n") - F.col("_p")).cast("long").alias("distance"))
