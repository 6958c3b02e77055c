"""Queries over names, the folder tree, space and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import names as N
from ..operators import search as S
from ..operators import space, tree
from ..plans.search_query import parse
from . import table
from .base import band_sql, category_sql, ext_sql, sql, up_sql

QUERIES, SQL = {}, {}
NOW = 1_794_000_000_000  # the fixed moment of queries about age
c = F.col


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


def entries(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's entries, repeated rows once."""
    return table(spark, d, "entries").dropDuplicates(["id"])


def stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dir_stats").dropDuplicates(["entry_id"])


def paths(spark: SparkSession, d: str) -> DataFrame:
    return tree.with_paths(fixtures.tree(spark, d))


# ---- names -----------------------------------------------------------------------------------------------------


@query("c01_fold", sql("ent", f"SELECT DISTINCT name, {up_sql('name')} AS folded FROM ent"))
def c01(spark, d):
    return table(spark, d, "entries").select("name").distinct().select("name", N.fold(c("name")).alias("folded"))


@query("c02_equal_names", sql("ent", f"SELECT a.id, b.id AS other FROM ent a JOIN ent b ON a.parent_id = b.parent_id AND {up_sql('a.name')} = {up_sql('b.name')} AND a.id < b.id WHERE a.name <> b.name"))
def c02(spark, d):
    """Siblings whose names differ in case only."""
    e = entries(spark, d).select("id", "parent_id", "name", N.fold(c("name")).alias("k"))
    o = e.select(c("id").alias("other"), "parent_id", "k", c("name").alias("n2"), c("k").alias("k2")).drop("k2")
    return e.join(o, ["parent_id", "k"]).where("id < other AND name <> n2").select("id", "other")


@query("c03_stored_names", "SELECT DISTINCT doc_id AS id, replace(coalesce(source, ''), '/', chr(65535)) AS name, replace(replace(coalesce(source, ''), '/', chr(65535)), chr(65535), chr(65535) || 'FFFF') AS stored, replace(coalesce(source, ''), '/', chr(65535)) AS back FROM documents")
def c03(spark, d):
    name = F.translate(F.coalesce("source", F.lit("")), "/", N.ESCAPE)
    df = table(spark, d, "documents").select(c("doc_id").alias("id"), name.alias("name"))
    return df.select("id", "name", N.encode_name(c("name")).alias("stored"), N.decode_name(N.encode_name(c("name"))).alias("back"))


@query("c04_extension", sql("ent", f"SELECT id, {ext_sql('name')} AS ext FROM ent"))
def c04(spark, d):
    return entries(spark, d).select("id", N.extension(c("name")).alias("ext"))


@query("c05_category", sql("ent", f"SELECT category, count(*) AS n FROM (SELECT {category_sql(ext_sql('name'))} AS category FROM ent WHERE NOT is_dir) GROUP BY category"))
def c05(spark, d):
    return entries(spark, d).where("NOT is_dir").groupBy(N.category(N.extension(c("name"))).alias("category")).agg(F.count("*").alias("n"))


@query("c06_size_band", sql("ent", f"SELECT {band_sql('size')} AS band, count(*) AS n FROM ent WHERE size IS NOT NULL GROUP BY 1"))
def c06(spark, d):
    return entries(spark, d).where("size IS NOT NULL").groupBy(N.band(c("size")).alias("band")).agg(F.count("*").alias("n"))


@query("c11_unix_ms", sql("ent", "SELECT id, (modified_at - 116444736000000000 - (((modified_at - 116444736000000000) % 10000) + 10000) % 10000) // 10000 AS ms FROM ent WHERE modified_at IS NOT NULL"))
def c11(spark, d):
    return entries(spark, d).where("modified_at IS NOT NULL").select("id", N.unix_ms(c("modified_at")).alias("ms"))


@query("c12_match_score", sql("ent", r"SELECT id, CASE WHEN upper(name) = 'PLAN' THEN 0 WHEN starts_with(upper(name), 'PLAN') THEN 1 WHEN regexp_matches(upper(name), '[ _\-.(\[]PLAN') THEN 2 ELSE 3 END AS score FROM ent WHERE contains(upper(name), 'PLAN')"))
def c12(spark, d):
    f = N.fold(c("name"))
    return entries(spark, d).where(F.contains(f, F.lit("PLAN"))).select("id", N.match_score(f, "PLAN").alias("score"))


@query("c17_unc_parts", "SELECT id, regexp_replace(upper(replace(trim(unc_path), '/', chr(92))), '\\\\+$', '') AS normal, split_part(ltrim(upper(unc_path), chr(92)), chr(92), 1) AS server, split_part(ltrim(upper(unc_path), chr(92)), chr(92), 2) AS share FROM volumes WHERE unc_path IS NOT NULL".replace("\\\\+", "\\+"))
def c17(spark, d):
    u = c("unc_path")
    return table(spark, d, "volumes").where("unc_path IS NOT NULL").select("id", N.normal_unc(u).alias("normal"), N.unc_server(u).alias("server"), N.unc_share(u).alias("share"))


@query("c18_relative_under", "SELECT entry_id, path, trim(substr(replace(path, '/', chr(92)), 7), chr(92)) AS rest FROM (SELECT DISTINCT * FROM dup_files) WHERE upper(left(replace(path, '/', chr(92)), 7)) = 'ALBUM0' || chr(92)")
def c18(spark, d):
    df = table(spark, d, "dup_files").distinct().select("entry_id", "path", N.relative_under(c("path"), "album0").alias("rest"))
    return df.where(c("rest").isNotNull() & (c("rest") != ""))


@query("c22_human_bytes", sql("ent", "SELECT id, " + "CASE " + " ".join(f"WHEN size >= {s} THEN CASE WHEN size // {s // 10} < 1000 THEN (size // {s // 10}) // 10 || '.' || (size // {s // 10}) % 10 ELSE (size // {s}) || '' END || ' {u}'" for u, s in (("TB", 10**12), ("GB", 10**9), ("MB", 10**6), ("KB", 10**3))) + " ELSE size || ' B' END AS shown FROM ent WHERE size >= 0"))
def c22(spark, d):
    return entries(spark, d).where("size >= 0").select("id", N.human_bytes(c("size")).alias("shown"))


@query("c25_crc32", None)
def c25(spark, d):
    return entries(spark, d).select("id", F.crc32(c("name").cast("binary")).alias("crc"))


@query("f02_local_content", sql("ent", "SELECT (coalesce(attrs, 0) & 4460544) = 0 AS local, count(*) AS n FROM ent WHERE NOT is_dir GROUP BY 1"))
def f02(spark, d):
    return entries(spark, d).where("NOT is_dir").groupBy(N.local_content(c("attrs")).alias("local")).agg(F.count("*").alias("n"))


@query("f16_printable", sql("ent", f"SELECT id, {ext_sql('name')} IN ({', '.join(map(repr, N.IMAGE_EXTENSIONS + N.RAW_EXTENSIONS))}) AND size <= 536870912 AS image, {ext_sql('name')} IN ({', '.join(map(repr, N.VIDEO_EXTENSIONS))}) AND NOT ends_with(lower(name), '.d.mts') AS video FROM ent WHERE NOT is_dir AND size IS NOT NULL"))
def f16(spark, d):
    return entries(spark, d).where("NOT is_dir AND size IS NOT NULL").select("id", (N.is_printable(c("name")) & (c("size") <= N.MAX_IMAGE_BYTES)).alias("image"), N.is_video(c("name")).alias("video"))


@query("proj07_kind", sql("ent", f"SELECT CASE WHEN is_dir THEN 'dir' ELSE {category_sql(ext_sql('name'))} END AS kind, count(*) AS n FROM ent GROUP BY 1"))
def p07(spark, d):
    return entries(spark, d).groupBy(N.kind_of(c("is_dir"), c("name")).alias("kind")).agg(F.count("*").alias("n"))


# ---- scans ------------------------------------------------------------------------------------------------------


@query("s02_listing", sql("ent", "SELECT parent_id, count(*) AS n, count(*) FILTER (is_dir) AS folders FROM ent WHERE parent_id IS NOT NULL GROUP BY 1"))
def s02(spark, d):
    """What each folder lists."""
    return entries(spark, d).where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("n"), F.count_if("is_dir").alias("folders"))


@query("s11_lookup", sql("ent", "SELECT id, volume_id, name FROM ent WHERE parent_id IS NULL UNION ALL SELECT id, volume_id, name FROM ent WHERE parent_id IN (SELECT id FROM ent WHERE parent_id IS NULL) AND name < 'D'"))
def s11(spark, d):
    """Roots, and their children with names before D."""
    e = entries(spark, d)
    roots = e.where("parent_id IS NULL")
    kids = e.where("name < 'D'").join(roots.select(c("id").alias("parent_id")), "parent_id", "left_semi")
    return roots.select("id", "volume_id", "name").unionByName(kids.select("id", "volume_id", "name"))


@query("s12_child_by_name", sql("tree", "SELECT id, name FROM tree WHERE parent_id = 3 AND upper(name) = 'NATION_12' ORDER BY name = 'Nation_12' DESC, name, id LIMIT 1"))
def s12(spark, d):
    return tree.child_by_name(fixtures.tree(spark, d), 3, "Nation_12").select("id", "name")


@query("s13_volume_by_mount", "SELECT id, kind FROM volumes WHERE upper(last_mount) IN ('C:' || chr(92), 'G:' || chr(92))")
def s13(spark, d):
    return table(spark, d, "volumes").where(N.fold(c("last_mount")).isin("C:\\", "G:\\")).select("id", "kind")


@query("s14_name_index", sql("tree", "SELECT volume_id, count(*) AS names, sum(strlen(name)) AS bytes FROM tree WHERE parent_id IS NOT NULL GROUP BY 1"))
def s14(spark, d):
    return S.name_index(fixtures.tree(spark, d)).groupBy("volume_id").agg(F.count("*").alias("names"), F.sum(F.octet_length("folded")).alias("bytes"))


@query("s22_replicate", sql("tree", "SELECT t.id + k * 100000000 AS id, t.volume_id + k * 1000 AS volume_id, t.parent_id + k * 100000000 AS parent_id FROM tree t, range(3) r(k)"))
def s22(spark, d):
    """The catalog three times, with ids and volumes moved apart."""
    t = fixtures.tree(spark, d).select("id", "volume_id", "parent_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    far = c("k").cast("long") * 100_000_000
    return t.select((c("id") + far).alias("id"), (c("volume_id") + c("k").cast("long") * 1000).alias("volume_id"), (c("parent_id") + far).alias("parent_id"))


@query("s23_locate", sql("path", "SELECT lower(v.last_mount) || upper(p.path) || chr(92) || 'new' || chr(92) || 'x.txt' AS path, t.volume_id, p.id, 'new' || chr(92) || 'x.txt' AS rest FROM path p JOIN tree t USING (id) JOIN volumes v ON v.id = t.volume_id WHERE t.is_dir AND t.parent_id IS NOT NULL AND v.last_mount IS NOT NULL"))
def s23(spark, d):
    """Where new files under the folders of all mounted volumes belong, given absolute paths in another case."""
    p = paths(spark, d)
    v = table(spark, d, "volumes").select("id", "last_mount")
    at = p.where("is_dir AND parent_id IS NOT NULL").join(v.where("last_mount IS NOT NULL").select(c("id").alias("volume_id"), "last_mount"), "volume_id")
    return tree.locate(p, v, at.select(F.concat(F.lower("last_mount"), F.upper("path"), F.lit("\\new\\x.txt")).alias("path")))


@query("s24_resolve", sql("path", "SELECT t.volume_id, lower(p.path) AS rel, p.id FROM path p JOIN tree t USING (id) WHERE t.is_dir AND p.depth > 0"))
def s24(spark, d):
    p = paths(spark, d)
    return tree.resolve(p, p.where("is_dir AND depth > 0").select("volume_id", F.lower("path").alias("rel")))


# ---- tree -------------------------------------------------------------------------------------------------------


@query("a01_roll_up", sql("stats", "SELECT * FROM stats"))
def a01(spark, d):
    return tree.roll_up(paths(spark, d))


#: The catalog's own entries with their chains, loops left out: deep, and with links to nothing, to files and to other volumes.
EPATH = """, epath AS (SELECT id, [id] AS chain FROM ent WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM ent) UNION ALL SELECT t.id, list_append(p.chain, t.id) FROM epath p JOIN ent t ON t.parent_id = p.id)"""


def entry_paths(spark, d):
    return tree.with_paths(entries(spark, d))


@query("a01_roll_up_entries", sql("ent", EPATH + """, x AS (SELECT unnest(p.chain) AS a, c.is_dir, c.size, c.alloc_size FROM ent c JOIN epath p ON p.id = c.parent_id JOIN ent q ON q.id = c.parent_id AND q.is_dir)
SELECT t.id AS entry_id, coalesce(sum(size), 0)::BIGINT AS total_size, coalesce(sum(coalesce(alloc_size, size)), 0)::BIGINT AS total_alloc, count(*) FILTER (NOT x.is_dir) AS file_count, count(*) FILTER (x.is_dir) AS dir_count FROM (SELECT id FROM ent WHERE is_dir AND id IN (SELECT id FROM epath)) t LEFT JOIN x ON x.a = t.id GROUP BY t.id"""))
def a01c(spark, d):
    return tree.roll_up(entry_paths(spark, d))


@query("x03_without_files_entries", sql("ent", EPATH + ", f AS (SELECT DISTINCT unnest(chain[1:-2]) AS id FROM epath JOIN ent USING (id) WHERE NOT is_dir) SELECT id FROM ent JOIN epath USING (id) WHERE is_dir AND id NOT IN (SELECT id FROM f)"))
def x03b(spark, d):
    return tree.without_files(entry_paths(spark, d))


@query("f12_guarded", sql("ent", EPATH + r", own AS (SELECT id FROM ent WHERE parent_id IS NOT NULL AND (coalesce(attrs, 0) & 1030 <> 0 OR regexp_matches(name, '^[.$]'))) SELECT id FROM epath WHERE list_has_any(chain, (SELECT list(id) FROM own))"))
def f12b(spark, d):
    """Entries that are hidden, system, links or dotted, and all below such folders."""
    from ..operators.cleanup import guarded

    return guarded(entry_paths(spark, d))


@query("q01_canonical_entries", sql("ent", EPATH + "SELECT volume_id, array_to_string(list_filter(list_transform(chain, lambda x: m[x]), lambda n: n <> ''), chr(92)) AS path, is_dir, CASE WHEN is_dir THEN 0 ELSE size END AS size, CASE WHEN NOT is_dir THEN modified_at END AS modified_ms FROM epath JOIN ent USING (id), (SELECT map(list(id), list(coalesce(name, ''))) AS m FROM ent)"))
def q01b(spark, d):
    return tree.canonical(entry_paths(spark, d).withColumn("modified_ms", c("modified_at")))


@query("a01_refresh_roll_up", sql("stats", "SELECT * FROM stats"))
def a01b(spark, d):
    """Totals with the customers' folders of one nation set to zero, computed anew for those folders and what is above them."""
    p = paths(spark, d)
    right = tree.roll_up(p)
    seeds = p.where("parent_id = 1003 AND is_dir").select("id")
    stale = right.join(seeds.select(c("id").alias("entry_id"), F.lit(True).alias("x")), "entry_id", "left").select("entry_id", *[F.when(c("x"), 0).otherwise(c(n)).cast("long").alias(n) for n in ("total_size", "total_alloc", "file_count", "dir_count")])
    return tree.refresh_roll_up(stale, p, seeds)


@query("j03_folder_items", sql("ent dst", f"SELECT e.parent_id, e.id, e.name, CASE WHEN is_dir THEN 'dir' ELSE {category_sql(ext_sql('name'))} END AS kind, CASE WHEN is_dir THEN coalesce(total_size, 0) ELSE size END AS size, CASE WHEN is_dir THEN coalesce(file_count, 0) ELSE 1 END AS files FROM ent e LEFT JOIN dst ON entry_id = e.id WHERE parent_id IS NOT NULL"))
def j03(spark, d):
    return space.folder_items(entries(spark, d), stats(spark, d))


@query("o01_children_of_largest", sql("stats", f"SELECT t.id, t.name, CASE WHEN is_dir THEN total_size ELSE size END AS size FROM tree t LEFT JOIN stats ON entry_id = t.id WHERE parent_id = 1 ORDER BY size DESC, name"))
def o01(spark, d):
    return space.folder_items(fixtures.tree(spark, d), tree.roll_up(paths(spark, d)), 1).select("id", "name", "size").orderBy(F.desc("size"), "name")


@query("o09_largest_folders", sql("ent dst", "SELECT id, name, total_size FROM ent JOIN dst ON entry_id = id ORDER BY total_size DESC, id LIMIT 20"))
def o09(spark, d):
    return entries(spark, d).join(stats(spark, d), c("id") == c("entry_id")).select("id", "name", "total_size").orderBy(F.desc("total_size"), "id").limit(20)


@query("j08_subtree", sql("path", "SELECT p.id, p.path FROM path p WHERE list_contains(chain, 1003)"))
def j08(spark, d):
    return tree.subtree(paths(spark, d), 1003).select("id", "path")


@query("j09_chain", sql("path", "SELECT p.id, g.i - 1 AS pos, chain[g.i] AS ancestor_id, t.name FROM path p, range(1, 6) g(i), tree t WHERE g.i <= len(chain) AND t.id = chain[g.i]"))
def j09(spark, d):
    p = paths(spark, d)
    return tree.chain(p, p.select("id"))


@query("x05_breadcrumb", sql("path", "SELECT p.id, replace(p.path, chr(92), ' > ') AS crumbs FROM path p JOIN tree USING (id) WHERE is_dir AND p.depth > 0"))
def x05(spark, d):
    return paths(spark, d).where("is_dir AND depth > 0").select("id", F.array_join(F.split("path", r"\\"), " > ").alias("crumbs"))


@query("j12_overlap", sql("path", ", x AS (SELECT id, chain FROM path JOIN tree USING (id) WHERE is_dir), ab AS (SELECT id AS a, 1000 + id % 25 AS b FROM x WHERE len(chain) = 3 UNION SELECT chain[2], 1 + id % 5 FROM x WHERE len(chain) = 3 UNION SELECT id, chain[1] FROM x) SELECT a, b, list_contains(p.chain, b) OR list_contains(q.chain, a) AS overlap FROM ab JOIN path p ON p.id = a JOIN path q ON q.id = b"))
def j12(spark, d):
    """Every folder with one of another level: some nation, some volume, its own volume, itself."""
    p = paths(spark, d)
    f = p.where("is_dir")
    low = f.where("depth = 2")
    pairs = low.select(c("id").alias("a"), (c("id") % 25 + 1000).alias("b")).union(low.select(F.get("ancestors", F.lit(1)), c("id") % 5 + 1)).union(f.select("id", F.coalesce(F.get("ancestors", F.lit(0)), "id")))
    return tree.overlapping(p, pairs.distinct())


@query("f18_drop_nested", sql("path", ", sel AS (SELECT id, chain FROM path WHERE id % 7 = 0 OR id IN (1, 1005)) SELECT id FROM sel WHERE NOT EXISTS (SELECT 1 FROM sel o WHERE o.id <> sel.id AND list_contains(sel.chain, o.id))"))
def f18(spark, d):
    """Of a selection of entries, those inside no other selected one."""
    p = paths(spark, d)
    return tree.drop_nested(p, p.where("id % 7 = 0 OR id IN (1, 1005)").select("id"))


@query("x03_without_files", sql("stats", "SELECT entry_id AS id FROM stats WHERE file_count = 0"))
def x03(spark, d):
    return tree.without_files(paths(spark, d))


@query("j07_top_empty", sql("stats", "SELECT t.id, t.volume_id, t.parent_id, t.name FROM tree t JOIN stats s ON s.entry_id = t.id JOIN tree p ON p.id = t.parent_id LEFT JOIN stats ps ON ps.entry_id = p.id WHERE s.file_count = 0 AND (p.parent_id IS NULL OR ps.file_count > 0)"))
def j07(spark, d):
    t = fixtures.tree(spark, d)
    return tree.top_empty(t, tree.roll_up(tree.with_paths(t)))


@query("q01_canonical", sql("path", "SELECT volume_id, path, is_dir, CASE WHEN is_dir THEN 0 ELSE size END AS size, CASE WHEN NOT is_dir THEN modified_ms END AS modified_ms FROM path JOIN tree USING (id)"))
def q01(spark, d):
    return tree.canonical(paths(spark, d))


@query(
    "q02_problems",
    sql(
        "ent dst",
        """, loops AS (
  SELECT c.id AS start, c.parent_id AS above FROM ent c JOIN ent p ON p.id = c.parent_id UNION SELECT l.start, c.parent_id FROM loops l JOIN ent c ON c.id = l.above JOIN ent p ON p.id = c.parent_id),
  hung AS (SELECT e.* FROM ent e JOIN ent p ON p.id = e.parent_id AND p.is_dir AND p.volume_id = e.volume_id),
  reach AS (SELECT id, [id] AS chain FROM ent WHERE parent_id IS NULL AND is_dir UNION ALL SELECT h.id, list_append(r.chain, h.id) FROM reach r JOIN hung h ON h.parent_id = r.id WHERE h.is_dir)
SELECT 'two_roots' AS problem, min(id) AS id FROM ent WHERE parent_id IS NULL GROUP BY volume_id HAVING count(*) > 1
UNION ALL SELECT 'root_name', id FROM ent WHERE parent_id IS NULL AND name <> ''
UNION ALL SELECT 'no_parent', id FROM ent e WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ent p WHERE p.id = e.parent_id)
UNION ALL SELECT 'parent_is_file', e.id FROM ent e JOIN ent p ON p.id = e.parent_id WHERE NOT p.is_dir
UNION ALL SELECT 'other_volume', e.id FROM ent e JOIN ent p ON p.id = e.parent_id WHERE e.volume_id <> p.volume_id
UNION ALL SELECT 'same_name', min(id) FROM ent WHERE parent_id IS NOT NULL GROUP BY parent_id, name HAVING count(*) > 1
UNION ALL SELECT 'no_stats', id FROM ent WHERE is_dir AND id NOT IN (SELECT entry_id FROM dst)
UNION ALL SELECT 'file_stats', id FROM ent WHERE NOT is_dir AND id IN (SELECT entry_id FROM dst)
UNION ALL SELECT 'parked_name', id FROM ent WHERE starts_with(name, chr(1))
UNION ALL SELECT DISTINCT 'loop', start FROM loops WHERE start = above OR above IN (SELECT start FROM loops WHERE start = above)
UNION ALL SELECT 'duplicate_id', id FROM ent GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'stats_differ', d.entry_id FROM dst d JOIN (
  SELECT a AS id, coalesce(sum(size), 0) AS s, coalesce(sum(alloc), 0) AS l, count(size) AS f, count(*) FILTER (is_dir AND NOT own) AS n FROM (
    SELECT unnest(chain) AS a, false AS own, true AS is_dir, NULL AS size, NULL AS alloc FROM (SELECT chain[1:-2] AS chain FROM reach) UNION ALL SELECT unnest(chain), false, false, coalesce(e.size, 0), coalesce(e.alloc_size, e.size, 0) FROM reach r JOIN hung e ON e.parent_id = r.id AND NOT e.is_dir UNION ALL SELECT id, true, true, NULL, NULL FROM reach) GROUP BY a) x
  ON x.id = d.entry_id WHERE d.total_size IS DISTINCT FROM s OR d.total_alloc IS DISTINCT FROM l OR d.file_count IS DISTINCT FROM f OR d.dir_count IS DISTINCT FROM n""",
    ),
)
def q02(spark, d):
    return tree.problems(table(spark, d, "entries"), table(spark, d, "dir_stats"))


# ---- space ------------------------------------------------------------------------------------------------------


@query("o02_largest_files", sql("ent", "SELECT id, name, size FROM ent WHERE NOT is_dir AND size IS NOT NULL ORDER BY size DESC, id LIMIT 100"))
def o02(spark, d):
    return space.largest_files(entries(spark, d), 100).select("id", "name", "size")


@query("o02_largest_in_subtree", sql("path", "SELECT id, path, size FROM path JOIN tree USING (id) WHERE NOT is_dir AND list_contains(chain, 1005) ORDER BY size DESC, id LIMIT 50"))
def o02b(spark, d):
    return space.largest_files(tree.subtree(paths(spark, d), 1005), 50).select("id", "path", "size")


@query(
    "a02_type_stats",
    sql(
        "ent",
        f""", f AS (SELECT {ext_sql('name')} AS ext, coalesce(size, 0) AS size FROM ent WHERE NOT is_dir), x AS (SELECT ext, count(*) AS files, sum(size) AS bytes FROM f GROUP BY ext),
g AS (SELECT * FROM x ORDER BY bytes DESC, ext LIMIT 10)
SELECT 'total' AS what, '' AS key, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM f
UNION ALL SELECT 'category', k.key, count(f.ext), coalesce(sum(f.size), 0)::BIGINT FROM (SELECT unnest(['images','videos','audio','documents','archives','disk_images','code','programs','other']) AS key) k LEFT JOIN f ON {category_sql('f.ext')} = k.key AND f.ext IS NOT NULL GROUP BY k.key
UNION ALL SELECT 'band', b.b || '', count(f.ext), coalesce(sum(f.size), 0)::BIGINT FROM range(6) b(b) LEFT JOIN f ON {band_sql('f.size')} = b.b AND f.ext IS NOT NULL GROUP BY b.b
UNION ALL SELECT 'extension', ext, files, bytes::BIGINT FROM g
UNION ALL SELECT 'other_extensions', '', coalesce(sum(files), 0)::BIGINT, coalesce(sum(bytes), 0)::BIGINT FROM x WHERE ext NOT IN (SELECT ext FROM g)""",
    ),
)
def a02(spark, d):
    return space.type_stats(entries(spark, d), 10)


@query("w07_treemap", sql("stats", """, u AS (SELECT t.id, t.parent_id, t.name, t.is_dir, CASE WHEN t.is_dir THEN total_size ELSE size END AS size, p.depth FROM tree t JOIN path p USING (id) LEFT JOIN stats ON entry_id = t.id WHERE t.volume_id = 1),
s AS (SELECT * FROM u WHERE depth > 0 AND size >= (SELECT greatest(1, ceil(size * 0.00002)) FROM u WHERE id = 1)),
f AS (SELECT u.id, u.size, u.depth, count(*) AS n FROM u JOIN s ON s.parent_id = u.id WHERE u.is_dir GROUP BY ALL),
o AS (SELECT id, size, depth, n, coalesce(sum(n) OVER (ORDER BY size DESC, depth, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f QUALIFY before < 12000),
k AS (SELECT s.* FROM s JOIN o ON o.id = s.parent_id QUALIFY before + row_number() OVER (PARTITION BY s.parent_id ORDER BY s.size DESC, s.name, s.id) <= 12000),
n AS (SELECT * FROM k UNION ALL SELECT id, NULL, name, is_dir, size, depth FROM u WHERE id = 1),
h AS (SELECT id FROM o UNION SELECT id FROM n WHERE is_dir AND depth < 64 AND NOT EXISTS (SELECT 1 FROM o WHERE before + o.n >= 12000 AND (-o.size, o.depth, o.id) <= (-n.size, n.depth, n.id)))
SELECT n.id, n.parent_id, n.name, n.size, n.is_dir, n.depth, CASE WHEN n.id IN (FROM h) THEN (coalesce((SELECT sum(size) FROM u x WHERE x.parent_id = n.id), 0) - coalesce((SELECT sum(size) FROM k x WHERE x.parent_id = n.id), 0))::BIGINT ELSE 0 END AS other
FROM n"""))
def w07(spark, d):
    """The treemap of volume 1."""
    p = tree.with_paths(fixtures.tree(spark, d))
    return space.treemap(p, tree.roll_up(p), 1)


@query("o06_folder_page", sql("ent dst", "SELECT parent_id, id, row_number() OVER k AS pos, greatest(count(*) OVER (PARTITION BY parent_id) - 1000, 0) AS more FROM (SELECT e.id, parent_id, name, CASE WHEN is_dir THEN coalesce(total_size, 0) ELSE coalesce(size, -1) END AS size FROM ent e LEFT JOIN dst ON entry_id = e.id WHERE parent_id IS NOT NULL) WINDOW k AS (PARTITION BY parent_id ORDER BY size DESC, name, id) QUALIFY pos <= 1000"))
def o06(spark, d):
    """What a view shows of every folder, and how many children it doesn't."""
    return space.folder_page(space.folder_items(entries(spark, d), stats(spark, d)), 1000)


# ---- search -----------------------------------------------------------------------------------------------------


def catalog_index(spark, d):
    return S.name_index(entries(spark, d).withColumn("modified_ms", N.unix_ms(c("modified_at"))))


def searched(spark, d, text: str, with_paths: bool = False) -> DataFrame:
    """A search of the catalog's entries, or with paths of the derived tree."""
    index = S.name_index(fixtures.tree(spark, d)) if with_paths else catalog_index(spark, d)
    return S.matches(index, table(spark, d, "volumes"), parse(text, NOW), paths(spark, d).select("id", "path") if with_paths else None)


SCORE = r"(CASE WHEN upper(name) = '{t}' THEN 0 WHEN starts_with(upper(name), '{t}') THEN 1 WHEN regexp_matches(upper(name), '[ _\-.(\[]{t}') THEN 2 ELSE 3 END * 1000 + least(strlen(upper(name)), 999))::BIGINT"
MS = "((modified_at - 116444736000000000) // 10000)"


@query("f03_search_words", sql("ent", f"SELECT id, {SCORE.format(t='COPY')} AS score FROM ent WHERE parent_id IS NOT NULL AND contains(upper(name), 'COPY') AND contains(upper(name), 'PLAN')"))
def f03(spark, d):
    return searched(spark, d, "copy plan").select("id", "score")


@query("f04_search_size", sql("ent", "SELECT id FROM ent WHERE parent_id IS NOT NULL AND NOT is_dir AND size BETWEEN 1500000 AND 20000000"))
def f04(spark, d):
    return searched(spark, d, "size:1.5MB..20MB").select("id")


@query("f05_search_types", sql("ent", f"SELECT id FROM ent WHERE parent_id IS NOT NULL AND NOT is_dir AND {ext_sql('lower(name)')} IN ('jpg', 'png', 'pdf') AND {category_sql(ext_sql('lower(name)'))} = 'images'"))
def f05(spark, d):
    return searched(spark, d, "ext:jpg,.PNG,pdf type:foto").select("id")


@query("f06_search_modified", sql("ent", f"SELECT id FROM ent WHERE parent_id IS NOT NULL AND {MS} >= epoch_ms(TIMESTAMP '2019-01-01') AND {MS} < epoch_ms(TIMESTAMP '2021-04-01')"))
def f06(spark, d):
    return searched(spark, d, "modified:2019..2021-03").select("id")


@query("f07_search_disk", sql("ent", "SELECT id FROM ent WHERE parent_id IS NOT NULL AND is_dir AND volume_id IN (SELECT id FROM volumes WHERE online AND (upper(user_name) = 'LAB' OR upper(os_label) = 'LAB' OR upper(rtrim(last_mount, chr(92))) = 'LAB'))"))
def f07(spark, d):
    return searched(spark, d, "disk:lab online:yes is:folder").select("id")


@query("f08_search_path", sql("path", "SELECT t.id FROM tree t JOIN path p ON p.id = t.parent_id WHERE contains(upper(p.path), 'NATION_12') AND contains(upper(t.name), 'ORDER_1')"))
def f08(spark, d):
    return searched(spark, d, "path:nation_12 order_1", True).select("id")


@query("f09_search_regex", sql("ent", r"SELECT id FROM ent WHERE parent_id IS NOT NULL AND regexp_matches(upper(name), '^SCAN[ _-]?\d+\.PDF$')"))
def f09(spark, d):
    return searched(spark, d, r'regex:"^scan[ _-]?\d+\.pdf$"').select("id")


@query("f10_no_roots", sql("ent", "SELECT count(*) AS n FROM ent WHERE parent_id IS NOT NULL"))
def f10(spark, d):
    return catalog_index(spark, d).agg(F.count("*").alias("n"))


@query("o03_search_ranked", sql("ent", f"SELECT id, volume_id, {SCORE.format(t='SCAN')} AS score FROM ent WHERE parent_id IS NOT NULL AND contains(upper(name), 'SCAN') ORDER BY score, volume_id, id LIMIT 200"))
def o03(spark, d):
    return S.ranked(searched(spark, d, "scan")).select("id", "volume_id", "score")


@query("o03_search_total", sql("ent", "SELECT least(count(*), 10000) AS total FROM ent WHERE parent_id IS NOT NULL AND contains(upper(name), 'A')"))
def o03b(spark, d):
    return spark.createDataFrame([(S.capped_total(searched(spark, d, "a")),)], "total long")


@query("o04_first_matches", sql("ent", "SELECT volume_id, id FROM ent WHERE parent_id IS NOT NULL AND contains(upper(name), 'DRAFT') QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY id) <= 10"))
def o04(spark, d):
    """The first ten matches of each volume, in the order of ids."""
    from pyspark.sql import Window

    m = searched(spark, d, "draft").select("volume_id", "id")
    return m.withColumn("n", F.row_number().over(Window.partitionBy("volume_id").orderBy("id"))).where("n <= 10").drop("n")


@query(
    "proj05_search_hits",
    sql("stats", f"""SELECT t.id, p.path AS folder, CASE WHEN is_dir THEN 'dir' ELSE {category_sql(ext_sql('lower(t.name)'))} END AS kind, CASE WHEN is_dir THEN total_size ELSE size END AS size,
  coalesce(nullif(trim(user_name), ''), nullif(trim(os_label), ''), nullif(trim(last_mount), ''), '#' || v.id) AS disk, online
FROM (SELECT *, {SCORE.format(t='CUSTOMER').replace('upper(name)', 'upper(name)')} AS score FROM tree WHERE contains(upper(name), 'CUSTOMER') AND parent_id IS NOT NULL ORDER BY score, volume_id, id LIMIT 50) t
JOIN path p ON p.id = t.parent_id JOIN volumes v ON v.id = t.volume_id LEFT JOIN stats ON entry_id = t.id"""),
)
def p05(spark, d):
    p = paths(spark, d)
    best = S.ranked(searched(spark, d, "customer", True), 50)
    return S.hits(best, p, table(spark, d, "volumes"), tree.roll_up(p)).select("id", "folder", "kind", "size", "disk", "online")


@query("proj01_display_size", sql("ent dst", "SELECT e.id, CASE WHEN is_dir THEN coalesce(total_size, 0) ELSE size END AS size FROM ent e LEFT JOIN dst ON entry_id = e.id WHERE parent_id IS NOT NULL"))
def proj01(spark, d):
    return space.folder_items(entries(spark, d), stats(spark, d)).select("id", "size")


@query("proj06_full_path", sql("path", "SELECT t.id, rtrim(v.last_mount, chr(92)) || chr(92) || p.path AS full_path FROM path p JOIN tree t USING (id) JOIN volumes v ON v.id = t.volume_id WHERE v.last_mount IS NOT NULL AND t.is_dir"))
def proj06(spark, d):
    v = table(spark, d, "volumes").where("last_mount IS NOT NULL").select(c("id").alias("volume_id"), F.regexp_replace("last_mount", r"\\+$", "").alias("m"))
    return paths(spark, d).where("is_dir").join(v, "volume_id").select("id", F.concat("m", F.lit("\\"), N.decode_name(c("path"))).alias("full_path"))


@query("a13_counters", sql("ent dst", "SELECT 'entries' AS what, count(*) AS n FROM ent UNION ALL SELECT 'folders', count(*) FILTER (is_dir) FROM ent UNION ALL SELECT 'bytes', sum(size) FILTER (NOT is_dir)::BIGINT FROM ent UNION ALL SELECT 'folder_totals', count(*) FROM dst"))
def a13(spark, d):
    g = entries(spark, d).agg(F.count("*").alias("entries"), F.count_if("is_dir").alias("folders"), F.sum(F.when(~c("is_dir"), c("size"))).alias("bytes"))
    return g.unpivot([], ["entries", "folders", "bytes"], "what", "n").unionByName(stats(spark, d).agg(F.count("*").alias("n")).select(F.lit("folder_totals").alias("what"), "n"))


@query("x01_contained", sql("path", "SELECT id FROM path WHERE upper(path) IN ('NATION_1', 'NATION_6') OR starts_with(upper(path), 'NATION_1' || chr(92)) OR starts_with(upper(path), 'NATION_6' || chr(92))"))
def x01(spark, d):
    """Entries at or below one of the allowed folders; whole names, so `Nation_12` is outside."""
    from ..operators.cleanup import protected

    p = paths(spark, d)
    return p.where(protected(c("path"), ["Nation_1", "nation_6"])).select("id")


@query("u01_recursive_union", sql("tree", ", sub AS (SELECT id FROM tree WHERE id = 2 UNION ALL SELECT t.id FROM sub JOIN tree t ON t.parent_id = sub.id) SELECT id FROM sub"))
def u01(spark, d):
    return tree.subtree(paths(spark, d), 2).select("id")
