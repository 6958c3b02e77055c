"""Queries over contents, duplicates, similar pictures and backups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import names as N
from ..operators import backup, content, similar
from ..operators import duplicates as D
from . import table
from .base import category_sql, ext_sql, sql

QUERIES, SQL = {}, {}
c = F.col


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


# ---- contents: documents as files; every tenth hash is missing, some are of an older size or time -------------------


def files(spark, d):
    return fixtures.content_files(spark, d).select("id", "volume_id", "name", "path", "size", "modified", F.when(c("doc_id") % 11 == 0, 4194304).otherwise(32).cast("long").alias("attrs"), "online", "doc_id")


def hashes(spark, d):
    f = fixtures.content_files(spark, d).where("doc_id % 10 <> 9 AND full IS NOT NULL")
    return f.select(c("id").alias("entry_id"), (c("size") + (c("doc_id") % 10 == 7).cast("int")).alias("size"), (c("modified") + (c("doc_id") % 10 == 8).cast("int")).alias("modified"), "quick", F.when(c("doc_id") % 10 < 5, c("full")).alias("full"))


def hashed(spark, d):
    return content.with_hashes(files(spark, d), hashes(spark, d))


HASHED = """, h AS (
  SELECT doc.id, volume_id, name, path, size, modified, online, doc_id, CASE WHEN doc_id % 11 = 0 THEN 4194304 ELSE 32 END AS attrs,
    CASE WHEN doc_id % 10 NOT IN (7, 8, 9) THEN quick END AS quick, CASE WHEN doc_id % 10 < 5 THEN "full" END AS "full" FROM doc),
sq AS (SELECT size, quick, count(*) AS n FROM h WHERE quick IS NOT NULL GROUP BY ALL HAVING n > 1),
w AS (SELECT * FROM h WHERE size > 0 AND attrs & 4460544 = 0) """


@query("f01_valid_hashes", sql("doc", HASHED + 'SELECT id, quick, "full" FROM h'))
def f01(spark, d):
    return hashed(spark, d).select("id", "quick", "full")


EIGHT = " || ".join(f"lpad(printf('%x', (strlen(text) >> {8 * k}) & 255), 2, '0')" for k in range(8))


@query("c16_content_hashes", f"SELECT doc_id, sha256(text) AS \"full\", sha256(unhex({EIGHT} || left(h, 131072) || substr(h, greatest(131072, 2 * strlen(text) - 131072) + 1))) AS quick FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL)")
def c16(spark, d):
    b = c("text").cast("binary")
    return table(spark, d, "documents").where(c("text").isNotNull()).select("doc_id", content.full_hash(b).alias("full"), content.quick_hash(b).alias("quick"))


@query("j02_work_states", sql("doc", HASHED + 'SELECT id, quick IS NOT NULL AS has_quick, "full" IS NOT NULL AS has_full, doc_id % 4 = 1 AS has_print FROM h'))
def j02(spark, d):
    """What is known of each file as it is now; every fourth has a print, every other one of an older time."""
    f = files(spark, d)
    prints = f.where("doc_id % 4 IN (1, 2)").select(c("id").alias("entry_id"), "size", (c("modified") - (c("doc_id") % 4 - 1)).alias("modified"))
    return content.work_state(f, hashes(spark, d), prints)


@query("j04_quick_work", sql("doc", HASHED + "SELECT id, size FROM w WHERE quick IS NULL AND size IN (SELECT size FROM h WHERE size > 0 GROUP BY size HAVING count(*) > 1)"))
def j04(spark, d):
    return content.quick_work(hashed(spark, d))


@query("j05_full_work", sql("doc", HASHED + 'SELECT id, size, (size, quick) IN (SELECT (size, quick) FROM sq) AS candidate FROM w WHERE "full" IS NULL AND quick IS NOT NULL UNION ALL SELECT id, size, false FROM w WHERE "full" IS NULL AND quick IS NULL'))
def j05(spark, d):
    return content.full_work(hashed(spark, d))


@query("w10_hash_order", sql("doc", HASHED + 'SELECT id, row_number() OVER (ORDER BY cand DESC, CASE WHEN cand THEN -size ELSE size END, id) AS pos FROM (SELECT id, size, quick IS NOT NULL AND (size, quick) IN (SELECT (size, quick) FROM sq) AS cand FROM w WHERE "full" IS NULL)'))
def w10(spark, d):
    """The place of every pending file in the full pass."""
    return content.hash_order(hashed(spark, d))


@query("a04_shared_quick", sql("doc", HASHED + "SELECT size, quick, n FROM sq"))
def a04(spark, d):
    return content.shared_quick(hashed(spark, d))


@query("a05_hash_progress", sql("doc", HASHED + 'SELECT volume_id, count(*) AS files, count("full") AS hashed, count(*) - count("full") AS pending FROM w GROUP BY 1'))
def a05(spark, d):
    return content.progress(hashed(spark, d))


@query("a07_pending", sql("doc", HASHED + 'SELECT count(*) - count("full") AS pending FROM w'))
def a07(spark, d):
    return content.progress(hashed(spark, d)).agg(F.sum("pending").alias("pending"))


@query("h01_passes", sql("doc", HASHED + """SELECT id, CASE WHEN quick IS NULL AND size IN (SELECT size FROM h WHERE size > 0 GROUP BY size HAVING count(*) > 1) THEN 1
  WHEN "full" IS NOT NULL THEN 0 WHEN quick IS NOT NULL AND (size, quick) IN (SELECT (size, quick) FROM sq) THEN 2 ELSE 3 END::BIGINT AS pass FROM w"""))
def h01(spark, d):
    return content.passes(hashed(spark, d))


@query("f17_changed_recently", sql("tree", "SELECT id FROM tree WHERE modified_ms > epoch_ms(TIMESTAMP '1996-06-15') - 864000000 AND modified_ms < epoch_ms(TIMESTAMP '1996-06-15') + 864000000"))
def f17(spark, d):
    return fixtures.tree(spark, d).where(content.changed_recently(c("modified_ms"), 834_796_800_000, 864_000_000)).select("id")


# ---- duplicates of the dup_files table: the latest listing of each entry ---------------------------------------------


def dup_files(spark, d):
    f = table(spark, d, "dup_files").groupBy(c("entry_id").alias("id")).agg(F.max_by(F.struct("volume_id", "size", F.lower("full_hash").alias("full"), F.coalesce("path", F.lit("")).alias("path"), "modified", F.coalesce("online", F.lit(False)).alias("online")), "seen_at").alias("r")).select("id", "r.*")
    return f.withColumn("name", F.element_at(F.split("path", r"\\"), -1))


DUPS = """WITH l AS (SELECT DISTINCT * FROM dup_files QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY seen_at DESC) = 1),
f AS (SELECT entry_id AS id, volume_id, size, lower(full_hash) AS "full", coalesce(path, '') AS path, modified, coalesce(online, false) AS online, split_part(coalesce(path, ''), chr(92), -1) AS name FROM l),
m AS (SELECT *, count(*) OVER (PARTITION BY size, "full") AS copies FROM f WHERE size >= 1 AND "full" IS NOT NULL QUALIFY copies > 1),
g AS (SELECT size, "full", count(*) AS copies, count(*) FILTER (online) AS online, min(id) AS first_id FROM m GROUP BY ALL) """


@query("j06_duplicates", DUPS + 'SELECT id, size, "full", copies FROM m')
def j06(spark, d):
    return D.members(dup_files(spark, d)).select("id", "size", "full", "copies")


@query("a03_groups", DUPS + 'SELECT size, "full", copies, online, copies - online AS offline, size * (copies - 1) AS recoverable, first_id FROM g')
def a03(spark, d):
    return D.summary(D.members(dup_files(spark, d)))


@query("a03_totals", DUPS + "SELECT count(*) AS groups, sum(copies)::BIGINT AS files, sum(size * (copies - 1))::BIGINT AS recoverable FROM g")
def a03b(spark, d):
    return D.totals(D.members(dup_files(spark, d)))


@query("p08_group_key".replace("p08", "proj08"), DUPS + 'SELECT size || \'-\' || left("full", 16) AS group_key, copies FROM g')
def proj08(spark, d):
    return D.summary(D.members(dup_files(spark, d))).select(F.concat_ws("-", "size", F.left("full", F.lit(16))).alias("group_key"), "copies")


@query("f14_filtered_groups", DUPS + f"SELECT size, \"full\" FROM m GROUP BY size, \"full\" HAVING size >= 1000 AND bool_or(volume_id = 7) AND bool_or(volume_id = 7 AND contains(upper(path), 'O')) AND {category_sql(ext_sql('min_by(name, id)'))} = 'images'")
def f14(spark, d):
    return D.filtered(D.members(dup_files(spark, d)), 1000, "images", 7, "o")


@query("o05_largest_groups", DUPS + 'SELECT size, "full", copies, size * (copies - 1) AS recoverable FROM g ORDER BY recoverable DESC, size DESC, "full" LIMIT 300')
def o05(spark, d):
    return D.largest_groups(D.members(dup_files(spark, d))).select("size", "full", "copies", "recoverable")


RULES = [("keep_on_volume", 7), ("keep_oldest",), ("keep_shortest_path",), ("never_in", "misc")]


@query(
    "w01_selected",
    DUPS
    + """, r1 AS (SELECT *, bool_or(volume_id = 7) OVER k AS any1 FROM m WINDOW k AS (PARTITION BY size, "full")),
r2 AS (SELECT *, CASE WHEN any1 THEN volume_id = 7 ELSE true END AS a1 FROM r1),
r3 AS (SELECT *, min(modified) FILTER (a1) OVER (PARTITION BY size, "full") AS oldest FROM r2),
r4 AS (SELECT *, a1 AND modified IS NOT DISTINCT FROM oldest AS a2 FROM r3),
r5 AS (SELECT *, min(length(path)) FILTER (a2) OVER (PARTITION BY size, "full") AS shortest FROM r4),
r6 AS (SELECT *, min(id) FILTER (a2 AND length(path) = shortest) OVER (PARTITION BY size, "full") AS keeper FROM r5)
SELECT id, size, "full" FROM r6 WHERE online AND id <> keeper AND NOT contains(upper(path), 'MISC')""",
)
def w01(spark, d):
    return D.selected(D.members(dup_files(spark, d)), RULES)


@query("a17_selection_totals", DUPS + ', k AS (SELECT size, "full", min(id) AS keeper FROM m GROUP BY ALL) SELECT count(*) AS copies, sum(size)::BIGINT AS bytes FROM m JOIN k USING (size, "full") WHERE online AND id <> keeper')
def a17(spark, d):
    return D.selected(D.members(dup_files(spark, d)), []).agg(F.count("*").alias("copies"), F.sum("size").alias("bytes"))


@query("x12_only_offline_left", DUPS + ', k AS (SELECT size, "full", min(id) AS keeper FROM m GROUP BY ALL) SELECT size, "full" FROM m JOIN k USING (size, "full") GROUP BY size, "full" HAVING count(*) FILTER (online AND id <> keeper) > 0 AND count(*) FILTER (online AND id = keeper) = 0 AND count(*) FILTER (NOT online OR id = keeper) > 0')
def x12(spark, d):
    """Groups where deleting the default selection leaves copies on unconnected disks only."""
    m = D.members(dup_files(spark, d))
    return D.only_offline_left(m, D.selected(m, []))


@query("x12_can_select", DUPS + ', k AS (SELECT size, "full", count(*) FILTER (NOT (online AND id % 3 <> 0)) AS l FROM m GROUP BY ALL) SELECT id, online AND ((online AND id % 3 <> 0) OR l > 1) AS can_select FROM m JOIN k USING (size, "full")')
def x12b(spark, d):
    """Which copies can be selected or unselected after two in three connected ones are."""
    m = D.members(dup_files(spark, d))
    return D.can_select(m, m.where("online AND id % 3 <> 0"))


@query("j19_last_copies", DUPS + """, doomed AS (SELECT * FROM f WHERE id % 2 = 0), s AS (SELECT size, "full", count(*) FILTER (id % 2 <> 0) AS kept, count(*) FILTER (id % 2 <> 0 AND online) AS kept_online FROM f WHERE "full" IS NOT NULL AND size > 0 GROUP BY ALL)
SELECT d.id, CASE WHEN s.kept IS NULL THEN 'no_hash' WHEN kept = 0 THEN 'last_copy' WHEN kept_online = 0 THEN 'only_offline' ELSE 'ok' END AS verdict FROM doomed d LEFT JOIN s USING (size, "full")""")
def j19(spark, d):
    f = dup_files(spark, d)
    return D.last_copies(f, f.where("id % 2 = 0"))


@query("j20_kept_copies", DUPS + 'SELECT d.id, min(k.id) AS kept_id, count(*) AS kept FROM f d JOIN f k ON d.size = k.size AND d."full" = k."full" WHERE d.id % 2 = 0 AND k.id % 2 <> 0 GROUP BY d.id')
def j20(spark, d):
    f = dup_files(spark, d)
    return D.kept_copies(f, f.where("id % 2 = 0"))


@query("j21_same_file", DUPS + ", n AS (SELECT id, volume_id AS serial, size + (volume_id << 32) AS number, CASE WHEN volume_id % 3 = 0 THEN 'nas' || volume_id % 2 END AS server FROM f) SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON (a.serial = b.serial AND a.number = b.number) OR (a.server = b.server AND a.number & 4294967295 = b.number & 4294967295 AND a.number & 4294967295 <> 0) WHERE a.id % 3 = 0 AND b.id % 3 = 1")
def j21(spark, d):
    """Files that are one on disk; sizes stand for file numbers, every third volume is a share of one of two servers."""
    v = c("volume_id")
    f = dup_files(spark, d).select("id", v.alias("serial"), (c("size") + v * (1 << 32)).alias("number"), F.when(v % 3 == 0, F.concat(F.lit("nas"), (v % 2).cast("string"))).alias("server"))
    return D.same_file(f.where("id % 3 = 0"), f.where("id % 3 = 1"))


# ---- similar pictures and videos -------------------------------------------------------------------------------------


def prints(spark, d):
    return table(spark, d, "image_prints").where("dhash <> 0").groupBy(c("entry_id").alias("id")).agg(F.max(F.struct("dhash", "width", "height")).alias("r")).select("id", c("r.dhash").alias("print"), "r.width", "r.height")


PRINTS = "p AS (SELECT DISTINCT entry_id AS id, dhash AS print, width, height FROM image_prints WHERE dhash <> 0)"


@query("c13_distance", "SELECT entry_a, entry_b, bit_count(xor(a.dhash, b.dhash))::BIGINT AS distance FROM (SELECT DISTINCT entry_a, entry_b FROM print_pairs) JOIN (SELECT DISTINCT entry_id, dhash FROM image_prints) a ON a.entry_id = entry_a JOIN (SELECT DISTINCT entry_id, dhash FROM image_prints) b ON b.entry_id = entry_b")
def c13(spark, d):
    p = table(spark, d, "image_prints").select("entry_id", "dhash").distinct()
    pairs = table(spark, d, "print_pairs").select("entry_a", "entry_b").distinct()
    j = pairs.join(p.select(c("entry_id").alias("entry_a"), c("dhash").alias("x")), "entry_a").join(p.select(c("entry_id").alias("entry_b"), c("dhash").alias("y")), "entry_b")
    return j.select("entry_a", "entry_b", N.hamming(c("x"), c("y")).alias("distance"))


@query("j13_near_prints", f"WITH {PRINTS}, q AS (SELECT DISTINCT print FROM p) SELECT a.print AS a, b.print AS b, bit_count(xor(a.print, b.print))::BIGINT AS distance FROM q a JOIN q b ON a.print < b.print AND bit_count(xor(a.print, b.print)) <= 6")
def j13(spark, d):
    """Only the prints count, so no file's prints are put together first."""
    return similar.near_prints(table(spark, d, "image_prints").where("dhash <> 0"), 6, "dhash")


@query("j13_groups", f"WITH RECURSIVE {PRINTS}, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND bit_count(xor(a.print, b.print)) <= 6), r AS (SELECT a AS id, a AS near FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.near) SELECT id, min(near) AS group_id FROM r GROUP BY id")
def j13b(spark, d):
    return similar.print_groups(prints(spark, d), 6)


@query("j14_similar", f"WITH {PRINTS} SELECT a.id, b.id AS near_id, bit_count(xor(a.print, b.print))::BIGINT AS distance FROM p a JOIN p b ON a.id <> b.id AND bit_count(xor(a.print, b.print)) <= 6 WHERE a.id % 20 = 0")
def j14(spark, d):
    """Every print whose id is divisible by 20, searched among all."""
    p = prints(spark, d)
    return similar.similar(p.where("id % 20 = 0"), p, 6)


@query("w06_representatives", f"WITH RECURSIVE {PRINTS}, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND bit_count(xor(a.print, b.print)) <= 6), r AS (SELECT a AS id, a AS near FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.near), g AS (SELECT id, min(near) AS group_id FROM r GROUP BY id), x AS (SELECT group_id, min_by(p.id, (-coalesce(width::BIGINT * height, 0), p.id)) AS rep_id, count(*) AS files FROM g JOIN p USING (id) GROUP BY 1) SELECT group_id, g.id, rep_id, files, bit_count(xor(p.print, q.print))::BIGINT AS distance FROM g JOIN x USING (group_id) JOIN p ON p.id = g.id JOIN p q ON q.id = rep_id")
def w06(spark, d):
    p = prints(spark, d)
    return similar.representatives(similar.print_groups(p, 6), p)


def videos(spark, d):
    v = fixtures.vector_prints(spark, d).groupBy(F.floor(c("id") / 5).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "print"))), lambda x: x["print"]).alias("frames"))
    return v.select("id", (c("id") % 40 * 700 + 60000).alias("duration_ms"), "frames")


VIDEOS = ", v AS (SELECT id // 5 AS id, 60000 + 700 * (id // 5 % 40) AS duration_ms, list(print ORDER BY id) AS frames FROM vec GROUP BY id // 5), dist AS (SELECT a.id AS a, b.id AS b, abs(a.duration_ms - b.duration_ms) <= greatest(greatest(a.duration_ms, b.duration_ms) * 3 // 100, 2000) AS near, list_sum(list_transform(range(1, len(a.frames) + 1), lambda i: bit_count(xor(a.frames[i], b.frames[i])))) / len(a.frames) AS mean FROM v a JOIN v b ON a.id < b.id WHERE len(a.frames) = len(b.frames)) "


@query("c14_mean_distance", sql("vec", VIDEOS + "SELECT a, b, round(mean, 6) AS mean FROM dist WHERE b = a + 1"))
def c14(spark, d):
    v = videos(spark, d)
    w = v.select((c("id") - 1).alias("id"), c("id").alias("b"), c("frames").alias("fb"))
    return v.join(w, "id").where(F.size("frames") == F.size("fb")).select(c("id").alias("a"), "b", F.round(N.mean_distance(c("frames"), c("fb")), 6).alias("mean"))


@query("j15_near_videos", sql("vec", VIDEOS + "SELECT a, b FROM dist WHERE near AND mean <= 28"))
def j15(spark, d):
    return similar.near_videos(videos(spark, d), 28.0)


@query("j15_groups", sql("vec", VIDEOS + ", e AS (SELECT a, b FROM dist WHERE near AND mean <= 28 UNION SELECT b, a FROM dist WHERE near AND mean <= 28), r AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other) SELECT id, min(other) AS group_id, (SELECT count(*) FROM e WHERE a = id) AS links FROM r GROUP BY id"))
def j15b(spark, d):
    return similar.video_groups(videos(spark, d), 28.0)


@query("f20_close_durations", "SELECT a.p_partkey AS a, b.p_partkey AS b, abs(a.d - b.d) <= greatest(greatest(a.d, b.d) * 3 // 100, 2000) AS near FROM (SELECT p_partkey, floor(p_retailprice * 100)::BIGINT AS d FROM part) a JOIN (SELECT p_partkey, floor(p_retailprice * 100)::BIGINT AS d FROM part) b ON b.p_partkey = a.p_partkey + 1")
def f20(spark, d):
    p = table(spark, d, "part").select(c("p_partkey").alias("a"), F.floor(c("p_retailprice") * 100).cast("long").alias("da"))
    q = p.select((c("a") - 1).alias("a"), c("a").alias("b"), c("da").alias("db"))
    return p.join(q, "a").select("a", "b", similar.close_durations(c("da"), c("db")).alias("near"))


@query("a06_print_progress", f"WITH e AS (SELECT DISTINCT * FROM entries), p AS (SELECT DISTINCT entry_id, size, modified_at FROM image_prints) SELECT volume_id, count(*) AS files, count(p.entry_id) AS printed FROM e LEFT JOIN p ON p.entry_id = e.id AND p.size = e.size AND p.modified_at IS NOT DISTINCT FROM e.modified_at WHERE NOT is_dir AND {ext_sql('name')} IN ({', '.join(map(repr, N.IMAGE_EXTENSIONS + N.RAW_EXTENSIONS))}) AND e.size <= 536870912 GROUP BY 1")
def a06(spark, d):
    """Pictures per volume and those with a print of their present size and time."""
    e = table(spark, d, "entries").dropDuplicates(["id"]).where(~c("is_dir") & N.is_printable(c("name")) & (c("size") <= N.MAX_IMAGE_BYTES)).select("id", "volume_id", "size", "modified_at")
    p = table(spark, d, "image_prints").select(c("entry_id").alias("id"), c("size").alias("s"), c("modified_at").alias("m")).distinct()
    ok = (c("s") == c("size")) & c("m").eqNullSafe(c("modified_at"))
    return e.join(p, "id", "left").groupBy("volume_id").agg(F.count("*").alias("files"), F.count_if(ok).alias("printed"))


@query("j01_valid_prints", "SELECT e.id, p.dhash FROM (SELECT DISTINCT * FROM entries) e JOIN (SELECT DISTINCT * FROM image_prints) p ON p.entry_id = e.id AND p.size = e.size AND p.modified_at IS NOT DISTINCT FROM e.modified_at")
def j01(spark, d):
    e = table(spark, d, "entries").dropDuplicates(["id"]).select("id", "size", "modified_at")
    p = table(spark, d, "image_prints").distinct().select(c("entry_id").alias("id"), "size", c("modified_at").alias("m"), "dhash")
    return e.join(p, ["id", "size"]).where(c("modified_at").eqNullSafe(c("m"))).select("id", "dhash")


# ---- backups: even documents are the source, odd ones the destination -------------------------------------------------


def side(spark, d, odd: int):
    f = fixtures.content_files(spark, d).where(c("doc_id") % 2 == odd)
    half = F.floor(c("doc_id") / 2)
    rel = F.concat(F.lit("d"), (half % 9).cast("string"), F.lit("\\"), F.when(half % 3 == 0, F.lit("x")).otherwise(F.lit("y")), (half % 50).cast("string"), F.lit("\\f"), half.cast("string"), F.lit(".txt"))
    return f.select(rel.alias("rel"), (c("size") % 40).alias("size"), (half * 15_000_000).alias("modified"), F.when(c("doc_id") % 5 < 3, F.md5((c("size") % 40).cast("string").cast("binary"))).alias("full"))


SIDES = """WITH s AS (SELECT doc_id % 2 AS odd, 'd' || (doc_id // 2) % 9 || chr(92) || CASE WHEN (doc_id // 2) % 3 = 0 THEN 'x' ELSE 'y' END || (doc_id // 2) % 50 || chr(92) || 'f' || (doc_id // 2) || '.txt' AS rel,
  coalesce(n_chars, 0) % 40 AS size, (doc_id // 2) * 15000000 AS modified, CASE WHEN doc_id % 5 < 3 THEN md5((coalesce(n_chars, 0) % 40) || '') END AS "full" FROM documents),
a AS (SELECT *, upper(split_part(rel, chr(92), -1)) AS name FROM s WHERE odd = 0), b AS (SELECT *, upper(split_part(rel, chr(92), -1)) AS name FROM s WHERE odd = 1),
v AS (SELECT rel, size, CASE WHEN "full" IS NOT NULL AND (size, "full") IN (SELECT (size, "full") FROM b WHERE "full" IS NOT NULL) THEN 'content'
  WHEN EXISTS (SELECT 1 FROM b WHERE b.name = a.name AND b.size = a.size AND abs(a.modified - b.modified) <= 20000000 AND (a."full" IS NULL OR b."full" IS NULL)) THEN 'metadata' ELSE 'missing' END AS evidence FROM a) """


@query("j10_verify", SIDES + "SELECT * FROM v")
def j10(spark, d):
    return backup.verify(side(spark, d, 0), side(spark, d, 1))


@query("a08_tallies", SIDES + "SELECT evidence, count(*) AS files, sum(size)::BIGINT AS bytes FROM v GROUP BY 1")
def a08(spark, d):
    return backup.tallies(backup.verify(side(spark, d, 0), side(spark, d, 1)), "evidence")


@query("a11_coverage", SIDES + "SELECT count(*) AS files, count(*) FILTER (evidence <> 'missing') AS found, sum(size)::BIGINT AS bytes, sum(size) FILTER (evidence <> 'missing')::BIGINT AS found_bytes, count(*) FILTER (evidence <> 'missing') * 100 // count(*) AS files_percent, (sum(size) FILTER (evidence <> 'missing') * 100 // sum(size))::BIGINT AS bytes_percent FROM v")
def a11(spark, d):
    return backup.coverage(backup.verify(side(spark, d, 0), side(spark, d, 1)))


@query("a09_folder_level", SIDES + "SELECT CASE WHEN contains(substr(rel, 4), chr(92)) THEN split_part(substr(rel, 4), chr(92), 1) ELSE '' END AS name, evidence, count(*) AS files, sum(size)::BIGINT AS bytes FROM v WHERE starts_with(rel, 'd4' || chr(92)) GROUP BY ALL")
def a09(spark, d):
    return backup.folder_level(backup.verify(side(spark, d, 0), side(spark, d, 1)), "d4", "evidence")


@query("f15_report_filter", SIDES + "SELECT rel, size FROM v WHERE evidence = 'missing' AND size >= 10 AND contains(upper(rel), 'X1')")
def f15(spark, d):
    v = backup.verify(side(spark, d, 0), side(spark, d, 1))
    return v.where((c("evidence") == "missing") & (c("size") >= 10) & F.contains(N.fold(c("rel")), F.lit("X1"))).select("rel", "size")


@query("u02_not_in_backup", SIDES + 'SELECT rel, "full" FROM a WHERE "full" IS NOT NULL EXCEPT SELECT rel, "full" FROM b')
def u02(spark, d):
    key = ["rel", "full"]
    return side(spark, d, 0).where("full IS NOT NULL").select(*key).subtract(side(spark, d, 1).select(*key))


@query("f19_same_time", SIDES + "SELECT a.rel, abs(a.modified - b.modified - (length(a.rel) - 14) * 9000000) <= 20000000 AS same FROM a JOIN b USING (rel)")
def f19(spark, d):
    b = side(spark, d, 1).select("rel", c("modified").alias("m"))
    return side(spark, d, 0).join(b, "rel").select("rel", backup.same_time(c("modified"), c("m") + (F.length("rel") - 14) * 9_000_000).alias("same"))


@query(
    "j11_compare_paths",
    SIDES
    + """SELECT coalesce(a.rel, b.rel) AS rel, coalesce(a.size, b.size) AS size,
  CASE WHEN b.rel IS NULL THEN 'only_a' WHEN a.rel IS NULL THEN 'only_b' WHEN a."full" IS NOT NULL AND b."full" IS NOT NULL THEN CASE WHEN a.size = b.size AND a."full" = b."full" THEN 'same' ELSE 'different' END
       WHEN a.size <> b.size THEN 'different' WHEN abs(a.modified - b.modified) <= 20000000 THEN 'same' ELSE 'different' END AS status,
  CASE WHEN a.rel IS NOT NULL AND b.rel IS NOT NULL THEN CASE WHEN (a."full" IS NOT NULL AND b."full" IS NOT NULL) OR a.size <> b.size THEN 'content' ELSE 'metadata' END END AS evidence
FROM a FULL JOIN b ON upper(a.rel) = upper(b.rel)""",
)
def j11(spark, d):
    return backup.compare_paths(side(spark, d, 0), side(spark, d, 1)).drop("other")


@query(
    "j11_compare_contents",
    SIDES
    + """, j AS (SELECT a.rel AS ra, b.rel AS rb, a.size AS sa, b.size AS sb, a."full" AS fa, b."full" AS fb, abs(a.modified - b.modified) <= 20000000 AS near FROM a JOIN b ON upper(a.rel) = upper(b.rel)),
jj AS (SELECT *, CASE WHEN fa IS NOT NULL AND fb IS NOT NULL THEN sa = sb AND fa = fb WHEN sa <> sb THEN false ELSE near END AS same, CASE WHEN (fa IS NOT NULL AND fb IS NOT NULL) OR sa <> sb THEN 'content' ELSE 'metadata' END AS evidence FROM j),
s1 AS (SELECT ra, rb, evidence FROM jj WHERE same),
a1 AS (SELECT * FROM a WHERE rel NOT IN (SELECT ra FROM s1)), b1 AS (SELECT * FROM b WHERE rel NOT IN (SELECT rb FROM s1)),
m1 AS (SELECT x.rel AS ra, y.rel AS rb FROM (SELECT *, row_number() OVER (PARTITION BY size, "full" ORDER BY rel) AS n FROM a1 WHERE "full" IS NOT NULL) x JOIN (SELECT *, row_number() OVER (PARTITION BY size, "full" ORDER BY rel) AS n FROM b1 WHERE "full" IS NOT NULL) y USING (size, "full", n)),
a2 AS (SELECT * FROM a1 WHERE rel NOT IN (SELECT ra FROM m1)), b2 AS (SELECT * FROM b1 WHERE rel NOT IN (SELECT rb FROM m1)),
m2 AS (SELECT a2.rel AS ra, b2.rel AS rb FROM a2 JOIN b2 ON a2.name = b2.name AND a2.size = b2.size AND abs(a2.modified - b2.modified) <= 20000000 AND (a2."full" IS NULL OR b2."full" IS NULL)),
a3 AS (SELECT * FROM a2 WHERE rel NOT IN (SELECT ra FROM m2)), b3 AS (SELECT * FROM b2 WHERE rel NOT IN (SELECT rb FROM m2)),
d AS (SELECT jj.* FROM jj WHERE ra IN (SELECT rel FROM a3) AND rb IN (SELECT rel FROM b3))
SELECT ra AS rel, NULL AS other, size, 'same' AS status, evidence FROM s1 JOIN a ON rel = ra UNION ALL SELECT ra, rb, size, 'same', 'content' FROM m1 JOIN a ON rel = ra UNION ALL SELECT ra, rb, size, 'same', 'metadata' FROM m2 JOIN a ON rel = ra
UNION ALL SELECT ra, NULL, sa, 'different', evidence FROM d UNION ALL SELECT rel, NULL, size, 'only_a', NULL FROM a3 WHERE rel NOT IN (SELECT ra FROM d) UNION ALL SELECT rel, NULL, size, 'only_b', NULL FROM b3 WHERE rel NOT IN (SELECT rb FROM d)""",
)
def j11b(spark, d):
    return backup.compare_contents(side(spark, d, 0), side(spark, d, 1))


@query("u03_classes", SIDES + "SELECT CASE WHEN b.rel IS NULL THEN 'only_a' WHEN a.rel IS NULL THEN 'only_b' ELSE 'both' END AS class, count(*) AS n FROM a FULL JOIN b USING (rel) GROUP BY 1")
def u03(spark, d):
    x, y = side(spark, d, 0).select("rel", F.lit(1).alias("x")), side(spark, d, 1).select("rel", F.lit(1).alias("y"))
    return x.join(y, "rel", "full_outer").groupBy(F.when(c("y").isNull(), "only_a").when(c("x").isNull(), "only_b").otherwise("both").alias("class")).agg(F.count("*").alias("n"))


@query("b02_copy_preview", sql("doc", "SELECT d.volume_id, count(*) AS files, sum(d.size)::BIGINT AS bytes, sum(d.size) <= any_value(v.free_space) AS fits FROM doc d JOIN volumes v ON v.id = d.volume_id WHERE v.free_space IS NOT NULL GROUP BY 1"))
def b02(spark, d):
    free = table(spark, d, "volumes").where("free_space IS NOT NULL").select(c("id").alias("volume_id"), "free_space")
    return backup.copy_preview(fixtures.content_files(spark, d), free)


@query("c15_print_of_pixels", "SELECT doc_id, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS print FROM (SELECT doc_id, list_sum(list_transform(range(64), lambda i: CASE WHEN (doc_id * (i + i // 8 + 1) * 7919) % 256 < (doc_id * (i + i // 8 + 2) * 7919) % 256 THEN (1::HUGEINT << (63 - i)::HUGEINT) ELSE 0::HUGEINT END)) AS h FROM documents)")
def c15(spark, d):
    """Prints of 72 gray values each, derived from the ids of documents."""
    grays = F.transform(F.sequence(F.lit(1), F.lit(72)), lambda k: c("doc_id") * k * 7919 % 256)
    return table(spark, d, "documents").select("doc_id", similar.print_of_pixels(grays).alias("print"))
