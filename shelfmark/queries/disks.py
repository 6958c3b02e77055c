"""Queries over volumes, health, actions, journal records and changes to tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import names as N
from ..operators import actions as A
from ..operators import content, similar
from ..operators import health as H
from ..operators import reconcile as R
from ..operators import search as S
from ..operators import tree
from ..operators import volumes as V
from ..operators import writes as W
from ..shared import Scratch, numbered
from . import table
from .base import category_sql, ext_sql, sql, up_sql

QUERIES, SQL = {}, {}
c = F.col


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


def vols(spark, d):
    return table(spark, d, "volumes").distinct()


# ---- volumes ----------------------------------------------------------------------------------------------------

NAME = "coalesce(nullif(trim(user_name), ''), nullif(trim(os_label), ''), nullif(trim(last_mount), ''), '#' || id)"
KIND = "CASE WHEN kind = 'network' THEN 'network' WHEN kind = 'removable' THEN 'stick' WHEN lower(bus_type) IN ('usb', 'ieee1394', 'sd', 'mmc') THEN 'external' ELSE 'internal' END"
GROUP = "CASE WHEN disk_key IS NOT NULL THEN 'disk:' || disk_key WHEN unc_path IS NOT NULL THEN 'net:' || split_part(ltrim(upper(unc_path), chr(92)), chr(92), 1) ELSE 'volume:' || id END"


SECTION = "CASE WHEN kind = 'network' THEN 'network' WHEN online THEN 'online' ELSE 'offline' END"
SERVER = "split_part(ltrim(upper(unc_path), chr(92)), chr(92), 1)"


@query("proj02_display_kind", f"SELECT id, {KIND} AS shown_as FROM volumes")
def proj02(spark, d):
    return vols(spark, d).select("id", V.display_kind(c("kind"), c("bus_type")).alias("shown_as"))


@query("proj03_display_name", f"SELECT id, {NAME} AS name FROM volumes")
def proj03(spark, d):
    return vols(spark, d).select("id", V.display_name().alias("name"))


@query("proj04_cards", sql("stats", f"SELECT v.id, {NAME.replace('id)', 'v.id)')} AS name, {KIND} AS shown_as, CASE WHEN capacity > 0 AND free_space IS NOT NULL THEN (capacity - free_space) * 100 // capacity END AS used_percent, {GROUP.replace('|| id', '|| v.id')} AS group_key, status, online, coalesce(total_size, 0) AS size, coalesce(file_count, 0) AS files FROM volumes v LEFT JOIN (SELECT * FROM stats WHERE entry_id <= 5) s ON s.entry_id = v.id"))
def proj04(spark, d):
    p = tree.with_paths(fixtures.tree(spark, d))
    roots = tree.roll_up(p).join(p.where("parent_id IS NULL").select(c("id").alias("entry_id"), "volume_id"), "entry_id")
    return V.cards(vols(spark, d), roots)


@query("proj09_used_percent", "SELECT id, CASE WHEN capacity > 0 AND free_space IS NOT NULL THEN (capacity - free_space) * 100 // capacity END AS used_percent FROM volumes")
def proj09(spark, d):
    return vols(spark, d).select("id", V.used_percent().alias("used_percent"))


@query("a19_disk_groups", f"SELECT {GROUP} AS group_key, count(*) AS volumes FROM volumes GROUP BY 1")
def a19(spark, d):
    return vols(spark, d).groupBy(V.group_key().alias("group_key")).agg(F.count("*").alias("volumes"))


@query("a18_locations", "SELECT min_by(location, id) AS location, count(*) AS volumes FROM volumes WHERE trim(location) <> '' GROUP BY upper(trim(location))")
def a18(spark, d):
    return V.known_locations(vols(spark, d))


@query("a18_filter_counts", f"SELECT count(*) AS all_volumes, count(*) FILTER (s = 'online') AS online, count(*) FILTER (s = 'network') AS network, count(*) FILTER (s = 'offline') AS offline FROM (SELECT {SECTION} AS s FROM volumes WHERE status IS DISTINCT FROM 'ignored')")
def a18b(spark, d):
    return V.filter_counts(vols(spark, d))


@query("f21_visible", f"SELECT id, {SECTION} AS section FROM volumes WHERE status IS DISTINCT FROM 'ignored'")
def f21(spark, d):
    return V.visible(vols(spark, d)).select("id", V.section().alias("section"))


@query("f22_eligible", "WITH v AS (SELECT id, coalesce(online, false) AS o, coalesce(status IN ('indexed', 'reindex_needed'), false) AS auto, status = 'indexing' AS ix, kind = 'network' AS net, coalesce(upper(fs_type) = 'NTFS', false) AS ntfs FROM volumes) SELECT id, o AND auto AND NOT net AND ntfs AS by_journal, o AND (auto OR ix) AND (net OR NOT ntfs) AS by_watcher FROM v")
def f22(spark, d):
    """Which volumes update from their journal, and which by watching folders."""
    journal, watcher = V.updated_by()
    return vols(spark, d).select("id", journal.alias("by_journal"), watcher.alias("by_watcher"))


@query("c24_disk_parts", "SELECT id, split_part(disk_key, '|', 1) AS model, split_part(disk_key, '|', 2) AS serial, disk_key FROM volumes WHERE disk_key IS NOT NULL")
def c24(spark, d):
    parts = F.split("disk_key", r"\|")
    v = vols(spark, d).where("disk_key IS NOT NULL").select("id", parts[0].alias("model"), parts[1].alias("serial"))
    return v.withColumn("disk_key", F.concat_ws("|", "model", "serial"))


def detected(spark, d):
    """Volumes as connected now: some without serial or path, some resized."""
    v = vols(spark, d)
    return v.select((c("id") + 100).alias("id"), "kind", "unc_path", F.when(c("id") % 7 != 0, c("fs_serial")).alias("fs_serial"), "fs_type", F.when(c("id") % 3 != 0, c("volume_guid")).alias("volume_guid"), F.when(c("id") % 5 == 0, c("capacity") + 1).otherwise(c("capacity")).alias("capacity"))


@query("j16_candidates", "WITH d AS (SELECT id + 100 AS det, kind, unc_path, CASE WHEN id % 7 <> 0 THEN fs_serial END AS fs_serial, fs_type, CASE WHEN id % 3 <> 0 THEN volume_guid END AS volume_guid, CASE WHEN id % 5 = 0 THEN capacity + 1 ELSE capacity END AS capacity FROM volumes) SELECT det, k.id, coalesce(upper(d.volume_guid) = upper(k.volume_guid), false) AS guid, d.capacity IS NULL OR coalesce(d.capacity = k.capacity, false) AS capacity_ok FROM d JOIN volumes k ON CASE WHEN d.kind = 'network' THEN k.kind = 'network' AND upper(d.unc_path) = upper(k.unc_path) WHEN d.fs_serial IS NOT NULL THEN k.kind <> 'network' AND d.fs_serial = k.fs_serial AND upper(d.fs_type) = upper(k.fs_type) ELSE k.kind <> 'network' AND upper(d.volume_guid) = upper(k.volume_guid) END")
def j16(spark, d):
    return V.candidates(detected(spark, d), vols(spark, d)).drop("net")


@query("j16_matched")
def j16b(spark, d):
    return V.match(detected(spark, d), vols(spark, d))


@query("x10_ambiguous")
def x10b(spark, d):
    """The catalogued volumes among which the user chooses for each ambiguous one."""
    return V.ambiguous(detected(spark, d), vols(spark, d))


@query("j17_delta", "WITH a AS (SELECT id, last_mount AS m FROM volumes WHERE id % 4 <> 0), b AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'X:' ELSE last_mount END AS m FROM volumes WHERE id % 5 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'came' WHEN b.id IS NULL THEN 'left' WHEN a.m IS DISTINCT FROM b.m THEN 'moved' ELSE 'same' END AS change FROM a FULL JOIN b USING (id)")
def j17(spark, d):
    v = vols(spark, d)
    return V.delta(v.where("id % 4 <> 0").select("id", c("last_mount").alias("mount")), v.where("id % 5 <> 0").select("id", F.when(c("id") % 3 == 0, "X:").otherwise(c("last_mount")).alias("mount")))


@query("x11_changed_rows", "WITH b AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'moved' ELSE status END AS status FROM volumes WHERE id % 5 <> 0), a AS (SELECT id, status FROM volumes WHERE id % 4 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.status IS DISTINCT FROM b.status THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b USING (id)")
def x11(spark, d):
    v = vols(spark, d)
    return V.changed_rows(v.where("id % 4 <> 0").select("id", "status"), v.where("id % 5 <> 0").select("id", F.when(c("id") % 3 == 0, "moved").otherwise(c("status")).alias("status")))


@query("s20_unmapped_shares", "SELECT id FROM volumes WHERE unc_path IS NOT NULL AND NOT online")
def s20(spark, d):
    v = vols(spark, d)
    return V.unmapped_shares(v, v.where("online AND unc_path IS NOT NULL").select(F.lower("unc_path").alias("unc_path"))).select("id")


@query("s20_moved_shares", "SELECT id + 100 AS det, id FROM volumes WHERE unc_path IS NOT NULL")
def s20b(spark, d):
    v = vols(spark, d).where("unc_path IS NOT NULL")
    now = v.select((c("id") + 100).alias("id"), F.regexp_replace("unc_path", r"box-\d+", "nas").alias("unc_path"))
    return V.moved_shares(now, v)


@query("j24_share_check", f"WITH e AS (SELECT DISTINCT volume_id, {up_sql('name')} AS n FROM entries WHERE parent_id IN (SELECT id FROM entries WHERE parent_id IS NULL)) SELECT volume_id, count(*) AS known, count(*) FILTER (strlen(n) % 2 = 0) AS found FROM e GROUP BY 1")
def j24(spark, d):
    e = table(spark, d, "entries")
    top = e.join(e.where("parent_id IS NULL").select(c("id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("volume_id", "name")
    return V.share_check(top, top.where(F.octet_length(N.fold(c("name"))) % 2 == 0).select("volume_id", N.fold(c("name")).alias("name")))


@query("x13_readers", f"SELECT id, CASE WHEN kind = 'network' THEN 4 ELSE 1 END::BIGINT AS readers, CASE WHEN kind = 'network' THEN 'net:' || coalesce({SERVER}, '') ELSE 'disk:' || disk_key END AS resource FROM volumes")
def x13(spark, d):
    """How many files are read at once on a volume, and what a job there keeps busy."""
    return vols(spark, d).select("id", V.readers().alias("readers"), V.resource().alias("resource"))


@query("x14_waiting", "SELECT id, CASE WHEN status = 'indexing' OR id % 6 = 0 THEN NULL WHEN status = 'ignored' OR id % 7 = 0 THEN 'excluded' WHEN id % 5 = 0 THEN 'busy' WHEN id % 4 >= id % 6 THEN 'skipped' ELSE 'next' END AS why FROM volumes")
def x14(spark, d):
    """Why the analysis of each volume waits; numbers derived from the ids stand for files left and skipped."""
    v = vols(spark, d).select("id", (c("status") == "indexing").alias("running"), ((c("status") == "ignored") | (c("id") % 7 == 0)).alias("excluded"), (c("id") % 5 == 0).alias("busy"), (c("id") % 6).alias("left"), (c("id") % 4).alias("skipped"))
    return v.select("id", content.waiting(False).alias("why"))


@query("c27_rescan_gap", "SELECT id, least(greatest(10 * (capacity // 1000000000), 1800000), 21600000) AS gap_ms FROM volumes")
def c27(spark, d):
    """Time to the next full reading: ten times the last one's, between 30 minutes and 6 hours (a millisecond for each GB here)."""
    return vols(spark, d).select("id", F.least(F.greatest(F.floor(c("capacity") / 1_000_000_000) * 10, F.lit(1_800_000)), F.lit(21_600_000)).alias("gap_ms"))


# ---- exclusion, cleanup -----------------------------------------------------------------------------------------

from ..operators import cleanup as C  # noqa: E402


def paths(spark, d):
    return tree.with_paths(fixtures.tree(spark, d))


@query("f11_excluded", sql("path", "SELECT id FROM path WHERE list_has_any(string_split(upper(path), chr(92)), ['NATION_12', 'NATION_6']) OR upper(path) = 'NATION_7' OR starts_with(upper(path), 'NATION_7' || chr(92))"))
def f11(spark, d):
    return C.excluded(paths(spark, d), ["Nation_12", "nation_6"], ["Nation_7"]).select("id")


@query("f12_protected", sql("path", r"SELECT id FROM path WHERE regexp_matches(upper(path), '^(NATION_5(\\|$)|NATION_3\\[^\\]+\\[^\\]+(\\|$)|[^\\]+\\CUSTOMER#000000007(\\|$))')"))
def f12(spark, d):
    """At or below a folder, what lies two below another, and one name in any folder."""
    p = paths(spark, d)
    return p.where(C.protected(c("path"), ["nation_5", "Nation_3\\*\\*", "*/customer#000000007"])).select("id")


@query("f13_program_folders", sql("path", "SELECT DISTINCT p.id FROM path p, (SELECT DISTINCT parent_id FROM tree WHERE name LIKE '%7.zip') x WHERE list_contains(p.chain, x.parent_id) AND x.parent_id > 5"))
def f13(spark, d):
    """Entries inside folders that directly hold a file of a certain ending (libraries in practice)."""
    return C.inside_holders(paths(spark, d), "%7.zip").select("id")


#: Both browsers keep their profiles (the nations) directly on each volume.
BROWSERS = [("", "chromium"), ("", "firefox")]


def with_browsers(p):
    """The derived folders under the names of browsers' caches, by their last digit: those of a nation as caches in a profile, nations as caches beside the profiles."""
    last = F.right("name", F.lit(1))
    inner = F.when(last == "7", "Cache").when(last == "9", "Code Cache").when(last == "5", "GPUCache").when(last == "3", "cache2")
    direct = F.when(last == "0", "ShaderCache").when(last == "1", "GrShaderCache").when(last == "2", "GraphiteDawnCache")
    return p.withColumn("name", F.coalesce(F.when(c("is_dir") & (c("depth") == 2), inner).when(c("is_dir") & (c("depth") == 1), direct), "name"))


CACHES = """SELECT t.id, p.path, s.total_size AS size, t.volume_id, CASE WHEN p.depth = 1 OR right(t.name, 1) IN ('7', '9', '5') THEN 'chromium' ELSE 'firefox' END AS owner FROM tree t JOIN path p USING (id) JOIN stats s ON s.entry_id = t.id
  WHERE t.is_dir AND s.total_size > 0 AND ((p.depth = 1 AND right(t.name, 1) IN ('0', '1', '2')) OR (p.depth = 2 AND right(t.name, 1) IN ('7', '9', '5', '3')))"""
CLEANUP = """, o AS (SELECT t.*, p.path FROM tree t JOIN path p USING (id)), cc AS (CACHES),
z AS (SELECT 'temp' AS category, NULL::VARCHAR AS owner, id, path, size, volume_id FROM o WHERE NOT is_dir AND starts_with(upper(path), 'NATION_5' || chr(92)) AND modified_ms < epoch_ms(TIMESTAMP '1997-01-01')
UNION ALL SELECT 'empty_folders', NULL, o.id, o.path, s.total_size, o.volume_id FROM o JOIN stats s ON s.entry_id = o.id JOIN tree q ON q.id = o.parent_id LEFT JOIN stats qs ON qs.entry_id = q.id WHERE s.file_count = 0 AND (q.parent_id IS NULL OR qs.file_count > 0) AND NOT (KEEP)
UNION ALL SELECT 'large_old', NULL, id, path, size, volume_id FROM o WHERE NOT is_dir AND size >= 30000000 AND modified_ms < epoch_ms(TIMESTAMP '1996-01-01') AND NOT (KEEP) AND NOT starts_with(upper(path), 'NATION_5' || chr(92))
UNION ALL SELECT 'browser_caches', owner, id, path, size, volume_id FROM cc) """.replace("CACHES", CACHES)
KEEP_10 = CLEANUP.replace("KEEP", "starts_with(upper(o.path), 'NATION_10' || chr(92))")


def proposals(spark, d, keep: list[str]):
    t = with_browsers(paths(spark, d))
    return C.scan(t, tree.roll_up(t), temp=["Nation_5"], temp_before=852_076_800_000, large=30_000_000, large_before=820_454_400_000, keep=keep, browsers=BROWSERS)


@query("g01_cleanup", sql("stats", KEEP_10 + "SELECT category, id, path, size FROM z"))
def g01(spark, d):
    return proposals(spark, d, ["nation_10"]).select("category", "id", "path", "size")


@query("a10_cleanup_totals", sql("stats", CLEANUP.replace("KEEP", "false") + "SELECT category, count(*) AS items, sum(size)::BIGINT AS bytes FROM z GROUP BY 1"))
def a10(spark, d):
    return C.totals(proposals(spark, d, []))


@query("g02_default_selection", sql("stats", CLEANUP.replace("KEEP", "false") + "SELECT category, owner, count(*) AS chosen, sum(size)::BIGINT AS bytes FROM z WHERE category <> 'large_old' AND owner IS DISTINCT FROM 'firefox' GROUP BY ALL"))
def g02(spark, d):
    """What is selected at first while one of the browsers runs."""
    return C.default_selection(proposals(spark, d, []), ["firefox"]).groupBy("category", "owner").agg(F.count("*").alias("chosen"), F.sum("size").alias("bytes"))


@query("o10_group_order", sql("stats", CLEANUP.replace("KEEP", "false") + "SELECT category, owner, items, bytes, blocked, row_number() OVER (ORDER BY blocked, bytes DESC) AS pos FROM (SELECT category, owner, count(*) AS items, sum(size)::BIGINT AS bytes, coalesce(owner = 'firefox', false) AS blocked FROM z GROUP BY ALL)"))
def o10_groups(spark, d):
    return C.groups(proposals(spark, d, []), ["firefox"])


@query("o08_large_old", sql("ent", "SELECT id, size FROM ent WHERE NOT is_dir AND size >= 1000000 AND modified_at < 132000000000000000 ORDER BY size DESC, id"))
def o08(spark, d):
    e = table(spark, d, "entries").dropDuplicates(["id"])
    return C.large_old(e, "modified_at", 1_000_000, 132_000_000_000_000_000).select("id", "size")


@query("j25_browser_caches", sql("stats", ", cc AS (" + CACHES + ") SELECT id, path FROM cc"))
def j25(spark, d):
    """Cache folders of both layouts on all volumes, in the browser's folder and in each profile."""
    t = with_browsers(paths(spark, d))
    totals = tree.roll_up(t)
    found = [C.browser_caches(t, totals, folder, layout).select("id", "path") for folder, layout in BROWSERS]
    return found[0].unionByName(found[1])


# ---- health -----------------------------------------------------------------------------------------------------


@query("w02_worsening", sql("rdg", """, x AS (SELECT *, lag(status) OVER k AS s0, lag(reallocated) OVER k AS r0, row_number() OVER k AS n FROM rdg WINDOW k AS (PARTITION BY disk_key ORDER BY at_ms, reading_no)),
y AS (SELECT disk_key, reading_no, CASE WHEN n = 1 THEN CASE WHEN status = 'critical' THEN 'status' END WHEN list_position(['good', 'warning', 'critical'], status) > list_position(['good', 'warning', 'critical'], s0) THEN 'status' WHEN reallocated > r0 THEN 'reallocated' END AS reason FROM x) SELECT * FROM y WHERE reason IS NOT NULL"""))
def w02(spark, d):
    return H.worsening(fixtures.readings(spark, d)).select("disk_key", "reading_no", "reason")


@query("w03_thinned")
def w03(spark, d):
    r = fixtures.readings(spark, d).withColumn("reallocated", F.floor(c("reallocated") / 400).cast("long"))
    return H.thinned(r).select("disk_key", "reading_no", "at_ms", "status")


@query("w04_latest", sql("rdg", "SELECT disk_key, reading_no, row_number() OVER (PARTITION BY disk_key ORDER BY at_ms DESC, reading_no DESC) AS pos FROM rdg QUALIFY pos <= 30"))
def w04(spark, d):
    return H.latest(fixtures.readings(spark, d), 30).select("disk_key", "reading_no", "pos")


@query("x07_health_view", sql("rdg", ", l AS (SELECT * FROM rdg QUALIFY row_number() OVER (PARTITION BY disk_key ORDER BY at_ms DESC, reading_no DESC) <= 30) SELECT disk_key, count(*) AS points, max_by(status, (at_ms, reading_no)) AS status, max(reallocated) AS most, CASE WHEN any_value(k) % 3 <> 0 THEN CASE any_value(k) % 2 WHEN 0 THEN 'ssd' ELSE 'hdd' END END AS medium FROM (SELECT *, split_part(disk_key, '-', 2)::BIGINT AS k FROM l) GROUP BY 1"))
def x07(spark, d):
    r = fixtures.readings(spark, d)
    k = F.split("disk_key", "-")[1].cast("long")
    media = r.select("disk_key").distinct().where(k % 3 != 0).select("disk_key", F.when(k % 2 == 0, "ssd").otherwise("hdd").alias("medium"))
    return H.health_view(r, media)


@query("a16_worst_status", sql("rdg", "SELECT disk_key, ['good', 'warning', 'critical'][max(list_position(['good', 'warning', 'critical'], status))] AS worst, string_agg(DISTINCT status, ',' ORDER BY status) AS seen FROM rdg GROUP BY 1"))
def a16(spark, d):
    r = fixtures.readings(spark, d)
    g = r.groupBy("disk_key").agg(F.max(H.severity(c("status"))).alias("w"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("seen"))
    return g.select("disk_key", F.element_at(F.array(*map(F.lit, H.SEVERITY)), c("w").cast("int")).alias("worst"), "seen")


def page(spark, d):
    """Events as pages of an NVMe log: warning bits, temperature, spare, wear and errors at their offsets."""
    e = table(spark, d, "events").select("event_id", "user_id")
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    n = c("event_id")
    head = F.concat(byte(n % 8), byte((n % 120 + 273) % 256), byte(F.floor((n % 120 + 273) / 256)), byte(n % 100), byte(F.lit(10)), byte(n % 105))
    hexed = F.concat(head, F.repeat(F.lit("00"), F.lit(122)), byte(n % 256), byte(F.floor(n / 256) % 256), F.repeat(F.lit("00"), F.lit(30)), byte(n % 3), F.repeat(F.lit("00"), F.lit(31)))
    return e.select("event_id", F.unhex(hexed).alias("page"))


@query("c19_nvme", """WITH e AS (SELECT event_id AS n FROM events), r AS (SELECT n, n % 8 AS w, n % 120 AS deg, n % 100 AS spare, n % 105 AS used, n % 3 AS errors, n % 65536 AS hours FROM e)
SELECT n AS event_id, CASE WHEN (w & 29) <> 0 OR spare < 10 OR used >= 100 THEN 'critical' WHEN (w & 2) <> 0 OR used >= 90 OR errors > 0 OR deg >= 65 THEN 'warning' ELSE 'good' END AS status, deg AS temperature, hours, used AS wear, errors AS media_errors, spare,
  array_to_string(list_filter([CASE WHEN (w & 29) <> 0 OR spare < 10 THEN 'nvme_critical_warning' END, CASE WHEN (w & 2) <> 0 THEN 'temperature' END, CASE WHEN used >= 100 THEN 'worn_out' END, CASE WHEN used BETWEEN 90 AND 99 THEN 'wear_high' END, CASE WHEN errors > 0 THEN 'media_errors' END, CASE WHEN deg >= 65 AND (w & 2) = 0 THEN 'temperature' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def c19(spark, d):
    r = H.nvme_reading(c("page"))
    return page(spark, d).select("event_id", r.alias("r")).select("event_id", "r.status", "r.temperature", "r.hours", "r.wear", "r.media_errors", "r.spare", F.array_join("r.reasons", ",").alias("reasons"))


def nas(spark, d):
    """Suppliers as the answers of network storages: one array of three disks each, some missing or ill."""
    s = table(spark, d, "supplier").select("s_suppkey")
    k = c("s_suppkey").cast("string")
    disks = F.array(*[F.concat(F.lit(f"D{i}-"), k) for i in range(3)])
    raid = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("pool"), k).alias("name"), F.when(c("s_suppkey") % 9 == 0, "degraded").otherwise("OK").alias("status"), F.when(c("s_suppkey") % 7 == 0, "resync").otherwise("idle").alias("activity"), disks.alias("disks"))).alias("data")))
    one = lambda i: F.struct(F.concat(F.lit(f"D{i}-"), k).alias("serial"), (c("s_suppkey") % (i + 4) != 0).alias("healthy"), F.lit(False).alias("faulty"))
    listed = F.filter(F.array(one(0), one(1), one(2)), lambda x: ~((c("s_suppkey") % 11 == 0) & x["serial"].startswith("D2")))
    return s.select(c("s_suppkey").alias("server"), raid.alias("raid_json"), F.to_json(F.struct(listed.alias("data"))).alias("disk_json"))


NAS = "WITH d AS (SELECT s_suppkey AS server, 'pool' || s_suppkey AS storage, i, 'D' || i || '-' || s_suppkey AS serial, s_suppkey % 9 = 0 AS degraded, s_suppkey % 7 = 0 AS resync, i = 2 AND s_suppkey % 11 = 0 AS missing, s_suppkey % (i + 4) <> 0 OR (i = 2 AND s_suppkey % 11 = 0) AS healthy FROM supplier, range(3) r(i)) "


@query("s10_nas_disks", NAS + "SELECT server, storage, serial, healthy, missing FROM d")
def s10(spark, d):
    return H.nas_disks(nas(spark, d)).select("server", "storage", "serial", "healthy", "missing")


@query("a15_nas_states", NAS + "SELECT server, storage, CASE WHEN bool_or(degraded OR missing) THEN 'problem' WHEN bool_or(NOT healthy OR resync) THEN 'attention' ELSE 'ok' END AS state FROM d GROUP BY ALL")
def a15(spark, d):
    return H.nas_states(H.nas_disks(nas(spark, d)))


@query("u05_nas_news", NAS + ", p AS (SELECT DISTINCT server, 'raid|' || storage || '|degraded' AS problem FROM d WHERE degraded UNION SELECT server, 'disk|' || serial || '|' || CASE WHEN missing THEN 'missing' ELSE 'unhealthy' END FROM d WHERE missing OR NOT healthy) SELECT * FROM p WHERE server % 2 = 1")
def u05(spark, d):
    now = H.nas_problems(H.nas_disks(nas(spark, d)))
    return H.news(now.where("server % 2 = 0"), now)


@query("x08_nas_shares", NAS + ", st AS (SELECT server, storage, count(*) AS n_disks, count(*) FILTER (missing OR NOT healthy) AS n_bad FROM d GROUP BY ALL) SELECT s_suppkey AS server, share, st.storage, n_disks, n_bad FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'POOL' || s_suppkey WHEN 1 THEN 'ZimaOS-HD' ELSE 'other' END AS share FROM supplier) LEFT JOIN st ON st.server = s_suppkey AND (upper(share) = upper(storage) OR (upper(share) = 'ZIMAOS-HD' AND s_suppkey % 2 = 0))")
def x08(spark, d):
    """The storage behind each share, and its disks; every other server's own storage is mounted as the system's."""
    k = c("s_suppkey")
    disks = H.nas_disks(nas(spark, d))
    shares = table(spark, d, "supplier").select(k.alias("server"), F.when(k % 3 == 0, F.concat(F.lit("POOL"), k.cast("string"))).when(k % 3 == 1, "ZimaOS-HD").otherwise("other").alias("share"))
    storages = disks.select("server", "storage").distinct().withColumn("mount", F.when(c("server") % 2 == 0, "/DATA").otherwise("/media"))
    return H.share_storages(shares, storages, disks)


@query("x08_nas_servers", f"SELECT {SERVER} AS server, count(*) AS shares FROM volumes WHERE kind = 'network' AND unc_path IS NOT NULL AND status IS DISTINCT FROM 'ignored' GROUP BY 1")
def x08b(spark, d):
    return V.dimensions(vols(spark, d)).where("what = 'server_shares'").select(c("key").alias("server"), c("value").cast("long").alias("shares"))


# ---- actions ----------------------------------------------------------------------------------------------------


@query("o07_newest_actions", sql("act", "SELECT id, action FROM act ORDER BY at_ms DESC, id DESC LIMIT 1000"))
def o07(spark, d):
    return A.newest(fixtures.actions(spark, d)).select("id", "action")


@query("w05_batches", sql("act", """, x AS (SELECT *, CASE WHEN lag(action) OVER k = action AND lag(volume_id) OVER k = volume_id AND at_ms - lag(at_ms) OVER k <= 60000 THEN 0 ELSE 1 END AS s FROM act WINDOW k AS (ORDER BY at_ms, id)),
y AS (SELECT *, sum(s) OVER (ORDER BY at_ms, id) AS b FROM x) SELECT max(at_ms) AS at_ms, any_value(action) AS action, any_value(volume_id) AS volume_id, count(*) FILTER (outcome = 'done') AS done, coalesce(sum(size) FILTER (outcome = 'done'), 0)::BIGINT AS bytes, count(*) FILTER (outcome NOT IN ('done', 'failed')) AS skipped, count(*) FILTER (outcome = 'failed') AS failed FROM y GROUP BY b"""))
def w05(spark, d):
    return A.batches(fixtures.actions(spark, d))


@query("a10_outcomes", sql("act", "SELECT action, outcome, count(*) AS n, sum(size)::BIGINT AS bytes FROM act GROUP BY ALL"))
def a10b(spark, d):
    return A.outcomes(fixtures.actions(spark, d))


@query("a12_most_frequent", "SELECT props, count(*) AS n FROM events WHERE event_type = 'error' AND props IS NOT NULL GROUP BY 1 ORDER BY n DESC, props LIMIT 5")
def a12(spark, d):
    return A.most_frequent(table(spark, d, "events").where("event_type = 'error'"), "props")


@query("w08_failure_streaks", sql("act", ", x AS (SELECT *, count(*) FILTER (outcome <> 'failed') OVER (PARTITION BY volume_id ORDER BY at_ms, id ROWS UNBOUNDED PRECEDING) AS g FROM act) SELECT volume_id, min(at_ms) AS since, max(at_ms) AS until, count(*) AS failures FROM x WHERE outcome = 'failed' GROUP BY volume_id, g"))
def w08(spark, d):
    return A.failure_streaks(fixtures.actions(spark, d))


@query("w09_remaining", sql("act", ", s AS (SELECT volume_id AS job, action AS phase, at_ms, id AS done FROM act), g AS (SELECT job, phase, min_by(at_ms, (at_ms, done)) AS t0, min_by(done, (at_ms, done)) AS d0, max_by(at_ms, (at_ms, done)) AS t1, max_by(done, (at_ms, done)) AS d1 FROM s GROUP BY ALL) SELECT job, phase, CASE WHEN t1 - t0 >= 15000 AND d1 > d0 THEN floor((1000000 - d1) * (t1 - t0) / (d1 - d0))::BIGINT END AS eta_ms FROM g"))
def w09(spark, d):
    return A.remaining(fixtures.actions(spark, d).select(c("volume_id").alias("job"), c("action").alias("phase"), "at_ms", c("id").alias("done"), F.lit(1_000_000).cast("long").alias("total")))


# ---- journal records and changes to tables ------------------------------------------------------------------------


@query("a14_grouped_changes", "WITH r AS (SELECT DISTINCT volume_id, file_ref, parent_ref, journal_id, usn, reason FROM changes WHERE file_ref IS NOT NULL), p AS (SELECT volume_id, file_ref, parent_ref, min((journal_id, usn)) AS f FROM r WHERE parent_ref IS NOT NULL GROUP BY ALL), q AS (SELECT volume_id, file_ref, string_agg(parent_ref || '', ',' ORDER BY f) AS parents FROM p GROUP BY ALL) SELECT r.volume_id, r.file_ref, bool_or((reason & 256) <> 0) AS created, count(*) AS records, coalesce(any_value(parents), '') AS parents FROM r LEFT JOIN q USING (volume_id, file_ref) GROUP BY ALL")
def a14(spark, d):
    r = table(spark, d, "changes").select("volume_id", "file_ref", "parent_ref", "journal_id", "usn", "reason").distinct()
    return R.grouped_changes(r).withColumn("parents", F.array_join("parents", ","))


@query("r03_affected_folders", "WITH e AS (SELECT DISTINCT id, volume_id, parent_id, file_ref FROM entries WHERE file_ref IS NOT NULL) SELECT volume_id, parent_ref AS folder_ref FROM changes WHERE parent_ref IS NOT NULL UNION SELECT c.volume_id, p.file_ref FROM changes c JOIN e ON e.volume_id = c.volume_id AND e.file_ref = c.file_ref JOIN e p ON p.id = e.parent_id")
def r03(spark, d):
    return R.affected_folders(table(spark, d, "changes"), table(spark, d, "entries").dropDuplicates(["id"]))


@query("r05_claimed_twice", "WITH s AS (SELECT DISTINCT volume_id, snap_no, delivery_no, parent_ref, name, file_ref FROM snapshots WHERE file_ref IS NOT NULL QUALIFY delivery_no = max(delivery_no) OVER (PARTITION BY volume_id, snap_no)) SELECT volume_id, snap_no, parent_ref, name, count(*) AS n FROM s WHERE parent_ref IS NOT NULL AND name IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def r05(spark, d):
    """Names that two files of one folder claim in the last delivery of any snapshot."""
    s = table(spark, d, "snapshots").where("file_ref IS NOT NULL").select("volume_id", "snap_no", "delivery_no", "parent_ref", "name", "file_ref").distinct()
    last = s.groupBy("volume_id", "snap_no").agg(F.max("delivery_no").alias("delivery_no"))
    return R.claimed_twice(s.join(last, ["volume_id", "snap_no", "delivery_no"]), ["volume_id", "snap_no"])


def snapshot(spark, d, first: bool):
    """The first or last snapshot of every volume, by its last delivery."""
    pick = F.min if first else F.max
    s = table(spark, d, "snapshots").where("file_ref IS NOT NULL")
    top = s.groupBy("volume_id").agg(pick(F.struct("snap_no", F.when(F.lit(first), -c("delivery_no")).otherwise(c("delivery_no")).alias("dn"))).alias("t"))
    cond = (c("snap_no") == c("t.snap_no")) & (F.abs(c("t.dn")) == c("delivery_no"))
    return s.join(top, "volume_id").where(cond).select("volume_id", "parent_ref", "name", "is_dir", "file_ref", "size", c("modified_at").alias("modified")).distinct()


def as_tree(spark, rows, what: str, up: str):
    """Rows as a tree below one root for each volume, which also holds what has no folder there; numbers stand for references."""
    n = Scratch(spark, what).save(numbered(rows, [c("volume_id"), c("file_ref")], what))
    folders = n.where("is_dir").select("volume_id", c("file_ref").alias("parent_ref"), c(what).alias("_up"))
    roots = rows.select("volume_id").distinct().select("volume_id", (-c("volume_id")).alias(what))
    inner = n.join(folders, ["volume_id", "parent_ref"], "left").withColumn(up, F.coalesce("_up", -c("volume_id"))).drop("_up", "parent_ref")
    zero = F.lit(0).cast("long")
    no = F.lit(None).cast("long")
    return inner.unionByName(roots.select("volume_id", F.lit("").alias("name"), F.lit(True).alias("is_dir"), no.alias("file_ref"), zero.alias("size"), zero.alias("modified"), what, no.alias(up)))


def reconciled(spark, d):
    """The first snapshots as a catalog, the last ones as a listing in which some references are unknown, some folders renamed and some not wholly readable."""
    old = as_tree(spark, snapshot(spark, d, True), "id", "parent_id")
    now = as_tree(spark, snapshot(spark, d, False), "node", "parent_node")
    bad = F.coalesce(c("is_dir") & (c("file_ref") % 7 == 0), F.lit(False))
    now = now.withColumns({"state": F.when(bad, "incomplete").otherwise("complete"), "name": F.when(c("is_dir") & (c("file_ref") % 11 == 0), F.concat("name", F.lit(" new"))).otherwise(c("name"))})
    unread = now.where("state = 'incomplete'").select(c("node").alias("parent_node"), F.lit(True).alias("_bad"))
    seen = now.join(unread, "parent_node", "left").where(c("_bad").isNull() | c("is_dir") | (c("file_ref") % 3 != 0)).drop("_bad")
    seen = Scratch(spark, "listing").save(seen.withColumn("ref", c("file_ref")).withColumn("file_ref", F.when(c("file_ref") % 5 != 0, c("file_ref"))))
    return Scratch(spark, "catalog").save(old), seen


RECONCILED = """WITH RECURSIVE m AS (SELECT volume_id, min(snap_no) AS a, max(snap_no) AS b FROM snapshots WHERE file_ref IS NOT NULL GROUP BY 1), k AS (SELECT volume_id, snap_no, max(delivery_no) AS dn FROM snapshots WHERE file_ref IS NOT NULL GROUP BY ALL),
s AS (SELECT DISTINCT volume_id, snap_no, parent_ref, name, is_dir, file_ref, size, modified_at FROM snapshots SEMI JOIN (SELECT volume_id, snap_no, dn AS delivery_no FROM k) USING (volume_id, snap_no, delivery_no) WHERE file_ref IS NOT NULL),
x AS (SELECT s.* FROM s JOIN m ON m.volume_id = s.volume_id AND snap_no = a), y AS (SELECT s.* FROM s JOIN m ON m.volume_id = s.volume_id AND snap_no = b),
o AS (SELECT x.volume_id, x.file_ref || '' AS id, coalesce(p.file_ref || '', 'root') AS up, x.name, x.is_dir, x.file_ref, x.size, x.modified_at FROM x LEFT JOIN x p ON p.volume_id = x.volume_id AND p.file_ref = x.parent_ref AND p.is_dir),
w AS (SELECT y.volume_id, y.file_ref || '' AS node, coalesce(p.file_ref || '', 'root') AS up, CASE WHEN y.is_dir AND y.file_ref % 11 = 0 THEN y.name || ' new' ELSE y.name END AS name, y.is_dir, y.file_ref AS ref, CASE WHEN y.file_ref % 5 <> 0 THEN y.file_ref END AS file_ref, y.size, y.modified_at, y.is_dir AND y.file_ref % 7 = 0 AS bad
  FROM y LEFT JOIN y p ON p.volume_id = y.volume_id AND p.file_ref = y.parent_ref AND p.is_dir WHERE y.is_dir OR NOT coalesce(p.file_ref % 7 = 0, false) OR y.file_ref % 3 <> 0),
r AS (SELECT o.volume_id, o.id, w.node FROM o JOIN w ON o.volume_id = w.volume_id AND o.file_ref = w.file_ref AND o.is_dir = w.is_dir),
oo AS (SELECT * FROM o ANTI JOIN r USING (volume_id, id)), ww AS (SELECT * FROM w ANTI JOIN r USING (volume_id, node)),
g AS (SELECT volume_id, id, node FROM r UNION ALL SELECT DISTINCT volume_id, 'root', 'root' FROM x UNION ALL
  SELECT g.volume_id, oo.id, ww.node FROM g JOIN oo ON oo.volume_id = g.volume_id AND oo.up = g.id JOIN ww ON ww.volume_id = g.volume_id AND ww.up = g.node AND ww.name = oo.name AND ww.is_dir = oo.is_dir AND ww.file_ref IS NULL),
z AS (
  SELECT CASE WHEN g.id IS NULL THEN 'insert' WHEN coalesce(q.id, '') <> o.up OR w.name <> o.name THEN 'move' WHEN w.size IS DISTINCT FROM o.size OR w.modified_at IS DISTINCT FROM o.modified_at THEN 'update' ELSE 'unchanged' END AS op, w.volume_id, o.file_ref AS old_ref, w.ref AS new_ref
  FROM w LEFT JOIN g ON g.volume_id = w.volume_id AND g.node = w.node LEFT JOIN o ON o.volume_id = w.volume_id AND o.id = g.id LEFT JOIN g q ON q.volume_id = w.volume_id AND q.node = w.up
  UNION ALL SELECT 'delete', o.volume_id, o.file_ref, NULL FROM o ANTI JOIN g USING (volume_id, id) JOIN g q ON q.volume_id = o.volume_id AND q.id = o.up LEFT JOIN w f ON f.volume_id = o.volume_id AND f.node = q.node
  WHERE NOT coalesce(f.bad, false) OR EXISTS (SELECT 1 FROM w t WHERE t.volume_id = o.volume_id AND t.up = q.node AND t.name = o.name)) """


@query("r01_reconcile", RECONCILED + "SELECT * FROM z")
def r01(spark, d):
    """The last snapshot of every volume against its first, row by row."""
    old, now = reconciled(spark, d)
    ops = R.reconcile(old, now)
    refs = old.select("id", c("file_ref").alias("old_ref")).where("id > 0")
    out = ops.where("parent_id IS NOT NULL OR parent_node IS NOT NULL").join(refs, "id", "left").join(now.select("node", c("ref").alias("new_ref")), "node", "left")
    return out.select("op", "volume_id", "old_ref", "new_ref")


@query("r01_reconcile_counts", RECONCILED + "SELECT op, count(*) AS n FROM z GROUP BY 1")
def r01_counts(spark, d):
    """How many entries each operation concerns."""
    ops = R.reconcile(*reconciled(spark, d))
    return ops.where("parent_id IS NOT NULL OR parent_node IS NOT NULL").groupBy("op").agg(F.count("*").alias("n"))


@query("r01_applied", RECONCILED + """, lo AS (SELECT * FROM o ANTI JOIN g USING (volume_id, id)), dd AS (SELECT volume_id, old_ref || '' AS id FROM z WHERE op = 'delete' UNION ALL SELECT lo.volume_id, lo.id FROM dd JOIN lo ON lo.volume_id = dd.volume_id AND lo.up = dd.id)
SELECT volume_id, count(*) AS entries, (sum(size) FILTER (NOT is_dir))::BIGINT AS bytes FROM (SELECT volume_id, is_dir, size FROM w UNION ALL SELECT lo.volume_id, lo.is_dir, lo.size FROM lo ANTI JOIN dd USING (volume_id, id)) GROUP BY 1""")
def r01_applied(spark, d):
    """The catalog after the operations: entries and bytes of every volume."""
    old, now = reconciled(spark, d)
    after = R.apply_reconciled(old, now, R.reconcile(old, now)).where("parent_id IS NOT NULL")
    return after.groupBy("volume_id").agg(F.count("*").alias("entries"), F.sum(F.when(~c("is_dir"), c("size"))).alias("bytes"))


@query("j22_refs", "SELECT DISTINCT e.id, c.volume_id, c.file_ref FROM (SELECT DISTINCT volume_id, file_ref FROM changes) c JOIN (SELECT DISTINCT id, volume_id, file_ref FROM entries) e ON e.volume_id = c.volume_id AND e.file_ref = c.file_ref")
def j22(spark, d):
    return table(spark, d, "changes").select("volume_id", "file_ref").distinct().join(table(spark, d, "entries").select("id", "volume_id", "file_ref").distinct(), ["volume_id", "file_ref"])


@query("j23_folders_to_refresh", sql("path", ", w AS (SELECT t.volume_id, lower(p.path) || chr(92) || 'new.txt' AS path FROM path p JOIN tree t USING (id) WHERE t.is_dir AND p.depth = 2 AND p.id % 3 = 0 UNION SELECT t.volume_id, p.path FROM path p JOIN tree t USING (id) WHERE t.is_dir AND p.depth = 1), x AS (SELECT t.volume_id, t.id, t.parent_id, p.depth FROM tree t JOIN path p USING (id) WHERE t.is_dir) SELECT volume_id, id FROM x WHERE depth = 2 AND id % 3 = 0 UNION SELECT volume_id, id FROM x WHERE depth = 1 UNION SELECT volume_id, parent_id FROM x WHERE depth = 1"))
def j23(spark, d):
    p = paths(spark, d)
    new = p.where("is_dir AND depth = 2 AND id % 3 = 0").select("volume_id", F.concat(F.lower("path"), F.lit("\\new.txt")).alias("path"))
    return R.folders_to_refresh(p, new.union(p.where("is_dir AND depth = 1").select("volume_id", "path")))


@query("k03_apply_ops", sql("tree", "SELECT id, parent_id, CASE WHEN id % 3 = 0 AND id % 7 <> 0 THEN 'new name' ELSE name END AS name, CASE WHEN id % 5 = 0 AND id % 7 <> 0 THEN 77 ELSE size END AS size FROM tree WHERE id >= 10000000 AND id % 7 <> 0 UNION ALL SELECT id + 500000000, parent_id, 'born', size FROM tree WHERE id >= 10000000 AND id % 11 = 0"))
def k03(spark, d):
    """Renames, size changes, deletions and insertions over the files of the derived tree, given as one log."""
    t = fixtures.tree(spark, d).where("id >= 10000000").select("id", "parent_id", "name", "size")
    op = lambda df, seq, what, **v: df.select(F.lit(seq).cast("long").alias("seq"), F.lit(what).alias("op"), v.get("id", c("id")).alias("id"), *[v.get(n, F.lit(None)).cast(k).alias(n) for n, k in (("parent_id", "long"), ("name", "string"), ("size", "long"))])
    log = op(t.where("id % 3 = 0"), 1, "update", name=F.lit("new name")).unionByName(op(t.where("id % 5 = 0"), 2, "update", size=F.lit(77))).unionByName(op(t.where("id % 7 = 0"), 3, "delete"))
    log = log.unionByName(op(t.where("id % 11 = 0"), 4, "insert", id=c("id") + 500_000_000, parent_id=c("parent_id"), name=F.lit("born"), size=c("size")))
    return W.apply_ops(t, log, ["parent_id", "name", "size"])


@query("k04_upsert_guarded", "WITH o AS (SELECT DISTINCT entry_id, size, dhash FROM image_prints), n AS (SELECT DISTINCT entry_id, size + 1 AS size, dhash FROM image_prints WHERE entry_id % 2 = 0 AND entry_id IN (SELECT id FROM entries WHERE volume_id < 8)) SELECT * FROM o WHERE entry_id NOT IN (SELECT entry_id FROM n) UNION ALL SELECT * FROM n")
def k04(spark, d):
    o = table(spark, d, "image_prints").select("entry_id", "size", "dhash").distinct()
    new = o.where("entry_id % 2 = 0").withColumn("size", c("size") + 1)
    exist = table(spark, d, "entries").where("volume_id < 8").select(c("id").alias("entry_id")).distinct()
    return W.upsert(o, new, ["entry_id"], existing=exist)


@query("k05_last_writer", sql("rdg", "SELECT disk_key, status, reallocated FROM rdg QUALIFY row_number() OVER (PARTITION BY disk_key ORDER BY reading_no % 2 DESC, reading_no DESC) = 1"))
def k05(spark, d):
    """Odd readings written over even ones; of several new ones the last holds."""
    r = fixtures.readings(spark, d).select("disk_key", "status", "reallocated", "reading_no")
    old = W.upsert(r.limit(0), r.where("reading_no % 2 = 0"), ["disk_key"], "reading_no")
    return W.upsert(old, r.where("reading_no % 2 = 1"), ["disk_key"], "reading_no").drop("reading_no")


@query("k06_update_volumes", "SELECT id, CASE WHEN id % 2 = 0 THEN 'indexed' ELSE status END AS status, CASE WHEN id % 2 = 0 AND id > 10 THEN 'cellar' ELSE location END AS location FROM volumes")
def k06(spark, d):
    v = vols(spark, d)
    ch = v.where("id % 2 = 0").select("id", F.lit("indexed").alias("status"), F.when(c("id") > 10, "cellar").alias("location"))
    return W.update_volumes(v, ch, ["status", "location"]).select("id", "status", "location")


@query("k07_remove_volume", sql("ent", "SELECT volume_id, count(*) AS n FROM ent WHERE volume_id <> 7 GROUP BY 1"))
def k07(spark, d):
    return W.remove_volume(table(spark, d, "entries").dropDuplicates(["id"]), 7).groupBy("volume_id").agg(F.count("*").alias("n"))


@query("k07_prune", sql("rdg", "SELECT disk_key, count(*) AS n FROM rdg WHERE at_ms >= epoch_ms(TIMESTAMP '2024-01-15') GROUP BY 1"))
def k07b(spark, d):
    return W.prune(fixtures.readings(spark, d), 1_705_276_800_000).groupBy("disk_key").agg(F.count("*").alias("n"))


@query("k10_deletion_plan", sql("doc", "SELECT id, CASE WHEN doc_id % 3 = 1 THEN 'skipped_missing' WHEN doc_id % 3 = 2 AND doc_id % 4 = 0 THEN 'skipped_changed' ELSE 'done' END AS outcome FROM doc"))
def k10(spark, d):
    f = fixtures.content_files(spark, d)
    disk = f.where("doc_id % 3 <> 1").select("id", (c("size") + ((c("doc_id") % 3 == 2) & (c("doc_id") % 4 == 0)).cast("int")).alias("size"), "modified")
    return W.deletion_plan(f, disk)


@query("s07_watch_batches", "WITH e AS (SELECT user_id, ts FROM events), x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM e), y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, count(*) AS n, epoch_us(min(ts)) // 1000 AS first_ms FROM y GROUP BY user_id, g")
def s07(spark, d):
    """Changes in batches that an hour without any ends."""
    e = table(spark, d, "events").select("user_id", c("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.unix_millis(F.min("ts")).alias("first_ms")).drop("w")


@query("u06_distinct_folders", "SELECT DISTINCT volume_id, parent_ref FROM changes WHERE parent_ref IS NOT NULL")
def u06(spark, d):
    return table(spark, d, "changes").where("parent_ref IS NOT NULL").select("volume_id", "parent_ref").distinct()


@query("x06_dimensions", f"SELECT 'volume_disk' AS what, id || '' AS key, disk_key AS value FROM volumes WHERE disk_key IS NOT NULL UNION ALL SELECT 'disk_medium', disk_key, max(bus_type) FROM volumes WHERE disk_key IS NOT NULL GROUP BY 2 UNION ALL SELECT 'server_shares', {SERVER}, count(*) || '' FROM volumes WHERE kind = 'network' AND unc_path IS NOT NULL AND status IS DISTINCT FROM 'ignored' GROUP BY 2")
def x06(spark, d):
    return V.dimensions(vols(spark, d))


@query("x09_print_states", f"WITH e AS (SELECT DISTINCT * FROM entries), p AS (SELECT DISTINCT entry_id, size, modified_at FROM image_prints) SELECT e.id, p.entry_id IS NOT NULL AS printed, {ext_sql('name')} IN ({', '.join(map(repr, N.IMAGE_EXTENSIONS + N.RAW_EXTENSIONS))}) AS image FROM e LEFT JOIN p ON p.entry_id = e.id AND p.size = e.size AND p.modified_at IS NOT DISTINCT FROM e.modified_at WHERE NOT is_dir AND e.size > 0 AND coalesce(attrs, 0) & 4460544 = 0")
def x09(spark, d):
    """Work states of files: whether they have a print as they are now, and whether they are pictures."""
    e = table(spark, d, "entries").dropDuplicates(["id"])
    return similar.print_states(e, table(spark, d, "image_prints")).select("id", "printed", N.is_printable(c("name")).alias("image"))


@query("x17_trigrams", f"WITH g AS (SELECT DISTINCT id, {up_sql('name')} AS n FROM entries), t AS (SELECT id, unnest(list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3)))) AS gram FROM g WHERE length(n) >= 3) SELECT gram, count(DISTINCT id) AS names, min(id) AS first_id, max(id) AS last_id FROM t GROUP BY 1")
def x17(spark, d):
    """The index of a trigram search: for each run of three characters how many names have it, and the first and last of them."""
    return S.trigrams(table(spark, d, "entries")).groupBy("gram").agg(F.count("*").alias("names"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("o10_cards_order", f"SELECT id, row_number() OVER (ORDER BY CASE {SECTION} WHEN 'online' THEN 0 WHEN 'network' THEN 1 ELSE 2 END, upper({NAME}), id) AS pos FROM volumes WHERE status IS DISTINCT FROM 'ignored'")
def o10(spark, d):
    """Cards in their order; volumes are a handful of rows."""
    return V.visible(vols(spark, d)).select("id", F.row_number().over(Window.orderBy(*V.cards_order(vols(spark, d)))).cast("long").alias("pos"))
