"""Small cases of operators whose inputs the tables don't have."""

import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.operators import content, duplicates, health, reconcile, search, similar, space, tree, volumes, writes
from shelfmark.plans.search_query import get_filter, set_filter, split_at


def test_search_text_editing():
    assert set_filter("plan size:1 x", "size", "2MB..3MB") == "plan x size:2MB..3MB"
    assert set_filter('SIZE:"a b"  plan', "size", None) == "plan" and set_filter("", "disk", "My disk") == 'disk:"My disk"'
    assert get_filter('plan Disk:"My disk" x', "disk") == "My disk" and get_filter("resize:3", "size") is None and get_filter("size:", "size") == ""
    assert split_at("naïve text", 2, 5) == ("na", "ïve", " text") and split_at("ab", 5, 1) == ("ab", "", "")


def test_names_claimed_twice(spark):
    s = spark.createDataFrame([(1, 1, 5, "a", 10), (1, 1, 5, "a", 11), (1, 2, 5, "a", 10), (1, 1, 6, "a", 12), (1, 1, None, "n", 1), (1, 1, None, "n", 2), (2, 1, 5, None, 1), (2, 1, 5, None, 2)], "volume_id long, snap_no int, parent_ref long, name string, file_ref long")
    assert [tuple(r) for r in reconcile.claimed_twice(s, ["volume_id", "snap_no"]).collect()] == [(1, 1, 5, "a", 2)]
    assert [tuple(r) for r in reconcile.claimed_twice(s).collect()] == [(1, 5, "a", 3)]


def test_why_analysis_waits(spark):
    rows = [(1, 0, False, True, True, 0), (2, 5, True, True, True, 0), (3, 5, False, True, True, 9), (4, 5, False, False, True, 9), (5, 5, False, False, False, 5), (6, 5, False, False, False, 4)]
    df = spark.createDataFrame(rows, "id long, left long, running boolean, excluded boolean, busy boolean, skipped long")
    why = lambda paused: {r["id"]: r["w"] for r in df.select("id", content.waiting(paused).alias("w")).collect()}
    assert why(False) == {1: None, 2: None, 3: "excluded", 4: "busy", 5: "skipped", 6: "next"}
    assert why(True) == {1: None, 2: None, 3: "excluded", 4: "paused", 5: "paused", 6: "paused"}
    left = spark.createDataFrame([(10, 8, 4, 2, 1, 1, 2, 2), (10, 8, 4, 2, 1, 1, 1, 2), (5, 5, 1, 1, 0, 0, 0, 0)], "files long, hashed long, images long, printed long, videos long, videos_printed long, skipped_files long, skipped_prints long")
    assert [r[0] for r in left.select(content.only_skipped_left()).collect()] == [True, False, False]
    shown = spark.createDataFrame([(1, 3), (3, 3), (5, 3), (0, 0)], "h long, t long").select(content.hash_percent(F.col("h"), F.col("t")).alias("p"))
    assert [r["p"] for r in shown.collect()] == [33, 100, 100, 100]


def test_choice_of_an_ambiguous_volume(spark):
    c = spark.createDataFrame([(10, 1), (10, 2), (11, 3)], "det long, volume_id long")
    assert volumes.resolve(c, 2, 10) == ("known", 2) and volumes.resolve(c, None, 10) == ("new", None)
    for wrong in ((3, 10), (1, 99)):
        with pytest.raises(ValueError):
            volumes.resolve(c, *wrong)


def test_selection_edits(spark):
    f = spark.createDataFrame([(1, 9, "h", True), (2, 9, "h", True), (3, 9, "h", False), (4, 8, "g", True), (5, 8, "g", True)], "id long, size long, full string, online boolean")
    pick = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    can = {r["id"]: r["can_select"] for r in duplicates.can_select(f, pick(1, 4)).collect()}
    assert can == {1: True, 2: True, 3: False, 4: True, 5: False}
    assert [r["size"] for r in duplicates.only_offline_left(f, pick(1, 2, 4)).collect()] == [9]


def test_one_file_under_two_shares(spark):
    S = "id long, serial long, number long, server string"
    a = spark.createDataFrame([(1, 1, 0x85CC2, "NAS"), (2, 1, 7 << 32, "nas"), (3, 5, 44, None)], S)
    b = spark.createDataFrame([(11, 2, 0x4000085CC2, "nas"), (12, 3, 7 << 32, "nas"), (13, 5, 44, None), (14, 2, 0x85CC2, None)], S)
    assert {tuple(r) for r in duplicates.same_file(a, b).collect()} == {(1, 11), (3, 13)}


def test_subtree_deletes_and_volumes(spark):
    e = spark.createDataFrame([(1, 1, None, "", True, 0, 0), (2, 1, 1, "a", True, 0, 0), (3, 1, 2, "b", False, 5, 5), (4, 1, 1, "c", False, 5, 5)], "id long, volume_id long, parent_id long, name string, is_dir boolean, size long, alloc_size long")
    p = tree.with_paths(e)
    log = spark.createDataFrame([(1, "delete_subtree", 2, None), (2, "update", 4, "d"), (3, "insert", 3, "again")], "seq long, op string, id long, name string")
    left = writes.apply_ops(e, writes.subtree_deletes(p, log), ["name"])
    assert {tuple(r) for r in left.collect()} == {(1, ""), (3, "again"), (4, "d")}
    v = spark.createDataFrame([(1, "A", 5), (2, "B", 6)], "id long, os_label string, next_usn long")
    v2 = writes.put_volume(v, spark.createDataFrame([("C", None)], "os_label string, next_usn long"))
    v3 = writes.set_volumes(v2, spark.createDataFrame([(1, None, 9)], "id long, os_label string, next_usn long"), ["os_label", "next_usn"])
    assert {tuple(r) for r in v3.select("id", "os_label", "next_usn").collect()} == {(1, None, 9), (2, "B", 6), (3, "C", None)}
    t = writes.reset_catalog({"entries": e, "settings": v})
    assert t["entries"].count() == 0 and t["settings"].count() == 2


def test_refreshed_totals_equal_all_totals(spark):
    rows = [(1, None, True, 0), (2, 1, True, 0), (3, 2, True, 0), (4, 3, False, 5), (5, 2, False, 7), (6, 1, True, 0), (7, 6, False, 11), (8, 3, True, 0)]
    e = spark.createDataFrame([(i, 1, p, str(i) if p else "", d, s, s + 1) for i, p, d, s in rows], "id long, volume_id long, parent_id long, name string, is_dir boolean, size long, alloc_size long")
    p = tree.with_paths(e)
    right = {tuple(r) for r in tree.roll_up(p).collect()}
    stale = tree.roll_up(p).withColumn("total_size", F.when(F.col("entry_id").isin(1, 2, 3), 0).otherwise(F.col("total_size")))
    assert {tuple(r) for r in tree.refresh_roll_up(stale, p, spark.createDataFrame([(3,)], "id long")).collect()} == right


def test_print_pass_goes_on(spark):
    def grays(data):
        if data == b"bad":
            raise OSError("torn")
        return range(len(data))

    f = spark.createDataFrame([(1, bytearray(72)), (2, bytearray(b"bad")), (3, bytearray(b"x")), (4, bytearray(72)), (5, None)], "id long, content binary")
    got = {r["id"]: (r["print"], r["error"]) for r in similar.print_pass(f, grays, spark.createDataFrame([(4,)], "id long")).collect()}
    assert got == {1: (-1, None), 2: (None, "OSError"), 3: (None, "ValueError"), 4: (None, "skipped"), 5: (None, "TypeError")}


def test_contents_are_guarded(spark, tmp_path):
    import os

    for n, data in (("a", b"12345"), ("b", b"67"), ("c", b"9")):
        (tmp_path / n).write_bytes(data)
        os.utime(tmp_path / n, (1000, 1000))
    want = spark.createDataFrame([(1, f"file:{tmp_path}/a", 5, 1_000_000), (2, f"file:{tmp_path}/b", 3, 1_000_000), (3, f"file:{tmp_path}/gone", 1, 1), (4, f"file:{tmp_path}/c", 1, 999)], "id long, path string, size long, modified_ms long")
    got = {r["id"]: (r["content"] and bytes(r["content"]), r["state"]) for r in content.read_contents(spark, str(tmp_path), want).collect()}
    assert got == {1: (b"12345", "ok"), 2: (None, "changed"), 3: (None, "missing"), 4: (None, "changed")}


def test_live_index(spark, tmp_path):
    e = lambda name: spark.createDataFrame([(1, v, 9, name, False, 1, 1) for v in (1, 2, 3)], "id long, volume_id long, parent_id long, name string, is_dir boolean, size long, modified_ms long")
    i = search.LiveIndex(str(tmp_path / "index"), 1000)
    i.touch(1, 2)
    assert i.refresh(e("old"), 0) == [1, 2]
    i.touch(1, 3)
    assert i.refresh(e("new"), 500) == [3] and i.due(999) == [] and i.due(1000) == [1]
    now = lambda: {r["volume_id"]: r["name"] for r in spark.read.parquet(i.path).collect()}
    assert now() == {1: "old", 2: "old", 3: "new"}
    assert i.refresh(e("new"), 1000) == [1] and now() == {1: "new", 2: "old", 3: "new"}


def test_trigrams_and_pages(spark):
    e = spark.createDataFrame([(1, "Maß"), (1, "Maß"), (2, "aaaa"), (3, "ab"), (4, None)], "id long, name string")
    assert {tuple(r) for r in search.trigrams(e).collect()} == {("MAß", 1), ("AAA", 2)}
    items = spark.createDataFrame([(1, i, f"n{i}", None if i == 3 else i % 2) for i in range(5)] + [(2, 9, "x", 1)], "parent_id long, id long, name string, size long")
    assert {tuple(r) for r in space.folder_page(items, 2).collect()} == {(1, 1, 1, 3), (1, 0, 2, 3), (2, 9, 1, 0)}


def test_storage_of_a_share(spark):
    shares = spark.createDataFrame([("n", "PHOTOS"), ("n", "zimaos-hd"), ("n", "other"), ("m", "photos")], "server string, share string")
    st = spark.createDataFrame([("n", "Photos", "/media/x"), ("n", "System", "/DATA")], "server string, storage string, mount string")
    d = spark.createDataFrame([("n", "Photos", "1", True, False), ("n", "Photos", "2", False, False), ("n", "System", "3", True, True)], "server string, storage string, serial string, healthy boolean, missing boolean")
    assert {tuple(r) for r in health.share_storages(shares, st, d).collect()} == {("n", "PHOTOS", "Photos", 2, 1), ("n", "zimaos-hd", "System", 1, 1), ("n", "other", None, None, None), ("m", "photos", None, None, None)}


def test_crc_is_zlibs(spark):
    names = ["", "a", "naïve.txt", "資料"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(F.crc32(F.col("n").cast("binary"))).collect()]
    assert got == [zlib.crc32(n.encode()) for n in names] and N.fold_text("ß") == "ß"
