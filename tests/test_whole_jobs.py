"""The whole job, where a query used to stop before its end."""

from shelfmark import queries


def test_hash_order_has_every_pending_file(spark, tmp_path):
    n = 1300
    rows = [(i, "s", "en", f"t{i % 40}" if i % 3 else f"own {i}", i % 40 + 1) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    files = []
    for i, _, _, text, size in rows:
        if i % 11:  # others have no local content
            files.append((i + 20_000_000, size, (size, text) if i % 10 not in (7, 8, 9) else None, i % 10 < 5))
    shared = {}
    for i, _, _, text, size in rows:
        if i % 10 not in (7, 8, 9):
            shared[(size, text)] = shared.get((size, text), 0) + 1
    pending = [(shared.get(q, 0) < 2, -size if shared.get(q, 0) > 1 else size, id) for id, size, q, full in files if not full]
    want = {id: pos for pos, (_, _, id) in enumerate(sorted(pending), 1)}
    got = [(r["id"], r["pos"]) for r in queries.all_queries()["w10_hash_order"](spark, str(tmp_path)).collect()]
    assert len(want) > 500 and len(got) == len(want) and dict(got) == want


def test_problems_have_wrong_totals_and_double_ids(spark, tmp_path):
    E = "id long, volume_id long, parent_id long, name string, is_dir boolean, size long, alloc_size long"
    rows = [
        (1, 1, None, "", True, 0, 0), (2, 1, 1, "a", True, 7, 7), (3, 1, 2, "f", False, 10, 16), (4, 1, 2, "g", False, 5, None), (5, 1, 1, "b", True, 0, 0),
        (6, 1, 5, "h", False, 1, 1), (6, 1, 5, "i", False, 1, 1), (7, 2, 5, "other", True, 0, 0), (8, 2, 7, "k", False, 3, 3), (9, 1, 99, "lost", True, 0, 0),
    ]
    right = [(1, 16, 22, 3, 2), (2, 15, 21, 2, 0), (5, 1, 1, 1, 0), (7, 0, 0, 0, 0), (9, 5, 5, 5, 5)]
    S = "entry_id long, total_size long, total_alloc long, file_count long, dir_count long"
    spark.createDataFrame(rows + rows[:3], E).write.parquet(f"{tmp_path}/entries.parquet")

    def found(stats):
        spark.createDataFrame(stats, S).write.mode("overwrite").parquet(f"{tmp_path}/dir_stats.parquet")
        return {(r["problem"], r["id"]) for r in queries.all_queries()["q02_problems"](spark, str(tmp_path)).collect()}

    structure = {("duplicate_id", 6), ("other_volume", 7), ("no_parent", 9)}
    assert found(right) == structure
    for k in range(1, 5):
        wrong = [tuple(v + (r[0] == 2 and i == k) for i, v in enumerate(r)) for r in right]
        assert found(wrong) == structure | {("stats_differ", 2)}
    assert found([*right, (1, None, 22, 3, 2)]) == structure | {("stats_differ", 1)}


def test_ambiguous_volumes_have_candidates(spark):
    from shelfmark.operators import volumes

    S = "id long, kind string, unc_path string, fs_serial long, fs_type string, volume_guid string, capacity long, user_name string, os_label string, last_mount string, location string"
    known = spark.createDataFrame([(1, "fixed", None, 5, "NTFS", "{g1}", 100, "Foto", None, "D:\\", " "), (2, "fixed", None, 5, "NTFS", "{g2}", 100, None, "B", None, "shelf"), (3, "fixed", None, 5, "NTFS", "{g3}", 7, None, None, None, None), (4, "network", "\\\\old\\share", None, None, None, 9, None, None, None, None)], S)
    det = spark.createDataFrame([(10, "fixed", None, 5, "NTFS", None, 100), (11, "fixed", None, 5, "NTFS", None, 8), (12, "network", "\\\\new\\share", None, None, None, 9), (13, "fixed", None, 6, "NTFS", None, 1)], ", ".join(S.split(", ")[:7]))
    got = volumes.ambiguous(det, known).select("det", "volume_id", "name", "location").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(10, 1, "Foto", None), (10, 2, "B", "shelf"), (11, 1, "Foto", None), (11, 2, "B", "shelf"), (11, 3, "#3", None), (12, 4, "#4", None)], key=str)


def test_browser_caches_of_each_profile(spark):
    from pyspark.sql import functions as F

    from shelfmark.operators import cleanup, tree

    names = {1: (None, ""), 2: (1, "Chrome"), 3: (2, "Default"), 4: (2, "Profile 1"), 5: (3, "Cache"), 6: (4, "CACHE"), 7: (4, "cookies"), 8: (2, "ShaderCache"), 9: (3, "GPUCache"), 10: (2, "Cache"), 20: (1, "Firefox"), 21: (20, "p1"), 22: (21, "cache2"), 23: (4, "cache")}
    rows = [(v * 1000 + i, v, v * 1000 + up if up else None, n, True, 0) for v in (1, 2) for i, (up, n) in names.items()]
    rows += [(v * 1000 + 500 + i, v, v * 1000 + i, "x.bin", False, 10 + i) for v in (1, 2) for i in names if i not in (1, 9)]
    e = spark.createDataFrame(rows, "id long, volume_id long, parent_id long, name string, is_dir boolean, size long").withColumns({"alloc_size": F.col("size"), "attrs": F.lit(0), "modified_ms": F.lit(50).cast("long")})
    p = tree.with_paths(e)
    s = cleanup.scan(p, tree.roll_up(p), [], 0, 1, 0, browsers=[("chrome", "chromium"), ("Firefox", "firefox")]).where("category = 'browser_caches'")
    assert {(r["id"], r["size"]) for r in s.collect()} == {(v * 1000 + i, 10 + i) for v in (1, 2) for i in (5, 6, 8, 22)}


def test_cleanup_queries_have_all_categories_and_volumes(spark, sf):
    q = queries.all_queries()
    four = {"temp", "empty_folders", "large_old", "browser_caches"}
    assert "browser_caches" in {r["category"] for r in q["g01_cleanup"](spark, sf).select("category").distinct().collect()}
    assert {r["category"] for r in q["a10_cleanup_totals"](spark, sf).collect()} == four
    assert q["j25_browser_caches"](spark, sf).join(queries.tree.fixtures.tree(spark, sf).select("id", "volume_id"), "id").select("volume_id").distinct().count() > 1


def test_video_groups_are_transitive(spark):
    from shelfmark.operators import similar

    rows = [(1, 60000, [0, 0]), (2, 61000, [1, 1]), (3, 62900, [3, 3]), (4, 60000, [0, 0]), (5, 60000, [0xFFFF, 0xFFFF]), (6, 90000, [0, 0]), (7, 120000, [5, 5]), (8, 120000, [5, 5]), (9, 60000, [0])]
    df = spark.createDataFrame(rows, "id long, duration_ms long, frames array<long>")
    got = {tuple(r) for r in similar.video_groups(df, 1.0).collect()}
    assert got == {(1, 1, 2), (4, 1, 2), (2, 1, 3), (3, 1, 1), (7, 7, 1), (8, 7, 1)}
