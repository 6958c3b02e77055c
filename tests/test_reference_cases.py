"""Literal expectations for names, the search language, selection rules, health pages, backups and trees."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.operators import backup, cleanup, duplicates, health, reconcile, search, similar, tree, volumes, writes
from shelfmark.plans.search_query import QueryError, parse, parse_size


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("name", ["straße", "ÉtÉ", "ﬁn", "μ", "ŉ", "", "Ωmega资料"])
def test_fold(spark, name):
    assert one(spark, name, N.fold) == N.fold_text(name)


@pytest.mark.parametrize("name,ext", [("a.JPG", "jpg"), (".gitignore", ""), ("x.", ""), ("a.b c", ""), ("tar.tar.gz", "gz"), ("a." + "x" * 17, ""), ("", ""), ("..foo", "foo")])
def test_extension(spark, name, ext):
    assert one(spark, name, N.extension) == ext


def test_names_round_trip(spark):
    assert one(spark, "a￿b", lambda c: N.decode_name(N.encode_name(c))) == "a￿b"
    assert one(spark, "x￿D800y", N.decode_name) == "x�y"


def test_unc_and_relative(spark):
    assert one(spark, "//Nas/Photos/", N.normal_unc) == "\\\\NAS\\PHOTOS"
    assert one(spark, "\\\\?\\UNC\\nas\\p", N.normal_unc) == "\\\\NAS\\P"
    assert one(spark, "C:\\Users\\me\\x", lambda c: N.relative_under(c, "c:/users")) == "me\\x"
    assert one(spark, "C:\\Users2\\x", lambda c: N.relative_under(c, "c:\\users")) is None


def test_unix_ms_rounds_down(spark):
    assert one(spark, N.EPOCH_FILETIME - 1, N.unix_ms, "long") == -1
    assert one(spark, N.EPOCH_FILETIME + 10_001, N.unix_ms, "long") == 1


def test_parser():
    q = parse('plan "two words" size:1.5MB..2GB ext:.JPG,png type:foto d:x is:dir online:sì', 0)
    assert q.terms == ["PLAN", "TWO WORDS", "X"] and q.sizes == [(1_500_000, 2_000_000_000)] and q.exts == [{"jpg", "png"}] and q.types == [{"images"}] and q.disks == ["D:"] and q.is_dir and q.online == [True]
    day = int(datetime.datetime(2024, 3, 15, tzinfo=datetime.UTC).timestamp() * 1000)
    assert parse("modified:15/03/2024").times == [(day, day + 86_400_000)] and parse("mod:>2024-03-15").times == [(day + 86_400_000, None)]
    assert parse("modified:<30d", 10**12).times == [(10**12 - 30 * 86_400_000, None)]
    assert parse_size(">10") == (11, None) and parse_size("<10") == (None, 9) and parse_size("5..1") is None and parse_size("<0") is None and parse_size("1,5kib") == (1536, None)
    for text, code in [('"a', "unclosed_quote"), ("foo:1", "unknown_filter"), ("size:", "empty_value"), ("size:x", "bad_size"), ("modified:2024-13", "bad_date"), ("type:x", "bad_type"), ("is:x", "bad_is"), ("online:x", "bad_online"), ("regex:(", "bad_regex")]:
        with pytest.raises(QueryError) as e:
            parse(text)
        assert e.value.code == code


def test_search_unknown_disk_and_empty(spark):
    v = spark.createDataFrame([(1, "Foto", None, "D:\\", True)], "id long, user_name string, os_label string, last_mount string, online boolean")
    e = spark.createDataFrame([(2, 1, 1, "port.txt", False, 5, 1), (3, 1, 1, "my port", True, 0, None), (4, 1, 1, "export", True, 0, None), (1, 1, None, "port", True, 0, None)], "id long, volume_id long, parent_id long, name string, is_dir boolean, size long, modified_ms long")
    i = search.name_index(e)
    with pytest.raises(search.UnknownDisk):
        search.matches(i, v, parse("disk:none"))
    assert search.matches(i, v, parse("")).count() == 0
    assert [r["id"] for r in search.ranked(search.matches(i, v, parse("port"))).collect()] == [2, 3, 4]
    assert [r["id"] for r in search.matches(i, v, parse("d:port")).orderBy("id").collect()] == [2, 3, 4]


def test_pairs_by_time_leave_no_two_that_fit(spark):
    import random

    rnd, unit = random.Random(6), backup.TOLERANCE
    side = lambda s: [(f"{s}{i}\\{rnd.choice(['n', 'm'])}", 1, rnd.choice([None, *[int(unit * rnd.uniform(0, 30)) for _ in range(6)]]), rnd.choice([None, None, f"{s}{i}"])) for i in range(60)]
    a, b = side("a"), side("b")
    S = "rel string, size long, modified long, full string"
    got = backup.compare_contents(spark.createDataFrame(a, S), spark.createDataFrame(b, S)).collect()
    fits = lambda x, y: x[0][-1] == y[0][-1] and (x[3] is None or y[3] is None) and (x[2] is None and y[2] is None or None not in (x[2], y[2]) and abs(x[2] - y[2]) <= unit)
    A, B = {x[0]: x for x in a}, {y[0]: y for y in b}
    pairs = [(A[r["rel"]], B[r["other"]]) for r in got if r["other"]]
    assert len(pairs) > 10 and all(fits(x, y) for x, y in pairs) and len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
    left_a, left_b = [A[r["rel"]] for r in got if r["status"] == "only_a"], [B[r["rel"]] for r in got if r["status"] == "only_b"]
    assert len(pairs) + len(left_a) == 60 == len(pairs) + len(left_b) and not any(fits(x, y) for x in left_a for y in left_b)
    near = backup.compare_contents(spark.createDataFrame([("x\\f", 1, 0, None), ("y\\f", 1, 19_000_000, None)], S), spark.createDataFrame([("z\\f", 1, 38_000_000, None)], S)).collect()
    assert {(r["rel"], r["status"]) for r in near} == {("x\\f", "only_a"), ("y\\f", "same")}


def test_quick_hash_of_long_contents(spark):
    import hashlib

    from shelfmark.operators import content

    for n in (0, 5, 65_536, 65_537, 100_000, 131_072, 131_073, 300_000):
        data = bytes(i * 7 % 251 for i in range(n))
        want = hashlib.sha256(n.to_bytes(8, "little") + data[:65_536] + data[max(n - 65_536, 65_536) :]).hexdigest()
        assert one(spark, data, content.quick_hash, "binary") == want, n


def test_selection_rules(spark):
    rows = [(1, 1000, "h", 1, "a/long/path", 30, True), (2, 1000, "h", 2, "b", 10, True), (3, 1000, "h", 2, "c", 20, False), (4, 1000, "h", 1, "keep/d", None, True)]
    f = spark.createDataFrame(rows, "id long, size long, full string, volume_id long, path string, modified long, online boolean")
    pick = lambda *rules: sorted(r["id"] for r in duplicates.selected(f, list(rules)).collect())
    assert pick() == [2, 4] and pick(("keep_oldest",)) == [1, 4] and pick(("keep_newest",)) == [2, 4]
    assert pick(("keep_on_volume", 9)) == [2, 4] and pick(("keep_on_volume", 2), ("keep_shortest_path",)) == [1, 4]
    assert pick(("never_in", "KEEP")) == [2]
    v = {r["id"]: r["verdict"] for r in duplicates.last_copies(f, f.where("id <> 3")).collect()}
    assert v == {1: "only_offline", 2: "only_offline", 4: "only_offline"}


def test_near_prints_equal_all_pairs(spark):
    import random

    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    values = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(9))) for b in base for _ in range(4)] + base
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "id long, print long")
    for limit in (0, 3, 6, 9, 12):
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= limit}
        assert {(r["a"], r["b"]) for r in similar.near_prints(df, limit).collect()} == want
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 6}
    assert {(r["a"], r["b"]) for r in similar.near_prints(df, 6, hot_rows=3).collect()} == want
    at = {v: i for i, v in enumerate(signed)}
    found = {(r["id"], r["near_id"], r["distance"]) for r in similar.similar(df.where("id % 5 = 0"), df.union(df.selectExpr("id + 1000", "print").where("id % 7 = 0")), 6).collect()}
    twice = lambda i: [i, i + 1000] if i % 7 == 0 else [i]
    assert found == {(at[a], j, ((a ^ b) & (2**64 - 1)).bit_count()) for a in signed for b in signed if at[a] % 5 == 0 and ((a ^ b) & (2**64 - 1)).bit_count() <= 6 for j in twice(at[b]) if j != at[a]}


def _brute(values, limit):
    return {(a, b): d for a in values for b in values if a < b and (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= limit}


def _some_prints():
    import random

    rnd = random.Random(8)
    base = [rnd.getrandbits(63) for _ in range(40)]
    return sorted({v ^ sum(1 << k for k in rnd.sample(range(63), rnd.randrange(5))) for v in base for _ in range(5)} | {rnd.getrandbits(20) << 40 for _ in range(60)})


def _nothing_large_sent(df):
    """No broadcast in the plan that could hold an exploded or met table: Spark underrates both."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any("Broadcast" in x for x in plan.splitlines())


def test_print_groups_send_nothing_to_the_driver(spark):
    values = _some_prints()
    df = spark.createDataFrame(list(enumerate(values)), "id long, print long")
    group = list(range(len(values)))
    at = {v: i for i, v in enumerate(values)}
    near = _brute(values, 6)
    while any(group[at[a]] != group[at[b]] for a, b in near):
        for a, b in near:
            group[at[a]] = group[at[b]] = min(group[at[a]], group[at[b]])
    want = {(at[x], group[at[x]]) for pair in near for x in pair}
    for hot in (100_000, 20):  # 20: groups are dealt out to cells
        assert {tuple(r) for r in similar.print_groups(df, 6, hot_rows=hot).collect()} == want
    p = similar.near_prints(df, 6)
    assert _nothing_large_sent(p) and p.count() == len(near)


def test_similar_sends_nothing_to_the_driver(spark):
    values = _some_prints()
    df = spark.createDataFrame(list(enumerate(values)), "id long, print long")
    near = _brute(values, 6)
    at = {v: i for i, v in enumerate(values)}
    both = {(at[x], at[y], d) for (a, b), d in near.items() for x, y in ((a, b), (b, a))}
    for hot in (100_000, 20):
        found = similar.similar(df.where("id % 5 = 0"), df, 6, hot_rows=hot)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == {x for x in both if x[0] % 5 == 0}
    assert _nothing_large_sent(similar.similar(df.where("id % 5 = 0"), df, 6))


def test_representatives_read_the_groups_once(spark):
    values = _some_prints()
    df = spark.createDataFrame([(i, v, i % 7 or None, 3) for i, v in enumerate(values)], "id long, print long, width int, height int")
    groups = similar.print_groups(df, 6)
    got = similar.representatives(groups, df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    of = {r["id"]: r["group_id"] for r in groups.collect()}
    best = {g: min((-(i % 7) * 3, i) for i in of if of[i] == g)[1] for g in set(of.values())}
    n = lambda g: sum(x == g for x in of.values())
    assert {tuple(r) for r in got.collect()} == {(g, i, best[g], n(g), (values[i] ^ values[best[g]]).bit_count()) for i, g in of.items()}


def test_near_prints_once_each_in_cells(spark):
    values = _some_prints()
    df = spark.createDataFrame(list(enumerate(values)), "id long, print long")
    for limit, hot in ((1, 7), (6, 7)):
        p = similar.near_prints(df, limit, hot_rows=hot)
        got = [tuple(r) for r in p.collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b, d) for (a, b), d in _brute(values, limit).items()}
    p = df.select(F.col("print").alias("p"))
    far = similar._flipped(p, p, 7, True)  # the way of limits that leave no choice of blocks
    assert _nothing_large_sent(far) and {tuple(r) for r in far.collect()} == set(_brute(values, 7))


def test_near_prints_move_little_besides_the_prints(spark):
    store = spark.sparkContext._jsc.sc()

    def moved():
        store.listenerBus().waitUntilEmpty()
        all_ = store.statusStore().executorList(False)
        return sum(all_.apply(i).totalShuffleWrite() for i in range(all_.size()))

    df = spark.range(40_000).selectExpr("xxhash64(id) AS print").repartition(1)
    before = moved()
    assert similar.near_prints(df, 6).count() == 0
    n = 40_000 * 8
    assert 7 * n < moved() - before < 10 * n  # seven groups, and the distinct prints once


def test_near_prints_of_files_with_several(spark, tmp_path):
    from shelfmark.queries.files import QUERIES

    values = _some_prints()
    rows = [(i % 50, 1, 1, v, i % 7 or None, 3) for i, v in enumerate(values)] + [(900, 1, 1, 0, 2, 2), (901, 1, 1, None, 2, 2)]
    spark.createDataFrame(rows, "entry_id long, size long, modified_at long, dhash long, width int, height int").write.parquet(f"{tmp_path}/image_prints.parquet")
    got = [tuple(r) for r in QUERIES["j13_near_prints"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b, d) for (a, b), d in _brute([v for v in values if v], 6).items()}


@pytest.mark.parametrize("edges", [200_000, 9])
def test_linked_chains(spark, edges):
    pairs = [(i + 1, i) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (200, 201), (201, 200), (7, 7)] + [(300, 301 + i) for i in range(60)]
    got = {r["v"]: r["group_id"] for r in similar.linked(spark.createDataFrame(pairs, "a long, b long"), edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200, **{i: 300 for i in range(300, 361)}}


def test_pixels(spark):
    import numpy as np

    g = np.random.default_rng(1).integers(0, 255, 72).tolist()
    want = 0
    for r in range(8):
        for k in range(8):
            want = want << 1 | (g[r * 9 + k] < g[r * 9 + k + 1])
    want = want - (1 << 64) if want >> 63 else want
    assert one(spark, g, similar.print_of_pixels, "array<int>") == want


def test_health_pages(spark):
    log = bytearray(512)
    log[0], log[1:3], log[3], log[4], log[5], log[160] = 1, (300).to_bytes(2, "little"), 5, 10, 95, 2
    r = one(spark, bytes(log), health.nvme_reading, "binary")
    assert r["status"] == "critical" and r["reasons"] == ["nvme_critical_warning", "wear_high", "media_errors"] and r["temperature"] == 27
    assert one(spark, b"short", health.nvme_reading, "binary") is None
    page, limits = bytearray(512), bytearray(512)
    for k, (i, cur, raw) in enumerate([(5, 100, 8), (194, 60, 40), (9, 90, 1234), (231, 5, 0)]):
        at = 2 + k * 12
        page[at], page[at + 3], page[at + 4], page[at + 5 : at + 11] = i, cur, cur, raw.to_bytes(6, "little")
    limits[2], limits[3] = 231, 10
    df = spark.createDataFrame([(bytes(page), bytes(limits))], "p binary, t binary")
    r = df.select(health.ata_reading(health.ata_attributes(F.col("p"), F.col("t")), F.lit(False)).alias("r")).first()["r"]
    assert r["status"] == "critical" and r["reasons"] == ["attribute_failed", "reallocated", "wear_high"] and (r["temperature"], r["hours"], r["reallocated"], r["wear"]) == (40, 1234, 8, 95)


def test_thinning(spark):
    day = health.DAY_MS
    rows = [("d", 0, 0, "good", 0), ("d", 1, 5, "good", 0), ("d", 2, day, "good", 0), ("d", 3, day + 5, "warning", 0), ("d", 4, day + 6, "good", 0), ("d", 5, 2 * day, "good", 0), ("d", 6, 2 * day + 7, "good", 0)]
    df = spark.createDataFrame(rows, "disk_key string, reading_no long, at_ms long, status string, reallocated long")
    assert sorted(r["reading_no"] for r in health.thinned(df).collect()) == [0, 2, 3, 4, 6]


def test_backup_contents(spark):
    S = "rel string, size long, modified long, full string"
    a = spark.createDataFrame([("x\\1", 5, 0, "h"), ("x\\2", 5, 0, "h"), ("y\\m", 7, 0, None), ("z", 9, 0, "q"), ("only", 1, 0, "w")], S)
    b = spark.createDataFrame([("moved\\1", 5, 99, "h"), ("M\\M", 7, 19_999_999, "k"), ("Z", 9, 0, "r"), ("new", 2, 0, None)], S)
    got = {(r["rel"], r["other"], r["status"], r["evidence"]) for r in backup.compare_contents(a, b).collect()}
    assert got == {("x\\1", "moved\\1", "same", "content"), ("x\\2", None, "only_a", None), ("y\\m", "M\\M", "same", "metadata"), ("z", None, "different", "content"), ("only", None, "only_a", None), ("new", None, "only_b", None)}


def test_ops_in_order(spark):
    e = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, size long")
    ops = spark.createDataFrame([(1, "update", 1, "x", None), (2, "delete", 1, None, None), (3, "insert", 1, None, 7), (4, "update", 1, "y", None), (5, "delete", 2, None, None), (6, "update", 2, "z", None), (7, "update", 3, "q", None)], "seq long, op string, id long, name string, size long")
    assert [tuple(r) for r in writes.apply_ops(e, ops, ["name", "size"]).collect()] == [(1, "y", 7)]


def test_cleanup_guards(spark):
    e = spark.createDataFrame([(1, 1, None, "", True, 0, 0), (2, 1, 1, "Windows", True, 0, 0), (3, 1, 2, "empty", True, 0, 0), (4, 1, 1, "App", True, 0, 0), (5, 1, 4, "x.DLL", False, 5, 0), (6, 1, 4, "hollow", True, 0, 0), (7, 1, 1, ".git", True, 0, 0), (8, 1, 1, "free", True, 0, 0), (9, 1, 1, "hid", True, 0, 2), (10, 1, 8, "deeper", True, 0, 0)], "id long, volume_id long, parent_id long, name string, is_dir boolean, size long, attrs long").withColumn("alloc_size", F.col("size")).withColumn("modified_ms", F.lit(5).cast("long"))
    p = tree.with_paths(e)
    got = cleanup.scan(p, tree.roll_up(p), [], 0, 1, 10)
    assert {(r["category"], r["id"]) for r in got.collect()} == {("empty_folders", 8)}


def test_volume_matching(spark):
    S = "id long, kind string, unc_path string, fs_serial long, fs_type string, volume_guid string, capacity long"
    known = spark.createDataFrame([(1, "fixed", None, 5, "NTFS", "{g1}", 100), (2, "fixed", None, 5, "ntfs", "{g2}", 200), (3, "network", "\\\\nas\\a", None, None, None, 1)], S)
    det = spark.createDataFrame([(10, "fixed", None, 5, "NTFS", "{G2}", 100), (11, "fixed", None, 5, "NTFS", None, 100), (12, "network", "//NAS/A/", None, None, None, 9), (13, "fixed", None, 6, "NTFS", None, 1)], S)
    got = {r["det"]: (r["decision"], r["id"]) for r in volumes.match(det, known).collect()}
    assert got == {10: ("known", 2), 11: ("known", 1), 12: ("known", 3), 13: ("new", None)}


def test_treemap_budget_and_rest(spark):
    from shelfmark.operators.space import treemap

    def drawn(items, **more):
        ids, rows = {"": 1}, [(1, 1, None, "", True, 0, 0)]
        for p, size in items:
            is_dir = p.endswith("\\")
            names = p.rstrip("\\").split("\\")
            ids["\\".join(names)] = len(ids) + 1
            rows.append((ids["\\".join(names)], 1, ids["\\".join(names[:-1])], names[-1], is_dir, size, size))
        e = spark.createDataFrame(rows, "id long, volume_id long, parent_id long, name string, is_dir boolean, size long, alloc_size long")
        p = tree.with_paths(e)
        return {r["name"]: (r["size"], r["depth"], r["other"]) for r in treemap(p, tree.roll_up(p), 1, **more).collect()}

    sample = [("Video\\", 0), ("Video\\film.mkv", 6000), ("Foto\\", 0), ("Foto\\2024\\", 0), ("Foto\\2024\\a.jpg", 2000), ("Foto\\2024\\b.jpg", 1800), ("notes.txt", 150), (".gitignore", 49), ("tiny.bin", 1)]
    got = drawn(sample, min_fraction=0.01, levels=3, budget=100)
    assert got == {"": (10_000, 0, 50), "Video": (6000, 1, 0), "film.mkv": (6000, 2, 0), "Foto": (3800, 1, 0), "2024": (3800, 2, 0), "a.jpg": (2000, 3, 0), "b.jpg": (1800, 3, 0), "notes.txt": (150, 1, 0)}
    assert drawn(sample, min_fraction=0.0, levels=1, budget=2) == {"": (10_000, 0, 200), "Video": (6000, 1, 0), "Foto": (3800, 1, 0)}
    deep = [("Big\\", 0), ("Big\\Sub\\", 0), ("Big\\Sub\\deep.bin", 5000), ("Big\\x.bin", 3000), ("Small\\", 0), ("Small\\s.bin", 1000)]
    got = drawn(deep, min_fraction=0.0, levels=5, budget=5)
    assert set(got) == {"", "Big", "Small", "Sub", "x.bin", "deep.bin"} and got["Small"] == (1000, 1, 0)
    many = [("F\\", 0), *[(f"F\\{i}", 20) for i in range(3000)], ("rest", 3_000_000)]
    assert drawn(many, min_fraction=0.0005)["F"] == (60_000, 1, 60_000)  # each too small to be drawn, so all of them are the rest
    assert drawn([*many, ("F\\big", 9000)], min_fraction=0.0005)["F"] == (69_000, 1, 60_000)


def test_long_paths_stay_whole(spark):
    e = spark.createDataFrame([(1, 1, None, "", True, 0, 0), (2, 1, 1, "a", True, 0, 0)], "id long, volume_id long, parent_id long, name string, is_dir boolean, size long, alloc_size long")
    m = spark.createDataFrame([(1, "C:\\")], "id long, last_mount string")
    rest = "\\".join(f"n{i}" for i in range(1500))
    w = spark.createDataFrame([(f"c:\\A\\{rest}",), ("c:\\a",)], "path string")
    assert {(r["id"], r["rest"]) for r in tree.locate(tree.with_paths(e), m, w).collect()} == {(2, rest), (2, "")}


def test_crc32(spark):
    import zlib

    assert one(spark, "naïve", lambda c: F.crc32(c.cast("binary"))) == zlib.crc32("naïve".encode())


def test_hot_keys_join_like_cold_ones(spark):
    from shelfmark.shared import lookup_join

    left = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(100)] + [(None, -1), (50, -2)], "k long, v long")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(7)], "k long, w string")
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        assert sorted(map(tuple, lookup_join(left, right, "k", how, hot_rows=5).select("k", "v", "w").collect()), key=str) == want


def test_empty_tables(spark):
    from shelfmark.operators import actions, content, space

    e = spark.createDataFrame([], "id long, volume_id long, parent_id long, name string, is_dir boolean, size long, alloc_size long, attrs long, modified_ms long")
    p = tree.with_paths(e)
    assert p.count() == 0 and tree.roll_up(p).count() == 0 and space.largest_files(e, 5).count() == 0
    assert {(r["what"], r["files"]) for r in space.type_stats(e, 3).collect()} >= {("total", 0), ("category", 0), ("band", 0), ("other_extensions", 0)}
    s = spark.createDataFrame([], "rel string, size long, modified long, full string")
    assert backup.verify(s, s).count() == 0 and backup.compare_contents(s, s).count() == 0 and backup.coverage(backup.verify(s, s)).first()["files_percent"] == 100
    log = spark.createDataFrame([], "id long, at_ms long, action string, volume_id long, size long, outcome string")
    assert actions.batches(log).count() == 0
    assert similar.near_prints(spark.createDataFrame([], "id long, print long"), 6).count() == 0 and similar.linked(spark.createDataFrame([], "a long, b long")).count() == 0
    h = content.with_hashes(spark.createDataFrame([], "id long, volume_id long, size long, modified long, attrs long"), spark.createDataFrame([], "entry_id long, size long, modified long, quick string, full string"))
    assert content.passes(h).count() == 0
