"""Binary records, the walker, and the streaming layer driven to the end over files."""

import os
import random

import pytest
import struct

from pyspark.sql import functions as F

from shelfmark.functions.names import decode_name
from shelfmark.operators.changefeed import replay
from shelfmark.sources import records as R
from shelfmark.sources.walker import Walk
from shelfmark.streaming.journal import FileState, follow, position_lost
from shelfmark.streaming.watch import follow_health, overflowed, path_batches


def test_journal_buffers(spark):
    recs = [(100, 5, 6, 256, 32, "a.txt"), (200, -7, 6, 512, 16, "Ω資\ud800x￿")]
    good, third = R.journal_buffer(300, recs), R.journal_buffer(300, recs[:1], 3)
    df = spark.createDataFrame([(1, good), (2, third), (3, good[:-9]), (4, b"xx"), (5, None)], "buffer_id long, data binary")
    rows = R.parse_journal(df).collect()
    by = lambda i: [r for r in rows if r["buffer_id"] == i]
    assert [(r["usn"], r["file_ref"], r["name"]) for r in by(1)] == [(100, 5, "a.txt"), (200, -7, "Ω資￿D800x￿FFFF")]
    assert [(r["usn"], r["parent_ref"]) for r in by(2)] == [(100, 6)]
    assert len(by(3)) == 2 and by(3)[1]["error"] and by(4)[0]["error"] and not by(5)
    assert spark.createDataFrame(by(1), R.JOURNAL_SCHEMA).select(decode_name(F.col("name"))).collect()[1][0] == "Ω資�x￿"


def file_record(names, flags=1, base=0, size=5, modified=7):
    def attr(kind, body):
        n = -(-(24 + len(body)) // 8) * 8
        return (struct.pack("<IIBBHHHIHH", kind, n, 0, 0, 0, 0, 0, len(body), 24, 0) + body).ljust(n, b"\0")

    body = attr(0x10, struct.pack("<qqqq", 1, modified, 3, 4)) if modified else b""
    for parent, name, space in names:
        raw = name.encode("utf-16-le")
        body += attr(0x30, struct.pack("<q", parent) + bytes(56) + bytes([len(raw) // 2, space]) + raw)
    if size is not None:
        body += attr(0x80, bytes(size))
    head = b"FILE" + struct.pack("<HHqHHHHIIq", 48, 3, 0, 1, 1, 56, flags, 0, 1024, base)
    rec = bytearray((head.ljust(56, b"\0") + body + b"\xff\xff\xff\xff").ljust(1024, b"\0"))
    rec[48:50] = b"\x01\x02"
    for k in (1, 2):
        rec[48 + 2 * k : 50 + 2 * k] = rec[k * 512 - 2 : k * 512]
        rec[k * 512 - 2 : k * 512] = b"\x01\x02"
    return bytes(rec)


def test_file_table(spark):
    torn = bytearray(file_record([(5, "x", 1)]))
    torn[510] ^= 1
    rows = [(40, file_record([(5, "long name.txt", 1), (5, "LONGNA~1.TXT", 2), (9, "link", 1)])), (41, file_record([(5, "more", 1)], base=40 | 3 << 48, size=None, modified=None)), (42, bytes(torn)), (43, file_record([(5, "deleted", 1)], flags=0)), (44, b"x")]
    t = R.parse_file_table(spark.createDataFrame(rows, "record_id long, data binary"))
    assert t.where("error IS NOT NULL").count() == 2
    got = {(r["file_id"], r["parent_ref"], r["name"], r["size"], r["modified"]) for r in R.merged_file_table(t).collect()}
    assert got == {(40, 5, "long name.txt", 5, 7), (40, 9, "link", 5, 7), (40, 5, "more", 5, 7)}
    assert R.runs(bytes([0x11, 3, 5, 0x11, 2, 0xFE, 0x01, 4, 0])) == [(3, 5), (2, 3), (4, None)]


def test_walker(spark, tmp_path):
    for p in ("a/b/c.txt", "a/skip/x.txt", "top.txt", "z/e.bin"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    os.symlink(tmp_path / "a", tmp_path / "z" / "link")
    spark.dataSource.register(Walk)
    rows = spark.read.format("shelfmark_walk").option("exclude", "SKIP").load(str(tmp_path)).collect()
    assert {(r["path"], r["is_dir"], r["is_link"]) for r in rows} == {("a", True, False), ("a\\b", True, False), ("a\\b\\c.txt", False, False), ("top.txt", False, False), ("z", True, False), ("z\\e.bin", False, False), ("z\\link", False, True)}
    assert {r["parent"] for r in rows if r["name"] == "c.txt"} == {"a\\b"} and {r["size"] for r in rows if r["name"] == "top.txt"} == {7}


SCHEMA = "volume_id long, journal_id long, usn long, file_ref long, parent_ref long, reason long, name string, size long, modified_at long, attrs long"


def test_stream_equals_one_batch(spark, tmp_path):
    rnd, usn, rows = random.Random(8), 0, []
    for _ in range(300):
        usn += 1
        rows.append((1, 5 + usn // 200, usn, rnd.randrange(25), rnd.choice([None, 1, 2]), rnd.choice([256, 512, 0, 0]), rnd.choice([None, "a", "b"]), None, None, None))
    src = tmp_path / "in"
    for k in range(4):
        part = rows[k * 75 : k * 75 + 75] + (rows[max(0, k * 75 - 20) : k * 75])  # the end of the one before comes again
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(src / f"p{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    state = FileState(spark, str(tmp_path / "state"))
    q = follow(stream, state, str(tmp_path / "check"), None)
    q.awaitTermination()
    key = ["volume_id", "file_ref", "parent_ref", "name", "journal_id", "usn"]
    want = {tuple(r) for r in replay(spark.createDataFrame(rows, SCHEMA)).select(*key).collect()}
    assert state.pointer()["batch"] == 3
    assert {tuple(r) for r in state.read().select(*key).collect()} == want
    before = state.pointer()
    state.apply(spark.createDataFrame(rows, SCHEMA), 2)  # an old batch again
    state.apply(spark.createDataFrame(rows[:80], SCHEMA), 9)  # old records in a new batch
    assert before != state.pointer() and {tuple(r) for r in state.read().select(*key).collect()} == want


def test_out_of_order_over_batches(spark, tmp_path):
    """Records shuffled over many batches give what a replay of the whole feed gives."""
    rnd, rows = random.Random(4), []
    for usn in range(1, 241):
        rows.append((1, 5 + usn // 100, usn, rnd.choice([*range(12), None]), rnd.choice([None, 1, 2]), rnd.choice([256, 512, 768, 0, 0, None]), rnd.choice([None, "a", "b"]), rnd.choice([None, 3]), None, None))
    want = {tuple(r) for r in replay(spark.createDataFrame(rows, SCHEMA)).select("volume_id", "file_ref", "parent_ref", "name", "size", "journal_id", "usn").collect()}
    mixed = rows + rnd.sample(rows, 40)
    rnd.shuffle(mixed)
    state = FileState(spark, str(tmp_path / "state"), buckets=4)
    for k in range(5):
        state.apply(spark.createDataFrame(mixed[k::5], SCHEMA), k)
    assert {tuple(r) for r in state.read().select("volume_id", "file_ref", "parent_ref", "name", "size", "journal_id", "usn").collect()} == want


def test_crash_between_steps(spark, tmp_path, monkeypatch):
    """A run that ends after writing its version, or before its pointer is in place, leaves the state before it; the batch is applied again."""
    row = lambda usn, ref: (1, 5, usn, ref, 1, 256, "n", 1, 1, 1)
    state = FileState(spark, str(tmp_path / "state"), buckets=2, keep=1)
    refs = lambda: sorted(r["file_ref"] for r in state.read().collect())
    state.apply(spark.createDataFrame([row(1, 1)], SCHEMA), 0)
    state.apply(spark.createDataFrame([row(2, 2)], SCHEMA), 1)
    third = spark.createDataFrame([row(3, 3)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(FileState, "_point", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.apply(third, 2)
    assert refs() == [1, 2] and state.pointer()["batch"] == 1
    (tmp_path / "state" / "pointer-000000000000002.new").write_text("{torn")
    assert refs() == [1, 2]
    state.apply(third, 2)
    state.apply(third, 2)
    assert refs() == [1, 2, 3] and state.pointer()["batch"] == 2
    assert len([p for p in os.listdir(tmp_path / "state") if p.startswith("pointer-") and p.endswith("2")]) == 1
    kept = {f"v{v}/bucket={b}" for b, v in state.pointer()["buckets"].items()}
    there = {f"{v}/{b}" for v in os.listdir(tmp_path / "state") if v.startswith("v") for b in os.listdir(tmp_path / "state" / v) if b.startswith("bucket")}
    assert there == kept  # older versions are gone


def test_positions(spark):
    p = spark.createDataFrame([(1, 5, 10), (2, 5, 10), (3, 5, 10), (4, None, None), (5, 5, 10)], "id long, journal_id long, next_usn long")
    j = spark.createDataFrame([(1, 5, 1, 20), (2, 6, 1, 20), (3, 5, 11, 20), (4, 5, 1, 20), (5, 5, 1, 9)], "id long, journal_id long, first_usn long, next_usn long")
    assert {tuple(r) for r in position_lost(p, j).collect()} == {(2, "recreated"), (3, "overwritten"), (4, "no_position"), (5, "ahead")}


def test_watch_and_health_streams(spark, tmp_path):
    rows = [("d", k, t, s, r) for k, (t, s, r) in enumerate([(0, "good", 0), (5, "good", 0), (9, "critical", 0), (12, "critical", 3), (13, "good", 3)])] + [("e", 9, 1, "critical", 0)]
    schema = "disk_key string, reading_no long, at_ms long, status string, reallocated long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "r"))
    q = follow_health(spark.readStream.schema(schema).parquet(str(tmp_path / "r"))).writeStream.format("memory").queryName("health_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["disk_key"], r["at_ms"]): (r["keep"], r["reason"]) for r in spark.table("health_out").collect()}
    assert got == {("d", 0): (True, None), ("d", 5): (False, None), ("d", 9): (True, "status"), ("d", 12): (True, "reallocated"), ("d", 13): (True, None), ("e", 1): (True, "status")}
    p = spark.sql("SELECT 1 AS volume_id, concat('p', id % 7) AS path, timestamp_millis(id * 100 + IF(id > 20, 5000, 0)) AS at FROM range(40)")
    b = path_batches(p).orderBy("since").collect()
    assert [(r["records"], r["paths"]) for r in b] == [(21, 7), (19, 7)] and overflowed(path_batches(p), 20).count() == 1


def test_scratch_is_cleared(spark):
    import os

    from shelfmark.operators import tree
    from shelfmark.shared import clear_scratch, shared_dir

    e = spark.createDataFrame([(1, 1, None, "", True, 0, 0), (2, 1, 1, "a", False, 5, 5)], "id long, volume_id long, parent_id long, name string, is_dir boolean, size long, alloc_size long")
    there = lambda: set(os.listdir(shared_dir(spark).removeprefix("file:")))
    before = there()
    assert tree.with_paths(e).count() == 2
    made = there() - before
    assert made and clear_scratch() > 0 and not made & there() and clear_scratch() == 0
