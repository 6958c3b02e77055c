"""The operators of the llm subpackage against brute force, round trips and literal cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import sentences as S
from shelfmark.llm.components import components, union_find
from shelfmark.llm.packing import best_fit, pack
from shelfmark.llm.survivors import align, consensus_values, edit_distance, file_survivors, tokens, vote
from shelfmark.llm.tokens import decode, encode, token_counts
from shelfmark.llm.topn import top_n


# ---- components ----------------------------------------------------------------------------------------------------


def groups(edges):
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("cell,hot", [(50_000, 2_000_000), (20, 2_000_000), (15, 10)])
def test_components(spark, cell, hot):
    rnd = random.Random(cell)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000, 1001 + i) for i in range(150)]  # a hub
    chain = list(range(5000, 5060))
    rnd.shuffle(chain)
    edges += list(zip(chain, chain[1:])) + [(7, 7), (None, 3), (3, None)] + [(-5, -9), (-9, 2**62)]
    df = spark.createDataFrame([(a, b, "x") for a, b in edges + [(b, a) for a, b in edges[:50]]], "a long, b long, v string")
    assert {r["v"]: r["group_id"] for r in components(df, "a", "b", cell, hot).collect()} == groups(edges)


def test_components_empty(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b").count() == 0


def test_union_find():
    v, r = union_find(np.array([5, 9, 3]), np.array([9, 7, 4]))
    assert dict(zip(v.tolist(), r.tolist())) == {5: 5, 9: 5, 7: 5, 3: 3, 4: 3}


# ---- top N ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bounds", [100_000, 1, 0])
def test_top_n(spark, bounds):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), i, rnd.choice([5, 5, 7, None, -3]), rnd.choice(["b", "a", None, "é", "😀", "z"])) for i in range(400)] + [(9, 1, 2**62, "a"), (9, 2, -(2**62), "b")]
    rows += rows[:100] + [(4, 77, 1, "x")] * 20
    rnd.shuffle(rows)
    want = set()
    for g in {r[0] for r in rows} - {None}:
        best = sorted({(-r[2], (r[3] or "").encode(), r[1]) for r in rows if r[0] == g and r[2] is not None})[:5]
        want |= {(g, b[2], k + 1) for k, b in enumerate(best)}
    df = spark.createDataFrame([(*r, 0) for r in rows], "g long, id long, score long, name string, s long").repartition(6)
    assert {tuple(r) for r in top_n(df, "g", "id", "score", "name", 5, bound_rows=bounds).collect()} == want


def test_top_n_over_batches(spark):
    """Groups cut by Arrow batches, with repeats of their items."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(8)
        rows = [(rnd.choice([1, 1, 2, 3, 4]), rnd.randrange(12), rnd.randrange(4), rnd.choice("ab")) for _ in range(300)]
        want = set()
        for g in {r[0] for r in rows}:
            best = {}
            for r in rows:
                if r[0] == g:
                    best[r[1]] = min(best.get(r[1], (9, "")), (-r[2], r[3]))
            want |= {(g, i, k + 1) for k, (_, i) in enumerate(sorted((p, i) for i, p in best.items())[:5])}
        df = spark.createDataFrame(rows, "g long, id long, score long, name string").repartition(3)
        assert {tuple(r) for r in top_n(df, "g", "id", "score", "name", 5).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_top_n_ties_stay_few(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("g"), "id", F.lit(3).cast("long").alias("s"), F.lit("same").alias("t"))
    assert [(r["id"], r["pos"]) for r in top_n(df, "g", "id", "s", "t").orderBy("pos").collect()] == [(i, i + 1) for i in range(5)]
    assert top_n(df.where("id < 0"), "g", "id", "s", "t").count() == 0


# ---- survivors -----------------------------------------------------------------------------------------------------


def test_file_survivors(spark):
    rows = [
        (1, 10, "AB", " \u00a0", 5, True, 1), (2, 10, "ab", "p2", -1, True, 1), (3, 10, "aB", "p3", 9, None, 1), (3, 10, "zz", "old", 9, True, 0), (4, 10, "ab", None, 0, False, 1),
        (5, 7, None, "x", 1, True, 1), (6, 7, None, "x", 1, True, 1), (7, None, "ab", "x", 1, True, 1), (8, 8, "q", "", None, None, 1), (9, 8, "Q", None, 0, None, 1), (9, 8, "Q", None, 0, None, 1), (None, 8, "q", "x", 1, True, 1), (10, 3, "one", "x", 1, True, 1),
    ]
    df = spark.createDataFrame(rows, "entry_id long, size long, full_hash string, path string, modified long, online boolean, seen_at long")
    got = {(r["size"], r["full_hash"], r["entry_id"], r["path_from"], r["modified_from"]) for r in file_survivors(df).collect()}
    assert got == {(10, "ab", 1, 2, 1), (8, "q", 8, 0, 0)}


def test_alignment_and_vote():
    rows = ["Photos\\2021\\trip.jpg", "Photos\\2021\\trip copy.jpg", "Photos\\2021\\trip.jpg", "Old\\Photos\\2021\\trip.jpg"]
    p = [{t: 1.0} for t in tokens(rows[0])]
    for r in rows[1:]:
        p = align(p, [{t: 1.0} for t in tokens(r)])
    assert "".join(vote(p)) == rows[0] and all(abs(sum(col.values()) - 4) < 1e-9 for col in p)
    assert edit_distance(list("kitten"), list("sitting")) == 3


@pytest.mark.parametrize("chunk,hot", [(64, 2_000_000), (2, 3)])
def test_survivors_of_a_large_group(spark, chunk, hot):
    """The consensus of copies that outweigh all later ones is the first copy's, however many agree on something else."""
    rnd, rows = random.Random(chunk), []
    for i in range(200):
        path = rnd.choice([None, " ", f"Work\\Year {rnd.randrange(3)}\\report{rnd.randrange(9)}.pdf", f"x{i}\\y", "ré_su-mé²\\…"])
        rows.append((i, 5 if i % 3 else i % 4, "AB", path, rnd.choice([None, 0, 7, 8, 9]), rnd.choice([True, False, None]), 1))
    want = set()
    for size in {r[1] for r in rows}:
        group = sorted((0 if r[5] else 1 if r[5] is None else 2, -(r[4] or 0), r[0], r) for r in rows if r[1] == size)
        pick = lambda ok: next((r[0] for *_, r in group if ok(r)), 0)  # noqa: E731, B023
        want.add((size, "ab", group[0][2], pick(lambda r: r[3] and r[3].strip()), pick(lambda r: r[4])))
    df = spark.createDataFrame(rows, "entry_id long, size long, full_hash string, path string, modified long, online boolean, seen_at long")
    assert {tuple(r) for r in file_survivors(df, chunk, 2, hot).select("size", "full_hash", "entry_id", "path_from", "modified_from").collect()} == want


@pytest.mark.parametrize("chunk", [64, 3])
def test_consensus_of_large_groups(spark, chunk):
    rnd, rows = random.Random(2), []
    for i in range(60):
        rows.append(("big", f"Work\\Year 20{rnd.choice([21, 21, 21, 22])}\\report{rnd.choice(['', '', ' copy'])}.pdf{'' if i % 9 else 'x'}"))
    rows += [("one", "a\\b"), ("empty", ""), ("none", None), (None, "x")]
    got = {r["g"]: r for r in consensus_values(spark.createDataFrame(rows, "g string, p string"), "g", "p", chunk=chunk, fan=2).collect()}
    assert set(got) == {"big", "one", "empty"} and got["big"]["p"] == "Work\\Year 2021\\report.pdf" and got["big"]["distance"] == 0
    assert got["one"]["p"] == "a\\b" and got["empty"]["p"] == ""
    assert got["big"]["n_values"] == len({p for g, p in rows if g == "big"})


# ---- tokens --------------------------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "Hello world's best, 1234 files!!  \n\n x", "naïve — 日本語のテキスト ไทย हिन्दी", "<|endoftext|> it's", "a" * 3000, "\u00a0\u3000 tab\tnew\r\nline", "I'll we've they're don't 'S", "emoji 😀👍🏽 \u200d", "x  y   z "]


@pytest.mark.parametrize("hot", [8 << 20, 300, 0])
def test_encode_equals_library(spark, hot):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)] + [(None, "lost", "")], "doc_id long, text string, words string")
    out = encode(df, hot_bytes=hot)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(TEXTS)}
    assert {r["doc_id"]: r["text"] for r in decode(out).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, hot_bytes=hot).collect()} == {i: len(v) for i, v in got.items()}


def test_encode_takes_the_greatest_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (1, None), (2, "c"), (2, "c")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in decode(encode(df, hot_bytes=20)).collect()} == {1: "c", 2: "c"}
    assert sorted(map(tuple, token_counts(df).collect())) == [(1, 1), (2, 1)]


def test_encode_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- packing -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("task,fan", [(10_000, 8), (20, 8), (7, 2)])
def test_pack(spark, task, fan):
    rnd = random.Random(task)
    items = [(i, rnd.choice([0, None, 3, 40, 99, 100, 101, 250, rnd.randrange(1, 90)])) for i in range(500)] + [(None, 5)]
    rows = pack(spark.createDataFrame(items, "id long, n long"), "id", "n", 100, slack=1, task_items=task, fan=fan).collect()
    parts, fill = {}, {}
    for r in rows:
        parts.setdefault(r["id"], []).append((r["part_no"], r["start_at"], r["size"]))
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
    assert max(fill.values()) <= 100
    for i, n in items:
        if i is None or not n:
            assert i not in parts or i is None
            continue
        p = sorted(parts[i])
        assert sum(s for _, _, s in p) == n and [a for _, a, _ in p] == [100 * k for k in range(len(p))] and all(s == 100 for _, _, s in p[:-1])
        assert len(p) == -(-n // 100)
    total = sum(n for i, n in items if i is not None and n)
    assert len(fill) <= 1.12 * -(-total // 100) + 8
    assert sum(f <= 50 for f in fill.values()) <= 1  # the tree has brought all that is half full or less together


def test_pack_meets_across_partitions(spark):
    """One small item a partition ends in others' containers; hosts of equal fill beyond what can be used stay behind."""
    rows = pack(spark.range(400).select("id", F.when(F.col("id") < 40, 30).otherwise(60).alias("n")), "id", "n", 100, slack=0, task_items=2, fan=2).collect()
    fill = {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
    assert len(rows) == 400 and sum(fill.values()) == 40 * 30 + 360 * 60 and sorted(fill.values())[-40:] == [90] * 40 and len(fill) == 360


def test_pack_what_cannot_meet(spark):
    rows = pack(spark.range(300).select("id", F.lit(60).alias("n")), "id", "n", 100, task_items=50).collect()
    assert len({r["container"] for r in rows}) == 300 == len(rows)
    assert pack(spark.range(0).select("id", F.lit(60).alias("n")), "id", "n", 100).count() == 0


def test_best_fit_is_tight():
    of, free = best_fit(np.array([60, 50, 40, 50]), 100)
    assert sorted(free) == [0, 0] and of[0] == of[2] and of[1] == of[3]


# ---- sentences -----------------------------------------------------------------------------------------------------

CASES = [
    ("Mr. Smith paid approx. 3.5 GB. It failed again... The rest, e.g. videos, is fine!", 3),
    ('"Nothing was copied. The share was offline," the notice said. Did you mean "the other disk?" or the share?', 2),
    ("Files are left out (they change every minute. Nobody misses them). The scan ended.", 2),
    ("Title\n\n- item one. with a stop\n- item two\n1. first\n2. second\n\nText that\nruns on. Second.", 7),
    ("2031-09-25 20:45:54.820 INFO done in 90.4 s. 56 left\n2031-09-25 20:45:55 WARN x", 2),
    ("Der Lauf kam am 7. Mai an. Sie schrieb: „Die Platte ist voll.“ Und nun?", 3),
    ("共享文件夹在9:26跳过了！通知写道：“没有复制任何内容。网络已断开。”第二位恢复了。“磁盘已满。”她说。", 4),
    ("「何もコピーされていません。共有が切れています。」と表示されました。本当に…？", 2),
    ("M. Dupont a noté : « Le disque est plein. » Le dossier a bougé !La suite vient.", 3),
    ("डॉ. मिरानी ने छोड़ीं। फिर से पाईं ।", 2),
    ("Τι έγινε; Ο δίσκος γέμισε.", 2),
    ("ระบบตรวจสอบพบไฟล์ a_1.jpg แล้วค่ะ ไฟล์ซ้ำมี 3 กลุ่มครับ", 2),
    ("L'archivista ha saltato la posta come detto all'art. 1080. La scansione è finita.", 2),
    ("Mr. Quillby found it after 35.3 s, min. 7992, max. 528 under the attic. It ended.", 2),
    ("One pass ended.Nobody moved it. See D:\\mix\\v8.6 and scan.v6.JPG now.", 3),
]


class Always:
    def score(self, c):
        return 1


class Rules:
    """The labels alone, with one answer for what they leave open."""

    def __init__(self, rest):
        self.rest = rest

    def score(self, c):
        y = S.reliable(c)
        return (self.rest if y is None else y) - 0.5


@pytest.fixture(scope="module")
def labelled(sf):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    random.Random(3).shuffle(texts)
    return [e for t in texts for e in S.examples(t)]


@pytest.fixture(scope="module")
def model(labelled):
    cut = len(labelled) * 3 // 4
    return S.MaxEnt().fit([S.places(c) for c, _ in labelled[:cut]], [y for _, y in labelled[:cut]])


@pytest.mark.parametrize("text,n", CASES)
def test_sentences(model, text, n):
    got = S.split(text, model)
    assert len(got) == n, [text[a:b] for a, b in got]
    assert "".join(text[a:b] for a, b in got).split() == text.split() or "".join("".join(text[a:b].split()) for a, b in got) == "".join(text.split())
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in got)


def test_the_model_decides(model):
    """Neither taking every candidate nor the labels alone gives the sentences that the model gives."""
    right = lambda m: sum(len(S.split(t, m)) == n for t, n in CASES)
    assert right(model) == len(CASES)
    assert right(Always()) < 0.6 * len(CASES) and right(Rules(0)) < 0.6 * len(CASES) and right(Rules(1)) < len(CASES)


def test_sentences_without_text(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \u00a0\n\u3000", 0), (4, "A. B", 0), (None, "Lost.", 0), (5, "😀 Done. Next one.", 0)], "doc_id long, text string, start_at int")
    got = sorted(tuple(r) for r in S.sentences(df).collect())
    assert {r[0] for r in got} == {4, 5} and (5, 0, 7) in got and (5, 8, 17) in got
    assert S.sentences(df.where("doc_id > 9")).count() == 0


def test_model_learns_held_out_boundaries(model, labelled):
    hold = labelled[len(labelled) * 3 // 4 :]
    assert sum((model.score(c) > 0) == bool(y) for c, y in hold) / len(hold) > 0.98


def test_tokens_are_whole():
    a, b = "x" * 500, "Y" + "y" * 700
    c = S.candidates(f"one {a}. {b} two", 0, 1210)[0]
    assert (c.before, c.left, c.right) == ("one", a, b)
    c = S.candidates("at 5 p.m. Then", 0, 14)[-1]
    assert (c.left, c.inner, c.before, c.end) == ("m", True, "p", 9)


def test_sample_is_spread_and_bounded(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Mr. A "), "id", F.lit(" went. Then it ended.\n\nA new one begins. Fine")).alias("text"))
    m = S.train(df, "doc_id", "text", sample=200, rows=100)
    assert np.count_nonzero(m.weights)
    given = S.sentences(df, model=m)
    assert given.count() == 4 * 4000


def test_long_texts_take_time_in_proportion():
    import time

    for unit in ("word ", "a.b", "( ", '"x. ', "AB ", "((((", "- x\n", "1E E7 ", "ก ข ", ". ", "a. (b) ", "x.) "):
        t = time.time()
        S.split(unit * (60_000 // len(unit)), S.MaxEnt())
        assert time.time() - t < 15, unit
