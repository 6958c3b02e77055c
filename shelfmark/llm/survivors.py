"""One surviving record for each group of duplicates, by token consensus.

`consensus_values` aligns the tokens of a group's values progressively, lets weighted tokens vote column by column, and
emits the existing value closest to the consensus. It works on chunks of a bounded number of different values whose
profiles are merged in a tree, so a group of any size spreads over many tasks. Weights are given, or follow from an
order of precedence in which each copy outweighs all later ones; `file_survivors` builds a record that way.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch, lookup_join

#: Fixed: the characters of Unicode's White_Space property, as a class for Java's and Python's regular expressions.
WHITE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def latest(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Of each non-null key the row with the latest `at`; of equally late ones the greatest, so any order of rows gives the same."""
    pick = F.max(F.struct(F.col(at).alias("_at"), *columns)).alias("_r")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(pick).select(key, *[f"_r.{c}" for c in columns])


TOKEN = re.compile(r"[\\/]|[^\W\d_]+|\d+|[^\w\\/]|_")
GAP = ""
MISMATCH = 0.7  # less than two gaps of 0.4, so that different tokens in one place share a column and a profile doesn't grow with each


def tokens(value: str) -> list[str]:
    return TOKEN.findall(value)


def align(profile: list[dict[str, float]], other: list[dict[str, float]]) -> list[dict[str, float]]:
    """The columns of two profiles merged along their best global alignment (Needleman-Wunsch over expected matches)."""
    wa = sum(profile[0].values()) if profile else 0.0
    wb = sum(other[0].values()) if other else 0.0
    n, m = len(profile), len(other)
    alike = lambda x, y: len(x) == 1 and x.keys() == y.keys()
    lo, hi = 0, 0
    while lo < min(n, m) and alike(profile[lo], other[lo]):
        lo += 1  # a common beginning needs no search
    while hi < min(n, m) - lo and alike(profile[n - 1 - hi], other[m - 1 - hi]):
        hi += 1  # nor does a common end
    a, b = profile[lo : n - hi], other[lo : m - hi]
    inv = 2 / (wa * wb) if wa and wb else 0.0
    ones = [next(iter(y.items())) if len(y) == 1 else None for y in b]
    match = []  # what it brings to put column i beside column j
    for x in a:
        row = []
        for y, one in zip(b, ones):
            if one is not None:
                same = x.get(one[0], 0.0) * one[1]
            else:
                few, many = (x, y) if len(x) < len(y) else (y, x)
                same = sum(v * many[k] for k, v in few.items() if k in many)
            row.append(same * inv - MISMATCH)
        match.append(row)
    best = [[-0.4 * j for j in range(len(b) + 1)]]
    for i, got in enumerate(match, 1):
        above, left = best[-1], -0.4 * i
        row = [left]
        for j, bring in enumerate(got):
            up, across = above[j] + bring, above[j + 1] - 0.4
            left -= 0.4
            left = up if up >= across and up >= left else across if across >= left else left
            row.append(left)
        best.append(row)
    out, i, j = [], len(a), len(b)
    while i or j:
        here = best[i][j]
        if i and j and abs(here - best[i - 1][j - 1] - match[i - 1][j - 1]) < 1e-9:
            x, y = a[i - 1], b[j - 1]
            out.append({k: x.get(k, 0.0) + y.get(k, 0.0) for k in x.keys() | y.keys()})
            i, j = i - 1, j - 1
        elif i and abs(here - best[i - 1][j] + 0.4) < 1e-9:
            x = dict(a[i - 1])
            x[GAP] = x.get(GAP, 0.0) + wb
            out.append(x)
            i -= 1
        else:
            y = dict(b[j - 1])
            y[GAP] = y.get(GAP, 0.0) + wa
            out.append(y)
            j -= 1
    both = [{k: v + y.get(k, 0.0) for k, v in x.items()} for x, y in [*zip(profile[:lo], other[:lo]), *zip(profile[n - hi :], other[m - hi :])]]
    return both[:lo] + out[::-1] + both[lo:]


def vote(profile: list[dict[str, float]]) -> list[str]:
    """The heaviest token of every column (of equal ones the greatest), gaps left out."""
    return [t for c in profile if (t := max(c.items(), key=lambda kv: (round(kv[1], 6), kv[0]))[0]) != GAP]


def edit_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def consensus_values(rows: DataFrame, group: str, value: str, weight: Column | None = None, precedence: list[Column] | None = None, chunk: int = 64, fan: int = 16, hot_rows: int = 2_000_000) -> DataFrame:
    """`group, consensus, value, distance, n_values`: per group the existing value closest to its token consensus.

    `weight` (default 1) weighs a row's vote; rows with a null group or value, and weights not above zero, don't vote.
    With a `precedence` (ascending; at most a LONG each) instead, an earlier row outweighs all later ones together: in
    that order each counts a sixteenth of the one before, in a chunk as among chunks. Values are aligned heaviest or
    first ones first; of equally close values the heaviest or first, then the least wins. An empty value is a value
    without tokens. `chunk`: different values aligned in one task; `fan`: profiles merged in one step.
    """
    scratch = Scratch(rows.sparkSession, "consensus")
    value_name = value
    kind = rows.schema[group].dataType.simpleString()
    if precedence is None:
        w = F.lit(1.0) if weight is None else weight.cast("double")
        v = rows.select(F.col(group).alias("g"), F.col(value).alias("v"), w.alias("w")).where("g IS NOT NULL AND v IS NOT NULL AND w > 0").groupBy("g", "v").agg(F.sum("w").alias("w"))
        v = v.select("g", "v", "w", F.array((-F.col("w") * 1000).cast("long")).alias("r"))
    else:
        v = rows.select(F.col(group).alias("g"), F.col(value).alias("v"), F.array(*[p.cast("long") for p in precedence]).alias("r")).where("g IS NOT NULL AND v IS NOT NULL")
        v = v.groupBy("g", "v").agg(F.min("r").alias("r")).select("g", "v", F.lit(1.0).alias("w"), "r")
    v = scratch.save(v)
    n_values = v.count()
    sizes = v.groupBy("g").agg(F.count("*").alias("n"))
    part = scratch.save(lookup_join(v, sizes, "g", "inner", hot_rows, n_values))
    alone = part.where("n = 1").select("g", F.col("v").alias("consensus"), "v", F.lit(0).cast("long").alias("d"), F.lit(1).cast("long").alias("n"))
    part = part.where("n > 1")
    falls = precedence is not None
    won = f"g {kind}, tokens array<string>, consensus string"
    single = lambda r: [{t: r["w"]} for t in tokens(r["v"])]
    # groups of one chunk vote where they are aligned; profiles of the others meet in a tree
    few = part.where(F.col("n") <= chunk).select("g", F.lit(0).cast("long").alias("c"), "r", "v", "w")
    voted = [few.repartition("g").sortWithinPartitions("g", "r", "v").mapInArrow(_fold(single, falls, True), won)]
    many = part.where(F.col("n") > chunk).withColumn("c", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / chunk)).cast("long")).select("g", "c", "r", "v", "w")
    profiles = scratch.save(many.repartition("g", "c").sortWithinPartitions("g", "c", "r", "v").mapInArrow(_fold(single, falls, False), f"g {kind}, c long, r array<bigint>, profile string"))
    while profiles.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        up = profiles.withColumn("c", F.floor(F.col("c") / fan)).repartition("g", "c").sortWithinPartitions("g", "c", "r", "profile")
        profiles = scratch.save(up.mapInArrow(_fold(lambda r: json.loads(r["profile"]), falls, False), profiles.schema))
    voted.append(profiles.mapInArrow(_voted, won))
    voted = scratch.save(voted[0].unionByName(voted[1]))
    # a value that equals the consensus is the closest one; distances are only measured where there is none
    equal = scratch.save(part.select("g", "v", "r", "n").join(voted.select("g", F.col("consensus").alias("v")), ["g", "v"]))
    open_ = voted.join(equal.select("g"), "g", "left_anti")
    near = lookup_join(part.select("g", "v", "r", "n"), open_, "g", "inner", hot_rows, n_values).mapInArrow(_near, f"g {kind}, v string, r array<bigint>, n long, d long, consensus string")
    best = near.groupBy("g").agg(F.min(F.struct("d", "r", "v")).alias("b"), F.max("consensus").alias("consensus"), F.max("n").alias("n"))
    best = best.select("g", "consensus", F.col("b")["v"].alias("v"), F.col("b")["d"].alias("d"), "n").unionByName(alone)
    best = best.unionByName(equal.select("g", F.col("v").alias("consensus"), "v", F.lit(0).cast("long").alias("d"), "n"))
    return best.select(F.col("g").alias(group), "consensus", F.col("v").alias(value_name), F.col("d").alias("distance"), F.col("n").alias("n_values"))


def _fold(read, falls: bool, last: bool):
    """Profiles of the runs of equal (g, c), the first row's r with each, or with `last` what they vote for; holds one profile at a time. `falls`: each row weighs a sixteenth of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rank, profile, scale, done, schema = None, None, [], 1.0, [], None

        def batch() -> pa.RecordBatch:
            g, c, r, p = zip(*done)
            done.clear()
            if last:
                return pa.RecordBatch.from_arrays([pa.array(g, schema.field("g").type), pa.array(p, pa.list_(pa.string())), pa.array(["".join(t) for t in p])], names=["g", "tokens", "consensus"])
            return pa.RecordBatch.from_arrays([pa.array(g, schema.field("g").type), pa.array(c, pa.int64()), pa.array(r, pa.list_(pa.int64())), pa.array(p, pa.string())], names=["g", "c", "r", "profile"])

        for b in batches:
            schema = b.schema
            for r in b.to_pylist():
                if (r["g"], r["c"]) != at:
                    if at is not None:
                        done.append((*at, rank, vote(profile) if last else json.dumps(profile)))
                    at, rank, profile, scale = (r["g"], r["c"]), r["r"], read(r), 1.0
                else:
                    other = read(r)
                    if falls:
                        scale /= 16
                        other = [{k: x * scale for k, x in c.items()} for c in other]
                    profile = align(profile, other)
                if len(done) >= 1000:
                    yield batch()
        if at is not None:
            done.append((*at, rank, vote(profile) if last else json.dumps(profile)))
            yield batch()

    return run


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        won = [vote(json.loads(p)) for p in b.column(b.schema.get_field_index("profile")).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("g")), pa.array(won, pa.list_(pa.string())), pa.array(["".join(t) for t in won])], names=["g", "tokens", "consensus"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = lambda n: b.column(b.schema.get_field_index(n))  # noqa: E731, B023
        d = [edit_distance(tokens(v), won) for v, won in zip(col("v").to_pylist(), col("tokens").to_pylist())]
        yield pa.RecordBatch.from_arrays([col("g"), col("v"), col("r"), col("n"), pa.array(d, pa.int64()), col("consensus")], names=["g", "v", "r", "n", "d", "consensus"])


def file_survivors(listings: DataFrame, chunk: int = 64, fan: int = 16, hot_rows: int = 2_000_000) -> DataFrame:
    """The surviving file of each content: `size, full_hash, entry_id, path_from, modified_from`.

    Of an entry only its latest listing counts. Content is size and hash (hex digits in lower case); a null or blank
    hash or a null size is no content. Copies rank online, unknown, offline; then latest modified (null, zero and
    negative are unknown, last); then least entry_id. A path of white space only is none.

    The path is the consensus of the copies' paths, aligned token by token, where a copy outweighs all that rank after
    it; path_from is the first copy that has the existing path closest to it. The entry and its time are one token
    each, so nothing is to be aligned and the vote is the heaviest copy's.
    """
    scratch = Scratch(listings.sparkSession, "survivors")
    rows = latest(listings, "entry_id", "seen_at", ["size", "full_hash", "path", "modified", "online"])
    rows = rows.select("size", F.nullif(F.lower(F.trim("full_hash")), F.lit("")).alias("full_hash"), "entry_id", "path", "modified", "online").where("size IS NOT NULL AND full_hash IS NOT NULL")
    known = F.col("modified") > 0
    order = [F.when(F.col("online"), 0).when(F.col("online").isNull(), 1).otherwise(2), F.when(known, -F.col("modified")).otherwise(F.lit(1)), F.col("entry_id")]
    rows = scratch.save(rows.select(F.concat_ws("-", "size", "full_hash").alias("g"), "size", "full_hash", F.array(*[c.cast("long") for c in order]).alias("rank"), F.when(F.col("path").rlike(f"[^{WHITE}]"), F.col("path")).alias("path"), known.alias("known")))
    id = lambda c: F.element_at(c, -1)
    first = rows.groupBy("g", "size", "full_hash").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.min(F.when(F.col("known"), F.col("rank"))).alias("dated")).where("n > 1")
    first = scratch.save(first.select("g", "size", "full_hash", id(F.col("first")).alias("entry_id"), F.coalesce(id(F.col("dated")), F.lit(0)).alias("modified_from")))
    several = scratch.save(rows.where("path IS NOT NULL").select("g", "path", "rank").join(first.select("g"), "g", "left_semi"))
    chosen = consensus_values(several, "g", "path", precedence=[F.element_at("rank", i) for i in (1, 2, 3)], chunk=chunk, fan=fan, hot_rows=hot_rows).select("g", "path")
    holder = several.select("g", "path", "rank").join(chosen, ["g", "path"]).groupBy("g").agg(F.min("rank").alias("r")).select("g", id(F.col("r")).alias("path_from"))
    return first.join(holder, "g", "left").select("size", "full_hash", "entry_id", F.coalesce("path_from", F.lit(0)).cast("long").alias("path_from"), "modified_from")
