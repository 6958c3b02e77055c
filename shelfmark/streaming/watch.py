"""Streams of changed paths, of disk readings and of actions: batches, alarms, thinning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.health import DAY_MS, SEVERITY


def path_batches(paths: DataFrame, quiet: str = "500 milliseconds", late: str = "5 seconds") -> DataFrame:
    """Changed paths (volume_id, path, at) in batches that a quiet time ends: number of records and of different paths; works on streams and tables."""
    return paths.withWatermark("at", late).groupBy("volume_id", F.session_window("at", quiet).alias("w")).agg(F.count("*").alias("records"), F.size(F.collect_set("path")).cast("long").alias("paths")).select("volume_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "records", "paths")


def distinct_paths(paths: DataFrame, within: str = "5 seconds") -> DataFrame:
    """Each changed path once in the given time."""
    return paths.withWatermark("at", within).dropDuplicatesWithinWatermark(["volume_id", "path"])


def overflowed(batches: DataFrame, most: int = 10_000) -> DataFrame:
    """Batches too large to follow path by path: the volume is read in full."""
    return batches.where(F.col("records") > most).select("volume_id", "since", F.lit(True).alias("rescan"))


STATE = "at_ms long, status string, reallocated long"
OUT = "disk_key string, at_ms long, status string, reallocated long, keep boolean, reason string"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    for f in frames:
        out = []
        for r in f.sort_values(["at_ms", "reading_no"]).itertuples():
            rank = SEVERITY.index(r.status) if r.status in SEVERITY else 0
            if last is None:
                reason = "status" if r.status == "critical" else None
            else:
                before = SEVERITY.index(last[1]) if last[1] in SEVERITY else 0
                reason = "status" if before and rank > before else "reallocated" if r.reallocated > last[2] else None
            keep = last is None or (r.status, r.reallocated) != (last[1], last[2]) or r.at_ms - last[0] >= DAY_MS
            if keep:
                last = (int(r.at_ms), r.status, int(r.reallocated))
            out.append((key[0], int(r.at_ms), r.status, int(r.reallocated), keep, reason))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["disk_key", "at_ms", "status", "reallocated", "keep", "reason"])


def follow_health(readings: DataFrame) -> DataFrame:
    """Each reading of a stream with whether the history keeps it and why it is an alarm, compared with the last kept one of its disk."""
    return readings.select("disk_key", "at_ms", "reading_no", "status", "reallocated").groupBy("disk_key").applyInPandasWithState(_follow, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
