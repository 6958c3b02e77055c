"""The log of actions: batches, outcomes, failures, streaks, remaining times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 60_000


def newest(log: DataFrame, n: int = 1000) -> DataFrame:
    return log.orderBy(F.desc("at_ms"), F.desc("id")).limit(n)


def batches(log: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Runs of consecutive records (newest first) of one action on one volume with at most a minute between them.

    Only a record's neighbour matters, so records are numbered within ranges of time: the window runs per hour, over
    the hour's records and the one before it, instead of over the whole log in one task.
    """
    hour = F.floor(F.col("at_ms") / 3_600_000)
    df = log.withColumn("hour", hour)
    ends = df.groupBy("hour").agg(F.max_by(F.struct("id", "at_ms", "action", "volume_id"), F.struct("at_ms", "id")).alias("last"))
    # the last record of the nearest earlier hour that has any: hours are few (one row each)
    prev = ends.select("hour", F.lag("last").over(Window.orderBy("hour")).alias("prev"))
    w = Window.partitionBy("hour").orderBy("at_ms", "id")
    df = df.join(prev, "hour").withColumn("p", F.coalesce(F.lag(F.struct("id", "at_ms", "action", "volume_id")).over(w), F.col("prev")))
    p = F.col("p")
    starts = p.isNull() | (p["action"] != F.col("action")) | (p["volume_id"] != F.col("volume_id")) | (F.col("at_ms") - p["at_ms"] > gap_ms)
    df = df.withColumn("_s", starts.cast("long"))
    sums = df.groupBy("hour").agg(F.sum("_s").alias("k"))
    base = sums.select("hour", (F.sum("k").over(Window.orderBy("hour")) - F.col("k")).alias("base"))
    df = df.join(base, "hour").withColumn("batch", F.col("base") + F.sum("_s").over(w))
    done, failed = F.col("outcome") == "done", F.col("outcome") == "failed"
    return df.groupBy("batch").agg(
        F.max("at_ms").alias("at_ms"), F.first("action").alias("action"), F.first("volume_id").alias("volume_id"), F.count_if(done).alias("done"),
        F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(~done & ~failed).alias("skipped"), F.count_if(failed).alias("failed")).drop("batch")


def outcomes(log: DataFrame) -> DataFrame:
    return log.groupBy("action", "outcome").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def most_frequent(rows: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The most frequent values with their counts; ties by value."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def failure_streaks(log: DataFrame, key: str = "volume_id") -> DataFrame:
    """Runs of failures per key without anything else between: first and last time, length."""
    w = Window.partitionBy(key).orderBy("at_ms", "id")
    df = log.withColumn("_ok", F.sum((F.col("outcome") != "failed").cast("long")).over(w))
    return df.where("outcome = 'failed'").groupBy(key, "_ok").agg(F.min("at_ms").alias("since"), F.max("at_ms").alias("until"), F.count("*").alias("failures")).drop("_ok")


def remaining(samples: DataFrame, settle_ms: int = 15_000) -> DataFrame:
    """Milliseconds left of each job: what remains over the speed since its phase began, after some seconds of it.

    `samples`: job, phase, at_ms, done, total. Null where the phase is young or nothing has moved.
    """
    g = samples.groupBy("job", "phase").agg(F.min_by(F.struct("at_ms", "done"), F.struct("at_ms", "done")).alias("a"), F.max_by(F.struct("at_ms", "done", "total"), F.struct("at_ms", "done")).alias("b"))
    dt, dn = F.col("b.at_ms") - F.col("a.at_ms"), F.col("b.done") - F.col("a.done")
    eta = F.floor((F.col("b.total") - F.col("b.done")) * dt / dn).cast("long")
    return g.select("job", "phase", F.when((dt >= settle_ms) & (dn > 0), eta).alias("eta_ms"))
