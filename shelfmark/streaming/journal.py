"""Keeping a table of present files up to date from a stream of journal records.

The state of a file is what can be merged in any order: the last creation, the last deletion, the last record, and for
every value the last record that carried it. A micro-batch is reduced to such rows and merged with those of the state,
so records that come late, out of order or again, in one batch or over many, give what a replay of the whole feed
gives. The state is spread over buckets of keys; a batch rewrites only the buckets it has records for.

A pointer file for each batch names the version of every bucket. It is written beside the older ones and appears by
one rename, so at any moment the newest complete pointer is the state: a crash leaves the one before. Versions and
pointers that the last few pointers don't name are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changefeed import CREATE_BIT, DELETE_BIT

VALUES = ("parent_ref", "name", "size", "modified_at", "attrs")
KEY = ("volume_id", "file_ref")
SEQUENCE = ("journal_id", "usn")


class FileState:
    """The versioned state under `path` (a folder that all executors share), in `buckets` of keys; the `keep` last pointers stay readable."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 3):
        self.spark, self.path, self.buckets, self.keep = spark, path.rstrip("/"), buckets, keep

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        fs = self._fs()
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _pointers(self) -> list[str]:
        return [n for n in self._names() if n.startswith("pointer-") and not n.endswith(".new")]

    def _load(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def pointer(self) -> dict:
        """The newest complete pointer: the batch it belongs to, and the version of each bucket."""
        names = self._pointers()
        return self._load(names[-1]) if names else {"batch": -1, "buckets": {}}

    def _point(self, to: dict) -> None:
        fs, name = self._fs(), f"pointer-{to['batch']:015d}"
        out = fs.create(self._at(name + ".new"), True)
        out.write(bytearray(json.dumps(to).encode()))
        out.close()
        if not fs.rename(self._at(name + ".new"), self._at(name)):
            raise OSError(f"{name} could not be put in place")

    def clean(self) -> None:
        """Deletes what the last pointers don't name, torn writes of earlier runs included."""
        fs, names = self._fs(), self._pointers()
        for n in names[: -self.keep]:
            fs.delete(self._at(n), False)
        used = {f"v{v}/bucket={b}" for n in names[-self.keep :] for b, v in self._load(n)["buckets"].items()}
        versions = [v for v in self._names() if v.startswith("v")]
        for v in versions:
            there = [f"{v}/{b}" for b in self._names(v) if b.startswith("bucket=")]
            for b in there:
                if b not in used:
                    fs.delete(self._at(b), True)
            if not used & set(there):
                fs.delete(self._at(v), True)

    def _rows(self, buckets: dict[str, int]) -> DataFrame | None:
        if not buckets:
            return None
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*[f"{self.path}/v{v}/bucket={b}" for b, v in sorted(buckets.items())])

    def read(self) -> DataFrame | None:
        """The files that are present: key, sequence of the last record applied, values; None before the first batch."""
        rows = self._rows(self.pointer()["buckets"])
        if rows is None:
            return None
        made = rows.where(F.col("made").isNotNull() & (F.col("gone").isNull() | (F.col("made") > F.col("gone"))))
        value = lambda v: F.when(F.col(f"of_{v}.at") >= F.col("made"), F.col(f"of_{v}.value")).alias(v)
        return made.select(*KEY, "last.*", *[value(v) for v in VALUES])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch. A batch that was applied already changes nothing; records with a null in key or sequence don't count."""
        now = self.pointer()
        if batch_id <= now["batch"]:
            return
        known = F.lit(True)
        for n in (*KEY, *SEQUENCE):
            known = known & F.col(n).isNotNull()
        at, reason = F.struct(*SEQUENCE), F.coalesce("reason", F.lit(0)).cast("long")
        ends = reason.bitwiseAND(DELETE_BIT) != 0
        carried = lambda v: F.max(F.when(~ends & F.col(v).isNotNull(), F.struct(at.alias("at"), F.col(v).alias("value")))).alias(f"of_{v}")
        news = batch.where(known).groupBy(*KEY).agg(
            F.max(F.when(~ends & (reason.bitwiseAND(CREATE_BIT) != 0), at)).alias("made"), F.max(F.when(ends, at)).alias("gone"), F.max(at).alias("last"), *[carried(v) for v in VALUES])
        news = news.withColumn("bucket", F.pmod(F.xxhash64(F.lit(29), *KEY), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = [r["bucket"] for r in news.select("bucket").distinct().collect()]  # at most `buckets` rows
            old = self._rows({str(b): now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]})
            both = news.drop("bucket") if old is None else news.drop("bucket").unionByName(old)
            merge: list[Column] = [F.max(n).alias(n) for n in ("made", "gone", "last", *[f"of_{v}" for v in VALUES])]
            merged = both.groupBy(*KEY).agg(*merge).withColumn("bucket", F.pmod(F.xxhash64(F.lit(29), *KEY), F.lit(self.buckets)).cast("int"))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{batch_id}")
        finally:
            news.unpersist()
        self._point({"batch": batch_id, "buckets": now["buckets"] | {str(b): batch_id for b in touched}})
        self.clean()


def follow(records: DataFrame, state: FileState, checkpoint: str, every: str | None = "15 seconds"):
    """Starts the query; `every` None takes what is there and stops."""
    w = records.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)).start()


def position_lost(positions: DataFrame, journals: DataFrame) -> DataFrame:
    """`id, lost`: volumes that must be read in full, as their journal was created anew or its records start after the position.

    `journals`: id, journal_id, first_usn, next_usn as the disk says now.
    """
    j = positions.select("id", F.col("journal_id").alias("j0"), F.col("next_usn").alias("u0")).join(journals, "id")
    why = F.when(F.col("j0").isNull() | F.col("u0").isNull(), "no_position").when(F.col("j0") != F.col("journal_id"), "recreated").when(F.col("u0") < F.col("first_usn"), "overwritten").when(F.col("u0") > F.col("next_usn"), "ahead")
    return j.select("id", why.alias("lost")).where("lost IS NOT NULL")
