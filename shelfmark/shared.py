"""Tables written to the folder that all executors share: the only way this library cuts lineage.

The folder is `spark.checkpoint.dir` of the session. Where a session has none (tests on one machine), a temporary
folder of this machine is used; a cluster must set it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: str | None = None
_KEPT: dict[str, SparkSession] = {}  # folders of tables that may still be read


def shared_dir(spark: SparkSession) -> str:
    global _LOCAL
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="shelfmark-")
    return _LOCAL


class Scratch:
    """Intermediate tables of one run of an operator, as Parquet files in the shared folder.

    A saved table survives the loss of executors and is read back with column pruning. `drop` removes a table that no
    later step reads. What is left belongs to results that may still be read: `clear_scratch` removes it once they
    have been, or the end of Python does.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        self._n = 0
        _KEPT[self.root] = spark

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._shelfmark_path = path
        return back

    def together(self, *tables: DataFrame) -> DataFrame:
        """Saved tables of one schema as one scan, whose small files share tasks."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._shelfmark_path for t in tables])

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._shelfmark_path)

    def settle(self) -> None:
        """Lets go of the shuffle files behind what has been saved: Spark keeps them until the driver collects its garbage."""
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch() -> int:
    """Removes the intermediate tables of all operators run so far and says of how many runs; their results must have been written or collected. For sessions that go on."""
    n = 0
    while _KEPT:
        root, spark = _KEPT.popitem()
        try:
            _delete(spark, root)
            n += 1
        except Exception:  # the session has ended; its folder belongs to the cluster
            pass
    return n


atexit.register(clear_scratch)


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df`, spread over all cores if it comes in fewer partitions than there are: for work in Python on a scan, which takes far longer than the shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def numbered(df: DataFrame, by: list[Column], to: str) -> DataFrame:
    """`df` with the place of each row in the order `by`, from 1.

    Rows are range-partitioned, numbered within their partition and moved by the sizes of the partitions before it. The
    partitions are written once, as a second sampling could cut them elsewhere; only one row per partition meets in a
    window.
    """
    at = F.col("_at")
    parts = Scratch(df.sparkSession, "numbered").save(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    parts = parts.withColumns({"_part": F.shiftright(at, 33), "_n": at.bitwiseAND((1 << 33) - 1)})
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn(to, F.col("_before") + F.col("_n") + 1).drop("_at", "_part", "_n", "_before")


def small_side(df: DataFrame, rows: int, max_rows: int = 100_000) -> DataFrame:
    """`df` with a broadcast hint if its counted `rows` stay under `max_rows`; else `df`, for a shuffled join."""
    return F.broadcast(df) if rows <= max_rows else df


def lookup_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", hot_rows: int = 2_000_000, left_rows: int | None = None) -> DataFrame:
    """Join to a `right` with one row per `on`, where single keys may hold a large share of `left`.

    Keys with more than `hot_rows` rows of `left` (so fewer than left_rows / hot_rows keys: a bound by construction)
    meet their `right` row by broadcast and never move; all other keys are joined by shuffle. With `left_rows` known
    to be at most `hot_rows` no key can be hot and the plain join is used.
    """
    if left_rows is not None and left_rows <= hot_rows:
        return left.join(right, on, how)
    hot = left.where(F.col(on).isNotNull()).groupBy(on).count().where(F.col("count") > hot_rows).select(on, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(hot), on, "left")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, on, how)
    warm = marked.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, how)
    return cold.unionByName(warm)
