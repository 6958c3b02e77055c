"""A catalog derived from the star schema, with a clean tree and known times, beside the catalog's own tables.

Regions are volumes, nations, customers and suppliers are folders, orders are files; documents are files with content,
events are disk readings and logged actions. The SQL of the queries derives the same rows on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the derivation: extension by the first digit of an order's priority.
EXTENSIONS = {"1": "pdf", "2": "jpg", "3": "mp4", "4": "zip", "5": "xyz"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the derived catalog: id, volume_id, parent_id, name, is_dir, size, alloc_size, modified_ms, attrs."""
    t = lambda n: table(spark, d, n)
    no = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")

    def folder(df, id, volume, parent, name):
        return df.select(id.cast("long").alias("id"), volume.cast("long").alias("volume_id"), parent.cast("long").alias("parent_id"), name.alias("name"), F.lit(True).alias("is_dir"), zero.alias("size"), zero.alias("alloc_size"), no.alias("modified_ms"), F.lit(16).cast("long").alias("attrs"))

    c = F.col
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    of = nation.select(c("n_nationkey").alias("nk"), (c("n_regionkey") + 1).alias("vol"))
    customer = t("customer").join(of, c("c_nationkey") == c("nk"))
    parts = [
        folder(t("region"), c("r_regionkey") + 1, c("r_regionkey") + 1, no, F.lit("")),
        folder(nation, c("n_nationkey") + 1000, c("n_regionkey") + 1, c("n_regionkey") + 1, c("n_name")),
        folder(customer, c("c_custkey") + 1_000_000, c("vol"), c("c_nationkey") + 1000, c("c_name")),
        folder(t("supplier").join(of, c("s_nationkey") == c("nk")), c("s_suppkey") + 2_000_000, c("vol"), c("s_nationkey") + 1000, c("s_name")),
    ]
    ext = F.lit("xyz")
    for digit, e in EXTENSIONS.items():
        ext = F.when(c("o_orderpriority").startswith(digit), e).otherwise(ext)
    size = F.floor(c("o_totalprice") * 100).cast("long")
    orders = t("orders").join(customer.select("c_custkey", "vol"), c("o_custkey") == c("c_custkey")).select(
        (c("o_orderkey") + 10_000_000).alias("id"), c("vol").cast("long").alias("volume_id"), (c("o_custkey") + 1_000_000).alias("parent_id"),
        F.concat(F.lit("order_"), c("o_orderkey").cast("string"), F.lit("."), ext).alias("name"), F.lit(False).alias("is_dir"), size.alias("size"), size.alias("alloc_size"),
        F.unix_millis(c("o_orderdate").cast("timestamp")).alias("modified_ms"), F.when(c("o_orderstatus") == "P", 4096).otherwise(0).cast("long").alias("attrs"),
    )
    out = parts[0]
    for p in [*parts[1:], orders]:
        out = out.unionByName(p)
    return out


def content_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: id, volume_id, name, path, size, modified, quick, full; texts that are null have no hash."""
    c = F.col
    name = F.concat(F.regexp_replace(F.coalesce("source", F.lit("none")), "[/]", "-"), F.lit("_"), c("doc_id").cast("string"), F.lit("."), F.coalesce("lang", F.lit("txt")))
    text = F.coalesce("text", F.lit(""))
    n = F.coalesce("n_chars", F.lit(0))
    return table(spark, d, "documents").select(
        (c("doc_id") + 20_000_000).alias("id"), (c("doc_id") % 5 + 1).alias("volume_id"), name.alias("name"), F.concat(F.coalesce("source", F.lit("none")), F.lit("\\"), name).alias("path"),
        n.alias("size"), (c("doc_id") * 1000).alias("modified"), F.when(c("text").isNotNull(), F.md5(F.concat(n.cast("string"), F.substring(text, 1, 65536), F.right(text, F.lit(65536))).cast("binary"))).alias("quick"),
        F.when(c("text").isNotNull(), F.sha2(text.cast("binary"), 256)).alias("full"), (c("doc_id") % 5 % 2 == 0).alias("online"), c("doc_id"),
    )


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Events as disk readings: disk_key, reading_no, at_ms, status, reallocated."""
    c = F.col
    status = F.when(c("event_type") == "error", "critical").when(c("event_type") == "purchase", "warning").otherwise("good")
    return table(spark, d, "events").select(F.concat(F.lit("disk-"), c("user_id").cast("string")).alias("disk_key"), c("event_id").alias("reading_no"), F.unix_millis(c("ts").cast("timestamp")).alias("at_ms"), status.alias("status"), F.floor(F.abs("value")).cast("long").alias("reallocated"))


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Events as the log of actions: id, at_ms, action, volume_id, size, outcome."""
    c = F.col
    outcome = F.element_at(F.array(*map(F.lit, ["done", "skipped_changed", "skipped_missing", "failed"])), (c("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select(c("event_id").alias("id"), F.unix_millis(c("ts").cast("timestamp")).alias("at_ms"), c("event_type").alias("action"), (c("user_id") % 5 + 1).alias("volume_id"), F.floor(F.abs(c("value")) * 100).cast("long").alias("size"), outcome.alias("outcome"))


def vector_prints(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 63-bit prints: bit i says whether element i is below element i+1."""
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("long"), lambda s, i: s + F.when(F.get("embedding", i) < F.get("embedding", i + 1), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("print"))
