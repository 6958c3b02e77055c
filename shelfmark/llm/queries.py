"""Queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries import table
from .components import components
from ..shared import Scratch
from .packing import pack
from .sentences import sentences
from .survivors import consensus_values, file_survivors, latest
from .tokens import decode, encode, token_counts
from .topn import top_n

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query(
    "p3_found",
    """
WITH RECURSIVE u AS (SELECT DISTINCT entry_id FROM image_prints WHERE dhash <> 0),
e AS (SELECT DISTINCT entry_a AS a, entry_b AS b FROM print_pairs WHERE distance <= 6 AND entry_a <> entry_b AND entry_a IN (FROM u) AND entry_b IN (FROM u)),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS entry_id, a AS near FROM b UNION SELECT r.entry_id, b.b FROM r JOIN b ON b.a = r.near)
SELECT entry_id, min(near) AS group_id FROM r GROUP BY entry_id
""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = table(spark, sf_dir, "image_prints").where("dhash <> 0").select(F.col("entry_id").alias("id")).distinct()
    pairs = table(spark, sf_dir, "print_pairs").where("distance <= 6").select("entry_a", "entry_b")
    pairs = pairs.join(usable, pairs.entry_a == usable.id, "left_semi").join(usable, pairs.entry_b == usable.id, "left_semi")
    return components(pairs, "entry_a", "entry_b").select(F.col("v").alias("entry_id"), "group_id")


@query(
    "p5_found",
    """
WITH l AS (SELECT DISTINCT * FROM dup_files QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY seen_at DESC) = 1),
c AS (SELECT size, lower(full_hash) AS full_hash, entry_id, regexp_full_match(coalesce(path, ''), '[\\s\\p{Z}]*') AS no_path, modified,
  row_number() OVER (PARTITION BY size, lower(full_hash) ORDER BY CASE WHEN online THEN 0 WHEN online IS NULL THEN 1 ELSE 2 END,
    CASE WHEN modified > 0 THEN modified ELSE 0 END DESC, entry_id) AS pos FROM l WHERE full_hash IS NOT NULL)
SELECT size, full_hash, min_by(entry_id, pos) AS entry_id, coalesce(min_by(entry_id, pos) FILTER (NOT no_path), 0) AS path_from,
  coalesce(min_by(entry_id, pos) FILTER (modified > 0), 0) AS modified_from FROM c GROUP BY size, full_hash HAVING count(*) > 1
""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_survivors(table(spark, sf_dir, "dup_files"))


@query("p5_consensus")
def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of each content that its copies agree on most; an online copy's vote weighs double."""
    rows = latest(table(spark, sf_dir, "dup_files"), "entry_id", "seen_at", ["size", "full_hash", "path", "online"])
    rows = rows.where("size IS NOT NULL AND full_hash IS NOT NULL AND trim(path) <> ''").select(F.concat_ws("-", "size", F.lower("full_hash")).alias("content"), "path", "online")
    return consensus_values(rows, "content", "path", F.when(F.col("online"), 2.0).otherwise(1.0))


@query(
    "p6_found",
    """
WITH e AS (SELECT DISTINCT e.parent_id, e.id, e.name, CASE WHEN e.is_dir THEN d.total_size ELSE e.size END AS size
  FROM entries e LEFT JOIN (SELECT DISTINCT * FROM dir_stats) d ON d.entry_id = e.id WHERE e.parent_id IS NOT NULL)
SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY size DESC, encode(coalesce(name, '')), id) AS pos FROM e WHERE size IS NOT NULL QUALIFY pos <= 5
""",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry of unknown kind counts as a file; of differing totals of one folder the largest holds."""
    e = table(spark, sf_dir, "entries").where("parent_id IS NOT NULL")
    totals = table(spark, sf_dir, "dir_stats").groupBy(F.col("entry_id").alias("id")).agg(F.max("total_size").alias("total"))
    files = e.where("NOT coalesce(is_dir, false)").select("parent_id", "id", "name", "size")
    folders = e.where("is_dir").select("parent_id", "id", "name").join(totals, "id").select("parent_id", "id", "name", F.col("total").alias("size"))
    return top_n(files.unionByName(folders), "parent_id", "id", "size", "name", 5)


@query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


@query("p7_round_trip")
def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: its number of ids and whether the text came back."""
    docs = table(spark, sf_dir, "documents")
    ids = Scratch(spark, "round-trip").save(encode(docs))
    back = decode(ids).select("doc_id", F.col("text").alias("back"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").join(ids, "doc_id").select("doc_id", F.size("ids").cast("long").alias("n_ids"), (F.col("text") == F.col("back")).alias("same"))


@query("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or part of a text longer than 2,048 tokens, with its container."""
    sizes = token_counts(table(spark, sf_dir, "documents"))
    return pack(sizes, "doc_id", "n_tokens", 2048).withColumnRenamed("size", "n_tokens")


@query("p8_checked", "SELECT count(*) FILTER (text <> '') AS documents, 0 AS over_capacity, 0 AS tokens_lost, 0 AS cut_needlessly, true AS tight FROM documents")
def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of the packing: texts in containers, containers over their capacity, tokens lost, texts cut that would fit, and whether at most one container in a hundred (and eight) is more than the tokens need."""
    docs = table(spark, sf_dir, "documents")
    sizes = Scratch(spark, "checked").save(token_counts(docs))
    c = Scratch(spark, "checked").save(pack(sizes, "doc_id", "n_tokens", 2048))
    fill = c.groupBy("container").agg(F.sum("size").alias("fill")).agg(F.count_if(F.col("fill") > 2048).alias("over_capacity"), F.count("*").alias("containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("packed"))
    per = c.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("size").alias("tokens"))
    items = per.agg(F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= 2048)).alias("cut_needlessly"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    sums = items.unionByName(fill, allowMissingColumns=True).unionByName(total, allowMissingColumns=True)
    sums = sums.agg(*[F.max(n).alias(n) for n in sums.columns])  # three rows of one sum each
    return sums.select("documents", "over_capacity", (F.col("total") - F.col("packed")).alias("tokens_lost"), "cut_needlessly", (F.col("containers") <= F.ceil(F.col("total") / 2048) * 1.01 + 8).alias("tight"))


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))
