"""Registry of the named queries of the core and of the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_queries() -> dict[str, Query]:
    from . import catalog, disks, files, tree

    return catalog.QUERIES | tree.QUERIES | files.QUERIES | disks.QUERIES


def all_sql() -> dict[str, str]:
    from . import catalog, disks, files, tree

    return catalog.SQL | tree.SQL | files.SQL | disks.SQL
