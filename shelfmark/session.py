"""Session factory with the settings the operators assume (UTC, adaptive execution)."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "shelfmark", **conf: str) -> SparkSession:
    """A session; `conf` keys use `__` for the dots. Cluster settings given outside win over these defaults."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()
