"""shelfmark: analytics over catalogs of file systems, written for Spark's DataFrame engine."""

__version__ = "0.1.0"
