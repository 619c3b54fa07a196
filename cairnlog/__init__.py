"""Log analytics as lazy Spark plans: ingest, query, count, sessionise, label, score."""

__version__ = "0.1.0"
