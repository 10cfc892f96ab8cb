"""lexmill: a Spark engine that builds, queries and evaluates searchable text corpora."""

__version__ = "0.1.0"
