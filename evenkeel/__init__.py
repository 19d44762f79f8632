"""Content equivalence of two relational snapshots, decided with Spark aggregations."""

__version__ = "0.1.0"
