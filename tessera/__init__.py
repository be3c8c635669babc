"""Versioned keyed data, ordered logs, content-addressed objects and snapshot
trees as Spark DataFrame plans."""

__version__ = "0.1.0"
