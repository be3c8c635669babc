"""The registered queries, module by module."""

from . import catalogue, contents, directory, encoded, keyed, linked, logs, placed, relational  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
