"""Every runnable query. Importing the modules fills the registry."""

from sturdytab.queries import auditing, corrupting, learning, selecting  # noqa: F401
from sturdytab.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
