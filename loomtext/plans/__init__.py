"""The registered queries and their SQL."""

from . import relational, scalar  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
