"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import STOP_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: SQL shared by the queries: documents as files, conversations as headed notes, tokens.
STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
FILES = "files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path, doc_id::VARCHAR AS basename, n_chars AS size, text AS content, 1704067200000 + doc_id * 3600000 AS mtime_ms FROM documents)"
NOTES = "notes AS (SELECT conv_id, 'conv/' || conv_id || '.md' AS path, string_agg('# ' || role || ' ' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def sql_tokens(c: str, pattern: str = r"[^\p{L}\p{N}]+", stop: bool = True) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '{pattern}'), lambda t: length(t) >= 3{f' AND NOT list_contains({STOPS}, t)' if stop else ''})"


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
