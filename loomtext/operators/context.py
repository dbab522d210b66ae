"""Prompt contexts: retrieved hits and notes, each trimmed to its share of a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T

#: Shares of the context budget by section.
CHAPTER = {"retrieved": 0.45, "bible": 0.25, "sliding": 0.10}
MICRO = {"sliding": 0.03, "bible": 0.25, "characters": 0.37, "retrieved": 0.20}
LABELS = {"retrieved": "Retrieved context", "bible": "Story bible", "sliding": "Sliding window", "characters": "Character notes"}


def assemble(row: DataFrame, shares: dict[str, float], limit: Column, sliding_words: int = 20_000) -> DataFrame:
    """row with each section's text cut to its share; the sliding section is the last words of its text first."""
    context = N.context_budget(limit)["context"]
    out = row
    for name, share in shares.items():
        body = T.last_n_words(F.col(name), sliding_words) if name == "sliding" else F.col(name)
        out = out.withColumn(name, T.trim_head(body, F.floor(context * share), LABELS[name]))
    return out


def prompt(**sections: Column) -> Column:
    """A prompt of titled sections, those that are blank left out."""
    return T.query_text(**sections)


def prefix_words(chapters: DataFrame, limit: int, book: str = "book", ord_col: str = "ord", body: str = "markdown") -> DataFrame:
    """The chapters of each book up to a number of words, the last one cut to what is left."""
    limit = max(1, min(2_000_000, limit))
    n = F.sum(T.word_count(F.col(body)).cast("long")).over(Window.partitionBy(book).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, -1))
    left = F.lit(limit) - F.coalesce(n, F.lit(0))
    own = T.word_count(F.col(body))
    out = chapters.withColumn("_left", left).where("_left > 0")
    return out.withColumn(body, F.when(own <= F.col("_left"), F.col(body)).otherwise(T.slice_first_n_words(F.col(body), F.col("_left")))).drop("_left")


def first_chapters(chapters: DataFrame, n: int, book: str = "book", ord_col: str = "ord") -> DataFrame:
    n = max(1, min(200, n))
    return chapters.withColumn("_r", F.row_number().over(Window.partitionBy(book).orderBy(ord_col))).where(F.col("_r") <= n).drop("_r")


def aggregate_updates(updates: DataFrame, entity: str = "entity", ord_col: str = "ord", text: str = "update") -> DataFrame:
    """(entity, updates): the updates of an entity as one text, in order."""
    parts = F.array_sort(F.collect_list(F.struct(ord_col, text)))
    return updates.groupBy(entity).agg(F.array_join(F.transform(parts, lambda s: s[text]), "\n\n---\n\n").alias("updates"))
