"""The lexical and vector index: chunks, postings, corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import index_chunks


def chunk_table(files: DataFrame, level: str = "h1", target: int = 500, overlap: int = 100) -> DataFrame:
    """chunks(key, path, chunk_index, start_word, end_word, text) of files(path, content)."""
    c = index_chunks(files.select("path", "content"), "content", level, target, overlap)
    return c.select(F.concat(F.lit("chunk:"), F.col("path"), F.lit(":"), F.col("chunk_index").cast("string")).alias("key"), "path", "chunk_index", "start_word", "end_word", "text")


def postings(chunks: DataFrame) -> DataFrame:
    """(term, key, tf): exploded and counted, so counts are combined before the shuffle."""
    return chunks.select("key", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "key").agg(F.count("*").alias("tf"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """(key, path, len): tokens of each chunk that has any."""
    return chunks.select("key", "path", F.size(T.tokens(F.col("text"))).cast("long").alias("len")).where("len > 0")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n_chunks, total_len, avgdl)."""
    return lengths.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))


def index_status(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("path").alias("indexed_files"), F.count("*").alias("indexed_chunks"))
