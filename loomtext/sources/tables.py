"""Canonical tables over Parquet inputs and over folders of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of a table for each core below which its rows are dealt out anew.
SMALL = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt out over the cores if its files are so small that a few splits hold them all; larger tables keep their splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def markdown_folder(spark: SparkSession, folder: str, extension: str = "md") -> DataFrame:
    """files(path, basename, ext, mtime, size, content) of a folder tree, one row a file.

    The extension is matched at the listing, so other files are never opened; paths are relative to folder.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").text(folder, wholetext=True)
    root = folder.rstrip("/").removeprefix("file://") + "/"
    at = F.instr(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), root)
    path = F.substring(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), at + len(root), F.lit(1 << 20))
    return raw.select(
        path.alias("path"),
        F.regexp_replace(T.base_name(path), r"\.[^.]*$", "").alias("basename"),
        F.lit(extension).alias("ext"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("content"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: source/lang/doc_id.md, modified doc_id hours after the start of 2024."""
    d = spread(read(spark, sf_dir, "documents"))
    return d.select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.col("doc_id").cast("string").alias("basename"),
        F.lit("md").alias("ext"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600).alias("mtime"),
        F.col("n_chars").alias("size"),
        F.col("text").alias("content"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as headed notes (path, content): an H1 of role and turn over each text."""
    turn = F.concat(F.lit("# "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("turn", turn.alias("part"))))
    return (
        read(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(parts.alias("parts"))
        .select("conv_id", F.format_string("conv/%d.md", "conv_id").alias("path"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("content"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as chunk vectors."""
    v = read(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.format_string("chunk:v/%d.md:0", "vec_id").alias("key"), F.format_string("v/%d.md", "vec_id").alias("path"), F.col("embedding").alias("vector"), "label")


def queries(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """``benchmark`` as retrieval queries; limit: only ids below it."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return b.where(F.col("query_id") < limit) if limit is not None else b
