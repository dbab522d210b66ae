"""Search results kept by key: only queries without a fresh result reach the search.

A result's key is the hash of the query's text, the search's settings and the version of what it reads, so a new version misses.
folder/hits/run=T-… has the hits that a run at time T found, folder/asked/run=T-… the keys it asked for, those
without hits included, and folder/commits the names of complete runs. Runs older than ``keep`` seconds are not opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import folders

#: Seconds that a result counts.
KEEP = 30.0


def _runs(spark: SparkSession, folder: str) -> dict[str, float]:
    """The complete runs and their times."""
    return {n: int(n.split("-")[0]) / 1000 for n in folders.names(spark, f"{folder}/commits") if "-" in n}


def _fresh(spark: SparkSession, folder: str, now: float, keep: float) -> list[str]:
    return [n for n, at in _runs(spark, folder).items() if 0 <= now - at <= keep]


def _read(spark: SparkSession, folder: str, table: str, runs: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/{table}").parquet(*[f"{folder}/{table}/run={r}" for r in runs])


def search(folder: str, queries: DataFrame, find: Callable[[DataFrame], DataFrame], made_of: str, now: float, keep: float = KEEP, settings: str = "") -> DataFrame:
    """The hits that find(queries) gives for queries(query_id, text), kept or found now; equal texts are asked once.

    find: from (query_id, text) to hits with a query_id. made_of: the version of what find reads; settings: all else
    that its result hangs on; now: seconds since 1970. Null and blank texts have no hits. A failed run keeps nothing.
    If nothing is kept and no query is to be asked, find is called with an empty table, for the columns.
    """
    spark = queries.sparkSession
    words = T.trim_ws(T.text(F.col("text")))
    asked = queries.select("query_id", words.alias("text")).where("text <> ''")
    asked = asked.withColumn("asked", F.sha2(F.concat_ws("\n", F.lit(made_of), F.lit(settings), "text"), 256))
    runs = _fresh(spark, folder, now, keep)
    misses = asked.join(_read(spark, folder, "asked", runs), "asked", "left_anti") if runs else asked
    misses = misses.groupBy("asked").agg(F.first("text").alias("text")).persist()
    try:
        if not runs or not misses.isEmpty():
            run = f"{int(now * 1000):015d}-{uuid.uuid4().hex}"
            find(misses.select(F.col("asked").alias("query_id"), "text")).withColumnRenamed("query_id", "asked").write.parquet(f"{folder}/hits/run={run}")
            misses.select("asked").write.parquet(f"{folder}/asked/run={run}")
            folders.mark(spark, f"{folder}/commits/{run}")
            runs.append(run)
    finally:
        misses.unpersist()
    last = _read(spark, folder, "asked", runs).groupBy("asked").agg(F.max("run").alias("run"))
    hits = asked.drop("text").join(last, "asked").join(_read(spark, folder, "hits", runs), ["asked", "run"])
    return hits.drop("asked", "run")


def expire(spark: SparkSession, folder: str, now: float, keep: float = KEEP) -> int:
    """Deletes the runs that are too old, and gives their number. No search of an earlier time may be at work."""
    old = [n for n, at in _runs(spark, folder).items() if now - at > keep]
    for n in old:
        folders.delete(spark, f"{folder}/commits/{n}")
        folders.delete(spark, f"{folder}/asked/run={n}")
        folders.delete(spark, f"{folder}/hits/run={n}")
    return len(old)
