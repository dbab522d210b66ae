"""Hash-gated, incremental indexing: batch building blocks and a Structured Streaming driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    """files with ``hash`` of the content."""
    return files.withColumn("hash", F.md5(F.coalesce(F.col(content), F.lit("")).cast("binary")))


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """The files whose hash isn't the one in state(path, hash)."""
    return files.join(state.select("path", F.col("hash").alias("_was")), "path", "left").where(~F.col("hash").eqNullSafe(F.col("_was"))).drop("_was")


def replace_paths(index: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """index without the rows of the paths of fresh and gone, and the rows of fresh: what a clean rebuild gives."""
    paths = fresh.select("path") if gone is None else fresh.select("path").unionByName(gone.select("path"))
    return index.join(paths.distinct(), "path", "left_anti").select(*index.columns).unionByName(fresh)


def reindex(index: DataFrame, state: DataFrame, files: DataFrame, chunk: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(index, state) after the files of a batch: unchanged ones are left alone, of the others all rows are made anew."""
    new = changed(with_hash(files), state)
    kept = index.join(new.select("path").distinct(), "path", "left_anti").select(*index.columns)
    own = new.select("path", "hash")
    return kept.unionByName(chunk(new).select(*index.columns)), state.join(own, "path", "left_anti").select("path", "hash").unionByName(own)


def failed_only(tasks: DataFrame, state: DataFrame, key: str = "task_id") -> DataFrame:
    """The tasks of a changed input, or else of those that failed last time: state(task_id, hash, failed)."""
    return tasks.join(state.select(key, F.col("hash").alias("_was"), F.col("failed").alias("_failed")), key, "left").where(~F.col("hash").eqNullSafe(F.col("_was")) | F.coalesce("_failed", F.lit(False))).drop("_was", "_failed")


def latest_wins(requests: DataFrame, key: str, seq: str) -> DataFrame:
    """Of each key the last request."""
    rest = [c for c in requests.columns if c != key]
    return requests.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(seq, *[c for c in rest if c != seq])).alias("_r")).select(key, "_r.*")


def merge_events(events: DataFrame, key: str, seq: str) -> DataFrame:
    """One row of each key: of every other column the last value by seq that isn't null. So a run's finish adds to its start."""
    rest = [c for c in events.columns if c not in (key, seq)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest]
    return events.groupBy(key).agg(F.max(seq).alias(seq), *last)


def stream_index(files: DataFrame, folder: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame]):
    """A started query that keeps folder/v<batch> the index of all files seen, for a streaming frame of files(path, content).

    Each micro-batch takes the last content of a path, skips unchanged ones, and writes a new version of index and
    state; the newest complete version is the one to read, so a restart after a failure repeats a batch safely.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.groupBy("path").agg(F.max_by("content", "mtime").alias("content"))
        before = latest_version(spark, folder, epoch)
        if before is None:
            new = with_hash(batch)
            index, state = chunk(new), new.select("path", "hash")
        else:
            index, state = reindex(spark.read.parquet(f"{folder}/v{before}/index"), spark.read.parquet(f"{folder}/v{before}/state"), batch, chunk)
        state.write.mode("overwrite").parquet(f"{folder}/v{epoch}/state")
        index.write.mode("overwrite").parquet(f"{folder}/v{epoch}/index")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark, folder: str, before: int | None = None) -> int | None:
    """The newest complete version below ``before``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return None
    found = [int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName()[1:].isdigit()]
    done = [v for v in found if (before is None or v < before) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{v}/index/_SUCCESS"))]
    return max(done, default=None)
