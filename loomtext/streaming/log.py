"""An index of chunks that changes by log: each batch adds the chunks of its changed paths and a note of what went.

folder/paths/v=N has (path, hash, gone) of the paths that version N changed, folder/chunks/v=N their new chunks, and
folder/commits the names of the versions that are complete. A reader takes each path's last version and the chunks of
that version, so an edit never counts twice and a removed path is gone, while a batch writes what it changes only.
``compact`` writes what is current as one version, after which older ones are no longer read, and ``vacuum`` deletes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folders
from .incremental import changed, with_hash

Chunk = Callable[[DataFrame], DataFrame]


def commits(spark: SparkSession, folder: str) -> list[tuple[int, str, str]]:
    """(version, kind, batch) of the complete versions in order; kind is 'delta' or 'base'."""
    return sorted((int(v), kind, batch) for v, kind, batch in (n.split(".", 2) for n in folders.names(spark, f"{folder}/commits") if n.count(".") >= 2))


def live(spark: SparkSession, folder: str) -> list[int]:
    """The versions that a reader needs: from the last base on."""
    all_ = commits(spark, folder)
    base = max((v for v, kind, _ in all_ if kind == "base"), default=0)
    return [v for v, _, _ in all_ if v >= base]


def _table(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    at = [f"{folder}/{table}/v={v}" for v in live(spark, folder)]
    return spark.read.option("basePath", f"{folder}/{table}").parquet(*at) if at else None


def state(spark: SparkSession, folder: str) -> DataFrame:
    """(path, hash, v) of the paths that are there, v the version that has their chunks."""
    paths = _table(spark, folder, "paths")
    if paths is None:
        return spark.createDataFrame([], "path string, hash string, v int")
    return paths.groupBy("path").agg(F.max_by(F.struct("hash", "gone"), "v").alias("last"), F.max("v").alias("v")).where("NOT last.gone").select("path", "last.hash", "v")


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The chunks of the paths that are there, those of a clean build; None if nothing was ever written."""
    chunks = _table(spark, folder, "chunks")
    return None if chunks is None else chunks.join(state(spark, folder).select("path", "v"), ["path", "v"]).drop("v")


def _write(folder: str, chunks: DataFrame, paths: DataFrame, kind: str, batch: str) -> int:
    spark = paths.sparkSession
    v = max([0, *(int(n.split("=")[1]) for n in folders.names(spark, f"{folder}/paths") if n.startswith("v="))]) + 1
    paths.select("path", "hash", "gone").write.parquet(f"{folder}/paths/v={v}")
    chunks.write.parquet(f"{folder}/chunks/v={v}")
    folders.mark(spark, f"{folder}/commits/{v}.{kind}.{batch}")
    return v


def append(folder: str, files: DataFrame, chunk: Chunk, gone: DataFrame | None = None, batch: str = "") -> int | None:
    """The new version's number after files(path, content) were added or edited and the paths of gone(path) removed.

    Files whose hash is the same are left alone, and so are removals of paths that aren't there; a batch whose name is
    in the log is not written again. A version that fails before its end is never read.
    """
    spark = files.sparkSession
    if batch and any(b == batch for _, _, b in commits(spark, folder)):
        return None
    now = state(spark, folder)
    new = changed(with_hash(files.dropDuplicates(["path"])), now)
    paths = new.select("path", "hash", F.lit(False).alias("gone"))
    if gone is not None:
        left = gone.select("path").distinct().join(files.select("path"), "path", "left_anti").join(now.select("path"), "path", "left_semi")
        paths = paths.unionByName(left.select("path", F.lit(None).cast("string").alias("hash"), F.lit(True).alias("gone")))
    return _write(folder, chunk(new), paths, "delta", batch)


def rescan(folder: str, files: DataFrame, chunk: Chunk) -> int | None:
    """A version after which the index holds exactly these files: changed ones anew, the paths that aren't among them removed."""
    return append(folder, files, chunk, state(files.sparkSession, folder).select("path").join(files.select("path"), "path", "left_anti"))


def compact(spark: SparkSession, folder: str) -> int | None:
    """Writes what is current as one version, the new base."""
    chunks = read(spark, folder)
    return None if chunks is None else _write(folder, chunks, state(spark, folder).select("path", "hash", F.lit(False).alias("gone")), "base", "")


def vacuum(spark: SparkSession, folder: str) -> list[int]:
    """Deletes versions before the last base, and those that failed; gives their numbers. No writer may be at work.

    The names of commits stay: they tell which batches were written.
    """
    needed = set(live(spark, folder))
    found = {int(n.split("=")[1]) for t in ("paths", "chunks") for n in folders.names(spark, f"{folder}/{t}") if n.startswith("v=")}
    old = sorted(v for v in found - needed)
    for v in old:
        for t in ("paths", "chunks"):
            folders.delete(spark, f"{folder}/{t}/v={v}")
    return old


def stream(files: DataFrame, folder: str, checkpoint: str, chunk: Chunk):
    """A started query that adds each micro-batch of files(path, content, mtime[, gone]) to the log.

    Of a path the row with the last mtime counts; gone: it was removed. After a failure a batch that was written is left alone.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in files.columns else F.lit(False)

    def write(batch: DataFrame, epoch: int) -> None:
        last = batch.withColumn("_gone", gone).groupBy("path").agg(F.max_by(F.struct("content", F.col("_gone").alias("gone")), "mtime").alias("r")).select("path", "r.*")
        last = last.persist()
        try:
            append(folder, last.where("NOT gone").select("path", "content"), chunk, last.where("gone"), f"batch-{epoch}")
        finally:
            last.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
