"""Spark-side helpers: durable cuts of lineage, connected components, bounded head tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomtext-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Whether a query's shuffle files are deleted when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder: lineage and plans end there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{scratch_dir(spark)}/loomtext-{uuid.uuid4().hex}", {}

    def cut(self, df: DataFrame, name: str | None = None, free: bool = False) -> DataFrame:
        """Writes df as Parquet in the shared folder and reads it back. free: its shuffle files go at once, not when the driver's garbage is collected."""
        name = name or uuid.uuid4().hex[:8]
        path = f"{self.base}/{name}"
        before = self.spark.conf.get(FREE, None)
        if free:
            self.spark.conf.set(FREE, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if free:
                self.spark.conf.unset(FREE) if before is None else self.spark.conf.set(FREE, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Frees tables that no lazy result reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores before it as make it differ from all columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def doc_key(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, root) of every node of an edge list, root the least node of its component.

    Alternating large-star and small-star rounds over edges from a node u to a smaller one v. In the first, v gives way
    to its own least smaller neighbour; in the second, a node and its smaller neighbours are tied to the least of them.
    No neighbourhood is collected: the least neighbours are a table of their own, combined before the shuffle, and the
    edges of a hub meet them in a plain join, which adaptive execution splits. Nodes are of any orderable type.
    Self loops and repeated edges are allowed; no edges give no rows. More than ``max_rounds`` rounds raise.
    """
    tag = uuid.uuid4().hex[:6]
    e = scratch.cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"cc-{tag}-0")
    for k in range(max_rounds):
        low = scratch.cut(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"low-{tag}-{k}")
        moved = e.join(low.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        moved = scratch.cut(moved, f"star-{tag}-{k}")
        # All edges lead to roots, one from each node: done.
        done = not moved.where("moved").take(1) and not low.where("n > 1").take(1)
        if done:
            scratch.drop(f"low-{tag}-{k}", f"star-{tag}-{k}")
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        small = (
            moved.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        e = scratch.cut(small, f"cc-{tag}-{k + 1}")
        scratch.drop(f"low-{tag}-{k}", f"star-{tag}-{k}", f"cc-{tag}-{k}")
    raise RuntimeError(f"components have not converged in {max_rounds} rounds")


def head_cut(freq: DataFrame, column: str, limit: int) -> float:
    """The least value c such that at most ``limit`` rows have column >= c, up to steps of 2**(1/8).

    Only a histogram over logarithmic steps (some hundreds of rows) comes to the driver.
    """
    step = F.floor(F.log2(F.col(column)) * 8).cast("int")
    left = limit
    cut = float("inf")
    for b, n in freq.groupBy(step.alias("b")).count().orderBy(F.desc("b")).collect():
        if n > left:
            break
        left -= n
        cut = 2 ** (b / 8)
    return cut


#: Nodes of a plan that read files and pass on rows in their order.
_STABLE = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def _stable(plan) -> bool:
    children = plan.children()
    return plan.getClass().getSimpleName() in _STABLE and all(_stable(children.apply(i)) for i in range(children.size()))


def with_rows(docs: DataFrame, scratch: Scratch, name: str = "row") -> DataFrame:
    """docs with a row number, in the column ``name``, that is the same each time the frame is read.

    A frame that only projects or filters files by deterministic expressions is read in the same partitions and order
    every time, once the number of file splits is pinned (else it follows the number of executors); any other one is
    written to the shared folder first.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    plan = docs._jdf.queryExecution().optimizedPlan()
    if not (plan.deterministic() and _stable(plan)):
        docs = scratch.cut(docs)
    return docs.select("*", F.monotonically_increasing_id().alias(name))
