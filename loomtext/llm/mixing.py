"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The documents of each source, shuffled by a keyed hash, form one stream of words that is cut into blocks of
``block`` words. A golden-ratio sequence, mapped through the cumulative quotas of the sources, says which source
each slot of the mix takes its next block from; the k-th slot of a source takes block k modulo its number of
blocks. The schedule is joined to the blocks, and the blocks to the documents they are cut from.

Defined cases: a null text has no words; documents without words are in the result with taken 0; a null source is
a source of its own and comes last; repeated rows are documents of their own; a null doc_id is kept; other
columns are ignored; an empty table gives no rows. The sources, at most ``MAX_SOURCES``, are the configuration of
a mix and are held on the driver; documents, blocks and slots are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark

WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 100_000
#: 2**31 times the golden ratio's fraction, made odd: slot i has the point (i * STEP mod 2**31) / 2**31.
STEP, SPAN = 1327217885, 1 << 31
#: Slots are ranked within runs of so many, and documents within 2**12 ranges of their hash: no source is one task's work.
RUN, HASH_RANGES = 1 << 16, 1 << 12


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """The shares of sum(sizes) by weight, none above cap times its size; what is above is reshared by weight."""
    total, rest_w = float(sum(sizes)), float(sum(weights))
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    capped, level = 0.0, 0.0
    for i in order:
        level = (total - capped) / rest_w
        if level <= cap * sizes[i] / weights[i]:
            break
        capped, rest_w = capped + cap * sizes[i], rest_w - weights[i]
    return [cap * s if level > cap * s / w else w * level for s, w in zip(sizes, weights, strict=True)]


def quota(target: float, size: int, block: int) -> int:
    """Blocks that bring a source nearest its target: whole passes, then full blocks."""
    if not size:
        return 0
    n = -(-size // block)
    whole = int(target // size)
    return whole * n + min(n, int((target - whole * size) / block + 0.5))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, block: int = 64, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source_col, size, source_size, target, taken) of each row of docs; weights repeat over the sources in code-point order."""
    scratch = _spark.Scratch(docs.sparkSession)
    rows = _spark.with_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), scratch)
    out = mix_rows(rows, scratch, weights, cap, block, seed)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def mix_rows(docs: DataFrame, scratch: _spark.Scratch, weights: tuple[float, ...], cap: float, block: int, seed: str) -> DataFrame:
    """(row, id, source, size, source_size, target, taken) of each row of docs (row, id, text, source)."""
    spark = docs.sparkSession
    base = docs.select(
        "row",
        "id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie"),
    ).withColumn("h", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long"))
    base = scratch.cut(base, "sizes")
    found = base.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)
    quotas = [quota(t, s, block) for t, s in zip(goal, sizes, strict=True)]
    plan = spark.createDataFrame(
        [(i, r["source"], s, t, max(1, -(-s // block))) for i, (r, s, t) in enumerate(zip(found, sizes, goal, strict=True))],
        "src int, name string, source_size long, target double, n_blocks long",
    )

    n, edges = sum(quotas), np.cumsum(quotas)

    def scheduled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            point = b.column("id").to_numpy() % SPAN * STEP % SPAN
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.searchsorted(edges, point * (n / SPAN), "right").astype(np.int32))], ["slot", "src"])

    slots = spark.range(n).mapInArrow(scheduled, "slot long, src int").withColumn("run", F.floor(F.col("slot") / RUN))
    runs = slots.groupBy("src", "run").count()
    before = runs.withColumn("before", F.sum("count").over(Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    before = scratch.cut(before.select("src", "run", "count", F.coalesce("before", F.lit(0)).alias("before")), "runs")
    got = {r["src"]: r["n"] for r in before.groupBy("src").agg(F.sum("count").alias("n")).collect()}
    # The sequence is within a few slots of each quota; slots beyond one are void, and missing ones come at the end.
    short = [(i, got.get(i, 0) + k) for i, q in enumerate(quotas) for k in range(q - got.get(i, 0))]
    ranked = slots.join(before.select("src", "run", "before"), ["src", "run"]).select(
        "src", (F.col("before") + F.row_number().over(Window.partitionBy("src", "run").orderBy("slot")) - 1).alias("rank")
    )
    ranked = ranked.unionByName(spark.createDataFrame(short, "src int, rank long"))
    bound = spark.createDataFrame([(i, q, max(1, -(-s // block))) for i, (q, s) in enumerate(zip(quotas, sizes, strict=True))], "src int, quota long, n_blocks long")
    times = ranked.join(F.broadcast(bound), "src").where("rank < quota").groupBy("src", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count("*").alias("times"))

    rows = base.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("name"))).withColumn("part", F.shiftright("h", 60 - 12))
    parts = rows.groupBy("src", "part").agg(F.sum("size").alias("sum"))
    parts = parts.select("src", "part", F.coalesce(F.sum("sum").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    own = Window.partitionBy("src", "part").orderBy("h", "id", "size", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(parts, ["src", "part"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    cut = (
        placed.where("size > 0")
        .select("row", "src", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
        .select("row", "src", "block", (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)).alias("words"))
    )
    taken = cut.join(times, ["src", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return rows.join(taken, "row", "left").select("row", "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, block: int = 64, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes any words of, with all their columns and mix_size, mix_target (their source's) and mix_taken.

    Where docs has columns of these names, the new ones have underscores before theirs.
    """
    scratch = _spark.Scratch(docs.sparkSession)
    row, *names = _spark.fresh(docs.columns, "row", "mix_size", "mix_target", "mix_taken")
    rows = _spark.with_rows(docs, scratch, row)
    plan = mix_rows(rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), scratch, weights, cap, block, seed)
    plan = plan.where("taken > 0").select("row", "size", "target", "taken").toDF(row, *names)
    return rows.join(plan, row).drop(row)
