"""Connected components of the pairs that meet under shared keys and pass a test, with output linear in the rows.

Ids that may have a partner bring their data to one key each, their home, the least of their keys by hash, so that
alike ones meet. There pairs are tested but for those that links already connect. Then, in the keys under which several
components meet, the pairs that have not met are looked for: each is tested under the least key that its two ids
share, as their ``LOW`` least keys tell, or under all keys they share where these have none in common. What leaves a
group is one link for each id that was tied to another, never its pairs; no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _blocks, _spark

#: Least keys of an id that are held side by side with it.
LOW = 8

Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def link(
    scratch: _spark.Scratch,
    hits: DataFrame,
    sketch: str,
    candidates: Callable[[pa.Table], Pairs],
    payload: Callable[[DataFrame], DataFrame],
    test: Callable[[pa.Table, Pairs, _blocks.Groups], None],
    rows: int = 20_000,
) -> DataFrame:
    """(node, root) of each id that a link ties to another, root the least id of its component.

    hits: (key long, id long, and the columns of the schema ``sketch``), the ids that may have a partner under a key.
    candidates(t): the pairs of rows of t, sorted by key, that stand under one key and may be linked by their sketches.
    payload(ids): (id, data binary) with one row of each of the ids and perhaps of others. test(t, pairs, groups): joins the linked ones of the pairs,
    whose data t has, in groups; pairs that are in one group already need no test.
    """
    names = [c.split()[0] for c in sketch.split(",")]

    def tested(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        label, home = t["label"].to_numpy(), t["home"].to_numpy()
        groups = _blocks.Groups(label)

        def apart() -> Pairs:
            for i, j in candidates(t):
                new = (home[i] != home[j]) & (groups.label[i] != groups.label[j])
                if new.any():
                    yield i[new], j[new]

        test(t, apart(), groups)
        order = np.lexsort((label, groups.label))
        least = np.zeros(len(t), np.int64)
        if len(t):
            begin = np.flatnonzero(np.diff(groups.label[order], prepend=-1))
            least[order] = np.repeat(label[order][begin], np.diff(np.append(begin, len(t))))
        tied = np.unique(np.stack([label, least])[:, label != least], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(tied[0]), pa.array(tied[1])], ["a", "b"])

    def unmet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        key, label = t["key"].to_numpy(), t["label"].to_numpy()
        low = np.zeros((len(t), LOW), np.int64)
        lists = t["low"].combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        filled = np.arange(LOW) < n[:, None]
        low[filled] = lists.flatten().to_numpy()
        hit = np.zeros(len(t), bool)
        for i, j in candidates(t):
            apart = label[i] != label[j]
            for at in range(0, len(i), 50_000):
                p, q = (x[at : at + 50_000][apart[at : at + 50_000]] for x in (i, j))
                same = ((low[p][:, :, None] == low[q][:, None, :]) & filled[q][:, None, :]).any(axis=2) & filled[p]
                least = low[p, same.argmax(axis=1)]
                here = ~same.any(axis=1) | ((least == key[p]) & (low[p, 0] != low[q, 0]))
                hit[p[here]] = hit[q[here]] = True
        yield from t.drop_columns(["low"]).filter(pa.array(hit)).combine_chunks().to_batches()

    homes = hits.groupBy("id").agg(
        F.transform(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("key").alias("x"), "key"))), 1, LOW), lambda x: x["key"]).alias("low"),
        *[F.min_by(c, "key").alias(c) for c in names],
    )
    homes = scratch.cut(homes.select("id", F.col("low")[0].alias("key"), "low", *names), "homes")
    data = scratch.cut(homes.drop("low").join(payload(homes.select("id")), "id"), "data")
    at = data.withColumns({"label": F.col("id"), "home": F.col("id")})
    first = scratch.cut(_blocks.grouped(at, "key", tested, "a long, b long", rows=rows, heavy=True), "links")
    roots = scratch.cut(_spark.components(scratch, first), "roots")
    tagged = homes.withColumnRenamed("key", "home").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    tagged = scratch.cut(tagged, "tagged")
    under = Window.partitionBy("key")
    several = hits.select("key", "id").join(tagged.select("id", "label"), "id").select("key", "id", (F.min("label").over(under) != F.max("label").over(under)).alias("several"))
    met = several.where("several").join(tagged, "id").select("key", "id", *names, "home", "label", "low")
    open_ = scratch.cut(_blocks.grouped(met, "key", unmet, f"key long, id long, {sketch}, home long, label long", rows=rows, heavy=True), "open")
    if open_.take(1):
        more = scratch.cut(_blocks.grouped(open_.join(data.select("id", "data"), "id"), "key", tested, "a long, b long", rows=rows, heavy=True), "more")
        if more.take(1):
            every = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
            roots = scratch.cut(_spark.components(scratch, every), "all-roots")
        scratch.drop("more")
    scratch.drop("homes", "data", "links", "tagged", "open")
    return roots
