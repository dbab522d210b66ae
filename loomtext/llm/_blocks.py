"""Grouped work in Arrow functions: whole groups of a key, streamed in bounded tables; hot keys split into pairs of parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix

#: Rows of one key that one unit of work compares; keys with more are split into parts of about so many, each pair of parts one unit.
PART = 4096
#: Bound of the hot keys that are split; found in a sample of 1 in SAMPLE ids.
HOT_KEYS, SAMPLE = 50_000, 32
#: Tasks a core for work that is great for its bytes.
TASKS = 4


def grouped(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, rows: int = 50_000, size: int = 16 << 20, then: tuple[str, ...] = (), heavy: bool = False) -> DataFrame:
    """fn over tables of whole groups of key, in its order; a table has about ``rows`` rows or ``size`` bytes.

    heavy: the work is great for its bytes, so that its tasks are not to be made fewer by them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = b = 0
        for batch in batches:
            held.append(batch)
            n, b = n + len(batch), b + batch.nbytes
            if n >= rows or b >= size:
                t = pa.Table.from_batches(held)
                k = t[key].to_numpy()
                cut = int(np.searchsorted(k, k[-1]))  # the last group may go on
                if cut:
                    yield from fn(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
                    n, b = len(t) - cut, sum(x.nbytes for x in held)
        if n:
            yield from fn(pa.Table.from_batches(held))

    dealt = df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, key) if heavy else df.repartition(key)
    return dealt.sortWithinPartitions(key, *then).mapInArrow(run, schema)


def hot_keys(sampled: DataFrame, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, number of parts) of the keys that seem to have more than ``part`` rows, from the (key) rows of 1 in SAMPLE ids."""
    t = sampled.groupBy("key").count().where(F.col("count") * SAMPLE > part).orderBy(F.desc("count"), "key").limit(HOT_KEYS).toArrow()
    key, parts = t["key"].to_numpy(), -(-t["count"].to_numpy() * SAMPLE // part)
    order = np.argsort(key)
    return key[order], parts[order].astype(np.int64)


def split_hot(key: np.ndarray, ident: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) that replace the rows of a batch: rows of hot keys stand once for each pair of parts that holds theirs."""
    keys, parts = hot
    rows = np.arange(len(key))
    if not len(keys) or not len(key):
        return rows, key
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    n = np.where(keys[at] == key, parts[at], 1)
    rows = np.repeat(rows, n)
    other = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    split = n[rows] > 1
    own = (mix(ident[rows].astype(np.uint64)) % n[rows].astype(np.uint64)).astype(np.int64)
    lo, hi = np.minimum(own, other), np.maximum(own, other)
    new = mix(key[rows].astype(np.uint64) ^ mix((lo * 1_000_003 + hi + 1).astype(np.uint64))).view(np.int64)
    return rows, np.where(split, new, key[rows])


def pairs_of(key: np.ndarray, most: int = 64) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """All pairs (i < j) of rows with equal keys in groups of up to ``most`` rows, and the (from, to) of the larger groups; key is sorted."""
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    large = [(int(b), int(b + s)) for b, s in zip(begin[size > most], size[size > most], strict=True)]
    ok = (size > 1) & (size <= most)
    begin, size = begin[ok], size[ok]
    # Row r of a group pairs with the rows after it.
    row = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    after = np.repeat(begin + size, size) - row - 1
    i = np.repeat(row, after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    return i, j, large


class Groups:
    """Disjoint sets over rows, at first those with equal labels; the label of each row is at hand as an array."""

    def __init__(self, labels: np.ndarray):
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        self.label, self.members = first[back], {}
        order = np.argsort(self.label, kind="stable")
        begin = np.flatnonzero(np.diff(self.label[order], prepend=-1))
        for rows in np.split(order, begin[1:]):
            if len(rows) > 1:
                self.members[int(rows[0])] = rows.tolist()

    def join(self, a: int, b: int) -> None:
        """Unites the sets of a and b; the smaller one takes the larger one's label."""
        p, q = int(self.label[a]), int(self.label[b])
        if p == q:
            return
        x, y = self.members.pop(p, [p]), self.members.pop(q, [q])
        if len(x) < len(y):
            p, x, y = q, y, x
        self.label[y] = p
        self.members[p] = x + y


BLOOM_BITS = 1 << 25


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of BLOOM_BITS bits (4 MB, whatever the number of rows) with a bit set for each value of a long column."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BLOOM_BITS >> 6, np.uint64)
        for b in batches:
            word, bit = _bloom_place(b.column(0).to_numpy())
            np.bitwise_or.at(own, word, np.uint64(1) << bit)
        w = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(own[w].view(np.int64))], ["w", "b"])

    t = df.select(column).mapInArrow(bits, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BLOOM_BITS >> 6, np.uint64)
    out[t["w"].to_numpy()] = t["b"].to_numpy().view(np.uint64)
    return out


def _bloom_place(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot = mix(values.view(np.uint64))
    return (slot >> np.uint64(64 - 19)).astype(np.int64), slot & np.uint64(63)


def in_bloom(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be there: all that were put in, and some others."""
    word, bit = _bloom_place(values)
    return ((bits[word] >> bit) & np.uint64(1)).astype(bool)
