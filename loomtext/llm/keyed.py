"""Per-document sums of per-key values where the key table is too large to broadcast.

A document is a bag of keys (pre-tokens, n-grams); each distinct key has one value, computed once. The most
frequent keys, at most ``HEAD_KEYS`` of at most ``HEAD_BYTES`` bytes, are broadcast and summed where the
document is read. The rest goes through a shuffle join, so the result is exact whatever the head holds, and a
hot key never reaches the shuffle: its rows are in the head.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks, _spark
from ._text import flat, pieces, span_hash

#: Bound of what is broadcast: HEAD_KEYS * HEAD_BYTES = 12 MB of keys.
HEAD_KEYS, HEAD_BYTES = 1 << 18, 48
#: Bytes of keys that are counted before they are passed on. If they go in blocks: keys that are merged at once and that are kept then, buckets of blocks, and counts of a bucket that are merged at once.
WINDOW_BYTES, WINDOW, KEPT, BUCKETS, MERGED = 32 << 20, 250_000, 400_000, 128, 500_000


def _counted(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.RecordBatch], Iterator[pa.Array]], most: int, keep: int = 0) -> Iterator[pa.RecordBatch]:
    """(key binary, freq long) of the batches, merged each time that about ``most`` more keys or WINDOW_BYTES bytes of them are held, and passed on if more than ``keep`` or these bytes are left."""
    held, n, size = [], 0, 0

    def merged() -> pa.Table:
        t = pa.concat_tables(held).group_by("key").aggregate([("freq", "sum")]) if len(held) > 1 else held[0].rename_columns(["key", "freq_sum"])
        return pa.table({"key": t["key"], "freq": t["freq_sum"]}).combine_chunks()

    def passed(t: pa.Table) -> list[pa.RecordBatch]:
        return t.set_column(0, "key", t["key"].cast(pa.binary())).combine_chunks().to_batches()

    for batch in batches:
        for keys in keys_of(batch):
            if len(keys):
                c = pc.value_counts(keys)
                held.append(pa.table({"key": c.field(0), "freq": c.field(1)}))
                n, size = n + len(c), size + c.field(0).nbytes
            if n > most or size > WINDOW_BYTES:
                held, n, size = [merged()], 0, 0
                if len(held[0]) > keep or held[0].nbytes > WINDOW_BYTES:
                    yield from passed(held.pop())
    if held:
        yield from passed(merged())


def count_keys(docs: DataFrame, columns: list[str], keys_of: Callable[[pa.RecordBatch], Iterator[pa.Array]]) -> DataFrame:
    """(key binary, freq long) over all rows. keys_of yields the key arrays of a batch; counts are made before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, keys_of, 250_000)

    return docs.select(*columns).mapInArrow(counted, "key binary, freq long").groupBy("key").agg(F.sum("freq").alias("freq"))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, the upper ones of which are nearly empty."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _numbers(data: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(keys: pa.Array, freq: np.ndarray) -> bytes:
    """Keys and their counts as compressed bytes; sorted keys take the least."""
    data, offs = flat(keys)
    raw = b"".join((_planes(np.diff(offs).astype(np.uint32)), _planes(freq.astype(np.int64)), data.tobytes()))
    return b"".join((len(keys).to_bytes(8, "little"), len(raw).to_bytes(8, "little"), pa.compress(raw, "zstd", asbytes=True)))


def unpacked(block: bytes) -> pa.Table:
    """(key, freq) of ``packed`` ones."""
    n, size = int.from_bytes(block[:8], "little"), int.from_bytes(block[8:16], "little")
    raw = np.frombuffer(pa.decompress(block[16:], size, "zstd", asbytes=True), np.uint8)
    offs = np.concatenate(([0], np.cumsum(_numbers(raw[: 4 * n], np.uint32), dtype=np.int64)))
    keys = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(raw[12 * n :])])
    return pa.table({"key": keys, "freq": _numbers(raw[4 * n : 12 * n], np.int64)})


def count_packed(
    docs: DataFrame,
    columns: list[str],
    keys_of: Callable[[pa.RecordBatch], Iterator[pa.Array]],
    then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter,
    schema: str = "key binary, freq long",
) -> DataFrame:
    """As ``count_keys``, where most keys are rare: counts are shuffled in compressed blocks of sorted keys, which takes about half of the disk.

    Keys are dealt out to BUCKETS by hash, and a bucket is merged MERGED counts at a time. then: what is made of batches
    of the result, with the columns of the schema, by the worker that merges them.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _counted(batches, keys_of, WINDOW, KEPT):
            data, offs = flat(b.column("key"))
            bucket = (span_hash(data, offs[:-1], offs[1:]) % np.uint64(BUCKETS)).astype(np.int32)
            order = pc.sort_indices(b.column("key")).to_numpy()
            order = order[np.argsort(bucket[order], kind="stable")]
            key, freq, bucket = b.column("key").take(pa.array(order)), b.column("freq").to_numpy()[order], bucket[order]
            begin = np.flatnonzero(np.diff(bucket, prepend=-1))
            to = np.append(begin[1:], len(bucket))
            done = [packed(key.slice(f, t - f), freq[f:t]) for f, t in zip(begin.tolist(), to.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[begin]), "block": pa.array(done, pa.binary())})
            del b, key, freq, done
            pa.default_memory_pool().release_unused()

    def summed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        of = t["bucket"].to_numpy()
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        for f, to in zip(begin.tolist(), np.append(begin[1:], len(of)).tolist(), strict=True):
            held, n, most = [], 0, MERGED
            for x in t["block"].slice(f, to - f):
                held.append(unpacked(x.as_py()))
                n += len(held[-1])
                if n > most:
                    held = [_merged(held)]
                    n, most = len(held[0]), max(MERGED, 2 * len(held[0]))
            own = _merged(held)
            yield from then(pieces(pa.table({"key": own["key"].cast(pa.binary()), "freq": own["freq"]}).combine_chunks().to_batches()[0], "key"))

    def _merged(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).group_by("key").aggregate([("freq", "sum")])
        return pa.table({"key": t["key"], "freq": t["freq_sum"]})

    dealt = docs.select(*columns).mapInArrow(blocks, "bucket int, block binary")
    return _blocks.grouped(dealt, "bucket", summed, schema, rows=1 << 12, size=4 << 20)


def head_of(valued: DataFrame, columns: list[str]) -> pa.Table:
    """The most frequent keys of (key, freq, ...), as a bounded table on the driver."""
    short = valued.where(F.octet_length("key") <= HEAD_BYTES)
    cut = _spark.head_cut(short, "freq", HEAD_KEYS)
    return short.where(F.col("freq") >= cut).select("key", *columns).toArrow()
