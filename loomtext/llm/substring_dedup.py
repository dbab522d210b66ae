"""Exact removal of repeated byte strings with suffix order and longest-previous-factor arrays.

A string of ``length`` bytes that starts at two places of the corpus has the same content at both, so it has
the same *anchor* at both: the least hash of its ``GRAM``-byte substrings. Consecutive starts with one anchor
form a region; only regions with the same anchor can share strings. So the corpus is dealt out by anchor:

1. Regions are found and hashed where the documents are read; an anchor seen once is dropped, unless it stands
   twice in its own region (periodic text).
2. Regions of equal content are counted as a class. All strings of a class with two members are repeated.
3. The other classes of an anchor are compared by suffix order: positions are sorted by the ``length`` bytes
   that follow, and for each the previous and the next smaller position in that order give its longest earlier
   match (LPF). Anchors with more than ``GROUP`` classes are compared through hashes of all their strings
   instead, counted in a shuffle, so that no anchor is ever one task's work.

Two regions count as equal if 128 hash bits and their lengths agree.

Defined cases: null and empty texts have 0 bytes; texts shorter than ``length`` bytes lose nothing; repeated rows
are documents of their own, so their strings repeat; null doc_ids are kept; other columns are ignored; an empty
table gives no rows; a string's copies may overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark
from ._text import BASE, BYTE, flat, inverse_powers, mix, pieces, powers

GRAM = 32
#: Classes of one anchor that a task compares by suffix order: 7 MB of text, about 350 MB of arrays.
GROUP = 24_000
CHUNK = 1 << 20


def _gram_hash(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes (a power of two) from each position; the last n - 1 positions are cut off."""
    h, size, p = BYTE[data], 1, BASE
    while size < n:
        h = h[:-size] * p + h[size:]
        p, size = p * p, size * 2
    return mix(h)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h, size = np.minimum(h[:-size], h[size:]), size * 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :])


def regions(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, document, start in the document, bytes, may repeat in itself) of all regions of a batch of documents."""
    out = []
    ends = np.repeat(offs[1:], np.diff(offs)) if len(data) else np.zeros(0, np.int64)
    for c in range(0, len(data), CHUNK):
        part = data[c : c + CHUNK + length - 1]
        if len(part) < length:
            break
        with np.errstate(over="ignore"):
            gram = _gram_hash(part, GRAM)
            low = _sliding_min(gram, length - GRAM + 1)
            x = np.arange(c, c + len(low))
            valid = x + length <= ends[c : c + len(low)]
            first = valid.copy()
            first[1:] &= ~(valid[:-1] & (low[1:] == low[:-1]))
            last = valid.copy()
            last[:-1] &= ~(valid[1:] & (low[1:] == low[:-1]))
            s, e = np.flatnonzero(first), np.flatnonzero(last) + length
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[part] * powers(len(part)), dtype=np.uint64)))
            content = mix((total[e] - total[s]) * inverse_powers(len(part) + 1)[s])
            # Anchors: least in some string. A string can only repeat within its own region if its anchor is there twice.
            pad = np.zeros(length - GRAM, np.uint64)
            anchor = np.flatnonzero(gram == ~_sliding_min(~np.concatenate((pad, low, pad)), length - GRAM + 1))
            near = (np.diff(anchor) <= length - GRAM) & (gram[anchor[1:]] == gram[anchor[:-1]])
            twin = np.isin(low[s], gram[anchor[1:][near]])
        doc = np.searchsorted(offs, s + c, "right") - 1
        out.append((low[s].view(np.int64), content.view(np.int64), doc, s + c - offs[doc], e - s, twin))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank, in suffix order bounded to ``length`` bytes, of each position with so many bytes after it (prefix doubling)."""
    word = np.zeros(max(0, len(data) - 7), np.uint64)
    for k in range(8):
        word |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    rank, size = np.unique(word, return_inverse=True)[1].astype(np.int64), 8
    while size < length:
        step = min(size, length - size)
        pair = rank[: len(rank) - step] * (len(data) + 1) + rank[step:]
        rank, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), size + step
    return rank


def earlier_smaller(pos: np.ndarray) -> np.ndarray:
    """For each index, the nearest index before it whose value is smaller, else -1 (pointer jumping)."""
    prev = np.arange(-1, len(pos) - 1)
    todo = np.flatnonzero((prev >= 0) & (pos[np.maximum(prev, 0)] > pos))
    while len(todo):
        prev[todo] = prev[prev[todo]]
        todo = todo[(prev[todo] >= 0) & (pos[np.maximum(prev[todo], 0)] > pos[todo])]
    return prev


def repeated(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start (ascending; length bytes follow): has its string an earlier start, has it another start at all."""
    rank = window_ranks(data, length)[starts]
    order = np.lexsort((starts, rank))  # suffix order
    r, pos = rank[order], starts[order]
    before, after = earlier_smaller(pos), len(pos) - 1 - earlier_smaller(pos[::-1])[::-1]
    # The longest earlier match reaches length bytes if it does so with the previous or the next smaller position.
    lpf = ((before >= 0) & (r[np.maximum(before, 0)] == r)) | ((after < len(pos)) & (r[np.minimum(after, len(pos) - 1)] == r))
    # The first copy of a string stands where a run of equal strings begins, and has a later one if its run goes on.
    more = np.zeros(len(pos), bool)
    more[:-1] = r[1:] == r[:-1]
    earlier, other = np.zeros(len(pos), bool), np.zeros(len(pos), bool)
    earlier[order], other[order] = lpf, lpf | more
    return earlier, other


def _runs(flags: np.ndarray, key: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans [from, to) that the flagged strings of each key cover; strings of one key come in order of their start."""
    i = np.flatnonzero(flags)
    k, a = key[i], at[i]
    new = np.ones(len(i), bool)
    new[1:] = (k[1:] != k[:-1]) | (a[1:] > a[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    return k[first], a[first], a[last] + length


def repeated_spans(docs: DataFrame, scratch: _spark.Scratch, length: int = 200, keep_first: bool = False, text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(row, spans array<struct<s, e>>): byte spans to remove of the rows of docs, which has the columns row and text_col.

    keep_first: the first start of each string, by row and position, stays; else every copy goes.
    """
    texts = docs.select("row", F.col(text_col).alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                h, r, doc, at, size, twin = regions(*flat(b.column("text")), length)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(r), b.column("row").take(pa.array(doc)), pa.array(at), pa.array(size.astype(np.int32)), pa.array(twin)], ["h", "r", "row", "at", "size", "twin"])

    everything = scratch.cut(texts.mapInArrow(found, "h long, r long, row long, at long, size int, twin boolean"), "regions")
    several = everything.groupBy("h").agg(F.count("*").alias("c"), F.max("twin").alias("twin")).where("c > 1 or twin")
    some = scratch.cut(everything.join(several, "h", "left_semi"), "shared")
    scratch.drop("regions")
    classes = some.groupBy("h", "r", "size").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("first"), F.max("twin").alias("twin"))
    classes = scratch.cut(classes, "classes")
    # Anchors with several classes, of which some string may be found once in its own class.
    wide = classes.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max("twin").alias("twin")).where("k > 1 or twin" if keep_first else "(k > 1 or twin) and least = 1").drop("twin")
    reps = classes.join(wide, "h").select("h", "size", "n", "k", "first.row", "first.at")
    cut = reps.join(texts, "row").select("h", "row", "at", "n", "k", F.substring(F.col("text").cast("binary"), F.col("at").cast("int") + 1, F.col("size")).alias("part"))
    cut = scratch.cut(cut, "parts")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(t: pa.Table) -> pa.RecordBatch:
            data, offs = flat(t["part"])
            data = np.ascontiguousarray(data)
            n = np.diff(offs) - length + 1
            rep = np.repeat(np.arange(len(n)), n)
            rel = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            earlier, other = repeated(data, offs[rep] + rel, length)
            k, s, e = _runs(earlier if keep_first else other, rep, rel, length)
            row, at = t["row"].to_numpy()[k], t["at"].to_numpy()[k]
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(at + s), pa.array(at + e)], ["row", "s", "e"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for b in pieces(batch, "part", 1 << 20):
                if size > 1 << 20:
                    t = pa.Table.from_batches(held)
                    h = t["h"].to_numpy()
                    cut_at = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
                    if cut_at:
                        yield spans(t.slice(0, cut_at))
                        held = t.slice(cut_at).combine_chunks().to_batches()
                        size = sum(x.column("part").nbytes for x in held)
                held.append(b)
                size += b.column("part").nbytes
        if held:
            yield spans(pa.Table.from_batches(held))

    few = cut.where(F.col("k") <= group).select("h", "row", "at", "part")
    few = few.repartition("h").sortWithinPartitions("h", "row", "at").mapInArrow(compared, "row long, s long, e long")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "part", 1 << 18):
                data, offs = flat(b.column("part"))
                with np.errstate(over="ignore"):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(len(data)), dtype=np.uint64)))
                    n = np.diff(offs) - length + 1
                    rep = np.repeat(np.arange(len(n)), n)
                    rel = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    x = offs[rep] + rel
                    w = mix((total[x + length] - total[x]) * inverse_powers(len(data) + 1)[x])
                take = pa.array(rep)
                yield pa.RecordBatch.from_arrays([b.column("h").take(take), pa.array(w.view(np.int64)), b.column("row").take(take), pa.array(b.column("at").to_numpy()[rep] + rel)], ["h", "w", "row", "at"])

    many = cut.where(F.col("k") > group).mapInArrow(strings, "h long, w long, row long, at long")
    twice = many.groupBy("h", "w").agg(F.count("*").alias("c"), F.min(F.struct("row", "at")).alias("first")).where("c > 1")
    many = many.join(twice, ["h", "w"])
    if keep_first:
        many = many.where("row <> first.row or at <> first.at")
    many = many.select("row", F.col("at").alias("s"), (F.col("at") + length).alias("e"))

    whole = some.join(classes.where("n > 1"), ["h", "r", "size"])
    if keep_first:
        whole = whole.where("row <> first.row or at <> first.at")
    whole = whole.select("row", F.col("at").alias("s"), (F.col("at") + F.col("size")).alias("e"))
    return whole.unionByName(few).unionByName(many).groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, group: int = GROUP) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of each row of docs."""
    scratch = _spark.Scratch(docs.sparkSession)
    docs = _spark.with_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), scratch)
    joined = docs.join(repeated_spans(docs, scratch, length, keep_first, group=group), "row", "left").select("id", "text", "spans")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                data, offs = flat(b.column("text"))
                raw, (spans, so) = data.tobytes(), _span_lists(b.column("spans"))
                removed, runs, sums, texts = [], [], [], []
                for i in range(len(b)):
                    text = raw[offs[i] : offs[i + 1]]
                    gone, k = 0, 0
                    if so[i + 1] > so[i]:
                        own = spans[so[i] : so[i + 1]]
                        own = own[np.argsort(own[:, 0], kind="stable")]
                        reach = np.maximum.accumulate(own[:, 1])
                        first = np.flatnonzero(np.concatenate(([True], own[1:, 0] > reach[:-1])))
                        s, e = own[first, 0], reach[np.append(first[1:], len(own)) - 1]
                        gone, k = int((e - s).sum()), len(s)
                        text = b"".join(text[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True))
                    removed.append(gone)
                    runs.append(k)
                    sums.append(hashlib.sha256(text).hexdigest())
                    texts.append(text)
                cols = [b.column("id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sums)]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(texts, pa.binary())] * keep_text], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text])

    kind = docs.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(kept, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
    return out.withColumnRenamed("id", id_col)


def _span_lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The spans of all rows as one (n, 2) array, and the offsets of the rows; null counts as no spans."""
    n = np.asarray([0 if x is None else x for x in pa.compute.list_value_length(col).to_pylist()], np.int64)
    f = pa.compute.list_flatten(col)
    return np.stack([f.field(0).to_numpy(zero_copy_only=False), f.field(1).to_numpy(zero_copy_only=False)], 1), np.concatenate(([0], np.cumsum(n)))
