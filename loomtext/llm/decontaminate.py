"""Benchmark decontamination by spaced seeds.

Words (letters and digits, lower case) are hashed; each mask of ``MASKS`` picks ``WEIGHT`` of the words in a span
and ignores the rest, so that a span with substituted words still gives the hash of the original under some mask.
Hashes of the documents are joined to those of the test items; around each hit, item and document are laid side by
side at the hit's offset, and the aligned words are compared: an item is found if a run of at least ``min_words``
aligned words (or the whole item, if shorter) agrees in a share of at least ``similarity``.

The test items' hashes are broadcast while there are at most ``MAX_BROADCAST`` of them; beyond that the documents'
hashes go through a shuffle join with the same result.

Items of fewer than ``MIN_WORDS`` words need nearly exact copies: a hit needs all picked words of a mask, so a copy
with as many substitutions as ``similarity`` allows is often not found.

Defined cases: null and empty texts match nothing; items with fewer words than ``WEIGHT`` match a document only
where all their words stand in a row; items without words match nothing; repeated rows match each; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark
from ._text import flat, mix, pieces, span_hash, words

#: Word offsets that a mask picks. The first is a plain run; the others skip places, so that no single substitution, and no
#: two at a fixed distance, fall on a picked place of all.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 8), (0, 2, 3, 5, 8, 9), (0, 1, 4, 6, 7, 9), (0, 3, 4, 5, 7, 10))
WEIGHT, MIN_WORDS, SIMILARITY, MAX_BROADCAST = 6, 13, 0.8, 2_000_000
_COEFF = mix(np.arange(1, 17, dtype=np.uint64))


def normal(texts: pa.Array) -> pa.Array:
    texts = texts if not texts.null_count else pc.fill_null(texts, "")
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and for each text the index of its first (n + 1 values)."""
    data, offs = flat(normal(texts))
    starts, ends, first = words(data, offs)
    return span_hash(data, starts, ends), first


def seeds(h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask: its number, the hashes of its spans, and the words they start at; spans stay within a text."""
    end = np.repeat(first[1:], np.diff(first))
    for m, mask in enumerate(MASKS):
        n = len(h) - mask[-1]
        if n <= 0:
            continue
        s = np.full(n, np.uint64(m + 1))
        for j, k in enumerate(mask):
            s += h[k : k + n] * _COEFF[j]
        at = np.flatnonzero(np.arange(n) + mask[-1] < end[:n])
        yield m, mix(s[at]), at


class Items:
    """The test items' words and a hash index of their spans."""

    def __init__(self, ids: np.ndarray, h: np.ndarray, first: np.ndarray):
        self.ids, self.h, self.first = ids, h, first
        keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, s, at in seeds(h, first):
            keys.append(s)
            places.append(at)
        # Items too short for a mask are found through their first words.
        size = np.diff(first)
        self.short = np.flatnonzero((size > 0) & (size <= MASKS[0][-1]))
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], place[order]
        self.item = np.repeat(np.arange(len(ids)), size)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.key >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document word, item word) of all equal spans."""
        maybe = np.flatnonzero(self.bits[(s >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, s[maybe]), np.searchsorted(self.key, s[maybe], "right")
        n = hi - lo
        return np.repeat(at[maybe], n), self.place[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]


def best_run(equal: np.ndarray, least: int, similarity: float) -> tuple[int, int, int]:
    """(start, end, agreeing) of the longest run of at least ``least`` places that agree in a share of ``similarity``; (0, 0, 0) if none."""
    n = len(equal)
    total = np.concatenate(([0], np.cumsum(equal)))
    for size in range(n, max(1, least) - 1, -1):
        same = total[size:] - total[: n - size + 1]
        k = int(np.argmax(same))
        if same[k] >= similarity * size - 1e-9:
            return k, k + size, int(same[k])
    return 0, 0, 0


def verify(h: np.ndarray, first: np.ndarray, items: Items, doc_word: np.ndarray, item_word: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, start word, end word, agreeing words, item's words) of each item that is found in a document."""
    doc = np.searchsorted(first, doc_word, "right") - 1
    item = items.item[item_word]
    shift = doc_word - item_word
    seen = np.unique(np.stack([doc, item, shift]), axis=1)
    best: dict[tuple[int, int], tuple[int, int, int, int, int, int]] = {}
    for d, i, s in seen.T.tolist():
        a, b = items.first[i], items.first[i + 1]
        lo, hi = max(a, first[d] - s), min(b, first[d + 1] - s)
        equal = h[lo + s : hi + s] == items.h[lo:hi]
        x, y, same = best_run(equal, min(min_words, b - a), similarity)
        if same and same > best.get((d, i), (0,) * 6)[4]:
            best[d, i] = (d, i, int(lo + s + x - first[d]), int(lo + s + y - first[d]), same, int(b - a))
    return list(best.values())


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(id_col, item_col, start_word, end_word, n_match, item_words) for each row of docs and test item found in it."""
    spark, scratch = docs.sparkSession, _spark.Scratch(docs.sparkSession)
    tests = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = docs.schema["id"].dataType.simpleString(), tests.schema["item"].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, start_word long, end_word long, n_match long, item_words long"
    names = [id_col, item_col, "start_word", "end_word", "n_match", "item_words"]

    def emit(ids: pa.Array, items: Items, found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) if found else [[]] * 6
        doc = pa.array(cols[0], pa.int64())
        return pa.RecordBatch.from_arrays([ids.take(doc), items.ids.take(pa.array(cols[1], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[2:])], ["id", "item", "start_word", "end_word", "n_match", "item_words"])

    # Words bound the spans: at most one span a word and mask.
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size * len(MASKS) // 2 <= max_broadcast:
        shared = spark.sparkContext.broadcast(tests.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            items = Items(t["item"].combine_chunks(), *word_hashes(t["text"].combine_chunks()))
            for batch in batches:
                for b in pieces(batch, "text"):
                    h, first = word_hashes(b.column("text"))
                    pairs = [items.hits(s, at) for _, s, at in seeds(h, first)]
                    pairs += [(w, np.full(len(w), items.first[i])) for i in items.short if len(w := np.flatnonzero(h == items.h[items.first[i]]))]
                    if pairs:
                        yield emit(b.column("id"), items, verify(h, first, items, np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), min_words, similarity))

        return docs.mapInArrow(scan, schema).toDF(*names)

    docs = _spark.with_rows(docs, scratch)
    tests = _spark.with_rows(tests, scratch)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                h, first = word_hashes(b.column("text"))
                out = [(s, at) for _, s, at in seeds(h, first)]
                # A text's first word stands for it if it may be an item shorter than the masks.
                out.append((mix(h ^ np.uint64(1)), np.arange(len(h))))
                s, at = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
                doc = np.searchsorted(first, at, "right") - 1
                front = np.arange(len(s)) >= len(s) - len(h)
                lead = (at == first[doc]) & (np.diff(first)[doc] <= MASKS[0][-1])
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), b.column("row").take(pa.array(doc)), pa.array(~front | lead)], ["key", "row", "of_item"])

    item_keys = tests.mapInArrow(keys, "key long, row long, of_item boolean").where("of_item").select("key", F.col("row").alias("item_row")).distinct()
    # Spans that a document repeats count once; a hot span's rows are split by adaptive execution.
    pairs = docs.mapInArrow(keys, "key long, row long, of_item boolean").select("key", "row").join(item_keys, "key").select("row", "item_row").distinct()
    sides = pairs.join(docs, "row").join(tests.select(F.col("row").alias("item_row"), "item", F.col("text").alias("item_text")), "item_row").select("id", "text", "item", "item_text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                b = batch.slice(k, 1)
                items = Items(b.column("item"), *word_hashes(b.column("item_text")))
                h, first = word_hashes(b.column("text"))
                pairs = [items.hits(s, at) for _, s, at in seeds(h, first)]
                pairs += [(w, np.full(len(w), items.first[i])) for i in items.short if len(w := np.flatnonzero(h == items.h[items.first[i]]))]
                if pairs:
                    yield emit(b.column("id"), items, verify(h, first, items, np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), min_words, similarity))

    return sides.mapInArrow(check, schema).toDF(*names)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs in which no test item is found; rows with a null id stay unless found by a null id."""
    (leaked,) = _spark.fresh(docs.columns, "leaked")
    found = leaks(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias(leaked)).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(F.col(leaked)), "left_anti")
