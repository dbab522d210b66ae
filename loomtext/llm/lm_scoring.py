"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is modelled as its words, with A-Z in lower case, joined by single spaces, then an end symbol. The trie of
contexts of up to ``order`` bytes is held as a table of n-grams with counts, which grows with the corpus and is
never collected. A symbol's probability is its share of the longest context that has been seen, with escape
method C (as many escapes as distinct symbols) and with exclusion of the symbols of longer contexts; below order 0
all symbols left are equal. The code length of each distinct n-gram is computed once, where all contexts that end
in the same two bytes are together (orders 1 and 0 have at most 65,536 rows and are broadcast), and joined to the
documents' n-gram counts.

``adaptive_code_length`` instead learns from each document alone, symbol by symbol.

Defined cases: null and empty texts are the end symbol alone; repeated rows count and score as often as they
stand; a null doc_id counts as the empty text in the split; other columns are ignored; an empty table gives no
rows, and no training text gives every symbol 1/256; texts of any length are scored whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, keyed
from ._text import LOWER, flat, pieces, segment_sum, spans_array, words

#: Neither byte is part of UTF-8 text: the context before a text, and the symbol after it.
PAD, END, SYMBOLS = 0xFE, 0xFF, 256
#: Bound of the broadcast n-grams: 2**20 of 16 bytes each.
HEAD_GRAMS, SLOT_BITS = 1 << 20, 22
#: Bytes of text whose words and whose n-grams are worked on at a time; n-grams with counts that a task merges at once, and that it keeps then.
TEXT_BYTES, GRAM_BYTES, MERGED, KEPT = 2 << 20, 1 << 18, 1_500_000, 1_000_000
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The padded symbols of all documents in one buffer, the places of the symbols that are scored, and for each document the index of its first place."""
    n, size = len(first) - 1, ends - starts
    per_doc = np.diff(first)
    body = segment_sum(size + 1, first)
    length = np.maximum(body, 1)
    base = np.concatenate(([0], np.cumsum(length + order)))
    out = np.full(int(base[-1]), PAD, np.uint8)
    doc = np.repeat(np.arange(n), per_doc)
    before = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    lead = np.concatenate((before, [0]))[np.minimum(first[:-1], len(before))] if len(before) else np.zeros(n, np.int64)
    to = base[doc] + order + before - lead[doc]
    at = np.arange(int(size.sum()), dtype=np.int64)
    skip = np.cumsum(size) - size
    out[at + np.repeat(to - skip, size)] = data[at + np.repeat(starts - skip, size)]
    out[to + size] = 32
    out[base[1:] - 1] = END
    place = np.ones(len(out), bool)
    place[(base[:-1, None] + np.arange(order)).ravel()] = False
    return out, np.flatnonzero(place), np.concatenate(([0], np.cumsum(length)))


def grams(symbols: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """The symbol at each place below its ``order`` context symbols, packed into one integer."""
    g = np.zeros(len(symbols) - order if len(symbols) else 0, np.uint64)
    for k in range(order + 1):
        g <<= np.uint64(8)
        g |= symbols[k : len(symbols) - order + k]
    return g[places - order]


def code_lengths(wanted: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of the last symbol of each wanted n-gram.

    levels[k]: sorted n-grams of k context bytes and a symbol, with their counts, for k from 0 to the order. They
    must hold every one whose last bytes any wanted n-gram shares.
    """
    out, todo = np.zeros(len(wanted)), np.arange(len(wanted))
    above, was, at = None, np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        grams_k, n = levels[k]
        if not len(grams_k):
            was = np.zeros(len(todo), bool)
            above = None
            continue
        ctx, begin = np.unique(grams_k >> np.uint64(8), return_index=True)
        q = np.diff(np.append(begin, len(grams_k)))
        total = np.add.reduceat(n, begin)
        key = wanted[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
        c = np.minimum(np.searchsorted(ctx, key >> np.uint64(8)), len(ctx) - 1)
        seen = ctx[c] == key >> np.uint64(8)
        left, kinds = total[c].astype(float), q[c].astype(float)
        if above is not None:  # exclude the symbols of the longer context
            up, up_begin, up_q = above
            covered = np.add.reduceat(n[np.searchsorted(grams_k, up & np.uint64((1 << 8 * (k + 1)) - 1))], up_begin)
            left -= np.where(was, covered[at], 0)
            kinds -= np.where(was, up_q[at], 0)
        p = np.minimum(np.searchsorted(grams_k, key), len(grams_k) - 1)
        hit = seen & (grams_k[p] == key)
        whole = np.where(left + kinds > 0, left + kinds, 1)
        share = np.where(hit, n[p], np.where(seen & (left + kinds > 0), kinds, whole))
        out[todo] += np.log10(share / whole)
        above = (grams_k, begin, q)
        todo, was, at = todo[~hit], seen[~hit], c[~hit]
    if len(todo):
        out[todo] -= math.log10(SYMBOLS - (len(levels[0][0]) if len(levels[0][0]) else 0))
    return out


def _marginal(g: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of the last ``width`` bytes with the sums of their counts."""
    u, i = np.unique(g & np.uint64((1 << 8 * width) - 1), return_inverse=True)
    return u, np.bincount(i, weights=n, minlength=len(u)).astype(np.int64)


class HeadTable:
    """A fixed hash table of n-grams with two places each; n-grams that find none are treated like any rare one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.key, self.value = np.full(1 << SLOT_BITS, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << SLOT_BITS)
        for k in (_K1, _K2):
            slot = self._slot(keys, k)
            free = self.key[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.key[slot[free]], self.value[slot[free]] = keys[free], values[free]
            lost = self.key[slot] != keys
            keys, values = keys[lost], values[lost]

    @staticmethod
    def _slot(keys: np.ndarray, k: np.uint64) -> np.ndarray:
        return ((keys * k) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, or 0 where there is none; indexes of the keys without one)."""
        slot = self._slot(keys, _K1)
        value = self.value[slot]
        miss = np.flatnonzero(self.key[slot] != keys)
        slot = self._slot(keys[miss], _K2)
        hit = self.key[slot] == keys[miss]
        value[miss] = np.where(hit, self.value[slot], 0)
        return value, miss[~hit]


def _gram_keys(g: np.ndarray) -> pa.Array:
    """n-grams as nine-byte keys, which no word can be: they begin with a byte that UTF-8 has not."""
    raw = np.empty((len(g), 9), np.uint8)
    raw[:, 0] = PAD
    raw[:, 1:] = g.astype(">u8").view(np.uint8).reshape(-1, 8)
    return pa.BinaryArray.from_buffers(pa.binary(), len(g), [None, pa.py_buffer((np.arange(len(g) + 1) * 9).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of all (keys, counts), with the sums of their counts; held is emptied."""
    keys, counts = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    held.clear()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    del order
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def _prepared(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offs = flat(b.column("text"))
    data = LOWER[data]
    return data, *words(data, offs)


def text_grams(b: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of each symbol that is scored, and for each document the index of its first one (and the end)."""
    symbols, places, begin = stream(*_prepared(b), order)
    return grams(symbols, places, order), begin


def score(docs: DataFrame, held_out, order: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    held_out: boolean Column over docs; rows where it is true are scored but not learnt from. order: at most 6.
    base_score: log10 probability of the words and the end under unigrams with one added to each count.
    """
    spark = docs.sparkSession
    scratch = _spark.Scratch(spark)
    docs = _spark.with_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out")), scratch)

    def word_keys(batch: pa.RecordBatch) -> Iterator[pa.Array]:
        for b in pieces(batch, "text"):
            data, starts, ends, _ = _prepared(b)
            yield spans_array(data, starts, ends)

    trained = scratch.cut(keyed.count_keys(docs.where("not held_out"), ["text"], word_keys), "words")
    n_words, kinds = trained.agg(F.coalesce(F.sum("freq"), F.lit(0)), F.count("*")).first()
    n_docs = docs.where("not held_out").count()
    n, v = n_words + n_docs, kinds + (n_docs > 0)
    unit = math.log10(n + v + 1)

    def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def passed(u: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            for x in range(0, len(u), 100_000):
                g, uses = u[x : x + 100_000], c[x : x + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array((g >> np.uint64(1)).view(np.int64)), pa.array(np.where(g & np.uint64(1), 0, uses)), pa.array(uses)], ["g", "n", "uses"])

        size = 0
        for batch in batches:
            for b in pieces(batch, "text", GRAM_BYTES):
                g, begin = text_grams(b, order)
                g <<= np.uint64(1)
                g |= np.repeat(b.column("held_out").to_numpy(zero_copy_only=False), np.diff(begin)).astype(np.uint64)
                held.append(np.unique(g, return_counts=True))
                size += len(held[-1][0])
                if size > MERGED:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > KEPT:
                        yield from passed(*held.pop())
                        size = 0
        if held:
            yield from passed(*merged(held))

    counted = docs.select("text", "held_out").mapInArrow(gram_counts, "g long, n long, uses long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))
    counted = scratch.cut(counted, "grams")
    short = counted.where("n > 0").groupBy((F.col("g").bitwiseAND(0xFFFF)).alias("g")).agg(F.sum("n").alias("n")).toArrow()  # at most 65,536 rows
    g1, n1 = short["g"].to_numpy().astype(np.uint64), short["n"].to_numpy()
    low = [_marginal(g1, n1, 1), _marginal(g1, n1, 2)]

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def prices(t: pa.Table) -> Iterator[pa.RecordBatch]:
            g, m = t["g"].to_numpy().astype(np.uint64), t["n"].to_numpy()
            known = m > 0
            levels = [*low, *(_marginal(g[known], m[known], k + 1) for k in range(2, order + 1))]
            value = code_lengths(g, levels)
            out = pa.RecordBatch.from_arrays([_gram_keys(g), t["g"].combine_chunks(), t["uses"].combine_chunks(), pa.array(value)], ["key", "g", "uses", "value"])
            yield from (out.slice(x, 100_000) for x in range(0, len(out), 100_000))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > 200_000:
                t = pa.Table.from_batches(held)
                tail = t["tail"].to_numpy()
                cut = int(np.searchsorted(tail, tail[-1]))  # the last context may go on
                if cut:
                    yield from prices(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from prices(pa.Table.from_batches(held))

    tail = F.shiftright("g", 8).bitwiseAND(0xFFFF)
    valued = counted.withColumn("tail", tail).repartition("tail").sortWithinPartitions("tail").mapInArrow(priced, "key binary, g long, uses long, value double")
    valued = scratch.cut(valued, "prices")
    scratch.drop("grams")
    often = valued.where(F.col("uses") >= _spark.head_cut(valued, "uses", HEAD_GRAMS)).select("g", "value").toArrow()
    top = keyed.head_of(trained, ["freq"])
    shared = spark.sparkContext.broadcast((top, often["g"].to_numpy(), often["value"].to_numpy()))
    del often, top

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, keys, values = shared.value
        table = HeadTable(keys.astype(np.uint64), values)
        word_list = top["key"].combine_chunks().cast(pa.large_binary())
        freq = np.append(top["freq"].to_numpy(), 0)
        value = np.log10(freq + 1.0) - unit

        def summed_grams(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Each document's sum over the n-grams of the table; document, n-gram and how often of all others."""
            g, begin = text_grams(b, order)
            worth, miss = table.find(g)
            total = segment_sum(worth, begin)
            gd, gk = np.searchsorted(begin, miss, "right") - 1, g[miss]
            order_ = np.lexsort((gk, gd))
            gd, gk = gd[order_], gk[order_]
            new = np.ones(len(gd), bool)
            new[1:] = (gd[1:] != gd[:-1]) | (gk[1:] != gk[:-1])
            lead = np.flatnonzero(new)
            return total, gd[lead], gk[lead], np.diff(np.append(lead, len(gd)))

        for batch in batches:
            for b in pieces(batch, "text", TEXT_BYTES):
                rows = len(b)
                data, starts, ends, first = _prepared(b)
                code = spans_array(data, starts, ends).dictionary_encode()
                at = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                found = pc.fill_null(pc.index_in(code.dictionary, word_list), len(word_list)).to_numpy(zero_copy_only=False)[at] if len(at) else at
                head = found < len(word_list)
                base = segment_sum(np.where(head, value[found], 0.0), first) + (math.log10(n_docs + 1) - unit)
                known = segment_sum(head.astype(np.int64), first) + (n_docs > 0)
                doc = np.repeat(np.arange(rows), np.diff(first))[~head]
                kinds_here = max(1, len(code.dictionary))
                pair, times = np.unique(doc * kinds_here + at[~head], return_counts=True)
                wd, wk = pair // kinds_here, pair % kinds_here
                some = [(len(x), *summed_grams(x)) for x in pieces(b, "text", GRAM_BYTES)]
                before = np.cumsum([0] + [x[0] for x in some])
                total, gk, g_times = (np.concatenate([x[k] for x in some]) for k in (1, 3, 4))
                gd = np.concatenate([x[2] + at for x, at in zip(some, before, strict=False)])
                del some
                # Each document has one row of its own, whose key matches nothing and is spread over the partitions.
                own = [b"\xff" + int(r).to_bytes(8, "big", signed=True) for r in b.column("row").to_numpy()]
                d = np.concatenate((np.arange(rows), wd, gd))
                zero = np.zeros(len(d) - rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("row").take(pa.array(d)),
                        b.column("id").take(pa.array(d)),
                        b.column("held_out").take(pa.array(d)),
                        pa.array(np.concatenate((np.diff(first) + 1, zero)).astype(np.int64)),
                        pa.array(np.concatenate((known, zero)).astype(np.int64)),
                        pa.array(np.concatenate((base, zero))),
                        pa.array(np.concatenate((total, zero))),
                        pa.concat_arrays([pa.array(own, pa.binary()), code.dictionary.take(pa.array(wk)).cast(pa.binary()), _gram_keys(gk)]),
                        pa.array(np.concatenate((np.zeros(rows, np.int64), times, g_times)).astype(np.int64)),
                        pa.array(np.concatenate((np.zeros(rows, np.int8), np.ones(len(wd), np.int8), np.full(len(gd), 2, np.int8)))),
                    ],
                    ["row", "id", "held_out", "n_tokens", "n_known", "base", "total", "key", "times", "kind"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    parts = docs.mapInArrow(summed, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, total double, key binary, times long, kind byte")
    values = trained.select("key", F.col("freq"), F.lit(None).cast("double").alias("value")).unionByName(valued.select("key", F.lit(None).cast("long").alias("freq"), "value"))
    return (
        parts.join(values, "key", "left")
        .groupBy("row", "id", "held_out")
        .agg(
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when((F.col("kind") == 1) & (F.col("freq") > 0), F.col("times")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + F.when(F.col("kind") == 1, F.col("times") * (F.log10(F.coalesce("freq", F.lit(0)) + F.lit(1.0)) - unit)).otherwise(0.0)).alias("base_score"),
            F.sum(F.col("total") + F.when(F.col("kind") == 2, F.col("times") * F.col("value")).otherwise(0.0)).alias("score"),
        )
        .select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    )


class Trie:
    """A PPM model in memory: counts by context; for one document, and to hold the distributed model against."""

    def __init__(self, order: int = 5):
        self.order, self.counts = order, defaultdict(lambda: defaultdict(int))

    def log10p(self, context: bytes, symbol: int) -> float:
        out, excluded = 0.0, frozenset()
        for k in range(self.order, -1, -1):
            seen = self.counts.get(context[len(context) - k :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in excluded}
            whole = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / whole)
            if whole:
                out += math.log10(len(left) / whole)
            excluded = frozenset(seen)
        return out - math.log10(SYMBOLS - len(excluded))

    def add(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            self.counts[context[len(context) - k :]][symbol] += 1

    def run(self, text: bytes, learn: bool, price: bool = True) -> float:
        """log10 probability of a text in normal form; learn: count each symbol once it is priced."""
        padded, total = bytes([PAD]) * self.order + text + bytes([END]), 0.0
        for i in range(self.order, len(padded)):
            context = padded[i - self.order : i]
            total += self.log10p(context, padded[i]) if price else 0.0
            if learn:
                self.add(context, padded[i])
        return total


def normal_form(text: str | None) -> bytes:
    raw = (text or "").encode()
    return b" ".join(x for x in raw.translate(LOWER.tobytes()).translate(bytes(range(256)).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ")).split(b" ") if x)


def adaptive_code_length(docs: DataFrame, order: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_symbols, bits): the code length of each text under a model that learns from that text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", 1 << 16):
                texts = [normal_form(t) for t in b.column("text").to_pylist()]
                bits = [-Trie(order).run(t, learn=True) * math.log2(10) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array(bits, pa.float64())], ["id", "n_symbols", "bits"])

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_symbols long, bits double").withColumnRenamed("id", id_col)
