"""Source divergence audit: how the terms of each source of a language differ from those of the language and of its other sources.

A term that fewer than ``min_df`` documents of its language hold has no part in any figure, and most distinct terms are
such. A first pass sums count-min sketches of document frequencies over all tasks; a sketch never underestimates, so what
it puts below ``min_df`` is dropped where the documents are read and never shuffled. A second pass counts the survivors
exactly, by language and source; the exact document frequency then decides.

The pair sums run over all kept terms of a language, though most sources lack most of them. A term that a source lacks
has one and the same rate there, so a sum is made of three parts: all terms as if absent in both; for each source its
counts, by how many terms have each, against the other's rate of an absent term; and a correction for the terms that
both have, found by a join on (language, term). All numbers are integers, so the parts add up exactly.

Bounds: a sketch has ``DEPTH * width`` counters that stop at 255, one byte each (8 MB at the default width), whatever the
input; a task sums its own in four bytes each. Results don't depend on the width, only how much is shuffled. Pairs of
sources are as many as the result has.

Defined cases: null texts, languages and sources are empty strings; each row is a document, so repeated rows count as
often as they stand there; a source without terms, and a language without kept terms, are there with pairs of value 0; an
empty table gives no rows; other columns, whatever their names, are ignored. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _spark
from ._text import LOWER, flat, mix, pieces, span_hash, spans_array, words

#: Bytes outside terms: [\x00-\x40\x5B-\x60\x7B-\x7F].
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Rows of the sketch, its counters in a row, and counters of a block, the unit that tasks merge.
DEPTH, WIDTH, BLOCK = 2, 1 << 22, 1 << 16
#: Parts that the counts of one source are dealt into where they meet the other sources of a language.
SALTS = 16
SCALE = 1_000_000_000


def _words(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, starts and ends of the terms, and each term's document."""
    data, offs = flat(b.column("text"))
    data = LOWER[data]
    s, e, first = words(data, offs, OUTSIDE)
    return data, s, e, np.repeat(np.arange(len(b)), np.diff(first))


def _keys(data: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray, langs: pa.Array) -> np.ndarray:
    """A 64-bit key of each term and its document's language."""
    code = langs.dictionary_encode()
    own = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in code.dictionary.to_pylist()], np.uint64)
    return mix(span_hash(data, s, e) ^ own[code.indices.to_numpy(zero_copy_only=False)][doc]) if len(s) else np.zeros(0, np.uint64)


def _places(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(keys + np.uint64(row * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(width - 1)).astype(np.int64)


def frequency_sketch(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The count-min sketch (DEPTH, width) of how many of the docs(lang, text) hold each (lang, term); counters stop at 255."""
    if width & (width - 1):
        raise ValueError("the width must be a power of two")
    size = min(BLOCK, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((DEPTH, width), np.int32)
        for batch in batches:
            for b in pieces(batch, "text"):
                data, s, e, doc = _words(b)
                if not len(s):
                    continue
                code = pa.array(_keys(data, s, e, doc, b.column("lang"))).dictionary_encode()
                at, keys = code.indices.to_numpy().astype(np.int64), code.dictionary.to_numpy()
                held = np.bincount(np.unique(doc * len(keys) + at) % len(keys), minlength=len(keys))
                for row in range(DEPTH):
                    np.add.at(own[row], _places(keys, row, width), held.astype(np.int32))
        full = np.flatnonzero(own.ravel())
        if not len(full):
            return
        value = np.minimum(own.ravel()[full], 255).astype(np.uint8)
        block = full // size
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        for a, z in zip(begin, np.append(begin[1:], len(full)), strict=True):
            place = (full[a:z] % size).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 1].astype(np.int32)), pa.array([place.tobytes()], pa.binary()), pa.array([value[a:z].tobytes()], pa.binary())], ["block", "place", "value"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, place, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = held.setdefault(block, np.zeros(size, np.uint8))
                at, v = np.frombuffer(place, np.uint16), np.frombuffer(value, np.uint8)
                total[at] = np.minimum(total[at].astype(np.int32) + v, 255)
        for block, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "value"])

    parts = docs.select("lang", "text").mapInArrow(count, "block int, place binary, value binary")
    merged = parts.repartition("block").mapInArrow(merge, "block int, value binary").toArrow()
    out = np.zeros((DEPTH * width // size, size), np.uint8)
    for block, value in zip(merged["block"].to_pylist(), merged["value"].to_pylist(), strict=True):
        out[block] = np.frombuffer(value, np.uint8)
    return out.reshape(DEPTH, width)


def possible(sketch: np.ndarray, keys: np.ndarray, least: int) -> np.ndarray:
    """Which keys may have a document frequency of ``least``: all that have it, and some others."""
    ok = np.ones(len(keys), bool)
    for row in range(len(sketch)):
        ok &= sketch[row][_places(keys, row, sketch.shape[1])] >= min(least, 255)
    return ok


def term_counts(docs: DataFrame, sketch: np.ndarray, least: int) -> DataFrame:
    """(lang, source, term, docs, n): exact counts of the terms that the sketch lets through; (lang, source, '', 0, 0) of each group."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def table(*columns: pa.Array) -> pa.Table:
        return pa.table(list(columns), ["lang", "source", "term", "docs", "n"])

    def merged(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("docs", "sum"), ("n", "sum")])
        return t.rename_columns({"docs_sum": "docs", "n_sum": "n"}).select(["lang", "source", "term", "docs", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for b in pieces(batch, "text"):
                group = pa.Table.from_batches([b.select(["lang", "source"])]).combine_chunks()
                groups = group.group_by(["lang", "source"], use_threads=False).aggregate([])
                place = {g: k for k, g in enumerate(zip(groups["lang"].to_pylist(), groups["source"].to_pylist(), strict=True))}
                own = np.array([place[g] for g in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)], np.int64)
                none = pa.array(np.zeros(len(groups), np.int64))
                marks = table(groups["lang"], groups["source"], pa.array([""] * len(groups), pa.string()), none, none)
                held.append(marks)
                rows += len(marks)
                data, s, e, doc = _words(b)
                if len(s):
                    code = pa.array(_keys(data, s, e, doc, b.column("lang"))).dictionary_encode()
                    keep = possible(shared.value, code.dictionary.to_numpy(), least)[code.indices.to_numpy()]
                    s, e, doc = s[keep], e[keep], doc[keep]
                if len(s):
                    code = spans_array(data, s, e).dictionary_encode()
                    size = len(code.dictionary)
                    pair, times = np.unique(doc * size + code.indices.to_numpy(), return_counts=True)
                    key, back = np.unique(own[pair // size] * size + pair % size, return_inverse=True)
                    term = code.dictionary.cast(pa.large_string()).cast(pa.string()).take(pa.array(key % size))
                    at = pa.array(key // size)
                    n = np.bincount(back, weights=times).astype(np.int64)
                    held.append(table(groups["lang"].take(at), groups["source"].take(at), term, pa.array(np.bincount(back).astype(np.int64)), pa.array(n)))
                    rows += len(key)
                if rows > 400_000:
                    t = merged(held)
                    held, rows = [t], len(t)
                    if rows > 200_000:
                        yield from t.combine_chunks().to_batches()
                        held, rows = [], 0
        if held:
            yield from merged(held).combine_chunks().to_batches()

    counted = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, docs long, n long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def rate(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), in decimals; null where no term is kept."""
    d = lambda c: f"cast({c} as decimal(20, 0))"
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + (({d(n)} + 2) * {SCALE}BD) div ({d(total)} + 2 * {d(kept)}) END")


def spread(p: str, q: str) -> str:
    """floor((p - q)**2 / (p + q)) of two rates, which are below 2**30: the square fits a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def _with_others(left: DataFrame, groups: DataFrame) -> DataFrame:
    """left(lang, source, ...) with each other group (b, b_p0) of the language; left is dealt into SALTS parts a language."""
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b_p0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return left.withColumn("salt", salt).join(other, ["lang", "salt"]).where("source <> b").drop("salt")


def divergence(docs: DataFrame, min_df: int = 10, top: int = 10, width: int = WIDTH, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair', each other source; part 'term', the ``top`` terms of a source.

    Of a language the terms that at least ``min_df`` of its documents hold are kept. A rate of a term is 1 + floor(SCALE *
    (count + 2) / (N + 2 V)), V the kept terms, N all their occurrences. A pair's value sums spread() of the two sources'
    rates over all kept terms; a term's, where the source has it at a higher rate than the language, is spread() of
    these two rates. Ranks order by value, largest first, then by item.
    """
    scratch = _spark.Scratch(docs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    counts = scratch.cut(term_counts(docs, frequency_sketch(docs, width), min_df), "counts")
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("lang_n")).where(F.col("df") >= min_df)
    terms = scratch.cut(terms.drop("df"), "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    held = scratch.cut(counts.where("term <> ''").select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = scratch.cut(groups.withColumn("p0", rate("0", "total", "kept")), "groups")
    rated = held.join(groups, ["lang", "source"]).select("lang", "source", "term", "p0", rate("n", "total", "kept").alias("p"), rate("lang_n", "lang_total", "kept").alias("q"))
    rated = scratch.cut(rated, "rated")

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    own = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(spread("p", "q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    absent = spread("p0", "b_p0")
    base = _with_others(groups.select("lang", "source", "p0", "kept"), groups).where("source < b").select("lang", "source", "b", F.expr(f"coalesce(kept * ({absent}), 0L)").alias("value"))
    levels = rated.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m"))
    alone = _with_others(levels, groups).select("lang", F.least("source", "b").alias("source"), F.greatest("source", "b").alias("b"), F.expr(f"m * ({spread('p', 'b_p0')} - {absent})").alias("value"))
    other = rated.select("lang", "term", F.col("source").alias("b"), F.col("p0").alias("b_p0"), F.col("p").alias("b_p"))
    both = rated.join(other, ["lang", "term"]).where("source < b").select("lang", "source", "b", F.expr(f"{spread('p', 'b_p')} - {spread('p', 'b_p0')} - {spread('p0', 'b_p')} + {absent}").alias("value"))
    pairs = base.unionByName(alone).unionByName(both).groupBy("lang", "source", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", ways.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(own)
