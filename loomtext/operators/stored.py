"""A stored index: postings in blocks with bounds, chunk lengths and statistics; vectors with their norms.

Postings lie in folders by hash of the term, so that a search opens those of its terms only, and in blocks of the chunks
of one span of numbers, each with the largest weight in it. A search sums the largest weights of a query's terms by span,
scores the best spans exactly, and then only those whose bound reaches the score of the last place: the result is that
of scoring everything.

An index is written to a version folder whose header comes last; the newest version with a header is the one to load.
Texts and blocks are dealt out by span, both when an index is made and when it is searched: what is counted or summed for
a chunk is so in one task, and neither postings nor scores are shuffled by term or by query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions import text as T
from . import folders
from .retrieval import CONFIG, by_score, query_blocks, top

#: Chunk numbers that a block covers; folders of terms, each with a file of each task that made blocks.
SPAN, PARTS = 256, 16
#: Tables in folders by part; without rows they have no files to take a schema from.
POSTINGS, TERMS = "term string, span long, n long, most double, hits array<struct<doc:long,w:double>>, part int", "term string, df long, part int"
#: Spans of a query that are scored first, for the score of its last place; spans to be scored that are broadcast (8 bytes each); scores that a task adds up at once.
FIRST, FEW, AT_ONCE = 8, 1 << 18, 1 << 20


def _new(spark: SparkSession, folder: str) -> str:
    found = [int(n[1:]) for n in folders.names(spark, folder) if n[:1] == "v" and n[1:].isdigit()]
    return f"{folder}/v{max(found, default=0) + 1}"


def _head(spark: SparkSession, at: str, **values) -> None:
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).coalesce(1).write.parquet(f"{at}/meta")


def _newest(spark: SparkSession, folder: str, wanted: dict) -> tuple[str, dict] | None:
    """The newest complete version and its header, or None if there is none or a wanted setting differs."""
    found = [int(n[1:]) for n in folders.names(spark, folder) if n[:1] == "v" and n[1:].isdigit() and folders.there(spark, f"{folder}/{n}/meta/_SUCCESS")]
    if not found:
        return None
    at = f"{folder}/v{max(found)}"
    head = spark.read.parquet(f"{at}/meta").first().asDict()
    return (at, head) if all(head.get(k) == v for k, v in wanted.items()) else None


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


class Postings:
    """A loaded lexical index; ``save`` and ``load`` make one."""

    def __init__(self, spark: SparkSession, at: str, head: dict):
        self.spark, self.at, self.head = spark, at, head

    @property
    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/chunks")

    @property
    def blocks(self) -> DataFrame:
        """(part, term, span, n, most, hits): the chunks of a span that hold the term, and their largest weight."""
        return self.spark.read.schema(POSTINGS).parquet(f"{self.at}/postings")

    @property
    def terms(self) -> DataFrame:
        """(part, term, df)."""
        return self.spark.read.schema(TERMS).parquet(f"{self.at}/terms")

    def asked(self, queries: DataFrame, cfg: RetrievalConfig = CONFIG) -> DataFrame:
        """(query_id, part, term, idf) of the queries' terms that the index holds; only their folders are read."""
        tokens = F.array_distinct(F.slice(T.tokens(F.col("text")), 1, cfg.query_terms))
        asked = queries.select("query_id", F.explode(tokens).alias("term")).withColumn("part", _part(F.col("term"), self.head["parts"]))
        n = F.lit(self.head["n_chunks"])
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return asked.join(self._within(self.terms, asked), ["part", "term"]).select("query_id", "part", "term", idf.alias("idf"))

    def _within(self, table: DataFrame, asked: DataFrame) -> DataFrame:
        parts = [r["part"] for r in asked.select("part").distinct().collect()]  # at most as many as there are folders
        return table.where(F.col("part").isin(parts))

    def search(self, queries: DataFrame, limit: int = 24, cfg: RetrievalConfig = CONFIG) -> DataFrame:
        """(query_id, key, path, score, rank): what ``bm25_search`` gives over the index's chunks. queries(query_id, text).

        A block of queries has a bounded number of terms, which are broadcast. Blocks of postings of these terms, once for
        all queries, are shuffled by span, and of a span's scores only each query's best leave the task. Spans that no
        query needs are left out before, unless there are very many to be scored.
        """
        k = max(1, min(cfg.bm25_cap, limit))
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(q: DataFrame) -> DataFrame:
            table = self.asked(q, cfg).toArrow()  # at most 24 * QUERY_BLOCK rows
            asked = self.spark.createDataFrame(table, f"query_id {kind}, part int, term string, idf double")
            held = self._within(self.blocks, asked).join(F.broadcast(asked.select("part", "term").distinct()), ["part", "term"], "left_semi")
            terms = F.broadcast(asked.select("query_id", "term", "idf"))
            bounds = held.select("span", "term", "most").repartition("span").join(terms, "term").groupBy("span", "query_id").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
            first = top(bounds, FIRST, F.col("bound").desc(), F.col("span")).select("query_id", "span").toArrow()  # at most FIRST * QUERY_BLOCK rows
            spans = self.spark.createDataFrame(first.select(["span"]), "span long").distinct()
            ahead = self._scored(held.join(F.broadcast(spans), "span", "left_semi"), table, k, first=first)
            last = top(ahead, k, F.col("score").desc()).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).toArrow()
            # Sums in another order differ in the last places, and ranks go by nine of them.
            least = F.broadcast(self.spark.createDataFrame(last.select(["query_id", "least"]), f"query_id {kind}, least double"))
            needed = bounds.join(least, "query_id", "left").where("least is null or bound >= least - 1e-6").select("span").distinct()
            few = needed.limit(FEW + 1).toArrow()
            held = held.join(F.broadcast(self.spark.createDataFrame(few, "span long")), "span", "left_semi") if len(few) <= FEW else held
            place = F.rank().over(Window.partitionBy("query_id").orderBy(by_score()))  # ties of the last place meet their keys below
            best = self._scored(held, table, k, last=last).withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
            return top(best.join(self.chunks.select("doc", "key", "path"), "doc").select("query_id", "key", "path", "score"), k, by_score(), F.col("key"))

        return query_blocks(queries, run)

    def _scored(self, held: DataFrame, asked: pa.Table, k: int, first: pa.Table | None = None, last: pa.Table | None = None) -> DataFrame:
        """(query_id, doc, score): in each span of the blocks held, a query's k best chunks and those that equal the last of them.

        first(query_id, span): the only pairs to be scored; last(query_id, least): scores that a query's chunks must reach.
        """
        ids = pc.unique(asked["query_id"])
        number = lambda column: pc.index_in(column, ids).to_numpy()
        order = np.argsort(asked["term"].to_numpy(), kind="stable")
        asked = asked.take(pa.array(order)).combine_chunks()
        terms, least, only = pc.unique(asked["term"]), np.full(len(ids), -np.inf), None
        begin = np.searchsorted(pc.index_in(asked["term"], terms).to_numpy(), np.arange(len(terms) + 1))
        if last is not None and len(last):
            least[number(last["query_id"])] = last["least"].to_numpy() - 1e-6
        if first is not None:
            only = {}
            for span, query in zip(first["span"].to_pylist(), number(first["query_id"]).tolist(), strict=True):
                only.setdefault(span, []).append(query)
        shared = self.spark.sparkContext.broadcast((ids, terms, begin, number(asked["query_id"]), asked["idf"].to_numpy(), least, only))
        width = SPAN

        def best(t: pa.Table) -> pa.Table:
            ids, terms, begin, query, idf, least, only = shared.value
            span, docs = t["span"][0].as_py(), t["docs"].combine_chunks()
            term = pc.index_in(t["term"], terms).to_numpy()[pc.list_parent_indices(docs).to_numpy()]
            at, w = pc.list_flatten(docs).to_numpy() - span * width, pc.list_flatten(t["ws"].combine_chunks()).to_numpy()
            times = begin[term + 1] - begin[term]
            total, score, done = np.cumsum(times), np.zeros(len(ids) * width), 0
            while done < len(at):
                # Each hit counts for each query that asks for its term.
                to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + AT_ONCE, "right")))
                n = times[done:to]
                hit = np.repeat(np.arange(done, to), n)
                ask = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + begin[term[hit]]
                score += np.bincount(query[ask] * width + at[hit], w[hit] * idf[ask], len(score))
                done = to
            score = score.reshape(len(ids), width)
            rank = np.round(score, 9)
            low = np.partition(rank, -k, axis=1)[:, -k][:, None] if width > k else np.zeros((len(ids), 1))
            keep = (score > 0) & (rank >= low) & (score >= least[:, None])
            if only is not None:
                some = np.zeros(len(ids), bool)
                some[only.get(span, [])] = True
                keep &= some[:, None]
            row, place = np.nonzero(keep)
            return pa.table([ids.take(pa.array(row)), pa.array(place + span * width), pa.array(score[row, place])], ["query_id", "doc", "score"])

        kind = self.spark.createDataFrame(asked.select(["query_id"]).slice(0, 0)).schema["query_id"].dataType.simpleString()
        narrow = held.select("span", "term", F.col("hits.doc").alias("docs"), F.col("hits.w").alias("ws"))
        return narrow.groupBy("span").applyInArrow(best, f"query_id {kind}, doc long, score double")


def _blocks_of(k1: float, b: float, avgdl: float) -> Callable[[pa.Table], pa.Table]:
    """From the chunks (span, doc, len, terms) of a span to its blocks (term, span, n, most, hits)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc").combine_chunks()
        lists = t["terms"].combine_chunks()
        words = pc.list_flatten(lists).dictionary_encode()
        # tf of each term and chunk, by term, then chunk.
        pair, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(t) + pc.list_parent_indices(lists).to_numpy(), return_counts=True)
        term, at = pair // len(t), pair % len(t)
        w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * t["len"].to_numpy()[at] / avgdl))
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        hits = pa.StructArray.from_arrays([t["doc"].combine_chunks().take(pa.array(at)), pa.array(w)], ["doc", "w"])
        return pa.table(
            [
                words.dictionary.take(pa.array(term[begin])),
                pa.array(np.full(len(begin), t["span"][0].as_py())),
                pa.array(np.diff(np.append(begin, len(term)))),
                pa.array(np.maximum.reduceat(w, begin)),
                pa.ListArray.from_arrays(pa.array(np.append(begin, len(term)).astype(np.int32)), hits),
            ],
            ["term", "span", "n", "most", "hits"],
        )

    return run


def save(chunks: DataFrame, folder: str, cfg: RetrievalConfig = CONFIG, parts: int = PARTS, **settings) -> Postings:
    """Writes chunks(key, path, text, ...) as a new version of the index in folder, with settings in its header."""
    spark = chunks.sparkSession
    at = _new(spark, folder)
    chunks.withColumn("len", F.size(T.tokens(F.col("text"))).cast("long")).withColumn("doc", F.monotonically_increasing_id()).write.parquet(f"{at}/chunks")
    held = spark.read.parquet(f"{at}/chunks")
    stats = held.where("len > 0").agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl")).first().asDict()
    by_span = held.where("len > 0").select(F.floor(F.col("doc") / SPAN).alias("span"), "doc", "len", "text").repartition("span")
    by_span = by_span.select("span", "doc", "len", T.tokens(F.col("text")).alias("terms"))
    blocks = by_span.groupBy("span").applyInArrow(_blocks_of(cfg.bm25_k1, cfg.bm25_b, stats["avgdl"]), POSTINGS.removesuffix(", part int"))
    blocks = blocks.withColumn("part", _part(F.col("term"), parts))
    # Each task writes its spans' blocks into the folders of their terms: once shuffled by span, they are not shuffled again.
    blocks.sortWithinPartitions("part", "term", "span").write.partitionBy("part").parquet(f"{at}/postings")
    terms = spark.read.schema(POSTINGS).parquet(f"{at}/postings").groupBy("part", "term").agg(F.sum("n").alias("df"))
    terms.hint("rebalance", "part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{at}/terms")
    _head(spark, at, parts=parts, k1=cfg.bm25_k1, b=cfg.bm25_b, **stats, **settings)
    return load(spark, folder, cfg, **settings)


def load(spark: SparkSession, folder: str, cfg: RetrievalConfig = CONFIG, **settings) -> Postings | None:
    """The newest index in folder, or None if there is none or it was made with other settings: then it is to be saved anew."""
    found = _newest(spark, folder, {"k1": cfg.bm25_k1, "b": cfg.bm25_b, **settings})
    return Postings(spark, *found) if found else None


def save_vectors(vectors: DataFrame, folder: str, backend: str, **settings) -> DataFrame:
    """Writes vectors(key, path, vector, ...) with their lengths and norms as a new version, and gives it back.

    Null vectors, and those with null or non-finite numbers, are left out.
    """
    spark = vectors.sparkSession
    at = _new(spark, folder)
    sound = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    vectors.where(sound).withColumns({"dim": F.size("vector"), "norm": F.sqrt(square)}).write.parquet(f"{at}/vectors")
    dims = spark.read.parquet(f"{at}/vectors").agg(F.coalesce(F.max("dim"), F.lit(0)).alias("dim"), F.count("*").alias("n_vectors")).first().asDict()
    _head(spark, at, backend=backend, **dims, **settings)
    return load_vectors(spark, folder, backend, **settings)


def load_vectors(spark: SparkSession, folder: str, backend: str, **settings) -> DataFrame | None:
    """The newest vectors in folder, or None if there are none or another backend or other settings made them."""
    found = _newest(spark, folder, {"backend": backend, **settings})
    return spark.read.parquet(f"{found[0]}/vectors") if found else None


def state_of(df: DataFrame) -> str:
    """A digest of the files that df reads: their paths, sizes and times of change."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return files.agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.md5(F.concat_ws("|", "file_path", "file_size", "file_modification_time")))), ","))).first()[0]
