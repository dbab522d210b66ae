"""Retrieval: heuristic scan, BM25, dense nearest neighbours, fusion, diversification, reranking.

All operators take tables of queries, so that many queries share a plan. Scores order by value, rounded to nine
places so that the order of sums doesn't matter, then by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions import numeric as N
from ..functions import text as T
from . import folders
from .index import chunk_lengths, corpus_stats

CONFIG = RetrievalConfig()
#: Queries that one plan may broadcast (short texts or vectors); larger sets come in blocks of so many.
QUERY_BLOCK = 10_000
HIT = ("query_id", "provider", "key", "path", "title", "excerpt", "score", "reason_tags")


def query_blocks(queries: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run over the whole query set if it is small enough to broadcast, else over blocks of it, united."""
    n = queries.count()
    if n <= QUERY_BLOCK:
        return run(queries)
    blocks = -(-n // QUERY_BLOCK)
    out = None
    for k in range(blocks):
        part = run(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k))
        out = part if out is None else out.unionByName(part)
    return out


def top(df: DataFrame, k: int | Column, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of each query, with their ``rank`` from 1; Spark cuts groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def by_score(c: str = "score") -> Column:
    return F.round(F.col(c), 9).desc()


def _trigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda i: F.substring(text, i, F.lit(3))))


def name_hits(names: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, path) of the names(path, base) that contain a term of at least three characters; terms(term), distinct.

    Names are posted under their trigrams; a term looks up its rarest one only, and what it finds there is compared.
    """
    posted = names.select("path", "base", F.explode(_trigrams(F.col("base"))).alias("gram"))
    counted = posted.groupBy("gram").agg(F.count("*").alias("n"))
    grams = terms.select("term", F.explode(_trigrams(F.col("term"))).alias("gram")).join(counted, "gram", "left")
    rarest = grams.groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(posted, "gram").where(F.contains(F.col("base"), F.col("term"))).select("term", "path")


def _candidates(meta: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, path) of all files that can be among a query's k best by name, age and place.

    Those are the files whose name has one of its terms; the active file; the k newest under the active file's folder; and
    the k newest of all, at most k paths, which go into the plan: every other file has as many before it.
    """
    hits = name_hits(meta, queries.select(F.explode("terms").alias("term")).distinct())
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    newest = by_score("half"), F.col("path")
    aged = meta.select("path", (0.5 * F.col("recency")).alias("half"))
    recent = [r["path"] for r in aged.orderBy(*newest).limit(k).collect()]
    out = asked.join(hits, "term").select("query_id", "path")
    if recent:
        out = out.unionByName(queries.select("query_id", F.explode(F.lit(recent)).alias("path")))
    if dict(queries.dtypes)["active_path"] == "string":
        active = queries.where("active_path is not null").select("query_id", "active_path", T.parent_path(F.col("active_path")).alias("dir"))
        sizes = [r["n"] for r in active.where("dir <> ''").select(F.length("dir").alias("n")).distinct().collect()]  # lengths of paths, a few hundred at most
        out = out.unionByName(active.select("query_id", F.col("active_path").alias("path")))
        if sizes:
            below = aged.withColumn("n", F.explode(F.lit(sizes))).where(F.length("path") >= F.col("n")).select("path", "half", F.left("path", F.col("n")).alias("dir"))
            below = top(below.join(active.select("dir").distinct(), "dir"), k, *newest, by="dir")
            out = out.unionByName(active.select("query_id", "dir").join(below.select("dir", "path"), "dir").select("query_id", "path"))
    return out.distinct()


def heuristic_search(files: DataFrame, queries: DataFrame, as_of: Column, limit: int = 24, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """Hits of a scan that scores files by name, age and place, then reads the best of them.

    queries(query_id, text[, active_path]). Only files that can be among a query's best are scored (``_candidates``); the
    contents are joined back once to count terms and once, for the hits, to cut excerpts.
    """
    if "active_path" not in queries.columns:
        queries = queries.withColumn("active_path", F.lit(None))
    terms = F.slice(T.tokens(F.col("text"), T.ASCII_SPLIT), 1, cfg.query_terms)
    queries = queries.select("query_id", terms.alias("terms"), "active_path").where(F.size("terms") > 0)
    meta = files.select("path", F.col("basename").alias("title"), F.lower(F.concat_ws(" ", "basename", "path")).alias("base"), T.recency(F.col("mtime"), as_of).alias("recency"))
    k = min(cfg.metadata_candidates, cfg.content_candidates)
    active = F.col("active_path").cast("string")
    near = F.when(F.col("path") == active, 0.75).otherwise(0.0) + F.when(active.isNotNull() & F.col("path").startswith(T.parent_path(active)), 0.15).otherwise(0.0)
    hits = F.size(F.filter("terms", lambda t: F.contains(F.col("base"), t)))
    scored = _candidates(meta, queries, k).join(meta, "path").join(queries, "query_id").withColumn("title_hits", hits).withColumn("base_score", F.col("title_hits") + 0.5 * F.col("recency") + near)
    found = top(scored.select("query_id", "path", "title", "title_hits", "base_score"), k, by_score("base_score"), F.col("path")).drop("rank")

    # Lower case is made below the join: once a file, not once a term.
    found = found.join(queries.select("query_id", "terms"), "query_id").join(files.select("path", F.lower("content").alias("low")), "path")
    low = F.col("low")
    times = lambda t: ((F.octet_length(low) - F.octet_length(F.replace(low, t, F.lit("")))) / F.octet_length(t)).cast("long")
    held = F.filter("terms", lambda t: F.contains(low, t))
    found = found.withColumn("held", held).withColumn("tf", F.aggregate("held", F.lit(0).cast("long"), lambda s, t: s + times(t)))
    score = F.least(F.lit(1.0), F.col("base_score") / 6 + F.least(F.lit(1.0), F.col("tf") / cfg.query_terms) * 0.7)
    tags = F.array_compact(F.array(F.when(F.col("title_hits") > 0, "titleMatch"), F.when(F.col("tf") > 0, "textMatch")))
    out = found.select((F.col("tf") + F.col("title_hits") > 0).alias("hit"), "query_id", F.lit("heuristic").alias("provider"), F.concat(F.lit("file:"), F.col("path")).alias("key"), "path", "title", F.get("held", F.lit(0)).alias("first"), score.alias("score"), tags.alias("reason_tags"))
    # Hits rank before the rest, which then goes: a filter above would be evaluated a second time in the join.
    out = top(out, limit, F.col("hit").desc(), by_score(), F.col("key")).where("hit").join(files.select("path", "content"), "path")
    text = F.when(F.col("first").isNotNull(), T.snippet(F.col("content"), F.col("first"), cfg.excerpt_chars)).otherwise(F.left("content", F.lit(cfg.excerpt_chars)))
    return out.withColumn("excerpt", text).select(*HIT, "rank")


def bm25_scores(chunks: DataFrame, queries: DataFrame, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """(query_id, key, path, score) of every chunk with a query term.

    The terms of a block of queries are bounded and broadcast, so a frequent term's postings never meet in one task. Only
    postings of those terms are kept, dealt out by chunk: counts and scores of a chunk need no further shuffle.
    """
    tokens = T.tokens(F.col("text"))
    stats = corpus_stats(chunk_lengths(chunks))
    k1, b = cfg.bm25_k1, cfg.bm25_b

    def run(q: DataFrame) -> DataFrame:
        asked = q.select("query_id", F.explode(F.array_distinct(F.slice(tokens, 1, cfg.query_terms))).alias("term"))
        posted = chunks.select("key", "path", tokens.alias("terms")).select("key", "path", F.size("terms").cast("long").alias("len"), "terms").select("key", "path", "len", F.explode("terms").alias("term"))
        held = posted.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").repartition("key").groupBy("key", "path", "len", "term").agg(F.count("*").alias("tf"))
        df = held.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = df.join(F.broadcast(stats)).join(F.broadcast(asked), "term").select("query_id", "term", idf.alias("idf"), "avgdl")
        weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
        return held.join(F.broadcast(terms), "term").groupBy("query_id", "key", "path").agg(F.sum(weight).alias("score"))

    return query_blocks(queries, run)


def bm25_search(chunks: DataFrame, queries: DataFrame, limit: int = 24, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    return top(bm25_scores(chunks, queries, cfg), max(1, min(cfg.bm25_cap, limit)), by_score(), F.col("key"))


def bm25_provider(chunks: DataFrame, queries: DataFrame, allowed: Column | None = None, limit: int = 24, cfg: RetrievalConfig = CONFIG, search: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """BM25 hits: scores over the query's best, then the path filter, then the limit.

    search: what finds (queries, limit) among the chunks, such as the ``search`` of a stored index; by default the chunks are read.
    """
    n = min(cfg.bm25_cap, 8 * limit)
    found = search(queries, n) if search else bm25_search(chunks, queries, n, cfg)
    best = F.max("score").over(Window.partitionBy("query_id"))
    found = found.withColumn("score", N.clamp01(F.when(best > 0, F.col("score") / best).otherwise(0.0))).drop("rank")
    found = found.where(allowed) if allowed is not None else found
    found = top(found, limit, by_score(), F.col("key")).join(chunks.select("key", F.col("text").alias("_text")), "key")
    return found.select("query_id", F.lit("bm25").alias("provider"), "key", "path", T.base_name(F.col("path")).alias("title"), T.excerpt(F.col("_text"), cfg.excerpt_chars).alias("excerpt"), "score", F.array(F.lit("bm25")).alias("reason_tags"), "rank")


#: Bytes of the scores that a task holds at a time: queries of a block by vectors of a batch.
TILE_BYTES = 32 << 20


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix in double precision) for each length of vector; null numbers count as 0, null vectors and those with infinite numbers are left out."""
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    for n in np.unique(size[size >= 0]).tolist():
        rows = np.flatnonzero(size == n)
        m = np.nan_to_num(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0, posinf=np.inf, neginf=-np.inf).reshape(len(rows), n)
        sound = np.isfinite(m).all(axis=1)
        yield rows[sound], m[sound]


def dense_knn(vectors: DataFrame, queries: DataFrame, limit: int = 24, allowed: Column | None = None, cosine: bool = False, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """(query_id, key, path, score, rank): the nearest vectors by dot product (or cosine), exact, score mapped to 0..1.

    queries(query_id, query_vector), in blocks that are broadcast; paths are filtered before the top is taken. A batch of
    vectors meets a tile of queries, of bounded bytes, in one matrix product, and only each query's best of the batch
    leave it. Null vectors and those with infinite numbers take no part, null numbers and NaN count as 0; of vectors of
    two lengths the shorter length is multiplied.
    """
    v = vectors.where(allowed) if allowed is not None else vectors
    v = v.select("key", "path", "vector").where("vector is not null")
    k = max(1, min(cfg.dense_cap, 6 * limit))
    kind = queries.schema["query_id"].dataType.simpleString()

    def scan(q: DataFrame) -> DataFrame:
        asked = q.select("query_id", "query_vector").where("query_vector is not null").toArrow()
        shared = queries.sparkSession.sparkContext.broadcast((asked["query_id"].combine_chunks(), [(at, m, np.sqrt((m * m).sum(1))) for at, m in _matrices(asked["query_vector"].combine_chunks())] if len(asked) else []))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, blocks = shared.value
            for b in batches:
                own_blocks = list(_matrices(b.column("vector")))
                tile = max(1, TILE_BYTES // (8 * max(1, len(b))))
                for at, m, scale_m in ((at[f : f + tile], m[f : f + tile], s[f : f + tile]) for at, m, s in blocks for f in range(0, len(at), tile)):
                    score = np.full((len(at), len(b)), -np.inf)
                    for own, a in own_blocks:
                        n = min(a.shape[1], m.shape[1])
                        s = m[:, :n] @ a[:, :n].T
                        if cosine:
                            scale = np.outer(scale_m, np.sqrt((a * a).sum(1)))
                            s = np.where(scale == 0, 0.0, s / np.where(scale == 0, 1.0, scale))
                        score[:, own] = s
                    rank = np.round(score, 9)
                    # Ties with the last place stay, too: the order by key is made over all.
                    least = np.partition(rank, -k, axis=1)[:, -k][:, None] if len(b) > k else np.full((len(at), 1), -np.inf)
                    asks, row = np.nonzero((rank >= least) & (score > -np.inf))
                    row_ = pa.array(row)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[asks])), b.column("key").take(row_), b.column("path").take(row_), pa.array(score[asks, row])], ["query_id", "key", "path", "raw"])

        return v.mapInArrow(best, f"query_id {kind}, key string, path string, raw double")

    found = top(query_blocks(queries, scan), k, by_score("raw"), F.col("key"))
    return found.where(F.col("rank") <= limit).select("query_id", "key", "path", N.unit_score(F.col("raw")).alias("score"), "rank")


def rrf(hits: DataFrame, limit: int = 200, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """Reciprocal-rank fusion of hits of several providers (with provider_ord): one row a key, score over the best.

    A key's fields are the first provider's, its tags all providers', and "fused".
    """
    rank = F.row_number().over(Window.partitionBy("query_id", "provider_ord").orderBy(by_score(), F.col("key")))
    ranked = hits.withColumn("_r", rank)
    fields = F.min_by(F.struct("path", "title", "excerpt"), F.struct("provider_ord", "_r"))
    tags = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("provider_ord", "reason_tags"))), lambda s: s["reason_tags"])))
    fused = ranked.groupBy("query_id", "key").agg(fields.alias("f"), F.max("score").alias("best_score"), F.sum(1 / (cfg.rrf_k + F.col("_r"))).alias("score"), tags.alias("reason_tags"))
    fused = top(fused, max(1, min(cfg.rrf_cap, limit)), by_score(), F.col("key"))
    most = F.max("score").over(Window.partitionBy("query_id"))
    return fused.select("query_id", F.lit("fused").alias("provider"), "key", "f.path", "f.title", "f.excerpt", N.clamp01(F.when(most > 0, F.col("score") / most).otherwise(0.0)).alias("score"), F.array_union("reason_tags", F.array(F.lit("fused"))).alias("reason_tags"), "best_score", "rank")


def mmr_order(score: np.ndarray, tokens: list[set], vectors: list, limit: int, lam: float = 0.72, stop: float = 0.95) -> list[int]:
    """Candidates picked one by one by lam * score - (1 - lam) * likeness to what is picked; the first of equals wins.

    A candidate's likeness is the running maximum over the picks in order, which stops once it reaches ``stop``.
    """
    n = len(score)
    if n <= limit:
        return list(range(n))
    have = np.array([v is not None for v in vectors])
    matrix = np.array([v for v in vectors if v is not None], float) if have.any() else np.zeros((0, 0))
    place = np.cumsum(have) - 1
    # Shared tokens of all pairs at once: a matrix of candidates and tokens by its transpose.
    code: dict = {}
    at = [[code.setdefault(x, len(code)) for x in t] for t in tokens]
    table = np.zeros((n, max(1, len(code))), np.float32)
    for k, row in enumerate(at):
        table[k, row] = 1
    shared, size = table @ table.T, np.array([len(t) for t in tokens])
    like, free, out = np.zeros(n), np.ones(n, bool), []
    while len(out) < limit and free.any():
        value = np.where(free, lam * score - (1 - lam) * like, -np.inf)
        k = int(np.argmax(value))
        out.append(k)
        free[k] = False
        todo = np.flatnonzero(free & (like < stop))
        if not len(todo):
            continue
        both = shared[todo, k]
        union = size[todo] + size[k] - both
        s = np.where(union > 0, both / np.maximum(union, 1), 0.0)
        if have[k]:
            w = have[todo]
            s[w] = np.clip((matrix[place[todo[w]]] @ matrix[place[k]] + 1) / 2, 0, 1)
        like[todo] = np.maximum(like[todo], s)
    return out


def mmr(hits: DataFrame, limit: int = 24, vectors: DataFrame | None = None, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """Hits picked by maximal marginal relevance, with ``rank`` in the order of picking.

    Sequential within a query, so a grouped function over its at most ``mmr_candidates`` best hits.
    """
    limit = max(1, min(200, limit))
    found = top(hits.drop("rank"), cfg.mmr_candidates, by_score(), F.col("key"))
    found = found.withColumn("_tokens", T.token_set(F.concat_ws(" ", "path", F.coalesce("title", F.lit("")), "excerpt")))
    found = found.join(vectors.select("key", F.col("vector").alias("_vector")), "key", "left") if vectors is not None else found.withColumn("_vector", F.lit(None).cast("array<float>"))
    keep = [f for f in hits.drop("rank").schema.fields]

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        order = mmr_order(g["score"].to_numpy(float), [set(t) for t in g["_tokens"]], list(g["_vector"]), limit, cfg.mmr_lambda, cfg.mmr_stop)
        out = g.iloc[order].drop(columns=["_tokens", "_vector"])
        out["rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out[[f.name for f in keep] + ["rank"]]

    from pyspark.sql import types as S

    return found.groupBy("query_id").applyInPandas(pick, S.StructType([*keep, S.StructField("rank", S.IntegerType())]))


def overlap_score(query: Column, doc: Column) -> Column:
    """The default, deterministic pair score: share of the query's tokens in the document."""
    q = T.token_set(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, T.token_set(doc))) / F.size(q))


def rerank(hits: DataFrame, queries: DataFrame, limit: int = 24, shortlist: int | None = None, score: Callable[[Column, Column], Column] = overlap_score, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """The best hits in the order of a pair score, of equal ones by their old score; a null score leaves the old one.

    score: a function of two columns (query, document), such as a Pandas UDF over a model.
    """
    limit = max(1, min(200, limit))
    n = max(limit, min(cfg.rerank_cap, shortlist or cfg.rerank_shortlist))
    short = top(hits.drop("rank"), n, by_score(), F.col("key")).drop("rank").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    new = F.coalesce(N.clamp01(score(F.col("_q"), F.concat_ws("\n", "path", "excerpt"))), F.col("score"))
    out = short.withColumn("_old", F.col("score")).withColumn("score", new)
    out = top(out, limit, by_score(), F.round("_old", 9).desc(), F.col("key"))
    return out.drop("_q", "_old").withColumn("provider", F.lit("rerank")).withColumn("reason_tags", F.array_union("reason_tags", F.array(F.lit("rerank"))))


def hybrid(batches: list[DataFrame], limit: int = 24, vectors: DataFrame | None = None, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """Hits of several providers fused, diversified and sorted; of one provider sorted and cut only."""
    limit = max(1, min(200, limit))
    cols = list(HIT)
    if len(batches) == 1:
        return top(batches[0].select(*cols), limit, by_score(), F.col("key"))
    united = None
    for i, b in enumerate(batches):
        part = b.select(*cols, F.lit(i).alias("provider_ord"))
        united = part if united is None else united.unionByName(part)
    picked = mmr(rrf(united, max(limit, min(500, 8 * limit)), cfg).drop("best_score"), limit, vectors, cfg)
    return top(picked.drop("rank"), limit, by_score(), F.col("key"))


ERRORS = "provider string, location string, message string"


def run_providers(providers: dict[str, Callable[[DataFrame], DataFrame]], queries: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The batches of hits of the providers that found any, and a table of errors (provider, location, message).

    Each provider runs on its own into a table in the shared folder; one that fails, in the plan or on an executor, gives
    no hits and an error, and the others go on.
    """
    spark, base = queries.sparkSession, f"{folders.shared_folder(queries.sparkSession)}/loomtext-hits-{uuid.uuid4().hex}"
    batches, errors = [], []
    for k, (name, run) in enumerate(providers.items()):
        try:
            found = run(queries).select(*HIT)
            found.write.parquet(f"{base}/{k}")
            batch = spark.read.schema(found.schema).parquet(f"{base}/{k}")
            if not batch.isEmpty():
                batches.append(batch)
        except Exception as e:  # whatever a provider raises is its own failure
            folders.delete(spark, f"{base}/{k}")
            errors.append((name, type(e).__name__, (str(e).splitlines() or [""])[0][:500]))
    return batches, spark.createDataFrame(errors, ERRORS)


def hybrid_of(providers: dict[str, Callable[[DataFrame], DataFrame]], queries: DataFrame, limit: int = 24, vectors: DataFrame | None = None, cfg: RetrievalConfig = CONFIG) -> tuple[DataFrame, DataFrame]:
    """``hybrid`` of the providers that work, and the errors of those that don't; without any hits an empty table."""
    batches, errors = run_providers(providers, queries)
    if not batches:
        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, provider string, key string, path string, title string, excerpt string, score double, reason_tags array<string>, rank int"), errors
    return hybrid(batches, limit, vectors, cfg), errors


def format_hits(hits: DataFrame, with_score: bool = True) -> DataFrame:
    """(query_id, text): numbered hits in order of rank."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("path"), F.lit("\n"))
    note = F.concat(F.lit("Score: "), F.format_string("%.3f", "score"), F.lit(" ("), F.col("provider"), F.lit(")\n")) if with_score else F.lit("")
    part = F.struct("rank", F.concat(head, note, F.col("excerpt")).alias("t"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"]), "\n\n---\n\n").alias("text"))


def _allowed(a: Column, b: Column, maybe: float) -> Column:
    """Edits that names of lengths a and b may differ by and still be as alike as ``maybe``."""
    return F.floor((1 - maybe) * F.greatest(a, b) + 1e-9).cast("int")


def _segment(length: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of so many nearly equal parts of a name."""
    cut = lambda k: F.floor(k * length / parts).cast("int")
    return cut(i), cut(i + 1) - cut(i)


#: Known names under one part from which on they are told apart by their heads first; heads that stand for one shorter head.
FREQUENT, BRANCHES = 64, 16


def _head_lengths(names: DataFrame) -> list[int]:
    """Lengths of heads of the names, each with at most ``BRANCHES`` times the heads of the one before where that can be; the last is the longest name's."""
    heads = names.select("kn").distinct().select(F.posexplode(F.transform(F.sequence(F.lit(1), F.length("kn")), lambda i: F.left("kn", i))).alias("p", "head"))
    counts = [r["n"] for r in heads.groupBy("p").agg(F.approx_count_distinct("head").alias("n")).orderBy("p").collect()]  # as many as the longest name has characters
    out, held = [], 1
    for p, n in enumerate(counts, 1):
        if p == len(counts) or counts[p] > BRANCHES * held:
            out.append(p)
            held = max(1, n)
    return out


def _below_heads(asked: DataFrame, often: DataFrame, kept: list[str], cut: Callable[[DataFrame, str], DataFrame], name: str) -> DataFrame:
    """(n, l, kn, *kept, kl, d) of the names that share a frequent part and may be within d edits, found from short heads to long ones.

    If names are within d edits, so are their heads if these differ in length as the names do: so pairs of heads within d
    edits are found once for all names that begin so, and only what is below them goes on.
    """
    spark, key = asked.sparkSession, ["kl", "d", "i", "part"]
    cuts = _head_lengths(often)
    own = lambda k: F.left("n", F.greatest(F.lit(0), F.lit(cuts[k]) + F.col("l") - F.col("kl")))
    head = lambda k: F.left("kn", F.lit(cuts[k]))
    # Dealt out by name, as few bytes cost many comparisons.
    deal = lambda df, *c: df.repartition(4 * spark.sparkContext.defaultParallelism, *c)
    found = None
    for at in range(len(cuts)):
        last = at == len(cuts) - 1
        # In the end the part that names met on doesn't count, so that a pair of heads goes on once.
        by = ["kl", "d"] if last and at else key
        mine = asked.select("l", *by, *([own(at - 1).alias("begins")] if at else []), own(at).alias("n")).distinct()
        theirs = often.select(*by, *([head(at - 1).alias("above")] if at else []), head(at).alias("head"), *(kept if last else [])).distinct()
        if found is None:
            found = deal(mine, "n").join(theirs, by)
        else:
            found = found.select("l", *by, F.col("n").alias("begins"), F.col("head").alias("above")).distinct().join(theirs, [*by, "above"])
            found = deal(found, "l", *by, "begins").join(mine, ["l", *by, "begins"])
        if not last:
            found = found.where(F.call_function("levenshtein", "n", "head", "d") >= 0)
            found = cut(found.select("n", "l", *key, "head"), f"{name}{at}")
    return found.select("n", "l", F.col("head").alias("kn"), *kept, "kl", "d")


def alike_names(proposed: DataFrame, known: DataFrame, maybe: float = 0.78) -> DataFrame:
    """(n, kn, sim) of the pairs of normalised names, proposed(n) and known(kn), with a similarity of at least ``maybe``."""
    return _alike_pairs(proposed, known.select("kn"), maybe).distinct()


def _alike_pairs(proposed: DataFrame, known: DataFrame, maybe: float) -> DataFrame:
    """``alike_names`` with the other columns of known, which depend on kn; a pair that meets in several ways comes several times.

    Names within d edits: of d + 1 parts of the known one at least one stands unchanged in the other, shifted by s with
    |s| + |difference in length - s| <= d. So parts of known names meet substrings of proposed ones in an equi-join on
    lengths, part and text, and distances, computed up to d, decide. Where a part is frequent among the known names, a
    proposed one does not meet all of them: heads of both meet, short ones first, and only what is below heads within
    reach goes on, so that names that begin alike are told apart once for all of them. Names whose first half begins some
    known name while their last half ends none are compared from the end, as edits that are found first leave fewer.
    """
    spark = known.sparkSession
    base = f"{folders.shared_folder(spark)}/loomtext-names-{uuid.uuid4().hex}"

    def cut(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    p = proposed.select("n", F.length("n").alias("l")).where("l > 0").distinct()
    kept = [c for c in known.columns if c != "kn"]
    k = known.select("kn", *kept, F.length("kn").alias("kl")).where("kl > 0").distinct()
    low, high = (lambda c: F.ceil(F.col(c) * maybe - 1e-9).cast("int")), (lambda c: F.floor(F.col(c) / maybe + 1e-9).cast("int"))
    lengths = lambda own, other: F.explode(F.sequence(low(own), high(own))).alias(other)
    d = _allowed(F.col("l"), F.col("kl"), maybe)
    begin, size = _segment(F.col("kl"), F.col("d") + 1, F.col("i"))
    ways = k.select("kn", *kept, "kl", lengths("kl", "l")).select("kn", *kept, "kl", d.alias("d")).distinct()  # lengths with the same d share their parts
    ways = ways.select("kn", *kept, "kl", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i"))
    key = ["kl", "d", "i", "part"]
    parts = ways.select("kn", *kept, *key[:3], F.substring("kn", begin + 1, size).alias("part")).where("part <> ''")
    parts = cut(parts.join(parts.groupBy(*key).agg((F.count("*") > FREQUENT).alias("frequent")), key), "parts")

    more = F.col("l") - F.col("kl")
    asked = p.select("n", "l", lengths("l", "kl")).join(k.select("kl").distinct(), "kl").withColumn("d", d).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    first, last = F.greatest(F.lit(0), begin - F.floor((F.col("d") - more) / 2).cast("int")), F.least(F.col("l") - size, begin + F.floor((F.col("d") + more) / 2).cast("int"))
    asked = asked.withColumns({"first": first, "last": last, "size": size}).where("first <= last and size > 0")
    held = F.array_distinct(F.transform(F.sequence("first", "last"), lambda at: F.substring(F.col("n"), at + 1, F.col("size"))))
    asked = asked.select("n", "l", "kl", "d", "i", F.explode(held).alias("part"))

    pairs = asked.join(parts.where("not frequent").drop("frequent"), key).select("n", "l", "kn", *kept, "kl", "d")
    often = parts.where("frequent").drop("frequent")
    half = F.floor(F.col("l") / 2).cast("int")
    halves = k.select("kn", "kl").join(p.select(half.alias("half")).distinct(), F.col("half").between(1, F.col("kl")))
    starts = halves.select(F.left("kn", "half").alias("start")).distinct().withColumn("starts", F.lit(True))
    ends = halves.select(F.right("kn", "half").alias("end")).distinct().withColumn("ends", F.lit(True))
    ways = p.withColumns({"start": F.left("n", half), "end": F.right("n", half)}).join(starts, "start", "left").join(ends, "end", "left")
    ways = ways.select("n", (F.col("starts") & F.col("ends").isNull()).alias("back")).fillna(False)
    asked = cut(asked.join(cut(often.select(*key).distinct(), "frequent"), key).join(ways, "n"), "asked")
    there = [r["back"] for r in asked.select("back").distinct().collect()]
    if False in there:
        pairs = pairs.unionByName(_below_heads(asked.where("not back"), often, kept, cut, "heads"))
    if True in there:
        turn = lambda df, c: df.withColumn(c, F.reverse(c))
        below = _below_heads(turn(asked.where("back"), "n"), turn(often, "kn"), kept, cut, "tails")
        pairs = pairs.unionByName(turn(turn(below, "n"), "kn"))
    met = pairs.select("n", "kn", *kept, F.greatest("l", "kl").alias("longer"), F.call_function("levenshtein", "n", "kn", "d").alias("edits"))
    return met.where("edits >= 0").select("n", "kn", *kept, (1 - F.col("edits") / F.col("longer")).alias("sim")).where(F.col("sim") >= maybe)


def resolve_names(proposed: DataFrame, known: DataFrame, sure: float = 0.92, maybe: float = 0.78, most: int = 5) -> DataFrame:
    """(name, resolved, candidates): a known name that is equal when normalised or alike enough, else up to ``most`` alike ones.

    A name that equals a known one needs no comparison; the others meet known names by ``alike_names``.
    """
    p = proposed.select("name", T.normalize_name(F.col("name")).alias("n")).distinct()
    k = known.select(F.col("name").alias("known"), T.normalize_name(F.col("name")).alias("kn")).where("kn <> ''")
    exact = p.join(k, F.col("n") == F.col("kn")).groupBy("name").agg(F.min("known").alias("exact"))
    rest = p.where("n <> ''").join(exact, "name", "left_anti")
    # Known names beyond the first ones of a proposed one, each by its least spelling, can't be among its candidates.
    met = _alike_pairs(rest, k.groupBy("kn").agg(F.min("known").alias("least")), maybe)
    nearest = F.dense_rank().over(Window.partitionBy("n").orderBy(F.round("sim", 9).desc(), "least"))
    near = met.withColumn("rank", nearest).where(F.col("rank") <= most).select("n", "kn", "sim").distinct()
    alike = near.join(rest, "n").join(k.distinct(), "kn").select("name", "known", "sim")
    best = top(alike, most, F.round("sim", 9).desc(), F.col("known"), by="name")
    listed = best.groupBy("name").agg(F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("sim"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "known"))), lambda s: s["known"]).alias("c"))
    out = p.select("name").join(exact, "name", "left").join(listed, "name", "left")
    found = F.coalesce("exact", F.when(F.col("sim") >= sure, F.get("c", F.lit(0))))
    return out.select("name", found.alias("resolved"), F.when(found.isNull(), F.coalesce("c", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("candidates"))
