"""Queries of the operators, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, context, files, folders, index, kept, parsing, publish, retrieval, sinks, stored, vault
from ..sources import tables as S
from ..streaming import attempts, debounce, incremental, log
from .registry import FILES, NOTES, query, sql_tokens, sql_words

C = F.col
WITH_FILES = f"WITH {FILES} "
AS_OF = "2025-01-01 00:00:00"


# Files and folders


@query(WITH_FILES + "SELECT path, basename, size, mtime_ms, length(content) AS chars FROM files")
def scan_included_files(spark, d):
    return S.files(spark, d).select("path", "basename", "size", F.unix_millis("mtime").alias("mtime_ms"), F.length("content").cast("long").alias("chars"))


@query(WITH_FILES + ", w AS (SELECT path FROM files UNION ALL SELECT 'missing/' || doc_id || '.md' FROM labels) SELECT w.path, md5(coalesce(content, '[File not found: ' || w.path || ']')) AS content FROM w LEFT JOIN files USING (path)")
def read_file_or_sentinel(spark, d):
    files = S.files(spark, d)
    wanted = files.select("path").unionByName(S.read(spark, d, "labels").select(F.format_string("missing/%d.md", "doc_id").alias("path")))
    return vault.read_or_sentinel(wanted, files).select("path", F.md5("content").alias("content"))


@query("SELECT r_name AS folder, string_agg('## ' || n_name || chr(10) || 'Key ' || n_nationkey || chr(10), chr(10) || '---' || chr(10) || chr(10) ORDER BY n_name) AS notes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def format_character_notes(spark, d):
    n = S.read(spark, d, "nation").join(S.read(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    return vault.format_notes(n.select(C("r_name").alias("folder"), C("n_name").alias("name"), F.concat(F.lit("Key "), C("n_nationkey").cast("string")).alias("content")), "folder")


_TREE = WITH_FILES + ", fo AS (SELECT DISTINCT unnest([string_split(path, '/')[1], string_split(path, '/')[1] || '/' || string_split(path, '/')[2]]) AS path FROM files)"


@query(_TREE + " SELECT path, string_split(path, '/')[-1] AS name, len(string_split(path, '/'))::BIGINT AS depth FROM fo")
def vault_folders(spark, d):
    return vault.folders(S.files(spark, d)).withColumn("depth", C("depth").cast("long"))


@query(_TREE + ", n AS (SELECT path FROM fo UNION ALL SELECT path FROM files), p AS (SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM n) SELECT parent, count(*) AS n_children, min(path) AS first, max(path) AS last FROM p GROUP BY parent")
def folder_children(spark, d):
    return vault.children(vault.tree(S.files(spark, d)))


@query(WITH_FILES + "SELECT regexp_replace(path, '/[^/]*$', '') AS folder, arg_max(path, mtime_ms) AS path FROM files WHERE regexp_matches(basename, '^1') GROUP BY 1")
def latest_matching_file(spark, d):
    return vault.latest(S.files(spark, d), T.parent_path(C("path")), "^1")


@query(WITH_FILES + "SELECT path, row_number() OVER (ORDER BY mtime_ms + size DESC, path) AS position FROM files")
def file_recency_size_order(spark, d):
    return vault.picker_positions(S.files(spark, d))


@query(_TREE + " SELECT path FROM fo")
def vault_tree_filtered(spark, d):
    return vault.non_empty_folders(vault.tree(S.files(spark, d), "md")).select("path")


@query(WITH_FILES + "SELECT path FROM files WHERE (path = 'src1' OR starts_with(path, 'src1/') OR path = 'src2' OR starts_with(path, 'src2/')) AND NOT (path = 'src2/en' OR starts_with(path, 'src2/en/'))")
def path_filter(spark, d):
    return vault.path_filter(S.files(spark, d), include=["src1", "src2/"], exclude=["src2/en"]).select("path")


@query(WITH_FILES + ", i AS (SELECT DISTINCT source AS path FROM documents WHERE source LIKE '%1%'), e AS (SELECT path FROM files JOIN labels USING (doc_id) WHERE toxic = 1) SELECT path FROM files WHERE EXISTS (SELECT 1 FROM i WHERE files.path = i.path OR starts_with(files.path, i.path || '/')) AND NOT EXISTS (SELECT 1 FROM e WHERE files.path = e.path OR starts_with(files.path, e.path || '/'))")
def path_filter_semi_anti(spark, d):
    f = S.files(spark, d)
    inside = S.read(spark, d, "documents").where("source like '%1%'").select(C("source").alias("path")).distinct()
    outside = f.join(S.read(spark, d, "labels").where("toxic = 1"), "doc_id").select("path")
    return vault.filter_by_lists(f, inside, outside).select("path")


# Chunks and sections

_WINDOWS = f"w AS (SELECT doc_id, path, {sql_words('content')} AS w FROM files), c AS (SELECT doc_id, path, w, unnest(range(0, (greatest(0, ceil((len(w) - 500) / 400.0))::BIGINT) * 400 + 1, 400)) AS s FROM w WHERE len(w) > 0), chunks AS (SELECT doc_id, path, s // 400 AS chunk_index, s AS start_word, least(len(w), s + 500)::BIGINT AS end_word, array_to_string(w[s + 1:s + 500], ' ') AS text, 'chunk:' || path || ':' || (s // 400) AS key FROM c)"
WITH_CHUNKS = f"WITH {FILES}, {_WINDOWS}"


def _chunks(spark, d):
    return index.chunk_table(S.files(spark, d))


@query(WITH_CHUNKS + " SELECT doc_id, start_word, end_word, md5(text) AS text FROM chunks")
def chunk_word_window(spark, d):
    c = S.files(spark, d).select("doc_id", F.explode(chunking.windows(T.words(C("content")))).alias("c"))
    return c.select("doc_id", C("c.start_word").cast("long").alias("start_word"), C("c.end_word").cast("long").alias("end_word"), F.md5("c.text").alias("text"))


_SECTIONS = (
    f"WITH {NOTES}, l AS (SELECT conv_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM notes), "
    "s AS (SELECT *, sum(CASE WHEN regexp_matches(ltrim(line), '^#\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS k FROM l), "
    "sec AS (SELECT conv_id, k::BIGINT - 1 AS ord, arg_min(rtrim(line), i) AS heading, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT regexp_matches(ltrim(line), '^#\\s')), ''), '\\s+$', '') AS content, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS full_text FROM s WHERE k > 0 GROUP BY conv_id, k) "
)


@query(_SECTIONS + "SELECT conv_id, ord, full_text AS section FROM sec")
def split_by_heading(spark, d):
    return S.notes(spark, d).select("conv_id", F.posexplode(chunking.split_by_heading(C("content"))).alias("ord", "section")).withColumn("ord", C("ord").cast("long"))


@query(_SECTIONS + "SELECT conv_id, ord, heading, content FROM sec")
def split_by_h1(spark, d):
    s = S.notes(spark, d).select("conv_id", F.posexplode(chunking.split_by_h1(C("content"))).alias("ord", "s"))
    return s.select("conv_id", C("ord").cast("long").alias("ord"), "s.heading", "s.content")


@query(_SECTIONS + "SELECT conv_id, ord, substr(heading, 3) AS title, regexp_replace(content, '^\\s+', '') AS markdown FROM sec")
def parse_h1_chapters(spark, d):
    s = S.notes(spark, d).select("conv_id", F.posexplode(parsing.h1_chapters(C("content"))).alias("ord", "s"))
    return s.select("conv_id", C("ord").cast("long").alias("ord"), "s.title", "s.markdown")


def _merged_sql(least: int) -> str:
    """Tables up to merged(conv_id, ord, section, n): a section goes to the one before as long as that has fewer words."""
    return _SECTIONS.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + (
        f", sx AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS i, full_text AS t, len({sql_words('full_text')}) AS n FROM sec WHERE full_text <> ''), "
        "g AS (SELECT conv_id, i, n AS held, 0::BIGINT AS ord FROM sx WHERE i = 1 UNION ALL "
        f"SELECT sx.conv_id, sx.i, CASE WHEN held < {least} THEN held + n ELSE n END, CASE WHEN held < {least} THEN ord ELSE ord + 1 END FROM g JOIN sx ON sx.conv_id = g.conv_id AND sx.i = g.i + 1), "
        "merged AS (SELECT conv_id, ord, string_agg(t, chr(10) || chr(10) ORDER BY i) AS section, sum(n)::BIGINT AS n FROM g JOIN sx USING (conv_id, i) GROUP BY conv_id, ord) "
    )


@query(_merged_sql(200) + "SELECT conv_id, ord, section FROM merged")
def merge_small_sections(spark, d):
    merged = chunking.merge_small(chunking.split_by_heading(C("content")), 200)
    return S.notes(spark, d).select("conv_id", F.posexplode(merged).alias("ord", "section")).withColumn("ord", C("ord").cast("long"))


@query(WITH_CHUNKS + " SELECT key, start_word, end_word, md5(text) AS text FROM chunks")
def build_index_chunks(spark, d):
    return _chunks(spark, d).select("key", C("start_word").cast("long"), C("end_word").cast("long"), F.md5("text").alias("text"))


@query(
    _merged_sql(250)
    + f", pos AS (SELECT *, {sql_words('section')} AS w, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM merged), "
    "p AS (SELECT *, unnest(CASE WHEN n <= 500 THEN [0] ELSE range(0, ceil((n - 500) / 400.0)::BIGINT * 400 + 1, 400) END) AS s FROM pos) "
    "SELECT 'chunk:conv/' || conv_id || '.md:' || (row_number() OVER (PARTITION BY conv_id ORDER BY ord, s) - 1) AS key, a + s AS start_word, a + least(n, CASE WHEN n <= 500 THEN n ELSE s + 500 END) AS end_word, CASE WHEN n <= 500 THEN section ELSE array_to_string(w[s + 1:s + 500], ' ') END AS text FROM p"
)
def index_chunks_by_heading(spark, d):
    return index.chunk_table(S.notes(spark, d)).select("key", C("start_word").cast("long"), C("end_word").cast("long"), "text")


@query()
def chunk_sentence_aware(spark, d):
    return chunking.chunk_sentences(S.files(spark, d), "doc_id")


# Links, entities, rosters: notes made of the nations

_TOC = "toc AS (SELECT r_regionkey, '# Preface' || chr(10) || '- [[nowhere]]' || chr(10) || '# TOC' || chr(10) || string_agg('- [[' || n_name || '#part|see]] and [x](notes/' || n_name || '.md)', chr(10) ORDER BY n_nationkey) || chr(10) || 'not [[listed]]' || chr(10) || '# End' || chr(10) || '- [[late]]' AS content FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey)"


def _toc(spark, d):
    line = F.format_string("- [[%s#part|see]] and [x](notes/%s.md)", "n_name", "n_name")
    n = S.read(spark, d, "nation").join(S.read(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda s: s["l"]), "\n")
    return n.groupBy("r_regionkey").agg(F.concat(F.lit("# Preface\n- [[nowhere]]\n# TOC\n"), body, F.lit("\nnot [[listed]]\n# End\n- [[late]]")).alias("content"))


def _nation_files(spark, d):
    return S.read(spark, d, "nation").select(F.format_string("notes/%s.md", "n_name").alias("path"), F.when(C("n_nationkey") % 2 == 0, F.concat(F.lit("# The "), C("n_name"), F.lit("\ntext"))).otherwise("plain").alias("content"))


@query("SELECT r_regionkey, count(*) + 1 AS lines FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def toc_block(spark, d):
    return _toc(spark, d).select("r_regionkey", F.size(parsing.toc_block(C("content"))).cast("long").alias("lines"))


@query("SELECT n_regionkey AS r_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, k) - 1) AS ord, CASE k WHEN 0 THEN n_name ELSE 'notes/' || n_name || '.md' END AS target FROM nation, (SELECT unnest([0, 1]) AS k)")
def extract_links(spark, d):
    links = _toc(spark, d).select("r_regionkey", F.posexplode(parsing.list_links(parsing.toc_block(C("content")))).alias("ord", "target"))
    return links.withColumn("ord", C("ord").cast("long"))


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1), 1) AS i FROM pages) SELECT page_id, href, min(i) AS first FROM l GROUP BY page_id, href")
def ordered_distinct(spark, d):
    found = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    p = S.read(spark, d, "pages").select("page_id", found.alias("all"))
    return p.select("page_id", "all", F.explode(F.array_distinct("all")).alias("href")).select("page_id", "href", F.array_position("all", C("href")).alias("first"))


@query("SELECT n_regionkey AS r_regionkey, n_name AS target, 'notes/' || n_name || '.md' AS path FROM nation UNION ALL SELECT n_regionkey, 'notes/' || n_name || '.md', 'notes/' || n_name || '.md' FROM nation")
def resolve_links(spark, d):
    links = _toc(spark, d).select("r_regionkey", F.explode(parsing.list_links(parsing.toc_block(C("content")))).alias("target"))
    return parsing.resolve_links(links, _nation_files(spark, d))


@query("SELECT n_regionkey AS r_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, k) - 1) AS ord, CASE WHEN n_nationkey % 2 = 0 THEN 'The ' || n_name ELSE n_name END AS title, 'notes/' || n_name || '.md' AS source_path FROM nation, (SELECT unnest([0, 1]) AS k)")
def compile_from_toc(spark, d):
    c = parsing.compile_from_toc(_toc(spark, d), _nation_files(spark, d), "r_regionkey")
    return c.select("r_regionkey", C("ord").cast("long").alias("ord"), "title", "source_path")


@query("SELECT n_regionkey, n_name AS entity, 'key ' || n_nationkey AS update FROM nation")
def parse_sections_h2(spark, d):
    part = F.format_string("## %s\n\n### Today Update\nkey %d\n", "n_name", "n_nationkey")
    n = S.read(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("intro\n"), F.array_join(F.collect_list(part), "\n")).alias("content"))
    return n.select("n_regionkey", F.explode(parsing.entity_sections(C("content"))).alias("s")).select("n_regionkey", "s.entity", "s.update")


@query("SELECT DISTINCT item_id, name FROM (SELECT item_id, unnest(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+[A-Z][a-z]+)*)\\b', 1)) AS name FROM benchmark) WHERE len(string_split(name, ' ')) <= 3")
def capitalized_names(spark, d):
    return S.read(spark, d, "benchmark").select("item_id", F.explode(parsing.capitalized_names(C("text"))).alias("name"))


@query("SELECT s_nationkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS ord, '- ' || s_name || ' | aliases: S' || s_suppkey || ', T' || s_suppkey AS line FROM supplier")
def parse_roster(spark, d):
    line = F.concat(F.when(C("s_suppkey") % 2 == 0, "- ").otherwise("3. "), C("s_name"), F.format_string(" | Alias: S%d", "s_suppkey"), F.lit("\n"), F.lower("s_name"), F.format_string(" | aliases: S%d,  T%d", "s_suppkey", "s_suppkey"))
    parts = F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("l"))))
    r = S.read(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(parts, lambda s: s["l"]), "\n").alias("content"))
    p = parsing.parse_roster(r, "s_nationkey")
    return p.select("s_nationkey", C("ord").cast("long").alias("ord"), parsing.roster_lines(C("name"), C("aliases")).alias("line"))


# Index and retrieval

_POSTINGS = f", t AS (SELECT key, path, unnest({sql_tokens('text')}) AS term FROM chunks), postings AS (SELECT term, key, path, count(*) AS tf FROM t GROUP BY term, key, path), lens AS (SELECT key, path, count(*) AS len FROM t GROUP BY key, path), stats AS (SELECT count(*) AS n, avg(len) AS avgdl, sum(len)::BIGINT AS total FROM lens)"
_BM25 = WITH_CHUNKS + _POSTINGS + (
    f", q AS (SELECT item_id AS query_id, unnest(list_distinct(({sql_tokens('text')})[1:24])) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term), "
    "sc AS (SELECT query_id, p.key, p.path, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM q JOIN postings p USING (term) JOIN df USING (term) JOIN lens l ON l.key = p.key, stats GROUP BY query_id, p.key, p.path), "
    "bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank FROM sc) "
)


@query(WITH_CHUNKS + _POSTINGS + " SELECT term, key, tf FROM postings")
def term_frequency(spark, d):
    return index.postings(_chunks(spark, d))


@query(WITH_CHUNKS + _POSTINGS + " SELECT n AS n_chunks, total AS total_len, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, d):
    return index.corpus_stats(index.chunk_lengths(_chunks(spark, d))).withColumn("avgdl", F.round("avgdl", 6))


@query(WITH_CHUNKS + " SELECT count(DISTINCT path) AS indexed_files, count(*) AS indexed_chunks FROM chunks")
def index_status(spark, d):
    return index.index_status(_chunks(spark, d))


@query(_BM25 + "SELECT query_id, key, path, round(score, 6) AS score, rank FROM bm WHERE rank <= 24")
def bm25_search(spark, d):
    hits = retrieval.bm25_search(_chunks(spark, d), S.queries(spark, d))
    return hits.select("query_id", "key", "path", F.round("score", 6).alias("score"), C("rank").cast("long").alias("rank"))


def _stored(spark, d):
    """The stored index of the documents' chunks, made on first use and again when the files of documents change."""
    folder, made_of = f"{folders.shared_folder(spark)}/loomtext-index", stored.state_of(S.read(spark, d, "documents"))
    at = f"{folder}/{made_of}"
    return stored.load(spark, at, made_of=made_of) or stored.save(_chunks(spark, d), at, made_of=made_of)


@query(_BM25 + "SELECT query_id, key, path, round(score, 6) AS score, rank FROM bm WHERE rank <= 24")
def bm25_stored_index(spark, d):
    hits = _stored(spark, d).search(S.queries(spark, d))
    return hits.select("query_id", "key", "path", F.round("score", 6).alias("score"), C("rank").cast("long").alias("rank"))


@query(_BM25 + "SELECT query_id, key, path, round(score, 6) AS score, rank FROM bm WHERE rank <= 24")
def bm25_kept(spark, d):
    """Every second query is asked, then all of them: those with a kept result are not searched again."""
    held, asked = _stored(spark, d), S.queries(spark, d)
    at = f"{folders.shared_folder(spark)}/loomtext-kept-{uuid.uuid4().hex}"
    find = lambda q: held.search(q).select("query_id", "key", "path", "score", "rank")
    kept.search(at, asked.where("query_id % 2 = 0"), find, held.head["made_of"], now=1_000.0)
    hits = kept.search(at, asked, find, held.head["made_of"], now=1_010.0)
    return hits.select("query_id", "key", "path", F.round("score", 6).alias("score"), C("rank").cast("long").alias("rank"))


@query(WITH_CHUNKS + _POSTINGS + " SELECT term, count(*) AS df, count(DISTINCT path) AS paths, sum(tf)::BIGINT AS total FROM postings GROUP BY term")
def stored_postings(spark, d):
    """The terms of the stored index: their chunks from its blocks, their paths and counts from its chunks."""
    index_ = _stored(spark, d)
    of = index_.blocks.groupBy("term").agg(F.sum(F.size("hits")).alias("df"))
    tf = index_.chunks.select(F.explode(T.tokens(C("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("total"))
    # Chunks of a path meet in one task, and only numbers leave it.
    by_path = index_.chunks.select("path", "text").repartition("path").groupBy("path").agg(F.collect_list(F.array_distinct(T.tokens(C("text")))).alias("terms"))
    paths = by_path.select(F.explode(F.array_distinct(F.flatten("terms"))).alias("term")).groupBy("term").agg(F.count("*").alias("paths"))
    of = of.join(paths, "term")
    return of.join(tf, "term").select("term", "df", "paths", "total")


@query(_BM25 + ", nr AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS s FROM bm WHERE rank <= 192), al AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, key) AS r FROM nr WHERE path LIKE 'src1%') SELECT query_id, key, round(s, 6) AS score, r AS rank, md5(CASE WHEN length(text) > 2500 THEN left(text, 2500) || '…' ELSE text END) AS excerpt FROM al JOIN chunks USING (key) WHERE r <= 24")
def bm25_provider(spark, d):
    held = _stored(spark, d)
    hits = retrieval.bm25_provider(held.chunks, S.queries(spark, d), C("path").startswith("src1"), search=held.search)
    return hits.select("query_id", "key", F.round("score", 6).alias("score"), C("rank").cast("long").alias("rank"), F.md5("excerpt").alias("excerpt"))


def _dense_sql(score: str) -> str:
    return (
        "WITH v AS (SELECT vec_id, 'chunk:v/' || vec_id || '.md:0' AS key, 'v/' || vec_id || '.md' AS path, embedding::DOUBLE[] AS e FROM embeddings), "
        f"s AS (SELECT q.vec_id AS query_id, v.key, v.path, {score} AS raw FROM v, v q WHERE q.vec_id % 20 = 0), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, key) AS rank FROM s) "
        "SELECT query_id, key, round((raw + 1) / 2, 6) AS score, rank FROM r WHERE rank <= 24"
    )


def _vector_queries(spark, d):
    """Every 20th vector asks; all vectors answer."""
    return S.vectors(spark, d).where("vec_id % 20 = 0").select(C("vec_id").alias("query_id"), C("vector").alias("query_vector"))


@query(_dense_sql("list_dot_product(q.e, v.e)"))
def dense_knn(spark, d):
    hits = retrieval.dense_knn(S.vectors(spark, d), _vector_queries(spark, d))
    return hits.select("query_id", "key", F.least(F.round("score", 6), F.lit(1.0)).alias("score"), C("rank").cast("long").alias("rank"))


@query(_dense_sql("list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)))"))
def dense_knn_cosine(spark, d):
    hits = retrieval.dense_knn(S.vectors(spark, d), _vector_queries(spark, d), cosine=True)
    return hits.select("query_id", "key", F.round("score", 6).alias("score"), C("rank").cast("long").alias("rank"))


@query(_dense_sql("list_dot_product(q.e, v.e)"))
def dense_knn_stored(spark, d):
    """The same from a stored table of vectors, made on first use and again when the files of embeddings change."""
    made_of = stored.state_of(S.read(spark, d, "embeddings"))
    at = f"{folders.shared_folder(spark)}/loomtext-vectors/{made_of}"
    vectors = stored.load_vectors(spark, at, "given", made_of=made_of)
    if vectors is None:
        vectors = stored.save_vectors(S.vectors(spark, d), at, "given", made_of=made_of)
    asked = vectors.where("vec_id % 20 = 0").select(C("vec_id").alias("query_id"), C("vector").alias("query_vector"))
    hits = retrieval.dense_knn(vectors, asked)
    return hits.select("query_id", "key", F.least(F.round("score", 6), F.lit(1.0)).alias("score"), C("rank").cast("long").alias("rank"))


_HEURISTIC = WITH_FILES + (
    f", hq AS (SELECT item_id AS query_id, ({sql_tokens('text', '[^a-z0-9]+')})[1:24] AS terms FROM benchmark), "
    "hb AS (SELECT query_id, terms, path, basename, content, len(list_filter(terms, lambda t: contains(lower(basename || ' ' || path), t))) AS title_hits, 1 / (1 + greatest(0, 1735689600000 - mtime_ms) / 2592000000.0::DOUBLE) AS rec FROM files, hq WHERE len(terms) > 0), "
    "hc AS (SELECT *, title_hits + 0.5::DOUBLE * rec AS base FROM hb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(title_hits + 0.5::DOUBLE * rec, 9) DESC, path) <= 120), "
    "hh AS (SELECT *, list_sum(list_transform(terms, lambda t: (length(content) - length(replace(lower(content), t, ''))) // length(t)))::BIGINT AS tf FROM hc), "
    "hs AS (SELECT query_id, 'file:' || path AS key, path, title_hits, tf, least(1.0, base / 6 + least(1.0, tf / 24.0::DOUBLE) * 0.7::DOUBLE) AS score FROM hh WHERE tf > 0 OR title_hits > 0), "
    "he AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank FROM hs) "
)


def _heuristic(spark, d, limit=24):
    return retrieval.heuristic_search(S.files(spark, d), S.queries(spark, d), F.lit(AS_OF).cast("timestamp"), limit)


@query(_HEURISTIC + "SELECT query_id, key, round(score, 6) AS score, rank, CASE WHEN title_hits > 0 THEN 'titleMatch,' ELSE '' END || CASE WHEN tf > 0 THEN 'textMatch,' ELSE '' END AS tags FROM he WHERE rank <= 24")
def heuristic_search(spark, d):
    tags = F.array_join(F.transform("reason_tags", lambda t: F.concat(t, F.lit(","))), "")
    return _heuristic(spark, d).select("query_id", "key", F.round("score", 6).alias("score"), C("rank").cast("long").alias("rank"), tags.alias("tags"))


def _united(spark, d):
    held = _stored(spark, d)
    cols = list(retrieval.HIT)
    lexical = retrieval.bm25_provider(held.chunks, S.queries(spark, d), search=held.search).select(*cols, F.lit(0).alias("provider_ord"))
    return lexical.unionByName(_heuristic(spark, d).select(*cols, F.lit(1).alias("provider_ord")))


@query(
    _HEURISTIC
    + ", "
    + _BM25.removeprefix(WITH_FILES[: len("WITH ")]).removeprefix(FILES + ", ")
    + ", bp AS (SELECT query_id, key, score / max(score) OVER (PARTITION BY query_id) AS s FROM bm WHERE rank <= 192), bq AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, key) AS r FROM bp QUALIFY r <= 24), "
    "u AS (SELECT query_id, key, 1 / (60 + r) AS p FROM bq UNION ALL SELECT query_id, key, 1 / (60 + rank) FROM he WHERE rank <= 24), f AS (SELECT query_id, key, sum(p) AS s FROM u GROUP BY query_id, key) "
    "SELECT query_id, key, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM f"
)
def rrf_fusion(spark, d):
    return retrieval.rrf(_united(spark, d)).select("query_id", "key", F.round("score", 6).alias("score"))


@query()
def mmr_select(spark, d):
    return retrieval.mmr(retrieval.rrf(_united(spark, d)).drop("best_score"), 12)


@query()
def hybrid_search(spark, d):
    """The default pair of providers: the heuristic scan and nearest vectors of hashed words, fused and diversified.

    Chunks and their vectors are those of the stored index, so each text is embedded once.
    """
    from ..operators.embed import hashed_bag_of_words

    held = _stored(spark, d)
    at, settings = f"{held.at}-vectors", {"made_of": held.head["made_of"]}
    v = stored.load_vectors(spark, at, "hashed words", **settings)
    if v is None:
        v = stored.save_vectors(held.chunks.select("key", "path", T.excerpt(C("text")).alias("excerpt"), hashed_bag_of_words(C("text")).alias("vector")), at, "hashed words", **settings)
    near = retrieval.dense_knn(v, S.queries(spark, d).select("query_id", hashed_bag_of_words(C("text")).alias("query_vector")), 192)
    near = near.join(v.select("key", "excerpt"), "key").select("query_id", F.lit("semantic").alias("provider"), "key", "path", T.base_name(C("path")).alias("title"), "excerpt", "score", F.array(F.lit("semantic")).alias("reason_tags"))
    return retrieval.hybrid([_heuristic(spark, d, 192), near], 24, v.select("key", "vector"))


@query(_HEURISTIC + "SELECT query_id, key, round(score, 6) AS score, rank, 1::BIGINT AS errors FROM he WHERE rank <= 24")
def hybrid_one_provider_fails(spark, d):
    """The heuristic scan beside a provider that fails on the executors: its hits, sorted only, and the number of errors."""
    broken = lambda q: q.select("query_id", *[F.raise_error(F.lit("no model")).cast("string").alias(c) for c in retrieval.HIT[1:]])
    hits, errors = retrieval.hybrid_of({"heuristic": lambda q: _heuristic(spark, d), "semantic": broken}, S.queries(spark, d))
    return hits.select("query_id", "key", F.round("score", 6).alias("score"), C("rank").cast("long").alias("rank"), F.lit(errors.count()).cast("long").alias("errors"))


@query(
    _BM25
    + f", nr AS (SELECT query_id, key, path, score / max(score) OVER (PARTITION BY query_id) AS s FROM bm WHERE rank <= 192), sl AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, key) <= 60), "
    f"qs AS (SELECT item_id AS query_id, list_distinct({sql_tokens('text', stop=False)}) AS qt FROM benchmark), "
    f"rs AS (SELECT query_id, key, s AS old, len(list_intersect(qt, {sql_tokens('sl.path || chr(10) || CASE WHEN length(text) > 2500 THEN left(text, 2500) ELSE text END', stop=False)})) / len(qt) AS score FROM sl JOIN chunks USING (key) JOIN qs USING (query_id)) "
    "SELECT query_id, key, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(old, 9) DESC, key) AS rank FROM rs QUALIFY rank <= 12"
)
def rerank(spark, d):
    held = _stored(spark, d)
    hits = retrieval.bm25_provider(held.chunks, S.queries(spark, d), limit=60, search=held.search)
    return retrieval.rerank(hits, S.queries(spark, d), 12).select("query_id", "key", F.round("score", 6).alias("score"), C("rank").cast("long").alias("rank"))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[-_]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _fuzzy_sql(proposed: str) -> str:
    return (
        f"WITH p AS (SELECT DISTINCT name, {_NORM.format('name')} AS n FROM ({proposed})), k AS (SELECT s_name AS known, {_NORM.format('s_name')} AS kn FROM supplier), "
        "ex AS (SELECT name, min(known) AS exact FROM p JOIN k ON n = kn GROUP BY name), "
        "al AS (SELECT name, known, 1 - levenshtein(n, kn) / greatest(length(n), length(kn)) AS sim FROM p, k WHERE 1 - levenshtein(n, kn) / greatest(length(n), length(kn)) >= 0.78), "
        "b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(sim, 9) DESC, known) AS r FROM al QUALIFY r <= 5), "
        "g AS (SELECT name, max(sim) AS sim, list(known ORDER BY r) AS c FROM b GROUP BY name), "
        "o AS (SELECT p.name, coalesce(exact, CASE WHEN sim >= 0.92 THEN c[1] END) AS resolved, c FROM p LEFT JOIN ex USING (name) LEFT JOIN g USING (name)) "
        "SELECT name, resolved, CASE WHEN resolved IS NULL THEN coalesce(array_to_string(c, '|'), '') ELSE '' END AS candidates FROM o"
    )


def _resolved(spark, d, proposed):
    known = S.read(spark, d, "supplier").select(C("s_name").alias("name"))
    return retrieval.resolve_names(proposed, known).withColumn("candidates", F.array_join("candidates", "|"))


@query(_fuzzy_sql("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier"))
def fuzzy_resolve(spark, d):
    return _resolved(spark, d, S.read(spark, d, "customer").select(C("c_name").alias("name")).unionByName(S.read(spark, d, "supplier").select(C("s_name").alias("name"))))


@query(_fuzzy_sql("SELECT unnest([replace(s_name, 'Supplier', 'Splier'), replace(s_name, 'upplier', 'upply') || 'x', s_name || ' jr', replace(s_name, '00', '')]) AS name FROM supplier"))
def fuzzy_resolve_alike(spark, d):
    """Misspelt names, most of them alike to many known ones."""
    s = C("s_name")
    spelt = F.array(F.replace(s, F.lit("Supplier"), F.lit("Splier")), F.concat(F.replace(s, F.lit("upplier"), F.lit("upply")), F.lit("x")), F.concat(s, F.lit(" jr")), F.replace(s, F.lit("00"), F.lit("")))
    return _resolved(spark, d, S.read(spark, d, "supplier").select(F.explode(spelt).alias("name")))


@query(_BM25 + "SELECT query_id, md5(string_agg('[' || rank || '] ' || bm.path || chr(10) || 'Score: ' || printf('%.3f', score) || ' (bm25)' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS text FROM bm JOIN chunks USING (key) WHERE rank <= 5 GROUP BY query_id")
def format_hits(spark, d):
    chunks = _chunks(spark, d)
    hits = retrieval.bm25_search(chunks, S.queries(spark, d), 5).join(chunks.select("key", C("text").alias("excerpt")), "key").withColumn("provider", F.lit("bm25"))
    return retrieval.format_hits(hits).withColumn("text", F.md5("text"))


def _books(spark, d):
    s = S.notes(spark, d).select(C("conv_id").alias("book"), F.posexplode(parsing.h1_chapters(C("content"))).alias("ord", "s"))
    return s.select("book", C("ord").cast("long").alias("ord"), "s.title", "s.markdown")


@query()
def assemble_chapter_context(spark, d):
    hits = retrieval.format_hits(_heuristic(spark, d)).withColumnRenamed("text", "retrieved")
    row = S.queries(spark, d).join(hits, "query_id", "left").withColumns({"retrieved": F.coalesce("retrieved", F.lit("[No results]")), "bible": C("text"), "sliding": C("text")}).drop("text")
    return context.assemble(row, context.CHAPTER, F.lit(16_000))


def _head_sql(c: str, share: float, label: str) -> str:
    """The head of a text within its share of the 6,000 tokens that a limit of 16,000 leaves for the context."""
    n = int(6_000 * share)
    return f"CASE WHEN length({c}) > {4 * n} THEN left({c}, {4 * n}) || chr(10) || chr(10) || '[{label}: truncated to ~{n:,} tokens]' ELSE {c} END"


_LAST = f"(CASE WHEN len({sql_words('text')}) <= 20000 THEN text ELSE array_to_string({sql_words('text')}[-20000:], ' ') END)"


@query(f"SELECT doc_id, {_head_sql(_LAST, 0.03, 'Sliding window')} AS sliding, {_head_sql('text', 0.25, 'Story bible')} AS bible, {_head_sql('source', 0.37, 'Character notes')} AS characters, {_head_sql('lang', 0.2, 'Retrieved context')} AS retrieved FROM documents")
def assemble_micro_context(spark, d):
    row = S.read(spark, d, "documents").select("doc_id", C("text").alias("sliding"), C("text").alias("bible"), C("source").alias("characters"), C("lang").alias("retrieved"))
    return context.assemble(row, context.MICRO, F.lit(16_000))


@query("SELECT doc_id, md5('Style:' || chr(10) || source || chr(10) || chr(10) || 'Passage:' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS prompt FROM documents WHERE trim(text) <> ''")
def assemble_prompt(spark, d):
    return S.read(spark, d, "documents").where("trim(text) <> ''").select("doc_id", F.md5(context.prompt(Style=C("source"), Notes=F.lit(" "), Passage=C("text"))).alias("prompt"))


_BOOKS = _SECTIONS.rstrip() + ", books AS (SELECT conv_id AS book, ord, substr(heading, 3) AS title, regexp_replace(content, '^\\s+', '') AS markdown FROM sec) "


@query(_BOOKS + f", w AS (SELECT *, {sql_words('markdown')} AS ws FROM books), p AS (SELECT *, 100 - coalesce(sum(len(ws)) OVER (PARTITION BY book ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lft FROM w) SELECT book, ord, title, CASE WHEN len(ws) <= lft THEN markdown ELSE array_to_string(ws[1:lft], ' ') END AS markdown FROM p WHERE lft > 0")
def prefix_word_budget(spark, d):
    return context.prefix_words(_books(spark, d), 100)


@query(_BOOKS + "SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY book ORDER BY ord) <= 2")
def first_n_chapters(spark, d):
    return context.first_chapters(_books(spark, d), 2)


@query(_BOOKS + "SELECT book, string_agg(title || chr(10) || chr(10) || markdown, chr(10) || chr(10) ORDER BY ord) AS body FROM books GROUP BY book")
def export_txt(spark, d):
    return sinks.export_txt(_books(spark, d))


@query(_BOOKS + "SELECT book, '{\\rtf1\\ansi' || chr(10) || string_agg('{\\b ' || title || '}\\par' || chr(10) || replace(replace(replace(replace(markdown, '\\', '\\\\'), '{', '\\{'), '}', '\\}'), chr(10), '\\par' || chr(10)) || '\\par' || chr(10), '' ORDER BY ord) || '}' AS body FROM books GROUP BY book")
def export_rtf_body(spark, d):
    return sinks.export_rtf(_books(spark, d))


# Aggregates


@query("SELECT role AS entity, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY conv_id * 1000 + turn)) AS updates FROM conversations WHERE conv_id % 10 >= 0 GROUP BY role, conv_id".replace(" GROUP BY role, conv_id", " GROUP BY role || conv_id, role").replace("role AS entity", "role || conv_id AS entity"))
def aggregate_updates(spark, d):
    u = S.read(spark, d, "conversations").select(F.concat("role", C("conv_id").cast("string")).alias("entity"), (C("conv_id") * 1000 + C("turn")).alias("ord"), C("text").alias("update"))
    return context.aggregate_updates(u).withColumn("updates", F.md5("updates"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def error_summary(spark, d):
    return S.read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_errors(spark, d):
    return S.read(spark, d, "events").where("event_type = 'error'").orderBy(C("ts").desc(), C("event_id").desc()).limit(100).select("event_id", "event_type")


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 10")
def top_k(spark, d):
    return retrieval.top(S.read(spark, d, "documents"), 10, C("n_chars").desc(), C("doc_id"), by="source").select("source", "doc_id", "n_chars")


# Incremental

_STATE = WITH_FILES + ", state AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE md5(content) END AS hash, doc_id % 7 = 0 AS failed FROM files WHERE doc_id % 4 > 0) "


def _state(spark, d):
    return S.files(spark, d).where("doc_id % 4 > 0").select("path", F.when(C("doc_id") % 5 == 0, "old").otherwise(F.md5(C("content").cast("binary"))).alias("hash"), (C("doc_id") % 7 == 0).alias("failed"))


@query(_STATE + "SELECT f.path FROM files f LEFT JOIN state s USING (path) WHERE s.hash IS DISTINCT FROM md5(f.content)")
def hash_gate_changes(spark, d):
    return incremental.changed(incremental.with_hash(S.files(spark, d)), _state(spark, d)).select("path")


@query(WITH_CHUNKS + " SELECT key, md5(text) AS text FROM chunks")
def incremental_reindex(spark, d):
    """An index of an older state brought up to date: the rows of a clean build."""
    files = S.files(spark, d)
    old = files.where("doc_id % 4 > 0").withColumn("content", F.when(C("doc_id") % 5 == 0, F.reverse("content")).otherwise(C("content")))
    made, _ = incremental.reindex(index.chunk_table(old), incremental.with_hash(old).select("path", "hash"), files, index.chunk_table)
    return made.select("key", F.md5("text").alias("text"))


@query(WITH_CHUNKS + " SELECT key, md5(text) AS text FROM chunks")
def index_log(spark, d):
    """The same by a log of changes: an older state, its edits and removals, a compaction, then a rescan of what is there now."""
    files = S.files(spark, d)
    folder = f"{folders.shared_folder(spark)}/loomtext-log-{uuid.uuid4().hex}"
    old = files.withColumn("content", F.when(C("doc_id") % 5 == 0, F.reverse("content")).otherwise(C("content")))
    log.append(folder, old, index.chunk_table)
    log.append(folder, files.where("doc_id % 10 = 0"), index.chunk_table, gone=files.where("doc_id % 4 = 1").select("path"))
    log.compact(spark, folder)
    log.rescan(folder, files, index.chunk_table)
    return log.read(spark, folder).select("key", F.md5("text").alias("text"))


@query(_STATE + "SELECT f.path AS task_id FROM files f LEFT JOIN state s USING (path) WHERE s.hash IS DISTINCT FROM md5(f.content) OR coalesce(s.failed, false)")
def retry_failed_only(spark, d):
    tasks = incremental.with_hash(S.files(spark, d)).select(C("path").alias("task_id"), "hash")
    return incremental.failed_only(tasks, _state(spark, d).withColumnRenamed("path", "task_id")).select("task_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_request_wins(spark, d):
    return incremental.latest_wins(S.read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT user_id AS run_id, max(event_id) AS seq, arg_max(value, event_id) FILTER (event_type = 'click' AND value IS NOT NULL) AS started, arg_max(props, event_id) FILTER (event_type = 'purchase' AND props IS NOT NULL) AS finished FROM events GROUP BY user_id")
def run_log_merged(spark, d):
    """Events as starts and finishes of runs, merged by run."""
    e = S.read(spark, d, "events").select(C("user_id").alias("run_id"), C("event_id").alias("seq"), F.when(C("event_type") == "click", C("value")).alias("started"), F.when(C("event_type") == "purchase", C("props")).alias("finished"))
    return incremental.merge_events(e, "run_id", "seq")


@query("SELECT event_id, user_id FROM events QUALIFY coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts > INTERVAL 1 DAY, true)")
def debounced_requests(spark, d):
    """The events after which their user is quiet for a day."""
    return debounce.debounced(S.read(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 86_400).select("event_id", "user_id")


@query("SELECT doc_id::VARCHAR AS task_id, least(doc_id % 5 + 1, 3)::INTEGER AS attempt, CASE WHEN doc_id % 5 < 3 THEN 'done' ELSE 'failed' END AS state, CASE WHEN doc_id % 5 >= 3 THEN 'chunk ' || doc_id || ' failed' END AS error FROM documents")
def attempt_ledger(spark, d):
    """Tasks that fail up to four times, with two retries each and waits that take no time here."""
    tasks = incremental.with_hash(S.files(spark, d)).select(C("doc_id").cast("string").alias("task_id"), "hash", (C("doc_id") % 5).alias("fails"))
    work = lambda t: t.select("task_id", F.when(C("attempt") <= C("fails"), F.concat(F.lit("chunk "), C("task_id"), F.lit(" failed"))).alias("error"))
    now = [0.0]
    folder = f"{folders.shared_folder(spark)}/loomtext-attempts-{uuid.uuid4().hex}"
    last = attempts.run(folder, tasks, work, clock=lambda: now[0], sleep=lambda s: now.append(now.pop() + s))
    return last.select("task_id", "attempt", "state", "error")


# File plans


@query(WITH_CHUNKS + ", wanted AS (SELECT doc_id || '-Chunked/' || doc_id || '-CHUNK-' || lpad((chunk_index + 1)::VARCHAR, 3, '0') || '.md' AS path FROM chunks), e AS (SELECT doc_id || '-Chunked/' || doc_id || '-CHUNK-00' || k || '.md' AS path FROM documents, (SELECT unnest([1, 2, 3]) AS k) WHERE doc_id % 3 = 0) SELECT coalesce(w.path, e.path) AS path, CASE WHEN w.path IS NULL THEN 'deleted' WHEN e.path IS NULL THEN 'created' ELSE 'overwritten' END AS action FROM wanted w FULL JOIN e ON w.path = e.path")
def chunk_file_plan(spark, d):
    c = S.files(spark, d).select("doc_id", F.posexplode(chunking.windows(T.words(C("content")))).alias("chunk_index", "c")).select(C("doc_id").cast("string").alias("base"), "chunk_index")
    there = S.read(spark, d, "documents").where("doc_id % 3 = 0").select(F.explode(F.array(*[F.format_string(f"%d-Chunked/%d-CHUNK-00{k}.md", "doc_id", "doc_id") for k in (1, 2, 3)])).alias("path"))
    return sinks.chunk_file_plan(c, there, overwrite=True)


@query(WITH_CHUNKS + ", wanted AS (SELECT doc_id || '-Chunked/' || doc_id || '-CHUNK-' || lpad((chunk_index + 1)::VARCHAR, 3, '0') || '.md' AS path FROM chunks WHERE path LIKE '%/en/%'), e AS (SELECT doc_id || '-Chunked/' || doc_id || '-CHUNK-00' || k || '.md' AS path, lang FROM documents, (SELECT unnest([1, 2]) AS k)), a AS (SELECT CASE WHEN e.path IS NULL THEN 'created' WHEN w.path IS NOT NULL THEN 'overwritten' WHEN lang = 'en' THEN 'deleted' END AS action FROM wanted w FULL JOIN e ON w.path = e.path) SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'overwritten') AS overwritten, 0::BIGINT AS skipped, count(*) FILTER (action = 'deleted') AS deleted FROM a")
def chunk_file_counts(spark, d):
    """English documents are chunked anew; files of all documents are there, and those of the others stay."""
    english = S.files(spark, d).where("path like '%/en/%'").withColumn("base", C("doc_id").cast("string"))
    c = english.select("base", F.posexplode(chunking.windows(T.words(C("content")))).alias("chunk_index", "c")).select("base", "chunk_index")
    there = S.read(spark, d, "documents").select(F.explode(F.array(*[F.format_string(f"%d-Chunked/%d-CHUNK-00{k}.md", "doc_id", "doc_id") for k in (1, 2)])).alias("path"))
    return sinks.plan_counts(sinks.chunk_file_plan(c, there, True, english))


@query(WITH_CHUNKS + " SELECT doc_id || '-Chunked/' || doc_id || '-CHUNK-' || lpad((chunk_index + 1)::VARCHAR, 3, '0') || '.md' AS path, md5(text) AS content FROM chunks")
def written_chunk_files(spark, d):
    """Chunk files of reversed documents with longer chunks written over by those of the documents, and read back."""
    at = f"{folders.shared_folder(spark)}/loomtext-files-{uuid.uuid4().hex}"
    base = S.files(spark, d).withColumn("base", C("doc_id").cast("string"))

    def write(source, target):
        chunks = source.select("base", F.posexplode(chunking.windows(T.words(C("content")), target)).alias("chunk_index", "c")).select("base", "chunk_index", "c.text")
        files.write_files(sinks.chunk_file_writes(chunks, files.listed_files(spark, at), True, base.select("base"), "text"), at)

    write(base.where("doc_id % 2 = 0").withColumn("content", F.reverse("content")), 200)
    write(base, 500)
    return files.listed_files(spark, at, contents=True).select("path", F.md5("content").alias("content"))


@query("SELECT coalesce(s_name, c_name) AS name, CASE WHEN c_name IS NULL THEN 'note' WHEN s_name IS NULL THEN '# ' || c_name || chr(10) || chr(10) || '## Jan 1 - Update' || chr(10) || chr(10) || c_mktsegment || chr(10) ELSE 'note' || chr(10) || chr(10) || '## Jan 1 - Update' || chr(10) || chr(10) || c_mktsegment || chr(10) END AS content FROM supplier FULL JOIN customer ON replace(c_name, 'Customer', 'Supplier') = s_name".replace("CASE WHEN c_name", "CASE WHEN c_name").replace("coalesce(s_name, c_name)", "coalesce(s_name, replace(c_name, 'Customer', 'Supplier'))").replace("'# ' || c_name", "'# ' || replace(c_name, 'Customer', 'Supplier')"))
def apply_note_updates(spark, d):
    notes = S.read(spark, d, "supplier").select(C("s_name").alias("name"), F.lit("note").alias("content"))
    updates = S.read(spark, d, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"), C("c_mktsegment").alias("update"))
    return sinks.apply_updates(notes, updates, F.lit("Jan 1"))


@query(WITH_FILES + "SELECT path FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def create_if_absent(spark, d):
    f = S.files(spark, d)
    return sinks.create_if_absent(f.select("path", "doc_id"), S.read(spark, d, "labels"), "doc_id").select("path")


@query()
def export_epub(spark, d):
    return publish.books_as(publish.epub, _books(spark, d)).select("book", F.length("file").alias("n_bytes"))


@query()
def export_docx(spark, d):
    return publish.books_as(publish.docx, _books(spark, d)).select("book", F.length("file").alias("n_bytes"))


@query()
def export_rtf(spark, d):
    return publish.books_as(publish.rtf, _books(spark, d)).select("book", F.length("file").alias("n_bytes"))


@query()
def markdown_to_plain_text(spark, d):
    return S.notes(spark, d).select("conv_id", publish.markdown_to_plain(C("content")).alias("plain"))


@query("SELECT item_id, '# Run log' || chr(10) || chr(10) || '- Mode: chapter' || chr(10) || '- Model: none' || chr(10) || '- Time: 2025-01-01T00:00:00Z' || chr(10) || '- Query hash: ' || printf('%08x', list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(text, ''), lambda x: unicode(x)::HUGEINT)), lambda h, u: (xor(h::BIGINT, u::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT) || chr(10) || '- Context: ' || length(text) || ' chars' || chr(10) || chr(10) || '## Query' || chr(10) || chr(10) || '```text' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || '## Retrieved context' || chr(10) || chr(10) || '```text' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) AS log FROM benchmark")
def generation_log(spark, d):
    log = publish.run_log(F.lit("chapter"), F.lit("none"), F.lit(AS_OF).cast("timestamp"), C("text"), C("text"))
    return S.read(spark, d, "benchmark").select("item_id", log.alias("log"))
