"""Queries of the column functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..sources import tables as S
from .registry import query, sql_tokens, sql_words

C = F.col


def _docs(spark, d):
    return S.read(spark, d, "documents")


@query("SELECT item_id, printf('%08x', list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(text, ''), lambda x: unicode(x)::HUGEINT)), lambda h, u: (xor(h::BIGINT, u::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS hash FROM benchmark")
def fnv1a32(spark, d):
    return S.read(spark, d, "benchmark").select("item_id", T.fnv1a32(C("text")).alias("hash"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def estimate_tokens(spark, d):
    return _docs(spark, d).select("doc_id", T.estimate_tokens(C("text")).alias("tokens"))


@query(f"SELECT doc_id, md5(array_to_string({sql_words('text')}, '|')) AS words FROM documents")
def word_split(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(F.array_join(T.words(C("text")), "|")).alias("words"))


@query(f"SELECT doc_id, len({sql_words('text')})::BIGINT AS n FROM documents")
def word_count(spark, d):
    return _docs(spark, d).select("doc_id", T.word_count(C("text")).cast("long").alias("n"))


@query(f"SELECT doc_id, md5(array_to_string({sql_tokens('text')}, '|')) AS tokens, len({sql_tokens('text')})::BIGINT AS n FROM documents")
def tokenize_unicode(spark, d):
    t = T.tokens(C("text"))
    return _docs(spark, d).select("doc_id", F.md5(F.array_join(t, "|")).alias("tokens"), F.size(t).cast("long").alias("n"))


@query(f"SELECT doc_id, md5(array_to_string({sql_tokens('text', '[^a-z0-9]+')}, '|')) AS tokens FROM documents")
def tokenize_ascii(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(F.array_join(T.tokens(C("text"), T.ASCII_SPLIT), "|")).alias("tokens"))


@query(f"SELECT doc_id, len(list_distinct({sql_tokens('text', stop=False)}))::BIGINT AS n, md5(array_to_string(list_sort(list_distinct({sql_tokens('text', stop=False)})), '|')) AS tokens FROM documents")
def token_set(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.token_set(C("text"))).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(T.token_set(C("text"))), "|")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(t) > 2500 THEN left(t, 2500) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def excerpt(spark, d):
    return _docs(spark, d).select("doc_id", T.excerpt(C("text")).alias("excerpt"))


@query(
    """WITH a AS (SELECT doc_id, text AS c, instr(lower(text), 'the') - 1 AS pos FROM documents), b AS (SELECT *, greatest(0, pos - 100) AS s, least(length(c), greatest(0, pos - 100) + 300) AS e FROM a)
    SELECT doc_id, CASE WHEN pos < 0 THEN left(c, 300) ELSE regexp_replace((CASE WHEN s > 0 THEN '…' ELSE '' END) || substr(c, s + 1, e - s) || (CASE WHEN e < length(c) THEN '…' ELSE '' END), '^\\s+|\\s+$', '', 'g') END AS snippet FROM b"""
)
def find_snippet(spark, d):
    return _docs(spark, d).select("doc_id", T.snippet(C("text"), F.lit("the"), 300).alias("snippet"))


@query(f"SELECT doc_id, CASE WHEN len(w) <= 50 THEN text ELSE array_to_string(w[1:50], ' ') END AS words FROM (SELECT doc_id, text, {sql_words('text')} AS w FROM documents)")
def first_n_words(spark, d):
    return _docs(spark, d).select("doc_id", T.first_n_words(C("text"), 50).alias("words"))


@query(f"SELECT doc_id, CASE WHEN len(w) <= 50 THEN text ELSE array_to_string(w[len(w) - 49:], ' ') END AS words FROM (SELECT doc_id, text, {sql_words('text')} AS w FROM documents)")
def last_n_words(spark, d):
    return _docs(spark, d).select("doc_id", T.last_n_words(C("text"), 50).alias("words"))


@query(f"SELECT doc_id, array_to_string(({sql_words('text')})[1:50], ' ') AS words FROM documents")
def slice_first_n_words(spark, d):
    return _docs(spark, d).select("doc_id", T.slice_first_n_words(C("text"), 50).alias("words"))


@query(
    f"""WITH a AS (SELECT doc_id, text, instr(text, 'an') AS pos FROM documents), b AS (SELECT doc_id, pos, left(text, pos - 1) AS p, substr(text, pos + 2) AS q FROM a),
    c AS (SELECT *, {sql_words('p')} AS pw, {sql_words('q')} AS qw FROM b)
    SELECT doc_id, CASE WHEN pos = 0 THEN '' WHEN len(pw) <= 20 THEN p ELSE array_to_string(pw[len(pw) - 19:], ' ') END AS before, CASE WHEN pos = 0 THEN '' WHEN len(qw) <= 20 THEN q ELSE array_to_string(qw[1:20], ' ') END AS after FROM c"""
)
def surrounding_context(spark, d):
    return _docs(spark, d).select("doc_id", T.surroundings(C("text"), F.lit("an"), 20).alias("s")).select("doc_id", "s.before", "s.after")


@query("SELECT doc_id, CASE WHEN length(text) > 4800 THEN left(text, 4800) || chr(10) || chr(10) || '[Note: truncated to ~1,200 tokens]' ELSE text END AS text FROM documents")
def trim_head_budget(spark, d):
    return _docs(spark, d).select("doc_id", T.trim_head(C("text"), F.lit(1200), "Note").alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 4800 THEN '[Note: showing last ~1,200 tokens]' || chr(10) || chr(10) || right(text, 4800) ELSE text END AS text FROM documents")
def trim_tail_budget(spark, d):
    return _docs(spark, d).select("doc_id", T.trim_tail(C("text"), F.lit(1200), "Note").alias("text"))


@query(
    """WITH a AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS lim FROM orders), b AS (SELECT *, least(20000, greatest(6000, floor(lim * 0.02)))::BIGINT AS output, least(20000, greatest(4000, floor(lim * 0.02)))::BIGINT AS other FROM a), c AS (SELECT *, greatest(1000, lim - output - other)::BIGINT AS context FROM b)
    SELECT o_orderkey, output, other, context, least(200, greatest(24, context // 12000))::BIGINT AS chapter_hits, least(80, greatest(12, context // 20000))::BIGINT AS micro_hits FROM c"""
)
def context_budget(spark, d):
    o = S.read(spark, d, "orders").select("o_orderkey", N.context_budget(F.floor("o_totalprice").cast("long")).alias("b")).select("o_orderkey", "b.*")
    return o.withColumns({"chapter_hits": N.retrieval_limit(C("context"), 12_000, 24, 200), "micro_hits": N.retrieval_limit(C("context"), 20_000, 12, 80)})


@query("SELECT event_id, CASE WHEN value IS NULL THEN 2 ELSE greatest(2, least(50, floor(value)))::BIGINT END AS clamped, greatest(0.0, least(1.0, value / 10)) AS unit, CASE WHEN value IS NULL THEN 20 ELSE greatest(1, least(200, floor(value)))::BIGINT END AS hit_limit FROM events")
def clamp_functions(spark, d):
    v = C("value")
    return S.read(spark, d, "events").select("event_id", N.clamp_int(v, 2, 50).alias("clamped"), N.clamp01(v / 10).alias("unit"), N.normalize_limit(v).alias("hit_limit"))


_NAME = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[-_]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT s_suppkey, {_NAME.format('s_name')} AS name FROM supplier")
def normalize_name(spark, d):
    return S.read(spark, d, "supplier").select("s_suppkey", T.normalize_name(C("s_name")).alias("name"))


@query("SELECT p_partkey, levenshtein(p_name, p_brand)::BIGINT AS distance FROM part")
def levenshtein(spark, d):
    return S.read(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_brand").cast("long").alias("distance"))


@query(f"SELECT p_partkey, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 9) AS sim FROM (SELECT p_partkey, {_NAME.format('p_name')} AS a, {_NAME.format('p_type')} AS b FROM part)")
def name_similarity(spark, d):
    return S.read(spark, d, "part").select("p_partkey", F.round(T.name_similarity(C("p_name"), C("p_type")), 9).alias("sim"))


_PAIR = "(SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, d):
    v = S.read(spark, d, "embeddings").select("vec_id", "embedding")
    return v.join(v.select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("next")), "vec_id")


@query(f"SELECT vec_id, round(list_dot_product(x, y), 6) AS dot FROM {_PAIR}")
def vector_dot(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(N.dot(C("embedding"), C("next")), 6).alias("dot"))


@query(f"SELECT vec_id, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) AS cosine FROM {_PAIR}")
def vector_cosine(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(N.cosine(C("embedding"), C("next")), 6).alias("cosine"))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total, round(v[1] / n, 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def l2_normalize(spark, d):
    v = S.read(spark, d, "embeddings").select("vec_id", N.l2_normalize(C("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query(f"SELECT p_partkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 9) AS j FROM (SELECT p_partkey, list_distinct({sql_tokens('p_name', stop=False)}) AS a, list_distinct({sql_tokens('p_type || chr(32) || p_name', stop=False)}) AS b FROM part)")
def jaccard(spark, d):
    b = T.token_set(F.concat_ws(" ", "p_type", "p_name"))
    return S.read(spark, d, "part").select("p_partkey", F.round(T.jaccard(T.token_set(C("p_name")), b), 9).alias("j"))


@query(
    """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</p>\\s*<p>', chr(10) || chr(10), 'g'), '<br\\s*/?>', chr(10), 'g'), '</h\\d>\\s*<h\\d[^>]*>', chr(10) || chr(10), 'g'), '</li>\\s*<li>', chr(10), 'g'), '</(ul|ol)>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM pages)
    SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS plain FROM a"""
)
def html_to_plain_text(spark, d):
    return S.read(spark, d, "pages").select("page_id", F.md5(T.html_to_plain(C("html"))).alias("plain"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM pages")
def escape_xml(spark, d):
    return S.read(spark, d, "pages").select("page_id", F.md5(T.escape_xml(C("html"))).alias("escaped"))


@query("SELECT page_id, md5(regexp_replace(replace(replace(replace(html, '\\', '\\\\'), '{', '\\{'), '}', '\\}'), '\\r?\\n', '\\\\par' || chr(10), 'g')) AS escaped FROM pages")
def escape_rtf(spark, d):
    return S.read(spark, d, "pages").select("page_id", F.md5(T.escape_rtf(C("html"))).alias("escaped"))


@query("SELECT page_id, CASE WHEN n = '' THEN 'book' ELSE n END AS name FROM (SELECT page_id, regexp_replace(trim(url), '[\\x00-\\x1F<>:\"/\\\\|?*]', '_', 'g') AS n FROM pages)")
def sanitize_file_name(spark, d):
    return S.read(spark, d, "pages").select("page_id", T.sanitize_file_name(C("url")).alias("name"))


@query("SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS parent, string_split(url, '/')[-1] AS base, CASE WHEN lower(url) LIKE '%.html' THEN url ELSE url || '.html' END AS named FROM pages")
def path_functions(spark, d):
    u = C("url")
    return S.read(spark, d, "pages").select("page_id", T.parent_path(u).alias("parent"), T.base_name(u).alias("base"), T.ensure_extension(u, "html").alias("named"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H-%M-%S') AS file_stamp, strftime(ts, '%B %-d, %Y, %-I:%M %p') AS long_form, strftime(ts, '%Y-%m-%d') AS day FROM events")
def date_stamps(spark, d):
    ts = C("ts")
    return S.read(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd HH-mm-ss").alias("file_stamp"), F.date_format(ts, "MMMM d, yyyy, h:mm a").alias("long_form"), F.date_format(ts, "yyyy-MM-dd").alias("day"))


@query("SELECT doc_id, round(1 / (1 + greatest(0, 1735689600000 - (1704067200000 + doc_id * 3600000)) / 2592000000.0::DOUBLE), 9) AS recency FROM documents")
def recency_decay(spark, d):
    return S.files(spark, d).select("doc_id", F.round(T.recency(C("mtime"), F.lit("2025-01-01 00:00:00").cast("timestamp")), 9).alias("recency"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)^[A-Z]\\w+')) AS n FROM documents")
def regex_count(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_count("text", F.lit(r"(?m)^[A-Z]\w+")).cast("long").alias("n"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS v, left(props, 1200) AS preview FROM events")
def json_first_of(spark, d):
    return S.read(spark, d, "events").select("event_id", T.json_first_of(C("props"), "$.missing", "$.k").alias("v"), F.left("props", F.lit(1200)).alias("preview"))


@query("SELECT doc_id, concat_ws(chr(10) || chr(10), 'Text:' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), CASE WHEN doc_id % 3 > 0 THEN 'Source:' || chr(10) || source END) AS q FROM documents WHERE trim(text) <> ''")
def build_query_text(spark, d):
    return _docs(spark, d).where("trim(text) <> ''").select("doc_id", T.query_text(Text=C("text"), Source=F.when(C("doc_id") % 3 > 0, C("source"))).alias("q"))


@query("SELECT o_orderkey, CASE WHEN used <= lim - 6000 THEN greatest(512, least(8192, lim - used - 1024))::BIGINT END AS tokens FROM (SELECT o_orderkey, 200000 AS lim, floor(o_totalprice)::BIGINT AS used FROM orders)")
def output_token_budget(spark, d):
    return S.read(spark, d, "orders").select("o_orderkey", N.output_budget(F.lit(200_000), F.floor("o_totalprice").cast("long")).alias("tokens"))


@query()
def embed_text(spark, d):
    from ..operators.embed import hashed_bag_of_words

    return _docs(spark, d).select("doc_id", hashed_bag_of_words(C("text")).alias("vector"))
