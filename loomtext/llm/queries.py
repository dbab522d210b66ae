"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines

    out = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._spark import doc_key
    from .toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), doc_key() % 4 == 2)


def op8_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .collision_search import search

    return search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._spark import doc_key
    from .lm_scoring import score

    return score(_read(spark, sf_dir, "documents"), doc_key() % 7 == 2)


def op3_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), 200, keep_text=False)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, format_conversations

    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{said}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{said}'")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(rows))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import components

    return components(_read(spark, sf_dir, "documents"))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_codec import encode_and_decode

    return encode_and_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(_read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_format": OP10_SQL, "op12_source_divergence": OP12_SQL, "op13_filter_audit": OP13_SQL, "op4_source_mix": OP4_SQL}


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS merged,
    length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '<<\|<</?SYS>>|<\||</?s>|\[/?INST\]')) AS text_chars,
    length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, chr(10), '')) AS role_chars
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN merged THEN 8 ELSE 8 + role_chars + 1 + 7 END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || doc_id), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src
  FROM d GROUP BY source
), o AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    ((SELECT sum(size) FROM d)::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER p, 0)) / ((SELECT sum(w) FROM s)::DOUBLE - coalesce(sum(w) OVER p, 0)) AS lev
  FROM s WINDOW p AS (ORDER BY 3.0::DOUBLE * source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min(lev, struct_pack(r := cap / w, i := src)) FILTER (lev <= cap / w) AS found, max(lev) AS most FROM o
), g AS (
  SELECT source, source_size, CASE WHEN (SELECT coalesce(found, most) FROM l) > cap / w THEN cap ELSE w * (SELECT coalesce(found, most) FROM l) END AS target FROM o
), q AS (
  SELECT *, (source_size + 63) // 64 AS nb, floor(target / source_size)::BIGINT AS whole FROM g WHERE source_size > 0
), k AS (
  SELECT *, whole * nb + least(nb, floor((target - whole * source_size) / 64 + 0.5)::BIGINT) AS quota FROM q
), placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM d
), cut AS (
  SELECT doc_id, source, size, a, unnest(range(a // 64, (a + size - 1) // 64 + 1)) AS b FROM placed WHERE size > 0
), got AS (
  SELECT cut.doc_id, sum((least(a + size, (b + 1) * 64) - greatest(a, b * 64)) * (quota // nb + CASE WHEN b < quota % nb THEN 1 ELSE 0 END))::BIGINT AS taken
  FROM cut JOIN k ON cut.source IS NOT DISTINCT FROM k.source GROUP BY cut.doc_id
)
SELECT d.doc_id, d.size, g.source_size, g.target, coalesce(got.taken, 0)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN got ON got.doc_id = d.doc_id
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), c AS (
  SELECT w.lang, source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, source, w.term
), l AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang
), g AS (
  SELECT x.lang, x.source, coalesce(v, 0) AS v, coalesce(l.total, 0) AS lang_total, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l ON l.lang = x.lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) AS p, 1 + 1000000000 * (k.n + 2) // (g.lang_total + 2 * g.v) AS q
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), x AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, coalesce((SELECT sum((u.p - z.p) * (u.p - z.p) // (u.p + z.p)) FROM p u JOIN p z ON u.term = z.term WHERE u.lang = a.lang AND u.source = a.source AND z.lang = a.lang AND z.source = b.source), 0)
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM x QUALIFY part = 'pair' OR rank <= 10
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, t, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), x AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails,
    coalesce((SELECT bool_or(l.quality = 1) FROM labels l WHERE l.doc_id = m.doc_id), false) AS good, coalesce((SELECT bool_or(l.toxic = 1) FROM labels l WHERE l.doc_id = m.doc_id), false) AS toxic FROM m
), c AS (
  SELECT part, fails, len(list_filter(fails, lambda f: f)) AS n_fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY ALL
), o AS (
  SELECT '' AS filter_order UNION ALL SELECT filter_order || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(filter_order, l)
), s AS (
  SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS k, [instr('ABCDE', filter_order[j]) FOR j IN range(1, step)] AS before FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5
), r AS (
  SELECT c.part, s.filter_order, s.step, s.k, c.n, c.good, c.toxic, c.n_fails, c.fails[s.k] AS own, len(list_filter(s.before, lambda j: c.fails[j])) > 0 AS gone FROM c, s
), a AS (
  SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (own AND n_fails = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost FROM r GROUP BY part, filter_order, step, k
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM a
"""
