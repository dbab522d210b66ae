"""Text expressions. White space is the Unicode class of ECMAScript's ``\\s``; null text counts as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\x0B\f\r    -     　﻿]"
#: Words that lexical retrieval leaves out.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "to", "of", "in", "on", "for", "with", "at", "from", "by", "as", "is", "are", "was", "were", "be", "been", "it", "that", "this", "these", "those",
)
UNICODE_SPLIT, ASCII_SPLIT = r"[^\p{L}\p{N}]+", r"[^a-z0-9]+"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once a row, even where use has it within a lambda or several times."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, f"{WS}+", " "))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count twice."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def words(c: Column) -> Column:
    return F.filter(F.split(text(c), f"{WS}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def first_n_words(c: Column, n: int) -> Column:
    """The text itself when it has at most n words, else its first n joined by spaces."""
    w = words(c)
    return F.when(F.size(w) <= n, text(c)).otherwise(F.array_join(F.slice(w, 1, n), " "))


def last_n_words(c: Column, n: int) -> Column:
    w = words(c)
    return F.when(F.size(w) <= n, text(c)).otherwise(F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n)), " "))


def slice_first_n_words(c: Column, n: Column | int) -> Column:
    """The first n words, always joined by single spaces; empty for n <= 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n <= 0, "").otherwise(F.array_join(F.slice(words(c), F.lit(1), F.greatest(n.cast("int"), F.lit(0))), " "))


def tokens(c: Column, pattern: str = UNICODE_SPLIT, stop: bool = True) -> Column:
    """Lower-case runs of letters and digits, at least three long, without stop words."""
    ws = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(F.lower(text(c)), pattern), lambda t: (F.length(t) >= 3) & ~F.array_contains(ws, t) if stop else F.length(t) >= 3)


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c, stop=False))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def excerpt(c: Column, n: int = 2500) -> Column:
    flat = collapse_ws(text(c))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("…"))).otherwise(flat)


def snippet(content: Column, term: Column, n: int) -> Column:
    """n characters around the first occurrence of term, marked where cut; the first n if there is none."""
    at = F.instr(F.lower(content), F.lower(term)) - 1
    start = F.greatest(F.lit(0), at - n // 3)
    end = F.least(F.length(content), start + n)
    around = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(content, start + 1, end - start), F.when(end < F.length(content), "…").otherwise(""))
    return F.when(at < 0, F.left(content, F.lit(n))).otherwise(trim_ws(around))


def surroundings(c: Column, selected: Column, n: int = 500) -> Column:
    """struct(before, after): n words either side of the first occurrence of selected; empty if there is none."""
    at = F.instr(c, selected)
    before = last_n_words(F.substring(c, F.lit(1), at - 1), n)
    after = first_n_words(F.substring(c, at + F.length(selected), F.length(c)), n)
    return F.struct(F.when(at > 0, before).otherwise("").alias("before"), F.when(at > 0, after).otherwise("").alias("after"))


def estimate_tokens(c: Column) -> Column:
    return F.ceil(utf16_length(text(c)) / 4).cast("long")


def trim_head(c: Column, budget: Column, label: str) -> Column:
    """The head of a text within a budget of tokens (four characters each), with a note if it was cut."""
    n = F.floor(budget * 4).cast("int")
    note = F.concat(F.lit(f"\n\n[{label}: truncated to ~"), F.format_number(budget, 0), F.lit(" tokens]"))
    return F.when(F.length(text(c)) > n, F.concat(F.left(text(c), n), note)).otherwise(text(c))


def trim_tail(c: Column, budget: Column, label: str) -> Column:
    n = F.floor(budget * 4).cast("int")
    note = F.concat(F.lit(f"[{label}: showing last ~"), F.format_number(budget, 0), F.lit(" tokens]\n\n"))
    return F.when(F.length(text(c)) > n, F.concat(note, F.right(text(c), n))).otherwise(text(c))


def fnv1a32(c: Column) -> Column:
    """FNV-1a over UTF-16 code units as eight hexadecimal digits. An interpreted fold: for keys and short texts."""
    units = F.flatten(
        F.transform(
            F.filter(F.split(text(c), ""), lambda x: x != ""),
            lambda x: F.when(F.ascii(x) < 65536, F.array(F.ascii(x).cast("long"))).otherwise(
                F.array((F.lit(0xD800) + F.shiftright(F.ascii(x) - 65536, 10)).cast("long"), (F.lit(0xDC00) + (F.ascii(x) - 65536).bitwiseAND(1023)).cast("long"))
            ),
        )
    )
    fold = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.lpad(F.lower(F.hex(fold)), 8, "0")


def normalize_name(c: Column) -> Column:
    """Lower case, hyphens and underscores as spaces, letters and digits only, single spaces."""
    c = F.regexp_replace(trim_ws(F.lower(text(c))), "[-_]+", " ")
    return collapse_ws(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{WS[1:-1]}]", ""))


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of normalised names; 0 if either is empty."""
    a, b = normalize_name(a), normalize_name(b)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


#: The entities that are decoded.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def replace_all(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_to_plain(c: Column) -> Column:
    """Paragraph, heading, break and list ends as newlines, other tags gone, entities decoded, at most one blank line."""
    ws = WS
    c = F.regexp_replace(text(c), f"</p>{ws}*<p>", "\n\n")
    c = F.regexp_replace(c, f"<br{ws}*/?>", "\n")
    c = F.regexp_replace(c, rf"</h\d>{ws}*<h\d[^>]*>", "\n\n")
    c = F.regexp_replace(c, f"</li>{ws}*<li>", "\n")
    c = F.regexp_replace(c, "</(ul|ol)>", "\n\n")
    c = replace_all(F.regexp_replace(c, "<[^>]+>", ""), ENTITIES)
    return trim_ws(F.regexp_replace(c, "\n{3,}", "\n\n"))


def escape_xml(c: Column) -> Column:
    return replace_all(text(c), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")))


def escape_rtf(c: Column) -> Column:
    c = replace_all(text(c), (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}")))
    return F.regexp_replace(c, "\r?\n", r"\\par" + "\n")


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[.*+?^${}()|\[\]\\]", r"\\$0")


def escape_fence(c: Column) -> Column:
    """Code fences broken by a zero-width space, so that a text can stand inside one."""
    return F.replace(text(c), F.lit("```"), F.lit("``​`"))


def sanitize_file_name(c: Column, default: str = "book") -> Column:
    name = F.regexp_replace(trim_ws(text(c)), r'[\x00-\x1F<>:"/\\|?*]', "_")
    return F.when(name == "", default).otherwise(name)


def parent_path(c: Column) -> Column:
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise("")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def normalize_folder(c: Column, default: str) -> Column:
    f = F.regexp_replace(F.replace(text(c), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.when(f == "", default).otherwise(f)


def ensure_extension(c: Column, ext: str) -> Column:
    return F.when(F.lower(c).endswith(f".{ext}"), c).otherwise(F.concat(c, F.lit(f".{ext}")))


def recency(mtime: Column, as_of: Column) -> Column:
    """1 / (1 + age / 30 days), against an explicit time; 1 for files that are newer."""
    age = F.greatest(F.lit(0), F.unix_millis(as_of) - F.unix_millis(mtime))
    return 1 / (1 + age / (30 * 86_400_000.0))


def json_first_of(c: Column, *paths: str) -> Column:
    """The first of the JSON paths that is there."""
    return F.coalesce(*(F.get_json_object(c, p) for p in paths))


def query_text(**parts: Column) -> Column:
    """Labelled parts that are not blank, joined by blank lines."""
    shown = [F.when(trim_ws(text(v)) != "", F.concat(F.lit(f"{k}:\n"), trim_ws(text(v)))) for k, v in parts.items()]
    return F.concat_ws("\n\n", *shown)
