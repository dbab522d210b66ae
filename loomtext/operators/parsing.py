"""Structured text to rows: chapters, tables of contents, links, entity sections, rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import lines_of

WS = T.WS

# The formats of list items, links and rosters in notes. They must be these for right results.
LIST_ITEM = rf"^{WS}*(?:[-*+]{WS}+|\d+\.{WS}+)"
WIKI_LINK = r"\[\[([^\]|#]+)(?:#[^\]]+)?(?:\|[^\]]+)?\]\]"
MARKDOWN_LINK = r"\[[^\]]*\]\(([^)]+)\)"
BULLET = f"^[-*]{WS}+"
NUMBER = rf"^\d+[.)\]]{WS}+"
ALIASES = rf"(?i)aliases?{WS}*:{WS}*(.+)$"


def h1_chapters(c: Column) -> Column:
    """array<struct<title, markdown>> at "# Title" lines; text before the first is the chapter "Chapter", a text without any content the chapter "Book"."""
    body = F.regexp_replace(T.text(c), "^﻿", "")
    lines = lines_of(body, "\r?\n")
    pattern = f"^#{WS}+(.+?){WS}*$"
    at = F.filter(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.lit(pattern)), i)), lambda i: i.isNotNull())
    n = F.size(lines)

    def chapter(h: Column, k: Column) -> Column:
        rest = F.slice(lines, h + 2, F.greatest(F.coalesce(F.get(at, k + 1), n) - h - 1, F.lit(0)))
        return F.struct(T.trim_ws(F.regexp_extract(F.get(lines, h), pattern, 1)).alias("title"), T.trim_ws(F.array_join(rest, "\n")).alias("markdown"))

    lead = T.trim_ws(F.array_join(F.slice(lines, F.lit(1), F.coalesce(F.get(at, F.lit(0)), n)), "\n"))
    preamble = F.when(lead != "", F.array(F.struct(F.lit("Chapter").alias("title"), lead.alias("markdown")))).otherwise(F.array().cast("array<struct<title:string,markdown:string>>"))
    made = F.concat(preamble, F.transform(at, chapter))
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.struct(F.lit("Book").alias("title"), T.trim_ws(body).alias("markdown"))))


def toc_block(c: Column) -> Column:
    """The lines below "# TOC" up to the next H1; null without one."""
    lines = lines_of(F.regexp_replace(T.text(c), "^﻿", ""), "\r?\n")
    is_toc = F.transform(lines, lambda x: F.regexp_like(T.trim_ws(x), F.lit(f"(?i)^#{WS}+toc{WS}*$")))
    start = F.array_position(is_toc, F.lit(True)).cast("int")
    rest = F.slice(lines, start + 1, F.size(lines))
    stop = F.array_position(F.transform(rest, lambda x: F.regexp_like(T.trim_ws(x), F.lit(f"^#{WS}+"))), F.lit(True)).cast("int")
    return F.when(start > 0, F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest))


def list_links(lines: Column) -> Column:
    """Targets of wiki links, then of Markdown links, of each list item, in order."""
    item = F.filter(lines, lambda x: F.regexp_like(x, F.lit(LIST_ITEM)))
    both = F.flatten(F.transform(item, lambda x: F.concat(F.regexp_extract_all(x, F.lit(WIKI_LINK), F.lit(1)), F.regexp_extract_all(x, F.lit(MARKDOWN_LINK), F.lit(1)))))
    return F.filter(F.transform(both, T.trim_ws), lambda x: x != "")


def link_target(c: Column) -> Column:
    """A link without its fragment and angle brackets."""
    bare = T.trim_ws(F.substring_index(c, "#", 1))
    return T.trim_ws(F.regexp_replace(bare, "^<|>$", ""))


def resolve_links(links: DataFrame, files: DataFrame, target: str = "target") -> DataFrame:
    """links with ``path``: the file of that path, else of that path with .md, else the shortest path of that base name; null if none."""
    files = files.select("path").distinct()
    t = link_target(F.col(target))
    names = files.select("path", F.regexp_replace(T.base_name(F.col("path")), r"\.[^.]*$", "").alias("_name")).groupBy("_name").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("_near"))
    out = links.withColumn("_t", t)
    out = out.join(files.select(F.col("path").alias("_exact")), F.col("_t") == F.col("_exact"), "left")
    out = out.join(files.select(F.col("path").alias("_md")), F.concat(F.col("_t"), F.lit(".md")) == F.col("_md"), "left")
    out = out.join(names, F.regexp_replace(T.base_name(F.col("_t")), r"\.md$", "") == F.col("_name"), "left")
    return out.select(*links.columns, F.when(F.col("_t") != "", F.coalesce("_exact", "_md", "_near")).alias("path"))


def compile_from_toc(toc: DataFrame, files: DataFrame, id_col: str, content: str = "content") -> DataFrame:
    """(id_col, ord, title, source_path, markdown): the linked chapters of a table-of-contents note, each once, in order."""
    block = F.coalesce(toc_block(F.col(content)), lines_of(F.col(content), "\r?\n"))
    links = toc.select(id_col, F.posexplode(F.array_distinct(list_links(block))).alias("ord", "target"))
    found = resolve_links(links, files).where("path is not null")
    pattern = f"(?m)^#{WS}+(.+?){WS}*$"
    body = files.select("path", F.col("content").alias("_body"))
    title = F.regexp_extract("_body", pattern, 1)
    name = F.regexp_replace(T.base_name(F.col("path")), r"\.[^.]*$", "")
    return found.join(body, "path").select(id_col, "ord", F.when(title != "", title).otherwise(name).alias("title"), F.col("path").alias("source_path"), T.trim_ws(F.col("_body")).alias("markdown"))


def entity_sections(c: Column) -> Column:
    """array<struct<entity, update>> at "## Name" lines with content; an "### … Update" line in it goes."""
    parts = F.split(T.text(c), f"(?m)^##{WS}+(?=.)")
    made = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: F.struct(T.trim_ws(F.substring_index(p, "\n", 1)).alias("entity"), T.trim_ws(F.regexp_replace(T.trim_ws(F.when(F.instr(p, "\n") > 0, F.substring(p, F.instr(p, "\n") + 1, F.length(p))).otherwise("")), rf"(?m)\A((?:(?!^###{WS}+.*?Update{WS}*\n)[\s\S])*?)^###{WS}+.*?Update{WS}*\n", "$1")).alias("update")),
    )
    return F.filter(made, lambda s: (s["entity"] != "") & (s["update"] != ""))


def capitalized_names(c: Column, most_words: int = 3) -> Column:
    """Distinct runs of capitalised ASCII words, of at most three words by spaces; words end at any other character, as ECMAScript's ``\\b`` has it."""
    found = F.regexp_extract_all(T.text(c), F.lit(rf"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*)(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: F.size(F.split(x, " ")) <= most_words))


def parse_roster(rosters: DataFrame, id_col: str, content: str = "content") -> DataFrame:
    """(id_col, ord, name, aliases array<string>): "- Name | aliases: A, B" lines; names differ by more than case, aliases are united."""
    line = F.explode(F.transform(lines_of(F.col(content), "\r?\n"), lambda x, i: F.struct(i.alias("i"), T.trim_ws(x).alias("x"))))
    rows = rosters.select(F.col(id_col), line.alias("l")).select(id_col, F.col("l.i").alias("i"), F.col("l.x").alias("x")).where("x <> ''")
    clean = T.trim_ws(F.regexp_replace(F.regexp_replace("x", BULLET, ""), NUMBER, ""))
    sides = F.split(clean, rf"{WS}*\|{WS}*")
    rows = rows.select(id_col, "i", T.collapse_ws(F.get(sides, F.lit(0))).alias("name"), F.regexp_extract(F.coalesce(F.get(sides, F.lit(1)), F.lit("")), ALIASES, 1).alias("a")).where("name <> ''")
    aliases = F.filter(F.transform(F.split("a", ","), T.collapse_ws), lambda x: x != "")
    rows = rows.withColumn("aliases", aliases)
    merged = rows.groupBy(id_col, F.lower("name").alias("_k")).agg(F.min_by("name", "i").alias("name"), F.min("i").alias("i"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "aliases"))), lambda s: s["aliases"]))).alias("aliases"))
    return merged.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("i")) - 1).alias("ord"), "name", "aliases")


def roster_lines(name: Column, aliases: Column) -> Column:
    return F.concat(F.lit("- "), name, F.when(F.size(aliases) > 0, F.concat(F.lit(" | aliases: "), F.array_join(aliases, ", "))).otherwise(""))
