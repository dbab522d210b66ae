"""Text to chunks and sections. Everything but the sentence-aware chunker is an expression on one row: no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def window_size(target: int, overlap: int) -> tuple[int, int]:
    """(words of a window, step) for a wished size and overlap."""
    size = max(200, min(2000, target))
    return size, max(1, size - max(0, min(size - 1, overlap)))


def windows(words: Column, target: int = 500, overlap: int = 100, offset: Column | None = None) -> Column:
    """array<struct<start_word, end_word, text>> of overlapping windows; the last one ends with the text."""
    size, step = window_size(target, overlap)
    offset = F.lit(0) if offset is None else offset

    def made(words: Column) -> Column:
        n = F.size(words)
        last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int") * step
        each = F.transform(
            F.sequence(F.lit(0), last, F.lit(step)),
            lambda s: F.struct((offset + s).cast("int").alias("start_word"), (offset + F.least(n, s + size)).cast("int").alias("end_word"), F.array_join(F.slice(words, s + 1, F.lit(size)), " ").alias("text")),
        )
        return F.when(n > 0, each).otherwise(F.array().cast("array<struct<start_word:int,end_word:int,text:string>>"))

    return T.let(words, made)


def _sections(lines: Column, is_heading, build) -> Column:
    """build(heading line, body lines) of each run from a heading to the next; what stands before the first is left out."""
    def each(lines: Column, at: Column) -> Column:
        n = F.size(lines)
        return F.transform(at, lambda h, k: build(F.get(lines, h), F.slice(lines, h + 2, F.greatest(F.coalesce(F.get(at, k + 1), n) - h - 1, F.lit(0)))))

    def found(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda x, i: F.when(is_heading(x), i)), lambda i: i.isNotNull())
        return T.let(at, lambda at: each(lines, at))

    return T.let(lines, found)


def lines_of(c: Column, carriage: str = "\r\n") -> Column:
    return F.split(F.regexp_replace(T.text(c), carriage, "\n"), "\n")


def split_by_heading(c: Column, level: str = "h1") -> Column:
    """Sections at headings of one level (h1, h2, h3), heading included, trimmed, empty ones left out; none without headings."""
    mark = "#" * int(level[1])
    ws = T.WS
    made = _sections(lines_of(c), lambda x: F.regexp_like(x, F.lit(f"^{ws}*{mark}(?!#){ws}+")), lambda h, body: T.trim_ws(F.concat_ws("\n", F.regexp_replace(h, f"{ws}+$", ""), F.array_join(body, "\n"))))
    return F.filter(made, lambda s: s != "")


def split_by_h1(c: Column) -> Column:
    """array<struct<heading, content, full_text>> at lines that begin with "# "; the whole text if there are none."""

    def build(h: Column, body: Column) -> Column:
        heading, content = F.regexp_replace(h, f"{T.WS}+$", ""), F.regexp_replace(F.array_join(body, "\n"), f"{T.WS}+$", "")
        return F.struct(heading.alias("heading"), content.alias("content"), T.trim_ws(F.concat_ws("\n", heading, content)).alias("full_text"))

    made = _sections(lines_of(c), lambda x: x.startswith("# "), build)
    whole = T.trim_ws(F.regexp_replace(T.text(c), "\r\n", "\n"))
    alone = F.when(whole == "", F.array().cast("array<struct<heading:string,content:string,full_text:string>>")).otherwise(F.array(F.struct(F.lit("").alias("heading"), whole.alias("content"), whole.alias("full_text"))))
    return F.when(F.size(made) > 0, F.filter(made, lambda s: s["full_text"] != "")).otherwise(alone)


def merge_small(sections: Column, min_words: int) -> Column:
    """Neighbouring sections joined by blank lines until they have min_words; the rest as it is."""
    start = F.struct(F.lit("").alias("held"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        n = T.word_count(s)
        held = T.trim_ws(acc["held"])
        return (
            F.when(acc["n"] == 0, F.struct(s.alias("held"), n.alias("n"), acc["out"].alias("out")))
            .when(acc["n"] < min_words, F.struct(F.concat(acc["held"], F.lit("\n\n"), s).alias("held"), (acc["n"] + n).alias("n"), acc["out"].alias("out")))
            .otherwise(F.struct(s.alias("held"), n.alias("n"), F.when(held != "", F.array_append(acc["out"], held)).otherwise(acc["out"]).alias("out")))
        )

    end = lambda acc: F.when((acc["n"] > 0) & (T.trim_ws(acc["held"]) != ""), F.array_append(acc["out"], T.trim_ws(acc["held"]))).otherwise(acc["out"])
    return F.aggregate(sections, start, add, end)


def index_chunks(files: DataFrame, content: str = "content", level: str = "h1", target: int = 500, overlap: int = 100) -> DataFrame:
    """files with chunk_index, start_word, end_word, text: merged sections, windows inside long ones, windows where no headings are."""
    target, overlap = max(200, min(2000, target)), max(0, min(500, overlap))
    kind = "array<struct<start_word:int,end_word:int,text:string>>"
    merged = merge_small(split_by_heading(F.col(content), level), max(200, target // 2)) if level != "none" else F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(acc: Column, s: Column) -> Column:
        n = T.word_count(s)
        one = F.array(F.struct(acc["at"].alias("start_word"), (acc["at"] + n).alias("end_word"), s.alias("text")))
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.when(n <= target, one).otherwise(windows(T.words(s), target, overlap, acc["at"]))).alias("out"))

    df = files.withColumn("_merged", merged)
    made = F.when(F.size("_merged") > 0, F.aggregate("_merged", start, add, lambda acc: acc["out"])).otherwise(windows(T.words(F.col(content)), target, overlap))
    return df.select(*files.columns, F.posexplode(made).alias("chunk_index", "_c")).select(*files.columns, "chunk_index", "_c.start_word", "_c.end_word", "_c.text")


def sentence_chunks(text: str | None, n: int = 500, lossless: bool = False, ahead: int = 50) -> list[str]:
    """Chunks of about n words that end, if it comes soon, at a sentence's end.

    By default the words between the n-th and the sentence's end are left out, as users of the chunks know them;
    lossless keeps them in the chunk.
    """
    words = (text or "").split()
    out: list[str] = []
    at = 0
    while at < len(words):
        end = at + n
        if end > len(words):
            out.append(" ".join(words[at:]))
            break
        # The next chunk starts after a word that ends a sentence: the n-th itself or one of those after it.
        stop = next((j for j in range(end, min(end - 1 + ahead, len(words))) if words[j - 1][-1] in ".!?"), end)
        out.append(" ".join(words[at : stop if lossless else end]))
        at = stop
    return out


def chunk_sentences(files: DataFrame, id_col: str, content: str = "content", n: int = 500, lossless: bool = False) -> DataFrame:
    """(id_col, chunk_index, text) by ``sentence_chunks``: sequential, so an Arrow function over batches of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c) for i, t in zip(b[id_col], b[content], strict=True) for k, c in enumerate(sentence_chunks(t, n, lossless))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "text"])

    return files.select(id_col, content).mapInPandas(run, f"{id_col} {files.schema[id_col].dataType.simpleString()}, chunk_index int, text string")
