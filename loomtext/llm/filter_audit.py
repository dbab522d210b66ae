"""Filter interaction audit: what each filter of a chain removes, in every order of the filters, from one pass over the documents.

A document fails some of n filters; its failures are the bits of a mask. Per part and label class, 2**n signed parity
sums are aggregated, S[w] = sum of (-1)**popcount(w & mask), a Walsh-Hadamard transform of the number of documents by
mask. Sums are integers, so the inverse gives the cells exactly; every order of the filters is then evaluated on the
cells, and a filter's Shapley value, summed over all n! orders, is the sum over the cells that fail it of
n! / (number of failures): among the filters that a document fails each one is the first in as many orders.

Documents are read once, into a narrow table; the rest of the work grows with parts, not with documents.

Defined cases: null texts count as empty, a null part as the empty one; each row is a document, so repeated rows count
as often as they stand there; a repeated row isn't a copy of itself, as only a smaller id makes one; a null id is
neither smaller nor larger than another one and has no labels; several label rows of one id count as one whose label
is set if any of them sets it; an empty table has no parts and gives no rows; other columns, whatever their names, are
ignored. Texts may be of any length.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

#: White space between words, and as many spaces.
_WHITE = "\t\n\x0b\x0c\r"


def word_array(text: Column) -> Column:
    """The words, maximal runs without the space and the five characters from tab to carriage return."""
    return F.array_remove(F.split(F.translate(text, _WHITE, " " * len(_WHITE)), " "), "")


def short(text: Column, words: Column, least: int = 200) -> Column:
    return F.size(words) < least


def repetitive(text: Column, words: Column, percent: int = 50) -> Column:
    """Distinct words are less than percent % of the words."""
    return F.size(F.array_distinct(words)) * 100 < F.size(words) * percent


def shouting(text: Column, words: Column, percent: int = 3) -> Column:
    """Capitals A-Z are more than percent % of the characters."""
    return (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) * 100 > F.length(text) * percent


def symbols(text: Column, words: Column) -> Column:
    return F.regexp_like(text, F.lit("[#$%&*|]"))


#: The default filters by letter: functions of the text and its words, true where a document fails.
FILTERS = {"A": short, "B": repetitive, "C": shouting, "D": symbols}
#: The letter of the filter that fails a document whose text a smaller id has, too.
COPY = "E"


def failures(docs: DataFrame, scratch: _spark.Scratch, filters=FILTERS, copy: str | None = COPY, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of each row: bit k is set if the document fails the k-th filter; that of copies is the last one.

    The least id of each text, by its SHA-256, meets the rows by text and id together: a row that isn't met is a copy,
    and the rows of one text are spread over all partitions.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", word_array(F.col("text")))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    rows = rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("hash"))
    if copy is None:
        return rows.drop("hash")
    rows = scratch.cut(rows)
    first = rows.where("id is not null").groupBy("hash").agg(F.min("id").alias("id")).select("hash", "id", F.lit(True).alias("is_first"))
    fails = F.when(F.col("id").isNotNull() & F.col("is_first").isNull(), 1 << len(filters)).otherwise(0)
    return rows.join(first, ["hash", "id"], "left").select("id", "part", (F.col("mask") + fails).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame, classes: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """rows with the array ``labels``: 'all' and each class, {name: column of labels}, whose column is 1 for the id."""
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(f"is_{k}") for k, c in enumerate(classes.values())])
    # Rows without an id meet nothing; a number of their own keeps them from one partition.
    alone = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    rows = rows.withColumn("alone", alone).join(own.withColumn("alone", F.lit(-1).cast("long")), ["id", "alone"], "left")
    names = F.array(F.lit("all"), *[F.when(F.col(f"is_{k}"), F.lit(c)) for k, c in enumerate(classes)])
    return rows.select("part", "mask", F.array_compact(names).alias("labels"))


def parity_sums(rows: DataFrame, n: int) -> DataFrame:
    """(part, label, sums): the 2**n signed parity sums of the masks, counted before the shuffle."""
    sums = [F.sum(1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(w)) % 2)).alias(f"s{w}") for w in range(1 << n)]
    each = rows.select("part", "mask", F.explode("labels").alias("label"))
    return each.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*[f"s{w}" for w in range(1 << n)]).alias("sums"))


def _masks(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit((1 << n) - 1))


def _sum_where(array: Column | str, n: int, where, weight=None) -> Column:
    """The sum of the array's places m, 0 to 2**n - 1, that where(m) holds for, each times weight(m)."""
    of = lambda m: F.get(array, m) if weight is None else F.get(array, m) * weight(m)
    return F.aggregate(F.filter(_masks(n), where), F.lit(0).cast("long"), lambda total, m: total + of(m))


def cells(sums: DataFrame, n: int) -> DataFrame:
    """(part, label, cells): documents by mask, the transform's exact inverse (itself, over 2**n)."""
    sign = lambda m: lambda w: 1 - 2 * (F.bit_count(m.bitwiseAND(w)) % 2)
    inverse = F.transform(_masks(n), lambda m: F.shiftright(_sum_where("sums", n, lambda w: F.lit(True), sign(m)), n))
    return sums.select("part", "label", inverse.alias("cells"))


def audit(docs: DataFrame, labels: DataFrame, filters=FILTERS, copy: str | None = COPY, classes: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <class>_lost..., shapley) for every order of the filters.

    filters: {letter: function of the columns text and words}; copy: the letter of the filter of copies, or None.
    classes: {name: column of labels}; a document is of a class if the column is 1 for its id.
    kept: documents after this step; removed: by it; redundant: those that fail its filter and are gone before;
    unique_fails: those that fail its filter only; <class>_lost: removed ones of the class; shapley: what its filter
    removes, summed over all orders.
    """
    classes = {"good": "quality", "toxic": "toxic"} if classes is None else classes
    letters = "".join(filters) + (copy or "")
    n = len(letters)
    masks = failures(docs, _spark.Scratch(docs.sparkSession), filters, copy, id_col, text_col, part_col)
    found = cells(parity_sums(labelled(masks, labels, classes, id_col), n), n)
    none = F.array_repeat(F.lit(0).cast("long"), 1 << n)
    parts = found.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == c, F.col("cells"))), none).alias(f"cells_{c}") for c in ("all", *classes)])
    orders = F.explode(F.lit(["".join(p) for p in permutations(letters)]))
    steps = parts.withColumn("filter_order", orders).select("*", F.posexplode(F.split("filter_order", "")).alias("pos", "letter"))
    bit = lambda letter: F.get(F.lit([1 << k for k in range(n)]), F.instr(F.lit(letters), letter) - 1)
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("pos")), F.lit(0), lambda m, x: m + bit(x))
    steps = steps.withColumns({"bit": bit(F.col("letter")), "before": before})
    own = lambda m: m.bitwiseAND(F.col("bit")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda c: _sum_where(f"cells_{c}", n, lambda m: own(m) & ~earlier(m))
    share = F.lit([0] + [factorial(n) // k for k in range(1, n + 1)])
    return steps.select(
        "part",
        "filter_order",
        (F.col("pos") + 1).alias("step"),
        _sum_where("cells_all", n, lambda m: ~own(m) & ~earlier(m)).alias("kept"),
        removed("all").alias("removed"),
        _sum_where("cells_all", n, lambda m: own(m) & earlier(m)).alias("redundant"),
        F.get("cells_all", F.col("bit")).alias("unique_fails"),
        *[removed(c).alias(f"{c}_lost") for c in classes],
        _sum_where("cells_all", n, own, lambda m: F.get(share, F.bit_count(m)).cast("long")).alias("shapley"),
    )
