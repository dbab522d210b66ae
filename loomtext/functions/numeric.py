"""Numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Dot product over the shorter length, divided by the lengths of the whole vectors; 0 for zero vectors."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def unit_score(s: Column) -> Column:
    """(s + 1) / 2 within 0 and 1."""
    return clamp01((s + 1) / 2)


def clamp01(x: Column) -> Column:
    """x within 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def clamp_int(x: Column, low: int, high: int) -> Column:
    """floor(x) within low and high; low if x is null or not finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.when(finite, x).otherwise(0))))).otherwise(low).cast("long")


def normalize_limit(x: Column) -> Column:
    """A limit within 1 and 200; 20 if x is null or not finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, clamp_int(x, 1, 200)).otherwise(20).cast("long")


def context_budget(limit: Column) -> Column:
    """struct(output, other, context): how a limit of tokens is shared out."""
    share = F.floor(limit * 0.02)
    output = F.least(F.lit(20_000), F.greatest(F.lit(6_000), share))
    other = F.least(F.lit(20_000), F.greatest(F.lit(4_000), share))
    return F.struct(output.cast("long").alias("output"), other.cast("long").alias("other"), F.greatest(F.lit(1_000), limit - output - other).cast("long").alias("context"))


def retrieval_limit(context: Column, per: int, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(context / per))).cast("long")


def output_budget(limit: Column, used: Column) -> Column:
    """Tokens left to generate: 512 to 8,192, what is left less 1,024; null if the prompt leaves under 6,000."""
    return F.when(used <= limit - 6_000, F.greatest(F.lit(512), F.least(F.lit(8_192), limit - used - 1_024))).cast("long")
