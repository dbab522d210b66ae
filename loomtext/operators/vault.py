"""Folders, path filters and file listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _clean(p: str) -> str:
    return p.replace("\\", "/").rstrip("/")


def under(path: Column, folders: list[str]) -> Column:
    """Whether a path is one of the folders or below one; literal lists, so the test reaches the scan."""
    return reduce(lambda a, b: a | b, ((path == f) | path.startswith(f + "/") for f in map(_clean, folders) if f), F.lit(False))


def path_filter(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, active: str | None = None, config_dir: str = ".config", logs_dir: str | None = None) -> DataFrame:
    """Files that may be read: not configuration or logs; included, or without an include list the active file, or any; not excluded."""
    p = F.col("path")
    ok = ~under(p, [config_dir, *([logs_dir] if logs_dir else [])])
    if include:
        ok &= under(p, include)
    elif active:
        ok &= p == active
    return files.where(ok & ~under(p, exclude or []))


def ancestors(path: Column, own: bool = False) -> Column:
    """The folders above a path, from the top; own: and the path itself."""
    parts = F.split(path, "/")
    n = F.size(parts) - (0 if own else 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def filter_by_lists(files: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """Files that are an entry of include (path) or below one, and of exclude neither. Equi-joins on the files' ancestors, so the lists may be of any size."""
    steps = files.select("path", F.explode(ancestors(F.col("path"), own=True)).alias("_step"))
    inside = steps.join(include.select(F.col("path").alias("_step")).distinct(), "_step", "left_semi").select("path").distinct()
    outside = steps.join(exclude.select(F.col("path").alias("_step")).distinct(), "_step", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_semi").join(outside, "path", "left_anti")


def folders(files: DataFrame) -> DataFrame:
    """(path, name, depth) of all folders."""
    f = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return f.select("path", T.base_name(F.col("path")).alias("name"), F.size(F.split("path", "/")).alias("depth"))


def tree(files: DataFrame, extension: str | None = None) -> DataFrame:
    """(path, name, type, depth, parent) of all folders and files; extension: only files of it, and all folders."""
    d = folders(files).withColumn("type", F.lit("folder"))
    own = files if extension is None else files.where(F.lower("ext") == extension)
    f = own.select("path", T.base_name(F.col("path")).alias("name"), F.size(F.split("path", "/")).alias("depth"), F.lit("file").alias("type"))
    return d.unionByName(f).withColumn("parent", T.parent_path(F.col("path")))


def children(nodes: DataFrame) -> DataFrame:
    """(parent, n_children, first, last): the entries of each folder."""
    return nodes.groupBy("parent").agg(F.count("*").alias("n_children"), F.min("path").alias("first"), F.max("path").alias("last"))


def non_empty_folders(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'folder'").join(nodes.select(F.col("parent").alias("path")).distinct(), "path", "left_semi")


def latest(files: DataFrame, folder: Column, pattern: str) -> DataFrame:
    """(folder, path): of each folder the newest file whose base name matches."""
    hit = files.where(F.regexp_like(T.base_name(F.col("path")), F.lit(pattern)))
    return hit.groupBy(folder.alias("folder")).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def picker_order(files: DataFrame) -> DataFrame:
    """Files by time and size, newest and largest first."""
    return files.orderBy((F.unix_millis("mtime") + F.col("size")).desc(), "path")


def picker_positions(files: DataFrame, most_ranges: int = 256) -> DataFrame:
    """(path, position) of all files in picker_order, from 1.

    Files are dealt to ranges of the order, whose bounds are those of a fixed sample, and numbered within each; no
    task sorts them all, and only the sample and a count for each range come to the driver.
    """
    score = F.unix_millis("mtime") + F.col("size")
    keyed = files.select(F.struct(score.isNull().alias("none"), (-score).alias("score"), "path").alias("key"))
    ranges = max(1, min(most_ranges, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sample = sorted(((r["none"], r["score"] or 0, r["path"] or "") for r in keyed.orderBy(F.xxhash64("key")).limit(32 * ranges).select("key.*").collect()), key=lambda r: (r[0], r[1], r[2].encode()))
    bounds = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []
    bound = F.array(*(F.struct(F.lit(n).alias("none"), F.lit(s).cast("long").alias("score"), F.lit(p).alias("path")) for n, s, p in bounds))
    place = F.struct(F.col("key.none").alias("none"), F.coalesce("key.score", F.lit(0)).cast("long").alias("score"), F.coalesce("key.path", F.lit("")).alias("path"))
    dealt = keyed.select("key", (F.size(F.filter(bound, lambda b: b <= place)) if bounds else F.lit(0)).alias("range"))
    before, start = 0, []
    for r, n in sorted(map(tuple, dealt.groupBy("range").count().collect())):
        start.append((r, before))
        before += n
    starts = files.sparkSession.createDataFrame(start, "range int, before long")
    own = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    return dealt.withColumn("own", own).join(F.broadcast(starts), "range").select(F.col("key.path").alias("path"), (F.col("before") + F.col("own")).alias("position"))


def read_or_sentinel(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, content) of the wanted paths; a note in place of a file that isn't there."""
    return wanted.join(files.select("path", "content"), "path", "left").select("path", F.coalesce("content", F.concat(F.lit("[File not found: "), F.col("path"), F.lit("]"))).alias("content"))


def format_notes(notes: DataFrame, group: str) -> DataFrame:
    """(group, notes): the notes (name, content) of a group as one text, by name."""
    part = F.concat(F.lit("## "), F.col("name"), F.lit("\n"), F.col("content"), F.lit("\n"))
    made = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", part.alias("p")))), lambda s: s["p"]), "\n---\n\n")
    return notes.groupBy(group).agg(made.alias("notes"))
