"""Text files of given names: a Python data source whose tasks write aside, and a job that gives the files their names.

``write_files`` takes rows (path, content, action) as ``sinks.chunk_file_plan`` makes them, or ``sinks.chunk_file_writes``,
whose rows the tasks hold against the folder, so that no contents are shuffled. Each task attempt writes a list
of its files and, packed in blocks, their contents into a folder of its own below ``_aside``; nothing is seen under its
name until all tasks are done. Then the commit names the blocks of the attempts that count and writes the counts of the
actions to ``_counts``, and tasks, to which the blocks are dealt out, remove the deleted files, then write each of the
others aside and rename it; one that is run again does the same again. So beside the files there and the new ones the disk holds packed
contents only, not a file in whole disk blocks for each, and the plan's shuffles go before the files are made. If a task fails for good the folder of the run is deleted; tasks that are then still at work may
leave files aside, which ``sweep`` removes. A run that ends amid the renames leaves whole files under some of the names;
writing the plan again completes it. The folder may be in any store that pyarrow knows and all executors share.

Defined cases: null content is an empty file; a path that is null, absolute or leads out of the folder fails the run;
paths are distinct, of equal ones any stays; an empty plan gives counts of zero; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

ACTIONS = ("created", "overwritten", "skipped", "deleted")
#: Actions that the task chooses by whether the file is there, and what it does if so, else ``created``.
IF_THERE = {"overwrite": "overwritten", "keep": "skipped"}
#: Folders below the sink's that Spark's readers leave out, and the name of a run's table of lists.
ASIDE, COUNTS, COMMITTED = "_aside", "_counts", "committed"
#: Tasks a core for the work on files, which is great for the bytes of their names; names that a batch has.
TASKS, NAMES = 4, 10_000
#: Characters of contents that a block has before it is packed, and names that it has at most.
BLOCK, BLOCK_NAMES = 1 << 20, 512
#: Whether a query's shuffle files are deleted when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class Written(WriterCommitMessage):
    """Where a task's list of files is, the ends of its blocks in the list and in the contents, and how many rows of each action it had."""

    aside: str
    ends: list[tuple[int, int]]
    counts: dict[str, int]


class NamedFiles(DataSource):
    """The format ``named_files``: options path, a folder, and run, a name for this write."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["run"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, run: str):
        self.folder, self.run = folder, run

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.folder)
        return store, root.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        aside = f"{root}/{ASIDE}/{self.run}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(aside)
        counts, n, ends = dict.fromkeys(ACTIONS, 0), 0, [(0, 0)]
        names, texts, held = [], [], 0
        at, there = None, set()
        with store.open_output_stream(f"{aside}/listed") as listed, store.open_output_stream(f"{aside}/contents") as contents:

            def pack() -> None:
                sink = pa.BufferOutputStream()
                with pa.CompressedOutputStream(sink, "zstd") as out:
                    out.write("".join(texts).encode())
                listed.write("".join(names).encode())
                contents.write(sink.getvalue())
                ends.append((listed.tell(), contents.tell()))
                names.clear()
                texts.clear()

            for b in batches:
                for path, content, action in zip(*(b.column(c) for c in ("path", "content", "action")), strict=True):
                    path, content, action = path.as_py(), content.as_py(), action.as_py()
                    if action not in counts and action not in IF_THERE:
                        raise ValueError(f"unknown action {action!r}")
                    if action != "skipped" and (not path or path.startswith("/") or ".." in path.split("/")):
                        raise ValueError(f"path outside the folder: {path!r}")
                    if action in IF_THERE:
                        if at != (at := f"{root}/{path}".rpartition("/")[0]):
                            there = {i.path for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True))}
                        action = IF_THERE[action] if f"{root}/{path}" in there else "created"
                    counts[action] += 1
                    if action == "skipped":
                        continue
                    names.append(json.dumps([action, f"{aside}/{n}", f"{root}/{path}"]) + "\n")
                    texts.append(json.dumps("" if action == "deleted" else content or "", ensure_ascii=False) + "\n")
                    held, n = held + len(texts[-1]), n + 1
                    if held >= BLOCK or len(names) >= BLOCK_NAMES:
                        pack()
                        held = 0
            if names:
                pack()
        return Written(aside, ends, counts)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        done = [m for m in messages if m]
        store.create_dir(f"{root}/{ASIDE}/{self.run}")
        with store.open_output_stream(f"{root}/{ASIDE}/{self.run}/{COMMITTED}") as f:
            f.write("".join(json.dumps([m.aside, *start, *end]) + "\n" for m in done for start, end in zip(m.ends, m.ends[1:])).encode())
        store.create_dir(f"{root}/{COUNTS}")
        with store.open_output_stream(f"{root}/{COUNTS}/{self.run}.json") as f:
            f.write(json.dumps({a: sum(m.counts[a] for m in done) for a in ACTIONS}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        # A task still at work may write there meanwhile; what it leaves is swept, and the write's own error is the one raised.
        with contextlib.suppress(OSError):
            _clear(self.folder, self.run)


def _clear(folder: str, run: str) -> None:
    store, root = fs.FileSystem.from_uri(folder)
    aside = f"{root.rstrip('/')}/{ASIDE}/{run}"
    if store.get_file_info(aside).type != fs.FileType.NotFound:
        store.delete_dir(aside)


def _tasks(spark: SparkSession) -> int:
    return TASKS * spark.sparkContext.defaultParallelism


def _named(spark: SparkSession, folder: str, run: str) -> None:
    """Removes the deleted files of the blocks that the committed attempts have packed, then writes the others under their names."""

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for value in b.column(0).to_pylist():
                attempt, first, _, last, _ = json.loads(value)
                gone = [path for action, _, path in map(json.loads, read(store, f"{attempt}/listed", first, last).splitlines()) if action == "deleted"]
                for path in gone:
                    _gone(store, path)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(gone)], pa.int64())})

    def read(store: fs.FileSystem, at: str, start: int, end: int) -> bytes:
        with store.open_input_file(at) as f:
            f.seek(start)
            return f.read(end - start)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, made = fs.FileSystem.from_uri(folder)[0], set()
        for b in batches:
            for value in b.column(0).to_pylist():
                attempt, first, packed, last, packed_end = json.loads(value)
                names = read(store, f"{attempt}/listed", first, last).splitlines()
                with pa.CompressedInputStream(pa.BufferReader(read(store, f"{attempt}/contents", packed, packed_end)), "zstd") as f:
                    texts = f.read().decode().split("\n")[:-1]
                for name, text in zip(names, texts, strict=True):
                    action, aside, path = json.loads(name)
                    if action == "deleted":
                        continue
                    at = path.rpartition("/")[0]
                    if at not in made:
                        store.create_dir(at)
                        made.add(at)
                    # Another attempt of this task may be at work.
                    aside = f"{aside}-{TaskContext.get().taskAttemptId()}"
                    with store.open_output_stream(aside) as f:
                        f.write(json.loads(text).encode())
                    store.move(aside, path)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(names)], pa.int64())})

    # Read as lines: a folder's name may be any text.
    blocks = spark.read.text(f"{folder}/{ASIDE}/{run}/{COMMITTED}").repartition(_tasks(spark), "value")
    for work in (removed, named):
        blocks.mapInArrow(work, "n long").agg(F.sum("n")).collect()


def _gone(store: fs.FileSystem, path: str) -> None:
    try:
        store.delete_file(path)
    except OSError:
        if store.get_file_info(path).type != fs.FileType.NotFound:
            raise


def write_files(plan: DataFrame, folder: str) -> DataFrame:
    """One row (created, overwritten, skipped, deleted), the counts of the files written; plan(path, content, action)."""
    spark, run = plan.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(NamedFiles)
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        plan.select(*[F.col(c).cast("string").alias(c) for c in ("path", "content", "action")]).write.format("named_files").option("run", run).mode("append").save(folder)
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    try:
        _named(spark, folder, run)
    finally:
        _clear(folder, run)
    return spark.read.schema(", ".join(f"{a} long" for a in ACTIONS)).json(f"{folder}/{COUNTS}/{run}.json")


def sweep(folder: str) -> None:
    """Deletes what failed writes have left aside. No writer may be at work."""
    store, root = fs.FileSystem.from_uri(folder)
    aside = f"{root.rstrip('/')}/{ASIDE}"
    if store.get_file_info(aside).type != fs.FileType.NotFound:
        store.delete_dir(aside)


def listed_files(spark: SparkSession, folder: str, contents: bool = False) -> DataFrame:
    """(path[, content]) of all files below a folder, empty ones included, paths relative to it; none if it isn't there.

    One task lists the folder itself, and what is in it is dealt out. Names that begin with _ or . are left out.
    """

    def entries(at: str, deep: bool) -> tuple[fs.FileSystem, int, list[fs.FileInfo]]:
        store, root = fs.FileSystem.from_uri(folder)
        root = root.rstrip("/")
        return store, len(root) + 1, store.get_file_info(fs.FileSelector(f"{root}/{at}".rstrip("/"), allow_not_found=True, recursive=deep))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                _, cut, found = entries("", False)
                found = [i for i in found if i.base_name[0] not in "._"]
                for k in range(0, len(found), NAMES):
                    some = found[k : k + NAMES]
                    yield pa.RecordBatch.from_pydict({"path": pa.array([i.path[cut:] for i in some], pa.string()), "deep": pa.array([i.type == fs.FileType.Directory for i in some], pa.bool_())})

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            root = fs.FileSystem.from_uri(folder)[1].rstrip("/")
            for path, deep in zip(b.column("path").to_pylist(), b.column("deep").to_pylist(), strict=True):
                store, cut, found = entries(path, True) if deep else (fs.FileSystem.from_uri(folder)[0], 0, [])
                names = sorted(i.path[cut:] for i in found if i.is_file and not any(n[0] in "._" for n in i.path[cut:].split("/"))) if deep else [path]
                for k in range(0, len(names), 256):
                    out = {"path": pa.array(names[k : k + 256], pa.string())}
                    if contents:
                        out["content"] = pa.array([_text(store, f"{root}/{n}") for n in names[k : k + 256]], pa.string())
                    yield pa.RecordBatch.from_pydict(out)

    first = spark.range(1, numPartitions=1).mapInArrow(top, "path string, deep boolean")
    return first.repartition(_tasks(spark), "path").mapInArrow(below, "path string, content string" if contents else "path string")


def _text(store: fs.FileSystem, path: str) -> str:
    with store.open_input_stream(path) as f:
        return f.read().decode()
