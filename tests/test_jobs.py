"""Files by name, kept results, attempts with waits, debounced requests."""

import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomtext.operators import files, folders, kept, sinks
from loomtext.streaming import attempts, debounce


def on_disk(folder):
    out = {}
    for at, dirs, names in os.walk(folder):
        dirs[:] = [d for d in dirs if not d.startswith("_")]
        out |= {os.path.relpath(os.path.join(at, n), folder): open(os.path.join(at, n), encoding="utf-8").read() for n in names if not n.startswith(".")}
    return out


def chunks(spark, of):
    return spark.createDataFrame([(b, i, t) for b, texts in of.items() for i, t in enumerate(texts)], "base string, chunk_index int, text string")


def chunked(spark, folder, of, overwrite, notes=None):
    notes = None if notes is None else spark.createDataFrame([(n,) for n in notes], "base string")
    plan = sinks.chunk_file_plan(chunks(spark, of), files.listed_files(spark, f"file://{folder}"), overwrite, notes, "text")
    return files.write_files(plan, f"file://{folder}").first().asDict()


def test_chunk_files_are_made_replaced_skipped_and_deleted(spark, tmp_path):
    name = lambda b, n: f"{b}-Chunked/{b}-CHUNK-00{n}.md"
    assert chunked(spark, tmp_path, {"a": ["a one", "a two", None], "b é": ["b one"]}, False) == {"created": 4, "overwritten": 0, "skipped": 0, "deleted": 0}
    assert on_disk(tmp_path) == {name("a", 1): "a one", name("a", 2): "a two", name("a", 3): "", name("b é", 1): "b one"}
    assert chunked(spark, tmp_path, {"a": ["new", "new"], "c": ["c"]}, False) == {"created": 1, "overwritten": 0, "skipped": 2, "deleted": 0}
    assert on_disk(tmp_path)[name("a", 1)] == "a one"
    (tmp_path / "a-Chunked" / "own.md").write_text("mine")
    assert chunked(spark, tmp_path, {"a": ["new"]}, True) == {"created": 0, "overwritten": 1, "skipped": 0, "deleted": 2}
    assert on_disk(tmp_path) == {name("a", 1): "new", "a-Chunked/own.md": "mine", name("b é", 1): "b one", name("c", 1): "c"}
    assert chunked(spark, tmp_path, {"a": ["new"]}, True, ["a", "c"])["deleted"] == 1 and name("c", 1) not in on_disk(tmp_path)
    back = {r["path"]: r["content"] for r in files.listed_files(spark, f"file://{tmp_path}", contents=True).collect()}
    assert back == on_disk(tmp_path)


def test_files_of_a_failed_write_are_not_seen(spark, tmp_path):
    rows = [(f"d/{i}.md", f"text {i}", "created") for i in range(40)]
    good = spark.createDataFrame(rows, "path string, content string, action string").repartition(4)
    for bad in (("../out.md", "x", "created"), (None, "x", "created"), ("/etc/x", "x", "created"), ("x", "x", "renamed")):
        with pytest.raises(PySparkException):
            files.write_files(good.unionByName(spark.createDataFrame([bad], good.schema)), f"file://{tmp_path}/s")
        assert on_disk(tmp_path) == {}
        files.sweep(f"file://{tmp_path}/s")
        assert os.listdir(tmp_path / "s") == []
    assert files.write_files(good, f"file://{tmp_path}/s").first()["created"] == 40 and len(on_disk(tmp_path / "s")) == 40
    assert files.write_files(good.where("false"), f"file://{tmp_path}/s").first().asDict() == dict.fromkeys(files.ACTIONS, 0)


def test_contents_are_packed_until_files_are_named(spark, tmp_path, monkeypatch):
    texts = [f"{i} é\r\n\u2028 \\n " + "words of a chunk " * 200 for i in range(900)] + ["", None]
    rows = [(f"d{i % 300}/{i} é.md", t, "created") for i, t in enumerate(texts)]
    plan = spark.createDataFrame(rows, "path string, content string, action string").coalesce(1)
    held, named = [], files._named

    def looked_at(spark, folder, run):
        held.append([os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(tmp_path / "_aside" / run) for n in names if not n.startswith(".")])
        held.append(sum(1 for _ in open(tmp_path / "_aside" / run / files.COMMITTED)))
        named(spark, folder, run)

    monkeypatch.setattr(files, "_named", looked_at)
    assert files.write_files(plan, f"file://{tmp_path}").first()["created"] == 902
    # A list and contents of one task, and what the commit wrote; several blocks, which are dealt out.
    assert len(held[0]) <= 3 and sum(held[0]) < sum(len(t or "") for t in texts) / 4 and held[1] >= 3
    back = {r["path"]: r["content"] for r in files.listed_files(spark, f"file://{tmp_path}", contents=True).collect()}
    assert back == {path: content or "" for path, content, _ in rows}
    gone = spark.createDataFrame([(p, None, "deleted") for p, _, _ in rows[::2]] + [("not/there.md", None, "deleted")], plan.schema)
    assert files.write_files(gone, f"file://{tmp_path}").first()["deleted"] == 452
    left = {r["path"] for r in files.listed_files(spark, f"file://{tmp_path}").collect()}
    assert left == {p for p, _, _ in rows[1::2]} and os.listdir(tmp_path / "_aside") == []


def test_chunk_files_are_held_against_the_folder_without_a_shuffle(spark, tmp_path):
    name = lambda b, n: f"{b}-Chunked/{b}-CHUNK-{n:03d}.md"
    at = {k: f"file://{tmp_path}/{k}" for k in ("plan", "writes")}

    def both(of, overwrite, notes=None):
        notes = None if notes is None else spark.createDataFrame([(n,) for n in notes], "base string")
        make = {"plan": sinks.chunk_file_plan, "writes": sinks.chunk_file_writes}
        made = {k: make[k](chunks(spark, of), files.listed_files(spark, at[k]), overwrite, notes, "text") for k in at}
        counts = [files.write_files(made[k], at[k]).first().asDict() for k in at]
        assert counts[0] == counts[1] and on_disk(tmp_path / "plan") == on_disk(tmp_path / "writes")
        return counts[0]

    assert both({"a": ["1", "2", None], "b é": ["1"]}, False)["created"] == 4
    assert both({"a": ["x", "x"], "c": ["1"]}, False) == {"created": 1, "overwritten": 0, "skipped": 2, "deleted": 0}
    assert both({"a": ["x"], "d": [f"{i}" for i in range(1001)]}, True) == {"created": 1001, "overwritten": 1, "skipped": 0, "deleted": 2}
    assert both({"d": ["new"]}, True, ["c", "d"]) == {"created": 0, "overwritten": 1, "skipped": 0, "deleted": 1001}
    assert on_disk(tmp_path / "writes") == {name("a", 1): "x", name("b é", 1): "1", name("d", 1): "new"}
    plan = sinks.chunk_file_writes(chunks(spark, {"a": ["x"]}), files.listed_files(spark, at["writes"]), True)
    assert not any("content" in line or "text" in line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


def test_kept_results(spark, tmp_path):
    at, calls = f"file://{tmp_path}/kept", []

    def find(q):
        calls.append(sorted(r["text"] for r in q.collect()))
        return q.where("text <> 'nothing'").select("query_id", F.explode(F.split("text", " ")).alias("key"))

    def ask(texts, now, made_of="v1", **more):
        q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        return sorted(tuple(r) for r in kept.search(at, q, find, made_of, now, **more).select("query_id", "key").collect())

    both = [(0, "a"), (0, "b"), (1, "c")]
    assert ask(["a b", "c", "nothing", "", None], 1000) == both
    assert ask(["a b", " c ", "nothing"], 1010) == both and calls == [["a b", "c", "nothing"]]  # nothing is asked again
    assert ask(["a b", "d", "d"], 1020) == [(0, "a"), (0, "b"), (1, "d"), (2, "d")] and calls[1:] == [["d"]]
    assert ask(["a b"], 1020, "v2") == both[:2] and calls[2:] == [["a b"]]  # another version of the index
    assert ask(["a b"], 1020, settings="limit 3") == both[:2] and len(calls) == 4
    assert ask(["a b", "d"], 1031) == [(0, "a"), (0, "b"), (1, "d")] and calls[4:] == [["a b"]]  # the first run is too old
    assert kept.expire(spark, at, 1031) == 1 and ask(["a b", "d"], 1032) == [(0, "a"), (0, "b"), (1, "d")] and len(calls) == 5
    assert ask([], 5000) == [] and ask(["", None], 5001) == []


def test_a_failed_search_keeps_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/kept"
    q = spark.createDataFrame([(1, "x")], "query_id long, text string")
    with pytest.raises(PySparkException):
        kept.search(at, q, lambda q: q.select("query_id", F.raise_error(F.lit("no")).cast("string").alias("key")), "v", 10)
    assert folders.names(spark, f"{at}/commits") == []
    assert kept.search(at, q, lambda q: q.select("query_id", F.lit("k").alias("key")), "v", 10).collect()[0]["key"] == "k"


class Clock:
    def __init__(self):
        self.now, self.slept = 100.0, []

    def time(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(round(seconds, 6))
        self.now += seconds


def test_attempts_wait_longer_and_end(spark, tmp_path):
    at, clock, tried = f"file://{tmp_path}/tasks", Clock(), []
    tasks = spark.createDataFrame([("good", "h", 0), ("once", "h", 1), ("twice", "h", 2), ("never", "h", 9)], "task_id string, hash string, fails int")

    def work(d):
        tried.append(sorted((r["task_id"], r["attempt"]) for r in d.collect()))
        return d.select("task_id", F.when(F.col("attempt") <= F.col("fails"), F.lit("broken")).alias("error"))

    def run(t, job=work):
        return {r["task_id"]: (r["attempt"], r["state"], r["error"]) for r in attempts.run(at, t, job, clock=clock.time, sleep=clock.sleep).collect()}

    assert run(tasks) == {"good": (1, "done", None), "once": (2, "done", None), "twice": (3, "done", None), "never": (3, "failed", "broken")}
    assert clock.slept == [0.6, 1.2] and [len(t) for t in tried] == [4, 3, 2]
    # Later only the failed one is tried, from the start, and what has changed.
    tried.clear()
    assert run(tasks.withColumn("hash", F.when(F.col("task_id") == "good", "new").otherwise(F.col("hash"))))["never"] == (3, "failed", "broken")
    assert tried == [[("good", 1), ("never", 1)], [("never", 2)], [("never", 3)]]
    done = attempts.standing(spark, at).where("state = 'done'").select("task_id", "hash")
    assert attempts.run_round(at, done, work, 1e9) == 0 and len(tried) == 3


def test_a_job_that_fails_or_does_not_answer_is_an_attempt(spark, tmp_path):
    clock = Clock()
    tasks = spark.createDataFrame([("a", "h"), ("b", "h")], "task_id string, hash string")
    run = lambda name, work: {r["task_id"]: r.asDict() for r in attempts.run(f"file://{tmp_path}/{name}", tasks, work, retries=1, wait=2, clock=clock.time, sleep=clock.sleep).collect()}
    got = run("broken", lambda d: d.select("task_id", F.raise_error(F.lit("no model")).cast("string").alias("error")))
    assert {(r["state"], r["attempt"]) for r in got.values()} == {("failed", 2)} and "no model" in got["a"]["error"]
    got = run("silent", lambda d: d.where("task_id = 'a'").select("task_id", F.lit(None).cast("string").alias("error")))
    assert got["a"]["state"] == "done" and (got["b"]["state"], got["b"]["error"]) == ("failed", "no answer")
    assert clock.slept == [2, 2] and attempts.run(f"file://{tmp_path}/none", tasks.where("false"), run).count() == 0


def test_a_round_runs_only_what_is_due(spark, tmp_path):
    at = f"file://{tmp_path}/tasks"
    tasks = spark.createDataFrame([("a", "h")], "task_id string, hash string")
    fail = lambda d: d.select("task_id", F.lit("no").alias("error"))
    assert [attempts.run_round(at, tasks, fail, now, 2, 10) for now in (0, 9, 10, 29, 30, 1000)] == [1, 0, 1, 0, 1, 0]
    assert [(r["attempt"], r["state"], r["next_at"]) for r in attempts.ledger(spark, at).orderBy("round").collect()] == [(1, "waiting", 10), (2, "waiting", 30), (3, "failed", None)]


def requests(seed=3, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "c", None]) if rng.random() < 0.7 else "hot", round(rng.uniform(0, 300), 1), i) for i in range(n)]


def quiet(rows, wait):
    last = sorted(rows, key=lambda r: (r[1], r[2]))
    return sorted(r[2] for i, r in enumerate(last) if not any(s[0] == r[0] and round(s[1] - r[1], 6) <= wait for s in last[i + 1 :]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, s double, n long").select("key", F.timestamp_micros(F.round(F.col("s") * 1_000_000).cast("long")).alias("at"), "n")


@pytest.mark.parametrize("wait", [0.6, 5.0])
def test_debounced(spark, wait):
    rows = requests()
    got = debounce.debounced(frame(spark, rows), "key", "at", "n", wait)
    assert got.columns == ["key", "at", "n"] and sorted(r["n"] for r in got.collect()) == quiet(rows, wait)
    assert debounce.debounced(frame(spark, [("a", None, 1)]), "key", "at", "n", wait).count() == 0


def test_debounced_stream(spark, tmp_path):
    rows, wait = requests(n=150), 2.0
    late = ("a", 120.0, 1000)  # comes when its time has long passed
    by_time = sorted(rows, key=lambda r: r[1] + random.Random(r[2]).uniform(0, 8))  # up to 8 seconds out of order
    parts = [by_time[:40], by_time[40:90], by_time[90:], [("clock", 1000.0, 2000)], [late, ("clock", 2000.0, 2001)]]
    src = tmp_path / "in"
    for i, p in enumerate(parts):
        frame(spark, p).coalesce(1).write.parquet(f"file://{src}/{i}")
    schema = spark.read.parquet(f"file://{src}/0").schema
    got = []
    for i in range(len(parts)):  # each run goes on from the checkpoint of the one before
        stage = tmp_path / "stream"
        stage.mkdir(exist_ok=True)
        for f in (src / str(i)).glob("*.parquet"):
            f.rename(stage / f"{i}-{f.name}")
        stream = debounce.debounced_stream(spark.readStream.schema(schema).parquet(f"file://{stage}"), "key", "at", "n", wait)
        q = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    got = sorted(r["n"] for r in back.collect())
    assert got == sorted([*quiet(rows, wait), 2000])
    assert sorted(r["n"] for r in back.join(frame(spark, [*rows, *parts[3]]), ["n", "at"]).collect()) == got


def test_files_are_named_and_listed_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(f"d{i}/{k}.md", f"text {i} {k}", "created") for i in range(40) for k in range(3)]
    plan = spark.createDataFrame(rows, "path string, content string, action string").repartition(4)
    runs, clear = [], files._clear
    monkeypatch.setattr(files, "_clear", lambda folder, run: runs.append(run))
    assert files.write_files(plan, f"file://{tmp_path}").first()["created"] == 120
    want = {path: content for path, content, _ in rows}
    assert on_disk(tmp_path) == want
    # A task that is run again, some of whose files have their names, names the rest.
    listed = [line for f in (tmp_path / "_aside" / runs[0]).glob("*/listed") for line in f.read_text().splitlines()]
    _, aside, path = json.loads(listed[0])
    os.rename(path, aside)
    files._named(spark, f"file://{tmp_path}", runs[0])
    assert on_disk(tmp_path) == want
    clear(f"file://{tmp_path}", runs[0])
    assert os.listdir(tmp_path / "_aside") == []
    back = files.listed_files(spark, f"file://{tmp_path}", contents=True).withColumn("task", F.spark_partition_id()).collect()
    assert {r["path"]: r["content"] for r in back} == want and len({r["task"] for r in back}) > 4
