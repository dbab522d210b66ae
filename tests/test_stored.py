"""Stored indexes, the index by log, names by segments, plans of chunk files: against plain Python and clean builds."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import folders, index, retrieval, sinks, stored
from loomtext.streaming import log


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in range(40)]
    rows = [(f"n/{i}.md", " ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 60, 300, 900])))) for i in range(n)]
    return rows + [("n/empty.md", ""), ("n/none.md", None), ("n/twin1.md", rows[0][1]), ("n/twin2.md", rows[0][1])]


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('chunks')}/c"
    index.chunk_table(spark.createDataFrame(corpus(), "path string, content string")).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "alpha1 beta2 gamma3 alpha1"), (2, "delta39"), (3, "nowhere"), (4, ""), (5, None), (6, corpus()[0][1])], "query_id long, text string")


def hits(df):
    return sorted((r["query_id"], r["rank"], r["key"], r["path"], round(r["score"], 7)) for r in df.collect())


@pytest.mark.parametrize("span,first", [(256, 8), (4, 2)])
def test_stored_search_is_bm25(spark, chunks, queries, tmp_path, monkeypatch, span, first):
    monkeypatch.setattr(stored, "SPAN", span)
    monkeypatch.setattr(stored, "FIRST", first)
    made = stored.save(chunks, f"file://{tmp_path}/i", parts=8)
    for limit in (1, 5, 400):
        assert hits(made.search(queries, limit)) == hits(retrieval.bm25_search(chunks, queries, limit))


def test_a_search_reads_the_folders_of_its_terms(spark, chunks, tmp_path):
    made = stored.save(chunks, f"file://{tmp_path}/i", parts=32)
    asked = spark.createDataFrame([(1, "alpha1")], "query_id long, text string")
    plan = made._within(made.blocks, asked.select(stored._part(F.lit("alpha1"), 32).alias("part")))
    assert len({f.split("part=")[1].split("/")[0] for f in plan.inputFiles()}) == 32  # what is there
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "part" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert [r["path"] for r in made.search(asked, 3).collect()] == [r["path"] for r in retrieval.bm25_search(chunks, asked, 3).collect()]


def test_versions_and_settings(spark, chunks, tmp_path):
    at = f"file://{tmp_path}/i"
    assert stored.load(spark, at) is None
    stored.save(chunks, at, target=500)
    assert stored.load(spark, at, target=500) is not None and stored.load(spark, at, target=400) is None
    assert stored.load(spark, at, retrieval.RetrievalConfig(bm25_b=0.5), target=500) is None
    few = chunks.where("path = 'n/1.md'")
    made = stored.save(few, at, target=500)
    assert made.at.endswith("v2") and made.head["n_chunks"] == few.count()
    chunks.limit(1).write.parquet(f"{at}/v3/chunks")  # a version whose writer failed
    assert stored.load(spark, at, target=500).at.endswith("v2")
    assert stored.save(chunks, at, target=500).at.endswith("v4")


def test_an_index_of_nothing(spark, chunks, queries, tmp_path):
    made = stored.save(chunks.limit(0), f"file://{tmp_path}/i")
    assert made.search(queries).count() == 0 and made.head["n_chunks"] == 0


def test_stored_vectors(spark, tmp_path):
    at = f"file://{tmp_path}/v"
    rows = [("a", "p", [3.0, 4.0]), ("b", "p", None), ("c", "p", [float("nan"), 1.0]), ("d", "p", [float("inf"), 1.0]), ("e", "p", [None, 1.0]), ("f", "p", [0.0, 0.0])]
    v = spark.createDataFrame(rows, "key string, path string, vector array<float>")
    assert stored.load_vectors(spark, at, "m") is None
    made = {r["key"]: (r["dim"], r["norm"]) for r in stored.save_vectors(v, at, "m").collect()}
    assert made == {"a": (2, 5.0), "f": (2, 0.0)}
    assert stored.load_vectors(spark, at, "other") is None and stored.load_vectors(spark, at, "m").count() == 2


def test_dense_tiles_and_odd_numbers(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"k{i}", "p", [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [("inf", "p", [float("inf")] * 6), ("nan", "p", [float("nan")] * 6)]
    v = spark.createDataFrame(rows, "key string, path string, vector array<double>")
    q = v.where("key like 'k1%'").select(F.substring("key", 2, 9).cast("long").alias("query_id"), F.col("vector").alias("query_vector"))
    want = hits(retrieval.dense_knn(v, q, 3))
    assert want and all(h[2] != "inf" for h in want)
    monkeypatch.setattr(retrieval, "TILE_BYTES", 4000)
    assert hits(retrieval.dense_knn(v, q, 3)) == want


# The heuristic scan and providers


def scanned(rows, queries, as_of_ms, most=120, limit=24):
    import re
    from decimal import ROUND_HALF_UP, Decimal

    nine = lambda x: float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    stop = set(retrieval.T.STOP_WORDS)
    out = []
    for q, text, active in queries:
        terms = [t for t in re.split("[^a-z0-9]+", text.lower()) if len(t) >= 3 and t not in stop][:24]
        if not terms:
            continue
        cand = []
        for path, name, mtime, content in rows:
            title = sum(t in f"{name} {path}".lower() for t in terms)
            base = title + 0.5 / (1 + max(0, as_of_ms - mtime) / 2592e6) + (0.75 if path == active else 0) + (0.15 if active is not None and path.startswith(active.rpartition("/")[0]) else 0)
            cand.append((-nine(base), path, base, title, content.lower()))
        found = []
        for _, path, base, title, low in sorted(cand)[:most]:
            tf = sum(low.count(t) for t in terms)
            if tf or title:
                found.append((-nine(min(1.0, base / 6 + 0.7 * min(1.0, tf / 24))), f"file:{path}"))
        out += [(q, k + 1, key) for k, (_, key) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def test_scan_of_candidates_is_the_scan_of_all(spark):
    import datetime

    rng = random.Random(4)
    part = lambda: rng.choice(["ab", "abc", "notes", "dragon", "Keep", "zed9"])
    rows = sorted({f"{part()}/{part()}{rng.randint(0, 3)}/{part()}-{i}.md": 0 for i in range(400)} | {f"root{i}.md": 0 for i in range(5)})
    rows = [(p, p.rpartition("/")[2][:-3], 1_700_000_000_000 - rng.randint(0, 400) * 86_400_000, " ".join(part() for _ in range(rng.randint(0, 40)))) for p in rows]
    queries = [(1, "the Dragon keep dragon", None), (2, "zed9 nowhere", rows[7][0]), (3, "notes", "root1.md"), (4, "ab", None), (5, "qqq", "abc/gone.md"), (6, "abc", "ab/x"), (7, "unseen words only", None)]
    files = spark.createDataFrame([(p, n, datetime.datetime.fromtimestamp(m / 1000, datetime.timezone.utc), c) for p, n, m, c in rows], "path string, basename string, mtime timestamp, content string")
    asked = spark.createDataFrame(queries, "query_id long, text string, active_path string")
    as_of = F.timestamp_millis(F.lit(1_700_000_000_000))
    got = retrieval.heuristic_search(files, asked, as_of)
    assert sorted((r["query_id"], r["rank"], r["key"]) for r in got.collect()) == scanned(rows, queries, 1_700_000_000_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert retrieval.heuristic_search(files.limit(0), asked, as_of).count() == 0


def test_a_failing_provider_leaves_the_others(spark):
    asked = spark.createDataFrame([(1, "x")], "query_id long, text string")
    one = lambda name, n: lambda q: q.select("query_id", F.lit(name).alias("provider"), F.explode(F.array(*[F.lit(f"{name}{i}") for i in range(n)])).alias("key")).select("*", *[F.lit("t").alias(c) for c in ("path", "title", "excerpt")], (1 / (1 + F.length("key"))).alias("score"), F.array(F.lit(name)).alias("reason_tags"))

    def raising(q):
        raise ValueError("not set up\nmore")

    broken = lambda q: one("b", 2)(q).withColumn("path", F.raise_error(F.lit("lost")).cast("string"))
    hits, errors = retrieval.hybrid_of({"a": one("a", 3), "r": raising, "b": broken, "none": lambda q: one("n", 1)(q).limit(0)}, asked)
    assert [r["key"] for r in hits.orderBy("rank").collect()] == ["a0", "a1", "a2"] and hits.first()["provider"] == "a"
    assert [(r["provider"], r["message"]) for r in errors.where("provider = 'r'").collect()] == [("r", "not set up")] and errors.count() == 2
    both, errors = retrieval.hybrid_of({"a": one("a", 3), "c": one("c", 2)}, asked)
    assert {r["key"] for r in both.collect()} == {"a0", "a1", "a2", "c0", "c1"} and errors.count() == 0
    none, errors = retrieval.hybrid_of({"r": raising}, asked)
    assert none.count() == 0 and errors.count() == 1


def test_a_finish_adds_to_its_start(spark):
    from loomtext.streaming import incremental

    e = spark.createDataFrame([("r1", 1, "chapter", None, None), ("r1", 2, None, "ok", 5), ("r2", 3, "micro", None, None), ("r1", 4, None, None, 7)], "run string, seq int, mode string, status string, chars int")
    got = {r["run"]: (r["seq"], r["mode"], r["status"], r["chars"]) for r in incremental.merge_events(e, "run", "seq").collect()}
    assert got == {"r1": (4, "chapter", "ok", 7), "r2": (3, "micro", None, None)}


# The index by log


def one_chunk(files):
    return files.select(F.concat(F.lit("chunk:"), "path").alias("key"), "path", F.col("content").alias("text")).where("text <> ''")


def content(df):
    return sorted((r["key"], r["text"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_log_equals_a_clean_build_after_each_change(spark, tmp_path):
    at, there = f"file://{tmp_path}/log", {}
    rng = random.Random(2)
    assert log.read(spark, at) is None and log.compact(spark, at) is None
    for k in range(6):
        new = {f"p{rng.randrange(12)}": rng.choice(["x", "y", "z", ""]) * rng.randint(0, 3) for _ in range(4)}
        out = [p for p in there if p not in new][:k % 3] + ["never"]
        log.append(at, frame(spark, list(new.items())), one_chunk, frame(spark, [(p, None) for p in out]))
        there = {p: c for p, c in {**there, **new}.items() if p not in out}
        assert content(log.read(spark, at)) == sorted((f"chunk:{p}", c) for p, c in there.items() if c)
        assert {r["path"] for r in log.state(spark, at).collect()} == set(there)
        if k == 3:
            log.compact(spark, at)
            assert content(log.read(spark, at)) == sorted((f"chunk:{p}", c) for p, c in there.items() if c)
            assert len(log.live(spark, at)) == 1 and log.vacuum(spark, at) == [1, 2, 3, 4]


def test_log_writes_what_changes_only(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    rows = [(f"p{i}", f"{random.Random(i).random()} " * 200) for i in range(200)]
    log.append(at, frame(spark, rows), one_chunk)
    first = folders.written(spark, f"{at}/chunks/v=1")
    assert log.append(at, frame(spark, [("p1", "new"), *rows[2:]]), one_chunk) == 2
    assert folders.written(spark, f"{at}/chunks/v=2") < first / 10
    assert [r["path"] for r in spark.read.parquet(f"{at}/paths/v=2").collect()] == ["p1"]


def test_log_failures_and_replays(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    log.append(at, frame(spark, [("a", "1")]), one_chunk, batch="b0")
    assert log.append(at, frame(spark, [("a", "2")]), one_chunk, batch="b0") is None
    with pytest.raises(Exception):
        log.append(at, frame(spark, [("a", "3")]), lambda f: one_chunk(f).withColumn("key", F.raise_error(F.lit("no"))))
    assert content(log.read(spark, at)) == [("chunk:a", "1")]
    assert log.append(at, frame(spark, [("b", "4")]), one_chunk) == 3
    assert content(log.read(spark, at)) == [("chunk:a", "1"), ("chunk:b", "4")] and log.vacuum(spark, at) == [2]
    log.rescan(at, frame(spark, [("b", "4"), ("c", "5")]), one_chunk)
    assert content(log.read(spark, at)) == [("chunk:b", "4"), ("chunk:c", "5")]


def test_log_of_a_stream(spark, tmp_path):
    at, inbox = f"file://{tmp_path}/log", tmp_path / "in"
    schema = "path string, content string, mtime long, gone boolean"
    batches = [[("a", "1", 1, False), ("a", "2", 2, None), ("b", "1", 1, False)], [("b", None, 2, True), ("c", "1", 1, False)], [("a", "3", 3, False), ("c", "1", 2, False), ("b", "9", 1, False), ("b", "", 0, True)]]
    want = [[("a", "2"), ("b", "1")], [("a", "2"), ("c", "1")], [("a", "3"), ("b", "9"), ("c", "1")]]
    for rows, now in zip(batches, want):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(inbox))
        log.stream(spark.readStream.schema(schema).parquet(str(inbox)), at, str(tmp_path / "ck"), one_chunk).awaitTermination()
        assert content(log.read(spark, at)) == sorted((f"chunk:{p}", t) for p, t in now)
    assert len(log.commits(spark, at)) == 3


# Names and chunk files


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _step(row, i, x, b)
    return row[-1]


def _step(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
    return out


@pytest.mark.parametrize("maybe", [0.78, 0.6, 0.9])
def test_segments_find_all_alike_names(spark, maybe):
    rng = random.Random(7)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 24))) for _ in range(25)]

    def spoil(name):
        name = list(name)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(name) + 1)
            name[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "xy"])
        return "".join(name)

    p, k = sorted({spoil(rng.choice(base)) for _ in range(120)}), sorted({spoil(b) for b in base for _ in range(3)})
    got = {(r["n"], r["kn"]): r["sim"] for r in retrieval.alike_names(spark.createDataFrame([(x,) for x in p], "n string"), spark.createDataFrame([(x,) for x in k], "kn string"), maybe).collect()}
    want = {(a, b): 1 - distance(a, b) / max(len(a), len(b)) for a in p for b in k if a and b and 1 - distance(a, b) / max(len(a), len(b)) >= maybe}
    assert got == pytest.approx(want) and set(got) == set(want)


def test_names_alike_in_most_places_meet_heads_first(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "FREQUENT", 4)
    k = [f"supplier000000{i:03d}" for i in range(300)]
    p = [f"customer000000{i:03d}" for i in range(0, 300, 7)] + [x.replace("supplier", "splier") for x in k[::17]] + [f"{x} jr" for x in k[::23]] + ["supplier00000x", "supplier0"]
    shared = folders.shared_folder(spark)
    old = set(folders.names(spark, shared))
    got = {(r["n"], r["kn"]) for r in retrieval.alike_names(spark.createDataFrame([(x,) for x in p], "n string"), spark.createDataFrame([(x,) for x in k], "kn string")).collect()}
    want = {(a, b) for a in p for b in k if 1 - distance(a, b) / max(len(a), len(b)) >= 0.78}
    assert got == want and len(want) > 300
    # No name that begins with customer goes on beyond the first heads.
    (made,) = [n for n in folders.names(spark, shared) if n.startswith("loomtext-names-") and n not in old]
    heads = [spark.read.parquet(f"{shared}/{made}/{n}") for n in folders.names(spark, f"{shared}/{made}") if n.startswith("heads")]
    assert heads and not any(t.where("n like 'customer%'").count() for t in heads)


def test_names_that_begin_or_end_alike_are_told_apart_once(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "FREQUENT", 4)
    k = [f"supplier000000{i:03d}" for i in range(300)]
    p = [x.replace("supplier", "splier") for x in k[::3]] + [f"{x} jr" for x in k[::3]]
    shared = folders.shared_folder(spark)
    old = set(folders.names(spark, shared))
    got = {(r["n"], r["kn"]) for r in retrieval.alike_names(spark.createDataFrame([(x,) for x in p], "n string"), spark.createDataFrame([(x,) for x in k], "kn string")).collect()}
    assert got == {(a, b) for a in p for b in k if 1 - distance(a, b) / max(len(a), len(b)) >= 0.78}
    (made,) = [n for n in folders.names(spark, shared) if n.startswith("loomtext-names-") and n not in old]
    first = [spark.read.parquet(f"{shared}/{made}/{n}").count() for n in ("heads0", "tails0")]
    assert first[0] < len(p) / 2 and first[1] <= 4 * 10 * 10  # pairs of heads, by part, not names


def test_candidates_in_the_order_of_their_spelling(spark):
    names = [f"{'a' if i % 2 else 'A'}bcdefgh{i:02d}" for i in range(12)] + ["ABCDEFGH11", "ABcdefgh10"]
    known = spark.createDataFrame([(x,) for x in names], "name string")
    for most in (1, 3, 13, 20):
        (r,) = retrieval.resolve_names(spark.createDataFrame([("abcdefghxx",)], "name string"), known, most=most).collect()
        assert r["candidates"] == sorted(names)[:most]


def test_as_many_candidates_as_asked_for(spark):
    known = spark.createDataFrame([(f"abcdefgh{i:02d}",) for i in range(12)], "name string")
    asked = spark.createDataFrame([("abcdefghxx",), ("abcdefghijklmnopqrstuvwxyzabcdefghijklmno",)], "name string")
    for most in (1, 5, 20):
        got = {r["name"]: r["candidates"] for r in retrieval.resolve_names(asked, known, most=most).collect()}
        assert got["abcdefghxx"] == [f"abcdefgh{i:02d}" for i in range(min(most, 12))]


def test_chunk_files_of_other_notes_stay(spark):
    chunks = spark.createDataFrame([("a", 0), ("a", 1)], "base string, chunk_index int")
    paths = ["a-Chunked/a-CHUNK-002.md", "a-Chunked/a-CHUNK-003.md", "a-Chunked/a-CHUNK-1003.md", "b-Chunked/b-CHUNK-001.md", "a-Chunked/b-CHUNK-001.md", "c-Chunked/c-CHUNK-001.md", "a.md"]
    there = spark.createDataFrame([(p,) for p in paths], "path string")
    plan = lambda *a: {r["path"]: r["action"] for r in sinks.chunk_file_plan(chunks, there, *a).collect()}
    own = {"a-Chunked/a-CHUNK-001.md": "created", "a-Chunked/a-CHUNK-002.md": "overwritten", "a-Chunked/a-CHUNK-003.md": "deleted", "a-Chunked/a-CHUNK-1003.md": "deleted"}
    assert plan(True) == own
    notes = spark.createDataFrame([("a",), ("c",)], "base string")
    assert plan(True, notes) == own | {"c-Chunked/c-CHUNK-001.md": "deleted"}
    assert plan(False) == {"a-Chunked/a-CHUNK-001.md": "created", "a-Chunked/a-CHUNK-002.md": "skipped"}
    assert sinks.plan_counts(sinks.chunk_file_plan(chunks, there, True)).first().asDict() == {"created": 1, "overwritten": 1, "skipped": 0, "deleted": 2}
