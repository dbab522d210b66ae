"""Operators on literal cases and against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomtext.config import RetrievalConfig
from loomtext.functions import text as T
from loomtext.operators import chunking, context, index, parsing, retrieval, sinks, vault
from loomtext.streaming import incremental


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_windows_cover_all_words(spark):
    for n in (0, 1, 499, 500, 501, 900, 1000, 1301):
        text = " ".join(map(str, range(n)))
        got = [(c["start_word"], c["end_word"]) for c in one(spark, chunking.windows(T.words(F.lit(text))))]
        want, at = [], 0
        while n:
            want.append((at, min(n, at + 500)))
            if at + 500 >= n:
                break
            at += 400
        assert got == want, n
    assert one(spark, chunking.windows(T.words(F.lit("a b c"))))[0]["text"] == "a b c"


def test_headings(spark):
    text = F.lit("lead\r\n# One \r\nbody\n## sub\n  # Two\n#not\n### x")
    assert one(spark, chunking.split_by_heading(text)) == ["# One\nbody\n## sub", "# Two\n#not\n### x"]
    assert one(spark, chunking.split_by_heading(text, "h2")) == ["## sub\n  # Two\n#not\n### x"]
    assert one(spark, chunking.split_by_heading(F.lit("none"))) == []
    assert [s["heading"] for s in one(spark, chunking.split_by_h1(F.lit("# A\nx\n# B")))] == ["# A", "# B"]
    assert one(spark, chunking.split_by_h1(F.lit(" plain ")))[0]["full_text"] == "plain"
    assert one(spark, chunking.split_by_h1(F.lit(""))) == []


def merged(sections, least):
    out, held, n = [], [], 0
    for s in sections:
        k = len(s.split())
        if n == 0:
            held, n = [s], k
        elif n < least:
            held, n = [*held, s], n + k
        else:
            out.append("\n\n".join(held).strip())
            held, n = [s], k
    if n:
        out.append("\n\n".join(held).strip())
    return [x for x in out if x]


def test_merge_small(spark):
    random.seed(1)
    for _ in range(6):
        parts = [" ".join("w" * random.randint(0, 6)) for _ in range(random.randint(0, 8))]
        col = F.array(*map(F.lit, parts)) if parts else F.array().cast("array<string>")
        assert one(spark, chunking.merge_small(col, 5)) == merged(parts, 5)


def test_index_chunks_mix_sections_and_windows(spark):
    text = "# A\n" + "x " * 300 + "\n# B\n" + "y " * 1200
    got = index.chunk_table(spark.createDataFrame([("p.md", text)], "path string, content string")).orderBy("chunk_index").collect()
    assert [(r["start_word"], r["end_word"]) for r in got] == [(0, 302), (302, 802), (702, 1202), (1102, 1504)]
    assert got[0]["text"].startswith("# A\nx") and got[0]["key"] == "chunk:p.md:0"


def test_sentence_chunks_drop_or_keep():
    words = [f"w{i}" for i in range(30)]
    words[12] = "end."
    text = " ".join(words)
    assert chunking.sentence_chunks(text, 10)[0].split() == words[:10]
    assert chunking.sentence_chunks(text, 10)[1].split()[0] == "w13"
    kept = chunking.sentence_chunks(text, 10, lossless=True)
    assert " ".join(kept) == text
    assert chunking.sentence_chunks(None) == [] and chunking.sentence_chunks("a b", 10) == ["a b"]


def test_chapters_keep_what_comes_first(spark):
    c = one(spark, parsing.h1_chapters(F.lit("﻿intro\n#  One \ntext\n# Two")))
    assert [(x["title"], x["markdown"]) for x in c] == [("Chapter", "intro"), ("One", "text"), ("Two", "")]
    assert [(x["title"], x["markdown"]) for x in one(spark, parsing.h1_chapters(F.lit("")))] == [("Book", "")]


def test_links_and_sections(spark):
    assert one(spark, parsing.list_links(F.array(F.lit("- [[A#x|y]] [t](b.md)"), F.lit("[[no]]"), F.lit("2. [[C]]")))) == ["A", "b.md", "C"]
    assert one(spark, parsing.toc_block(F.lit("x"))) is None
    s = one(spark, parsing.entity_sections(F.lit("pre\n## Ann\n### Jan Update\nhit\n## Bob\n\n## Cy\nok\n### Feb Update\nmore")))
    assert [(x["entity"], x["update"]) for x in s] == [("Ann", "hit"), ("Cy", "ok\nmore")]
    assert one(spark, parsing.capitalized_names(F.lit("Ann Lee met Bob. Ann Lee left. A B"))) == ["Ann Lee", "Bob"]


def test_roster(spark):
    r = spark.createDataFrame([(1, "- Ann | aliases: A, B\n2) ann | ALIASES: B, C\n\n* Bob")], "k int, content string")
    got = parsing.parse_roster(r, "k").orderBy("ord").collect()
    assert [(x["name"], x["aliases"]) for x in got] == [("Ann", ["A", "B", "C"]), ("Bob", [])]


def files(spark):
    rows = [("Folder/a.md", "a", "md"), ("Folder2/b.md", "b", "md"), ("Folder/sub/c.md", "c", "md"), ("d.md", "d", "md"), (".config/e.md", "e", "md")]
    return spark.createDataFrame(rows, "path string, content string, ext string")


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_path_filter(spark):
    f = files(spark)
    assert paths(vault.path_filter(f, include=["Folder/"])) == ["Folder/a.md", "Folder/sub/c.md"]
    assert paths(vault.path_filter(f, exclude=["Folder"])) == ["Folder2/b.md", "d.md"]
    assert paths(vault.path_filter(f, active="d.md")) == ["d.md"]
    inc = spark.createDataFrame([("Folder",), ("d.md",)], "path string")
    exc = spark.createDataFrame([("Folder/sub",)], "path string")
    assert paths(vault.filter_by_lists(f, inc, exc)) == ["Folder/a.md", "d.md"]


def test_tree(spark):
    f = files(spark)
    assert paths(vault.folders(f)) == [".config", "Folder", "Folder/sub", "Folder2"]
    assert {r["parent"]: r["n_children"] for r in vault.children(vault.tree(f)).collect()}["Folder"] == 2


def plain_mmr(score, tokens, vectors, limit, lam=0.72, stop=0.95):
    def sim(a, b):
        if vectors[a] is not None and vectors[b] is not None:
            return max(0.0, min(1.0, (float(np.dot(vectors[a], vectors[b])) + 1) / 2))
        union = len(tokens[a] | tokens[b])
        return len(tokens[a] & tokens[b]) / union if union else 0.0

    if len(score) <= limit:
        return list(range(len(score)))
    out = []
    while len(out) < limit:
        best, top = None, -1e9
        for c in range(len(score)):
            if c in out:
                continue
            red = 0.0
            for s in out:
                red = max(red, sim(c, s))
                if red >= stop:
                    break
            v = lam * score[c] - (1 - lam) * red
            if v > top:
                best, top = c, v
        out.append(best)
    return out


def test_mmr_against_plain_loop():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 25)
        score = np.array(sorted((rng.choice([0.2, 0.5, rng.random()]) for _ in range(n)), reverse=True))
        tokens = [{rng.choice("abcdef") for _ in range(rng.randint(0, 5))} for _ in range(n)]
        vectors = [None if rng.random() < 0.4 else np.eye(4)[rng.randrange(4)] for _ in range(n)]
        limit = rng.randint(1, 10)
        assert retrieval.mmr_order(score, tokens, vectors, limit) == plain_mmr(score, tokens, vectors, limit)


HIT = "query_id int, provider string, key string, path string, title string, excerpt string, score double, reason_tags array<string>"


def hits(spark, rows):
    return spark.createDataFrame([(1, p, k, f"{k}.md", k, "text", s, [p]) for p, k, s in rows], HIT)


def test_rrf_adds_and_unites(spark):
    a = hits(spark, [("x", "k1", 0.9), ("x", "k2", 0.5)]).withColumn("provider_ord", F.lit(0))
    b = hits(spark, [("y", "k2", 0.7), ("y", "k3", 0.6)]).withColumn("provider_ord", F.lit(1))
    got = {r["key"]: r for r in retrieval.rrf(a.unionByName(b)).collect()}
    assert got["k2"]["rank"] == 1 and got["k2"]["score"] == 1.0 and got["k2"]["best_score"] == 0.7
    assert got["k2"]["reason_tags"] == ["x", "y", "fused"]
    assert abs(got["k1"]["score"] - (1 / 61) / (1 / 62 + 1 / 61)) < 1e-12


def test_hybrid_of_one_batch_sorts_only(spark):
    got = retrieval.hybrid([hits(spark, [("x", "b", 0.5), ("x", "a", 0.5), ("x", "c", 0.9)])], 2).orderBy("rank").collect()
    assert [r["key"] for r in got] == ["c", "a"] and got[0]["provider"] == "x"


def test_heuristic_bonuses(spark):
    f = spark.createDataFrame([("d/x.md", "x", "cat cat"), ("d/y.md", "y", "cat"), ("e/z.md", "z", "dog")], "path string, basename string, content string").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    q = spark.createDataFrame([(1, "cat", "d/y.md")], "query_id int, text string, active_path string")
    got = {r["path"]: r["score"] for r in retrieval.heuristic_search(f, q, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert set(got) == {"d/x.md", "d/y.md"}
    assert abs(got["d/x.md"] - ((0.5 + 0.15) / 6 + 0.7 * 2 / 24)) < 1e-12
    assert abs(got["d/y.md"] - ((0.5 + 0.75 + 0.15) / 6 + 0.7 / 24)) < 1e-12


def test_rerank_keeps_old_score_where_the_model_fails(spark):
    q = spark.createDataFrame([(1, "text")], "query_id int, text string")
    h = hits(spark, [("x", "a", 0.2), ("x", "b", 0.4)])
    got = retrieval.rerank(h, q, 2, score=lambda a, b: F.when(F.col("key") == "a", 0.9)).orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in got] == [("a", 0.9), ("b", 0.4)] and got[0]["provider"] == "rerank"


def test_resolve_names(spark):
    known = spark.createDataFrame([("Anna Smith",), ("Ann Smith",), ("Bob",)], "name string")
    asked = spark.createDataFrame([("anna-smith",), ("Anna Smyth",), ("Zed",), ("",)], "name string")
    got = {r["name"]: r for r in retrieval.resolve_names(asked, known).collect()}
    assert got["anna-smith"]["resolved"] == "Anna Smith"
    assert got["Anna Smyth"]["resolved"] is None and got["Anna Smyth"]["candidates"] == ["Anna Smith", "Ann Smith"]
    assert got["Zed"]["candidates"] == [] and got[""]["candidates"] == []


def test_prefix_words(spark):
    c = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "d  e"), (1, 2, "f")], "book int, ord int, markdown string")
    assert [r["markdown"] for r in context.prefix_words(c, 4).orderBy("ord").collect()] == ["a b c", "d"]


def test_reindex_gives_the_clean_build(spark):
    old = spark.createDataFrame([("a", "one two"), ("b", "three")], "path string, content string")
    new = spark.createDataFrame([("a", "one"), ("b", "three"), ("c", "four")], "path string, content string")
    state = incremental.with_hash(old).select("path", "hash")
    made, after = incremental.reindex(index.chunk_table(old), state, new, index.chunk_table)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, index.chunk_table(new).collect()))
    assert incremental.changed(incremental.with_hash(new), after).count() == 0


def test_chunk_file_plan(spark):
    chunks = spark.createDataFrame([("x", 0), ("x", 1)], "base string, chunk_index int")
    there = spark.createDataFrame([("x-Chunked/x-CHUNK-001.md",), ("x-Chunked/x-CHUNK-003.md",), ("x-Chunked/own.md",)], "path string")
    plan = lambda o: {r["path"][-6:-3]: r["action"] for r in sinks.chunk_file_plan(chunks, there, o).collect()}
    assert plan(True) == {"001": "overwritten", "002": "created", "003": "deleted"}
    assert plan(False) == {"001": "skipped", "002": "created"}


def test_index_is_rebuilt_after_a_change_of_settings(spark, tmp_path):
    chunks = index.chunk_table(files(spark))
    sinks.save_index(chunks, f"file://{tmp_path}/i", 1, target=500)
    assert sinks.load_index(spark, f"file://{tmp_path}/i", 1, target=500).count() == chunks.count()
    assert sinks.load_index(spark, f"file://{tmp_path}/i", 1, target=400) is None
    assert sinks.load_index(spark, f"file://{tmp_path}/none", 1) is None


def test_stream_keeps_the_index_current(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    schema = "path string, content string, mtime long"
    feed = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        q = incremental.stream_index(spark.readStream.schema(schema).parquet(src), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", index.chunk_table)
        q.awaitTermination(120)
        v = incremental.latest_version(spark, f"file://{tmp_path}/out")
        return {r["path"]: r["text"] for r in spark.read.parquet(f"file://{tmp_path}/out/v{v}/index").collect()}

    feed([("a", "one", 1), ("b", "two", 1)])
    assert run() == {"a": "one", "b": "two"}
    feed([("a", "old", 2), ("a", "new", 3)])
    assert run() == {"a": "new", "b": "two"}


def test_markdown_folder(spark, tmp_path):
    from loomtext.sources import tables

    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a.md").write_text("# A\nx")
    (tmp_path / "b.txt").write_text("no")
    got = tables.markdown_folder(spark, str(tmp_path)).select("path", "basename", "content").collect()
    assert [tuple(r) for r in got] == [("sub dir/a.md", "a", "# A\nx")]


def test_settings_overlay():
    c = RetrievalConfig().with_stored({"target_words": 300, "unknown": 1})
    assert c.target_words == 300 and c.overlap_words == 100


def test_updates_of_one_name_go_to_one_note(spark):
    notes = spark.createDataFrame([("Ann", "old"), ("Bob", "")], "name string, content string")
    updates = spark.createDataFrame([("Ann", "b", 2), ("Ann", "a", 3), ("Cid", "c", 1), ("Bob", None, 1)], "name string, update string, ord int")
    got = dict(map(tuple, sinks.apply_updates(notes, updates, F.lit("S")).collect()))
    part = lambda x: f"\n\n## S - Update\n\n{x}\n"
    assert got == {"Ann": "old" + part("b") + part("a"), "Bob": "", "Cid": "# Cid" + part("c")}


def test_text_files_of_like_paths_stay_apart(spark, tmp_path):
    rows = [("a/b", "1"), ("a_b", "2"), ("a=b", "3")]
    sinks.write_text_files(spark.createDataFrame(rows, "path string, content string"), f"file://{tmp_path}/out")
    assert sorted(map(tuple, spark.read.text(f"file://{tmp_path}/out").select("path", "value").collect())) == sorted(rows)


def test_postings_of_a_term_do_not_meet_in_one_task(spark):
    chunks = spark.createDataFrame([(f"k{i}", f"p{i}", "common word" if i % 2 else "common other") for i in range(20)], "key string, path string, text string")
    asked = spark.createDataFrame([(1, "common"), (2, "other common")], "query_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = retrieval.bm25_scores(chunks, asked)
        assert out.count() == 40
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_embedding_makes_no_object_of_each_token(spark):
    import zlib

    import pyarrow as pa

    from loomtext.operators import embed

    rows = [["abc", "def", "abc"], [], ["ghi"] * 300] * 400
    got = embed._hashed.func(pa.array(rows, pa.list_(pa.string()))).to_pylist()
    for row, v in zip(rows[:3], got, strict=False):
        want = np.zeros(256, np.float32)
        for t in row:
            want[zlib.crc32(t.encode()) % 256] += 1
        n = np.linalg.norm(want)
        assert v == (want / n if n else want).tolist()
    assert len(got) == len(rows) and got[:3] == got[-3:]
    texts = spark.createDataFrame([(1, "abc def abc"), (2, ""), (3, None)], "id long, text string")
    vectors = {r["id"]: r["v"] for r in texts.select("id", embed.hashed_bag_of_words(F.col("text")).alias("v")).collect()}
    assert vectors[1] == got[0] and vectors[2] == vectors[3] == got[1]
