"""Near duplicates, lines, leaks, mixing, search, formatting: against brute force, on odd texts and empty tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import Sets, corpus, frame, rows_of, words
from pyspark.sql import functions as F

from loomtext.llm import _blocks, _spark, chat_format, collision_search, decontaminate, line_dedup, mixing, ngram_join


@pytest.fixture(scope="module")
def rows():
    return corpus()


def plain_components(rows, k, percent):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    u = Sets()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                u.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[u.find(i)] = min(least.get(u.find(i), 1 << 60), r[0])
    return sorted(((r[0], len(s), least.get(u.find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr), u, sets


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (2, 50)])
def test_ngram_components(spark, rows, k, percent):
    want, _, _ = plain_components(rows, k, percent)
    assert rows_of(ngram_join.components(frame(spark, rows), k, percent), "doc_id", "n_shingles", "component_id") == want


def test_ngram_components_with_split_keys_and_trees(spark, monkeypatch):
    monkeypatch.setattr(_blocks, "PART", 20)
    monkeypatch.setattr(_blocks, "SAMPLE", 2)
    rng = random.Random(8)
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
            w[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "", "", 0))
    want, _, _ = plain_components(rows, 3, 80)
    assert rows_of(ngram_join.components(frame(spark, rows), 3, 80), "doc_id", "n_shingles", "component_id") == want


def test_one_per_component(spark, rows):
    _, u, sets = plain_components(rows, 5, 80)
    first = {}
    for i, r in enumerate(rows):
        key = ("empty", i) if not sets[i] else u.find(i)
        first.setdefault(key, []).append(r[0])
    want = sorted((min(v, key=lambda x: (x is not None, x or 0)) for v in first.values()), key=repr)
    df = frame(spark, rows)
    got = ngram_join.one_per_component(df)
    assert got.columns == df.columns and sorted((r["doc_id"] for r in got.collect()), key=repr) == want
    assert ngram_join.one_per_component(frame(spark, [])).count() == 0


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 80).astype(np.uint64)
    sets = []
    for _ in range(150):
        s = base.copy()
        s[rng.integers(0, 80, rng.integers(0, 14))] = rng.integers(0, 2**63)
        sets.append(np.unique(s[: rng.integers(60, 81)]))
    th = ngram_join.Threshold(80)
    size = np.array([len(s) for s in sets])
    found = {tuple(sorted(p)) for i, j in ngram_join.tree_pairs(size, [ngram_join.signature(s) for s in sets], th) for p in zip(i.tolist(), j.tolist())}
    for i in range(150):
        for j in range(i):
            linked = 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
            assert linked == ngram_join.linked(sets[i], sets[j], th)
            assert not linked or (j, i) in found


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    u = Sets()
    for a, b in edges:
        u.join(a, b)
    got = dict(map(tuple, _spark.components(_spark.Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: u.find(x) for e in edges for x in e if e[0] != e[1]} or all(u.find(k) == v for k, v in got.items())
    assert all(x in got for a, b in edges if a != b for x in (a, b))
    assert _spark.components(_spark.Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(rows):
    """Texts by row number after line dedup by edit distance alone, all pairs compared."""
    import duckdb

    between = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    norm = lambda s: between.sub(" ", s.lower()).strip()
    forms = sorted({norm(x) for r in rows for x in (r[1] or "").split("\n")} - {""})
    # DuckDB's distance is of bytes: other characters than ASCII ones get a letter each.
    short = str.maketrans({c: chr(65 + k) for k, c in enumerate(sorted({c for x in forms for c in x if ord(c) > 127}))})
    every, back = pa.table({"x": [x.translate(short) for x in forms]}), {x.translate(short): x for x in forms}
    alike = duckdb.sql(
        """SELECT a.x, b.x FROM every a JOIN every b ON a.x < b.x AND length(b.x) BETWEEN length(a.x) * 0.79 AND length(a.x) * 1.26
        WHERE levenshtein(a.x, b.x) <= floor(0.2 * greatest(length(a.x), length(b.x)) + 1e-9)"""
    ).fetchall()
    u = Sets()
    for a, b in alike:
        u.join(back[a], back[b])
    taken, out = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        kept = []
        for x in (rows[i][1] or "").split("\n"):
            n = norm(x)
            if not n or u.find(n) not in taken:
                kept.append(x)
            if n:
                taken.add(u.find(n))
        out[i] = None if rows[i][1] is None else "\n".join(kept)
    return out


def test_lines(spark, rows):
    want = plain_lines(rows)
    df = frame(spark, rows)
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(((r[0], want[i]) for i, r in enumerate(rows)), key=repr)
    assert all(r["n_lines"] == (len(t.split("\n")) if (t := dict((x[0], x[1]) for x in rows)[r["doc_id"]]) else 0) for r in got.collect())
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_lines_with_split_keys(spark, monkeypatch):
    monkeypatch.setattr(_blocks, "PART", 10)
    monkeypatch.setattr(_blocks, "SAMPLE", 2)
    rng = random.Random(4)
    base = " ".join(f"word{rng.randrange(99)}" for _ in range(40))
    rows = [(i, base.replace(" ", " x", 1 + i % 3).replace("word1", f"w{i % 50}", 1), "", "", 0) for i in range(120)]
    want = plain_lines(rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {r[0]: want[i] for i, r in enumerate(rows)}


def test_edit_similarity():
    rng = random.Random(6)
    for _ in range(1500):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 24)))
        b = a[:7] + a[9:] if rng.random() < 0.6 else "".join(rng.choice("abc ") for _ in range(rng.randint(0, 24)))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(d[j + 1] + 1, e[j] + 1, d[j] + (x != y)))
            d = e
        assert line_dedup.distances([(a, b), (b, a), (a, a)]).tolist() == [d[-1], d[-1], 0]
        assert line_dedup.similar(a, b) == (d[-1] <= int(0.2 * max(len(a), len(b)) + 1e-9))


def leak_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 14, 20, 25, 4, 8))] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(80)]
        truth = None
        if i % 3 == 0:
            k = rng.randrange(6)
            own = items[k][1].split()
            if i % 2 and k < 4:
                for p in rng.sample(range(len(own)), len(own) // 10):
                    own[p] = word()
            w[10:10] = [x.upper() + "," for x in own]
            truth = k
        docs.append((i, " ".join(w), truth))
    return items, docs


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST, 0])
def test_leaks_are_found(spark, most):
    items, docs = leak_rows()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    df = frame(spark, [*[(i, t, "", "", 0) for i, t, _ in docs], (500, None, "", "", 0), (501, "", "", "", 0), (502, items[0][1], "", "", 0), (502, items[0][1], "", "", 0)])
    got = decontaminate.leaks(df, bench, max_broadcast=most).collect()
    want = sorted([(i, k) for i, _, k in docs if k is not None] + [(502, 0), (502, 0)])
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want
    assert all(r["start_word"] == 10 for r in got if r["doc_id"] < 500)
    assert decontaminate.leaks(frame(spark, []), bench, max_broadcast=most).count() == 0
    kept = decontaminate.without_leaks(df, bench, max_broadcast=most)
    assert kept.columns == df.columns and kept.count() == df.count() - len({(w, n) for n, w in enumerate(want)})
    assert decontaminate.without_leaks(df, bench.limit(0), max_broadcast=most).count() == df.count()


def test_mix_meets_its_targets(spark, rows):
    df = frame(spark, rows)
    got = mixing.mix(df, block=16).collect()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    total = sum(size.values())
    goal = {r["source"]: r["target"] for r in got}
    assert sum(goal.values()) == pytest.approx(total)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    free = [s for s in order if goal[s] < 3 * size[s] - 1e-9]
    assert len({round(goal[s] / weight[s], 6) for s in free}) == 1 and all(goal[s] <= 3 * size[s] for s in order)
    for s in order:
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - goal[s]) <= 16
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((r[0], len(words(r[1]))) for r in rows if r[0] is not None)
    assert all(r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix(df, block=16)
    assert rows_of(again, "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in got), key=repr)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mixed_documents(df, block=16).where("mix_taken = 0").count() == 0


def test_targets_are_reshared():
    assert mixing.targets([10, 10, 100], [1, 2, 3]) == [22.5, 30.0, 67.5]
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [1, 2]) == [0.0, 5.0]


def vectors():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((600, 8)).astype(np.float32)
    v[100:300] = v[5]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(600, None), (700, []), (800, [0.0] * 8), (900, [float("nan")] + [1.0] * 7), (1000, [None] + [1.0] * 7), (1100, [float("inf")] * 8), (1200, [1.0, 2.0]), (1300, [1.0, 2.5]), (None, [1.0] * 8), rows[7]]
    return rows


def test_search_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))
    got = {}
    for r in collision_search.search(df, F.col("vec_id") % 100 == 0, chunk_rows=128).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    able = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    hit = total = 0
    for q, v in {i: v for i, v in able if i % 100 == 0}.items():
        want = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in able if i != q and len(x) == len(v))[:10]
        own = got[q]
        assert own == sorted(own) and len(own) == len(want)
        hit += sum(a <= want[-1][0] + 1e-9 for a, _ in own)
        total += len(want)
        if v.tolist() == rows[5][1]:
            assert own == want
    assert hit / total > 0.9
    assert set(got) == {i for i, _ in able if i % 100 == 0}
    assert collision_search.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("n", [2000, 16_384])
def test_search_verifies_few_rows(n):
    """On unit vectors without any structure, the hardest: recall of 0.9 with under a fifth of the rows verified."""
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    index = collision_search.Index(np.arange(n), v)
    hit = seen = 0
    for q in range(0, 1000, 50):
        ids, _, verified = index.nearest(q, v[q], 10)
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(ids.tolist()) & set(np.argsort(d)[:10].tolist()))
        seen += verified
    assert hit >= 0.9 * 200 and seen < 0.2 * 20 * n, (hit / 200, seen / 20 / n)


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "system", "be <|turn|> good\\"), (1, 1, "user", "a"), (1, 2, "user", "<|next|>b\\l"), (1, 3, "assistant", said), (1, 4, "assistant", ""), (1, 5, "assistant", "<<SYS>>x<|end|>"), (2, 0, None, None), (2, 0, None, None), (3, 1, "as\nsist<|", "x\ny"), (3, 0, "assistant", "<"), (None, 0, "user", "😀"), (4, None, "user", "b"), (4, None, "user", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("e", F.lit(1)).withColumn("id", F.lit(2)).repartition(3)
    out = chat_format.format_conversations(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    made = {r["conv_id"]: r for r in out.collect()}
    digest = {r["conv_id"]: r for r in chat_format.digests(out).collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == c))
        f = made[c]["formatted"]
        spans = [f[s["start"] : s["start"] + s["length"]] for s in made[c]["loss_spans"]]
        loss = [x for _, _, r, x in own if r == "assistant"]
        plain = lambda x: "\\".join(p.replace("\\l", "<").replace("\\b", "[").replace("\\n", "\n") for p in x.split("\\\\"))
        assert [plain(s) for s in spans] == loss
        assert digest[c]["n_turns"] == len(own) and digest[c]["formatted_chars"] == len(f)
        assert digest[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        assert digest[c]["loss_sha256"] == hashlib.sha256("".join(loss).encode()).hexdigest() and digest[c]["loss_chars"] == len("".join(loss))
        assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", f)
    assert made[1]["formatted"].count("<|turn|>") == 3
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_columns_with_the_names_used_inside(spark, rows):
    """Columns named as the operators name theirs pass through; new columns have underscores then."""
    names = ["row", "_row", "__row", "lines", "_lines", "n_lines", "n_removed", "leaked", "_leaked", "mix_size", "mix_taken", "stays", "group"]
    df = frame(spark, rows, clash=False).withColumns({n: F.lit(n) for n in names})
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    same = lambda out: all(out.select(*names).distinct().collect() == [tuple(names)] for _ in (0,))
    lines = line_dedup.dedup_lines(df)
    assert lines.columns == [*df.columns, "_n_lines", "_n_removed"] and lines.count() == df.count() and same(lines)
    kept = ngram_join.one_per_component(df)
    assert kept.columns == df.columns and same(kept)
    clean = decontaminate.without_leaks(df, bench)
    assert clean.columns == df.columns and same(clean)
    mixed = mixing.mixed_documents(df, block=16)
    assert mixed.columns == [*df.columns, "_mix_size", "mix_target", "_mix_taken"] and same(mixed)


def test_least_ids_with_nulls(spark):
    """A null id counts as greater than any other in a component's name, and comes first in what stays."""
    text = "a b c d e f g h"
    df = frame(spark, [(None, text, "", "", 0), (7, text, "", "", 0), (5, text + " i", "", "", 0), (None, "x y z", "", "", 0)], clash=False)
    got = rows_of(ngram_join.components(df, 3, 80), "doc_id", "component_id")
    assert got == sorted([(None, 5), (7, 5), (5, 5), (None, None)], key=repr)
    assert sorted((r["doc_id"] is None, r["text"]) for r in ngram_join.one_per_component(df, 3, 80).collect()) == [(True, text), (True, "x y z")]
