"""The pipeline on a small fixture against plain Python stages, and the registry."""

import os
import random

import pytest
from helpers import frame, words
from test_groups import plain_components, plain_lines

DATA = "/root/testdata/sf0.001"


def tables(spark, folder):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 7)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(4)]
    docs, labels = [], []
    for i in range(240):
        text = "\n".join(" ".join(word() for _ in range(rng.randint(5, 20))) for _ in range(rng.randint(2, 4)))
        bad = i % 5 == 0
        if bad:
            text = text.replace(" ", " idiot ", 1)
        if i % 7 == 1 and i > 20:
            w = docs[i - 7][1].split(" ")
            w[rng.randrange(len(w))] = word()
            text = " ".join(w)
            bad = labels[i - 7][2]
        if i % 11 == 3:
            text += "\n" + items[i % 4][1]
        docs.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, 1, int("idiot" in text)))
    docs += [(500, None, None, None, 0), (501, "", "en", "s1", 0)]
    frame(spark, docs, clash=False).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    docs, items = tables(spark, folder)
    rows = [d for d in docs if "idiot" not in (d[1] or "")]
    kept = plain_lines(rows)
    rows = [(r[0], kept[i], *r[2:]) for i, r in enumerate(rows)]
    _, u, sets = plain_components(rows, 5, 80)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(u.find(i) if sets[i] else ("empty", i), r)
    rows = [r for r in first.values() if not any(t in (r[1] or "").replace("\n", " ") for _, t in items)]
    out = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, out, folder)
        assert got.columns == out.columns, name
        path = f"{folder}/{name.replace(' ', '_')}"
        got.write.parquet(path)
        out = spark.read.parquet(path)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted((r[0], r[1]) for r in rows)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    mixed = corpus_pipeline.run(spark, folder).collect()
    total = sum(len(words(r[1])) for r in rows)
    assert {r["doc_id"] for r in mixed} <= {r[0] for r in rows}
    assert abs(sum(r["mix_taken"] for r in mixed) - total) <= 64 * 5


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_sql(spark):
    import duckdb

    from loomtext.llm import queries

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, DATA).toPandas(), c.execute(sql).df()
        key = list(want.columns)[0]
        assert got[want.columns].sort_values(key).reset_index(drop=True).astype(str).equals(want.sort_values(key).reset_index(drop=True).astype(str)), name
