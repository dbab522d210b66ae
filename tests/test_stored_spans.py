"""The stored index is made and searched by spans of chunks: no shuffle by term and chunk or by query and chunk."""

import random
import re

import pytest

from loomtext.operators import index, retrieval, stored


def hits(df):
    return sorted((r["query_id"], r["rank"], r["key"], round(r["score"], 7)) for r in df.collect())


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_scores_are_summed_by_span(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(stored, "SPAN", 8)
    monkeypatch.setattr(stored, "FEW", few)
    monkeypatch.setattr(stored, "AT_ONCE", 5)
    rng = random.Random(3)
    notes = [(f"n/{i}.md", " ".join(f"word{rng.randrange(40)}" for _ in range(rng.choice([3, 20])))) for i in range(60)]
    at = f"file://{tmp_path}/chunks"
    index.chunk_table(spark.createDataFrame(notes, "path string, content string")).write.parquet(at)
    chunks = spark.read.parquet(at)
    queries = spark.createDataFrame([(7, "word1 word2 word3"), (None, "word4"), (9, "none")], "query_id long, text string")
    made = stored.save(chunks, f"file://{tmp_path}/i", parts=2)
    found = made.search(queries.where("query_id is not null"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(span" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, (doc|h|span|_groupingexpression)", plan)
    assert hits(found) == hits(retrieval.bm25_search(chunks, queries.where("query_id is not null"), 5))
    assert made.blocks.groupBy("term", "span").count().where("count > 1").count() == 0
