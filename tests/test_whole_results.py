"""Queries whose whole results are held against plain Python and the SQL."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomtext.operators import parsing, vault
from loomtext.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def table(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'")


def by_sql(name, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c.execute(SQL[name]).fetchall()


def names(text):
    found = re.findall(r"(?a:\b)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?a:\b)", text)
    return {x for x in found if len(x.split(" ")) <= 3}


def test_names_next_to_other_letters(spark):
    text = "éAnn met Boé, Cy\u00a0Dee and über Eve"
    assert spark.range(1).select(parsing.capitalized_names(F.lit(text))).first()[0] == ["Ann", "Bo", "Cy\u00a0Dee", "Eve"]


@needs_data
def test_names_of_all_rows(spark):
    rows = table("benchmark").select("item_id, text").fetchall()
    got = [tuple(r) for r in QUERIES["capitalized_names"](spark, DATA).select("item_id", "name").collect()]
    assert sorted(got) == sorted((i, x) for i, t in rows for x in names(t))
    assert any(not t.isascii() and names(t) for _, t in rows)
    assert sorted(got) == sorted(by_sql("capitalized_names", "benchmark"))


@needs_data
def test_order_of_all_files(spark):
    rows = table("documents").select("doc_id, source, lang, n_chars").fetchall()
    order = sorted((-(1704067200000 + i * 3600000 + n), f"{s}/{g}/{i}.md") for i, s, g, n in rows)
    got = [tuple(r) for r in QUERIES["file_recency_size_order"](spark, DATA).select("path", "position").collect()]
    assert len(rows) > 100 and sorted(got, key=lambda r: r[1]) == [(p, k + 1) for k, (_, p) in enumerate(order)]
    assert sorted(got) == sorted(by_sql("file_recency_size_order", "documents"))


def test_order_with_ties_nulls_and_no_files(spark):
    row = "SELECT timestamp_millis(CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN 5 ELSE id END) AS mtime, 3L AS size, concat('é', id % 50) AS path FROM range({})"
    files = spark.sql(row.format(300))
    got = vault.picker_positions(files).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 301))
    assert [r["path"] for r in got] == [r["path"] for r in vault.picker_order(files).collect()]
    assert vault.picker_positions(spark.sql(row.format(0))).count() == 0
