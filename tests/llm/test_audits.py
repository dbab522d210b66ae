"""Piece ids, source divergence and filter audit: against plain Python, on odd texts, null columns and empty tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from helpers import corpus, frame, rows_of, words
from pyspark.sql import functions as F

from loomtext.llm import _spark, divergence, filter_audit, piece_codec

LETTERS = "ABCDE"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


ODD = ["  lead", "trail  ", "a\n\nb", "\n", " ", "▁", "▁▁ a▁ b ▁c", "<s>x</s><0x0A>", "日本語 テキスト", "😀 🏳️‍🌈 é", "a\tb\r\nc", "x" * 5000 + " y", " nbsp and　wide", "﻿bom", "a\x00b", "▁mark▁ ▁"]


def test_ids_and_texts_are_the_librarys(spark, rows, model, library):
    rows = rows + [(900 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_eos=True)
        want.append((r[0], tuple(ids), library.decode(ids)))
    got = piece_codec.decode(piece_codec.encode(frame(spark, rows), model), model).collect()
    assert sorted(((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got), key=repr) == sorted(want, key=repr)
    digests = rows_of(piece_codec.encode_and_decode(frame(spark, rows), model), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == sorted(((i, len(ids), sha(" ".join(map(str, ids))), sha(t)) for i, ids, t in want), key=repr)


def test_ids_without_a_head_and_a_head_of_some(spark, rows, model, library, monkeypatch):
    want = sorted(((r[0], library.encode(r[1] or "")) for r in rows), key=repr)
    for keys, width in ((0, 1), (40, 2)):
        monkeypatch.setattr(piece_codec, "_width", lambda model, width=width: width)
        monkeypatch.setattr(piece_codec, "HEAD_KEYS", keys)
        monkeypatch.setattr(piece_codec, "AT_ONCE", 1)
        assert rows_of(piece_codec.encode(frame(spark, rows), model, end=False), "doc_id", "ids") == want


def test_empty_tables(spark, model):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert piece_codec.encode_and_decode(none, model).count() == 0
    assert divergence.divergence(none, width=1 << 16).count() == 0
    assert filter_audit.audit(none, labels).count() == 0


def test_a_very_long_text(spark, model, library):
    text = " ".join(f"w{i % 977} ünïcode" for i in range(60_000)) + "\n" + "z" * 20_000
    got = piece_codec.encode(frame(spark, [(1, text, "en", "s", 1), (2, "b", "en", "s", 1)]), model).orderBy("doc_id").collect()
    assert got[0]["ids"] == library.encode(text, add_eos=True) and got[1]["ids"] == library.encode("b", add_eos=True)
    masks = filter_audit.failures(frame(spark, [(1, text, "en", "s", 1)]), _spark.Scratch(spark)).collect()
    assert [r["mask"] for r in masks] == [2]
    long = [(i, text, "en", f"s{i % 2}", 1) for i in range(10)]
    got = divergence.divergence(frame(spark, long), width=1 << 16)
    assert rows_of(got, *got.columns) == audited(long, 10)


def terms(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [x.decode() for x in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", raw)]


def audited(rows, min_df, top=10):
    df, own, by = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        found = Counter(terms(text))
        df[lang].update(found.keys())
        own[lang, source] += found
        by[lang].add(source)
    out = []
    for lang, sources in by.items():
        kept = [t for t, n in df[lang].items() if n >= min_df]
        count = {s: {t: own[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        rate = lambda c: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}
        p, q = {s: rate(count[s]) for s in sources}, rate(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            own_terms = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own_terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_df", [1, 4, 10])
def test_divergence(spark, rows, min_df):
    rows = rows + [(700 + i, t, "de", s, 1) for i, (t, s) in enumerate([("nur eins", "a"), (None, "b"), ("...", None), ("EINS Zwei zwei ß", "a"), ("É é Zwei", "c")])]
    got = divergence.divergence(frame(spark, rows), min_df=min_df, width=1 << 16)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got, *got.columns) == audited(rows, min_df)


def test_the_sketch_never_underestimates(spark, rows):
    import numpy as np

    docs = frame(spark, rows).select("text", F.coalesce("lang", F.lit("")).alias("lang"))
    sketch = divergence.frequency_sketch(docs, 1 << 16)
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    data, s, e, doc = divergence._words(batch)
    keys = divergence._keys(data, s, e, doc, batch.column("lang"))
    df = Counter(k for k, _ in set(zip(keys.tolist(), doc.tolist())))
    at = np.array(list(df), np.uint64)
    least = np.min([sketch[r][divergence._places(at, r, 1 << 16)] for r in range(len(sketch))], axis=0)
    assert (least >= np.minimum(list(df.values()), 255)).all() and (least == np.minimum(list(df.values()), 255)).mean() > 0.9
    few = np.array([k for k, n in df.items() if n == 1], np.uint64)
    assert divergence.possible(sketch, at, 1).all() and divergence.possible(sketch, few, 2).mean() < 0.1


def test_divergence_whatever_the_width(spark, rows):
    want = rows_of(divergence.divergence(frame(spark, rows), min_df=3, width=1 << 18), "lang", "source", "part", "item", "value", "rank")
    assert rows_of(divergence.divergence(frame(spark, rows), min_df=3, width=16), "lang", "source", "part", "item", "value", "rank") == want


def chain(rows, labels):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = defaultdict(list)
    for i, text, lang, *_ in rows:
        text = text or ""
        w = words(text, lower=False)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and i > first[text]]
        docs[lang or ""].append(({c for c, f in zip(LETTERS, fails) if f}, i in good, i in toxic))
    out, removed = [], Counter()
    for part, held in docs.items():
        for order in map("".join, permutations(LETTERS)):
            left = held
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                failing = sum(letter in d[0] for d in held)
                removed[part, letter] += len(gone)
                out.append([part, order, step, len(left), len(gone), failing - len(gone), sum(d[0] == {letter} for d in held), sum(d[1] for d in gone), sum(d[2] for d in gone)])
    return sorted((tuple([*r, removed[r[0], r[1][r[2] - 1]]]) for r in out), key=repr)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit(spark, rows):
    rows = [(r[0], (r[1] or "") * (1 + k % 5) + ("#" if k % 7 == 0 else "") if k % 3 else r[1], r[2] if k % 4 else "de", r[3], r[4]) for k, r in enumerate(rows)]
    rows += rows[:9] + [(None, rows[3][1], "de", "s", 1), (1000, rows[3][1], None, "s", 1), (1001, None, "", "s", 1)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1)]
    got = filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rows_of(got, *COLUMNS) == chain(rows, labels)


def test_filter_audit_of_some_filters(spark, rows):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, nice int")
    got = filter_audit.audit(frame(spark, rows), labels, {"X": filter_audit.short, "Y": filter_audit.symbols}, None, {"nice": "nice"}, part_col="source").collect()
    parts = {r[3] or "" for r in rows}
    assert len(got) == len(parts) * 4 and {r["filter_order"] for r in got} == {"XY", "YX"}
    for part in parts:
        mine = [r for r in got if r["part"] == part and r["filter_order"] == "XY"]
        assert sum(r["removed"] for r in mine) + min(r["kept"] for r in mine) == sum((r[3] or "") == part for r in rows)


def test_parity_sums_invert_exactly(spark):
    masks = [(p, m, ["all"]) for p in "ab" for m in range(8) for _ in range(m * (2 if p == "a" else 1))]
    sums = filter_audit.parity_sums(spark.createDataFrame(masks, "part string, mask int, labels array<string>"), 3)
    got = {r["part"]: r["cells"] for r in filter_audit.cells(sums, 3).collect()}
    assert got == {"a": [2 * m for m in range(8)], "b": list(range(8))}


def test_encoding_frees_its_table(spark, rows):
    """The table of chunks and the shuffles of its join are gone before documents' places are shuffled."""
    P = pytest.importorskip("public_tokenizers")
    import os

    shared = _spark.scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    piece_codec.encode(frame(spark, rows), P.path("piece_bpe_32k.model"))
    (own,) = set(os.listdir(shared)) - before
    left = os.listdir(f"{shared}/{own}")
    assert "found" in left and "segments" not in left
