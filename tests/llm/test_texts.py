"""Token counts, language model, substring removal, toxicity: against brute force, on odd texts and empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, frame, rows_of, words
from pyspark.sql import functions as F

from loomtext.llm import _spark, _text, lm_scoring, substring_dedup, token_counts, toxicity


def test_words_and_hashes():
    data, offs = _text.flat(pa.array(["ab cd", None, "", "ef", "gh", " x\n"]))
    s, e, first = _text.words(data, offs)
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(s, e)] == [b"ab", b"cd", b"ef", b"gh", b"x"] and first.tolist() == [0, 2, 2, 2, 3, 4, 5]
    same, so = _text.flat(pa.array(["x ef ab gh cd"]))
    h1, h2 = _text.span_hash(data, s, e), _text.span_hash(same, *_text.words(same, so)[:2], limit=3)
    assert sorted(h1.tolist()) == sorted(h2.tolist()) and len(set(h1.tolist())) == 5


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_token_counts(spark, rows):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 50) for r in rows), key=repr)
    got = token_counts.token_counts(frame(spark, rows), model, limit=50)
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(frame(spark, []), model).count() == 0


def test_token_counts_without_a_head(spark, rows, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from loomtext.llm import keyed

    model = P.path("piece_bpe_32k.model")
    want = rows_of(token_counts.token_counts(frame(spark, rows), model), "doc_id", "n_tokens")
    monkeypatch.setattr(keyed, "HEAD_KEYS", 0)
    assert rows_of(token_counts.token_counts(frame(spark, rows), model), "doc_id", "n_tokens") == want


def test_language_model(spark, rows):
    rows = [r for r in rows if len(r[1] or "") < 1500]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    trie, count = lm_scoring.Trie(5), Counter()
    for r in rows:
        if not held(r[0]):
            trie.run(lm_scoring.normal_form(r[1]), learn=True, price=False)
            count.update([*words(r[1]), "end"])
    n, v = sum(count.values()), len(count)
    got = lm_scoring.score(frame(spark, rows), _spark.doc_key() % 7 == 2).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for r in rows[::3] + rows[-20:]:
        w = [*words(r[1]), "end"]
        g = by[r[0]][0]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held(r[0]), len(w), sum(count[x] > 0 for x in w), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert g["score"] == pytest.approx(trie.run(lm_scoring.normal_form(r[1]), learn=False))
    assert lm_scoring.score(frame(spark, []), F.lit(False)).count() == 0


def test_language_model_in_small_parts(spark, rows, monkeypatch):
    # One row of each id: rows of one id and different texts have no order.
    rows = list({r[0]: r for r in rows}.values())
    parts = lambda: sorted(((repr(r["doc_id"]), r["n_known"], r["score"]) for r in lm_scoring.score(frame(spark, rows), F.lit(False)).collect()))
    want = parts()
    for name, value in (("GRAM_BYTES", 300), ("TEXT_BYTES", 2000), ("MERGED", 400), ("KEPT", 200)):
        monkeypatch.setattr(lm_scoring, name, value)
    for g, w in zip(parts(), want, strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2])


def test_language_model_memory(spark, monkeypatch):
    """What a task holds besides its input and the tables that are broadcast doesn't grow with the text."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.Generator(np.random.PCG64(5))
    vocabulary = np.array(["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (3000, 5))])
    docs = frame(spark, [(i, " ".join(w), "", "", 0) for i, w in enumerate(rng.choice(vocabulary, (600, 2000)))]).coalesce(1)
    plain = DataFrame.mapInArrow

    def watched(df, fn, schema, *more, **named):
        def run(batches):
            import tracemalloc

            tracemalloc.start()
            try:
                yield from fn(batches)
                assert tracemalloc.get_traced_memory()[1] < 150 << 20, schema
            finally:
                tracemalloc.stop()

        return plain(df, run, schema, *more, **named)

    monkeypatch.setattr(DataFrame, "mapInArrow", watched)
    assert lm_scoring.score(docs, F.lit(False)).count() == 600


def test_language_model_without_training(spark):
    got = lm_scoring.score(frame(spark, [(1, "ab", "en", "s", 2), (2, None, "en", "s", 0)]), F.lit(True)).orderBy("doc_id").collect()
    assert [r["n_known"] for r in got] == [0, 0] and got[0]["score"] == pytest.approx(-3 * math.log10(256))
    assert got[1]["n_tokens"] == 1 and got[1]["score"] == pytest.approx(-math.log10(256))


def test_probabilities_sum_to_one():
    trie = lm_scoring.Trie(3)
    for t in (b"abab", b"abba", b"cab"):
        trie.run(t, learn=True, price=False)
    for context in (b"\xfe\xfe\xfe", b"aba", b"zzz", b"zab"):
        assert sum(10 ** trie.log10p(context, s) for s in range(256)) == pytest.approx(1)


def test_adaptive_code_length(spark):
    got = {r["doc_id"]: r for r in lm_scoring.adaptive_code_length(frame(spark, [(1, "ab" * 50, "", "", 0), (2, None, "", "", 0)])).collect()}
    assert got[1]["n_symbols"] == 101 and got[1]["bits"] < 101 * 2 and got[2]["bits"] == pytest.approx(8)


def plain_removal(rows, length, keep_first=False, order=None):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((r[0], len(t), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 2])
def test_repeats_are_removed(spark, rows, group):
    got = substring_dedup.remove_repeats(frame(spark, rows), 60, keep_text=False, group=group)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_removal(rows, 60)


def test_keep_first_leaves_one_copy(spark, rows):
    for group in (substring_dedup.GROUP, 2):
        got = substring_dedup.remove_repeats(frame(spark, rows), 60, keep_first=True, group=group).collect()
        before = {(r[1] or "").encode()[i : i + 60] for r in rows for i in range(len((r[1] or "").encode()) - 59)}
        text = b"\xff".join(bytes(r["kept"]) for r in got)
        removed = substring_dedup.remove_repeats(frame(spark, rows), 60, keep_text=False).agg(F.sum("n_removed")).first()[0]
        assert 0 < sum(r["n_removed"] for r in got) < removed
        # A passage and a whole copied document are still there once.
        assert text.count(rows[3][1].encode()[:60]) <= 1 and len(before) > 0


def test_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(frame(spark, []), 60).count() == 0


def test_longest_previous_factor():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    starts = np.arange(300 - 16)
    earlier, other = substring_dedup.repeated(data, starts, 16)
    t = data.tobytes()
    for i in starts:
        assert earlier[i] == any(t[j : j + 16] == t[i : i + 16] for j in range(i))
        assert other[i] == any(t[j : j + 16] == t[i : i + 16] for j in starts if j != i)


def toxic_rows(n=600):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(plain, 30))
        bad = rng.random() < 0.2
        if bad:
            w[3] = rng.choice(["zorkam", "zorkit", "idiot"])
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_held_out_accuracy(spark):
    docs, labels = toxic_rows()
    marks = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int")
    df = frame(spark, [*docs, (9000, None, "", "", 0), (9001, "", "", "", 0), docs[0]])
    got = toxicity.toxicity(df, marks, _spark.doc_key() % 4 == 2).collect()
    truth = {i: t for i, _, t in labels}
    out = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(docs) + 3 and len(out) > 100
    assert sum(a == b for a, b in out) / len(out) > 0.97
    odd = [r for r in got if r["doc_id"] in (9000, 9001)]
    assert odd[0]["score"] == odd[1]["score"] < 0.3 and all(0 <= r["score"] <= 1 for r in got)
    again = toxicity.toxicity(df, marks, _spark.doc_key() % 4 == 2).collect()
    assert sorted((str(r["doc_id"]), r["predicted"]) for r in got) == sorted((str(r["doc_id"]), r["predicted"]) for r in again)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "you idiot", "", "", 0), (2, "good day", "", "", 0)])
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, none, F.lit(False)).collect()}
    assert got[1] > got[2]
    assert toxicity.toxicity(frame(spark, []), none, F.lit(False)).count() == 0


def test_label_model_finds_accurate_voters():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    votes = np.column_stack([np.where(y, rng.random(2000) < a, rng.random(2000) < b) for a, b in ((0.9, 0.05), (0.8, 0.1), (0.5, 0.5))])
    votes = np.column_stack([votes, votes[:, 0]]).astype(float)
    post, rates, weight = toxicity.label_model(votes, np.full(2000, -1), 0.3)
    assert ((post > 0.5) == y).mean() > 0.88
    assert weight[0] < 0.7 and weight[3] < 0.7 and weight[2] > 0.8


def test_logistic_converges_on_separable_labels():
    x = np.concatenate([np.zeros((500, 3)), np.ones((20, 3)) * 2])
    w, b = toxicity.logistic(x, np.concatenate([np.zeros(500), np.ones(20)]))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert p[:500].max() < 0.1 and p[500:].min() > 0.8


def test_filter_keeps_all_columns(spark):
    docs, labels = toxic_rows(200)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = frame(spark, docs)
    out = toxicity.without_toxic(df, marks, _spark.doc_key() % 4 == 2)
    assert out.columns == df.columns and 0 < out.count() < df.count()


def test_counts_in_packed_blocks(spark, rows, monkeypatch):
    import pyarrow as pa

    from loomtext.llm import keyed

    docs = frame(spark, [*rows, (999, "x" * 100_000, "en", "s", 1), (1000, " ".join(f"word{i}" for i in range(3000)), "en", "s", 1)])

    def keys_of(batch):
        yield pa.array([w.encode() for t in batch.column("text").to_pylist() for w in (t or "").split()] + [b""], pa.large_binary())

    want = rows_of(keyed.count_keys(docs, ["text"], keys_of), "key", "freq")
    assert rows_of(keyed.count_packed(docs, ["text"], keys_of), "key", "freq") == want and len(want) > 3000
    # Merged again and again, in windows of few keys.
    monkeypatch.setattr(keyed, "WINDOW", 50)
    monkeypatch.setattr(keyed, "MERGED", 50)
    monkeypatch.setattr(keyed, "BUCKETS", 3)
    assert rows_of(keyed.count_packed(docs, ["text"], keys_of), "key", "freq") == want
    assert keyed.count_packed(frame(spark, []), ["text"], keys_of).count() == 0
    # A count takes far less than its bytes.
    keys = pa.array(sorted(f"word{i}".encode() for i in range(3000)), pa.binary())
    block = keyed.packed(keys, np.ones(3000, np.int64))
    assert len(block) < keys.nbytes / 4 and keyed.unpacked(block)["key"].to_pylist() == keys.to_pylist()
