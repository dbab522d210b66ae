"""Edit distances up to a bound, and tasks of work that is great for its bytes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import _blocks, line_dedup


def some_pairs(seed):
    rng = random.Random(seed)
    text = lambda of: "".join(rng.choice(of) for _ in range(rng.randint(0, 150)))
    for _ in range(rng.randint(1, 40)):
        of = "abcdé日 "[: rng.choice([2, 4, 7])]
        a = text(of)
        b = text(of)
        if rng.random() < 0.6:
            b = "".join(c for x in a for c in (x, "", x + "a", "b")[rng.choice([0] * 12 + [1, 2, 3])])
        yield (a, b) if len(a) >= len(b) else (b, a)


@pytest.mark.parametrize("seed", range(8))
def test_bounded_distances(seed):
    pairs = list(some_pairs(seed))
    most = [line_dedup.bound(a, b) for a, b in pairs]
    exact = line_dedup.distances(pairs).tolist()
    assert all(got == d if d <= m else got > m for got, d, m in zip(line_dedup._lanes(pairs, most), exact, most, strict=True))
    left = np.arange(0, 2 * len(pairs), 2)
    may = line_dedup.may_be(line_dedup.letters([x for p in pairs for x in p]), left, left + 1, np.array(most))
    assert all(ok for ok, d, m in zip(may, exact, most, strict=True) if d <= m)


def test_unlike_long_texts_are_told_apart_early(monkeypatch):
    a, b = ("".join(random.Random(k).choice("abcdefgh") for _ in range(4000)) for k in (1, 2))
    seen = []
    least = line_dedup._least
    monkeypatch.setattr(line_dedup, "_least", lambda pv, mv, sides, ends, step: seen.append(step) or least(pv, mv, sides, ends, step))
    assert line_dedup._lanes([(a, b)], [800])[0] > 800 and max(seen) < 2400


@pytest.mark.parametrize("seed", range(8))
def test_distances_on_words(seed, monkeypatch):
    pairs = [(a, b) for k in range(3) for a, b in some_pairs(3 * seed + k) if b]
    rng = random.Random(seed)
    pairs += [(x * 5, y * 5) for x, y in pairs] + [("a" * n, "b" * n) for n in (63, 64, 65, 128)]
    most = [int(len(a) * rng.choice([0.05, 0.2, 0.5])) for a, _ in pairs]
    exact = line_dedup.distances(pairs).tolist()
    assert line_dedup._distances_within([], []) == []
    monkeypatch.setattr(line_dedup, "FEW", 1)
    for words in (1 << 20, 10):  # with 10, as long numbers
        monkeypatch.setattr(line_dedup, "MOST_WORDS", words)
        for some in (list(range(len(pairs))), *([k] for k in range(len(pairs)))):
            got = line_dedup._distances_within([pairs[k] for k in some], [most[k] for k in some])
            assert all(g == exact[k] if exact[k] <= most[k] else g > most[k] for g, k in zip(got, some, strict=True))


def test_many_unlike_lines_are_compared_on_words(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    texts = []
    for k in range(128):
        a = [rng.choice(words) for _ in range(40)]
        texts += [" ".join(a), " ".join(w if rng.random() < (0.5 if k % 2 else 0.9) else rng.choice(words) for w in a)]
    table = pa.table({"data": pa.array([x.encode() for x in texts])})
    left = np.arange(0, len(texts), 2)
    monkeypatch.setattr(line_dedup, "quick", lambda a, b, most: False)

    def linked():
        groups = _blocks.Groups(np.arange(len(texts)))
        line_dedup.verify(table, iter([(left, left + 1)]), groups, line_dedup.SIMILARITY)
        return groups.label.tolist()

    want = [k - 1 if k % 2 and line_dedup.similar(texts[k - 1], texts[k]) else k for k in range(len(texts))]
    lanes, seen = line_dedup._lanes, []
    monkeypatch.setattr(line_dedup, "_lanes", lambda sides, most=None: seen.append(len(sides)) or lanes(sides, most))
    assert linked() == want and 20 < sum(a != b for a, b in enumerate(want)) < 108
    assert sum(seen) < 64


def test_heavy_work_keeps_its_tasks(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id as key")
    for heavy in (False, True):
        _blocks.grouped(rows, "key", lambda t: iter(t.to_batches()), "key long", heavy=heavy).write.parquet(f"file://{tmp_path}/{heavy}")
    files = [len(list((tmp_path / str(heavy)).glob("part-*"))) for heavy in (False, True)]
    assert files[0] < files[1] == _blocks.TASKS * spark.sparkContext.defaultParallelism
