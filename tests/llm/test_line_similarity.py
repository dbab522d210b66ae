"""Lines are found by edit similarity: against brute force, and recall by length and kind of change."""

import random

import pytest
from helpers import corpus, frame
from test_groups import plain_lines

from loomtext.llm import line_dedup


def changed(n, kind, rng):
    """A line of n words and a copy with one letter or word changed, added or lost."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    line = [word() for _ in range(n)]
    copy, k = list(line), rng.randrange(n)
    if kind == "letter":
        p = rng.randrange(len(copy[k]))
        copy[k] = copy[k][:p] + "z" + copy[k][p + 1 :]
    elif kind == "word":
        copy[k] = word()
    elif kind == "lost":
        del copy[k]
    else:
        copy.insert(k, word())
    return " ".join(line), " ".join(copy)


@pytest.mark.parametrize("kind", ["letter", "word", "lost", "added"])
def test_recall_by_length(spark, kind):
    rng = random.Random(kind)
    sizes = (3, 4, 6, 8, 12, 20, 40)
    pairs = [(n, *changed(n, kind, rng)) for n in sizes for _ in range(80)]
    pairs = [p for p in pairs if line_dedup.similar(p[1], p[2])]
    rows = [(i, x, "en", "s", 1) for i, x in enumerate(x for _, *p in pairs for x in p)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for n in sizes:
        own = [got[2 * i + 1] for i, p in enumerate(pairs) if p[0] == n]
        assert len(own) < 5 or sum(own) >= 0.9 * len(own), (n, sum(own), len(own))
    assert not any(got[2 * i] for i in range(len(pairs)))


def test_large_group_of_alike_lines(spark):
    """A family of lines, each with a word of its own, and one of lines too unlike: one stays, and all stay."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, head = [word() for _ in range(30)], [word() for _ in range(12)]
    near = [" ".join(base[: i % 30] + [word()] + base[i % 30 + 1 :]) for i in range(900)]
    far = [" ".join(head + [word() for _ in range(18)]) for i in range(300)]
    rows = [(i, x, "en", "s", 1) for i, x in enumerate(near + far)]
    got = line_dedup.dedup_lines(frame(spark, rows)).where("n_removed = 0").select("doc_id").collect()
    assert {r["doc_id"] for r in got} == {0, *range(900, 1200)}


def test_lines_on_odd_texts(spark):
    rows = corpus(seed=11)
    want = plain_lines(rows)
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(((r[0], want[i]) for i, r in enumerate(rows)), key=repr)


def test_pipeline_drops_lines_with_a_changed_word(spark):
    import corpus_pipeline

    rng = random.Random(12)
    pairs = [p for p in (changed(n, "word", rng) for n in (8, 12, 30, 60) * 8) if line_dedup.similar(*p)]
    docs = frame(spark, [(i, f"{a}\n{b}", "en", "s", 1) for i, (a, b) in enumerate(pairs)], clash=False)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert sum(got[i] == (a, len(a)) for i, (a, _) in enumerate(pairs)) >= 0.9 * len(pairs)
