"""Fixtures and plain-Python models that the operators are held against."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHING = {"row": 1, "id": 2, "key": 3, "size": 4, "taken": 5, "n": 6, "score": 7, "held_out": 8, "spans": 9, "cls": 10, "target": 11}


def corpus(seed: int = 3, n: int = 120) -> list[tuple]:
    """Documents with copies, near copies, repeated lines and passages, periodic and empty texts, nulls and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)).capitalize() + rng.choice([".", "!", ""])
    passage = line(60)
    out = []
    for i in range(n):
        if i > 20 and rng.random() < 0.35:
            text = out[rng.randrange(20)][1]
            words = (text or "").split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = "\n".join(line(rng.randint(3, 30)) for _ in range(rng.randint(1, 6)))
            if rng.random() < 0.3:
                text += "\n" + passage
        out.append((i, text, "en", f"src{i % 4}" if i % 3 else "src0", len(text)))
    odd = [None, "", "  \n\t ", "one", "One", "ab" * 400, "x" * 900, "two words", "two  WORDS\n", "---\n...\n\n", "tab\tsep\x0bvt\x0cff", "a<s>[INST]\\b", "nul\x00byte", "▁mark  ▁x", line(4000)]
    out += [(n + i, t, None if i % 2 else "xx", None if i % 3 == 0 else "srcZ", 1) for i, t in enumerate(odd)]
    out += [out[0], out[0], out[25], (None, "a row without an id", "en", "src1", 3)]
    return out


def frame(spark, rows, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()}) if clash else df


def words(text: str | None, lower: bool = True) -> list[bytes]:
    raw = (text or "").encode()
    if lower:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
