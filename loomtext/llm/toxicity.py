"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters are a small multilingual lexicon, style patterns, and word and word-start patterns found in the labelled
rows by an exact binomial test with Bonferroni's correction. Each fires or abstains. The label model is a mixture
of toxic and clean texts in which every voter has a firing rate for either class (its accuracy), fitted by
expectation maximisation with the given labels as one more, nearly sure voter; voters that go together beyond what
the classes explain (their residual correlations) share their weight. A logistic classifier is trained on the
posterior labels and scores every whole text.

Fitting uses at most ``MAX_LABELLED`` labelled rows, those with the least hash of their id, and at most
``MAX_VOTERS`` voters: with fewer rows all of them. Scores cover all rows.

Defined cases: null and empty texts fire no voter and get the classifier's score of that; labels that are null are
left out, of repeated labels the greatest counts; repeated rows are scored each; a null doc_id counts as the empty
text in the split; other columns are ignored; empty tables give no rows, and without labels the lexicon alone is
used, at a prior of ``PRIOR``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark
from ._text import pieces

MAX_LABELLED, MAX_VOTERS, PRIOR = 20_000, 256, 0.1
#: General insults, as word starts.
LEXICON = (
    "idiot", "stupid", "moron", "imbecil", "dumbass", "loser", "scum", "trash", "garbage", "worthless", "pathetic", "disgusting", "clown", "bastard", "asshole", "bitch",
    "retard", "vermin", "crétin", "connard", "salaud", "salope", "débile", "ordure", "abruti", "dégoûtant", "minable",
    "dummkopf", "arschloch", "idiotisch", "abschaum", "widerlich", "wertlos", "vollidiot", "erbärmlich", "estúpid", "imbécil", "basura", "escoria", "asqueros", "patétic", "inútil", "gilipollas",
)
#: Style voters, counted on the text as it is: shouting, runs of marks, masked words.
STYLES = (r"\p{Lu}{4,}", r"[!?]{2,}", r"\p{L}[*#@$]{2,}\p{L}?")
STARTS = (4, 5, 6, 7, 8)


def _normal(texts: pa.Array) -> pa.Array:
    """Lower case, every run of other characters than letters and digits one space, a space at either end."""
    texts = texts if not texts.null_count else pc.fill_null(texts, "")
    t = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")
    return pc.binary_join_element_wise(pa.scalar("", t.type), pc.utf8_trim(t, " "), pa.scalar("", t.type), pa.scalar(" ", t.type))


def _patterns(words: set[str]) -> set[str]:
    """Patterns of a text's words: " start" and " word "."""
    out = set()
    for w in words:
        if w.isalpha() and len(w) > 2:
            if len(w) <= 24:
                out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in STARTS if len(w) >= n)
    return out


@dataclass
class Model:
    """Voters and the classifier over their features."""

    patterns: list[str]
    weights: np.ndarray
    bias: float
    accuracy: dict[str, tuple[float, float]] = field(default_factory=dict)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, p in enumerate(self.patterns):
            a.add_word(p, i)
        if self.patterns:
            a.make_automaton()
        return a


def counts(texts: pa.Array, automaton, n: int) -> np.ndarray:
    """For each text: hits of each pattern, hits of each style, words."""
    out = np.zeros((len(texts), n + len(STYLES) + 1), np.float32)
    texts = texts if not texts.null_count else pc.fill_null(texts, "")
    for i, t in enumerate(_normal(texts).to_pylist()):
        out[i, -1] = t.count(" ") - 1
        if n:
            for _, k in automaton.iter(t):
                out[i, k] += 1
    for k, style in enumerate(STYLES):
        out[:, n + k] = pc.count_substring_regex(texts, style).to_numpy(zero_copy_only=False)
    return out


def features(c: np.ndarray) -> np.ndarray:
    n = c.shape[1] - len(STYLES) - 1
    hits, words = c[:, :n].sum(1), np.maximum(c[:, -1], 1)
    per = lambda x: np.log1p(100 * x / words)
    return np.column_stack([np.minimum(np.log1p(c[:, :n]), 2), np.log1p(hits), per(hits), (hits > 0), *(per(c[:, n + k]) for k in range(len(STYLES)))]).astype(np.float32)


def label_model(votes: np.ndarray, gold: np.ndarray, prior: float, gold_accuracy: float = 0.98, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic per row, firing rates of each voter by class, weight of each voter).

    votes: rows x voters, 1 where a voter fires. gold: 1, 0, or -1 where there is no label.
    """
    m = votes.shape[1]
    known = np.where(gold < 0, 0.0, np.log(gold_accuracy / (1 - gold_accuracy)) * np.where(gold > 0, 1, -1))
    n = votes.sum(1)
    # At first every voter is as good as any: rows with more votes than most are toxic.
    post = 1 / (1 + np.exp(-(math.log(prior / (1 - prior)) + known + 2.0 * (n - n.mean()) / (n.std() + 1e-9))))
    rates, weight = np.zeros((m, 2)), np.ones(m)
    for turn in range(rounds):
        pi = float(np.clip(post.mean(), 1e-4, 1 - 1e-4))
        rates[:, 1] = (votes.T @ post + 0.5) / (post.sum() + 1)
        rates[:, 0] = (votes.T @ (1 - post) + 0.5) / ((1 - post).sum() + 1)
        if turn % 5 == 0:
            # Correlations left within the classes; voters that repeat each other share one voice.
            both = np.zeros((m, m))
            for at in range(0, len(votes), 2048):
                p = post[at : at + 2048, None]
                rest = votes[at : at + 2048] - p * rates[:, 1] - (1 - p) * rates[:, 0]
                both += rest.T @ rest
            scale = np.sqrt(np.diag(both) / len(votes)) + 1e-9
            corr = both / len(votes) / np.outer(scale, scale)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(1))
        fire, still = np.log(rates[:, 1] / rates[:, 0]), np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))
        logit = math.log(pi / (1 - pi)) + known + votes @ (weight * (fire - still)) + float(weight @ still)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-5:
            post = new
            break
        post = new
    return post, rates, weight


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton's method with step halving."""
    a = np.column_stack([x, np.ones(len(x), x.dtype)])
    w = np.zeros(a.shape[1])
    w[-1] = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    pull = np.full(a.shape[1], ridge)
    pull[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (pull * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        slope = a.T @ (p - y) + pull * w
        curve = np.diag(pull)
        for at in range(0, len(a), 2048):
            part = a[at : at + 2048].astype(np.float64)
            curve += (part * (p * (1 - p))[at : at + 2048, None]).T @ part
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-8 and (new := loss(w - size * step)) > now - 1e-4 * size * float(slope @ step):
            size /= 2
        if size <= 1e-8 or now - new < 1e-9 * (1 + abs(now)):
            break
        w, now = w - size * step, new
    return w[:-1], float(w[-1])


def _tail(pos: int, n: int, p: float) -> float:
    """P(X >= pos) of a binomial, for pos well above n * p: the first terms of the sum."""
    total, log = 0.0, math.lgamma(n + 1)
    for k in range(pos, min(n, pos + 60) + 1):
        total += math.exp(log - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
    return total


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_voters: int = MAX_VOTERS) -> Model:
    """A model from the labelled rows; docs and labels hold only rows that may be learnt from."""
    spark, scratch = docs.sparkSession, _spark.Scratch(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = marks.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    # Of repeated ids one row is used, so that the bound holds.
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    found = scratch.cut(found.dropDuplicates(["id"]), "labelled")
    base = found.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    n, toxic = base[0], base[1]
    prior = (toxic + PRIOR) / (n + 1)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for b in pieces(batch, "text"):
                for t, y in zip(_normal(b.column("text")).to_pylist(), b.column("y").to_pylist(), strict=True):
                    count.update((p, y) for p in _patterns(set(t.split())))
        items = list(count.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p for (p, _), _ in part]), pa.array([c if y else 0 for (_, y), c in part], pa.int64()), pa.array([c for _, c in part], pa.int64())], ["pattern", "pos", "n"])

    stats = found.select("text", "y").mapInArrow(seen, "pattern string, pos long, n long").groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    # A voter must be toxic's in most rows it fires on; the labelled rows are bounded, and so is what passes here.
    able = stats.where("pos >= 3").agg(F.count("*")).first()[0]
    # The test's value is at least prior^pos * (1 - prior)^(n - pos), so most rows drop out before they are collected.
    bound = F.col("pos") * math.log(prior) + (F.col("n") - F.col("pos")) * math.log1p(-prior)
    likely = stats.where("pos >= 3 and 2 * pos > n").where(bound < math.log(0.05 / max(1, able))).toArrow().to_pylist()
    rated = sorted((p, r["pattern"]) for r in likely if (p := _tail(r["pos"], r["n"], prior)) * max(1, able) < 0.05)
    chosen: list[str] = []
    for _, p in sorted(rated, key=lambda r: (len(r[1].rstrip()), r)):
        # A word start that passed stands for the words and longer starts below it.
        if not any(p.startswith(c) for c in chosen if not c.endswith(" ")):
            chosen.append(p)
    rank = {p: i for i, (_, p) in enumerate(rated)}
    chosen = sorted(chosen, key=rank.__getitem__)[:max_voters]
    patterns = chosen + [f" {w}" for w in LEXICON if not any(f" {w}".startswith(c) for c in chosen)]
    shape = Model(patterns, np.zeros(0), 0.0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shape.automaton()
        for batch in batches:
            for b in pieces(batch, "text"):
                c = counts(b.column("text"), a, len(patterns))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.float32())), b.column("y"), b.column("h")], ["c", "y", "h"])

    width = len(patterns) + len(STYLES) + 1

    def model(c: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        # Without labels the lexicon stands for them: one made-up row a pattern.
        if not n:
            c, y = np.eye(len(patterns), width, dtype=np.float32), np.full(len(patterns), -1)
        if not n or not toxic:
            blank = np.zeros((9 * len(patterns) * (not n), width), np.float32)
            c, y = np.concatenate([c, blank, np.eye(len(patterns), width, dtype=np.float32)]), np.concatenate([y, np.zeros(len(blank), int), np.ones(len(patterns), int)])
        post, rates, _ = label_model((c[:, :-1] > 0).astype(np.float32), y, float(np.clip(prior, 1e-3, 0.999)))
        w, bias = logistic(features(c), post)
        return pa.RecordBatch.from_arrays([pa.array([w], pa.list_(pa.float64())), pa.array([bias]), pa.array([rates.ravel()], pa.list_(pa.float64()))], ["w", "bias", "rates"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("h")  # so that reruns agree
        yield model(t["c"].combine_chunks().flatten().to_numpy().reshape(-1, width), t["y"].to_numpy())

    if n:
        # The bounded sample is fitted in one task, so that the driver holds the model only.
        rows = found.select("text", "y", F.xxhash64("id").alias("h")).mapInArrow(counted, "c array<float>, y int, h long").repartition(1)
        got = rows.mapInArrow(fitted, "w array<double>, bias double, rates array<double>").toArrow()
    else:
        got = model(np.zeros((0, width), np.float32), np.zeros(0, int))
    w, rates = (got.column(k).to_pylist()[0] for k in ("w", "rates"))
    return Model(patterns, np.array(w), got.column("bias").to_pylist()[0], dict(zip(patterns, np.reshape(rates, (-1, 2)).tolist(), strict=False)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, score double, predicted int) of each row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c) for c in keep])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        a = m.automaton()
        for batch in batches:
            for b in pieces(batch, "text"):
                p = 1 / (1 + np.exp(-np.clip(features(counts(b.column("text"), a, len(m.patterns))) @ m.weights + m.bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column("id"), *[b.column(c) for c in keep], pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["id", *keep, "score", "predicted"])

    schema = T.StructType([*rows.select("id", *keep).schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(scored, schema).withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; rows whose held_out is true are not learnt from."""
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    model = fit(docs.where("not held_out"), labels.where(~held_out), max_labelled=MAX_LABELLED)
    return score(docs, model, threshold, keep=("held_out",))


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below threshold, with the columns of docs."""
    seen = docs.select("doc_id", "text", held_out.alias("held_out")).where("not held_out")
    model = fit(seen, labels.where(~held_out), max_labelled=MAX_LABELLED)
    plain = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), "*")
    names = [f"_{i}" for i in range(len(docs.columns))]
    kept = score(plain.toDF("_id", "_text", *names), model, threshold, "_id", "_text", tuple(names))
    return kept.where("predicted = 0").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
