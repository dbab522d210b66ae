"""Exact Jaccard join of word n-gram sets with signature trees, as connected components.

Two documents link when 100 * |A & B| >= percent * |A | B|. The work is dealt out so that no pair is lost and no
group of alike documents is expanded into its pairs:

1. Documents with equal sets are one class (their links are certain), stood for by one member.
2. A class is posted under each n-gram of its prefix: its first n - ceil(percent * n) + 1 n-grams in one global
   order, which puts n-grams counted often last. Any two linked classes share a prefix n-gram.
3. Within each prefix n-gram, classes are compared by signature: hashed bitmaps and sizes bound the overlap that a
   pair can have. Larger groups are held in signature trees, whose nodes have the OR of their bitmaps and the range
   of their sizes; two trees are traversed together and pairs of nodes pruned by the most overlap they allow.
4. Classes with a possible partner bring their sets to one of their prefix n-grams, then those with partners in other
   components that they have not met to the n-grams they share with them (``_links``). There the same traversal gives
   pairs to verify exactly, but for those already connected: one link leaves a group for each class it ties.

Hot n-grams are split into parts, each pair of parts one unit of work. Sets hold 64-bit hashes of n-grams.

Defined cases: null and empty texts, and texts without words, have empty sets and link with nothing; texts with
fewer words than the n-gram have their whole sequence as the one n-gram; repeated rows are in one class; a null id is
greater than any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks, _links, _spark
from ._text import LOWER, flat, mix, pieces, span_hash, words

#: Bound of the broadcast n-grams that count as frequent; any choice gives the same links.
FREQUENT = 1 << 18
LEAF, FANOUT = 32, 8
#: Counting frequent n-grams: so many at a time, and those seen at least so often among them.
COUNT_AT_ONCE, COUNT_LEAST = 4_000_000, 3
_COEFF = mix(np.arange(101, 133, dtype=np.uint64))


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after the other, and the index of each text's first (n + 1 values)."""
    data, offs = flat(texts)
    data = LOWER[data]
    starts, ends, first = words(data, offs)
    h = span_hash(data, starts, ends)
    n = len(h) - k + 1
    s = np.zeros(max(0, n), np.uint64)
    for j in range(k):
        s += h[j : j + n] * _COEFF[j] if n > 0 else s
    s = mix(s) if n > 0 else s
    out, size = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(s[a : b - k + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif b > a:
            own = mix((h[a:b] * _COEFF[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            own = h[:0]
        out.append(own)
        size.append(len(own))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(size)


def set_class(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)))
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def width_of(n: int) -> int:
    """Bits of the signature of a set of n: a power of two, about one bit an n-gram."""
    return 1 << min(16, max(8, int(n - 1).bit_length()))


def signature(s: np.ndarray) -> np.ndarray:
    w = width_of(len(s))
    out = np.zeros(w >> 6, np.uint64)
    bit = s & np.uint64(w - 1)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def fold(sig: np.ndarray, to: int) -> np.ndarray:
    """Signatures (rows) folded to so many words."""
    while sig.shape[-1] > to:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] | sig[..., half:]
    return sig


class Threshold:
    """Links at 100 * overlap >= percent * union, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, a, b):
        """The least overlap of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def fits(self, a, b):
        """Whether sizes alone allow a link."""
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def largest(self, n, place):
        """The largest set that one of n links with if their first common n-gram has so many of its own before it."""
        return (100 + self.percent) * (n - place) // self.percent - n

    def prefix(self, n):
        return n - -(-self.percent * n // 100) + 1


def possible(sig_a: np.ndarray, sig_b: np.ndarray, a: np.ndarray, b: np.ndarray, th: Threshold) -> np.ndarray:
    """Whether sets with these signatures (rows of equal width) and sizes can link: each bit that only one has is an n-gram that only it has."""
    least = th.overlap(a, b)
    only_a = np.bitwise_count(sig_a & ~sig_b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(sig_b & ~sig_a).sum(-1, dtype=np.int64)
    return th.fits(a, b) & (a - only_a >= least) & (b - only_b >= least)


class Tree:
    """A signature tree over rows of signatures: levels of nodes, from the leaves (blocks of rows) to the root."""

    def __init__(self, sig: np.ndarray, size: np.ndarray):
        # Rows of like size and like bits stand together.
        self.order = np.lexsort((*sig.T[:2], size))
        self.sig, self.size = sig[self.order], size[self.order]
        spare = self.size - np.bitwise_count(self.sig).sum(1, dtype=np.int64)  # n-grams that share a bit with another
        self.levels = []
        step, bits, lo, hi, more = LEAF, self.sig, self.size, self.size, spare
        while True:
            at = np.arange(0, len(bits), step)
            bits, lo, hi, more = np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(more, at)
            self.levels.append((bits, lo, hi, more))
            if len(bits) == 1:
                break
            step = FANOUT

    def pairs(self, th: Threshold) -> Iterator[tuple[slice, slice]]:
        """Pairs of leaves (rows of this tree's order) that may hold a link, by traversing the tree with itself."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, x, y = stack.pop()
            bits, lo, hi, more = self.levels[level]
            if x != y:
                if hi[x] * 100 < th.percent * lo[y] or hi[y] * 100 < th.percent * lo[x]:
                    continue
                common = int(np.bitwise_count(bits[x] & bits[y]).sum())
                if common + min(more[x], more[y]) < th.overlap(int(lo[x]), int(lo[y])):
                    continue
            if level == 0:
                n = len(self.size)
                yield slice(x * LEAF, min(n, (x + 1) * LEAF)), slice(y * LEAF, min(n, (y + 1) * LEAF))
                continue
            below = len(self.levels[level - 1][0])
            xs, ys = range(x * FANOUT, min(below, (x + 1) * FANOUT)), range(y * FANOUT, min(below, (y + 1) * FANOUT))
            stack += [(level - 1, p, q) for p in xs for q in ys if x != y or p <= q]


def close_pairs(key: np.ndarray, size: np.ndarray, sigs: list[np.ndarray], th: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows with equal keys whose signatures allow a link; key is sorted. Larger groups are traversed as trees."""
    i, j, large = _blocks.pairs_of(key)
    ok = th.fits(size[i], size[j])
    i, j = i[ok], j[ok]
    words_ = np.array([len(s) for s in sigs], np.int64)
    at = np.concatenate(([0], np.cumsum(words_)))
    every = np.concatenate(sigs) if sigs else np.zeros(0, np.uint64)
    w = np.minimum(words_[i], words_[j])
    for width in np.unique(w):
        sel = np.flatnonzero(w == width)
        for part in range(0, len(sel), 20_000):
            p = sel[part : part + 20_000]
            side = []
            for rows in (i[p], j[p]):
                out = np.zeros((len(rows), width), np.uint64)
                for full in np.unique(words_[rows]):
                    r = np.flatnonzero(words_[rows] == full)
                    out[r] = fold(every[at[rows[r]][:, None] + np.arange(full)], width)
                side.append(out)
            good = possible(*side, size[i[p]], size[j[p]], th)
            yield i[p][good], j[p][good]
    for a, b in large:
        # Rows of one size range at a time: their signatures have close widths.
        yield from ((x + a, y + a) for x, y in tree_pairs(size[a:b], sigs[a:b], th))


def tree_pairs(size: np.ndarray, sigs: list[np.ndarray], th: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose signatures allow a link, leaf by leaf of signature trees.

    A tree holds the rows of one signature width and the next, as linked sizes differ by less than twice.
    """
    width = np.array([len(s) for s in sigs])
    for w in np.unique(width):
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        tree = Tree(np.stack([fold(sigs[r], w) for r in rows]), size[rows])
        own = width[rows][tree.order] == w
        for x, y in tree.pairs(th):
            p, q = np.meshgrid(np.arange(x.start, x.stop), np.arange(y.start, y.stop), indexing="ij")
            keep = ((p < q) if x == y else np.ones(p.shape, bool)) & (own[p] | own[q])  # two of the wider ones meet in their own tree
            p, q = p[keep], q[keep]
            good = possible(tree.sig[p], tree.sig[q], tree.size[p], tree.size[q], th)
            yield rows[tree.order[p[good]]], rows[tree.order[q[good]]]


def linked(a: np.ndarray, b: np.ndarray, th: Threshold) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) >= th.overlap(len(a), len(b))


def verify(t: pa.Table, pairs: Iterator[tuple[np.ndarray, np.ndarray]], groups: _blocks.Groups, th: Threshold) -> None:
    """Joins the rows of linked pairs in groups, by their whole sets; a row meets its partners of a batch in one search."""
    grams = [np.frombuffer(x, np.uint64) for x in t["data"].to_pylist()]
    size = np.array([len(g) for g in grams], np.int64)
    for i, j in pairs:
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for x, ys in zip(i[np.flatnonzero(np.diff(i, prepend=-1))].tolist(), np.split(j, np.flatnonzero(np.diff(i)) + 1), strict=True):
            ys = ys[groups.label[ys] != groups.label[x]]
            if not len(ys):
                continue
            many, own = np.concatenate([grams[y] for y in ys.tolist()]), grams[x]
            found = own[np.minimum(np.searchsorted(own, many), len(own) - 1)] == many
            both = np.add.reduceat(found, np.cumsum(size[ys]) - size[ys], dtype=np.int64)
            for y in ys[both >= th.overlap(size[x], size[ys])].tolist():
                groups.join(x, y)


def classes_of(docs: DataFrame, scratch: _spark.Scratch, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((row, id, n, cls) of each row of docs (row, id, text), (cls, first struct<id, row>, least id, least row, many) of each class, (node, root) of the least rows of linked classes).

    n is the size of a row's set and cls the class of rows with equal sets.
    """
    spark, th = docs.sparkSession, Threshold(percent)
    kind = docs.schema["id"].dataType.simpleString()

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            at = c >= COUNT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(u[at].view(np.int64)), pa.array(c[at])], ["s", "n"])

        for batch in batches:
            for b in pieces(batch, "text"):
                s, _ = shingles(b.column("text"), k)
                held.append(s)
                n += len(s)
                if n > COUNT_AT_ONCE:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()

    counts = scratch.cut(docs.select("text").mapInArrow(often, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")), "often")
    top = counts.where(F.col("n") >= _spark.head_cut(counts, "n", FREQUENT)).toArrow()
    s = top["s"].to_numpy().view(np.uint64)
    order = np.argsort(s)
    frequent = spark.sparkContext.broadcast((s[order], (1 + np.log2(np.maximum(top["n"].to_numpy()[order], 1))).astype(np.uint8)))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = frequent.value
        bits = np.zeros(1 << 22, bool)
        bits[(known >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            for b in pieces(batch, "text", 2 << 20):
                s, first = shingles(b.column("text"), k)
                step = np.zeros(len(s), np.uint8)
                maybe = np.flatnonzero(bits[(s >> np.uint64(42)).astype(np.int64)])
                if len(known):
                    at = np.minimum(np.searchsorted(known, s[maybe]), len(known) - 1)
                    step[maybe] = np.where(known[at] == s[maybe], rank[at], 0)
                n = np.diff(first)
                prefixes, sigs = [], []
                for a, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own, rare = s[a:e], step[a:e]
                    p = th.prefix(e - a) if e > a else 0
                    prefixes.append(own[np.argsort(rare, kind="stable")[:p]] if rare.any() else own[:p])
                    sigs.append(signature(own).tobytes() if e > a else b"")
                size = np.array([len(p) for p in prefixes], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.concatenate(prefixes).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(set_class(s, first)), pa.array(n.astype(np.int32)), lists, pa.array(sigs, pa.binary())], ["row", "id", "cls", "n", "prefix", "sig"])

    every = scratch.cut(docs.mapInArrow(described, f"row long, id {kind}, cls long, n int, prefix array<long>, sig binary"), "sets")
    frequent.unpersist()
    stands = every.where("n > 0").groupBy("cls").agg(F.min(F.struct("id", "row")).alias("first"), F.min("id").alias("least"), F.min("row").alias("row"), (F.count("*") > 1).alias("many"))
    stands = scratch.cut(stands, "stands")
    reps = scratch.cut(every.join(stands.select("cls", "row"), ["cls", "row"]).select("row", "n", "prefix", "sig"), "classes")

    def posted(hot):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    b = batch.slice(at, 1024)
                    lists = b.column("prefix")
                    size = lists.value_lengths().to_numpy(zero_copy_only=False)
                    of = np.repeat(np.arange(len(b)), size)
                    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                    row, n = b.column("row").to_numpy(), b.column("n").to_numpy().astype(np.int64)
                    top = th.largest(n[of], place)
                    rows, key = _blocks.split_hot(lists.flatten().to_numpy(), row[of], hot)
                    take = pa.array(of[rows])
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column("row").take(take), b.column("n").take(take), pa.array(top[rows].astype(np.int32))], ["key", "id", "n", "top"])

        return run

    narrow, cols = reps.select("row", "n", "prefix"), "key long, id long, n int, top int"
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    hot = _blocks.hot_keys(narrow.where(F.pmod(F.xxhash64("row"), F.lit(_blocks.SAMPLE)) == 0).mapInArrow(posted(none), cols))

    def met(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows with another under their key of a size that either's place in its order allows; rows come by key and size."""
        t = t.combine_chunks()
        key, n, top = t["key"].to_numpy(), t["n"].to_numpy().astype(np.int64), t["top"].to_numpy()
        keep = np.zeros(len(key), bool)
        i, j, large = _blocks.pairs_of(key, 32)
        ok = th.fits(n[i], n[j]) & (n[j] <= top[i]) & (n[i] <= top[j])
        keep[i[ok]] = keep[j[ok]] = True
        for a, b in large:
            own, most = n[a:b], top[a:b]
            others = np.searchsorted(own, most, "right") - np.searchsorted(own, -(-th.percent * own // 100)) - (own <= most)
            keep[a:b] = others > 0
        yield from t.select(["key", "id", "n"]).filter(pa.array(keep)).combine_chunks().to_batches()

    shared = _blocks.grouped(narrow.mapInArrow(posted(hot), cols), "key", met, "key long, id long, n int", rows=100_000, then=("n",))

    def candidates(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return close_pairs(t["key"].to_numpy(), t["n"].to_numpy().astype(np.int64), [np.frombuffer(x, np.uint64) for x in t["sig"].to_pylist()], th)

    def may_link(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        hit = np.zeros(len(t), bool)
        for i, j in candidates(t):
            hit[i] = hit[j] = True
        yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    signed = shared.join(reps.select(F.col("row").alias("id"), "sig"), "id").select("key", "id", "n", "sig")
    hits = scratch.cut(_blocks.grouped(signed, "key", may_link, "key long, id long, n int, sig binary", rows=20_000), "hits")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = spark.sparkContext.broadcast(_blocks.bloom(ids, "id"))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(_blocks.in_bloom(wanted.value, batch.column("row").to_numpy())))
                for b in pieces(batch, "text") if len(batch) else ():
                    s, first = shingles(b.column("text"), k)
                    yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([s[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], ["id", "data"])

        return docs.select("row", "text").mapInArrow(sets, "id long, data binary")

    roots = _links.link(scratch, hits, "n int, sig binary", candidates, sets_of, lambda t, pairs, groups: verify(t, pairs, groups, th))
    scratch.drop("often", "classes", "hits")
    return every.select("row", "id", "n", "cls"), stands, roots


def components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of each row of docs; component_id is the least id of its component."""
    scratch = _spark.Scratch(docs.sparkSession)
    docs = _spark.with_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), scratch)
    every, stands, roots = classes_of(docs, scratch, k, percent)
    linked = scratch.cut(roots.join(stands, F.col("node") == F.col("row")).select("cls", "root", "least"), "linked")
    # The least ids are tables of their own: the join of a large component's classes or rows with one is then split.
    least = scratch.cut(linked.groupBy("root").agg(F.min("least").alias("least")), "least")
    named = linked.select("cls", "root").join(least, "root").select("cls", "least").unionByName(stands.where("many").join(roots, F.col("node") == F.col("row"), "left_anti").select("cls", "least"))
    named = scratch.cut(named, "named")
    return every.join(named, "cls", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"))


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the least id (null first), then row. Rows with empty sets stay. All columns pass through, whatever their names."""
    scratch = _spark.Scratch(docs.sparkSession)
    (row,) = _spark.fresh(docs.columns, "row")
    rows = _spark.with_rows(docs, scratch, row)
    every, stands, roots = classes_of(rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), scratch, k, percent)
    linked = stands.join(roots, F.col("node") == F.col("row"), "left")
    stays = linked.groupBy(F.coalesce("root", "row")).agg(F.min("first").alias("first")).select("first.row")
    stays = scratch.cut(stays.unionByName(every.where("n = 0").select("row")), "stays")
    return rows.join(stays.withColumnRenamed("row", row), row, "left_semi").drop(row)
