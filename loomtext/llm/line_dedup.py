"""Fuzzy line deduplication over the whole corpus.

Lines are normalised (lower case, runs of ASCII characters other than letters and digits one space). Equal lines are
one distinct line. Two lines whose edit similarity, 1 - distance / longer length, is at least ``SIMILARITY`` are linked,
and of each connected group of lines the first occurrence, by id, row and line, stays.

A line's 64-bit SimHash is made of its words, those of up to three bytes together with the word after them. It is cut
into two blocks, and lines are joined on each, so all pairs within 1 bit meet. Alike lines are further apart, up to
``RADIUS`` bits, which no join on blocks can reach that are wide enough to tell lines apart; so lines are also
joined on the ``RUNS`` least hashes of their runs of words (of two words in short lines, three in longer and four in
long ones), and lines of up to ``SHORT`` words on their first and last bytes. Of the pairs that meet, those within
``RADIUS`` bits, or ``WIDER`` with a line of up to ``MEDIUM`` words, are compared by edit distance; lines of up to
``SHORT`` words all count as within it. Pairs that share none of the keys, or differ in more bits, are not found: the
README has the measured recall.

Lines with a partner left, and no others, bring their texts to the comparison, where pairs that links already connect
are skipped (``_links``): a group of alike lines costs about one comparison a line and gives one link a line.

Defined cases: null texts stay null and empty ones empty, with no lines; blank lines and lines without letters or
digits always stay; repeated rows are documents of their own, so their lines repeat; null ids are kept; other
columns pass through, whatever their names; an empty table gives no rows; lines and texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _blocks, _links, _spark
from ._text import flat, inverse_powers, mix, pieces, powers, span_hash, words

SIMILARITY, RADIUS, WIDER = 0.8, 18, 24
#: First bits of the blocks, and their width.
BLOCKS, WIDTH = (0, 32), 32
#: Runs that a line is joined on, of each kind; the least and most words of a line, and the words of a run, of each kind.
RUNS, KINDS = 4, ((2, 9, 2), (7, 20, 3), (17, 1 << 40, 4))
#: Lines of up to so many words have the wider radius, which the lowest bit of their SimHash tells.
MEDIUM = 16
#: Lines of up to so many words have no SimHash and are joined on so many bytes at either end, if they have the bytes in the range.
SHORT, ENDS = 4, ((5, 9, 3), (8, 17, 5), (14, 1 << 40, 9))
#: Lines under one key that one task compares; a key with more is split into parts of about so many.
PART = 1024
#: Pairs, and characters of them, that are gathered before their distances are computed; pairs and characters computed at once.
AT_ONCE, MANY, WIDE, LONG = 2048, 1 << 21, 256, 1 << 18
#: Fewer pairs at once, or pairs whose table of characters takes more words, are computed as long numbers.
FEW, MOST_WORDS = 48, 1 << 20
#: Bins of the counts of characters, which tell many pairs apart before their distances are computed; a power of 2, at most 256.
BINS = 32

#: ASCII bytes that are neither letters nor digits.
_BETWEEN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: The bits of a byte, one in each byte of a 64-bit number.
_LANES = np.array([sum(((c >> b) & 1) << (8 * b) for b in range(8)) for c in range(256)], np.uint64)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.uint64((1 << 64) - 1)
#: Words to go on by in two lines, the nearest first.
_REACH = sorted(((p, q) for p in range(5) for q in range(5) if p or q), key=lambda s: (sum(s), abs(s[0] - s[1])))


class Lines:
    """The normalised lines with words of a batch of texts."""

    def __init__(self, texts: pa.Array):
        self.data, offs = flat(pc.utf8_lower(texts if not texts.null_count else pc.fill_null(texts, "")))
        line_start = np.unique(np.concatenate((offs[:-1], np.flatnonzero(self.data == 10) + 1)))
        line_start = line_start[line_start < len(self.data)]
        doc = np.searchsorted(offs, line_start, "right") - 1
        self.starts, self.ends, _ = words(self.data, offs, _BETWEEN)
        first = np.searchsorted(self.starts, line_start)
        count = np.diff(np.append(first, len(self.starts)))
        line = np.flatnonzero(count)
        self.begin, self.count = first[line], count[line]
        self.doc = doc[line]
        self.number = line - np.searchsorted(line_start, offs[self.doc])
        self.word = span_hash(self.data, self.starts, self.ends)
        self.total = np.zeros(len(self.word) + 1, np.uint64)
        np.cumsum(self.word * powers(len(self.word)), out=self.total[1:])
        self.hash = self._span(self.begin, self.begin + self.count).view(np.int64)

    def _span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from a up to b."""
        own = (self.total[b] - self.total[a]) * inverse_powers(len(self.word) + 1)[a]
        return mix(own + (b - a).astype(np.uint64))

    def runs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in which, key) of what the lines numbered by which are joined on, by place."""
        rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for low, most, size in KINDS:
            line = np.flatnonzero((self.count[which] >= low) & (self.count[which] <= most))
            if not len(line):
                continue
            n = self.count[which[line]] - size + 1
            first = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(self.begin[which[line]] - first, n)
            left = self._span(at, at + size) + np.uint64(size)
            for _ in range(RUNS):
                least = np.minimum.reduceat(left, first)
                some = least != _NONE
                rows.append(line[some])
                keys.append(least[some])
                left[left == np.repeat(least, n)] = _NONE
        short = np.flatnonzero(self.count[which] <= SHORT)
        of, ends = [], []
        for k, text in zip(short.tolist(), self.texts(which[short]), strict=True):
            for low, most, size in ENDS:
                if low <= len(text) <= most:
                    of += [k, k]
                    ends += [int.from_bytes(blake2b(x, digest_size=8).digest()) for x in (b"^" + text[:size], b"$" + text[-size:])]
        row = np.concatenate([*rows, np.array(of, np.int64)])
        order = np.argsort(row, kind="stable")
        return row[order], np.concatenate([*keys, np.array(ends, np.uint64)])[order].view(np.int64)

    def simhash(self, which: np.ndarray) -> np.ndarray:
        """SimHash of the lines numbered by which: bit k is set if it is in the hashes of more than half of the words. 0 for short lines."""
        out = np.zeros(len(which), np.int64)
        long = self.count[which] > SHORT
        which = which[long]
        if not len(which):
            return out
        word, little = self.word.copy(), np.flatnonzero(self.ends - self.starts <= 3)
        after = np.append(self.word[1:], np.uint64(0))
        after[self.begin + self.count - 1] = 0
        word[little] = mix(word[little] * _PAIR + after[little])
        n = self.count[which]
        first = np.cumsum(n) - n
        at = np.repeat(self.begin[which] - first, n) + np.arange(int(n.sum()))
        # Sums of up to 255 words fit the bytes of one number; longer lines are summed in parts.
        cut = np.concatenate([np.arange(f, f + k, 255) for f, k in zip(first, n, strict=True)]) if n.max() > 255 else first
        own = word[at].view(np.uint8).reshape(-1, 8)
        lanes = np.stack([np.add.reduceat(_LANES[own[:, k]], cut) for k in range(8)], axis=1)
        sums = lanes.view(np.uint8)
        if n.max() > 255:
            sums = np.add.reduceat(sums, np.searchsorted(cut, first), axis=0, dtype=np.int64)
        out[long] = np.packbits(sums * np.int64(2) > n[:, None], axis=1).view(np.int64).ravel() & -2 | (n <= MEDIUM)
        return out

    def texts(self, which: np.ndarray) -> list[bytes]:
        """The lines in normal form."""
        raw, out = self.data.tobytes(), []
        for i in which:
            w = slice(self.begin[i], self.begin[i] + self.count[i])
            out.append(b" ".join(raw[a:b] for a, b in zip(self.starts[w].tolist(), self.ends[w].tolist(), strict=True)))
        return out


def block_keys(sim: np.ndarray, block: int) -> np.ndarray:
    own = (sim.view(np.uint64) >> np.uint64(BLOCKS[block])) & np.uint64((1 << WIDTH) - 1)
    return mix((np.uint64(block + 1) << np.uint64(WIDTH)) | own).view(np.int64)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of SimHashes are within the radius."""
    medium = ((a | b) & np.uint64(1)).astype(bool)
    return (np.bitwise_count((a ^ b) >> np.uint64(1)) <= np.where(medium, WIDER, RADIUS)) | (a == 0) | (b == 0)


def middles(a: str, b: str) -> tuple[str, str]:
    """The texts without what both begin and both end with, the longer one first: their distance is the same."""
    i = _common(a, b, 1)
    a, b = a[i:], b[i:]
    j = _common(a, b, -1)
    a, b = a[: len(a) - j], b[: len(b) - j]
    return (a, b) if len(a) >= len(b) else (b, a)


def quick(a: str, b: str, most: int) -> bool:
    """Whether one way to edit whole words shows a distance of at most ``most``; a is the longer one."""
    return len(a) <= most or word_edits(a.split(" "), b.split(" "), most) <= most


def word_edits(x: list[str], y: list[str], most: int) -> int:
    """An upper bound of the edit distance, or any number above most: where words differ, both go on from the next two equal words within reach."""
    i = j = cost = 0
    m, n = len(x), len(y)
    x, y = [*x, "", ""], [*y, "", ""]  # so that the ends are equal words, too
    while i < m or j < n:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _REACH:
            if i + p <= m and j + q <= n and x[i + p] == y[j + q] and x[i + p + 1] == y[j + q + 1]:
                break
        else:
            return most + 1
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        if cost > most:
            return cost
        i, j = i + p, j + q
    return cost


def bound(a: str, b: str, similarity: float = SIMILARITY) -> int:
    """The most edits of two texts that are similar."""
    return int((1 - similarity) * max(len(a), len(b)) + 1e-9)


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length is at least similarity."""
    most = bound(a, b, similarity)
    a, b = middles(a, b)
    return len(a) - len(b) <= most and (quick(a, b, most) or int(distances([(a, b)])[0]) <= most)


def _common(a: str, b: str, way: int) -> int:
    """Length of the longest common prefix (way 1) or suffix (way -1), by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid] if way > 0 else a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            high = mid - 1
    return low


def batches(sides: list[tuple[str, str]]) -> Iterator[list[int]]:
    """The places of (longer, shorter) texts in batches of like length, the longest first, that are computed at once."""
    order = sorted(range(len(sides)), key=lambda k: (-len(sides[k][1]), -len(sides[k][0])))
    at = 0
    while at < len(order):
        most = len(sides[order[at]][1])
        to, size = at + 1, len(sides[order[at]][0])
        while to < len(order) and to - at < WIDE and 4 * len(sides[order[to]][1]) >= 3 * most and (size := size + len(sides[order[to]][0])) <= LONG:
            to += 1
        yield sorted(order[at:to], key=lambda k: -len(sides[k][0]))
        at = to


def distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Edit distances by bit-parallel columns (Myers), many pairs of like length at once."""
    sides = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    out = np.zeros(len(pairs), np.int64)
    for some in batches(sides):
        out[some] = _lanes([sides[k] for k in some])
    return out


def _lanes(sides: list[tuple[str, str]], most: list[int] | None = None) -> list[int]:
    """Edit distances of (longer, shorter) texts; each pair has its lane of whole bytes in the same long numbers.

    A lane has a bit for each character of the shorter text and a spare one, into which sums and shifts run over. Lanes
    stand by the length of the longer text, and go from the high end when it is read. most: of a pair whose distance is
    above its number, any number above that may be given; its lane goes once no way to the end can cost less.
    """
    out = [len(a) for a, _ in sides]
    order = sorted((k for k, (_, b) in enumerate(sides) if b), key=lambda k: -len(sides[k][0]))
    tables, ends, full, ones, at = [], [], 0, 0, 0
    for k in order:
        a, b = sides[k]
        size = len(b) // 8 + 1
        bits: dict[str, int] = {}
        for i, c in enumerate(b):
            bits[c] = bits.get(c, 0) | 1 << i
        table = {c: x.to_bytes(size, "little") for c, x in bits.items()}
        none = bytes(size)
        tables.append(iter([table.get(c, none) for c in a]))
        full |= ((1 << len(b)) - 1) << (8 * at)
        ones |= 1 << (8 * at)
        at += size
        ends.append(at)
    pv, mv, step = full, 0, 0
    every = max(32, len(sides[order[0]][0]) // 12) if order else 0
    while order:
        live = len(order)
        for column in zip_longest(*tables, fillvalue=b""):
            step += 1
            eq = int.from_bytes(b"".join(column), "little")
            xv = eq | mv
            xh = ((((eq & pv) + pv) ^ pv) | eq) & full
            ph, mh = mv | (full ^ (xh | pv)), pv & xh
            ph = ((ph << 1) | ones) & full
            pv, mv = ((mh << 1) & full) | (full ^ (xv | ph)), ph & xv
            left = live
            while left and len(sides[order[left - 1]][0]) == step:
                left -= 1
            if left < live:
                # The last column's steps down add up to the distance.
                low = ends[left - 1] if left else 0
                up, down = (x.to_bytes(ends[live - 1], "little") for x in (pv, mv))
                for n in range(left, live):
                    own = slice(ends[n - 1] if n else 0, ends[n])
                    out[order[n]] += int.from_bytes(up[own], "little").bit_count() - int.from_bytes(down[own], "little").bit_count()
                rest = (1 << (8 * low)) - 1
                pv, mv, full, ones, live = pv & rest, mv & rest, full & rest, ones & rest, left
                if not live:
                    break
            if most is not None and step % every == 0:
                least = _least(pv, mv, [sides[k] for k in order[:live]], ends[:live], step)
                stay = [n for n in range(live) if least[n] <= most[order[n]]]
                if 8 * len(stay) <= 7 * live:
                    break
        if not live:
            return out
        for n in range(live):
            out[order[n]] = int(least[n])
        pv, mv, full, ones = (_only(x, stay, ends) for x in (pv, mv, full, ones))
        ends = np.cumsum([ends[n] - (ends[n - 1] if n else 0) for n in stay]).tolist()
        order, tables = [order[n] for n in stay], [tables[n] for n in stay]
        for k in order:
            out[k] = len(sides[k][0])
    return out


def _distances_within(sides: list[tuple[str, str]], most: list[int]) -> list[int]:
    """As ``_lanes``, on arrays of 64-bit words, all words of all pairs at once.

    A word stands for 64 characters of a shorter text. At a step it is one column behind the word above it, whose lowest
    row it goes on from, so that no word waits for another one of its column (blocks of Hyyrö, 2003).
    """
    wide = len(sides)
    if wide < FEW or not all(b for _, b in sides):
        return _lanes(sides, most)
    words, columns = -(-max(len(b) for _, b in sides) // 64), max(len(a) for a, _ in sides)
    long, short = (np.array([len(x[k]) for x in sides]) for k in (0, 1))
    lane = np.repeat(np.arange(wide), short)
    row = np.arange(len(lane)) - np.repeat(np.cumsum(short) - short, short)
    code = np.frombuffer("".join(b for _, b in sides).encode("utf-32-le"), np.uint32).astype(np.int64)
    kinds, back = np.unique(lane << 32 | code, return_inverse=True)
    begin = np.searchsorted(kinds, np.arange(wide) << 32)
    place = np.arange(1, len(kinds) + 1) - begin[kinds >> 32]  # a character's number in its lane; 0: not there
    size = words * wide
    if (int(place.max()) + 1) * size > MOST_WORDS:
        return _lanes(sides, most)
    table = np.zeros((int(place.max()) + 1) * size, np.uint64)
    np.bitwise_or.at(table, place[back] * size + (row >> 6) * wide + lane, np.uint64(1) << (row & 63).astype(np.uint64))
    other = np.repeat(np.arange(wide), long)
    code = np.frombuffer("".join(a for a, _ in sides).encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.minimum(np.searchsorted(kinds, other << 32 | code), len(kinds) - 1)
    known = kinds[at] == other << 32 | code
    # The table's row of each column's character, the last column first.
    of = np.zeros((columns + words, wide), np.int64)
    of[len(of) - 1 - (np.arange(len(other)) - np.repeat(np.cumsum(long) - long, long)), other] = np.where(known, place[at], 0) * size
    of += np.arange(wide)
    below = (np.arange(words) * wide)[:, None]
    pv, mv = np.full((words, wide), _NONE), np.zeros((words, wide), np.uint64)
    up, down = np.zeros((words + 1, wide), np.uint64), np.zeros((words + 1, wide), np.uint64)
    up[0] = 1
    score = np.repeat(64 * np.arange(1, words + 1)[:, None], wide, axis=1)
    out, last, left = np.zeros(wide, np.int64), (short - 1) >> 6, np.arange(wide)
    end = long + last
    ends, every, limit = set(end.tolist()), max(32, columns // 8), np.array(most)
    top, one = np.uint64(63), np.uint64(1)
    for step in range(1, int(end.max()) + 1):
        k = min(step, words)
        eq = table.take(of[len(of) - step : len(of) - step + k] + below[:k])
        p, m, u, d = pv[:k], mv[:k], up[:k], down[:k]
        xv = eq | m
        eq |= d
        xh = eq & p
        xh += p
        xh ^= p
        xh |= eq
        ph = xh | p
        np.invert(ph, out=ph)
        ph |= m
        xh &= p
        hp, hm = ph >> top, xh >> top
        ph <<= one
        ph |= u
        xh <<= one
        xh |= d
        np.bitwise_and(ph, xv, out=m)
        ph |= xv
        np.invert(ph, out=ph)
        np.bitwise_or(xh, ph, out=p)
        up[1 : k + 1], down[1 : k + 1] = hp, hm
        score[:k] += hp.view(np.int64)
        score[:k] -= hm.view(np.int64)
        if step in ends:
            done = np.flatnonzero(end == step)
            w = last[done]
            # The last word's rows below the text's end.
            spare = np.where(short[done] & 63, _NONE << (short[done] & 63).astype(np.uint64), np.uint64(0))
            out[left[done]] = score[w, done] - np.bitwise_count(pv[w, done] & spare) + np.bitwise_count(mv[w, done] & spare).astype(np.int64)
        if step % every == 0 and step >= words:
            # From a cell on, the rest costs its difference in length at least; every eighth row is looked at, between which it falls by 8 at most.
            change = np.bitwise_count(pv.T.copy().view(np.uint8)).astype(np.int64) - np.bitwise_count(mv.T.copy().view(np.uint8))
            inner = np.cumsum(change.reshape(len(left), words, 8), axis=2)
            cost = (score.T - inner[:, :, 7])[:, :, None] + np.concatenate((np.zeros((len(left), words, 1), np.int64), inner), axis=2)
            rows = 64 * np.arange(words)[:, None] + 8 * np.arange(9)
            rest = (long[:, None] - step + np.arange(words))[:, :, None] - (short[:, None, None] - rows)
            cost += np.abs(rest)
            cost[(rows - 8 > short[:, None, None]) | (rest + short[:, None, None] - rows < 0)] = 1 << 40
            least = np.min(cost, axis=(1, 2)) - 9
            over = (least > limit[left]) & (end > step)
            out[left[over]] = least[over]
            stay = np.flatnonzero(~over & (end > step))
            if not len(stay):
                break
            if 8 * len(stay) <= 7 * len(left):
                # Fewer lanes: the table keeps its places.
                pv, mv, up, down, score, of = (np.ascontiguousarray(x[:, stay]) for x in (pv, mv, up, down, score, of))
                left, long, short, last, end = left[stay], long[stay], short[stay], last[stay], end[stay]
            else:
                end = np.where(over, 0, end)
            ends = set(end.tolist())
    return out.tolist()


def _least(pv: int, mv: int, sides: list[tuple[str, str]], ends: list[int], step: int) -> np.ndarray:
    """The least that each lane's distance can be, after so many columns: from any of their cells the rest costs its difference in length."""
    up, down = (np.unpackbits(np.frombuffer(x.to_bytes(ends[-1], "little"), np.uint8), bitorder="little").astype(np.int8) for x in (pv, mv))
    # The bits of a lane below its text's end are those of rows from 1; its spare ones repeat the last row.
    rows = np.concatenate(([0], np.cumsum(up - down, dtype=np.int64)))
    begin = 8 * np.array([0, *ends[:-1]])
    width = np.diff(8 * np.array([0, *ends]))
    short, rest = np.array([len(b) for _, b in sides]), np.array([len(a) - step for a, _ in sides])
    number = np.arange(1, len(rows)) - np.repeat(begin, width)
    cost = step + rows[1:] - np.repeat(rows[begin], width) + np.abs(np.repeat(short, width) - np.minimum(number, np.repeat(short, width)) - np.repeat(rest, width))
    return np.minimum(np.minimum.reduceat(cost, begin), step + np.abs(short - rest))


def _only(x: int, stay: list[int], ends: list[int]) -> int:
    """The lanes in stay, side by side."""
    raw = x.to_bytes(ends[-1], "little")
    return int.from_bytes(b"".join(raw[ends[n - 1] if n else 0 : ends[n]] for n in stay), "little")


def letters(text: list[str]) -> np.ndarray:
    """How often each text has the characters of each of so many bins."""
    code = np.frombuffer("".join(text).encode("utf-32-le"), np.uint8)[::4] & (BINS - 1)
    row = np.repeat(np.arange(len(text), dtype=np.int32) * BINS, [len(x) for x in text])
    return np.bincount(row + code, minlength=len(text) * BINS).astype(np.int32).reshape(-1, BINS)


def may_be(counts: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs can be within most edits: an edit takes away at most one character, and adds at most one."""
    ok = np.ones(len(i), bool)
    for at in range(0, len(i), 1 << 13):
        own = slice(at, at + (1 << 13))
        off = counts[i[own]] - counts[j[own]]
        more = np.maximum(off, 0).sum(1)
        ok[own] = np.maximum(more, more - off.sum(1)) <= most[own]
    return ok


def verify(t: pa.Table, pairs: Iterator[tuple[np.ndarray, np.ndarray]], groups: _blocks.Groups, similarity: float) -> None:
    """Joins the rows of similar pairs in groups, by their texts."""
    text = [x.decode() for x in t["data"].to_pylist()]
    size = np.array([len(x) for x in text], np.int64)
    counts = letters(text)
    asked: list[tuple[int, int, int]] = []
    sides: list[tuple[str, str]] = []
    held = 0

    def settle() -> None:
        for some in batches(sides):
            some = [k for k in some if groups.label[asked[k][0]] != groups.label[asked[k][1]]]
            for k, d in zip(some, _distances_within([sides[k] for k in some], [asked[k][2] for k in some]), strict=True):
                if d <= asked[k][2]:
                    groups.join(*asked[k][:2])
        asked.clear()
        sides.clear()

    for i, j in pairs:
        most = ((1 - similarity) * np.maximum(size[i], size[j]) + 1e-9).astype(np.int64)
        fit = np.flatnonzero((np.abs(size[i] - size[j]) <= most) & (groups.label[i] != groups.label[j]))
        fit = fit[may_be(counts, i[fit], j[fit], most[fit])]
        for x, y, m in zip(i[fit].tolist(), j[fit].tolist(), most[fit].tolist(), strict=True):
            if groups.label[x] != groups.label[y]:
                own = middles(text[x], text[y])
                if quick(*own, m):
                    groups.join(x, y)
                else:
                    asked.append((x, y, m))
                    sides.append(own)
                    held += len(own[0]) + len(own[1])
                    if len(asked) >= AT_ONCE or held >= MANY:
                        settle()
                        held = 0
    settle()


def duplicate_lines(docs: DataFrame, scratch: _spark.Scratch, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", row_col: str = "row") -> tuple[DataFrame, DataFrame]:
    """((row, lines array<int>) of the lines to remove, (row, line, group) of all lines that have another in their group).

    docs has the columns row_col, id_col and text_col; lines are numbered from 0 between newlines; group is a line's hash.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                lines = Lines(b.column("text"))
                # What pairs are found by stands with the first of a task's equal lines only.
                new = np.array([i for i, h in enumerate(lines.hash.tolist()) if not (h in seen or seen.add(h))], np.int64)
                at = np.full(len(lines.hash), -1)
                at[new] = np.arange(len(new))
                at = pa.array(at, mask=at < 0)
                row, key = lines.runs(new)
                keys = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(new) + 1)).astype(np.int32)), pa.array(key)).take(at)
                sim = pa.array(lines.simhash(new)).take(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(pa.array(lines.doc)), b.column("id").take(pa.array(lines.doc)), pa.array(lines.number.astype(np.int32)), pa.array(lines.hash), sim, keys],
                    ["row", "id", "line", "h", "sim", "runs"],
                )

    every = scratch.cut(texts.mapInArrow(found, f"row long, id {kind}, line int, h long, sim long, runs array<long>"), "lines")
    able = every.where("sim is not null").select("h", "sim", "runs")

    def keyed(hot):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h, sim, runs = b.column("h").to_numpy(), b.column("sim").to_numpy(), b.column("runs")
                hashed = np.flatnonzero(sim)
                of = np.concatenate([pc.list_parent_indices(runs).to_numpy(), np.tile(hashed, len(BLOCKS))])
                key = np.concatenate([pc.list_flatten(runs).to_numpy(), *(block_keys(sim[hashed], t) for t in range(len(BLOCKS)))])
                rows, key = _blocks.split_hot(key, h[of], hot)
                take = of[rows]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h[take]), pa.array(sim[take])], ["key", "id", "sim"])

        return run

    cols = "key long, id long, sim long"
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    hot = _blocks.hot_keys(able.where(F.pmod(F.xxhash64("h"), F.lit(_blocks.SAMPLE)) == 0).mapInArrow(keyed(none), cols), PART)

    def candidates(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows within the radius; row by row for large groups."""
        sim = t["sim"].to_numpy().view(np.uint64)
        i, j, large = _blocks.pairs_of(t["key"].to_numpy(), 32)
        for k in range(0, len(i), 1 << 18):
            p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            ok = near(sim[p], sim[q])
            yield p[ok], q[ok]
        for a, b in large:
            for k in range(a, b - 1):
                j = k + 1 + np.flatnonzero(near(sim[k + 1 : b], sim[k]))
                if len(j):
                    yield np.full(len(j), k), j

    def partnered(t: pa.Table) -> Iterator[pa.RecordBatch]:
        # A line stands once for each task that has it.
        t = t.combine_chunks()
        key, h = t["key"].to_numpy(), t["id"].to_numpy()
        shared = np.zeros(len(key), bool)
        shared[1:] = key[1:] == key[:-1]
        shared[:-1] |= shared[1:]
        at = np.flatnonzero(shared)
        at = at[np.lexsort((h[at], key[at]))]
        new = np.ones(len(at), bool)
        new[1:] = (h[at][1:] != h[at][:-1]) | (key[at][1:] != key[at][:-1])
        t = t.take(pa.array(at[new])).combine_chunks()
        hit = np.zeros(len(t), bool)
        for i, j in candidates(t):
            hit[i] = hit[j] = True
        yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    hits = scratch.cut(_blocks.grouped(able.mapInArrow(keyed(hot), cols), "key", partnered, cols, rows=50_000), "hits")
    distinct = scratch.cut(every.groupBy("h").agg(F.count("*").alias("n"), F.min("row").alias("row")), "distinct")

    def spelled(ids: DataFrame) -> DataFrame:
        # One document of each line is read again.
        places = distinct.join(ids.withColumnRenamed("id", "h"), "h", "left_semi")
        places = scratch.cut(places.select("row", F.col("h").bitwiseXOR(F.shiftleft("row", 23)).alias("place")), "places")
        bits = spark.sparkContext.broadcast((_blocks.bloom(places, "row"), _blocks.bloom(places, "place")))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, here = bits.value
            for batch in batches:
                batch = batch.filter(pa.array(_blocks.in_bloom(rows, batch.column("row").to_numpy())))
                for b in pieces(batch, "text", 1 << 20) if len(batch) else ():
                    lines = Lines(b.column("text"))
                    maybe = np.flatnonzero(_blocks.in_bloom(here, lines.hash ^ (b.column("row").to_numpy()[lines.doc] << 23)))
                    _, once = np.unique(lines.hash[maybe], return_index=True)
                    which = maybe[once]
                    yield pa.RecordBatch.from_arrays([pa.array(lines.hash[which]), pa.array(lines.texts(which), pa.binary())], ["id", "data"])

        return texts.select("row", "text").mapInArrow(read, "id long, data binary")

    roots = _links.link(scratch, hits, "sim long", candidates, spelled, lambda t, pairs, groups: verify(t, pairs, groups, similarity))
    # Of lines that stand more than once or have alike ones, all but their group's first occurrence go.
    named = distinct.join(roots.withColumnRenamed("node", "h"), "h", "left").where("n > 1 or root is not null")
    named = scratch.cut(named.select("h", F.coalesce("root", "h").alias("group")), "named")
    shared = scratch.cut(every.select("row", "id", "line", "h").join(named, "h").select("row", "id", "line", "group"), "repeated")
    first = scratch.cut(shared.groupBy("group").agg(F.min(F.struct("id", "row", "line")).alias("stays")), "first")
    scratch.drop("lines", "hits", "distinct", "places", "named")
    gone = shared.join(first, "group").where("row <> stays.row or line <> stays.line").groupBy("row").agg(F.collect_list("line").alias("lines"))
    return gone, shared.select("row", "line", "group")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines cut out of text_col, and the columns n_lines (between newlines) and n_removed.

    Where docs has columns of these names, the new ones have underscores before theirs.
    """
    scratch = _spark.Scratch(docs.sparkSession)
    row, lines, n_lines, n_removed = _spark.fresh(docs.columns, "row", "lines", "n_lines", "n_removed")
    rows = _spark.with_rows(docs, scratch, row)
    gone, _ = duplicate_lines(rows, scratch, similarity, id_col, text_col, row)
    joined = rows.join(gone.toDF(row, lines), row, "left").drop(row)
    at = joined.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, k = [], [], []
            for t, gone in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                parts = t.split("\n") if t else []
                n.append(len(parts))
                k.append(len(gone or ()))
                if gone:
                    drop = set(gone)
                    t = "\n".join(p for i, p in enumerate(parts) if i not in drop)
                texts.append(t)
            kept = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(k, pa.int64())], [*b.schema.names[:-1], n_lines, n_removed])

    schema = T.StructType([*joined.drop(lines).schema, T.StructField(n_lines, T.LongType()), T.StructField(n_removed, T.LongType())])
    return joined.mapInArrow(cut, schema)
