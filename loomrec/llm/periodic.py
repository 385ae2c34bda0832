"""Maximal repetitions of words by longest previous factors: suffix array and LCP give the LPF array, LPF the Lempel-Ziv blocks;
extensions around block starts find the runs that touch one, copies from earlier text give the rest.

Documents are worked on in blocks of some hundred thousand words, every step an array operation over the whole block. Ranks of
all substrings of length 2^k, kept per k, sort the suffixes and later answer how far two places agree, to the right or left.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomrec.llm.common import small_batches

#: A run is at least this long, in words and in periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Documents are put together until a block has so many words; a longer document is a block of its own.
BLOCK_WORDS = 200_000

Run = tuple[int, int, int]  # start, length, period


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space bytes, which are those that bytes.split() cuts at."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document in ten, by the crc32 of its id (a null id: of the empty text), gets a periodic tail."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a : a + p]
    return words[:a] + (turn * ((n - a) // p + 1))[: n - a]


class Ranks:
    """Order of all suffixes of a block, and ranks of all substrings of 2^k words, none reaching beyond its document."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray):
        """ids: word numbers, distinct between documents; start, end: of the document that a position is in."""
        m = len(ids)
        self.start, self.end = start, end
        self.order = np.argsort(ids, kind="stable")
        rank = np.empty(m, np.int32)
        rank[self.order] = self._heads(ids[self.order], np.arange(m))
        self.levels = [rank]
        slots, h = self._shared(rank[self.order], np.arange(m)), 1
        while len(slots):
            at = self.order[slots]
            beyond = at + h
            inside = beyond < end[at]
            second = np.where(inside, rank[np.where(inside, beyond, 0)].astype(np.int64) + 1, 0)
            key = rank[at].astype(np.int64) * (m + 1) + second
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            self.order[slots] = at
            heads = self._heads(key, slots)
            rank = rank.copy()
            rank[at] = heads
            self.levels.append(rank)
            slots, h = self._shared(heads, slots), h * 2

    @staticmethod
    def _heads(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """For sorted keys the slot where each one's group of equals begins."""
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        return np.maximum.accumulate(np.where(first, slots, 0))

    @staticmethod
    def _shared(heads: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Slots whose group has more than one member."""
        same = np.zeros(len(heads) + 1, bool)
        same[1:-1] = heads[1:] == heads[:-1]
        return slots[same[1:] | same[:-1]]

    def same(self, k: int | np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the 2^k words from i and from j are equal, for i < j. Ranks differ between documents and where a document ends
        before 2^k words; places outside the block equal none."""
        found = np.flatnonzero((i >= 0) & (j < len(self.end)))
        out = np.zeros(len(i), bool)
        for level in [k] if isinstance(k, int) else np.unique(k[found]).tolist():
            if level < len(self.levels):
                some = found if isinstance(k, int) else found[k[found] == level]
                out[some] = self.levels[level][i[some]] == self.levels[level][j[some]]
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            n += self.same(k, i + n, j + n).astype(np.int64) << k
        return n

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i and up to j, both included, are equal."""
        n, low = np.zeros(len(i), np.int64), self.start[j]
        for k in reversed(range(len(self.levels))):
            a, b = i - n - (1 << k) + 1, j - n - (1 << k) + 1
            n += ((a >= low) & self.same(k, a, b)).astype(np.int64) << k
        return n


def common_prefixes(ranks: Ranks) -> np.ndarray:
    """LCP of each suffix and the one before it in order; 0 where they differ in the first word."""
    out, order = np.zeros(len(ranks.order), np.int64), ranks.order
    first = ranks.levels[0][order]
    some = np.flatnonzero(first[1:] == first[:-1]) + 1
    a, b = order[some - 1], order[some]
    out[some] = ranks.forward(np.minimum(a, b), np.maximum(a, b))
    return out


def _nearest_smaller(order: np.ndarray, lcp: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length): for each slot the nearest earlier slot with a smaller position, and the least LCP on the way there.

    Minima over 2^k slots are built once; each slot then walks left by falling powers, past blocks of larger positions.
    """
    m = len(order)
    order, lcp = order.astype(np.int32), lcp.astype(np.int32)
    places, shortest = [np.concatenate((np.array([-1], np.int32), order))], [np.concatenate((np.zeros(1, np.int32), lcp))]  # slot 0 stops every walk
    while (1 << len(places)) <= longest:
        h, p, s = 1 << (len(places) - 1), places[-1], shortest[-1]
        p2, s2 = p.copy(), s.copy()
        p2[h:], s2[h:] = np.minimum(p[h:], p[:-h]), np.minimum(s[h:], s[:-h])
        p2[:h], s2[:h] = -1, 0
        places.append(p2)
        shortest.append(s2)
    at, least = np.arange(m), lcp.copy()
    for k in reversed(range(len(places))):
        go = (places[k][at] > order) & (least > 0)
        least = np.where(go, np.minimum(least, shortest[k][at]), least)
        at = np.where(go, np.maximum(at - (1 << k), 0), at)
    found = places[0][at]
    return found, np.where((found >= 0) & (found < order), least, 0)


def longest_previous_factors(ranks: Ranks, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(LPF, source) per position: length of the longest factor that also begins earlier in the document, and where."""
    order = ranks.order
    heads = np.flatnonzero(np.concatenate((lcp == 0, [True])))
    longest = int(np.diff(heads).max()) if len(heads) > 1 else 1
    left, ll = _nearest_smaller(order, lcp, longest)
    right, rl = _nearest_smaller(order[::-1].copy(), np.concatenate(([0], lcp[:0:-1])), longest)
    right, rl = right[::-1], rl[::-1]
    lpf, source = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    lpf[order], source[order] = np.maximum(ll, rl), np.where(ll >= rl, left, right)
    return lpf, source


def blocks_of(lpf: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks; they never cross documents, as factors don't."""
    following, out, at, m = (np.arange(len(lpf)) + np.maximum(lpf, 1)).tolist(), [], 0, len(lpf)
    while at < m:
        out.append(at)
        at = following[at]
    return np.array(out, np.int64)


def touching_runs(ranks: Ranks, starts: np.ndarray) -> set[Run]:
    """(start, end, period) of the runs that cross or touch a block's start or a document's end.

    A run of e periods that ends in block k and crosses its start b has (e - 1) p < |block k - 1| + |block k|, else the block
    before would have been longer. It holds a period's length to the left or to the right of b: extending the comparison of b with
    b - p, or with b + p, both ways gives all of it.
    """
    m = len(ranks.end)
    lengths = np.diff(np.concatenate((starts, [m])))
    inner = np.flatnonzero(starts != ranks.start[starts])  # blocks after the first of their document
    ends = np.flatnonzero(starts + lengths == ranks.end[starts])  # last blocks: their end is a place to look at too
    b = np.concatenate((starts[inner], (starts + lengths)[ends]))
    low = np.concatenate((ranks.start[starts[inner]], ranks.start[starts[ends]]))
    high = np.concatenate((ranks.end[starts[inner]], ranks.end[starts[ends]]))
    most = np.concatenate((lengths[inner - 1] + lengths[inner] - 1, lengths[ends])) // (LEAST_PERIODS - 1)
    p = np.arange(1, int(most.sum()) + 1) - np.repeat(np.cumsum(most) - most, most)
    b, low, high = np.repeat(b, most), np.repeat(low, most), np.repeat(high, most)
    least = np.maximum(LEAST_WORDS, LEAST_PERIODS * p) - p  # words that must agree, on both sides of b together
    k = np.frexp((least + 1) // 2)[1] - 1  # so one side agrees in 2^k words
    found: dict[tuple[int, int], int] = {}
    for other in (-1, 1):
        i, j = (b - p, b) if other < 0 else (b, b + p)
        ok = (i >= low) & (j <= high)
        near = ranks.same(k, i, np.where(j < high, j, m)) | ranks.same(k, i - (1 << k), np.where(ok, j - (1 << k), m))
        some = np.flatnonzero(ok & near)
        i, j, q = i[some], j[some], p[some]
        right = np.zeros(len(some), np.int64)
        open_ = np.flatnonzero(j < high[some])
        right[open_] = ranks.forward(i[open_], j[open_])
        left = ranks.backward(i - 1, j - 1)
        good = left + right >= least[some]
        for s, e, x in zip((i - left)[good].tolist(), (j + right)[good].tolist(), q[good].tolist()):
            found[s, e] = min(x, found.get((s, e), x))
    return {(s, e, x) for (s, e), x in found.items()}


def with_copies(runs: Iterable[Run], blocks: Iterable[tuple[int, int, int]]) -> list[Run]:
    """All runs of a document, sorted: those given and, block by block, the copies of runs inside a block's earlier occurrence.
    blocks: (start, length, source) in order. Runs are bucketed by start, and copies join them before later starts are looked at."""
    out = sorted(runs)
    for b, length, source in blocks:
        last, x = source + length - 1, bisect_left(out, (source + 1,))
        while x < len(out) and out[x][0] < last:
            s, e, p = out[x]
            if e <= last:  # e is exclusive: the run ends before the block's last word
                insort(out, (s + b - source, e + b - source, p))
            x += 1
    return out


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> list[list[Run]]:
    """Runs (start, length, period) of each document of a block, sorted. ids: word numbers of all documents in turn, distinct
    between documents; bounds: where each begins, and the end of the last."""
    sizes = np.diff(bounds)
    out: list[list[Run]] = [[] for _ in sizes]
    if not len(ids):
        return out
    ranks = Ranks(ids, np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes))
    lpf, source = longest_previous_factors(ranks, common_prefixes(ranks))
    starts = blocks_of(lpf)
    mine: dict[int, list[Run]] = {}
    for run in touching_runs(ranks, starts):
        mine.setdefault(int(np.searchsorted(bounds, run[0], "right")) - 1, []).append(run)
    for d, runs in mine.items():
        own = starts[np.searchsorted(starts, bounds[d]) : np.searchsorted(starts, bounds[d + 1])]
        own = own[lpf[own] >= LEAST_WORDS + 2]
        every = with_copies(runs, zip(own.tolist(), lpf[own].tolist(), source[own].tolist()))
        out[d] = [(s - int(bounds[d]), e - s, p) for s, e, p in every]
    return out


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): words of all texts as numbers, equal only for equal words of one text."""
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    every = [w for t in texts for w in t]
    number = {w: i for i, w in enumerate(dict.fromkeys(every))}
    ids = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    return ids + np.repeat(np.arange(len(texts)), np.diff(bounds)) * len(number), bounds


def digest(words: list[bytes], runs: list[Run]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of one document."""
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = words
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for s, n, p in runs:
            edge[s + p] += 1
            edge[s + n] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SCHEMA.split(", ")])


def periodic_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the longest one, and hashes of all runs and of the text without their repeats.

    docs: (doc_id, text); further columns are dropped. A null or empty text has no words: no runs, four nulls and the hashes of
    the empty string. A null id counts as the empty text in the rule for tails. Repeated rows are each worked on; an empty table
    gives no rows. Map only: no shuffle, each document by itself. Memory follows a block (BLOCK_WORDS words, or one longer
    document): some 8 bytes a word for each power of two up to its longest repeat and to the count of its commonest word.
    """
    small_batches(docs.sparkSession)

    def rows(block: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
        for (doc_id, words), runs in zip(block, runs_of(*numbered([w for _, w in block]))):
            yield (doc_id, *digest(words, runs))

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), ARROW)], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = repeat_tail(words_of(text.as_py()), doc_id)
                block.append((doc_id, words))
                n += len(words)
                if n >= BLOCK_WORDS:
                    yield batch(list(rows(block)))
                    block, n = [], 0
        if block:
            yield batch(list(rows(block)))

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, SCHEMA)
