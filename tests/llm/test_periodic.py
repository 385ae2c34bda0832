"""Runs of periodic words against comparison of every period at every place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loomrec.llm import periodic
from loomrec.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, start long, period string, n_runs double"


def plain_runs(w):
    n, seen = len(w), {}
    a = np.array([hash(x) for x in w], np.int64)
    for p in range(1, n // 4 + 1):
        eq = np.concatenate(([0], a[p:] == a[:-p], [0])).astype(int)
        edges = np.diff(eq)
        for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            if e - s + p >= max(6, 4 * p):
                seen.setdefault((int(s), int(e - s + p)), p)
    return sorted((s, n, p) for (s, n), p in seen.items())


def plain(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in sorted(runs, key=lambda r: (r[0], r[2])))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def key(r):
    return (r[0] is None, r[0] or 0, r[6], r[7])


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()), key=key)
    assert got == sorted((plain(r["doc_id"], r["text"]) for r in docs), key=key)
    assert any(r[1] for r in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b a b a b a b c"), (None, None), (4, "x " * 5), (4, "x " * 6), (4, "x " * 6), (5, "é\xa0e é\xa0e " * 9)]
    rows += [(6, "a b c d " * 4000 + "tail"), (7, "\x1c a\x85b " * 8), (10, " ".join(f"w{i}" for i in range(5000)))]
    df = spark.createDataFrame([(d, t, 1, "x", 0.5) for d, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in periodic.periodic_digest(df).collect()), key=key) == sorted((plain(*r) for r in rows), key=key)
    assert periodic.periodic_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_and_nested_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            w = [b"%d" % rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 120))]
            if rng.random() < 0.5:
                unit = [b"%d" % rng.randrange(3) for _ in range(rng.randint(1, 6))] * rng.randint(3, 8)
                gap = [b"%d" % rng.randrange(3) for _ in range(5)]
                w = (unit + gap + unit + gap[::-1] + gap + unit) * rng.randint(1, 5) + w[: rng.randint(0, 9)]
            texts.append(w)
        assert periodic.runs_of(*periodic.numbered(texts)) == [plain_runs(t) for t in texts]


def test_factors_blocks_and_copies():
    text = b"a b a b a b x y a b a b q a b a b x y a b".split()
    ids, bounds = periodic.numbered([text, text])
    ranks = periodic.Ranks(ids, np.repeat(bounds[:-1], 21), np.repeat(bounds[1:], 21))
    lpf, source = periodic.longest_previous_factors(ranks, periodic.common_prefixes(ranks))
    for i in range(42):
        d, n = i // 21 * 21, 21
        longest = 0
        for j in range(d, i):
            m = 0
            while i + m < d + n and text[(i + m) % 21] == text[(j + m) % 21]:
                m += 1
            longest = max(longest, m)
        assert lpf[i] == longest and (not longest or (ids[source[i] : source[i] + longest] == ids[i : i + longest]).all() and d <= source[i] < i)
    starts = periodic.blocks_of(lpf)
    assert starts.tolist()[:4] == [0, 1, 2, 6] and 21 in starts
    assert periodic.with_copies([(2, 9, 1)], [(20, 12, 0), (40, 8, 1), (60, 9, 1)]) == [(2, 9, 1), (22, 29, 1), (61, 68, 1)]


def test_long_periodic_text():
    for w in ([b"a"] * 100_000, [b"%d" % (i % 5000) for i in range(60_000)]):
        p = 1 if w[0] == w[1] else 5000
        assert periodic.runs_of(*periodic.numbered([w])) == [[(0, len(w), p)]]
