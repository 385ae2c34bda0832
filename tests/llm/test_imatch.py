"""I-Match fingerprints against a plain version over Python sets."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import regex
import xxhash

from loomrec.llm import imatch
from loomrec.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, term long"
MASK = (1 << 64) - 1


def h64(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def terms(text):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    return {h64(w.encode()) for w in words} or {h64(text.encode())}


def level_of(n):
    x, level = max(1, n * 4 // 32), 0
    while x >= 4 ** (level + 1):
        level += 1
    return level


def stays(t, level):
    return (t >> 5) & (4**level - 1) == 0


def subsets(text, band):
    level = level_of(len(terms(text)))
    mine = {t for t in terms(text) if stays(t, level)}
    mine = (mine & band) or mine

    def digest(found):
        seed = 42
        for t in sorted(found, key=lambda t: t - (1 << 64) if t >> 63 else t):
            seed = h64(t.to_bytes(8, "little"), seed)
        return f"{seed:016x}"[-8:] if found else "-"

    return {level + i: [digest({t for t in mine if t & 31 == r and stays(t, level + i)}) for r in range(32)] for i in (0, 1)}


def text_of(p):
    return "|".join([str(min(p)), *[",".join(p[k]) for k in sorted(p)]])


def like(a, b):
    if text_of(a) == text_of(b):
        return 1.0
    pairs = [x for k in a if k in b for x in zip(a[k], b[k])]
    some = [x for x in pairs if x != ("-", "-")]
    return sum(x[0] == x[1] for x in some) / len(some) if some else 0.0


def plain(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    df = Counter(t for _, text in rows for t in terms(text))
    band = {t for t, n in df.items() if n >= 2 and n <= 0.1 * len(rows)}
    prints = [subsets(t, band) for _, t in rows]
    out = []
    for i, (d, t) in enumerate(rows):
        j = (i + 1) % len(rows)
        cut = len(t) // 4
        edit = t[: len(t) - cut] + rows[j][1][:cut]
        e = subsets(edit, band)
        out.append((d, len(t), hashlib.sha256(edit.encode()).hexdigest(), text_of(prints[i]), text_of(e), like(prints[i], e), like(prints[i], prints[j])))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1:5])


def got(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect()), key=key)


def wanted(rows):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in plain(rows)), key=key)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 0, "z", 5) for d, t in rows], SCHEMA)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = got(QUERIES["op12_imatch_fingerprints"](spark, sf_dir))
    assert found == wanted(rows)
    near = sorted(r[5] for r in found)
    assert near[len(near) // 2] > 0.4 and sum(r[6] for r in found) / len(found) < 0.1


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None)],
        [(1, "a b c d e f g h")],
        [(None, "no id"), (None, "no id either"), (3, "!!! ???"), (3, "!!! ???"), (4, ""), (5, None), (6, "Ünï çödé 漢字 𝔘𝔫𝔦 x"), (7, "one")],
        [(i, "same words in every copy of this text") for i in range(40)] + [(100 + i, f"other words number {i % 7} and {i}") for i in range(40)],
        [(1, " ".join(f"w{i}" for i in range(30000))), (2, " ".join(f"w{i}" for i in range(20000, 50000))), (3, "w1 w2"), (4, "x" * 100000)],
    ],
)
def test_edges(spark, rows):
    assert got(imatch.fingerprints(frame(spark, rows).repartition(3))) == wanted(rows)


def test_equal_texts_have_equal_fingerprints_and_order_of_terms_does_not_count(spark):
    rows = [(i, f"alpha{i % 3} beta{i % 5} gamma delta") for i in range(60)] + [(100 + i, f"delta gamma beta{i % 5} alpha{i % 3}") for i in range(60)]
    by = {}
    for r in imatch.fingerprints(frame(spark, rows)).collect():
        by.setdefault(frozenset(dict(rows)[r["doc_id"]].split()), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())


def test_ranges_count_the_cuts_below(spark):
    from pyspark.sql import functions as F

    cuts = [3, 5, 9, 20, 21]
    rows = spark.range(30).select("id", imatch.range_of(F.col("id"), cuts).alias("p")).collect()
    assert all(r["p"] == sum(c <= r["id"] for c in cuts) for r in rows)
