"""Intent scoring against plain Python over the texts: phrases across fields, repeats, empty phrases, groups, negations."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomrec.operators import description_scoring as D
from loomrec.sources import manifests as M

FIELDS = [D.Field("title", 5.0, "title"), D.Field("main", 4.0, "category"), D.Field("cats", 2.5, "category"), D.Field("body", 0.4, "body")]
RECORD, INTENT = "id long, title string, main string, cats array<string>, body string", "query long, kind string, grp int, phrase string"


def toks(x):
    x = " ".join(x) if isinstance(x, list) else x or ""
    return [t.lower() for t in re.findall("[A-Za-z0-9]+", x) if len(t) > 1 and t.lower() not in D.GENERIC]


def brute(records, intents):
    texts = {r[0]: [toks(x) for x in r[1:]] for r in records}
    has = lambda words, phrase: bool(toks(phrase)) and f" {' '.join(toks(phrase))} " in f" {' '.join(words)} "
    out = {}
    for q in {i[0] for i in intents}:
        of = lambda kind: [p for qq, k, _, p in intents if qq == q and k == kind]  # noqa: E731, B023
        asked = {t for qq, _, _, p in intents if qq == q for t in toks(p)}
        core_tokens = {t for p in of("core") for t in toks(p)}
        groups = {g for qq, k, g, _ in intents if qq == q and k == "any"}
        for doc, parts in texts.items():
            full, title, cat = sum(parts, []), parts[0], parts[1] + parts[2]
            if not asked & set(full):
                continue
            score = 0.0
            for f, words in zip(FIELDS, parts):
                for t in asked & set(words):
                    df = sum(t in sum(p, []) for p in texts.values())
                    tf = words.count(t)
                    score += (3 if t in core_tokens else 1) * math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2) * f.weight
            score += sum(60 if has(title, p) else 25 if has(full, p) else 0 for p in of("intent"))
            score += sum(28 if has(title, p) else -55 + (5 if has(full, p) else -90) for p in of("core"))
            met = any(has(cat, p) for p in of("category"))
            score += 45 if met else -20 if of("category") else 0
            negative = [p for p in of("negative") if has(full, p)]
            score += sum(-120 if has(title, p) else -80 for p in negative)
            must = all(has(full, p) for p in of("must")) and all(any(has(full, p) for qq, k, gg, p in intents if (qq, k, gg) == (q, "any", g)) for g in groups)
            score += 0 if must else -120
            out[q, doc] = (score, must, must and not negative and (met or not of("category")))
    return out


def check(got, want):
    got = {(r["query"], r["doc"]): r for r in got.collect()}
    assert got.keys() == want.keys()
    for key, (score, must, strict) in want.items():
        assert got[key]["score"] == pytest.approx(score, abs=1e-4) and (got[key]["required_pass"], got[key]["strict_pass"]) == (must, strict), key


def test_equals_texts(spark, tmp_path):
    rng = random.Random(4)
    words = "red tea cup lid pot box the of Big, x".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    records = [(i, some(6), some(3), [some(3), some(3)], some(12)) for i in range(80)] + [(90, None, None, None, None), (91, "red red tea", None, ["tea", None], "")]
    intents = [(q, kind, g, some(4)) for q in range(8) for kind in D.KINDS for g in range(rng.randrange(3))]
    intents += [(8, "core", 0, "red tea"), (8, "core", 0, "red tea"), (8, "must", 0, "the"), (9, "negative", 0, "tea tea"), (9, "category", 0, "cup lid"), (10, "description", 0, "absent")]
    plain = [(r[0], r[1], r[2], [c for c in r[3] if c] if r[3] else None, r[4]) for r in records]
    df, ask = spark.createDataFrame(records, RECORD), spark.createDataFrame(intents, INTENT)
    positions = D.positional_postings(df, "id", FIELDS)
    want = brute(plain, intents)
    check(D.score_intents(positions, ask, FIELDS, len(records), 1000), want)
    root = str(tmp_path / "ix")
    D.store_positions(positions, root, len(records), buckets=8, block_rows=20)
    kept, n = D.stored_positions(spark, root, ask)
    assert n == len(records)
    check(D.score_intents(kept, ask, FIELDS, n, 1000), want)
    best = D.score_intents(kept, ask, FIELDS, n, 2).filter("query = 0").orderBy("rank").collect()
    assert [(r["rank"], r["doc"]) for r in best] == [(n, d) for n, (_, d) in enumerate(sorted((-round(s, 4), d) for (q, d), (s, *_) in want.items() if q == 0)[:2], 1)]
    one, _ = D.stored_positions(spark, root, spark.createDataFrame([(1, "core", 0, "lid")], INTENT))
    assert one.count() < positions.count() and M.versions(spark, root) == [1]


def test_empty_and_unknown(spark):
    records, ask = spark.createDataFrame([(1, "red", None, None, None)], RECORD), spark.createDataFrame([(1, "core", None, "red"), (2, "any", None, None)], INTENT)
    positions = D.positional_postings(records, "id", FIELDS)
    assert [(r["query"], r["doc"]) for r in D.score_intents(positions, ask, FIELDS, 1, 5).collect()] == [(1, 1)]
    assert D.score_intents(positions, ask.limit(0), FIELDS, 1, 5).count() == 0
    assert D.score_intents(positions.limit(0), ask, FIELDS, 0, 5).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        D.score_intents(positions, ask.withColumn("kind", F.lit("other")), FIELDS, 1, 5).count()
