"""The rounds over bands: crowded bands of unlike texts, near copies, copies, empty texts, against all pairs."""

from __future__ import annotations

import random

import pytest

from loomrec.llm import simhash


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """Smallest id of each text's component over 4-bit fingerprints and a similarity of 0.8."""
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fp, sets = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}, {i: shingles(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if i < j and (bin(fp[i] ^ fp[j]).count("1") <= 4 or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("growth", [2, 8])
def test_crowded_bands(spark, monkeypatch, growth):
    monkeypatch.setattr(simhash, "HEAD_GROWTH", growth)
    rng = random.Random(growth)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [word() for _ in range(140)]
    texts = {}
    for g in range(25):  # two thirds of each text are shared: many unlike texts meet in a band
        own = shared + [word() for _ in range(70)]
        for copy in range(rng.randrange(1, 5)):
            near = list(own)
            for _ in range(copy):
                near[rng.randrange(len(near))] = word()
            texts[len(texts) * 3 + 1] = " ".join(near)
    texts |= {500: "", 501: "  ", 502: texts[1], 503: "one two"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(600, None)], "doc_id long, text string")
    marked = simhash.fingerprints(df.filter("doc_id < 500"), ["doc_id"], banded=True)
    crowd = max(r["count"] for r in marked.selectExpr("explode(bands) as key").groupBy("key").count().collect())
    assert crowd > 9
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    want = brute(texts) | {600: 500}
    assert got == want and len(set(want.values())) > 15


def test_links_and_classes_do_not_pass_through_the_driver(spark):
    df = spark.createDataFrame([(i, f"one two three four five {i % 7}") for i in range(40)], "doc_id long, text string")
    out = simhash.near_duplicate_digest(df)
    assert out.count() == 40
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_texts_that_share_a_passage_are_not_paired(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(100000)}"
    passage = [word() for _ in range(150)]
    texts = {i: " ".join(passage + [word() for _ in range(60)]) for i in range(60)}
    texts |= {60: texts[7] + " and a few words more"}
    made, keep = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: made.append((name, keep(df, name))) or made[-1][1])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == brute(texts) and got[60] == 7
    assert sum(t.count() for name, t in made if name == "pairs") < 5 * len(texts)
