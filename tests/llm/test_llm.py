"""The corpus operators against brute force, round trips and edge cases on small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from loomrec.llm import class_lm, decontaminate, encoding, packing, pages, pii, quality, sharding, simhash, toxicity
from loomrec.llm.graph import components
from loomrec.llm.queries import QUERIES, tokenizer_path
from loomrec.llm.tokens import PieceEncoder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, label string"
LONG = "alpha beta gamma delta. " * 3000
MIXED = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "The cat sat on the mat. The cat sat on the mat.\nHome | About | Contact | Help\nbye now"),
    (5, "The cat sat on the mat."), (None, "no id here at all"), (6, LONG), (7, LONG), (8, LONG + "tail"), (9, "mail bob@example.com or a@b.c_d@e.fr, 192.168.0.1 999.1.1.1"),
    (10, "card 4111 1111 1111 1111, +1 (988) 555-2485; +12; 4111111111111112"), (11, "you are an idiot and a moron"),
]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None if t is None else len(t), 0.5, 1, "x") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def mixed(spark):
    return frame(spark, MIXED)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


# 1 sharding


def test_curve_visits_every_cell_in_steps_of_one(spark):
    bits = 3
    cells = spark.range(512).selectExpr("cast(id % 8 as int) x", "cast(id div 8 % 8 as int) y", "cast(id div 64 as int) z")
    from pyspark.sql import functions as F

    rows = cells.withColumn("h", sharding.hilbert_index([F.col(c) for c in "xyz"], bits)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(512))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(rows, rows[1:]))


def test_shards_hold_the_law_of_rows(documents, mixed, empty):
    for df in (documents, mixed):
        rows = sharding.document_shards(df).collect()
        assert len(rows) == df.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(s, [])) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1
    by_text = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in sharding.document_shards(documents).collect():
        raw = by_text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    assert sharding.document_shards(empty).count() == 0


# 2 class bigrams


def test_word_hashes_split_as_words_and_lower_only_ascii():
    hasher = class_lm.WordHasher()
    same, ends = hasher.sequence([b"The cat", b"", "\tthe\x0bCAT É".encode(), "é".encode()])
    assert ends.tolist() == [3, 4, 8, 10]
    assert same[0] == same[4] and same[1] == same[5] and same[6] != same[8] and same[2] == same[3] == same[7] == 0


def test_exchange_raises_likelihood_and_finds_two_languages():
    matrix = np.kron(np.eye(2), np.full((4, 4), 10.0)) + 0.1
    cls = class_lm.exchange(matrix, 2, 10)
    assert len(set(cls[:4])) == 1 and len(set(cls[4:])) == 1 and cls[0] != cls[4]


def test_exchange_rounds_raise_the_likelihood_of_all_words(spark, documents):
    from pyspark.sql import functions as F

    train = documents.select(F.col("text").cast("binary").alias("text"))
    counts = class_lm.word_counts(train)
    words = [0, *[r["w"] for r in counts.filter("w != 0").orderBy(F.desc("c"), "w").limit(50).collect()]]
    cls = [i % class_lm.CLASSES for i in range(len(words))]
    contexts = class_lm.context_counts(train, words, cls)
    sums = {r["w"]: r["n"] for r in contexts.filter(F.col("ctx") < class_lm.SIDE).groupBy("w").agg(F.sum("n").alias("n")).collect()}
    assert sums == {r["w"]: r["c"] for r in counts.collect()}
    rng = np.random.default_rng(1)
    start = rng.random((2 * class_lm.SIDE, class_lm.CLASSES)) + 1
    one = class_lm.exchange_all(contexts, start)
    assert one[: class_lm.SIDE].sum() == sum(sums.values()) and class_lm.likelihood(one) > class_lm.likelihood(start)
    assert class_lm.likelihood(class_lm.exchange_all(contexts, one)) >= class_lm.likelihood(one) - 1e-9


def test_scores_match_brute_force_and_beat_the_base_on_held_out_texts(spark, documents, texts, empty):
    got = {r["doc_id"]: r for r in class_lm.class_scores(documents).collect()}
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), None] for d, t in texts}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    assert sum(r["score"] for d, r in got.items() if held[d]) > sum(r["base_score"] for d, r in got.items() if held[d])
    assert class_lm.class_scores(empty).count() == 0
    assert class_lm.class_scores(frame(spark, MIXED)).count() == len(MIXED)


# 3 ids


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 9])
def test_values_round_trip(n):
    v = np.array([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 5], np.uint32)[:n]
    assert encoding.unpack_values(*encoding.pack_values(v), n).tolist() == v.tolist()


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_equal_whole_texts(file, kind, texts):
    from tokenizers import Tokenizer

    enc, plain = PieceEncoder(tokenizer_path(file), kind), Tokenizer.from_file(tokenizer_path(file))
    rng = np.random.default_rng(1)
    alphabet = np.array(["a", " ", "\n", "b'", "1", ".", "é", "\t", "\x1d", "'s", " '", ",", "\x01", " ", "Straße", "word."])
    odd = ["".join(rng.choice(alphabet, rng.integers(0, 14))) for _ in range(2000)]
    for batch in ([t for _, t in texts], odd, ["", "<|endoftext|> a<|endoftext|>"], odd):
        ids, counts = enc.encode(batch)
        for e, c, t in zip(np.cumsum(counts), counts, batch):
            assert ids[e - c : e].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_files_read_back_in_order(documents, mixed, empty):
    for df in (documents, mixed):
        path = tokenizer_path("byte_bpe_50k.json")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        rows = sorted(encoding.ranked_id_digest(df, path).collect(), key=lambda r: r["start"])
        start = 0
        own = defaultdict(list)
        for r in df.collect():
            ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            own[r["doc_id"]].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert ids == sorted(ids)
        for r in rows:
            assert r["start"] == start
            start += r["n_tokens"]
            own[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        assert not any(own.values())
    assert encoding.ranked_id_digest(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_files_are_read_without_their_writer(spark, mixed, tmp_path):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    folder = encoding.ranked_id_files(mixed, path, folder=str(tmp_path / "files"))
    id_of = pq.read_table(f"{folder}/ranks").sort_by("rank").column("id").to_numpy()
    found = []
    for block in pq.read_table(f"{folder}/blocks").column("block").to_pylist():
        docs, counts, ranks = encoding.read_block(block)
        ends = np.cumsum(counts)
        found += [(d, id_of[ranks[e - c : e]].tolist()) for d, c, e in zip(docs, counts, ends)]
    tok = Tokenizer.from_file(path)
    want = [(d, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in MIXED]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(found, key=key) == sorted(want, key=key)


# 4 toxicity


def test_toxicity_generalises(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.toxicity_digest(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(got[d]["predicted"], y) for d, y in truth.items() if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in truth)
    precision = sum(p and y for p, y in held) / max(1, sum(p for p, _ in held))
    recall = sum(p and y for p, y in held) / sum(y for _, y in held)
    assert precision >= 0.95 and recall >= 0.75  # measured: 1.0 and 0.78 here, 1.0 and 0.92 at sf0.1
    learned, _ = toxicity.train(docs, labels)
    patterns, counts = toxicity.vote_patterns(docs, learned)
    assert counts.sum() == sum(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in docs.select("doc_id").collect())
    fired = dict(zip(toxicity.Voters(learned).names, (np.abs(patterns) * counts[:, None]).sum(axis=0)))
    assert all(n > 0 for n in fired.values()), fired


def test_label_model_matches_brute_force_and_finds_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(3000) < 0.3
    says = lambda hit, miss: np.where(rng.random(3000) < np.where(truth, hit, miss), 1, 0)
    strong, weak, copy = says(0.8, 0.02), says(0.5, 0.05), says(0.6, 0.04)
    rows = np.stack([strong, weak, copy, copy, np.where((strong + weak + copy) == 0, -1, 0)], axis=1).astype(np.int8)
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns, counts.astype(float), 0.3)

    post = [0.05 if (r == -1).any() else 0.9 if (r == 1).sum() >= 3 else 0.4 for r in rows]
    weight = [1.0] * 5
    for _ in range(25):
        table = {}
        for m in range(5):
            for v in (-1, 0, 1):
                for y in (0, 1):
                    p = np.array(post) if y else 1 - np.array(post)
                    table[m, v, y] = math.log((p[rows[:, m] == v].sum() + 0.1) / (p.sum() + 0.3))
        odds = {tuple(x): math.log(0.3 / 0.7) + sum(weight[m] * (table[m, v, 1] - table[m, v, 0]) for m, v in enumerate(x.tolist())) for x in patterns}
        post = [1 / (1 + math.exp(-odds[tuple(r)])) for r in rows]
        fired, over = rows == 1, np.zeros((5, 5))
        for p in (1 - np.array(post), np.array(post)):
            for a in range(5):
                for b in range(5):
                    ma, mb, both = (p[f].sum() / p.sum() for f in (fired[:, a], fired[:, b], fired[:, a] & fired[:, b]))
                    if a != b:
                        over[a, b] += p.mean() * min(1, max(0, (both - ma * mb) / (math.sqrt(ma * (1 - ma) * mb * (1 - mb)) + 1e-6)))
        weight = [1 / (1 + over[a].sum()) for a in range(5)]
    assert np.allclose(model.posterior(rows), post) and np.allclose(model.weight, weight)
    assert max(weight[2:4]) < min(weight[:2])  # the two that always agree count less
    assert ((model.posterior(rows) > 0.5) == truth).mean() > 0.85


def test_toxicity_edges(spark, mixed, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (2, 0, 0), (2, 0, 1), (999, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        rows = toxicity.toxicity_digest(mixed, labels).collect()
        assert len(rows) == len(MIXED) and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.toxicity_digest(empty, labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity_digest(mixed, none).collect() if r["doc_id"] == 11} == {1}


# 5 pages


def test_common_lines_are_longest():
    rng = np.random.default_rng(3)

    def length(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        return d[-1, -1]

    for _ in range(500):
        a, b = (rng.integers(0, 6, rng.integers(0, 13)).tolist() for _ in range(2))
        found = pages.common_lines(a, b)
        rest = iter(b)
        assert len(found) == length(a, b) and all(a[i] in rest for i in sorted(found))


def test_page_differencing_and_markup(spark):
    def body(i):
        return f"<html><body><div>Site of things</div><div>Story {i} &amp; more <b>bo</b>ld</div><p>text number {i}<div>All for you</div></body></html>"

    article = '<body><nav>menu</nav><article><h1>T</h1><p>a&nbsp;b<br>c<div class="comments"><p>lol</p></div></article><footer>f</footer><script>x="<p>no</p>"</script>'
    rows = [(i, f"http://h.example/a/{i}", body(i)) for i in range(4)] + [(10, "http://x.example/1", article), (11, None, None), (12, "u", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in pages.main_texts(df).collect()}
    for i in range(4):
        assert got[i]["text"] == f"Story {i} & more bold text number {i}"
    assert got[10]["text"] == "T a b c" and got[10]["n_chars"] == 7
    assert got[11]["text"] == got[12]["text"] == ""
    assert pages.main_texts(df.limit(0)).count() == 0


def test_copies_under_near_urls_keep_their_text(spark):
    html = "<div>the very same story</div><p>in two places</p>"
    df = spark.createDataFrame([(1, "http://h/a/1", html), (2, "http://h/a/2", html), (3, "http://h/a/2", html)], "page_id long, url string, html string")
    assert {r["text"] for r in pages.main_texts(df).collect()} == {"the very same story in two places"}


def test_pages_that_differ_by_query_or_stand_among_copies_lose_their_template(spark):
    def page(*own):
        return "<div>Subscribe now to our letter</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>All rights reserved by us</div>"

    rows = [(i, f"http://q/view?id={i}", page(f"story number {i} of the query host")) for i in range(4)]
    rows += [(10 + i, f"http://c/{i}", page("one story in many copies")) for i in range(5)] + [(20, "http://c/9", page("another story, told once only"))]
    rows += [(30 + i, f"http://s/{i}", page(f"tale {i}")) for i in range(6)]  # the template is most of each page
    got = {r["page_id"]: r["text"] for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"story number {i} of the query host" for i in range(4)]
    assert {got[10 + i] for i in range(5)} == {"one story in many copies"} and got[20] == "another story, told once only"
    assert [got[30 + i] for i in range(6)] == [f"tale {i}" for i in range(6)]


def test_blocks_change_no_neighbour(spark, monkeypatch):
    """Brute force over each host's different pages in order, with blocks much smaller than a host."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        host, body = f"h{rng.integers(0, 3)}", [f"line {x}" for x in rng.integers(0, 60, rng.integers(1, 7))]
        rows.append((i, f"http://{host}/{rng.integers(0, 40):03d}?p={i % 2}", "".join(f"<p>{x}</p>" for x in ["top", *body, f"end of {host}"])))
    rows.append((500, "http://h0/007", "<article><p>marked</p></article>"))
    rows = rows * 2
    monkeypatch.setattr(pages, "BLOCK_PAGES", 8)
    got = sorted((r["page_id"], r["text"]) for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())

    outline = {i: [t for t, p in pages.page_lines(h) if p] for i, _, h in rows}
    line, want = {}, []
    for i, u, _ in rows:
        host, path = u[7:].split("/", 1)
        key = (host, tuple(outline[i]))
        line[key] = min(line.get(key, "~"), "/" + path)
    order = sorted((host, path, pages.line_hash("\n".join(own)), own) for (host, own), path in line.items())
    number = {t: k for k, t in enumerate(sorted({t for x in order for t in x[3]}))}
    codes = lambda own: [number[t] for t in own]
    shared = {}
    for k, (host, path, _, own) in enumerate(order):
        near = [(-pages.common_prefix(path, order[j][1]), abs(j - k), j) for j in range(max(0, k - 3), min(len(order), k + 4)) if j != k and order[j][0] == host]
        shared[host, own] = pages.shared_lines((codes(own), [len(t) for t in own]), [codes(order[j][3]) for _, _, j in sorted(near)])
    for i, u, _ in rows:
        host = u[7:].split("/", 1)[0]
        gone = shared[host, tuple(outline[i])] if i != 500 else ()
        want.append((i, " ".join(t for k, t in enumerate(outline[i]) if k not in gone)))
    assert got == sorted(want) and sum(map(len, shared.values())) > 100


@pytest.mark.parametrize("page", ["<a " * 300_000, '<a "' * 250_000, "<a '" * 250_000, "<div>" * 200_000 + "</b>" * 20_000 + "<p>x" * 20_000, "<!--" * 250_000, "<!x" * 300_000, "<" * 10**6, "<td>" * 200_000, "</div>" * 150_000, "<a" * 500_000, "<p>a<b " * 120_000])
def test_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    pages.page_lines(page)
    assert time.process_time() - began < 4


# 6 packing


def test_packing_is_gapless_and_tight(spark, documents, mixed, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for df in (documents, mixed, frame(spark, [(1, "TARİHİ. tarih, a<|endoftext|> b"), (1, "İ.")])):
        rows = packing.pack_documents(df, path).collect()
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        total = sum(r["length"] for r in rows)
        assert len(sequences) <= math.ceil(total / 4096) * 1.05 + 1
        want = Counter()
        for r in df.collect():
            ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            for k, at in enumerate(range(0, len(ids), 4096)):
                part = np.array(ids[at : at + 4096], "<u4")
                want[r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in df.collect())
    assert packing.pack_documents(empty, path).count() == 0


def test_rounds_merge_residual_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 8)
    items = spark.createDataFrame([(i, 0, i, 0, 100 + 37 * (i % 50), 0) for i in range(200)], "doc_id long, piece int, row long, start long, length long, crc long")
    rows = packing.hierarchical_pack(items).collect()
    total = sum(r["length"] for r in rows)
    assert len(rows) == 200 and len({r["sequence_id"] for r in rows}) <= math.ceil(total / 4096) * 1.3


# 7 quality


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_quality_base_and_verdict(documents, mixed, empty, spark, sf_dir):
    for df in (documents, mixed):
        own = defaultdict(list)
        for r in df.collect():
            own[r["doc_id"]].append(brute_quality(r["text"]))
        for r in quality.line_first_clean(df, ["doc_id"]).collect():
            own[r["doc_id"]].remove((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]))
            assert not (r["base_failed"] and r["kept"])
        assert not any(own.values())
    assert quality.line_first_clean(empty, ["doc_id"]).count() == 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality.line_first_clean(documents, ["doc_id"]).collect()
    wrong = [r for r in rows if r["doc_id"] in labels and not r["base_failed"] and r["kept"] != bool(labels[r["doc_id"]])]
    assert len(wrong) <= 0.02 * len(labels) + 1


@pytest.mark.parametrize(
    ("line", "fails"),
    [("Home | About | Contact | Help", True), ("WHAT!! IS!! THIS!! SHOUTING!! ABOUT!!", True), ("A plain sentence with more than eight words in it.", False),
     ("We use cookies to improve things.", True), ("a line of many words that simply never ever ends", True), ("Short title", False)],
)
def test_line_rules(spark, line, fails):
    text = line + "\n" + "Some words that make a long enough text for the base rule to pass here today. " * 6
    from pyspark.sql import functions as F

    row = frame(spark, [(1, text)]).select(quality.line_fails(F.lit(line), quality.has_furniture(F.col("text"))).alias("f")).first()
    assert row["f"] == fails


# 8 near-duplicates


def test_simhash_links_and_components(texts, documents, mixed, empty):
    import xxhash

    got = {r["doc_id"]: r for r in simhash.near_duplicate_digest(documents).collect()}
    own = {}
    for d, t in texts:
        w = WORD.findall(t.translate(LOWER))
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        own[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert all(got[d]["fingerprint"] == f"{f:016x}" for d, f in own.items())
    root = {d: d for d in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (own[a] ^ own[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(got[d]["component_id"] == find(d) for d in ids)
    rows = simhash.near_duplicate_digest(mixed).collect()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    assert simhash.near_duplicate_digest(empty).count() == 0


def test_variants_miss_no_pair_and_chains_join(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 20)]
    flips = []
    for b in base:
        x = b & (2**64 - 1)
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(bit)
        flips.append(x - 2**64 if x >= 2**63 else x)
    all_fp = sorted({*base, *flips})
    found = {tuple(sorted((r["a"], r["b"]))) for r in simhash.fingerprint_links(spark.createDataFrame([(f,) for f in all_fp], "fp long")).collect()}
    want = {(a, b) for i, b in enumerate(all_fp) for a in all_fp[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert found == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(chain).collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[101] == roots[100] == 100


# 9 decontamination


def test_containment_matches_brute_force(spark, documents, mixed, empty, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")

    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        n = min(5, len(w))
        return n, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    def brute(docs, items):
        out = set()
        for r in docs.collect():
            w = WORD.findall((r["text"] or "").translate(LOWER))
            for it in items.collect():
                n, s = shingles(it["text"])
                own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
                if s and 5 * len(s & own) >= 4 * len(s):
                    out.add((r["doc_id"], it["item_id"], len(s & own)))
        return out

    small = spark.createDataFrame([(1, "the CAT sat on"), (2, None), (3, ""), (4, "one"), (4, "alpha beta gamma delta. alpha"), (None, "bye now")], "item_id long, text string")
    for docs, items in ((documents, bench), (mixed, small)):
        got = {(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontaminate.contained_items(docs, items).collect()}
        assert got == brute(docs, items)
        hit = {d for d, _, _ in got}
        left = decontaminate.decontaminated(docs, items)
        assert left.count() == sum(r["doc_id"] not in hit for r in docs.collect())
    assert decontaminate.contained_items(empty, bench).count() == decontaminate.contained_items(mixed, small.limit(0)).count() == 0


# 10 personal data


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    found = []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for k, (kind, rule, good) in enumerate(rules):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(rule, text or "") if good(m[0])]
    return sorted(found)


def test_pii_matches_brute_force(spark, documents, mixed, empty):
    rng = np.random.default_rng(2)
    alphabet = np.array(["a", "@", ".", "1", "255", "4111111111111111", " ", "-", "+1", "555", "(", ")", "\U0001f600", "_", "b.c", "%", "é", "\n"])
    odd = frame(spark, [(i, "".join(rng.choice(alphabet, rng.integers(0, 40)))) for i in range(800)])
    many = frame(spark, [(1, "1.2.3.4 " * 1500)])
    for df in (documents, mixed, odd, many):
        own = defaultdict(list)
        for r in df.collect():
            spans = brute_pii(r["text"])
            digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()
            own[r["doc_id"]].append((*(sum(x[2] == k for x in spans) for k in pii.BASE_KINDS), digest))
        for r in pii.pii_digest(df).collect():
            own[r["doc_id"]].remove((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]))
        assert not any(own.values())
    assert pii.pii_digest(empty).count() == 0


def test_pii_takes_a_million_repeats_of_each_kind(spark):
    n = 1_000_000
    # text, its base spans: the plain patterns would take quadratic time here
    cases = [
        ("a@b" + ".c" * n, [("email", 0, 3 + 2 * n)]), ("a" * n + "@b.c", [("email", 0, n + 4)]), ("a@" + "b" * n + ".c", [("email", 0, n + 4)]),
        ("1." * n, [("ip", i, i + 7) for i in range(0, 2 * n, 8)]), ("1.2.3." + "4" * n + "x", []), ("1" * n, []), ("4 " * n, []), ("4-" * n + "4", []),
        ("+1" + " 1" * n, []), ("+1" + " " * n + "2", []), ("+1" * n, []), ("GB82" + " WEST" * n, []), ("A" * n, []), ("123-45-6789-" * (n // 10), []),
        ("1.2.3.4 a@b.c " * 5000, [x for i in range(0, 70_000, 14) for x in (("ip", i, i + 7), ("email", i + 8, i + 13))]),
    ]
    df = frame(spark, [(i, t) for i, (t, _) in enumerate(cases)]).repartition(4)
    for r in pii.pii_digest(df).collect():
        spans = cases[r["doc_id"]][1]
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert (r["base_sha256"], r["n_email"], r["n_ip"]) == (digest, sum(x[0] == "email" for x in spans), sum(x[0] == "ip" for x in spans)), r["doc_id"]
    from pyspark.sql import functions as F

    assert pii.mask_pii(df, ["doc_id"]).select(F.sum(F.char_length("text")).alias("n")).first()["n"] > 0


def test_checksums_and_context_add_spans_and_masks(spark):
    text = "IBAN GB82 WEST 1234 5698 7654 32 and GB00 WEST 1234 5698 7654 32; ssn 123-45-6789, part 123-45-6789 x@y.zz"
    df = frame(spark, [(1, text)])
    assert [x.split(":")[0] for x in pii.pii_digest(df).first()["spans"].split(",")] == ["iban", "ssn", "ssn", "email"]
    masked = pii.mask_pii(df, ["doc_id"]).first()["text"]
    assert "x@y.zz" not in masked and "GB82" not in masked and "GB00" in masked and "[EMAIL]" in masked


# pipeline


def test_pipeline_stages_keep_columns_and_rows(spark, sf_dir, documents, mixed, empty):
    for docs in (mixed, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == corpus_pipeline.COLUMNS, name
            assert out.count() <= docs.count()
    masked = {r["doc_id"]: r for r in corpus_pipeline.mask_personal_data(spark, mixed, sf_dir).collect()}
    assert "[EMAIL]" in masked[9]["text"] and masked[9]["n_chars"] == len(masked[9]["text"]) and masked[1]["text"] is None


def test_pipeline_equals_brute_force_stages(spark, sf_dir, documents):
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = documents.join(toxicity.score_toxicity(documents, labels, ["doc_id"]).filter("predicted = 0"), "doc_id", "left_semi")
    first = {r["doc_id"] for r in simhash.near_duplicates(clean).collect() if r["doc_id"] == r["component_id"]}
    hit = {r["doc_id"] for r in decontaminate.contained_items(clean, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert packed == first - hit


def test_every_operator_is_registered():
    assert {k.split("_")[0] for k in QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}


def test_mask_covers_every_reported_span(spark):
    rows = [
        (1, "SSN 123-45-6789, 234-56-7890"), (2, "ssn: 123-45-6789; 234-56-7890; 345-67-8901 end"), (3, "numbers 123-45-6789"), (4, None), (5, ""),
        (6, "ünï mail a@b.de or c@d.org, iban DE89370400440532013000, DE89370400440532013000"), (7, "no data"),
        (8, "call " + " x ".join(["+49 170 1234567"] * 1300)), (9, "host 10.0.0.1@example.org now"), (10, "x" * 510 + " a@b.de " + "y" * 600 + " ssn 123-45-6789"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(df, ["doc_id"]).collect()}
    assert masked[1] == "SSN [SSN], [SSN]" and masked[2] == "ssn: [SSN]; [SSN]; [SSN] end" and masked[3] == rows[2][1]
    assert masked[4] is None and masked[5] == "" and masked[7] == "no data"
    assert masked[6] == "ünï mail [EMAIL] or [EMAIL], iban [IBAN], [IBAN]" and masked[8] == "call " + " x ".join(["[PHONE]"] * 1300)
    assert masked[9] == "host [EMAIL] now"
    for r in pii.find_pii(df, ["doc_id", "text"]).collect():
        assert not r["pii_spans"] or all(r["text"][s["start"] : s["end"]] not in masked[r["doc_id"]] for s in r["pii_spans"])


def test_light_edits_are_near_duplicates_at_any_distance(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 5000)}"
    rows, group = [], {}
    for g in range(30):
        base = [word() for _ in range(30 + 10 * g)]
        for copy in range(3):
            w = list(base)
            for at in range(4, len(w), 60):
                w[at] = word() if copy else w[at]
            rows.append((len(rows), " ".join(w)))
            group[len(rows) - 1] = g

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len({b for _, b in pairs}) >= 40
    far = [(a, b) for a, b in pairs if (simhash.fingerprint(rows[a][1].encode()) ^ simhash.fingerprint(rows[b][1].encode())).bit_count() > 4]
    assert far
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] for a, b in pairs) and all(group[d] == group[c] for d, c in got.items())
