"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors.

Voters read words only. The label model is fitted by expectation-maximisation on the votes of all documents outside the held-out
third, labelled or not: an accuracy per voter and vote, and a discount for voters that fire together beyond what the classes
explain. Labels only supply the learned lexicons and the class balance. The classifier is fitted on posteriors; beside what the
voters count it reads the hashed beginnings of all words, which no voter does.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import crc_mod, small_batches

#: Bounds of the fit: labelled rows of the lexicons and rows of the classifier (both by hash order of the id), stems that reach the
#: driver, hashed features. The driver gets at most SAMPLE_ROWS * HASHED numbers of two bytes, whatever the texts' length.
SAMPLE_ROWS, LEXICON_WORDS, HASHED, HASHED_CHARS = 8_000, 6_000, 4096, 5
MIN_TOXIC_TEXTS, MIN_TOXIC_SHARE, MIN_LOG_ODDS, STEM_CHARS = 4, 0.015, 3.5, range(5, 11)
THRESHOLD = 0.7
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 3, 1
#: Insults by theme, lower case.
THEMES = {
    "intellect": ["clown", "dumb", "fool", "idiot", "idiotic", "imbecile", "moron", "moronic", "stupid"],
    "filth": ["asshole", "bastard", "bitch", "disgusting", "filth", "garbage", "pig", "scum", "trash", "vermin", "vile"],
    "worth": ["coward", "creep", "freak", "jerk", "liar", "loser", "pathetic", "ugly", "worthless"],
}
#: Two different hits this many words apart are close; a text with a hit in so many words is dense; with fewer than one in
#: RARE_WORDS its hits are rare.
CLOSE_WORDS, DENSE_WORDS, RARE_WORDS = 30, 60, 200
JACKKNIFE = 3
SPLIT = re.compile(r"[^\w']+")


def words_in(text: str) -> list[str]:
    return [w for w in SPLIT.split(text.lower()) if w]


class Voters:
    """Votes and features of a text: 1 toxic, -1 clean, 0 nothing.

    One voter for each theme of insults and each learned lexicon, which speak if their hits are not rare; hits close together;
    dense hits; one hit three times or more; four or more different hits; no hit at all (clean); rare hits (clean).
    """

    def __init__(self, learned: list[list[str]]):
        self.theme = {w: k for k, words in enumerate(THEMES.values()) for w in words}
        self.learned: dict[str, list[int]] = {}
        for k, stems in enumerate(learned):
            for stem in stems:
                self.learned.setdefault(stem, []).append(k)
        self.sizes = sorted({len(w) for w in self.learned})
        self.gate = {w[: self.sizes[0]] for w in self.learned} if self.learned else set()
        self.n_learned = len(learned)
        self.names = [*THEMES, *[f"learned_{k}" for k in range(len(learned))], "close", "dense", "repeated", "several", "silent", "rare"]

    def lexicons(self, word: str) -> list[int]:
        """Numbers of the lexicons that hold a word: themes, then learned ones."""
        out = [self.theme[word]] if word in self.theme else []
        if self.gate and word[: self.sizes[0]] in self.gate:
            out += {len(THEMES) + k for n in self.sizes if n <= len(word) for k in self.learned.get(word[:n], ()) if n >= STEM_CHARS[0] or n == len(word)}
        return out

    def read(self, text: str) -> tuple[list[int], list[float]]:
        """(votes, features): features count different hits of each theme and of the learned lexicons, those beyond the first and
        the third, and say how often one hit comes back, how dense all are, and whether some are close."""
        words = words_in(text)
        known = {w: found for w in set(words) if (found := self.lexicons(w))}
        different, times = ([0] * (len(THEMES) + self.n_learned) for _ in range(2))
        most = total = 0
        close = False
        if known:
            places = [(i, w) for i, w in enumerate(words) if w in known]
            close = any(b - a <= CLOSE_WORDS and v != w for (a, v), (b, w) in zip(places, places[1:]))
            for w, n in Counter(w for _, w in places).items():
                most, total = max(most, n), total + n
                for k in known[w]:
                    different[k] += 1
                    times[k] += n
        n, often = len(known), lambda x, span: x * span >= max(1, len(words)) and x > 0
        votes = [*(int(often(x, RARE_WORDS)) for x in times), int(close), int(often(total, DENSE_WORDS)), int(most >= 3), int(n >= 4)]
        votes += [-int(n == 0), -int(0 < n < 4 and not often(total, RARE_WORDS))]
        counts = [*different[: len(THEMES)], max(different[len(THEMES) :], default=0), max(0, n - 1), max(0, n - 3), max(0, most - 1)]
        return votes, [*map(math.log1p, counts), math.log1p(RARE_WORDS * total / max(1, len(words))), float(close)]


def hashed(text: str) -> np.ndarray:
    """Different hashed word beginnings of a text, sorted."""
    return np.unique(np.fromiter((zlib.crc32(w.encode()) % HASHED for w in {w[:HASHED_CHARS] for w in words_in(text)}), np.uint16))


def stems_of(words: set[str]) -> set[str]:
    """Beginnings of longer words, and shorter words whole."""
    return {w[:n] for w in words for n in (STEM_CHARS if len(w) >= STEM_CHARS[0] else (len(w),)) if n <= len(w)}


def copy_key(text: str) -> int:
    """From the three least hashes of its longer words: alike for near copies of a text."""
    least = sorted({zlib.crc32(w.encode()) for w in words_in(text) if len(w) >= 7})[:3]
    return zlib.crc32(repr(least).encode())


def labelled_stems(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, toxic, stems) of at most SAMPLE_ROWS labelled rows outside the held-out third, taken in the order of the id's hash.
    Repeated rows, copies and near copies count once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            keys = [copy_key(t) for t in texts]
            stems = pa.array([sorted(stems_of(set(words_in(t)))) for t in texts], pa.list_(pa.string()))
            parts = pa.array([k % JACKKNIFE for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), parts, stems], ["toxic", "copy", "part", "stems"])

    ids = labels.filter("toxic in (0, 1)").filter(crc_mod("doc_id", HELD_OUT_MODULUS) != HELD_OUT_REMAINDER)
    ids = ids.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = F.broadcast(ids.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(SAMPLE_ROWS))
    own = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("label_id")).filter("text is not null").select("toxic", "text")
    return own.mapInArrow(read, "toxic int, copy long, part int, stems array<string>").dropDuplicates(["copy", "toxic"]).drop("copy")


def learn_lexicons(rows: DataFrame) -> tuple[list[list[str]], float]:
    """(lexicons, share of toxic texts): stems far commoner in toxic texts than in clean ones, counted by Spark; one lexicon for each
    part left out. A stem inside one already taken adds nothing."""
    in_part = lambda k, y: ((F.col("part") == k) & (F.col("toxic") == y)).cast("long")
    sums = [F.sum(in_part(k, y)).alias(f"n{y}_{k}") for k in range(JACKKNIFE) for y in (0, 1)]
    total = rows.agg(*sums).first()
    texts = {(k, y): total[f"n{y}_{k}"] or 0 for k in range(JACKKNIFE) for y in (0, 1)}
    n_toxic, n_all = sum(texts[k, 1] for k in range(JACKKNIFE)), sum(texts.values())
    if not n_all:
        return [[] for _ in range(JACKKNIFE)], 0.0
    counts = rows.select("part", "toxic", F.explode("stems").alias("stem")).groupBy("stem").agg(*sums)
    toxic, clean = (sum((F.col(f"n{y}_{k}") for k in range(JACKKNIFE)), F.lit(0)) for y in (1, 0))
    odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_all - n_toxic + 1))
    found = counts.filter(toxic >= MIN_TOXIC_TEXTS).filter(odds >= MIN_LOG_ODDS - 1).orderBy(toxic.desc(), "stem").limit(LEXICON_WORDS).collect()
    lexicons = []
    for out in range(JACKKNIFE):
        parts = [k for k in range(JACKKNIFE) if k != out]
        n1, n0 = (sum(texts[k, y] for k in parts) for y in (1, 0))
        able = []
        for r in found:
            t, c = (sum(r[f"n{y}_{k}"] for k in parts) for y in (1, 0))
            if t >= max(MIN_TOXIC_TEXTS, n1 * MIN_TOXIC_SHARE) and math.log((t + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1)) >= MIN_LOG_ODDS:
                able.append((len(r["stem"]), r["stem"]))
        taken: set[str] = set()
        for _, stem in sorted(able):
            if not any(stem[:n] in taken for n in range(STEM_CHARS[0], len(stem))):
                taken.add(stem)
        lexicons.append(sorted(taken))
    return lexicons, n_toxic / n_all


class LabelModel:
    """P(toxic | votes), fitted on different vote patterns with their numbers of documents. Each voter has P(vote | class) for its
    three votes; votes of a correlated pair are tempered by the share of evidence they have in common, estimated from co-firing
    beyond what the classes explain."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, balance: float, rounds: int = 25):
        onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        self.weight = np.ones(votes.shape[1])
        ayes, noes = (votes == 1).sum(axis=1), (votes == -1).sum(axis=1)
        post = np.where(noes > 0, 0.05, np.where(ayes >= 3, 0.9, 0.4))
        self.balance = min(0.5, max(balance, 1e-3))
        for _ in range(rounds):
            table = []
            for p in ((1 - post) * counts, post * counts):
                table.append((np.einsum("n,nmv->mv", p, onehot) + 0.1) / (p.sum() + 0.3))
            self.log = np.log(np.stack(table))
            post = self.posterior(votes)
            self.weight = self._shared(votes, counts, post)

    def _shared(self, votes: np.ndarray, counts: np.ndarray, post: np.ndarray) -> np.ndarray:
        fired = (votes == 1).astype(float)
        excess = np.zeros((votes.shape[1],) * 2)
        for p in ((1 - post) * counts, post * counts):
            mean = p @ fired / max(p.sum(), 1e-9)
            joint = (fired * p[:, None]).T @ fired / max(p.sum(), 1e-9)
            spread = np.sqrt(np.outer(mean * (1 - mean), mean * (1 - mean))) + 1e-6
            excess += p.sum() / counts.sum() * np.clip((joint - np.outer(mean, mean)) / spread, 0, 1)
        np.fill_diagonal(excess, 0)
        return 1 / (1 + np.clip(excess.sum(axis=1), 0, None))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        index = votes.astype(int) + 1
        cols = np.arange(votes.shape[1])
        log_odds = ((self.log[1][cols, index] - self.log[0][cols, index]) * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(log_odds + math.log(self.balance / (1 - self.balance)), -40, 40)))


class Linear:
    """Logistic regression on soft labels over dense features and hashed presence features of unit length, by gradient steps with a
    ridge that holds the many hashed weights closer to zero than the few dense ones."""

    def __init__(self, n_dense: int):
        self.dense, self.sparse, self.bias = np.zeros(n_dense), np.zeros(HASHED), 0.0

    def logits(self, dense: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        text = np.array([self.sparse[r].sum() / math.sqrt(max(1, len(r))) for r in rows])
        return dense @ self.dense + text + self.bias

    def fit(self, dense: np.ndarray, rows: list[np.ndarray], target: np.ndarray, rounds: int = 30) -> Linear:
        """Rounds of Newton steps for the dense weights and preconditioned gradient steps for the hashed ones."""
        x = np.hstack([dense, np.ones((len(dense), 1))])
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate([*rows, np.zeros(0, np.uint16)]).astype(np.int64)
        scale = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(self.logits(dense, rows), -30, 30)))
            slope = p * (1 - p)
            curve = (x * slope[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
            step = np.linalg.solve(curve, x.T @ (p - target) + 1e-2 * np.append(self.dense, self.bias))
            self.dense, self.bias = self.dense - step[:-1], self.bias - step[-1]
            p = 1 / (1 + np.exp(-np.clip(self.logits(dense, rows), -30, 30)))
            gradient = np.bincount(flat, np.repeat(p - target, sizes) * scale, HASHED) + self.sparse
            bound = np.bincount(flat, np.repeat(p * (1 - p) * np.sqrt(np.maximum(sizes, 1)), sizes) * scale, HASHED) + 1
            self.sparse -= gradient / bound
        return self

    def score(self, dense: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(dense, rows), -30, 30)))


def vote_patterns(docs: DataFrame, learned: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(different vote patterns, documents with each) over all documents outside the held-out third; patterns are bounded by
    the voters, not by the documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, found = Voters(learned), {}
        for batch in batches:
            for x in batch.column(0):
                key = ",".join(map(str, voters.read(x.as_py() or "")[0]))
                found[key] = found.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    seen = docs.filter(crc_mod("doc_id", HELD_OUT_MODULUS) != HELD_OUT_REMAINDER).select("text")
    rows = seen.mapInArrow(read, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    return np.array([[int(v) for v in r["pattern"].split(",")] for r in rows], np.int8), np.array([r["n"] for r in rows], float)


def classifier_rows(docs: DataFrame, learned: list[list[str]]) -> list[tuple]:
    """(votes, features, hashed) of at most SAMPLE_ROWS documents outside the held-out third, in the order of the id's hash."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(learned)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            votes, features = zip(*map(voters.read, texts)) if texts else ((), ())
            marks = [hashed(t).astype(np.int16) for t in texts]
            columns = [pa.array(votes, pa.list_(pa.int8())), pa.array(features, pa.list_(pa.float64())), pa.array(marks, pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "votes", "features", "marks"])

    ids = docs.filter(crc_mod("doc_id", HELD_OUT_MODULUS) != HELD_OUT_REMAINDER).filter("doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    chosen = F.broadcast(ids.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS))
    own = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id")).select("id", "text")
    read_rows = own.mapInArrow(read, "id long, votes array<tinyint>, features array<double>, marks array<smallint>").dropDuplicates(["id"])
    return [(r["votes"], r["features"], np.array(r["marks"], np.int64)) for r in read_rows.orderBy("id").toLocalIterator()]


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[list[str]], Linear]:
    """(learned lexicons, classifier). Without labels only the fixed lexicons vote, at a class balance of 0.05; without documents
    the classifier is one of fixed weights: two different insults make a text toxic."""
    lexicons, balance = learn_lexicons(labelled_stems(docs, labels))
    voters = Voters(lexicons)
    patterns, counts = vote_patterns(docs, lexicons)
    n_dense = len(voters.read("")[1])
    rows = classifier_rows(docs, lexicons) if len(patterns) else []
    if not rows or not (patterns == 1).any():
        fixed = Linear(n_dense)
        fixed.dense[len(THEMES) + 1], fixed.bias = 16.0, -8.0
        return lexicons, fixed
    model = LabelModel(patterns, counts, balance or 0.05)
    votes, features, marks = (list(x) for x in zip(*rows))
    return lexicons, Linear(n_dense).fit(np.array(features), marks, model.posterior(np.array(votes, np.int8)))


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus score (0 to 1) and predicted (1 from THRESHOLD on) for every row, from its whole text.

    Null and empty texts score like a text without any toxic word. Repeated rows score alike; labels of unknown ids, null
    labels and contradictory labels do no harm. The fit reads the documents for their votes and two samples of bounded size; the
    scoring is one narrow pass; only stems and weights are sent out.
    """
    small_batches(docs.sparkSession)
    learned, linear = train(docs.withColumn("text", F.col(text)), labels)
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(learned)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t.as_py() or "" for t in batch.column(len(keep))]
            score = linear.score(np.array([voters.read(t)[1] for t in texts]), [hashed(t) for t in texts])
            out = [*batch.columns[: len(keep)], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, [*keep, "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double", "predicted int"])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = crc_mod("doc_id", HELD_OUT_MODULUS) == HELD_OUT_REMAINDER
    scored = score_toxicity(docs, labels, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
