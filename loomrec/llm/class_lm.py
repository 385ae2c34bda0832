"""Brown class-based bigrams: exchange clustering assigns every word a class; log P(w | previous) is the class transition
plus the word's emission.

The CONTEXT_WORDS commonest words are exchanged one by one over their own bigrams. All words are then exchanged in rounds: each
moves to the class that its neighbours on both sides speak for, until the likelihood of the class bigrams settles. A neighbour
outside the context words counts as one class of its own, RARE.

Words are 64-bit hashes of their lower-cased bytes (two of V words collide with odds of V^2 / 2^65). Counts of words, of
word-and-context pairs and of class transitions cover every training text. Tables that grow with the vocabulary live in
Spark; what is sent to workers is bounded by CONTEXT_WORDS and CLASSES.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import crc_mod, drop_stored, partitions, small_batches, stored

CLASSES, CONTEXT_WORDS, MAX_ROUNDS, SETTLED, DRIVER_ROUNDS = 32, 1024, 10, 1e-3, 12
#: Contexts: class of the word before (or RARE), then of the word after, the same numbers above SIDE.
RARE, SIDE = CLASSES, CLASSES + 1
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 7, 2
TRANSITION_SMOOTHING = 50.0
BLOCK_TOKENS, FLUSH_TOKENS, CHUNK_BYTES = 1_500_000, 2_000_000, 500_000
END = np.uint64(0)
UNKNOWN = CLASSES
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
LOWER_TABLE = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64) + np.uint64(1)
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


class WordHasher:
    """Hashes of all words of a run of texts, from prefix sums of a polynomial modulo 2^64, then mixed."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            m = max(n, CHUNK_BYTES * 2)
            first = lambda x: np.concatenate([[np.uint64(1)], np.full(m - 1, x, np.uint64)])
            self.power, self.inverse = np.cumprod(first(MULTIPLIER), dtype=np.uint64), np.cumprod(first(INVERSE), dtype=np.uint64)

    def sequence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, each text followed by END; end of each text in them)."""
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self._reach(len(raw) + 1)
        space = IS_SPACE[raw]
        before = np.concatenate([[True], space[:-1]])
        after = np.concatenate([space[1:], [True]])
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(LOWER_TABLE[raw] * self.power[: len(raw)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        h[h == END] = np.uint64(1)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        upto = np.searchsorted(starts, text_ends)
        own = np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))
        out = np.zeros(len(h) + len(texts), np.uint64)
        out[np.arange(len(h)) + own] = h
        return out, upto + np.arange(1, len(texts) + 1)


def _chunks(column: pa.Array) -> Iterator[tuple[slice, list[bytes]]]:
    held, size, start = [], 0, 0
    for i, x in enumerate(column):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield slice(start, i + 1), held
            held, size, start = [], 0, i + 1
    if held:
        yield slice(start, len(column)), held


def _counted(tokens: np.ndarray) -> pa.RecordBatch:
    found, n = np.unique(tokens, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["w", "c"])


def word_counts(train: DataFrame) -> DataFrame:
    """(w, c) of every token of the training texts, END included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(), [], 0
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                held.append(hasher.sequence(texts)[0])
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield _counted(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield _counted(np.concatenate(held))

    return train.select("text").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def neighbours(codes: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens before and after each one; before a text's first and after its last token stands ``end``."""
    before, after = np.concatenate([[end], codes[:-1]]), np.concatenate([codes[1:], [end]])
    after[ends - 1] = end
    return before, after


class Coder:
    """Codes of the context words in a token array (-1: not one), by binary search in at most CONTEXT_WORDS hashes."""

    def __init__(self, words: list[int], codes: list[int]):
        w = np.array(words, np.int64).view(np.uint64)
        order = np.argsort(w)
        self.words, self.codes = w[order], np.array(codes, np.int16)[order]

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, self.codes[at], np.int16(-1))


def context_matrix(train: DataFrame, words: list[int]) -> np.ndarray:
    """Counts of adjacent context words (previous, next) over all training texts; at most CONTEXT_WORDS^2 sums reach the
    driver."""
    n, end = len(words), words.index(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, coder, total = WordHasher(), Coder(words, list(range(n))), np.zeros(n * n, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                tokens, ends = hasher.sequence(texts)
                codes = coder(tokens)
                previous = neighbours(codes, ends, end)[0]
                here = (codes >= 0) & (previous >= 0)
                total += np.bincount(previous[here].astype(np.int64) * n + codes[here], minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = train.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n * n)
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    return out.reshape(n, n)


def exchange(matrix: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Exchange clustering of the context words: from classes by frequency rank, each word in turn moves to the class that
    raises the class bigrams' likelihood most, until a round moves none."""
    n = len(matrix)
    cls = np.arange(n) % k
    member = np.eye(k)[cls]
    counts = member.T @ matrix @ member
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    def gain(c: np.ndarray) -> float:
        return float(xlogx(c).sum() - xlogx(c.sum(axis=0)).sum() - xlogx(c.sum(axis=1)).sum())

    for _ in range(rounds):
        moved = 0
        for w in range(n):
            row, col, own = matrix[w] @ member, member.T @ matrix[:, w], matrix[w, w]
            old = cls[w]
            base = counts.copy()
            base[old] -= row
            base[:, old] -= col
            base[old, old] += own
            row_w, col_w = row.copy(), col.copy()
            row_w[old] -= own
            col_w[old] -= own
            best, best_gain = old, -np.inf
            for c in range(k):
                trial = base.copy()
                trial[c] += row_w
                trial[:, c] += col_w
                trial[c, c] += own
                g = gain(trial)
                if g > best_gain + 1e-9:
                    best, best_gain, best_counts = c, g, trial
            counts = best_counts
            if best != old:
                moved += 1
                cls[w] = best
                member[w] = np.eye(k)[best]
        if not moved:
            break
    return cls


def context_counts(train: DataFrame, words: list[int], cls: list[int]) -> DataFrame:
    """(w, ctx, n): every token with the class of the word before it, and again with that of the word after it (plus SIDE), over
    all training texts; sorted by w within partitions by w."""
    end_class = cls[words.index(0)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, coder, held, size = WordHasher(), Coder(words, cls), [], 0

        def flush() -> pa.RecordBatch:
            w, ctx = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((ctx, w))
            w, ctx = w[order], ctx[order]
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (ctx[1:] != ctx[:-1])]))
            n = np.diff(np.append(first, len(w)))
            return pa.RecordBatch.from_arrays([pa.array(w[first].view(np.int64)), pa.array(ctx[first].astype(np.int32)), pa.array(n)], ["w", "ctx", "n"])

        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                tokens, ends = hasher.sequence(texts)
                codes = coder(tokens)
                before, after = neighbours(np.where(codes < 0, np.int16(RARE), codes), ends, end_class)
                held.append((np.tile(tokens, 2), np.concatenate([before, after + SIDE])))
                size += 2 * len(tokens)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    spark = train.sparkSession
    pairs = train.select("text").mapInArrow(count, "w long, ctx int, n long").groupBy("w", "ctx").agg(F.sum("n").alias("n"))
    return stored(pairs.repartition(partitions(spark), "w").sortWithinPartitions("w", "ctx"), "contexts")


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(w, ctx, n) runs of whole words from batches sorted by word."""
    carry = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in batches:
        now = [np.concatenate([c, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, c in enumerate(carry)]
        if not len(now[0]):
            continue
        cut = np.searchsorted(now[0], now[0][-1])
        if cut:
            yield tuple(x[:cut] for x in now)
        carry = [x[cut:] for x in now]
    if len(carry[0]):
        yield tuple(carry)


def _assign(w: np.ndarray, ctx: np.ndarray, n: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each word, best class of each word)."""
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    best = np.concatenate([
        np.add.reduceat(n[a:b, None] * score[ctx[a:b]], first[i : i + 20_000] - a).argmax(axis=1)
        for i in range(0, len(first), 20_000)
        for a, b in [(first[i], first[i + 20_000] if i + 20_000 < len(first) else len(w))]
    ])
    return first, best


def _information(c: np.ndarray) -> np.ndarray:
    return np.log(c * c.sum() / (c.sum(axis=1, keepdims=True) * c.sum(axis=0, keepdims=True)))


def _scores(counts: np.ndarray) -> np.ndarray:
    """log of P(context, class) / (P(context) P(class)), smoothed, for contexts of both sides: the exchange criterion of one
    occurrence."""
    c = counts + 0.1
    return np.vstack([_information(c[:SIDE]), _information(c[SIDE:])])


def likelihood(counts: np.ndarray) -> float:
    """Average information of a token's class and the classes beside it: rises with the likelihood of the class bigrams."""
    return float((counts * _scores(counts)).sum() / max(1.0, counts[:SIDE].sum()))


def exchange_all(contexts: DataFrame, start: np.ndarray) -> np.ndarray:
    """Exchange rounds over the whole vocabulary: all words move at once to their best class given the last round's class
    counts, whose 2 * SIDE * CLASSES numbers are summed over partitions. Rounds end when the likelihood gains less than SETTLED
    of itself; a round that loses is not kept."""
    counts, reached = start, likelihood(start)
    for round_no in range(MAX_ROUNDS):
        score = _scores(counts)

        def recount(batches: Iterator[pa.RecordBatch], score: np.ndarray = score) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * SIDE * CLASSES)
            for w, ctx, n in _by_word(batches):
                first, best = _assign(w, ctx, n, score)
                of_row = np.repeat(best, np.diff(np.append(first, len(w))))
                total += np.bincount(ctx * CLASSES + of_row, weights=n, minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

        rows = contexts.mapInArrow(recount, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        moved = np.zeros(2 * SIDE * CLASSES)
        for r in rows:
            moved[r["cell"]] = r["n"]
        moved = moved.reshape(2 * SIDE, CLASSES)
        now = likelihood(moved)
        # the first round brings in the words outside the context words, so it is no gain or loss to compare
        if round_no and now <= reached:
            break
        settled = round_no and now - reached < SETTLED * abs(now)
        counts, reached = moved, now
        if settled:
            break
    return counts


def word_classes(contexts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(w, c, cls) of every training word; each token has one word before it, so those contexts sum to the word's count."""
    score = _scores(counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, ctx, n in _by_word(batches):
            first, best = _assign(w, ctx, n, score)
            own = np.add.reduceat(np.where(ctx < SIDE, n, 0), first)
            yield pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(own), pa.array(best.astype(np.int32))], ["w", "c", "cls"])

    return stored(contexts.mapInArrow(place, "w long, c long, cls int"), "word-classes")


def coded_documents(docs: DataFrame, model: DataFrame, n_blocks: int, n_tokens: int, vocabulary: int, class_log: list[float]) -> DataFrame:
    """Per row: n_tokens, n_known, base_score, emission (sum of log10 P(w | class) of known tokens) and its class sequence.

    Documents are dealt into blocks of bounded size, rows that repeat by the split of the input they come from; each block asks for its distinct words once, the answers are joined
    on the word and brought back to the block, so the vocabulary is never held whole by anyone.
    """
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.spark_partition_id()), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "block")
    floor = math.log10(n_tokens + vocabulary + 1)
    logs = np.array(class_log)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                words = np.unique(np.concatenate(parts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block, np.int32)), pa.array(words)], ["block", "w"])

        for batch in batches:
            blocks = batch.column(3).to_numpy()
            for block in np.unique(blocks):
                mine = batch.column(1).filter(pa.array(blocks == block))
                for _, texts in _chunks(mine):
                    held.setdefault(int(block), []).append(np.unique(hasher.sequence(texts)[0]))
                    size += len(held[int(block)][-1])
            if size >= FLUSH_TOKENS:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    wanted = dealt.mapInArrow(ask, "block int, w long")
    answers = wanted.join(model, "w").select("block", "w", "c", "cls")

    def code(own: pa.Table, known: pa.Table) -> pa.Table:
        import zstandard

        words = known.column("w").to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, c, cls = words[order], known.column("c").to_numpy()[order], known.column("cls").to_numpy()[order]
        c, cls = np.append(c, 0), np.append(cls, UNKNOWN)
        base = np.log10(c + 1) - floor
        emission = np.append(np.log10(np.maximum(c[:-1], 1)) - logs[cls[:-1]], 0.0)
        hasher, press, out = WordHasher(), zstandard.ZstdCompressor(level=1), []
        texts = (x for piece in own.column("text").chunks for x in _chunks(piece))
        for _, part in texts:
            tokens, ends = hasher.sequence(part)
            at = np.searchsorted(words, tokens)
            miss = len(words)
            at = np.where((at < miss) & (words[np.minimum(at, max(miss - 1, 0))] == tokens), at, miss) if miss else np.zeros(len(tokens), np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            codes = cls[at].astype(np.uint8)
            sums = [np.add.reduceat(x, starts) for x in ((at < miss).astype(np.int64), base[at], emission[at])]
            out += zip(ends - starts, *sums, (press.compress(codes[a:b].tobytes()) for a, b in zip(starts, ends)))
        columns = [own.column("doc_id"), own.column("train"), *(pa.array(x) for x in zip(*out))]
        schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emission", pa.float64()), ("classes", pa.binary())])
        return pa.Table.from_arrays(columns, names=schema.names).cast(schema)

    result = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"
    return stored(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(code, result), "coded")


def transitions(coded: DataFrame, end_class: int) -> np.ndarray:
    """Counts of (class, next class) over the training texts, from the coded sequences."""
    side = CLASSES + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, total = zstandard.ZstdDecompressor(), np.zeros(side * side, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seq = np.frombuffer(press.decompress(x.as_py()), np.uint8).astype(np.int64)
                total += np.bincount(np.concatenate([[end_class], seq[:-1]]) * side + seq, minlength=side * side)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(side * side)
    for r in coded.filter("train").select("classes").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(side, side)


def class_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row; learns from rows whose crc32 of
    the id leaves another remainder than HELD_OUT_REMAINDER.

    score: sum of log10 of (1 - e) P(class | previous class) P(word | class) for known tokens and e for others, where e is
    the share of words seen once among training tokens (the mass of one unseen type, as in the base). A null or empty text
    is the single token END. Repeated rows score alike; an empty table gives no rows; with no training rows every token is
    unknown and e is 1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train_flag = crc_mod("doc_id", HELD_OUT_MODULUS) != HELD_OUT_REMAINDER
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), train_flag.alias("train"))
    train = base.filter("train")
    counts = stored(word_counts(train), "word-counts")
    stats = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("once")).first()
    n_train, vocabulary, once = stats["n"] or 0, stats["v"], stats["once"] or 0
    if not n_train:
        model = counts.select("w", "c", F.lit(0).alias("cls"))
        end_class, class_log = UNKNOWN, [0.0] * CLASSES
    else:
        top = counts.filter("w != 0").orderBy(F.desc("c"), "w").limit(CONTEXT_WORDS - 1).collect()
        words = [0, *[r["w"] for r in top]]
        drop_stored(counts)
        cls = exchange(context_matrix(train, words), CLASSES, DRIVER_ROUNDS)
        contexts = context_counts(train, words, cls.tolist())
        seeded = contexts.join(F.broadcast(spark.createDataFrame([(w, int(k)) for w, k in zip(words, cls)], "w long, cls int")), "w")
        start = np.zeros((2 * SIDE, CLASSES))
        for r in seeded.groupBy("ctx", "cls").agg(F.sum("n").alias("n")).collect():
            start[r["ctx"], r["cls"]] = r["n"]
        model = word_classes(contexts, exchange_all(contexts, start))
        drop_stored(contexts)
        sums = {r["cls"]: r["n"] for r in model.groupBy("cls").agg(F.sum("c").alias("n")).collect()}
        class_log = [math.log10(sums.get(k, 1)) for k in range(CLASSES)]
        end_class = model.filter("w = 0").first()["cls"]
    n_blocks = max(partitions(spark), -(-n_train // BLOCK_TOKENS))
    coded = coded_documents(base, model, n_blocks, n_train, vocabulary, class_log)
    follow = transitions(coded, end_class)[:, :CLASSES]
    marginal = (follow.sum(axis=0) + 1e-9) / (follow.sum() + 1e-9 * CLASSES)
    smooth = np.log10((follow + TRANSITION_SMOOTHING * marginal) / (follow.sum(axis=1, keepdims=True) + TRANSITION_SMOOTHING))
    unseen = min(1.0, max(1, once) / max(1, n_train))
    table = np.hstack([smooth + math.log10(1 - unseen) if unseen < 1 else smooth, np.full((CLASSES + 1, 1), math.log10(unseen))])
    held_out = ~F.col("train")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            steps = []
            for x in batch.column(batch.num_columns - 1):
                seq = np.frombuffer(press.decompress(x.as_py()), np.uint8).astype(np.int64)
                steps.append(table[np.concatenate([[end_class], seq[:-1]]), seq].sum())
            score = batch.column(batch.num_columns - 2).to_numpy() + np.array(steps)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    ready = coded.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "emission", "classes")
    scored = ready.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
