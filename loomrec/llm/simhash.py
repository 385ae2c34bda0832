"""SimHash near-duplicates through deletion-variant signatures: few segments, each indexed with one bit left open.

The pipeline's stage also joins texts whose distinct 5-word shingles have a Jaccard similarity of 0.8 or more, however far their
fingerprints lie apart: bands of minimum hashes propose pairs, the whole shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrec.llm.common import small_batches, stored
from loomrec.llm.graph import components

BITS, SEED, SHINGLE_WORDS, MAX_DIFFERING = 64, 42, 4, 4
SHINGLE_CHUNK = 50_000
#: A pair at similarity 0.8 shares none of 20 bands of 5 minima with a chance of 0.0004.
SIMILAR_WORDS, BANDS, BAND_ROWS, MINIMA_CHUNK = 5, 20, 5, 1024
#: One head of a band is compared in the first round, then this many times as many in each further one.
HEAD_GROWTH = 8
#: A band of more texts than CROWD is left for the rare shingles of its texts. Shingles are counted by ORDER_CELLS remainders of their hashes.
CROWD, ORDER_CELLS = 8, 1 << 20
#: Keys of texts are broadcast if they have been counted to be at most this many (of 8 bytes); else they are shuffled.
BROADCAST_ROWS = 1_000_000
_DRAWN = np.random.default_rng(SEED)
FACTORS = _DRAWN.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
OFFSETS = _DRAWN.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64)[:, None] * np.uint64(2)
LOWER_TABLE = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, shingle_words: int) -> Iterator[np.ndarray]:
    """64-bit hashes of all shingles of a text in order, a chunk at a time; nothing for a text without words."""
    import xxhash

    words = text.translate(LOWER_TABLE).split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = max(1, len(words) - shingle_words + 1)
    firsts = starts[:n].tolist()
    ends = (starts + lengths)[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, SHINGLE_CHUNK):
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(firsts[i : i + SHINGLE_CHUNK], ends[i : i + SHINGLE_CHUNK])), np.uint64)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' 64-bit hashes; 0 for a text without words."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, shingle_words):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def bands(text: bytes) -> np.ndarray:
    """One key per band of minimum hashes of the 5-word shingles; none for a text without words."""
    import xxhash

    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    found = False
    for hashes in shingle_hashes(text, SIMILAR_WORDS):
        found = True
        for i in range(0, len(hashes), MINIMA_CHUNK):
            np.minimum(least, (hashes[None, i : i + MINIMA_CHUNK] * FACTORS + OFFSETS).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[i * BAND_ROWS : (i + 1) * BAND_ROWS].tobytes(), i) for i in range(BANDS if found else 0)]
    return np.array(keys, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", banded: bool = False) -> DataFrame:
    """``keep`` and ``fp``, the signed long of the fingerprint of the whole text (null: empty); with ``banded`` also its bands."""
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            found = [pa.array(np.array([fingerprint(x.as_py() or b"") for x in texts], np.uint64).view(np.int64))]
            if banded:
                found.append(pa.array([bands(x.as_py() or b"") for x in texts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found], [*keep, "fp", "bands"][: len(keep) + len(found)])

    small_batches(docs.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["fp long"] + ["bands array<long>"] * banded)
    return docs.select(*keep, F.col(text).cast("binary").alias("__text")).mapInArrow(run, schema)


def segment_widths(max_differing: int, bits: int = BITS) -> list[int]:
    """The fewest segments of which one differs by at most one bit: more than half as many as differing bits."""
    n = max_differing // 2 + 1
    return [bits // n + (i < bits % n) for i in range(n)]


def variants(fp: Column, max_differing: int) -> Column:
    """(key, side) of a fingerprint: each segment as it is (side 2), and with each of its bits left open (side: that bit).
    Two fingerprints whose segment differs in exactly one bit meet at that bit's key on sides 0 and 1."""
    out, low = [], 0
    for s, width in enumerate(segment_widths(max_differing)):
        value = F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1)
        out.append(F.struct(value.bitwiseOR(F.lit((s * BITS + BITS - 1) << 40)).alias("key"), F.lit(2).alias("side")))
        for j in range(width):
            bit = F.shiftright(value, j).bitwiseAND(1)
            open_value = value.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << j)))
            out.append(F.struct(open_value.bitwiseOR(F.lit((s * BITS + j) << 40)).alias("key"), bit.cast("int").alias("side")))
        low += width
    return F.array(*out)


def fingerprint_links(classes: DataFrame, max_differing: int = MAX_DIFFERING) -> DataFrame:
    """(a, b) of every two fingerprints of ``classes`` (distinct, column fp) that differ in 1 to ``max_differing`` bits; a
    link may come twice. Equality joins on variant keys; the distance is checked inside the join."""
    v = classes.select("fp", F.explode(variants(F.col("fp"), max_differing)).alias("v")).select("fp", "v.key", "v.side")
    left = v.filter("side != 1").select(F.col("fp").alias("a"), F.col("key").alias("ka"), F.col("side").alias("sa"))
    right = v.filter("side != 0").select(F.col("fp").alias("b"), F.col("key").alias("kb"), F.col("side").alias("sb"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_differing
    sides = ((F.col("sa") == 0) & (F.col("sb") == 1)) | ((F.col("sa") == 2) & (F.col("sb") == 2) & (F.col("a") < F.col("b")))
    return left.join(right.hint("merge"), (F.col("ka") == F.col("kb")) & sides & close).select("a", "b")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """text_no and the distinct 5-word shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.concatenate([*shingle_hashes(x.as_py() or b"", SIMILAR_WORDS), np.zeros(0, np.uint64)])).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["text_no", "shingles"])

    return texts.select("text_no", F.col("text").cast("binary").alias("__text")).mapInArrow(run, "text_no long, shingles array<long>")


def similar_links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b), the fingerprints of the ``pairs`` (ta, a, tb, b) whose texts have a Jaccard similarity of 0.8 or more. Only
    texts that stand in a pair are read again and shingled, each once."""
    asked = stored(pairs.select(F.explode(F.array("ta", "tb")).alias("text_no")).distinct(), "asked")
    side = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    sets = stored(shingle_sets(docs.select("text_no", "text").join(side, "text_no", "left_semi").dropDuplicates(["text_no"])), "shingle-sets")
    left = pairs.join(sets.select(F.col("text_no").alias("ta"), F.col("shingles").alias("sa")).hint("merge"), "ta")
    both = left.join(sets.select(F.col("text_no").alias("tb"), F.col("shingles").alias("sb")).hint("merge"), "tb")
    return both.filter(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (fp, text_no, key, n, at) with their roots whose key is found in more than one component, each once."""
    placed = rows.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("key", F.coalesce("root", "fp").alias("root"), "text_no", "fp", "n", "at")
    keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    return placed.join(keys.hint("merge"), "key", "left_semi").distinct()


def rare_shingles(sets: DataFrame) -> DataFrame:
    """(text_no, key, n, at): of each text's n distinct shingles the rarest fifth and one more, with their places from 0.

    Texts with a Jaccard similarity of 0.8 share at least 0.8 of either one's shingles, so in any one order of all shingles the first that
    they share is among these of both. The order is by the count of a shingle's cell, then by hash: a fixed number of counts is sent
    to the tasks, whatever the input; what many texts share comes last.
    """
    cell = F.pmod("s", F.lit(ORDER_CELLS))
    found = sets.select(F.explode("shingles").alias("s")).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(ORDER_CELLS, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_no, keys, sizes, places = [], [], [], []
            for no, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = shingles.values.to_numpy(zero_copy_only=False)
                first = own[np.lexsort((own, counts[own % ORDER_CELLS]))][: len(own) - (4 * len(own) + 4) // 5 + 1]
                text_no.append(np.full(len(first), no, np.int64))
                keys.append(first)
                sizes.append(np.full(len(first), len(own), np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
            columns = [np.concatenate([*c, np.zeros(0, d)]).astype(d) for c, d in ((text_no, np.int64), (keys, np.int64), (sizes, np.int32), (places, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["text_no", "key", "n", "at"])

    return sets.select("text_no", "shingles").mapInArrow(run, "text_no long, key long, n int, at int")


def uncrowded(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (fp, text_no, key, n, at) of bands of at most CROWD texts; the texts of all others come with their rare shingles as keys
    in place of those bands, by which no similar pair is lost."""
    columns = ["fp", "text_no", "key", "n", "at"]
    crowded = stored(rows.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > CROWD).select("key"), "crowded")
    few = rows.join(crowded.hint("merge"), "key", "left_anti").select(*columns)
    inside = stored(rows.join(crowded.hint("merge"), "key", "left_semi").select("fp", "text_no").distinct(), "crowded-texts")
    if inside.isEmpty():
        return few
    texts = docs.select("text_no", "text").join(inside.select("text_no").hint("merge"), "text_no", "left_semi").dropDuplicates(["text_no"])
    rare = rare_shingles(stored(shingle_sets(texts), "crowded-shingles"))
    return few.unionByName(rare.join(inside.hint("merge"), "text_no").select(*columns))


def similar_roots(docs: DataFrame, marked: DataFrame, near: DataFrame) -> DataFrame:
    """(node, root) of every fingerprint linked by ``near`` or by similar texts that share a band.

    Crowded bands give way to the rare shingles of their texts (see ``uncrowded``), so texts that merely share a common passage don't meet.
    Works in rounds over the keys whose texts lie in several components. In each, a few texts of a band, its heads, are compared with
    the band's texts of other components and then leave it, as they have met all of them; components are built anew before the next
    round. A group of near copies is joined by its first head. Heads grow by HEAD_GROWTH a round, so a band of n texts
    takes some log n rounds. Every two texts of a band are compared or found in one component before.
    """
    near = stored(near, "near-roots")
    links = near.filter("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    banded = marked.select("fp", "text_no", F.explode("bands").alias("key"), F.lit(0).alias("n"), F.lit(0).alias("at"))
    rows, roots, done, heads = uncrowded(docs, stored(apart(banded, near), "bands")), near, None, 1
    while True:
        rows = stored(apart(rows.select("fp", "text_no", "key", "n", "at"), roots), "bands")
        if rows.isEmpty():
            return roots
        place = F.row_number().over(W.partitionBy("key").orderBy("root", "text_no", "fp"))
        head = stored(rows.withColumn("place", place).filter(F.col("place") <= heads), "heads")
        left = head.select("key", F.col("root").alias("ra"), F.col("text_no").alias("ta"), F.col("fp").alias("a"), F.col("n").alias("na"), F.col("at").alias("xa"))
        right = rows.select("key", F.col("root").alias("rb"), F.col("text_no").alias("tb"), F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("at").alias("xb"))
        # the first shingle that similar texts share leaves enough of both after it
        enough = 9 * F.least(F.col("na") - F.col("xa"), F.col("nb") - F.col("xb")) >= 4 * (F.col("na") + F.col("nb"))
        ordered = F.when(F.col("ta") < F.col("tb"), F.struct("ta", "a", "tb", "b")).otherwise(F.struct(F.col("tb").alias("ta"), F.col("b").alias("a"), F.col("ta").alias("tb"), F.col("a").alias("b")))
        pairs = left.join(right.hint("merge"), "key").filter(enough & (F.col("ra") != F.col("rb"))).select(ordered.alias("p")).select("p.*").distinct()
        pairs = stored(pairs if done is None else pairs.join(done.hint("merge"), ["ta", "tb"], "left_anti"), "pairs")
        done = pairs.select("ta", "tb") if done is None else done.unionByName(pairs.select("ta", "tb"))
        links = links.unionByName(stored(similar_links(docs, pairs), "similar-links"))
        roots = stored(components(links), "similar-roots")
        rows = rows.join(head.select("key", "text_no", "fp").hint("merge"), ["key", "text_no", "fp"], "left_anti")
        heads *= HEAD_GROWTH


def near_duplicates(docs: DataFrame, max_differing: int = MAX_DIFFERING, keep: tuple[str, ...] = ("doc_id",), similar: bool = True) -> DataFrame:
    """``keep`` (doc_id among them), fp and component_id of every row; component_id is the smallest doc_id reachable over links of at most
    ``max_differing`` bits and, with ``similar``, over texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.

    Equal fingerprints are one class before anything is joined, so copies cost one row however many they are; links and
    components run on classes. Null and empty texts have fingerprint zero and are one class; rows that share a doc_id
    each get a row; an empty table gives none; a component of null ids alone has a null id. Tables in the shared folder
    hold fingerprints and links, so nothing is hashed twice. Joins are hinted to shuffle: classes and links grow with the
    documents, and a broadcast would pass them whole through the driver.
    """
    numbered = docs.withColumn("text_no", F.xxhash64("text")) if similar else docs
    marked = stored(fingerprints(numbered, [*keep, *["text_no"] * similar], banded=similar), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "classes")
    roots = components(fingerprint_links(classes, max_differing))
    roots = similar_roots(numbered, marked, roots) if similar else roots
    placed = classes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"), F.col("node").isNotNull().alias("linked"))
    firsts = placed.filter("linked").groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_class = placed.join(firsts.hint("merge"), "root", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id"))
    return marked.join(of_class.hint("merge"), "fp").select(*keep, "fp", "component_id")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, similar=False).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, max_differing: int = MAX_DIFFERING) -> DataFrame:
    """One document of each group stays: the one whose id names the component. Rows equal in id and text count as one; a
    null id stays only in a component of null ids. The documents are shuffled once, by id, to meet the verdicts."""
    key = F.xxhash64("text")
    found = near_duplicates(docs.select("doc_id", "text", key.alias("text_key")), max_differing, ("doc_id", "text_key"))
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")).distinct()
    joined = docs.withColumn("__key", key).join(kept, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")))
    return joined.dropDuplicates(["doc_id", "__key"]).select(*docs.columns)
