"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A block holds whole documents in order. Layout, little-endian: magic ``RKVB``, uint32 documents, uint64 ids; per
document int64 doc_id, uint8 null flag, uint32 ids; then control bytes (four 2-bit codes each: bytes of a value less 1,
low bits first) and the values' bytes (1 to 4 each, low byte first). Values are ranks: 0 is the commonest id.
A folder of files holds ``blocks`` (Parquet rows with a block each) and ``ranks`` (the id of each rank), so it can be read
without anything else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.llm.common import drop_stored, new_path, partitions, small_batches, stored
from loomrec.llm.tokens import encoder, text_chunks

MAGIC = b"RKVB"
BLOCK_IDS = 1 << 20
END_ID = 0
BLOCKS, RANKS = "part int, seq int, ids_before long, n_ids long, block binary", "rank int, id long"
#: For each control byte, the four lengths and their offsets from the first value's byte, by the format's rule.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int64)
OFFSETS = np.cumsum(LENGTHS, axis=1) - LENGTHS
SPANS = LENGTHS.sum(axis=1)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative values below 2^32."""
    v = values.astype(np.uint32)
    n_bytes = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = n_bytes - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    parts = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), parts[np.arange(4) < n_bytes[:, None]].tobytes()


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Inverse of ``pack_values``: places and widths of all values come from table lookups by control byte."""
    c = np.frombuffer(control, np.uint8)
    last = n - 4 * (len(c) - 1) if len(c) else 0
    spans = SPANS[c]
    starts = np.cumsum(spans) - spans
    at = (starts[:, None] + OFFSETS[c]).ravel()[:n]
    width = LENGTHS[c].ravel()[:n]
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = width > k
        if not more.any():
            break
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    assert last <= 4
    return out


def write_block(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_values(ranks)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + np.array([len(ids)], "<u4").tobytes() + np.array([len(ranks)], "<u8").tobytes()
    return b"".join([head, ids.tobytes(), null.tobytes(), counts.astype("<u4").tobytes(), control, data])


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if block[:4] != MAGIC:
        raise ValueError("not a block of ranked ids")
    n, total = int(np.frombuffer(block, "<u4", 1, 4)[0]), int(np.frombuffer(block, "<u8", 1, 8)[0])
    at = 16
    ids = np.frombuffer(block, "<i8", n, at)
    null = np.frombuffer(block, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(block, "<u4", n, at + 9 * n).astype(np.int64)
    at += 13 * n
    n_control = -(-total // 4)
    ranks = unpack_values(block[at : at + n_control], block[at + n_control :], total)
    return [None if z else int(d) for d, z in zip(ids, null)], counts, ranks


def token_table(docs: DataFrame, path: str, kind: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of each whole text with the end id, as compressed little-endian uint32."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, press = encoder(path, kind), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for rows, texts in text_chunks(batch):
                ids, counts = enc.encode(texts)
                ends = np.cumsum(counts)
                found = [np.append(ids[e - c : e], np.uint32(end_id)).astype("<u4") for e, c in zip(ends, counts)]
                columns = [batch.column(0)[rows], pa.array(counts + 1, pa.int64())]
                narrow = [press.compress((x.astype("<u2") if int(x.max()) < 65536 else x).tobytes()) for x in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(narrow, pa.binary())], ["doc_id", "n_tokens", "ids"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def unpack_ids(payload: bytes, n: int) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def rank_table(tokens: DataFrame) -> list[int]:
    """Ids by falling count, then id. Counts are over all rows; at most one row per vocabulary entry reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for n, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.bincount(unpack_ids(payload, n), minlength=len(total))
                part[: len(total)] += total
                total = part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = tokens.select("n_tokens", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [r["id"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))]


def write_ranked(tokens: DataFrame, by_rank: list[int], folder: str) -> None:
    """Writes ``ranks`` and the blocks of ranked ids in ascending doc_id order (nulls first): (part, seq, ids_before, n_ids,
    block); part and seq give the order, ids_before counts inside the part."""
    rank_of = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ranks = rank_of[np.concatenate(held)]
            block = write_block(docs, np.array([len(x) for x in held]), ranks)
            values = zip((part, seq, before, len(ranks), block), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["part", "seq", "ids_before", "n_ids", "block"])

        for batch in batches:
            for doc, n, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs.append(doc)
                held.append(unpack_ids(payload, n))
                size += n
                if size >= BLOCK_IDS:
                    yield flush()
                    docs, held, seq, before, size = [], [], seq + 1, before + size, 0
        if docs:
            yield flush()

    spark = tokens.sparkSession
    ordered = tokens.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    spark.createDataFrame(list(enumerate(by_rank)), RANKS).coalesce(1).write.parquet(f"{folder}/ranks")
    ordered.mapInArrow(write, BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from a folder of files; start counts the ids of all documents before.
    The ranks, one for each entry of the vocabulary in use at most, go to every worker."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    by_rank = [r["id"] for r in spark.read.schema(RANKS).parquet(f"{folder}/ranks").orderBy("rank").collect()]
    sums = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(sums, default=-1) + 1):
        starts.append(total)
        total += sums.get(part, 0)
    id_of = np.array(by_rank or [0], "<u4")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, block = (batch.column(k)[i].as_py() for k in range(3))
                docs, counts, ranks = read_block(block)
                ids = id_of[ranks]
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(ids[e - c : e]) for e, c in zip(ends, counts)]
                first = starts[part] + before + ends - counts
                arrays = [pa.array(docs, pa.int64()), pa.array(first, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "ids_before", "block").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ranked_id_files(docs: DataFrame, path: str, kind: str = "byte", end_id: int = END_ID, folder: str | None = None) -> str:
    """Encodes every document and writes ranked-id files to ``folder`` (default: a new one in the shared folder), which it
    returns.

    Texts are encoded once, into a table in the shared folder; counting, range partitioning by doc_id and coding read
    that. Null texts count as empty (only the end id); rows with one doc_id stand side by side; an empty table gives no
    blocks; further columns are ignored.
    """
    folder = folder or new_path(docs.sparkSession, "ranked-ids")
    tokens = stored(token_table(docs, path, kind, end_id), "token-ids")
    write_ranked(tokens, rank_table(tokens), folder)
    drop_stored(tokens)
    return folder


def ranked_id_digest(docs: DataFrame, path: str) -> DataFrame:
    return read_ranked(docs.sparkSession, ranked_id_files(docs, path))
