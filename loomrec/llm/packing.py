"""Hierarchical residual packing: best-fit inside partitions, emit nearly full bins, merge the rest as items in rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import small_batches, stored
from loomrec.llm.tokens import encoder, forget_encoders, text_chunks

CAPACITY = 4096
END_ID = 1
#: Items of one local packing, and the share of room from which a bin is out.
GROUP_ITEMS, FULL = 40_000, 0.99
ROUNDS = 12
BIN = "bin long, round int, fill long, seed long, members array<struct<doc_id:bigint,piece:int,row:bigint,offset:bigint,length:bigint,start:bigint,crc:bigint>>"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the given order: the open bin with the least room that suffices.

    Bins are kept by room in stacks; a bit mask of rooms in use finds the least sufficient one at once.
    """
    stacks: dict[int, list[int]] = {}
    rooms, mask = [], 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            b, room = len(rooms), capacity
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        rooms[b] = left
        if left:
            stacks.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, kind: str = "word", end_id: int = END_ID, capacity: int = CAPACITY, remember: bool = True) -> DataFrame:
    """(doc_id, row, piece, start, length, crc) of each document's pieces: its ids with the end id, cut only if longer than
    ``capacity``. row tells rows with one doc_id apart. ``remember``: workers keep their memory of pieces for the next task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind)
        for batch in batches:
            for rows, texts in text_chunks(batch):
                ids, counts = enc.encode(texts)
                ends = np.cumsum(counts)
                out = []
                for doc, row, e, c in zip(batch.column(0)[rows].to_pylist(), batch.column(2)[rows].to_pylist(), ends, counts):
                    own = np.append(ids[e - c : e], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        out.append((doc, row, k, at, len(part), zlib.crc32(part)))
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(x, t) for x, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "piece", "start", "length", "crc"])
        if not remember:
            del enc
            forget_encoders()

    small_batches(docs.sparkSession)
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return numbered.mapInArrow(cut, "doc_id long, row long, piece int, start long, length long, crc long")


def pack_round(items: DataFrame, groups: int, round_no: int, capacity: int) -> DataFrame:
    """One round: items go to ``groups`` tasks by hash, longest first within a task, and are packed best-fit."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables).combine_chunks()
        fill = table.column("fill").to_numpy()
        where, offset = best_fit(fill, capacity)
        order = np.argsort(where, kind="stable")
        table, where, offset, fill = table.take(pa.array(order)), where[order], offset[order], fill[order]
        members = table.column("members").combine_chunks()
        inner, sizes = members.flatten(), members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        names = [f.name for f in inner.type]
        fields = [inner.field(n) for n in names]
        fields[names.index("offset")] = pa.array(inner.field("offset").to_numpy() + np.repeat(offset, sizes))
        starts = np.flatnonzero(np.diff(where, prepend=-1))
        ends = np.append(np.cumsum(sizes)[starts[1:] - 1], sizes.sum()) if len(starts) > 1 else np.array([sizes.sum()])
        bounds = np.concatenate([[0], ends]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, names))
        totals = np.add.reduceat(fill, starts)
        part = TaskContext.get().partitionId()
        ids = (np.int64(round_no) << 56) + (np.int64(part) << 28) + np.arange(len(starts), dtype=np.int64)
        columns = [pa.array(ids), pa.array(np.full(len(starts), round_no, np.int32)), pa.array(totals), pa.array(ids ^ 0x5BD1E995), lists]
        out = pa.RecordBatch.from_arrays(columns, ["bin", "round", "fill", "seed", "members"])
        for i in range(0, out.num_rows, 2000):
            yield out.slice(i, 2000)

    spread = items.repartition(groups, F.xxhash64("seed", F.lit(round_no))).sortWithinPartitions(F.col("fill").desc(), "seed")
    return stored(spread.mapInArrow(pack, BIN), f"packed-{round_no}")


def hierarchical_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, row, start, length, crc, sequence_id, offset) of every piece.

    Round 0 packs pieces in groups of about ``GROUP_ITEMS``. Bins filled to ``FULL`` are out; of the rest only those that
    some other could still join go on, as whole items, to a round with fewer groups, until one group has packed them or a
    round saves nothing. Each round is a table in the shared folder, so a lost executor repeats one task of one round.
    Groups are bounded at any input size; the driver sees counts. Pieces of any order, ties and repeats are packed alike;
    an empty table gives no rows.
    """
    member = F.struct("doc_id", "piece", "row", F.lit(0).cast("long").alias("offset"), "length", "start", "crc")
    seed = F.xxhash64("doc_id", "piece", "row", "crc")
    items = pieces.select(
        F.lit(0).cast("long").alias("bin"), F.lit(-1).alias("round"), F.col("length").alias("fill"), seed.alias("seed"), F.array(member).alias("members")
    )
    count, out, carried = pieces.count(), [], 0
    for round_no in range(ROUNDS):
        groups = max(1, -(-count // GROUP_ITEMS))
        bins = pack_round(items, groups, round_no, capacity)
        done = F.col("fill") >= FULL * capacity
        stats = bins.filter(~done).agg(F.min("fill").alias("lo"), F.count("*").alias("n")).first()
        n_open = stats["n"]
        if groups == 1 or not n_open or (round_no and n_open > 0.98 * carried):
            out.append(bins)
            break
        joinable = ~done & (F.col("fill") + stats["lo"] <= capacity)
        out.append(bins.filter(~joinable))
        items = bins.filter(joinable)
        count = carried = items.count()
        if not count:
            break
    else:
        out.append(items)
    packed = out[0]
    for more in out[1:]:
        packed = packed.unionByName(more)
    m = packed.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m"))
    return m.select("m.doc_id", "m.piece", "m.row", "m.start", "m.length", F.col("m.crc").alias("ids_crc32"), "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, path: str, remember: bool = True) -> DataFrame:
    """The documents contract: every piece of every document with its place. A null text is empty: one piece, the end id."""
    pieces = stored(token_pieces(docs, path, remember=remember), "pieces")
    return hierarchical_pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
