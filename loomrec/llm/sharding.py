"""Hilbert-curve sharding: order rows along a space-filling curve over several metadata columns and cut runs.

Files cut from such runs are narrow in every dimension at once, so min/max statistics prune on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrec.llm.common import let, partitions, stored

BITS = 8


def _rotate_right(x: int, by: int, n: int) -> int:
    by %= n
    return ((x >> by) | (x << (n - by))) & ((1 << n) - 1)


def _rotate_left(x: int, by: int, n: int) -> int:
    return _rotate_right(x, -by % n, n)


def _trailing_ones(x: int) -> int:
    count = 0
    while x & 1:
        x >>= 1
        count += 1
    return count


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) for each state * 2^n + corner of the n-dimensional curve, from its Gray-code rule.

    A state is (entry corner, direction), numbered entry * n + direction.
    """
    corners = 1 << n
    gray = [i ^ (i >> 1) for i in range(corners)]
    rank = {g: i for i, g in enumerate(gray)}
    digits, following = [0] * (corners * n * corners), [0] * (corners * n * corners)
    for entry in range(corners):
        for direction in range(n):
            for corner in range(corners):
                w = rank[_rotate_right(corner ^ entry, direction + 1, n)]
                inner_entry = 0 if w == 0 else gray[2 * ((w - 1) // 2)]
                turn = 0 if w == 0 else _trailing_ones(w if w % 2 else w - 1) % n
                at = (entry * n + direction) * corners + corner
                digits[at] = w
                following[at] = (entry ^ _rotate_left(inner_entry, direction + 1, n)) * n + (direction + turn + 1) % n
    return digits, following


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """Index on the curve of a cell given by one integer level (0 to 2^bits - 1) per dimension; built-in functions only."""
    n = len(levels)
    digits, following = curve_tables(n)
    digit_of, next_of = (F.array(*[F.lit(v) for v in t]) for t in (digits, following))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("h"))

    def step(acc: Column, bit: Column, cell: Column) -> Column:
        corner = F.lit(0)
        for k in range(n):
            corner = corner + F.pmod(F.floor(cell[k] / F.pow(F.lit(2.0), bit)), F.lit(2)).cast("int") * (1 << k)
        return let(
            (acc["state"] * (1 << n) + corner).cast("int"),
            lambda at: F.struct(
                F.get(next_of, at).alias("state"),
                (acc["h"] * (1 << n) + F.get(digit_of, at)).cast("long").alias("h"),
            ),
        )

    return let(
        F.array(*[x.cast("int") for x in levels]),
        lambda cell: F.aggregate(
            F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, lambda acc, bit: step(acc, bit, cell), lambda acc: acc["h"]
        ),
    )


def _text_rank(value: Column, skip: int) -> Column:
    """An order-keeping number from the three characters after a common prefix."""
    code = F.lit(0)
    for k in range(3):
        code = code * 128 + F.least(F.ascii(F.substring(value, skip + k + 1, 1)), F.lit(127))
    return code.cast("double")


def dimension_levels(df: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """One order-keeping level per column: strings by the characters after the prefix all values share, numbers by
    logarithm. Only the minimum and maximum of each column come to the driver. Null: level 0."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = df.agg(*[f(F.col(d)).alias(f"{d}__{n}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top, levels = (1 << bits) - 1, []
    for d in dims:
        lo, hi = found[f"{d}__lo"], found[f"{d}__hi"]
        if lo is None:
            levels.append(F.lit(0))
            continue
        if isinstance(kinds[d], T.StringType):
            skip = 0
            while skip < min(len(lo), len(hi)) and lo[skip] == hi[skip]:
                skip += 1
            number = _text_rank(F.col(d), skip)
            low, high = _text_rank(F.lit(lo), skip), _text_rank(F.lit(hi), skip)
        else:
            number = F.log1p(F.col(d).cast("double") - F.lit(float(lo)))
            low, high = F.lit(0.0), F.log1p(F.lit(float(hi) - float(lo)))
        level = F.floor((number - low) / F.greatest(high - low, F.lit(1e-9)) * top).cast("int")
        levels.append(F.coalesce(F.greatest(F.lit(0), F.least(F.lit(top), level)), F.lit(0)))
    return levels


def hilbert_shards(
    df: DataFrame, dims: list[str], n_shards: int, order: list[str], keep: list[str], bits: int = BITS
) -> DataFrame:
    """Assigns every row a shard and a gapless slot: rows in curve order, cut into ``n_shards`` runs whose counts differ
    by one at most (law ``rows``).

    dims: metadata columns of the curve; order: columns that break ties inside a cell (with them every row has one
    place); keep: columns returned beside curve_index, shard, slot. Rows are range-partitioned by (index, order), so a
    cell of any size is spread over tasks; the driver sees one count per partition. Nulls in a dimension take level 0,
    equal rows stand side by side in any order, an empty table gives no rows. No Python runs on executors.
    """
    spark = df.sparkSession
    placed = df.select(*keep, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], hilbert_index(dimension_levels(df, dims, bits), bits).alias("curve_index"))
    keys = ["curve_index", *[f"__o{i}" for i in range(len(order))]]
    runs = stored(
        placed.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).select(
            *keep, "curve_index", F.monotonically_increasing_id().alias("__at")
        ),
        "curve",
    )
    block, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = {r["b"]: r["n"] for r in runs.groupBy(block.alias("b")).count().withColumnRenamed("count", "n").collect()}
    starts, total = [], 0
    for b in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(b, 0)
    if not total:
        rank = F.lit(0).cast("long")
    else:
        rank = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), block.cast("int")) + row
    n = max(1, total)
    ranked = runs.withColumn("__rank", rank)
    ranked = ranked.withColumn("shard", F.expr(f"cast((__rank * {n_shards}L) div {n}L as int)"))
    start = F.expr(f"(cast(shard as bigint) * {n}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("slot", F.col("__rank") - start).drop("__rank", "__at")


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Writes one directory per shard, rows in slot order; a reader prunes shards and row groups on every dimension."""
    df.repartition(F.col(shard)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def document_shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The documents contract: size and crc of the text, law ``rows``, shard, slot; grown_shard is null under this law.

    A null text counts as no bytes and crc 0. Ties inside a cell go by text crc and doc_id, so equal texts of one
    source stay together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = hilbert_shards(base, ["lang", "source", "n_chars"], n_shards, ["text_crc32", "doc_id"], ["doc_id", "size", "text_crc32", "lang", "source", "n_chars"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index"
    )
