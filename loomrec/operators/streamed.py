"""Rules that depend on the order of a group's rows, over many small groups: a task streams its sorted rows, group after group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT_ROWS = 10_000


def in_order(df: DataFrame, key: str, order: list[Column], run: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``run`` on the rows of each key in order, as tuples of the columns of ``df`` (the key first). A frame per group, as
    applyInPandas makes, costs far more than the rows of a small group do. A group's rows must fit a task, as there."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], names=target.names)

        for _, group in groupby(rows, lambda r: r[0]):
            out.extend(run(list(group)))
            if len(out) >= OUT_ROWS:
                yield flush()
                out.clear()
        if out:
            yield flush()

    wanted = df.select(key, *[c for c in df.columns if c != key])
    return wanted.repartition(key).sortWithinPartitions(key, *order).mapInArrow(stream, schema)
