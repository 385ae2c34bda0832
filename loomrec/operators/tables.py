"""Tables in the folder that all executors share, for results that later steps of one operator read more than once."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local one in a single-machine session and an error on a cluster."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        wanted = spark.conf.get("spark.checkpoint.dir", "")
        if not wanted and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="loomrec-"))
    return context.getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back: computed once, short lineage, safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            drop_path(df.sparkSession, os.path.dirname(file))


_BUILT: ContextVar[dict[tuple, DataFrame] | None] = ContextVar("built", default=None)


@contextmanager
def shared_tables() -> Iterator[None]:
    """Inside, ``once`` stores each table that it is asked for; a scope within another one shares its tables."""
    if _BUILT.get() is not None:
        yield
        return
    token = _BUILT.set({})
    try:
        yield
    finally:
        _BUILT.reset(token)


def once(key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of this key, built and stored the first time that a query asks for it; outside of ``shared_tables`` merely its plan.
    For tables that several parts of one query read, which Spark would otherwise derive anew for each."""
    built = _BUILT.get()
    if built is None:
        return build()
    if key not in built:
        built[key] = stored(build(), str(key[0]))
    return built[key]
