"""File sources and sinks: manifests, resume points, signatures, atomic publishing, keyed layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_scan(spark: SparkSession, root: str, files: dict[str, str], schema: str) -> DataFrame:
    """Union of one JSON-lines file per category under ``root``; a path that leaves the root is refused."""
    for name in files.values():
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"path outside the allowed root: {name}")
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).json(f"{root}/{f}").withColumn("category", F.lit(c)) for c, f in files.items()])


def signature(df: DataFrame) -> DataFrame:
    """Row count and an order-free checksum of all rows."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(2**31))).alias("checksum"))


def resume_points(loaded: DataFrame) -> DataFrame:
    return loaded.groupBy("source", "category").agg(F.max("source_line").alias("resume_after"))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Target with ``rows`` merged in: of each key the highest version stays, new rows winning ties."""
    both = target.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    names = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(version, "__new")).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}") for c in names if c != "__new"])


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None, max_rows: int | None = None) -> int:
    """Writes beside ``path``, checks the size, moves the old table aside, renames the new one into place and deletes the old
    one last. Between the two renames readers find no table; if the second fails, the old one is put back."""
    spark = df.sparkSession
    staging = f"{path}.staging"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    rows = spark.read.parquet(staging).count()
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if max_rows is not None and rows > max_rows:
        fs.delete(source, True)
        raise ValueError(f"{rows} rows exceed the cap of {max_rows}")
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.replaced")
    fs.delete(aside, True)
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(source, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"cannot publish {path}")
    fs.delete(aside, True)
    return rows


def keyed_layouts(df: DataFrame, path: str, layouts: dict[str, list[str]], buckets: int = 64) -> None:
    """The same rows under several lookup keys: one directory per layout, partitioned by the key's bucket and sorted."""
    for name, keys in layouts.items():
        bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        bucketed.repartition("bucket").sortWithinPartitions("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def point_lookup(spark: SparkSession, path: str, layout: str, key: dict[str, object], buckets: int = 64, limit: int | None = None) -> DataFrame:
    """Rows of one key: the bucket prunes directories, the sort order prunes row groups."""
    rows = spark.read.parquet(f"{path}/{layout}")
    typed = [F.lit(v).cast(rows.schema[k].dataType) for k, v in key.items()]  # the hash depends on the type
    hashed = spark.range(1).select(F.pmod(F.xxhash64(*typed), F.lit(buckets)).alias("b")).first()["b"]
    found = rows.filter(F.col("bucket") == hashed)
    for name, value in key.items():
        found = found.filter(F.col(name) == F.lit(value))
    return found.limit(limit) if limit else found
