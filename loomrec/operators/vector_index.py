"""Vectors stored in k-means cells, searched in the cells nearest to each query.

The cells are fitted on a sample of bounded size; every row is indexed. Cells are Parquet partitions, so that a search reads only those it
probes; probing all of them gives the exact result. Later rows are added to the fitted cells as further folders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.operators import vector_join as N
from loomrec.operators.recall import top_k
from loomrec.operators.tables import drop_stored, stored
from loomrec.sources.manifests import commit_manifest, new_folder, read_manifest, write_dealt

#: Cells grow with the square root of the rows up to here: 4,096 centroids of 1,024 doubles are 32 MB, the most a task is sent.
MOST_CELLS = 4096
#: Rows of the sample per cell, as many as the fit reads in each of its rounds.
SAMPLE_PER_CELL = 64
ROUNDS = 8
#: Components of unit vectors are summed as integers of this scale, so that a sum doesn't depend on its order.
SCALE = 1 << 20


def _near(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.round(unit @ centroids.T, 9)


def _fit(sample: DataFrame, cells: int, rounds: int) -> np.ndarray:
    """Unit centroids by spherical k-means on (id, vector) rows. Only centroids reach the driver. They begin as the sample's first
    vectors in hash order; a cell that empties keeps its centroid."""
    first = sample.orderBy(F.xxhash64("id"), "id").limit(cells).select("vector").collect()
    if not first:
        return np.zeros((0, 0))
    centroids = N._unit(pd.Series([r["vector"] for r in first]))
    for _ in range(rounds):
        at = centroids

        def sums(batches: Iterator[pd.DataFrame], at: np.ndarray = at) -> Iterator[pd.DataFrame]:
            total, seen = np.zeros(at.shape, np.int64), np.zeros(len(at), np.int64)
            for pdf in batches:
                if len(pdf):
                    unit = N._unit(pdf["vector"])
                    cell = _near(unit, at).argmax(axis=1)
                    np.add.at(total, cell, np.floor(unit * SCALE).astype(np.int64))
                    np.add.at(seen, cell, 1)
            held = np.flatnonzero(seen)
            yield pd.DataFrame({"cell": held.astype(np.int32), "total": list(total[held])})

        parts = sample.select("vector").mapInPandas(sums, "cell int, total array<long>").select("cell", F.posexplode("total").alias("dim", "x"))
        merged = parts.groupBy("cell", "dim").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("total"))
        moved = centroids.copy()
        for r in merged.collect():
            length = np.linalg.norm(np.array(r["total"], np.float64))
            if length > 0:
                moved[r["cell"]] = np.array(r["total"], np.float64) / length
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def _place(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, vector, cell): the nearest cell of every row; ties go to the smaller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=_near(N._unit(pdf["vector"]), centroids).argmax(axis=1).astype(np.int32))

    return vectors.select("id", "vector").mapInPandas(run, "id long, vector array<double>, cell int")


def _write(vectors: DataFrame, root: str, centroids: np.ndarray, block_rows: int) -> tuple[str, int]:
    placed = stored(_place(vectors, centroids), "placed")  # placed once, counted and dealt from there
    folder = new_folder("vectors")
    write_dealt(placed, f"{root}/{folder}", "cell", "id", block_rows, ["id"])
    rows = placed.count()
    drop_stored(placed)
    return folder, rows


def _centroids(spark: SparkSession, root: str, content: dict) -> np.ndarray:
    rows = spark.read.schema("cell int, vector array<double>").parquet(f"{root}/{content['centroids']}").orderBy("cell").collect()
    return np.array([r["vector"] for r in rows], np.float64)


def build_index(vectors: DataFrame, root: str, dims: int, cells: int | None = None, sample_per_cell: int = SAMPLE_PER_CELL, rounds: int = ROUNDS, block_rows: int = N.BLOCK_ROWS) -> int:
    """Fits cells and stores every row of ``vectors`` (id, vector; as ``usable`` gives them) as a new version under ``root``.

    cells: the rounded root of the number of rows, at most MOST_CELLS, unless given. The sample holds about ``sample_per_cell`` rows a cell,
    chosen by the hash of the id, copies once. A repeated id is stored as often as it occurs. No rows: an empty index.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    cells = min(n, cells or min(MOST_CELLS, round(n**0.5)))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, cells * sample_per_cell / max(1, n)))
    sample = stored(vectors.filter(share).groupBy("vector").agg(F.min("id").alias("id")), "sample")
    centroids = _fit(sample, cells, rounds)
    fitted = sample.count()
    drop_stored(sample)
    after, _ = read_manifest(spark, root)
    content = {"dims": dims, "cells": len(centroids), "fitted_on": fitted, "block_rows": block_rows, "centroids": new_folder("centroids"), "folders": [], "rows": 0}
    table = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(table, "cell int, vector array<double>").coalesce(1).write.parquet(f"{root}/{content['centroids']}")
    if len(centroids):
        folder, content["rows"] = _write(vectors, root, centroids, block_rows)
        content["folders"] = [folder]
    return commit_manifest(spark, root, after, content)


def add_vectors(vectors: DataFrame, root: str) -> int:
    """Stores further rows in the cells fitted before. Needs a built index; an empty one is built instead of added to."""
    spark = vectors.sparkSession
    after, content = read_manifest(spark, root)
    if not content:
        raise ValueError(f"no index at {root}")
    if not content["cells"]:
        return build_index(vectors, root, content["dims"], block_rows=content["block_rows"])
    folder, rows = _write(vectors, root, _centroids(spark, root, content), content["block_rows"])
    if not rows:
        return after
    return commit_manifest(spark, root, after, {**content, "folders": [*content["folders"], folder], "rows": content["rows"] + rows})


def folders_of(content: dict) -> list[str]:
    """The folders that a manifest names, as ``vacuum`` asks for them."""
    return [content["centroids"], *content["folders"]]


def _nearest_cells(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                order = np.argsort(-_near(N._unit(pdf["vector"]), centroids), axis=1, kind="stable")
                yield pdf.assign(cells=list(order[:, :probes].astype(np.int32)))

    return queries.select("id", "vector").mapInPandas(run, "id long, vector array<double>, cells array<int>").select("id", "vector", F.explode("cells").alias("cell"))


def search(queries: DataFrame, root: str, k: int, probes: int | None = None, drop_self: bool = False, least: float = 0.0, version: int | None = None) -> DataFrame:
    """(query, item, score, rank): the k greatest cosines (six decimals, above ``least``) among the items of each query's ``probes`` nearest cells.

    queries: (id, vector) of ``usable``. probes: the calibrated number, or all, if not given. Only folders of probed cells are read. A cell's
    items and the queries that ask it meet in blocks, so a hot cell takes as many tasks as it has pairs of blocks.
    """
    spark = queries.sparkSession
    _, content = read_manifest(spark, root, version)
    if not content or not content["cells"] or not content["rows"]:
        return spark.createDataFrame([], "query long, item long, score double, rank int")
    probes = min(probes or content.get("probes") or content["cells"], content["cells"])
    asked = stored(_nearest_cells(queries, _centroids(spark, root, content), probes), "asked")
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # no more than there are centroids
    schema = "id long, vector array<double>, part int, cell int"
    items = None
    for number, folder in enumerate(content["folders"]):
        one = spark.read.schema(schema).parquet(f"{root}/{folder}").filter(F.col("cell").isin(cells)).withColumn("folder", F.lit(number))
        items = one if items is None else items.unionByName(one)
    blocks = items.groupBy("cell").agg(F.collect_set(F.struct("folder", "part")).alias("blocks"))
    groups = asked.groupBy("cell").agg(F.ceil(F.count("*") / content["block_rows"]).cast("int").alias("groups"))
    left = asked.join(F.broadcast(groups), "cell").join(F.broadcast(blocks), "cell").withColumn("a", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    left = left.select("cell", F.explode("blocks").alias("b"), "a", "id", "vector").select("cell", "b.folder", "b.part", "a", "id", "vector", F.lit(None).cast("long").alias("seen"))
    right = items.join(F.broadcast(groups), "cell").select("cell", "folder", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("a"), "id", "vector")
    keys = ["cell", "folder", "part", "a"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(N.block_scores(k, drop_self, least), "query long, item long, score double")
    return top_k(found, ["query"], [F.col("score").desc(), F.col("item")], k)


def recall_by_probes(queries: DataFrame, exact: DataFrame, root: str, k: int, probes: list[int], drop_self: bool = False) -> DataFrame:
    """(probes, n_expected, n_found, recall): the share of the pairs of ``exact`` (query, item) that a search with so many probes finds."""
    spark = queries.sparkSession
    want = exact.select("query", "item").distinct()
    out = None
    for p in probes:
        found = search(queries, root, k, p, drop_self).select("query", "item").distinct().withColumn("hit", F.lit(1))
        one = want.join(found, ["query", "item"], "left").agg(F.count("*").alias("n_expected"), F.count("hit").alias("n_found"))
        one = one.select(F.lit(p).alias("probes"), "*", F.when(F.col("n_expected") > 0, F.round(F.col("n_found") / F.col("n_expected"), 6)).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "probes int, n_expected long, n_found long, recall double")


def calibrate(queries: DataFrame, root: str, k: int, goal: float = 0.9, drop_self: bool = False) -> int:
    """Doubles the probes until the measured recall reaches ``goal``, and makes that number the default of ``search``. The exact side
    is the index with all cells probed; the cost grows with the queries, which the caller bounds."""
    spark = queries.sparkSession
    after, content = read_manifest(spark, root)
    exact = stored(search(queries, root, k, max(1, content["cells"]), drop_self), "exact")
    probes = 1
    while probes < content["cells"]:
        share = recall_by_probes(queries, exact, root, k, [probes], drop_self).first()["recall"]
        if share is None or share >= goal:
            break
        probes *= 2
    probes = max(1, min(probes, content["cells"]))
    drop_stored(exact)
    commit_manifest(spark, root, after, {**content, "probes": probes})
    return probes
