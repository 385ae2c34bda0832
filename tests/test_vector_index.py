"""Stored vector index: exact with all cells, recall by probes, pruning, added rows, empty tables, hot cells; manifests."""

from __future__ import annotations

import numpy as np
import pytest

from loomrec.operators import vector_index as X
from loomrec.operators import vector_join as N
from loomrec.sources import manifests as M
from tests.test_vector_join import SCHEMA, brute


def clustered(seed, n, dims=8, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims)) * 3
    return [(i, [float(x) for x in c[i % centres] + rng.normal(size=dims)]) for i in range(n)]


def rows_of(df):
    return {tuple(r) for r in df.select("query", "item", "score", "rank").collect()}


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_all_cells_equal_brute_force(spark, tmp_path, block_rows):
    items = clustered(1, 150) + [(500 + i, [1.0] * 8) for i in range(60)] + [(3, clustered(1, 4)[3][1])]  # copies fill one cell, one id twice
    queries = [r for r in items if r[0] % 20 == 0]
    root = str(tmp_path / "ix")
    df = spark.createDataFrame(items[:160], SCHEMA)
    X.build_index(df, root, 8, block_rows=block_rows)
    X.add_vectors(spark.createDataFrame(items[160:], SCHEMA), root)
    _, content = M.read_manifest(spark, root)
    assert content["rows"] == len(items) and len(content["folders"]) == 2
    q = spark.createDataFrame(queries, SCHEMA)
    assert rows_of(X.search(q, root, 6, content["cells"], drop_self=True)) == brute(queries, items, 6, drop_self=True)


def test_recall_grows_and_cells_are_pruned(spark, tmp_path):
    items = clustered(2, 600)
    root = str(tmp_path / "ix")
    df = spark.createDataFrame(items, SCHEMA)
    X.build_index(df, root, 8)
    q = df.filter("id % 15 = 0")
    exact = N.block_top_k(q, df, 5, drop_self=True)
    cells = M.read_manifest(spark, root)[1]["cells"]
    shares = [r["recall"] for r in X.recall_by_probes(q, exact, root, 5, [1, 4, cells], True).orderBy("probes").collect()]
    assert shares == sorted(shares) and shares[0] < 1.0 and shares[-1] == 1.0
    probes = X.calibrate(q, root, 5, 0.9, True)
    assert probes < cells and M.read_manifest(spark, root)[1]["probes"] == probes
    found = X.search(q, root, 5, drop_self=True)
    want = {(r["query"], r["item"]) for r in exact.collect()}
    assert len(want & {(r["query"], r["item"]) for r in found.collect()}) >= 0.9 * len(want)
    one = X.search(q.filter("id = 0"), root, 5, 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan, plan
    files = {f.rsplit("cell=", 1)[1].split("/")[0] for f in spark.read.parquet(f"{root}/{M.read_manifest(spark, root)[1]['folders'][0]}").inputFiles()}
    assert len(files) > 4


def test_same_cells_for_other_partitions(spark, tmp_path):
    items = spark.createDataFrame(clustered(3, 200), SCHEMA)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    X.build_index(items.repartition(3), a, 8)
    X.build_index(items.repartition(7), b, 8)
    cells = [X._centroids(spark, r, M.read_manifest(spark, r)[1]) for r in (a, b)]
    assert np.array_equal(*cells)


def test_empty(spark, tmp_path):
    root, none = str(tmp_path / "ix"), spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], SCHEMA)
    assert X.search(some, root, 3).count() == 0
    with pytest.raises(ValueError, match="no index"):
        X.add_vectors(some, root)
    X.build_index(none, root, 2)
    assert X.search(some, root, 3).count() == 0
    X.add_vectors(some, root)
    assert X.add_vectors(none, root) == M.versions(spark, root)[-1]
    assert rows_of(X.search(some, root, 3, drop_self=True)) == {(1, 2, 0.707107, 1), (2, 1, 0.707107, 1)}
    assert X.search(none, root, 3).count() == 0


def test_versions_conflicts_and_vacuum(spark, tmp_path):
    root = str(tmp_path / "ix")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], SCHEMA)
    first = X.build_index(some, root, 2)
    second = X.add_vectors(spark.createDataFrame([(3, [1.0, 0.5])], SCHEMA), root)
    assert (first, second) == (1, 2)
    with pytest.raises(M.Conflict):
        M.commit_manifest(spark, root, first, {})
    assert X.search(some, root, 5, version=1).filter("item = 3").count() == 0 < X.search(some, root, 5).filter("item = 3").count()
    X.build_index(some, root, 2)
    gone = M.vacuum(spark, root, X.folders_of, keep=1)
    assert len(gone) == 3 and M.versions(spark, root) == [3]
    assert X.search(some, root, 5).count() == 4
