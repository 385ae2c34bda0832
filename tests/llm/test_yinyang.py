"""Yinyang k-means against plain rounds over Python integers."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from loomrec.llm import yinyang
from loomrec.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, differences

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, q string"


def plain(rows, k=8, rounds=10, seed=3, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        own = [min((gap(v, m), j) for j, m in enumerate(c)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, o) in zip(kept, own) if o == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = Counter()
    for d, j in own:
        inertia[j] += d
    return sorted(
        ((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own)),
        key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_query_equals_sql(spark, sf_dir):
    name = "op11_yinyang_clusters"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) == ""


def test_ties_nulls_copies_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 64)).astype(np.float32)
    rows = [(i, (base[i % 6] + rng.normal(scale=0.4, size=64)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [float("nan")])]
    rows += [(504, [None] + [1.0] * 63), (505, [float("inf")] + [0.0] * 63)] + [(i, [0.0] * 64) for i in range(600, 640)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)
    assert got(yinyang.cluster_digest(df)) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_clusters(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert got(yinyang.cluster_digest(spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA))) == plain(rows)


def test_components_beyond_the_range_saturate(spark):
    df = spark.createDataFrame([(1, [3e38] * 64, 0, 0, ""), (2, [-3e38] * 64, 0, 0, "")], SCHEMA)
    assert [r["distance"] for r in yinyang.cluster_digest(df).collect()] == [0, 0]


def test_bounds_stay_sound_and_filters_pass_over_vectors():
    rng = np.random.default_rng(2)
    q = rng.integers(-400, 400, (3000, 16)) + np.repeat(rng.integers(-900, 900, (12, 16)), 250, 0)
    c = q[rng.choice(len(q), 12, replace=False)].copy()
    model = yinyang.Model(c, yinyang.group_centroids(c), np.zeros(12))
    assert model.n_groups == 3
    cluster, upper, lower = yinyang.first_bounds(q, model)
    passed = 0
    for _ in range(8):
        new = np.stack([q[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(12)])
        drift = np.sqrt(((new - c) ** 2).sum(1))
        model, c = yinyang.Model(new, model.groups, drift * (1 + yinyang.SLACK)), new
        passed += int((upper + model.drift[cluster] < (lower - [model.drift[model.groups == g].max() for g in range(3)]).min(1)).sum())
        cluster, upper, lower = yinyang.next_bounds(q, cluster, upper, lower, model)
        d = ((q[:, None] - c[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        root, rows = np.sqrt(d), np.arange(len(q))
        assert (upper >= root[rows, cluster]).all()
        root[rows, cluster] = np.inf
        assert all((lower[:, g] <= root[:, model.groups == g].min(1)).all() for g in range(3))
    assert passed > len(q)
