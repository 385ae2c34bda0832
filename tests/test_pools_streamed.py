"""Pools per user are picked from streamed rows, without a frame for each user."""

from __future__ import annotations

import random

from loomrec.operators import candidates as C


def test_pools_make_no_frames(spark):
    rng = random.Random(2)
    rows = [(u, i, rng.randrange(8) / 8, ",".join(s for s in "abc" if rng.random() < 0.6) or "b") for u in range(9) for i in range(rng.randrange(25))]
    merged = spark.createDataFrame(rows, "user_id long, item_id long, score double, sources string")
    limited, balanced = C.limit_pool(merged, 6, {"c": 2, "a": 1}, {"b": 3}), C.balanced_pool(merged, 6, ["c", "a", "b"])
    for df in (limited, balanced):
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    got: dict = {}
    for which, df in enumerate((limited, balanced)):
        for r in sorted(df.collect(), key=lambda r: r["slot"]):
            got.setdefault((which, r["user_id"]), []).append((-r["score"], r["item_id"], r["sources"]))
    for u in {r[0] for r in rows}:
        own = sorted((-s, i, names) for v, i, s, names in rows if v == u)
        picks: list = []
        fits = lambda row: "b" not in row[2] or sum("b" in p[2] for p in picks) < 3  # noqa: B023, E731
        for source, least in (("c", 2), ("a", 1), ("", 6)):
            for row in own:
                if len(picks) < 6 and row not in picks and source in row[2] and fits(row) and sum(source in p[2] for p in picks) < least:
                    picks.append(row)
        assert got[0, u] == sorted(picks)
        turn: list = []
        while len(turn) < min(6, len(own)):
            for source in "cab":
                row = next((r for r in own if source in r[2] and r not in turn), None)
                if row is not None and len(turn) < 6:
                    turn.append(row)
        assert got[1, u] == turn
