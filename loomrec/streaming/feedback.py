"""The feedback log as a stream: idempotent append within a watermark, and version-guarded preference state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "version long, kind string, ts timestamp"
OUTPUT = "profile_id long, item_id long, kind string, version long"


def deduplicated(stream: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def hourly_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "kind", "n")


def preference_state(stream: DataFrame) -> DataFrame:
    """Latest explicit preference per (profile, item): an event whose version isn't above the stored one changes nothing,
    however late it comes. Versions here are event ids, which grow with acceptance."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        version, kind = state.get[:2] if state.exists else (-1, None)
        changed, ts = False, state.get[2] if state.exists else None
        for pdf in batches:
            own = pdf[pdf["kind"].isin(["LIKE", "DISLIKE"])].sort_values("event_id")
            if len(own) and int(own["event_id"].iloc[-1]) > version:
                last = own.iloc[-1]
                version, kind, ts, changed = int(last["event_id"]), str(last["kind"]), last["ts"], True
        if changed:
            state.update((version, kind, ts))
            yield pd.DataFrame([(key[0], key[1], kind, version)], columns=["profile_id", "item_id", "kind", "version"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    explicit = stream.filter(F.col("kind").isin("LIKE", "DISLIKE"))
    return explicit.groupBy("profile_id", "item_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
