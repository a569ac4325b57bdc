"""Streaming extensions: the same counts as in batch, over arriving hops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Arriving Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def visits(df: DataFrame, at: str, place: str, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, place, n: visits in windows; a window is final when the watermark has passed it."""
    w = df.withWatermark(at, late).groupBy(F.window(at, length), place)
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), place, "n")


def stays(df: DataFrame, at: str, subject: str, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """subject, start, end, n: sessions of a subject."""
    s = df.withWatermark(at, late).groupBy(F.session_window(at, gap), subject)
    return s.agg(F.count("*").alias("n")).select(subject, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def last_places(df: DataFrame, subject: str, at: str, place: str) -> DataFrame:
    """subject, place, at: the latest place of each subject, emitted whenever it changes; the state is one row per subject."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else (None, None)
        best = known
        for b in batches:
            b = b.dropna(subset=[at, place]).sort_values([at, place])
            if len(b):
                row = b.iloc[-1]
                if best[1] is None or row[at].to_pydatetime() >= best[1]:
                    best = (row[place], row[at].to_pydatetime())
        if best != known:
            state.update(best)
            yield pd.DataFrame({subject: [key[0]], place: [best[0]], at: [best[1]]})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (subject, place, at)}
    out = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return df.groupBy(subject).applyInPandasWithState(update, out, f"{place} {kinds[place]}, {at} {kinds[at]}", "update", GroupStateTimeout.NoTimeout)
