"""Structured Streaming forms of the operators that need only one record, one window or one key at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.joins import nearest_neuron


def project_stream(vectors: DataFrame, vector: str, ids: np.ndarray, w: np.ndarray, keep: list[str]) -> DataFrame:
    """Best matching neuron of every arriving vector; stateless, so it runs in append mode without a shuffle."""
    return nearest_neuron(vectors, vector, ids, w, keep)


def windowed(events: DataFrame, time: str, value: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Count, sum and extremes of ``value`` per window and key; rows later than ``late`` behind the newest are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("window.start").alias("beg"), F.col("window.end").alias("end"), *keys, "n", "total", "low", "high")


def running_best(hits: DataFrame, key: str, score: str, item: str, n: int) -> DataFrame:
    """The n best items per key so far, sent again for each key that a batch touches; the state of a key is n items."""
    out = f"`{key}` string, item long, score double, rank int"

    def update(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = list(zip(*state.get)) if state.exists else []
        for f in frames:
            f = f.dropna(subset=[score, item])
            best = sorted({*best, *zip(f[score].tolist(), f[item].tolist())}, key=lambda x: (-x[0], x[1]))[:n]
        if best:
            state.update(tuple(list(c) for c in zip(*best)))
            yield pd.DataFrame({key: name[0], "item": [int(b[1]) for b in best], "score": [float(b[0]) for b in best], "rank": range(1, len(best) + 1)})

    typed = hits.select(F.col(key).cast("string").alias(key), F.col(score).cast("double").alias(score), F.col(item).cast("long").alias(item))
    return typed.groupBy(key).applyInPandasWithState(update, out, "scores array<double>, items array<long>", "update", "NoTimeout")
