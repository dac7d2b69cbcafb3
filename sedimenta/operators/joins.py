"""Joins the planner has no name for: last hit wins, nearest neuron, neighbours within a radius, positions in intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest codebook (neurons x dimensions) that is sent to every worker, in numbers.
CODEBOOK_MAX = 50_000_000


def last_wins(left: DataFrame, right: DataFrame, key: str, order: str, value: str, default) -> DataFrame:
    """Left lookup of ``value``; the row with the highest ``order`` counts, keys without one get ``default``."""
    last = right.groupBy(key).agg(F.max(F.struct(order, value)).alias("__last")).select(key, F.col(f"__last.{value}").alias(value))
    return left.join(last, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def codebook(neurons: DataFrame, neuron: str, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a model's neurons, ordered by id; refused beyond a fixed size, as it goes to every worker."""
    rows = neurons.agg(F.count("*").alias("n"), F.max(F.size(weights)).alias("d")).first()
    if (rows["n"] or 0) * (rows["d"] or 0) > CODEBOOK_MAX:
        raise ValueError(f"a codebook holds at most {CODEBOOK_MAX} numbers")
    got = neurons.select(F.col(neuron).cast("long").alias("i"), F.col(weights).cast("array<double>").alias("w")).orderBy("i").toArrow()
    w = got.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return got.column("i").to_numpy(), w.reshape(got.num_rows, -1)


def best_of(x: np.ndarray, ids: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(neuron, squared distance) nearest to each row; ties to the lowest neuron. Exact distances decide near ties."""
    out, best = np.zeros(len(x), np.int64), np.zeros(len(x))
    ww = (w * w).sum(1)
    top = np.abs(ww).max(initial=0)
    for lo in range(0, len(x), 256):
        block = x[lo : lo + 256]
        d2 = ww[None] - 2 * block @ w.T
        at = d2.argmin(1)
        slack = 1e-9 * (1 + top + (block * block).sum(1))
        near = d2 <= (d2[np.arange(len(block)), at] + slack)[:, None]
        # rows in which others come as near as rounding could decide are solved again; there are few
        for r in np.flatnonzero(near.sum(1) > 1):
            some = np.flatnonzero(near[r])
            at[r] = some[((w[some] - block[r]) ** 2).sum(1).argmin()]
        out[lo : lo + 256] = ids[at]
        best[lo : lo + 256] = ((w[at] - block) ** 2).sum(1)
    return out, best


def nearest_neuron(vectors: DataFrame, vector: str, ids: np.ndarray, w: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` with ``neuron`` and ``distance2`` of the best matching neuron of each vector; vectors that are null or hold NaN are left out.

    The codebook is a model of bounded size: it travels with the task, vectors don't move, and there is no shuffle.
    """
    narrow = vectors.select(*keep, F.col(vector).cast("array<double>").alias("__v")).where(F.col("__v").isNotNull() & ~F.exists("__v", lambda x: x.isNull() | F.isnan(x)) & (F.size("__v") == w.shape[1]))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("neuron", T.LongType()), T.StructField("distance2", T.DoubleType())])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            n, d2 = best_of(x, ids, w)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(n), pa.array(d2)], [*b.schema.names[:k], "neuron", "distance2"])

    return narrow.mapInArrow(run, schema)


def neighbours_within(centres: np.ndarray, vectors: DataFrame, vector: str, radius: float) -> DataFrame:
    """(centre, n): vectors within ``radius`` of each of a bounded set of centres, counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centres), np.int64)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for lo in range(0, len(centres), 512):
                c = centres[lo : lo + 512]
                d2 = (c * c).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * c @ x.T
                count[lo : lo + 512] += (np.sqrt(np.maximum(d2, 0)) <= radius).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), pa.array(count)], ["centre", "n"])

    usable = vectors.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    return usable.mapInArrow(run, "centre long, n long").groupBy("centre").agg(F.sum("n").alias("n"))


def condensed_distances(vectors: DataFrame, index: str, vector: str) -> DataFrame:
    """(i, j, d): Euclidean distances of a codebook's vectors, for i > j; the codebook is of checked size and travels with the task."""
    ids, w = codebook(vectors, index, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v in zip(b.column(0).to_numpy(), b.column(1)):
                low = ids < i
                d = np.sqrt(((w[low] - np.asarray(v.as_py())) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i)), pa.array(ids[low]), pa.array(d)], ["i", "j", "d"])

    return vectors.select(F.col(index).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "i long, j long, d double")


def match_distances(vectors: DataFrame, matches: DataFrame, neurons: DataFrame, index: str, vector: str) -> DataFrame:
    """(index, row, col, distance) of every vector to the neuron that its stored best match names.

    ``matches``: index, row, col. ``neurons``: row, col, w. Vectors without a match, or whose match is no neuron, have none.
    """
    from sedimenta.functions.vectors import distance

    at = vectors.select(F.col(index).alias("index"), F.col(vector).cast("array<double>").alias("v")).join(matches.select("index", "row", "col"), "index")
    return at.join(neurons.select("row", "col", "w"), ["row", "col"]).select("index", "row", "col", distance("euclid", F.col("v"), F.col("w")).alias("distance"))


def local_neuron(vectors: DataFrame, vector: str, before: str, ids: np.ndarray, w: np.ndarray, columns: int, keep: list[str], box: int) -> DataFrame:
    """Like ``nearest_neuron``, among the neurons at most ``box`` rows and columns from the neuron in ``before`` on the toroid.

    ``ids`` are 0, 1, ... row by row; a vector whose ``before`` is null searches the whole map.
    """
    rows = len(ids) // columns
    narrow = vectors.select(*keep, F.col(before).cast("long").alias("__b"), F.col(vector).cast("array<double>").alias("__v")).where(F.col("__v").isNotNull() & ~F.exists("__v", lambda x: x.isNull() | F.isnan(x)) & (F.size("__v") == w.shape[1]))
    schema = T.StructType([*narrow.schema.fields[:-2], T.StructField("neuron", T.LongType()), T.StructField("distance2", T.DoubleType())])
    k, step = len(keep), np.arange(-box, box + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(k + 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            was = b.column(k).fill_null(-1).to_numpy()
            n, d2 = np.zeros(len(x), np.int64), np.zeros(len(x))
            for start in np.unique(was):  # vectors of one former match share their box
                mine = was == start
                near = ids if start < 0 else np.unique((((start // columns + step) % rows)[:, None] * columns + ((start % columns + step) % columns)[None]).ravel())
                n[mine], d2[mine] = best_of(x[mine], near, w[near])
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(n), pa.array(d2)], [*b.schema.names[:k], "neuron", "distance2"])

    return narrow.mapInArrow(run, schema)


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, pos: str, beg: str, end: str, width: int) -> DataFrame:
    """Points joined with the intervals of their key that hold them (inclusive).

    Both sides meet on (key, bin of ``width`` positions), so that a key's points meet only intervals near them.
    """
    p = points.withColumn("__bin", F.floor(F.col(pos) / width))
    i = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(beg) / width), F.floor(F.col(end) / width))))
    return p.join(i, [key, "__bin"]).where(F.col(pos).between(F.col(beg), F.col(end))).drop("__bin")
