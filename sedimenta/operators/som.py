"""Self-organising maps on a toroid: grid, cooling, neighbourhoods, training, projection, U-matrix, growing.

The map is a model of bounded size and lives as one NumPy matrix (neurons x dimensions), row-major, numbered from 0; it
is sent to the workers. Data stay distributed: an epoch of batch training is one pass in which every task finds best
matches and adds its vectors up per neuron, and the sums of all tasks (neurons x dimensions) are merged per neuron.
Online and k-batch training depend on the order of the vectors and run in one task, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.joins import best_of
from sedimenta.operators.linalg import Moments, principal_components

#: Vectors that one-task training takes at most.
SEQUENTIAL_MAX = 2_000_000


# grid --------------------------------------------------------------------------------------------------------------
def grid_size(n: int, scale: float = 6.5, ratio: float = 5 / 3) -> tuple[int, int]:
    """(rows, columns) for n vectors: about n * scale neurons, columns over rows about ``ratio``."""
    rows = math.ceil(math.sqrt(n * scale / ratio))
    return rows, math.ceil(rows * ratio)


def cells(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """(neuron, row, col), numbered row by row from 0."""
    return spark.range(rows * columns).select(F.col("id").alias("neuron"), (F.col("id") / columns).cast("long").alias("row"), (F.col("id") % columns).alias("col"))


def offsets(rows: int, columns: int, radius: int, kind: str = "squared", once: bool = True) -> list[tuple[int, int]]:
    """Steps to the cells within a radius on the toroid, the cell itself left out.

    A radius beyond half the map reaches some cells from both sides; they count once, or with ``once`` off as often as
    they are reached.
    """
    high_r, high_c = (min(radius, (rows - 1) // 2), min(radius, (columns - 1) // 2)) if once else (radius, radius)
    low_r, low_c = (min(radius, rows // 2), min(radius, columns // 2)) if once else (radius, radius)
    out = []
    for dr in range(-low_r, high_r + 1):
        for dc in range(-low_c, high_c + 1):
            r, c = min(abs(dr), rows - abs(dr)), min(abs(dc), columns - abs(dc))
            d = {"squared": r * r + c * c, "manhattan": r + c, "max": max(r, c)}[kind]
            if 0 < d <= (radius * radius if kind == "squared" else radius):
                out.append((dr, dc))
    return out


def neighbours(grid: DataFrame, rows: int, columns: int, steps: list[tuple[int, int]]) -> DataFrame:
    """(neuron, neighbour) by the given steps, over the toroid's edges."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps])).alias("s")
    to = F.pmod(F.col("row") + F.col("s.dr"), F.lit(rows)) * columns + F.pmod(F.col("col") + F.col("s.dc"), F.lit(columns))
    return grid.select("neuron", "row", "col", step).select("neuron", to.cast("long").alias("neighbour"))


VON_NEUMANN = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def toroid_distance2(rows: int, columns: int) -> np.ndarray:
    """Squared distance from cell 0 to every cell; by shifts it serves all others."""
    r, c = np.arange(rows), np.arange(columns)
    r, c = np.minimum(r, rows - r), np.minimum(c, columns - c)
    return (r[:, None] ** 2 + c[None] ** 2).astype(float)


# schedules and kernels ---------------------------------------------------------------------------------------------
def linear(start: float, end: float, steps: int, step: int, whole: bool = False) -> float:
    """Linear cooling; ``whole`` rounds up (radius)."""
    v = start if step <= 0 else end if step >= steps - 1 else start - step * (start - end) / steps
    return math.ceil(v) if whole else v


def exponential(start: float, end: float, steps: int, step: int) -> float:
    return start * math.exp(step * math.log((end or 0.1) / start) / steps)


def kernel(kind: str, x: np.ndarray, r2: float) -> np.ndarray:
    """Weight of a neighbour at squared distance ``x`` for a squared radius ``r2``."""
    r = r2 + 1
    if kind == "gauss":
        return np.exp(-(x**2) / (2 * r * r / 4))
    if kind == "mexhat":
        q = (3 * x / r) ** 2
        return (1 - q) * np.exp(-q)
    if kind == "cone":
        return (r - x) / r
    if kind == "epanechnikov":
        return 1 - x**2 / (r * r)
    if kind == "bubble":
        return np.ones_like(x)
    raise ValueError(f"no kernel {kind}")


def square_around(rows: int, columns: int, neuron: int, x: int) -> list[int]:
    """The x by x cells around a neuron on the toroid, the neuron included, row by row from the upper left; x is odd."""
    if x % 2 == 0:
        raise ValueError("a square around a cell has an odd side")
    r, c, half = neuron // columns, neuron % columns, x // 2
    return [(r + a) % rows * columns + (c + b) % columns for a in range(-half, half + 1) for b in range(-half, half + 1)]


def weights_of(kind: str, rows: int, columns: int, radius: float) -> np.ndarray:
    """Kernel weights from cell 0 to every cell, 0 beyond the radius."""
    x = toroid_distance2(rows, columns)
    return np.where(x <= radius * radius, kernel(kind, x, radius * radius), 0.0)


# initial weights ---------------------------------------------------------------------------------------------------
def initial(kind: str, m: Moments, rows: int, columns: int, seed: int = 1) -> np.ndarray:
    """Starting weights: ``norm_mean_2std``, ``uni_min_max``, ``uni_mean_2std``, ``zero`` or ``pca``."""
    rng, shape, sd = np.random.default_rng(seed), (rows * columns, len(m.mean)), m.stdev
    if kind == "norm_mean_2std":
        return rng.normal(m.mean, 2 * sd, shape)
    if kind == "uni_min_max":
        return rng.uniform(m.low, m.high, shape)
    if kind == "uni_mean_2std":
        return rng.uniform(m.mean - 2 * sd, m.mean + 2 * sd, shape)
    if kind == "zero":
        return np.zeros(shape)
    if kind == "pca":
        values, vectors = principal_components(m)
        r = np.linspace(-1, 1, rows) if rows > 1 else np.zeros(1)
        c = np.linspace(-1, 1, columns) if columns > 1 else np.zeros(1)
        second = vectors[1] * math.sqrt(max(values[1], 0)) if len(values) > 1 else 0 * vectors[0]
        first = vectors[0] * math.sqrt(max(values[0], 0))
        return (m.mean + 2 * r[:, None, None] * first + 2 * c[None, :, None] * second).reshape(shape)
    raise ValueError(f"no start {kind}")


# training ----------------------------------------------------------------------------------------------------------
@dataclass
class Schedule:
    epochs: int = 20
    radius: tuple[float, float] = (50, 1)
    rate: tuple[float, float] = (1.0, 0.1)
    cooling: str = "linear"
    kernel: str = "gauss"

    def at(self, epoch: int) -> tuple[float, float]:
        if self.cooling == "linear":
            return linear(*self.radius, self.epochs, epoch, True), linear(*self.rate, self.epochs, epoch)
        return max(1.0, exponential(*self.radius, self.epochs, epoch)), exponential(*self.rate, self.epochs, epoch)


def _sums(v: str, w: np.ndarray):
    ids = np.arange(len(w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, off = np.zeros_like(w), np.zeros(len(w), np.int64), np.zeros(len(w))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            n, d2 = best_of(x, ids, w)
            order = np.argsort(n, kind="stable")
            hit, first = np.unique(n[order], return_index=True)
            if len(hit):
                total[hit] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(n, minlength=len(w))
            off += np.bincount(n, np.sqrt(d2), minlength=len(w))
        hit = np.flatnonzero(count)
        yield from _models(hit, count[hit], off[hit], total[hit])

    return run


_SUMS = "neuron long, n long, off double, total array<double>"


def _models(neuron: np.ndarray, n: np.ndarray, off: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums per neuron as batches of bounded size."""
    step = max(1, 500_000 // max(total.shape[1], 1))
    for lo in range(0, len(neuron), step):
        part = np.ascontiguousarray(total[lo : lo + step])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(neuron[lo : lo + step]), pa.array(n[lo : lo + step]), pa.array(off[lo : lo + step]), lists], ["neuron", "n", "off", "total"])


def _added(size: int, dims: int):
    """Sums of all tasks for the neurons of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, off = np.zeros((size, dims)), np.zeros(size, np.int64), np.zeros(size)
        for b in batches:
            at = b.column(0).to_numpy()
            np.add.at(total, at, b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            np.add.at(count, at, b.column(1).to_numpy())
            np.add.at(off, at, b.column(2).to_numpy())
        hit = np.flatnonzero(count)
        yield from _models(hit, count[hit], off[hit], total[hit])

    return run


def smooth(total: np.ndarray, rows: int, columns: int, k: np.ndarray) -> np.ndarray:
    """Toroid convolution of per-neuron numbers with kernel weights, by fast Fourier transform."""
    f = np.fft.rfft2(k)
    x = total.reshape(rows, columns, -1)
    return np.fft.irfft2(np.fft.rfft2(x, axes=(0, 1)) * f[:, :, None], s=(rows, columns), axes=(0, 1)).reshape(total.shape)


def _gathered(vectors: DataFrame, v: str, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(sums, counts) of the vectors per best matching neuron, and their mean distance to it.

    A task sends one row of sums per neuron that it met; these rows meet per neuron and are added there.
    """
    usable = vectors.select(F.col(v).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    merged = usable.mapInArrow(_sums("v", w), _SUMS).repartition("neuron").mapInArrow(_added(*w.shape), _SUMS).toArrow()  # neurons x dimensions numbers
    total, count = np.zeros_like(w), np.zeros(len(w))
    at = merged.column("neuron").to_numpy()
    if len(at):
        total[at] = merged.column("total").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        count[at] = merged.column("n").to_numpy()
    n = count.sum()
    return total, count, float(merged.column("off").to_numpy().sum() / n) if n else 0.0


def batch_epoch(vectors: DataFrame, v: str, w: np.ndarray, rows: int, columns: int, radius: float, rate: float, kind: str) -> np.ndarray:
    """One batch epoch: each neuron moves by ``rate`` to the kernel-weighted mean of the vectors around it."""
    total, count, _ = _gathered(vectors, v, w)
    return _moved(total, count, w, rows, columns, radius, rate, kind)


def _moved(total: np.ndarray, count: np.ndarray, w: np.ndarray, rows: int, columns: int, radius: float, rate: float, kind: str) -> np.ndarray:
    k = weights_of(kind, rows, columns, radius)
    mass = smooth(count[:, None], rows, columns, k)[:, 0]
    lead = smooth(total, rows, columns, k)
    near = mass > 1e-9
    out = w.copy()
    out[near] += min(rate, 1.0) * (lead[near] / mass[near, None] - w[near])
    return out


def train_batch(vectors: DataFrame, v: str, w: np.ndarray, rows: int, columns: int, schedule: Schedule, measure: bool = False):
    """Batch training over all epochs. The vectors should be cached or cheap to read: each epoch reads them once.

    With ``measure`` the result is (weights, mean distances to the best match at the start and after each epoch); an
    epoch's search measures the one before, so that only the last one costs a pass of its own.
    """
    errors = []
    for epoch in range(schedule.epochs):
        total, count, off = _gathered(vectors, v, w)
        errors.append(off)
        w = _moved(total, count, w, rows, columns, *schedule.at(epoch), schedule.kernel)
    return (w, [*errors, _gathered(vectors, v, w)[2]]) if measure else w


def train_sequential(x: np.ndarray, w: np.ndarray, rows: int, columns: int, schedule: Schedule, k_batch: float | None = None, local: int | None = None, seed: int = 1) -> np.ndarray:
    """Online (``k_batch`` None) or k-batch training of one worker's vectors, in a seeded order per epoch.

    Online: weights move after every vector. K-batch: mean vectors per best match gather over ceil(n * k_batch) vectors
    and then move their surroundings, lowest neuron first. ``local``: after the first epoch the best match is looked for
    in a box of that many cells around the one before.
    """
    if len(x) > SEQUENTIAL_MAX:
        raise ValueError("too many vectors for one task; use batch training")
    w, rng, ids = np.array(w, float), np.random.default_rng(seed), np.arange(len(w))
    before = np.full(len(x), -1)
    every = math.ceil(len(x) * k_batch) if k_batch else 0
    for epoch in range(schedule.epochs):
        radius, rate = schedule.at(epoch)
        k = weights_of(schedule.kernel, rows, columns, radius) * rate
        dr, dc = np.nonzero(k)
        strength = k[dr, dc]

        def around(neuron: int, dr=dr, dc=dc) -> np.ndarray:
            return (neuron // columns + dr) % rows * columns + (neuron % columns + dc) % columns

        gathered: dict[int, list] = {}

        def flush(strength=strength) -> None:
            for neuron in sorted(gathered):
                total, n = gathered[neuron]
                at = around(neuron)
                w[at] += strength[:, None] * (total / n - w[at])
            gathered.clear()

        for step, i in enumerate(rng.permutation(len(x))):
            if local and before[i] >= 0:
                r, c = before[i] // columns, before[i] % columns
                box = np.unique(((np.arange(r - local, r + local + 1) % rows)[:, None] * columns + (np.arange(c - local, c + local + 1) % columns)[None]).ravel())
                best = int(box[((w[box] - x[i]) ** 2).sum(1).argmin()])
            else:
                best = int(best_of(x[i : i + 1], ids, w)[0][0])
            before[i] = best
            if every:
                t = gathered.setdefault(best, [np.zeros(x.shape[1]), 0])
                t[0] += x[i]
                t[1] += 1
                if (step + 1) % every == 0:
                    flush()
            else:
                at = around(best)
                w[at] += strength[:, None] * (x[i] - w[at])
        flush()
    return w


def train_in_one_task(vectors: DataFrame, order: str, v: str, w: np.ndarray, rows: int, columns: int, schedule: Schedule, **how) -> DataFrame:
    """(neuron, row, col, w) of ``train_sequential`` over all vectors in the order of ``order``, in one task of an executor."""
    n = vectors.count()
    if n > SEQUENTIAL_MAX:
        raise ValueError("too many vectors for one task; use batch training")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in batches if b.num_rows]
        if parts:
            out = train_sequential(np.concatenate(parts), w, rows, columns, schedule, **how)
            k = np.arange(len(out))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(k // columns), pa.array(k % columns), pa.array(out.tolist(), pa.list_(pa.float64()))], ["neuron", "row", "col", "w"])

    one = vectors.select(order, F.col(v).cast("array<double>").alias("v")).coalesce(1).sortWithinPartitions(order)
    return one.mapInArrow(run, "neuron long, row long, col long, w array<double>")


# results -----------------------------------------------------------------------------------------------------------
def to_frame(spark: SparkSession, w: np.ndarray, columns: int) -> DataFrame:
    """(neuron, row, col, w) of a trained map."""
    rows = [(k, k // columns, k % columns, x.tolist()) for k, x in enumerate(w)]
    return spark.createDataFrame(rows, "neuron long, row long, col long, w array<double>")


def u_matrix(neurons: DataFrame, rows: int, columns: int, scaled: bool = True) -> DataFrame:
    """(neuron, row, col, height): mean distance to the four toroid neighbours, scaled to 0 .. 1 over the map."""
    from sedimenta.functions.vectors import DISTANCES

    pairs = neighbours(neurons.select("neuron", "row", "col"), rows, columns, VON_NEUMANN)
    own = neurons.select("neuron", "row", "col", F.col("w").alias("w1"))
    other = neurons.select(F.col("neuron").alias("neighbour"), F.col("w").alias("w2"))
    raw = pairs.join(own, "neuron").join(other, "neighbour").groupBy("neuron", "row", "col").agg(F.avg(DISTANCES["euclid"](F.col("w1"), F.col("w2"))).alias("height"))
    if not scaled:
        return raw
    ends = raw.agg(F.min("height").alias("__lo"), F.max("height").alias("__hi"))
    return raw.crossJoin(F.broadcast(ends)).select("neuron", "row", "col", F.when(F.col("__hi") > F.col("__lo"), (F.col("height") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.col("height")).alias("height"))


def grow(w: np.ndarray, rows: int, columns: int, new_rows: int, new_columns: int) -> np.ndarray:
    """The map widened by empty columns, then rows, spread evenly; each is filled with the mean of its filled 4-neighbours."""

    def places(old: int, new: int) -> list[int]:
        step, out, added = max(1, int(0.5 + old / max(1, new - old))), [], 0
        for k in range(old):
            out.append(k)
            if added < new - old and (k + 1) % step == 0:
                out.append(-1)
                added += 1
        return out + [-1] * (new - old - added)

    if new_rows < rows or new_columns < columns:
        raise ValueError("a map only grows")
    g = w.reshape(rows, columns, -1)
    for axis, (old, new) in ((1, (columns, new_columns)), (0, (rows, new_rows))):
        at = np.array(places(old, new))
        wide = np.take(g, np.maximum(at, 0), axis=axis)
        empty = at < 0
        if axis:
            wide[:, empty] = np.nan
        else:
            wide[empty] = np.nan
        while np.isnan(wide).any():
            shifted = np.stack([np.roll(wide, s, a) for s in (1, -1) for a in (0, 1)])
            known = ~np.isnan(shifted)
            mean = np.where(known, shifted, 0).sum(0) / np.maximum(known.sum(0), 1)
            fill = np.isnan(wide) & known.any(0)
            wide = np.where(fill, mean, wide)
        g = wide
    return g.reshape(new_rows * new_columns, -1)
