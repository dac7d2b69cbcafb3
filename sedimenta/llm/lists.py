"""Inverted lists over numeric vectors: centroids fitted on a bounded sample, every vector assigned, lists probed.

A vector belongs to the list of its nearest centroid. For searches within a radius the lists to probe follow from
geometry and lose nothing: a vector at least t beyond the plane halfway between two centroids has no vector of the
other list nearer than t. For searches without radius the ``nprobe`` nearest lists are probed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import BROADCAST_MAX_BYTES, cut

from .topn import fingerprints

#: Vectors of the sample that centroids are fitted on: a fiftieth of all, but at least and at most so many.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST = 50, 40_000, 200_000
#: Vectors a list should hold; rows of a block of a list; numbers that one matrix of distances may have.
LIST_ROWS, BLOCK_ROWS, MATRIX_NUMBERS = 1_000, 6_000, 4_000_000
#: Sample vectors a centroid needs at least, rounds of the fit, seed.
PER_CENTROID, ROUNDS, SEED = 10, 6, 20_011
#: Lines into which the one line of a group of equal rows is multiplied, to spread its rows over tasks.
SALTS = 16
#: What a row of a group of equal rows takes in a broadcast table.
TWIN_BYTES = 64


def usable(vectors: DataFrame, index: str, vector: str) -> DataFrame:
    """(index LONG, v): one record per index, without null, NaN, infinite or odd-sized vectors.

    The dimension is that of most records (the smaller one where two are equally frequent).
    """
    ok = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & (F.size("v") > 0)
    rows = vectors.select(F.col(index).cast("long").alias("index"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v")).where(F.col("index").isNotNull() & ok)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0)).groupBy("index").agg(F.min("v").alias("v"))


def collapse(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """(distinct, twins, number of distinct) of ``rows`` (index, ...) that may be equal in ``columns``.

    ``distinct`` keeps, of equal rows, the one with the lowest index, with the number of ``copies``. ``twins`` has every
    row of a group of more than one: index, rep (that lowest index). Groups are found on fingerprints and indexes alone,
    so that the columns themselves (vectors) don't move; a group of any size is only aggregated, or joined to its one
    line through salts.
    """
    fp1, fp2 = fingerprints(columns)
    rows = cut(rows.select("*", fp1.alias("fp1"), fp2.alias("fp2")))
    key = ["fp1", "fp2"]
    groups = rows.groupBy(*key).agg(F.min("index").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    twins = cut(rows.select(*key, "index", F.pmod("index", F.lit(SALTS)).cast("int").alias("salt")).join(groups.select(*key, "rep", "copies", salt), [*key, "salt"]).select("index", "rep", "copies"))
    later = twins.where("index != rep").select("index")
    # one join tells both: rows that stand for others have copies, the others of a group have 0 and go
    marks = twins.select("index", F.when(F.col("index") == F.col("rep"), F.col("copies")).otherwise(0).alias("copies"))
    n_twins = twins.count()
    small = n_twins * TWIN_BYTES <= BROADCAST_MAX_BYTES  # then no vector moves; else both sides meet by their index
    distinct = rows.drop(*key).join(F.broadcast(marks) if small else marks, "index", "left").withColumn("copies", F.coalesce("copies", F.lit(1))).where("copies > 0")
    return distinct if small else cut(distinct), twins.select("index", "rep"), rows.count() - later.count()


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equally long vectors as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row, by blocks of bounded size."""
    step = max(64, MATRIX_NUMBERS // max(len(c), 1))
    return np.concatenate([squares(x[i : i + step], c).argmin(1) for i in range(0, len(x), step)])


def fit(vectors: DataFrame, rows: int, sample_rows: int | None = None, list_rows: int = LIST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, estimated vectors of each list) from about ``sample_rows`` vectors, chosen by a hash of their index.

    By default the sample is a fiftieth of the vectors, between 40,000 and 200,000. Lists then hold about ``list_rows``
    vectors each in collections of up to 20 million; in larger ones they grow unless the sample is made larger.
    """
    sample_rows = sample_rows or int(np.clip(rows // SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST))
    share = min(1.0, sample_rows / max(rows, 1))
    sample = vectors if share == 1 else vectors.where(F.pmod(F.xxhash64(F.lit(SEED), "index"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = sample.select("index", "v").toArrow()
    if not got.num_rows:
        return np.zeros((0, 0)), np.zeros(0)
    x = matrix(got.column("v"))[np.argsort(got.column("index").to_numpy(), kind="stable")]
    lists = int(np.clip(round(rows / list_rows), 1, max(1, len(x) // PER_CENTROID)))
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), lists, replace=False)]
    for k in range(ROUNDS):
        own = nearest_of(x, c)
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        if k < ROUNDS - 1:  # an empty list moves into the fullest one
            for e, f in zip(np.flatnonzero(count == 0), np.argsort(-count, kind="stable")):
                c[e] = x[own == f][-1]
    own = nearest_of(x, c)
    return c, np.bincount(own, minlength=lists) / len(x) * rows


def place(vectors: DataFrame, centroids: np.ndarray, expected: np.ndarray, radius: float | None, nprobe: int, is_query=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``vectors`` (index, v, ...) as candidates of their own list and as queries of every list that they probe.

    Adds ``list``, ``block`` and ``part`` (a large list is cut into blocks of candidates, each meets parts of its
    queries), ``is_candidate`` and ``is_query``. The cut follows the list's expected size; a wrong guess costs time only.
    """
    blocks = np.maximum(1, np.ceil(expected / block_rows)).astype(np.int64)
    step = int(np.clip(MATRIX_NUMBERS // max(len(centroids), 1), 64, 2048))
    vectors = vectors.withColumn("__q", F.lit(True) if is_query is None else is_query)
    schema = vectors.drop("__q").schema
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", list int, block int, part int, is_candidate boolean, is_query boolean"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                x = matrix(batch.column("v"))
                asks = batch.column("__q").to_numpy(zero_copy_only=False).astype(bool)
                d2 = squares(x, centroids)
                own = d2.argmin(1)
                me = np.arange(len(x))
                if radius is None:
                    near = np.zeros(d2.shape, bool)
                    k = min(nprobe, d2.shape[1])
                    near[me[:, None], np.argpartition(d2, k - 1, axis=1)[:, :k]] = True
                else:  # distance to the plane between the two centroids, with room for rounding
                    there, which = np.unique(own, return_inverse=True)
                    between = np.sqrt(squares(centroids[there], centroids))[which]
                    near = d2 - d2[me, own][:, None] <= 2 * between * (radius * (1 + 1e-9) + 1e-9) + 1e-9
                near[~asks] = False
                near[me, own] = True
                at, to = np.nonzero(near)
                mine = to == own[at]
                index = batch.column("index").to_numpy()[at].astype(np.uint64)
                mixed = (index * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                n = blocks[to].astype(np.uint64)
                slot = (mixed % n).astype(np.int64)
                # a query goes to all blocks of a list, in its own part; a candidate to all parts, in its own block
                copies = np.where(n > 1, np.where(mine, 2 * n - 1, n), 1).astype(np.int64)
                row = np.repeat(np.arange(len(at)), copies)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                s, m = slot[row], mine[row]
                block = np.where(turn < n[row].astype(np.int64), turn, s)
                # turns 0..n-1: as query in block ``turn``, part s; later turns: as candidate only, in block s, other parts
                part = s.copy()
                extra = turn >= n[row].astype(np.int64)
                other = turn - n[row].astype(np.int64)
                part[extra] = (other + (other >= s))[extra]
                candidate = m & ((block == s) | extra)
                query = ~extra & asks[at[row]]
                keep = candidate | query
                out = [batch.column(f.name).take(pa.array(at[row][keep])) for f in schema.fields]
                out += [pa.array(to[row][keep].astype(np.int32)), pa.array(block[keep].astype(np.int32)), pa.array(part[keep].astype(np.int32)), pa.array(candidate[keep]), pa.array(query[keep])]
                yield from pa.Table.from_arrays(out, [*schema.names, "list", "block", "part", "is_candidate", "is_query"]).combine_chunks().to_batches(max_chunksize=10_000)

    return vectors.mapInArrow(assign, text)
