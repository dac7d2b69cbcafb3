"""Most similar vectors for every vector: an adaptive dimension scan over probed lists.

Vectors are rotated by one random orthogonal matrix, so that a partial distance over the first d of D dimensions
estimates the whole. Candidates of a probed list are scanned in column blocks; after each block the hypothesis "still
nearer than the k-th best" is tested, and a candidate goes once its partial distance exceeds
(d / D) * (1 + epsilon / sqrt(d))^2 times the squared threshold. Distances of the survivors are exact, from the vectors
as given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.session import cut

from .lists import LIST_ROWS, SALTS, SEED, collapse, fit, matrix, place, squares, usable
from .topn import top_n

#: Dimensions of a column block, strictness of the hypothesis tests, rows of queries and candidates scanned at a time.
STEP, EPSILON, QUERIES, CANDIDATES = 8, 2.1, 512, 2048


def rotation(dim: int) -> np.ndarray:
    """The same random orthogonal matrix everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bounds(dim: int, step: int, epsilon: float) -> list[tuple[int, float]]:
    """(dimensions seen, factor on the squared threshold) of each test; the last one has all dimensions.

    A partial distance beyond the threshold itself settles the matter, so no factor exceeds 1.
    """
    seen = [*range(step, dim, step), dim]
    return [(d, min(1.0, d / dim * (1 + epsilon / np.sqrt(d)) ** 2) if d < dim else 1.0) for d in seen]


def scan(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int, radius: float | None, epsilon: float = EPSILON, step: int = STEP):
    """(query row, candidate row, squared distance) of at most k nearest candidates per query; a vector isn't its own."""
    dim = q.shape[1]
    turn = rotation(dim)
    qr, cr = q @ turn, c @ turn
    tests = bounds(dim, step, epsilon)
    most = np.inf if radius is None else radius * radius * (1 + 1e-9)
    found = []
    for lo in range(0, len(q), QUERIES):
        rows = slice(lo, min(lo + QUERIES, len(q)))
        limit = np.full(rows.stop - lo, most)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for at in range(0, len(c), CANDIDATES):
            cols = slice(at, min(at + CANDIDATES, len(c)))
            d, factor = tests[0]
            # the tolerance on the first partial distance covers the cancellation in squares()
            part = squares(qr[rows, :d], cr[cols, :d])
            i, j = np.nonzero(part <= (limit * factor)[:, None] + 1e-9)
            own = q_id[lo + i] == c_id[at + j]
            i, j = i[~own], j[~own]
            p = part[i, j]
            for nd, factor in tests[1:]:
                if not len(i):
                    break
                diff = qr[lo + i, d:nd] - cr[at + j, d:nd]
                p = p + (diff * diff).sum(1)
                ok = p <= limit[i] * factor + 1e-9
                i, j, p, d = i[ok], j[ok], p[ok], nd
            if not len(i):
                continue
            diff = q[lo + i] - c[at + j]
            exact = (diff * diff).sum(1)
            ok = exact <= most
            bi, bj, bd = (np.concatenate(x) for x in zip(best, (i[ok], at + j[ok], exact[ok])))
            order = np.lexsort((c_id[bj], bd, bi))
            bi, bj, bd = bi[order], bj[order], bd[order]
            first = np.searchsorted(bi, bi)
            inside = np.arange(len(bi)) - first < k
            best = bi[inside], bj[inside], bd[inside]
            kth = np.arange(len(bi)) - first == k - 1
            limit[bi[kth]] = np.minimum(limit[bi[kth]], bd[kth])
        found.append((best[0] + lo, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _scan_list(k: int, radius: float | None, epsilon: float):
    def run(t: pa.Table) -> pa.Table:
        asks, offers = t.filter(t.column("is_query")), t.filter(t.column("is_candidate"))
        i, j, d2 = (np.zeros(0, np.int64),) * 3
        if asks.num_rows and offers.num_rows:
            i, j, d2 = scan(matrix(asks.column("v")), asks.column("index").to_numpy(), matrix(offers.column("v")), offers.column("index").to_numpy(), k, radius, epsilon)
        return pa.table({"a": asks.column("index").take(pa.array(i)), "b": offers.column("index").take(pa.array(j)), "distance": pa.array(np.sqrt(d2.astype(float)))})

    return run


def nearest(
    vectors: DataFrame, index: str, vector: str, k: int, radius: float | None = None, is_query=None, nprobe: int = 12,
    epsilon: float = EPSILON, sample_rows: int | None = None, list_rows: int = LIST_ROWS,
) -> DataFrame:
    """The ``k`` nearest vectors (Euclid) of every vector: ``data_index``, ``neighbour``, ``distance``, ``neighbour_rank``.

    ``radius`` bounds the distance; the lists probed then hold every vector within it. Without it ``nprobe`` lists are
    probed. ``is_query`` (a condition on ``index``) restricts the vectors that ask, never those that are found.

    * null vectors, vectors with null, NaN or infinite elements or of another size don't count, nor do null indexes;
    * rows with the same index are one record; ties of the distance go to the lower index;
    * equal vectors are searched once: groups of copies of any size cost as one vector, and each copy has its k lowest
      fellows at distance 0 first; an empty table gives an empty result; other columns play no part.
    """
    distinct, twins, n = collapse(usable(vectors.select(index, vector), index, vector), ["v"])
    centroids, expected = fit(distinct, n, sample_rows, list_rows)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "data_index long, neighbour long, distance double, neighbour_rank int")
    # the k + 1 lowest indexes of each group of equal vectors
    firsts = top_n(twins.withColumn("s", F.lit(0.0)), "rep", "s", "index", k + 1)
    copied = cut(firsts.groupBy(F.col("group_key").alias("index")).agg(F.array_sort(F.collect_list("item_id")).alias("ids")))
    distinct, asking = distinct.drop("copies"), None
    if is_query is not None:  # a group of equal vectors asks if any of its records does
        others = twins.where(is_query(F.col("index"))).select(F.col("rep").alias("index"), F.lit(True).alias("twin_asks")).distinct()
        distinct = distinct.join(others, "index", "left").select("index", "v", (is_query(F.col("index")) | F.coalesce("twin_asks", F.lit(False))).alias("asks"))
        asking = F.col("asks")
    placed = place(distinct, centroids, expected, radius, nprobe, asking)
    pairs = placed.select("index", "v", "list", "block", "part", "is_candidate", "is_query").groupBy("list", "block", "part").applyInArrow(_scan_list(k, radius, epsilon), "a long, b long, distance double")
    # a neighbour stands for its equal vectors, at most k of which can matter; a group's own records are at distance 0
    wide = pairs.join(copied.select(F.col("index").alias("b"), "ids"), "b", "left").select("a", F.explode(F.coalesce("ids", F.array("b"))).alias("neighbour"), "distance")
    own = copied.select(F.col("index").alias("a"), F.explode("ids").alias("neighbour"), F.lit(0.0).alias("distance"))
    around = wide.unionByName(own).withColumn("s", -F.col("distance"))
    around = top_n(around, "a", "s", "neighbour", k + 1)
    lists = around.select(F.col("group_key").alias("index"), F.col("item_id").alias("neighbour"), (-F.col("item_score") + 0.0).alias("distance"), F.col("item_rank"))
    single = lists.join(copied.select("index"), "index", "left_anti").select(F.col("index").alias("data_index"), "neighbour", "distance")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    shared = lists.join(copied.select("index"), "index", "left_semi").select(F.col("index").alias("rep"), "neighbour", "distance", salt)
    members = twins.select("index", "rep", F.pmod("index", F.lit(SALTS)).cast("int").alias("salt"))
    if is_query is not None:
        members = members.where(is_query(F.col("index")))
        single = single.where(is_query(F.col("data_index")))
    each = members.join(shared, ["rep", "salt"]).where(F.col("index") != F.col("neighbour")).select(F.col("index").alias("data_index"), "neighbour", "distance")
    # a record brings at most k + 1 rows here, so that the window holds bounded groups
    w = Window.partitionBy("data_index").orderBy("distance", "neighbour")
    return single.unionByName(each).withColumn("neighbour_rank", F.row_number().over(w)).where(F.col("neighbour_rank") <= k)
