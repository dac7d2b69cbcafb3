"""Grouping records into similarity clusters by Markov clustering on a sparse, distributed flow matrix.

1. *Similarity graph.* Records are alike if their vectors lie within a radius and their grid positions within a window
   on a toroid. Vectors go through the inverted lists of ``lists``, whose probes lose nothing within the radius. No pair
   is emitted here: each block of a list gives, per record, the number of its fellows and sums of their hashes, and partial
   results are put together.
2. *Equal neighbourhoods.* Records with the same closed neighbourhood take the same part in every step of Markov
   clustering, so they become one node with a size. A group in which all are alike is one node, however large.
3. *Markov clustering.* Columns of the flow matrix are spread over their neighbourhoods; expansion (squaring, as a
   join on the middle node), inflation and pruning of small entries alternate until a column and the columns it flows
   into stand still. Settled columns leave the iteration. Rows that keep flow on their diagonal are attractors; a column
   belongs to the attractor that gets most of its flow, and the members with the strongest flow represent a cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.session import cut

from .lists import LIST_ROWS, SALTS, collapse, fit, matrix, place, squares, usable

#: Exponent of the inflation, share of its column's largest entry below which an entry goes, tolerance. The iteration
#: ends when all columns have settled (8 to 15 rounds as a rule); one that hasn't by ROUNDS comes out marked.
INFLATION, PRUNE, TOLERANCE, ROUNDS = 2.0, 1e-3, 1e-6, 200
#: Decimals that flows are rounded to, products of one middle node beyond which it is split, rows of a block of distances.
DIGITS, HUB_PAIRS, CHUNK = 12, 1_000_000, 1024


def _hash(ids: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of each id."""
    x = ids.astype(np.uint64) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _within(a: np.ndarray, b: np.ndarray, window: int, size: int) -> np.ndarray:
    """Who of ``a`` lies within the window of whom of ``b`` on a ring, from a table of the positions that occur."""
    x, i = np.unique(a, return_inverse=True)
    y, j = np.unique(b, return_inverse=True)
    d = np.abs(x[:, None] - y[None]) % size
    return (np.minimum(d, size - d) <= window)[i][:, j]


def _alike(asks: pa.Table, offers: pa.Table, radius: float, window: int, rows: int, columns: int):
    """(block of queries, block of offers, who is alike, squared distances) for all blocks."""
    q, c = matrix(asks.column("v")), matrix(offers.column("v"))
    middle = c.mean(0)
    near_q, near_c = q - middle, c - middle  # distances by products lose fewer digits near the origin
    qq, cc = (near_q * near_q).sum(1), (near_c * near_c).sum(1)
    at = {n: (asks.column(n).to_numpy(), offers.column(n).to_numpy()) for n in ("bm_row", "bm_col")}
    limit = radius * radius
    slack = 1e-6 * max(1.0, limit)
    for lo in range(0, len(q), CHUNK):
        hi = min(lo + CHUNK, len(q))
        for co in range(0, len(c), CHUNK):
            ch = min(co + CHUNK, len(c))
            d2 = near_q[lo:hi] @ near_c[co:ch].T
            d2 *= -2
            d2 += qq[lo:hi, None]
            d2 += cc[co:ch]
            near = d2 <= limit + slack
            for n, size in (("bm_row", rows), ("bm_col", columns)):
                near &= _within(at[n][0][lo:hi], at[n][1][co:ch], window, size)
            edge = near & (d2 > limit - slack)
            if edge.any():  # where rounding could decide, the distance is taken again without cancellation
                i, j = np.nonzero(edge)
                diff = q[lo + i] - c[co + j]
                near[i, j] = (diff * diff).sum(1) <= limit
            yield lo, hi, co, ch, near, d2


def _neighbourhoods(radius: float, window: int, rows: int, columns: int, close: bool):
    """Per record of a block's queries: fellows among its offers, two sums of their hashes and, if asked for, how close they are.

    All sums are products of the matrix of likeness with columns of small whole numbers, exact as doubles: 64-bit hashes
    are added in four parts of 16 bits and put together, modulo 2^64.
    """

    def run(t: pa.Table) -> pa.Table:
        asks, offers = t.filter(t.column("is_query")), t.filter(t.column("is_candidate"))
        n = asks.num_rows
        degree, x, near_to = np.zeros(n, np.int64), np.zeros((2, n), np.uint64), np.zeros(n)
        if n and offers.num_rows:
            ids, weight = offers.column("index").to_numpy(), offers.column("copies").to_numpy().astype(float)
            hashes = [_hash(ids, 1), _hash(ids, 2)]
            parts = np.stack([weight, *[((h >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(float) for h in hashes for k in range(4)]], axis=1)
            for lo, hi, co, ch, near, d2 in _alike(asks, offers, radius, window, rows, columns):
                if not near.any():
                    continue
                got = near.astype(float) @ parts[co:ch]
                degree[lo:hi] += got[:, 0].astype(np.int64)
                for h in range(2):
                    for k in range(4):
                        x[h, lo:hi] += got[:, 1 + 4 * h + k].astype(np.uint64) << np.uint64(16 * k)
                if close:
                    near_to[lo:hi] += np.where(near, radius - np.sqrt(np.maximum(d2, 0)), 0.0) @ weight[co:ch]
        some = pa.array(degree > 0)
        return pa.table({"index": asks.column("index"), "degree": degree, "x1": x[0].view(np.int64), "x2": x[1].view(np.int64), "close": near_to}).filter(some)

    return run


def _links(radius: float, window: int, rows: int, columns: int):
    def run(t: pa.Table) -> pa.Table:
        asks, offers = t.filter(t.column("is_query")), t.filter(t.column("is_candidate"))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if asks.num_rows and offers.num_rows:
            p, q = asks.column("index").to_numpy(), offers.column("index").to_numpy()
            for lo, _, co, _, near, _ in _alike(asks, offers, radius, window, rows, columns):
                i, j = np.nonzero(near)
                a.append(p[lo + i])
                b.append(q[co + j])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def similarity_graph(points: DataFrame, radius: float, window: int, rows: int, columns: int, sample_rows: int | None = None, list_rows: int = LIST_ROWS, close: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, links) of the graph of alike points ``(index, v, bm_row, bm_col)``.

    ``members``: index, node (the lowest index with the same closed neighbourhood), close (radius minus distance, summed
    over all that are alike). ``nodes``: node, size, degree (records
    alike, itself included). ``links``: a, b for alike nodes, both directions, each node with itself.
    """
    search, twins, n = collapse(points.select("index", "v", "bm_row", "bm_col"), ["v", "bm_row", "bm_col"])
    centroids, expected = fit(search, n, sample_rows, list_rows)
    if not len(centroids):
        empty = points.sparkSession.createDataFrame
        return empty([], "index long, node long, close double"), empty([], "node long, size long, degree long"), empty([], "a long, b long")
    spec = (radius, window, rows, columns)
    keep = ["index", "v", "bm_row", "bm_col", "copies", "list", "block", "part", "is_candidate", "is_query"]
    parts = place(search, centroids, expected, radius, 1).select(*keep).groupBy("list", "block", "part").applyInArrow(_neighbourhoods(*spec, close), "index long, degree long, x1 long, x2 long, close double")
    # hashes of the same records come from the same blocks, whoever asks, so that equal neighbourhoods have equal marks
    around = parts.groupBy("index").agg(F.sum("degree").alias("degree"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.round(F.sum("close"), 6).alias("close"))
    around = cut(around.join(search.select("index", "copies"), "index"))
    same_around = ["degree", "x1", "x2"]
    nodes = cut(around.groupBy(*same_around).agg(F.min("index").alias("node"), F.sum("copies").alias("size")))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    of = around.withColumn("salt", F.pmod("index", F.lit(SALTS)).cast("int")).join(nodes.select(*same_around, "node", salt), [*same_around, "salt"]).select("index", "node", "close")
    of = cut(of)
    later = twins.where("index != rep").withColumn("salt", F.pmod("index", F.lit(SALTS)).cast("int"))
    members = of.unionByName(later.join(of.select(F.col("index").alias("rep"), "node", "close", salt), ["rep", "salt"]).select("index", "node", "close"))
    # a node whose size is its degree has no link outward; only the others are searched for links
    own = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    linked = nodes.where(F.col("size") != F.col("degree")).select(F.col("node").alias("index"))
    if linked.isEmpty():  # every group of equal neighbourhoods stands alone
        return members, nodes.select("node", "size", "degree"), own
    open_nodes = search.join(linked, "index", "left_semi")
    outward = place(open_nodes, centroids, expected, radius, 1).select(*keep).groupBy("list", "block", "part").applyInArrow(_links(*spec), "a long, b long")
    links = outward.where("a != b").unionByName(own)
    return members, nodes.select("node", "size", "degree"), links


def _square(flow: DataFrame, middle: DataFrame) -> DataFrame:
    """(col, row, s, m) of the flow's next step: every column goes on through the columns of the rows that it reaches.

    Entries meet on the middle node. A middle node that would give more than HUB_PAIRS products is split: the columns
    that reach it by a hash, its own column replicated over the parts.
    """
    left = middle.select("row", F.col("col").alias("k"), "s", F.col("m").alias("m1"))
    right = flow.select(F.col("row").alias("k"), "col", F.col("s").alias("sk"), F.col("m").alias("m2"))
    load = left.groupBy("k").agg(F.count("*").alias("a")).join(right.groupBy("k").agg(F.count("*").alias("b")), "k")
    key = ["k"]
    if (load.agg(F.max(F.col("a") * F.col("b"))).first()[0] or 0) > HUB_PAIRS:
        hubs = cut(load.select("k", F.ceil(F.col("a") * F.col("b") / F.lit(HUB_PAIRS)).cast("int").alias("parts")).where("parts > 1"))
        key = ["k", "part"]
        left = left.join(hubs, "k", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        right = right.join(hubs, "k", "left").withColumn("part", F.pmod(F.xxhash64("col"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return left.join(right, key).groupBy("col", "row").agg(F.first("s").alias("s"), F.sum(F.col("sk") * F.col("m1") * F.col("m2")).alias("m"))


def _inflate(squared: DataFrame, inflation: float, prune: float) -> DataFrame:
    """(col, row, s, m): powers of the entries, without small ones, scaled to columns that add up to 1.

    Per column only a maximum and a sum are aggregated; flows are rounded, so that the order of additions decides no tie.
    """
    powers = squared.withColumn("m", F.pow("m", F.lit(inflation)))
    strong = powers.join(powers.groupBy("col").agg(F.max("m").alias("top")), "col").where(F.col("m") >= F.col("top") * prune).drop("top")
    scaled = strong.join(strong.groupBy("col").agg(F.sum(F.col("m") * F.col("s")).alias("total")), "col")
    return scaled.select("col", "row", "s", (F.round(F.col("m") * F.col("s") / F.col("total"), DIGITS) / F.col("s")).alias("m"))


def markov_clusters(nodes: DataFrame, links: DataFrame, inflation: float = INFLATION, prune: float = PRUNE, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """Clusters of sized nodes: ``node``, ``cluster`` (lowest node of its attractors), ``flow`` (what the node gets), ``settled``.

    ``settled`` is false where flow still moved after the last round. A node that flows to no attractor is its own cluster.

    An entry (row, col, s, m) of the flow matrix is what each record of node ``col`` sends to each of the s records of
    node ``row``; the entries of a column, times their sizes, add up to 1. A node whose only link is the one to itself
    is a 1 x 1 matrix, which settles in the first round.
    """
    sized = nodes.select(F.col("node").alias("row"), F.col("size").alias("s"))
    degree = nodes.select(F.col("node").alias("col"), F.col("degree").alias("d"))
    flow = links.select(F.col("a").alias("col"), F.col("b").alias("row")).join(degree, "col").join(sized, "row").select("row", "col", F.col("s").cast("double").alias("s"), (F.lit(1.0) / F.col("d")).alias("m"))
    flow = cut(flow)
    done: DataFrame | None = None
    for _ in range(rounds):
        # columns flow on through the columns of the rows they reach, settled ones included
        squared = cut(_square(flow, flow if done is None else flow.unionByName(done)))
        fresh = _inflate(squared, inflation, prune)
        both = fresh.withColumn("old", F.lit(0.0)).unionByName(flow.select("col", "row", "s", F.lit(0.0).alias("m"), F.col("m").alias("old")))
        moved = cut(both.groupBy("col", "row").agg(F.first("s").alias("s"), F.sum("m").alias("m"), F.sum("old").alias("old")))
        # a column has settled once it and every unsettled column that it flows into stand still
        restless = moved.groupBy("col").agg(F.max(F.abs(F.col("m") - F.col("old")) * F.col("s")).alias("change")).where(F.col("change") > tolerance).select("col")
        now = moved.where("m > 0").select("row", "col", "s", "m")
        waiting = now.join(restless.select(F.col("col").alias("row")), "row", "left_semi").select("col").unionByName(restless).distinct().withColumn("open", F.lit(True))
        state = cut(now.join(waiting, "col", "left").withColumn("open", F.coalesce("open", F.lit(False))))
        flow, still = state.where("open").drop("open"), state.where("NOT open").drop("open")
        n_open, n_still = state.agg(F.count_if("open"), F.count_if(~F.col("open"))).first()
        if n_still:
            done = still if done is None else done.unionByName(still)
        if not n_open:
            break
    limit = flow.withColumn("settled", F.lit(False)) if done is None else done.withColumn("settled", F.lit(True)).unionByName(flow.withColumn("settled", F.lit(False)))
    # attractors keep flow on their diagonal; those that a common column flows to form one system, named by its lowest
    attractors = limit.where("row = col").select("row")
    kept = cut(limit.join(attractors, "row", "left_semi"))
    share = F.round(F.col("m") / F.col("top"), 6)
    best = kept.join(kept.groupBy("col").agg(F.max("m").alias("top")), "col").groupBy("col").agg(F.min_by("row", F.struct(-share, F.col("row"))).alias("best"))
    # a column that no attractor has a row in is a cluster of its own
    named = limit.groupBy("col").agg(F.min("settled").alias("settled")).join(best, "col", "left").withColumn("best", F.coalesce("best", "col"))
    of_best = kept.join(attractors.select(F.col("row").alias("col")), "col", "left_semi").groupBy("col").agg(F.min("row").alias("cluster")).select(F.col("col").alias("best"), "cluster")
    got = limit.join(nodes.select(F.col("node").alias("col"), F.col("size").alias("sc")), "col").groupBy("row").agg(F.sum(F.col("m") * F.col("sc")).alias("flow")).select(F.col("row").alias("col"), "flow")
    return named.join(of_best, "best", "left").join(got, "col", "left").select(F.col("col").alias("node"), F.coalesce("cluster", "best").alias("cluster"), F.coalesce("flow", F.lit(0.0)).alias("flow"), "settled")


def positioned(vectors: DataFrame, matches: DataFrame) -> DataFrame:
    """Points (index, v, bm_row, bm_col) that have both a usable vector and a position; one record per index."""
    at = matches.where(F.col("bm_row").isNotNull() & F.col("bm_col").isNotNull() & F.col("data_index").isNotNull())
    at = at.groupBy(F.col("data_index").alias("index")).agg(F.min(F.struct("bm_row", "bm_col")).alias("p")).select("index", F.col("p.bm_row").cast("long").alias("bm_row"), F.col("p.bm_col").cast("long").alias("bm_col"))
    return usable(vectors.select("data_index", "v"), "data_index", "v").join(at, "index")


def similarity_clusters(points: DataFrame, radius: float, window: int, rows: int, columns: int, sample_rows: int | None = None, list_rows: int = LIST_ROWS, rounds: int = ROUNDS, close: bool = True, prune: float = PRUNE) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) of points ``(index, v, bm_row, bm_col)``.

    ``members``: index, cluster_first (lowest index of its cluster), size, flow, close, complete, settled. ``clusters``:
    cluster_first, size, complete, settled, typical (indexes of the three members with the strongest flow; of equal flow, those
    closest to all that are like them, then the lower index). ``complete``: every two members are alike and none is like
    a point outside. ``settled``: the flow of all its members stood still before the rounds were over. Without ``close``
    this measure is 0 and members of equal flow are typical by their index.

    * null, NaN and odd-sized vectors and null positions take no part (``positioned`` leaves them out);
    * equal points cost as one, but count as many; an empty table gives two empty results;
    * a point that is like no other is a cluster of one.
    """
    members, nodes, links = similarity_graph(points, radius, window, rows, columns, sample_rows, list_rows, close)
    found = cut(markov_clusters(nodes, links, prune=prune, rounds=rounds).join(nodes, "node"))
    # the exact check: a cluster of one node, whose records have as many fellows as the cluster has members
    whole = found.groupBy("cluster").agg(F.sum("size").alias("cluster_size"), F.min("node").alias("cluster_first"), F.max("degree").alias("most"), F.count("*").alias("parts"), F.min("settled").alias("all_settled"))
    whole = whole.withColumn("complete", (F.col("parts") == 1) & (F.col("most") == F.col("cluster_size")))
    told = found.join(whole, "cluster").select("node", "cluster_first", "cluster_size", "complete", "flow", F.col("all_settled").alias("settled"))
    out = members.join(told, "node").select("index", "cluster_first", F.col("cluster_size").alias("size"), "flow", "close", "complete", "settled")
    best = Window.partitionBy("cluster_first").orderBy(F.desc(F.round("flow", 9)), F.desc("close"), "index")
    few = out.withColumn("r", F.row_number().over(best)).where("r <= 3")
    clusters = few.groupBy("cluster_first", "size", "complete", "settled").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "index"))), lambda x: x["index"]).alias("typical"))
    return out, clusters
