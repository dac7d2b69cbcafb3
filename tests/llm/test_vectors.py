import numpy as np
import pytest

from sedimenta.llm import knn, lists, markov


def frame(spark, x, ids=None, extra=()):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame([*rows, *extra], "data_index long, v array<double>")


def brute(x, ids, k, radius=np.inf):
    out = set()
    for i, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i and d[j] <= radius][:k]
        out |= {(int(ids[i]), int(ids[j])) for j in order}
    return out


def clusters(rng, n, dim=16):
    centres = rng.normal(size=(20, dim)) * 2
    return centres[rng.integers(20, size=n)] + rng.normal(size=(n, dim)) * 0.1


@pytest.mark.parametrize("limit", [1 << 23, 0])
def test_radius_search_is_exact_and_copies_are_whole(spark, monkeypatch, limit):
    monkeypatch.setattr(lists, "BROADCAST_MAX_BYTES", limit)  # at 0 copies meet their vectors by a shuffle
    rng = np.random.default_rng(1)
    x = clusters(rng, 600)
    x[500:560] = x[3]  # a tenth of all rows are copies of one vector
    ids = rng.permutation(600) * 3
    bad = [(9001, None), (9002, [float("nan")] * 16), (9003, [1.0, 2.0]), (9004, [None] * 16), (None, [0.0] * 16), (int(ids[0]), [float(c) for c in x[0]])]
    df = frame(spark, x, ids, bad)
    got = knn.nearest(df, "data_index", "v", 5, radius=0.4, list_rows=60).collect()
    assert {(r.data_index, r.neighbour) for r in got} == brute(x, ids, 5, 0.4)
    assert len(got) == len({(r.data_index, r.neighbour) for r in got})


def test_recall_without_radius(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([clusters(rng, 1200), rng.normal(size=(300, 16))])
    ids = np.arange(len(x))
    got = {(r.data_index, r.neighbour) for r in knn.nearest(frame(spark, x), "data_index", "v", 5, list_rows=60, is_query=lambda i: i % 50 == 0).collect()}
    want = {p for p in brute(x, ids, 5) if p[0] % 50 == 0}
    assert {a for a, _ in got} == {a for a, _ in want}
    assert len(got & want) / len(want) >= 0.9


def test_scan_abandons_but_keeps_the_nearest():
    rng = np.random.default_rng(3)
    x = clusters(rng, 800, 32)
    ids = np.arange(800)
    i, j, d2 = knn.scan(x, ids, x, ids, 5, None)
    got = set(zip(i.tolist(), j.tolist()))
    want = brute(x, ids, 5)
    assert len(got & want) / len(want) > 0.97
    assert np.allclose(d2, ((x[i] - x[j]) ** 2).sum(1))


def test_blocks_of_a_large_list_meet_all_queries(spark):
    rng = np.random.default_rng(4)
    x = clusters(rng, 300)
    df = lists.usable(frame(spark, x), "data_index", "v")
    centroids, expected = lists.fit(df, 300, list_rows=100)
    placed = lists.place(df, centroids, expected, 0.5, 1, block_rows=20).toPandas()
    pairs = set()
    for _, g in placed.groupby(["list", "block", "part"]):
        pairs |= {(a, b) for a in g.loc[g.is_query, "index"] for b in g.loc[g.is_candidate, "index"]}
    seen = sum(len(g.loc[g.is_query]) * len(g.loc[g.is_candidate]) for _, g in placed.groupby(["list", "block", "part"]))
    assert brute(x, np.arange(300), 300, 0.5) <= pairs
    assert seen == len(pairs)  # each query meets each candidate once


def test_empty(spark):
    empty = spark.createDataFrame([], "data_index long, v array<double>")
    assert knn.nearest(empty, "data_index", "v", 5).collect() == []
    points = spark.createDataFrame([], "index long, v array<double>, bm_row long, bm_col long")
    members, found = markov.similarity_clusters(points, 1.0, 2, 10, 10)
    assert members.collect() == [] and found.collect() == []


def points(spark, rows):
    return spark.createDataFrame(rows, "index long, v array<double>, bm_row long, bm_col long")


def test_cliques_chains_and_the_toroid(spark):
    rows = [(k, [0.1 * k, 0.0], k % 2 * 9, 0) for k in range(6)]  # all alike, over the toroid's edge
    rows += [(20 + k, [50.0 + 0.8 * k, 0.0], 5, 5) for k in range(6)]  # a chain
    rows += [(40 + k, [90.0, 0.0], 1, 1) for k in range(7)]  # copies
    rows += [(60, [90.0, 0.0], 5, 5), (61, [200.0, 0.0], 0, 0)]  # alike in the vector only; alone
    members, told = markov.similarity_clusters(points(spark, rows), 1.0, 2, 10, 10)
    got = {r["index"]: r for r in members.collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if r.complete and r["size"] >= 5} == {*range(6), *range(40, 47)}
    assert {got[k].cluster_first for k in range(40, 47)} == {40}
    chain = [got[20 + k] for k in range(6)]
    assert len({r.cluster_first for r in chain}) >= 2 and not any(r.complete and r["size"] >= 5 for r in chain)
    assert got[60].cluster_first == 60 and got[61]["size"] == 1
    by = {r.cluster_first: r for r in told.collect()}
    assert by[40]["size"] == 7 and by[40].typical == [40, 41, 42]
    assert by[0].typical == [2, 3, 1]  # the middle of the row is closest to all others


def test_split_hubs_give_the_same_square(spark, monkeypatch):
    rng = np.random.default_rng(8)
    m = np.where(rng.random((12, 12)) < 0.6, rng.random((12, 12)), 0)
    m[:, 3] = m[3] = 0.5  # a hub
    flow = spark.createDataFrame([(int(i), int(j), 2.0, float(m[i, j])) for i, j in zip(*np.nonzero(m))], "row long, col long, s double, m double")
    for pairs in (1_000_000, 20):
        monkeypatch.setattr(markov, "HUB_PAIRS", pairs)
        got = np.zeros((12, 12))
        for r in markov._square(flow, flow).collect():
            got[r.row, r.col] += r.m
        assert np.allclose(got, 2 * m @ m)


def test_flow_matches_dense_markov_clustering(spark):
    rng = np.random.default_rng(6)
    n = 24
    a = np.eye(n, dtype=bool)
    for lo in (0, 8, 16):
        block = rng.random((8, 8)) < 0.7
        a[lo : lo + 8, lo : lo + 8] |= block | block.T
    a[7, 8] = a[8, 7] = True
    m = a / a.sum(0)
    for _ in range(60):
        m = m @ m
        m = m**2
        m = np.where(m >= markov.PRUNE * m.max(0), m, 0)
        m /= m.sum(0)
    nodes = spark.createDataFrame([(i, 1, int(a[:, i].sum())) for i in range(n)], "node long, size long, degree long")
    links = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(a))], "a long, b long")
    got = {r.node: r.cluster for r in markov.markov_clusters(nodes, links).collect()}
    dense = {j: int(m[:, j].argmax()) for j in range(n)}
    same = lambda d: {frozenset(k for k in d if d[k] == v) for v in set(d.values())}
    assert same(got) == same(dense)


def test_sized_nodes_flow_like_their_records(spark):
    # two triangles sharing a bridge, once as records and once with twins collapsed
    a = np.eye(7, dtype=bool)
    for g in ((0, 1, 2, 3), (3, 4, 5, 6)):
        for i in g:
            for j in g:
                a[i, j] = True
    nodes = spark.createDataFrame([(i, 1, int(a[:, i].sum())) for i in range(7)], "node long, size long, degree long")
    links = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(a))], "a long, b long")
    plain = {r.node: r.cluster for r in markov.markov_clusters(nodes, links).collect()}
    small = spark.createDataFrame([(0, 3, 4), (3, 1, 7), (4, 3, 4)], "node long, size long, degree long")
    edges = spark.createDataFrame([(0, 0), (3, 3), (4, 4), (0, 3), (3, 0), (3, 4), (4, 3)], "a long, b long")
    lumped = {r.node: r.cluster for r in markov.markov_clusters(small, edges).collect()}
    assert {k: plain[k] for k in (0, 3, 4)} == lumped


def test_clusters_tell_whether_they_settled(spark):
    rows = [(k, [0.1 * k, 0.0], 1, 1) for k in range(4)] + [(20 + k, [50.0 + 0.8 * k, 0.0], 5, 5) for k in range(6)]
    members, told = markov.similarity_clusters(points(spark, rows), 1.0, 2, 10, 10, rounds=1)
    assert {r["index"]: r.settled for r in members.collect()} == {k: k < 20 for k, *_ in rows}
    assert all(r.settled == (r.cluster_first < 20) for r in told.collect())
    _, told = markov.similarity_clusters(points(spark, rows), 1.0, 2, 10, 10)
    assert all(r.settled for r in told.collect())


def test_equal_halves_fall_to_the_lower_attractor(spark):
    # a path of five: the middle node gets as much from either side
    nodes = spark.createDataFrame([(k, 1, 2 if k in (0, 4) else 3) for k in range(5)], "node long, size long, degree long")
    links = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if abs(a - b) <= 1], "a long, b long")
    got = [{r.node: (r.cluster, r.settled) for r in markov.markov_clusters(nodes, links.repartition(n)).collect()} for n in (1, 5)]
    assert got[0] == got[1] and all(settled for _, settled in got[0].values())


def test_nodes_without_attractor_stay(spark):
    nodes = spark.createDataFrame([(k, 1, 1) for k in range(4)], "node long, size long, degree long")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 3)], "a long, b long")  # flow runs in a ring
    got = {r.node: (r.cluster, r.settled) for r in markov.markov_clusters(nodes, links, rounds=3).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (2, False), 3: (3, True)}


@pytest.mark.parametrize("rows", [5, 40])
def test_bounds_end_with_the_whole_distance(rows):
    tests = knn.bounds(rows, 8, 2.1)
    assert tests[-1] == (rows, 1.0) and [d for d, _ in tests] == sorted({d for d, _ in tests})
