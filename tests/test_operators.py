import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedimenta.functions import normalize as nz
from sedimenta.functions import sequences as sq
from sedimenta.functions import vectors as vx
from sedimenta.operators import annotate as an
from sedimenta.operators import classify as cl
from sedimenta.operators import counts as ct
from sedimenta.operators import density, graph, image, joins, linalg, som


# sequences ---------------------------------------------------------------------------------------------------------
def kmers_by_scan(seq, k):
    out, p = [], 0
    while p + k <= len(seq):
        mer = seq[p : p + k]
        if set(mer) <= set("ACGT"):
            out.append(mer)
            p += 1
        else:
            p += k
    return out


def test_exact_kmers_follow_the_scan(spark):
    rng = np.random.default_rng(1)
    seqs = ["", "A", "ACG", "NNNN", "ACGT", "N" * 9 + "ACGTACGT", *["".join(rng.choice(list("ACGTN"), int(n), p=[0.23, 0.23, 0.23, 0.23, 0.08])) for n in rng.integers(1, 80, 60)]]
    df = spark.createDataFrame(list(enumerate(seqs)), "i long, s string")
    got = df.select("i", sq.kmers(F.col("s"), 4).alias("k"), sq.kmers(F.col("s"), 4, skip=False).alias("p")).collect()
    for r in got:
        s = seqs[r.i]
        assert r.k == kmers_by_scan(s, 4)
        assert r.p == [s[p : p + 4] for p in range(len(s) - 3) if set(s[p : p + 4]) <= set("ACGT")]


def canonical_count(mers):
    from collections import Counter

    table = {m: c for m, c, _ in sq.canonical_kmers(len(mers[0]) if mers else 1)}
    return dict(Counter(table[m] for m in mers))


@pytest.mark.parametrize("stretch", [1 << 18, 7, 64])
@pytest.mark.parametrize("k", [1, 3, 4, 6])
def test_counted_kmers_follow_the_scan(stretch, k, monkeypatch):
    monkeypatch.setattr(sq, "SCAN_LETTERS", stretch)  # scans go on over the ends of stretches
    rng = np.random.default_rng(k)
    seqs = ["", "A", "NN", "ACGT" * 9, "N" * 30, "AÄCGTNé" * 3, *["".join(rng.choice(list("ACGTN"), int(n), p=[0.2, 0.2, 0.2, 0.2, 0.2])) for n in rng.integers(0, 90, 40)]]
    for skip in (True, False):
        got = {}
        for text, code, n in sq.count_kmers(pa.array(["x", *seqs]).slice(1), k, skip):
            for t, mer, m in zip(text.tolist(), sq._spelled(code, k).to_pylist(), n.tolist()):
                got.setdefault(t, {}).setdefault(mer, 0)
                got[t][mer] += m
        for i, s in enumerate(seqs):
            mers = kmers_by_scan(s, k) if skip else [s[p : p + k] for p in range(len(s) - k + 1) if set(s[p : p + k]) <= set("ACGT")]
            assert got.get(i, {}) == canonical_count(mers), (s, skip)


def test_kmer_tables_have_a_row_for_every_text(spark):
    df = spark.createDataFrame([(1, "ACGTT"), (1, "NNN"), (2, None), (3, "")], "key long, s string")
    rows = sq.kmer_table(df, ["key"], "s", 2).collect()
    assert sorted((r.key, sum(r[1:])) for r in rows) == [(1, 0), (1, 4), (2, 0), (3, 0)] and len(rows[0]) == 11
    counts = {(r.key, r.kmer): r.n for r in sq.kmer_counts(df, "key", "s", 2).collect()}
    assert counts == {(1, "AC"): 2, (1, "CG"): 1, (1, "AA"): 1}


def test_a_long_text_takes_bounded_memory():
    import resource

    text = ("ACGTTGCA" * 10 + "N") * 60_000  # 5 million letters
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    total = sum(int(n.sum()) for *_, n in sq.count_kmers(pa.array([text]), 4, False))
    assert total == 60_000 * 77
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


@pytest.mark.parametrize("k,n", [(1, 2), (2, 10), (3, 32), (4, 136), (5, 512)])
def test_canonical_kmers(spark, k, n):
    rows = sq.canonical_kmers(k)
    assert len({c for _, c, _ in rows}) == n
    back = str.maketrans("ACGT", "TGCA")
    table = {m: c for m, c, _ in rows}
    assert all(table[m] == table[m.translate(back)[::-1]] for m in table)
    df = spark.createDataFrame([(m,) for m in table], "m string").select("m", sq.canonical(F.col("m")).alias("c"))
    assert {r.m: r.c for r in df.collect()} == table


def test_windows_follow_the_definition(spark):
    cases = [(length, c, w, m) for length in (5, 9, 10, 23, 40) for c in (4, 10) for w in (3, 4, 12) for m in (0, 2, 6)]
    for length, c, w, m in cases:
        want = []
        if length >= c + m:
            for n, b in enumerate(range(0, length, w)):
                if b + c > length and length - b <= m:
                    break
                want.append((n + 1, b + 1, min(b + c, length)))
        beg, end = sq.spans(length, c, w, m)
        assert [(k + 1, int(b) + 1, int(e)) for k, (b, e) in enumerate(zip(beg, end))] == want
    seqs = ["".join("ACGT"[k % 4] for k in range(n)) for n in (0, 5, 12, 23, 40)]
    rows = sq.subdivide(spark.createDataFrame([(f"s{k} x", s) for k, s in enumerate(seqs)], "name string, seq string"), "name", "seq", 10, 4, 2).collect()
    assert len(rows) == sum(len(sq.spans(len(s), 10, 4, 2)[0]) for s in seqs)
    assert all(r.seq == seqs[int(r.name[1:])][r.beg - 1 : r.end] and r.fragment == f"{r.name}_{r.n} {r.beg}-{r.end}" for r in rows)
    with pytest.raises(ValueError):
        sq.spans(10, 2, 1)
    wide = spark.createDataFrame([("ü", "äß€" * 7)], "name string, seq string")
    assert [r.seq for r in sq.subdivide(wide, "name", "seq", 10, 8).collect()] == [("äß€" * 7)[b : b + 10] for b in (0, 8, 16)]


def test_two_bit_and_names(spark):
    df = spark.createDataFrame([("ACGTT",), ("A",), ("",), ("GATTACAGATTACA",)], "s string")
    assert all(r.s == r.u for r in df.select("s", sq.unpack_2bit(sq.pack_2bit(F.col("s"))).alias("u")).collect())
    n = spark.createDataFrame([("X_scaffold_1_2 10-20",), ("X_contig_7 note",), (None,)], "name string").select(sq.fragment_parts(F.col("name")).alias("p"), sq.sample_name(F.col("name")).alias("s")).collect()
    assert tuple(n[0].p) == ("X_scaffold_1", 2, 10, 20) and n[0].s == "X" and n[1].p is None and n[2].s is None


# vectors, moments, solvers -----------------------------------------------------------------------------------------
def test_distances(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 6))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    r = df.select(*[vx.distance(n, F.col("a"), F.col("b")).alias(n) for n in vx.DISTANCES], *[vx.distance(n, F.col("a"), F.col("a")).alias(f"{n}_self") for n in vx.DISTANCES if n != "bray_curtis"]).first()
    d = np.abs(a - b)
    want = {
        "manhattan": d.sum(), "euclid": np.sqrt((d**2).sum()), "squared_euclid": (d**2).sum(), "lquarter": (d**0.25).sum() ** 4, "lthird": (d ** (1 / 3)).sum() ** 3, "lhalf": (d**0.5).sum() ** 2, "lp1": d.sum(), "lp2": np.sqrt((d**2).sum()),
        "lp3": (d**3).sum() ** (1 / 3), "lp4": (d**4).sum() ** 0.25, "maximum": d.max(), "canberra": (d / (np.abs(a) + np.abs(b))).sum(), "bray_curtis": d.sum() / (a + b).sum(), "correlation": 1 - np.corrcoef(a, b)[0, 1], "cosine": 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b),
    }
    assert {n: r[n] for n in want} == pytest.approx(want)
    assert all(abs(r[f"{n}_self"]) < 1e-12 for n in want if n != "bray_curtis")
    with pytest.raises(ValueError):
        vx.distance("cosine", F.col("a"), F.col("b"), 1.0)


def test_moments_per_class(spark):
    rng = np.random.default_rng(3)
    x, k = rng.normal(size=(500, 5)), rng.integers(0, 3, 500)
    rows = [(int(c), v.tolist()) for c, v in zip(k, x)] + [(0, None), (1, [float("nan")] * 5), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "c int, v array<double>").repartition(7)
    got = linalg.moments(df, "v", "c")
    for c in range(3):
        y = x[k == c]
        m = got[str(c)]
        assert m.n == len(y) and np.allclose(m.mean, y.mean(0)) and np.allclose(m.cov, np.cov(y.T)) and np.allclose(m.low, y.min(0)) and np.allclose(m.correlation, np.corrcoef(y.T))
    d = {r.c: r.mahalanobis for r in linalg.mahalanobis(df.where("c = 1"), "v", ["c"], "c", got).collect()}
    assert d[1] >= 0
    values, vectors = linalg.principal_components(got["0"])
    assert np.allclose(got["0"].cov @ vectors[0], values[0] * vectors[0]) and values[0] == max(values)


@pytest.mark.parametrize("n", [2, 3, 4, 8])
def test_solvers(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    spd = a @ a.T + n * np.eye(n)
    want = np.arange(1.0, n + 1)
    for method in ("lu", "qr"):
        assert np.allclose(linalg.solve(a, a @ want, method), want)
    assert np.allclose(linalg.solve(spd, spd @ want, "cholesky"), want)
    low, up, order, sign = linalg.lu(a)
    assert np.allclose(low @ up, a[order]) and np.isclose(linalg.det(a), np.linalg.det(a))
    assert np.allclose(linalg.inverse(a) @ a, np.eye(n))
    s = linalg.svd(a)
    assert np.allclose(s.u * s.s @ s.v.T, a) and s.rank == n and s.cond >= 1
    tall = rng.normal(size=(n + 3, n))
    assert np.allclose(linalg.solve(tall, tall @ want), want)
    for bad in (lambda: linalg.cholesky(-spd), lambda: linalg.solve(np.zeros((n, n)), want, "lu"), lambda: linalg.svd(tall.T), lambda: linalg.symmetric_eigen(a)):
        with pytest.raises(ValueError):
            bad()
    assert linalg.is_singular(np.ones((n, n)))


def test_boxcox_exponent_and_golden_section(spark):
    assert nz.golden_section(lambda x: -((x - 2.5) ** 2), -10, 10) == pytest.approx(2.5, abs=1e-5)
    x = np.exp(np.random.default_rng(4).normal(size=400))
    assert abs(nz.golden_section(lambda p: nz.profile_likelihood(x, p), -10, 10, 1e-3)) < 0.2
    df = spark.createDataFrame([(1, float(v)) for v in x] + [(2, 5.0), (2, 5.0), (3, None)], "row_num int, value double")
    got = {r.row_num: r.exponent for r in nz.boxcox_exponents(df, ["row_num"]).collect()}
    assert abs(got[1]) < 0.2 and got[2] is None and got[3] is None


# tables and joins --------------------------------------------------------------------------------------------------
def test_numbering_boxes_and_pasting(spark):
    df = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "a int, b int").repartition(6)
    assert [(r.row_num, r.a) for r in ct.numbered(df, ["a"]).orderBy("row_num").collect()] == [(k + 1, k) for k in range(101)]
    cells = spark.createDataFrame([(r, c, float(r * c)) for r in range(1, 5) for c in range(1, 4)], "row_num int, col_num int, value double")
    assert {tuple(r)[:2] for r in ct.box(cells, 2, 2, 3, 3).collect()} == {(2, 2), (2, 3), (3, 2), (3, 3)}
    assert {(r.row_num, r.col_num): r.value for r in ct.collapse(cells, {3: 1}).collect()}[(4, 1)] == 16.0
    with pytest.raises(ValueError):
        ct.box(cells, 0, 1, 1, 1)
    left, right = spark.range(3).withColumnRenamed("id", "row_num"), spark.range(4).withColumnRenamed("id", "row_num")
    with pytest.raises(ValueError):
        ct.paste(left, right)
    with pytest.raises(ValueError):
        ct.stack([left, right.withColumn("x", F.lit(1))])
    n = ct.sample_with_replacement(spark.range(20_000), "id", 1.0).count()
    assert abs(n - 20_000) < 600
    assert abs(ct.pick_random(spark.range(20_000), "id", 0.25).count() - 5000) < 250


def test_best_neuron_takes_the_lowest_of_equal_ones(spark):
    w = np.array([[0.0, 0.0], [1.0, 1.0], [1.0, 1.0], [5.0, 5.0]])
    df = spark.createDataFrame([(1, [0.9, 0.9]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 0.0]), (5, [9.0, 9.0])], "i int, v array<double>")
    got = {r.i: r.neuron for r in joins.nearest_neuron(df, "v", np.array([3, 4, 5, 6]), w, ["i"]).collect()}
    assert got == {1: 4, 2: 3, 5: 6}


def test_points_in_intervals(spark):
    rng = np.random.default_rng(5)
    pts = [("k", int(p)) for p in rng.integers(0, 500, 300)]
    ivs = [("k", int(b), int(b + n), g) for g, (b, n) in enumerate(zip(rng.integers(0, 480, 40), rng.integers(0, 90, 40)))]
    got = joins.points_in_intervals(spark.createDataFrame(pts, "key string, pos int"), spark.createDataFrame(ivs, "key string, beg int, end int, g int"), "key", "pos", "beg", "end", 32).count()
    assert got == sum(b <= p <= e for _, p in pts for _, b, e, _ in ivs)


# graphs ------------------------------------------------------------------------------------------------------------
def test_components(spark):
    rng = np.random.default_rng(6)
    n = 300
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (180, 2))] + [(k, k + 1) for k in range(400, 460)] + [(500, 501 + k) for k in range(80)] + [(None, 3)]
    sets = density.UnionFind()
    for a, b in edges:
        if a is not None:
            sets.union(a, b)
    nodes = [*range(n), *range(400, 461), *range(500, 581)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame([(k,) for k in nodes], "node int"), spark.createDataFrame(edges, "a int, b int")).collect()}
    groups = {}
    for k in nodes:
        groups.setdefault(sets.find(k), []).append(k)
    assert got == {k: min(g) for g in groups.values() for k in g}
    assert sets.same(400, 460) and not sets.same(400, 500) and not sets.has(10_000)


# maps --------------------------------------------------------------------------------------------------------------
def test_logged_schedule_and_sizes():
    assert som.grid_size(2784, scale=6) == (101, 169) and som.grid_size(2784) == (105, 175)
    radii = [som.linear(51, 1, 20, e, True) for e in range(20)]
    assert radii[0] == 51 and radii[1] == 49 and radii[5] == 39 and radii[10] == 26 and radii[15] == 14 and radii[19] == 1
    counts = {r: len(som.offsets(101, 169, r, once=False)) for r in (51, 49, 39, 26, 14, 1)}
    assert counts == {51: 8212, 49: 7524, 39: 4776, 26: 2120, 14: 612, 1: 4}
    assert len(som.offsets(101, 169, 51)) < 8212 and len(som.offsets(101, 169, 49)) == 7524


def test_training_lowers_the_error(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 4))[rng.integers(40, size=600)] + rng.normal(size=(600, 4)) * 0.05
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    m = linalg.moments(df, "v")[""]
    ids = np.arange(60)
    error = lambda w: np.sqrt(joins.best_of(x, ids, w)[1]).mean()
    schedule = som.Schedule(epochs=6, radius=(3, 1), rate=(0.5, 0.1))
    # a trained map is ordered, so it is held against one that has only the mean, and random starts not against themselves
    flat = error(np.tile(m.mean, (60, 1)))
    for kind in ("pca", "norm_mean_2std", "uni_min_max", "uni_mean_2std"):
        start = som.initial(kind, m, 6, 10)
        assert start.shape == (60, 4)
        assert error(som.train_batch(df, "v", start, 6, 10, schedule)) < 0.7 * flat
    start = som.initial("pca", m, 6, 10)
    for how in ({}, {"k_batch": 0.15}, {"local": 2}):
        assert error(som.train_sequential(x, start, 6, 10, schedule, **how)) < 0.7 * flat
    for kind in ("gauss", "mexhat", "cone", "epanechnikov", "bubble"):
        assert som.kernel(kind, np.zeros(1), 9.0)[0] == 1.0
    assert som.initial("zero", m, 2, 2).sum() == 0
    grown = som.grow(start, 6, 10, 8, 13)
    assert grown.shape == (104, 4) and not np.isnan(grown).any()
    u = som.u_matrix(som.to_frame(spark, start, 10), 6, 10).collect()
    assert min(r.height for r in u) == 0 and max(r.height for r in u) == 1


def test_smoothing_equals_the_plain_sum():
    rng = np.random.default_rng(8)
    rows, columns = 5, 7
    t = rng.normal(size=(35, 2))
    k = som.weights_of("gauss", rows, columns, 2)
    want = np.zeros_like(t)
    for a in range(35):
        for b in range(35):
            dr, dc = (a // columns - b // columns) % rows, (a % columns - b % columns) % columns
            want[a] += k[dr, dc] * t[b]
    assert np.allclose(som.smooth(t, rows, columns, k), want)


def test_watershed_and_otsu(spark):
    h = np.full((6, 9), 1.0)
    h[1:3, 1:3], h[4, 6:8] = 0.0, 0.1
    h[3, 3:6] = 0.5
    labels, merges = density.watershed(h)
    assert labels[1, 1] != labels[4, 6] and len(set(labels[1:3, 1:3].ravel())) == 1
    assert {x for m in merges for x in m[1:3]} >= {labels[1, 1], labels[4, 6]}
    cells = spark.createDataFrame([(0, k, v) for k, v in enumerate([0.1, 0.12, 0.1, 0.8, 0.82, 0.9])], "row int, col int, v double")
    assert 0.12 * 255 - 1 <= image.otsu(image.histogram(cells)).first().threshold < 0.8 * 255


def test_hashing_and_strata(spark):
    df = spark.range(4000).withColumn("bucket", F.when(F.col("id") < 3000, "hot").when(F.col("id") < 3998, "cold").otherwise("tiny"))
    got = {r.bucket: r["count"] for r in density.stratified(df, "bucket", F.xxhash64("id"), 10.0).groupBy("bucket").count().collect()}
    assert got == {"hot": 300, "cold": 100, "tiny": 2}
    assert density.pareto_radius(np.random.default_rng(1).normal(size=(300, 3))) > 0


# hits, clusters, classes -------------------------------------------------------------------------------------------
def test_best_hits_ties_and_nulls(spark):
    rows = [("a", 3, 5.0), ("a", 2, 5.0), ("a", 1, float("nan")), ("b", 4, None), (None, 5, 9.0)]
    got = an.best_hits(spark.createDataFrame(rows, "q string, line_no long, bit_score double"), ["q"]).collect()
    assert [(r.q, r.line_no) for r in got] == [("a", 2)]


def test_majority_moves_parts(spark):
    rows = [(1, "p", 2, 100), (2, "p", 3, 60), (3, "p", 3, 50), (4, "q", 1, 10), (5, "q", 2, 10), (6, "r", 0, 90), (7, "r", 4, 10)]
    got = {r.i: r.corrected for r in cl.correct_parts(spark.createDataFrame(rows, "i int, parent string, cls int, length long"), "parent", "cls", "length").collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 1, 5: 1, 6: 0, 7: 4}


def test_bins(spark):
    df = spark.createDataFrame([(0,), (10,), (63,), (64,), (999,)], "n int")
    got = df.select("n", cl.length_bin(F.col("n"), F.lit(0), F.lit(64)).alias("b")).collect()
    points = [int(i * 64 / 64) for i in range(64)]
    assert [r.b for r in got] == [next((k for k, p in enumerate(points) if p >= r.n), 64) for r in got]
