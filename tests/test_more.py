import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.functions import vectors as vx
from sedimenta.operators import counts as ct
from sedimenta.operators import linalg


def long(spark, a):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(a) for j, v in enumerate(row)], "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


def test_views_of_matrices(spark):
    a = np.arange(20.0).reshape(4, 5)
    m = long(spark, a)
    assert {r.i: r.v for r in linalg.row_of(m, 2).collect()} == dict(enumerate(a[2]))
    assert {r.i: r.v for r in linalg.column_of(m, 1).collect()} == dict(enumerate(a[:, 1]))
    assert {r.i: r.v for r in linalg.diagonal_of(m).collect()} == dict(enumerate(np.diag(a)))
    assert (dense(linalg.part_of(m, 1, 2, 2, 3), (2, 3)) == a[1:3, 2:5]).all()
    assert (dense(linalg.selection_of(m, [3, 0, 3], [4, 1]), (3, 2)) == a[[3, 0, 3]][:, [4, 1]]).all()
    assert (dense(linalg.dice_of(m, 4, None, 1, 2), (4, 3)) == a[::-1, ::2]).all()
    assert (dense(linalg.swap_rows(m, 0, 3), (4, 5)) == a[[3, 1, 2, 0]]).all()
    assert (dense(linalg.transpose(m), (5, 4)) == a.T).all()
    assert (dense(linalg.gemm(m, linalg.transpose(m), 2.0, 0.5, long(spark, np.ones((4, 4)))), (4, 4)) == 2 * a @ a.T + 0.5).all()
    assert linalg.equals(m, long(spark, a + 1e-9), 1e-6) and not linalg.equals(m, long(spark, a + 1.0), 0.5)
    assert linalg.equals(long(spark, [[np.nan]]), long(spark, [[np.nan]]))
    assert (dense(linalg.combine(m, m, lambda x, y: x * y), (4, 5)) == a * a).all()


@pytest.mark.parametrize("lower", [True, False])
@pytest.mark.parametrize("transposed", [True, False])
@pytest.mark.parametrize("unit", [True, False])
def test_dense_kernels(lower, transposed, unit):
    rng = np.random.default_rng(1)
    a, b, x = rng.normal(size=(4, 4)) + 4 * np.eye(4), rng.normal(size=(4, 4)), rng.normal(size=4)
    how = {"lower": lower, "transposed": transposed, "unit": unit}
    assert np.allclose(linalg.trmv(a, linalg.trsv(a, x, **how), **how), x)
    for left in (True, False):
        assert np.allclose(linalg.trmm(a, linalg.trsm(a, b, 1.0, left, **how), 1.0, left, **how), b)
    s = a + a.T
    assert np.allclose(linalg.symv(np.tril(s) if lower else np.triu(s), x, lower), s @ x)
    assert np.allclose(linalg.syr2(a, x, x), linalg.syr(a, x, 2.0))
    assert np.allclose(linalg.syrk(a, 2.0, transposed=transposed), 2 * (a.T @ a if transposed else a @ a.T))


def test_folds_and_search(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0],), ([],)], "v array<double>")
    r = df.select(vx.aggregate(F.col("v"), lambda a, x: a - x).alias("a"), vx.aggregate_upto(F.col("v"), lambda a, x: a + x, 9.0).alias("u"), vx.search(F.col("v"), F.lit(4.0)).alias("s"), vx.search(F.col("v"), F.lit(5.0)).alias("m")).collect()
    assert tuple(r[0]) == (8 - 4 - 2 - 1, 12.0, 2, -4) and r[1].a is None


def test_table_operators(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in (1, 2, 3) for c in (1, 2, 3)], "row_num int, col_num int, value double")
    at = lambda df: {(r.row_num, r.col_num): r.value for r in df.collect()}
    order = spark.createDataFrame([(3, 1), (1, 2)], "row_num int, place int")
    assert at(ct.keep_rows(cells, order)) == {(1, c): 30.0 + c for c in (1, 2, 3)} | {(2, c): 10.0 + c for c in (1, 2, 3)}
    assert at(ct.apply(cells, lambda v, agg: v - agg(F.min), "row_num"))[(2, 3)] == 2.0
    assert at(ct.apply(cells, lambda v, agg: v / agg(F.max)))[(3, 3)] == 1.0
    assert at(ct.apply(cells, lambda v, agg: v * 2))[(1, 1)] == 22.0
    assert at(ct.drop_columns(cells, [1]))[(1, 1)] == 12.0 and at(ct.drop_rows(cells, [1, 2]))[(1, 3)] == 33.0
    more = spark.createDataFrame([(4, 1, 0.5)], "row_num int, col_num int, value double")
    assert at(ct.add_rows(cells, more))[(4, 1)] == 0.5
    assert at(ct.add_column(cells, more.select("row_num", "value"), 4))[(4, 4)] == 0.5
    with pytest.raises(ValueError):
        ct.info_values(cells, "nothing")


def test_qr_by_reflections():
    from sedimenta.operators import linalg

    rng = np.random.default_rng(3)
    for m, n in ((5, 5), (7, 3), (4, 1)):
        a = rng.normal(size=(m, n))
        f = linalg.qr(a)
        assert np.allclose(f.q @ f.r, a) and np.allclose(f.q.T @ f.q, np.eye(n)) and np.allclose(np.tril(f.r, -1), 0) and f.full_rank
        x = a[:, 0]
        v, beta = linalg.householder(x)
        assert np.allclose(x - beta * v * (v @ x), [-np.sign(x[0]) * np.linalg.norm(x), *[0] * (m - 1)])
    assert not linalg.qr(np.array([[1.0, 2], [2, 4], [3, 6]])).full_rank and linalg.householder(np.zeros(3))[1] == 0
    s = rng.normal(size=(4, 4))
    s = s + s.T
    b = rng.normal(size=(4, 4))
    assert np.allclose(linalg.symm(np.tril(s), b), s @ b) and np.allclose(linalg.symm(np.triu(s), b, left=False, lower=False, alpha=2, beta=1, c=b), 2 * b @ s + b)


def test_matrix_orders_and_random_cells(spark):
    from sedimenta.operators import linalg

    m = linalg.factory(spark, "vandermonde", 3)
    dense = lambda d: [[x[1] for x in sorted((r.j, r.v) for r in rows)] for _, rows in sorted({i: [r for r in d if r.i == i] for i in {r.i for r in d}}.items())]
    a = np.array(dense(m.collect()))
    assert np.allclose(dense(linalg.swap_columns(m, 0, 2).collect()), a[:, [2, 1, 0]])
    assert np.allclose(dense(linalg.permuted(m, [2, 0, 1], [1, 2, 0]).collect()), a[[2, 0, 1]][:, [1, 2, 0]])
    with pytest.raises(ValueError):
        linalg.permuted(m, [0, 0, 1])
    x = [r.v for r in linalg.factory(spark, "random", 20).collect()]
    assert x == [r.v for r in linalg.factory(spark, "random", 20).collect()] and 0 <= min(x) and max(x) < 1 and 0.4 < np.mean(x) < 0.6


def test_squares_around_a_cell():
    from sedimenta.operators.som import square_around

    assert square_around(4, 5, 0, 3) == [19, 15, 16, 4, 0, 1, 9, 5, 6]
    with pytest.raises(ValueError):
        square_around(4, 5, 0, 2)


def test_watershed_from_markers():
    from sedimenta.operators.density import watershed

    h = np.ones((5, 9))
    h[:, :3], h[:, 5:8] = 0.1, 0.2
    h[2, 1], h[2, 6] = 0.0, 0.0
    label, merges = watershed(h, [2 * 9 + 1, 2 * 9 + 6, 2 * 9 + 1])
    assert label[2, 1] == 1 and label[2, 6] == 2 and (label > 0).all() and (label[:, :3] == 1).all() and (label[:, 5:8] == 2).all()
    assert [m[:3] for m in merges] == [(3, 1, 2)]
    wall = np.zeros((5, 9), bool)
    wall[:, [3, 8]] = True
    label, merges = watershed(h, [2 * 9 + 1], wall)
    assert (label[:, :3] == 1).all() and (label[:, 3:] == 0).all() and merges == []
    label, _ = watershed(h, None, wall)
    assert (label[wall] == 0).all() and (label[~wall] > 0).all()


def test_quantiles_of_any_group(spark):
    from sedimenta.functions.stats import describe, exact_quantiles

    rng = np.random.default_rng(5)
    groups = {"a": rng.integers(0, 9, 400).astype(float), None: rng.normal(size=101), "one": np.array([4.0]), "void": np.array([])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("void", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r for r in exact_quantiles(df, ["k"], "x", {"q": 0.3, "m": 0.5}).collect()}
    assert set(got) == {"a", None, "one"}
    for k in got:
        assert got[k].q == pytest.approx(np.quantile(groups[k], 0.3)) and got[k].m == pytest.approx(np.median(groups[k]))
    told = {r.k: r for r in describe(df, ["k"], "x", "robust").collect()}
    assert set(told) == set(groups) and told["void"].n == 0 and told["void"].median is None and told["one"].mad == 0
    assert told[None].mad == pytest.approx(np.median(np.abs(groups[None] - np.median(groups[None])))) and told["a"].iqr == pytest.approx(np.subtract(*np.quantile(groups["a"], [0.75, 0.25])))
    whole = describe(df, [], "x", "full").collect()
    assert len(whole) == 1 and whole[0].n == 502
    assert exact_quantiles(df.limit(0), ["k"], "x", {"q": 0.3}).collect() == []


def test_boxcox_exponents_follow_the_likelihood(spark):
    from sedimenta.functions import normalize as nz

    rng = np.random.default_rng(6)
    data = {1: np.exp(rng.normal(size=80)), 2: rng.normal(5, 1, 60) ** 2, 3: rng.normal(size=50), 4: np.full(5, 2.0)}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k long, value double").repartition(4)
    got = {r.k: r.exponent for r in nz.boxcox_exponents(df, ["k"]).collect()}
    assert got[4] is None
    for k in (1, 2, 3):
        x = data[k] + (0 if data[k].min() > 0 else 1 + abs(data[k].min()))
        assert got[k] == pytest.approx(nz.golden_section(lambda e, x=x: nz.profile_likelihood(x, e), -10, 10, 1e-5), abs=2e-3)
