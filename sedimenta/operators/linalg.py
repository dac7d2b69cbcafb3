"""Linear algebra: sparse and tall matrices as DataFrames, small square ones as NumPy on the driver.

Long matrices are cells (i, j, v) with 0-based indexes. Column moments of a tall matrix come from one pass in which
every task folds its rows into a Gram matrix of bounded size (dimensions squared); only those are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dimensions of a tall matrix at most; a Gram matrix of that size is what a task returns.
DIMENSIONS_MAX = 2_000


# long form ---------------------------------------------------------------------------------------------------------
def cells_of(rows: DataFrame, i: str, v: str) -> DataFrame:
    """Cells of a matrix whose rows are arrays."""
    return rows.select(F.col(i).cast("long").alias("i"), F.posexplode(v).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """alpha * A * B + beta * C in long form: a join on the inner index and a sum, partial sums first."""
    product = a.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("y")), "k")
    out = product.groupBy("i", "j").agg((F.sum(F.col("x") * F.col("y")) * alpha).alias("v"))
    if c is None or beta == 0:
        return out
    return out.unionByName(c.select("i", "j", (F.col("v") * beta).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def gemv(a: DataFrame, x: DataFrame, alpha: float = 1.0, beta: float = 0.0, y: DataFrame | None = None) -> DataFrame:
    """alpha * A * x + beta * y; vectors are (i, v)."""
    out = a.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg((F.sum(F.col("v") * F.col("x")) * alpha).alias("v"))
    if y is None or beta == 0:
        return out
    return out.unionByName(y.select("i", (F.col("v") * beta).alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))


def ger(m: DataFrame, x: DataFrame, y: DataFrame, alpha: float = 1.0) -> DataFrame:
    """A + alpha * x * y', for the cells that A has."""
    return m.join(x.select("i", F.col("v").alias("x")), "i").join(y.select(F.col("i").alias("j"), F.col("v").alias("y")), "j").select("i", "j", (F.col("v") + alpha * F.col("x") * F.col("y")).alias("v"))


def trace(m: DataFrame) -> DataFrame:
    return m.where("i = j").agg(F.sum("v").alias("trace"))


def properties(m: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row: rows, columns, is_square, is_diagonal, is_identity, is_symmetric. Absent cells are 0."""
    off = F.when(F.col("i") != F.col("j"), F.abs("v")).otherwise(0.0)
    shape = m.agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols"), F.max(off).alias("off"), F.max(F.when(F.col("i") == F.col("j"), F.abs(F.col("v") - 1))).alias("unit"), F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(0)).alias("diag"))
    skew = m.unionByName(transpose(m).withColumn("v", -F.col("v"))).groupBy("i", "j").agg(F.abs(F.sum("v")).alias("d")).agg(F.max("d").alias("skew"))
    square = F.col("n_rows") == F.col("n_cols")
    return shape.crossJoin(F.broadcast(skew)).select(
        "n_rows", "n_cols", square.alias("is_square"), (square & (F.col("off") <= tolerance)).alias("is_diagonal"),
        (square & (F.col("off") <= tolerance) & (F.col("unit") <= tolerance) & (F.col("diag") == F.col("n_rows"))).alias("is_identity"), (square & (F.col("skew") <= tolerance)).alias("is_symmetric"),
    )


def factory(spark: SparkSession, kind: str, rows: int, columns: int | None = None) -> DataFrame:
    """Cells of a ``general`` (1 / (i + j + 1)), ``hilbert``, ``vandermonde``, ``random`` (seeded, in [0, 1)) or ``identity`` matrix."""
    columns = columns or rows
    at = spark.range(rows * columns).select((F.col("id") / columns).cast("long").alias("i"), (F.col("id") % columns).alias("j"))
    value = {
        "general": 1.0 / (F.col("i") + F.col("j") + 1), "hilbert": 1.0 / (F.col("i") + F.col("j") + 1),
        "random": F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(rows), F.lit(columns), "i", "j")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52)),
        "vandermonde": F.pow(F.col("i") + 1.0, F.lit(columns) - F.col("j") - 1), "identity": (F.col("i") == F.col("j")).cast("double"),
    }[kind]
    return at.select("i", "j", value.cast("double").alias("v"))


# views of long matrices, renumbered from 0
def row_of(m: DataFrame, i: int) -> DataFrame:
    """A row as a vector (i, v)."""
    return m.where(F.col("i") == i).select(F.col("j").alias("i"), "v")


def column_of(m: DataFrame, j: int) -> DataFrame:
    return m.where(F.col("j") == j).select("i", "v")


def diagonal_of(m: DataFrame) -> DataFrame:
    return m.where("i = j").select("i", "v")


def part_of(m: DataFrame, i: int, j: int, rows: int, columns: int) -> DataFrame:
    """The part of so many rows and columns from (i, j)."""
    return m.where(F.col("i").between(i, i + rows - 1) & F.col("j").between(j, j + columns - 1)).select((F.col("i") - i).alias("i"), (F.col("j") - j).alias("j"), "v")


def selection_of(m: DataFrame, rows: list[int] | None = None, columns: list[int] | None = None) -> DataFrame:
    """Chosen rows and columns in the given order; a number may stand more than once."""

    def pick(m: DataFrame, name: str, picks: list[int]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(p).cast("long").alias("old"), F.lit(k).cast("long").alias("new")) for k, p in enumerate(picks)])
        return m.withColumn("__p", F.explode(F.filter(pairs, lambda s: s["old"] == F.col(name)))).withColumn(name, F.col("__p.new")).drop("__p")

    m = m if rows is None else pick(m, "i", rows)
    return (m if columns is None else pick(m, "j", columns)).select("i", "j", "v")


def dice_of(m: DataFrame, reverse_rows: int | None = None, reverse_columns: int | None = None, row_step: int = 1, column_step: int = 1) -> DataFrame:
    """Every so-many-th row and column; given the number of rows or columns, in reverse order."""
    i = F.col("i") if reverse_rows is None else F.lit(reverse_rows - 1) - F.col("i")
    j = F.col("j") if reverse_columns is None else F.lit(reverse_columns - 1) - F.col("j")
    return m.select(i.alias("i"), j.alias("j"), "v").where((F.col("i") % row_step == 0) & (F.col("j") % column_step == 0)).select((F.col("i") / row_step).cast("long").alias("i"), (F.col("j") / column_step).cast("long").alias("j"), "v")


def swap_rows(m: DataFrame, a: int, b: int) -> DataFrame:
    return m.withColumn("i", F.when(F.col("i") == a, F.lit(b)).when(F.col("i") == b, F.lit(a)).otherwise(F.col("i")))


def swap_columns(m: DataFrame, a: int, b: int) -> DataFrame:
    return m.withColumn("j", F.when(F.col("j") == a, F.lit(b)).when(F.col("j") == b, F.lit(a)).otherwise(F.col("j")))


def permuted(m: DataFrame, rows: list[int] | None = None, columns: list[int] | None = None) -> DataFrame:
    """Rows and columns in a new order: place k gets what stood at the k-th number. Every number must stand exactly once."""
    for order in (rows, columns):
        if order is not None and sorted(order) != list(range(len(order))):
            raise ValueError("not a permutation")
    return selection_of(m, rows, columns)


def combine(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """f(x, y) for every cell that either matrix has; absent cells are 0."""
    both = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], "full")
    return both.select("i", "j", f(F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))).alias("v"))


def equals(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> bool:
    """Whether all cells are equal within a tolerance; NaN equals NaN."""
    off = combine(a, b, lambda x, y: F.when(F.isnan(x) & F.isnan(y), 0.0).otherwise(F.abs(x - y)))
    return off.where(F.isnan("v") | (F.col("v") > tolerance)).limit(1).count() == 0


# tall matrices -----------------------------------------------------------------------------------------------------
@dataclass
class Moments:
    """Count, means and covariance (n - 1) of the columns of a tall matrix; ``low`` and ``high`` are extremes."""

    n: int
    mean: np.ndarray
    cov: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def stdev(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    @property
    def correlation(self) -> np.ndarray:
        s = self.stdev
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.cov / np.outer(s, s)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict = {}
    for b in batches:
        keys = np.array(b.column(0).to_pylist(), dtype=object)
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        for key in set(keys.tolist()):
            y = x[keys == key]
            n, m = len(y), y.mean(0)
            c = (y - m).T @ (y - m)
            if key in state:
                n0, m0, c0, lo, hi = state[key]
                d = m - m0
                state[key] = (n0 + n, m0 + d * n / (n0 + n), c0 + c + np.outer(d, d) * n0 * n / (n0 + n), np.minimum(lo, y.min(0)), np.maximum(hi, y.max(0)))
            else:
                state[key] = (n, m, c, y.min(0), y.max(0))
    for key, (n, m, c, lo, hi) in state.items():
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([n]), *[pa.array([a.ravel().tolist()], pa.list_(pa.float64())) for a in (m, c, lo, hi)]], ["key", "n", "m", "c", "lo", "hi"])


def moments(rows: DataFrame, v: str, key: str | None = None) -> dict[str, Moments]:
    """Column moments of the vectors ``v``, per ``key`` (a bounded number of classes) or of all (key ``""``).

    Vectors that are null or hold NaN are left out. Tasks return one Gram matrix per class; they are merged pairwise,
    per class, in the cluster.
    """
    usable = rows.select((F.col(key).cast("string") if key else F.lit("")).alias("key"), F.col(v).cast("array<double>").alias("v"))
    usable = usable.where(F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    text = "key string, n long, m array<double>, c array<double>, lo array<double>, hi array<double>"

    def merge(t: pa.Table) -> pa.Table:
        n, m, c, lo, hi = 0, 0.0, 0.0, np.inf, -np.inf
        for r in t.to_pylist():
            d = np.asarray(r["m"]) - m
            k = r["n"]
            cross = np.outer(d, d).ravel() * n * k / (n + k) if n else 0.0
            m = m + d * k / (n + k)
            c, n = c + np.asarray(r["c"]) + cross, n + k
            lo, hi = np.minimum(lo, r["lo"]), np.maximum(hi, r["hi"])
        return pa.table({"key": [t.column("key")[0].as_py()], "n": [n], "m": [m.tolist()], "c": [c.tolist()], "lo": [lo.tolist()], "hi": [hi.tolist()]})

    parts = usable.mapInArrow(_fold, text).withColumn("leaf", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("key", "leaf").applyInArrow(lambda t: merge(t), text)
    out = {}
    for r in some.groupBy("key").applyInArrow(lambda t: merge(t), text).collect():
        d = len(r["m"])
        if d > DIMENSIONS_MAX:
            raise ValueError(f"at most {DIMENSIONS_MAX} dimensions")
        cov = np.asarray(r["c"]).reshape(d, d) / max(r["n"] - 1, 1)
        out[r["key"]] = Moments(r["n"], np.asarray(r["m"]), cov, np.asarray(r["lo"]), np.asarray(r["hi"]))
    return out


def principal_components(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as rows), the largest first; the first non-zero element of a vector is positive."""
    values, vectors = np.linalg.eigh(m.cov)
    vectors = vectors.T[::-1]
    for v in vectors:
        big = np.flatnonzero(np.abs(v) > 1e-12)
        if len(big) and v[big[0]] < 0:
            v *= -1
    return values[::-1], vectors


def mahalanobis(rows: DataFrame, v: str, keep: list[str], key: str, models: dict[str, Moments]) -> DataFrame:
    """``keep`` with the ``mahalanobis`` distance of each vector to its class's mean under its class's covariance."""
    solvers = {k: (m.mean, _factor(m.cov)) for k, m in models.items() if m.n > 1}

    def run(keys: pd.Series, vectors: pd.Series) -> pd.Series:
        out = np.full(len(keys), np.nan)
        for k in keys.dropna().unique():
            if k in solvers:
                at = np.flatnonzero((keys == k).to_numpy())
                mean, root = solvers[k]
                d = np.stack([vectors.iloc[i] for i in at]) - mean
                out[at] = np.sqrt(np.maximum(((d @ root) ** 2).sum(1), 0))
        return pd.Series(out)

    f = F.pandas_udf(run, "double")
    usable = F.col(v).isNotNull() & ~F.exists(F.col(v), lambda x: x.isNull() | F.isnan(x.cast("double")))
    return rows.where(usable).select(*keep, f(F.col(key).cast("string"), F.col(v).cast("array<double>")).alias("mahalanobis"))


def _factor(cov: np.ndarray) -> np.ndarray:
    """R with R R' the inverse: from Cholesky where the matrix is positive definite, else from the pseudo-inverse."""
    try:
        return np.linalg.inv(cholesky(cov)).T
    except ValueError:
        w, q = np.linalg.eigh(np.linalg.pinv(cov, hermitian=True))
        return q * np.sqrt(np.maximum(w, 0))


# small square matrices ---------------------------------------------------------------------------------------------
def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(L, U, row order, sign) with partial pivoting."""
    u = np.array(a, float)
    n, m = u.shape
    order, sign, low = np.arange(n), 1, np.eye(n, min(n, m))
    for k in range(min(n, m)):
        p = k + int(np.abs(u[k:, k]).argmax())
        if p != k:
            u[[k, p]], order[[k, p]], sign = u[[p, k]], order[[p, k]], -sign
            low[[k, p], :k] = low[[p, k], :k]
        if u[k, k] != 0:
            f = u[k + 1 :, k] / u[k, k]
            low[k + 1 :, k] = f
            u[k + 1 :] -= np.outer(f, u[k])
    return low, np.triu(u[: min(n, m)]), order, sign


def det(a: np.ndarray) -> float:
    _, u, _, sign = lu(a)
    return float(sign * np.diag(u).prod())


def is_singular(a: np.ndarray) -> bool:
    return bool((np.diag(lu(a)[1]) == 0).any())


def triangular_solve(t: np.ndarray, b: np.ndarray, lower: bool) -> np.ndarray:
    x = np.array(b, float)
    for k in range(len(t)) if lower else range(len(t) - 1, -1, -1):
        done = slice(0, k) if lower else slice(k + 1, None)
        x[k] = (x[k] - t[k, done] @ x[done]) / t[k, k]
    return x


def cholesky(a: np.ndarray) -> np.ndarray:
    """Lower factor of a symmetric, positive definite matrix; ValueError for any other."""
    if a.shape[0] != a.shape[1] or not np.allclose(a, a.T):
        raise ValueError("not symmetric")
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError as e:
        raise ValueError("not positive definite") from e


def solve(a: np.ndarray, b: np.ndarray, method: str | None = None) -> np.ndarray:
    """x of A x = b: by Cholesky, LU, or QR (least squares; the default for matrices that aren't square)."""
    method = method or ("lu" if a.shape[0] == a.shape[1] else "qr")
    if method == "cholesky":
        low = cholesky(a)
        return triangular_solve(low.T, triangular_solve(low, b, True), False)
    if method == "lu":
        low, up, order, _ = lu(a)
        if (np.diag(up) == 0).any():
            raise ValueError("singular")
        x = triangular_solve(up, triangular_solve(low, np.asarray(b, float)[order], True), False)
        # one step of refinement
        return x + triangular_solve(up, triangular_solve(low, (b - a @ x)[order], True), False)
    f = qr(np.asarray(a, float))
    if not f.full_rank:
        raise ValueError("rank deficient")
    return triangular_solve(f.r, f.q.T @ b, False)


def inverse(a: np.ndarray) -> np.ndarray:
    return solve(a, np.eye(len(a)))


@dataclass
class Svd:
    u: np.ndarray
    s: np.ndarray
    v: np.ndarray

    @property
    def cond(self) -> float:
        return float(self.s[0] / self.s[-1]) if self.s[-1] else float("inf")

    @property
    def norm2(self) -> float:
        return float(self.s[0])

    @property
    def rank(self) -> int:
        return int((self.s > max(self.u.shape[0], self.v.shape[0]) * self.s[0] * 2.0**-52).sum())


def svd(a: np.ndarray) -> Svd:
    if a.shape[0] < a.shape[1]:
        raise ValueError("needs at least as many rows as columns")
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    return Svd(u, s, vt.T)


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending eigenvalues, eigenvectors as columns); ValueError unless symmetric."""
    if not np.allclose(a, a.T):
        raise ValueError("not symmetric")
    return np.linalg.eigh(a)


@dataclass
class Qr:
    """A = Q R by Householder reflections; ``h`` has the reflections' vectors as columns."""

    q: np.ndarray
    r: np.ndarray
    h: np.ndarray

    @property
    def full_rank(self) -> bool:
        d = np.abs(np.diag(self.r))
        return bool((d > 1e-14 * max(d.max(initial=0.0), 1e-300)).all())


def householder(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta) with (I - beta v v') x = -sign(x0) |x| e0; beta 0 for a zero vector."""
    v = np.array(x, float)
    norm = float(np.sqrt((v * v).sum()))
    if norm == 0:
        return v, 0.0
    v[0] += norm if v[0] >= 0 else -norm
    return v, 2.0 / float((v * v).sum())


def qr(a: np.ndarray) -> Qr:
    """Factors of a matrix with at least as many rows as columns."""
    m, n = a.shape
    if m < n:
        raise ValueError("needs at least as many rows as columns")
    r, q, h = np.array(a, float), np.eye(m), np.zeros((m, n))
    for k in range(n):
        v, beta = householder(r[k:, k])
        r[k:] -= beta * np.outer(v, v @ r[k:])
        q[:, k:] -= beta * np.outer(q[:, k:] @ v, v)
        h[k:, k] = v
    return Qr(q[:, :n], np.triu(r[:n]), h)


# dense kernels of small matrices, by their usual names
def symv(a: np.ndarray, x: np.ndarray, lower: bool = True, alpha: float = 1.0, beta: float = 0.0, y: np.ndarray | None = None) -> np.ndarray:
    """alpha * A x + beta * y of a symmetric matrix of which only one half is read."""
    half = np.tril(a) if lower else np.triu(a)
    full = half + half.T - np.diag(np.diag(a))
    return alpha * full @ x + (beta * y if y is not None else 0)


def symm(a: np.ndarray, b: np.ndarray, left: bool = True, lower: bool = True, alpha: float = 1.0, beta: float = 0.0, c: np.ndarray | None = None) -> np.ndarray:
    """alpha * A B (or B A) + beta * C of a symmetric A of which only one half is read."""
    half = np.tril(a) if lower else np.triu(a)
    full = half + half.T - np.diag(np.diag(a))
    return alpha * (full @ b if left else b @ full) + (beta * c if c is not None else 0)


def trmv(a: np.ndarray, x: np.ndarray, lower: bool = True, transposed: bool = False, unit: bool = False) -> np.ndarray:
    return _triangle(a, lower, transposed, unit) @ x


def trsv(a: np.ndarray, x: np.ndarray, lower: bool = True, transposed: bool = False, unit: bool = False) -> np.ndarray:
    return triangular_solve(_triangle(a, lower, transposed, unit), x, lower != transposed)


def syr(a: np.ndarray, x: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    return a + alpha * np.outer(x, x)


def syr2(a: np.ndarray, x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    return a + alpha * (np.outer(x, y) + np.outer(y, x))


def syrk(a: np.ndarray, alpha: float = 1.0, beta: float = 0.0, c: np.ndarray | None = None, transposed: bool = False) -> np.ndarray:
    product = a.T @ a if transposed else a @ a.T
    return alpha * product + (beta * c if c is not None else 0)


def trmm(a: np.ndarray, b: np.ndarray, alpha: float = 1.0, left: bool = True, lower: bool = True, transposed: bool = False, unit: bool = False) -> np.ndarray:
    t = _triangle(a, lower, transposed, unit)
    return alpha * (t @ b if left else b @ t)


def trsm(a: np.ndarray, b: np.ndarray, alpha: float = 1.0, left: bool = True, lower: bool = True, transposed: bool = False, unit: bool = False) -> np.ndarray:
    t = _triangle(a, lower, transposed, unit)
    return triangular_solve(t, alpha * b, lower != transposed) if left else triangular_solve(t.T, alpha * b.T, lower == transposed).T


def _triangle(a: np.ndarray, lower: bool, transposed: bool, unit: bool) -> np.ndarray:
    t = np.tril(a) if lower else np.triu(a)
    if unit:
        t = t - np.diag(np.diag(t)) + np.eye(len(t))
    return t.T if transposed else t
