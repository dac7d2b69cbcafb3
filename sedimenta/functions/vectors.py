"""Vectors as ``ARRAY<DOUBLE>`` columns: arithmetic, folds and the family of distances, all inside codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def total(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda a, x: a + x)


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def fold(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over the pairs of elements."""
    return total(F.zip_with(a, b, f))


# elementwise -------------------------------------------------------------------------------------------------------
def plus(a: Column, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y) if isinstance(b, Column) else F.transform(a, lambda x: x + F.lit(float(b)))


def minus(a: Column, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y) if isinstance(b, Column) else F.transform(a, lambda x: x - F.lit(float(b)))


def times(a: Column, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y) if isinstance(b, Column) else F.transform(a, lambda x: x * F.lit(float(b)))


def over(a: Column, b) -> Column:
    """Division; by 0 it is null."""
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y)) if isinstance(b, Column) else F.transform(a, lambda x: F.try_divide(x, F.lit(float(b))))


def plusmult(a: Column, b: Column, m: float) -> Column:
    """a + m * b."""
    return a if m == 0 else F.zip_with(a, b, lambda x, y: x + F.lit(float(m)) * y)


def same(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Whether all elements are equal within a tolerance; NaN equals NaN."""
    near = lambda x, y: (F.abs(x - y) <= F.lit(tolerance)) | (F.isnan(x) & F.isnan(y))
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, near), lambda t: F.coalesce(t, F.lit(False)))


def part(v: Column, start: int, length: int) -> Column:
    """``length`` elements from the 0-based ``start``."""
    return F.slice(v, start + 1, length)


def selection(v: Column, index: Column) -> Column:
    """Elements at the 0-based positions in ``index``."""
    return F.transform(index, lambda i: F.get(v, i.cast("int")))


def permute(v: Column, order: list[int]) -> Column:
    return selection(v, F.array(*[F.lit(i) for i in order]))


def swapped(v: Column, i: int, j: int) -> Column:
    """Elements i and j (0-based) exchanged."""
    return F.transform(v, lambda x, k: F.when(k == i, F.get(v, F.lit(j))).when(k == j, F.get(v, F.lit(i))).otherwise(x))


# aggregates --------------------------------------------------------------------------------------------------------
def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v).cast("double"))


def variance(v: Column) -> Column:
    """Sample variance about the mean; null for one element."""
    return F.aggregate(
        v, F.struct(_zero().alias("n"), _zero().alias("m"), _zero().alias("s")),
        lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["m"] + (x - a["m"]) / (a["n"] + 1)).alias("m"), (a["s"] + (x - a["m"]) * (x - a["m"]) * a["n"] / (a["n"] + 1)).alias("s")),
        lambda a: F.when(a["n"] > 1, a["s"] / (a["n"] - 1)),
    )


def stdev(v: Column) -> Column:
    return F.sqrt(variance(v))


def dot(a: Column, b: Column) -> Column:
    return fold(a, b, lambda x, y: x * y)


def norm2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, _zero(), lambda a, x: a + x * x))


def asum(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda a, x: a + F.abs(x))


def iamax(v: Column) -> Column:
    """0-based position of the first element of the largest magnitude."""
    m = F.transform(v, F.abs)
    return F.array_position(m, F.array_max(m)).cast("int") - 1


def covariance(a: Column, b: Column) -> Column:
    n = F.size(a).cast("double")
    return F.when(n > 1, (dot(a, b) - total(a) * total(b) / n) / (n - 1))


def correlation(a: Column, b: Column) -> Column:
    return F.try_divide(covariance(a, b), F.sqrt(covariance(a, a) * covariance(b, b)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(s: Column, phi: float) -> Column:
    """Quantile of sorted elements."""
    at = F.lit(phi) * (F.size(s) - 1)
    lo = F.floor(at).cast("int")
    low, high = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(s) - 1))
    return F.when(F.size(s) > 1, low + (at - lo) * (high - low))


def quantile(v: Column, phi: float) -> Column:
    """Linear interpolation at phi * (n - 1) of the sorted elements; null for one element."""
    return let(F.sort_array(v), lambda s: _at(s, phi))


def trimmed_mean(v: Column, share: float = 0.1) -> Column:
    """Mean of the elements strictly between the quantiles ``share`` and 1 - ``share``; null if there are none."""
    ends = let(F.sort_array(v), lambda s: F.struct(_at(s, share).alias("lo"), _at(s, 1 - share).alias("hi")))
    return let(ends, lambda e: mean(F.filter(v, lambda x: (x > e["lo"]) & (x < e["hi"]))))


def robust_stdev(v: Column) -> Column:
    return F.least(let(F.sort_array(v), lambda s: (_at(s, 0.75) - _at(s, 0.25)) / 1.349), stdev(v))


def to_unit(v: Column) -> Column:
    """Elements scaled to 0 .. 1; constant vectors stay."""
    ends = F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
    return let(ends, lambda e: F.when(e["hi"] > e["lo"], F.transform(v, lambda x: (x - e["lo"]) / (e["hi"] - e["lo"]))).otherwise(v))


def ztrans(v: Column) -> Column:
    centre = F.struct(mean(v).alias("m"), stdev(v).alias("s"))
    return let(centre, lambda c: F.when(c["s"] > 0, F.transform(v, lambda x: (x - c["m"]) / c["s"])).otherwise(v))


def aggregate(v: Column, combine: Callable[[Column, Column], Column], f: Callable[[Column], Column] = lambda x: x) -> Column:
    """f of the elements folded by ``combine`` from the last element down; null for an empty vector."""
    back = F.reverse(F.transform(v, f))
    return F.when(F.size(v) > 0, F.aggregate(F.slice(back, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.get(back, F.lit(0)), combine))


def aggregate_upto(v: Column, combine: Callable[[Column, Column], Column], threshold: float, f: Callable[[Column], Column] = lambda x: x) -> Column:
    """As ``aggregate``, but a value above the threshold is kept as it is by the elements that follow."""
    t = F.lit(float(threshold))
    return aggregate(v, lambda a, x: F.when(a > t, a).otherwise(combine(a, x)), f)


def search(v: Column, value: Column) -> Column:
    """0-based place of a value in a sorted vector, or -(place where it would go + 1)."""
    at = F.size(F.filter(v, lambda x: x < value))
    return F.when(F.array_contains(v, value), at).otherwise(-(at + 1))


# distances ---------------------------------------------------------------------------------------------------------
def minkowski(p: float) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.pow(fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p))


def squared_euclid(a: Column, b: Column) -> Column:
    return fold(a, b, lambda x, y: (x - y) * (x - y))


def canberra(a: Column, b: Column) -> Column:
    """Sum of |a - b| / (|a| + |b|); elements that are both 0 give NaN."""
    return fold(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(float("nan"))).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y))))


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "manhattan": lambda a, b: fold(a, b, lambda x, y: F.abs(x - y)),
    "euclid": lambda a, b: F.sqrt(squared_euclid(a, b)),
    "squared_euclid": squared_euclid,
    "lquarter": minkowski(0.25), "lthird": minkowski(1 / 3), "lhalf": minkowski(0.5),
    "lp1": minkowski(1), "lp2": minkowski(2), "lp3": minkowski(3), "lp4": minkowski(4),
    "maximum": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
    "canberra": canberra,
    "bray_curtis": lambda a, b: F.try_divide(fold(a, b, lambda x, y: F.abs(x - y)), fold(a, b, lambda x, y: x + y)),
    "correlation": lambda a, b: F.lit(1.0) - correlation(a, b),
    "cosine": lambda a, b: F.lit(1.0) - F.try_divide(dot(a, b), norm2(a) * norm2(b)),
}
#: Distances that have a bounded form.
BOUNDED = tuple(d for d in DISTANCES if d not in ("canberra", "bray_curtis", "correlation", "cosine"))


def distance(name: str, a: Column, b: Column, threshold: float | None = None) -> Column:
    """A distance by name; with a threshold the bounded form: null where it is exceeded."""
    if name not in DISTANCES:
        raise ValueError(f"no distance {name}")
    if threshold is not None and name not in BOUNDED:
        raise ValueError(f"{name} has no bounded form")
    d = DISTANCES[name](a, b)
    return d if threshold is None else F.when(d <= F.lit(float(threshold)), d)


def grid_distance(kind: str, r1: Column, c1: Column, r2: Column, c2: Column, rows: int, columns: int, toroid: bool = True) -> Column:
    """Distance of two grid cells: ``squared``, ``manhattan`` or ``max``, on a plane or a toroid."""
    dr, dc = F.abs(r1 - r2), F.abs(c1 - c2)
    if toroid:
        dr, dc = F.least(dr, F.lit(rows) - dr), F.least(dc, F.lit(columns) - dc)
    return {"squared": dr * dr + dc * dc, "manhattan": dr + dc, "max": F.greatest(dr, dc)}[kind]
