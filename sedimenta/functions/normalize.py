"""Normalisations of a long table, per row, per column or over the whole matrix.

A method adds one aggregate of its scope and one expression per cell. The aggregate is joined back and not taken over a
window, so that a scope of any size, the whole matrix included, is summed in parallel and never held in one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.stats import beside, exact_quantiles
from sedimenta.session import cut

METHODS = ("by_sum", "by_norm", "zero_to_one", "zero_to_half", "logtrans", "boxcox", "ztrans", "rztrans")


def _shift(low: Column) -> Column:
    """What is added before a logarithm: 0 where all values are positive, else 1 + |min|."""
    return F.when(low > 0, 0.0).otherwise(1 + F.abs(low))


def _recipe(method: str, x: Column, l1: float) -> tuple[dict[str, Column], object]:
    if method == "by_sum":
        return {"s": F.sum(x)}, lambda v, a: F.when(a("s") != 0, v / a("s")).otherwise(v)
    if method == "by_norm":
        return {"s": F.sqrt(F.sum(x * x))}, lambda v, a: F.when(a("s") != 0, v / a("s")).otherwise(v)
    if method in ("zero_to_one", "zero_to_half"):
        flat = (lambda v: v) if method == "zero_to_one" else (lambda v: F.lit(0.5))
        return {"lo": F.min(x), "hi": F.max(x)}, lambda v, a: F.when(a("hi") > a("lo"), (v - a("lo")) / (a("hi") - a("lo"))).otherwise(flat(v))
    if method == "logtrans" or method == "boxcox" and l1 == 0:
        return {"lo": F.min(x)}, lambda v, a: F.log(v + _shift(a("lo")))
    if method == "boxcox":
        return {"lo": F.min(x)}, lambda v, a: (F.pow(v + _shift(a("lo")), F.lit(float(l1))) - 1) / F.lit(float(l1))
    if method == "ztrans":
        return {"m": F.avg(x), "s": F.stddev_samp(x)}, lambda v, a: F.when(F.coalesce(a("s"), F.lit(0.0)) > 0, (v - a("m")) / a("s")).otherwise(v)
    raise ValueError(f"method must be one of {METHODS}")


def normalize(df: DataFrame, method: str, keys: list[str], value: str = "value", out: str = "normalized", l1: float = 0.5) -> DataFrame:
    """``df`` with the normalised ``value`` in ``out``; ``keys`` name the scope (row, column, or none for the matrix).

    Rows with null keys take no part in a keyed scope. Constant scopes stay as they are, or become 0.5
    (``zero_to_half``).
    """
    x = F.col(value)
    if method == "rztrans":
        return _robust(df, keys, value, out)
    aggregates, cell = _recipe(method, x, l1)
    scope = df.groupBy(*keys).agg(*[c.alias(f"__{n}") for n, c in aggregates.items()])
    joined = df.join(scope, keys) if keys else df.crossJoin(F.broadcast(scope))  # one row
    return joined.withColumn(out, cell(x, lambda n: F.col(f"__{n}"))).drop(*[f"__{n}" for n in aggregates])


def _robust(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(x - trimmed mean) / min(IQR / 1.349, stdev)."""
    x = F.col(value)
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    q = exact_quantiles(df, keys, value, {"__p10": 0.1, "__q1": 0.25, "__q3": 0.75, "__p90": 0.9})
    scope = cut(beside(df.groupBy(*keys).agg(F.stddev_samp(x).alias("__sd")), q, keys, "left"))
    inner = beside(df.select(*keys, value), scope, keys).groupBy(*keys).agg(F.avg(F.when((x > F.col("__p10")) & (x < F.col("__p90")), x)).alias("__tm"))
    spread = F.least((F.col("__q3") - F.col("__q1")) / 1.349, F.col("__sd"))
    centre = beside(scope, inner, keys).select(*keys, spread.alias("__spread"), "__tm")
    both = beside(df, centre, keys)
    return both.withColumn(out, F.when(F.col("__spread") > 0, (x - F.col("__tm")) / F.col("__spread")).otherwise(x)).drop("__spread", "__tm")


def golden_section(f, lo: float, hi: float, tolerance: float = 1e-6, rounds: int = 100) -> float:
    """Where f is largest between lo and hi, for a function with one maximum."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if hi - lo <= tolerance:
            break
        if fa >= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def profile_likelihood(x: np.ndarray, l1: float) -> float:
    """Log-likelihood of the Box-Cox exponent, with the mean and variance profiled out."""
    n = len(x)
    with np.errstate(all="ignore"):
        y = np.log(x) if abs(l1) < 1e-12 else (x**l1 - 1) / l1
        v = y.var(ddof=1)
        return float(-(n - 1) / 2 * np.log(v) + (l1 - 1) * (n - 1) / n * np.log(x).sum()) if v > 0 and np.isfinite(v) else -np.inf


#: Exponents that a pass over the data tries in each scope; the next pass lies between the neighbours of the best.
TRIALS = 20


def boxcox_exponents(df: DataFrame, keys: list[str], value: str = "value", tolerance: float = 1e-3) -> DataFrame:
    """The Box-Cox exponent of each scope (``keys``), between -10 and 10; null for constant scopes.

    A pass takes the likelihoods of TRIALS + 1 evenly spaced exponents by aggregates, in every scope at once, and the next
    one narrows each scope's range to the neighbours of its best; the likelihood has one maximum. A scope of any size is
    only aggregated.
    """
    x = F.col("__x")
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    scope = rows.groupBy(*keys).agg(F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.count("*").alias("__n"))
    scope = cut(scope.withColumns({"__shift": _shift(F.col("__min")), "__a": F.lit(-10.0), "__b": F.lit(10.0)}))
    width = 20.0
    while width > tolerance:
        held = beside(rows, scope, keys).withColumn("__x", F.col("__v") + F.col("__shift"))
        at = lambda k: F.col("__a") + (F.col("__b") - F.col("__a")) * (k / TRIALS)
        bent = lambda k: F.when(F.abs(at(k)) < 1e-12, F.log(x)).otherwise((F.pow(x, at(k)) - 1) / at(k))
        tried = held.groupBy(*keys).agg(F.first("__a").alias("__a"), F.first("__b").alias("__b"), F.first("__n").alias("__n"), F.first("__shift").alias("__shift"), F.first("__min").alias("__min"), F.first("__max").alias("__max"), F.sum(F.log(x)).alias("__logs"), *[F.var_samp(bent(k)).alias(f"__v{k}") for k in range(TRIALS + 1)])
        m = F.col("__n") - 1
        like = lambda k: F.when((F.col(f"__v{k}") > 0) & (F.col(f"__v{k}") < float("inf")), -m / 2 * F.log(f"__v{k}") + (at(k) - 1) * m / F.col("__n") * F.col("__logs")).otherwise(F.lit(float("-inf")))
        best = F.array_max(F.array(*[F.struct(like(k).alias("l"), F.lit(-k).alias("k")) for k in range(TRIALS + 1)]))["k"]
        step = (F.col("__b") - F.col("__a")) / TRIALS
        scope = cut(tried.withColumn("__best", F.col("__a") - step * best).select(*keys, "__n", "__shift", "__min", "__max", F.greatest(F.col("__a"), F.col("__best") - step).alias("__a"), F.least(F.col("__b"), F.col("__best") + step).alias("__b")))
        width = width * 2 / TRIALS
    found = scope.select(*keys, F.when((F.col("__n") > 1) & (F.col("__max") > F.col("__min")), (F.col("__a") + F.col("__b")) / 2).alias("exponent"))
    return beside(df.select(*keys).distinct(), found, keys, "left") if keys else found


def normalize_counts(df: DataFrame, rows: str | None = "by_sum", columns: str | None = None, matrix: str | None = None) -> DataFrame:
    """A long counts table (row_num, col_num, value) normalised by rows, then columns, then as a whole; default rows by their sum."""
    for method, keys in ((rows, ["row_num"]), (columns, ["col_num"]), (matrix, [])):
        if method:
            df = normalize(df, method, keys, "value", "__new").withColumn("value", F.col("__new")).drop("__new")
    return df
