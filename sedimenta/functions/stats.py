"""Descriptive statistics as aggregate expressions, in four grades: quick, lite, full, robust.

Nulls are ignored. One value has no spread: lite and beyond are null for it. A value counts as non-zero for ``nz_min``
if it is above 0; without one it is infinite. Moments come from Spark's single-pass aggregates and keep partial sums.
Quantiles are exact and interpolate linearly; they are read off one distributed order of each group's different values,
so that no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.session import cut

GRADES = ("quick", "lite", "full", "robust")


def quick(x: Column) -> dict[str, Column]:
    return {
        "n": F.count(x), "min": F.min(x), "max": F.max(x), "sum": F.sum(x), "mean": F.avg(x),
        "nz_min": F.coalesce(F.min(F.when(x > 0, x)), F.lit(float("inf"))),
    }


def spread_of(x: Column) -> dict[str, Column]:
    return {"variance": F.var_samp(x), "stdev": F.stddev_samp(x)}


def moments(x: Column) -> dict[str, Column]:
    """Skew and kurtosis over the sample variance; 0 for constant values; geometric mean (1 if a value isn't above 0)."""
    n, flat = F.count(x), F.var_samp(x) == 0
    return {
        "skew": F.when(n < 2, None).when(flat, 0.0).otherwise(F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5))),
        "kurtosis": F.when(n < 2, None).when(flat, 0.0).otherwise((F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3),
        "geomean": F.when(n < 2, None).when(F.min(x) > 0, F.exp(F.avg(F.when(x > 0, F.log(x))))).otherwise(1.0),
    }


def quantile(x: Column, phi: float) -> Column:
    """Linear interpolation at phi * (n - 1) as an aggregate, for groups of bounded size; null for fewer than two values."""
    return F.when(F.count(x) > 1, F.percentile(x, F.lit(phi)))


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of ``left`` with the columns of ``right``, which has one row per key; null keys meet null keys."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.select(F.struct(*keys).alias("__right"), *[c for c in right.columns if c not in keys])
    return left.withColumn("__left", F.struct(*keys)).join(other, F.col("__left") == F.col("__right"), how).drop("__left", "__right")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, phis: dict[str, float]) -> DataFrame:
    """(keys, one column per name in ``phis``): linear interpolation at phi * (n - 1) of each group's values without nulls.

    Equal values are counted first and the different ones put in one distributed order of (keys, value). Counts per range
    and group tell in which ranges a group's wanted ranks lie; only the values of these are ranked, by running counts. A
    group of any size is spread over ranges, and no task holds it.
    """
    each = df.select(*keys, F.col(value).cast("double").alias("__x")).where("__x IS NOT NULL").groupBy(*keys, "__x").agg(F.count("*").alias("__n"))
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges are drawn by sampling, so the placement is written once and both its uses read the same
    placed = cut(each.repartitionByRange(blocks, *keys, "__x").withColumn("__b", F.spark_partition_id()))
    mine = Window.partitionBy(*keys)  # a row per range that a group has values in
    sizes = placed.groupBy("__b", *keys).agg(F.sum("__n").alias("__m"))
    sizes = sizes.withColumns({"__o": F.coalesce(F.sum("__m").over(mine.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__size": F.sum("__m").over(mine)})
    at = {name: F.lit(float(phi)) * (F.col("__size") - 1) for name, phi in phis.items()}
    within = lambda rank, lo, hi: (lo <= rank) & (rank < hi)
    wanted = F.lit(False)
    for rank in at.values():
        for f in (F.floor, F.ceil):
            wanted = wanted | within(f(rank), F.col("__o"), F.col("__o") + F.col("__m"))
    held = beside(placed, sizes.where(wanted), ["__b", *keys])
    hi = F.col("__o") + F.sum("__n").over(Window.partitionBy("__b", *keys).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = held.withColumn("__hi", hi).withColumn("__lo", F.col("__hi") - F.col("__n"))
    out = {}
    for name, rank in at.items():
        low, high = (F.max(F.when(within(f(rank), F.col("__lo"), F.col("__hi")), F.col("__x"))) for f in (F.floor, F.ceil))
        out[name] = low + (high - low) * F.first(rank - F.floor(rank))
    return ranked.groupBy(*keys).agg(*[F.when(F.count("__x") > 0, c).alias(n) for n, c in out.items()])


def describe(df: DataFrame, keys: list[str], value: str, grade: str = "full") -> DataFrame:
    """Statistics of ``value`` per ``keys`` (all rows together for no keys), one column for each.

    Deviations need the group's mean or median, so that a small table of group centres is joined back. A group of any size
    is only ever aggregated, or spread over ranges of its values.
    """
    if grade not in GRADES:
        raise ValueError(f"grade must be one of {GRADES}")
    x = F.col(value)
    first = dict(quick(x))
    if grade != "quick":
        first |= spread_of(x)
    if grade in ("full", "robust"):
        first |= moments(x)
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in first.items()])
    if grade == "quick":
        return out
    if grade != "lite":
        ends = {"__lo": 0.1, "__hi": 0.9} if grade == "robust" else {}
        out = beside(out, exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75} | ends), keys, "left").withColumn("iqr", F.col("q3") - F.col("q1"))
        out = cut(out)
    centre = out.select(*keys, F.col("mean").alias("__mean"), *([F.col("median").alias("__median"), "__lo", "__hi"] if grade == "robust" else []))
    held = beside(df.select(*keys, value), centre, keys)
    more = {"avdev": F.when(F.count(x) > 1, F.avg(F.abs(x - F.col("__mean"))))}
    if grade == "robust":
        more["trmean"] = F.coalesce(F.avg(F.when((x > F.col("__lo")) & (x < F.col("__hi")), x)), F.lit(float("nan")))
    out = beside(out.drop("__lo", "__hi"), held.groupBy(*keys).agg(*[c.alias(n) for n, c in more.items()]), keys)
    if grade == "robust":
        mad = exact_quantiles(held.withColumn("__d", F.abs(x - F.col("__median"))), keys, "__d", {"mad": 0.5})
        out = beside(out, mad, keys, "left").withColumn("rstdev", F.least(F.col("iqr") / 1.349, F.col("stdev")))
    return out
