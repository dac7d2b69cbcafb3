"""Images as cells (row, col, v) on a plane or toroid: convolutions, histogram, threshold, zoom, colours, tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the filters, with their divisor: Gaussian 5 x 5 (its fourth row has 14 where symmetry would have 16),
#: gradient 5 x 5 along columns (transposed: along rows), edges 3 x 3.
GAUSSIAN = ([[1, 4, 7, 4, 1], [4, 16, 26, 16, 4], [7, 26, 41, 26, 7], [4, 14, 26, 16, 4], [1, 4, 7, 4, 1]], 273.0)
GRADIENT = ([[2, 3, 0, -3, -2], [3, 4, 0, -4, -3], [6, 6, 0, -6, -6], [3, 4, 0, -4, -3], [2, 3, 0, -3, -2]], 1.0)
EDGES = ([[0.5, 1, 0.5], [1, -6, 1], [0.5, 1, 0.5]], 1.0)


def convolve(image: DataFrame, kernel: tuple[list[list[float]], float], rows: int, columns: int, transposed: bool = False) -> DataFrame:
    """Every cell gives its weighted share to the cells around it (over the toroid's edges); shares are added up."""
    weights, divisor = kernel
    half = len(weights) // 2
    taps = [(a - half, b - half, (weights[b][a] if transposed else weights[a][b]) / divisor) for a in range(len(weights)) for b in range(len(weights)) if (weights[b][a] if transposed else weights[a][b])]
    tap = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(w)).alias("w")) for a, b, w in taps])).alias("t")
    spread = image.select("row", "col", "v", tap).select(F.pmod(F.col("row") - F.col("t.a"), F.lit(rows)).alias("row"), F.pmod(F.col("col") - F.col("t.b"), F.lit(columns)).alias("col"), (F.col("v") * F.col("t.w")).alias("v"))
    return spread.groupBy("row", "col").agg(F.sum("v").alias("v"))


def gradient(image: DataFrame, rows: int, columns: int) -> DataFrame:
    """Magnitude of the gradient across and along."""
    x = convolve(image, GRADIENT, rows, columns).withColumnRenamed("v", "gx")
    y = convolve(image, GRADIENT, rows, columns, transposed=True).withColumnRenamed("v", "gy")
    return x.join(y, ["row", "col"]).select("row", "col", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("v"))


def grey(v: Column) -> Column:
    """Grey level 0 .. 255 of a value 0 .. 1."""
    return F.floor(v * 255).cast("int").bitwiseAND(255)


def histogram(image: DataFrame, v: str = "v") -> DataFrame:
    """(level, n) of the grey levels that occur."""
    return image.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).groupBy(grey(F.col(v)).alias("level")).agg(F.count("*").alias("n"))


def otsu(levels: DataFrame) -> DataFrame:
    """One row with the ``threshold`` level of the largest variance between the classes up to it and above it.

    Runs over at most 256 levels.
    """
    w = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = levels.select("level", F.sum("n").over(w).alias("below"), F.sum("n").over(everything).alias("n"), F.sum(F.col("level") * F.col("n")).over(w).alias("low"), F.sum(F.col("level") * F.col("n")).over(everything).alias("total"))
    above = F.col("n") - F.col("below")
    gap = F.try_divide(F.col("low").cast("double"), F.col("below").cast("double")) - F.try_divide((F.col("total") - F.col("low")).cast("double"), above.cast("double"))
    between = F.col("below").cast("double") * above * gap * gap
    return s.select("level", F.round(F.coalesce(between, F.lit(0.0)), 3).alias("b")).agg(F.max_by("level", F.struct(F.col("b"), -F.col("level"))).alias("threshold"))


def zoom(image: DataFrame, rows: int, columns: int, times: int) -> DataFrame:
    """Bilinear zoom over the toroid: each cell becomes times x times cells."""
    at = lambda a, b, name: image.select(F.pmod(F.col("row") - a, F.lit(rows)).alias("row"), F.pmod(F.col("col") - b, F.lit(columns)).alias("col"), F.col("v").alias(name))
    four = at(0, 0, "v00").join(at(0, 1, "v01"), ["row", "col"]).join(at(1, 0, "v10"), ["row", "col"]).join(at(1, 1, "v11"), ["row", "col"])
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(times) for b in range(times)])).alias("s")
    y, x = F.col("s.a") / float(times), F.col("s.b") / float(times)
    v = F.col("v00") * (1 - y) * (1 - x) + F.col("v01") * (1 - y) * x + F.col("v10") * y * (1 - x) + F.col("v11") * y * x
    return four.select("*", steps).select((F.col("row") * times + F.col("s.a")).alias("row"), (F.col("col") * times + F.col("s.b")).alias("col"), v.alias("v"))


def palette_index(v: Column, colours: int) -> Column:
    return F.least(F.lit(colours - 1), F.floor(v * colours)).cast("int")


def tile(image: DataFrame, rows: int, columns: int) -> DataFrame:
    """The image four times, 2 x 2."""
    q = F.explode(F.array(*[F.struct(F.lit(a * rows).alias("a"), F.lit(b * columns).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("q")
    return image.select("*", q).select((F.col("row") + F.col("q.a")).alias("row"), (F.col("col") + F.col("q.b")).alias("col"), "v")


def overlay(matches: DataFrame, size: int, scale: int, shape: str = "square") -> DataFrame:
    """Pixels (row, col, class) of best matches (row, col, class) drawn as squares or circles; the highest class is on top."""
    half = size // 2
    dots = [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1) if shape == "square" or a * a + b * b <= half * half]
    dot = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in dots])).alias("d")
    return matches.select("*", dot).select((F.col("row") * scale + F.col("d.a")).alias("row"), (F.col("col") * scale + F.col("d.b")).alias("col"), "class").groupBy("row", "col").agg(F.max("class").alias("class"))
