"""Counts tables in long form: (row_num, col_num, value) with a table of rows and one of columns.

Rows and columns are numbered from 1. Wide tables exist only at the border; everything between works on cells, so that
statistics and sums over rows, columns or the whole are plain aggregations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.session import cut


def to_long(wide: DataFrame, row: str, columns: Sequence[str], value: str = "value") -> DataFrame:
    """Cells (row, col_num, col_name, value) of the data columns of a wide table."""
    cells = F.array(*[F.struct(F.lit(k + 1).alias("col_num"), F.lit(c).alias("col_name"), F.col(c).cast("double").alias(value)) for k, c in enumerate(columns)])
    return wide.select(row, F.explode(cells).alias("c")).select(row, "c.col_num", "c.col_name", f"c.{value}")


def to_wide(long: DataFrame, row: str, names: Sequence[str], name: str = "col_name", value: str = "value", fill: float | None = None) -> DataFrame:
    """One row per ``row`` with the given columns, in their order."""
    wide = long.groupBy(row).pivot(name, list(names)).agg(F.first(value))
    return wide if fill is None else wide.fillna(fill, list(names))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row_num", blocks: int | None = None) -> DataFrame:
    """Rows numbered from 1 in a total order, without gathering them in one task.

    Range partitions are sorted and counted; each block's offset is the sum of the counts before it. The counts, one
    per block, are all that reaches one place.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    # ranges are drawn by sampling, so the placement is written once and both its uses read the same
    placed = cut(df.repartitionByRange(n, *keys).withColumn("__block", F.spark_partition_id()))
    within = placed.withColumn("__k", F.row_number().over(Window.partitionBy("__block").orderBy(*keys)))
    sizes = within.groupBy("__block").agg(F.count("*").alias("__n"))
    before = sizes.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__before"))  # one row per block
    return within.join(F.broadcast(before), "__block").withColumn(name, F.col("__k") + F.col("__before")).drop("__block", "__k", "__before")


def box(long: DataFrame, c1: int, r1: int, c2: int, r2: int) -> DataFrame:
    """Cells of the inclusive, 1-based box."""
    if min(c1, r1) < 1 or c2 < c1 or r2 < r1:
        raise ValueError("a box goes from low to high, from 1")
    return long.where(F.col("row_num").between(r1, r2) & F.col("col_num").between(c1, c2))


def collapse(long: DataFrame, onto: Mapping[int, int], axis: str = "col_num") -> DataFrame:
    """Rows or columns added onto a target: ``onto`` maps a number to its target; the others keep theirs."""
    target = F.col(axis)
    for a, b in onto.items():
        target = F.when(F.col(axis) == a, F.lit(b)).otherwise(target)
    other = "row_num" if axis == "col_num" else "col_num"
    return long.select(other, target.alias(axis), "value").groupBy(other, axis).agg(F.sum("value").alias("value"))


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by position; all need the same number of columns."""
    if len({len(t.columns) for t in tables}) != 1:
        raise ValueError("tables need the same number of columns")
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def paste(left: DataFrame, right: DataFrame, row: str = "row_num", check: bool = True) -> DataFrame:
    """Columns side by side by row number; both need the same rows."""
    if check and left.join(right, row, "full").where(left[row].isNull() | right[row].isNull()).limit(1).count():
        raise ValueError("tables need the same rows")
    return left.join(right, row)


def promote(info: DataFrame, long: DataFrame, key: str, col_num: int) -> tuple[DataFrame, DataFrame]:
    """Metadata ``key`` as a data column: (info without it, long with its cells)."""
    cells = info.select("row_num", F.lit(col_num).alias("col_num"), F.expr(f"try_cast(`{key}` AS DOUBLE)").alias("value"))
    return info.drop(key), long.select("row_num", "col_num", "value").unionByName(cells)


def stats_all_ways(long: DataFrame, grade: str = "lite") -> DataFrame:
    """Statistics per row, per column and of the matrix: row_num and col_num are null where all count.

    The quick grade is one pass of grouping sets. The others have deviations from each scope's own centre (``avdev``, and the
    robust ones), so that the three scopes are described one by one.
    """
    from sedimenta.functions.stats import describe, quick

    if grade != "quick":
        none = F.lit(None)
        each = (("row", ["row_num"], {"col_num": none.cast(long.schema["col_num"].dataType)}), ("column", ["col_num"], {"row_num": none.cast(long.schema["row_num"].dataType)}), ("matrix", [], {k: none.cast(long.schema[k].dataType) for k in ("row_num", "col_num")}))
        out = None
        for scope, keys, other in each:
            part = describe(long.select(*keys, "value"), keys, "value", grade).withColumns({**other, "scope": F.lit(scope)})
            out = part if out is None else out.unionByName(part)
        return out
    x = F.col("value")
    parts = dict(quick(x))
    sets = long.groupingSets([[F.col("row_num")], [F.col("col_num")], []], F.col("row_num"), F.col("col_num"))
    return sets.agg(F.grouping_id().alias("scope_bits"), *[c.alias(n) for n, c in parts.items()]).withColumn("scope", F.element_at(F.array(F.lit("cell"), F.lit("row"), F.lit("column"), F.lit("matrix")), (F.col("scope_bits") + 1).cast("int"))).drop("scope_bits")


def chance(key: str, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of ``seed:key``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def pick_number(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), those of the lowest ``chance`` of their unique key."""
    return df.orderBy(chance(key, seed), key).limit(n)


def pick_random(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Distinct rows without replacement, each with probability ``share``, by a seeded hash of ``key``: the same rows on every run."""
    if not 0 <= share < 1:
        raise ValueError("share must be at least 0 and below 1")
    return df.where(chance(key, seed) < share)


def sample_with_replacement(df: DataFrame, key: str, rate: float, seed: int = 0) -> DataFrame:
    """Rows repeated as a Poisson number of times of mean ``rate``, drawn by a hash of the key, with ``draw`` from 1."""
    import math

    u = chance(key, seed)
    cum, p, times = 0.0, math.exp(-rate), F.lit(0)
    for k in range(1, max(8, int(rate * 4) + 8)):
        cum += p
        times = times + F.when(u >= cum, 1).otherwise(0)
        p *= rate / k
    return df.withColumn("__n", times).where("__n > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def keep_rows(long: DataFrame, rows: DataFrame, row: str = "row_num") -> DataFrame:
    """Cells of the rows in ``rows`` (row_num, place), renumbered by their place."""
    return long.join(rows.select(F.col(row), F.col("place").alias("__place")), row).drop(row).withColumnRenamed("__place", row)


def info_values(info: DataFrame, key: str) -> DataFrame:
    """One metadata key per row; ValueError for a key that the table hasn't."""
    if key not in info.columns:
        raise ValueError(f"no metadata {key}")
    return info.select("row_num", key)


def apply(long: DataFrame, f, *by: str) -> DataFrame:
    """Cells mapped by ``f(value, aggregate)``: a column function of the value and of a function that gives an aggregate
    of the cell's scope (``by`` row_num, col_num, or nothing for the matrix), as in ``lambda v, agg: v - agg(F.avg)``."""
    used: dict[str, Column] = {}

    def agg(g) -> Column:
        name = f"__a{len(used)}"
        used[name] = g("value").alias(name)
        return F.col(name)

    mapped = f(F.col("value"), agg)
    if not used:
        return long.withColumn("value", mapped)
    scope = long.groupBy(*by).agg(*used.values())
    joined = long.join(scope, list(by)) if by else long.crossJoin(F.broadcast(scope))  # one row
    return joined.withColumn("value", mapped).drop(*used)


def add_rows(long: DataFrame, rows: DataFrame) -> DataFrame:
    """More rows (row_num, col_num, value); numbers that are taken and columns that differ are errors of the caller's data."""
    return long.select("row_num", "col_num", "value").unionByName(rows.select("row_num", "col_num", "value"))


def add_column(long: DataFrame, column: DataFrame, number: int) -> DataFrame:
    """One more column, from (row_num, value)."""
    return long.select("row_num", "col_num", "value").unionByName(column.select("row_num", F.lit(number).alias("col_num"), F.col("value").cast("double").alias("value")))


def drop_columns(long: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """Columns left out; the ones behind them move up."""
    gone = sorted(set(numbers))
    shift = F.lit(0)
    for k in gone:
        shift = shift + F.when(F.col("col_num") > k, 1).otherwise(0)
    return long.where(~F.col("col_num").isin(gone)).withColumn("col_num", F.col("col_num") - shift)


def drop_rows(long: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """Rows left out; the ones behind them move up."""
    gone = sorted(set(numbers))
    shift = F.lit(0)
    for k in gone:
        shift = shift + F.when(F.col("row_num") > k, 1).otherwise(0)
    return long.where(~F.col("row_num").isin(gone)).withColumn("row_num", F.col("row_num") - shift)
