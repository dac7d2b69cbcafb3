"""Classes of data points: by neuron, by majority of their sequence, by length, coverage, name or hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.counts import numbered


def class_table(df: DataFrame, name: str, by_size: bool = False, least: int = 1) -> DataFrame:
    """(name, class, n): classes from 1 by name, or by size and then name; those below ``least`` members left out.

    The numbering is distributed, so that there may be any number of names.
    """
    sizes = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = [F.desc("n"), F.asc("name")] if by_size else [F.asc("name")]
    return numbered(sizes, order, "class")


def by_first_appearance(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, class): classes from 1 in the order in which names first appear."""
    first = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(order).alias("__first"))
    return numbered(first, ["__first", "name"], "class").select("name", "class")


def by_neuron(matches: DataFrame, mask: DataFrame, neuron: str = "neuron") -> DataFrame:
    """Matches with the class of their neuron in ``mask`` (neuron, class); 0 where it has none."""
    return matches.join(mask.select(F.col("neuron").alias(neuron), "class"), neuron, "left").withColumn("class", F.coalesce("class", F.lit(0)))


def majority(parts: DataFrame, parent: str, cls: str, length: str) -> DataFrame:
    """(parent, class): the class with most bases of each parent, the lower of equal ones."""
    sums = parts.where(F.col(parent).isNotNull()).groupBy(parent, cls).agg(F.sum(length).alias("bases"))
    return sums.groupBy(parent).agg(F.max_by(F.col(cls), F.struct("bases", -F.col(cls))).alias("winner"))


def correct_parts(parts: DataFrame, parent: str, cls: str, length: str) -> DataFrame:
    """``parts`` with ``corrected``: every part of a parent moves to the class with most bases; a win of class 0 changes nothing."""
    won = majority(parts, parent, cls, length)
    return parts.join(won, parent, "left").withColumn("corrected", F.when(F.coalesce("winner", F.lit(0)) != 0, F.col("winner")).otherwise(F.col(cls))).drop("winner")


def length_bin(length: Column, low: Column, high: Column, bins: int = 64) -> Column:
    """Index of the first of ``bins`` breakpoints low + int(i * (high - low) / bins) that isn't below the length; else ``bins``."""
    points = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: low + F.floor(i * (high - low) / bins))
    at = F.array_position(F.transform(points, lambda p: p >= length), F.lit(True))
    return F.when(at > 0, at.cast("int") - 1).otherwise(bins)


def coverage_bin(value: Column, low: Column, high: Column, top: int = 31) -> Column:
    return F.when(high > low, F.floor(top * (value - low) / (high - low))).otherwise(0).cast("int")


def distance_bin(distance: Column, top: int = 31) -> Column:
    return F.least(F.lit(top), F.floor(distance)).cast("int")


def members_per_class(classes: DataFrame, cls: str) -> DataFrame:
    return classes.groupBy(cls).agg(F.count("*").alias("n"))


def names_index(names: DataFrame) -> DataFrame:
    """(parent, n, last_index): fragments per parent; names that are no fragments count under their first word, the last one standing.

    ``names``: index, name.
    """
    from sedimenta.functions.sequences import first_word, fragment_parts

    p = fragment_parts(F.col("name"))
    rows = names.where("name IS NOT NULL").select("index", p.isNotNull().alias("is_part"), F.coalesce(p["parent"], first_word(F.col("name"))).alias("parent"))
    return rows.groupBy("parent").agg(F.when(F.max("is_part"), F.countDistinct(F.when(F.col("is_part"), F.col("index")))).otherwise(1).alias("n"), F.max("index").alias("last_index"))
