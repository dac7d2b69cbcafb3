"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded Bernoulli copy.

Tokens are added up per source (partial sums before the shuffle, so that a source with most of the rows is no hot key).
A source's rate is its share of the target size over its tokens. Each record is emitted floor(rate) times, and once
more if the first 52 bits of the MD5 of ``seed:id``, as a number in [0, 1), lie below the rate's fraction. The rates are a few numbers, joined by
a broadcast whose size is checked; the pass that emits has no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sources at most in the table of targets.
SOURCES_MAX = 100_000
_SCHEMA = "source string, target_share double, max_repeats int, source_tokens long, rate double"


def rates(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[tuple[str, float, int, int, float]]:
    """(source, share, cap, tokens, rate) of each target source.

    Without ``total_tokens`` the mixture is the largest in which every source meets its share within its cap. Shares
    are scaled to add up to 1. Sources without tokens can't contribute: rate 0.
    """
    goal = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m")).limit(SOURCES_MAX + 1)
    have = sized.where(F.col("source").isNotNull() & F.col("n_tokens").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("t"))
    rows = sorted((r["source"], r["w"], r["m"], r["t"] or 0) for r in goal.join(have, "source", "left").collect())
    if len(rows) > SOURCES_MAX:
        raise ValueError(f"more than {SOURCES_MAX} sources")
    scale = sum(w for _, w, _, _ in rows) or 1.0
    rows = [(s, w / scale, m, t) for s, w, m, t in rows]
    able = [m * t / w for _, w, m, t in rows if t > 0]
    size = total_tokens if total_tokens is not None else min(able, default=0.0)
    return [(s, w, m, t, min(float(m), w * size / t) if t > 0 else 0.0) for s, w, m, t in rows]


def mix(sized: DataFrame, rated: list[tuple], seed: int = 0) -> DataFrame:
    """The mixture of ``sized`` (doc_id, source, n_tokens): ``doc_id``, ``source``, ``copy_no`` (from 1), ``n_tokens``.

    * records of null or unlisted sources, with null ids or sizes, take no part; records of 0 tokens are repeated alike;
    * no record is used more often than its source's cap; the same seed gives the same mixture on every run;
    * repeated rows count as records of their own; an empty table gives an empty result.
    """
    spark = sized.sparkSession
    table = F.broadcast(spark.createDataFrame(rated, _SCHEMA).select("source", "rate"))
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    rows = sized.select("doc_id", "source", "n_tokens").where("doc_id IS NOT NULL AND n_tokens IS NOT NULL").join(table, "source")
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    rows = rows.withColumn("copies", copies).where("copies > 0")
    return rows.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")


def shares(mixed: DataFrame, rated: list[tuple]) -> DataFrame:
    """Per target source: its rate, records and tokens of the mixture, its actual share and what it misses its target by."""
    table = mixed.sparkSession.createDataFrame(rated, _SCHEMA)
    out = mixed.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("n_tokens").alias("mixed_tokens"), F.max("copy_no").alias("most_copies"))
    told = table.join(out, "source", "left").fillna(0, ["n_records", "mixed_tokens", "most_copies"])
    total = F.lit(mixed.agg(F.sum("n_tokens")).first()[0] or 0)
    return told.withColumn("actual_share", F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0)).withColumn("off_target", F.col("actual_share") - F.col("target_share"))
