"""Search hits, gene features, coverage and sequence clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.sequences import sample_name
from sedimenta.operators.counts import numbered


# hits --------------------------------------------------------------------------------------------------------------
def best_hits(hits: DataFrame, key: list[str], score: str = "bit_score", order: str = "line_no") -> DataFrame:
    """One hit per key: the highest score, the first of equal ones. An aggregate, so only one row per key and task is shuffled."""
    usable = hits.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    for k in key:
        usable = usable.where(F.col(k).isNotNull())
    rest = [c for c in hits.columns if c not in key]
    best = usable.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score).cast("double"), -F.col(order).cast("long"))).alias("__b"))
    return best.select(*key, *[F.col(f"__b.{c}").alias(c) for c in rest])


def hit_coverage(hits: DataFrame, subjects: DataFrame, subject: str, length: str) -> DataFrame:
    """Hits with ``coverage``: aligned over subject length."""
    return hits.join(subjects.select(subject, length), subject).withColumn("coverage", F.try_divide(F.col("aln_len").cast("double"), F.col(length).cast("double")))


def hmm_target(line: Column, domains: bool = False) -> Column:
    """Fields of a whitespace table of profile hits: target, query, e-value, score, description (the rest of the line)."""
    f = F.split(F.trim(line), r"\s+")
    tail = 23 if domains else 19
    text = F.array_join(F.slice(f, tail, F.greatest(F.size(f) - tail + 1, F.lit(0))), " ")
    return F.struct(
        F.get(f, F.lit(0)).alias("target"), F.get(f, F.lit(3 if domains else 2)).alias("query"), F.get(f, F.lit(6 if domains else 4)).cast("double").alias("e_value"),
        F.get(f, F.lit(7 if domains else 5)).cast("double").alias("score"), text.alias("description"),
    )


# genes -------------------------------------------------------------------------------------------------------------
def gene_map(features: DataFrame, seqid: str, beg: str, end: str) -> DataFrame:
    """(seqid, n_genes, first, last): how many genes each sequence has and the positions that they span; ``number_features`` lists them in order."""
    usable = features.where(F.col(seqid).isNotNull() & F.col(beg).isNotNull() & F.col(end).isNotNull())
    return usable.groupBy(seqid).agg(F.count("*").alias("n_genes"), F.min(F.least(beg, end)).alias("first"), F.max(F.greatest(beg, end)).alias("last"))


def number_features(features: DataFrame, seqid: str, order: list[str]) -> DataFrame:
    """Features numbered from 1 within their sequence, with ``name`` <seqid>_<n>.

    All features are put in one distributed order and numbered by it; a sequence's numbers are these less its lowest, so
    that no task holds a whole sequence.
    """
    every = numbered(features.where(F.col(seqid).isNotNull()), [F.col(seqid), *[F.col(c) for c in order]], "__at")
    least = every.groupBy(seqid).agg((F.min("__at") - 1).alias("__before"))
    out = every.join(least, seqid).withColumn("n", F.col("__at") - F.col("__before")).drop("__at", "__before")
    return out.withColumn("name", F.concat_ws("_", seqid, "n"))


def to_nucleotides(hits: DataFrame, genes: DataFrame, gene: str = "gene") -> DataFrame:
    """Protein hits in nucleotide positions of their gene: start + 3 * position."""
    return hits.join(genes.select(gene, "seqid", "start"), gene).select("*", (F.col("start") + 3 * F.col("q_beg")).alias("nt_beg"), (F.col("start") + 3 * F.col("q_end")).alias("nt_end"))


# coverage ----------------------------------------------------------------------------------------------------------
def covered(depth: DataFrame, sequences: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(seqid, sample, bases, share): depth sums per sequence and sample, 0 below the threshold of covered positions.

    ``depth``: seqid, sample, pos, depth. ``sequences``: seqid, length.
    """
    per = depth.groupBy("seqid", "sample").agg(F.sum("depth").alias("all_bases"), F.count(F.when(F.col("depth") > 0, 1)).alias("n"))
    share = F.try_divide(F.col("n").cast("double"), F.col("length").cast("double"))
    return per.join(sequences, "seqid").select("seqid", "sample", F.when(share >= threshold, F.col("all_bases")).otherwise(0).alias("bases"), share.alias("share"))


def covered_by_any(depth: DataFrame, passing: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seqid, share): positions covered in any passing (seqid, sample), over the length."""
    seen = depth.where("depth > 0").join(passing.select("seqid", "sample"), ["seqid", "sample"], "left_semi").groupBy("seqid", "pos").agg(F.lit(1).alias("one"))
    return seen.groupBy("seqid").agg(F.count("*").alias("n")).join(sequences, "seqid").select("seqid", F.try_divide(F.col("n").cast("double"), F.col("length").cast("double")).alias("share"))


def gene_depth(depth: DataFrame, genes: DataFrame, width: int = 1024) -> DataFrame:
    """Depth summed per gene and sample, the last base included. ``genes``: gene, seqid, beg, end."""
    from sedimenta.operators.joins import points_in_intervals

    return points_in_intervals(depth, genes, "seqid", "pos", "beg", "end", width).groupBy("gene", "sample").agg(F.sum("depth").alias("bases"))


# clusters ----------------------------------------------------------------------------------------------------------
def cluster_index(records: DataFrame) -> DataFrame:
    """Clusters of records (kind, cluster, size, pct_id, alignment, label): one row each.

    S: a seed with its length; L: a library seed; C and D: average identity; H, N, R: members with their identity.
    """
    kind = F.col("kind")
    member = kind.isin("H", "N", "R")
    return records.where("cluster IS NOT NULL").groupBy("cluster").agg(
        F.max(F.when(kind.isin("S", "L"), F.col("label"))).alias("seed"), F.max(F.when(kind == "S", F.col("size").cast("long"))).alias("seed_length"),
        F.max(kind == "L").alias("is_library"), F.count(F.when(member | (kind == "S"), 1)).alias("n_members"),
        F.max(F.when(kind == "C", F.expr("try_cast(pct_id AS DOUBLE)")).when(kind == "D", F.expr("try_cast(alignment AS DOUBLE)"))).alias("avg_id"),
        F.avg(F.when(member, F.expr("try_cast(pct_id AS DOUBLE)"))).alias("mean_pct_id"),
    )


def cluster_of(records: DataFrame) -> DataFrame:
    """(label, cluster) of every seed and member."""
    return records.where(F.col("kind").isin("S", "H", "N", "R")).select("label", "cluster")


#: Samples that a table has columns for, at most; beyond, ``members`` grouped by cluster and sample is the table in long form.
SAMPLES_MAX = 10_000


def sample_names(members: DataFrame) -> list[str]:
    """Samples of the members, in order; ValueError beyond SAMPLES_MAX."""
    got = members.select(sample_name(F.col("label")).alias("s")).where("s IS NOT NULL").distinct().limit(SAMPLES_MAX + 1).collect()
    if len(got) > SAMPLES_MAX:
        raise ValueError(f"more than {SAMPLES_MAX} samples")
    return sorted(r[0] for r in got)


def cluster_lines(records: DataFrame, order: str, least: int = 1) -> DataFrame:
    """(rank, cluster, n_members, line): clusters with at least ``least`` members, largest first, then lowest number; ``line``
    has the seed, the size and the average identity, by tabs."""
    c = cluster_index(records).where(F.col("n_members") >= least)
    text = F.concat_ws("\t", "cluster", F.coalesce("seed", F.lit("")), "n_members", F.coalesce(F.format_string("%.1f", "avg_id"), F.lit("*")))
    by = {"size": [F.desc("n_members"), F.asc("cluster")], "identity": [F.desc_nulls_last("avg_id"), F.asc("cluster")], "seed": [F.asc_nulls_last("seed"), F.asc("cluster")]}[order]
    return numbered(c.withColumn("line", text), by, "rank").select("rank", "cluster", "n_members", "line")


def window_coverage(depth: DataFrame, windows: DataFrame, threshold: float = 0.0, width: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(counts, any): depth sums per window and sample, and the share of each window's positions that any sample covers.

    ``depth``: seqid, sample, pos, depth. ``windows``: window, seqid, beg, end. A sample counts 0 in a window, and adds
    nothing to its covered positions, where it covers less than ``threshold`` of them.
    """
    from sedimenta.operators.joins import points_in_intervals

    size = windows.select("window", (F.col("end") - F.col("beg") + 1).alias("size"))
    inside = points_in_intervals(depth.where("depth > 0"), windows, "seqid", "pos", "beg", "end", width).groupBy("window", "sample", "pos").agg(F.sum("depth").alias("depth"))
    per = inside.groupBy("window", "sample").agg(F.sum("depth").alias("bases"), F.count("*").alias("n")).join(size, "window")
    per = per.withColumn("passes", F.col("n") / F.col("size") >= threshold)
    seen = inside.join(per.where("passes").select("window", "sample"), ["window", "sample"], "left_semi").select("window", "pos").distinct().groupBy("window").agg(F.count("*").alias("n"))
    share = size.join(seen, "window", "left").select("window", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("share"))
    return per.select("window", "sample", F.when(F.col("passes"), F.col("bases")).otherwise(0).alias("bases")), share


def sample_table(counts: DataFrame, rows: DataFrame, row: str, samples: list[str], value: str = "bases") -> DataFrame:
    """``rows`` with a column for each sample, 0 where ``counts`` (row, sample, value) has nothing."""
    wide = counts.groupBy(row).agg(*[F.sum(F.when(F.col("sample") == s, F.col(value))).alias(s) for s in samples])
    return rows.join(wide, row, "left").fillna(0, samples)


def count_samples(members: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Members per cluster and sample (what stands before ``_scaffold`` or ``_contig``), one column each, 0 where none."""
    named = members.withColumn("sample", sample_name(F.col("label"))).where("sample IS NOT NULL")
    wide = named.groupBy("cluster").pivot("sample", samples).count() if samples else named.groupBy("cluster").pivot("sample").count()
    return wide.fillna(0)


def rarefaction(members: DataFrame, order: str, step: int, group: str = "sample", cluster: str = "cluster") -> DataFrame:
    """After every ``step`` members of a group, in order: how many members and how many different clusters were seen.

    ``order`` is a number from 1 within the group. A cluster counts at its first member, so that running counts are sums
    per step and then over steps; no window runs over single members.
    """
    first = members.groupBy(group, cluster).agg(F.min(order).alias("__first"))
    block = lambda c: F.ceil(F.col(c) / step).cast("long")
    seen = members.groupBy(group, block(order).alias("block")).agg(F.count("*").alias("n"))
    new = first.groupBy(group, block("__first").alias("block")).agg(F.count("*").alias("k"))
    w = Window.partitionBy(group).orderBy("block")
    return seen.join(new, [group, "block"], "left").select(group, "block", F.sum("n").over(w).alias("n_members"), F.sum(F.coalesce("k", F.lit(0))).over(w).alias("n_clusters"))

