"""Queries on vectors and matrices: arithmetic, distances, moments, products, radius counts, hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import vectors as vx
from sedimenta.operators import density, joins, linalg
from sedimenta.plans.tables import counts
from sedimenta.session import cut, table


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable training vectors, one per index."""
    t = table(spark, sf_dir, "training_vectors").where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    return t.groupBy("data_index").agg(F.min("v").alias("v"))


def following(spark, sf_dir) -> DataFrame:
    """Each vector with the one whose id follows."""
    e = embeddings(spark, sf_dir)
    return e.select("vec_id", F.col("v").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")


def centroids(spark, sf_dir) -> DataFrame:
    """(label, w): mean vector of each label."""
    m = embeddings(spark, sf_dir).select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("w"))  # one array of d numbers per label


#: Distances that get so large, or so near to a division by 0, that their logarithm is compared.
LARGE = ("lquarter", "lthird", "lhalf", "bray_curtis")


def distances(spark, sf_dir):
    """All 15 distances between each vector and the next, some as logarithms."""
    p = following(spark, sf_dir)
    return p.select("vec_id", *[F.round(F.log(F.abs(d)) if n in LARGE else d, 5).alias(n) for n in vx.DISTANCES for d in (vx.distance(n, F.col("a"), F.col("b")),)])


def bounded(spark, sf_dir):
    """All 11 bounded distances: how many pairs stay within the threshold, and the mean of their logarithms."""
    p = following(spark, sf_dir)
    d = {n: vx.distance(n, F.col("a"), F.col("b"), t) for n, t in THRESHOLDS.items()}
    return p.agg(*[F.count(c).alias(f"n_{n}") for n, c in d.items()], *[F.round(F.avg(F.log(c)), 6).alias(f"mean_{n}") for n, c in d.items()])


THRESHOLDS = {"manhattan": 9.0, "euclid": 1.5, "squared_euclid": 2.0, "lquarter": 1.5e6, "lthird": 24_000.0, "lhalf": 450.0, "lp1": 9.0, "lp2": 1.4, "lp3": 0.85, "lp4": 0.65, "maximum": 0.45}


def aggregates(spark, sf_dir):
    """Folds of each vector, and of each with the next."""
    p, a, b = following(spark, sf_dir), F.col("a"), F.col("b")
    out = {
        "low": F.array_min(a), "high": F.array_max(a), "total": vx.total(a), "mean": vx.mean(a), "variance": vx.variance(a), "stdev": vx.stdev(a), "dot": vx.dot(a, b), "norm2": vx.norm2(a),
        "asum": vx.asum(a), "covariance": vx.covariance(a, b), "correlation": vx.correlation(a, b), "q1": vx.quantile(a, 0.25), "median": vx.quantile(a, 0.5), "trimmed": vx.trimmed_mean(a, 0.2), "rstdev": vx.robust_stdev(a),
    }
    return p.select("vec_id", vx.iamax(a).alias("iamax"), *[F.round(c, 6).alias(n) for n, c in out.items()])


def arithmetic(spark, sf_dir):
    """Elementwise arithmetic, views and scalings, each folded to its sum."""
    p, a, b = following(spark, sf_dir), F.col("a"), F.col("b")
    out = {
        "plus": vx.plus(a, b), "minus": vx.minus(a, b), "times": vx.times(a, b), "plus_number": vx.plus(a, 2), "times_number": vx.times(a, 3), "plusmult": vx.plusmult(a, b, 0.5), "part": vx.part(a, 8, 4),
        "selection": vx.selection(a, F.array(F.lit(0), F.lit(5), F.lit(5))), "unit": vx.to_unit(a),
    }
    firsts = {"swapped": vx.swapped(a, 0, 3), "permuted": vx.permute(a, [7, 6, 5]), "ztrans": vx.ztrans(a)}
    return p.select("vec_id", vx.same(a, a).alias("is_same"), vx.same(a, b, 1e-3).alias("is_near"), *[F.round(vx.total(c), 5).alias(n) for n, c in out.items()], *[F.round(F.get(c, F.lit(0)), 5).alias(n) for n, c in firsts.items()])


def condensed(spark, sf_dir):
    """Lower triangle of the distances between the labels' mean vectors."""
    d = joins.condensed_distances(cut(centroids(spark, sf_dir)), "label", "w")
    return d.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("d", 6).alias("d"))


def grid_distances(spark, sf_dir):
    """Toroid and planar distances of each best match to its fellow with the next index."""
    b = table(spark, sf_dir, "bestmatches").where("bm_row IS NOT NULL AND bm_col IS NOT NULL").groupBy("data_index").agg(F.min("bm_row").alias("r"), F.min("bm_col").alias("c"))
    p = b.join(b.select((F.col("data_index") - 1).alias("data_index"), F.col("r").alias("r2"), F.col("c").alias("c2")), "data_index")
    args = (F.col("r"), F.col("c"), F.col("r2"), F.col("c2"), 82, 137)
    return p.select("data_index", *[vx.grid_distance(k, *args, toroid=t).cast("long").alias(f"{'toroid' if t else 'plane'}_{k}") for k in ("squared", "manhattan", "max") for t in (True, False)])


def radius_counts(spark, sf_dir):
    """Vectors within a radius of each label's mean vector."""
    names, w = joins.codebook(centroids(spark, sf_dir), "label", "w")
    n = joins.neighbours_within(w, embeddings(spark, sf_dir), "v", 0.95)
    labels = spark.createDataFrame([(k, int(name)) for k, name in enumerate(names)], "centre long, label int")
    return labels.join(n, "centre").select("label", "n")


def descriptives(spark, sf_dir):
    """Minimum, maximum, mean and standard deviation of each dimension."""
    m = linalg.moments(training(spark, sf_dir), "v")[""]
    rows = [(k, float(a), float(b), round(float(c), 6), round(float(d), 6)) for k, (a, b, c, d) in enumerate(zip(m.low, m.high, m.mean, m.stdev))]
    return spark.createDataFrame(rows, "dimension int, low double, high double, mean double, stdev double")


def _pairs(spark, m: np.ndarray, name: str) -> DataFrame:
    return spark.createDataFrame([(i, j, round(float(m[i, j]), 6)) for i in range(len(m)) for j in range(i + 1)], f"i int, j int, {name} double")


def covariance(spark, sf_dir):
    """Covariance of all pairs of dimensions, from one Gram matrix per task."""
    return _pairs(spark, linalg.moments(training(spark, sf_dir), "v")[""].cov, "covariance")


def correlation(spark, sf_dir):
    """Correlation of all pairs of dimensions."""
    return _pairs(spark, linalg.moments(training(spark, sf_dir), "v")[""].correlation, "correlation")


def principal_components(spark, sf_dir):
    """Variances along the principal components, largest first, with their share."""
    values, _ = linalg.principal_components(linalg.moments(training(spark, sf_dir), "v")[""])
    return spark.createDataFrame([(k, float(v), float(v / values.sum())) for k, v in enumerate(values)], "component int, variance double, share double")


def mahalanobis(spark, sf_dir):
    """Distance of every vector to its label's model."""
    e = embeddings(spark, sf_dir)
    return linalg.mahalanobis(e, "v", ["vec_id", "label"], "label", linalg.moments(e, "v", "label"))


def _plane(spark, sf_dir):
    """The first two dimensions of the vectors."""
    return embeddings(spark, sf_dir).select("vec_id", "label", F.slice("v", 1, 2).alias("v"))


def mahalanobis_plane(spark, sf_dir):
    """The same in the first two dimensions, which has a closed form."""
    e = _plane(spark, sf_dir)
    d = linalg.mahalanobis(e, "v", ["vec_id", "label"], "label", linalg.moments(e, "v", "label"))
    return d.select("vec_id", "label", F.round(d.columns[-1], 6).alias("distance"))


def principal_plane(spark, sf_dir):
    """Variances along the two principal components of the first two dimensions, which have a closed form."""
    values, _ = linalg.principal_components(linalg.moments(_plane(spark, sf_dir), "v")[""])
    return spark.createDataFrame([(k, round(float(v), 9)) for k, v in enumerate(values)], "component int, variance double")


def eigen_sums(spark, sf_dir):
    """Sum of the covariance's eigenvalues, of their squares, and of the principal variances: its trace, its squared norm, its trace."""
    m = linalg.moments(training(spark, sf_dir), "v")[""]
    values, _ = linalg.symmetric_eigen(m.cov)
    principal, _ = linalg.principal_components(m)
    return spark.createDataFrame([(round(float(values.sum()), 6), round(float((values**2).sum()), 6), round(float(principal.sum()), 6))], "total double, squares double, principal double")


def gemm(spark, sf_dir):
    """Columns of the counts table times each other."""
    a = counts(spark, sf_dir).select(F.col("row_num").alias("i"), F.col("col_num").cast("long").alias("j"), F.col("value").alias("v"))
    return linalg.gemm(linalg.transpose(a), a).select("i", "j", F.round("v", 2).alias("v"))


def gemv(spark, sf_dir):
    """The counts table times the vector 1 .. 7."""
    a = counts(spark, sf_dir).select(F.col("row_num").alias("i"), F.col("col_num").cast("long").alias("j"), F.col("value").alias("v"))
    x = spark.range(1, 8).select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    return linalg.gemv(a, x, alpha=2.0).select("i", F.round("v", 2).alias("v"))


def ger(spark, sf_dir):
    """The counts table plus the outer product of row and column numbers."""
    a = counts(spark, sf_dir).select(F.col("row_num").alias("i"), F.col("col_num").cast("long").alias("j"), F.col("value").alias("v"))
    number = lambda c: a.select(F.col(c).alias("i")).distinct().select("i", F.col("i").cast("double").alias("v"))
    return linalg.ger(a, number("i"), number("j"), 0.5).select("i", "j", F.round("v", 2).alias("v"))


def trace(spark, sf_dir):
    """Trace of the counts table's first seven rows and columns, as far as there are cells."""
    a = counts(spark, sf_dir).select(F.col("row_num").alias("i"), F.col("col_num").cast("long").alias("j"), F.col("value").alias("v"))
    return linalg.trace(a)


def factories(spark, sf_dir):
    """Matrices made from a rule, and their properties."""
    out = None
    for kind in ("general", "hilbert", "vandermonde", "identity"):
        p = linalg.properties(linalg.factory(spark, kind, 6), 1e-12).withColumn("kind", F.lit(kind))
        out = p if out is None else out.unionByName(p)
    return out


_PICKS = density.draw_picks(64, 4, 10, 3)


def hash_buckets(spark, sf_dir):
    """Buckets of a unary hash of ten (dimension, level) picks on -0.5 .. 0.5."""
    return density.buckets(embeddings(spark, sf_dir), density.unary_bits(F.col("v"), [-0.5] * 64, [0.5] * 64, 4, _PICKS))


def stratified(spark, sf_dir):
    """A quarter of every hash bucket."""
    e = embeddings(spark, sf_dir).withColumn("bucket", density.unary_bits(F.col("v"), [-0.5] * 64, [0.5] * 64, 4, _PICKS[:4]))
    return density.stratified(e, "bucket", F.xxhash64("vec_id"), 25.0).groupBy("bucket").agg(F.count("*").alias("n"))


def stratified_sizes(spark, sf_dir):
    """How many rows each bucket's quarter has."""
    return stratified(spark, sf_dir)


def pareto_radius(spark, sf_dir):
    """Pareto radius of all usable vectors, and the density at each: how many others it has within the radius."""
    r, n = density.pareto_densities(training(spark, sf_dir), "data_index", "v")
    return n.select(F.col("index").alias("centre"), "n", F.lit(round(r, 6)).alias("radius"))


def queries():
    fs = (distances, bounded, aggregates, arithmetic, condensed, grid_distances, radius_counts, descriptives, covariance, correlation, principal_components, principal_plane, eigen_sums, mahalanobis, mahalanobis_plane, gemm, gemv, ger, trace, factories, hash_buckets, stratified_sizes, pareto_radius)
    return {f"vectors_{f.__name__}": f for f in fs}


_F = "f AS (SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
_U = f"{_F}, u AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, unnest(range(0, len(a))) AS d FROM f)"
_T = "t AS (SELECT data_index, min(v) AS v FROM training_vectors WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY data_index), u AS (SELECT data_index, unnest(v) AS x, unnest(range(0, len(v)))::INT AS d FROM t)"
_C = "e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding))) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS x FROM e GROUP BY ALL), c AS (SELECT label, list(x ORDER BY d) AS w FROM m GROUP BY label)"
_K = "WITH c AS (SELECT l_suppkey AS i, l_linenumber::BIGINT AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def _bits(picks):
    return " || ".join(f"CASE WHEN (embedding[{d + 1}]::DOUBLE + 0.5) / 1.0::DOUBLE * 4 >= {t + 1} THEN '1' ELSE '0' END" for d, t in picks)


def oracle_sql():
    lp = lambda p: f"pow(sum(pow(abs(x - y), {p}::DOUBLE)), 1 / {p}::DOUBLE)"
    sq = "sum((x - y) * (x - y))"
    both = "FROM u GROUP BY vec_id"
    pair = lambda f, n: f"WITH {_T}, p AS (SELECT a.d AS i, b.d AS j, {f}(a.x, b.x) AS r FROM u a JOIN u b USING (data_index) WHERE a.d >= b.d GROUP BY ALL) SELECT i, j, round(r, 6) AS {n} FROM p"
    t = {
        "distances": f"""WITH {_U} SELECT vec_id, round(sum(abs(x - y)), 5) AS manhattan, round(sqrt({sq}), 5) AS euclid, round({sq}, 5) AS squared_euclid, round(ln({lp(0.25)}), 5) AS lquarter, round(ln({lp('(1.0::DOUBLE / 3)')}), 5) AS lthird, round(ln({lp(0.5)}), 5) AS lhalf,
            round({lp(1)}, 5) AS lp1, round({lp(2)}, 5) AS lp2, round({lp(3)}, 5) AS lp3, round({lp(4)}, 5) AS lp4, round(max(abs(x - y)), 5) AS maximum, round(sum(abs(x - y) / (abs(x) + abs(y))), 5) AS canberra, round(ln(abs(sum(abs(x - y)) / sum(x + y))), 5) AS bray_curtis,
            round(1 - corr(x, y), 5) AS correlation, round(1 - sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)), 5) AS cosine {both}""",
        "bounded": f"""WITH {_U}, d AS (SELECT sum(abs(x - y)) AS manhattan, sqrt({sq}) AS euclid, {sq} AS squared_euclid, {lp(0.25)} AS lquarter, {lp('(1.0::DOUBLE / 3)')} AS lthird, {lp(0.5)} AS lhalf, sum(abs(x - y)) AS lp1, sqrt({sq}) AS lp2, {lp(3)} AS lp3, {lp(4)} AS lp4, max(abs(x - y)) AS maximum {both})
            SELECT {", ".join(f"count(CASE WHEN {n} <= {t} THEN 1 END) AS n_{n}, round(avg(CASE WHEN {n} <= {t} THEN ln({n}) END), 6) AS mean_{n}" for n, t in (("manhattan", 9), ("euclid", 1.5), ("squared_euclid", 2), ("lquarter", 1500000), ("lthird", 24000), ("lhalf", 450), ("lp1", 9), ("lp2", 1.4), ("lp3", 0.85), ("lp4", 0.65), ("maximum", 0.45)))} FROM d""",
        "aggregates": f"""WITH {_U}, q AS (SELECT vec_id, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi {both})
            SELECT vec_id, arg_max(d, struct_pack(m := abs(x), k := -d))::INT AS iamax, round(min(x), 6) AS low, round(max(x), 6) AS high, round(sum(x), 6) AS total, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance, round(stddev_samp(x), 6) AS stdev, round(sum(x * y), 6) AS dot,
            round(sqrt(sum(x * x)), 6) AS norm2, round(sum(abs(x)), 6) AS asum, round(covar_samp(x, y), 6) AS covariance, round(corr(x, y), 6) AS correlation, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median,
            round(avg(CASE WHEN x > lo AND x < hi THEN x END), 6) AS trimmed, round(least((quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349, stddev_samp(x)), 6) AS rstdev FROM u JOIN q USING (vec_id) GROUP BY vec_id""",
        "arithmetic": f"""WITH {_U} SELECT vec_id, true AS is_same, max(abs(x - y)) <= 1e-3 AS is_near, round(sum(x + y), 5) AS plus, round(sum(x - y), 5) AS minus, round(sum(x * y), 5) AS times, round(sum(x + 2), 5) AS plus_number, round(sum(3 * x), 5) AS times_number, round(sum(x + 0.5 * y), 5) AS plusmult,
            round(sum(CASE WHEN d BETWEEN 8 AND 11 THEN x END), 5) AS part, round(max(CASE WHEN d = 0 THEN x END) + 2 * max(CASE WHEN d = 5 THEN x END), 5) AS selection, round((sum(x) - count(*) * min(x)) / (max(x) - min(x)), 5) AS unit,
            round(max(CASE WHEN d = 3 THEN x END), 5) AS swapped, round(max(CASE WHEN d = 7 THEN x END), 5) AS permuted, round((max(CASE WHEN d = 0 THEN x END) - avg(x)) / stddev_samp(x), 5) AS ztrans {both}""",
        "condensed": f"WITH {_C} SELECT a.label AS i, b.label AS j, round(list_distance(a.w, b.w), 6) AS d FROM c a JOIN c b ON a.label > b.label",
        "grid_distances": """WITH b AS (SELECT data_index, min(bm_row) AS r, min(bm_col) AS c FROM bestmatches WHERE bm_row IS NOT NULL AND bm_col IS NOT NULL GROUP BY data_index),
            p AS (SELECT x.data_index, abs(x.r - y.r)::BIGINT AS pr, abs(x.c - y.c)::BIGINT AS pc FROM b x JOIN b y ON y.data_index = x.data_index + 1), t AS (SELECT *, least(pr, 82 - pr) AS tr, least(pc, 137 - pc) AS tc FROM p)
            SELECT data_index, tr * tr + tc * tc AS toroid_squared, pr * pr + pc * pc AS plane_squared, tr + tc AS toroid_manhattan, pr + pc AS plane_manhattan, greatest(tr, tc) AS toroid_max, greatest(pr, pc) AS plane_max FROM t""",
        "radius_counts": f"WITH {_C} SELECT c.label, count(CASE WHEN list_distance(c.w, embeddings.embedding::DOUBLE[]) <= 0.95 THEN 1 END) AS n FROM c CROSS JOIN embeddings GROUP BY c.label",
        "descriptives": f"WITH {_T} SELECT d AS dimension, min(x) AS low, max(x) AS high, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stdev FROM u GROUP BY d",
        "covariance": pair("covar_samp", "covariance"),
        "correlation": pair("corr", "correlation"),
        "principal_plane": """WITH x AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM x)
            SELECT k::INT AS component, round((a + c) / 2 + (1 - 2 * k) * sqrt(pow((a - c) / 2, 2) + b * b), 9) AS variance FROM m CROSS JOIN range(0, 2) t(k)""",
        "eigen_sums": f"WITH {_T}, p AS (SELECT a.d AS i, b.d AS j, covar_samp(a.x, b.x) AS r FROM u a JOIN u b USING (data_index) GROUP BY ALL) SELECT round(sum(CASE WHEN i = j THEN r END), 6) AS total, round(sum(r * r), 6) AS squares, round(sum(CASE WHEN i = j THEN r END), 6) AS principal FROM p",
        "mahalanobis_plane": """WITH x AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT label, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM x GROUP BY label)
            SELECT vec_id, label, round(sqrt((c * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * c - b * b)), 6) AS distance FROM x JOIN m USING (label)""",
        "gemm": f"{_K} SELECT a.j AS i, b.j, round(sum(a.v * b.v), 2) AS v FROM c a JOIN c b USING (i) GROUP BY a.j, b.j",
        "gemv": f"{_K} SELECT i, round(2 * sum(v * j), 2) AS v FROM c GROUP BY i",
        "ger": f"{_K} SELECT i, j, round(v + 0.5 * i * j, 2) AS v FROM c",
        "trace": f"{_K} SELECT sum(v) AS trace FROM c WHERE i = j",
        "factories": "SELECT 6::BIGINT AS n_rows, 6::BIGINT AS n_cols, true AS is_square, kind = 'identity' AS is_diagonal, kind = 'identity' AS is_identity, kind <> 'vandermonde' AS is_symmetric, kind FROM (VALUES ('general'), ('hilbert'), ('vandermonde'), ('identity')) t(kind)",
        "hash_buckets": f"SELECT {_bits(_PICKS)} AS bucket, count(*) AS n FROM embeddings GROUP BY 1",
        "stratified_sizes": f"SELECT {_bits(_PICKS[:4])} AS bucket, CASE WHEN floor(count(*) * 0.25 + 0.5) = 0 THEN count(*) ELSE floor(count(*) * 0.25 + 0.5)::BIGINT END AS n FROM embeddings GROUP BY 1",
    }
    return {f"vectors_{n}": s for n, s in t.items()}
