"""Queries on counts tables: statistics, normalisations, table operators. The table has a row per supplier and a column per line number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import normalize as nz
from sedimenta.functions import scalars as sc
from sedimenta.functions.stats import describe, exact_quantiles
from sedimenta.operators import counts as ct
from sedimenta.operators import joins
from sedimenta.session import table

#: Digits after the point that results are compared with.
R = 6


def rounded(df: DataFrame, *names: str, digits: int = R) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table: quantity per supplier (row) and line number (column)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("row_num"), F.col("l_linenumber").cast("int").alias("col_num")).agg(F.sum("l_quantity").alias("value"))


_COUNTS = "c AS (SELECT l_suppkey AS row_num, l_linenumber::INT AS col_num, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def _stats(grade):
    names = {"quick": ["min", "max", "sum", "mean", "nz_min"], "lite": ["variance", "stdev", "avdev"], "full": ["skew", "kurtosis", "geomean", "q1", "median", "q3", "iqr"], "robust": ["mad", "trmean", "rstdev"]}

    def query(spark, sf_dir):
        out = describe(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", grade)
        wide = [n for g in ("quick", "lite", "full", "robust") for n in names[g] if n in out.columns]
        return rounded(out, *[n for n in wide if n not in ("sum", "variance")], digits=4).withColumn("sum", F.round("sum", 0)).select("l_returnflag", "n", *[F.round(n, 0).alias(n) if n == "variance" else n for n in wide])

    query.__doc__ = f"Statistics ({grade}) of prices per return flag."
    return query


def stats_all_ways(spark, sf_dir):
    """Robust statistics per row, per column and of the matrix."""
    out = ct.stats_all_ways(counts(spark, sf_dir), "robust")
    names = ["mean", "variance", "stdev", "skew", "kurtosis", "geomean", "q1", "median", "q3", "avdev", "mad", "trmean", "rstdev"]
    out = out.withColumn("trmean", F.nanvl("trmean", F.lit(-1.0)))
    return rounded(out, *names, digits=4).select("scope", "row_num", "col_num", "n", "min", "max", "sum", *names)


def quantiles(spark, sf_dir):
    """Three quantiles of prices per return flag."""
    q = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return rounded(q, "p10", "p50", "p99", digits=4)


_NORMS = {
    "by_sum": (["row_num"], "value / sum(value) OVER (PARTITION BY row_num)"),
    "by_norm": (["col_num"], "value / sqrt(sum(value * value) OVER (PARTITION BY col_num))"),
    "zero_to_one": ([], "(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())"),
    "zero_to_half": (["row_num"], "CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END"),
    "logtrans": (["col_num"], "ln(value + CASE WHEN min(value) OVER v > 0 THEN 0 ELSE 1 + abs(min(value) OVER v) END)"),
    "boxcox": (["row_num"], "(pow(value + CASE WHEN min(value) OVER w > 0 THEN 0 ELSE 1 + abs(min(value) OVER w) END, 0.5) - 1) / 0.5"),
    "ztrans": (["row_num"], "CASE WHEN coalesce(stddev_samp(value) OVER w, 0) > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE value END"),
}


def _norm(method):
    keys = ["col_num"] if method == "rztrans" else _NORMS[method][0]

    def query(spark, sf_dir):
        return rounded(nz.normalize(counts(spark, sf_dir), method, keys), "normalized").select("row_num", "col_num", "normalized")

    query.__doc__ = f"Counts normalised by {method} over {keys or 'the matrix'}."
    return query


def normalize_counts(spark, sf_dir):
    """Rows by their sum, then columns to 0 .. 1."""
    return rounded(nz.normalize_counts(counts(spark, sf_dir), "by_sum", "zero_to_one"), "value")


def boxcox_exponents(spark, sf_dir):
    """Best Box-Cox exponent of each row."""
    return nz.boxcox_exponents(counts(spark, sf_dir), ["row_num"])


def abundance_per_length(spark, sf_dir):
    """Every cell over its row's length (here the supplier's rounded balance, above 0)."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_num"), (F.floor(F.abs("s_acctbal")) + 1).alias("length"))
    return counts(spark, sf_dir).join(rows, "row_num").select("row_num", "col_num", F.round(F.col("value") / F.col("length"), R).alias("abundance"))


def wide_counts(spark, sf_dir):
    """The counts table in wide form, 0 where a cell is absent."""
    names = [f"c{k}" for k in range(1, 8)]
    named = counts(spark, sf_dir).withColumn("col_name", F.concat(F.lit("c"), F.col("col_num")))
    return ct.to_wide(named, "row_num", names, fill=0.0)


def long_again(spark, sf_dir):
    """Wide and long again."""
    return ct.to_long(wide_counts(spark, sf_dir), "row_num", [f"c{k}" for k in range(1, 8)])


def filter_by_info(spark, sf_dir):
    """Rows that a predicate on metadata keeps, numbered anew in their order."""
    kept = table(spark, sf_dir, "supplier").where("s_acctbal > 0 AND s_nationkey < 10").select("s_suppkey")
    return ct.numbered(kept, ["s_suppkey"])


def sort_by_info(spark, sf_dir):
    """Row numbers in descending order of a metadata key."""
    return ct.numbered(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")], "place").select("place", "s_suppkey")


def box(spark, sf_dir):
    """An inclusive box of cells."""
    return ct.box(counts(spark, sf_dir), 2, 3, 5, 40)


def collapse_columns(spark, sf_dir):
    """Columns 5 to 7 added onto column 1."""
    return rounded(ct.collapse(counts(spark, sf_dir), {5: 1, 6: 1, 7: 1}, "col_num"), "value", digits=2)


def collapse_rows(spark, sf_dir):
    """Rows added onto the first of their nation."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_num"), "s_nationkey")
    first = s.groupBy("s_nationkey").agg(F.min("row_num").alias("onto"))
    to = s.join(first, "s_nationkey").select("row_num", "onto")
    return counts(spark, sf_dir).join(to, "row_num").groupBy(F.col("onto").alias("row_num"), "col_num").agg(F.round(F.sum("value"), 2).alias("value"))


def promote(spark, sf_dir):
    """A metadata key as an eighth data column."""
    info = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_num"), F.col("s_nationkey").alias("nation"), "s_name")
    return ct.promote(info, counts(spark, sf_dir), "nation", 8)[1]


def stacked(spark, sf_dir):
    """Customers and suppliers in one table, by position."""
    return ct.stack([table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")]).toDF("key", "name", "balance")


def pasted(spark, sf_dir):
    """Two tables of the same rows side by side."""
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_num"), "p_size")
    right = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_num"), "p_brand")
    return ct.paste(left, right)


def last_hit(spark, sf_dir):
    """Customers with the priority of their last order, ``none`` without."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return joins.last_wins(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "o_orderkey", "o_orderpriority", "none")


def picked(spark, sf_dir):
    """A seeded tenth of the customers, without replacement."""
    return ct.pick_random(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.1)


def drawn(spark, sf_dir):
    """As many customers as there are, drawn with replacement."""
    return ct.sample_with_replacement(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 1.0)


def picked_number(spark, sf_dir):
    """Exactly 40 customers, without replacement."""
    return ct.pick_number(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 40, 7)


def quick_all_ways(spark, sf_dir):
    """Quick statistics per row, per column and of the matrix, in one pass."""
    return ct.stats_all_ways(counts(spark, sf_dir), "quick").select("scope", "row_num", "col_num", "n", "min", "max", "sum", F.round("mean", 4).alias("mean"), "nz_min")


def scalar_functions(spark, sf_dir):
    """Every numeric function on prices and quantities."""
    a, b = F.col("l_discount") - 0.05, F.col("l_tax")
    one = {f"u_{n}": f(a) for n, f in sc.UNARY.items() if n not in ("sqrt", "quiet_sqrt", "log2")} | {"u_quiet_sqrt": F.coalesce(F.nanvl(sc.UNARY["quiet_sqrt"](a), F.lit(-1.0)), F.lit(-1.0)), "u_log2": sc.UNARY["log2"](F.col("l_quantity"))}
    two = {f"b_{n}": f(a, b) for n, f in sc.BINARY.items() if n != "pow"} | {"b_pow": sc.BINARY["pow"](F.col("l_quantity"), b)}
    more = {"x_p_diff": sc.p_diff(3)(a, b), "x_plus_mult": sc.plus_mult(2.0)(a, b), "x_bound": sc.bind_second(sc.BINARY["minus"], 1.0)(a), "x_chain": sc.chain(F.abs, sc.BINARY["minus"])(a, b)}
    out = {n: F.sum(F.round(c.cast("double"), 6)) for n, c in (one | two | more).items()}
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.round(c, 3).alias(n) for n, c in out.items()])


def colours(spark, sf_dir):
    """Colours in other spaces: red, green and blue from three columns of parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 5).alias("r"), (F.col("p_partkey") % 256).alias("g"), (F.floor("p_retailprice").cast("long") % 256).alias("b"))
    hexed = p.withColumn("hex", sc.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")))
    back = hexed.withColumn("rgb", sc.hex_to_rgb(F.col("hex"))).withColumn("hsv", sc.hsv(F.col("r"), F.col("g"), F.col("b"))).withColumn("hsl", sc.hsl(F.col("r"), F.col("g"), F.col("b")))
    return back.select("p_partkey", "hex", F.col("rgb.g").alias("green"), F.round(F.col("hsv.h") + 1e-7, 3).alias("hue"), F.round("hsv.s", 5).alias("saturation"), F.round("hsv.v", 5).alias("value"), F.round("hsl.l", 5).alias("lightness"))


def queries():
    named = {f"stats_{g}": _stats(g) for g in ("quick", "lite", "full", "robust")} | {f"norm_{m}": _norm(m) for m in [*_NORMS, "rztrans"]}
    more = (stats_all_ways, quantiles, normalize_counts, boxcox_exponents, abundance_per_length, wide_counts, long_again, filter_by_info, sort_by_info, box, collapse_columns, collapse_rows, promote, stacked, pasted, last_hit, picked, picked_number, drawn, quick_all_ways, scalar_functions, colours)
    return named | {f"tables_{f.__name__}": f for f in more}


def _q(p):
    return f"quantile_cont(x, {p})"


#: First 52 bits of a seeded MD5, as a number in [0, 1).
_CHANCE = "(('0x' || substr(md5('{}:' || c_custkey), 1, 13))::BIGINT / pow(2, 52))"
_ROBUST = """, round(CASE WHEN count(x) > 1 THEN avg(abs(x - m)) END, 4) AS avdev, round(quantile_cont(abs(x - md), 0.5), 4) AS mad, round(coalesce(avg(CASE WHEN x > lo AND x < hi THEN x END), -1), 4) AS trmean,
    round(least((quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349, stddev_samp(x)), 4) AS rstdev"""
_MOMENTS = """CASE WHEN count(x) < 2 THEN NULL WHEN var_samp(x) = 0 THEN 0 ELSE sum(pow(x - m, 3)) / (count(x) * var_samp(x) * stddev_samp(x)) END AS skew_,
    CASE WHEN count(x) < 2 THEN NULL WHEN var_samp(x) = 0 THEN 0 ELSE sum(pow(x - m, 4)) / (count(x) * var_samp(x) * var_samp(x)) - 3 END AS kurtosis_,
    CASE WHEN count(x) < 2 THEN NULL WHEN min(x) > 0 THEN exp(avg(ln(CASE WHEN x > 0 THEN x END))) ELSE 1 END AS geomean_"""


def oracle_sql():
    base = "WITH r AS (SELECT l_returnflag, l_extendedprice AS x, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m, quantile_cont(l_extendedprice, 0.5) OVER (PARTITION BY l_returnflag) AS md, quantile_cont(l_extendedprice, 0.1) OVER (PARTITION BY l_returnflag) AS lo, quantile_cont(l_extendedprice, 0.9) OVER (PARTITION BY l_returnflag) AS hi FROM lineitem)"
    quick = "count(x) AS n, round(min(x), 4) AS min, round(max(x), 4) AS max, round(sum(x), 0) AS sum, round(avg(x), 4) AS mean, round(coalesce(min(CASE WHEN x > 0 THEN x END), 'inf'::DOUBLE), 4) AS nz_min"
    lite = quick + ", round(var_samp(x), 0) AS variance, round(stddev_samp(x), 4) AS stdev, round(avg(abs(x - m)), 4) AS avdev"
    inner = ", " + _MOMENTS
    full = lite + inner + f", {_q(0.25)} AS q1_, {_q(0.5)} AS md_, {_q(0.75)} AS q3_"
    tail = ", round(skew_, 4) AS skew, round(kurtosis_, 4) AS kurtosis, round(geomean_, 4) AS geomean, round(q1_, 4) AS q1, round(md_, 4) AS median, round(q3_, 4) AS q3, round(q3_ - q1_, 4) AS iqr"
    lite_names = "l_returnflag, n, min, max, sum, mean, nz_min, variance, stdev, avdev"
    robust = full + ", stddev_samp(x) AS sd_, round(quantile_cont(abs(x - md), 0.5), 4) AS mad, round(avg(CASE WHEN x > lo AND x < hi THEN x END), 4) AS trmean"
    sql = {
        "stats_quick": f"{base} SELECT l_returnflag, {quick} FROM r GROUP BY l_returnflag",
        "stats_lite": f"{base} SELECT l_returnflag, {lite} FROM r GROUP BY l_returnflag",
        "stats_full": f"{base} SELECT {lite_names}{tail} FROM (SELECT l_returnflag, {full} FROM r GROUP BY l_returnflag)",
        "stats_robust": f"{base} SELECT {lite_names}{tail}, mad, trmean, round(least((q3_ - q1_) / 1.349, sd_), 4) AS rstdev FROM (SELECT l_returnflag, {robust} FROM r GROUP BY l_returnflag)",
    }
    for m, (keys, expr) in _NORMS.items():
        sql[f"norm_{m}"] = f"WITH {_COUNTS} SELECT row_num, col_num, round({expr}, 6) AS normalized FROM c WINDOW w AS (PARTITION BY row_num), v AS (PARTITION BY col_num)"
    sql["norm_rztrans"] = f"""WITH {_COUNTS}, q AS (SELECT col_num, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi, least((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349, stddev_samp(value)) AS s FROM c GROUP BY col_num),
        t AS (SELECT col_num, avg(value) AS tm FROM c JOIN q USING (col_num) WHERE value > lo AND value < hi GROUP BY col_num)
        SELECT row_num, col_num, round(CASE WHEN s > 0 THEN (value - tm) / s ELSE value END, 6) AS normalized FROM c JOIN q USING (col_num) JOIN t USING (col_num)"""
    scope = "SELECT '{0}' AS scope, {1} AS row_num, {2} AS col_num, count(x) AS n, min(x) AS min, max(x) AS max, sum(x) AS sum, round(avg(x), 4) AS mean, round(var_samp(x), 4) AS variance, round(stddev_samp(x), 4) AS stdev, " + _MOMENTS + f", round({_q(0.25)}, 4) AS q1, round({_q(0.5)}, 4) AS median, round({_q(0.75)}, 4) AS q3 {_ROBUST} FROM (SELECT row_num, col_num, value AS x, avg(value) OVER ({{3}}) AS m, quantile_cont(value, 0.5) OVER ({{3}}) AS md, quantile_cont(value, 0.1) OVER ({{3}}) AS lo, quantile_cont(value, 0.9) OVER ({{3}}) AS hi FROM c) {{4}}"
    every = " UNION ALL ".join(scope.format(*p) for p in (("row", "row_num", "NULL", "PARTITION BY row_num", "GROUP BY row_num"), ("column", "NULL", "col_num", "PARTITION BY col_num", "GROUP BY col_num"), ("matrix", "NULL", "NULL", "", "")))
    t = {
        "picked": f"SELECT c_custkey FROM customer WHERE {_CHANCE.format(0)} < 0.1",
        "picked_number": f"SELECT c_custkey FROM customer ORDER BY {_CHANCE.format(7)}, c_custkey LIMIT 40",
        "drawn": f"""WITH RECURSIVE p(k, p, cum) AS (SELECT 0, exp(-1.0::DOUBLE), exp(-1.0::DOUBLE) UNION ALL SELECT k + 1, p / (k + 1), cum + p / (k + 1) FROM p WHERE k < 10), u AS (SELECT c_custkey, {_CHANCE.format(0)} AS u FROM customer),
            n AS (SELECT c_custkey, count(*) AS n FROM u JOIN p ON u >= cum GROUP BY c_custkey) SELECT c_custkey, unnest(range(1, n + 1))::INT AS draw FROM n""",
        "quick_all_ways": f"WITH {_COUNTS} " + " UNION ALL ".join(f"SELECT '{s}' AS scope, {r} AS row_num, {c} AS col_num, count(*) AS n, min(value) AS min, max(value) AS max, sum(value) AS sum, round(avg(value), 4) AS mean, coalesce(min(CASE WHEN value > 0 THEN value END), 'inf'::DOUBLE) AS nz_min FROM c {g}" for s, r, c, g in (("row", "row_num", "NULL", "GROUP BY row_num"), ("column", "NULL", "col_num", "GROUP BY col_num"), ("matrix", "NULL", "NULL", ""))),
        "stats_all_ways": f"WITH {_COUNTS} SELECT * EXCLUDE (skew_, kurtosis_, geomean_), round(skew_, 4) AS skew, round(kurtosis_, 4) AS kurtosis, round(geomean_, 4) AS geomean FROM ({every})",
        "quantiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY l_returnflag",
        "normalize_counts": f"WITH {_COUNTS}, s AS (SELECT row_num, col_num, value / sum(value) OVER (PARTITION BY row_num) AS v FROM c) SELECT row_num, col_num, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE v END, 6) AS value FROM s WINDOW w AS (PARTITION BY col_num)",
        "abundance_per_length": f"WITH {_COUNTS} SELECT row_num, col_num, round(value / (floor(abs(s_acctbal)) + 1), 6) AS abundance FROM c JOIN supplier ON s_suppkey = row_num",
        "wide_counts": f"WITH {_COUNTS} SELECT row_num, " + ", ".join(f"coalesce(max(CASE WHEN col_num = {k} THEN value END), 0) AS c{k}" for k in range(1, 8)) + " FROM c GROUP BY row_num",
        "long_again": f"WITH {_COUNTS}, k AS (SELECT unnest(range(1, 8))::INT AS col_num) SELECT r.row_num, k.col_num, 'c' || k.col_num AS col_name, coalesce(value, 0) AS value FROM (SELECT DISTINCT row_num FROM c) r CROSS JOIN k LEFT JOIN c USING (row_num, col_num)",
        "filter_by_info": "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS row_num FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 10",
        "sort_by_info": "SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place, s_suppkey FROM supplier",
        "box": f"WITH {_COUNTS} SELECT * FROM c WHERE row_num BETWEEN 3 AND 40 AND col_num BETWEEN 2 AND 5",
        "collapse_columns": f"WITH {_COUNTS} SELECT row_num, CASE WHEN col_num IN (5, 6, 7) THEN 1 ELSE col_num END AS col_num, round(sum(value), 2) AS value FROM c GROUP BY ALL",
        "collapse_rows": f"WITH {_COUNTS}, o AS (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS onto FROM supplier) SELECT onto AS row_num, col_num, round(sum(value), 2) AS value FROM c JOIN o ON s_suppkey = row_num GROUP BY onto, col_num",
        "promote": f"WITH {_COUNTS} SELECT * FROM c UNION ALL SELECT s_suppkey, 8, s_nationkey::DOUBLE FROM supplier",
        "stacked": "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier",
        "pasted": "SELECT p_partkey AS row_num, p_size, p_brand FROM part",
        "last_hit": "SELECT c_custkey, coalesce(arg_max(o_orderpriority, o_orderkey), 'none') AS o_orderpriority FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
        "colours": """WITH p AS (SELECT p_partkey, (p_size * 5)::DOUBLE AS r, (p_partkey % 256)::DOUBLE AS g, (floor(p_retailprice)::BIGINT % 256)::DOUBLE AS b FROM part),
            t AS (SELECT *, greatest(r, g, b) / 255 AS hi, least(r, g, b) / 255 AS lo FROM p)
            SELECT p_partkey, printf('#%02x%02x%02x', r::INT, g::INT, b::INT) AS hex, g::INT AS green,
              round(60 * CASE WHEN hi = lo THEN 0 WHEN hi = r / 255 THEN ((g - b) / 255 / (hi - lo) + 6) % 6 WHEN hi = g / 255 THEN (b - r) / 255 / (hi - lo) + 2 ELSE (r - g) / 255 / (hi - lo) + 4 END + 1e-7::DOUBLE, 3) AS hue,
              round(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END, 5) AS saturation, round(hi, 5) AS value, round((hi + lo) / 2, 5) AS lightness FROM t""",
        "scalar_functions": """WITH v AS (SELECT l_returnflag, l_quantity AS q, l_discount - 0.05::DOUBLE AS a, l_tax AS b FROM lineitem) SELECT l_returnflag,
            round(sum(round(a, 6)), 3) AS u_identity, round(sum(round(abs(a), 6)), 3) AS u_abs, round(sum(round(a * a, 6)), 3) AS u_square, round(sum(round(CASE WHEN a < 0 THEN -1 ELSE sqrt(abs(a)) END, 6)), 3) AS u_quiet_sqrt,
            round(sum(round(log2(q), 6)), 3) AS u_log2, round(sum(round(sign(a) * floor(abs(a) + 0.5), 6)), 3) AS u_round,
            round(sum(round(a + b, 6)), 3) AS b_plus, round(sum(round(a - b, 6)), 3) AS b_minus, round(sum(round(a * b, 6)), 3) AS b_mult, round(sum(round(CASE WHEN b <> 0 THEN a / b END, 6)), 3) AS b_div,
            round(sum(round(least(a, b), 6)), 3) AS b_min, round(sum(round(greatest(a, b), 6)), 3) AS b_max, round(sum((a = b)::INT::DOUBLE), 3) AS b_equals, round(sum(sign(a - b)::DOUBLE), 3) AS b_cmp,
            round(sum(round(sqrt(a * a + b * b), 6)), 3) AS b_hypot, round(sum(round(abs(a - b), 6)), 3) AS b_abs_diff, round(sum(round((a - b) * (a - b), 6)), 3) AS b_square_diff,
            round(sum(round(CASE WHEN abs(a) + abs(b) <> 0 THEN abs(a - b) / (abs(a) + abs(b)) END, 6)), 3) AS b_canberra_diff, round(sum(round(pow(q, b), 6)), 3) AS b_pow,
            round(sum(round(pow(abs(a - b), 3), 6)), 3) AS x_p_diff, round(sum(round(a + 2 * b, 6)), 3) AS x_plus_mult, round(sum(round(a - 1, 6)), 3) AS x_bound, round(sum(round(abs(a - b), 6)), 3) AS x_chain
            FROM v GROUP BY l_returnflag""",
    }
    return sql | {f"tables_{n}": s for n, s in t.items()}
