"""Queries of the training-data operators on the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.session import cut, table

from .knn import nearest
from .markov import positioned, similarity_clusters
from .mixing import mix, rates, shares
from .packing import fill_report, kinds_of, pack, pack_check
from .pii import personal_spans, redact
from .tokens import token_sizes
from .topn import top_n

#: The BLAST fields besides the query.
BLAST = ["s_id", "pct_id", "aln_len", "mistmatches", "gap_open", "q_beg", "q_end", "s_beg", "s_end", "eval", "bit_score"]
#: The query is what stands before the first white space.
QUERY_NAME = r"^\S*"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 best hits of each query."""
    best = top_n(table(spark, sf_dir, "hits"), F.regexp_extract("q_id", QUERY_NAME, 0), "bit_score", "line_no", 3, distinct_on=BLAST)
    return best.select(F.col("group_key").alias("q_id"), F.col("item_id").alias("line_no"))


#: What makes points alike: distance of vectors, rows and columns on the toroid, and the toroid's size.
ALIKE = {"radius": 1.0, "window": 8, "rows": 82, "columns": 137}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs at most 0.03 apart of which one is among the 5 nearest of the other."""
    near = nearest(table(spark, sf_dir, "training_vectors"), "data_index", "v", 5, radius=0.03)
    pair = (F.least("data_index", "neighbour").alias("data_index_a"), F.greatest("data_index", "neighbour").alias("data_index_b"))
    return near.where(F.col("distance") <= 0.03).select(*pair).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors, at any distance, of every vector whose index is divisible by 50."""
    near = nearest(table(spark, sf_dir, "training_vectors"), "data_index", "v", 5, is_query=lambda i: i % 50 == 0)
    return near.withColumn("distance", F.round("distance", 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the clusters of at least 5 points, every two alike and none like a point outside."""
    members, _ = similarity_clusters(positioned(table(spark, sf_dir, "training_vectors"), table(spark, sf_dir, "bestmatches")), **ALIKE, close=False)
    return members.where("complete AND size >= 5").select(F.col("index").alias("data_index"), "cluster_first")


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size, its most typical members and whether its flow had settled."""
    _, clusters = similarity_clusters(positioned(table(spark, sf_dir, "training_vectors"), table(spark, sf_dir, "bestmatches")), **ALIKE)
    return clusters


#: Tighter positions: groups of p4_found fall apart into overlapping ones, linked by chains. Columns are pruned harder, since
#: every cell of the map is a node of its own here.
CLOSE = {**ALIKE, "window": 2, "prune": 0.0937}


def p4_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every point where best matches must be within 2 rows and columns, and its size."""
    members, _ = similarity_clusters(positioned(table(spark, sf_dir, "training_vectors"), table(spark, sf_dir, "bestmatches")), **CLOSE, close=False)
    return members.select(F.col("index").alias("data_index"), "cluster_first", "size", "settled")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of every kind."""
    sizes = cut(token_sizes(table(spark, sf_dir, "documents"), "text", ["doc_id"]))
    return pack(sizes, kinds_of(table(spark, sf_dir, "containers")))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each kind are filled."""
    return fill_report(p7_pack(spark, sf_dir), kinds_of(table(spark, sf_dir, "containers")))


#: Limits that bind: at most one text to 128 tokens of the capacity, and half of the attention cost of one text that fills it.
BOUNDED = {"max_texts": lambda cap: cap // 128, "max_attention": lambda cap: cap * cap / 2}


def _bounded(spark: SparkSession, sf_dir: str):
    sizes = cut(token_sizes(table(spark, sf_dir, "documents"), "text", ["doc_id"]))
    kinds = kinds_of(table(spark, sf_dir, "containers"))
    return pack(sizes, kinds, **BOUNDED), sizes, kinds


def p7_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers that are also limited in texts and attention cost."""
    return _bounded(spark, sf_dir)[0]


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each kind's containers, and how often a rule of the bounded packing is broken."""
    packed, sizes, kinds = _bounded(spark, sf_dir)
    return pack_check(cut(packed), sizes, kinds, **BOUNDED)


def _mixture(spark: SparkSession, sf_dir: str):
    sizes = cut(token_sizes(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"]))
    rated = rates(sizes, table(spark, sf_dir, "mix_targets"))
    return mix(sizes, rated), rated


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all sources, mixed to the target shares."""
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return shares(*_mixture(spark, sf_dir))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each target source, and how often a rule of the mixture is broken: more copies than allowed, a number of
    copies that isn't the rate rounded up or down, or a record left out though its source's rate is at least 1."""
    sizes = cut(token_sizes(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"]))
    rated = rates(sizes, table(spark, sf_dir, "mix_targets"))
    used = mix(sizes, rated).groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("copy_no").alias("last"))
    told = spark.createDataFrame([(s, m, r) for s, _, m, _, r in rated], "source string, most int, rate double")
    each = sizes.join(told, "source").join(used, ["doc_id", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    off = (F.col("n") != F.floor("rate")) & (F.col("n") != F.ceil("rate")) | (F.col("last") != F.col("n"))
    return each.groupBy("source").agg(F.count("*").alias("n_records"), F.count_if(F.col("n") > F.col("most")).alias("n_over"), F.count_if(off).alias("n_off"))


def _by_characters(spark: SparkSession, sf_dir: str):
    sizes = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.length("text").cast("long").alias("n_tokens"))
    rated = rates(sizes, table(spark, sf_dir, "mix_targets"))
    return mix(sizes, rated), rated


def p8_by_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture with sizes in characters instead of tokens."""
    return _by_characters(spark, sf_dir)[0].select("doc_id", "source", "copy_no", F.col("n_tokens").alias("n_chars"))


def p8_shares_by_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source, in characters."""
    told = shares(*_by_characters(spark, sf_dir))
    return told.select("source", "n_records", F.col("mixed_tokens").alias("mixed_chars"), "most_copies", *[F.round(c, 9).alias(c) for c in ("rate", "actual_share", "off_target")])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of personal information in the documents."""
    return personal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_names"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with typed placeholders in place of personal information."""
    return redact(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_names"))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, and how often a rule is broken: places that overlap or reach beyond their text, and texts whose length after
    the replacement isn't that before it, less the places, plus their placeholders."""
    documents = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    spans = cut(p9_found(spark, sf_dir))
    size = documents.select("doc_id", F.length("text").alias("size"))
    before = F.lag("span_end").over(Window.partitionBy("doc_id").orderBy("span_beg"))
    wrong = spans.join(size, "doc_id").select(((F.col("span_beg") < F.coalesce(before, F.lit(0))) | (F.col("span_end") <= F.col("span_beg")) | (F.col("span_end") > F.col("size"))).alias("bad"))
    change = spans.groupBy("doc_id").agg(F.sum(F.length("pii_kind") + 2 - F.col("span_end") + F.col("span_beg")).alias("change"))
    after = p9_redacted(spark, sf_dir).select("doc_id", F.length("clean_text").alias("after")).join(size, "doc_id").join(change, "doc_id", "left")
    kept = after.agg(F.count("*").alias("n_texts"), F.count_if(F.col("after") != F.col("size") + F.coalesce("change", F.lit(0))).alias("n_off"))
    return kept.crossJoin(F.broadcast(wrong.agg(F.count_if("bad").alias("n_wrong"))))  # one row each


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p4_clusters": p4_clusters, "p4_close": p4_close,
        "p7_pack": p7_pack, "p7_fill": p7_fill, "p7_bounded": p7_bounded, "p7_checks": p7_checks,
        "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_checks": p8_checks, "p8_by_characters": p8_by_characters, "p8_shares_by_characters": p8_shares_by_characters,
        "p9_found": p9_found, "p9_redacted": p9_redacted, "p9_checks": p9_checks,
    }


_VECTORS = "t AS (SELECT data_index, min(v) AS v FROM training_vectors WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY data_index)"


_POINTS = f"""{_VECTORS}, p AS (SELECT data_index, min({{'r': bm_row, 'c': bm_col}}) AS p FROM bestmatches WHERE bm_row IS NOT NULL AND bm_col IS NOT NULL GROUP BY data_index),
            u AS (SELECT t.data_index AS i, v, p.p.r AS r, p.p.c AS c FROM t JOIN p USING (data_index))"""


def _alike(window: int) -> str:
    return f"list_distance(a.v, b.v) <= 1.0 AND least(abs(a.r - b.r), 82 - abs(a.r - b.r)) <= {window} AND least(abs(a.c - b.c), 137 - abs(a.c - b.c)) <= {window}"


def _markov(window: int, prune: float = 0.001, rounds: int = 24) -> str:
    """Markov clustering record by record, as so many rounds of a recursion; ``named`` has each record's cluster."""
    return f"""
            WITH RECURSIVE {_POINTS}, link AS (SELECT a.i AS a, b.i AS b, list_distance(a.v, b.v) AS d FROM u a JOIN u b ON {_alike(window)}),
            flow(k, r, c, m) AS (
                SELECT 0, b, a, 1.0::DOUBLE / count(*) OVER (PARTITION BY a) FROM link
                UNION ALL
                SELECT k + 1, r, c, round(m / sum(m) OVER (PARTITION BY k, c), 12) FROM (
                    SELECT *, max(m) OVER (PARTITION BY k, c) AS top FROM (
                        SELECT x.k AS k, x.r AS r, y.c AS c, pow(sum(x.m * y.m), 2) AS m FROM flow x JOIN flow y ON x.c = y.r WHERE x.k < {rounds} GROUP BY x.k, x.r, y.c))
                WHERE m >= top * {prune}),
            last AS (SELECT r, c, m FROM flow WHERE k = {rounds} AND m > 0),
            kept AS (SELECT r, c, round(m / max(m) OVER (PARTITION BY c), 6) AS share FROM last WHERE r IN (SELECT r FROM last WHERE r = c)),
            best AS (SELECT c, r FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY share DESC, r) AS n FROM kept) WHERE n = 1),
            grp AS (SELECT best.c AS i, min(kept.r) AS g FROM best JOIN kept ON kept.c = best.r WHERE kept.r IN (SELECT r FROM last WHERE r = c) GROUP BY best.c),
            named AS (SELECT i, min(i) OVER (PARTITION BY g) AS cluster_first, count(*) OVER (PARTITION BY g) AS size FROM grp)"""


_MIX = """
            WITH s AS (SELECT doc_id, source, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL),
            goal AS (SELECT source, max(target_share) AS w, max(max_repeats) AS m FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0 GROUP BY source),
            r AS (SELECT source, w / (SELECT sum(w) FROM goal) AS w, m, coalesce(t, 0) AS t FROM goal LEFT JOIN (SELECT source, sum(n)::DOUBLE AS t FROM s GROUP BY source) USING (source)),
            rate AS (SELECT source, w, CASE WHEN t > 0 THEN least(m, w * (SELECT min(m * t / w) FROM r WHERE t > 0) / t) ELSE 0 END AS rate FROM r),
            drawn AS (SELECT doc_id, source, n, (floor(rate) + CASE WHEN ('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT / pow(2, 52) < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies
                      FROM s JOIN rate USING (source) WHERE doc_id IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
            WITH once AS (
                SELECT regexp_extract(q_id, '^\\S*') AS q, min(line_no) AS line_no, {", ".join(BLAST)} FROM hits
                WHERE q_id IS NOT NULL AND bit_score IS NOT NULL AND NOT isnan(bit_score) GROUP BY ALL
            ), ranked AS (SELECT q, line_no, row_number() OVER (PARTITION BY q ORDER BY bit_score DESC, line_no) AS r FROM once)
            SELECT q AS q_id, line_no FROM ranked WHERE r <= 3""",
        "p3_found": f"""
            WITH {_VECTORS}, near AS (
                SELECT a.data_index AS a, b.data_index AS b, list_distance(a.v, b.v) AS d FROM t a JOIN t b ON a.data_index <> b.data_index AND list_distance(a.v, b.v) <= 0.03
            ), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM near)
            SELECT DISTINCT least(a, b) AS data_index_a, greatest(a, b) AS data_index_b FROM r WHERE k <= 5""",
        "p4_found": f"""
            WITH {_POINTS}, n AS (SELECT a.i, list_sort(list(b.i)) AS around FROM u a JOIN u b ON {_alike(8)} GROUP BY a.i),
            whole AS (SELECT around FROM n GROUP BY around HAVING count(*) = len(around) AND count(*) >= 5)
            SELECT i AS data_index, around[1] AS cluster_first FROM n JOIN whole USING (around)""",
        "p4_close": f"""{_markov(2, 0.0937)}
            SELECT i AS data_index, cluster_first, size, true AS settled FROM named""",
        "p4_clusters": f"""{_markov(8)},
            told AS (SELECT n.*, sum(1.0 - d) AS close, count(*) AS fellows, round(any_value(got), 9) AS got FROM named n JOIN link ON link.a = n.i JOIN (SELECT r, sum(m) AS got FROM last GROUP BY r) f ON f.r = n.i GROUP BY ALL)
            SELECT cluster_first, size, min(fellows) = size AND max(fellows) = size AS complete, true AS settled, list(i ORDER BY got DESC, round(close, 6) DESC, i)[1:3] AS typical FROM told GROUP BY cluster_first, size""",
        "p3_neighbours": f"""
            WITH {_VECTORS}, near AS (SELECT a.data_index, b.data_index AS neighbour, list_distance(a.v, b.v) AS d FROM t a JOIN t b ON a.data_index <> b.data_index AND a.data_index % 50 = 0),
            ranked AS (SELECT *, (row_number() OVER (PARTITION BY data_index ORDER BY d, neighbour))::INT AS neighbour_rank FROM near)
            SELECT data_index, neighbour, round(d, 6) AS distance, neighbour_rank FROM ranked WHERE neighbour_rank <= 5""",
        "p7_checks": """
            SELECT container_kind, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_texts, 0 AS n_torn, 0 AS n_over, 0 AS n_gaps
            FROM containers WHERE container_kind IS NOT NULL AND capacity_tokens > 0 GROUP BY container_kind""",
        "p8_checks": "SELECT source, count(*) AS n_records, 0 AS n_over, 0 AS n_off FROM documents JOIN (SELECT DISTINCT source FROM mix_targets WHERE target_share > 0 AND max_repeats > 0) USING (source) WHERE text IS NOT NULL GROUP BY source",
        "p9_checks": "SELECT count(*) AS n_texts, 0 AS n_off, 0 AS n_wrong FROM documents WHERE text IS NOT NULL",
        "p8_by_characters": _MIX + " SELECT doc_id, source, unnest(range(1, copies + 1))::INT AS copy_no, n AS n_chars FROM drawn",
        "p8_shares_by_characters": _MIX + """
            , told AS (SELECT source, sum(copies)::BIGINT AS n_records, sum(copies * n)::BIGINT AS mixed_chars, max(copies) AS most_copies FROM drawn WHERE copies > 0 GROUP BY source)
            SELECT source, coalesce(n_records, 0) AS n_records, coalesce(mixed_chars, 0) AS mixed_chars, coalesce(most_copies, 0) AS most_copies, round(rate, 9) AS rate,
              round(coalesce(mixed_chars, 0)::DOUBLE / (SELECT sum(mixed_chars) FROM told), 9) AS actual_share, round(coalesce(mixed_chars, 0)::DOUBLE / (SELECT sum(mixed_chars) FROM told) - w, 9) AS off_target
            FROM rate LEFT JOIN told USING (source)""",
    }
