"""Queries of the operators that take raw tables apart: rejected lines, packed fields, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.intervals import periods_and_gaps
from sedimenta.operators.packed_fields import split_packed
from sedimenta.operators.rejects import load_counts, rejected_lines
from sedimenta.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body lines of the raw counts tables that fail."""
    return rejected_lines(table(spark, sf_dir, "counts_raw"), conflicts=False).select("file_id", "line_no")


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing lines per reason."""
    bad = rejected_lines(table(spark, sf_dir, "counts_raw"))
    return bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_lines"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows: key, number of data cells that hold a value, and their sum."""
    clean, _ = load_counts(table(spark, sf_dir, "counts_raw"))
    values = F.array_compact(F.map_values("data"))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return clean.select("file_id", "line_no", "key", F.size(values).alias("n_values"), F.round(total, 4).alias("total"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packed attribute of each feature."""
    return split_packed(table(spark, sf_dir, "gff").select("feature_no", "attributes"), "attributes", ["feature_no"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods and gaps of features per sequence and of hits per query."""
    gff = table(spark, sf_dir, "gff").select(F.lit("gff").alias("origin"), F.col("seqid").alias("entity"), F.col("gff_start").alias("beg"), F.col("gff_end").alias("end"))
    hits = table(spark, sf_dir, "hits").select(F.lit("hits").alias("origin"), F.regexp_extract("q_id", r"^\S*", 0).alias("entity"), F.col("q_beg").cast("long").alias("beg"), F.col("q_end").cast("long").alias("end"))
    return periods_and_gaps(gff.unionByName(hits))


def queries():
    return {"p2_found": p2_found, "p2_reasons": p2_reasons, "p2_clean": p2_clean, "p5_found": p5_found, "p6_found": p6_found}


_P2 = r"""
    WITH raw AS (SELECT file_id, line_no, regexp_replace(min(line), '[\r\n]+$', '') AS line FROM counts_raw
                 WHERE file_id IS NOT NULL AND line_no IS NOT NULL AND line IS NOT NULL GROUP BY file_id, line_no),
    torn AS (SELECT file_id, line_no FROM counts_raw WHERE line IS NOT NULL GROUP BY file_id, line_no HAVING count(DISTINCT regexp_replace(line, '[\r\n]+$', '')) > 1),
    sign AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS k FROM raw WHERE line LIKE '\%%' ESCAPE '\'),
    rules AS (SELECT file_id,
                string_split(max(CASE WHEN k = 3 THEN regexp_replace(line, '^%[ \t]?', '') END), chr(9)) AS types,
                list_transform(string_split(max(CASE WHEN k = 4 THEN regexp_replace(line, '^%[ \t]?', '') END), chr(9)), lambda x: lower(trim(x))) AS names
              FROM sign GROUP BY file_id),
    body AS (SELECT r.*, types, names,
               regexp_full_match(line, '(\s*"([^"]|"")*"[^\S\t]*|[^\t"]*)(\t([^\S\t]*"([^"]|"")*"[^\S\t]*|[^\t"]*))*') AS well,
               regexp_extract_all(line || chr(9), '([^\S\t]*"(?:[^"]|"")*"[^\S\t]*|[^\t"]*)\t', 1) AS cells
             FROM raw r LEFT JOIN rules USING (file_id) WHERE line NOT LIKE '#%' AND line NOT LIKE '\%%' ESCAPE '\' AND regexp_matches(line, '\S')),
    cell AS (SELECT file_id, line_no, trim(types[i]) AS role, names[i] AS name,
               trim(CASE WHEN trim(cells[i]) LIKE '"%' THEN replace(regexp_replace(trim(cells[i]), '^"|"$', '', 'g'), '""', '"') ELSE cells[i] END) AS v
             FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM body WHERE well AND len(cells) = len(types))),
    judged AS (
        SELECT file_id, line_no, CASE WHEN types IS NULL THEN 'no_header' WHEN NOT well THEN 'bad_quoting' ELSE 'field_count' END AS reason
          FROM body WHERE types IS NULL OR NOT well OR len(cells) <> len(types)
        UNION SELECT file_id, line_no, 'bad_number' FROM cell WHERE role = '1' AND v <> '' AND NOT regexp_full_match(v, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')
        UNION SELECT file_id, line_no, 'bad_key' FROM cell WHERE role = '9' AND NOT regexp_full_match(v, '[0-9]+')
        UNION SELECT file_id, line_no, 'stray_header' FROM sign WHERE k > 4
        UNION SELECT file_id, line_no, 'conflicting_texts' FROM torn JOIN body USING (file_id, line_no)
        UNION SELECT file_id, line_no, 'bad_length' FROM cell WHERE role = '0' AND name = 'length' AND v <> '' AND NOT regexp_full_match(v, '\+?0*[1-9][0-9]*'))
"""


def oracle_sql():
    return {
        "p2_found": _P2 + "SELECT DISTINCT file_id, line_no FROM judged",
        "p2_reasons": _P2 + "SELECT reason, count(*) AS n_lines FROM judged GROUP BY reason",
        "p2_clean": _P2 + """
            SELECT file_id, line_no, max(CASE WHEN role = '9' THEN v END)::BIGINT AS key,
              count(CASE WHEN role = '1' AND v <> '' THEN 1 END)::INT AS n_values,
              round(coalesce(sum(CASE WHEN role = '1' AND v <> '' THEN v::DOUBLE END), 0), 4) AS total
            FROM cell WHERE (file_id, line_no) NOT IN (SELECT (file_id, line_no) FROM judged) GROUP BY file_id, line_no""",
        "p5_found": r"""
            WITH piece AS (
                SELECT feature_no, list_filter(list_transform(
                    regexp_extract_all(attributes, '(?s)(?:"(?:[^"\\]|\\.|"")*"|\\.|[^;&|,\t\n\r"\\])+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps
                FROM gff WHERE attributes IS NOT NULL AND trim(attributes) NOT IN ('', '.')
            ), one AS (SELECT feature_no, unnest(range(1, len(ps) + 1)) AS k, ps FROM piece),
            cut AS (SELECT feature_no, k::INT AS attr_pos, regexp_extract(ps[k], '^[A-Za-z0-9_]*') AS attr_tag,
                      regexp_replace(substr(ps[k], length(regexp_extract(ps[k], '^[A-Za-z0-9_]*')) + 1), '^\s*[=:]?\s*', '') AS v FROM one)
            SELECT feature_no, attr_pos, attr_tag,
              CASE WHEN regexp_full_match(v, '(?s)".*"') AND length(v) >= 2 THEN regexp_replace(regexp_replace(replace(v[2:-2], '""', '"'), '\\(.)', '\1', 'g'), 'x^', '')
                   ELSE regexp_replace(v, '\\(.)', '\1', 'g') END AS attr_value
            FROM cut""",
        "p6_found": r"""
            WITH iv AS (
                SELECT 'gff' AS origin, seqid AS entity, least(gff_start, gff_end) AS b, greatest(gff_start, gff_end) AS e FROM gff
                WHERE seqid IS NOT NULL AND gff_start IS NOT NULL AND gff_end IS NOT NULL
                UNION ALL
                SELECT 'hits', regexp_extract(q_id, '^\S*'), least(q_beg, q_end), greatest(q_beg, q_end) FROM hits
                WHERE q_id IS NOT NULL AND q_beg IS NOT NULL AND q_end IS NOT NULL
            ), m AS (SELECT *, max(e) OVER (PARTITION BY origin, entity ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
            g AS (SELECT *, sum(CASE WHEN pe IS NULL OR b > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY origin, entity ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS grp FROM m),
            p AS (SELECT origin, entity, min(b)::BIGINT AS seg_beg, max(e)::BIGINT AS seg_end FROM g GROUP BY origin, entity, grp)
            SELECT origin, entity, 'period' AS kind, seg_beg, seg_end FROM p
            UNION ALL
            SELECT origin, entity, 'gap', pe + 1, seg_beg - 1 FROM (SELECT *, lag(seg_end) OVER (PARTITION BY origin, entity ORDER BY seg_beg) AS pe FROM p) WHERE pe IS NOT NULL""",
    }
