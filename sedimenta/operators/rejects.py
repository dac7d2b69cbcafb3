"""Rows that fail to parse: load delimited lines typed by their file's own header and set the rest apart with reasons.

Header lines become two rule tables: one row per file (how many fields its lines have), and one row per file, column and
validation (role, name, rule). Lines are judged whole first, then exploded into (row, column, value) cells; cells meet the
rules of their column, the validations are evaluated, errors are aggregated per row, and the clean rows are what an
anti-join with the errors leaves. Rules are made once and measured: a few megabytes are broadcast and no line moves;
beyond that both sides meet on (file, column, salt), with the rules replicated over a few salts so that one file with a
third of all lines spreads over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.session import BROADCAST_MAX_BYTES, cut

SALTS = 16
#: White space at either end of a value, no-break and other Unicode spaces included; then the same without tab.
_SPACES = r"\u0085   -     　﻿"
_TRIM = rf"^[\s{_SPACES}]++|[\s{_SPACES}]++$"
_BLANK = rf"[[^\S\t]{_SPACES}]*+"
#: One field: quoted (a doubled quote stands for a quote), or free of quotes. Possessive, so that long lines need no stack.
_FIELD = rf'(?:{_BLANK}"[^"]*+(?:""[^"]*+)*+"{_BLANK}|[^\t"]*+)'
_WELL = rf"^{_FIELD}(?:\t{_FIELD})*+$"
_NUMBER = r"^[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?$"
KEY, INFO, DATA = "9", "0", "1"
#: The validations: role of a column, its name if only that one is meant, what a plainly right raw cell looks like, what
#: the cleaned value must look like, and the reason where it doesn't. Empty values are right where the pattern says so.
RULES = {
    "bad_number": (DATA, None, rf"{_NUMBER}|^$", rf"{_NUMBER}|^$"),
    "bad_key": (KEY, None, r"^[0-9]++$", r"^[0-9]++$"),
    "bad_length": (INFO, "length", r"^[1-9][0-9]*+$", r"^(?:\+?0*+[1-9][0-9]*+)?$"),
}
REASONS = ("no_header", "stray_header", "bad_quoting", "field_count", *RULES, "conflicting_texts")


def _clean(c):
    return F.regexp_replace(c, _TRIM, "")


def _value(c):
    """Value of a well-formed field: white space around goes, enclosing quotes go, a doubled quote is one."""
    t = _clean(c)
    return F.when(t.startswith('"'), _clean(F.regexp_replace(F.regexp_replace(t, r'^"|"$', ""), '""', '"'))).otherwise(t)


def numbered_lines(raw: DataFrame, file_id: str, line_no: str, line: str) -> DataFrame:
    """(file_id, line_no, line) with line ends and exact redeliveries removed lazily; null keys or lines carry no record."""
    return raw.select(F.col(file_id).alias("file_id"), F.col(line_no).cast("long").alias("line_no"), F.regexp_replace(F.col(line), r"[\r\n]++$", "").alias("line")).where(
        F.col("file_id").isNotNull() & F.col("line_no").isNotNull() & F.col("line").isNotNull()
    )


def header_rules(lines: DataFrame) -> DataFrame:
    """(file_id, header_last, col_types, row_keys): roles and lower-cased keys by position, from each file's first four ``%`` lines.

    At most four lines per file leave the scan's tasks (the window's group limit runs before its shuffle).
    """
    sign = lines.where(F.col("line").startswith("%")).groupBy("file_id", "line_no").agg(F.min("line").alias("line"))
    ranked = sign.withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))).where("k <= 4")
    packed = ranked.groupBy("file_id").agg(
        F.max("line_no").alias("header_last"),
        F.max(F.when(F.col("k") == 3, F.col("line"))).alias("types"),
        F.max(F.when(F.col("k") == 4, F.col("line"))).alias("names"),
    )
    cells = lambda c: F.transform(F.split(F.regexp_replace(F.col(c), r"^%[ \t]?", ""), "\t"), lambda x: F.regexp_replace(_clean(x), '"', ""))
    return packed.select("file_id", "header_last", cells("types").alias("col_types"), F.transform(cells("names"), F.lower).alias("row_keys"))


def cell_rules(header: DataFrame) -> DataFrame:
    """The rule table: (file_id, col, name, rule), one row for each validation of a file's column (col from 0)."""
    columns = header.where("col_types IS NOT NULL").select("file_id", F.posexplode("col_types").alias("col", "role"), "row_keys")
    named = columns.select("file_id", "col", "role", F.get("row_keys", F.col("col")).alias("name"))
    rule = F.array_compact(F.array(*[F.when((F.col("role") == role) & (F.lit(True) if only is None else F.col("name") == only), F.lit(r)) for r, (role, only, *_) in RULES.items()]))
    return named.select("file_id", "col", "name", F.explode(rule).alias("rule"))


def _measured(rules: DataFrame) -> tuple[DataFrame, bool]:
    """The rules, made once, and whether they are small enough to be broadcast."""
    rules = cut(rules)
    size = rules.agg(F.sum(F.length(F.to_json(F.struct(*rules.columns))))).first()[0] or 0
    return rules, size * 4 <= BROADCAST_MAX_BYTES  # with room for how rows are held in memory


def _meet(left: DataFrame, rules: tuple[DataFrame, bool], key: list[str], how: str) -> DataFrame:
    """``left`` with the rules of its key: by broadcast if these are small, else through salts."""
    table, small = rules
    if small:
        return left.join(F.broadcast(table), key, how)
    left = left.withColumn("salt", F.pmod(F.xxhash64("line_no"), F.lit(SALTS)).cast("int"))
    return left.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*key, "salt"], how).drop("salt")


def _parsed(lines: DataFrame, header: tuple[DataFrame, bool]) -> DataFrame:
    """Body lines with their file's header and parsed fields (null fields where the quoting is broken); stray headers are body lines."""
    about = lines.where(~F.col("line").startswith("#") & F.col("line").rlike(rf"[^\s{_SPACES}]"))
    body = _meet(about, header, ["file_id"], "left").where(~F.col("line").startswith("%") | (F.col("line_no") > F.col("header_last")))
    plain = ~F.col("line").contains('"')
    tiles = F.regexp_extract_all(F.concat("line", F.lit("\t")), F.lit(rf"({_FIELD})\t"), F.lit(1))
    return body.withColumn("fields", F.when(plain, F.split("line", "\t")).when(F.col("line").rlike(_WELL), tiles))


def _errors(parsed: DataFrame, rules: tuple[DataFrame, bool]) -> DataFrame:
    """One row per failing line: file_id, line_no, reasons (sorted) and the failing cells."""
    whole = (
        F.when(F.col("line").startswith("%"), "stray_header").when(F.col("col_types").isNull(), "no_header")
        .when(F.col("fields").isNull(), "bad_quoting").when(F.size("fields") != F.size("col_types"), "field_count")
    )
    judged = parsed.select("file_id", "line_no", whole.alias("row_reason"), "fields")
    cells = judged.select("file_id", "line_no", "row_reason", F.posexplode_outer(F.when(F.col("row_reason").isNull(), F.col("fields"))).alias("col", "raw"))
    met = _meet(cells, rules, ["file_id", "col"], "left").where(F.col("row_reason").isNotNull() | F.col("rule").isNotNull())

    def breaks(value, which: int):
        out = F.lit(False)
        for r, spec in RULES.items():
            out = F.when(F.col("rule") == r, ~value.rlike(spec[which])).otherwise(out)
        return out

    # cells that are plainly right go before any cleaning; what is left (few cells) is trimmed, unquoted and judged
    suspect = met.where(F.col("row_reason").isNotNull() | breaks(F.col("raw"), 2)).withColumn("value", _value(F.col("raw")))
    bad = suspect.withColumn("reason", F.coalesce("row_reason", F.when(breaks(F.col("value"), 3), F.col("rule")))).where(F.col("reason").isNotNull())
    return bad.groupBy("file_id", "line_no").agg(
        F.array_sort(F.collect_set("reason")).alias("reasons"),
        F.array_sort(F.collect_set(F.struct("name", "value"))).alias("bad_cells"),
    )


def _conflicts(lines: DataFrame) -> DataFrame:
    """(file_id, line_no) delivered with differing texts; only hashes of the lines are shuffled."""
    seen = lines.select("file_id", "line_no", F.xxhash64("line").alias("h"))
    return seen.groupBy("file_id", "line_no").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("file_id", "line_no")


def load_counts(raw: DataFrame, file_id: str = "file_id", line_no: str = "line_no", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(clean, rejected) of raw counts-table lines.

    ``clean``: file_id, line_no, key (LONG), info (map of metadata), data (map of column name to DOUBLE, empty cells null),
    beyond (map of the texts of keys and numbers that are right but that no LONG or DOUBLE holds; these are null above).
    ``rejected``: file_id, line_no, reasons (of REASONS, sorted), bad_cells (name, value of the failing cells).

    * every body line is in exactly one of the two; null file, line number or line: no record, in neither; blank and ``#``
      lines hold none either, nor do the four header lines; a later ``%`` line fails as ``stray_header``;
    * a line delivered again (same file and number) is one line; differing texts under one number fail all together, as
      ``conflicting_texts`` besides what is wrong with any of them;
    * a column of an unknown role is metadata; a name that stands twice gets its position behind it;
    * a file without types line fails whole, as ``no_header``; an empty table gives two empty results;
    * columns of ``raw`` besides the three named play no part, whatever their names.
    """
    lines = numbered_lines(raw, file_id, line_no, line)
    header = _measured(header_rules(lines))
    parsed = _parsed(lines, header)
    rejected = _rejected(lines, parsed, header)
    good = parsed.dropDuplicates(["file_id", "line_no"]).join(rejected.select("file_id", "line_no"), ["file_id", "line_no"], "left_anti")
    known = (KEY, DATA)

    def having(keep):
        return F.filter(F.col("cells"), keep)

    def texts(cells):
        return F.transform(cells, lambda c: F.struct(c["name"].alias("name"), _value(c["raw"]).alias("v"), c["role"].alias("role")))

    # a name that stands twice in a header keeps its first place, later ones get their position behind it; one without name too
    name = lambda k: F.get("row_keys", k)
    once = F.transform("col_types", lambda t, k: F.when(name(k).isNull(), F.concat(F.lit("#"), (k + 1).cast("string"))).when(F.array_position(F.col("row_keys"), name(k)) == k + 1, name(k)).otherwise(F.concat_ws("#", name(k), (k + 1).cast("string"))))
    good = good.select("file_id", "line_no", F.col("fields").alias("raw"), F.col("col_types").alias("role"), once.alias("name")).withColumn("cells", F.arrays_zip("raw", "role", "name"))
    valued = good.select("file_id", "line_no", *[texts(having(k)).alias(n) for n, k in (("keys", lambda c: c["role"] == KEY), ("infos", lambda c: ~c["role"].isin(*known)), ("values", lambda c: c["role"] == DATA))])
    number = lambda v: F.when(v != "", v.cast("double"))
    inside = lambda d: F.when(F.abs(d) != F.lit(float("inf")), d)
    wide = F.concat(F.filter("keys", lambda c: c["v"].try_cast("long").isNull()), F.filter("values", lambda c: F.abs(number(c["v"])) == F.lit(float("inf"))))
    clean = valued.select(
        "file_id", "line_no",
        F.get("keys", 0)["v"].try_cast("long").alias("key"),
        F.map_from_entries(F.transform("infos", lambda c: F.struct(c["name"], c["v"]))).alias("info"),
        F.map_from_entries(F.transform("values", lambda c: F.struct(c["name"], inside(number(c["v"]))))).alias("data"),
        F.map_from_entries(F.transform(wide, lambda c: F.struct(c["name"], c["v"]))).alias("beyond"),
    )
    return clean, rejected


def _rejected(lines: DataFrame, parsed: DataFrame, header: tuple[DataFrame, bool]) -> DataFrame:
    bad = _errors(parsed, _measured(cell_rules(header[0])))
    # differing texts of a body line; header lines and comments that were delivered differently are no records
    torn = _conflicts(lines).join(parsed.select("file_id", "line_no").distinct(), ["file_id", "line_no"], "left_semi")
    torn = torn.select("file_id", "line_no", F.array(F.lit("conflicting_texts")).alias("reasons"), F.array().cast(bad.schema["bad_cells"].dataType).alias("bad_cells"))
    return bad.unionByName(torn).groupBy("file_id", "line_no").agg(F.array_sort(F.flatten(F.collect_list("reasons"))).alias("reasons"), F.flatten(F.collect_list("bad_cells")).alias("bad_cells"))


def rejected_lines(raw: DataFrame, file_id: str = "file_id", line_no: str = "line_no", line: str = "line", conflicts: bool = True) -> DataFrame:
    """Only the failing lines of ``load_counts``, without planning the clean side.

    Without ``conflicts`` only lines that fail by themselves are looked for, and no line or hash of one is shuffled.
    """
    lines = numbered_lines(raw, file_id, line_no, line)
    header = _measured(header_rules(lines))
    parsed = _parsed(lines, header)
    return _rejected(lines, parsed, header) if conflicts else _errors(parsed, _measured(cell_rules(header[0])))
