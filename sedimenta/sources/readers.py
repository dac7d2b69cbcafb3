"""Readers of the text formats: one function per format, each over the text source with its own schema.

Lines that start with ``#`` and blank lines mean nothing; ``%`` lines are headers. Where a body is positional, lines are
numbered by (file, position) from the scan's own metadata and never by collecting a file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines that a header has at most.
HEADER_MAX = 200
#: Roles of columns in a training file.
ROLES = {0: "ignore", 1: "data", 3: "class", 9: "key"}


def lines(spark: SparkSession, path: str, ignore: str = r"^#|^\s*$", header: str = r"^%") -> DataFrame:
    """(line) of the body: neither ignored nor header."""
    return spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line")).where(~F.col("line").rlike(ignore) & ~F.col("line").rlike(header))


def header(spark: SparkSession, path: str) -> list[str]:
    """Header lines of one file, in order, without their sign. Only ``%`` lines reach the driver; more than HEADER_MAX are refused."""
    got = spark.read.text(path).where(F.col("value").startswith("%")).limit(HEADER_MAX + 1).collect()
    if len(got) > HEADER_MAX:
        raise ValueError(f"a header has at most {HEADER_MAX} lines")
    return [r[0].rstrip("\r")[1:].strip(" ") for r in got]


def positioned(spark: SparkSession, path: str, ignore: str = r"^[#%]|^\s*$") -> DataFrame:
    """(at, line) of a body whose order matters: ``at`` from 0, in the order of file names and of lines within a file.

    Blocks of files are counted, and each line's place is its place in its block plus the lines of the blocks before.
    """
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("id"))
    rows = rows.where(~F.col("line").rlike(ignore))
    blocks = rows.groupBy("f", "b").agg(F.count("*").alias("n"))
    before = blocks.select("f", "b", (F.sum("n").over(Window.orderBy("f", "b")) - F.col("n")).alias("before"))  # a row per block
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy("f", "b").orderBy("id")))
    return own.join(before, ["f", "b"]).select((F.col("k") - 1 + F.col("before")).alias("at"), "line")


def _tab(k: int, kind: str = "string") -> Column:
    c = F.get(F.split("line", "\t"), F.lit(k))
    return c if kind == "string" else F.when(F.trim(c) != "", F.trim(c).cast(kind))


# counts ------------------------------------------------------------------------------------------------------------
@dataclass
class CountsHeader:
    rows: int
    columns: int
    types: list[int]
    names: list[str]


def counts_header(spark: SparkSession, path: str) -> CountsHeader:
    h = header(spark, path)
    if len(h) < 4:
        raise ValueError("a counts table has four header lines")
    return CountsHeader(int(h[0]), int(h[1]), [int(t) for t in h[2].split("\t")], [n.strip() for n in h[3].split("\t")])


def counts_table(spark: SparkSession, path: str) -> DataFrame:
    """A counts table: metadata as text with lower-cased names, data as DOUBLE; roles stand in the fields' metadata."""
    h = counts_header(spark, path)
    if len(h.types) != len(h.names):
        raise ValueError("as many types as names are needed")
    out = []
    for k, (t, name) in enumerate(zip(h.types, h.names)):
        c = _tab(k, "bigint") if t == 9 else _tab(k) if t == 0 else _tab(k, "double")
        out.append(c.alias(name if t == 1 else name.lower(), metadata={"role": {9: "key", 0: "info", 1: "data"}[t]}))
    return lines(spark, path).select(*out)


# map and training files --------------------------------------------------------------------------------------------
def training(spark: SparkSession, path: str) -> DataFrame:
    """``.lrn``: (index, v[, class]). Header: points, columns, types, names."""
    h = header(spark, path)
    types = [int(t) for t in h[2].split("\t")] if len(h) > 2 else []
    data, key, cls = ([k for k, t in enumerate(types) if t == want] for want in (1, 9, 3))
    if len(types) != int(h[1]):
        raise ValueError("the header's number of columns differs from its types")
    index = _tab(key[0], "bigint") if key else F.lit(None).cast("bigint")
    more = [_tab(cls[0], "int").alias("class")] if cls else []
    return lines(spark, path).select(index.alias("index"), F.array(*[_tab(k, "double") for k in data]).alias("v"), *more)


def matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """Body of a positional matrix (``.umx``: one line per row; ``.wts``: one line per neuron): (at, w)."""
    return positioned(spark, path).select("at", F.transform(F.split("line", "\t"), lambda x: F.trim(x).cast("double")).alias("w"))


def weights(spark: SparkSession, path: str) -> DataFrame:
    """``.wts``: (neuron, row, col, w) from a header of rows and columns."""
    columns = int(header(spark, path)[0].split()[1])
    return matrix_rows(spark, path).select(F.col("at").alias("neuron"), (F.col("at") / columns).cast("long").alias("row"), (F.col("at") % columns).alias("col"), "w")


def best_matches(spark: SparkSession, path: str) -> DataFrame:
    """``.bm``: (index, row, col, distance)."""
    return lines(spark, path).select(_tab(0, "bigint").alias("index"), _tab(1, "int").alias("row"), _tab(2, "int").alias("col"), _tab(3, "double").alias("distance"))


def classes(spark: SparkSession, path: str) -> DataFrame:
    """``.cls`` and ``.cmx``: (index, class); points of class 0 are not stored."""
    return lines(spark, path).select(_tab(0, "bigint").alias("index"), _tab(1, "int").alias("class")).where("class != 0")


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """Classes named in the header, however many: (class, name, r, g, b)."""
    head = spark.read.text(path).where(F.col("value").startswith("%")).select(F.trim(F.regexp_replace("value", r"^%|\r+$", "")).alias("line"))
    return head.where(F.size(F.split("line", "\t")) >= 5).select(_tab(0, "int").alias("class"), _tab(1).alias("name"), *[_tab(k, "int").alias(c) for k, c in enumerate("rgb", 2)])


def names(spark: SparkSession, path: str) -> DataFrame:
    """``.names``: (index, name, description)."""
    return lines(spark, path).select(_tab(0, "bigint").alias("index"), _tab(1).alias("name"), _tab(2).alias("description"))


def colours(spark: SparkSession, path: str) -> DataFrame:
    """``.rgb``: (at, r, g, b)."""
    f = F.split(F.trim("line"), r"\s+")
    return positioned(spark, path).select("at", *[F.get(f, F.lit(k)).cast("int").alias(c) for k, c in enumerate("rgb")])


# sequences, hits, clusters, graphs ---------------------------------------------------------------------------------
def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, header, seq, length): records split at a line that begins with ``>``."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("r")).where(F.trim("r") != "")
    head = F.regexp_replace(F.split_part("r", F.lit("\n"), F.lit(1)), r"\r", "")
    seq = F.regexp_replace(F.expr("substring(r, length(split_part(r, '\n', 1)) + 1)"), r"\s+", "")
    return rec.select(F.regexp_extract(head, r"^\S*", 0).alias("name"), head.alias("header"), seq.alias("seq")).withColumn("length", F.length("seq"))


def blast(spark: SparkSession, path: str) -> DataFrame:
    """The 12 fields of tabular search hits."""
    fields = ["q_id", "s_id", "pct_id", "aln_len", "mismatches", "gap_open", "q_beg", "q_end", "s_beg", "s_end", "e_value", "bit_score"]
    kinds = ["string", "string", "double", *["int"] * 7, "double", "double"]
    return lines(spark, path).select(*[_tab(k, t).alias(n) for k, (n, t) in enumerate(zip(fields, kinds))])


def key_values(text: Column) -> Column:
    """Map of ``key=value`` pieces parted by ``;``. A quoted value keeps its ``;`` and loses its quotes; of a key that
    stands more than once the first value counts; a piece without ``=`` has a null value."""
    pieces = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r'((?:"[^"]*+"|[^;"]|")++)'), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "")
    pairs = F.transform(pieces, lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.when(p.contains("="), F.regexp_replace(F.regexp_replace(p, r"^[^=]*=\s*", ""), r'^"(.*)"$', "$1")).alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


def _feature() -> list[Column]:
    score = F.when(F.trim(_tab(5)) != ".", _tab(5, "double"))
    return [
        _tab(0).alias("seqid"), _tab(1).alias("source"), _tab(2).alias("type"), _tab(3, "bigint").alias("start"), _tab(4, "bigint").alias("end"), score.alias("score"),
        _tab(6).alias("strand"), _tab(7).alias("frame"), (_tab(4, "bigint") - _tab(3, "bigint") + 1).alias("length"), key_values(_tab(8)).alias("attributes"),
    ]


def gff(spark: SparkSession, path: str) -> DataFrame:
    """Features: seqid, source, type, start, end, score, strand, frame, length, attributes (a map, see ``key_values``)."""
    return lines(spark, path).select(*_feature())


def gff_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of a gene finder's GFF: (at, seqid, values), ``at`` in the file's order.

    A sequence's data are a ``# Sequence Data:`` line and the ``# Model Data:`` line behind it, put together in one map;
    its name is the first word of ``seqhdr``.
    """
    said = positioned(spark, path, r"^\s*$|^##").where(F.col("line").startswith("# ")).select("at", F.regexp_extract("line", r"^# (\w+) Data:", 1).alias("kind"), F.regexp_extract("line", r"Data:\s*(.*)$", 1).alias("text"))
    model = said.where("kind = 'Model'").select((F.col("at") - 1).alias("at"), F.col("text").alias("model"))
    both = said.where("kind = 'Sequence'").join(model, "at", "left").select("at", key_values(F.concat_ws(";", "text", "model")).alias("values"))
    return both.select("at", F.regexp_extract(F.col("values")["seqhdr"], r"^\S*", 0).alias("seqid"), "values")


def gene_finder(spark: SparkSession, path: str) -> DataFrame:
    """Genes of a gene finder's GFF with the data of their sequence: the columns of ``gff``, ``n`` (from 1 within the
    sequence, in the file's order), ``gene`` (<seqid>_<n>) and ``sequence`` (map; null for a sequence without comments)."""
    from sedimenta.operators.annotate import number_features

    features = positioned(spark, path, r"^\s*$|^##").where(~F.col("line").startswith("#")).select("at", *_feature())
    genes = number_features(features, "seqid", ["at"]).withColumnRenamed("name", "gene").drop("at")
    return genes.join(gff_sequences(spark, path).select("seqid", F.col("values").alias("sequence")), "seqid", "left")


def other_code(sequences: DataFrame, table: str = "11") -> DataFrame:
    """Sequences (of ``gff_sequences``) whose translation table isn't the given one, in the order of their number."""
    from sedimenta.operators.counts import numbered

    kept = sequences.where(F.coalesce(F.col("values")["transl_table"], F.lit("")) != table)
    return numbered(kept, [F.col("values")["seqnum"].cast("long"), F.col("seqid")], "place").select("place", "seqid", F.col("values")["seqhdr"].alias("seqhdr"))


def hmm_table(spark: SparkSession, path: str, domains: bool = False) -> DataFrame:
    from sedimenta.operators.annotate import hmm_target

    return lines(spark, path).select(hmm_target(F.col("line"), domains).alias("h")).select("h.*")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """``.uc`` records: kind, cluster, size, pct_id, strand, alignment, label, target."""
    return lines(spark, path).select(_tab(0).alias("kind"), _tab(1, "bigint").alias("cluster"), _tab(2).alias("size"), _tab(3).alias("pct_id"), _tab(4).alias("strand"), _tab(7).alias("alignment"), _tab(8).alias("label"), _tab(9).alias("target"))


def otu_map(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, seq, at): members of each cluster in their order."""
    f = F.split("line", "\t")
    rows = lines(spark, path).where(F.col("line").rlike(r"^\S+\t\S"))
    return rows.select(F.get(f, F.lit(0)).alias("cluster"), F.posexplode(F.slice(f, 2, F.size(f) - 1)).alias("at", "seq"))


def graph_nodes(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(_tab(0).alias("node"), _tab(1).alias("seqid"), _tab(2, "bigint").alias("length"), _tab(3, "double").alias("coverage"), _tab(4, "int").alias("degree"))


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(_tab(0).alias("a"), _tab(1).alias("b"), _tab(2).alias("kind"), _tab(3, "int").alias("connections"), _tab(4, "double").alias("ratio"), _tab(5, "double").alias("score"))


def include_list(spark: SparkSession, path: str) -> DataFrame:
    """First word of each line."""
    return lines(spark, path).select(F.regexp_extract("line", r"^\s*(\S+)", 1).alias("name")).where("name != ''")


def sample_counts(spark: SparkSession, path: str) -> DataFrame:
    """(sample, n) of lines ``sample number``."""
    rx = r"^(\S+)\s+(\d+)"
    return lines(spark, path).where(F.col("line").rlike(rx)).select(F.regexp_extract("line", rx, 1).alias("sample"), F.regexp_extract("line", rx, 2).cast("bigint").alias("n"))


#: Readers by what a file's name ends in.
BY_ENDING = {"lrn": training, "wts": weights, "umx": matrix_rows, "bm": best_matches, "cls": classes, "cmx": classes, "names": names, "rgb": colours, "uc": clusters}


def typed(spark: SparkSession, path: str) -> DataFrame:
    """A map's or training file by its ending; ValueError for one that no reader is for."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending not in BY_ENDING:
        raise ValueError(f"no reader for .{ending}")
    return BY_ENDING[ending](spark, path)
