"""Writers of the text formats: a folder of parts, written in parallel, and one part that holds the header.

Header lines tell themselves by their sign, so the readers take the folder as it is, in whatever order parts come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _write(body: DataFrame, header: list[str], path: str, line: Column) -> None:
    body.select(line.alias("value")).write.mode("overwrite").text(path)
    if header:
        body.sparkSession.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.mode("append").text(path)


def write_counts(table: DataFrame, path: str, key: str | None, info: list[str], data: list[str], delimiter: str = "\t") -> None:
    """A counts table with its four header lines; metadata names are written capitalised."""
    columns = [*([key] if key else []), *info, *data]
    types = ["9"] * bool(key) + ["0"] * len(info) + ["1"] * len(data)
    shown = [*([key.capitalize()] if key else []), *[i.capitalize() for i in info], *data]
    header = [f"% {table.count()}", f"% {len(data)}", "% " + delimiter.join(types), "% " + delimiter.join(shown)]
    _write(table, header, path, F.concat_ws(delimiter, *[_text(F.col(c)) for c in columns]))


def write_training(points: DataFrame, path: str, index: str, v: str, names: list[str]) -> None:
    """``.lrn``: points, columns (key included), types, names."""
    header = [f"% {points.count()}", f"% {len(names) + 1}", "% " + "\t".join(["9", *["1"] * len(names)]), "% " + "\t".join(["Key", *names])]
    _write(points, header, path, F.concat_ws("\t", _text(F.col(index)), F.array_join(F.transform(v, lambda x: x.cast("string")), "\t")))


def write_names(points: DataFrame, path: str, index: str, name: str, description: str | None = None) -> None:
    _write(points, [f"% {points.count()}"], path, F.concat_ws("\t", _text(F.col(index)), _text(F.col(name)), *([_text(F.col(description))] if description else [])))


def write_training_pair(points: DataFrame, path: str, index: str, v: str, name: str, names: list[str]) -> None:
    """``<path>.lrn`` and ``<path>.names`` of the same points."""
    write_training(points, f"{path}.lrn", index, v, names)
    write_names(points, f"{path}.names", index, name)


def write_map(neurons: DataFrame, matches: DataFrame, path: str, rows: int, columns: int, dimensions: int) -> None:
    """What a training leaves behind: ``<path>.wts``, ``<path>.bm`` and ``<path>.umx``."""
    from sedimenta.operators.som import u_matrix

    write_weights(neurons, f"{path}.wts", rows, columns, dimensions)
    write_best_matches(matches, f"{path}.bm", rows, columns)
    write_u_matrix(u_matrix(neurons, rows, columns), f"{path}.umx", rows, columns)


def write_gene_finder(features: DataFrame, sequences: DataFrame, path: str) -> None:
    """A gene finder's GFF: each sequence's two comment lines, then its features by their start.

    ``features``: seqid, source, type, start, end, score, strand, frame, attributes, order. ``sequences``: seqid, seqnum,
    seqlen, transl_table. Lines are put in one distributed order; no sequence is gathered.
    """
    columns = ("seqid", "source", "type", "start", "end", "score", "strand", "frame", "attributes")
    said = sequences.select(
        "seqid", "seqnum", F.posexplode(F.array(
            F.concat(F.lit("# Sequence Data: seqnum="), "seqnum", F.lit(";seqlen="), "seqlen", F.lit(';seqhdr="'), "seqid", F.lit(' a sequence"')),
            F.concat(F.lit("# Model Data: version=1;run_type=Single;transl_table="), "transl_table"))).alias("k", "value"), F.lit(None).cast("long").alias("order"))
    body = features.join(sequences.select("seqid", "seqnum"), "seqid").select("seqid", "seqnum", F.lit(2).alias("k"), F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns]).alias("value"), F.col("order").cast("long").alias("order"))
    keys = ["seqnum", "k", "order"]
    ordered = said.select("seqid", "seqnum", "k", "value", "order").unionByName(body).repartitionByRange(*keys).sortWithinPartitions(*keys)
    _write(ordered, ["##gff-version 3"], path, F.col("value"))


def write_weights(neurons: DataFrame, path: str, rows: int, columns: int, dimensions: int) -> None:
    """``.wts``: neurons in order, a range of them in each part; a neuron that is missing is written as NaN to keep the places."""
    from sedimenta.operators.som import cells

    grid = cells(neurons.sparkSession, rows, columns).select("neuron")
    neurons = grid.join(neurons.select("neuron", "w"), "neuron", "left").withColumn("w", F.coalesce("w", F.array_repeat(F.lit(float("nan")), dimensions)))
    header = [f"% {rows} {columns}", f"% {dimensions}"]
    ordered = neurons.select("neuron", "w").repartitionByRange("neuron").sortWithinPartitions("neuron")
    _write(ordered, header, path, F.array_join(F.transform("w", lambda x: x.cast("string")), "\t"))


def write_u_matrix(heights: DataFrame, path: str, rows: int, columns: int) -> None:
    """``.umx``: one line per row of the map."""
    line = heights.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "height"))), lambda x: x["height"].cast("string")).alias("h"))  # a row has a map's columns
    _write(line.repartitionByRange("row").sortWithinPartitions("row"), [f"% {rows} {columns}"], path, F.array_join("h", "\t"))


def write_best_matches(matches: DataFrame, path: str, rows: int, columns: int) -> None:
    _write(matches, [f"% {rows} {columns}", f"% {matches.count()}"], path, F.concat_ws("\t", *[_text(F.col(c)) for c in ("index", "row", "col", "distance")]))


def write_classes(points: DataFrame, path: str, classes: list[tuple[int, str, int, int, int]]) -> None:
    """``.cls`` with the colours of its classes in the header."""
    header = [f"% {points.count()}", *["%" + "\t".join(map(str, c)) for c in classes]]
    _write(points, header, path, F.concat_ws("\t", _text(F.col("index")), _text(F.col("class"))))


def write_hits(hits: DataFrame, path: str) -> None:
    """Tabular search hits, all of them: 12 fields, nulls empty, queries by their name (what stands before white space)."""
    rest = ("s_id", "pct_id", "aln_len", "mistmatches", "gap_open", "q_beg", "q_end", "s_beg", "s_end", "eval", "bit_score")
    _write(hits, [], path, F.concat_ws("\t", _text(F.regexp_extract("q_id", r"^\S*", 0)), *[_text(F.col(c)) for c in rest]))


def write_gff(features: DataFrame, path: str) -> None:
    """Features with a version line; ``attributes`` is text."""
    columns = ("seqid", "source", "type", "start", "end", "score", "strand", "frame", "attributes")
    _write(features, ["##gff-version 3"], path, F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns]))


def ramp(n: int = 32) -> list[tuple[int, str, int, int, int]]:
    """Classes 0 .. n-1 coloured from blue over green to red."""
    out = []
    for k in range(n):
        t = k / max(n - 1, 1)
        out.append((k, str(k), round(255 * max(0.0, 2 * t - 1)), round(255 * (1 - abs(2 * t - 1))), round(255 * max(0.0, 1 - 2 * t))))
    return out
