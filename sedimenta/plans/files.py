"""Queries that write a format and read it back, solve small systems, train in one task, and run over streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import linalg, som
from sedimenta.plans.maps import COLUMNS, codebook
from sedimenta.plans.tables import wide_counts
from sedimenta.plans.vectors import training
from sedimenta.session import cut, ensure_checkpoint_dir, table
from sedimenta.sources import readers, writers


def folder(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder that the cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{name}-{uuid.uuid4().hex}"


def counts(spark, sf_dir):
    """The counts table written with its header and read back."""
    path, data = folder(spark, "counts"), [f"c{k}" for k in range(1, 8)]
    rows = wide_counts(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_num"), F.col("s_name").alias("name")), "row_num")
    writers.write_counts(rows.withColumnRenamed("row_num", "key"), path, "key", ["name"], data)
    return readers.counts_table(spark, path)


def training_file(spark, sf_dir):
    """Training vectors written and read back: sums per point."""
    path = folder(spark, "lrn")
    v = training(spark, sf_dir)
    writers.write_training(v, path, "data_index", "v", [f"m{k}" for k in range(32)])
    return readers.training(spark, path).select(F.col("index").alias("data_index"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def names_file(spark, sf_dir):
    """Names written and read back."""
    path = folder(spark, "names")
    writers.write_names(table(spark, sf_dir, "seq_names").where("data_index IS NOT NULL AND name IS NOT NULL"), path, "data_index", "name", "description")
    got = readers.names(spark, path)
    return got.select(F.col("index").alias("data_index"), "name", F.when(F.col("description") != "", F.col("description")).alias("description"))


def best_match_file(spark, sf_dir):
    """Best matches written and read back."""
    path = folder(spark, "bm")
    b = table(spark, sf_dir, "bestmatches").where("bm_row IS NOT NULL AND bm_col IS NOT NULL").select(F.col("data_index").alias("index"), F.col("bm_row").alias("row"), F.col("bm_col").alias("col"), "distance")
    writers.write_best_matches(b, path, 82, 137)
    return readers.best_matches(spark, path)


def class_file(spark, sf_dir):
    """Classes written with their colours and read back; points of class 0 are not stored."""
    path = folder(spark, "cls")
    b = table(spark, sf_dir, "bestmatches").where("distance IS NOT NULL").groupBy("data_index").agg(F.min("distance").alias("d")).select(F.col("data_index").alias("index"), F.least(F.lit(31), F.floor(F.col("d") * 10)).cast("int").alias("class"))
    writers.write_classes(b, path, writers.ramp(32))
    return readers.classes(spark, path).join(readers.class_names(spark, path), "class").select("index", "class", "name")


def weights_file(spark, sf_dir):
    """A map's weights written in order and read back by position."""
    path = folder(spark, "wts")
    book = codebook(spark, sf_dir)
    rows = book.agg(F.max("row") + 1).first()[0]
    writers.write_weights(book, path, rows, COLUMNS, 64)
    got = readers.weights(spark, path).where(~F.isnan(F.col("w")[0]))
    return got.select("neuron", "row", "col", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def fasta_file(spark, sf_dir):
    """Sequences written as FASTA by the plain text sink and read back."""
    from sedimenta.plans.sequences import dna

    path = folder(spark, "fasta")
    lines = dna(spark, sf_dir).where("length(seq) > 0").select(F.concat(F.lit(">doc"), "doc_id", F.lit(" a text\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value"))
    lines.write.text(path)
    return readers.fasta(spark, path).select("name", "length", F.md5("seq").alias("md5"))


def gff_file(spark, sf_dir):
    """Features written and read back."""
    path = folder(spark, "gff")
    g = table(spark, sf_dir, "gff").where("seqid IS NOT NULL AND gff_start IS NOT NULL AND gff_end IS NOT NULL")
    g = g.select("seqid", F.col("feature_source").alias("source"), F.col("feature_type").alias("type"), F.col("gff_start").alias("start"), F.col("gff_end").alias("end"), "score", "strand", "frame", F.concat(F.lit("ID="), "feature_no").alias("attributes"))
    writers.write_gff(g, path)
    return readers.gff(spark, path).select(F.col("attributes")["ID"].cast("long").alias("feature_no"), "seqid", "type", "length", "score")


def hits_file(spark, sf_dir):
    """Every hit written and read back, with empty fields for nulls and queries cut to their names."""
    path = folder(spark, "blast")
    writers.write_hits(table(spark, sf_dir, "hits"), path)
    got = readers.blast(spark, path).withColumn("s_id", F.nullif("s_id", F.lit("")))
    queries = F.count_distinct(F.nullif("q_id", F.lit(""))).alias("queries")
    return got.groupBy("s_id").agg(F.count("*").alias("n"), queries, F.count("bit_score").alias("scored"), F.max("bit_score").alias("best"), F.count("q_beg").alias("placed"), F.min("q_beg").alias("first"))


def genes_file(spark, sf_dir):
    """A gene finder's file, sequences with their data and genes, written in order and read back with genes linked to their sequence."""
    from sedimenta.operators.counts import numbered

    path = folder(spark, "genes")
    g = table(spark, sf_dir, "gff").where("seqid IS NOT NULL AND gff_start IS NOT NULL AND gff_end IS NOT NULL")
    seqs = numbered(g.groupBy("seqid").agg(F.max(F.greatest("gff_start", "gff_end")).alias("seqlen")), ["seqid"], "seqnum").withColumn("transl_table", F.when(F.col("seqnum") % 7 == 0, 4).otherwise(11))
    f = g.select("seqid", F.col("feature_source").alias("source"), F.col("feature_type").alias("type"), F.col("gff_start").alias("start"), F.col("gff_end").alias("end"), "score", "strand", "frame", F.concat(F.lit(";ID="), "feature_no", F.lit(';note="a;b";ID=again')).alias("attributes"), F.col("feature_no").alias("order"))
    writers.write_gene_finder(f, seqs, path)
    genes = readers.gene_finder(spark, path)
    return genes.select(F.col("attributes")["ID"].cast("long").alias("feature_no"), "gene", "length", F.col("attributes")["note"].alias("note"), F.col("sequence")["seqlen"].cast("long").alias("seqlen"), F.col("sequence")["transl_table"].alias("code"))


def map_files(spark, sf_dir):
    """A map's weights, best matches and U-matrix written as a training leaves them, read by their endings and joined again."""
    from sedimenta.operators import joins
    from sedimenta.plans.vectors import embeddings

    path, book = folder(spark, "map"), cut(codebook(spark, sf_dir))
    rows = book.agg(F.max("row") + 1).first()[0]
    ids, w = joins.codebook(book, "neuron", "w")
    best = joins.nearest_neuron(embeddings(spark, sf_dir), "v", ids, w, ["vec_id"])
    matches = best.select(F.col("vec_id").alias("index"), F.floor(F.col("neuron") / COLUMNS).alias("row"), (F.col("neuron") % COLUMNS).alias("col"), F.sqrt("distance2").alias("distance"))
    writers.write_map(book, matches, path, rows, COLUMNS, w.shape[1])
    heights = readers.typed(spark, f"{path}.umx").select(F.col("at").alias("row"), F.posexplode("w").alias("col", "height"))
    hit = readers.typed(spark, f"{path}.bm").groupBy("row", "col").agg(F.count("*").alias("n"))
    return readers.typed(spark, f"{path}.wts").join(heights, ["row", "col"]).join(hit, ["row", "col"], "left").select("neuron", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round("height", 6).alias("height"), F.coalesce("n", F.lit(0)).alias("n"))


def pair_files(spark, sf_dir):
    """Training vectors and their names written as the pair that a training takes, read by their endings and joined again."""
    path = folder(spark, "pair")
    n = table(spark, sf_dir, "seq_names").where("name IS NOT NULL").groupBy("data_index").agg(F.min("name").alias("name"))
    v = training(spark, sf_dir).join(n, "data_index")
    writers.write_training_pair(v, path, "data_index", "v", "name", [f"m{k}" for k in range(32)])
    return readers.typed(spark, f"{path}.lrn").join(readers.typed(spark, f"{path}.names"), "index").select(F.col("index").alias("data_index"), "name", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def clusters_file(spark, sf_dir):
    """Cluster records written as lines and read back: records per kind and cluster, and the largest size."""
    from sedimenta.plans.sequences import _records

    path = folder(spark, "clusters")
    r = _records(spark, sf_dir)
    line = F.concat_ws("\t", "kind", "cluster", "size", F.coalesce("pct_id", F.lit("*")), F.lit("+"), F.lit("0"), F.lit("0"), F.coalesce("alignment", F.lit("*")), "label", F.lit("*"))
    r.select(line.alias("value")).write.text(f"{path}.uc")
    return readers.typed(spark, f"{path}.uc").groupBy("kind", "cluster").agg(F.count("*").alias("n"), F.max(F.col("size").cast("long")).alias("size"), F.count_distinct("label").alias("labels"))


def members_file(spark, sf_dir):
    """Documents per source as a map of clusters to members, written and read back with their place."""
    path = folder(spark, "members")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("cluster"), F.col("o_orderkey").alias("seq")).where("seq % 50 = 0")
    o.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("seq")).cast("array<string>"), "\t").alias("members")).select(F.concat_ws("\t", "cluster", "members").alias("value")).write.text(path)
    got = readers.otu_map(spark, path)
    return got.select(F.col("cluster").cast("long").alias("cluster"), F.col("seq").cast("long").alias("seq"), (F.col("at") + 1).alias("place"))


def graph_files(spark, sf_dir):
    """Nodes and edges written and read back: edges per node with its length."""
    path = folder(spark, "graph")
    s = table(spark, sf_dir, "supplier")
    s.select(F.concat_ws("\t", "s_suppkey", "s_name", (F.col("s_nationkey") + 1).cast("string"), F.col("s_acctbal").cast("string"), F.lit("2")).alias("value")).write.text(f"{path}/nodes")
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    li.select(F.concat_ws("\t", "l_suppkey", "l_partkey", F.lit("mate"), F.lit("3"), F.lit("0.5"), F.lit("1.25")).alias("value")).write.text(f"{path}/edges")
    nodes, edges = readers.graph_nodes(spark, f"{path}/nodes"), readers.graph_edges(spark, f"{path}/edges")
    n = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_edges"), F.round(F.sum("score"), 2).alias("score"))
    return nodes.join(n, "node", "left").select(F.col("node").cast("long").alias("node"), F.col("seqid").alias("name"), "length", F.round("coverage", 2).alias("coverage"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("score", F.lit(0.0)).alias("score"))


def small_files(spark, sf_dir):
    """A colour table, a list of names and counts per sample, written and read back."""
    path = folder(spark, "small")
    n = table(spark, sf_dir, "nation")
    n.select(F.concat_ws(" ", F.col("n_nationkey"), F.col("n_regionkey"), F.length("n_name")).alias("value")).coalesce(1).write.text(f"{path}.rgb")
    n.select(F.concat(F.col("n_name"), F.lit("  and more")).alias("value")).write.text(f"{path}-names")
    n.select(F.concat(F.regexp_replace("n_name", " ", "_"), F.lit("\t"), F.col("n_nationkey") + 7).alias("value")).write.text(f"{path}-counts")
    parts = readers.typed(spark, f"{path}.rgb").agg(F.sum("r").alias("a"), F.sum("b").alias("b")), readers.include_list(spark, f"{path}-names").agg(F.count_distinct("name").alias("a"), F.sum(F.length("name")).alias("b")), readers.sample_counts(spark, f"{path}-counts").agg(F.count("sample").alias("a"), F.sum("n").alias("b"))
    out = None
    for kind, part in zip(("colours", "names", "samples"), parts):
        part = part.select(F.lit(kind).alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


def solve(spark, sf_dir):
    """Systems with closed-form solutions, solved by three factorisations: largest error and properties."""
    rows = []
    for kind in ("hilbert", "vandermonde"):
        for n in (2, 3, 4, 6):
            a = np.array([[1 / (i + j + 1) if kind == "hilbert" else (i + 1.0) ** (n - j - 1) for j in range(n)] for i in range(n)])
            want = np.arange(1.0, n + 1)
            for method in ("lu", "qr", *(["cholesky"] if kind == "hilbert" else [])):
                error = float(np.abs(linalg.solve(a, a @ want, method) - want).max())
                rows.append((kind, n, method, error < 1e-6, not linalg.is_singular(a), linalg.svd(a).rank, bool(np.allclose(a @ linalg.inverse(a), np.eye(n), atol=1e-6))))
    return spark.createDataFrame(rows, "kind string, n int, method string, is_solved boolean, is_regular boolean, n_rank int, is_inverted boolean")


def eigen(spark, sf_dir):
    """Eigenvalues and condition of the training vectors' covariance."""
    m = linalg.moments(training(spark, sf_dir), "v")[""]
    values, vectors = linalg.symmetric_eigen(m.cov)
    s = linalg.svd(m.cov)
    return spark.createDataFrame([(k, float(v), float(x)) for k, (v, x) in enumerate(zip(values[::-1], s.s))], "k int, eigenvalue double, singular_value double")


def _sequential(**how):
    def query(spark, sf_dir):
        v = training(spark, sf_dir)
        rows, columns = 8, 12
        start = som.initial("pca", linalg.moments(v, "v")[""], rows, columns)
        return som.u_matrix(cut(som.train_in_one_task(v, "data_index", "v", start, rows, columns, som.Schedule(epochs=2, radius=(4, 1)), **how)), rows, columns)

    query.__doc__ = f"U-matrix of a map of 8 x 12 trained in one task, exactly ({how or 'online'})."
    return query


def stream_of(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """A driver table as a stream of its files; a table of one file is picked out of its folder by name."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    alone = any(f.rstrip("/").endswith(f"/{name}.parquet") for f in batch.inputFiles())
    reader = spark.readStream.schema(batch.schema).options(**options)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if alone else reader.parquet(path)


def stream_windows(spark, sf_dir):
    """Hourly counts and sums per event type over a stream of the events, late rows within the watermark included."""
    from sedimenta.streaming.scoring import windowed

    out, events = folder(spark, "stream"), stream_of(spark, sf_dir, "events", maxFilesPerTrigger="4")
    w = windowed(events, "ts", "value", ["event_type"], "1 hour", "3650 days")
    q = w.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/result")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.read.parquet(f"{out}/result")
    return r.select(F.unix_timestamp("beg").alias("beg"), "event_type", "n", F.round("total", 4).alias("total"), "low", "high")


def stream_projection(spark, sf_dir):
    """Best matching neuron of every vector of a stream, without state."""
    from sedimenta.operators.joins import codebook as book_of
    from sedimenta.streaming.scoring import project_stream

    ids, w = book_of(codebook(spark, sf_dir), "neuron", "w")
    out, stream = folder(spark, "projection"), stream_of(spark, sf_dir, "embeddings")
    q = project_stream(stream, "embedding", ids, w, ["vec_id"]).writeStream.format("parquet").option("path", f"{out}/result").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/result").groupBy("neuron").agg(F.count("*").alias("n"))


def queries():
    io = (counts, training_file, names_file, best_match_file, class_file, weights_file, fasta_file, gff_file, hits_file, genes_file, map_files, pair_files, clusters_file, members_file, graph_files, small_files)
    return {f"io_{f.__name__.removesuffix('_file').removesuffix('_files')}": f for f in io} | {"linalg_solve": solve, "linalg_eigen": eigen, "som_train_k_batch": _sequential(k_batch=0.15), "som_train_local": _sequential(local=3), "stream_windows": stream_windows, "stream_projection": stream_projection}


def oracle_sql():
    from sedimenta.plans import maps, sequences, tables

    cells = ", ".join(f"coalesce(max(CASE WHEN col_num = {k} THEN value END), 0) AS c{k}" for k in range(1, 8))
    t = "t AS (SELECT data_index, min(v) AS v FROM training_vectors WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY data_index)"
    return {
        "io_counts": f"WITH {tables._COUNTS} SELECT row_num AS key, s_name AS name, {cells} FROM c JOIN supplier ON s_suppkey = row_num GROUP BY ALL",
        "io_training": f"WITH {t} SELECT data_index, round(list_sum(v), 6) AS total FROM t",
        "io_names": "SELECT data_index, name, nullif(description, '') AS description FROM seq_names WHERE data_index IS NOT NULL AND name IS NOT NULL",
        "io_best_match": "SELECT data_index AS index, bm_row AS row, bm_col AS col, distance FROM bestmatches WHERE bm_row IS NOT NULL AND bm_col IS NOT NULL",
        "io_class": "SELECT data_index AS index, least(31, floor(d * 10))::INT AS class, least(31, floor(d * 10))::INT::VARCHAR AS name FROM (SELECT data_index, min(distance) AS d FROM bestmatches WHERE distance IS NOT NULL GROUP BY data_index) WHERE floor(d * 10) <> 0",
        "io_weights": f"WITH {maps._BOOK} SELECT neuron, row, col, round(list_sum(w), 5) AS total FROM k",
        "io_fasta": f"WITH {sequences._DNA} SELECT 'doc' || doc_id AS name, length(seq)::INT AS length, md5(seq) AS md5 FROM dna",
        "io_gff": "SELECT feature_no, seqid, feature_type AS type, gff_end - gff_start + 1 AS length, score FROM gff WHERE seqid IS NOT NULL AND gff_start IS NOT NULL AND gff_end IS NOT NULL",
        "io_hits": r"SELECT s_id, count(*) AS n, count(DISTINCT nullif(regexp_extract(q_id, '^\S*'), '')) AS queries, count(bit_score) AS scored, max(bit_score) AS best, count(q_beg) AS placed, min(q_beg) AS first FROM hits GROUP BY s_id",
        "io_genes": f"""WITH {sequences._GENES}, n AS (SELECT seqid, feature_no, row_number() OVER (PARTITION BY seqid ORDER BY feature_no) AS n FROM g), s AS (SELECT seqid, max(end_) AS seqlen, row_number() OVER (ORDER BY seqid) AS seqnum FROM g GROUP BY seqid)
            SELECT feature_no, seqid || '_' || n AS gene, gff_end - gff_start + 1 AS length, 'a;b' AS note, seqlen, CASE WHEN seqnum % 7 = 0 THEN '4' ELSE '11' END AS code FROM n JOIN s USING (seqid) JOIN gff USING (seqid, feature_no)""",
        "io_map": f"""WITH {maps._BEST}, s AS (SELECT max(row) + 1 AS rows FROM k), h AS (SELECT a.neuron, avg(list_distance(a.w, b.w)) AS h FROM k a CROSS JOIN s CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(dr, dc) JOIN k b ON b.row = (a.row + dr + rows) % rows AND b.col = (a.col + dc + 8) % 8 GROUP BY a.neuron),
            u AS (SELECT neuron, round((h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()), 6) AS height FROM h), hit AS (SELECT b.n AS neuron, count(*) AS n FROM best GROUP BY 1)
            SELECT neuron, round(list_sum(w), 5) AS total, height, coalesce(n, 0) AS n FROM k JOIN u USING (neuron) LEFT JOIN hit USING (neuron)""",
        "io_pair": f"WITH {t}, n AS (SELECT data_index, min(name) AS name FROM seq_names WHERE name IS NOT NULL GROUP BY data_index) SELECT data_index, name, round(list_sum(v), 6) AS total FROM t JOIN n USING (data_index)",
        "io_clusters": f"WITH {sequences._HITS} SELECT ['S', 'L', 'H', 'D', 'C', 'N', 'R'][line_no % 7 + 1] AS kind, aln_len::BIGINT AS cluster, count(*) AS n, max(aln_len)::BIGINT AS size, count(DISTINCT q) AS labels FROM h WHERE aln_len IS NOT NULL GROUP BY ALL",
        "io_members": "SELECT o_custkey % 100 AS cluster, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey)::INT AS place FROM orders WHERE o_orderkey % 50 = 0",
        "io_graph": "WITH e AS (SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey AS node, s_name AS name, s_nationkey + 1 AS length, round(s_acctbal, 2) AS coverage, coalesce(n, 0) AS n_edges, round(coalesce(n, 0) * 1.25::DOUBLE, 2) AS score FROM supplier LEFT JOIN e ON node = s_suppkey",
        "io_small": "SELECT 'colours' AS kind, sum(n_nationkey)::BIGINT AS a, sum(length(n_name))::BIGINT AS b FROM nation UNION ALL SELECT 'names', count(DISTINCT regexp_extract(n_name, '^\\S+')), sum(length(regexp_extract(n_name, '^\\S+')))::BIGINT FROM nation UNION ALL SELECT 'samples', count(*), sum(n_nationkey + 7)::BIGINT FROM nation",
        "linalg_solve": "SELECT kind, n::INT AS n, method, true AS is_solved, true AS is_regular, n::INT AS n_rank, true AS is_inverted FROM (VALUES ('hilbert'), ('vandermonde')) k(kind) CROSS JOIN (VALUES (2), (3), (4), (6)) s(n) CROSS JOIN (VALUES ('lu'), ('qr'), ('cholesky')) m(method) WHERE kind = 'hilbert' OR method <> 'cholesky'",
        "stream_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS beg, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events WHERE ts IS NOT NULL GROUP BY ALL",
        "stream_projection": f"WITH {maps._BEST} SELECT b.n AS neuron, count(*) AS n FROM best GROUP BY 1",
    }
