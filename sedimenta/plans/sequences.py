"""Queries on sequences, hits, genes, coverage, clusters, classes and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import sequences as sq
from sedimenta.operators import annotate as an
from sedimenta.operators import classify as cl
from sedimenta.operators import counts as ct
from sedimenta.operators import graph as gr
from sedimenta.session import table

#: Letters of texts as nucleotides: what isn't a letter becomes N. Fixed for these queries.
_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
QUERY = r"^\S*"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq): whole texts of the documents as nucleotides."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return d.select("doc_id", F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", "N"), _FROM, _TO).alias("seq"), "text")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the query's name and its sequence."""
    h = table(spark, sf_dir, "hits").where("q_id IS NOT NULL").withColumn("q", F.regexp_extract("q_id", QUERY, 0))
    return h.withColumn("seqid", F.regexp_replace("q", r"_\d+$", ""))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gff").where("seqid IS NOT NULL AND gff_start IS NOT NULL AND gff_end IS NOT NULL").select("feature_no", "seqid", F.least("gff_start", "gff_end").alias("beg"), F.greatest("gff_start", "gff_end").alias("end"))


# composition -------------------------------------------------------------------------------------------------------
def composition(spark, sf_dir):
    """Base shares, GC content and foreign letters of every text."""
    s = F.col("seq")
    m = dna(spark, sf_dir).select("doc_id", sq.gc_content(s).alias("gc"), sq.mono_nt_freq(s).alias("f"), sq.n_share(s).alias("n"), sq.non_dna(F.col("text")).alias("foreign"), F.length(sq.clean_nt(s)).alias("clean"))
    return m.select("doc_id", F.round("gc", 6).alias("gc"), *[F.round(f"f.{b}", 6).alias(b) for b in "actg"], F.round("n", 6).alias("n"), "foreign", "clean")


def complements(spark, sf_dir):
    """Reverse complements, as checksums."""
    return dna(spark, sf_dir).select("doc_id", F.md5(sq.reverse_complement(F.col("seq"))).alias("md5"))


def two_bit(spark, sf_dir):
    """Round trip of the 2-bit form of part types."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.translate(F.regexp_replace(F.lower("p_type"), "[^a-z]", "a"), _FROM, _TO).alias("seq"))
    packed = p.withColumn("packed", sq.pack_2bit(F.col("seq")))
    return packed.select("p_partkey", "seq", (sq.unpack_2bit(F.col("packed")) == F.col("seq")).alias("same"))


def windows(spark, sf_dir):
    """Windows of 300 letters at steps of 200, at least 50 left, of every text."""
    w = sq.subdivide(dna(spark, sf_dir).withColumn("name", F.col("doc_id").cast("string")), "name", "seq", 300, 200, 50)
    return w.select("name", "n", "beg", "end", "fragment", F.round(sq.gc_content(F.col("seq")), 6).alias("gc"))


def kmers_plain(spark, sf_dir):
    """Canonical 4-mers of all texts, every legal one counted."""
    return sq.kmer_counts(dna(spark, sf_dir), "doc_id", "seq", 4, skip=False).groupBy("kmer").agg(F.sum("n").alias("n"))


def kmers_exact(spark, sf_dir):
    """Canonical 4-mers per text, with the scan moving on by 4 behind an illegal one."""
    return sq.kmer_counts(dna(spark, sf_dir), "doc_id", "seq", 4)


def kmer_shares(spark, sf_dir):
    """Frequencies and relative abundances of canonical 3-mers per text."""
    d = dna(spark, sf_dir)
    f = sq.kmer_frequencies(sq.kmer_counts(d, "doc_id", "seq", 3, skip=False), "doc_id")
    bases = d.select("doc_id", sq.mono_nt_freq(F.col("seq")).alias("m")).select("doc_id", "m.*")
    r = sq.relative_abundance(f, bases, "doc_id")
    return r.groupBy("kmer").agg(F.sum("n").alias("n"), F.round(F.sum("freq"), 5).alias("freq"), F.round(F.sum("relative"), 3).alias("relative"))


def kmer_table(spark, sf_dir):
    """The counts table of 2-mers of all windows of 300 letters at steps of 200."""
    w = sq.subdivide(dna(spark, sf_dir).withColumn("name", F.col("doc_id").cast("string")), "name", "seq", 300, 200, 50)
    return sq.kmer_table(w, ["fragment"], "seq", 2, skip=False)


def kmer_lookup(spark, sf_dir):
    """The table of canonical k-mers for k = 4."""
    return sq.kmer_lookup(spark, 4)


def names(spark, sf_dir):
    """Parts of fragment names, sample and first word."""
    n = table(spark, sf_dir, "seq_names").where("name IS NOT NULL").select("name").distinct()
    p = sq.fragment_parts(F.col("name"))
    return n.select("name", p["parent"].alias("parent"), p["number"].alias("number"), p["beg"].alias("beg"), p["end"].alias("end"), sq.sample_name(F.col("name")).alias("sample"), sq.first_word(F.col("name")).alias("word"))


def base_names(spark, sf_dir):
    """File names without folder and extension."""
    return table(spark, sf_dir, "documents").where("file_path IS NOT NULL").groupBy(sq.base_name(F.col("file_path")).alias("base")).agg(F.count("*").alias("n"))


# hits and genes ----------------------------------------------------------------------------------------------------
def best_hit(spark, sf_dir):
    """Best hit of each query."""
    return an.best_hits(hits(spark, sf_dir), ["q"]).select("q", "line_no", "s_id", "bit_score")


def best_hit_per_subject(spark, sf_dir):
    """Best hit of each query and subject."""
    return an.best_hits(hits(spark, sf_dir), ["q", "s_id"]).select("q", "s_id", "line_no", "bit_score")


def hit_coverage(spark, sf_dir):
    """Share of the subject that hits cover, with a subject's length taken as its highest position."""
    h = hits(spark, sf_dir)
    length = h.groupBy("s_id").agg(F.max(F.greatest("s_beg", "s_end")).alias("s_length"))
    return an.hit_coverage(h, length, "s_id", "s_length").select("line_no", "s_id", F.round("coverage", 6).alias("coverage"))


def profile_lines(spark, sf_dir):
    """Lines of a profile table, written from hits and parsed again."""
    h = hits(spark, sf_dir).where("s_id IS NOT NULL AND eval IS NOT NULL")
    fill = [F.lit("-")] * 12
    line = F.concat_ws("  ", F.col("s_id"), F.lit("-"), F.col("q"), F.lit("-"), F.format_string("%.2e", "eval"), F.coalesce(F.col("aln_len").cast("string"), F.lit("0")), *fill, F.lit("of"), F.lit("some  kind"))
    return h.select("line_no", an.hmm_target(line).alias("t")).select("line_no", "t.target", "t.query", F.col("t.score").alias("score"), "t.description")


def gene_map(spark, sf_dir):
    """Genes per sequence with their first and last position."""
    return an.gene_map(table(spark, sf_dir, "gff"), "seqid", "gff_start", "gff_end")


def gene_totals(spark, sf_dir):
    """Genes, sequences that have some, and kinds of features."""
    return table(spark, sf_dir, "gff").where("seqid IS NOT NULL").agg(F.count("*").alias("n_genes"), F.countDistinct("seqid").alias("n_sequences"), F.countDistinct("feature_type").alias("n_types"))


def numbered_features(spark, sf_dir):
    """Features numbered within their sequence by position."""
    return an.number_features(genes(spark, sf_dir), "seqid", ["beg", "feature_no"]).select("feature_no", "name", (F.col("end") - F.col("beg") + 1).alias("length"))


def nucleotide_hits(spark, sf_dir):
    """Hits of genes in positions of their sequence."""
    starts = an.number_features(genes(spark, sf_dir), "seqid", ["beg", "feature_no"]).select(F.col("name").alias("gene"), "seqid", F.col("beg").alias("start"))
    h = hits(spark, sf_dir).select("line_no", F.col("q").alias("gene"), "q_beg", "q_end")
    return an.to_nucleotides(h, starts).select("line_no", "gene", "nt_beg", "nt_end")


# coverage ----------------------------------------------------------------------------------------------------------
def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seqid, sample, pos, depth): users, event types, minutes of the day and rounded values of the events."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")
    return e.groupBy(F.col("user_id").alias("seqid"), F.col("event_type").alias("sample"), (F.hour("ts") * 60 + F.minute("ts") + 1).cast("long").alias("pos")).agg(F.sum(F.floor(F.abs("value"))).cast("long").alias("depth"))


def _lengths(d):
    return d.select("seqid").distinct().withColumn("length", F.lit(1440))


def coverage(spark, sf_dir):
    """Depth per sequence and sample, 0 where fewer than 1 in 1,000 positions are covered."""
    d = depth(spark, sf_dir)
    return an.covered(d, _lengths(d), 0.001).select("seqid", "sample", "bases", F.round("share", 8).alias("share"))


def coverage_any(spark, sf_dir):
    """Positions covered in any sample that passes."""
    d = depth(spark, sf_dir)
    passing = an.covered(d, _lengths(d), 0.001).where("share >= 0.001")
    return an.covered_by_any(d, passing, _lengths(d)).select("seqid", F.round("share", 8).alias("share"))


def _day_windows(d):
    starts = F.explode(F.sequence(F.lit(0), F.lit(1439), F.lit(240))).alias("b")
    w = d.select("seqid").distinct().select("seqid", starts).where("b + 480 <= 1440 OR 1440 - b > 100")
    return w.select(F.concat_ws("_", "seqid", "b").alias("window"), "seqid", (F.col("b") + 1).alias("beg"), F.least(F.col("b") + 480, F.lit(1440)).alias("end"))


def window_table(spark, sf_dir):
    """Counts table of depths in windows of the day (480 at steps of 240): a column per event type, 0 where it covers too little."""
    d = depth(spark, sf_dir)
    w = _day_windows(d)
    counts, share = an.window_coverage(d, w, 0.004)
    samples = an.sample_names(d.select(F.concat("sample", F.lit("_contig")).alias("label")))
    return an.sample_table(counts, w.select("window"), "window", samples).join(share, "window").withColumn("share", F.round("share", 8))


def gene_depth(spark, sf_dir):
    """Alignment lengths of hits summed over the genes that hold their first position, per sample."""
    h = hits(spark, sf_dir).where("q_beg IS NOT NULL AND aln_len IS NOT NULL")
    d = h.select("seqid", sq.sample_name(F.col("q")).alias("sample"), F.col("q_beg").cast("long").alias("pos"), F.col("aln_len").alias("depth"))
    return an.gene_depth(d, genes(spark, sf_dir).withColumnRenamed("feature_no", "gene"))


# clusters ----------------------------------------------------------------------------------------------------------
_KINDS = ["S", "L", "H", "D", "C", "N", "R"]


def _records(spark, sf_dir):
    """Cluster records made of hits: kind by line number, cluster by alignment length."""
    h = hits(spark, sf_dir).where("aln_len IS NOT NULL")
    pct = F.col("pct_id").cast("string")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("line_no") % 7 + 1).cast("int"))
    return h.select(kind.alias("kind"), F.col("aln_len").alias("cluster"), F.col("aln_len").cast("string").alias("size"), pct.alias("pct_id"), pct.alias("alignment"), F.col("q").alias("label"))


def clusters(spark, sf_dir):
    """Index of clusters from their records."""
    c = an.cluster_index(_records(spark, sf_dir))
    return c.select("cluster", "seed", "seed_length", F.col("is_library").alias("is_library"), "n_members", F.round("avg_id", 4).alias("avg_id"), F.round("mean_pct_id", 4).alias("mean_pct_id"))


def cluster_samples(spark, sf_dir):
    """Members per cluster and sample, in long form, 0 where none."""
    members = an.cluster_of(_records(spark, sf_dir))
    samples = an.sample_names(members)
    wide = an.count_samples(members, samples).select("cluster", *[F.col(f"`{s}`").alias(f"s{k}") for k, s in enumerate(samples)])
    long = ct.to_long(wide, "cluster", [f"s{k}" for k in range(len(samples))])
    named = F.element_at(F.array(*map(F.lit, samples)), F.col("col_num"))
    return long.select("cluster", named.alias("sample"), F.col("value").cast("long").alias("n"))


def cluster_list(spark, sf_dir):
    """Clusters of at least 20 members as lines, largest first."""
    return an.cluster_lines(_records(spark, sf_dir), "size", 20)


def rarefaction(spark, sf_dir):
    """Members and different subjects seen per sample after every 10,000 lines."""
    h = hits(spark, sf_dir).where("s_id IS NOT NULL").select(sq.sample_name(F.col("q")).alias("sample"), F.col("s_id").alias("cluster"), "line_no").where("sample IS NOT NULL")
    return an.rarefaction(h, "line_no", 10_000)


# classes -----------------------------------------------------------------------------------------------------------
def class_table(spark, sf_dir):
    """Sources as classes by size."""
    return cl.class_table(table(spark, sf_dir, "documents"), "source", by_size=True, least=5)


def class_by_name(spark, sf_dir):
    """Samples as classes by name."""
    return cl.class_table(hits(spark, sf_dir).withColumn("sample", sq.sample_name(F.col("q"))), "sample")


def class_by_source(spark, sf_dir):
    """Samples as classes by first appearance."""
    return cl.by_first_appearance(hits(spark, sf_dir).withColumn("sample", sq.sample_name(F.col("q"))), "sample", "line_no")


def class_by_length(spark, sf_dir):
    """Documents per class of length among 64."""
    d = table(spark, sf_dir, "documents").where("n_chars IS NOT NULL")
    ends = d.agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
    return d.crossJoin(F.broadcast(ends)).groupBy(cl.length_bin(F.col("n_chars"), F.col("low"), F.col("high")).alias("class")).agg(F.count("*").alias("n"))


def class_by_coverage(spark, sf_dir):
    """Customers per class of log balance among 32."""
    c = table(spark, sf_dir, "customer").select(F.log(F.abs("c_acctbal") + 1).alias("x"))
    ends = c.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return c.crossJoin(F.broadcast(ends)).groupBy(cl.coverage_bin(F.col("x"), F.col("low"), F.col("high")).alias("class")).agg(F.count("*").alias("n"))


def class_by_hit(spark, sf_dir):
    """Sequences per class of their last hit's subject, classes by size, 0 without a hit."""
    h = hits(spark, sf_dir).where("s_id IS NOT NULL").select("seqid", "line_no", F.col("s_id").alias("subject"))
    last = h.groupBy("seqid").agg(F.max_by("subject", "line_no").alias("name"))
    known = cl.class_table(last, "name", by_size=True).select("name", "class")
    all_seqs = table(spark, sf_dir, "gff").where("seqid IS NOT NULL").select("seqid").distinct()
    got = all_seqs.join(last, "seqid", "left").join(known, "name", "left")
    return got.groupBy(F.coalesce("class", F.lit(0).cast("long")).alias("class")).agg(F.count("*").alias("n"))


def majority(spark, sf_dir):
    """Fragments whose sequence has a different class by majority of bases; classes by the rows of best matches."""
    n = table(spark, sf_dir, "seq_names").where("name IS NOT NULL").groupBy("data_index").agg(F.min("name").alias("name"))
    b = table(spark, sf_dir, "bestmatches").where("bm_row IS NOT NULL").groupBy("data_index").agg(F.min(F.floor(F.col("bm_row") / 21).cast("int")).alias("cls"))
    p = sq.fragment_parts(F.col("name"))
    parts = n.join(b, "data_index").where(p.isNotNull()).select("data_index", p["parent"].alias("parent"), "cls", (p["end"] - p["beg"] + 1).alias("length"))
    return cl.correct_parts(parts, "parent", "cls", "length").select("data_index", "cls", "corrected")


def name_index(spark, sf_dir):
    """Fragments per sequence."""
    return cl.names_index(table(spark, sf_dir, "seq_names").select(F.col("data_index").alias("index"), "name"))


# graphs ------------------------------------------------------------------------------------------------------------
def _tree(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    edges = c.select(F.col("node").alias("a"), F.floor(F.col("node") / 10).alias("b")).where("b > 0")
    return c, gr.keep_known(edges, c)


def components(spark, sf_dir):
    """Components of the graph that links each customer to the tenth of its number."""
    nodes, edges = _tree(spark, sf_dir)
    return gr.connected_components(nodes, edges)


def component_stats(spark, sf_dir):
    """Size, length, weighted coverage and edges of the components, ranked by size."""
    nodes, edges = _tree(spark, sf_dir)
    facts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") + 1).cast("long").alias("length"), F.col("c_acctbal").alias("coverage"))
    members = gr.connected_components(nodes, edges).join(facts, "node")
    return gr.ranked_by_size(gr.component_stats(members, edges)).withColumn("coverage", F.round("coverage", 4))


def orphans(spark, sf_dir):
    """Customers in no urgent order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("a"), F.lit(None).cast("long").alias("b"))
    return gr.orphans(c, o)


def degrees(spark, sf_dir):
    """Edges and neighbours of suppliers and parts, as linked by line items."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    return gr.degrees(li)


def queries():
    groups = {
        "seq": (composition, complements, two_bit, windows, kmers_plain, kmers_exact, kmer_shares, kmer_table, kmer_lookup, names, base_names),
        "hits": (best_hit, best_hit_per_subject, hit_coverage, profile_lines), "genes": (gene_map, gene_totals, numbered_features, nucleotide_hits),
        "coverage": (coverage, coverage_any, window_table, gene_depth), "clusters": (clusters, cluster_list, cluster_samples, rarefaction),
        "classes": (class_table, class_by_name, class_by_source, class_by_length, class_by_coverage, class_by_hit, majority, name_index), "graph": (components, component_stats, orphans, degrees),
    }
    return {f"{g}_{f.__name__.removeprefix('class_')}": f for g, fs in groups.items() for f in fs}


_DNA = f"dna AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', 'N', 'g'), '{_FROM}', '{_TO}') AS seq, text FROM documents WHERE length(text) > 0)"
_HITS = r"h AS (SELECT *, regexp_extract(q_id, '^\S*') AS q, regexp_replace(regexp_extract(q_id, '^\S*'), '_\d+$', '') AS seqid, nullif(regexp_extract(q_id, '^(\S+?)_(?:scaffold|contig)', 1), '') AS sample FROM hits WHERE q_id IS NOT NULL)"
_GENES = "g AS (SELECT feature_no, seqid, least(gff_start, gff_end) AS beg, greatest(gff_start, gff_end) AS end_ FROM gff WHERE seqid IS NOT NULL AND gff_start IS NOT NULL AND gff_end IS NOT NULL), f AS (SELECT *, seqid || '_' || row_number() OVER (PARTITION BY seqid ORDER BY beg, feature_no) AS name FROM g)"
_DEPTH = "d AS (SELECT user_id AS seqid, event_type AS sample, (hour(ts) * 60 + minute(ts) + 1)::BIGINT AS pos, sum(floor(abs(value)))::BIGINT AS depth FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL)"
_COVER = f"{_DEPTH}, c AS (SELECT seqid, sample, sum(depth)::BIGINT AS bases, count(CASE WHEN depth > 0 THEN 1 END) / 1440.0::DOUBLE AS share FROM d GROUP BY ALL)"
_EVENTS = ", ".join(f"coalesce(max(CASE WHEN sample = '{e}' AND passes THEN bases END), 0)::BIGINT AS {e}" for e in ("click", "error", "purchase", "signup", "view"))
_CANON = "CASE WHEN translate(reverse(translate(m, 'ACTG', 'TGAC')), 'ATCG', '0123') < translate(m, 'ATCG', '0123') THEN reverse(translate(m, 'ACTG', 'TGAC')) ELSE m END"


def _mers(k):
    return f"{_DNA}, p AS (SELECT doc_id, substr(seq, i::BIGINT, {k}) AS m FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM dna)), l AS (SELECT doc_id, {_CANON} AS kmer FROM p WHERE regexp_full_match(m, '[ACGT]{{{k}}}'))"


def oracle_sql():
    share = lambda b: f"round((length(seq) - length(replace(seq, '{b}', ''))) / length(seq)::DOUBLE, 6)"
    gc = lambda s: f"round(length(regexp_replace({s}, '[^GC]', '', 'g')) / nullif(length(regexp_replace({s}, '[^ACGT]', '', 'g')), 0)::DOUBLE, 6)"
    part = r"regexp_full_match(name, '[!-~]+_\d+\s+\d+-\d+')"
    rx = r"'^([!-~]+)_(\d+)\s+(\d+)-(\d+)$'"
    pick = lambda k: f"CASE WHEN {part} THEN regexp_extract(name, {rx}, {k}) END"
    records = f"{_HITS}, r AS (SELECT ['S', 'L', 'H', 'D', 'C', 'N', 'R'][line_no % 7 + 1] AS kind, aln_len AS cluster, pct_id, q AS label, sample FROM h WHERE aln_len IS NOT NULL)"
    tree = "e AS (SELECT c_custkey AS a, c_custkey // 10 AS b FROM customer WHERE c_custkey // 10 > 0 AND c_custkey // 10 IN (SELECT c_custkey FROM customer)), m AS (SELECT c_custkey AS node, (c_custkey // pow(10, length(c_custkey::VARCHAR) - 1)::BIGINT)::BIGINT AS component, c_nationkey + 1 AS length, c_acctbal AS coverage FROM customer WHERE c_custkey > 0 UNION ALL SELECT c_custkey, c_custkey, c_nationkey + 1, c_acctbal FROM customer WHERE c_custkey = 0)"
    return {
        "seq_composition": f"WITH {_DNA} SELECT doc_id, {gc('seq')} AS gc, {share('A')} AS a, {share('C')} AS c, {share('T')} AS t, {share('G')} AS g, {share('N')} AS n, length(regexp_replace(text, '[AaCcGgTtRrYySsWwKkMmBbDdHhVvNn.-]', '', 'g'))::INT AS \"foreign\", length(regexp_replace(seq, '[^ACGT]', '', 'g'))::INT AS clean FROM dna",
        "seq_complements": f"WITH {_DNA} SELECT doc_id, md5(reverse(translate(seq, 'ACTG', 'TGAC'))) AS md5 FROM dna",
        "seq_two_bit": f"SELECT p_partkey, translate(regexp_replace(lower(p_type), '[^a-z]', 'a', 'g'), '{_FROM}', '{_TO}') AS seq, true AS same FROM part",
        "seq_windows": f"""WITH {_DNA}, b AS (SELECT doc_id, seq, length(seq) AS l, unnest(range(0, length(seq), 200)) AS b FROM dna WHERE length(seq) >= 350), w AS (SELECT doc_id::VARCHAR AS name, (b // 200 + 1)::INT AS n, (b + 1)::INT AS beg, least(b + 300, l)::INT AS end_, seq FROM b WHERE b + 300 <= l OR l - b > 50)
            SELECT name, n, beg, end_ AS "end", name || '_' || n || ' ' || beg || '-' || end_ AS fragment, {gc('seq[beg:end_]')} AS gc FROM w""",
        "seq_kmers_plain": f"WITH {_mers(4)} SELECT kmer, count(*) AS n FROM l GROUP BY kmer",
        "seq_kmers_exact": f"""WITH {_DNA}, r AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(seq, '([ACGT]{{4,}}).?|.{{4}}', 1), lambda x: x <> '')) AS run FROM dna),
            p AS (SELECT doc_id, substr(run, i::BIGINT, 4) AS m FROM (SELECT doc_id, run, unnest(range(1, length(run) - 2)) AS i FROM r)) SELECT doc_id, {_CANON} AS kmer, count(*) AS n FROM p GROUP BY ALL""",
        "seq_kmer_lookup": f"""WITH b AS (SELECT unnest(['A', 'T', 'C', 'G']) AS b), p AS (SELECT x.b || y.b || z.b || w.b AS m FROM b x CROSS JOIN b y CROSS JOIN b z CROSS JOIN b w), c AS (SELECT m AS kmer, {_CANON} AS canonical FROM p)
            SELECT kmer, canonical, (dense_rank() OVER (ORDER BY translate(canonical, 'ATCG', '0123')) - 1)::INT AS kmer_id FROM c""",
        "seq_kmer_table": f"""WITH {_DNA}, b AS (SELECT doc_id, seq, length(seq) AS l, unnest(range(0, length(seq), 200)) AS b FROM dna WHERE length(seq) >= 350), w AS (SELECT doc_id || '_' || (b // 200 + 1) || ' ' || (b + 1) || '-' || least(b + 300, l) AS fragment, seq[b + 1:least(b + 300, l)] AS s FROM b WHERE b + 300 <= l OR l - b > 50),
            p AS (SELECT fragment, substr(s, i::BIGINT, 2) AS m FROM (SELECT fragment, s, unnest(range(1, length(s))) AS i FROM w)), k AS (SELECT fragment, CASE WHEN regexp_full_match(m, '[ACGT]{{2}}') THEN {_CANON} END AS kmer FROM p)
            SELECT fragment, {", ".join(f"count(CASE WHEN kmer = '{m}' THEN 1 END) AS {m}" for m in ("AA", "AT", "AC", "AG", "TA", "TC", "TG", "CC", "CG", "GC"))} FROM k GROUP BY fragment""",
        "seq_kmer_shares": f"""WITH {_mers(3)}, c AS (SELECT doc_id, kmer, count(*) AS n FROM l GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS freq FROM c),
            s AS (SELECT doc_id, (length(seq) - length(replace(seq, 'A', ''))) / length(seq)::DOUBLE AS a, (length(seq) - length(replace(seq, 'C', ''))) / length(seq)::DOUBLE AS c, (length(seq) - length(replace(seq, 'T', ''))) / length(seq)::DOUBLE AS t, (length(seq) - length(replace(seq, 'G', ''))) / length(seq)::DOUBLE AS g FROM dna),
            e AS (SELECT f.*, list_reduce(list_transform(string_split(kmer, ''), lambda x: CASE x WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'T' THEN t ELSE g END), lambda x, y: x * y) AS e FROM f JOIN s USING (doc_id))
            SELECT kmer, sum(n)::BIGINT AS n, round(sum(freq), 5) AS freq, round(sum(coalesce(freq / nullif(e, 0), 0)), 3) AS relative FROM e GROUP BY kmer""",
        "seq_names": f"SELECT DISTINCT name, {pick(1)} AS parent, ({pick(2)})::INT AS number, ({pick(3)})::BIGINT AS beg, ({pick(4)})::BIGINT AS \"end\", nullif(regexp_extract(name, '^(.+?)_(?:scaffold|contig)', 1), '') AS sample, regexp_extract(name, '^\\s*(\\S+)', 1) AS word FROM seq_names WHERE name IS NOT NULL",
        "seq_base_names": r"SELECT regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]*$', '') AS base, count(*) AS n FROM documents WHERE file_path IS NOT NULL GROUP BY 1",
        "hits_best_hit": f"WITH {_HITS} SELECT q, line_no, s_id, bit_score FROM h WHERE bit_score IS NOT NULL AND NOT isnan(bit_score) QUALIFY row_number() OVER (PARTITION BY q ORDER BY bit_score DESC, line_no) = 1",
        "hits_best_hit_per_subject": f"WITH {_HITS} SELECT q, s_id, line_no, bit_score FROM h WHERE s_id IS NOT NULL AND bit_score IS NOT NULL AND NOT isnan(bit_score) QUALIFY row_number() OVER (PARTITION BY q, s_id ORDER BY bit_score DESC, line_no) = 1",
        "hits_hit_coverage": f"WITH {_HITS} SELECT line_no, s_id, round(aln_len / nullif(max(greatest(s_beg, s_end)) OVER (PARTITION BY s_id), 0)::DOUBLE, 6) AS coverage FROM h WHERE s_id IS NOT NULL",
        "hits_profile_lines": f"WITH {_HITS} SELECT line_no, s_id AS target, q AS query, coalesce(aln_len, 0)::DOUBLE AS score, 'of some kind' AS description FROM h WHERE s_id IS NOT NULL AND eval IS NOT NULL",
        "genes_gene_map": f"WITH {_GENES} SELECT seqid, count(*) AS n_genes, min(beg) AS first, max(end_) AS last FROM g GROUP BY seqid",
        "genes_gene_totals": "SELECT count(*) AS n_genes, count(DISTINCT seqid) AS n_sequences, count(DISTINCT feature_type) AS n_types FROM gff WHERE seqid IS NOT NULL",
        "genes_numbered_features": f"WITH {_GENES} SELECT feature_no, name, end_ - beg + 1 AS length FROM f",
        "genes_nucleotide_hits": f"WITH {_GENES}, {_HITS} SELECT line_no, name AS gene, beg + 3 * q_beg AS nt_beg, beg + 3 * q_end AS nt_end FROM h JOIN f ON f.name = h.q",
        "coverage_coverage": f"WITH {_COVER} SELECT seqid, sample, CASE WHEN share >= 0.001 THEN bases ELSE 0 END AS bases, round(share, 8) AS share FROM c",
        "coverage_coverage_any": f"WITH {_COVER} SELECT d.seqid, round(count(DISTINCT pos) / 1440.0::DOUBLE, 8) AS share FROM d JOIN c ON c.seqid = d.seqid AND c.sample IS NOT DISTINCT FROM d.sample WHERE share >= 0.001 AND depth > 0 AND c.sample IS NOT NULL GROUP BY d.seqid",
        "coverage_gene_depth": f"WITH {_GENES}, {_HITS} SELECT feature_no AS gene, sample, sum(aln_len)::BIGINT AS bases FROM h JOIN g ON g.seqid = h.seqid AND q_beg BETWEEN beg AND end_ WHERE aln_len IS NOT NULL GROUP BY ALL",
        "coverage_window_table": f"""WITH {_DEPTH}, s AS (SELECT DISTINCT seqid FROM d), w AS (SELECT seqid || '_' || b AS window_, seqid, b + 1 AS beg, least(b + 480, 1440) AS end_ FROM s CROSS JOIN range(0, 1440, 240) t(b) WHERE b + 480 <= 1440 OR 1440 - b > 100),
            i AS (SELECT window_, sample, pos, sum(depth) AS depth, any_value(end_ - beg + 1) AS size FROM w JOIN d ON d.seqid = w.seqid AND pos BETWEEN beg AND end_ WHERE depth > 0 GROUP BY ALL),
            p AS (SELECT window_, sample, sum(depth) AS bases, count(*) / any_value(size)::DOUBLE >= 0.004 AS passes FROM i GROUP BY ALL), y AS (SELECT window_, count(DISTINCT pos) AS n FROM i JOIN p USING (window_, sample) WHERE passes GROUP BY window_)
            SELECT w.window_ AS "window", {_EVENTS}, round(coalesce(any_value(y.n), 0) / any_value(end_ - beg + 1)::DOUBLE, 8) AS share FROM w LEFT JOIN p ON p.window_ = w.window_ LEFT JOIN y ON y.window_ = w.window_ GROUP BY w.window_""",
        "clusters_cluster_list": f"""WITH {records}, c AS (SELECT cluster, max(CASE WHEN kind IN ('S', 'L') THEN label END) AS seed, count(CASE WHEN kind IN ('S', 'H', 'N', 'R') THEN 1 END) AS n_members, max(CASE WHEN kind IN ('C', 'D') THEN pct_id END) AS a FROM r GROUP BY cluster)
            SELECT row_number() OVER (ORDER BY n_members DESC, cluster) AS rank, cluster, n_members, cluster || chr(9) || coalesce(seed, '') || chr(9) || n_members || chr(9) || coalesce(printf('%.1f', a), '*') AS line FROM c WHERE n_members >= 20""",
        "clusters_clusters": f"""WITH {records} SELECT cluster, max(CASE WHEN kind IN ('S', 'L') THEN label END) AS seed, max(CASE WHEN kind = 'S' THEN cluster END)::BIGINT AS seed_length, max(kind = 'L') AS is_library, count(CASE WHEN kind IN ('S', 'H', 'N', 'R') THEN 1 END) AS n_members,
            round(max(CASE WHEN kind IN ('C', 'D') THEN pct_id END), 4) AS avg_id, round(avg(CASE WHEN kind IN ('H', 'N', 'R') THEN pct_id END), 4) AS mean_pct_id FROM r GROUP BY cluster""",
        "clusters_cluster_samples": f"WITH {records}, m AS (SELECT cluster, sample FROM r WHERE kind IN ('S', 'H', 'N', 'R') AND sample IS NOT NULL) SELECT c.cluster, s.sample, count(m.cluster) AS n FROM (SELECT DISTINCT cluster FROM m) c CROSS JOIN (SELECT DISTINCT sample FROM m) s LEFT JOIN m ON m.cluster = c.cluster AND m.sample = s.sample GROUP BY ALL",
        "clusters_rarefaction": f"""WITH {_HITS}, o AS (SELECT sample, s_id, ceil(line_no / 10000.0)::BIGINT AS block, line_no = min(line_no) OVER (PARTITION BY sample, s_id) AS fresh FROM h WHERE sample IS NOT NULL AND s_id IS NOT NULL), b AS (SELECT sample, block, count(*) AS n, count(CASE WHEN fresh THEN 1 END) AS k FROM o GROUP BY ALL)
            SELECT sample, block, (sum(n) OVER w)::BIGINT AS n_members, (sum(k) OVER w)::BIGINT AS n_clusters FROM b WINDOW w AS (PARTITION BY sample ORDER BY block)""",
        "classes_table": "SELECT source AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS class FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 5",
        "classes_by_name": f"WITH {_HITS} SELECT sample AS name, count(*) AS n, row_number() OVER (ORDER BY sample) AS class FROM h WHERE sample IS NOT NULL GROUP BY sample",
        "classes_by_source": f"WITH {_HITS} SELECT sample AS name, row_number() OVER (ORDER BY min(line_no)) AS class FROM h WHERE sample IS NOT NULL GROUP BY sample",
        "classes_by_length": "WITH e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents), p AS (SELECT list_transform(range(0, 64), lambda i: lo + i * (hi - lo) // 64) AS p FROM e) SELECT CASE WHEN n_chars > p[64] THEN 64 ELSE len(list_filter(p, lambda x: x < n_chars)) END::INT AS class, count(*) AS n FROM documents CROSS JOIN p WHERE n_chars IS NOT NULL GROUP BY 1",
        "classes_by_coverage": "WITH c AS (SELECT ln(abs(c_acctbal) + 1) AS x FROM customer), e AS (SELECT min(x) AS lo, max(x) AS hi FROM c) SELECT floor(31 * (x - lo) / (hi - lo))::INT AS class, count(*) AS n FROM c CROSS JOIN e GROUP BY 1",
        "classes_by_hit": f"""WITH {_HITS}, l AS (SELECT seqid, arg_max(s_id, line_no) AS name FROM h WHERE s_id IS NOT NULL GROUP BY seqid), k AS (SELECT name, row_number() OVER (ORDER BY count(*) DESC, name) AS class FROM l GROUP BY name)
            SELECT coalesce(class, 0) AS class, count(*) AS n FROM (SELECT DISTINCT seqid FROM gff WHERE seqid IS NOT NULL) LEFT JOIN l USING (seqid) LEFT JOIN k USING (name) GROUP BY 1""",
        "classes_majority": f"""WITH n AS (SELECT data_index, min(name) AS name FROM seq_names WHERE name IS NOT NULL GROUP BY data_index), b AS (SELECT data_index, min(bm_row // 21)::INT AS cls FROM bestmatches WHERE bm_row IS NOT NULL GROUP BY data_index),
            p AS (SELECT data_index, cls, {pick(1)} AS parent, ({pick(4)})::BIGINT - ({pick(3)})::BIGINT + 1 AS length FROM n JOIN b USING (data_index) WHERE {part}), s AS (SELECT parent, cls, sum(length) AS bases FROM p GROUP BY ALL), w AS (SELECT parent, cls AS winner FROM s QUALIFY row_number() OVER (PARTITION BY parent ORDER BY bases DESC, cls) = 1)
            SELECT data_index, cls, CASE WHEN winner <> 0 THEN winner ELSE cls END AS corrected FROM p JOIN w USING (parent)""",
        "classes_name_index": f"WITH p AS (SELECT data_index, {part} AS is_part, CASE WHEN {part} THEN {pick(1)} ELSE regexp_extract(name, '^\\s*(\\S+)', 1) END AS parent FROM seq_names WHERE name IS NOT NULL) SELECT parent, CASE WHEN max(is_part) THEN count(DISTINCT CASE WHEN is_part THEN data_index END) ELSE 1 END AS n, max(data_index) AS last_index FROM p GROUP BY parent",
        "graph_components": f"WITH {tree} SELECT node, component FROM m",
        "graph_component_stats": f"WITH {tree}, s AS (SELECT component, count(*) AS n_nodes, sum(length)::BIGINT AS length, round(sum(coverage * length) / sum(length), 4) AS coverage FROM m GROUP BY component), k AS (SELECT component, count(*) AS n_edges FROM e JOIN m ON m.node = e.a GROUP BY component) SELECT s.*, coalesce(n_edges, 0) AS n_edges, row_number() OVER (ORDER BY n_nodes DESC, component) AS rank FROM s LEFT JOIN k USING (component)",
        "graph_orphans": "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')",
        "graph_degrees": "WITH e AS (SELECT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem) SELECT a AS node, count(*) AS n_out, 0::BIGINT AS n_in, count(*) AS degree, count(DISTINCT b) AS neighbours FROM e GROUP BY a UNION ALL SELECT b, 0, count(*), count(*), count(DISTINCT a) FROM e GROUP BY b",
    }
