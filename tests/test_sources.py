import pytest
from pyspark.sql import functions as F

from sedimenta.sources import readers


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_counts_and_header_errors(spark, tmp_path):
    path = put(tmp_path, "t", "# note\n% 2\n%2\n%9\t0\t1\t1\n% Key\tName\tA\tB\n\n1\tx\t2.5\t\r\n2\ty\t-1\t4e2\n")
    rows = readers.counts_table(spark, path).orderBy("key").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 2.5, None), (2, "y", -1.0, 400.0)]
    with pytest.raises(ValueError):
        readers.counts_header(spark, put(tmp_path, "u", "% 1\n"))


def test_training_matrix_and_class_files(spark, tmp_path):
    lrn = put(tmp_path, "a.lrn", "% 2\n% 4\n% 9\t1\t0\t1\n% k\ta\tb\tc\n5\t1\tx\t2\n6\t3\ty\t4\n")
    assert [(r["index"], r.v) for r in readers.training(spark, lrn).orderBy("index").collect()] == [(5, [1.0, 2.0]), (6, [3.0, 4.0])]
    wts = put(tmp_path, "a.wts", "% 2 2\n% 1\n" + "\n".join("0.5 1 2 3".split()) + "\n")
    assert [(r.neuron, r.row, r.col, r.w) for r in readers.weights(spark, wts).orderBy("neuron").collect()] == [(0, 0, 0, [0.5]), (1, 0, 1, [1.0]), (2, 1, 0, [2.0]), (3, 1, 1, [3.0])]
    cls = put(tmp_path, "a.cls", "%3\n%0\tNONE\t255\t255\t255\n%2\tred\t255\t0\t0\n1\t2\n2\t0\n3\t2\n")
    assert [tuple(r) for r in readers.classes(spark, cls).orderBy("index").collect()] == [(1, 2), (3, 2)]
    assert {tuple(r) for r in readers.class_names(spark, cls).collect()} == {(0, "NONE", 255, 255, 255), (2, "red", 255, 0, 0)}
    bm = put(tmp_path, "a.bm", "% 2 2\n% 1\n7\t1\t0\n")
    assert [tuple(r) for r in readers.best_matches(spark, bm).collect()] == [(7, 1, 0, None)]
    assert [tuple(r) for r in readers.names(spark, put(tmp_path, "a.names", "% 1\n1\tn 1-2\tsome text\n")).collect()] == [(1, "n 1-2", "some text")]
    assert [tuple(r) for r in readers.colours(spark, put(tmp_path, "a.rgb", "  0 128 255\n255   0   0\n")).orderBy("at").collect()] == [(0, 0, 128, 255), (1, 255, 0, 0)]


def test_more_classes_than_a_header_has_lines(spark, tmp_path):
    n = readers.HEADER_MAX + 50
    cls = put(tmp_path, "many.cls", f"%{n}\n" + "".join(f"%{k}\tclass {k}\t1\t2\t{k % 256}\r\n" for k in range(n)) + "".join(f"{k}\t{k}\n" for k in range(n)))
    assert {tuple(r) for r in readers.class_names(spark, cls).collect()} == {(k, f"class {k}", 1, 2, k % 256) for k in range(n)}
    assert readers.classes(spark, cls).join(readers.class_names(spark, cls), "class").count() == n - 1
    assert len(readers.header(spark, put(tmp_path, "full", "% x\n" * readers.HEADER_MAX))) == readers.HEADER_MAX
    with pytest.raises(ValueError):
        readers.header(spark, put(tmp_path, "over", "% x\n" * (readers.HEADER_MAX + 1)))


def test_every_hit_comes_back(spark, tmp_path):
    from sedimenta.plans import files
    from sedimenta.sources import writers

    types = "q_id string, s_id string, pct_id double, aln_len int, mistmatches int, gap_open int, q_beg int, q_end int, s_beg int, s_end int, eval double, bit_score double"
    rest = (90.5, 10, 1, 0, 3, 12, 4, 13, 1e-5)
    hits = [("a", "x", *rest, 50.0), ("b\tgc=0.2", "x", *rest, 60.0), ("c  [partial]", "x", *rest, None), (None, "x", *rest[:4], None, *rest[5:], 70.0), ("d", "y", *[None] * 9, float("nan")), ("e", None, *rest, 1.0)]
    df = spark.createDataFrame(hits, types)
    writers.write_hits(df, f"{tmp_path}/blast")
    got = {r.q_id: tuple(r)[1:] for r in readers.blast(spark, f"{tmp_path}/blast").collect()}
    assert set(got) == {"a", "b", "c", "", "d", "e"} and got["b"] == hits[1][1:] and got["c"] == hits[2][1:] and got[""] == hits[3][1:]
    assert got["d"][:10] == hits[4][1:11] and got["d"][10] != got["d"][10] and got["e"] == ("", *rest, 1.0)
    df.write.parquet(f"{tmp_path}/hits.parquet")
    told = {r.s_id: tuple(r)[1:] for r in files.hits_file(spark, str(tmp_path)).collect()}
    assert told["x"] == (4, 3, 3, 70.0, 3, 3) and told[None] == (1, 1, 1, 1.0, 1, 3) and told["y"][0] == 1 and set(told) == {"x", "y", None}


def test_sequence_files(spark, tmp_path):
    fa = put(tmp_path, "s.fa", ">a first\nACGT\nAC\n>b\n\nGG\r\nTT\n")
    assert {(r.name, r.seq, r.length) for r in readers.fasta(spark, fa).collect()} == {("a", "ACGTAC", 6), ("b", "GGTT", 4)}
    gff = put(tmp_path, "s.gff", '##gff-version 3\n# Sequence Data: seqnum=1;seqlen=10;seqhdr="a x"\na\tp\tCDS\t3\t8\t1.5\t+\t0\tID=1_1;partial=00;\nb\tp\tCDS\t1\t2\t.\t-\t0\tID=2_1\n')
    rows = readers.gff(spark, gff).orderBy("seqid").collect()
    assert rows[0].length == 6 and rows[0].attributes == {"ID": "1_1", "partial": "00"} and rows[1].score is None
    assert readers.gff_sequences(spark, gff).first()["values"]["seqhdr"] == "a x"
    uc = put(tmp_path, "c.uc", "S\t0\t100\t*\t.\t*\t*\t*\tx_scaffold_1\t*\nH\t0\t90\t98.5\t+\t0\t0\t90M\ty_contig_2\tx_scaffold_1\nC\t0\t2\t98.5\t*\t*\t*\t*\tx_scaffold_1\t*\n")
    from sedimenta.operators.annotate import cluster_index, count_samples, cluster_of

    c = cluster_index(readers.clusters(spark, uc)).first()
    assert (c.seed, c.seed_length, c.n_members, c.avg_id, c.is_library) == ("x_scaffold_1", 100, 2, 98.5, False)
    assert count_samples(cluster_of(readers.clusters(spark, uc))).first().asDict() == {"cluster": 0, "x": 1, "y": 1}
    assert [tuple(r) for r in readers.otu_map(spark, put(tmp_path, "o", "c1\ta\tb\nbad\n")).collect()] == [("c1", 0, "a"), ("c1", 1, "b")]
    hmm = put(tmp_path, "h", "# c\nT1 - Q1 - 1e-5 33.5 0 0 0 0 0 0 0 0 0 0 0 0 a long  name\n")
    assert tuple(readers.hmm_table(spark, hmm).first()) == ("T1", "Q1", 1e-5, 33.5, "a long name")
    assert [r.name for r in readers.include_list(spark, put(tmp_path, "i", "n1 rest\n\nn2\n")).collect()] == ["n1", "n2"]
    assert [tuple(r) for r in readers.sample_counts(spark, put(tmp_path, "n", "s1 20\nbad\n")).collect()] == [("s1", 20)]
    assert readers.graph_nodes(spark, put(tmp_path, "gn", "a\ts\t10\t2.5\t3\n")).first().coverage == 2.5
    assert readers.graph_edges(spark, put(tmp_path, "ge", "a\tb\tk\t3\t0.5\t1.5\n")).first().ratio == 0.5


def test_key_values(spark):
    cases = {"a=1;b=\"x;y=2\";;a=3; c = d e ;flag": {"a": "1", "b": "x;y=2", "c": "d e", "flag": None}, "": {}, ";ID=10;": {"ID": "10"}, 'q="open;r=1': {"q": '"open', "r": "1"}}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.m for r in df.select("s", readers.key_values(F.col("s")).alias("m")).collect()} == cases


def test_gene_finder_files(spark, tmp_path):
    text = [
        "##gff-version 3", '# Sequence Data: seqnum=2;seqlen=900;seqhdr="s_2 second; one"', "# Model Data: version=1;transl_table=4",
        "s_2\tfinder\tCDS\t1\t90\t5.5\t+\t0\t;ID=2_1;partial=00", "s_2\tfinder\tCDS\t100\t190\t.\t-\t0\t;ID=2_2;ID=again",
        '# Sequence Data: seqnum=1;seqlen=50;seqhdr="s_1"', "# Model Data: version=1;transl_table=11",
    ]
    path = tmp_path / "genes.gff"
    path.write_text("\n".join(text) + "\n")
    got = sorted(readers.gene_finder(spark, str(path)).collect(), key=lambda r: r.gene)
    assert [(r.gene, r.n, r.length, r.attributes["ID"], r["sequence"]["seqlen"], r["sequence"]["transl_table"]) for r in got] == [("s_2_1", 1, 90, "2_1", "900", "4"), ("s_2_2", 2, 91, "2_2", "900", "4")]
    seqs = readers.gff_sequences(spark, str(path))
    assert [(r.seqid, r["values"]["seqhdr"]) for r in seqs.orderBy("at").collect()] == [("s_2", "s_2 second; one"), ("s_1", "s_1")]
    assert [tuple(r) for r in readers.other_code(seqs).collect()] == [(1, "s_2", "s_2 second; one")]


def test_files_are_read_by_their_ending(spark, tmp_path):
    (tmp_path / "x.bm").write_text("% 2 2\n% 1\n7\t0\t1\t0.5\n")
    assert tuple(readers.typed(spark, str(tmp_path / "x.bm")).first()) == (7, 0, 1, 0.5)
    with pytest.raises(ValueError):
        readers.typed(spark, str(tmp_path / "x.doc"))
