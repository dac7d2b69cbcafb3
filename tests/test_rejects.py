import pytest

from sedimenta.operators import rejects
from sedimenta.operators.rejects import load_counts, rejected_lines

SCHEMA = "file_id string, line_no long, line string, read_at string, key string"
HEAD = ["% 9", "%2", "% 9\t0\t0\t1\t1", "%Key\tName\tLENGTH\tA.x\tB.x"]
CASES = [
    ("1\tn\t100\t2.5\t3", None),
    (' 2 \t"a\tb"\t +7 \t"1e3"\t\r', None),
    ('3\t"say ""hi"""\t\t-.5E+2\t 4. ', None),
    ("4\tn\t100\t2.5", ["field_count"]),
    ("5\tn\t100\t2.5\t3\t", ["field_count"]),
    ('6\t"open\t100\t2.5\t3', ["bad_quoting"]),
    ('7\t"x" y\t100\t2.5\t3', ["bad_quoting"]),
    ('8\tx"y\t100\t2.5\t3', ["bad_quoting"]),
    ("9\tn\t100\tNaN\t3", ["bad_number"]),
    ("10\tn\t100\t١٢\t3", ["bad_number"]),
    ("11\tn\t100\t0x1F\t1,5", ["bad_number"]),
    ("12\tn\t100\t 5 \t3", None),
    ("-1\tn\t100\t1\t3", ["bad_key"]),
    ("\tn\t100\t1\t3", ["bad_key"]),
    ("1.5\tn\t0\tx\t3", ["bad_key", "bad_length", "bad_number"]),
    ("16\tn\t12.5\t1\t3", ["bad_length"]),
    ("17\t\t\t\t", None),
    ("18\tn\t100\t1d\t3f", ["bad_number"]),
]


def rows(file="f", first=5):
    head = [(file, k + 1, h, "t", "clash") for k, h in enumerate(HEAD)]
    return head + [(file, first + k, line, "t", "clash") for k, (line, _) in enumerate(CASES)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_reasons_and_clean_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(rejects, "BROADCAST_MAX_BYTES", limit)  # at 0 lines meet their rules through salts
    extra = [("f", 90, "# comment", "", ""), ("f", 91, "", "", ""), ("f", 92, "  \t ", "", ""), ("f", 93, None, "", ""), (None, 1, "x", "", ""), ("f", None, "x", "", "")]
    again = [rows()[7], rows()[10], rows()[0]]  # delivered twice
    clean, rejected = load_counts(spark.createDataFrame([*rows(), *extra, *again], SCHEMA).repartition(5))
    got = {r.line_no: r.reasons for r in rejected.collect()}
    assert got == {5 + k: why for k, (_, why) in enumerate(CASES) if why}
    ok = {r.line_no: r for r in clean.collect()}
    assert set(ok) == {5 + k for k, (_, why) in enumerate(CASES) if not why}
    assert ok[6].key == 2 and ok[6]["info"] == {"name": "a\tb", "length": "+7"} and ok[6]["data"] == {"a.x": 1000.0, "b.x": None}
    assert ok[7]["info"]["name"] == 'say "hi"' and ok[7]["data"] == {"a.x": -50.0, "b.x": 4.0}
    assert ok[16]["data"] == {"a.x": 5.0, "b.x": 3.0}


def test_files_have_their_own_rules(spark):
    other = [("g", 2, "% 1", "", ""), ("g", 3, "% 1", "", ""), ("g", 4, "% 1\t9", "", ""), ("g", 6, "% v\tkey", "", ""), ("g", 7, "7\t1", "", ""), ("g", 8, "1\t7.5", "", ""), ("h", 1, "1\t2", "", "")]
    got = {(r.file_id, r.line_no): r.reasons for r in rejected_lines(spark.createDataFrame([*rows(), *other], SCHEMA)).collect() if r.file_id != "f"}
    assert got == {("g", 8): ["bad_key"], ("h", 1): ["no_header"]}


def test_long_lines_and_empty_tables(spark):
    long = "1\t" + '"' + 'a""\t' * 60_000 + '"' + "\t5\t1\t2"
    wide = "2\t" + "b" * 300_000 + "\t5\t1\t2"
    df = spark.createDataFrame([*rows()[:4], ("f", 50, long, "", ""), ("f", 51, wide, "", ""), ("f", 52, long[:-20], "", "")], SCHEMA)
    clean, rejected = load_counts(df)
    assert {r.line_no for r in clean.collect()} == {50, 51}
    assert {r.line_no: r.reasons for r in rejected.collect()} == {52: ["bad_quoting"]}
    clean, rejected = load_counts(df.limit(0))
    assert clean.collect() == [] and rejected.collect() == []


@pytest.mark.parametrize("names", ["% Key\tName\tName\tA.x\tA.x", "% Key"])
def test_damaged_names_keep_rows(spark, names):
    df = spark.createDataFrame([*rows()[:3], ("f", 4, names, "", ""), ("f", 9, "1\tn\t5\t1\t2", "", "")], SCHEMA)
    clean, rejected = load_counts(df)
    assert rejected.collect() == []
    if "A.x" in names:
        assert clean.first()["data"] == {"a.x": 1.0, "a.x#5": 2.0}


def test_every_body_line_is_loaded_or_rejected(spark):
    from pyspark.sql import functions as F

    base = rows()[:4]
    lines = [
        (5, "99999999999999999999\tn\t5\t1\t2"), (6, "1\tn\t5\t1e999\t-1e999"), (7, "3\ta\t1\t1\t1"), (7, "3\tb\t9\t1\t1"),
        (8, "% late\tn\t5\t1\t2"), (9, "4\tn\tx\t1\t1"), (9, "4\tn\ty\t1\t1"), (10, "5\tn\t5\t1\t1"), (10, "5\tn\t5\t1\t1\r"),
    ]
    df = spark.createDataFrame([*base, *[("f", n, t, "", "") for n, t in lines]], SCHEMA)
    clean, rejected = load_counts(df)
    ok = {r.line_no: r for r in clean.collect()}
    assert {r.line_no: r.reasons for r in rejected.collect()} == {7: ["conflicting_texts"], 8: ["stray_header"], 9: ["bad_length", "conflicting_texts"]}
    assert set(ok) == {5, 6, 10}
    assert ok[5].key is None and ok[5].beyond == {"key": "99999999999999999999"}
    assert ok[6]["data"] == {"a.x": None, "b.x": None} and ok[6].beyond == {"a.x": "1e999", "b.x": "-1e999"}
    assert {r.line_no for r in rejected_lines(df, conflicts=False).collect()} == {8, 9}
    assert rejected_lines(df).count() == 3 and clean.where(F.size("beyond") == 0).count() == 1


def test_unknown_roles_are_metadata(spark):
    df = spark.createDataFrame([("g", 3, "% 9\t5\t1", "", ""), ("g", 1, "%1", "", ""), ("g", 2, "%1", "", ""), ("g", 4, "% k\todd\tv", "", ""), ("g", 5, "1\tzzz\t2", "", "")], SCHEMA)
    clean, rejected = load_counts(df)
    assert rejected.collect() == [] and clean.first()["info"] == {"odd": "zzz"}


def test_random_dirt(spark):
    import random

    rng = random.Random(4)
    cell = lambda: rng.choice(["1", "-2", "", '"q\t1"', '"', "x", "5.5e3", "9" * 30, "\u00a07\u00a0", '"a" b', "NaN"])
    lines = [("f", 5 + k, "\t".join(cell() for _ in range(rng.choice([4, 5, 5, 5, 5, 6]))), "", "") for k in range(400)]
    clean, rejected = load_counts(spark.createDataFrame([*rows()[:4], *lines], SCHEMA))
    a, b = {r.line_no for r in clean.select("line_no").collect()}, {r.line_no for r in rejected.collect()}
    assert not a & b and a | b == {n for _, n, text, _, _ in lines if text.strip()} and b
