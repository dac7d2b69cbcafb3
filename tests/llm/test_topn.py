import random

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import topn
from sedimenta.llm.topn import top_n

SCHEMA = "q string, id long, score double, a string, b double, group_key string"


def brute(rows, n, distinct):
    groups = {}
    for q, i, s, a, b, _ in rows:
        if q is None or i is None or s is None or s != s:
            continue
        key = (s, a, "nan" if b is not None and b != b else b) if distinct else i
        best = groups.setdefault(q, {})
        if key not in best or i < best[key][1]:
            best[key] = (s, i)
    out = set()
    for q, best in groups.items():
        for r, (s, i) in enumerate(sorted(best.values(), key=lambda x: (-x[0], x[1]))[:n]):
            out.add((q, i, s, r + 1))
    return out


def got(df):
    return [(r["group_key"], r["item_id"], r["item_score"], r["item_rank"]) for r in df.collect()]


@pytest.mark.parametrize("distinct", [False, True])
def test_against_brute_force(spark, distinct, monkeypatch):
    rng = random.Random(5)
    rows = [
        (rng.choice(["hot", "hot", "x", "y", None, f"g{rng.randrange(40)}"]), k, rng.choice([1.0, 2.0, 2.5, None, float("nan"), float("inf"), -1.0]), rng.choice(["p", "q", None]), rng.choice([0.5, None, float("nan")]), "clash")
        for k in range(3000)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    result = got(top_n(df, "q", "score", "id", 4, distinct_on=["score", "a", "b"] if distinct else None))
    assert len(result) == len(set(result))
    assert set(result) == brute(rows, 4, distinct)


def test_small_buffers_prune_and_merge(spark):
    # heaps handed on early, groups over the edge of a block
    import pyarrow as pa

    old = topn.BUFFER_ROWS, topn.STATE_ROWS
    topn.BUFFER_ROWS, topn.STATE_ROWS = 5, 3
    try:
        rows = [(f"g{k % 3}", float(k % 11), k) for k in range(200)]
        t = pa.table({"__group": [r[0] for r in rows], "__score": [r[1] for r in rows], "__item": [r[2] for r in rows], "__fp1": [r[2] for r in rows], "__fp2": [0] * 200})
        heaps = list(topn._build(iter(t.to_batches(max_chunksize=7)), 2))
        merged = pa.Table.from_batches(heaps).sort_by("__group")
        out = pa.Table.from_batches(list(topn._merge(iter(merged.to_batches(max_chunksize=4)), 2))).to_pylist()
    finally:
        topn.BUFFER_ROWS, topn.STATE_ROWS = old
    expect = {(g, r + 1, i) for g in ("g0", "g1", "g2") for r, (s, i) in enumerate(sorted(((s, i) for q, s, i in rows if q == g), key=lambda x: (-x[0], x[1]))[:2])}
    assert {(r["__group"], r["__rank"], r["__item"]) for r in out} == expect


def test_empty_table_and_payload(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_n(empty, "q", "score", "id", 3).collect() == []
    one = spark.createDataFrame([("a", 1, 0.0, "p", 1.0, "z"), ("a", 2, -0.0, None, 1.0, "z")], SCHEMA)
    rows = top_n(one, "q", "score", "id", 1, payload=["a"]).collect()
    assert [(r.group_key, r.item_id, r.a) for r in rows] == [("a", 1, "p")]
    with pytest.raises(ValueError):
        top_n(one, "q", "score", "id", 0)


def test_group_expression_keeps_the_query_name(spark):
    df = spark.createDataFrame([("q1 text", 1, 5.0, None, None, None), ("q1\tother", 2, 6.0, None, None, None), ("q2", 3, 1.0, None, None, None)], SCHEMA)
    assert set(got(top_n(df, F.regexp_extract("q", r"^\S*", 0), "score", "id", 1))) == {("q1", 2, 6.0, 1), ("q2", 3, 1.0, 1)}


def test_scores_and_identifiers_keep_their_types(spark):
    import datetime
    from decimal import Decimal

    big = [("g", 2, 9007199254740993), ("g", 1, 9007199254740992), ("g", 3, -(2**63))]
    assert [(r.item_id, r.item_score) for r in top_n(spark.createDataFrame(big, "g string, i long, s long"), "g", "s", "i", 1).collect()] == [(2, 9007199254740993)]
    dec = [("g", "b", Decimal("1.00000000000000000000000001")), ("g", "a", Decimal("1.00000000000000000000000002")), ("g", "c", Decimal("1.00000000000000000000000002"))]
    df = top_n(spark.createDataFrame(dec, "g string, i string, s decimal(38,26)"), "g", "s", "i", 2)
    assert sorted((r.item_rank, r.item_id) for r in df.collect()) == [(1, "a"), (2, "c")]
    days = [("g", k, datetime.date(2020, 1, 1 + k)) for k in range(5)]
    assert top_n(spark.createDataFrame(days, "g string, i int, s date"), "g", "s", "i", 1).first().item_id == 4


def test_rows_below_full_heaps_go_at_once():
    import pyarrow as pa

    heaps = topn.prune(table([("a", 3.0, 1), ("a", 2.0, 2), ("b", 1.0, 3)]), 2)
    left = topn.admit(table([("a", 1.0, 9), ("a", 2.0, 0), ("a", 5.0, 8), ("b", 0.5, 7), ("c", 0.1, 6)]), heaps, 2)
    assert isinstance(left, pa.Table) and left.column("__item").to_pylist() == [0, 8, 7, 6]


def table(rows):
    import pyarrow as pa

    g, s, i = zip(*rows)
    return pa.table({"__group": pa.array(g), "__score": pa.array(s), "__item": pa.array(i), "__fp1": pa.array(i), "__fp2": pa.array(i)})
