import random

import pytest

from sedimenta.operators import intervals
from sedimenta.operators.intervals import periods_and_gaps

SCHEMA = "origin string, entity string, beg long, end long, kind string"


def brute(rows):
    by = {}
    for o, e, a, b, _ in rows:
        if None not in (o, e, a, b):
            by.setdefault((o, e), []).append((min(a, b), max(a, b)))
    out = []
    for (o, e), spans in by.items():
        spans.sort()
        merged = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(o, e, "period", a, b) for a, b in merged]
        out += [(o, e, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])]
    return sorted(out)


def got(df, **how):
    return sorted(tuple(r) for r in periods_and_gaps(df, **how).collect())


@pytest.mark.parametrize("shard", [4, 16, 1 << 16])
@pytest.mark.parametrize("reach", [3, 40])
def test_against_brute_force(spark, shard, reach):
    rng = random.Random(shard + reach)
    rows = []
    for _ in range(900):
        a = rng.randrange(-100, 300)
        e = rng.choice(["hot", "hot", "x", "y", None, "shared"])
        rows.append((rng.choice(["p", "q"]), e, a, None if rng.random() < 0.03 else a + rng.randrange(-reach, reach), "clash"))
    rows += rows[:50]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), shard=shard) == brute(rows)


def test_long_intervals_touching_shards_and_far_positions(spark):
    big = 1 << 40
    rows = [("o", "e", 0, big, ""), ("o", "e", big + 1, big + 5, ""), ("o", "e", big + 9, big + 9, ""), ("o", "f", 65535, 65535, ""), ("o", "f", 65536, 70000, ""), ("o", "g", 7, 7, ""), ("o", "g", -5, -9, "")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    far = [("o", "e", k * 65536 * 3, k * 65536 * 3 + 1, "") for k in range(50)] + [("o", "e", 10, 20, "")]
    assert got(spark.createDataFrame(far, SCHEMA)) == brute(far)


def test_ends_of_the_number_range(spark):
    top, low = (1 << 63) - 1, -(1 << 63)
    rows = [("o", "e", top - 2, top, ""), ("o", "e", low, low + 1, ""), ("o", "e", 0, 5, ""), ("o", "f", low, top, ""), ("o", "g", top, top, ""), ("o", "g", top - 1, top - 1, "")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_small_buffers(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    monkeypatch.setattr(intervals, "BUFFER_ROWS", 5)
    monkeypatch.setattr(intervals, "STATE_ROWS", 8)
    rows = sorted(("o", rng.choice("abc"), s, (b := s * 10 + rng.randrange(8)), b + rng.randrange(2)) for s in (rng.randrange(3) for _ in range(300)))
    t = pa.table(dict(zip(("origin", "entity", "shard", "beg", "end"), map(list, zip(*rows)))))
    parts = pa.Table.from_batches(list(intervals._before(iter(t.to_batches(max_chunksize=4)))))
    parts = parts.sort_by([("origin", "ascending"), ("entity", "ascending"), ("shard", "ascending")])
    final = pa.Table.from_batches(list(intervals._after(iter(parts.to_batches(max_chunksize=3))))).to_pylist()
    edges = [r for r in final if r["kind"] == "edge"]
    assert len(edges) == len({(r["entity"], r["shard"]) for r in rows_of(rows)}) == len({(r["entity"], r["shard"]) for r in edges})


def rows_of(rows):
    return [dict(zip(("origin", "entity", "shard", "beg", "end"), r)) for r in rows]


def test_nothing(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([("o", "e", None, 5, ""), (None, "e", 1, 5, "")], SCHEMA)) == []


def test_long_intervals_leave_other_shards_alone(spark):
    rng = random.Random(8)
    rows = [("o", "hot", p, p + rng.randrange(4), "") for p in (rng.randrange(-3000, 3000) for _ in range(800))]
    rows += [("o", "hot", -700, -90, ""), ("o", "hot", 1003, 2500, ""), ("o", "hot", 10**12, 5, ""), ("o", "cold", 3, 10**12, ""), ("o", "cold", 10**12 + 5, 10**12 + 9, ""), ("o", "cold", -90, 1, "")]
    rows += [("p", f"e{k}", k * 100, k * 100 + 100 * rng.randrange(1, 30), "") for k in range(20)] + [("p", "e3", k * 40, k * 40 + 5, "") for k in range(100)]
    for reach in (1, 3):
        monkey = intervals.REACH
        try:
            intervals.REACH = reach
            assert got(spark.createDataFrame(rows, SCHEMA).repartition(3), shard=8) == brute(rows)
        finally:
            intervals.REACH = monkey


def test_a_hot_entity_keeps_its_shards_beside_one_long_interval(spark):
    rows = [("o", "hot", k << 16, (k << 16) + 9, "") for k in range(1000)] + [("o", "other", 0, 10**12, "")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
