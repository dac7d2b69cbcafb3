"""Overlapping and gapped intervals: continuous periods per entity, and the gaps between them.

Positions are exact units. An interval becomes runs in the compressed bitmaps of its entity, one bitmap for each shard
of consecutive positions. Bitmaps are run-length containers (sorted, disjoint set runs), united within every task
before the shuffle and again per (entity, shard) after it, so that an entity with most of the rows spreads over its
shards and a run costs the same whatever its length. Set runs and clear runs inside a shard are final; only the runs
at the edges of shards, one narrow row per shard, are joined up per entity.

A long interval leaves runs in the shards of its two ends only. The whole shards between are an interval of shard
numbers; these intervals are united by the same operator, one level up, so that one interval of any length costs a few
rows and changes nothing for the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a shard, and whole shards that an interval may reach over before they are kept as one interval of shards.
SHARD, REACH = 1 << 16, 64
BUFFER_ROWS, STATE_ROWS = 200_000, 1_000_000
_RUNS = "origin string, entity string, shard long, beg long, end long"
_FINAL = "origin string, entity string, shard long, kind string, beg long, end long, beg2 long, end2 long"


def unite(t: pa.Table) -> pa.Table:
    """Union of the run bitmaps in ``t``: disjoint, non-touching runs ordered by (bitmap code, begin)."""
    code = _codes(t)
    beg, end = t.column("beg").to_numpy(), t.column("end").to_numpy()
    order = np.lexsort((beg, code))
    code, beg, end = code[order], beg[order], end[order]
    if not len(code):
        return t
    fresh = np.r_[True, code[1:] != code[:-1]]
    # running maximum of the end within a bitmap: bitmaps are lifted apart, so that one accumulate serves all
    lift = np.cumsum(fresh) - 1
    low = beg.min()
    span = int(end.max()) - int(low) + 2
    if span * (int(lift[-1]) + 1) < (1 << 62):
        reach = np.maximum.accumulate(end - low + lift * span) - lift * span + low
    else:
        reach = np.concatenate([np.maximum.accumulate(x) for x in np.split(end, np.flatnonzero(fresh)[1:])])
    first = fresh.copy()
    first[1:] |= (beg[1:] > reach[:-1]) & (beg[1:] - 1 > reach[:-1])  # safe at the ends of the number range
    at = np.flatnonzero(first)
    last = np.r_[at[1:], len(code)] - 1
    out = t.select(["origin", "entity", "shard"]).take(pa.array(order[at]))
    return out.append_column("beg", pa.array(beg[at])).append_column("end", pa.array(reach[last]))


def _codes(t: pa.Table) -> np.ndarray:
    """A number for each (origin, entity, shard); equal keys only are equal."""
    parts = []
    for name in ("origin", "entity"):
        c = t.column(name).combine_chunks().dictionary_encode()
        parts.append(c.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    shard = t.column("shard").to_numpy()
    _, s = np.unique(shard, return_inverse=True)
    key = (parts[0] * (parts[1].max(initial=0) + 1) + parts[1]) * (s.max(initial=0) + 1) + s
    return key


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= BUFFER_ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for t in _tables(batches):
        state = unite(t if state is None else pa.concat_tables([state, t]))
        if state.num_rows > STATE_ROWS:
            yield from state.combine_chunks().to_batches(max_chunksize=20_000)
            state = None
    if state is not None:
        yield from state.combine_chunks().to_batches(max_chunksize=20_000)


def _after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs come ordered by bitmap; each complete bitmap gives its inner set and clear runs and one row of its edges."""
    names = [x.split()[0] for x in _FINAL.split(", ")]
    rest = None
    for t in _tables(batches):
        t = t if rest is None else pa.concat_tables([rest, t])
        key = [t.column(c)[t.num_rows - 1] for c in ("origin", "entity", "shard")]  # the bitmap that may go on in the next block
        t = unite(t)
        is_open = pc.and_(pc.and_(pc.equal(t.column("origin"), key[0]), pc.equal(t.column("entity"), key[1])), pc.equal(t.column("shard"), key[2]))
        rest = t.filter(is_open)
        yield from _extract(t.filter(pc.invert(is_open)), names)
    if rest is not None:
        yield from _extract(rest, names)


def _extract(t: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    if not t.num_rows:
        return
    code = _codes(t)
    beg, end = t.column("beg").to_numpy(), t.column("end").to_numpy()
    head = np.r_[True, code[1:] != code[:-1]]
    tail = np.r_[head[1:], True]
    keys = t.select(["origin", "entity", "shard"])

    def rows(at, kind, *cols):
        if len(at):
            k = keys.take(pa.array(at)).combine_chunks()
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in k.columns]
            full = [pa.array(c) if c is not None else pa.nulls(len(at), pa.int64()) for c in cols]
            whole = pa.Table.from_arrays([*arrays, pa.array([kind]).take(pa.array(np.zeros(len(at), np.int64))), *full], names=names)
            yield from whole.combine_chunks().to_batches(max_chunksize=20_000)

    inner = np.flatnonzero(~head & ~tail)
    yield from rows(inner, "period", beg[inner], end[inner], None, None)
    clear = np.flatnonzero(~head)  # the clear run before each set run but the first
    yield from rows(clear, "gap", end[clear - 1] + 1, beg[clear] - 1, None, None)
    h, z = np.flatnonzero(head), np.flatnonzero(tail)
    yield from rows(h, "edge", beg[h], end[h], beg[z], end[z])


def periods_and_gaps(df: DataFrame, shard: int = SHARD) -> DataFrame:
    """Periods and gaps of intervals ``(origin, entity, beg, end)``: origin, entity, kind, seg_beg, seg_end.

    Positions are inclusive. Begin and end exchanged mean the same positions. Intervals that share a position or touch
    (end + 1 = begin) are one period; a gap is what lies between two periods of an entity.

    * rows with null origin, entity, begin or end don't count; repeated and nested intervals change nothing;
    * an entity with one period has no gap; an empty table gives an empty result; other columns play no part;
    * intervals of any length, up to the ends of the number range, cost alike.
    """
    whole = F.col("origin").isNotNull() & F.col("entity").isNotNull() & F.col("beg").isNotNull() & F.col("end").isNotNull()
    spans = df.where(whole).select("origin", "entity", F.least("beg", "end").cast("long").alias("beg"), F.greatest("beg", "end").cast("long").alias("end"))
    longest = spans.agg(F.max(F.col("end").cast("double") - F.col("beg").cast("double"))).first()[0] or 0
    at = lambda c: F.expr(f"{c} div {shard} - if({c} % {shard} < 0, 1, 0)")
    spans = spans.withColumns({"s0": at("beg"), "s1": at("end")})
    is_long = F.col("s1") - F.col("s0") > REACH + 1
    placed = spans.select("origin", "entity", "beg", "end", F.explode(F.when(is_long, F.array("s0", "s1")).otherwise(F.sequence("s0", F.when(is_long, F.col("s0")).otherwise(F.col("s1"))))).alias("shard"))
    runs = placed.select(
        "origin", "entity", F.col("shard").cast("long").alias("shard"),
        F.greatest(F.col("beg"), F.try_multiply(F.col("shard"), F.lit(shard))).alias("beg"),  # null beyond the number range, which greatest passes over
        F.least(F.col("end"), F.try_subtract(F.try_multiply(F.col("shard") + 1, F.lit(shard)), F.lit(1))).alias("end"),
    )
    united = runs.mapInArrow(_before, _RUNS).repartition("origin", "entity", "shard").sortWithinPartitions("origin", "entity", "shard")
    final = united.mapInArrow(_after, _FINAL)

    edges = final.where("kind = 'edge'")
    inner = final.where("kind != 'edge'")
    if longest >= float(shard) * REACH:
        edges, inner = _under_long(spans.where(is_long), edges, inner, shard)
    w = Window.partitionBy("origin", "entity").orderBy("shard")
    joined = edges.withColumns({
        "before": F.lag("end2").over(w), "after": F.lead("beg").over(w),
    }).withColumns({
        "goes_on": F.coalesce(F.try_add("before", F.lit(1)) == F.col("beg"), F.lit(False)),
        "stays_open": F.coalesce(F.try_add("end2", F.lit(1)) == F.col("after"), F.lit(False)),
        "single": F.col("beg") == F.col("beg2"),
    })
    # begin of the period that is open at the right edge of a shard, carried over shards that it fills
    opened = F.when(~F.col("single"), F.col("beg2")).when(~F.col("goes_on"), F.col("beg"))
    joined = joined.withColumn("opened", opened).withColumn("carried", F.last("opened", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.when(F.col("goes_on"), F.col("carried")).otherwise(F.col("beg"))
    seg = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("seg_beg"), hi.alias("seg_end"))
    outer = joined.select("origin", "entity", F.explode(F.array_compact(F.array(
        F.when(~F.col("single"), seg("period", start, F.col("end"))),
        F.when(~F.col("stays_open"), seg("period", F.when(F.col("single"), start).otherwise(F.col("beg2")), F.col("end2"))),
        F.when(F.col("before").isNotNull() & ~F.col("goes_on"), seg("gap", F.col("before") + 1, F.col("beg") - 1)),
    ))).alias("s")).select("origin", "entity", "s.kind", "s.seg_beg", "s.seg_end")
    return inner.select("origin", "entity", "kind", F.col("beg").alias("seg_beg"), F.col("end").alias("seg_end")).unionByName(outer)


def _under_long(long: DataFrame, edges: DataFrame, inner: DataFrame, shard: int) -> tuple[DataFrame, DataFrame]:
    """Edges and inner runs with the whole shards under long intervals: these shards' own runs go, one row stands for them all."""
    full = periods_and_gaps(long.select("origin", "entity", (F.col("s0") + 1).alias("beg"), (F.col("s1") - 1).alias("end")), SHARD).where("kind = 'period'")
    beg, end = F.col("seg_beg") * shard, (F.col("seg_end") + 1) * shard - 1
    rows = full.select("origin", "entity", F.col("seg_beg").alias("shard"), F.lit("full").alias("kind"), beg.alias("beg"), end.alias("end"), beg.alias("beg2"), end.alias("end2"), F.col("seg_end").alias("covers"))
    w = Window.partitionBy("origin", "entity").orderBy("shard", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)  # full rows before edges
    all_rows = edges.withColumn("covers", F.lit(None).cast("long")).unionByName(rows).withColumn("reach", F.max("covers").over(w))
    covered = (F.col("kind") == "edge") & F.coalesce(F.col("reach") >= F.col("shard"), F.lit(False))
    gone = all_rows.where(covered).select("origin", "entity", "shard")
    return all_rows.where(~covered).drop("covers", "reach"), inner.join(gone, ["origin", "entity", "shard"], "left_anti")
