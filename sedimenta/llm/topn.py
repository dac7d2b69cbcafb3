"""Top N items within every group, by a mergeable aggregation.

Each task keeps, for every group it meets, a heap of at most N items ordered by score (high first) and then by the
unique identifier (low first). Only these heaps are shuffled; heaps of one group are merged by the same step. A group
of any size therefore sends at most N rows per task, and nothing is ever collected per group.

Heaps are held column-wise. Of the rows that a buffer has gathered, those below the N-th score of a group whose heap is
full go at once; the others and the heaps so far are ordered once by (group, score, identifier), and everything beyond
rank N is dropped. Repeated items (equal in ``distinct_on``) have equal scores; a heap keeps the
lowest identifier of each. That stays mergeable: an item leaves a heap only for N different items that are better by
that task's own identifiers, and their lowest identifiers over all tasks are at least as good.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_G, _S, _I, _A, _B = "__group", "__score", "__item", "__fp1", "__fp2"
#: Rows buffered before a prune, and heap rows of one task beyond which they are handed on early (they merge later).
BUFFER_ROWS, STATE_ROWS = 100_000, 1_000_000


def _codes(column: pa.ChunkedArray, descending: bool) -> np.ndarray:
    """Numbers that order ``column`` ascending: itself (or its negative), or dense ranks for what NumPy can't order."""
    kind = column.type
    if pa.types.is_floating(kind):
        x = column.to_numpy()
        return -x if descending else x
    if pa.types.is_integer(kind):
        x = column.to_numpy()
        return ~x if descending else x  # the complement has no overflow
    return pc.rank(column.combine_chunks(), sort_keys="descending" if descending else "ascending", tiebreaker="dense").to_numpy()


def _groups(t: pa.Table) -> np.ndarray:
    code = t.column(_G).combine_chunks().dictionary_encode()
    return (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)


def admit(t: pa.Table, heaps: pa.Table, n: int) -> pa.Table:
    """Rows of ``t`` that may enter ``heaps`` (as ``prune`` leaves them): those not below the last score of a full heap."""
    code = _groups(heaps)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    last = np.r_[first[1:], len(code)] - 1
    full = heaps.take(pa.array(last[last - first == n - 1]))
    if not full.num_rows:
        return t
    at = pc.index_in(t.column(_G), value_set=full.column(_G).combine_chunks())
    least = full.column(_S).combine_chunks().take(at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at)
    return t.filter(pc.fill_null(pc.greater_equal(t.column(_S), least), True))


def prune(t: pa.Table, n: int) -> pa.Table:
    """The n best different items of each group in ``t``, ordered by group code, rank."""
    code, score, item = _groups(t), _codes(t.column(_S), True), _codes(t.column(_I), False)
    a, b = t.column(_A).to_numpy(), t.column(_B).to_numpy()
    order = np.lexsort((item, b, a, score, code))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        x, y = order[1:], order[:-1]
        same[1:] = (code[x] == code[y]) & (score[x] == score[y]) & (a[x] == a[y]) & (b[x] == b[y])
    order = order[~same]
    order = order[np.lexsort((item[order], score[order], code[order]))]
    c = code[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
    rank = np.arange(len(c)) - np.repeat(first, np.diff(np.r_[first, len(c)]))
    return t.take(pa.array(order[rank < n]))


def _build(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: heaps of all groups of a task."""
    state, held, size = None, [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BUFFER_ROWS + (state.num_rows if state is not None else 0):
            rows = pa.Table.from_batches(held)
            state = prune(rows if state is None else pa.concat_tables([state, admit(rows, state, n)]), n).combine_chunks()
            held, size = [], 0
            if state.num_rows > STATE_ROWS:
                yield from state.to_batches(max_chunksize=10_000)
                state = None
    if held:
        rest = pa.Table.from_batches(held)
        state = prune(rest if state is None else pa.concat_tables([state, admit(rest, state, n)]), n)
    if state is not None:
        yield from state.combine_chunks().to_batches(max_chunksize=10_000)


def _merge(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """After the shuffle: rows come ordered by group, so that only the last group of a block stays open."""

    def ranked(t: pa.Table) -> Iterator[pa.RecordBatch]:
        # rows of a group stand together after prune; rank restarts with the group
        g = _groups(t)
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)])) + 1
        yield from t.append_column("__rank", pa.array(rank.astype(np.int32))).combine_chunks().to_batches(max_chunksize=10_000)

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= BUFFER_ROWS:
            t = prune(pa.concat_tables(held), n)
            last = batch.column(batch.schema.get_field_index(_G))[-1]
            is_open = pc.equal(t.column(_G), last)
            yield from ranked(t.filter(pc.invert(is_open)))
            held = [t.filter(is_open)]
            size = held[0].num_rows
    if held:
        yield from ranked(prune(pa.concat_tables(held), n))


def fingerprints(columns: Sequence[str]) -> tuple:
    """Two 64-bit fingerprints of the columns; nulls differ from every value and NaN equals NaN."""
    cols = [F.col(c) for c in columns]
    mask = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(F.lit(1), mask, *cols), F.xxhash64(F.lit(2), *reversed(cols), mask)


def top_n(df: DataFrame, group, score: str, unique_id: str, n: int, distinct_on: Sequence[str] | None = None, payload: Sequence[str] = ()) -> DataFrame:
    """Keep the ``n`` items of the highest ``score`` in every ``group``.

    Result: ``group_key``, ``item_id``, ``item_score``, ``item_rank`` (from 1) and the ``payload`` columns, whatever
    other columns ``df`` has. Ties of the score go to the lower ``unique_id``.

    * rows with null group, null or NaN score, or null identifier don't take part; infinities do;
    * ``distinct_on``: columns (with the group and score) in which repeated items are equal; they count once, as the
      lowest identifier. By default the identifier alone tells items apart, so repeated rows of it count once;
    * scores are compared as what they are (integers and decimals exactly, dates and texts in their order), and so are
      identifiers;
    * groups with fewer than n items come out with what they have; an empty table gives an empty result;
    * -0.0 and 0.0 are the same score.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    g = F.col(group) if isinstance(group, str) else group
    fp1, fp2 = fingerprints(distinct_on or [unique_id])
    kind, id_kind = df.select(score).schema[0].dataType, df.select(unique_id).schema[0].dataType
    value = F.col(score) if not isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(score).cast("double") + F.lit(0.0)
    item = F.col(unique_id).cast("long") if isinstance(id_kind, T.IntegralType) else F.col(unique_id)
    narrow = df.select(
        g.alias(_G), (value.cast("long") if isinstance(kind, T.IntegralType) else value).alias(_S), item.alias(_I), fp1.alias(_A), fp2.alias(_B),
        *[F.col(c).alias(f"__p{k}") for k, c in enumerate(payload)],
    ).where(F.col(_G).isNotNull() & F.col(_S).isNotNull() & F.col(_I).isNotNull() & (~F.isnan(_S) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(True)))
    heaps = narrow.mapInArrow(lambda it: _build(it, n), narrow.schema)
    merged_schema = T.StructType([*narrow.schema.fields, T.StructField("__rank", T.IntegerType())])
    merged = heaps.repartition(F.col(_G)).sortWithinPartitions(_G).mapInArrow(lambda it: _merge(it, n), merged_schema)
    return merged.select(
        F.col(_G).alias("group_key"), F.col(_I).alias("item_id"), F.col(_S).alias("item_score"), F.col("__rank").alias("item_rank"),
        *[F.col(f"__p{k}").alias(c) for k, c in enumerate(payload)],
    )
