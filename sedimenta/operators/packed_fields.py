"""Several values packed in one field: split them into one row per value, with its position.

The operator works on Arrow string buffers. All texts of a batch are one byte array; quote parity and escapes are
cumulative masks over it, separators are the bytes left outside quotes and escapes, and the pieces between them give
child offsets. Tags and values become list arrays on those offsets and are flattened with their parents' ordinals. No
step loops over rows or bytes in Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that part attributes, and bytes that part a tag from its value, besides blanks.
SEPARATORS, SIGNS = b";&|,\t\n\r", b"=:"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TAG = np.zeros(256, bool)
_TAG[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def _next(mask: np.ndarray) -> np.ndarray:
    """For every position (and the end) the first position at or after it where ``mask`` holds; else the end."""
    n = len(mask)
    at = np.full(n + 1, n, np.int64)
    at[:-1][mask] = np.flatnonzero(mask)
    return np.minimum.accumulate(at[::-1])[::-1]


def _last(mask: np.ndarray) -> np.ndarray:
    """For every position p of 0..n the last position before p where ``mask`` holds; else -1."""
    at = np.full(len(mask) + 1, -1, np.int64)
    at[1:][mask] = np.flatnonzero(mask)
    return np.maximum.accumulate(at)


def split_texts(texts: pa.Array, separators: bytes = SEPARATORS, signs: bytes = SIGNS) -> tuple[pa.ListArray, pa.ListArray]:
    """(tags, values): a list array each, one list per text."""
    texts = texts.cast(pa.large_string())
    blank = pc.is_in(pc.utf8_trim(texts, " \t\n\r\x0b\x0c"), pa.array(["", "."], pa.large_string()))
    texts = pc.if_else(pc.fill_null(blank, True), pa.scalar("", pa.large_string()), texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    begin, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    n = len(body)
    row_of = np.repeat(np.arange(len(texts)), end - begin)
    row_begin = begin[row_of]

    slash = body == 92
    if slash.any():  # a byte is escaped behind an odd run of backslashes of its own row
        run = np.arange(n) - 1 - np.maximum(_last(~slash)[:-1], row_begin - 1)
        escaped = run % 2 == 1
    else:
        escaped = np.zeros(n, bool)
    quote = (body == 34) & ~escaped
    seen = np.r_[0, np.cumsum(quote)]
    inside = (seen[:-1] - seen[row_begin]) % 2 == 1
    cut = _class(separators)[body] & ~escaped & ~inside

    # pieces: from a row's begin or behind a separator, to the next separator or the row's end
    cuts = np.flatnonzero(cut)
    filled = np.flatnonzero(end > begin)
    p_beg = np.concatenate([begin[filled], cuts + 1])
    p_end = np.concatenate([cuts, end[filled]])
    p_beg.sort()
    p_end.sort()
    space = _SPACE[body] & ~escaped
    p_beg, p_end = np.minimum(_next(~space)[p_beg], p_end), _last(~space)[p_end] + 1
    some = p_end > p_beg
    p_beg, p_end = p_beg[some], p_end[some]
    p_row = row_of[p_beg] if n else np.zeros(0, np.int64)

    t_end = np.minimum(_next(~_TAG[body])[p_beg], p_end)
    v_beg = np.minimum(_next(~space)[t_end], p_end)
    has_sign = np.zeros(len(v_beg), bool)
    left = v_beg < p_end
    has_sign[left] = _class(signs)[body[v_beg[left]]]
    v_beg = np.where(has_sign, np.minimum(_next(~space)[np.minimum(v_beg + 1, n)], p_end), v_beg)

    # bytes that stay: enclosing quotes, escaping backslashes and the second of two quotes inside quotes go
    quoted = np.zeros(len(v_beg), bool)
    wide = p_end - v_beg >= 2
    quoted[wide] = quote[v_beg[wide]] & quote[p_end[wide] - 1]
    stay = np.ones(n, bool)
    stay[slash & ~escaped] = False
    ends_row = end[row_of] - 1 == np.arange(n)
    stay[slash & ~escaped & ends_row] = True  # nothing follows it
    if quoted.any():
        stay[v_beg[quoted]] = False
        stay[p_end[quoted] - 1] = False
        q_beg, q_end = v_beg[quoted] + 1, p_end[quoted] - 1
        depth = np.zeros(n + 1, np.int32)
        np.add.at(depth, q_beg, 1)
        np.add.at(depth, q_end, -1)
        within = np.cumsum(depth)[:-1] > 0
        pair = quote & within
        second = np.zeros(n, bool)
        second[1:] = pair[1:] & pair[:-1]
        if second.any():  # in a run of quotes every second one goes
            run = np.arange(n) - 1 - _last(~pair)[:-1]
            second = pair & (run % 2 == 1)
        stay[second] = False
    kept = np.r_[0, np.cumsum(stay)]
    packed = body[stay]

    def strings(lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        size = kept[hi] - kept[lo]
        at = np.r_[0, np.cumsum(size)]
        take = np.repeat(kept[lo] - at[:-1], size) + np.arange(at[-1])
        return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed[take])))

    rows = pa.array(np.searchsorted(p_row, np.arange(len(texts) + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(rows, strings(p_beg, t_end)), pa.ListArray.from_arrays(rows, strings(v_beg, p_end))


def _explode(batches: Iterator[pa.RecordBatch], keep: int, separators: bytes, signs: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tags, values = split_texts(batch.column(keep), separators, signs)
        parent = pc.list_parent_indices(tags)
        at = parent.to_numpy(zero_copy_only=False)
        position = np.arange(len(at)) - tags.offsets.to_numpy()[at] + 1
        columns = [batch.column(k).take(parent) for k in range(keep)]
        out = [*columns, pa.array(position.astype(np.int32)), tags.flatten().cast(pa.string()), values.flatten().cast(pa.string())]
        names = [*batch.schema.names[:keep], "attr_pos", "attr_tag", "attr_value"]
        for lo in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([c.slice(lo, 50_000) for c in out], names)


def split_packed(df: DataFrame, packed: str, keep: Sequence[str], separators: bytes = SEPARATORS, signs: bytes = SIGNS) -> DataFrame:
    """One row per value packed in ``packed``: the ``keep`` columns, ``attr_pos`` (from 1), ``attr_tag``, ``attr_value``.

    * null, empty, blank and ``.`` texts hold no value; empty pieces have no position;
    * a separator inside double quotes or behind a backslash belongs to its value; an unclosed quote reaches to the end
      of its text and stays in the value;
    * a tag without value has the empty string; a piece that doesn't begin with a tag has the empty tag;
    * repeated rows come out repeatedly; an empty table gives an empty result; ``keep`` may hold columns that are
      called like the result's own: they get ``keep_`` before their name.
    """
    own = {"attr_pos", "attr_tag", "attr_value"}
    narrow = df.select(*[F.col(c).alias(f"keep_{c}" if c in own else c) for c in keep], F.col(packed).cast("string").alias("__packed"))
    schema = T.StructType([
        *narrow.schema.fields[:-1],
        T.StructField("attr_pos", T.IntegerType()), T.StructField("attr_tag", T.StringType()), T.StructField("attr_value", T.StringType()),
    ])
    k = len(keep)
    return narrow.where(F.col("__packed").isNotNull()).mapInArrow(lambda it: _explode(it, k, separators, signs), schema)
