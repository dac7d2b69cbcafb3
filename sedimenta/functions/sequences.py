"""Nucleotide sequences as string columns: composition, complements, windows and k-mers.

Composition and names are column expressions. Windows and k-mers would need an array of a text's pieces there, so they
scan Arrow buffers instead: k-mers are rolling base-4 codes counted per text, and only counts leave the scan; windows are
slices of the buffer. A text of any length is one pass in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACTGactg", "TGACtgac"))


def clean_nt(s: Column) -> Column:
    """Upper case, without letters other than A, C, G, T."""
    return F.regexp_replace(F.upper(s), "[^ACGT]", "")


def count_of(s: Column, letters: str) -> Column:
    """How many characters of ``s`` are among ``letters``."""
    out = F.length(s) * len(letters)
    for letter in letters:  # plain replacement is several times faster than translation
        out = out - F.length(F.replace(s, F.lit(letter), F.lit("")))
    return out


def gc_content(s: Column) -> Column:
    """GC / (GC + AT) in either case; null without any."""
    u = F.upper(s)
    gc = count_of(u, "GC")
    return F.try_divide(gc.cast("double"), (gc + count_of(u, "AT")).cast("double"))


def mono_nt_freq(s: Column) -> Column:
    """Shares of A, C, T, G in the full length."""
    n = F.length(s).cast("double")
    return F.struct(*[F.try_divide(count_of(s, b).cast("double"), n).alias(b.lower()) for b in "ACTG"])


def n_share(s: Column) -> Column:
    return F.try_divide(count_of(F.upper(s), "N").cast("double"), F.length(s).cast("double"))


def non_dna(s: Column) -> Column:
    """Characters that stand for no nucleotide: other than A, C, G, T, R, Y, S, W, K, M, B, D, H, V, N, dot and dash."""
    return F.length(F.regexp_replace(s, "[AaCcGgTtRrYySsWwKkMmBbDdHhVvNn.-]", ""))


#: Codes of the 2-bit form.
TWO_BIT = "TCGA"


def pack_2bit(s: Column) -> Column:
    """2-bit codes (T 0, C 1, G 2, A 3), four per byte as hexadecimal text behind the length; other letters count as T."""
    bits = F.translate(F.upper(F.regexp_replace(s, "[^ACGTacgt]", "T")), TWO_BIT, "0123")
    padded = F.rpad(bits, (F.ceil(F.length(s) / 2) * 2).cast("int"), "0")
    pairs = F.regexp_extract_all(padded, F.lit("([0-3]{2})"), F.lit(1))
    return F.concat(F.length(s).cast("string"), F.lit(":"), F.array_join(F.transform(pairs, lambda p: F.lower(F.conv(p, 4, 16))), ""))


def unpack_2bit(packed: Column) -> Column:
    n = F.split_part(packed, F.lit(":"), F.lit(1)).cast("int")
    digits = F.regexp_extract_all(F.split_part(packed, F.lit(":"), F.lit(2)), F.lit("([0-9a-f])"), F.lit(1))
    letters = F.array_join(F.transform(digits, lambda d: F.translate(F.lpad(F.conv(d, 16, 4), 2, "0"), "0123", TWO_BIT)), "")
    return F.substring(letters, F.lit(1), n)


def reverse_complement_2bit(packed: Column) -> Column:
    """The packed form of the reverse complement: codes in reverse order, each one's bits turned over (T 0 and A 3, C 1 and G 2)."""
    return pack_2bit(reverse_complement(unpack_2bit(packed)))


def spans(size: int, chunk: int, step: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """0-based begins and exclusive ends of a sequence's windows: full ones, and cut ones while more than ``least`` is left.

    Sequences shorter than ``chunk + least`` have none.
    """
    if chunk <= 2:
        raise ValueError("a window needs more than 2 letters")
    if size < chunk + least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    beg = np.arange(0, size, step)
    beg = beg[(beg + chunk <= size) | (size - beg > least)]
    return beg, np.minimum(beg + chunk, size)


#: Bytes of windows that one batch of rows holds.
WINDOW_BYTES = 16 << 20


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, step: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0)
        for k in range(batch.num_rows):
            body = np.frombuffer(batch.column(1)[k].as_buffer(), np.uint8)
            first = np.flatnonzero((body & 0xC0) != 0x80) if (body & 0x80).any() else None  # bytes that begin a letter
            size = len(body) if first is None else len(first)
            beg, end = spans(size, chunk, step, least)
            rows = max(1, WINDOW_BYTES // (4 * chunk))
            for lo in range(0, len(beg), rows):
                b, e = beg[lo : lo + rows], end[lo : lo + rows]
                if first is not None:
                    edge = np.r_[first, len(body)]
                    x, y = edge[b], edge[e]
                else:
                    x, y = b, e
                at = np.r_[0, np.cumsum(y - x)].astype(np.int32)
                take = np.repeat(x - at[:-1], y - x) + np.arange(at[-1])
                text = pa.StringArray.from_buffers(len(b), pa.py_buffer(at), pa.py_buffer(body[take]))
                n = np.arange(lo + 1, lo + 1 + len(b), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([names[k].as_py()] * len(b), pa.string()), pa.array(n), pa.array(b + 1), pa.array(e), text], ["name", "n", "beg", "end", "seq"])


def subdivide(df: DataFrame, name: str, seq: str, chunk: int, step: int, least: int = 0) -> DataFrame:
    """Windows of sequences as rows (name, n, beg, end, fragment, seq): ``<first word>_<n> <beg>-<end>`` names a fragment.

    Begin and end count letters from 1, both included. Null sequences and those too short have no window.
    """
    spans(0, chunk, step, least)
    narrow = df.where(F.length(seq) >= chunk + least).select(F.regexp_extract(name, r"^\S*", 0).alias("name"), F.col(seq).cast("string").alias("seq"))
    w = narrow.mapInArrow(lambda it: _cut(it, chunk, step, least), "name string, n int, beg long, end long, seq string")
    label = F.concat(F.col("name"), F.lit("_"), F.col("n"), F.lit(" "), F.col("beg"), F.lit("-"), F.col("end"))
    return w.select("name", "n", F.col("beg").cast("int").alias("beg"), F.col("end").cast("int").alias("end"), label.alias("fragment"), "seq")


def canonical_kmers(k: int) -> list[tuple[str, str, int]]:
    """(k-mer, canonical k-mer, id): a k-mer is canonical unless its reverse complement came before it in A, T, C, G order."""
    turn = str.maketrans("ACGT", "TGCA")
    ids: dict[str, int] = {}
    out = []
    for letters in product("ATCG", repeat=k):
        mer = "".join(letters)
        back = mer.translate(turn)[::-1]
        canon = back if back in ids else mer
        ids.setdefault(canon, len(ids))
        out.append((mer, canon, ids[canon]))
    return out


def canonical(mer: Column) -> Column:
    """Canonical form without a table, for any k: the first of a k-mer and its reverse complement in A, T, C, G order."""
    order = lambda c: F.translate(c, "ATCG", "0123")
    back = reverse_complement(mer)
    return F.when(order(back) < order(mer), back).otherwise(mer)


#: Letters that a scan looks at together, and codes of the letters in A, T, C, G order (4: no legal letter).
SCAN_LETTERS = 1 << 18
_CODES = np.full(256, 4, np.uint8)
_CODES[[65, 84, 67, 71]] = [0, 1, 2, 3]


def _entered(beg: np.ndarray, end: np.ndarray, text: np.ndarray, text_beg: np.ndarray, k: int) -> np.ndarray:
    """Where the scan enters each run of legal letters (beg to end, at least k long), -1 where it jumps over its k-mers.

    Behind a run that it counted the scan goes on one letter after its end, and from there in steps of k until it comes
    to a run with k letters left. What matters of the past is thus one number, the last such place. Runs of 2 k - 1
    letters are met whatever it was, and so are first runs of a text: all stretches between them are followed at once.
    """
    n, size = len(beg), end - beg
    place, out = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    first = np.r_[True, text[1:] != text[:-1]] if n else np.zeros(0, bool)
    sure = size >= 2 * k - 1
    known = first.copy()
    known[1:] |= sure[:-1]
    place[first] = text_beg[text[first]]
    after = ~first & known
    place[after] = end[np.flatnonzero(after) - 1] + 1
    open_ended = np.r_[~known[1:], False] if n else known  # runs whose successor waits for them
    at = np.flatnonzero(known)
    while len(at) > 32:
        gap = (place[at] - beg[at]) % k
        met = size[at] - gap >= k
        out[at] = np.where(met, beg[at] + gap, -1)
        goes = open_ended[at]
        on = np.where(met, end[at] + 1, place[at])[goes]
        at = at[goes] + 1
        place[at] = on
    for j in at.tolist():  # few stretches are left: one after the other
        here = int(place[j])
        while True:
            gap = (here - int(beg[j])) % k
            if int(size[j]) - gap >= k:
                out[j], here = beg[j] + gap, int(end[j]) + 1
            if not open_ended[j]:
                break
            j += 1
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def count_kmers(column: pa.Array, k: int, skip: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, canonical code, count) of the legal k-mers of a string column's texts, by stretches of bounded length."""
    body, at = _texts(column)
    # one place per letter: the bytes behind a letter's first go, all are illegal alike
    lead = (body & 0xC0) != 0x80
    if not lead.all():
        at = np.r_[0, np.cumsum(lead)][at]
        body = body[lead]
    n, owner_end = len(body), at[1:]
    code = _CODES[body]
    legal = code < 4
    # runs of legal letters, cut at the ends of texts
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    beg = np.flatnonzero(legal & (edge[:-1] | ~np.r_[False, legal[:-1]]))
    end = np.flatnonzero(legal & (edge[1:] | ~np.r_[legal[1:], False])) + 1
    enough = end - beg >= k
    beg, end = beg[enough], end[enough]
    if skip:
        enter = _entered(beg, end, np.searchsorted(owner_end, beg, side="right"), at[:-1], k)
        beg, end = enter[enter >= 0], end[enter >= 0]
    turn = np.zeros(n + 1, np.int8)
    turn[beg] += 1
    turn[end - k + 1] -= 1
    kind = next(t for t, most in ((np.uint8, 4), (np.uint16, 8), (np.uint32, 16), (np.uint64, 31)) if k <= most)
    inside = 0
    for lo in range(0, n, SCAN_LETTERS):
        hi = min(lo + SCAN_LETTERS, n)
        marks = np.cumsum(turn[lo:hi], dtype=np.int8) + np.int8(inside)
        inside = int(marks[-1])
        hit = np.flatnonzero(marks)
        if not len(hit):
            continue
        part = (code[lo : min(hi + k - 1, n)] & 3).astype(kind)
        part = np.r_[part, np.zeros(hi - lo + k - 1 - len(part), kind)]
        forward, back = np.zeros(hi - lo, kind), np.zeros(hi - lo, kind)
        for j in range(k):
            c = part[j : j + hi - lo]
            forward = (forward << kind(2)) | c
            back |= (c ^ kind(1)) << kind(2 * j)
        canon = np.minimum(forward, back)[hit].astype(np.int64)
        text = np.searchsorted(owner_end, hit + lo, side="right")
        if k <= 5:
            size, low = 4**k, int(text[0])
            n_of = np.bincount((text - low) * size + canon)
            where = np.flatnonzero(n_of)
            yield where // size + low, where % size, n_of[where]
        else:
            order = np.lexsort((canon, text))
            t, c = text[order], canon[order]
            first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])])
            yield t[first], c[first], np.diff(np.r_[first, len(t)])


def _spelled(codes: np.ndarray, k: int) -> pa.Array:
    letters = np.frombuffer(b"ATCG", np.uint8)[(codes[:, None] >> (2 * np.arange(k - 1, -1, -1))[None]) & 3]
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer((np.arange(len(codes) + 1) * k).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


def kmers(seq: Column, k: int, skip: bool = True) -> Column:
    """Legal k-mers of a short sequence as an array, in order; whole texts are counted by ``kmer_counts``."""
    legal = f"[ACGT]{{{k}}}"
    if not skip:
        return F.regexp_extract_all(seq, F.lit(f"(?=({legal}))"), F.lit(1))
    # behind a legal k-mer the scan moves on by one letter, else it eats k letters and leaves an empty match
    return F.filter(F.regexp_extract_all(seq, F.lit(f"(?s)(?=({legal})).|.{{{k}}}"), F.lit(1)), lambda m: m != "")


def kmer_counts(df: DataFrame, key: str, seq: str, k: int, skip: bool = True) -> DataFrame:
    """(key, kmer, n) of canonical k-mers (k up to 31) of upper-case A, C, G, T; null keys and sequences have none.

    With ``skip``, an illegal k-mer moves the scan on by k, so that legal ones overlapping it are lost; without, every
    legal k-mer counts. Both agree on sequences of legal letters. Counts per text leave the scan; they are added per key.
    """
    if not 1 <= k <= 31:
        raise ValueError("k is from 1 to 31")
    narrow = df.select(F.col(key), F.col(seq).cast("string").alias("__seq")).where(F.col(key).isNotNull() & F.col("__seq").isNotNull())
    schema = T.StructType([narrow.schema.fields[0], T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, code, n in count_kmers(batch.column(1), k, skip):
                for lo in range(0, len(text), 100_000):
                    part = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[part])), _spelled(code[part], k), pa.array(n[part].astype(np.int64))], schema.names)

    return narrow.mapInArrow(run, schema).groupBy(key, "kmer").agg(F.sum("n").alias("n"))


def kmer_table(df: DataFrame, keep: list[str], seq: str, k: int, skip: bool = True) -> DataFrame:
    """The counts table of k-mers: one row per sequence or window, with its ``keep`` columns and a column for every canonical
    k-mer (k up to 5, in the order of ``canonical_kmers``), 0 where it has none.

    Rows come straight from the scan, without a shuffle; null sequences have a row of zeros.
    """
    if not 1 <= k <= 5:
        raise ValueError("the table is for k from 1 to 5")
    mers = [m for m, canon, _ in canonical_kmers(k) if m == canon]
    place = np.full(4**k, -1)
    place[[int("".join(str("ATCG".index(c)) for c in m), 4) for m in mers]] = np.arange(len(mers))
    narrow = df.select(*keep, F.coalesce(F.col(seq).cast("string"), F.lit("")).alias("__seq"))
    schema = T.StructType([*narrow.schema.fields[:-1], *[T.StructField(m, T.LongType()) for m in mers]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.zeros((batch.num_rows, len(mers)), np.int64)
            for text, code, n in count_kmers(batch.column(len(keep)), k, skip):
                np.add.at(table, (text, place[code]), n)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c) for c in table.T]], schema.names)

    return narrow.mapInArrow(run, schema)


def kmer_frequencies(counts: DataFrame, key: str) -> DataFrame:
    """Counts over the sum of the sequence's counts."""
    return counts.join(counts.groupBy(key).agg(F.sum("n").alias("ksum")), key).withColumn("freq", F.col("n") / F.col("ksum"))


def relative_abundance(freqs: DataFrame, bases: DataFrame, key: str) -> DataFrame:
    """count / (ksum * product of the letters' own shares); 0 where a share is 0. ``bases``: key, a, c, t, g."""
    letters = F.split("kmer", "")
    share = lambda x: F.when(x == "A", F.col("a")).when(x == "C", F.col("c")).when(x == "T", F.col("t")).when(x == "G", F.col("g")).otherwise(1.0)
    expected = F.aggregate(letters, F.lit(1.0), lambda a, x: a * share(x))
    return freqs.join(bases, key).withColumn("relative", F.coalesce(F.try_divide(F.col("freq"), expected), F.lit(0.0)))


def kmer_lookup(spark: SparkSession, k: int) -> DataFrame:
    """(kmer, canonical, kmer_id) for k up to 7: at most 16,384 rows, fit to be broadcast."""
    if not 1 <= k <= 7:
        raise ValueError("the table is for k from 1 to 7")
    return spark.createDataFrame(canonical_kmers(k), "kmer string, canonical string, kmer_id int")


# names -------------------------------------------------------------------------------------------------------------
FRAGMENT = r"^([!-~]+)_(\d+)\s+(\d+)-(\d+)$"


def sample_name(label: Column) -> Column:
    """What stands before ``_scaffold`` or ``_contig``; null without."""
    got = F.regexp_extract(label, r"^(.+?)_(?:scaffold|contig)", 1)
    return F.when(got != "", got)


def first_word(label: Column) -> Column:
    return F.regexp_extract(label, r"^\s*(\S+)", 1)


def fragment_parts(label: Column) -> Column:
    """(parent, number, beg, end) of a fragment's name; null if it isn't one."""
    g = lambda n: F.regexp_extract(label, FRAGMENT, n)
    return F.when(label.rlike(FRAGMENT), F.struct(g(1).alias("parent"), g(2).cast("int").alias("number"), g(3).cast("long").alias("beg"), g(4).cast("long").alias("end")))


def base_name(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
