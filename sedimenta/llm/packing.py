"""Filling fixed-capacity containers with texts: vector best-fit, in independent shards.

Every container has three capacities: tokens, number of texts, and attention cost (the sum of squared lengths). Items
come longest first; an item goes to the open container that it fits under every constraint and whose weighted residual
is smallest in norm afterwards (or whose residual has the largest weighted dot product with the item); if none fits it,
a new one opens. Texts longer than the token capacity are cut into full containers and a rest, all others stay whole.
Shards are made by a hash of the text's id: each holds a bounded number of items, none depends on another, and all but
the last few containers of a shard are filled as well as in one run over everything.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a shard on average; tokens that a text is thought to take at least, which sets the number of texts.
SHARD_ITEMS, TOKENS_PER_TEXT = 8_192, 8
#: Weights of tokens, texts and attention in the choice of a container.
WEIGHTS = (1.0, 0.05, 0.05)
#: Kinds of containers at most; the table is a handful of rows.
KINDS_MAX = 1_000


def best_fit(sizes: np.ndarray, capacity: int, max_texts: int, max_attention: float, score: str = "residual", weights: Sequence[float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(container, place within it) of each item; ``sizes`` come in the order of packing and none exceeds ``capacity``.

    An item that breaks the limit of texts or attention all alone has a container to itself.
    """
    w = np.asarray(weights, float)
    full = np.array([capacity, max_texts, max_attention], float)
    left = np.zeros((3, 1024))
    name = np.zeros(1024, np.int64)
    filled: list[int] = []
    n_open = 0
    where, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    least = np.minimum.accumulate(sizes[::-1])[::-1] if len(sizes) else sizes
    for k, size in enumerate(sizes.tolist()):
        need = np.array([size, 1.0, float(size) * size])
        rest = left[:, :n_open] - need[:, None]
        fits = np.flatnonzero((rest >= 0).all(0))
        if len(fits):
            if score == "dot":
                value = -(w * need / full**2) @ left[:, fits]
            else:
                value = w @ (rest[:, fits] / full[:, None]) ** 2
            at = int(fits[value.argmin()])
            left[:, at] -= need
        else:
            if n_open == left.shape[1]:
                left, name = np.hstack([left, np.zeros_like(left)]), np.r_[name, np.zeros_like(name)]
            at, n_open = n_open, n_open + 1
            left[:, at] = full - need
            name[at] = len(filled)
            filled.append(0)
        box = int(name[at])
        where[k], place[k] = box, filled[box]
        filled[box] += 1
        # a container that takes none of the items to come is closed
        if k + 1 < len(sizes) and (left[0, at] < least[k + 1] or left[1, at] < 1 or left[2, at] < float(least[k + 1]) ** 2):
            n_open -= 1
            left[:, at], name[at] = left[:, n_open], name[n_open]
    return where, place


def kinds_of(containers: DataFrame) -> list[tuple[str, int]]:
    """(kind, capacity) rows of the container table, whose size is checked."""
    rows = containers.select("container_kind", "capacity_tokens").where("container_kind IS NOT NULL AND capacity_tokens > 0").distinct().limit(KINDS_MAX + 1).collect()
    if len(rows) > KINDS_MAX:
        raise ValueError(f"more than {KINDS_MAX} kinds of containers")
    return sorted((r[0], r[1]) for r in rows)


def limits(kinds: Sequence[tuple[str, int]], max_texts=None, max_attention=None) -> dict[str, tuple[int, int, float]]:
    """(tokens, texts, attention) that a container of each kind takes at most; limits are numbers or functions of the capacity."""
    of = lambda given, cap, default: default if given is None else given(cap) if callable(given) else given
    return {k: (cap, int(of(max_texts, cap, max(1, cap // TOKENS_PER_TEXT))), float(of(max_attention, cap, float(cap) * cap))) for k, cap in kinds}


def pack(sized: DataFrame, kinds: Sequence[tuple[str, int]], score: str = "residual", max_texts=None, max_attention=None, weights: Sequence[float] = WEIGHTS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers of every kind filled with all texts of ``sized`` (doc_id, n_tokens): one row per text or piece of one.

    Result: ``container_kind``, ``container_id``, ``place`` (from 0), ``doc_id``, ``piece_no`` (from 0), ``token_beg``,
    ``token_end`` (exclusive). ``max_texts`` and ``max_attention`` (numbers, or functions of the capacity) hold for a
    container of each kind; by default they are capacity / 8 texts and the cost of one text that fills it, which no texts
    within the capacity exceed.

    * texts up to the capacity are never cut; longer ones give full containers and one rest;
    * null ids or sizes take no part; texts of 0 tokens are packed as they are and take a place;
    * repeated rows are packed repeatedly; an empty table gives an empty result; other columns play no part.
    """
    spec = limits(kinds, max_texts, max_attention)
    items = sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n")).where("doc_id IS NOT NULL AND n >= 0")
    shards = max(1, -(-items.count() // shard_items))
    every = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("cap")) for k, c in kinds]) if kinds else F.array().cast("array<struct<container_kind:string,cap:bigint>>")
    of_kind = items.select("doc_id", "n", F.explode(every).alias("c")).select("doc_id", "n", "c.container_kind", "c.cap")
    pieces = of_kind.select("doc_id", "container_kind", "cap", "n", F.explode(F.sequence(F.lit(0), F.expr("int(greatest(0, (n - 1) div cap))"))).alias("piece_no"))
    pieces = pieces.select("container_kind", "cap", "doc_id", "piece_no", (F.col("piece_no") * F.col("cap")).alias("token_beg"), F.least("n", (F.col("piece_no") + 1) * F.col("cap")).alias("token_end"))
    is_full = (F.col("token_end") - F.col("token_beg")) == F.col("cap")
    whole = pieces.where(is_full).select("container_kind", F.concat_ws("-", "container_kind", F.lit("full"), "doc_id", "piece_no").alias("container_id"), F.lit(0).alias("place"), "doc_id", "piece_no", "token_beg", "token_end")
    loose = pieces.where(~is_full).withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(shards)).cast("int"))

    def fill(t: pa.Table) -> pa.Table:
        kind, shard = t.column("container_kind")[0].as_py(), t.column("shard")[0].as_py()
        t = t.append_column("size", pa.compute.subtract(t.column("token_end"), t.column("token_beg")))
        t = t.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece_no", "ascending")])
        box, place = best_fit(t.column("size").to_numpy(), *spec[kind], score, weights)
        ids = pa.array([f"{kind}-{shard}-{b}" for b in box.tolist()])
        return pa.table({"container_kind": t.column("container_kind"), "container_id": ids, "place": pa.array(place.astype(np.int32)), **{c: t.column(c) for c in ("doc_id", "piece_no", "token_beg", "token_end")}})

    text = "container_kind string, container_id string, place int, doc_id long, piece_no int, token_beg long, token_end long"
    packed = loose.groupBy("container_kind", "shard").applyInArrow(fill, text)
    return packed.unionByName(whole)


def fill_report(packed: DataFrame, kinds: Sequence[tuple[str, int]]) -> DataFrame:
    """Per kind: containers, texts, pieces, tokens, and the share of space that stays unused."""
    capacity = F.create_map(*[x for k, c in kinds for x in (F.lit(k), F.lit(c))]) if kinds else F.lit(None).cast("map<string,int>")
    boxes = packed.groupBy("container_kind", "container_id").agg(F.sum(F.col("token_end") - F.col("token_beg")).alias("used"), F.count("*").alias("pieces"))
    told = boxes.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return told.withColumn("capacity_tokens", capacity[F.col("container_kind")]).withColumn("unused_share", F.lit(1.0) - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


def pack_check(packed: DataFrame, sized: DataFrame, kinds: Sequence[tuple[str, int]], max_texts=None, max_attention=None) -> DataFrame:
    """What must hold of a packing, per kind: how many texts there are, and how often each rule is broken.

    ``n_texts`` placed; ``n_torn`` texts whose pieces don't follow each other from the first token to the last, or that are
    cut although they would fit; ``n_over`` containers over a limit that hold more than one piece (one piece may break the
    limit of texts or attention alone, but never that of tokens); ``n_gaps`` containers whose places aren't 0, 1, 2 ...
    """
    spec = packed.sparkSession.createDataFrame([(k, *v) for k, v in limits(kinds, max_texts, max_attention).items()], "container_kind string, cap long, most long, cost double")
    size = (F.col("token_end") - F.col("token_beg")).alias("size")
    rows = packed.select("*", size).join(F.broadcast(spec), "container_kind")
    used = rows.groupBy("container_kind", "container_id", "cap", "most", "cost").agg(F.sum("size").alias("used"), F.count("*").alias("n"), F.sum(F.col("size").cast("double") * F.col("size")).alias("paid"), F.max("place").alias("last"), F.countDistinct("place").alias("places"))
    over = (F.col("used") > F.col("cap")) | (F.col("n") > 1) & ((F.col("n") > F.col("most")) | (F.col("paid") > F.col("cost")))
    boxes = used.groupBy("container_kind").agg(F.count_if(over).alias("n_over"), F.count_if((F.col("last") != F.col("n") - 1) | (F.col("places") != F.col("n"))).alias("n_gaps"))
    pieces = rows.groupBy("container_kind", "doc_id", "cap").agg(F.count("*").alias("n"), F.min("token_beg").alias("b"), F.max("token_end").alias("e"), F.sum("size").alias("size"))
    whole = pieces.join(sized.select("doc_id", "n_tokens"), "doc_id")
    torn = (F.col("b") != 0) | (F.col("e") != F.col("n_tokens")) | (F.col("size") != F.col("n_tokens")) | (F.col("n") != F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("cap"))))
    return whole.groupBy("container_kind").agg(F.count("*").alias("n_texts"), F.count_if(torn).alias("n_torn")).join(boxes, "container_kind")
