"""Operator 11, sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at `VIRTUAL` places of a ring of 64-bit hashes; these depend on the shard's number alone. A row's
key is its text, so equal texts stand at one place. A row belongs to the first virtual node clockwise from it. A shard
takes no more rows than its quota: m rows over n shards are m // n each, and one more for the first m % n, so counts
are at most one apart (law `rows`). A shard takes what is offered to it in the order of the ring; what is left goes on
to the next virtual node of a shard that still has room, and so on until all rows have a place. After each such round
a shard is full or nothing is left, so there are no more rounds than shards.

Rows are brought into the order of the ring by range, with the rows' ids and places of reading as last keys, so rows
of one text may lie in many tasks. What the driver sees is one count for each of the shards' virtual nodes, a number
fixed by parameters; the table of segments it makes of them has at most a row for each node and each pair of shards.

Defined cases: a null text is the empty text; repeated rows are rows of their own; a group of equal texts stays in one
shard unless that is full, then its rest goes on; an empty table gives an empty table; further columns of the input
stay, and those named `shard` or `slot` are replaced. Rows without an id come first among equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, lean, load, ranked, ship

SHARDS = 40
VIRTUAL = 1024


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in ascending order, and the shard that each stands for."""
    at = np.array([xxhash.xxh64_intdigest(f"{s}/{v}", 42) for s in range(shards) for v in range(virtual)], np.uint64).astype(np.int64)
    by = np.argsort(at, kind="stable")
    return at[by], np.repeat(np.arange(shards), virtual)[by]


def settle(counts: np.ndarray, owner: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where rows go, by place in the ring's order: starts of segments, their shards, and the slots of their first rows.

    `counts` are rows before each virtual node and, last, behind the last of them, which belong to the first.
    """
    room, left, slot = room.copy(), counts.copy(), np.zeros(len(room), np.int64)
    begin = np.cumsum(counts) - counts
    to = np.append(np.arange(len(owner)), 0)
    found = []
    while left.any():
        arc = np.flatnonzero(left)
        shard = owner[to[arc]]
        by = np.lexsort((arc, shard))
        arc, shard = arc[by], shard[by]
        offered = left[arc]
        end = np.cumsum(offered)
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        before = end - offered - np.repeat((end - offered)[first], np.diff(np.append(first, len(arc))))
        taken = np.clip(room[shard] - before, 0, offered)
        some = taken > 0
        found.append((begin[arc[some]], shard[some], slot[shard[some]] + before[some]))
        np.add.at(slot, shard, taken)
        np.subtract.at(room, shard, taken)
        begin[arc] += taken
        left[arc] -= taken
        open_ = np.flatnonzero(room[owner] > 0)
        if len(open_):
            over = np.flatnonzero(left)
            to[over] = open_[np.searchsorted(open_, to[over], side="right") % len(open_)]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, shard, base = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(start)
    return start[by], shard[by], base[by]


def assign(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, text: str = "text", key: str = "doc_id", place: str | None = None) -> DataFrame:
    """All columns of `docs`, with `shard` (0 to shards - 1) and `slot` (from 0, without gaps, in each shard).

    With `place`, that column holds the 64-bit place on the ring in place of the text's hash, so texts needn't be moved.
    """
    spark = docs.sparkSession
    ship(spark)
    at, owner = ring(shards, virtual)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    kept = [c for c in names if c != place]
    pos = F.col(place) if place else F.xxhash64(F.coalesce(text, F.lit("")))
    read = Stored(docs.select(F.struct(*kept).alias("doc"), pos.alias("pos"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    rows = ranked(read.df, ["pos", "key", "row"], "shard-ring")

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(at) + 1, np.int64)
        for b in batches:
            total += np.bincount(np.searchsorted(at, b.column(0).to_numpy()), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["arc", "n"])

    # one row for each virtual node at most
    met = rows.select("pos").mapInArrow(lean(arcs), "arc long, n long").groupBy("arc").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(at) + 1, np.int64)
    for r in met:
        counts[r["arc"]] = r["n"]
    total = int(counts.sum())
    start, shard, base = settle(counts, owner, np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            k = np.searchsorted(start, rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(shard[k].astype(np.int32)), pa.array(base[k] + rank - start[k])], ["doc", "shard", "slot"])

    out = rows.select("doc", "rank").mapInArrow(lean(put), f"doc {rows.schema['doc'].dataType.simpleString()}, shard int, slot long")
    return out.select(*[F.col("doc").getField(c).alias(c) for c in kept], "shard", "slot")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = load(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("place"))
    out = assign(docs, place="place")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
