"""Operator 10: best-fit packing of tokenized documents with certified bin counts.

`pieces` tokenizes each document (its end id included) and cuts only those longer than a sequence.
`pack` deals pieces to groups of about GROUP rows by a hash, packs each group best-fit decreasing and
certifies it: dual feasible functions give a lower bound on the bins any packing of the group needs.
Groups above their bound exchange the pieces of bins that are not full, and every group those of its
emptiest bin (where its bound was rounded up): these are dealt anew with another hash and packed again,
for at most ROUNDS rounds, each kept only if it needs fewer bins.

Null text counts as empty (one piece, the end id). Rows that repeat a doc_id are packed each by
itself, also where one id or one text stands on a great part of all rows: a group that the hash makes
more than HOT times too large is dealt once more, row by row. Ties are broken by doc_id and piece, so
reruns agree (after such a deal, over the same files). A very long text becomes many pieces. Other columns
than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import discard, query, small_side, stored, tidy

CAPACITY, GROUP, ROUNDS, HOT = 2048, 4096, 3, 4
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint, filled bigint, gap bigint"


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    vocabulary = vocabulary or tokens.default_vocabulary()

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encoded(batch.column(1), vocabulary)):
                whole = np.append(ids, np.uint32(end_id)).astype("<u4")
                for i, at in enumerate(range(0, len(whole), capacity)):
                    own = whole[at : at + capacity]
                    out.append((doc_id, i, at, len(own), zlib.crc32(own.tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(tidy(cut), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of these lengths needs, by dual feasible functions.

    Each function maps lengths so that no bin's mapped lengths exceed 1; the sum over all lengths,
    rounded up, is then a bound. Used are the identity, the step functions u_k and the threshold
    functions that round lengths above capacity - a up to a full bin and those below a down to none.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    best = -(-int((count * sizes).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    number, mass = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * sizes))
    a = np.arange(capacity // 2 + 1)
    whole = number[-1] - number[capacity - a + 1]
    middle = mass[capacity - a + 1] - mass[a]
    return max(best, int((whole + -(-middle // capacity)).max()))


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given (longest first for best-fit decreasing)."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room they have
    rooms, used = 0, 0  # rooms: bit r is set if some bin has room r
    for i, size in enumerate(lengths.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            own, room, used = used, capacity, used + 1
        bins[i], offsets[i] = own, capacity - room
        if room > size:
            free[room - size].append(own)
            rooms |= 1 << (room - size)
    return bins, offsets


def _round(rows: DataFrame, turn: int, group: int, capacity: int) -> DataFrame:
    """One packing of all rows, with each bin's filled length and its group's gap (at least 1 for the emptiest bin)."""
    groups = max(1, math.ceil(rows.count() / group))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        pdf["sequence_id"] = (turn << 56) + (int(key[0]) << 24) + bins
        pdf["offset"], pdf["filled"] = offsets, filled[bins]
        gap = len(filled) - lower_bound(lengths, capacity)
        pdf["gap"] = np.maximum(gap, bins == filled.argmin())
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "filled", "gap"]]

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = rows.select(*names, F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("dealt"))
    hot = stored(dealt.groupBy("dealt").count().filter(F.col("count") > HOT * group).select("dealt", F.ceil(F.col("count") / group).alias("parts")))
    found, parts = hot.agg(F.count("*"), F.coalesce(F.sum("parts"), F.lit(0))).first()
    if found:
        side = small_side(hot.select("dealt"), found)
        row = F.monotonically_increasing_id()  # of stored rows: the same if a task runs again
        again = dealt.withColumn("row", row).join(side, "dealt").select(*names, (F.pmod(F.xxhash64(F.lit(turn), "row"), F.lit(parts)) + groups).alias("dealt"))
        dealt = dealt.join(side, "dealt", "left_anti").select(*names, "dealt").unionByName(again)
    packed_rows = stored(dealt.groupBy("dealt").applyInPandas(packed, PACKED))
    discard(hot)
    return packed_rows


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """rows (as from `pieces`, already stored) with sequence_id, offset, filled and gap."""
    kept = _round(rows, 0, group, capacity)
    for turn in range(1, rounds + 1):
        loose = (F.col("gap") > 0) & (F.col("filled") < capacity)
        pool = kept.filter(loose)
        before = pool.agg(F.countDistinct("sequence_id")).first()[0]
        if before < 2:
            break
        again = _round(pool, turn, group, capacity)
        if again.agg(F.countDistinct("sequence_id")).first()[0] >= before:
            discard(again)
            break
        merged = stored(kept.filter(~loose).unionByName(again))
        discard(kept, again)
        kept = merged
    return kept


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed documents (repeats by themselves) packed into sequences."""
    return pack(stored(pieces(docs))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
