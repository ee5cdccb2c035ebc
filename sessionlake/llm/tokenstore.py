"""Operator 3: token ids on disk, each document compressed by itself with one shared dictionary.

`write` trains a zstandard dictionary on the serialized ids of a bounded sample (SAMPLE documents),
deals the documents out by ranges of doc_id, and writes one Parquet row per block of documents:

    shard, block       where the block stands; shards and blocks ascend with doc_id
    first_id, last_id  the least and greatest doc_id in it (null if it holds null ids only)
    doc_ids            the block's documents, ascending
    n_tokens           ids of each, end id included
    token_start        ids before each, within the shard
    frame_at           offset of each document's frame in `frames`, and the end
    frames             the zstandard frames, one after the other
    dictionary         SHA-256 of the dictionary ('' if there is none)
    id_bytes           2 or 4 bytes for each id, little-endian

`read` gives the documents with their ids back, `fetch` the named ones: it reads the blocks whose range
holds an id (Parquet's statistics skip the others) and decompresses those documents' frames alone, on the
executors. Spark's writer commits the blocks, so the files may lie in any store and a lost executor costs
its own tasks only.

Null text counts as empty (the end id alone). Null doc_ids come first. Rows that repeat a doc_id are
all stored, ordered by a hash of their texts; the ranges that are dealt out go by that hash and a row
number too, so one id on all rows is still many shards. A very long text is one frame. Other columns than
doc_id and text are ignored. An empty table gives no blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import bounded_sample, query, shared_dir, tidy

#: Documents that the dictionary is fitted on, about, and serialized bytes of each that count at most.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1000, 64 << 10, 64 << 10, 3
BLOCK_DOCS, BLOCK_BYTES = 256, 4 << 20
SCHEMA = "shard int, block int, first_id bigint, last_id bigint, doc_ids array<bigint>, n_tokens array<bigint>, token_start array<bigint>, frame_at array<bigint>, frames binary, dictionary string, id_bytes int"
DOCUMENT = "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids binary"


def id_bytes(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(True) <= 1 << 16 else 4


def _serialized(ids: np.ndarray, end_id: int, width: int) -> bytes:
    return np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()


def train(docs: DataFrame, vocabulary: str, end_id: int, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of about `size` bytes from about `sample` documents (of long ones, the first SAMPLE_BYTES); b'' if they are too few."""
    width = id_bytes(vocabulary)

    def serialize(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_serialized(x, end_id, width)[:SAMPLE_BYTES] for x in tokens.encoded(batch.column(0), vocabulary)], pa.binary())], ["ids"])

    rows = bounded_sample(docs.select("doc_id", "text"), sample).select("text").mapInArrow(serialize, "ids binary").collect()
    samples = sorted(bytes(r.ids) for r in rows)
    size = min(size, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, level: int = LEVEL, sample: int = SAMPLE) -> None:
    """Write the documents' ids below `path`: blocks/ and dictionary/."""
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.default_vocabulary()
    width, raw = id_bytes(vocabulary), train(docs, vocabulary, end_id, sample)
    name = hashlib.sha256(raw).hexdigest() if raw else ""
    spark.createDataFrame([(name, bytearray(raw))], "dictionary string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches):
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_content_size=True)
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, starts, frames = [], [], [], []

        def block():
            at = [0, *np.cumsum([len(f) for f in frames]).tolist()]
            known = [i for i in doc_ids if i is not None]
            row = {"shard": shard, "block": number, "first_id": min(known, default=None), "last_id": max(known, default=None), "doc_ids": doc_ids, "n_tokens": sizes, "token_start": starts, "frame_at": at, "frames": b"".join(frames), "dictionary": name, "id_bytes": width}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encoded(batch.column(1), vocabulary)):
                frame = packer.compress(_serialized(ids, end_id, width))
                doc_ids.append(doc_id), sizes.append(len(ids) + 1), starts.append(start), frames.append(frame)
                start += len(ids) + 1
                if len(frames) == BLOCK_DOCS or sum(map(len, frames[-1:])) > BLOCK_BYTES or len(frames) % 16 == 0 and sum(map(len, frames)) > BLOCK_BYTES:
                    yield block()
                    number += 1
                    doc_ids, sizes, starts, frames = [], [], [], []
        if frames:
            yield block()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(blocks), SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("doc_ids", "n_tokens", "token_start", "frame_at")), ("frames", pa.binary()), ("dictionary", pa.string()), ("id_bytes", pa.int32())])


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first().bytes)


def _unpacker(raw: bytes, name: str) -> zstandard.ZstdDecompressor:
    if name != (hashlib.sha256(raw).hexdigest() if raw else ""):
        raise ValueError(f"a block names the dictionary {name!r}, which is not the one in dictionary/")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)


def _documents(row: dict, unpacker: zstandard.ZstdDecompressor, only: frozenset | None = None):
    view, at = memoryview(row["frames"]), row["frame_at"]
    for i, doc_id in enumerate(row["doc_ids"]):
        if only is None or doc_id in only:
            ids = np.frombuffer(unpacker.decompress(view[at[i] : at[i + 1]]), f"<u{row['id_bytes']}").astype("<u4")
            yield doc_id, row["token_start"][i], ids


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The stored documents: doc_id, start (ids of all documents before it), n_tokens and their ids as
    little-endian 32-bit numbers, or with `digest` only ids_crc32 of those bytes."""
    raw = _dictionary(spark, path)
    blocks = spark.read.schema(SCHEMA).parquet(f"{path}/blocks")

    def decode(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for doc_id, start, ids in _documents(row, _unpacker(raw, row["dictionary"])):
                    out.append((doc_id, row["shard"], start, len(ids), zlib.crc32(ids.tobytes()) if digest else ids.tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], ["doc_id", "shard", "shard_start", "n_tokens", "last"])

    # One row a shard, and a shard is a task of the writing job: the driver's list is as long as that job's.
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).orderBy("shard").collect()
    before, known = 0, []
    for r in totals:
        known.append((r.shard, before))
        before += r.n
    starts = spark.createDataFrame(known, "shard int, before bigint")
    last = "ids_crc32" if digest else "ids"
    found = blocks.mapInArrow(decode, f"doc_id bigint, shard int, shard_start bigint, n_tokens bigint, last {'bigint' if digest else 'binary'}")
    return found.join(F.broadcast(starts), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", F.col("last").alias(last))


def fetch(spark: SparkSession, path: str, *doc_ids: int) -> DataFrame:
    """doc_id and ids (little-endian 32-bit numbers) of these documents; an id that rows repeat comes as often."""
    raw, only = _dictionary(spark, path), frozenset(doc_ids)
    blocks = spark.read.schema(SCHEMA).parquet(f"{path}/blocks")
    near = reduce(or_, ((F.col("first_id") <= i) & (F.col("last_id") >= i) for i in doc_ids), F.lit(False))
    own = blocks.filter(near & F.arrays_overlap("doc_ids", F.array(*(F.lit(i).cast("bigint") for i in doc_ids)).cast("array<bigint>")))

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = [(d, ids.tobytes()) for d, _, ids in _documents(row, _unpacker(raw, row["dictionary"]), only)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["doc_id", "ids"])

    return own.select("doc_ids", "token_start", "frame_at", "frames", "dictionary", "id_bytes").mapInArrow(unpack, "doc_id bigint, ids binary")


@query
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path, digest=True)
