"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

`train` counts 1- to 3-grams of letters (lower case; anything else is one separator) by language and
bucket, summed by Spark from each task's sparse counts, on at most about `rows` labelled documents.
What reaches the driver is one row for each (language, bucket): languages x BUCKETS at most, whatever
the corpus. The matrix of log probabilities is broadcast; `predict` scores batches in numpy as sums of
its rows over each text's n-grams. The score is the posterior of the predicted language.

A null text or one without letters gets `und` and score 0, as does everything if no labelled row was
found (the pipeline's stage then keeps every document that has letters: nothing tells languages apart).
Ties go to the language that comes first by code point. A very long text is read in the same chunks as
many short ones. Each row is scored by itself, so repeated rows agree; an empty table gives no rows.
Other columns stay as they are; former columns named lang_pred and score are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import bounded_sample, query, tidy

BUCKETS, ROWS, SMOOTHING, CHUNK = 1 << 16, 20_000, 0.5, 1 << 16
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(column: pa.Array, buckets: int = BUCKETS):
    """For each range of texts: its number of texts, buckets of all their n-grams (kind after kind), the
    text of each, and each text's number of letters."""
    data, offsets = words.text_buffer(column)
    for lo, hi in words.chunks(offsets, CHUNK):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        points = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.append(0, np.cumsum((part & 0xC0) != 0x80))[own]
        n = hi - lo
        # a separator before each text and at the end, so that no n-gram spans two texts
        c = np.zeros(len(points) + n + 1, np.uint64)
        text = np.repeat(np.arange(n), np.diff(at))
        c[np.arange(len(points)) + text + 1] = _letters()[points]
        owner = np.append(np.repeat(np.arange(n), np.diff(at) + 1), n - 1)
        letters = np.bincount(owner, weights=c > 0, minlength=n)
        out = []
        for k in (1, 2, 3):
            h = np.full(len(c) - k + 1, k, np.uint64)
            for j in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : len(c) - k + 1 + j]
            inner = c[: len(c) - k + 1] > 0 if k == 1 else c[1 : len(c) - k + 2] > 0 if k == 3 else (c[:-1] > 0) | (c[1:] > 0)
            who = owner[k // 2 : len(c) - k + 1 + k // 2] if k > 1 else owner
            if k == 2:  # a pair belongs to its letter's text
                who = np.where(c[1:] > 0, owner[1:], owner[:-1])
            bucket = (words.mix(h[inner]) >> np.uint64(40)).astype(np.int64) % buckets
            out.append((bucket, who[inner]))
        yield n, out, letters


def train(docs: DataFrame, rows: int = ROWS, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities (buckets + 1, languages); its last row has the priors.

    docs: text and lang; rows without lang are left out. `rows` bounds the fitting sample.
    """
    labelled = docs.filter("lang is not null")

    def count(batches):
        for batch in batches:
            names, which = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            table = np.zeros((len(names), buckets + 1), np.int64)
            lo = 0
            for n, kinds, _ in grams(batch.column(0), buckets):
                for bucket, who in kinds:
                    np.add.at(table, (which[lo + who], bucket), 1)
                table[:, buckets] += np.bincount(which[lo : lo + n], minlength=len(names))
                lo += n
            lang, bucket = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in lang], pa.string()), pa.array(bucket, pa.int32()), pa.array(table[lang, bucket], pa.int64())], ["lang", "bucket", "n"])

    sample = bounded_sample(labelled, rows).select("text", "lang")
    counted = sample.mapInArrow(tidy(count), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()))
    table = np.zeros((buckets + 1, len(names)))
    place = {x: i for i, x in enumerate(names)}
    table[counted.column("bucket").to_numpy(), [place[x] for x in counted.column("lang").to_pylist()]] = counted.column("n").to_numpy()
    if not names:
        return names, table.astype(np.float32)
    inner = table[:-1] + SMOOTHING
    logs = np.vstack([np.log(inner / inner.sum(0)), np.log(table[-1:] / table[-1].sum())])
    return names, logs.astype(np.float32)


def scores(column: pa.Array, names: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    langs, best = [], []
    for n, kinds, letters in grams(column, len(logs) - 1):
        if not names:
            langs += [UNKNOWN] * n
            best.append(np.zeros(n))
            continue
        total = np.tile(logs[-1].astype(np.float64), (n, 1))
        for bucket, who in kinds:
            if len(bucket):
                first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                total[who[first]] += np.add.reduceat(logs[bucket], first, axis=0, dtype=np.float64)
        top = total.argmax(1)
        posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        langs += [names[t] if has else UNKNOWN for t, has in zip(top, letters > 0)]
        best.append(np.where(letters > 0, posterior, 0.0))
    return langs, np.concatenate([np.zeros(0), *best])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score; the other columns stay (a former lang_pred or score goes)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    place = kept.columns.index(text)

    def label(batches):
        for batch in batches:
            langs, best = scores(batch.column(place), *shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(best, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return kept.mapInArrow(tidy(label), StructType([*kept.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model).drop("text")


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents without a language, or whose language stays in doubt, go. Where no document has a label,
    no language can be told: those without letters go, the others stay."""
    model = train(docs.select("doc_id", "text", "lang"))
    if not model[0]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # so that no column is called like a prediction
    found = predict(numbered, model, f"c{docs.columns.index('text')}")
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*numbered.columns).toDF(*docs.columns)
