"""Operator 12: passages of K words that an earlier document holds go, by super-k-mer partitioning.

A window is K consecutive words of one document. Its minimiser is the least hash of the GRAM-word runs in
it. `super_kmers` cuts each document where the minimiser changes: consecutive windows that share one
travel as one string of at most 2 K - 1 words to that minimiser's bucket, so a word is sent about three
times and not K times. `judged` sorts a bucket's windows by hash and document, compares the bytes of
windows with equal hashes, and gives for each document the windows that a smaller doc_id holds too.
`removed` brings the words they cover back to their documents.

Hot groups. A task remembers the strings it has sent (SEEN of them, then anew): of a string that it sent for a
smaller doc_id it sends no copy, but says at once that this document's windows go. So a passage that stands
in a third of all documents arrives in its bucket about once a task. Buckets with more than HOT different
strings (a common phrase as minimiser, many near copies) are found by a count and cut once more: each of their windows
travels by itself to the bucket of its own hash. Nothing is dropped either way. The texts are cut once for the count
and once to be sent, which costs less than to store three times their size.

Rows with null text have no words; those with null doc_id keep all theirs and remove none of others. Rows that
repeat doc_id and text are judged alike; rows of one doc_id with different texts don't remove each other's
words. A very long text is read in pieces of about a megabyte. Other columns are ignored, whatever they are
called. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import query, small_side, stored, temporary, tidy

K, GRAM = 50, 8
#: Different strings in a bucket from which on its windows are dealt out one by one; strings and documents a task remembers; bytes of text cut at once.
HOT, SEEN, PIECE = 20_000, 50_000, 1 << 20
BASE = 0x9E3779B97F4A7C15
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Ranges of words [lo, hi); a row with `packed` stands for hi - lo - K + 1 windows at each lo, one without for words that go.
ROW = "doc_id bigint, h bigint, key bigint, lo array<bigint>, hi array<bigint>, packed binary"
MARK = "doc_id bigint, h bigint, lo array<bigint>, hi array<bigint>"
_ROW = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("key", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())), ("packed", pa.binary())])
_MARK = pa.schema([f for f in _ROW if f.name in ("doc_id", "h", "lo", "hi")])


def pieces(raw: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in stretches of about `size` bytes that end between words."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + size)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()  # without an argument, bytes are split at 0x20 and 0x09-0x0D
        at = end


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _run_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` word hashes, from sums of powers."""
    n = len(hashed)
    power = np.cumprod(np.append(np.uint64(1), np.full(n, BASE, np.uint64)))
    back = np.cumprod(np.append(np.uint64(1), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)))
    total = np.append(np.uint64(0), np.cumsum(hashed * power[:n]))
    return words.mix((total[size:] - total[:-size]) * back[: n - size + 1])


def cut(raw: bytes, k: int = K, gram: int = GRAM, size: int = PIECE) -> Iterator[tuple[int, int, int, bytes]]:
    """The super-k-mers of a text: bucket, first word, number of windows (at most k), words joined by one space."""
    tail: list[bytes] = []
    base = 0
    for piece in pieces(raw, size):
        own = tail + piece
        if len(own) >= k:
            joined = b" ".join(own)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
            starts = np.append(0, ends[:-1] + 1)
            least = _sliding_min(_run_hashes(words.hashes(np.frombuffer(joined, np.uint8), starts, ends), gram), k - gram + 1)
            first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
            length = np.diff(np.append(first, len(least)))
            parts = -(-length // k)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at = np.repeat(first, parts) + nth * k
            number = np.minimum(np.repeat(first + length, parts) - at, k)
            keys = least[at].view(np.int64)
            for key, i, n, s, e in zip(keys.tolist(), at.tolist(), number.tolist(), starts[at].tolist(), ends[at + number + k - 2].tolist()):
                yield key, base + i, n, joined[s:e]
        tail = own[-(k - 1) :] if k > 1 else []
        base += len(own) - len(tail)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


class _Sent:
    """What a task has sent, and the rows it has yet to give on."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}
        self.rows: list[tuple] = []

    def document(self, doc_id: int, h: int, parts) -> None:
        """parts: (key, windows, words a window covers, first words, string)"""
        own: dict[bytes, tuple] = {}
        gone: list[tuple[int, int]] = []
        for key, n, width, firsts, packed in parts:
            own.setdefault(packed, (key, n + width - 1, []))[2].extend(firsts)
        for packed, (key, length, firsts) in own.items():
            other = self.seen.get(packed)
            if other is not None and other < doc_id:
                gone += [(i, i + length) for i in firsts]
                continue
            if len(self.seen) >= SEEN:
                self.seen.clear()
            self.seen[packed] = doc_id
            self.rows.append((doc_id, h, key, firsts, [i + length for i in firsts], packed))
        if gone:
            lo, hi = zip(*merged(gone))
            self.rows.append((doc_id, h, None, lo, hi, None))

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_ROW), _ROW.types)], schema=_ROW)


def _cut_rows(k: int, gram: int):
    def rows(batches):
        sent, known = _Sent(), set()
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, h, raw = (batch.column(c)[i].as_py() for c in range(3))
                if (doc_id, h) in known:  # a row that repeats another
                    continue
                if len(known) >= SEEN:
                    known.clear()
                known.add((doc_id, h))
                sent.document(doc_id, h, ((key, n, k, [at], packed) for key, at, n, packed in cut(raw, k, gram)))
                if len(sent.rows) >= 4096:
                    yield sent.taken()
        yield sent.taken()

    return rows


def _known(docs: DataFrame) -> DataFrame:
    known = docs.filter("doc_id is not null and text is not null")
    return known.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("h"), F.col("text").cast("binary"))


def super_kmers(docs: DataFrame, k: int = K, gram: int = GRAM) -> DataFrame:
    """doc_id and text -> ROW: strings for their buckets, and words that are known to go (without a bucket)."""
    return _known(docs).mapInArrow(tidy(_cut_rows(k, gram)), ROW)


def hot_buckets(docs: DataFrame, k: int = K, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key of the buckets that get more than `hot` strings; stored. The texts are cut for this alone, as only counts are shuffled."""

    def keys(batches):
        for batch in _cut_rows(k, gram)(batches):
            yield pa.RecordBatch.from_arrays([batch.column(2)], ["key"])

    sent = _known(docs).mapInArrow(tidy(keys), "key bigint").filter("key is not null")
    return stored(sent.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"))


def _dealt(rows: DataFrame, k: int) -> DataFrame:
    """ROW and `hot` -> ROW: the windows of hot buckets as rows of their own, for the bucket of their own hash; other rows as they are."""

    def split(batches):
        sent = _Sent()
        for batch in batches:
            yield batch.filter(pa.compute.invert(batch.column(6))).select(_ROW.names)
            for r in batch.filter(batch.column(6)).to_pylist():
                own = r["packed"].split()
                texts = [b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)]
                sent.document(r["doc_id"], r["h"], ((int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True), 1, k, [x + i for x in r["lo"]], t) for i, t in enumerate(texts)))
                if len(sent.rows) >= 4096:
                    yield sent.taken()
        yield sent.taken()

    return rows.mapInArrow(tidy(split), ROW)


def _earlier(packed: list[bytes], docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of all strings: the string, the place in it, and whether a smaller document holds the window."""
    raw = b"".join(packed)
    data, offsets = np.frombuffer(raw, np.uint8), np.append(0, np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed))))
    starts, ends, first = words.segment(data, offsets)
    size = np.diff(first) - k + 1
    string = np.repeat(np.arange(len(packed)), size)
    place = np.arange(len(string)) - np.repeat(np.cumsum(size) - size, size)
    at = first[string] + place
    hashed, doc = _run_hashes(words.hashes(data, starts, ends), k)[at], docs[string]
    order = np.lexsort((doc, hashed))
    new = np.append(True, hashed[order][1:] != hashed[order][:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]  # the window of the least doc_id with this hash
    gone = np.zeros(len(order), bool)
    gone[order] = doc[order] > doc[head]
    s, e = starts[at], ends[at + k - 1]
    other = np.empty(len(order), np.int64)
    other[order] = head
    repeated = np.flatnonzero(gone)
    differ = [i for i, a, b, c, d in zip(repeated.tolist(), s[repeated].tolist(), e[repeated].tolist(), s[other[repeated]].tolist(), e[other[repeated]].tolist()) if raw[a:b] != raw[c:d]]
    if differ:  # different windows with one hash: these hashes' windows are told apart by their bytes
        among = np.flatnonzero(np.isin(hashed, hashed[differ])).tolist()
        least: dict[bytes, int] = {}
        for i in among:
            text = raw[s[i] : e[i]]
            least[text] = min(least.get(text, doc[i]), doc[i])
        for i in among:
            gone[i] = doc[i] > least[raw[s[i] : e[i]]]
    return string, place, gone


def judged(rows: DataFrame, k: int = K) -> DataFrame:
    """ROW -> MARK: words of each document that windows of smaller documents cover. Rows without a string are such words already."""

    def marks(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        docs = table.column("doc_id").to_numpy()
        string, place, gone = _earlier(table.column("packed").to_pylist(), docs, k)
        found = np.flatnonzero(gone)
        found: dict[int, list[int]] = {i: p.tolist() for i, p in zip(*_grouped(string[found], place[found]))}
        hs, los, out = table.column("h").to_pylist(), table.column("lo"), []
        for i, places in found.items():
            lo, hi = zip(*merged([(x + p, x + p + k) for x in los[i].as_py() for p in places]))
            out.append((int(docs[i]), hs[i], lo, hi))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(_MARK), _MARK.types)], schema=_MARK)

    def buckets(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            known = batch.filter(batch.column(5).is_null())
            if len(known):
                yield known.select(_MARK.names)
            batch = batch.filter(batch.column(5).is_valid())
            keys = batch.column(2).to_numpy()
            if not len(keys):
                continue
            new = np.flatnonzero(keys[1:] != keys[:-1])
            begins = not held or held[-1].column(2)[len(held[-1]) - 1].as_py() != keys[0]
            last = int(new[-1]) + 1 if len(new) else 0 if begins else None  # where the last bucket, which may go on, begins
            if last is None:
                held.append(batch)
                continue
            held.append(batch.slice(0, last))
            if any(len(x) for x in held):
                yield marks(pa.Table.from_batches(held))
            held = [batch.slice(last)]
        if any(len(x) for x in held):
            yield marks(pa.Table.from_batches(held))

    # Rows without a string are dealt out by their documents.
    return rows.withColumn("key", F.coalesce("key", "h")).repartition("key").sortWithinPartitions("key").mapInArrow(tidy(buckets), MARK)


def _grouped(keys: np.ndarray, values: np.ndarray):
    """Distinct ascending keys, and the values of each (keys come in ascending order)."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at].tolist(), np.split(values, at[1:]) if len(at) else []


def removed(docs: DataFrame, k: int = K, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, h (xxhash64 of the text) and `ranges` of word numbers [lo, hi) that go, of each document that loses any; stored."""
    with temporary(docs.sparkSession) as keep:
        rows = super_kmers(docs, k, gram)
        common = hot_buckets(docs, k, gram, hot)
        number = common.count()
        if number:
            side = small_side(common.withColumn("hot", F.lit(True)), number)
            rows = _dealt(rows.join(side, "key", "left").select(*_ROW.names, F.coalesce("hot", F.lit(False)).alias("hot")), k)
        marks = judged(rows, k).select("doc_id", "h", F.explode(F.arrays_zip("lo", "hi")).alias("range"))
        # A set: rows that repeat a document in different tasks give the same ranges, and none of them twice.
        return keep(stored(marks.groupBy("doc_id", "h").agg(F.collect_set("range").alias("ranges"))))


def kept(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words that stay, joined by one space."""

    def digests(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc_id, raw, gone = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b"", batch.column(2)[i].as_py() or []
                gone, base, dropped, digest, begun = merged([(r["lo"], r["hi"]) for r in gone]), 0, 0, hashlib.sha256(), False
                for own in pieces(raw):
                    stay, at = [], 0
                    for lo, hi in gone:
                        lo, hi = max(lo - base, at), min(hi - base, len(own))
                        if lo < hi:
                            stay += own[at:lo]
                            dropped, at = dropped + hi - lo, hi
                    stay += own[at:]
                    if stay:
                        digest.update((b" " if begun else b"") + b" ".join(stay))
                        begun = True
                    base += len(own)
                out.append((doc_id, base, dropped, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    numbers = ranges.agg(F.coalesce(F.sum(F.size("ranges") * 2 + 2), F.lit(0))).first()[0]
    both = own.join(small_side(ranges, numbers), ["doc_id", "h"], "left")
    return both.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"), "ranges").mapInArrow(tidy(digests), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


@query
def op12_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return kept(docs, removed(docs))


_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '{_W}'), []::varchar[]) as w from documents
), x as (select r, doc_id, unnest(range(1, len(w) - {K - 2})) as i, w from d
), g as (select r, doc_id, i, md5(array_to_string(w[i:i + {K - 1}], ' ')) as p from x
), m as (select p, min(doc_id) as first_id from g group by p
), c as (select distinct r, unnest(range(i, i + {K})) as j from g join m using (p) where first_id < doc_id
), a as (select r, list(j) as gone from c group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, j: not list_contains(coalesce(gone, []), j)), ' '), '')) as kept_sha256
from d left join a using (r)
"""
