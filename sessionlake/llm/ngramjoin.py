"""Operator 6: exact n-gram Jaccard self-join by vertical partitioning.

The global order of word n-grams is the order of their 64-bit hashes. It is cut into fragments, each
document's set into the segments that fall in them; fragments are counted apart and the partial
counts summed, first per document, then per pair.

1. Survey. Over the fragments in the first SHARE of the order, count for each document how many of
   its n-grams some other document has too. A partner at similarity t can lack at most (1 - t) |a| of
   a's n-grams, so a document with more than that many unshared ones links with nothing. Documents
   that pass collapse to one for each equal set. (A text is hashed whole; each few megabytes of texts
   count n-grams that two of their own documents share by themselves and send one notice, so a very
   common n-gram costs its fragment a few bytes for each such part, not for each document.)
2. Segments. For what is left, all fragments: n-grams of one document only are dropped, the others kept
   with the number of documents that have them. Each few megabytes of texts ask every fragment for the
   numbers of their distinct n-grams, so here too a very common n-gram is one entry for each such part.
3. Pivots. In the order of that number, a linked pair shares one of each set's first
   |a| - ceil(t |a|) + 1 n-grams. Each document is paired with the pivot of each such n-gram's group,
   the document whose n-grams are in the most documents on average. The partial overlaps of a pair's
   segments are counted in each band of fragments and summed; the exact similarity decides. The links found
   give first components.
4. The rest. Two documents a and b of a pivot p's group have at most
   min(|a & p|, |b & p|) + min(|a - p|, |b - p|) n-grams in common. So a link between two components
   that step 3 left apart either has min(|a & p|, |b & p|) large enough alone, and the two share a prefix
   n-gram of which p is the pivot, or they share an n-gram that p lacks. In each such group of documents
   those outside the group's largest component are compared with the others of like size; the
   largest component is never compared with itself. The pairs are counted as in step 3.

Fragments and partitions are as many as the bytes of text ask for, so no task grows with the data. Results
are exact up to collisions of 64-bit hashes of n-grams. Null or wordless text: an empty set, linked with
nothing. Fewer words than n: the sequence as one n-gram. A very long text is read in chunks. Every row is a
document of its own: rows that repeat a doc_id with other texts are not linked by that, and a component's
name is its least doc_id (null if it has none, as for a wordless row without doc_id). Other columns, whatever
they are called, are ignored by the join and kept by the pipeline's stage. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import query, small_side, stored, temporary, tidy
from .components import components

N, PERCENT, SHARE = 5, 75, 0.4
#: N-grams of a fragment, about; bytes of text for each n-gram, at least about; bands in which overlaps are counted.
POSTINGS, BYTES, BANDS = 500_000, 6, 8
#: Bytes of text, about, whose n-grams a task holds at once.
HELD = 8 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)
_NAMES = ["part", "fragment", "hashes", "docs", "notices", "info"]
_BLOBS = "part bigint, fragment int, hashes binary, docs binary, notices binary, info binary"
_COUNTS = "part bigint, docs binary, times binary, info binary"
_SURVEY = "doc_id bigint, shared bigint, n bigint, q bigint, d1 bigint, d2 bigint"
_ASKED = "part bigint, band int, fragment int, grams binary, times binary, docs binary"
_INFO = np.dtype([("doc", "<i8"), ("n", "<i8"), ("q", "<i8"), ("shared", "<i8"), ("d1", "<i8"), ("d2", "<i8")])


def shingle_sets(column: pa.Array, n: int = N):
    """For each text: its distinct n-grams as ascending hashes."""
    data, offsets = words.text_buffer(column)
    for lo, hi in words.chunks(offsets):
        own = offsets[lo : hi + 1]
        part, own = words.lower(data[own[0] : own[-1]]), own - own[0]
        starts, ends, first = words.segment(part, own)
        h = words.hashes(part, starts, ends)
        grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            grams = grams * _STEP + h[k : k + len(grams)]
        grams = words.mix(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                own_grams = np.sort(grams[a : b - n + 1])
                yield own_grams[np.append(True, own_grams[1:] != own_grams[:-1])]
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for k in range(a, b):
                    whole = whole * _STEP + h[k : k + 1]
                yield words.mix(whole)
            else:
                yield np.zeros(0, np.uint64)


def _planes(a: np.ndarray) -> bytes:
    """8-byte numbers with their first bytes together, then their second, ...: sorted ones compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(parts: list[bytes], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(8, -1).T).view(kind).ravel() for p in parts if p)])


def _held(batches):
    """Batches of (doc_id, text) cut into parts of about HELD bytes."""
    for whole in batches:
        for lo, hi in words.chunks(words.text_buffer(whole.column(1))[1], HELD):
            yield whole.slice(lo, hi - lo)


def _bounds(fragments: int, top: int) -> np.ndarray:
    return np.array([top * f // fragments for f in range(1, fragments)], np.uint64)


def _surveyed(fragments: int, share: float, n: int):
    """Batches of (doc_id, text) to the blobs of each fragment: n-grams that one document of a part has, with that document,
    and notices of those that several have (these are counted in the part)."""
    top = int(share * 2**64)
    bounds = _bounds(fragments, top)

    def spread(batches):
        part = TaskContext.get().partitionId() << 32
        for batch in _held(batches):
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            info, parts = np.zeros(len(doc_ids), _INFO), []
            info["doc"] = doc_ids
            for i, grams in enumerate(shingle_sets(batch.column(1), n)):
                own = grams[: np.searchsorted(grams, np.uint64(top))].copy() if share < 1 else grams  # a copy: the rest can go
                digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
                info["n"][i], info["q"][i], (info["d1"][i], info["d2"][i]) = len(grams), len(own), np.frombuffer(digest, "<i8")
                parts.append(own)
            all_grams = np.concatenate([np.zeros(0, np.uint64), *parts])
            index = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
            parts.clear()
            order = np.argsort(all_grams, kind="stable")
            all_grams, index = all_grams[order], index[order]
            several = np.append(all_grams[1:] == all_grams[:-1], False) if len(all_grams) else np.zeros(0, bool)
            several[1:] |= several[:-1].copy()
            info["shared"] += np.bincount(index[several], minlength=len(doc_ids))
            noted = np.unique(all_grams[several])
            all_grams, index = all_grams[~several], index[~several]
            cut, note_cut = ([0, *np.searchsorted(a, bounds).tolist(), len(a)] for a in (all_grams, noted))
            rows = [(part, f, _planes(all_grams[cut[f] : cut[f + 1]]), _planes(doc_ids[index[cut[f] : cut[f + 1]]]), _planes(noted[note_cut[f] : note_cut[f + 1]]), b"") for f in range(fragments) if cut[f] < cut[f + 1] or note_cut[f] < note_cut[f + 1]]
            if len(doc_ids):
                rows.append((part, int(doc_ids[0]) % fragments, b"", b"", b"", info.tobytes()))
            part += 1
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], _NAMES)

    return spread


def survey(docs: DataFrame, size: int, n: int = N, share: float = SHARE) -> DataFrame:
    """Of each document: n (set size), q (of these in the fragments looked at), shared (of these in other
    documents too) and d1, d2 (a digest of the set). size: bytes of all texts."""
    fragments = max(1, math.ceil(size / BYTES * share / POSTINGS))

    def counted(table: pa.Table) -> pa.Table:
        """For each part with n-grams in the fragment: its documents and how many of these n-grams others have too."""
        blobs = table.column("hashes").to_pylist()
        grams, docs = _numbers(blobs, np.uint64), _numbers(table.column("docs").to_pylist(), np.int64)
        row = np.repeat(np.arange(len(blobs)), [len(x) // 8 for x in blobs])
        noted = np.unique(_numbers(table.column("notices").to_pylist(), np.uint64))
        order = np.argsort(grams, kind="stable")
        grams, docs, row = grams[order], docs[order], row[order]
        shared = np.append(grams[1:] == grams[:-1], False) if len(grams) else np.zeros(0, bool)
        shared[1:] |= shared[:-1].copy()
        if len(noted) and len(grams):
            shared |= noted[np.minimum(np.searchsorted(noted, grams), len(noted) - 1)] == grams
        docs, row = docs[shared], row[shared]
        order = np.lexsort((docs, row))
        docs, row = docs[order], row[order]
        first = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (row[1:] != row[:-1]))) if len(docs) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(docs))).astype("<i4")
        docs = docs[first]
        at = np.searchsorted(row[first], np.arange(len(blobs) + 1)).tolist()
        cuts = list(zip(at, at[1:]))
        columns = [table.column("part"), pa.array([_planes(docs[a:b]) for a, b in cuts], pa.binary()), pa.array([times[a:b].tobytes() for a, b in cuts], pa.binary()), table.column("info")]
        return pa.table(columns, ["part", "docs", "times", "info"])

    def summed(batches):
        """The documents of a part, each with the sum of its counts."""
        for batch in batches:
            for answers in batch.column(0).to_pylist():
                info = np.sort(np.frombuffer(b"".join(x["info"] for x in answers), _INFO), order="doc")
                docs, times = _numbers([x["docs"] for x in answers], np.int64), np.frombuffer(b"".join(x["times"] for x in answers), "<i4")
                shared = info["shared"] + np.bincount(np.searchsorted(info["doc"], docs), weights=times, minlength=len(info)).astype(np.int64)
                columns = {"doc_id": info["doc"], "shared": shared} | {k: info[k] for k in ("n", "q", "d1", "d2")}
                yield pa.RecordBatch.from_pydict({k: pa.array(np.ascontiguousarray(v)) for k, v in columns.items()})

    blobs = docs.select("doc_id", "text").mapInArrow(tidy(_surveyed(fragments, share, n)), _BLOBS).repartition(fragments, "fragment")
    counts = blobs.groupBy("fragment").applyInArrow(counted, _COUNTS).filter("length(docs) > 0 or length(info) > 0")
    answers = counts.groupBy("part").agg(F.collect_list(F.struct("docs", "times", "info")).alias("answers")).select("answers")
    return answers.mapInArrow(tidy(summed), _SURVEY)


def segments(docs: DataFrame, postings: int, n: int = N) -> DataFrame:
    """The n-grams that at least two of the documents have: band, doc_id, grams, and beside each n-gram its
    number of documents. Fragments hold about POSTINGS of all postings; a band is a run of fragments."""
    fragments = BANDS * max(1, math.ceil(postings / POSTINGS / BANDS))
    bounds = _bounds(fragments, 2**64)

    def ask(batches):
        """Of each part and fragment: the part's distinct n-grams, how many of its documents have each, and which."""
        part = TaskContext.get().partitionId() << 32
        for batch in _held(batches):
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sets = list(shingle_sets(batch.column(1), n))
            grams = np.concatenate([np.zeros(0, np.uint64), *sets])
            owner = np.repeat(doc_ids, [len(x) for x in sets])
            sets.clear()
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            distinct, first, times = np.unique(grams, return_index=True, return_counts=True)
            cut = [0, *np.searchsorted(distinct, bounds).tolist(), len(distinct)]
            first = np.append(first, len(grams))
            rows = [(part, f * BANDS // fragments, f, _planes(distinct[a:b]), times[a:b].astype("<i4").tobytes(), _planes(owner[first[a] : first[b]])) for f, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
            part += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], ["part", "band", "fragment", "grams", "times", "docs"])

    def answer(table: pa.Table) -> pa.Table:
        """For each part that asks: the number of documents with each of its n-grams."""
        blobs = table.column("grams").to_pylist()
        grams = _numbers(blobs, np.uint64)
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), "<i4").astype(np.int64)
        _, which = np.unique(grams, return_inverse=True)
        total = np.minimum(np.bincount(which, weights=times), 2**31 - 1)[which].astype("<i4")
        at = np.append(0, np.cumsum([len(x) // 8 for x in blobs]))
        return pa.table({"part": table.column("part"), "band": table.column("band"), "fragment": table.column("fragment"), "totals": pa.array([total[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())})

    def cut(batches):
        """The documents of a part and band, each with those of its n-grams that several have."""
        for batch in batches:
            for band, asked, answers in zip(*(batch.column(i).to_pylist() for i in range(3))):
                times = np.concatenate([np.frombuffer(x["times"], "<i4") for x in asked])
                spread = np.repeat(np.concatenate([np.frombuffer(x["totals"], "<i4") for x in answers]), times)
                keep = spread > 1
                grams = np.repeat(_numbers([x["grams"] for x in asked], np.uint64), times)[keep]
                ids, spread = _numbers([x["docs"] for x in asked], np.int64)[keep], spread[keep]
                order = np.argsort(ids, kind="stable")
                grams, ids, spread = grams[order], ids[order], spread[order]
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
                at = pa.array(np.append(first, len(ids)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (grams.view(np.int64), spread.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), band, np.int32)), pa.array(ids[first]), *lists], ["band", "doc_id", "grams", "spread"])

    def in_order(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("part", "band").agg(F.array_sort(F.collect_list(F.struct("fragment", *columns))).alias(name))

    asked = stored(docs.select("doc_id", "text").mapInArrow(tidy(ask), _ASKED))
    totals = asked.select("part", "band", "fragment", "grams", "times").repartition(fragments, "fragment").groupBy("fragment").applyInArrow(answer, "part bigint, band int, fragment int, totals binary")
    both = in_order(asked, "asked", "grams", "times", "docs").join(in_order(totals, "answers", "totals"), ["part", "band"])
    return both.select("band", "asked", "answers").mapInArrow(tidy(cut), "band int, doc_id bigint, grams array<bigint>, spread array<int>")


def _least_common(percent: int, size):
    """ceil(percent * size / 100) on columns."""
    return F.expr(f"cast(({percent} * {size} + 99) div 100 as bigint)")


def prefixes(parts: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The n-grams of which a document must share one with each partner: doc_id, n, gram, and how typical the document is."""
    whole = parts.groupBy("doc_id").agg(F.flatten(F.collect_list(F.arrays_zip("spread", "grams"))).alias("own")).join(sizes, "doc_id")
    whole = whole.withColumn("typical", F.aggregate("own", F.lit(0).cast("bigint"), lambda s, x: s + x.spread) / F.col("n"))
    need = F.col("n") - _least_common(percent, "n") + 1 - (F.col("n") - F.size("own"))
    return whole.withColumn("need", need.cast("int")).filter("need > 0").select("doc_id", "n", "typical", F.explode(F.slice(F.array_sort("own"), F.lit(1), F.col("need"))).alias("g")).select("doc_id", "n", "typical", F.col("g.grams").alias("gram"))


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """pairs (a, b, na, nb), for each band of fragments: the number of common n-grams and those of a that b lacks."""
    own = parts.select("band", "doc_id", "grams")
    left = pairs.join(own.select(F.col("doc_id").alias("a"), "band", F.col("grams").alias("ga")), "a")
    both = left.join(own.select(F.col("doc_id").alias("b"), "band", F.col("grams").alias("gb")), ["b", "band"], "left")
    none = F.array().cast("array<bigint>")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", F.coalesce("gb", none))).alias("part"), F.array_except("ga", F.coalesce("gb", none)).alias("outside"))


def _linked(percent: int):
    return 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))


def _compared(rows: DataFrame, on: list[str], percent: int, test: Column) -> DataFrame:
    """Pairs a, b, na, nb of the groups `on` that `test` allows: of different components (c), of sizes within percent,
    one of the two outside the group's largest component. Sizes are met by bucket, each as wide as a partner can be off."""
    names, step = ("n", "common", "apart", "reach", "c"), math.log(100 / percent)
    bucket = F.floor(F.log(F.col("n")) / step)
    largest = rows.groupBy(*on, "c").agg(F.count("*").alias("members")).groupBy(*on).agg(F.max_by("c", F.struct("members", "c")).alias("main"), F.count("*").alias("several")).filter("several > 1").drop("several")
    mixed = stored(rows.join(stored(largest), on).withColumn("bucket", bucket))
    y = mixed.select(*on, "bucket", F.col("a").alias("b"), *(F.col(k).alias(f"{k}b") for k in names), (F.col("c") == F.col("main")).alias("mainb"))
    x = mixed.filter("c <> main").select(*on, "a", *(F.col(k).alias(f"{k}a") for k in names), F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    pairs = x.join(y, [*on, "bucket"]).filter((F.col("ca") != F.col("cb")) & (F.col("mainb") | (F.col("a") < F.col("b"))) & near & test)
    turned = F.col("a") > F.col("b")
    pick = lambda p, q, name: F.when(turned, F.col(q)).otherwise(F.col(p)).alias(name)
    return pairs.select(pick("a", "b", "a"), pick("b", "a", "b"), pick("na", "nb", "na"), pick("nb", "na", "nb"))


def _rest(counted: DataFrame, versus: DataFrame, members: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Pairs of step 4: a, b, na, nb. counted: each document a against its pivots b; members: the n-grams by which a came to
    b; joined: components so far."""
    group = counted.join(joined, counted.a == joined.node, "left").select(F.col("b").alias("p"), "a", F.col("na").alias("n"), "common", "apart", F.coalesce("component", "a").alias("c"))
    spans = group.groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).filter("lo < hi").select("p", "least")
    # reach: the largest partner with which the n-grams shared with p alone can make a link
    group = stored(group.join(spans, "p").withColumn("reach", F.expr(f"{100 + percent} * common div {percent}") - F.col("n")))
    if group.isEmpty():
        return counted.select("a", "b", "na", "nb").limit(0)
    by_prefix = members.select(F.lit(0).alias("way"), F.col("b").alias("p"), "gram", "a").join(group.filter("reach >= least"), ["p", "a"])
    lacking = versus.select(F.lit(1).alias("way"), F.col("b").alias("p"), "a", F.explode("outside").alias("gram")).join(group, ["p", "a"])
    inside = (F.col("nb") <= F.col("reacha")) & (F.col("na") <= F.col("reachb"))
    most = (100 + percent) * (F.least("commona", "commonb") + F.least("aparta", "apartb")) >= percent * (F.col("na") + F.col("nb"))
    found = _compared(by_prefix.unionByName(lacking), ["way", "p", "gram"], percent, F.when(F.col("way") == 0, inside).otherwise(most))
    tested = counted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.distinct().join(tested, ["a", "b"], "left_anti")


def _components_of(docs: DataFrame, size: int, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, copies of documents with a doc_id of their own each and `size` bytes of text."""
    found = stored(survey(docs, size, n))
    alive = found.filter((F.col("n") > 0) & (F.col("q") - F.col("shared") <= F.col("n") - _least_common(percent, "n")))
    classes = stored(alive.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")))
    reps = classes.select(F.col("rep").alias("doc_id"), "n")
    few, postings = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = stored(segments(docs.join(small_side(reps.select("doc_id"), few), "doc_id"), postings, n))
    enough = parts.groupBy("doc_id").agg(F.sum(F.size("grams")).alias("shared")).join(reps, "doc_id").filter(F.col("shared") >= _least_common(percent, "n"))
    sizes = stored(enough.select("doc_id", "n"))
    keys = stored(prefixes(parts.join(sizes.select("doc_id"), "doc_id", "left_semi"), sizes, percent))

    # Pivots and members are stored, so that Spark may split the partitions of a common n-gram where they are joined.
    pivots = stored(keys.groupBy("gram").agg(F.min_by(F.struct("doc_id", "n"), F.struct(-F.col("typical"), F.col("doc_id"))).alias("p"), F.count("*").alias("docs")).filter("docs > 1").select("gram", F.col("p.doc_id").alias("b"), F.col("p.n").alias("nb")))
    members = stored(keys.select("gram", F.col("doc_id").alias("a"), F.col("n").alias("na")).join(pivots, "gram").filter("a <> b"))
    around = members.select("a", "b", "na", "nb").distinct()
    versus = stored(overlaps(around, parts))
    counted = stored(versus.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"), F.sum(F.size("outside")).alias("apart")))
    known = counted.filter(_linked(percent)).select("a", "b")
    joined = components(known)

    second = stored(_rest(counted, versus, members, joined, percent))
    sums = overlaps(second, parts).groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))
    more = stored(sums.filter(_linked(percent)).select("a", "b"))
    if not more.isEmpty():
        joined = components(known.unionByName(more))

    reached = classes.join(joined, classes.rep == joined.node, "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"), "copies")
    result = found.join(reached, ["d1", "d2"], "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.coalesce("copies", F.lit(1))).otherwise(1).alias("copies"))


def _looked_over(docs: DataFrame) -> tuple[bool, int]:
    """Whether every row has a doc_id of its own, and the bytes of all texts."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("size"))
    found = ids.agg(F.count_if(F.col("doc_id").isNull() | (F.col("rows") > 1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return found[0] == 0, found[1]


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, copies of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with temporary(docs.sparkSession) as keep:
        own_ids, size = _looked_over(docs)
        if own_ids:
            return keep(stored(_components_of(docs, size, n, percent)))
        rows = stored(docs.select("*", F.monotonically_increasing_id().alias("node")))
        found = stored(_components_of(rows.select(F.col("node").alias("doc_id"), "text"), size, n, percent))
        named = rows.select("node", F.col("doc_id").alias("named")).join(found, F.col("node") == found.doc_id).drop("doc_id")
        least = stored(named.groupBy("component_id").agg(F.min("named").alias("least")))
        return keep(stored(named.join(least, "component_id").select(F.col("named").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), "copies")))


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
with recursive w as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as words from documents
), g as (
  select rid, doc_id, case when len(words) = 0 then [] when len(words) < {N} then [array_to_string(words, ' ')]
    else list_distinct(list_transform(generate_series(1, len(words) - {N - 1}), lambda i: array_to_string(words[i:i + {N - 1}], ' '))) end as grams from w
), s as (select rid, doc_id, len(grams) as n, list_sort(grams) as grams from g
), k as (select grams, min(rid) as rep, any_value(n) as n from s where n > 0 group by grams
), e as (select rep, n, unnest(grams) as gram from k
), p as (select a.rep as a, b.rep as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common from e a join e b on a.gram = b.gram and a.rep < b.rep and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) group by all
), l as (select a, b from p where 100 * common >= {PERCENT} * (na + nb - common)
), t as (select a as u, b as v from l union all select b, a from l
), r(node, other) as (select rep, rep from k union select r.node, t.v from r join t on t.u = r.other
), x as (select node, min(other) as root from r group by node
), m as (select s.rid, s.doc_id, s.n, s.grams, x.root from s left join k on s.n > 0 and s.grams = k.grams left join x on x.node = k.rep
), c as (select root, min(doc_id) as least from m where root is not null group by root)
select m.doc_id, cast(m.n as bigint) as n_shingles, case when m.root is null then m.doc_id else c.least end as component_id,
  cast(case when m.n = 0 then 1 else count(*) over (partition by m.grams) end as bigint) as copies from m left join c using (root)
"""


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the row with the least doc_id stays (rows without come last; of rows
    that share it, any one), and so does every document without words."""
    if _looked_over(docs)[0]:
        gone = stored(jaccard_components(docs).filter("component_id <> doc_id").select("doc_id"))
        return docs.join(small_side(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    rows = stored(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("node"), "doc_id", "text"))
    found = jaccard_components(rows.select(F.col("node").alias("doc_id"), "text")).filter("n_shingles > 0").select(F.col("doc_id").alias("node"), "component_id")
    named = rows.select("node", "doc_id").join(found, "node")
    stays = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "node")).alias("first")).select("component_id", F.col("first.node").alias("kept"))
    gone = stored(named.join(stays, "component_id").filter("node <> kept").select("node"))
    return rows.join(small_side(gone, gone.count()), "node", "left_anti").select("row.*")
