"""Operator 13: where the tokens of two tokenizers end together, each distinct text once.

`measured` shuffles the documents by their full text and keeps one row with its number of copies; each distinct
text is tokenized by both tokenizers and cut into groups at the byte offsets where tokens of both end. Every
token has at least one byte, so each group ends with exactly one link, the pair of its last A and last B token.
A text's links are kept as distinct pairs with counts. `pair_totals` sums them, weighted by copies, over the corpus;
`scored` brings the totals back to the texts, and `align` joins a text's measures to all its doc_ids by the
text's SHA-256.

A and B tokens always end together before a space between two ordinary characters (ASCII other than controls,
Latin letters): the byte-level pattern starts a token with such a space, and no piece of B holds a space after
another character (checked when B is loaded; without that, or with a normalizer in A, texts are not cut). So a
text is aligned in units cut there, and each worker remembers the units it has met (the last KEPT to 2 KEPT of
them; longer ones than LONG characters are not kept). Only new units go to the tokenizers.

Texts that are null, empty, or that either tokenizer doesn't give back byte for byte have no tokens: all
measures 0 and an empty digest. A very long text is read unit by unit; one without any space is a single unit.
Copies, also a third of all rows, are one row a task before they are shuffled, and join their text's measures
from a stored table, so that Spark may split that join's large partitions. A frequent pair is one row a task
too; totals are broadcast only if they are few, else Spark shuffles both sides. Rows that repeat a doc_id, or with a
null one, are measured each by itself. Other columns are ignored, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, query, small_side, stored, temporary, tidy

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Units a worker remembers (and as many of a generation before), the longest of them, units in one call of a tokenizer, characters of a text read at once.
KEPT, LONG, CALL, STRETCH = 250_000, 64, 4096, 1 << 18
#: A link (a, b) as one number: a * SHIFT + b.
SHIFT = 1 << 20
#: Spaces between ordinary characters.
CUT = re.compile(r"(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")
MEASURED = "text_key string, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<bigint>, counts array<bigint>"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A), public_tokenizers.path(B)


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 bytes as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entries = self.a.get_vocab(True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = self.a.normalizer is None and not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.shown = [f"{i}{mark}" for t, end in ((self.a_size, "|"), (self.b_size, ";")) for mark in (",", end) for i in range(len(t))]
        #: Units met since the last change of generation, and those of the generation before; a unit of that one that is met again moves over.
        self.known: dict[str, tuple | None] = {}
        self.former: dict[str, tuple | None] = {}

    def units(self, text: str):
        """The text's units, without the space that each begins with, in lists of about STRETCH characters."""
        at = 0
        while self.cuts and at + STRETCH < len(text) and (m := CUT.search(text, at + STRETCH)):
            yield CUT.split(text[at : m.start()])
            at = m.end()
        yield CUT.split(text[at:]) if self.cuts else [text]

    def learn(self, units: list[str]):
        """Of each unit: numbers of A and B tokens, the groups as text, the links; None if a tokenizer doesn't give it back."""
        for at in range(0, len(units), CALL):
            some = units[at : at + CALL]
            a = [x.ids for x in self.a.encode_batch_fast([" " + u for u in some], add_special_tokens=False)]
            b = self.b.encode(some, num_threads=1)
            raw = [b" " + u.encode() for u in some]
            good = [i for i, x in enumerate(raw) if b"".join(map(self.a_bytes.__getitem__, a[i])) == x == b"".join(map(self.b_bytes.__getitem__, b[i]))]
            for i in set(range(len(some))).difference(good):
                yield some[i], None
            yield from zip([some[i] for i in good], self._aligned([a[i] for i in good], [b[i] for i in good]))

    def _aligned(self, a: list[list[int]], b: list[list[int]]):
        """The same, for units that both tokenizers give back, all at once: their bytes stand one after the other."""
        n_a, n_b = ([len(x) for x in ids] for ids in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, sum(n)) for ids, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        other = np.searchsorted(ends_b, ends_a)
        last_a, last_b = ends_b[other] == ends_a, np.zeros(len(flat_b), bool)
        last_b[other[last_a]] = True
        links = (flat_a[last_a] * SHIFT + flat_b[last_b]).tolist()
        # A group's A ids, then its B ids: each as text with the mark that follows it.
        order = np.argsort(np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1]), kind="stable")
        shown = np.concatenate([flat_a + last_a * len(self.a_size), 2 * len(self.a_size) + flat_b + last_b * len(self.b_size)])[order]
        text, closed = list(map(self.shown.__getitem__, shown.tolist())), np.append(0, np.cumsum(last_a))
        at = token = 0
        for x, y in zip(n_a, n_b):
            lo, hi = closed[token], closed[token + x]
            yield x, y, "".join(text[at : at + x + y])[:-1], tuple(links[lo:hi])
            at, token = at + x + y, token + x

    def _found(self, units: list[str]) -> list[tuple | None]:
        if len(self.known) > KEPT:
            self.former, self.known = self.known, {}
        new, long = [], {}
        for u in set(units).difference(self.known):
            if u in self.former:
                self.known[u] = self.former[u]
            else:
                new.append(u)
        for u, x in self.learn(new):
            (self.known if len(u) <= LONG else long)[u] = x
        return [long[u] if u in long else self.known[u] for u in units] if long else list(map(self.known.__getitem__, units))

    def align(self, text: str) -> tuple:
        """n_a, n_b, n_groups, digest, and the Counter of links; zeros for a text without tokens."""
        n_a = n_b = 0
        digest, links = hashlib.sha256(), Counter()
        for nth, units in enumerate(self.units(text) if text else ()):
            found = self._found(units)
            if None in found:
                return 0, 0, 0, "", Counter()
            n_a, n_b = n_a + sum(x[0] for x in found), n_b + sum(x[1] for x in found)
            links.update(chain.from_iterable(x[3] for x in found))
            digest.update((";" * (nth > 0) + ";".join([x[2] for x in found])).encode())
        return n_a, n_b, links.total(), digest.hexdigest() if text else "", links


_aligners: dict[tuple, Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """The worker's aligner for these files; it stays for later tasks."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def text_key(text: str) -> Column:
    return F.sha2(text, 256)


def measured(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row for each distinct text that isn't null or empty: its key, copies, measures and links."""
    known_a, known_b = paths()
    a, b = a or known_a, b or known_b

    def rows(batches):
        own = aligner(a, b)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(lo, 256)
                for i in range(part.num_rows):
                    text = part.column(0)[i].as_py()
                    *facts, links = own.align(text)
                    out.append((hashlib.sha256(text.encode()).hexdigest(), part.column(1)[i].as_py(), *facts, list(links), list(links.values())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], [x.split()[0] for x in MEASURED.split(", ")])

    return docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).mapInArrow(tidy(rows), MEASURED)


def pair_totals(texts: DataFrame) -> DataFrame:
    """link, total (links of the corpus that hold it) and whether no other link of its B id has more; stored."""
    pairs = texts.select("copies", F.explode(F.arrays_zip("links", "counts")).alias("x"))
    totals = stored(pairs.groupBy(F.col("x.links").alias("link")).agg(F.sum(F.col("x.counts") * F.col("copies")).alias("total")))
    b = F.pmod(F.col("link"), F.lit(SHIFT)).alias("b")
    most = totals.groupBy(b).agg(F.max("total").alias("most"))
    out = stored(totals.withColumn("b", b).join(most, "b").select("link", "total", (F.col("total") == F.col("most")).alias("best")))
    discard(totals)
    return out


def scored(texts: DataFrame, totals: DataFrame) -> DataFrame:
    """text_key, n_best, count_sum of each text with links."""
    pairs = texts.select("text_key", F.explode(F.arrays_zip("links", "counts")).alias("x")).select("text_key", F.col("x.links").alias("link"), F.col("x.counts").alias("n"))
    met = pairs.join(small_side(totals, totals.count()), "link")
    return met.groupBy("text_key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs."""
    with temporary(docs.sparkSession) as keep:
        texts = stored(measured(docs, a, b))
        found = scored(texts, pair_totals(texts))
        facts = keep(stored(texts.select("text_key", "n_a", "n_b", "n_groups", "groups_sha256").join(found, "text_key", "left")))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key("text").alias("text_key")).join(facts, "text_key", "left")
    number = lambda c, name: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(name)
    return own.select("doc_id", number("n_a", "n_a"), number("n_b", "n_b"), number("n_groups", "n_groups"), number("n_groups", "n_links"), number("n_best", "n_best"), number("count_sum", "count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
