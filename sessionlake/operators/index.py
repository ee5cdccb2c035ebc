"""Search index: trigram and tag postings over blocks of rows, and what a regular expression requires of them.

`build` writes rows sorted by (session, order), numbered in blocks of 32 rows (a block lies in one file), and for every trigram
of a block's texts and every tag of its rows a posting. Postings are rows (key, span, blocks): a span is 4,096 blocks in a
row, so no list grows with the data however common a key is. `grep` and `mentions` evaluate what the search requires on the few
postings it names, read only the files with a candidate block, and then search the rows of these as `search` does: the
result is the scan's.

Trigrams are three characters (code points), ASCII letters in lower case, with the four other letters that
match an ASCII letter when case is ignored. Texts are cut in pieces of 64 K characters that overlap by two, so a very
long text needs no more memory than a short one. Rows with null or shorter texts have no trigrams and can be found by tags,
or by searches that require none. Empty tables give an empty index.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search
from .normalize import KEY, ORDER

BLOCK_BITS, SPAN_BITS = 5, 12
PIECE = 1 << 16
#: Requirements name at most this many trigrams of one literal, spread over it; fewer only means more candidates.
PER_LITERAL = 12
#: Up to so many files are read by name, and so many candidate blocks are sent to all tasks; beyond that all files, or all blocks
#: of the files, are searched.
FILES, BLOCKS = 10_000, 200_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters that equal an ASCII letter when case is ignored: Kelvin sign, long s, dotless i, dotted I.
_FROM, _TO = _UPPER + "Kſıİ", _UPPER.lower() + "ksii"
_FOLD = str.maketrans(_FROM, _TO)


# -- what a pattern requires ---------------------------------------------------------------------------
# A requirement is a key, ("and", parts), ("or", parts), or None where nothing is required.


def both(a, b):
    return b if a is None else a if b is None or a == b else ("and", [a, b])


def either(a, b):
    return None if a is None or b is None else a if a == b else ("or", [a, b])


def literal(text: str):
    """All trigrams of a text, or those that are sure to be the same in each of its spellings."""
    text = text.translate(_FOLD)
    sure = lambda c: c.isascii() or unicodedata.category(c) == "Lo"
    grams = [text[i : i + 3] for i in range(len(text) - 2) if all(map(sure, text[i : i + 3]))]
    step = max(1, -(-len(grams) // PER_LITERAL))
    need = None
    for gram in dict.fromkeys(grams[::step] + grams[-1:]):
        need = both(need, gram)
    return need


@dataclass
class _Part:
    """What a piece of a pattern matches: one of a few texts, if `exact` is known; else something that requires `need`."""

    exact: frozenset[str] | None
    need: object = None

    def required(self):
        if self.exact is None:
            return self.need
        first, *rest = [literal(x) for x in sorted(self.exact)] or [None]
        for other in rest:
            first = either(first, other)
        return first


class _Unknown(ValueError):
    """A form whose requirement isn't worked out: the pattern then requires nothing."""


_ANY, _NOTHING = _Part(None), _Part(frozenset([""]))
_FEW = 16


def _sequence(parts: list[_Part]) -> _Part:
    """Parts one after the other: exact texts are joined as long as they are few, then required."""
    need, run, broken = None, _NOTHING, False
    for part in parts:
        if part.exact is not None and len(run.exact) * len(part.exact) <= _FEW:
            run = _Part(frozenset(a + b for a in run.exact for b in part.exact))
            continue
        need, broken = both(need, run.required()), True
        run, extra = (part, None) if part.exact is not None else (_NOTHING, part.need)
        need = both(need, extra)
    return _Part(None, both(need, run.required())) if broken else run


def _alternatives(options: list[_Part]) -> _Part:
    if all(o.exact is not None for o in options) and sum(len(o.exact) for o in options) <= _FEW:
        return _Part(frozenset().union(*(o.exact for o in options)))
    need = options[0].required()
    for o in options[1:]:
        need = either(need, o.required())
    return _Part(None, need)


class _Reader:
    """Reads a pattern of java.util.regex from left to right. Only the forms that people search with are taken
    apart; others raise _Unknown."""

    CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "a": "\a", "e": "\x1b"}

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.p[self.i : self.i + n]

    def take(self, n: int = 1) -> str:
        found = self.peek(n)
        if len(found) < n:
            raise _Unknown
        self.i += n
        return found

    def whole(self) -> _Part:
        part = self.options()
        if self.i < len(self.p):
            raise _Unknown
        return part

    def options(self) -> _Part:
        found = [[]]
        while (c := self.peek()) and c != ")":
            if c == "|":
                self.take()
                found.append([])
            else:
                found[-1].append(self.repeated(self.single()))
        return _alternatives([_sequence(parts) for parts in found])

    def repeated(self, part: _Part) -> _Part:
        c = self.peek()
        if not c or c not in "*+?{":
            return part
        self.take()
        least = 1 if c == "+" else 0
        if c == "{":
            counts = ""
            while (d := self.take()) != "}":
                counts += d
            low, comma, high = counts.partition(",")
            if not low.isdigit() or high and not high.isdigit():
                raise _Unknown
            least = int(low)
            if counts == "1":
                return self.lazily(part)
        if c == "?" and part.exact is not None:
            return self.lazily(_Part(part.exact | {""}))
        return self.lazily(_Part(None, part.required()) if least else _ANY)

    def lazily(self, part: _Part) -> _Part:
        if self.peek() and self.peek() in "?+":
            self.take()
        if self.peek() and self.peek() in "*+?{":
            raise _Unknown
        return part

    def single(self) -> _Part:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.set_of_characters()
        if c == "\\":
            return self.escape()
        if c == ".":
            return _ANY
        if c in "^$":
            return _NOTHING
        if c in "*+?{":
            raise _Unknown
        return _Part(frozenset([c]))

    def group(self) -> _Part:
        aside = False
        if self.peek() == "?":
            self.take()
            if self.peek(2) in ("<=", "<!"):
                self.take(2)
                aside = True
            elif self.peek() in ("=", "!"):
                self.take()
                aside = True
            elif self.peek() == "<":
                while self.take() != ">":
                    pass
            elif self.peek() in (":", ">"):
                self.take()
            else:
                flags = ""
                while (c := self.take()) not in ":)":
                    flags += c
                if not set(flags) <= set("imsu"):
                    raise _Unknown
                if c == ")":
                    return _NOTHING
        part = self.options()
        if self.take() != ")":
            raise _Unknown
        return _ANY if aside else part

    def set_of_characters(self) -> _Part:
        """Few plain characters stand for themselves; ranges, classes and complements for anything."""
        found, plain = set(), self.peek() != "^"
        if not plain:
            self.take()
        if self.peek() == "]":
            raise _Unknown
        while (c := self.take()) != "]":
            if c in "[&":
                raise _Unknown
            if c == "\\":
                part = self.escape()
                plain, c = plain and part.exact is not None, next(iter(part.exact or {""}))
                plain = plain and c != ""
            if self.peek() == "-" and self.peek(2) != "-]":
                plain = False
                self.take()
                continue
            found.add(c)
        return _Part(frozenset(found)) if plain and len(found) <= 4 else _ANY

    def escape(self) -> _Part:
        c = self.take()
        if c in self.CONTROL:
            return _Part(frozenset([self.CONTROL[c]]))
        if c in "xu":
            try:
                return _Part(frozenset([chr(int(self.take(2 if c == "x" else 4), 16))]))
            except ValueError:
                raise _Unknown from None
        if c in "dDsSwWhHvVRX" or c in "123456789":
            return _ANY
        if c in "bBAzZG":
            return _NOTHING
        if c in "pP":
            if self.take() == "{":
                while self.take() != "}":
                    pass
            return _ANY
        if c.isalnum():
            raise _Unknown
        return _Part(frozenset([c]))


def required(pattern: str):
    """What a text must hold for the pattern to match somewhere in it, case ignored. None: nothing is known."""
    try:
        return _Reader(pattern).whole().required()
    except _Unknown:
        return None


def tagged(name: str, values: list[str]):
    """One of these values of a tag column."""
    need = None
    for k, value in enumerate(values):
        key = _tag_key(name, value)
        need = key if k == 0 else either(need, key)
    return need


def _tag_key(name: str, value: str) -> str:
    return f"tag {name}={value}"


def keys_of(need) -> set[str]:
    return set() if need is None else {need} if isinstance(need, str) else set().union(*map(keys_of, need[1]))


# -- the index ---------------------------------------------------------------------------------------


def fold(text: str | Column) -> Column:
    return F.translate(text, _FROM, _TO)


def _grams(rows: DataFrame, text: str) -> DataFrame:
    """Each block's trigrams."""
    whole = rows.filter(F.length(text) >= 3).select("block", fold(F.col(text)).alias("t"))
    starts = F.sequence(F.lit(1), F.length("t"), F.lit(PIECE))
    pieces = whole.select("block", F.explode(F.transform(starts, lambda i: F.substring(F.col("t"), i, F.lit(PIECE + 2)))).alias("t"))
    return pieces.select("block", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("(?s)(?=(...))"), F.lit(1)))).alias("key"))


def build(rows: DataFrame, path: str, text: str = "text", tags: list[str] = [], by: list[str] = KEY, order: list[str] = ORDER, files: int | None = None) -> None:
    """Write rows and their postings below `path`. Columns named `block` or starting with `_` are refused, as are tags
    that are not strings. files: into how
    many ranges of rows; Spark decides by their size if it isn't given."""
    if clash := [c for c in rows.columns if c == "block" or c.startswith("_")]:
        raise ValueError(f"columns that the index needs itself: {clash}")
    if other := [c for c in tags if rows.schema[c].dataType.simpleString() != "string"]:
        raise ValueError(f"tags that are not strings: {other}")
    spark = rows.sparkSession
    number = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    ranges = rows.repartitionByRange(files, *by, *order) if files else rows.repartitionByRange(*by, *order)
    ranges.sortWithinPartitions(*by, *order).withColumn("block", number).write.parquet(f"{path}/rows")
    kept = spark.read.parquet(f"{path}/rows")
    postings = _grams(kept, text)
    for name in tags:
        postings = postings.unionByName(kept.filter(F.col(name).isNotNull()).select("block", F.concat(F.lit(_tag_key(name, "")), F.col(name)).alias("key")))
    lists = postings.groupBy("key", F.shiftright("block", SPAN_BITS).alias("span")).agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    lists.repartitionByRange("key", "span").sortWithinPartitions("key", "span").write.parquet(f"{path}/postings")
    kept.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("block").alias("first"), F.max("block").alias("last")).write.parquet(f"{path}/files")
    spark.createDataFrame([(json.dumps({"text": text, "tags": tags, "by": by}),)], "value string").coalesce(1).write.text(f"{path}/settings")


def settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/settings").first()[0])


def candidates(spark: SparkSession, path: str, need) -> DataFrame:
    """The blocks that may hold what is required: each span's posting lists, at most 4,096 blocks long, cut and united."""
    keys = sorted(keys_of(need))
    named = reduce(Column.__or__, (F.col("key").isin(keys[i : i + 10]) for i in range(0, len(keys), 10)))  # longer lists are pushed as one range
    postings = spark.read.parquet(f"{path}/postings").filter(named)
    spans = postings.groupBy("span").agg(*(F.first(F.when(F.col("key") == k, F.col("blocks")), ignorenulls=True).alias(f"k{i}") for i, k in enumerate(keys)))
    none = F.array().cast("array<bigint>")

    def lists(part) -> Column:
        if isinstance(part, str):
            return F.coalesce(F.col(f"k{keys.index(part)}"), none)
        joined = [lists(p) for p in part[1]]
        out = joined[0]
        for other in joined[1:]:
            out = F.array_intersect(out, other) if part[0] == "and" else F.array_union(out, other)
        return out

    return spans.select(F.explode(lists(need)).alias("block"))


def narrowed(spark: SparkSession, path: str, need) -> DataFrame:
    """The rows of the index that can hold what is required, and perhaps more. Only files with a candidate block are read."""
    everything = spark.read.parquet(f"{path}/rows")
    if need is None:
        return everything.drop("block")
    found = candidates(spark, path, need)
    files = spark.read.parquet(f"{path}/files")
    # a file's blocks share their upper bits, the number of the task that wrote it
    part = F.shiftright("block", 33 - BLOCK_BITS)
    per_file = found.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high"))
    hit = files.withColumn("part", F.shiftright("first", 33 - BLOCK_BITS)).join(per_file, "part").filter("low <= last and high >= first")
    chosen = hit.select("file", "n").limit(FILES + 1).collect()
    if not chosen:
        return everything.limit(0).drop("block")
    some = everything if len(chosen) > FILES else spark.read.schema(everything.schema).parquet(*[f"{path}/rows/{r.file}" for r in chosen])
    if len(chosen) > FILES or sum(r.n for r in chosen) > BLOCKS:
        return some.drop("block")
    return some.join(F.broadcast(found), "block", "left_semi").drop("block")


def grep(spark: SparkSession, path: str, pattern: str, around: int = 80, **tags: list[str]) -> DataFrame:
    """`search.grep` over the indexed rows, those with one of the given values of each tag."""
    made = settings(spark, path)
    need = required(pattern)
    for name, values in tags.items():
        need = both(need, tagged(name, values) if name in made["tags"] and all(isinstance(v, str) for v in values) else None)
    rows = narrowed(spark, path, need)
    for name, values in tags.items():
        rows = rows.filter(F.col(name).isin(values))
    return search.grep(rows, pattern, around, made["text"])


def mentions(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """`search.mentions` over the indexed rows."""
    made = settings(spark, path)
    return search.mentions(narrowed(spark, path, literal(needle)).withColumn("text", F.col(made["text"])), needle, made["by"])
