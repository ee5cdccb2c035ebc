"""Operator 11: words that differ by one code point, by a dictionary of pairs of trie nodes.

`vocabulary` counts the words of all texts. `numbered` numbers the nodes of the words' trie: it sorts the words by ranges,
and each task gives a word the nodes of its predecessor as far as both begin alike, then new ones. Where two
tasks meet, the last and the first word share nodes as well; these few words come to the driver, which says which
numbers mean the same node. The same over the reversed words numbers the nodes of their endings.

A word without its i-th letter is a pair (node of what stands before, node of what follows), and so is a place
between two letters. `near` joins these pairs: words that skip a letter and have the same pair differ by that letter
(at most one word for each letter of the alphabet), and a word with a place of that pair lacks the letter (at most one). So
each pair's group is as small as the alphabet, whatever the data. Pairs are exact: equal nodes mean equal letters.
A run of equal letters gives the same shorter word several times; only its last letter counts.

`forms` takes each word's near word of largest n if it has twice as many occurrences; `roots` follows forms to the last by
pointer doubling: n doubles at each step, so a chain is short and can't turn back.

Rows with null text have no words; a null doc_id is an empty string in the hash. A very long text is read run by run, with
one count for each different run; a very long word takes numbers as many as its letters. Words of equal n are told apart by
code-point order. Repeated rows count each. Other columns are ignored, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, query, stored, temporary, tidy

WORD = re.compile("[A-Za-zÀ-ÿ]+")
#: Fixed by the contract: one occurrence in MISSPELT loses a letter; words of at least LEAST letters and TIMES occurrences.
MISSPELT, LEAST, TIMES, FACTOR = 97, 5, 3, 2
#: Different words a task counts before it gives the counts on; code points of a text read at once.
COUNTED, STRETCH = 100_000, 1 << 20
#: Numbers of a task begin at its number times 2^PLACES.
PLACES = 40


def occurrences(doc_id: str, text: str) -> Counter:
    """The words of a text as they count, with a letter gone where the hash says so."""
    runs: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and WORD.match(text[end]):  # a stretch ends between runs
            end += 1
        runs.update(WORD.findall(text, at, end))
        at = end
    lower: Counter = Counter()
    for run, n in runs.items():
        lower[run.encode().lower()] += n  # of bytes, only A-Z are lowered
    begin, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for raw, n in lower.items():
        h, word = zlib.crc32(raw, begin), raw.decode()
        if h % MISSPELT == 0:
            i = h % len(word)
            word = word[:i] + word[i + 1 :]
        if len(word) >= LEAST:
            out[word] += n
    return out


def vocabulary(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word and n, of the words with at least `times` occurrences."""

    def counts(batches):
        held: Counter = Counter()

        def given():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                held.update(occurrences(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                if len(held) >= COUNTED:
                    yield given()
        yield given()

    known = docs.filter("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    return known.mapInArrow(tidy(counts), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def numbered(rows: DataFrame, spelt: str, order: str, nodes: str) -> DataFrame:
    """rows with `order`, a number that ascends with the code points of column `spelt`, and `nodes`, the trie nodes
    of its first letter, first two letters, ... all letters; stored."""
    names = [f.name for f in rows.schema.fields]

    def number(batches):
        base = TaskContext.get().partitionId() << PLACES
        place, last, path, used = 0, "", [], 0
        for batch in batches:
            places, paths = [], []
            for word in batch.column(names.index(spelt)).to_pylist():
                same = _shared(last, word)
                new = len(word) - same
                path = path[:same] + list(range(base + used + 1, base + used + new + 1))
                used, last, place = used + new, word, place + 1
                places.append(base + place)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], [*names, order, nodes])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{order}` bigint", f"`{nodes}` array<bigint>"])
    raw = stored(rows.repartitionByRange(spelt).sortWithinPartitions(spelt).mapInArrow(tidy(number), schema))
    # Two words for each task of the job before: its first and its last.
    edge = F.struct(spelt, nodes)
    edges = raw.groupBy(F.shiftright(order, PLACES).alias("task")).agg(F.min_by(edge, order).alias("first"), F.max_by(edge, order).alias("last")).orderBy("task").collect()
    alias: dict[int, int] = {}
    for left, right in zip(edges, edges[1:]):
        same = _shared(left["last"][spelt], right["first"][spelt])
        alias.update(zip(right["first"][nodes][:same], (alias.get(x, x) for x in left["last"][nodes])))
    if not alias:
        return raw

    def renamed(batches):
        at = [*names, order, nodes].index(nodes)
        for batch in batches:
            own = pa.array([[alias.get(x, x) for x in path] for path in batch.column(at).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], own], batch.schema.names)

    out = stored(raw.mapInArrow(tidy(renamed), schema))
    discard(raw)
    return out


#: What a pair is to its word: it skips a letter that the next one equals, it skips another letter, it is a place between letters.
REPEAT, SKIP, PLACE = 0, 1, 2


def _pairs(tries: DataFrame) -> DataFrame:
    """id, n, word, before, after -> for each skipped letter and each place the pair of nodes around it."""

    def pairs(batches):
        for batch in batches:
            p, s, ids, ns, kinds = [], [], [], [], []
            for i in range(batch.num_rows):
                one, n, word, before, after = (batch.column(c)[i].as_py() for c in range(5))
                size, head, rest = len(word), [0, *before], [0, *after][::-1]  # rest[i]: the node of word[i:]
                p += head[:-1] + head
                s += rest[1:] + rest
                kinds += [REPEAT if a == b else SKIP for a, b in zip(word, word[1:])] + [SKIP] + [PLACE] * (size + 1)
                ids += [one] * (2 * size + 1)
                ns += [n] * (2 * size + 1)
                if len(p) > 1 << 16 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(s, pa.int64()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(kinds, pa.int32())], ["p", "s", "id", "n", "kind"])
                    p, s, ids, ns, kinds = [], [], [], [], []

    return tries.select("id", "n", "word", "before", "after").mapInArrow(tidy(pairs), "p bigint, s bigint, id bigint, n bigint, kind int")


def near(tries: DataFrame) -> DataFrame:
    """id, n_near (number of near words), best_n and best (the near word of largest n) of each word that has any."""
    # Larger n first, then smaller id, which is code-point order; a group has a member a letter of the alphabet, and one more.
    groups = _pairs(tries).groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "id", "kind"))).alias("members")).filter(F.size("members") > 1)
    own = groups.select("members", F.explode("members").alias("w"))
    w, o = (lambda name: F.col("w").getField(name)), (lambda x, name: x.getField(name))
    same = lambda x: (w("kind") != PLACE) & (o(x, "kind") != PLACE) & (o(x, "id") != w("id"))  # noqa: E731  one letter for another
    lacks = lambda x: ((w("kind") == SKIP) & (o(x, "kind") == PLACE)) | ((w("kind") == PLACE) & (o(x, "kind") == SKIP))
    found = own.select(w("id").alias("id"), F.filter("members", lambda x: same(x) | lacks(x)).alias("near")).filter(F.size("near") > 0)
    best = found.groupBy("id").agg(F.sum(F.size("near")).cast("bigint").alias("n_near"), F.min(F.struct(F.col("near")[0]["m"].alias("m"), F.col("near")[0]["id"].alias("id"))).alias("best"))
    return best.select("id", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.id").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, form -> id, root: the last word that forms lead to; stored."""
    state = stored(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = stored(state.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = step.filter("moved").limit(1).count()
        discard(state)
        state = step
        if not moved:
            return state.select("id", "root")


def variants(docs: DataFrame, factor: int = FACTOR, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary."""
    with temporary(docs.sparkSession) as keep:
        forward = numbered(vocabulary(docs, times), "word", "id", "before")
        backward = numbered(forward.select("id", F.reverse("word").alias("ending")), "ending", "place", "after")
        best = stored(near(forward.join(backward.select("id", "after"), "id")))
        all_words = forward.select("id", "word", "n")
        told = stored(all_words.join(best, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("best_n") >= factor * F.col("n"), F.col("best")).alias("form")))
        last = roots(told.filter("form is not null").select("id", "form"))
        named = lambda key, *columns: all_words.select(F.col("id").alias(key), *(F.col(c).alias(a) for c, a in columns))
        out = told.join(last, "id", "left").join(named("form", ("word", "form_word"), ("n", "form_n")), "form", "left").join(named("root", ("word", "root_word")), "root", "left")
        return keep(stored(out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_RUN = "[A-Za-zÀ-ÿ]+"
_LOWERED = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 bit by bit in a table made from its polynomial; words without one letter meet in an equi-join.
ORACLE = rf"""
with recursive tab0(i, k, c) as (
  select i, 0, i from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from tab0 where k < 8
), tab as (select list(c order by i) as t from tab0 where k = 8
), runs as (select coalesce(cast(doc_id as varchar), '') as d, unnest(list_transform(regexp_extract_all(text, '{_RUN}'), lambda x: {_LOWERED})) as run from documents
), u as (select d, run, count(*) as n, d || ':' || run as s from runs group by d, run
), b as (select *, list_transform(range(1, cast(length(hex(encode(s))) / 2 + 1 as bigint)), lambda i: cast('0x' || hex(encode(s))[2 * i - 1:2 * i] as bigint)) as bytes from u
), h as (select run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[cast(xor(c, x) & 255 as bigint) + 1]), 4294967295), 4294967295) as h from b, tab
), m as (select case when h % {MISSPELT} = 0 then left(run, cast(h % length(run) as integer)) || substr(run, cast(h % length(run) as integer) + 2) else run end as word, n from h
), v as (select word, cast(sum(n) as bigint) as n from m where length(word) >= {LEAST} group by word having sum(n) >= {TIMES}
), cut as (select word, n, i, left(word, i) as p, substr(word, i + 2) as s from (select word, n, cast(unnest(range(length(word))) as integer) as i from v)
), pairs as (
  select distinct a.word, b.word as other, b.n as other_n from cut a join cut b on a.p = b.p and a.s = b.s and a.word <> b.word
  union select a.word, b.word, b.n from cut a join v b on a.p || a.s = b.word
  union select b.word, a.word, a.n from cut a join v b on a.p || a.s = b.word
), near as (select word, count(*) as n_near, arg_min(other, (-other_n, encode(other))) as best, max(other_n) as best_n from pairs group by word
), f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when best_n >= {FACTOR} * n then best end as form, case when best_n >= {FACTOR} * n then best_n end as form_n from v left join near using (word)
), walk(word, here, k) as (select word, word, 0 from f union all select walk.word, f.form, k + 1 from walk join f on walk.here = f.word where f.form is not null
), r as (select word, arg_max(here, k) as root from walk group by word)
select f.word, form, root, n, n_near, form_n from f join r using (word)
"""
