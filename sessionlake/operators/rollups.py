"""Counts and sums by session: tools, files, compactions, steering, hints, tokens and cost."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .classify import valid_tool_name
from .normalize import KEY, ORDER, ROOT_TYPES, get, text_at

WRITES = ["Write", "Edit", "MultiEdit", "NotebookEdit"]


def tool_histogram(calls: DataFrame, by: list[str] = KEY, names: int | None = None, name: str = "tool_name") -> DataFrame:
    """Calls by session and tool, most frequent first; with `names`, only the first so many distinct names of a session."""
    valid = calls.filter(valid_tool_name(name))
    counted = valid.groupBy(*by, name).agg(F.count("*").alias("n"), *([F.min(F.struct(*ORDER)).alias("first")] if names else []))
    if names:
        seen = Window.partitionBy(*by).orderBy("first")
        counted = counted.withColumn("place", F.row_number().over(seen)).filter(F.col("place") <= names).drop("place", "first")
    return counted.orderBy(*by, F.desc("n"), name)


def writes(blocks: DataFrame) -> DataFrame:
    """Calls that write a file, with its path."""
    path = T.slashes(F.coalesce(text_at("$.file_path", "input"), text_at("$.notebook_path", "input")))
    return blocks.filter(F.col("block_type") == "tool_use").filter(F.col("tool_name").isin(WRITES)).withColumn("path", path).filter("path is not null")


def file_touches(blocks: DataFrame) -> DataFrame:
    """Files written in each session, how often and where last; newest first."""
    return touches(writes(blocks))


def touches(rows: DataFrame, by: list[str] = KEY, path: str = "path", at: str = "offset") -> DataFrame:
    found = rows.groupBy(*by, path).agg(F.count("*").alias("n"), F.max(at).alias("last_offset"))
    return found.orderBy(*by, F.desc("last_offset"), path)


def distinct_files(rows: DataFrame, cap: int, by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """Distinct paths in the order of their first sighting, the first `cap` of each session."""
    seen = rows.groupBy(*by, "path").agg(F.min(F.struct(*order)).alias("first"))
    w = Window.partitionBy(*by).orderBy("first", "path")
    return seen.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap).select(*by, "path", "place")


def changed_files(changes: DataFrame, context: DataFrame, cap: int = 64) -> DataFrame:
    """Changed paths below the session's directory, relative and safe; the first `cap` seen, sorted."""
    safe = changes.join(context.select(*KEY, "cwd"), KEY).withColumn("path", T.safe_relative_path("path", "cwd")).filter("path is not null").withColumn("seq", F.lit(0))
    return distinct_files(safe, cap).groupBy(*KEY).agg(F.array_sort(F.collect_set("path")).alias("changed_files"))


def compaction_stats(system: DataFrame) -> DataFrame:
    """Distinct compact boundaries (by uuid, else time) and the latest one's time."""
    b = system.filter("is_boundary")
    return b.groupBy(*KEY).agg(F.count_distinct(F.coalesce("uuid", F.col("ts").cast("string"))).alias("compaction_count"), F.max("ts").alias("last_compaction_time"))


def compaction_history(rows: DataFrame) -> DataFrame:
    """Each compaction of a wire log and the session's last one."""
    c = rows.filter("kind = 'compaction'").select(*KEY, *ORDER, "ts", "tokens_before", "tokens_after", "kept_messages", F.col("text").alias("summary"))
    last = c.groupBy(*KEY).agg(F.max(F.struct(*ORDER)).alias("last"))
    return c.join(last, KEY).withColumn("is_last", F.struct(*ORDER) == F.col("last")).drop("last")


def steer_counts(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'steer'").groupBy(*KEY, "origin_kind").agg(F.count("*").alias("n")).orderBy(*KEY, F.desc("n"), "origin_kind")


def cron_previews(rows: DataFrame, n: int = 3, chars: int = 200) -> DataFrame:
    from .windows import first_n

    return first_n(rows.filter("kind = 'steer' and origin_kind like 'cron%'"), n).withColumn("preview", T.truncate_chars(T.single_line("text"), chars))


#: The kinds of commit subjects that name a scope, and what a word that counts as a path holds.
SCOPED, MARKERS = ("feat", "fix", "refactor", "chore", "test"), ("v5/", "connectors/", "ui/")


def mentions(texts: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """Each text's distinct hints: scopes (of `fix(scope)` and the like) and whole words with a path marker; offset is kept if there."""
    scopes = [F.regexp_extract_all("text", F.lit(rf"{kind}\(([^)]+)\)"), F.lit(1)) for kind in SCOPED]
    marked = lambda word: reduce(or_, (F.contains(word, F.lit(m)) for m in markers))
    words = F.when(marked(F.col("text")), F.filter(F.split("text", r"(?U)\s+"), marked)).otherwise(F.array().cast("array<string>"))
    kept = [c for c in texts.columns if c in (*KEY, "offset")]
    return texts.select(*kept, F.explode(F.array_distinct(F.concat(*scopes, words))).alias("hint"))


def commit_hints(texts: DataFrame, markers: tuple[str, ...] = MARKERS, cap: int = 20) -> DataFrame:
    """Distinct hints (`mentions`) of owner and agent texts, sorted; the first `cap` of each session."""
    each = mentions(texts, markers).select(*KEY, "hint").distinct()
    w = Window.partitionBy(*KEY).orderBy("hint")
    return each.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap).drop("place")


def unknown_types(events: DataFrame, known: list[str] = ROOT_TYPES, column: str = "type") -> DataFrame:
    """Root types that aren't known, most frequent first."""
    return events.filter(~F.col(column).isin(known)).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def totals(rows: DataFrame, by: list[str] = KEY, kind: str = "kind") -> DataFrame:
    """Rows of each kind before anything is capped."""
    return rows.groupBy(*by, kind).agg(F.count("*").alias("n"))


def session_bytes(lines: DataFrame) -> DataFrame:
    files = lines.groupBy(*KEY, "file_path").agg(F.max("file_size").alias("size"))
    return files.groupBy(*KEY).agg(F.sum("size").alias("size_bytes"))


def warning(stuck: str = "n_stuck", unanswered: str = "unanswered") -> Column:
    queued = F.when(F.col(stuck) > 0, F.concat(F.col(stuck).cast("string"), F.when(F.col(stuck) == 1, F.lit(" queued message")).otherwise(F.lit(" queued messages")), F.lit(" never delivered")))
    return F.nullif(F.concat_ws("; ", queued, F.when(F.col(unanswered), F.lit("last message unanswered"))), F.lit(""))


# -- tokens and cost -------------------------------------------------------------------------------

#: USD for a million input and output tokens by model family; a cache write costs 1.25 of input, a read 0.1.
PRICES = {"haiku": (1.0, 5.0), "sonnet": (3.0, 15.0), "opus": (15.0, 75.0)}
CACHE_WRITE, CACHE_READ = 1.25, 0.1


def model_family(model: str | Column) -> Column:
    model = F.lower(F.col(model) if isinstance(model, str) else model)
    out = F.lit(None).cast("string")
    for family in reversed(sorted(PRICES)):
        out = F.when(F.contains(model, F.lit(family)), F.lit(family)).otherwise(out)
    return out


def usage_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Token totals and cost by `by` and model family. rows: model, input, output, cache_write, cache_read."""
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("input", "output", "cache_write", "cache_read")}
    sums = rows.withColumn("family", model_family("model")).groupBy(*by, "family").agg(*(F.sum(e).alias(c) for c, e in n.items()))
    prices = F.create_map(*(F.lit(x) for f, (i, o) in PRICES.items() for x in (f, i))), F.create_map(*(F.lit(x) for f, (i, o) in PRICES.items() for x in (f, o)))
    price_in, price_out = (F.try_element_at(m, F.col("family")) for m in prices)
    cost = (F.col("input") * price_in + F.col("cache_write") * price_in * CACHE_WRITE + F.col("cache_read") * price_in * CACHE_READ + F.col("output") * price_out) / 1e6
    total_input = F.col("input") + F.col("cache_write") + F.col("cache_read")
    return sums.select(*by, "family", "input", "output", "cache_write", "cache_read", total_input.alias("total_input"), (total_input + F.col("output")).alias("total"), (F.col("input") + F.col("cache_write") + F.col("cache_read") * CACHE_READ).alias("effective_input"), cost.alias("cost_usd"))


# -- open work -------------------------------------------------------------------------------------


def tracks_work() -> Column:
    return (F.col("block_type") == "tool_use") & F.col("tool_name").isin("TodoWrite", "TaskCreate", "TaskUpdate")


def tracked_work(offset: Column, ts: Column, name: Column, json: Column, shown: int = 20, raw_chars: int = 800) -> Column:
    """What a task-tracking call says, as a struct: its todos, or its raw input."""
    todos = F.transform(get("$.todos", "array<variant>", F.try_parse_json(json)), lambda t: F.struct(F.try_variant_get(t, "$.status", "string").alias("status"), F.try_variant_get(t, "$.content", "string").alias("content")))
    raw = T.head_chars(json, raw_chars)
    return F.struct(
        T.handle(offset).alias("handle"), ts.alias("timestamp"), name.alias("tool_name"), F.slice(todos, 1, shown).alias("todos"), F.greatest(F.size(todos) - shown, F.lit(0)).cast("bigint").alias("todos_omitted"),
        F.when(todos.isNull(), raw.text).alias("raw_input"), F.when(todos.isNull(), raw.truncated_chars).alias("raw_input_truncated_chars"),
    )


def open_work(blocks: DataFrame, shown: int = 20, raw_chars: int = 800) -> DataFrame:
    """The session's last task-tracking call: its todos, or its raw input."""
    last = blocks.filter(tracks_work()).groupBy(*KEY).agg(F.max_by(F.struct("offset", "ts", "tool_name", F.to_json("input").alias("json")), F.struct(*ORDER)).alias("c"))
    work = tracked_work(F.col("c.offset"), F.col("c.ts"), F.col("c.tool_name"), F.col("c.json"), shown, raw_chars)
    return last.select(*KEY, work.alias("w")).select(*KEY, "w.*")
