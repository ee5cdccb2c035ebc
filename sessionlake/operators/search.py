"""Search and reading: filters on messages, regular expressions with snippets, spans, single records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .classify import KINDS
from .normalize import KEY, ORDER, get, text_at


def message_filter(messages: DataFrame, kinds: list[str] | None = None, since: str | Column | None = None, until: str | Column | None = None) -> DataFrame:
    """Messages of these kinds between two times, both included."""
    if unknown := set(kinds or []) - set(KINDS):
        raise ValueError(f"unknown message kinds: {sorted(unknown)}")
    found = messages.filter(F.col("kind").isin(kinds)) if kinds else messages
    if since is not None:
        found = found.filter(F.col("ts") >= since)
    return found.filter(F.col("ts") <= until) if until is not None else found


def recent(sessions: DataFrame, now: Column, hours: float | None = 12, has_text_filter: bool = False) -> DataFrame:
    """Sessions updated within `hours` of `now`; None keeps all, as does a text filter with the default age."""
    if hours is None or has_text_filter and hours == 12:
        return sessions
    return sessions.filter(F.col("updated_at") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0)))


def mentions(texts: DataFrame, needle: str, by: list[str] = KEY) -> DataFrame:
    """Sessions with the needle, whatever its case, in any of their texts."""
    return texts.filter(F.contains(F.lower("text"), F.lit(needle.lower()))).select(*by).distinct()


def prefilter(lines: DataFrame, pattern: str) -> DataFrame:
    """Raw lines that can match: for a plain ASCII word a substring test spares parsing the others."""
    literal = T.plain_literal(pattern)
    return lines.filter(F.contains(F.lower("value"), F.lit(literal))) if literal else lines


def grep(rows: DataFrame, pattern: str, around: int = 80, text: str = "text") -> DataFrame:
    """Rows whose text matches (case-insensitive), with a snippet of the first match."""
    literal = T.plain_literal(pattern)
    found = rows.filter(F.contains(F.lower(text), F.lit(literal))) if literal else rows
    return found.filter(F.col(text).rlike(f"(?iu){pattern}")).withColumn("snippet", T.snippet(text, pattern, around))


def span_entries(messages: DataFrame, blocks: DataFrame, text_chars: int = 800, tool_chars: int = 400) -> DataFrame:
    """What a reader sees around a handle: messages, tool calls and tool results, capped by kind."""
    from .normalize import describe

    said = messages.select(*KEY, *ORDER, "ts", "kind", T.truncate_chars("text", text_chars).alias("text"))
    calls = blocks.filter("block_type = 'tool_use'").select(*KEY, *ORDER, "ts", F.lit("tool_call").alias("kind"), T.truncate_chars(describe("tool_name", "input"), tool_chars).alias("text"))
    results = blocks.filter("block_type = 'tool_result' and result_text is not null").select(*KEY, *ORDER, "ts", F.lit("tool_result").alias("kind"), T.truncate_chars("result_text", tool_chars).alias("text"))
    return said.unionByName(calls).unionByName(results)


def show_records(events: DataFrame, blocks: DataFrame, handles: DataFrame, chars: int = 4000) -> DataFrame:
    """Labelled pieces of whole records. handles: session columns and offset. A compaction summary is never capped."""
    label = (
        F.when(F.col("block_type") == "text", "text")
        .when(F.col("block_type") == "tool_use", F.concat(F.lit("tool_use:"), F.coalesce("tool_name", F.lit("?"))))
        .when(F.col("block_type") == "tool_result", "tool_result")
        .when(F.col("block_type") == "thinking", "thinking")
        .otherwise(F.col("block_type"))
    )
    body = F.coalesce("text", "thinking", "result_text", F.when(F.col("block_type") == "tool_use", F.to_json("input")))
    own = blocks.select(*KEY, *ORDER, "type", "ts", label.alias("label"), body.alias("body"), F.col("is_compact_summary").alias("whole"))
    piece = lambda name, path: F.struct(F.lit(name).alias("label"), get(path).alias("body"))
    other = events.filter(~F.col("type").isin("user", "assistant")).select(*KEY, "offset", F.lit(0).alias("seq"), "type", "ts", F.explode(F.array(piece("content", "$.content"), piece("error", "$.error.message"), piece("compact_boundary", "$.compactMetadata.trigger"), piece("operation", "$.operation"), piece("reason", "$.reason"), piece("attachment", "$.attachment"))).alias("p"), F.lit(False).alias("whole")).filter("p.body is not null").select(*KEY, *ORDER, "type", "ts", "p.label", "p.body", "whole")
    found = own.unionByName(other).join(handles, [*KEY, "offset"], "left_semi")  # Spark broadcasts them if it finds them small
    capped = F.when(F.col("whole"), F.struct(F.col("body").alias("text"), F.lit(0).cast("bigint").alias("truncated_chars"))).otherwise(T.head_chars("body", chars))
    return found.select(*KEY, *ORDER, T.handle("offset").alias("handle"), F.col("type").alias("kind"), F.col("ts").alias("timestamp"), "label", capped.alias("p")).select(*KEY, *ORDER, "handle", "kind", "timestamp", "label", "p.text", "p.truncated_chars").filter("text is not null")
