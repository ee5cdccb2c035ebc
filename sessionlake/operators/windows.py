"""Order within sessions: first and last rows, windows after a boundary, neighbours, latest values.

Where a plain aggregate answers the question it is used instead of a window, so a session that holds a
large part of all rows is pre-aggregated by every task. Rankings keep N rows only: Spark limits each
group before the shuffle. What needs all rows of a session in order (`ordinals`, `drop_adjacent`, `within_budget`) is
scanned in segments: rows are dealt out by ranges of session and order, each segment is scanned by itself, and what it needs
of the segments before it (a sum, a last row) comes from one row a session and segment. So a session of any size is spread
over as many tasks as it has segments. `by` are the session's columns, `order` the columns of file order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.scratch import stored
from .normalize import KEY, ORDER


def _ranked(df: DataFrame, by: list[str], order: list[str], last: bool) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(c) if last else F.asc(c) for c in order))))


def last_n(df: DataFrame, n: int, by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """The last n rows of each session; `rank` counts from the end."""
    return _ranked(df, by, order, True).filter(F.col("rank") <= n)


def first_n(df: DataFrame, n: int, by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    return _ranked(df, by, order, False).filter(F.col("rank") <= n)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def segmented(df: DataFrame, by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """df with `segment`: ranges of rows in session and order, about equally large; stored, so that the ranges stay as they are."""
    return stored(df.repartitionByRange(*by, *order).withColumn("segment", F.spark_partition_id()))


def _carried(rows: DataFrame, carries: DataFrame, by: list[str]) -> DataFrame:
    """rows with what their segment needs of those before it; sessions without a name are sessions too."""
    own = carries.select(*(F.col(c).alias(f"_{c}") for c in (*by, "segment")), "carry")
    return rows.join(own, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "segment"))), "left").drop(*(f"_{c}" for c in (*by, "segment")))


def running(df: DataFrame, value: Column, name: str, by: list[str] = KEY, order: list[str] = ORDER, backwards: bool = False) -> DataFrame:
    """df with the running sum of `value` up to each row of its session, in order (or from the end)."""
    way = F.desc if backwards else F.asc
    rows = segmented(df.withColumn(name, value.cast("bigint")), by, order)
    before = Window.partitionBy(*by).orderBy(way("segment")).rowsBetween(Window.unboundedPreceding, -1)
    carries = rows.groupBy(*by, "segment").agg(F.sum(name).alias("own")).withColumn("carry", F.coalesce(F.sum("own").over(before), F.lit(0).cast("bigint")))
    inside = Window.partitionBy(*by, "segment").orderBy(*(way(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    return _carried(rows.withColumn(name, F.sum(name).over(inside)), carries, by).withColumn(name, F.col(name) + F.col("carry")).drop("segment", "carry")


def ordinals(df: DataFrame, by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """Each row's place in its session, from 0."""
    return running(df, F.lit(1), "ordinal", by, order).withColumn("ordinal", F.col("ordinal") - 1)


def latest(df: DataFrame, columns: list[str], by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """The last value of each column that isn't null."""
    at = F.struct(*order)
    return df.groupBy(*by).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))


def time_span(df: DataFrame, by: list[str] = KEY, order: list[str] = ORDER, ts: str = "ts") -> DataFrame:
    """First and last real event time in file order (not the least and greatest), and the events that have one."""
    at = F.when(F.col(ts).isNotNull(), F.struct(*order))
    return df.groupBy(*by).agg(F.min_by(ts, at).alias("first_event_time"), F.max_by(ts, at).alias("last_event_time"), F.count(ts).alias("n_events"))


def after_boundary(df: DataFrame, is_boundary: Column, by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """Rows after the session's last boundary; all, if it has none."""
    at = F.struct(*order)
    last = df.filter(is_boundary).groupBy(*by).agg(F.max(at).alias("boundary"))
    return df.join(last, by, "left").filter(F.col("boundary").isNull() | (at > F.col("boundary"))).drop("boundary")


def drop_adjacent(df: DataFrame, same: list[Column], by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """Without rows equal (in `same`) to the row before; of an equal run the first stays."""
    rows = segmented(df.withColumn("same", F.struct(*(c.alias(f"s{i}") for i, c in enumerate(same)))), by, order)
    at = F.struct(*order)
    lasts = rows.groupBy(*by, "segment").agg(F.max_by("same", at).alias("last")).withColumn("carry", F.lag("last").over(Window.partitionBy(*by).orderBy("segment")))
    w = Window.partitionBy(*by, "segment").orderBy(*order)
    placed = _carried(rows.withColumn("before", F.lag("same").over(w)), lasts, by).withColumn("before", F.coalesce("before", "carry"))
    return placed.filter(F.col("before").isNull() | (F.col("before") != F.col("same"))).drop("same", "before", "segment", "carry")


def drop_adjacent_messages(messages: DataFrame, **options) -> DataFrame:
    """One message where two encodings say the same: equal role, equal text but for white space."""
    return drop_adjacent(messages, [F.col("role"), T.single_line("text")], **options)


#: The topic of a session that says nothing.
NO_TOPIC = "Empty session"


def topic(values: DataFrame, by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """Topic and where it came from. values: kind (custom_title, ai_title, agent_name, last_prompt, first_prompt), text,
    in_tail. The tail's last value of the best kind wins, then the head's, then the first prompt."""
    at = F.struct(*order)
    kinds = ["custom_title", "ai_title", "agent_name", "last_prompt"]
    pick = lambda kind, tail: F.max_by("text", F.when((F.col("kind") == kind) & (F.col("in_tail") == F.lit(tail)) & F.col("text").isNotNull(), at)).alias(f"{kind}_{tail}")
    first = F.min_by("text", F.when((F.col("kind") == "first_prompt") & F.col("text").isNotNull(), at)).alias("first_prompt")
    found = values.groupBy(*by).agg(*(pick(k, t) for t in (True, False) for k in kinds), first)
    ranked = [(f"{k}_{t}", k) for t in (True, False) for k in kinds] + [("first_prompt", "first_prompt")]
    source = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(k)) for c, k in ranked), F.lit("none"))
    return found.select(*by, F.coalesce(*(F.col(c) for c, _ in ranked), F.lit(NO_TOPIC)).alias("topic"), source.alias("topic_source"))


def unanswered(rows: DataFrame, asked: Column, answered: Column, by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """Whether each session's last question (or interrupt) stands after its last answer, and where."""
    at = F.struct(*order)
    found = rows.groupBy(*by).agg(F.max(F.when(asked, at)).alias("asked"), F.max(F.when(answered, at)).alias("answered"))
    return found.select(*by, (F.col("asked").isNotNull() & (F.col("answered").isNull() | (F.col("asked") > F.col("answered")))).alias("unanswered"), F.col(f"asked.{order[0]}").alias("asked_offset"))


def span_around(rows: DataFrame, targets: DataFrame, n: int, by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """n entries before each target offset, the entries at it, and n after. targets: the session's columns and `target`; a
    handful, as a reader asks for them."""
    near = rows.join(targets, by)
    own = [*by, "target"]
    back = _ranked(near.filter(F.col(order[0]) < F.col("target")), own, order, True).filter(F.col("rank") <= n)
    ahead = _ranked(near.filter(F.col(order[0]) > F.col("target")), own, order, False).filter(F.col("rank") <= n)
    return near.filter(F.col(order[0]) == F.col("target")).unionByName(back.drop("rank")).unionByName(ahead.drop("rank"))


def span_between(rows: DataFrame, start: int, end: int | None = None, forward: int = 4 << 20, offset: str = "offset") -> DataFrame:
    """Records from one handle up to another, or `forward` bytes on."""
    if end is not None and end <= start:
        raise ValueError("the end of a span must lie after its start")
    return rows.filter((F.col(offset) >= start) & (F.col(offset) < (end if end is not None else start + forward)))


def within_budget(rows: DataFrame, size: Column, budget: int, by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """The newest rows whose running size stays within budget; `running` is that size."""
    return running(rows, size, "running", by, order, backwards=True).filter(F.col("running") <= budget)


def tiered_excerpts(rows: DataFrame, shown: int, whole: int, chars: int = 4000, by: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    """The last `shown` rows: the newest `whole` of them with up to `chars` characters, earlier ones by their first line."""
    kept = last_n(rows, shown, by, order)
    text = F.when(F.col("rank") <= whole, T.head_chars("text", chars).text).otherwise(T.first_line("text"))
    return kept.withColumn("excerpt", text).withColumn("truncated_chars", F.greatest(F.length("text") - F.length("excerpt"), F.lit(0)).cast("bigint"))


def named_by_call(rows: DataFrame, by: list[str] = KEY, order: list[str] = ORDER, default: str = "tool") -> DataFrame:
    """Outputs with the name of the latest call of the same id before them. rows: call_id, name (of calls, else null)."""
    w = Window.partitionBy(*by, "call_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("name", F.coalesce(F.last("name", ignorenulls=True).over(w), F.lit(default)))
