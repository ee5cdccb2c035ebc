"""Operator 8: quotation linking and reply-ordered conversations. DataFrame functions only.

`parse` splits a message into lines and reads each line's quote level (the number of '>' in front).
Level 0 is the message's own text. A line is normalised (trimmed, white space collapsed, lower case)
and hashed. `link` finds for each quoted line the earliest message of the conversation that has the
line among its own, and takes as the message replied to the one that explains most lines of the lowest
quote level that explains any (ties: the later turn). `thread` follows these links to the first
message of each thread, doubling the distance at every step.

The result has one row for each message: the text without quotes, the turn replied to, the thread (turn
of its first message) and the depth below it. Sorted by conversation, thread, depth and turn, it is the
reply-ordered conversation; sorting is by range, so one very long conversation is cut over many tasks.

A null text has no lines; its text without quotes is ''. Blank lines quote nothing. A message without
known quotes starts a thread. A quote of a later message or of the message itself is no link. Rows that
repeat (conv_id, turn) are kept; lines of any of them count as the turn's. Rows whose conv_id or turn is
null start a thread of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, stored

MARK = r"^[ \t]*(?:>[ \t]?)+"


def parse(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with lines array<struct<level, body, norm>> and own_text."""
    mark = lambda x: F.regexp_extract(x, MARK, 0)
    body = lambda x: F.regexp_replace(x, MARK, "")
    split = F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x: F.struct(F.regexp_count(mark(x), F.lit(">")).alias("level"), body(x).alias("body"), F.lower(F.trim(F.regexp_replace(body(x), r"[ \t]+", " "))).alias("norm")))
    return messages.withColumn("lines", split).withColumn("own_text", F.array_join(F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.body), "\n"))


def link(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_matched of the messages that reply to an earlier one."""
    each = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("lines").alias("x")).select("conv_id", "turn", "x.level", F.xxhash64("x.norm").alias("h"), (F.col("x.norm") == "").alias("blank")).filter("not blank")
    quoted = each.filter("level > 0").groupBy("conv_id", "turn", "level", "h").agg(F.count("*").alias("n"))
    asked = quoted.select("conv_id", "h").distinct()
    sources = each.filter("level = 0").join(asked, ["conv_id", "h"], "left_semi").groupBy("conv_id", "h").agg(F.min("turn").alias("source"))
    votes = quoted.join(sources, ["conv_id", "h"]).filter("source < turn").groupBy("conv_id", "turn", "level", "source").agg(F.sum("n").alias("n"))
    best = F.struct(-F.col("level"), F.col("n"), F.col("source"))
    return votes.groupBy("conv_id", "turn").agg(F.max(best).alias("b")).select("conv_id", "turn", F.col("b.source").alias("reply_to"), F.col("b.n").alias("n_matched"))


def thread(links: DataFrame) -> DataFrame:
    """links (conv_id, turn, reply_to) with thread and depth."""
    state = stored(links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("bigint").alias("depth")))
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        moved = state.join(above, ["conv_id", "up"], "left")
        after = stored(moved.select("conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        if after.filter("moved").isEmpty():
            return after.select("conv_id", "turn", F.col("up").alias("thread"), "depth")
        state = after.drop("moved")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, thread, depth, n_quoted, text: one row for each message."""
    parsed = stored(parse(messages.select("conv_id", "turn", "role", "text")))
    links = stored(link(parsed))
    roots = thread(links)
    found = links.join(roots, ["conv_id", "turn"]).select("conv_id", "turn", "reply_to", "thread", "depth")
    n_quoted = F.size(F.filter("lines", lambda x: (x.level > 0) & (x.norm != ""))).cast("bigint")
    whole = parsed.select("conv_id", "turn", "role", n_quoted.alias("n_quoted"), F.col("own_text").alias("text"))
    out = whole.join(found, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), "n_quoted", "text")


def reply_ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("conv_id", "thread", "depth", "turn")


def transcript(rows: DataFrame, start: str = "<|", end: str = "|>") -> DataFrame:
    """Each message as a chat turn; in reply order the rows are the formatted conversation."""
    return rows.withColumn("formatted", F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit(end), F.lit("\n"), "text"))


@query
def op8_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = r"""
with recursive m as (
  select row_number() over () as rid, conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\r?\n') as raw from conversations
), l as (
  select rid, conv_id, turn, role, list_transform(raw, lambda x: {
    'level': len(regexp_replace(regexp_extract(x, '^[ \t]*(?:>[ \t]?)+', 0), '[^>]', '', 'g')),
    'body': regexp_replace(x, '^[ \t]*(?:>[ \t]?)+', ''),
    'norm': lower(trim(regexp_replace(regexp_replace(x, '^[ \t]*(?:>[ \t]?)+', ''), '[ \t]+', ' ', 'g'), ' '))}) as lines from m
), e as (
  select conv_id, turn, x.level as level, x.norm as norm from (select conv_id, turn, unnest(lines) as x from l where conv_id is not null and turn is not null) where x.norm <> ''
), q as (select conv_id, turn, level, norm, count(*) as n from e where level > 0 group by all
), s as (select conv_id, norm, min(turn) as source from e where level = 0 group by all
), v as (select conv_id, turn, level, source, sum(n) as n from q join s using (conv_id, norm) where source < turn group by all
), k as (select conv_id, turn, source as reply_to from v qualify row_number() over (partition by conv_id, turn order by level, n desc, source desc) = 1
), r(conv_id, turn, up, depth) as (
  select conv_id, turn, reply_to, 1 from k
  union all
  select r.conv_id, r.turn, k.reply_to, r.depth + 1 from r join k on k.conv_id = r.conv_id and k.turn = r.up
), t as (select conv_id, turn, min(up) as thread, max(depth) as depth from r group by all)
select l.conv_id, l.turn, l.role, k.reply_to, coalesce(t.thread, l.turn) as thread, cast(coalesce(t.depth, 0) as bigint) as depth,
  cast(len(list_filter(lines, lambda x: x.level > 0 and x.norm <> '')) as bigint) as n_quoted,
  array_to_string(list_transform(list_filter(lines, lambda x: x.level = 0), lambda x: x.body), chr(10)) as text
from l left join k on k.conv_id = l.conv_id and k.turn = l.turn left join t on t.conv_id = l.conv_id and t.turn = l.turn
"""
