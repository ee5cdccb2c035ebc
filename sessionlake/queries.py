"""The registered queries: every operator over the given tables, and the SQL that checks each.

The tables hold no transcripts, so two lossless adapters stand in: `conversations` is read as
messages (a conversation is a session, its turn the offset), some queries rendering each row as a JSON line of
one log format and parsing it back; `events` is read as an operation log (a user is a session,
`event_id` the offset, `event_type` the operation, `props.k` the call id). `documents` serve as texts and as one log
for each source, `pages` as file paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import classify, correlate, forest, index, normalize, redact, rollups, search, windows
from .plans import digest as digests
from .sources import logs
from .sources.scratch import shared_dir
from .streaming import delegations as followed

QUERIES, ORACLE = {}, {}
S, O = ["session_id"], ["offset", "seq"]


def registered(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- adapters --------------------------------------------------------------------------------------


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "owner").when(F.col("role") == "assistant", "agent").otherwise("harness")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("offset"), F.lit(0).alias("seq"), "role", kind.alias("kind"), "text")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("offset"), F.lit(0).alias("seq"), "ts", F.col("event_type").alias("name"), "value", F.get_json_object("props", "$.k").alias("call_id"))


def _json(*fields) -> Column:
    return F.to_json(F.struct(*fields))


def _line(rows: DataFrame, kind: str, value: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("format"), F.col("session_id").cast("string").alias("session_id"), "offset", value.alias("value"), F.octet_length(value).cast("bigint").alias("nbytes"), F.lit(1 << 40).cast("bigint").alias("file_size"), F.concat(F.lit("/logs/"), F.col("session_id").cast("string"), F.lit(".jsonl")).alias("file_path"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("session_id")).alias("modified_at"))


def main_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of the main format: users, assistants, and system turns as harness notices."""
    f = lambda name, value: (value if isinstance(value, Column) else F.lit(value)).alias(name)
    m = messages(spark, sf_dir)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("offset")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    sid = F.col("session_id").cast("string")
    common = [f("uuid", F.concat_ws("-", sid, "offset")), f("sessionId", sid), f("timestamp", stamp), f("isSidechain", False)]
    block = F.array(F.struct(f("type", "text"), f("text", F.col("text"))))
    user = _json(f("type", "user"), *common, f("isMeta", F.col("role") == "system"), f("message", F.struct(f("role", "user"), f("content", F.col("text")))))
    agent = _json(f("type", "assistant"), *common, f("message", F.struct(f("model", "m"), f("id", sid), f("type", "message"), f("role", "assistant"), f("content", block))))
    return _line(m, "main", F.when(F.col("role") == "assistant", agent).otherwise(user))


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user and assistant turn twice, as a message and as an event, white space differing."""
    f = lambda name, value: (value if isinstance(value, Column) else F.lit(value)).alias(name)
    m = messages(spark, sf_dir).filter("role in ('user', 'assistant')")
    part = F.array(F.struct(f("type", F.when(F.col("role") == "user", "input_text").otherwise("output_text")), f("text", F.col("text"))))
    item = _json(f("type", "response_item"), f("timestamp", "2026-01-01T00:00:00Z"), f("payload", F.struct(f("type", "message"), "role", f("content", part))))
    flat = F.concat(F.lit("\n "), F.replace("text", F.lit(" "), F.lit("  ")))
    event = _json(f("type", "event_msg"), f("payload", F.struct(f("type", F.when(F.col("role") == "user", "user_message").otherwise("agent_message")), f("message", flat))))
    once, twice = m.withColumn("offset", F.col("offset") * 2), m.withColumn("offset", F.col("offset") * 2 + 1)
    return _line(once, "rollout", item).unionByName(_line(twice, "rollout", event))


def wire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda name, value: (value if isinstance(value, Column) else F.lit(value)).alias(name)
    said = F.array(F.struct(f("type", "text"), f("text", F.col("text"))))
    prompt = _json(f("type", F.when(F.col("role") == "system", "turn.steer").otherwise("turn.prompt")), f("time", F.col("offset") + 1), f("origin", F.struct(f("kind", F.when(F.col("role") == "user", "user").otherwise("cron")))), f("input", said))
    part = _json(f("type", "agent.event"), f("time", F.col("offset") + 1), f("event", F.struct(f("type", "content.part"), f("part", F.struct(f("type", "text"), f("text", F.col("text")))))))
    return _line(messages(spark, sf_dir), "wire", F.when(F.col("role") == "assistant", part).otherwise(prompt))


def update_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an update log: views call a tool, purchases complete the call of their id, errors fail it."""
    f = lambda name, value: (value if isinstance(value, Column) else F.lit(value)).alias(name)
    kind = F.when(F.col("name") == "view", "tool_call").otherwise("tool_call_update")
    status = F.when(F.col("name") == "purchase", "completed").when(F.col("name") == "error", "failed")
    update = F.struct(f("sessionUpdate", kind), f("toolCallId", F.col("call_id")), f("title", F.when(F.col("name") == "view", F.concat(F.lit("view "), "call_id"))), f("rawInput", F.struct(f("command", F.concat(F.lit("run "), "call_id", F.lit("\nmore"))))), f("status", status), f("rawOutput", F.struct(f("b", "later"), f("a", F.concat(F.lit("out "), F.col("value").cast("string"))))))
    return _line(operations(spark, sf_dir).filter("name in ('view', 'purchase', 'error')"), "update", _json(f("params", F.struct(f("update", update)))))


def _id(df: DataFrame) -> DataFrame:
    return df.withColumn("session_id", F.col("session_id").cast("bigint"))


# -- digests and lists -----------------------------------------------------------------------------


@registered("""
select conv_id, arg_min(text, turn) filter (role = 'user') as first_prompt, arg_max(text, turn) filter (role = 'user') as last_user,
  arg_max(text, turn) filter (role = 'assistant') as last_report, count(*) as n_messages,
  coalesce(max(turn) filter (role = 'user') > coalesce(max(turn) filter (role = 'assistant'), -1), false) as unanswered
from conversations group by conv_id""")
def restore_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda kind: F.when(F.col("kind") == kind, F.col("offset"))
    asked, answered = F.max(at("owner")), F.max(at("agent"))
    m = messages(spark, sf_dir)
    return m.groupBy(F.col("session_id").alias("conv_id")).agg(
        F.min_by("text", at("owner")).alias("first_prompt"), F.max_by("text", at("owner")).alias("last_user"), F.max_by("text", at("agent")).alias("last_report"),
        F.count("*").alias("n_messages"), F.coalesce(asked > F.coalesce(answered, F.lit(-1)), F.lit(False)).alias("unanswered"),
    )


@registered("""
with f as (select conv_id as session_id, string_agg(text, ' ~ ' order by turn) as prompts from (select * from conversations where role = 'user' qualify row_number() over (partition by conv_id order by turn) <= 3) group by all),
r as (select conv_id as session_id, string_agg(text, ' ~ ' order by turn) as reports from (select * from conversations where role = 'assistant' qualify row_number() over (partition by conv_id order by turn desc) <= 5) group by all),
t as (select conv_id as session_id, arg_min(text, turn) filter (role = 'user') as topic, count(*) as n_events,
  coalesce(max(turn) filter (role = 'user'), -1) > coalesce(max(turn) filter (role = 'assistant'), -1) as unanswered from conversations group by all)
select session_id, coalesce(topic, 'Empty session') as topic, case when topic is null then 'none' else 'first_prompt' end as topic_source, prompts, reports, n_events, unanswered from t left join f using (session_id) left join r using (session_id)""")
def full_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = {"last_report_chars": 1 << 30, "report_chars": 1 << 30}
    d = digests.digest(main_lines(spark, sf_dir), caps=caps)
    joined = lambda c: F.nullif(F.array_join(F.transform(c, lambda x: x.text), " ~ "), F.lit(""))
    return _id(d).select("session_id", "topic", "topic_source", joined("first_prompts").alias("prompts"), joined("reports").alias("reports"), "n_events", F.coalesce("unanswered", F.lit(False)).alias("unanswered"))


@registered("""
with s as (select conv_id as session_id, conv_id + 1700000000 as updated_at, arg_min(text, turn) filter (role = 'user') as f, arg_max(text, turn) filter (role = 'user') as l,
  max(turn) filter (role = 'user') as h, coalesce(max(turn) filter (role = 'user'), -1) > coalesce(max(turn) filter (role = 'assistant'), -1) as u from conversations group by conv_id order by conv_id desc limit 30)
select session_id, coalesce(f, 'Empty session') as topic, trim(regexp_replace(f, '\\s+', ' ', 'g')) as first_prompt, trim(regexp_replace(l, '\\s+', ' ', 'g')) as last_message, '@o' || h as last_message_handle, case when u then 'last message unanswered' end as warning from s""".replace("\\\\", "\\"))
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(digests.session_list(main_lines(spark, sf_dir), 30)).select("session_id", "topic", "first_prompt", "last_message", "last_message_handle", "warning")


@registered("""
select user_id as session_id, max(ts) as updated_at, count(*) as n_events, arg_max(event_type, event_id) as last_operation
from events group by user_id order by updated_at desc, session_id limit 30""")
def session_list_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = operations(spark, sf_dir).groupBy("session_id").agg(F.max("ts").alias("updated_at"), F.count("*").alias("n_events"), F.max_by("name", "offset").alias("last_operation"))
    return windows.top(s, 30, F.desc("updated_at"), F.col("session_id"))


@registered("""
select session_id, count(*) as n_events from (select user_id as session_id, ts, max(ts) over (partition by user_id) as u from events)
where u >= timestamp '2024-01-31 00:00:00' - interval 24 hour group by session_id""")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = operations(spark, sf_dir).groupBy("session_id").agg(F.max("ts").alias("updated_at"), F.count("*").alias("n_events"))
    return search.recent(s, F.lit("2024-01-31 00:00:00").cast(s.schema["updated_at"].dataType), 24).select("session_id", "n_events")


# -- messages, search, spans -----------------------------------------------------------------------


@registered("""
select conv_id as session_id, '@o' || turn as handle, case role when 'user' then 'owner' else 'agent' end as kind, text from (
  select * from conversations where role in ('user', 'assistant') qualify row_number() over (partition by conv_id order by turn desc) <= 3)""")
def messages_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = digests.normalized(main_lines(spark, sf_dir))["messages"]
    kept = windows.last_n(search.message_filter(parsed, ["owner", "agent"]), 3)
    return _id(kept).select("session_id", T.handle("offset").alias("handle"), "kind", "text")


_FOUND = """case when p > 12 then '…' else '' end || substr(text, greatest(p - 12, 1), least(p + len(m) - 1 + 12, len(text)) - greatest(p - 12, 1) + 1) || case when p + len(m) - 1 + 12 < len(text) then '…' else '' end"""


@registered(rf"""
with f as (select conv_id as session_id, turn as "offset", text, regexp_extract(text, '(?i)\s(the|und)\s+[a-z]{{2,4}}[\s.,]', 0) as m from conversations where regexp_matches(text, '(?i)\s(the|und)\s+[a-z]{{2,4}}[\s.,]')),
g as (select *, strpos(text, m) as p from f) select session_id, "offset", {_FOUND.replace('p > 12', 'p > 13')} as snippet from g""")
def grep_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    pattern = r"\s(the|und)\s+[a-z]{2,4}[\s.,]"
    found = m.filter(F.col("text").rlike(f"(?i){pattern}"))
    return search.grep(found, pattern, 12).select("session_id", "offset", "snippet")


@registered(rf"""
with f as (select doc_id, text, strpos(lower(text), 'license') as p, 'license' as m from documents where contains(lower(text), 'license')) select doc_id, {_FOUND.replace('p > 12', 'p > 13')} as snippet from f""")
def grep_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep(table(spark, sf_dir, "documents"), "license", 12).select("doc_id", "snippet")


@registered("select distinct conv_id as session_id from conversations where contains(lower(text), 'and the')")
def sessions_mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.mentions(messages(spark, sf_dir), "And the", by=S)


#: What the indexed search looks for, and which sources (None: all).
_SEARCHES = [("license", None), (r"licen[cs]ed?\s+under", None), ("(MIT|Apache|BSD)[ -]+Licen[cs]e", ["src0", "src1", "src17"]), (r"\b(under|unter) (the )?[a-z]+ l", None), ("a.b", ["src3"])]


@registered(" union all ".join(f"""select {k} as search, doc_id from documents where regexp_matches(text, '(?i){p}')""" + (f" and source in ({', '.join(repr(x) for x in s)})" if s else "") for k, (p, s) in enumerate(_SEARCHES)))
def indexed_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    index.build(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path, tags=["source"], by=["doc_id"], order=[])
    found = (index.grep(spark, path, p, 12, **({"source": s} if s else {})).select(F.lit(k).alias("search"), "doc_id") for k, (p, s) in enumerate(_SEARCHES))
    return reduce(DataFrame.unionByName, found)


@registered("select distinct conv_id as session_id from conversations where contains(lower(text), 'and the')")
def indexed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    index.build(messages(spark, sf_dir), path, tags=["kind"], by=S, order=O)
    return index.mentions(spark, path, "And the")


_RANKED = 'select user_id as session_id, event_id as "offset", event_type as name, row_number() over (partition by user_id order by event_id) as r from events'


@registered(f"""
with e as ({_RANKED}), t as (select session_id, max(r) as tr, max("offset") as target from e where name = 'error' group by session_id)
select session_id, target, "offset", name from e join t using (session_id) where r between tr - 2 and tr + 2""")
def span_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    targets = ops.filter("name = 'error'").groupBy("session_id").agg(F.max("offset").alias("target"))
    return windows.span_around(ops.select("session_id", "offset", "seq", "name"), targets, 2, by=S).select("session_id", "target", "offset", "name")


@registered("""
with t as (select user_id, min(event_id) filter (event_type = 'click') as a, max(event_id) filter (event_type = 'error') as b from events group by user_id)
select e.user_id as session_id, e.event_id as "offset", e.event_type as name from events e join t using (user_id) where e.event_id >= a and e.event_id < b""")
def span_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    ends = ops.groupBy("session_id").agg(F.min(F.when(F.col("name") == "click", F.col("offset"))).alias("a"), F.max(F.when(F.col("name") == "error", F.col("offset"))).alias("b"))
    return ops.join(ends, "session_id").filter("offset >= a and offset < b").select("session_id", "offset", "name")


@registered("""select conv_id as session_id, turn as "offset", text from conversations where role = 'user' qualify row_number() over (partition by conv_id order by turn) <= 3""")
def first_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_n(messages(spark, sf_dir).filter("kind = 'owner'"), 3, by=S).select("session_id", "offset", "text")


@registered("""select conv_id as session_id, turn as "offset", role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 2""")
def last_n_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_n(messages(spark, sf_dir), 2, by=S).select("session_id", "offset", "role", "text")


@registered("""select conv_id as session_id, turn as "offset", row_number() over (partition by conv_id order by turn) - 1 as ordinal from conversations""")
def record_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ordinals(messages(spark, sf_dir), by=S).select("session_id", "offset", "ordinal")


@registered("""
select conv_id as session_id, coalesce(s, l, f, 'Empty session') as topic, case when s is not null then 'custom_title' when l is not null then 'last_prompt' when f is not null then 'first_prompt' else 'none' end as topic_source from (
  select conv_id, arg_max(text, turn) filter (role = 'system') as s, arg_max(text, turn) filter (role = 'user' and turn > 0) as l, arg_min(text, turn) filter (role = 'user') as f from conversations group by conv_id)""")
def topic_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("role") == "system", F.lit("custom_title")), F.when((F.col("role") == "user") & (F.col("offset") > 0), F.lit("last_prompt")), F.when(F.col("role") == "user", F.lit("first_prompt")), F.lit("other"))))
    return windows.topic(m.drop("kind").withColumn("kind", kinds).withColumn("in_tail", F.lit(True)), by=S)


@registered("""select conv_id as session_id, max(turn) filter (role = 'user') as asked_offset from conversations group by conv_id
having coalesce(max(turn) filter (role = 'user'), -1) > coalesce(max(turn) filter (role = 'assistant'), -1)""")
def unanswered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.unanswered(messages(spark, sf_dir), F.col("kind") == "owner", F.col("kind") == "agent", by=S).filter("unanswered").select("session_id", "asked_offset")


@registered("""
select conv_id as session_id, turn * 2 as "offset", role, text from (
  select *, lag(role) over w as r, lag(trim(regexp_replace(text, '\\s+', ' ', 'g'))) over w as t from conversations where role in ('user', 'assistant') window w as (partition by conv_id order by turn))
where r is null or r <> role or t <> trim(regexp_replace(text, '\\s+', ' ', 'g'))""".replace("\\\\", "\\"))
def adjacent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.rollout_rows(rollout_lines(spark, sf_dir))
    return _id(windows.drop_adjacent_messages(rows)).select("session_id", "offset", "role", "text")


@registered("""
select conv_id as session_id, turn as "offset", case turn % 6 when 0 then 'owner' when 1 then 'peer' when 2 then 'task_notification' when 3 then 'owner_command' when 4 then 'interrupt' else 'owner' end as kind,
  case turn % 6 when 0 then trim(text, E' \\n\\t\\r') when 1 then trim(text, E' \\n\\t\\r') when 2 then '<task-notification>' || text || '</task-notification>' when 3 then '/go ' || turn when 4 then trim('[Request interrupted by user] ' || text, E' \\n\\t\\r') else trim(text, E' \\n\\t\\r') end as text,
  case when turn % 6 = 1 then 'peer ' || turn end as sender from conversations""".replace("\\\\", "\\"))
def classify_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("offset") % 6
    wrapped = (
        F.when(turn == 0, F.col("text"))
        .when(turn == 1, F.concat(F.lit('<agent-message from="peer '), F.col("offset").cast("string"), F.lit('">'), "text", F.lit("</agent-message>")))
        .when(turn == 2, F.concat(F.lit("<task-notification>"), "text", F.lit("</task-notification>")))
        .when(turn == 3, F.concat(F.lit("<command-name>/go</command-name><command-args>"), F.col("offset").cast("string"), F.lit("</command-args>")))
        .when(turn == 4, F.concat(F.lit("[Request interrupted by user] "), "text"))
        .otherwise(F.concat(F.lit("<system-reminder>note</system-reminder>"), "text"))
    )
    m = messages(spark, sf_dir).select("session_id", "offset", wrapped.alias("text"))
    return classify.classify_texts(m, "text").select("session_id", "offset", "kind", "text", "sender")


@registered("""select conv_id as session_id, case role when 'user' then 'owner' when 'assistant' then 'agent' else 'harness' end as kind, count(*) as n from conversations group by all""")
def kind_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.totals(messages(spark, sf_dir), by=S)


@registered("""select conv_id as session_id, turn as "offset", text from conversations where role = 'user'""")
def wire_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.wire_rows(wire_lines(spark, sf_dir)).filter(normalize.is_human_prompt())).select("session_id", "offset", "text")


@registered("""select conv_id as session_id, 'cron' as origin_kind, count(*) as n from conversations where role = 'system' group by conv_id""")
def steer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(rollups.steer_counts(normalize.wire_rows(wire_lines(spark, sf_dir)))).select("session_id", "origin_kind", "n")


@registered("""
with r as (select *, sum(strlen(text)) over (partition by conv_id order by turn desc rows unbounded preceding) as running from conversations)
select conv_id as session_id, turn as "offset", cast(running as bigint) as running from r where running <= 1000""")
def output_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.within_budget(messages(spark, sf_dir), F.octet_length("text"), 1000, by=S).select("session_id", "offset", "running")


@registered("""
select conv_id as session_id, turn as "offset", trim(regexp_replace(text, '\\s+', ' ', 'g')) as one_line, substr(text, 1, 80) as head, greatest(len(text) - 80, 0) as truncated_chars,
  case when len(text) > 90 then '[truncated ' || (len(text) - 90) || ' chars]…' || substr(text, len(text) - 89) else text end as tail,
  case when len(text) > 40 then substr(text, 1, 40) || '…' else text end as short, string_split(text, chr(10))[1] as first_line,
  trim(regexp_replace(regexp_replace(trim(text, E' \\n\\t\\r'), '\\s*\\n\\s*', ' ⏎ ', 'g'), '\\s+', ' ', 'g')) as paragraphs from conversations""".replace("\\\\", "\\"))
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = T.head_chars("text", 80)
    return messages(spark, sf_dir).select("session_id", "offset", T.single_line("text").alias("one_line"), head.text.alias("head"), head.truncated_chars.alias("truncated_chars"), T.truncate_tail("text", 90).alias("tail"), T.truncate_chars("text", 40).alias("short"), T.first_line("text").alias("first_line"), T.paragraphs_on_one_line("text").alias("paragraphs"))


@registered("""
select conv_id as session_id, turn as "offset", case when r <= 2 then substr(text, 1, 100) else string_split(text, chr(10))[1] end as excerpt from (
  select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 4""")
def tiered_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tiered_excerpts(messages(spark, sf_dir), 4, 2, 100, by=S).select("session_id", "offset", "excerpt")


# -- operation logs --------------------------------------------------------------------------------


@registered("select user_id as session_id, event_type as name, count(*) as n from events group by all")
def tool_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.tool_histogram(operations(spark, sf_dir), by=S, name="name")


@registered("""select user_id as session_id, event_id as "offset", value from events where event_type = 'click' qualify row_number() over (partition by user_id order by event_id desc) <= 5""")
def recent_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_n(operations(spark, sf_dir).filter("name = 'click'"), 5, by=S).select("session_id", "offset", "value")


@registered("""
select user_id as session_id, event_id as "offset", event_type as name from (select *, max(event_id) filter (event_type = 'signup') over (partition by user_id) as b from events) where b is null or event_id > b""")
def post_boundary_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.after_boundary(operations(spark, sf_dir), F.col("name") == "signup", by=S).select("session_id", "offset", "name")


@registered("""select user_id as session_id, count(distinct event_id) as compaction_count, max(ts) as last_compaction_time from events where event_type = 'signup' group by user_id""")
def boundary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir).select(F.lit("main").alias("format"), "session_id", "offset", "ts", F.col("offset").cast("string").alias("uuid"), (F.col("name") == "signup").alias("is_boundary"))
    return rollups.compaction_stats(ops).drop("format")


def _delegation_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Views launch the call of their id, purchases notify it."""
    ops = operations(spark, sf_dir).withColumn("format", F.lit("main")).withColumn("tool_use_id", F.col("call_id"))
    none = F.lit(None).cast("string")
    calls = ops.filter("name = 'view'").select("format", "session_id", "offset", "seq", "ts", "tool_use_id", F.lit("assistant").alias("type"), F.lit("tool_use").alias("block_type"), F.lit(False).alias("is_sidechain"), F.lit("Task").alias("tool_name"), F.parse_json(F.to_json(F.struct(F.concat(F.lit("job "), F.col("offset").cast("string")).alias("description"), F.lit(True).alias("run_in_background")))).alias("input"), F.parse_json(F.to_json(F.struct(F.concat(F.lit("agent"), "call_id").alias("agentId")))).alias("outcome"), none.alias("result_text"))
    told = ops.filter("name = 'purchase'").select("format", "session_id", "offset", "seq", F.concat(F.lit("<task-notification><tool-use-id>"), "call_id", F.lit("</tool-use-id><status>completed</status><result>paid "), F.col("value").cast("string"), F.lit("</result></task-notification>")).alias("text"))
    answers = calls.withColumn("block_type", F.lit("tool_result")).withColumn("seq", F.lit(1))
    return calls, answers, told


def _delegations(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, answers, told = _delegation_records(spark, sf_dir)
    return correlate.correlated(correlate.launches(calls), correlate.results(answers), correlate.notifications(told))


_LAUNCHED = """with l as (select user_id as session_id, json_extract_string(props, '$.k') as k, min(event_id) as a from events where event_type = 'view' group by all),
n as (select user_id as session_id, json_extract_string(props, '$.k') as k, max(event_id) as b, arg_max(value, event_id) as v from events where event_type = 'purchase' group by all)"""


_STATUS = """ select l.session_id, '@o' || a as handle, k as tool_use_id, 'agent' || k as agent_id, 'job ' || a as description, case when b > a then 'completed' else 'running' end as status, case when b > a then 'paid ' || v end as excerpt from l left join n using (session_id, k)"""


@registered(_LAUNCHED + _STATUS)
def delegation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.delegations(_delegations(spark, sf_dir)).select("session_id", "handle", "tool_use_id", "agent_id", "description", "status", "excerpt")


@registered(_LAUNCHED + _STATUS)
def delegation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the records in four batches, out of order: by the last row that it gave of each call."""
    calls, answers, told = _delegation_records(spark, sf_dir)
    facts = followed.facts(calls.unionByName(answers), told)
    lines, checkpoint, changed = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    files = spark.sparkContext.defaultParallelism  # of a batch
    facts.repartition(4 * files, F.xxhash64("offset", "fact")).write.parquet(lines)
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", files).parquet(lines)
    calls = followed.aggregated(stream)
    changes = calls.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    changes.foreachBatch(lambda rows, batch: rows.withColumn("version", F.lit(batch)).write.mode("append").parquet(changed)).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(calls.schema.add("version", "long")).parquet(changed)
    held = followed.latest(rows).filter("offset is not null").withColumn("session_id", F.col("session_id").cast("bigint"))
    return correlate.delegations(held).select("session_id", "handle", "tool_use_id", "agent_id", "description", "status", "excerpt")


@registered(_LAUNCHED + " select l.session_id, count(*) as launched, count(*) filter (b is null or b < a) as running from l left join n using (session_id, k) group by all")
def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.delegations(_delegations(spark, sf_dir)).groupBy("session_id").agg(F.count("*").alias("launched"), F.count_if(F.col("status") == "running").alias("running"))


@registered("""
with e as (select user_id as session_id, json_extract_string(props, '$.k') as k, event_id, event_type, case when event_type = 'view' then 'view ' || json_extract_string(props, '$.k') end as n, value from events where event_type in ('view', 'purchase', 'error'))
select session_id, event_id as "offset", coalesce(name, 'tool') as name, case event_type when 'error' then 'failed' else 'completed' end as status, 'out ' || value as text from (
  select *, last_value(n ignore nulls) over (partition by session_id, k order by event_id rows unbounded preceding) as name from e) where event_type <> 'view'""")
def named_tool_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.update_rows(update_lines(spark, sf_dir))
    named = windows.named_by_call(rows.withColumn("name", F.when(F.col("kind") == "tool_call", F.col("title"))))
    return _id(named.filter("kind = 'tool_update'")).select("session_id", "offset", "name", "status", "text")


@registered("""select user_id as session_id, event_id as "offset", 'view ' || json_extract_string(props, '$.k') || ': run ' || json_extract_string(props, '$.k') as description from events where event_type = 'view'""")
def tool_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.update_rows(update_lines(spark, sf_dir)).filter("kind = 'tool_call'")
    return _id(rows).select("session_id", "offset", normalize.describe("title", "input").alias("description"))


@registered("select event_type as type, count(*) as n from events where event_type not in ('view', 'click') group by all")
def unknown_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.unknown_types(operations(spark, sf_dir).withColumnRenamed("name", "type"), ["view", "click"])


@registered("""
select user_id as session_id, arg_max(value, event_id) filter (event_type = 'purchase') as bought, arg_max(value, event_id) filter (event_type = 'error') as failed,
  arg_min(ts, event_id) as first_event_time, arg_max(ts, event_id) as last_event_time, count(ts) as n_events from events group by user_id""")
def latest_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir).withColumn("bought", F.when(F.col("name") == "purchase", F.col("value"))).withColumn("failed", F.when(F.col("name") == "error", F.col("value")))
    return windows.latest(ops, ["bought", "failed"], by=S).join(windows.time_span(ops, by=S), "session_id")


@registered("""
with u as (select user_id as session_id, case event_type when 'view' then 'haiku' when 'click' then 'sonnet' when 'purchase' then 'opus' end as family, cast(floor(value * 10) as bigint) as i, cast(floor(value) as bigint) as o, event_id % 7 as w, event_id % 11 as r from events),
p(family, pin, pout) as (values ('haiku', 1.0, 5.0), ('sonnet', 3.0, 15.0), ('opus', 15.0, 75.0)),
s as (select session_id, family, sum(i) as i, sum(o) as o, sum(w) as w, sum(r) as r from u group by all)
select session_id, family, cast(i as bigint) as input, cast(o as bigint) as output, cast(i + w + r as bigint) as total_input, cast(i + w + r + o as bigint) as total, round(i + w + r * 0.1::double, 6) as effective_input,
  round((i * pin::double + w * pin::double * 1.25::double + r * pin::double * 0.1::double + o * pout::double) / 1e6::double, 8) as cost_usd from s left join p using (family)""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    model = F.when(F.col("name") == "view", "x-haiku-4").when(F.col("name") == "click", "X-Sonnet-4").when(F.col("name") == "purchase", "opus-4-x").otherwise("other")
    rows = ops.select("session_id", model.alias("model"), F.floor(F.col("value") * 10).alias("input"), F.floor("value").alias("output"), (F.col("offset") % 7).alias("cache_write"), (F.col("offset") % 11).alias("cache_read"))
    return rollups.usage_totals(rows, S).select("session_id", "family", "input", "output", "total_input", "total", F.round("effective_input", 6).alias("effective_input"), F.round("cost_usd", 8).alias("cost_usd"))


# -- documents and pages ---------------------------------------------------------------------------


@registered("""
select doc_id from (select doc_id, row_number() over (partition by substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) order by doc_id desc) as r from documents) where r = 1""".replace("\\\\", "\\"))
def undelivered_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = table(spark, sf_dir, "documents").select(F.lit("all").alias("session_id"), F.col("doc_id").alias("offset"), "text")
    return correlate.undelivered(queued, queued, by=S).select(F.col("offset").alias("doc_id"))


@registered("""
select doc_id, '/src/' || source as repo, 'b' || (doc_id % 3) as branch, substr(md5(cast(doc_id as varchar)), 1, 10) as hash, 'change ' || doc_id as subject from documents""")
def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    sid = F.col("doc_id").cast("string")
    base = d.select(F.lit("main").alias("format"), F.lit("all").alias("session_id"), F.col("doc_id").alias("offset"), F.concat(F.lit("call"), sid).alias("tool_use_id"), "source", "doc_id")
    calls = base.select("format", "session_id", "offset", F.lit(0).alias("seq"), "tool_use_id", F.lit("tool_use").alias("block_type"), F.lit("Bash").alias("tool_name"), F.parse_json(F.to_json(F.struct(F.concat(F.lit("git -C /src/"), "source", F.lit(" commit -m x")).alias("command")))).alias("input"), F.lit(None).cast("string").alias("result_text"))
    line = F.concat(F.lit("ok\n[b"), (F.col("doc_id") % 3).cast("string"), F.lit(" "), F.substring(F.md5(sid.cast("binary")), 1, 10), F.lit("] change "), sid, F.lit("\n 1 file changed"))
    outs = base.select("format", "session_id", "offset", F.lit(1).alias("seq"), "tool_use_id", F.lit("tool_result").alias("block_type"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("variant").alias("input"), line.alias("result_text"))
    return correlate.commits(calls.unionByName(outs)).select(F.col("offset").alias("doc_id"), "repo", "branch", "hash", "subject")


_PATH = """lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("offset"), F.lit(0).alias("seq"), F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)).alias("host"), T.slashes(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)).alias("path"))


@registered(f"select host, path, count(*) as n, max(page_id) as last_offset from (select page_id, {_PATH} from pages) group by all")
def file_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.touches(_paths(spark, sf_dir), by=["host"])


@registered(f"""
with f as (select host, path, min(page_id) as first from (select page_id, {_PATH} from pages) group by all)
select host, path, row_number() over (partition by host order by first, path) as place from f qualify place <= 5""")
def distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.distinct_files(_paths(spark, sf_dir), 5, by=["host"])


#: What the query plants behind every document, by doc_id modulo 8, what must come of it, and how many redactions it costs.
_PLANTED = [
    ("", "", 0),
    ("\npassword\u00a0: hunter2\nnext", "\n[REDACTED]\nnext", 1),
    ("\ncall bearer\u2003abc.def now", "\n[REDACTED]", 1),
    ("\n-----BEGIN RSA PRIVATE KEY-----\nMIIabc\npassword: x\n-----END RSA PRIVATE KEY-----\nnext", "\n[REDACTED]\nnext", 1),
    ("\npass\u0007word: x\n\nbell\u0007s", "\n[REDACTED]\n\nbells", 1),
    ("\nkey sk-abcdefghijklmnop12, https://me:pw@host/x", "\nkey [REDACTED], https://[REDACTED]@host/x", 2),
    ("\neyJabcdefgh1.abcdefgh12.abcdefgh12 my_token = 3\n-----begin private key-----", "\n[REDACTED]\n[REDACTED]", 2),
    ("\r\ntokens and secrets, basic\nthings\r\n", "\ntokens and secrets, basic\nthings", 0),
]


def _chosen(i: int) -> str:
    quoted = lambda x: " || ".join(f"chr({ord(c)})" if ord(c) < 32 or ord(c) > 126 else f"'{c}'" for c in x) or "''"
    return "case doc_id % 8 " + " ".join(f"when {k} then {quoted(p[i]) if i < 2 else p[i]}" for k, p in enumerate(_PLANTED)) + " end"


#: The forms of credentials in the SQL engine's own terms, line by line; its blanks are ASCII only.
_LINE_SQL = r"""(?i)(^|[^a-z0-9_])["'']?([a-z0-9_]+_)?(password|passwd|secret|token|api[_-]?key|authorization)["'']?[\s\x{a0}\x{2003}]*[:=]|\b(bearer|basic)[\s\x{a0}\x{2003}]+[^\s,;"'']+"""
_PARTS_SQL = (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", r"\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[A-Z0-9]{16})\b", r"([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]+:[^/@\s]+@")
_REDACTED = rf"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
r as (select *, regexp_matches(line, '{_LINE_SQL}') as whole from l),
t as (select doc_id, source, i, case when whole then 1 else len(regexp_extract_all(line, '{_PARTS_SQL[0]}')) + len(regexp_extract_all(line, '{_PARTS_SQL[1]}')) + len(regexp_extract_all(line, '{_PARTS_SQL[2]}')) end as n,
  case when whole then '[REDACTED]' else regexp_replace(regexp_replace(regexp_replace(line, '{_PARTS_SQL[0]}', '[REDACTED]', 'g'), '{_PARTS_SQL[1]}', '[REDACTED]', 'g'), '{_PARTS_SQL[2]}', '\1[REDACTED]@', 'g') end as line from r),
d as (select doc_id, source, sum(n) + {_chosen(2)} as n, string_agg(line, chr(10) order by i) || {_chosen(1)} as text from t group by doc_id, source)"""


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    plants = F.element_at(F.array(*(F.lit(p[0]) for p in _PLANTED)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").withColumn("text", F.concat("text", plants))


@registered(_REDACTED + " select doc_id, cast(n as bigint) as redactions, md5(ltrim(text, chr(10))) as digest from d")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redact.redact_column(_planted(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "redactions", F.md5(F.col("text").cast("binary")).alias("digest"))


@registered(_REDACTED + " select source, count(*) as rows, cast(sum(n) as bigint) as redactions from d group by source")
def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redaction_counts(redact.redact_column(_planted(spark, sf_dir).select("source", "text")), "source")


@registered("select source, count(*) as lines, cast(sum(strlen(text)) as bigint) as bytes from documents group by source")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.scan_stats(table(spark, sf_dir, "documents").select("source", F.col("text").alias("value")), "source")


_LOG = r"""with l as (select doc_id, source, doc_id || ' ' || regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g') as line from documents),
d as (select doc_id, source, line, strlen(line) as nbytes, cast(sum(strlen(line) + 1) over (partition by source order by doc_id) - strlen(line) - 1 as bigint) as "offset", sum(strlen(line) + 1) over (partition by source) as file_size from l)"""


def _written_logs(spark: SparkSession, sf_dir: str) -> str:
    """Documents written as one log for each source, a line a document."""
    path = shared_dir(spark)
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", line.alias("value"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").text(path)
    return path


def _log_lines(spark: SparkSession, path: str, **window) -> DataFrame:
    lines = logs.raw_lines(spark, path, glob="part-*", split_bytes=256 << 10, **window)
    return lines.withColumn("source", F.regexp_extract("file_path", "/source=([^/]*)/", 1)).withColumn("doc_id", F.substring_index("value", " ", 1).cast("bigint"))


def _source_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs read back by byte ranges."""
    return _log_lines(spark, _written_logs(spark, sf_dir))


@registered(_LOG + """ select doc_id, source, "offset", nbytes, md5(line) as digest from d""")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_logs(spark, sf_dir).select("doc_id", "source", "offset", "nbytes", F.md5(F.col("value").cast("binary")).alias("digest"))


@registered(_LOG + """ select doc_id, ("offset" + nbytes + 1 <= 20000 or file_size <= 20000) as in_head, (file_size <= 30000 or "offset" > file_size - 30000) as in_tail, file_size > 30000 as truncated from d""")
def head_tail_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_logs(spark, sf_dir).select("doc_id", logs.in_head(20_000).alias("in_head"), logs.in_tail(30_000).alias("in_tail"), logs.truncated(30_000).alias("truncated"))


@registered(_LOG + """ select doc_id, 'tail' as part from d where file_size <= 30000 or "offset" > file_size - 30000 union all select doc_id, 'head' from d where "offset" + nbytes + 1 <= 20000 or file_size <= 20000
union all select doc_id, 'after' from d where "offset" >= 25000 and "offset" + nbytes <= 45000 union all select doc_id, 'before' from d where "offset" < 25000 and "offset" >= 5000""")
def log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every log, each reading only its bytes."""
    path = _written_logs(spark, sf_dir)
    parts = {"tail": {"tail": 30_000}, "head": {"head": 20_000}, "after": {"start": 25_000, "end": 45_001}, "before": {"start": 5000, "end": 25_000}}
    found = reduce(DataFrame.unionByName, (_log_lines(spark, path, **w).withColumn("part", F.lit(name)) for name, w in parts.items()))
    return found.filter((F.col("part") != "after") | logs.after(25_000, 20_000)).select("doc_id", "part")


@registered(_LOG + """ select doc_id, true as is_meta, false as malformed from d where "offset" = 0
union all select doc_id, false, false from (select doc_id, row_number() over (partition by source order by "offset" desc) as r from d where "offset" > 0 and (file_size <= 50000 or "offset" > file_size - 50000)) where r <= 12""")
def bounded_log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.bounded_records(_source_logs(spark, sf_dir), 50_000, 12, "source").select("doc_id", "is_meta", "malformed")


@registered(_LOG + """ select doc_id, '@o' || "offset" as handle, "offset" as parsed from d""")
def byte_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_logs(spark, sf_dir).select("doc_id", T.handle("offset").alias("handle"), T.parse_handle(T.handle("offset")).alias("parsed"))


# -- the delegation forest -------------------------------------------------------------------------
# Each event is a session, numbered within its user. A signup was launched by nobody, a view by the user's event before it, an error whose
# k ends in 7 by the event after it (with a view there, a cycle), any other by event k mod its number.

_EDGES = """
n as (select event_id as session, user_id, event_type as t, cast(json_extract_string(props, '$.k') as bigint) as k, cast(round(value * 100) as bigint) as tokens, row_number() over (partition by user_id order by event_id) - 1 as i from events),
w as (select *, case when t = 'signup' then null when t = 'view' then i - 1 when t = 'error' and k % 10 = 7 then i + 1 when i > 0 then k % i end as pi from n),
g as (select w.session, w.t, w.tokens, p.session as parent from w left join n p on p.user_id = w.user_id and p.i = w.pi),
f as (select session, session as root, 0 as depth from g where parent is null union all select g.session, f.root, f.depth + 1 from g join f on g.parent = f.session)"""


def _launched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges (child, parent) and measures (session, tokens, open) of the events."""
    rows = windows.ordinals(operations(spark, sf_dir), by=S).select("session_id", "offset", "name", "value", F.col("call_id").cast("bigint").alias("k"), F.col("ordinal").alias("i"))
    i, k, name = F.col("i"), F.col("k"), F.col("name")
    place = F.when(name == "signup", None).when(name == "view", i - 1).when((name == "error") & (k % 10 == 7), i + 1).when(i > 0, F.expr("try_mod(k, i)"))
    named = rows.withColumn("place", place).filter("place is not null").select("session_id", F.col("offset").alias("child"), F.col("place").alias("i"))
    edges = named.join(rows.select("session_id", "i", F.col("offset").alias("parent")), ["session_id", "i"]).select("child", "parent")
    return edges, rows.select(F.col("offset").alias("session"), F.round(F.col("value") * 100).cast("bigint").alias("tokens"), (name == "click").cast("bigint").alias("open"))


@registered(f"with recursive {_EDGES} select g.session, f.root, f.depth from g left join f using (session) where g.parent is not null or g.session in (select parent from g)")
def delegation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.forest(_launched(spark, sf_dir)[0])


@registered(f"""with recursive {_EDGES} select f.root, count(*) as n_sessions, max(f.depth) as max_depth, cast(sum(g.tokens) as bigint) as tokens, count(*) filter (g.t = 'click') as "open"
from g left join f using (session) group by f.root""")
def delegation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, measures = _launched(spark, sf_dir)
    return forest.rolled_up(forest.forest(edges), measures, ["tokens", "open"])
