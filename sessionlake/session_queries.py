"""Registered queries over scripted sessions: all row kinds of the main format, and the other formats' rows.

Every 24 rows of `events` in order of event_id are one session; a row's place in it says which record it
becomes (a prompt, a delegation, its result, a commit, a queue operation, a boundary ...), its values fill the
record. Each row is rendered as a JSON line of the log format and parsed back, so the queries run the whole way from
raw lines; the SQL states what must come out from the row's place and values alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import classify, correlate, normalize, redact, rollups, search, windows
from .operators.normalize import KEY, ORDER
from .plans import digest as digests
from .queries import ORACLE, QUERIES, registered, table  # noqa: F401
from .sources.scratch import stored

STEPS = 24


# -- rendering -------------------------------------------------------------------------------------


class Raw:
    """A column that holds JSON already."""

    def __init__(self, column: Column):
        self.column = column


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def obj(**fields) -> Column:
    """A JSON object; null fields are left out."""
    raw = {name: x.column for name, x in fields.items() if isinstance(x, Raw)}
    plain = [_lit(x).alias(name) for name, x in fields.items() if not isinstance(x, Raw)]
    if not raw:
        return F.to_json(F.struct(*plain))
    inner = F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), x) for name, x in raw.items()))
    # JSON of plain values ends with one brace, which comes back behind the inner objects.
    head = F.concat(F.rtrim(F.to_json(F.struct(*plain)), F.lit("}")), F.lit(",")) if plain else F.lit("{")
    return F.concat(head, inner, F.lit("}"))


def arr(*items: Column) -> Raw:
    return Raw(F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")))


def cat(*parts) -> Column:
    return F.concat(*(_lit(p).cast("string") for p in parts))


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.floor(F.col("event_id") / STEPS).cast("bigint").alias("session"), (F.col("event_id") % STEPS).alias("step"), F.col("event_type").alias("et"), "value", F.get_json_object("props", "$.k").alias("k"))


def as_lines(rows: DataFrame, kind: str, value: Column) -> DataFrame:
    sid = F.col("session").cast("string")
    lines = rows.select("session", "step", normalize.once(value).alias("value")).filter("value is not null")
    return lines.select(
        F.lit(kind).alias("format"), sid.alias("session_id"), (F.col("step") * 100).alias("offset"), "value", F.octet_length("value").cast("bigint").alias("nbytes"),
        F.lit(1 << 20).cast("bigint").alias("file_size"), cat("/logs/", sid, ".jsonl").alias("file_path"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("session")).alias("modified_at"),
    )


def rendered(rows: DataFrame, kind: str, records: list[Column]) -> DataFrame:
    """The lines of these records by step, a few records at a time (all in one expression are too much code), stored."""
    parts = []
    for first in range(0, len(records), 4):
        value = F.lit(None).cast("string")
        for step in range(first, min(first + 4, len(records))):
            value = F.when(F.col("step") == step, records[step]).otherwise(value)
        parts.append(as_lines(rows.filter(F.col("step").between(first, first + 3)), kind, value))
    return stored(reduce(DataFrame.unionByName, parts))


def main_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the main format, a record of another kind at each place."""
    i, k, et, v = F.col("event_id"), F.col("k"), F.col("et"), F.col("value")
    common = {"uuid": cat("u", i), "parentUuid": cat("u", i - 1), "sessionId": F.col("session").cast("string"), "timestamp": F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + i), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "isSidechain": (F.col("step") == 20) & (et == "signup"), "gitBranch": cat("b", k), "cwd": cat("/w/", k)}
    event = lambda kind, **more: obj(type=kind, **(common | more))
    user = lambda content, **more: event("user", message=Raw(obj(role="user", content=content)), **more)
    agent = lambda *blocks, **more: event("assistant", message=Raw(obj(model="x-opus-4", id=cat("m", i), type="message", role="assistant", content=arr(*blocks), usage=Raw(obj(input_tokens=F.floor(v), output_tokens=F.lit(3))))), **more)
    call = lambda name, id_, **args: obj(type="tool_use", id=id_, name=name, input=Raw(obj(**args)))
    result = lambda id_, content: arr(obj(type="tool_result", tool_use_id=id_, content=content))
    say = lambda text: obj(type="text", text=text)
    told = F.when(et == "error", cat("toolu_", i)).otherwise(cat("toolu_", i - 14))
    records = [
        F.when(et == "error", obj(type="ai-title", sessionId=F.col("session").cast("string"), aiTitle=cat("ai ", k))).otherwise(obj(type="custom-title", sessionId=F.col("session").cast("string"), customTitle=cat("title ", k))),
        user(cat("ask ", i, " in ui/p for fix(k", k, ")"), userType="external"),
        agent(obj(type="thinking", thinking="hm"), say(cat("plan ", k)), call("Task", cat("toolu_", i), description=cat("job ", k), subagent_type="explore", run_in_background=True)),
        user(result(cat("toolu_", i - 1), "started"), toolUseResult=Raw(obj(agentId=cat("ag", k)))),
        agent(call("Bash", cat("c", i), command=cat("git -C /r/", k, " commit -m x"))),
        user(result(cat("c", i - 1), cat("ok\n[main ", F.substring(F.md5(i.cast("string").cast("binary")), 1, 8), "] change ", i))),
        event("queue-operation", operation="enqueue", content=cat("queued ", i)),
        event("attachment", attachment=Raw(obj(type="queued_command", prompt=F.when(et.isin("view", "click"), cat("queued ", i - 1)).otherwise(cat("other ", i))))),
        F.when(et == "purchase", event("system", subtype="compact_boundary", compactMetadata=Raw(obj(trigger="auto", preTokens=F.floor(v), postTokens=F.lit(5))))).otherwise(event("system", subtype="error", content="note", error=Raw(obj(type="api", message=cat("boom ", i))))),
        user(cat("summary ", i), isCompactSummary=True),
        agent(call("TodoWrite", cat("t", i), todos=arr(obj(status="open", content=cat("todo ", k)), obj(status="done", content="other")))),
        event("progress", data=Raw(obj(type="agent_progress", agentId=cat("ag", k), prompt=cat("look ", i), elapsedTimeSeconds=v, normalizedMessages=arr(obj(uuid=cat("r", i), type="user"), obj(uuid="same", type="assistant")))), toolUseID=cat("toolu_", i - 9)),
        obj(type="file-history-snapshot", messageId=cat("m", i), snapshot=Raw(obj(trackedFileBackups=Raw(obj(f1=Raw(obj(backupFileName=cat("x@", k)))))))),
        agent(call("Edit", cat("e", i), file_path=cat("src\\f", i % 5, ".py"))),
        user(result(cat("e", i - 1), "edited"), toolUseResult=Raw(obj(type="update", filePath=cat("src/f", (i - 1) % 5, ".py"), content=cat("body ", k), structuredPatch=arr(obj(oldStart=F.lit(1), oldLines=i % 7, newStart=F.lit(2), newLines=F.lit(4)))))),
        user("ignored", origin=Raw(obj(kind="peer", **{"from": "w"}, name=cat("N", k), body=cat(" note ", i), handback=True))),
        user(cat("<task-notification><tool-use-id>", told, "</tool-use-id><status>", F.when(et == "click", "error").otherwise("completed"), "</status><result>done ", k, "</result></task-notification>")),
        user(cat("[Request interrupted by user] ", i)),
        agent(call("Bash", cat("g", i), command="sleep 9", run_in_background=True)),
        user(result(cat("g", i - 1), cat("Command running in background with ID: bg", k, ". Output below"))),
        agent(say(cat("final ", i, "\nsee docs/"))),
        event("queue-operation", operation="enqueue", content=F.when(et == "error", "<task-notification>x</task-notification>").otherwise(cat("left ", i))),
        F.when(et.isin("view", "click"), user(cat("last ", i))).otherwise(agent(say(cat("closing ", i)))),
        F.when(et == "view", F.lit("{broken")).otherwise(obj(type=cat("brand-", et))),
    ]
    return rendered(scripted(spark, sf_dir), "main", records)


_E = f"""with e as (select event_id as i, event_id // {STEPS} as session_id, event_id % {STEPS} as step, (event_id % {STEPS}) * 100 as "offset", event_type as et, value as v, json_extract_string(props, '$.k') as k, cast(to_timestamp(1700000000 + event_id) as timestamp) as ts from events)
"""


def _id(df: DataFrame) -> DataFrame:
    return df.withColumn("session_id", F.col("session_id").cast("bigint"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.events(main_lines(spark, sf_dir))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.content_blocks(_events(spark, sf_dir))


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return classify.incoming(e, normalize.attachments(e))


# -- events and blocks -----------------------------------------------------------------------------

_TYPE = """case when step = 0 then case et when 'error' then 'ai-title' else 'custom-title' end when step in (6, 21) then 'queue-operation' when step = 7 then 'attachment' when step = 8 then 'system'
  when step = 11 then 'progress' when step = 12 then 'file-history-snapshot' when step = 23 then 'brand-' || et when step in (2, 4, 10, 13, 18, 20) or step = 22 and et not in ('view', 'click') then 'assistant' else 'user' end"""


@registered(_E + f"""
select session_id, "offset", {_TYPE} as type, case when step = 23 then 'other' else {_TYPE} end as root_type,
  case when step = 0 then cast(session_id as varchar) when step not in (12, 23) then 'u' || i end as uuid, case when step not in (0, 12, 23) then 'u' || (i - 1) end as parent_uuid,
  case when step not in (0, 12, 23) then ts end as ts, step = 20 and et = 'signup' as is_sidechain, step = 9 as is_compact_summary, case when step not in (0, 12, 23) then '/w/' || k end as cwd,
  {_TYPE} in ('user', 'assistant', 'system') as is_relevant, step = 1 as is_external from e where not (step = 23 and et = 'view')""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _id(_events(spark, sf_dir))
    return e.select("session_id", "offset", "type", "root_type", "uuid", "parent_uuid", "ts", "is_sidechain", "is_compact_summary", "cwd", normalize.is_context_relevant().alias("is_relevant"), normalize.is_external().alias("is_external"))


@registered(_E + "select session_id, count(*) as lines, count(*) filter (step = 23 and et = 'view') as malformed from e group by all")
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.malformed(normalize.parse(main_lines(spark, sf_dir)), "session_id"))


_B = _E + """, b as (
  select *, 0 as seq, 'text' as block_type, case step when 1 then 'ask ' || i || ' in ui/p for fix(k' || k || ')' when 9 then 'summary ' || i when 15 then 'ignored' when 17 then '[Request interrupted by user] ' || i when 22 then 'last ' || i
    else '<task-notification><tool-use-id>toolu_' || (case et when 'error' then i else i - 14 end) || '</tool-use-id><status>' || (case et when 'click' then 'error' else 'completed' end) || '</status><result>done ' || k || '</result></task-notification>' end as text,
    cast(null as varchar) as tool_use_id, cast(null as varchar) as tool_name, cast(null as varchar) as result_text from e where step in (1, 9, 15, 16, 17) or step = 22 and et in ('view', 'click')
  union all select *, 0, 'thinking', null, null, null, null from e where step = 2
  union all select *, case step when 2 then 1 else 0 end, 'text', case step when 2 then 'plan ' || k when 20 then 'final ' || i || chr(10) || 'see docs/' else 'closing ' || i end, null, null, null from e where step in (2, 20) or step = 22 and et not in ('view', 'click')
  union all select *, case step when 2 then 2 else 0 end, 'tool_use', null, case step when 2 then 'toolu_' when 4 then 'c' when 10 then 't' when 13 then 'e' else 'g' end || i, case step when 2 then 'Task' when 10 then 'TodoWrite' when 13 then 'Edit' else 'Bash' end, null from e where step in (2, 4, 10, 13, 18)
  union all select *, 0, 'tool_result', null, case step when 3 then 'toolu_' when 5 then 'c' when 14 then 'e' else 'g' end || (i - 1), null,
    case step when 3 then 'started' when 5 then 'ok' || chr(10) || '[main ' || substr(md5(cast(i as varchar)), 1, 8) || '] change ' || i when 14 then 'edited' else 'Command running in background with ID: bg' || k || '. Output below' end from e where step in (3, 5, 14, 19))
"""


@registered(_B + """select session_id, "offset", seq, block_type, text, tool_use_id, tool_name, result_text, case when block_type = 'thinking' then 'hm' end as thinking from b""")
def session_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(_blocks(spark, sf_dir)).select("session_id", "offset", "seq", "block_type", "text", "tool_use_id", "tool_name", "result_text", "thinking")


@registered(_E + """
select session_id, "offset", case step when 3 then 'toolu_' else 'e' end || (i - 1) as tool_use_id, case step when 14 then 'update' end as outcome_type, case step when 14 then 'src/f' || ((i - 1) % 5) || '.py' end as file_path,
  case step when 14 then 'body ' || k end as text, case step when 14 then i % 7 end as old_lines from e where step in (3, 14)""")
def tool_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = normalize.tool_outcomes(_blocks(spark, sf_dir))
    return _id(o).select("session_id", "offset", "tool_use_id", "outcome_type", "file_path", "text", F.get("hunks", 0).old_lines.alias("old_lines"))


@registered(_E + """select session_id, "offset", 'queued_command' as attachment_type, case when et in ('view', 'click') then 'queued ' || (i - 1) else 'other ' || i end as prompt, ts as delivered_at from e where step = 7""")
def queued_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.attachments(_events(spark, sf_dir))).select("session_id", "offset", "attachment_type", "prompt", "delivered_at")


@registered(_E + """select session_id, "offset", 'agent_progress' as progress_type, 'ag' || k as agent_id, 'look ' || i as prompt, v as elapsed_seconds, 'toolu_' || (i - 9) as tool_use_id from e where step = 11""")
def progress_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.progress(_events(spark, sf_dir))).select("session_id", "offset", "progress_type", "agent_id", "prompt", "elapsed_seconds", "tool_use_id")


@registered(_E + """select session_id, 'r' || i as uuid, 'user' as type, 0 as seq from e where step = 11 union all select session_id, 'same', 'assistant', 1 from e where step = 11""")
def replayed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.replayed_messages(_events(spark, sf_dir))).select("session_id", "uuid", "type", "seq")


@registered(_E + """select session_id, "offset", 'f1' as path, 'x@' || k as backup from e where step = 12""")
def file_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.file_backups(_events(spark, sf_dir))).select("session_id", "offset", "path", "backup")


@registered(_B + """select session_id, "offset", text from b where block_type = 'text' union all select session_id, "offset", 'look ' || i from e where step = 11 union all select session_id, "offset", 'note' from e where step = 8 and et <> 'purchase'""")
def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.event_text(_events(spark, sf_dir))).select("session_id", "offset", "text")


@registered(_E + r"""select session_id, "offset", 'src\f' || (i % 5) || '.py' as path from e where step = 13 union all select session_id, "offset", 'src/f' || ((i - 1) % 5) || '.py' from e where step = 14 union all select session_id, "offset", 'f1' from e where step = 12""")
def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return _id(normalize.event_files(e, normalize.content_blocks(e))).select("session_id", "offset", "path")


@registered(_B + """select session_id, "offset", seq, case block_type when 'tool_use' then tool_name else 'tool_result:' || tool_use_id end as tool from b where block_type in ('tool_use', 'tool_result')""")
def event_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.event_tools(_blocks(spark, sf_dir))).select("session_id", "offset", "seq", "tool")


@registered(_B + f"""
, t as (select session_id, "offset", list(case block_type when 'tool_use' then tool_name else block_type end order by case block_type when 'text' then -1 else seq end) as said from b group by all)
select session_id, "offset", array_to_string(list_concat(list_concat([{_TYPE}], case when step = 8 then [case et when 'purchase' then 'compact_boundary' else 'error' end] when {_TYPE} = 'assistant' then ['x-opus-4'] else [] end),
  list_concat(coalesce(said, []), list_concat(case step when 11 then ['agent_progress'] when 7 then ['queued_command'] else [] end, case when step = 20 and et = 'signup' then ['sidechain'] else [] end))), ' ') as tags
from e left join t using (session_id, "offset") where not (step = 23 and et = 'view')""")
def event_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.event_tags(_events(spark, sf_dir))).select("session_id", "offset", F.array_join("tags", " ").alias("tags"))


@registered(_E + """select session_id, "offset", ts, 'enqueue' as operation, case when step = 6 then 'queued ' || i when et = 'error' then '<task-notification>x</task-notification>' else 'left ' || i end as content from e where step in (6, 21)""")
def queue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.queue_operations(_events(spark, sf_dir))).select("session_id", "offset", "ts", "operation", "content")


@registered(_E + """
select session_id, "offset", et = 'purchase' as is_boundary, et <> 'purchase' as is_error, case et when 'purchase' then 'auto' end as "trigger", case et when 'purchase' then cast(floor(v) as bigint) end as pre_tokens, case et when 'purchase' then 5 end as post_tokens,
  case when et <> 'purchase' then 'api: boom ' || i else 'system error' end as error_text from e where step = 8""")
def system_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.system_rows(_events(spark, sf_dir))).select("session_id", "offset", "is_boundary", "is_error", "trigger", "pre_tokens", "post_tokens", "error_text")


@registered(_E + f"""select session_id, "offset", 'm' || i as message_id, 'x-opus-4' as model, cast(floor(v) as bigint) as input, 3 as output from e where {_TYPE} = 'assistant'""")
def assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(normalize.assistant_turns(_events(spark, sf_dir))).select("session_id", "offset", "message_id", "model", F.col("usage.input").alias("input"), F.col("usage.output").alias("output"))


_LABELLED = """select session_id, "offset", case block_type when 'tool_use' then 'tool_use:' || tool_name else block_type end as label, substr(coalesce(text, case block_type when 'thinking' then 'hm' end, result_text), 1, 12) as head from b where step in (2, 5, 9) and block_type <> 'tool_use'"""


@registered(_B + _LABELLED + """ union all select session_id, "offset", 'tool_use:Task', '{"descriptio' from b where step = 2 and block_type = 'tool_use'
union all select session_id, "offset", case et when 'purchase' then 'compact_boundary' else 'error' end, case et when 'purchase' then 'auto' else substr('boom ' || i, 1, 12) end from e where step = 8
union all select session_id, "offset", 'content', 'note' from e where step = 8 and et <> 'purchase'""")
def records_by_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    handles = e.filter(F.col("offset").isin(200, 500, 800, 900)).select(*KEY, "offset")
    shown = search.show_records(e, normalize.content_blocks(e), handles)
    return _id(shown).select("session_id", "offset", "label", F.substring("text", 1, 12).alias("head"))


@registered(_B + """select session_id, "offset", seq, block_type from b where session_id = 7 and "offset" >= 200 and "offset" < 1500""")
def span_of_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _id(_blocks(spark, sf_dir)).filter("session_id = 7")
    return windows.span_between(rows, 200, 1500).select("session_id", "offset", "seq", "block_type")


# -- who said what ---------------------------------------------------------------------------------

_IN = _B + """, n as (
  select session_id, "offset", ts, i, k, et, step, case step when 9 then 'compact_summary' when 15 then 'peer' when 16 then 'task_notification' when 17 then 'interrupt' else 'owner' end as kind,
    case step when 15 then 'note ' || i else text end as text, case step when 15 then 'N' || k end as sender, step = 15 as handback, 'turn' as delivery from b where block_type = 'text' and step in (1, 9, 15, 16, 17) or step = 22 and et in ('view', 'click')
  union all select session_id, "offset", ts, i, k, et, step, 'owner_mid_turn', case when et in ('view', 'click') then 'queued ' || (i - 1) else 'other ' || i end, null, false, 'mid-turn' from e where step = 7)
"""


@registered(_IN + """select session_id, "offset", kind, text, sender, handback, delivery from n""")
def incoming_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(_incoming(spark, sf_dir)).select("session_id", "offset", "kind", "text", "sender", "handback", "delivery")


@registered(_IN + """
select session_id, "offset", case kind when 'peer' then 'peer' when 'task_notification' then 'notification' else 'owner' end as kind, text from n where kind in ('owner', 'owner_mid_turn', 'peer', 'task_notification')
union all select session_id, "offset", 'agent', text from b where block_type = 'text' and (step = 2 or step = 20 and et <> 'signup' or step = 22 and et not in ('view', 'click'))""")
def main_chain_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(digests.normalized(main_lines(spark, sf_dir))["messages"]).select("session_id", "offset", "kind", "text")


# -- facts that span records -----------------------------------------------------------------------


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What calls, results and notifications are read from, stored so that lines are parsed once.
    e = stored(_events(spark, sf_dir).filter(F.col("type").isin("user", "assistant", "attachment")).select(*KEY, "offset", "ts", "type", "is_sidechain", "is_meta", "is_compact_summary", "v"))
    texts = classify.incoming(e, normalize.attachments(e), holding=correlate.NOTICE)
    texts = texts.select(*KEY, *ORDER, normalize.once(F.struct("kind", "text")).alias("t")).select(*KEY, *ORDER, "t.*")
    return correlate.calls(normalize.content_blocks(e), texts.filter("kind = 'task_notification'"))


_D = """, d as (select a.session_id, a.i, a."offset", a.k, r.k as rk, n.k as nk, n.et as net from e a left join e r on r.session_id = a.session_id and r.step = 3 left join e n on n.session_id = a.session_id and n.step = 16 and n.et <> 'error' where a.step = 2)"""


@registered(_E + _D + """
select session_id, '@o200' as handle, 'toolu_' || i as tool_use_id, 'ag' || rk as agent_id, case when session_id % 2 = 0 and rk is not null then 'meta' else 'explore' end as agent_type, 'job ' || k as description,
  case when nk is not null then case net when 'click' then 'failed' else 'completed' end when rk is null then 'launched' else 'running' end as status, 'done ' || nk as excerpt from d""")
def delegations_with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    even = scripted(spark, sf_dir).filter("step = 3 and session % 2 = 0")
    meta = even.select(F.col("session").cast("string").alias("session_id"), cat("ag", F.col("k")).alias("agent_id"), F.lit("meta").alias("agent_type"), F.lit(None).cast("string").alias("description"))
    return _id(correlate.delegations(facts, meta)).select("session_id", "handle", "tool_use_id", "agent_id", "agent_type", "description", "status", "excerpt")


@registered(_E + """
select a.session_id, 'g' || a.i as tool_use_id, 'bg' || r.k as task_id, 'sleep 9' as command, case when r.k is null then 'launched' else 'running' end as status, 1 as launched, coalesce('bg' || r.k, case when length('g' || a.i) <= 12 then 'g' || a.i end) as still_running
from e a left join e r on r.session_id = a.session_id and r.step = 19 where a.step = 18""")
def background_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = correlate.background_tasks(stored(_facts(spark, sf_dir)))
    total = correlate.background_totals(tasks)
    return _id(tasks.join(total, KEY)).select("session_id", "tool_use_id", "task_id", "command", "status", "launched", F.array_join("still_running", ",").alias("still_running"))


@registered(_E + """select a.session_id, '@o400' as handle, '/r/' || a.k as repo, 'main' as branch, substr(md5(cast(r.i as varchar)), 1, 8) as hash, 'change ' || r.i as subject from e a join e r on r.session_id = a.session_id and r.step = 5 where a.step = 4""")
def session_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(correlate.commits(stored(_blocks(spark, sf_dir)))).select("session_id", "handle", "repo", "branch", "hash", "subject")


_STUCK = """select q.session_id, q."offset", case when q.step = 21 and q.et = 'error' then 'task_notification' else 'owner' end as kind, case when q.step = 6 then 'queued ' || q.i when q.et = 'error' then '<task-notification>x</task-notification>' else 'left ' || q.i end as text
from e q left join e a on a.session_id = q.session_id and a.step = 7 and a.et in ('view', 'click') where q.step = 21 or q.step = 6 and a.i is null"""


@registered(_E + _STUCK)
def stuck_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored(_events(spark, sf_dir))
    users = windows.first_n(normalize.content_blocks(e).filter("type = 'user' and block_type = 'text'"), 1, by=[*KEY, "offset"], order=["seq"])
    return _id(correlate.stuck_queue(normalize.queue_operations(e), users, normalize.attachments(e))).select("session_id", "offset", "kind", "text")


@registered(_E + """select session_id, 'src/f' || (i % 5) || '.py' as path, count(*) as n, max("offset") as last_offset from e where step = 13 group by all""")
def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(rollups.file_touches(_blocks(spark, sf_dir))).select("session_id", "path", "n", "last_offset")


@registered(_E + """select session_id, 'k' || k as hint from e where step = 1 union select session_id, 'ui/p' from e where step = 1""")
def commit_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = digests.normalized(main_lines(spark, sf_dir))["messages"]
    return _id(rollups.commit_hints(said.filter("kind in ('owner', 'agent')"))).select("session_id", "hint")


@registered(_E + """select session_id, '@o1000' as handle, 'TodoWrite' as tool_name, 'open: todo ' || k || ', done: other' as todos, 0 as todos_omitted from e where step = 10""")
def open_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = rollups.open_work(_blocks(spark, sf_dir))
    return _id(w).select("session_id", "handle", "tool_name", F.array_join(F.transform("todos", lambda t: F.concat(t.status, F.lit(": "), t.content)), ", ").alias("todos"), "todos_omitted")


@registered(_E + "select session_id, 1048576 as size_bytes from e group by all")
def session_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(rollups.session_bytes(main_lines(spark, sf_dir))).select("session_id", "size_bytes")


# -- the digest, all sections ----------------------------------------------------------------------

_G = _IN + _D + """
, z as (select session_id, max("offset") filter (step = 8 and et = 'purchase') as boundary, count(*) filter (step = 8 and et = 'purchase') as compactions, max(ts) filter (step = 8 and et = 'purchase') as compacted, arg_max('/w/' || k, "offset") filter (step not in (0, 12, 23)) as cwd,
    arg_max('b' || k, "offset") filter (step not in (0, 12, 23)) as branch, count(*) filter (step not in (0, 12, 23)) as n_events, max(case step when 0 then case et when 'error' then 'ai ' || k else 'title ' || k end end) as title, max(case step when 0 then case et when 'error' then 'ai_title' else 'custom_title' end end) as title_kind,
    min(case step when 1 then 'ask ' || i || ' in ui/p for fix(k' || k || ')' end) as asked, count(*) filter (step = 2) as subagents, count(*) filter (step = 18) as tasks from e group by session_id)
, p as (select n.*, coalesce(n."offset" > z.boundary, true) as later from n join z using (session_id))
, q as (select b.*, coalesce(b."offset" > z.boundary, true) as later from b join z using (session_id))
, s as (select s.*, coalesce(s."offset" > z.boundary, true) as later from (""" + _STUCK + """) s join z using (session_id))
, y as (select session_id, max("offset") filter (kind in ('owner', 'owner_mid_turn', 'interrupt') and later) as asked_at, string_agg(text, '|' order by "offset") filter (kind in ('owner', 'owner_mid_turn') and later) as owner_messages, string_agg(text || '~' || sender, '|') filter (kind = 'peer' and later) as peer_messages,
    string_agg(text, '|') filter (kind = 'interrupt' and later) as interrupts, max(text) filter (kind = 'compact_summary') as summary, string_agg(text, '|' order by "offset") filter (kind = 'owner') as first_prompts from p group by session_id)
, x as (select session_id, max("offset") filter (block_type = 'text' and step in (2, 20, 22) and not (step = 22 and et in ('view', 'click')) and later) as answered_at, string_agg(text, '|' order by "offset") filter (block_type = 'text' and (step = 2 or step = 20 and et <> 'signup' or step = 22 and et not in ('view', 'click')) and later) as reports,
    string_agg(case step when 2 then 'Task' when 4 then 'Bash: git -C /r/' || k || ' commit -m x' when 10 then 'TodoWrite' when 13 then 'Edit: src\\f' || (i % 5) || '.py' else 'Bash: sleep 9' end, '|' order by "offset") filter (block_type = 'tool_use' and later) as operations,
    string_agg('src/f' || (i % 5) || '.py', '|') filter (step = 13 and later) as files from q group by session_id)
, w as (select session_id, string_agg(text, '|' order by "offset") filter (kind = 'owner' and later) as stuck, count(*) filter (kind = 'task_notification' and later) as leftover from s group by session_id)
""".replace("\\\\", "\\")


@registered(_G + """
select z.session_id, coalesce(title, asked, 'Empty session') as topic, coalesce(title_kind, case when asked is not null then 'first_prompt' else 'none' end) as topic_source, z.cwd, z.branch as git_branch, n_events, coalesce(compactions, 0) as compactions, compacted as last_compaction_time,
  first_prompts, owner_messages, peer_messages, reports, operations, case when er.i is not null and not coalesce(er."offset" <= boundary, false) then 'api: boom ' || er.i end as errors, interrupts, stuck, nullif(coalesce(leftover, 0), 0) as other_leftover,
  coalesce(asked_at is not null and (answered_at is null or asked_at > answered_at), false) as unanswered, summary, case when td.i is not null then 'TodoWrite' end as open_work, d.i is not null as delegated, case when d.i is not null then case when nk is not null then case net when 'click' then 'failed' else 'completed' end when rk is null then 'launched' else 'running' end end as delegation,
  nullif(tasks, 0) as background, case when c.i is not null and r.i is not null and not coalesce(c."offset" <= boundary, false) then 'change ' || r.i end as commits, files
from z left join y using (session_id) left join x using (session_id) left join w using (session_id) left join d using (session_id) left join e er on er.session_id = z.session_id and er.step = 8 and er.et <> 'purchase' left join e td on td.session_id = z.session_id and td.step = 10
left join e c on c.session_id = z.session_id and c.step = 4 left join e r on r.session_id = z.session_id and r.step = 5""")
def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _id(digests.digest(main_lines(spark, sf_dir), caps={"owner_chars": 10_000}))
    texts = lambda c, of=lambda x: x.text: F.nullif(F.array_join(F.transform(c, of), "|"), F.lit("")).alias(c)
    return d.select(
        "session_id", "topic", "topic_source", "cwd", "git_branch", "n_events", F.coalesce("compaction_count", F.lit(0)).alias("compactions"), "last_compaction_time", texts("first_prompts"), texts("owner_messages"),
        texts("peer_messages", lambda x: F.concat(x.text, F.lit("~"), x.sender)), texts("reports"), texts("operations"), texts("errors"), texts("interrupts"), texts("stuck"), F.col("other_leftover_count").alias("other_leftover"), F.coalesce("unanswered", F.lit(False)).alias("unanswered"),
        F.col("compaction_summary.excerpt").alias("summary"), F.col("open_work.tool_name").alias("open_work"), F.col("subagent_count").isNotNull().alias("delegated"), F.get("delegations", 0).status.alias("delegation"), F.col("background.launched").alias("background"), texts("commits", lambda x: x.subject), texts("files", lambda x: x.path),
    )


# -- rollout format --------------------------------------------------------------------------------


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the rollout format; the session's id is a UUID of its number."""
    i, k, et = F.col("event_id"), F.col("k"), F.col("et")
    item = lambda **p: obj(type="response_item", timestamp=cat(" T", i), payload=Raw(obj(**p)))
    flat = lambda **p: obj(type="event_msg", payload=Raw(obj(**p)))
    text = lambda kind, x: arr(obj(type=kind, text=x), obj(type=kind, text="more"))
    records = [
        obj(type="session_meta", payload=Raw(obj(id=F.when(et == "error", "other").otherwise(_uuid()), cwd=cat("/w/", k), model_provider="prov", git=Raw(obj(branch="main", commit_hash=F.substring(F.md5(i.cast("string").cast("binary")), 1, 10), repository_url=cat("https://h/t/p", k, ".git")))))),
        item(type="message", role="user", content=text("input_text", cat("do ", i))),
        flat(type="user_message", message=cat("do ", i - 1, "  more")),
        item(type="message", role="developer", content=text("input_text", "hidden")),
        flat(type="agent_message", message=F.when(et == "click", cat("token = ", i)).otherwise(cat("said ", i))),
        item(type="function_call", name=cat("tool", i % 3), call_id=cat("f", i), arguments=obj(command=cat("run ", i, "\nmore"))),
        item(type="function_call_output", call_id=cat("f", i - 1), output=arr(obj(text=cat("out ", k)), obj(text="end"))),
        item(type="function_call_output", call_id="none", output=cat("stray ", i)),
        flat(type="item_completed", item=Raw(obj(type="agent_message", message=cat("done ", i)))),
        flat(type="task_complete", error=Raw(obj(message=cat("failed ", i)))),
        obj(type="patch_apply_end", payload=Raw(F.concat(F.lit('{"changes":{"/w/'), k, F.lit('/src/a'), (i % 4).cast("string"), F.lit('.py":{},"/etc/x":{}}}')))),
        obj(type="turn_context", payload=Raw(obj(model=cat("model ", k)))),
        flat(type="user_message", message=F.when(et == "view", "<environment_context>x").otherwise(cat("again ", i))),
    ]
    lines = rendered(scripted(spark, sf_dir), "rollout", records)
    return lines.withColumn("session_id", F.format_string("00000000-0000-7000-8000-%012d", F.col("session_id").cast("bigint")))


def _uuid() -> Column:
    return F.format_string("00000000-0000-7000-8000-%012d", F.col("session"))


_R = _E + """, m as (
  select *, case step when 1 then 'user' when 2 then 'user' when 4 then 'assistant' when 5 then 'tool_call' when 6 then 'tool' when 7 then 'tool' when 8 then 'assistant' when 9 then 'error' when 12 then 'user' end as role,
    case step when 1 then 'do ' || i || chr(10) || 'more' when 2 then 'do ' || (i - 1) || '  more' when 4 then case et when 'click' then 'token = ' || i else 'said ' || i end when 5 then 'run ' || i || chr(10) || 'more' when 6 then 'out ' || k || chr(10) || 'end' when 7 then 'stray ' || i when 8 then 'done ' || i when 9 then 'failed ' || i when 12 then case et when 'view' then '<environment_context>x' else 'again ' || i end end as text
  from e where step in (1, 2, 4, 5, 6, 7, 8, 9, 12))
"""


def _number(df: DataFrame) -> DataFrame:
    return df.withColumn("session_id", F.substring("session_id", -12, 12).cast("bigint"))


@registered(_R + """select session_id, "offset", role, text, case step when 5 then 'tool' || (i % 3) end as name, case step when 5 then 'f' || i when 6 then 'f' || (i - 1) when 7 then 'none' end as call_id from m""")
def rollout_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(normalize.rollout_rows(rollout_lines(spark, sf_dir))).select("session_id", "offset", "role", "text", "name", "call_id")


@registered(_E + """select session_id, '/w/' || k as cwd, 'prov' as provider, 'main' as branch, substr(md5(cast(i as varchar)), 1, 10) as "commit", 'p' || k as repository from e where step = 0 and et <> 'error'""")
def rollout_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(normalize.rollout_meta(rollout_lines(spark, sf_dir))).select("session_id", "cwd", "provider", "branch", "commit", "repository")


@registered(_R + """, o as (
  select session_id, string_agg(case when step in (6, 7) then case when step = 6 and c.name is not null then c.name else 'tool' end || ' -> ' || text when role = 'assistant' and et = 'click' and step = 4 then '[REDACTED]' else text end, '|' order by "offset") as messages, count(*) filter (step = 4 and et = 'click') as redactions
  from m left join (select session_id as sid, 'tool' || (i % 3) as name from m where step = 5) c on c.sid = m.session_id
  where step <> 5 and not (step = 12 and et = 'view') and not (step = 2 and exists (select 1 from m u where u.session_id = m.session_id and u.step = 1)) group by session_id)
select h.session_id, o.messages, nullif(coalesce(o.redactions, 0), 0) as redactions, 'model ' || t.k as model, case when f.i is not null then 'run ' || f.i end as operations,
  case when p.k = h.k then 'src/a' || (p.i % 4) || '.py' end as changed, h.session_id is not null as known
from e h left join o using (session_id) left join e t on t.session_id = h.session_id and t.step = 11 left join e f on f.session_id = h.session_id and f.step = 5 left join e p on p.session_id = h.session_id and p.step = 10 where h.step = 0 and h.et <> 'error'""")
def rollout_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _number(digests.rollout_report(rollout_lines(spark, sf_dir)))
    joined = lambda c, of: F.nullif(F.array_join(F.transform(c, of), "|"), F.lit(""))
    return r.select("session_id", joined("messages", lambda x: x.text).alias("messages"), F.nullif("redactions", F.lit(0)).alias("redactions"), "model", joined("tool_ops", lambda x: x.detail).alias("operations"), F.nullif(F.array_join("changed_files", "|"), F.lit("")).alias("changed"), F.lit(True).alias("known"))
