"""Facts that span records: delegations, background tasks, commits, queue items never delivered.

The reference of a call and its later results is an equi-join on (session, call id). Where order matters
the candidate is reduced to one row for each key first, so there are no range joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .classify import classify_texts
from .normalize import KEY, ORDER, get, once, text_at


def status(raw: str | Column) -> Column:
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.when(raw.isin("failed", "error"), F.lit("failed")).otherwise(raw)


NOTICE = "<task-notification>"


def _launch() -> tuple[Column, dict[str, Column]]:
    """Whether a block launches something, and the fields of the launch."""
    i = lambda k: text_at(f"$.{k}", "input")
    background = F.coalesce(get("$.run_in_background", "boolean", "input"), F.lit(False))
    kind = F.when(F.col("tool_name").isin("Agent", "Task"), "delegation").when((F.col("tool_name") == "Bash") & background, "background")
    holds = F.expr("type = 'assistant' and block_type = 'tool_use' and not is_sidechain and tool_use_id is not null") & kind.isNotNull()
    return holds, {"kind": kind, "launched_at": F.col("ts"), "description": i("description"), "agent_type": i("subagent_type"), "prompt": i("prompt"), "command": i("command"), "run_in_background": background}


def launch_rows(blocks: DataFrame) -> DataFrame:
    """Delegations (Agent, Task) and background shell tasks on the main chain, every sighting of an id."""
    holds, fields = _launch()
    return blocks.filter(holds).select(*KEY, "tool_use_id", *ORDER, *(c.alias(n) for n, c in fields.items()))


def launches(blocks: DataFrame) -> DataFrame:
    """The first sighting of each launch."""
    rows = launch_rows(blocks)
    row = F.struct(*(c for c in rows.columns if c not in (*KEY, "tool_use_id")))
    return rows.groupBy(*KEY, "tool_use_id").agg(F.min_by(row, F.struct(*ORDER)).alias("l")).select(*KEY, "tool_use_id", "l.*")


def notification_rows(texts: DataFrame) -> DataFrame:
    """Status and excerpt of each `<task-notification>` text, by the call id it names."""
    found = texts.filter(F.contains("text", F.lit(NOTICE))).select(*KEY, *ORDER, F.coalesce(T.tag("text", "tool-use-id"), T.tag("text", "tool_use_id")).alias("tool_use_id"), T.tag("text", "status").alias("raw"), F.coalesce(T.tag("text", "result"), T.tag("text", "summary")).alias("excerpt"))
    return found.filter("tool_use_id is not null")


def notifications(texts: DataFrame) -> DataFrame:
    """The last notification of each call."""
    return notification_rows(texts).groupBy(*KEY, "tool_use_id").agg(F.max_by(F.struct("raw", "excerpt", "offset"), F.struct(*ORDER)).alias("n")).select(*KEY, "tool_use_id", F.col("n.raw").alias("notified"), F.col("n.excerpt").alias("notified_excerpt"), F.col("n.offset").alias("notified_at"))


def _result() -> dict[str, Column]:
    return {"agent_id": text_at("$.agentId", "outcome"), "sync_excerpt": F.col("result_text"), "task_id": F.nullif(F.regexp_extract("result_text", "background with ID: ([^. \n]*)", 1), F.lit(""))}


def result_rows(blocks: DataFrame) -> DataFrame:
    """What tool results say of a launch: the agent's id, a synchronous text, a background task's id."""
    return blocks.filter("block_type = 'tool_result'").select(*KEY, *ORDER, "tool_use_id", *(c.alias(n) for n, c in _result().items()))


def results(blocks: DataFrame) -> DataFrame:
    """The last of each that a call's results say."""
    at = F.struct(*ORDER)
    return result_rows(blocks).groupBy(*KEY, "tool_use_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("agent_id", "sync_excerpt", "task_id")), F.max("offset").alias("result_at"))


def correlated(launches: DataFrame, results: DataFrame, notifications: DataFrame) -> DataFrame:
    on = [*KEY, "tool_use_id"]
    later = lambda c, at: F.when(F.col(at) >= F.col("offset"), F.col(c)).alias(c)
    joined = launches.join(results, on, "left").join(notifications, on, "left")
    kept = [c for c in launches.columns]
    return joined.select(*kept, *(later(c, "result_at") for c in ("agent_id", "sync_excerpt", "task_id")), *(later(c, "notified_at") for c in ("notified", "notified_excerpt")))


def calls(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """`correlated` of these blocks and notification texts, by one scan of each and one aggregate: every sighting of a call is a row
    of one long-form table, and a call's launch, results and notification are taken from its group."""
    holds, launch = _launch()
    struct = lambda fields: F.struct(*(c.alias(n) for n, c in fields.items()))
    answers = F.expr("block_type = 'tool_result' and tool_use_id is not null and " + " and ".join(f"{k} is not null" for k in KEY))
    # A block's fields, then its facts, are read once each, whatever mentions them.
    read = blocks.filter("block_type in ('tool_use', 'tool_result')").select(*KEY, *ORDER, once(F.struct("type", "block_type", "is_sidechain", "ts", "tool_use_id", "tool_name", "input", "result_text", "outcome")).alias("b")).select(*KEY, *ORDER, "b.*")
    facts = once(F.struct(F.when(holds, struct(launch)).alias("launch"), F.when(answers, struct(_result())).alias("result")))
    said = read.select(*KEY, "tool_use_id", *ORDER, facts.alias("x")).filter("x.launch is not null or x.result is not null").select(*KEY, "tool_use_id", *ORDER, "x.launch", "x.result")
    told = notification_rows(texts).filter(" and ".join(f"{k} is not null" for k in KEY)).select(*KEY, "tool_use_id", *ORDER, F.struct("raw", "excerpt").alias("notice"))
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(*ORDER))
    each = said.unionByName(told, allowMissingColumns=True).groupBy(*KEY, "tool_use_id").agg(
        F.min_by(F.struct(*ORDER, "launch"), at("launch")).alias("l"), F.max(F.when(F.col("result").isNotNull(), F.col("offset"))).alias("result_at"),
        *(F.max_by(f"result.{c}", at(f"result.{c}")).alias(c) for c in _result()), F.max_by(F.struct("notice", "offset"), at("notice")).alias("n"),
    )
    later = lambda c, when: F.when(F.col(when) >= F.col("l.offset"), F.col(c))
    return each.filter("l is not null").select(*KEY, "tool_use_id", *(f"l.{c}" for c in ORDER), *(f"l.launch.{c}" for c in launch), *(later(c, "result_at").alias(c) for c in _result()), later("n.notice.raw", "n.offset").alias("notified"), later("n.notice.excerpt", "n.offset").alias("notified_excerpt"))


def delegations(correlated: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row for each delegation, its status from the notification, else completed if it ran in the foreground and
    answered, else launched or running. meta (session_id, agent_id, agent_type, description) overrides the launch."""
    d = correlated.filter("kind = 'delegation'")
    if meta is not None:
        m = meta.select("session_id", "agent_id", F.col("agent_type").alias("meta_type"), F.col("description").alias("meta_description"))
        d = d.join(m, ["session_id", "agent_id"], "left").withColumn("agent_type", F.coalesce("meta_type", "agent_type")).withColumn("description", F.coalesce("meta_description", "description")).drop("meta_type", "meta_description")
    answered = F.col("sync_excerpt").isNotNull() & ~F.col("run_in_background")
    state = F.when(F.col("notified").isNotNull(), status("notified")).when(answered, F.lit("completed")).when(F.col("run_in_background") & F.col("agent_id").isNull(), F.lit("launched")).otherwise(F.lit("running"))
    return d.select(*KEY, T.handle("offset").alias("handle"), "offset", "seq", short_id("tool_use_id", "agent_id").alias("short_id"), "tool_use_id", "agent_id", "description", "agent_type", "prompt", "run_in_background", "launched_at", state.alias("status"), F.coalesce("notified_excerpt", F.when(answered, F.col("sync_excerpt"))).alias("excerpt"))


def background_tasks(correlated: DataFrame) -> DataFrame:
    b = correlated.filter("kind = 'background'")
    state = F.when(F.col("notified").isNotNull(), status("notified")).when(F.col("task_id").isNotNull(), F.lit("running")).otherwise(F.lit("launched"))
    return b.select(*KEY, T.handle("offset").alias("handle"), "offset", "tool_use_id", "task_id", "command", "description", "launched_at", state.alias("status"), F.when(F.col("notified").isNotNull(), F.col("notified_excerpt")).otherwise(F.when(F.col("task_id").isNull(), F.col("sync_excerpt"))).alias("excerpt"), F.col("notified").isNull().alias("open"))


def background_totals(tasks: DataFrame) -> DataFrame:
    running = F.collect_list(F.when(F.col("open"), F.struct("offset", F.coalesce("task_id", T.truncate_bytes("tool_use_id", 12)).alias("id"))))
    return tasks.groupBy(*KEY).agg(F.count("*").alias("launched"), F.transform(F.array_sort(running), lambda x: x.id).alias("still_running"))


def short_id(call: str, agent: str) -> Column:
    return F.coalesce(F.col(agent), T.truncate_bytes(F.regexp_replace(call, r"\A(?:toolu_)+", ""), 12))


def matches_id(needle: str, id_column: str = "agent_id", call: str = "tool_use_id") -> Column:
    """A delegation or task by prefix of its id, by its call id, or by the short form of that."""
    return F.coalesce(F.startswith(F.col(id_column), F.lit(needle)), F.lit(False)) | (F.col(call) == needle) | (short_id(call, id_column) == needle)


def commits(blocks: DataFrame, cwd: DataFrame | None = None) -> DataFrame:
    """Confirmed commits: `git ... commit` shell calls with the confirmation lines of their first result."""
    command = text_at("$.command", "input")
    calls = blocks.filter("block_type = 'tool_use' and tool_name = 'Bash'").withColumn("command", command).filter(T.is_git_commit("command"))
    calls = calls.groupBy(*KEY, "tool_use_id").agg(F.max_by(F.struct("offset", "command"), F.struct(*ORDER)).alias("c")).select(*KEY, "tool_use_id", "c.*")
    out = blocks.filter("block_type = 'tool_result'").select(*KEY, "tool_use_id", F.col("offset").alias("r"), "seq", "result_text")
    first = calls.join(out, [*KEY, "tool_use_id"]).filter("r >= offset").groupBy(*KEY, "tool_use_id", "offset", "command").agg(F.min_by("result_text", F.struct("r", "seq")).alias("output"))
    each = first.select(*KEY, "offset", T.repo_of_command("command").alias("repo"), F.posexplode(T.commit_lines("output")).alias("seq", "c"))
    if cwd is not None:
        each = each.join(cwd, KEY, "left").withColumn("repo", F.coalesce("repo", "cwd"))
    return each.select(*KEY, T.handle("offset").alias("handle"), "offset", "seq", "repo", "c.branch", "c.hash", "c.subject")


def undelivered(queued: DataFrame, delivered: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Queued texts that no later record repeats. queued and delivered: the session's columns, offset, text. One delivery
    answers any number of equal queued texts, so the last delivery of each text decides."""
    last = delivered.filter("text is not null").groupBy(*by, T.match_key("text").alias("match")).agg(F.max("offset").alias("delivered_at"))
    waiting = queued.filter("text is not null").withColumn("match", T.match_key("text"))
    return waiting.join(last, [*by, "match"], "left").filter(F.col("delivered_at").isNull() | (F.col("delivered_at") <= F.col("offset"))).drop("match", "delivered_at")


def stuck_queue(operations: DataFrame, users: DataFrame, attachments: DataFrame) -> DataFrame:
    """Enqueued texts never delivered, with the kind of their sender. users: first text block of user events."""
    enqueued = operations.filter("operation = 'enqueue'").select(*KEY, *ORDER, "ts", F.col("content").alias("text"))
    later = users.select(*KEY, "offset", "text").unionByName(attachments.filter("attachment_type = 'queued_command'").select(*KEY, "offset", F.col("prompt").alias("text"))).unionByName(operations.filter("operation = 'remove'").select(*KEY, "offset", F.col("content").alias("text")))
    waiting = undelivered(enqueued, later).withColumn("content", F.col("text"))
    return classify_texts(waiting, "text").select(*KEY, *ORDER, "ts", F.col("content").alias("text"), "kind")


def with_lookup(rows: DataFrame, small: DataFrame, on: str | list[str]) -> DataFrame:
    """Dimension lookup (titles, groups, live sessions). Spark broadcasts the side if its size allows."""
    return rows.join(small, on, "left")
