"""Digests: everything a person needs to resume a session, one row for each, and the session list.

The main format's sections are rows of one long-form table, limited and gathered by one aggregate. In the reports of the other
formats each section is its own grouped job, ranked before it is collected, so an array never holds more than its cap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import classify, correlate, normalize, redact, rollups, windows
from ..operators.normalize import KEY, ORDER
from ..sources import logs
from ..sources.scratch import stored

#: Rows and characters of each section, as defaults.
CAPS = {"first_prompts": 3, "owner": 8, "owner_chars": 600, "peers": 3, "peer_chars": 300, "reports": 5, "report_chars": 700, "last_report_chars": 2000, "delegations": 10, "operations": 10, "errors": 5, "stuck": 8, "interrupts": 5, "files": 20, "hints": 20, "commits": 10, "summary_chars": 600}
TAIL, HEAD = 32 << 20, 4 << 20


def section(rows: DataFrame, name: str, n: int, *columns: Column, last: bool = True) -> DataFrame:
    """The last (or first) n rows of each session as one array of structs, oldest first."""
    kept = windows.last_n(rows, n) if last else windows.first_n(rows, n)
    each = kept.select(*KEY, F.struct(*ORDER, *columns).alias("x"))
    out = each.groupBy(*KEY).agg(F.array_sort(F.collect_list("x")).alias(name))
    return out.withColumn(name, F.transform(name, lambda x: x.dropFields(*ORDER)))


def _handle() -> Column:
    return T.handle("offset").alias("handle")


def normalized(lines: DataFrame) -> dict[str, DataFrame]:
    """The tables of main-format lines (format, session_id, offset, nbytes, file_size, value)."""
    events = stored(normalize.events(lines))  # every section reads these, and JSON is parsed once
    blocks = stored(normalize.content_blocks(events))
    attachments = normalize.attachments(events)
    incoming = stored(classify.incoming(events, attachments))
    system = normalize.system_rows(events)
    return {"events": events, "blocks": blocks, "attachments": attachments, "incoming": incoming, "system": system, "queue": normalize.queue_operations(events), "messages": classify.messages(incoming, blocks)}


TITLES = ("custom_title", "ai_title", "agent_name", "last_prompt")


def _title_text() -> Column:
    return F.coalesce(*(normalize.text_at(f"$.{k}") for k in ("customTitle", "aiTitle", "agentName", "lastPrompt", "title", "name", "prompt")))


def titles(events: DataFrame, incoming: DataFrame, tail: int = TAIL) -> DataFrame:
    """Candidates for a session's topic, with in_tail."""
    value = _title_text()
    marks = events.filter(F.col("type").isin([k.replace("_", "-") for k in TITLES])).select(*KEY, "offset", F.lit(0).alias("seq"), F.replace(F.col("type"), F.lit("-"), F.lit("_")).alias("kind"), value.alias("text"), (logs.tail_start(tail) <= F.col("offset")).alias("in_tail"))
    first = windows.first_n(incoming.filter("kind = 'owner'"), 1).select(*KEY, *ORDER, F.lit("first_prompt").alias("kind"), "text", F.lit(False).alias("in_tail"))
    return marks.unionByName(first)


#: What delegations, commits and task lists show of themselves.
FACTS = ("short_id", "agent_id", "description", "agent_type", "status", "excerpt", "repo", "branch", "hash", "subject", "tool_name")
#: Payload of a section's row: what any section shows; the rest is null.
PAYLOAD = {"text": "string", "ts": "timestamp", "sender": "string", "delivery": "string", "handback": "boolean", "n": "bigint", "facts": f"struct<{', '.join(f'{c}: string' for c in FACTS)}>"}
#: Sections that show what came before the last compact boundary too.
WHOLE = ("first_prompts", "summary", "open_work", "delegations")


def _tagged(rows: DataFrame, *tags: tuple[str, Column, dict[str, Column]], first: tuple[str, ...] = (), at: tuple[str, str] = ("offset", "seq")) -> DataFrame:
    """Long form of several sections in one scan: rows once for each tag whose condition holds. `late` says which of a
    session's rows of a tag are kept: the latest, or the earliest for tags in `first`."""

    def one(tag: str, holds: Column, payload: dict[str, Column]) -> Column:
        sign = -1 if tag in first else 1
        late = [(F.col(c) * sign).cast("bigint").alias(f"late{i}") for i, c in enumerate(at)]
        fields = [payload.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in PAYLOAD.items()]
        return F.when(holds, F.struct(F.lit(tag).alias("tag"), *late, F.col(at[0]).cast("bigint").alias("offset"), F.col(at[1]).cast("bigint").alias("seq"), *fields))

    each = F.explode(F.array_compact(F.array(*(one(*t) for t in tags))))
    return rows.select(*KEY, each.alias("row")).select(*KEY, "row.*")


def _kept(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The rows that sections show, at most caps[tag] of a session and tag, with `rank` from the last."""
    order = Window.partitionBy(*KEY, "tag").orderBy(F.desc("late0"), F.desc("late1"), F.col("text"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(caps.values()))
    shown = F.create_map(*(F.lit(x) for tag in caps.items() for x in tag))
    return ranked.filter(F.col("rank") <= F.try_element_at(shown, F.col("tag")))


def _facts(*names: str) -> Column:
    return F.struct(*((F.col(c) if c in names else F.lit(None)).cast("string").alias(c) for c in FACTS))


def _headers(events: DataFrame, tail: int) -> DataFrame:
    """One aggregate over the events: latest values, time span and title candidates."""
    at, told = F.col("offset"), ["cwd", "git_branch", "entrypoint", "version"]
    kind = F.replace(F.col("type"), F.lit("-"), F.lit("_"))
    title, in_tail = F.when(F.col("type").isin([k.replace("_", "-") for k in TITLES]), _title_text()), logs.tail_start(tail) <= at
    e = events.select(*KEY, "offset", *told, "ts", kind.alias("kind"), title.alias("title"), in_tail.alias("in_tail"))
    last = lambda c, holds: F.max_by(c, F.when(holds & F.col(c).isNotNull(), at))
    picks = [last("title", (F.col("kind") == k) & (F.col("in_tail") == F.lit(t))).alias(f"{k}_{t}") for t in (True, False) for k in TITLES]
    timed = F.when(F.col("ts").isNotNull(), at)
    return e.groupBy(*KEY).agg(*(last(c, F.lit(True)).alias(c) for c in told), F.min_by("ts", timed).alias("first_event_time"), F.max_by("ts", timed).alias("last_event_time"), F.count("ts").alias("n_events"), *picks)


def _counted(incoming: DataFrame, blocks: DataFrame, leftovers: DataFrame, delegations: DataFrame, boundary: DataFrame) -> DataFrame:
    """Files, hints and numbers of rows after the boundary, each counted once for a session, as rows of sections."""
    texts = incoming.filter(F.col("kind").isin("owner", "owner_mid_turn")).select(*KEY, "offset", "text").unionByName(blocks.filter(_said()).select(*KEY, "offset", "text"))
    seen = lambda df, tag, value: df.select(*KEY, "offset", F.lit(tag).alias("tag"), value.alias("text"))
    found = seen(rollups.mentions(texts), "hints", F.col("hint")).unionByName(seen(rollups.writes(blocks), "files", F.col("path"))).unionByName(seen(leftovers, "leftover", F.lit("")))
    later = found.join(boundary, KEY, "left").filter(F.col("boundary").isNull() | (F.col("offset") > F.col("boundary")))
    each = later.select(*KEY, "offset", "tag", "text").unionByName(seen(delegations, "subagents", F.lit("")))
    counts = each.groupBy(*KEY, "tag", "text").agg(F.count("*").alias("n"), F.max("offset").alias("offset"))
    late = F.when(F.col("tag") == "hints", F.lit(0)).otherwise(F.col("offset")).cast("bigint")
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in PAYLOAD.items() if c not in ("text", "n")]
    return counts.select(*KEY, "tag", late.alias("late0"), F.lit(0).cast("bigint").alias("late1"), "offset", F.lit(0).cast("bigint").alias("seq"), "text", "n", *empty)


def _said() -> Column:
    return F.expr("type = 'assistant' and block_type = 'text' and not is_sidechain and text is not null")


def digest(lines: DataFrame, meta: DataFrame | None = None, caps: dict[str, int] | None = None, tail: int = TAIL, head: int = HEAD) -> DataFrame:
    """One row for each session of the main format: header and all sections.

    Sections are rows of one long-form table (session, tag, payload). It is limited to the rows that sections show, before and after one
    shuffle, and brought together by one aggregate, so a session costs a bounded list whatever its length. The last N rows after the last boundary
    are those of the last N that lie after it: sections are cut at the boundary when they are shown, not by a join."""
    caps = CAPS | (caps or {})
    t = normalized(lines)
    events, blocks, system, incoming = t["events"], t["blocks"], t["system"], t["incoming"]
    facts = stored(correlate.calls(blocks, incoming.filter("kind = 'task_notification'")))  # three sections read these
    delegations = correlate.delegations(facts, meta)
    users = windows.first_n(blocks.filter("type = 'user' and block_type = 'text'"), 1, by=[*KEY, "offset"], order=["seq"])
    stuck = stored(correlate.stuck_queue(t["queue"], users, t["attachments"]))  # so do two with these
    boundary = system.filter("is_boundary").groupBy(*KEY).agg(F.max("offset").alias("boundary"))

    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    text, cut = F.col("text"), lambda n: T.truncate_chars("text", n)
    called, spoke = F.expr("type = 'assistant' and block_type = 'tool_use'"), F.expr("type = 'assistant' and block_type = 'text'")
    heard = _tagged(
        incoming,
        ("first_prompts", is_("owner"), {"text": text}),
        ("owner_messages", is_("owner", "owner_mid_turn", "owner_command"), {"text": cut(caps["owner_chars"]), "ts": F.col("ts"), "delivery": F.col("delivery")}),
        ("peer_messages", is_("peer"), {"text": cut(caps["peer_chars"]), "ts": F.col("ts"), "sender": F.col("sender"), "handback": F.col("handback")}),
        ("interrupts", is_("interrupt"), {"text": text}),
        ("summary", is_("compact_summary"), {"text": T.head_chars("text", caps["summary_chars"]).text, "ts": F.col("ts"), "n": F.length("text")}),
        ("asked", is_("owner", "owner_mid_turn", "owner_command", "interrupt"), {}),
        first=("first_prompts",),
    )
    told = _tagged(
        blocks,
        ("reports", _said(), {"text": text}),
        ("operations", called, {"text": normalize.describe("tool_name", "input")}),
        ("open_work", rollups.tracks_work(), {"text": F.to_json("input"), "ts": F.col("ts"), "facts": _facts("tool_name")}),
        ("answered", spoke, {}),
    )
    shown = [
        heard, told,
        _tagged(system, ("errors", F.col("is_error"), {"text": F.col("error_text")})),
        _tagged(stuck, ("stuck", is_("owner", "owner_command"), {"text": text, "ts": F.col("ts")})),
        _tagged(delegations, ("delegations", F.lit(True), {"facts": _facts("short_id", "agent_id", "description", "agent_type", "status", "excerpt")})),
        _tagged(correlate.commits(blocks), ("commits", F.lit(True), {"facts": _facts("repo", "branch", "hash", "subject")})),
        _counted(incoming, blocks, stuck.filter(is_("peer", "task_notification")), delegations, boundary),
    ]
    most = {"owner_messages": caps["owner"], "peer_messages": caps["peers"], **{c: caps[c] for c in ("first_prompts", "reports", "operations", "errors", "interrupts", "stuck", "delegations", "commits", "files", "hints")}}
    kept = _kept(reduce(DataFrame.unionByName, shown), most | dict.fromkeys(("summary", "open_work", "asked", "answered", "leftover", "subagents"), 1))
    report = F.when(F.col("rank") == 1, cut(caps["last_report_chars"])).otherwise(cut(caps["report_chars"]))
    kept = kept.withColumn("text", F.when(F.col("tag") == "reports", report).otherwise(text))
    gathered = kept.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("offset", "seq", "tag", *PAYLOAD))).alias("rows"))

    out = _headers(events, tail)
    for part in (boundary, rollups.session_bytes(lines), rollups.compaction_stats(system), correlate.background_totals(correlate.background_tasks(facts)).select(*KEY, F.struct("launched", "still_running").alias("background")), gathered):
        out = out.join(part, KEY, "left")
    return _shown(out)


def _shown(d: DataFrame) -> DataFrame:
    """The digest's columns from the gathered rows."""
    later = lambda x: F.col("boundary").isNull() | (x.offset > F.col("boundary"))
    of = lambda tag, cut=True: F.filter("rows", lambda x: (x.tag == tag) & (later(x) if cut and tag not in WHOLE else F.lit(True)))
    handle = lambda x: T.handle(x.offset).alias("handle")
    fact = lambda x, *names: [x.facts[n].alias(n) for n in names]

    def listed(tag: str, *fields) -> Column:
        found = F.transform(of(tag), lambda x: F.struct(*(c for f in fields for c in f(x))))
        return F.when(F.size(found) > 0, found).alias(tag)

    base = lambda x: [handle(x), x.text.alias("text")]
    stamp = lambda x: [x.ts.alias("timestamp")]
    only = lambda tag, **k: F.get(of(tag, **k), 0)
    place = lambda x: F.when(x.isNotNull(), F.struct(x.offset.alias("offset"), x.seq.alias("seq")))
    asked, answered, summary, work = place(only("asked")), place(only("answered")), only("summary"), only("open_work")
    unanswered = F.when(asked.isNotNull() | answered.isNotNull(), asked.isNotNull() & (answered.isNull() | (asked > answered)))
    first = F.get(of("first_prompts"), 0).text
    ranked = [(F.col(f"{k}_{t}"), k) for t in (True, False) for k in TITLES] + [(first, "first_prompt")]
    source = F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for c, k in ranked), F.lit("none"))
    hints = F.array_sort(F.transform(of("hints", cut=False), lambda x: x.text))
    return d.select(
        *KEY, "first_event_time", "last_event_time", "n_events", "cwd", "git_branch", "entrypoint", "version",
        F.coalesce(*(c for c, _ in ranked), F.lit(windows.NO_TOPIC)).alias("topic"), source.alias("topic_source"),
        "size_bytes", "compaction_count", "last_compaction_time",
        F.when(summary.isNotNull(), F.struct(handle(summary), summary.ts.alias("timestamp"), summary.n.alias("total_chars"), summary.text.alias("excerpt"))).alias("compaction_summary"),
        only("subagents", cut=False).n.alias("subagent_count"),
        listed("first_prompts", base),
        listed("owner_messages", base, stamp, lambda x: [x.delivery.alias("delivery")]),
        listed("peer_messages", base, lambda x: [x.sender.alias("sender"), x.handback.alias("handback")], stamp),
        listed("reports", base), listed("operations", base), listed("errors", base), listed("interrupts", base),
        listed("stuck", base, stamp),
        only("leftover", cut=False).n.alias("other_leftover_count"),
        unanswered.alias("unanswered"),
        F.when(work.isNotNull(), rollups.tracked_work(work.offset, work.ts, work.facts["tool_name"], work.text)).alias("open_work"),
        listed("delegations", lambda x: [handle(x)], lambda x: fact(x, "short_id", "agent_id", "description", "agent_type", "status", "excerpt")),
        "background",
        listed("commits", lambda x: [handle(x), F.coalesce(x.facts["repo"], F.col("cwd")).alias("repo")], lambda x: fact(x, "branch", "hash", "subject")),
        listed("files", lambda x: [handle(x), x.n.alias("n"), x.text.alias("path")]),
        F.when(F.size(hints) > 0, hints).alias("hints"),
    )


def agent_digest(lines: DataFrame, delegations: DataFrame, reports: int = 5, operations: int = 15, errors: int = 10, files: int = 20) -> DataFrame:
    """Delegations with the digest of their own transcripts. lines: as from sources.logs.delegated_transcripts."""
    own = lines.withColumn("format", F.lit("agent")).withColumn("parent", F.col("session_id")).withColumn("session_id", F.concat_ws("/", "session_id", "agent_id"))
    t = normalized(own)
    blocks = t["blocks"]
    said = blocks.filter("type = 'assistant' and block_type = 'text' and text is not null")
    parts = [
        section(said, "reports", reports, _handle(), "text"),
        section(blocks.filter("type = 'assistant' and block_type = 'tool_use'"), "tool_operations", operations, _handle(), normalize.describe("tool_name", "input").alias("text")),
        section(t["system"].filter("is_error"), "errors", errors, _handle(), F.col("error_text").alias("text")),
        section(rollups.file_touches(blocks).withColumnRenamed("last_offset", "offset").withColumn("seq", F.lit(0)), "files", files, "n", "path"),
    ]
    found = t["events"].select(*KEY).distinct().withColumn("transcript_found", F.lit(True))
    for part in parts:
        found = found.join(part, KEY, "left")
    detail = found.withColumn("agent_id", F.substring_index("session_id", "/", -1)).withColumn("session_id", F.substring_index("session_id", "/", 1)).drop("format")
    return delegations.join(detail, ["session_id", "agent_id"], "left").withColumn("transcript_found", F.coalesce("transcript_found", F.lit(False))).withColumn("final_report", F.element_at("reports", -1).text)


def session_list(lines: DataFrame, limit: int = 30, tail: int = TAIL) -> DataFrame:
    """The newest sessions with topic, first prompt, last message and a warning. File times alone choose them; only their
    lines are then parsed."""
    if not 1 <= limit <= 100:
        raise ValueError("a list holds 1 to 100 sessions")
    files = lines.groupBy(*KEY).agg(F.max("modified_at").alias("updated_at"), F.max("file_size").alias("size_bytes"))
    chosen = files.orderBy(F.desc("updated_at"), "session_id").limit(limit)
    own = lines.join(F.broadcast(chosen.select(*KEY)), KEY, "left_semi")
    t = normalized(own)
    first = windows.first_n(t["incoming"].filter("kind = 'owner'"), 1).select(*KEY, T.single_line("text").alias("first_prompt"))
    owners = t["incoming"].filter(F.col("kind").isin("owner", "owner_mid_turn", "owner_command"))
    last = windows.last_n(owners, 1).select(*KEY, T.single_line("text").alias("last_message"), F.col("delivery").alias("last_message_delivery"), T.handle("offset").alias("last_message_handle"))
    asked = t["incoming"].select(*KEY, *ORDER, F.col("kind").isin("owner", "owner_mid_turn", "owner_command", "interrupt").alias("asked"), F.lit(False).alias("answered")).unionByName(t["blocks"].filter("type = 'assistant' and block_type = 'text'").select(*KEY, *ORDER, F.lit(False).alias("asked"), F.lit(True).alias("answered")))
    users = windows.first_n(t["blocks"].filter("type = 'user' and block_type = 'text'"), 1, by=[*KEY, "offset"], order=["seq"])
    stuck = correlate.stuck_queue(t["queue"], users, t["attachments"]).filter(F.col("kind").isin("owner", "owner_command")).groupBy(*KEY).agg(F.count("*").alias("n_stuck"))
    out = chosen
    for part in (windows.topic(titles(t["events"], t["incoming"], tail)), first, last, stuck, windows.unanswered(asked, F.col("asked"), F.col("answered")).select(*KEY, "unanswered")):
        out = out.join(part, KEY, "left")
    return out.select(*KEY, "updated_at", "size_bytes", "topic", "topic_source", "first_prompt", "last_message", "last_message_delivery", "last_message_handle", rollups.warning().alias("warning")).orderBy(F.desc("updated_at"), "session_id")


def rollout_report(lines: DataFrame, index: DataFrame | None = None, messages: int = 48, operations: int = 15, tools: int = 64, files: int = 64, budget: int = 256 << 10) -> DataFrame:
    """One row for each rollout session: meta, redacted messages within an output budget, operations, tools, files."""
    rows = stored(normalize.rollout_rows(lines))  # parsed once; messages, calls and their outputs read these
    calls = rows.filter("role = 'tool_call'")
    named = windows.named_by_call(rows.filter("role in ('tool_call', 'tool')")).filter("role = 'tool'").withColumn("text", F.concat("name", F.lit(" -> "), "text"))
    said = rows.filter("role in ('user', 'assistant', 'error')").unionByName(named)
    clean = stored(redact.admit_messages(said))  # segments are scanned more than once
    kept = stored(windows.last_n(windows.drop_adjacent_messages(clean), messages))
    within = windows.within_budget(kept, F.octet_length(F.to_json(F.struct("role", "text", "ts_raw"))), budget)
    context = normalize.rollout_context(lines)
    meta = normalize.rollout_meta(lines)
    where = meta.select(*KEY, "cwd").join(context.select(*KEY, F.col("cwd").alias("later")), KEY, "left").select(*KEY, F.coalesce("later", "cwd").alias("cwd"))
    first = windows.first_n(clean.filter("role = 'user'"), 1).select(*KEY, T.truncate_chars(T.single_line("text"), 200).alias("first_prompt"))
    counts = rollups.tool_histogram(calls, names=tools, name="name").groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("tool_counts"))
    parts = [
        context.select(*KEY, "model"),
        first,
        section(within.drop("rank"), "messages", messages, "role", "text", "ts_raw"),
        section(redact.admit_operations(calls), "tool_ops", operations, "name", F.col("text").alias("detail"), "ts_raw"),
        counts,
        rollups.changed_files(normalize.rollout_changes(lines), where, files),
        clean.groupBy(*KEY).agg(F.sum("redactions").alias("redactions"), F.count("*").alias("n_messages")),
        normalize.malformed(normalize.parse(lines), *KEY).select(*KEY, "malformed"),
    ]
    out = meta
    for part in parts:
        out = out.join(part, KEY, "left")
    if index is not None:
        out = correlate.with_lookup(out, index, "session_id")
    else:
        out = out.withColumn("title", F.lit(None).cast("string"))
    return out.withColumn("title", F.coalesce("title", "first_prompt")).withColumn("truncated", F.size("messages") < F.col("n_messages"))


def update_report(lines: DataFrame, summaries: DataFrame, signals: DataFrame | None = None, users: int = 80, agents: int = 10, operations: int = 15, errors: int = 10, files: int = 80) -> DataFrame:
    """One row for each session of the update store. lines: as from sources.logs.update_sessions."""
    rows = normalize.update_rows(lines.filter("log = 'updates'"))
    calls = rows.filter("kind = 'tool_call'").withColumn("name", F.coalesce("title", F.lit("tool")))
    named = windows.named_by_call(rows.filter("kind in ('tool_call', 'tool_update')").withColumn("name", F.when(F.col("kind") == "tool_call", F.coalesce("title", F.lit("tool"))))).filter("kind = 'tool_update'")
    prompts = normalize.chat_prompts(lines.filter("log = 'chat_history'"))
    described = calls.select(*KEY, *ORDER, "name", normalize.describe("name", "input", unknown="json").alias("text"))
    paths = rows.select(*KEY, *ORDER, F.explode("paths").alias("path"))
    parts = [
        section(prompts, "prompts", users, "prompt_index", "text"),
        section(rows.filter("kind = 'agent_chunk' and text is not null"), "agent_messages", agents, "text"),
        section(described, "operations", operations, _handle(), "text"),
        section(named.filter("status = 'failed'"), "errors", errors, _handle(), "name", "text"),
        rollups.distinct_files(paths, files).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x.path).alias("files")),
        rollups.tool_histogram(calls, name="name").groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("tool_counts")),
        rows.groupBy(*KEY).agg(F.count_if(F.col("kind") == "tool_call").alias("n_operations"), F.count_if(F.col("status") == "failed").alias("n_errors")),
    ]
    out = lines.select(*KEY).distinct().join(summaries, "session_id", "left")
    if signals is not None:
        out = out.join(signals, "session_id", "left")
    for part in parts:
        out = out.join(part, KEY, "left")
    return out


def wire_report(lines: DataFrame, states: DataFrame, items: int = 10, operations: int = 15, files: int = 100) -> DataFrame:
    """One row for each session of the wire store. lines: as from sources.logs.wire_sessions."""
    rows = normalize.wire_rows(lines)
    prompts = rows.filter(normalize.is_human_prompt())
    last = rollups.compaction_history(rows).filter("is_last").select(*KEY, F.struct("ts", "tokens_before", "tokens_after", "kept_messages", "summary").alias("last_compaction"))
    parts = [
        windows.time_span(rows),
        section(prompts, "prompts", items, _handle(), "text", "text_one_line"),
        section(rows.filter("kind = 'agent_text'"), "agent_messages", items, _handle(), "text"),
        section(rows.filter("kind = 'tool_call'"), "operations", operations, _handle(), "text"),
        rollups.tool_histogram(rows.filter("kind = 'tool_call'")).groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "n")))).alias("tool_counts")),
        rollups.steer_counts(rows).groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("origin_kind", "n")))).alias("steer_counts")),
        section(rollups.cron_previews(rows).drop("rank"), "cron_previews", 3, "preview"),
        rollups.distinct_files(rows.filter(F.col("path").isNotNull() & F.col("tool_name").isin("Read", "Write", "Edit", "NotebookEdit", "Glob", "Grep")), files).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x.path).alias("files")),
        last,
    ]
    out = lines.select(*KEY).distinct().join(states, "session_id", "left")
    for part in parts:
        out = out.join(part, KEY, "left")
    return out
