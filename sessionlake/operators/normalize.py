"""From raw lines to tables: events, content blocks, messages and tool rows of four log formats.

JSON is parsed once into a VARIANT column `v`; fields are read with try_variant_get, so a value of another
type is null instead of an error. Where a field counts only if it is a JSON string, `text_at` says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

KEY = ["format", "session_id"]
ORDER = ["offset", "seq"]
#: The root types of the main format.
ROOT_TYPES = ["user", "assistant", "progress", "system", "file-history-snapshot", "queue-operation", "summary", "attachment", "custom-title", "ai-title", "last-prompt", "bridge-session", "atis-latch", "mode", "permission-mode", "agent-name", "file-history-delta"]
MARKERS = ["summary", "custom-title", "ai-title", "last-prompt", "bridge-session", "atis-latch", "mode", "permission-mode", "agent-name", "file-history-snapshot", "file-history-delta"]


def get(path: str, kind: str = "string", v: str | Column = "v") -> Column:
    return F.try_variant_get(v, path, kind)


def text_at(path: str, v: str | Column = "v") -> Column:
    """The value at path if it is a JSON string."""
    return F.when(F.schema_of_variant(get(path, "variant", v)) == "STRING", get(path, "string", v))


def said_at() -> Column:
    """A message that is a bare string."""
    return text_at("$.message.content")


def listed_at() -> Column:
    """A message's blocks; null if it isn't an array. Asked before `said_at` where either may hold: what tells a string from other
    values writes out the schema of a whole array."""
    return get("$.message.content", "array<variant>")


def once(column: Column) -> Column:
    """The column as a generator's one row. Spark moves filters below a projection and evaluates its columns there anew for
    each mention, but not below a generator."""
    return F.explode(F.array(column))


def parse(lines: DataFrame) -> DataFrame:
    """Lines with v; null where a line isn't JSON (see `malformed`)."""
    return lines.select("*", once(F.try_parse_json("value")).alias("v"))


def malformed(parsed: DataFrame, *by: str) -> DataFrame:
    return parsed.groupBy(*by).agg(F.count("*").alias("lines"), F.count_if(F.col("v").isNull()).alias("malformed"))


# -- main format -----------------------------------------------------------------------------------


def events(lines: DataFrame) -> DataFrame:
    """Valid events of the main format. A row lives only if its type's required fields are there."""
    e = parse(lines).filter("v is not null")
    # What the conditions below mention often is read once a line.
    head = F.struct(F.coalesce(text_at("$.type"), F.lit("")).alias("type"), text_at("$.uuid").alias("uuid"), text_at("$.sessionId").alias("sid"), text_at("$.timestamp").alias("stamp"), get("$.isSidechain", "boolean").alias("side"))
    own = e.select("*", once(head).alias("head")).select("*", once(T.rfc3339("head.stamp")).alias("at")).withColumn("type", F.col("head.type"))
    ts, sid, side = F.col("at"), F.col("head.sid"), F.col("head.side")
    common = F.col("head.uuid").isNotNull() & sid.isNotNull() & ts.isNotNull() & side.isNotNull()
    said, blocks = said_at(), listed_at()
    listed = blocks.isNotNull()
    valid = (
        F.when(F.col("type") == "user", common & (listed | said.isNotNull()))
        .when(F.col("type") == "assistant", common & listed & reduce(lambda a, b: a & b, (text_at(f"$.message.{k}").isNotNull() for k in ("model", "id", "type", "role"))))
        .when(F.col("type") == "system", sid.isNotNull() & ts.isNotNull() & side.isNotNull())
        .when(F.col("type") == "queue-operation", text_at("$.operation").isNotNull() & sid.isNotNull() & ts.isNotNull())
        .when(F.col("type").isin("progress", "attachment"), common)
        .otherwise(F.lit(True))
    )
    marker = F.col("type").isin(MARKERS)
    out = own.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return out.filter("valid").select(
        *[c for c in e.columns if c not in ("v", "type", "value")],
        "type",
        F.when(F.col("type").isin(ROOT_TYPES), F.col("type")).otherwise("other").alias("root_type"),
        get("$.subtype").alias("subtype"),
        F.when(F.col("type").isin("queue-operation", *MARKERS), F.coalesce("head.uuid", sid)).otherwise(F.col("head.uuid")).alias("uuid"),
        get("$.parentUuid").alias("parent_uuid"),
        get("$.logicalParentUuid").alias("logical_parent_uuid"),
        F.when(~marker, ts).alias("ts"),
        F.coalesce(side, F.lit(False)).alias("is_sidechain"),
        F.coalesce(get("$.isMeta", "boolean"), F.lit(False)).alias("is_meta"),
        F.coalesce(get("$.isCompactSummary", "boolean"), F.lit(False)).alias("is_compact_summary"),
        *(get(f"$.{k}").alias(n) for k, n in (("userType", "user_type"), ("cwd", "cwd"), ("gitBranch", "git_branch"), ("entrypoint", "entrypoint"), ("version", "version"), ("slug", "slug"))),
        get("$.message.model").alias("model"),
        "v",
    )


def content_blocks(events: DataFrame) -> DataFrame:
    """One row for each block of user and assistant messages; a bare string is one text block."""
    text = said_at()
    bare = F.array(F.parse_json(F.to_json(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), text))))
    said = events.filter(F.col("type").isin("user", "assistant"))
    blocks = said.select("*", F.posexplode(F.coalesce(listed_at(), F.when(text.isNotNull(), bare))).alias("seq", "block"))
    b = lambda path, kind="string": get(path, kind, "block")
    s = lambda path: text_at(path, "block")
    return blocks.select(
        *[c for c in events.columns if c != "v"],
        "seq",
        s("$.type").alias("block_type"),
        s("$.text").alias("text"),
        s("$.thinking").alias("thinking"),
        F.coalesce(s("$.id"), s("$.tool_use_id")).alias("tool_use_id"),
        s("$.name").alias("tool_name"),
        b("$.input", "variant").alias("input"),
        tool_result_text(b("$.content", "variant")).alias("result_text"),
        b("$.is_error", "boolean").alias("is_error"),
        get("$.toolUseResult", "variant").alias("outcome"),
    )


def tool_result_text(content: Column) -> Column:
    """A string, or the first text in an array."""
    items = F.try_variant_get(content, "$", "array<variant>")
    first = F.filter(F.transform(items, lambda x: text_at("$.text", x)), lambda x: x.isNotNull())
    return F.coalesce(F.get(first, 0), text_at("$", content))


def tool_outcomes(blocks: DataFrame) -> DataFrame:
    """Typed results of tools: outcome_type, file_path, text, hunks. An unknown shape is null, not an error."""
    o = lambda path, kind="string": get(path, kind, "outcome")
    kind = F.coalesce(text_at("$.type", "outcome"), F.when(o("$.error").isNotNull(), F.lit("error")), F.when(text_at("$", "outcome").isNotNull(), F.lit("error")))
    hunk = lambda h: F.struct(*(F.try_variant_get(h, f"$.{k}", "bigint").alias(n) for k, n in (("oldStart", "old_start"), ("oldLines", "old_lines"), ("newStart", "new_start"), ("newLines", "new_lines"))))
    return blocks.filter("block_type = 'tool_result' and outcome is not null").select(
        *KEY, *ORDER, "tool_use_id",
        F.when(kind.isin("text", "create", "update", "delete", "read", "error", "image"), kind).alias("outcome_type"),
        F.coalesce(o("$.filePath"), o("$.file.filePath")).alias("file_path"),
        F.coalesce(o("$.content"), o("$.file.content"), o("$.stdout"), o("$.error"), text_at("$", "outcome")).alias("text"),
        F.transform(o("$.structuredPatch", "array<variant>"), hunk).alias("hunks"),
    )


def attachments(events: DataFrame) -> DataFrame:
    """Typed attachments: prompt and command mode of queued commands, hook results, reminders, files."""
    a = lambda path, kind="string": get(f"$.attachment.{path}", kind)
    todo = lambda t: F.struct(F.try_variant_get(t, "$.status", "string").alias("status"), F.try_variant_get(t, "$.content", "string").alias("content"))
    return events.filter("type = 'attachment'").select(
        *[c for c in events.columns if c != "v"],
        F.lit(0).alias("seq"),
        text_at("$.attachment.type").alias("attachment_type"),
        text_at("$.attachment.prompt").alias("prompt"),
        a("commandMode").alias("command_mode"),
        F.coalesce(T.rfc3339(a("timestamp")), F.col("ts")).alias("delivered_at"),
        F.coalesce(a("isMeta", "boolean"), F.lit(False)).alias("attachment_is_meta"),
        *origin("$.attachment.origin"),
        F.coalesce(a("hookName"), a("hookEvent")).alias("hook"),
        F.coalesce(a("content"), a("stdout"), a("stderr"), a("snippet")).alias("text"),
        F.coalesce(a("filename"), a("filePath")).alias("attached_path"),
        a("agentId").alias("attached_agent_id"),
        F.transform(a("todos", "array<variant>"), todo).alias("todos"),
    )


def origin(path: str) -> list[Column]:
    return [get(path, "variant").isNotNull().alias("has_origin"), get(f"{path}.kind").alias("origin_kind"), F.coalesce(get(f"{path}.name"), get(f"{path}.from")).alias("origin_sender"), get(f"{path}.body").alias("origin_body"), F.coalesce(get(f"{path}.handback", "boolean"), F.lit(False)).alias("origin_handback")]


def progress(events: DataFrame) -> DataFrame:
    """Facts of progress events: kind, elapsed seconds, lines, agent, prompt, query, links to the tool call."""
    d = lambda path, kind="string": get(f"$.data.{path}", kind)
    return events.filter("type = 'progress'").select(
        *KEY, "offset", "ts", "uuid",
        text_at("$.data.type").alias("progress_type"),
        d("elapsedTimeSeconds", "double").alias("elapsed_seconds"), d("totalLines", "bigint").alias("total_lines"),
        d("agentId").alias("agent_id"), d("prompt").alias("prompt"), d("query").alias("query"),
        F.coalesce(d("fullOutput"), d("output")).alias("output"),
        get("$.toolUseID").alias("tool_use_id"), get("$.parentToolUseID").alias("parent_tool_use_id"),
    )


def replayed_messages(events: DataFrame) -> DataFrame:
    """Conversations replayed inside progress events: each message once, since every event repeats the history."""
    each = events.filter("type = 'progress'").select(*KEY, "offset", F.posexplode(get("$.data.normalizedMessages", "array<variant>")).alias("seq", "m"))
    named = each.select(*KEY, *ORDER, F.try_variant_get("m", "$.uuid", "string").alias("uuid"), F.try_variant_get("m", "$.type", "string").alias("type"), F.col("m").alias("v"))
    first = named.groupBy(*KEY, "uuid").agg(F.min_by(F.struct("offset", "seq", "type", F.to_json("v").alias("json")), F.struct("offset", "seq")).alias("f"))
    return first.select(*KEY, "uuid", "f.offset", "f.seq", "f.type", F.try_parse_json("f.json").alias("v"))


def file_backups(events: DataFrame) -> DataFrame:
    """Tracked files of snapshots and deltas: path and backup name."""
    whole = events.filter("type = 'file-history-snapshot'").select(*KEY, "offset", F.explode(get("$.snapshot.trackedFileBackups", "map<string,variant>")).alias("path", "b"))
    delta = events.filter("type = 'file-history-delta'").select(*KEY, "offset", get("$.trackingPath").alias("path"), get("$.backupFileName").alias("backup"))
    return whole.select(*KEY, "offset", "path", F.coalesce(text_at("$", "b"), F.try_variant_get("b", "$.backupFileName", "string")).alias("backup")).unionByName(delta)


def queue_operations(events: DataFrame) -> DataFrame:
    return events.filter("type = 'queue-operation'").select(*KEY, "offset", F.lit(0).alias("seq"), "ts", text_at("$.operation").alias("operation"), text_at("$.content").alias("content"), text_at("$.reason").alias("reason"))


def system_rows(events: DataFrame) -> DataFrame:
    """System events: compact boundaries with their token counts, errors, level and content."""
    m = lambda k: F.coalesce(get(f"$.compactMetadata.{k}", "bigint"), get(f"$.microcompactMetadata.{k}", "bigint"))
    error = F.concat_ws(": ", get("$.error.type"), get("$.error.message"))
    return events.filter("type = 'system'").select(
        *KEY, "offset", F.lit(0).alias("seq"), "ts", "uuid", "subtype",
        F.coalesce(F.col("subtype") == "compact_boundary", F.lit(False)).alias("is_boundary"),
        F.coalesce((F.col("subtype") == "error") | get("$.error", "variant").isNotNull(), F.lit(False)).alias("is_error"),
        F.coalesce(get("$.compactMetadata.trigger"), get("$.microcompactMetadata.trigger")).alias("trigger"),
        m("preTokens").alias("pre_tokens"), m("postTokens").alias("post_tokens"),
        get("$.level").alias("level"), text_at("$.content").alias("content"),
        F.coalesce(F.nullif(error, F.lit("")), text_at("$.content"), F.lit("system error")).alias("error_text"),
    )


def assistant_turns(events: DataFrame) -> DataFrame:
    u = lambda k: get(f"$.message.usage.{k}", "bigint")
    usage = F.struct(*(u(k).alias(n) for k, n in (("input_tokens", "input"), ("output_tokens", "output"), ("cache_creation_input_tokens", "cache_write"), ("cache_read_input_tokens", "cache_read"))))
    return events.filter("type = 'assistant'").select(*KEY, "offset", "ts", "is_sidechain", "model", text_at("$.message.id").alias("message_id"), get("$.requestId").alias("request_id"), get("$.message.stop_reason").alias("stop_reason"), usage.alias("usage"))


def event_tags(events: DataFrame) -> DataFrame:
    """Index tags of each event: type, subtype, model, tools, progress and attachment kind."""
    blocks = F.transform(get("$.message.content", "array<variant>"), lambda b: F.when(text_at("$.type", b) == "tool_use", text_at("$.name", b)).when(text_at("$.type", b) == "tool_result", F.lit("tool_result")).otherwise(text_at("$.type", b)))
    said = F.when(text_at("$.message.content").isNotNull(), F.array(F.lit("text"))).otherwise(blocks)
    once = F.concat(F.when(F.array_contains(said, "text"), F.array(F.lit("text"))).otherwise(F.array()), F.filter(said, lambda x: x != "text"))
    one = lambda c: F.array(c)
    tags = F.concat(one(F.col("type")), one(F.col("subtype")), one(F.col("model")), F.coalesce(once, F.array()), one(text_at("$.data.type")), one(text_at("$.attachment.type")), one(F.when(F.col("is_sidechain"), F.lit("sidechain"))))
    return events.select(*KEY, "offset", F.array_compact(tags).alias("tags"))


def event_text(events: DataFrame) -> DataFrame:
    """Readable text of each event: joined text blocks, an agent's prompt, a shell's output, a system's content."""
    blocks = F.array_join(F.filter(F.transform(get("$.message.content", "array<variant>"), lambda b: F.when(text_at("$.type", b) == "text", text_at("$.text", b))), lambda x: x.isNotNull()), "\n")
    text = F.when(F.col("type").isin("user", "assistant"), F.coalesce(text_at("$.message.content"), blocks)).when(F.col("type") == "progress", F.coalesce(get("$.data.prompt"), get("$.data.fullOutput"))).when(F.col("type") == "system", text_at("$.content"))
    return events.select(*KEY, "offset", F.nullif(text, F.lit("")).alias("text")).filter("text is not null")


def event_files(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Files an event names: a tool's outcome, the inputs of Read, Write and Edit, snapshots."""
    written = F.when(F.col("tool_name").isin("Read", "Write", "Edit", "MultiEdit", "NotebookEdit"), F.coalesce(get("$.file_path", v="input"), get("$.notebook_path", v="input")))
    result = F.when(F.col("block_type") == "tool_result", F.coalesce(get("$.filePath", v="outcome"), get("$.file.filePath", v="outcome"), get("$.file_path", v=F.try_parse_json("result_text"))))
    named = blocks.select(*KEY, "offset", F.explode(F.array_compact(F.array(written, result))).alias("path"))
    return named.unionByName(file_backups(events).select(*KEY, "offset", "path")).filter("path is not null").distinct()


def event_tools(blocks: DataFrame) -> DataFrame:
    name = F.when(F.col("block_type") == "tool_use", F.col("tool_name")).when(F.col("block_type") == "tool_result", F.concat(F.lit("tool_result:"), "tool_use_id"))
    return blocks.select(*KEY, *ORDER, name.alias("tool")).filter("tool is not null")


# -- tool call descriptions ------------------------------------------------------------------------

#: The arguments that describe a call, most telling first.
ARGUMENTS = ["command", "cmd", "url", "query", "path", "file_path", "pattern", "script"]


def describe(name: str | Column, arguments: str | Column, unknown: str = "name", keys: list[str] = ARGUMENTS) -> Column:
    """`name: first line of the key argument`; unknown arguments give the bare name, their JSON or the raw string."""
    name = F.col(name) if isinstance(name, str) else name
    v = F.col(arguments) if isinstance(arguments, str) else arguments
    found = F.coalesce(*(text_at(f"$.{k}", v) for k in keys))
    if unknown == "json":
        found = F.coalesce(found, F.to_json(v))
    detail = T.first_line(found)
    return F.when(detail.isNull() | (detail == ""), name).otherwise(F.concat(name, F.lit(": "), detail))


# -- rollout format --------------------------------------------------------------------------------


def nested_text(v: Column, depth: int = 3) -> Column:
    """Text of a string, of an object (its content, else its text) or of an array, to a bounded depth."""
    plain = text_at("$", v)
    if depth == 0:
        return plain
    inner = F.coalesce(nested_text(F.try_variant_get(v, "$.content", "variant"), depth - 1), text_at("$.text", v))
    items = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: nested_text(x, depth - 1)), lambda x: x.isNotNull())
    return F.coalesce(plain, F.nullif(F.array_join(items, "\n"), F.lit("")), inner)


def rollout_rows(lines: DataFrame) -> DataFrame:
    """Long-form rows of rollout logs: role (user, assistant, tool_call, tool, error), text, name, call_id."""
    p = lambda k, kind="string": get(f"$.payload.{k}", kind)
    kind = F.concat_ws("/", text_at("$.type"), text_at("$.payload.type"))
    role = text_at("$.payload.role")
    parts = lambda want: F.array_join(F.filter(F.transform(p("content", "array<variant>"), lambda x: F.when(text_at("$.type", x) == want, text_at("$.text", x))), lambda x: x.isNotNull()), "\n")
    item = lambda path: F.coalesce(text_at(f"{path}.message"), nested_text(get(f"{path}.content", "variant"), 2), text_at(f"{path}.text"))
    inner = text_at("$.payload.item.type")
    raw = F.coalesce(text_at("$.payload.arguments"), text_at("$.payload.input"))
    parsed = F.try_parse_json(raw)
    detail = F.coalesce(*(text_at(f"$.{k}", parsed) for k in ARGUMENTS), raw)
    calls, outputs = ["response_item/function_call", "response_item/custom_tool_call"], ["response_item/function_call_output", "response_item/custom_tool_call_output"]
    text = (
        F.when(kind.isin("event_msg/user_message", "event_msg/agent_message"), text_at("$.payload.message"))
        .when(kind == "event_msg/item_completed", item("$.payload.item"))
        .when(kind == "event_msg/task_complete", text_at("$.payload.error.message"))
        .when((kind == "response_item/message") & role.isin("user", "assistant"), parts(F.when(role == "user", "input_text").otherwise("output_text")))
        .when(kind == "response_item/agent_message", item("$.payload"))
        .when(kind.isin(calls), detail)
        .when(kind.isin(outputs), nested_text(p("output", "variant")))
    )
    who = (
        F.when(kind.isin("event_msg/user_message") | (kind == "event_msg/item_completed") & (inner == "user_message"), "user")
        .when(kind.isin("event_msg/agent_message", "response_item/agent_message") | (kind == "event_msg/item_completed") & (inner == "agent_message"), "assistant")
        .when(kind == "event_msg/task_complete", "error")
        .when(kind == "response_item/message", role)
        .when(kind.isin(calls), "tool_call")
        .when(kind.isin(outputs), "tool")
    )
    rows = parse(lines).filter("v is not null").select(*KEY, "offset", F.lit(0).alias("seq"), T.truncate_chars(F.trim(text_at("$.timestamp")), 128).alias("ts_raw"), who.alias("role"), text.alias("text"), F.when(kind.isin(calls), text_at("$.payload.name")).alias("name"), p("call_id").alias("call_id"))
    return rows.filter("role in ('user', 'assistant', 'tool_call', 'tool', 'error') and text is not null")


def rollout_meta(lines: DataFrame) -> DataFrame:
    """session_id, cwd, provider, branch, commit and repository of each rollout's first record; its id must be the file's."""
    m = parse(lines.filter("offset = 0")).filter(text_at("$.type") == "session_meta")
    commit = text_at("$.payload.git.commit_hash")
    return m.filter(text_at("$.payload.id") == F.col("session_id")).select(*KEY, text_at("$.payload.cwd").alias("cwd"), T.safe_scalar(text_at("$.payload.model_provider"), 128).alias("provider"), T.safe_scalar(text_at("$.payload.git.branch"), 256).alias("branch"), F.when(T.is_commit_hash(commit), commit).alias("commit"), T.repository_label(text_at("$.payload.git.repository_url")).alias("repository"))


def rollout_context(lines: DataFrame) -> DataFrame:
    """The latest working directory and model of turn contexts."""
    t = parse(lines).filter(text_at("$.type") == "turn_context").select(*KEY, "offset", text_at("$.payload.cwd").alias("cwd"), text_at("$.payload.model").alias("model"))
    return t.groupBy(*KEY).agg(*(F.expr(f"max_by({c}, offset) filter (where {c} is not null)").alias(c) for c in ("cwd", "model")))


def rollout_changes(lines: DataFrame) -> DataFrame:
    """Paths of applied patches as they stand in the log."""
    patch = parse(lines).filter((text_at("$.type") == "patch_apply_end") | (text_at("$.payload.type") == "patch_apply_end"))
    return patch.select(*KEY, "offset", F.explode(F.map_keys(get("$.payload.changes", "map<string,variant>"))).alias("path"))


# -- update format ---------------------------------------------------------------------------------


def update_rows(lines: DataFrame) -> DataFrame:
    """Long-form rows of update logs: tool_call, tool_update (completed or failed) and agent_chunk."""
    u = lambda k, kind="string": get(f"$.params.update.{k}", kind)
    kind = text_at("$.params.update.sessionUpdate")
    status = u("status")
    raw = u("rawOutput", "map<string,variant>")
    values = F.transform(F.array_sort(F.map_keys(raw)), lambda k: F.coalesce(text_at("$", F.element_at(raw, k)), F.get(F.filter(F.transform(F.array_sort(F.map_keys(F.try_variant_get(F.element_at(raw, k), "$", "map<string,variant>"))), lambda j: text_at("$", F.element_at(F.try_variant_get(F.element_at(raw, k), "$", "map<string,variant>"), j))), lambda x: x != ""), 0)))
    output = F.coalesce(nested_text(u("content", "variant")), F.get(F.filter(values, lambda x: x.isNotNull() & (x != "")), 0))
    rows = parse(lines).filter("v is not null").select(
        *KEY, "offset", F.lit(0).alias("seq"),
        F.when(kind == "tool_call", "tool_call").when((kind == "tool_call_update") & status.isin("completed", "failed"), "tool_update").when(kind == "agent_message_chunk", "agent_chunk").alias("kind"),
        u("toolCallId").alias("call_id"), u("title").alias("title"), status.alias("status"), u("rawInput", "variant").alias("input"),
        F.when(kind == "agent_message_chunk", nested_text(u("content", "variant"))).otherwise(output).alias("text"),
        F.filter(F.transform(u("locations", "array<variant>"), lambda x: F.try_variant_get(x, "$.path", "string")), lambda x: x.isNotNull()).alias("paths"),
    )
    return rows.filter("kind is not null")


def chat_prompts(lines: DataFrame) -> DataFrame:
    """User prompts of a chat log; those with a synthetic reason are no prompts. prompt_index defaults to the ordinal."""
    from pyspark.sql.window import Window

    text = F.coalesce(text_at("$.content"), F.array_join(F.filter(F.transform(get("$.content", "array<variant>"), lambda x: F.coalesce(text_at("$", x), text_at("$.text", x))), lambda x: x.isNotNull()), " "), text_at("$.content.text"))
    users = parse(lines).filter(text_at("$.type") == "user").filter(text_at("$.synthetic_reason").isNull()).select(*KEY, "offset", F.lit(0).alias("seq"), get("$.prompt_index", "bigint").alias("prompt_index"), text.alias("text"))
    ordinal = F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER)) - 1
    return users.withColumn("prompt_index", F.coalesce("prompt_index", ordinal.cast("bigint")))


# -- wire format -----------------------------------------------------------------------------------


def wire_rows(lines: DataFrame) -> DataFrame:
    """Long-form rows of wire logs: prompt, steer, agent_text, tool_call, compaction. Lines under 10 bytes are skipped."""
    kind, event = text_at("$.type"), text_at("$.event.type")
    said = F.array_join(F.filter(F.transform(get("$.input", "array<variant>"), lambda x: F.when(text_at("$.type", x) == "text", text_at("$.text", x))), lambda x: x.isNotNull()), "\n")
    name = F.when(kind == "turn.prompt", "prompt").when(kind == "turn.steer", "steer").when((event == "content.part") & (text_at("$.event.part.type") == "text"), "agent_text").when(event == "tool.call", "tool_call").when(kind.contains("apply_compaction"), "compaction")
    text = F.when(kind.isin("turn.prompt", "turn.steer"), F.coalesce(text_at("$.input"), said)).when(event == "content.part", text_at("$.event.part.text")).when(event == "tool.call", describe(text_at("$.event.name"), get("$.event.args", "variant"))).otherwise(get("$.summary"))
    rows = parse(lines.filter("nbytes >= 10")).filter("v is not null").select(
        *KEY, "offset", F.lit(0).alias("seq"), T.millis(get("$.time", "bigint")).alias("ts"), name.alias("kind"),
        F.coalesce(get("$.origin.kind"), F.lit("?")).alias("origin_kind"), text.alias("text"), text_at("$.event.name").alias("tool_name"),
        F.coalesce(*(text_at(f"$.event.args.{k}") for k in ("path", "file_path", "notebook_path"))).alias("path"),
        get("$.tokensBefore", "bigint").alias("tokens_before"), get("$.tokensAfter", "bigint").alias("tokens_after"), get("$.keptUserMessageCount", "bigint").alias("kept_messages"),
    )
    return rows.filter("kind is not null").withColumn("text_one_line", T.single_line("text"))


def is_human_prompt() -> Column:
    """A wire row that the human typed."""
    return (F.col("kind") == "prompt") & (F.col("origin_kind") == "user")


def is_context_relevant() -> Column:
    """Events worth a reader's context: what was said, boundaries and errors."""
    return F.col("type").isin("user", "assistant", "summary") | (F.col("type") == "system") & F.coalesce(F.col("subtype").isin("compact_boundary", "error"), F.lit(False))


def is_external() -> Column:
    """User events that came from outside the agent."""
    return (F.col("type") == "user") & F.coalesce(F.col("user_type") == "external", F.lit(False))
