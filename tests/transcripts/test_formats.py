"""Golden cases of the four formats: lines in, rows out."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import classify, correlate, normalize, redact, rollups, search, windows
from sessionlake.plans import digest
from sessionlake.sources import logs

LINE = "format string, session_id string, offset bigint, nbytes bigint, file_size bigint, file_path string, modified_at timestamp, value string"


def lines(spark, rows, fmt="main", session="s"):
    """rows: dicts (or raw strings) at offsets 0, 100, 200, ..."""
    from datetime import datetime

    values = [r if isinstance(r, str) else json.dumps(r) for r in rows]
    return spark.createDataFrame([(fmt, session, i * 100, len(v.encode()), 1 << 20, f"/{session}.jsonl", datetime(2026, 1, 1), v) for i, v in enumerate(values)], LINE)


def event(kind, i=0, **more):
    return {"type": kind, "uuid": f"u{i}", "sessionId": "s", "timestamp": f"2026-01-01T00:00:{i:02d}Z", "isSidechain": False, **more}


def user(content, i=0, **more):
    return event("user", i, message={"role": "user", "content": content}, **more)


def agent(blocks, i=0, **more):
    blocks = [{"type": "text", "text": blocks}] if isinstance(blocks, str) else blocks
    return event("assistant", i, message={"model": "x-opus-4", "id": "m", "type": "message", "role": "assistant", "content": blocks, "usage": {"input_tokens": 7}}, **more)


def call(name, id_, **args):
    return {"type": "tool_use", "id": id_, "name": name, "input": args}


def result(id_, content):
    return {"type": "tool_result", "tool_use_id": id_, "content": content}


def test_rows_live_only_with_their_required_fields(spark):
    no_uuid = user("x")
    del no_uuid["uuid"]
    no_model = agent("x")
    del no_model["message"]["model"]
    bare = agent("x")
    bare["message"]["content"] = "bare"
    rows = [user("hi", parentUuid="p", gitBranch="b"), no_uuid, no_model, bare, "not json", {"type": "custom-title", "sessionId": "s", "customTitle": "T"}, {"type": "brand-new"}, event("queue-operation", operation="enqueue", content="q")]
    found = {r.offset: r for r in normalize.events(lines(spark, rows)).collect()}
    assert sorted(found) == [0, 500, 600, 700]
    assert (found[0].parent_uuid, found[0].git_branch, found[500].uuid, found[500].ts, found[600].root_type, found[700].uuid) == ("p", "b", "s", None, "other", "u0")
    assert normalize.malformed(normalize.parse(lines(spark, rows)), "session_id").first().malformed == 1
    assert [(r.type, r.n) for r in rollups.unknown_types(normalize.events(lines(spark, rows))).collect()] == [("brand-new", 1)]


def test_blocks_and_outcomes(spark):
    rows = [
        user("plain"),
        agent([{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "say"}, call("Write", "t1", file_path="a\\b.py", content="x"), call("Read", "t2", file_path="c")]),
        user([result("t1", [{"type": "image"}, {"type": "text", "text": "ok"}]), {"type": "text", "text": "and"}], toolUseResult={"type": "create", "filePath": "a/b.py", "content": "x", "structuredPatch": [{"oldStart": 1, "oldLines": 2, "newStart": 3, "newLines": 4}]}),
        user([result("t2", "text")], toolUseResult=5),
    ]
    ev = normalize.events(lines(spark, rows))
    blocks = normalize.content_blocks(ev).cache()
    got = [(r.offset, r.seq, r.block_type, r.text or r.thinking or r.result_text, r.tool_use_id) for r in blocks.orderBy("offset", "seq").collect()]
    assert got == [(0, 0, "text", "plain", None), (100, 0, "thinking", "hm", None), (100, 1, "text", "say", None), (100, 2, "tool_use", None, "t1"), (100, 3, "tool_use", None, "t2"), (200, 0, "tool_result", "ok", "t1"), (200, 1, "text", "and", None), (300, 0, "tool_result", "text", "t2")]
    o = {r.offset: r for r in normalize.tool_outcomes(blocks).collect()}
    assert (o[200].outcome_type, o[200].file_path, [tuple(h) for h in o[200].hunks]) == ("create", "a/b.py", [(1, 2, 3, 4)]) and o[300].outcome_type is None
    assert [(r.path, r.n) for r in rollups.file_touches(blocks).collect()] == [("a/b.py", 1)]
    assert {r.path for r in normalize.event_files(ev, blocks).collect()} == {"a\\b.py", "a/b.py", "c"}
    assert {r.tool for r in normalize.event_tools(blocks).collect()} == {"Write", "Read", "tool_result:t1", "tool_result:t2"}
    tags = {r.offset: r.tags for r in normalize.event_tags(ev).collect()}
    assert tags[0] == ["user", "text"] and tags[100] == ["assistant", "x-opus-4", "text", "thinking", "Write", "Read"]
    assert {r.offset: r.text for r in normalize.event_text(ev).collect()} == {0: "plain", 100: "say", 200: "and"}
    assert normalize.assistant_turns(ev).first().usage.input == 7
    shown = search.show_records(ev, blocks, spark.createDataFrame([("main", "s", 100)], "format string, session_id string, offset bigint"))
    assert [r.label for r in shown.orderBy("seq").collect()] == ["thinking", "text", "tool_use:Write", "tool_use:Read"]


PEER = '<cross-session-message from="a" name="Bob">hello</cross-session-message>'


INCOMING = [
    (user(" placeholder "), "owner", "placeholder", None, False),
    (user("x", origin={"kind": "human"}), "owner", "x", None, False),
    (user("<system-reminder>r</system-reminder>", origin={"kind": "human"}), "harness", None, None, False),
    (user("x", isCompactSummary=True, origin={"kind": "human"}), "compact_summary", "x", None, False),
    (user("<task-notification>t</task-notification>", origin={"kind": "task-notification"}), "task_notification", "<task-notification>t</task-notification>", None, False),
    (user(PEER, origin={"kind": "peer", "from": "z", "body": " clean ", "handback": True}), "peer", "clean", "z", True),
    (user(PEER, origin={"kind": "peer"}), "peer", "hello", None, False),
    (user("x", origin={"kind": "coordinator"}), "harness", None, None, False),
    (user("x", isMeta=True), "harness", None, None, False),
    (user("<command-name>/go</command-name><command-args> a b </command-args>"), "owner_command", "/go a b", None, False),
    (user("<command-name>/go</command-name><command-args></command-args>"), "owner_command", "/go", None, False),
    (user("<local-command-stdout>x"), "harness", None, None, False),
    (user("[Request interrupted by user for tool use]"), "interrupt", "[Request interrupted by user for tool use]", None, False),
    (user("<system-reminder>r</system-reminder> rest "), "owner", "rest", None, False),
    (user("<system-reminder>r</system-reminder>" + PEER), "peer", "hello", "Bob", False),
    (user("<system-reminder>open"), "harness", None, None, False),
    (user("<task-notification>t"), "task_notification", "<task-notification>t", None, False),
    (user('<agent-message from="w">done</agent-message>'), "peer", "done", "w", True),
    (user('<cross-session-message from="w">[Subagent hand-back] x</cross-session-message>'), "peer", "[Subagent hand-back] x", "w", True),
    (user('see <pasted_content id="1">P</pasted_content>'), "owner", "see [pasted] P", None, False),
    (event("attachment", attachment={"type": "queued_command", "prompt": "mid"}), "owner_mid_turn", "mid", None, False),
    (event("attachment", attachment={"type": "queued_command", "prompt": "n", "commandMode": "task-notification"}), "task_notification", "n", None, False),
    (event("attachment", attachment={"type": "queued_command", "prompt": "x", "origin": {"kind": "task-notification"}}), "harness", None, None, False),
]


def test_incoming_kinds(spark):
    ev = normalize.events(lines(spark, [c[0] for c in INCOMING]))
    found = {r.offset // 100: r for r in classify.incoming(ev, normalize.attachments(ev)).collect()}
    assert len(found) == len(INCOMING)
    for i, (row, kind, text, sender, handback) in enumerate(INCOMING):
        r = found[i]
        assert (r.kind, r.sender, r.handback) == (kind, sender, handback), row
        assert text is None or r.text == text, row


def _facts(spark, rows):
    t = digest.normalized(lines(spark, rows))
    return t, correlate.correlated(correlate.launches(t["blocks"]), correlate.results(t["blocks"]), correlate.notifications(t["incoming"].filter("kind = 'task_notification'")))


def test_delegations_and_tasks(spark):
    note = lambda id_, status, more="": user(f"<task-notification><tool-use-id>{id_}</tool-use-id><status>{status}</status>{more}</task-notification>", 9)
    launch = agent([call("Agent", "toolu_0123456789abcdef", description="d", subagent_type="x", run_in_background=True)], 1)
    rows = [
        launch, launch,
        user([result("toolu_0123456789abcdef", "started")], 2, toolUseResult={"agentId": "ag1"}),
        agent([call("Task", "t2", prompt="p")], 3), user([result("t2", "answer")], 4),
        agent([call("Bash", "t3", command="sleep", run_in_background=True)], 5), user([result("t3", "Command running in background with ID: bxyz1. Output")], 6),
        agent([call("Bash", "t4", command="make", run_in_background=True)], 5), user([result("t4", "background with ID: b2")], 6), note("t4", "error"),
        agent([call("Agent", "t5", run_in_background=True)], 7, isSidechain=True),
        agent([call("Agent", "t6", run_in_background=True)], 7), note("toolu_0123456789abcdef", "completed", "<result>fine</result>"),
    ]
    t, facts = _facts(spark, rows)
    d = {r.tool_use_id: r for r in correlate.delegations(facts).collect()}
    assert {k: (r.status, r.excerpt, r.short_id) for k, r in d.items()} == {"toolu_0123456789abcdef": ("completed", "fine", "ag1"), "t2": ("completed", "answer", "t2"), "t6": ("launched", None, "t6")}
    b = {r.tool_use_id: (r.status, r.task_id) for r in correlate.background_tasks(facts).collect()}
    assert b == {"t3": ("running", "bxyz1"), "t4": ("failed", "b2")}
    total = correlate.background_totals(correlate.background_tasks(facts)).first()
    assert (total.launched, total.still_running) == (2, ["bxyz1"])
    meta = spark.createDataFrame([("s", "ag1", "explore", "better")], "session_id string, agent_id string, agent_type string, description string")
    assert {(r.agent_type, r.description) for r in correlate.delegations(facts, meta).filter("agent_id = 'ag1'").collect()} == {("explore", "better")}
    assert correlate.delegations(facts).filter(correlate.matches_id("ag")).count() == 1 and correlate.delegations(facts).filter(correlate.matches_id("t6")).count() == 1


def test_commits(spark):
    rows = [agent([call("Bash", "c1", command="git -C /r commit -m x")]), user([result("c1", "[main abc1234] Subject\n[main def5678] Other")]), user([result("c1", "[main 9999999] late")]), agent([call("Bash", "c2", command="git commit -m y")]), user([result("c2", [{"type": "text", "text": "[b 0123456] S"}])]), agent([call("Bash", "c3", command="git log")]), user([result("c3", "[x 0123456] no")])]
    blocks = normalize.content_blocks(normalize.events(lines(spark, rows)))
    cwd = spark.createDataFrame([("main", "s", "/w")], "format string, session_id string, cwd string")
    found = [(r.handle, r.repo, r.branch, r.hash, r.subject) for r in correlate.commits(blocks, cwd).orderBy("offset", "seq").collect()]
    assert found == [("@o0", "/r", "main", "abc1234", "Subject"), ("@o0", "/r", "main", "def5678", "Other"), ("@o300", "/w", "b", "0123456", "S")]


def test_queue(spark):
    q = lambda op, text=None, i=0: event("queue-operation", i, operation=op, **({"content": text} if text else {}))
    rows = [q("enqueue", "delivered later"), q("dequeue"), user("delivered   later"), q("enqueue", "removed"), q("remove", "removed"), q("enqueue", "stuck"), q("enqueue", PEER), q("enqueue", "<task-notification>x</task-notification>"), q("enqueue", "by attachment"), event("attachment", attachment={"type": "queued_command", "prompt": "by attachment"})]
    d = digest.digest(lines(spark, rows)).first()
    assert [(s.handle, s.text) for s in d.stuck] == [("@o500", "stuck")] and d.other_leftover_count == 2


def test_digest(spark):
    boundary = event("system", 5, subtype="compact_boundary", compactMetadata={"trigger": "auto", "preTokens": 9})
    rows = [
        {"type": "custom-title", "sessionId": "s", "customTitle": "Head title"}, user("before", 1, cwd="/old"), boundary, boundary | {"timestamp": "2026-01-01T00:00:05Z"},
        user("summary text", 6, isCompactSummary=True), user("after", 7, cwd="/new"), agent([{"type": "text", "text": "report"}, call("TodoWrite", "w", todos=[{"status": "open", "content": f"t{i}"} for i in range(25)]), call("Edit", "e", file_path="src/a.py")], 8),
        event("system", 9, subtype="error", error={"type": "api", "message": "boom"}), agent([call("TaskUpdate", "w2", id="1")], 9), {"type": "last-prompt", "sessionId": "s", "lastPrompt": "LP"}, user("fix(core) open question", 10),
    ]
    d = digest.digest(lines(spark, rows), tail=1 << 30).first()
    assert (d.topic, d.topic_source, d.compaction_count, d.cwd, d.unanswered) == ("Head title", "custom_title", 1, "/new", True)
    assert [m.text for m in d.owner_messages] == ["after", "fix(core) open question"] and [p.text for p in d.first_prompts] == ["before", "after", "fix(core) open question"]
    assert [r.text for r in d.reports] == ["report"] and [e.text for e in d.errors] == ["api: boom"] and d.compaction_summary.excerpt == "summary text"
    assert d.open_work.tool_name == "TaskUpdate" and d.open_work.raw_input == '{"id":"1"}' and d.hints == ["core"]
    assert [(f.path, f.n) for f in d.files] == [("src/a.py", 1)] and str(d.first_event_time) == "2026-01-01 00:00:01" and d.size_bytes == 1 << 20
    head = digest.digest(lines(spark, rows), tail=1 << 19).first()  # every marker lies before the tail; a first prompt ranks below
    assert head.topic_source == "custom_title"
    todo = rollups.open_work(normalize.content_blocks(normalize.events(lines(spark, rows[:7])))).first()
    assert len(todo.todos) == 20 and todo.todos_omitted == 5
    (s,) = digest.session_list(lines(spark, rows), 5, tail=1 << 30).collect()
    assert (s.topic, s.last_message_handle, s.warning) == ("Head title", "@o1000", "last message unanswered")


def test_digest_sections_are_cut_at_the_boundary_and_at_their_caps(spark):
    boundary = event("system", 5, subtype="compact_boundary")
    some = [agent([call("Write", f"w{i}", file_path=f"f{i:02d}.py", content="x"), call("Edit", f"e{i}", file_path="same.py"), {"type": "text", "text": f"said v5/h{i:02d}"}], i) for i in range(25)]
    rows = [user(f"old {i}", i) for i in range(10)] + [agent("fix(gone)", i) for i in range(2)] + [boundary] + some + [user(f"new {i}", i) for i in range(4)]
    d = digest.digest(lines(spark, rows)).first()
    assert [m.text for m in d.owner_messages] == [f"new {i}" for i in range(4)] and [m.text for m in d.first_prompts] == ["old 0", "old 1", "old 2"]
    assert [r.text for r in d.reports] == [f"said v5/h{i:02d}" for i in range(20, 25)] and len(d.operations) == 10
    assert len(d.files) == 20 and ("same.py", 25) in {(f.path, f.n) for f in d.files} and d.hints == [f"v5/h{i:02d}" for i in range(20)]
    assert d.unanswered and d.stuck is None and d.other_leftover_count is None and d.subagent_count is None
    old = digest.digest(lines(spark, rows + [boundary])).first()
    assert old.owner_messages is None and old.files is None and old.hints is None and old.unanswered is None and len(old.first_prompts) == 3


def test_results_do_not_depend_on_the_order_of_rows(spark):
    rows = [user(f"q{i}", i) if i % 3 == 0 else agent(f"a{i}", i) for i in range(30)]
    whole = lines(spark, rows)
    shuffled = spark.createDataFrame(random.Random(1).sample(whole.collect(), 30), whole.schema).repartition(5)
    a, b = digest.digest(whole).first(), digest.digest(shuffled).first()
    assert a == b


def test_progress_and_backups(spark):
    m = [{"uuid": "a", "type": "user"}, {"uuid": "b", "type": "assistant"}]
    rows = [event("progress", data={"type": "agent_progress", "agentId": "q", "prompt": "p", "normalizedMessages": m[:1]}, toolUseID="t"), event("progress", data={"type": "agent_progress", "normalizedMessages": m}), {"type": "file-history-snapshot", "messageId": "m", "snapshot": {"trackedFileBackups": {"/a": {"backupFileName": "a@1"}}}}, {"type": "file-history-delta", "trackingPath": "/b"}]
    ev = normalize.events(lines(spark, rows))
    assert [(r.progress_type, r.agent_id, r.tool_use_id) for r in normalize.progress(ev).orderBy("offset").collect()] == [("agent_progress", "q", "t"), ("agent_progress", None, None)]
    assert {(r.uuid, r.offset) for r in normalize.replayed_messages(ev).collect()} == {("a", 0), ("b", 100)}
    assert {(r.path, r.backup) for r in normalize.file_backups(ev).collect()} == {("/a", "a@1"), ("/b", None)}


ROLLOUT = "0190aaaa-bbbb-7ccc-8ddd-eeeeeeeeeeee"


def test_rollout_report(spark):
    item = lambda **p: {"type": "response_item", "timestamp": "T", "payload": p}
    flat = lambda **p: {"type": "event_msg", "payload": p}
    rows = [
        {"type": "session_meta", "payload": {"id": ROLLOUT, "cwd": "/w", "model_provider": "prov", "git": {"branch": "main", "commit_hash": "abcdef1", "repository_url": "https://h/t/p.git"}}},
        item(type="message", role="user", content=[{"type": "input_text", "text": "do"}, {"type": "input_text", "text": "it"}]), flat(type="user_message", message="do it"),
        item(type="message", role="developer", content=[{"type": "input_text", "text": "hidden"}]), item(type="reasoning", content="hidden"),
        flat(type="user_message", message="<environment_context>x"), item(type="function_call", name="shell", call_id="1", arguments='{"command": "ls -l\\nmore"}'),
        item(type="function_call_output", call_id="1", output="listing"), item(type="function_call_output", call_id="9", output=[{"text": "a"}, {"text": "b"}]),
        flat(type="item_completed", item={"type": "agent_message", "content": [{"type": "output_text", "text": "forward"}]}), flat(type="task_complete", error={"message": "failed"}),
        {"type": "patch_apply_end", "payload": {"changes": {"/w/src/a.py": {"kind": "add"}, "/etc/x": {}}}}, {"type": "turn_context", "payload": {"model": "m1"}},
        item(type="agent_message", content=[{"type": "text", "text": "token = abc"}]), "broken",
    ]
    r = digest.rollout_report(lines(spark, rows, "rollout", ROLLOUT)).first()
    assert [(m.role, m.text) for m in r.messages] == [("user", "do\nit"), ("tool", "shell -> listing"), ("tool", "tool -> a\nb"), ("assistant", "forward"), ("error", "failed"), ("assistant", "[REDACTED]")]
    assert (r.cwd, r.branch, r.commit, r.repository, r.model, r.title, r.redactions, r.malformed) == ("/w", "main", "abcdef1", "p", "m1", "do it", 1, 1)
    assert [(o.name, o.detail) for o in r.tool_ops] == [("shell", "ls -l")] and r.tool_counts == {"shell": 1} and r.changed_files == ["src/a.py"]
    many = [rows[0]] + [flat(type="user_message", message=f"m{i}") for i in range(200)]
    last = digest.rollout_report(lines(spark, many, "rollout", ROLLOUT), messages=3).first()
    assert [m.text for m in last.messages] == ["m197", "m198", "m199"] and last.truncated
    long = redact.admit_messages(spark.createDataFrame([("x" * 5000,)], "text string")).first().text
    assert long.startswith("[truncated 904 chars]…") and len(long) == len("[truncated 904 chars]…") + 4096
    assert logs.bounded_records(lines(spark, many, "rollout", ROLLOUT).withColumn("valid_utf8", F.lit(True)), 1 << 20, 5).count() == 6


def test_update_report(spark):
    up = lambda **u: {"params": {"update": u}}
    rows = [up(sessionUpdate="tool_call", toolCallId="1", title="Run", rawInput={"command": "make\nall"}, locations=[{"path": "/a"}]), up(sessionUpdate="tool_call_update", toolCallId="1", status="failed", rawOutput={"z": "no", "a": {"y": "inner"}}), up(sessionUpdate="tool_call_update", toolCallId="1", status="in_progress"), up(sessionUpdate="agent_message_chunk", content={"type": "text", "text": "hi"}), up(sessionUpdate="tool_call", toolCallId="2", title="Odd", rawInput={"n": 1})]
    chat = [{"type": "user", "content": "first"}, {"type": "user", "content": [{"text": "a"}, {"text": "b"}], "prompt_index": 7}, {"type": "user", "content": "no", "synthetic_reason": "x"}, {"type": "assistant", "content": "y"}]
    own = lines(spark, rows, "update", "u").withColumn("log", F.lit("updates")).unionByName(lines(spark, chat, "update", "u").withColumn("log", F.lit("chat_history")))
    summary = spark.createDataFrame([("u", "Title")], "session_id string, title string")
    r = digest.update_report(own, summary).first()
    assert [o.text for o in r.operations] == ["Run: make", 'Odd: {"n":1}'] and [(e.name, e.text) for e in r.errors] == [("Run", "inner")]
    assert [(p.prompt_index, p.text) for p in r.prompts] == [(0, "first"), (7, "a b")] and r.files == ["/a"] and [m.text for m in r.agent_messages] == ["hi"]
    assert (r.title, r.n_operations, r.n_errors, r.tool_counts) == ("Title", 2, 1, {"Odd": 1, "Run": 1})


def test_wire_report(spark):
    rows = [{"type": "turn.prompt", "time": 1000, "origin": {"kind": "user"}, "input": [{"type": "text", "text": "do  this"}]}, {"type": "turn.prompt", "time": 1500, "origin": {"kind": "agent"}, "input": [{"type": "text", "text": "no"}]}, {"type": "turn.steer", "time": 2000, "origin": {"kind": "cron"}, "input": "tick"}, {"type": "e", "time": 2500, "event": {"type": "content.part", "part": {"type": "text", "text": "answer"}}}, {"type": "context.apply_compaction", "time": 3000, "summary": "S", "tokensBefore": 9, "tokensAfter": 3, "keptUserMessageCount": 1}] + [{"type": "e", "time": 4000, "event": {"type": "tool.call", "name": "Read", "args": {"path": f"/f{i % 3}"}}} for i in range(20)] + ["{}"]
    state = spark.createDataFrame([("k", "T")], "session_id string, title string")
    r = digest.wire_report(lines(spark, rows, "wire", "k"), state).first()
    assert [(p.text, p.text_one_line) for p in r.prompts] == [("do  this", "do this")] and r.steer_counts == {"cron": 1} and [c.preview for c in r.cron_previews] == ["tick"]
    assert r.tool_counts == {"Read": 20} and len(r.operations) == 15 and r.files == ["/f0", "/f1", "/f2"] and r.last_compaction.tokens_before == 9 and str(r.first_event_time) == "1970-01-01 00:00:01"


def test_agent_detail(spark):
    rows = [agent("found it", 1, isSidechain=True), agent([call("Edit", "e", file_path="x")], 2, isSidechain=True)]
    own = lines(spark, rows).withColumn("agent_id", F.lit("q"))
    launched = spark.createDataFrame([("s", "q"), ("s", "gone")], "session_id string, agent_id string")
    found = {r.agent_id: r for r in digest.agent_digest(own, launched).collect()}
    assert found["q"].final_report == "found it" and [f.path for f in found["q"].files] == ["x"] and not found["gone"].transcript_found


def test_search(spark):
    t = digest.normalized(lines(spark, [user("alpha BETA gamma", 1), agent("beta again", 2), user(PEER, 3)]))
    assert [(r.kind, r.snippet) for r in search.grep(t["messages"], "beta", 2).orderBy("offset").collect()] == [("owner", "…a BETA g…"), ("agent", "beta a…")]
    assert search.message_filter(t["messages"], ["peer"]).count() == 1 and search.message_filter(t["messages"], since="2026-01-01T00:00:02Z", until="2026-01-01T00:00:03Z").count() == 2
    with pytest.raises(ValueError):
        search.message_filter(t["messages"], ["nobody"])
    assert search.prefilter(lines(spark, [user("x"), user("BETA")]), "beta").count() == 1 and search.prefilter(lines(spark, [user("x")]), "a.b").count() == 1
    entries = search.span_entries(t["messages"], t["blocks"])
    near = windows.span_around(entries, spark.createDataFrame([("main", "s", 100)], "format string, session_id string, target bigint"), 1)
    assert sorted(r.offset for r in near.collect()) == [0, 100, 200]
    with pytest.raises(ValueError):
        windows.span_between(entries, 10, 10)
    assert windows.span_between(entries, 0, 200).count() == 2


def test_commit_hints(spark):
    """The scope alone, whatever stands before its kind; whole words with a marker; sorted, each once, at most `cap`."""
    rows = [("fix(ok) prefeat(x) feat(big scope) docs(no) fix()",), ("see web/ui/a.ts, v5/b and src/c; fix(ok)",), ("fix(feat(y)",)]
    said = spark.createDataFrame([("main", "s", i, 0, *r) for i, r in enumerate(rows)], "format string, session_id string, offset bigint, seq int, text string")
    assert sorted(r.hint for r in rollups.commit_hints(said).collect()) == ["big scope", "feat(y", "ok", "v5/b", "web/ui/a.ts,", "x", "y"]
    assert [r.hint for r in rollups.commit_hints(said, cap=2).orderBy("hint").collect()] == ["big scope", "feat(y"]


def test_a_list_holds_1_to_100_sessions(spark):
    for n in (0, 101):
        with pytest.raises(ValueError):
            digest.session_list(None, limit=n)
