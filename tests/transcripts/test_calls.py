"""Calls of sessions by one aggregate, and bodies of messages told apart without writing out their schema."""

import json

from pyspark.sql import functions as F

from sessionlake.operators import classify, correlate, normalize
from sessionlake.operators.normalize import KEY
from sessionlake.sources.scratch import stored


def line(kind, content, at, session="s", **more):
    message = {"role": kind, "content": content} | ({"model": "m", "id": "i", "type": "message"} if kind == "assistant" else {})
    return ("main", session, at, json.dumps({"type": kind, "uuid": f"u{at}", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "isSidechain": False, "message": message} | more))


def use(call, name="Task", **given):
    return [{"type": "text", "text": "so"}, {"type": "tool_use", "id": call, "name": name, "input": given}]


def answer(call, content, **more):
    return [{"type": "tool_result", "tool_use_id": call, "content": content}]


def notice(call, status="completed"):
    return f" <task-notification><tool-use-id>{call}</tool-use-id><status>{status}</status><result>r</result></task-notification>"


LINES = [
    line("user", answer("a", "early"), 0, toolUseResult={"agentId": "none"}),
    line("assistant", use("a", description="first"), 10), line("assistant", use("a", description="again"), 20),
    line("user", answer("a", [{"type": "text", "text": "one"}]), 30, toolUseResult={"agentId": "x"}), line("user", answer("a", "two"), 40),
    line("user", notice("a", "error"), 50), line("user", [{"type": "text", "text": notice("a")}], 60),
    line("user", notice("b"), 70), line("assistant", use("b", "Bash", command="c", run_in_background=True), 80), line("user", answer("b", "in background with ID: t1. More"), 90),
    line("assistant", use("c", "Bash", command="c"), 100), line("user", f"not one: {notice('b')}", 110), line("assistant", use("d"), 120, session=None), line("user", answer("d", "lost"), 130, session=None),
    ("main", "s", 140, json.dumps({"type": "attachment", "uuid": "u", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "isSidechain": False, "attachment": {"type": "queued_command", "commandMode": "task-notification", "prompt": notice("b", "killed")}})),
]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark, lines):
    e = normalize.events(spark.createDataFrame(lines, "format string, session_id string, offset bigint, value string"))
    e = stored(e)
    return e, stored(normalize.content_blocks(e)), stored(normalize.attachments(e))


def test_calls_equal_the_joins_in_one_aggregate(spark):
    e, blocks, attachments = tables(spark, LINES)
    texts = stored(classify.incoming(e, attachments)).filter("kind = 'task_notification'")
    few = stored(classify.incoming(e, attachments, holding=correlate.NOTICE)).filter("kind = 'task_notification'")
    joined = correlate.correlated(correlate.launches(blocks), correlate.results(blocks), correlate.notifications(texts))
    found = correlate.calls(blocks, few)
    assert found.columns == joined.columns and sorted(map(str, found.collect())) == sorted(map(str, joined.collect()))
    rows = {r.tool_use_id: r for r in found.collect()}
    assert sorted(rows) == ["a", "b", "d"]
    assert (rows["a"].description, rows["a"].agent_id, rows["a"].sync_excerpt, rows["a"].notified) == ("first", "x", "two", "completed")
    assert (rows["b"].task_id, rows["b"].notified, rows["d"].sync_excerpt) == ("t1", "killed", None)
    assert "Join" not in plan(found) and plan(found).count("Aggregate") == 1


def test_a_line_s_facts_are_read_once_and_arrays_are_told_by_their_items(spark):
    lines = [line("user", "[1]", 0), line("user", [], 10), line("user", {"a": [1]}, 20), line("user", None, 30), line("assistant", "bare", 40), line("user", ["x", {"type": "text", "text": "y"}], 50)]
    parsed = normalize.events(spark.createDataFrame(lines, "format string, session_id string, offset bigint, value string"))
    e, blocks, _ = tables(spark, lines)
    assert plan(parsed.select("offset", "type", "ts")).count("$.timestamp") <= 2  # its schema and its value; each mention had its own
    assert sorted(r.offset for r in e.collect()) == [0, 10, 50]
    assert sorted((r.offset, r.seq, r.text) for r in blocks.filter(F.col("block_type") == "text").select(*KEY, "offset", "seq", "text").collect()) == [(0, 0, "[1]"), (50, 1, "y")]
