"""What a row costs: JSON is parsed once, and text blocks are found without a shuffle."""

from pyspark.sql import functions as F

from sessionlake.operators import classify, normalize
from sessionlake.session_queries import as_lines

LINES = [
    '{"type": "user", "uuid": "u1", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "isSidechain": false, "message": {"role": "user", "content": "bare"}}',
    '{"type": "user", "uuid": "u2", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "isSidechain": false, "message": {"role": "user", "content": [{"type": "image"}, {"type": "text", "text": "second"}, {"type": "text", "text": "third"}]}}',
    '{"type": "user", "uuid": "u3", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "isSidechain": false, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "{\\"file_path\\": \\"a\\"}"}, {"type": 7}]}}',
    "{broken",
]


def lines(spark):
    return spark.createDataFrame([("main", "s", 10 * i, x) for i, x in enumerate(LINES)], "format string, session_id string, offset bigint, value string")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_parsed_once(spark):
    events = normalize.events(lines(spark))
    assert plan(events).count("parseJson") == 1
    assert [r.offset for r in events.orderBy("offset").collect()] == [0, 10, 20]


def test_a_rendered_line_is_rendered_once(spark):
    rows = spark.range(3).select(F.lit(7).alias("session"), F.col("id").alias("step"))
    found = as_lines(rows, "main", F.when(F.col("step") < 2, F.to_json(F.struct("step"))))
    assert plan(found).count("to_json") + plan(found).count("StructsToJsonEvaluator") == 1
    assert sorted((r.offset, r.value, r.nbytes) for r in found.collect()) == [(0, '{"step":0}', 10), (100, '{"step":1}', 10)]


def test_first_text_blocks_need_no_join(spark):
    events = normalize.events(lines(spark))
    found = classify.incoming(events, normalize.attachments(events))
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    assert sorted((r.offset, r.seq, r.kind, r.text) for r in found.collect()) == [(0, 0, "owner", "bare"), (10, 1, "owner", "second")]


def test_files_of_blocks_in_one_scan(spark):
    events = normalize.events(lines(spark))
    found = normalize.event_files(events, normalize.content_blocks(events))
    assert plan(found).count("Scan") <= 3  # blocks, snapshots, deltas; calls and results had a scan each
    assert [(r.offset, r.path) for r in found.collect()] == [(20, "a")]
