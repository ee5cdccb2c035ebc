"""Incremental ingest and open delegations on file streams."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sessionlake.operators import correlate
from sessionlake.streaming import delegations as followed
from sessionlake.streaming import ingest

T0 = datetime(2026, 1, 1)


def test_lines_land_once(spark, tmp_path):
    rows = [("main", "s", "/s.jsonl", i * 10, 9, f"{i}", T0) for i in range(5)]
    spark.createDataFrame(rows, ingest.LANDED).write.parquet(f"{tmp_path}/in")
    ingest.land(ingest.landed_lines(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    again = rows[3:] + [("main", "s", "/s.jsonl", 50, 9, "5", T0)]
    spark.createDataFrame(again, ingest.LANDED).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.land(ingest.landed_lines(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(r.offset for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 10, 20, 30, 40, 50]


def test_open_delegations(spark, tmp_path):
    kind = "session_id string, call_id string, ts timestamp, status string"
    late = T0 + timedelta(days=9)
    calls = [("s", "a", T0, None), ("s", "b", T0, None), ("z", "z", late, None)]
    told = [("s", "a", T0 + timedelta(hours=1), "completed"), ("s", "c", T0, "completed"), ("z", "y", late, "completed")]
    for name, rows in (("calls", calls), ("told", told)):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}")
    stream = lambda name: spark.readStream.schema(kind).parquet(f"{tmp_path}/{name}")
    query = ingest.open_delegations(stream("calls"), stream("told")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(180)
    found = {(r.call_id, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert ("a", "completed") in found and found <= {("a", "completed"), ("b", "running")}


BLOCK = "format string, session_id string, offset bigint, seq int, ts timestamp, type string, block_type string, is_sidechain boolean, tool_name string, tool_use_id string, input string, outcome string, result_text string"
TEXT = "format string, session_id string, offset bigint, seq int, text string"
NOTE = "<task-notification><tool-use-id>{}</tool-use-id><status>{}</status><result>{}</result></task-notification>"


def records(spark, rows):
    """Blocks and texts of (call, what, offset, value)."""
    call = lambda c, o, v: ("main", "s", o, 0, T0, "assistant", "tool_use", False, "Task", c, f'{{"description": "{v}", "run_in_background": {str(v == "bg").lower()}}}', None, None)
    said = lambda c, o, v: ("main", "s", o, 1, T0, "user", "tool_result", False, None, c, None, f'{{"agentId": "{v}"}}' if v == "id" else "{}", v)
    blocks = [call(c, o, v) if what == "call" else said(c, o, v) for c, what, o, v in rows if what != "note"]
    texts = [("main", "s", o, 2, NOTE.format(c, v, f"r{o}")) for c, what, o, v in rows if what == "note"]
    blocks = spark.createDataFrame(blocks, BLOCK).withColumn("input", F.parse_json("input")).withColumn("outcome", F.parse_json("outcome"))
    return blocks, spark.createDataFrame(texts, TEXT)


def batch_result(spark, rows):
    blocks, texts = records(spark, rows)
    facts = correlate.correlated(correlate.launches(blocks), correlate.results(blocks), correlate.notifications(texts))
    return {tuple(r) for r in correlate.delegations(facts).collect()}


def run_stream(spark, path, keep=None):
    stream = spark.readStream.schema(followed._ddl({"format": "string", "session_id": "string", "tool_use_id": "string", **followed._FACT})).parquet(f"{path}/in")
    write = lambda rows, _: rows.write.mode("append").parquet(f"{path}/out")
    query = followed.follow(stream, keep).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def test_followed_delegations_equal_the_batch_after_every_batch(spark, tmp_path):
    """Out of order, repeated and split over batches with a restart between each: launches seen twice, results and notices before
    their launch, a last notice that loses to an earlier batch's later one, a call nobody launched."""
    rows = [("a", "call", 10, "bg"), ("a", "call", 40, "again"), ("a", "said", 20, "id"), ("a", "said", 30, None), ("a", "note", 50, "error"), ("a", "note", 60, "completed")]
    rows += [("b", "call", 100, "first"), ("b", "said", 110, "done"), ("c", "call", 200, "bg"), ("c", "note", 150, "completed"), ("c", "said", 140, "id"), ("d", "note", 300, "failed"), ("e", "call", 400, "bg"), ("e", "said", 400, "id")]
    rows += [(f"x{i}", "call", 1000 + i, "bg") for i in range(9)] + [(f"x{i}", "note", 2000 + i, "failed") for i in range(0, 9, 2)]
    random.Random(3).shuffle(rows)
    seen = []
    for part in (rows[:9], rows[9:20] + rows[:5], rows[20:]):
        seen += part
        followed.facts(*records(spark, part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_stream(spark, tmp_path)
        expected = batch_result(spark, seen)
        assert {tuple(r) for r in correlate.delegations(followed.latest(spark.read.parquet(f"{tmp_path}/out"))).collect()} == expected
        assert {tuple(r) for r in correlate.delegations(followed.held_calls(spark, f"{tmp_path}/cp")).collect()} == expected
    out = spark.read.parquet(f"{tmp_path}/out")
    before = out.count()
    followed.facts(*records(spark, rows)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run_stream(spark, tmp_path)
    assert spark.read.parquet(f"{tmp_path}/out").count() == before  # a replay changes nothing


def test_ended_calls_are_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    try:
        for part in ([("a", "call", 1, "bg"), ("b", "call", 2, "bg"), ("a", "note", 3, "completed")], [("c", "call", 4, "bg")]):
            followed.facts(*records(spark, part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            run_stream(spark, tmp_path, timedelta(milliseconds=100))
            time.sleep(0.5)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert {r.tool_use_id for r in followed.held_calls(spark, f"{tmp_path}/cp").collect()} == {"b", "c"}
