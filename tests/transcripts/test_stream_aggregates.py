"""Calls followed by streaming aggregates."""

from pyspark.sql import functions as F

from sessionlake.operators import correlate
from sessionlake.streaming import delegations as followed


def test_calls_by_streaming_aggregates_equal_the_batch(spark, tmp_path):
    facts = [("main", "s", c, fact, at, 0, *rest) for c, fact, at, *rest in (
        ("a", "launch", 5, "d", None, None, None), ("a", "launch", 2, "first", None, None, None), ("a", "notice", 9, None, None, "completed", "done"), ("a", "notice", 7, None, None, "failed", "no"),
        ("b", "launch", 5, "x", None, None, None), ("b", "notice", 4, None, None, "completed", "early"), ("b", "result", 6, None, "agent", None, None), ("c", "notice", 1, None, None, "completed", "stray"),
    )]
    names = {"fact": "string", "offset": "bigint", "seq": "int", "description": "string", "agent_id": "string", "raw": "string", "excerpt": "string"}
    rows = spark.createDataFrame(facts, "format string, session_id string, tool_use_id string, " + ", ".join(f"{k} {v}" for k, v in names.items()))
    rows = rows.select(*followed.CALL, *((F.col(c) if c in names else F.lit(None)).cast(t).alias(c) for c, t in followed._FACT.items()))
    for i in range(4):
        rows.filter(F.col("offset") % 4 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = followed.aggregated(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    save = lambda batch, n: batch.withColumn("version", F.lit(n)).write.mode("append").parquet(f"{tmp_path}/out")
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    held = followed.latest(spark.read.parquet(f"{tmp_path}/out")).filter("offset is not null")
    assert sorted((r.tool_use_id, r.offset, r.description, r.agent_id, r.notified, r.notified_excerpt) for r in held.collect()) == [("a", 2, "first", None, "completed", "done"), ("b", 5, "x", "agent", None, None)]
    assert correlate.delegations(held.withColumn("kind", F.lit("delegation"))).count() == 2
