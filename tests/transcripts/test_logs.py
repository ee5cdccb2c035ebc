"""Scans of real files: offsets, windows, discovery and sidecars."""

import json

import pytest
from pyspark.sql import functions as F

from sessionlake.sources import logs, ranges

UUID = "0190aaaa-bbbb-7ccc-8ddd-eeeeeeeeeeee"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_offsets_point_at_their_lines_in_any_split(spark, tmp_path):
    rows = [("é" * (i % 50) + f"line {i}" + ("\r" if i % 7 == 0 else "")) if i % 5 else "" for i in range(4000)]
    files = {"a": "\n".join(rows) + "\n", "b": "\n".join(rows[::-1])}
    for name, text in files.items():
        put(tmp_path / f"{name}.jsonl", text)
    put(tmp_path / "c.jsonl", b'ok\n\xff\xfe{"x"\nend\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        found = logs.raw_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(found) == 2 * sum(bool(r.strip()) for r in rows) + 3
    for r in found:
        raw = (tmp_path / r.file_path.rsplit("/", 1)[1]).read_bytes()
        own = raw[r.offset : r.offset + r.nbytes]
        assert own.removesuffix(b"\r").decode("utf-8", "replace") == r.value and raw[r.offset + r.nbytes : r.offset + r.nbytes + 1] in (b"\n", b"")
        assert r.file_size == len(raw)
    assert [r.valid_utf8 for r in sorted(found, key=lambda r: r.offset) if "c.jsonl" in r.file_path] == [True, False, True]


def test_windows(spark, tmp_path):
    put(tmp_path / "a.jsonl", "".join(f"{i:09d}\n" for i in range(10)))
    lines = logs.raw_lines(spark, str(tmp_path)).withColumn("session_id", F.lit("a")).cache()
    offsets = lambda c: sorted(r.offset for r in lines.filter(c).collect())
    assert offsets(logs.in_head(25)) == [0, 10] and offsets(logs.in_head(100)) == list(range(0, 100, 10))
    assert offsets(logs.in_tail(25)) == [80, 90] and offsets(logs.in_tail(20)) == [90] and offsets(logs.in_tail(100)) == list(range(0, 100, 10))
    assert offsets(logs.before(30, 15)) == [20] and offsets(logs.after(30, 18)) == [30]
    kept = logs.bounded_records(lines, 1024, 3)
    assert sorted((r.offset, r.is_meta) for r in kept.collect()) == [(0, True), (70, False), (80, False), (90, False)]
    with pytest.raises(ValueError):
        logs.bounded_records(lines, 10, 3)
    assert logs.scan_stats(lines, "session_id").first().asDict() == {"session_id": "a", "lines": 10, "bytes": 90}


def test_discovery(spark, tmp_path):
    for p in ("projects/x/s1.jsonl", "archive/x/s2.jsonl", "projects/x/s1/subagents/agent-q.jsonl", "projects/x/s1/tool-results/t.jsonl", f"sessions/2026/01/02/rollout-x-{UUID}.jsonl", "sessions/2026/01/02/other.jsonl", "sessions/g/u1/updates.jsonl", "sessions/w/k1/agents/main/wire.jsonl", "sessions/w/k1/agents/aa/wire.jsonl", "sessions/w/k2/agents/zz/wire.jsonl", "sessions/w/k2/agents/bb/wire.jsonl"):
        put(tmp_path / p, "{}\n")
    lines = logs.raw_lines(spark, str(tmp_path)).cache()
    mine = logs.main_sessions(lines.filter("file_path like '%/projects/%' or file_path like '%/archive/%'"))
    assert {(r.session_id, r.source) for r in mine.collect()} == {("s1", "projects"), ("s2", "archive")}
    assert [r.session_id for r in logs.main_sessions(mine.select(*lines.columns), archive=False).collect()] == ["s1"]
    assert [(r.session_id, r.agent_id) for r in logs.delegated_transcripts(lines).collect()] == [("s1", "q")]
    assert [r.session_id for r in logs.rollout_sessions(lines).collect()] == [UUID]
    assert [(r.group, r.session_id, r.log) for r in logs.update_sessions(lines).collect()] == [("g", "u1", "updates")]
    assert {(r.session_id, r.agent) for r in logs.wire_sessions(lines).collect()} == {("k1", "main"), ("k2", "bb")}


def test_lookup(spark):
    s = spark.createDataFrame([("abcd1", 1), ("abcd2", 2), ("abcd", 0)], "session_id string, updated_at int")
    assert [(r.session_id, r.n_matches) for r in logs.lookup(s, "abcd1").collect()] == [("abcd1", 1)]
    assert [(r.session_id, r.n_matches) for r in logs.lookup(s, "abcd").collect()] == [("abcd", 1)]
    assert {r.n_matches for r in logs.lookup(s, "abc").collect()} == {3} and logs.lookup(s, "abc", least=8).count() == 0
    assert [r.session_id for r in logs.lookup(s, "abc", newest=True).collect()] == ["abcd2"]


def test_sidecars(spark, tmp_path):
    put(tmp_path / "s/subagents/agent-q.meta.json", '{"agentType": "explore", "description": "look"}')
    put(tmp_path / "sessions/g/u1/summary.json", json.dumps({"generated_title": "T", "info": {"cwd": "/w"}, "updated_at": "2026-01-01T00:00:00Z", "num_messages": 4}))
    put(tmp_path / "active_sessions.json", '[{"session_id": "u1"}, {"session_id": "u1"}, {}]')
    put(tmp_path / "u1/plan.json", '{"todos": {"1": {"status": "done", "content": "a"}, "2": {"status": "open", "content": "b"}}}')
    put(tmp_path / "u1/signals.json", '{"turnCount": 3}')
    put(tmp_path / "k1/state.json", '{"title": "K", "workDir": "/k"}')
    put(tmp_path / "bad/state.json", "not json")
    put(tmp_path / "u1/compaction/INDEX.md", "# x\n| n | file |\n| 1 | segment_1.md | a |\n| 2 | segment_2.md | b |\n")
    put(tmp_path / "out/t1.output", "x" * 50 + "\nlast\n")
    root = str(tmp_path)
    assert logs.delegation_meta(spark, root).first().asDict() == {"session_id": "s", "agent_id": "q", "agent_type": "explore", "description": "look"}
    s = logs.update_summaries(spark, root).first()
    assert (s.session_id, s.title, s.cwd, s.n_messages, str(s.updated_at)) == ("u1", "T", "/w", 4, "2026-01-01 00:00:00")
    assert [r.session_id for r in logs.live_sessions(spark, root).collect()] == ["u1"]
    assert {(r.todo_id, r.status) for r in logs.plan_todos(spark, root).collect()} == {("1", "done"), ("2", "open")}
    assert logs.signals(spark, root).first().turns == 3
    assert {(r.session_id, r.title) for r in logs.wire_states(spark, root).collect()} == {("k1", "K"), ("bad", None)}
    assert tuple(logs.compaction_index(spark, root).first()) == ("u1", 2, "segment_2.md")
    assert tuple(logs.task_output(spark, root, 10).first()) == ("t1", "last\n", True)
    body = spark.createDataFrame([("a\n## Summary\nb",), ("abc",)], "s string")
    assert [r.x for r in body.select(logs.segment_summary("s", chars=2).alias("x")).collect()] == ["## Summary\nb", "ab"]
    index = spark.createDataFrame([(0, json.dumps({"id": UUID, "thread_name": "old"})), (9, json.dumps({"id": UUID, "thread_name": "new"})), (20, '{"id": "x", "thread_name": "bad"}')], "offset bigint, value string")
    assert [tuple(r) for r in logs.title_index(index).collect()] == [(UUID, "new")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, None)], "session_id string, n int, x string")
    logs.write_json(df, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first().asDict() == {"n": 1, "session_id": "s"}
    assert json.loads(logs.as_json(df).first().report) == {"n": 1}


def test_ranges_give_each_line_once(tmp_path):
    """Any split, any block: the lines of the whole file, also around empty lines, long lines and a half last one."""
    for raw in (b"", b"\n", b"a", b"a\n", b"\n\na\n\nbb", b"x" * 50 + b"\ny\n" + b"z" * 30, b"one\ntwo\nthree\n"):
        path = tmp_path / "f.jsonl"
        path.write_bytes(raw)
        lines = raw.split(b"\n")
        lines = lines[:-1] if lines[-1] == b"" else lines
        expected, at = [], 0
        for line in lines:
            expected.append((at, line, at + len(line) < len(raw)))
            at += len(line) + 1
        for split in (1, 2, 3, 7, 100):
            for block in (1, 4, 64):
                found = []
                for part in ranges.split([(ranges.LogFile(f"file://{path}", len(raw), 0.0), 0, len(raw))], split):
                    for b in ranges.batches(part, block):
                        found += zip(b.column("offset").to_pylist(), b.column("raw").to_pylist(), b.column("terminated").to_pylist())
                assert found == expected, (raw, split, block)


def test_a_snapshot_ends_where_the_file_ended(tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_bytes(b"one\ntwo\nthr")
    reader = ranges.LogReader(ranges.options(str(tmp_path), split_bytes=2))
    parts = reader.partitions()
    path.write_bytes(b"one\ntwo\nthree\nfour\n")
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["offset"], r["raw"], r["terminated"], r["file_size"]) for r in rows] == [(0, b"one", True, 11), (4, b"two", True, 11), (8, b"thr", False, 11)]


def test_windows_decide_what_is_read(spark, tmp_path):
    for name in "ab":
        put(tmp_path / f"{name}.jsonl", "".join(f"{i:09d}\n" for i in range(10_000)))

    def read(**options):
        return sum(p.nbytes for p in ranges.LogReader(ranges.options(str(tmp_path), **options)).partitions())

    assert read() == 200_000
    assert read(tail=1000) <= 2000 and read(head=1000) == 2000
    assert read(start=500, end=501) == 2 and read(start=500, end=700) == 400 and read(start=10**6) == 0
    assert read(files=json.dumps([f"file://{tmp_path}/a.jsonl"])) == 100_000
    lines = logs.raw_lines(spark, str(tmp_path), split_bytes=777)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    everything = spark.createDataFrame(lines.collect(), lines.schema)
    places = lambda df: sorted((r.file_path, r.offset) for r in df.collect())
    for n in (0, 1, 995, 1000, 1001, 99_999, 100_000, 10**7):
        both = logs.raw_lines(spark, str(tmp_path), tail=n, split_bytes=777).unionByName(logs.raw_lines(spark, str(tmp_path), head=n))
        assert places(both) == places(everything.filter(logs.in_tail(n)).unionByName(everything.filter(logs.in_head(n))))
    assert places(logs.raw_lines(spark, str(tmp_path), start=495, end=520, files=[f"file://{tmp_path}/b.jsonl"])) == [(f"file://{tmp_path}/b.jsonl", o) for o in (500, 510)]
    assert places(lines.filter(logs.in_head_or_tail(25, 25)).filter("file_path like '%a.jsonl'")) == [(f"file://{tmp_path}/a.jsonl", o) for o in (0, 10, 99_980, 99_990)]


def test_spark_s_text_reader_gives_the_same_lines(spark, tmp_path):
    put(tmp_path / "a.jsonl", "".join("é" * (i % 50) + f"line {i}\n" * (i % 3) for i in range(900)) + "half")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        columns = ["file_size", "offset", "nbytes", "head_bytes", "tail_bytes", "raw"]
        rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
        ranges.register(spark)
        own = spark.read.format(ranges.NAME).options(**ranges.options(str(tmp_path), split_bytes=500)).load()
        assert rows(logs._text_lines(spark, [str(tmp_path)], None, "*.jsonl")) == rows(own)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_children(spark):
    paths = spark.createDataFrame([("/g/p1/subagents/c1/chat_history.jsonl",), ("/g/p1/subagents/c1/updates.jsonl",), ("/g/p1/subagents/c2/x.json",), ("/g/p2/updates.jsonl",)], "file_path string")
    assert {tuple(r) for r in logs.child_sessions(paths).collect()} == {("p1", "c1"), ("p1", "c2")}


def test_a_stream_follows_growing_files(spark, tmp_path):
    src, out = tmp_path / "logs", str(tmp_path / "out")

    def drain():
        logs.streamed_lines(spark, str(src), split_bytes=6).select("file_path", "offset", "value").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.file_path[-7:], r.offset, r.value) for r in spark.read.parquet(out).collect())

    put(src / "a.jsonl", "one\ntwo\nhal")
    assert drain() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    put(src / "a.jsonl", "one\ntwo\nhalf\nnext\n")
    put(src / "b.jsonl", "new\n")
    whole = drain()  # each call is a restart from the checkpoint
    assert whole == sorted((r.file_path[-7:], r.offset, r.value) for r in logs.raw_lines(spark, str(src)).collect())
    assert drain() == whole
    put(src / "b.jsonl", "x\n")  # shorter: replaced
    assert drain() == sorted([*whole, ("b.jsonl", 0, "x")])
