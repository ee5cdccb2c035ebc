"""Log scans: raw lines with byte offsets, windows on them, session discovery and sidecar files.

`raw_lines` is the one scan every format shares: byte ranges of files (`ranges`), so one very large file is
read by many tasks, and each line comes with the offset it was found at, without a shuffle. Offsets count raw bytes, before
blank lines go and invalid UTF-8 is replaced. Order within a session is offset order, never time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import ranges

MAX_LINE_BYTES = 1 << 20


#: File systems that executors reach without Spark's help; logs in any other are read by Spark's own text reader.
REACHED = ("", "file", "s3", "gs")


def raw_lines(spark: SparkSession, paths: str | list[str], modified_after: str | None = None, glob: str = "*.jsonl", head: int | None = None, tail: int | None = None, start: int | None = None, end: int | None = None, files: list[str] | None = None, split_bytes: int | None = None) -> DataFrame:
    """file_path, file_size, modified_at, offset, nbytes, head_bytes, tail_bytes, valid_utf8, value of every line that isn't blank.

    `head`, `tail`, `start`, `end` and `files` keep lines of the first or last bytes, of [start, end), of these files: only these
    bytes are read. Each execution reads the files as long as they were when it was planned; store the lines where several
    jobs must see the same state."""
    some = [paths] if isinstance(paths, str) else list(paths)
    if all((p.partition(":")[0] if ":" in p.partition("/")[0] else "") in REACHED for p in some):
        ranges.register(spark)
        more = {"modified_after": modified_after, "glob": glob, "head": head, "tail": tail, "start": start, "end": end, "files": json.dumps(files) if files is not None else None, "split_bytes": split_bytes}
        lines = spark.read.format(ranges.NAME).options(**ranges.options(some, **more)).load()
    else:
        lines = _text_lines(spark, some, modified_after, glob)
    found = _decoded(lines)
    for n, window in ((head, head_window), (tail, tail_window), (start, lambda n: F.col("offset") >= n), (end, lambda n: F.col("offset") < n), (files, lambda x: F.col("file_path").isin(x))):
        found = found if n is None else found.filter(window(n))
    return found


def _text_lines(spark: SparkSession, paths: list[str], modified_after: str | None, glob: str) -> DataFrame:
    """The columns of `ranges` by Spark's text reader, for stores that only Spark reaches. A line's offset is a prefix sum of
    byte lengths in two levels, first inside each file block and then over the blocks' totals."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    m = "_metadata"
    lines = reader.text(paths).select("value", F.col(f"{m}.file_path").alias("file_path"), F.col(f"{m}.file_size").alias("file_size"), F.col(f"{m}.file_modification_time").alias("modified_at"), F.col(f"{m}.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), (F.octet_length("value") + 1).cast("bigint").alias("size"))
    block = Window.partitionBy("file_path", "block").orderBy("row")
    within = lines.withColumn("inside", F.sum("size").over(block.rowsBetween(Window.unboundedPreceding, -1)))
    totals = lines.groupBy("file_path", "block").agg(F.sum("size").alias("total"))
    before = totals.withColumn("before", F.sum("total").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("file_path", "block", "before")
    offset, nbytes, size = F.coalesce("inside", F.lit(0)) + F.coalesce("before", F.lit(0)), F.col("size") - 1, F.col("file_size")
    placed = within.join(before, ["file_path", "block"]).withColumn("offset", offset)
    return placed.select("file_path", "file_size", "modified_at", "offset", nbytes.alias("nbytes"), F.least(F.col("offset") + F.col("size"), size).alias("head_bytes"), (size - F.col("offset") + (F.col("offset") > 0).cast("bigint")).alias("tail_bytes"), F.col("value").cast("binary").alias("raw"))


def streamed_lines(spark: SparkSession, paths: str | list[str], glob: str = "*.jsonl", split_bytes: int | None = None) -> DataFrame:
    """The same lines as a stream: each complete line of the growing files once. file_size is how far a batch has read."""
    ranges.register(spark)
    return _decoded(spark.readStream.format(ranges.NAME).options(**ranges.options(paths, glob=glob, split_bytes=split_bytes)).load())


def _decoded(lines: DataFrame) -> DataFrame:
    text = F.col("raw").cast("string")
    clean = F.regexp_replace(F.make_valid_utf8(text), "\r$", "")
    return lines.select("file_path", "file_size", "modified_at", "offset", "nbytes", "head_bytes", "tail_bytes", F.is_valid_utf8(text).alias("valid_utf8"), clean.alias("value")).filter(F.trim("value") != "")


# -- windows on offsets ----------------------------------------------------------------------------


def in_head(n: int) -> Column:
    """Complete lines within a file's first n bytes."""
    return (F.col("offset") + F.col("nbytes") + 1 <= n) | (F.col("file_size") <= n)


def tail_start(n: int) -> Column:
    return F.greatest(F.col("file_size") - n, F.lit(0))


def in_tail(n: int) -> Column:
    """Lines of the last n bytes; the first, maybe partial one is dropped, so a line starting exactly there is too."""
    return (tail_start(n) == 0) | (F.col("offset") > tail_start(n))


def head_window(n: int) -> Column:
    """in_head on lines of `raw_lines`, as one comparison."""
    return F.col("head_bytes") <= n


def tail_window(n: int) -> Column:
    """in_tail on lines of `raw_lines`, as one comparison."""
    return F.col("tail_bytes") <= n


def in_head_or_tail(head: int, tail: int) -> Column:
    """Both windows at once: a line that lies in both comes once."""
    return in_head(head) | in_tail(tail)


def truncated(n: int) -> Column:
    return tail_start(n) > 0


def before(offset: int, n: int) -> Column:
    return (F.col("offset") < offset) & (F.col("offset") >= offset - n)


def after(offset: int, n: int) -> Column:
    return (F.col("offset") >= offset) & (F.col("offset") + F.col("nbytes") <= offset + n)


def bounded_records(lines: DataFrame, tail_bytes: int, max_lines: int, key: str = "session_id") -> DataFrame:
    """The first line of each session as meta, then the last `max_lines` of its last `tail_bytes`, with
    `malformed` for lines over 1 MiB or of invalid UTF-8."""
    if not (1024 <= tail_bytes <= 64 << 20 and 1 <= max_lines <= 100_000):
        raise ValueError("limits are outside the supported bounds")
    last = Window.partitionBy(key).orderBy(F.desc("offset"))
    body = lines.filter((F.col("offset") > 0) & in_tail(tail_bytes)).withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= max_lines).drop("rank")
    meta = lines.filter("offset = 0")
    return meta.withColumn("is_meta", F.lit(True)).unionByName(body.withColumn("is_meta", F.lit(False))).withColumn("malformed", (F.col("nbytes") > MAX_LINE_BYTES) | ~F.col("valid_utf8"))


def scan_stats(lines: DataFrame, *by: str) -> DataFrame:
    return lines.groupBy(*by).agg(F.count("*").alias("lines"), F.sum(F.octet_length("value")).cast("bigint").alias("bytes"))


# -- discovery -------------------------------------------------------------------------------------


def main_sessions(lines: DataFrame, archive: bool = True) -> DataFrame:
    """Lines of main logs `projects/<slug>/<id>.jsonl`: delegated transcripts and tool results are no sessions."""
    path = F.col("file_path")
    found = lines.filter(~path.rlike("/(?:subagents|tool-results)/")).withColumn("format", F.lit("main")).withColumn("source", F.when(path.rlike("/projects/"), "projects").otherwise("archive")).withColumn("session_id", T.file_stem(path))
    return found if archive else found.filter("source = 'projects'")


def delegated_transcripts(lines: DataFrame) -> DataFrame:
    """Lines of `<session>/subagents/agent-<id>.jsonl`, by the agent and the session that launched it."""
    found = lines.withColumn("agent_id", F.regexp_extract("file_path", r"/subagents/agent-([^/]+)\.jsonl$", 1)).filter("agent_id <> ''")
    return found.withColumn("session_id", F.regexp_extract("file_path", r"/([^/]+)/subagents/", 1))


def rollout_sessions(lines: DataFrame) -> DataFrame:
    """Lines of `sessions/Y/M/D/*-<uuid>.jsonl`; other names are no sessions."""
    dated = lines.filter(F.col("file_path").rlike(r"/sessions/\d{4}/\d{2}/\d{2}/[^/]+\.jsonl$"))
    return dated.withColumn("format", F.lit("rollout")).withColumn("session_id", T.rollout_id("file_path")).filter("session_id is not null")


def update_sessions(lines: DataFrame) -> DataFrame:
    """Lines of `sessions/<group>/<id>/{updates,chat_history}.jsonl`, with group and log."""
    pattern = r"/sessions/([^/]+)/([^/]+)/(updates|chat_history)\.jsonl$"
    found = lines.filter(F.col("file_path").rlike(pattern)).withColumn("format", F.lit("update"))
    return found.select("*", *(F.regexp_extract("file_path", pattern, i).alias(n) for i, n in ((1, "group"), (2, "session_id"), (3, "log"))))


def wire_sessions(lines: DataFrame) -> DataFrame:
    """Lines of one wire log for each session: the main agent's, else the first agent's by name."""
    pattern = r"/sessions/([^/]+)/([^/]+)/agents/([^/]+)/wire\.jsonl$"
    found = lines.filter(F.col("file_path").rlike(pattern)).withColumn("format", F.lit("wire")).select("*", *(F.regexp_extract("file_path", pattern, i).alias(n) for i, n in ((1, "workdir"), (2, "session_id"), (3, "agent"))))
    chosen = found.groupBy("workdir", "session_id").agg(F.min(F.struct((F.col("agent") != "main").alias("other"), "agent")).alias("c")).select("workdir", "session_id", F.col("c.agent").alias("agent"))
    return found.join(chosen, ["workdir", "session_id", "agent"])


def child_sessions(paths: DataFrame) -> DataFrame:
    """Parent and child ids from `<parent>/subagents/<child>/`."""
    pattern = r"([^/]+)/subagents/([^/]+)"
    return paths.select(F.regexp_extract("file_path", pattern, 1).alias("parent_session_id"), F.regexp_extract("file_path", pattern, 2).alias("session_id")).filter("session_id <> ''").distinct()


def lookup(sessions: DataFrame, needle: str, least: int = 1, newest: bool = False) -> DataFrame:
    """Sessions by exact id or prefix of at least `least` characters, with n_matches: callers refuse more than
    one, unless `newest` takes the latest."""
    exact = sessions.filter(F.col("session_id") == needle)
    found = sessions.filter(F.startswith("session_id", F.lit(needle)) | (F.col("session_id") == needle)) if len(needle) >= least else exact
    # An exact id wins over longer ids that start with it. Two numbers, summed by every task, say which case it is.
    own = F.col("session_id") == needle
    matches, equal = found.agg(F.count("*"), F.count_if(own)).first()
    kept = found.filter(own) if equal else found
    if newest:
        return kept.orderBy(F.desc("updated_at"), "session_id").limit(1).withColumn("n_matches", F.lit(1).cast("bigint"))
    return kept.withColumn("n_matches", F.lit(equal or matches).cast("bigint"))


# -- sidecars --------------------------------------------------------------------------------------


def json_files(spark: SparkSession, paths: str | list[str], glob: str) -> DataFrame:
    """Small JSON documents: file_path and v (null if it isn't JSON)."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(paths)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.try_parse_json("value").alias("v"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def delegation_meta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """session_id, agent_id, agent_type, description of `agent-<id>.meta.json` files."""
    files = json_files(spark, paths, "agent-*.meta.json")
    return files.select(F.regexp_extract("file_path", r"/([^/]+)/subagents/agent-", 1).alias("session_id"), F.regexp_extract("file_path", r"/agent-([^/]+)\.meta\.json$", 1).alias("agent_id"), _get("$.agentType").alias("agent_type"), _get("$.description").alias("description"))


def title_index(lines: DataFrame) -> DataFrame:
    """session_id and title of a title index (id, thread_name): the last one for each valid id, redacted."""
    v = lines.select("offset", F.try_parse_json("value").alias("v")).select("offset", _get("$.id").alias("session_id"), _get("$.thread_name").alias("title"))
    last = v.filter(T.is_uuid("session_id") & F.col("title").isNotNull()).groupBy("session_id").agg(F.max_by("title", "offset").alias("title"))
    return last.withColumn("title", T.safe_scalar("title", 200)).filter("title is not null")


def update_summaries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each summary.json of the update store."""
    text = {"generated_title": "title", "session_summary": "summary_provider_written", "last_turn_summary": "last_turn_provider_written", "current_model_id": "model", "agent_name": "agent_name", "reasoning_effort": "reasoning_effort", "head_branch": "branch", "head_commit": "commit", "session_kind": "kind"}
    times = {"created_at": "created_at", "last_active_at": "last_active_at", "updated_at": "updated_at"}
    counts = {"num_messages": "n_messages", "num_chat_messages": "n_chat_messages"}
    columns = [_get(f"$.{k}").alias(n) for k, n in text.items()] + [T.rfc3339(_get(f"$.{k}")).alias(n) for k, n in times.items()] + [_get(f"$.{k}", "bigint").alias(n) for k, n in counts.items()]
    return json_files(spark, paths, "summary.json").select(F.regexp_extract("file_path", r"/([^/]+)/summary\.json$", 1).alias("session_id"), F.regexp_extract("file_path", r"/sessions/([^/]+)/", 1).alias("group"), _get("$.info.cwd").alias("cwd"), *columns)


def live_sessions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """session_id of each entry in active_sessions.json."""
    entries = json_files(spark, paths, "active_sessions.json").select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v"))
    return entries.select(_get("$.session_id").alias("session_id")).filter("session_id is not null").distinct()


def signals(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Counters beside an update log."""
    names = {"turnCount": "turns", "toolCallCount": "tool_calls", "contextTokensUsed": "context_tokens", "contextWindowTokens": "context_window"}
    return json_files(spark, paths, "signals.json").select(F.regexp_extract("file_path", r"/([^/]+)/signals\.json$", 1).alias("session_id"), *(_get(f"$.{k}", "bigint").alias(n) for k, n in names.items()))


def plan_todos(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """session_id, todo_id, status, content of each entry in plan.json's map of todos."""
    todos = json_files(spark, paths, "plan.json").select(F.regexp_extract("file_path", r"/([^/]+)/plan\.json$", 1).alias("session_id"), F.explode(F.try_variant_get("v", "$.todos", "map<string,variant>")).alias("todo_id", "v"))
    return todos.select("session_id", "todo_id", _get("$.status").alias("status"), _get("$.content").alias("content"))


def wire_states(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each state.json of the wire store."""
    return json_files(spark, paths, "state.json").select(F.regexp_extract("file_path", r"/([^/]+)/state\.json$", 1).alias("session_id"), _get("$.title").alias("title"), _get("$.workDir").alias("cwd"), _get("$.lastPrompt").alias("last_prompt"), T.rfc3339(_get("$.createdAt")).alias("created_at"), T.rfc3339(_get("$.updatedAt")).alias("updated_at"))


def compaction_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """session_id, segments and last segment file of each compaction INDEX.md."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "INDEX.md").text(paths).select(F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("row"), "value")
    rows = lines.filter(F.startswith("value", F.lit("| ")) & F.contains("value", F.lit("segment_")))
    return rows.select(F.regexp_extract("file_path", r"/([^/]+)/compaction/INDEX\.md$", 1).alias("session_id"), "row", F.trim(F.element_at(F.split("value", r"\|"), 3)).alias("segment")).groupBy("session_id").agg(F.count("*").alias("segments"), F.max_by("segment", "row").alias("last_segment"))


def segment_summary(body: str | Column, marker: str = "## Summary", chars: int = 4000) -> Column:
    """A segment's text from the first summary marker on, else its first characters."""
    body = F.col(body) if isinstance(body, str) else body
    at = F.locate(marker, body)
    return F.when(at > 0, F.substr(body, at)).otherwise(F.substring(body, 1, chars))


def task_output(spark: SparkSession, path: str, n: int = 256 << 10) -> DataFrame:
    """task_id and the last n bytes of each background task's captured output (whole lines)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.output").load(path)
    tail = F.make_valid_utf8(F.substring("content", -n, n).cast("string"))
    return files.select(T.file_stem("path").alias("task_id"), F.when(F.col("length") > n, F.regexp_replace(tail, r"\A[^\n]*\n", "")).otherwise(tail).alias("output"), (F.col("length") > n).alias("truncated"))


# -- sinks -----------------------------------------------------------------------------------------


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Reports as JSON lines; null fields are left out, as Spark does."""
    df.write.mode(mode).json(path)


def as_json(df: DataFrame, key: str = "session_id") -> DataFrame:
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("report"))
