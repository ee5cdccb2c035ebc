"""Delegations followed over a stream: one keyed state a call, readable at once.

Launches, results and notifications of a call may arrive in any order, in any batch and more than once. The state of a
call keeps what the batch operators would: the first launch, the last notification, the last non-null value of each field
of its results, each with the place (offset, seq) that decides. So after every batch the last row of each call equals
`correlate.delegations` over all lines so far, whatever the order they came in.

States are keyed by (session, call), not by session: a session with a third of all calls is spread over all tasks, and a
state is a few fields whatever the length of the session. With `keep`, an ended call is forgotten that long after its last change.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import correlate
from ..operators.normalize import KEY

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

CALL = [*KEY, "tool_use_id"]
LAUNCH = {"kind": "string", "launched_us": "bigint", "description": "string", "agent_type": "string", "prompt": "string", "command": "string", "run_in_background": "boolean"}
RESULT = ["agent_id", "sync_excerpt", "task_id"]
NOTICE = ["raw", "excerpt"]
_PLACE = {"offset": "bigint", "seq": "int"}
_FACT = {"fact": "string", **_PLACE, **LAUNCH, **{c: "string" for c in [*RESULT, *NOTICE]}}
#: The state of one call: each group of fields behind the place that won it.
_STATE = {
    **{f"launch_{c}": t for c, t in _PLACE.items()}, **LAUNCH,
    **{f"{r}_{c}": t for r in RESULT for c, t in _PLACE.items()}, **{r: "string" for r in RESULT}, "result_at": "bigint",
    **{f"notice_{c}": t for c, t in _PLACE.items()}, **{c: "string" for c in NOTICE},
    "version": "int",
}
_OUT = {"format": "string", "session_id": "string", "tool_use_id": "string", **_PLACE, **LAUNCH, **{r: "string" for r in RESULT}, "notified": "string", "notified_excerpt": "string", "version": "int"}
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


def facts(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Launches, results and notifications in one long form; both sides may be streams. A row without a call id says nothing."""
    launched = correlate.launch_rows(blocks).withColumn("launched_us", F.unix_micros(F.col("launched_at").cast("timestamp"))).withColumn("fact", F.lit("launch"))
    told = correlate.notification_rows(texts).withColumn("fact", F.lit("notice"))
    answered = correlate.result_rows(blocks).withColumn("fact", F.lit("result"))
    shaped = lambda df: df.select(*(F.col(c).cast("string").alias(c) for c in CALL), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _FACT.items()))
    return reduce(DataFrame.unionByName, map(shaped, (launched, answered, told))).filter("tool_use_id is not null")


def fold(state: dict | None, rows: Iterator) -> dict:
    """The state after these facts. Associative and commutative in them, so neither order nor repeats matter."""
    state = dict.fromkeys(_STATE) if state is None else state

    def wins(prefix: str, row, first: bool = False) -> bool:
        held, place = (state[f"{prefix}_offset"], state[f"{prefix}_seq"]), (row["offset"], row["seq"])
        if held[0] is not None and (place >= held if first else place <= held):
            return False
        state[f"{prefix}_offset"], state[f"{prefix}_seq"] = place
        return True

    for row in rows:
        if row["fact"] == "launch" and wins("launch", row, first=True):
            state.update({c: row[c] for c in LAUNCH})
        elif row["fact"] == "notice" and wins("notice", row):
            state.update({c: row[c] for c in NOTICE})
        elif row["fact"] == "result":
            state["result_at"] = max(row["offset"], state["result_at"] if state["result_at"] is not None else row["offset"])
            state.update({r: row[r] for r in RESULT if row[r] is not None and wins(r, row)})
    return state


def shown(state: dict) -> tuple | None:
    """The call as `correlate.correlated` gives it: what came before the launch isn't about it. None before the launch."""
    at = state["launch_offset"]
    if at is None:
        return None
    later = lambda place, value: state[value] if state[place] is not None and state[place] >= at else None
    return (at, state["launch_seq"], *(state[c] for c in LAUNCH), *(later("result_at", r) for r in RESULT), *(later("notice_offset", c) for c in NOTICE))


class CallState(StatefulProcessor):
    """Folds the facts of a call into its state and gives its row again whenever that changes."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("call", _ddl(_STATE))

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get()
        held = None if held is None else dict(zip(_STATE, held))
        before = shown(held) if held else None
        state = fold(held, rows)
        after = shown(state)
        if after is not None and after != before:
            state["version"] = (state["version"] or 0) + 1
            yield Row(**dict(zip(_OUT, (*key, *after, state["version"]))))
        self.state.update(tuple(state.values()))
        if self.keep_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if after is not None and (state["raw"] is not None or state["sync_excerpt"] is not None and not state["run_in_background"]):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def follow(facts: DataFrame, keep: timedelta | None = None) -> DataFrame:
    """The stream of changed calls, columns as of `correlate.correlated` and `version`, the number of the change. Write it in
    update mode. `correlate.delegations` and `background_tasks` take its rows as they come.

    States need Spark's RocksDB store; the session is set to it. Without `keep` they stay. With it they go by timers: a fact
    that arrives later starts a new state and shows nothing until a launch is seen again. Start such a stream with
    spark.sql.streaming.noDataMicroBatches.enabled=false: timers then run with the next lines, else in empty batches without end.
    """
    facts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    ms = None if keep is None else int(keep.total_seconds() * 1000)
    calls = facts.groupBy(*CALL).transformWithState(CallState(ms), _ddl(_OUT), "update", "none" if ms is None else "processingTime")
    return calls.withColumn("launched_at", F.timestamp_micros("launched_us")).drop("launched_us")


def aggregated(facts: DataFrame) -> DataFrame:
    """The same calls by Spark's own streaming aggregates, for streams too large to call Python for each key: columns as of `follow`, but
    for `version`, which a batch's number gives. In update mode a call's row comes with each batch that holds a fact of it, changed or not;
    a call without a launch has no offset."""
    facts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    place = F.struct(*_PLACE)
    of = lambda fact, holds=True: F.when((F.col("fact") == fact) & holds, place)
    calls = facts.groupBy(*CALL).agg(
        F.min_by(F.struct(*_PLACE, *LAUNCH), of("launch")).alias("l"), F.max_by(F.struct("offset", *NOTICE), of("notice")).alias("n"),
        F.max(F.when(F.col("fact") == "result", F.col("offset"))).alias("result_at"), *(F.max_by(r, of("result", F.col(r).isNotNull())).alias(r) for r in RESULT),
    )
    later = lambda at, c: F.when(F.col(at) >= F.col("l.offset"), F.col(c))
    return calls.select(*CALL, "l.offset", "l.seq", *(f"l.{c}" for c in LAUNCH if c != "launched_us"), *(later("result_at", r).alias(r) for r in RESULT), later("n.offset", "n.raw").alias("notified"), later("n.offset", "n.excerpt").alias("notified_excerpt"), F.timestamp_micros("l.launched_us").alias("launched_at"))


def latest(changes: DataFrame) -> DataFrame:
    """The last row of each call in a table of changes."""
    rest = [c for c in changes.columns if c not in CALL]
    return changes.groupBy(*CALL).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*CALL, "r.*")


def held_calls(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All calls as a stream's state holds them after its last batch, read from its checkpoint: a batch scan of the state
    store, while the stream runs or not. Columns as of `follow`."""
    state = spark.read.format("statestore").option("stateVarName", "call").load(checkpoint)
    s = lambda c: F.col(f"value.{c}")
    later = lambda place, c: F.when(s(place) >= s("launch_offset"), s(c))
    return state.select(
        *(F.col(f"key.{c}") for c in CALL), s("launch_offset").alias("offset"), s("launch_seq").alias("seq"),
        *(s(c) for c in LAUNCH if c != "launched_us"), *(later("result_at", r).alias(r) for r in RESULT),
        later("notice_offset", "raw").alias("notified"), later("notice_offset", "excerpt").alias("notified_excerpt"),
        s("version").alias("version"), F.timestamp_micros(s("launched_us")).alias("launched_at"),
    ).filter("offset is not null")
