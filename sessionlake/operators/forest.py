"""The forest of delegated sessions: who launched whom, followed up to the root, and sums rolled up to it.

Edges are (child, parent). Each round of pointer doubling replaces a session's ancestor by that ancestor's own, so a chain of
length n is followed in log2(n) joins of narrow rows, without a limit on depth or on rows. A session reaches its root in the
round that its depth asks for, and every depth below the greatest occurs, so a round that ends no session proves that the
rest lie on a cycle or below one: these get neither root nor depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, stored
from .normalize import KEY


def delegation_edges(delegations: DataFrame) -> DataFrame:
    """Edges from delegations whose agent is known; a delegated transcript is `<session>/<agent>`, as in `plans.digest.agent_digest`."""
    return delegations.filter("agent_id is not null").select(F.concat_ws("/", "session_id", "agent_id").alias("child"), F.col("session_id").alias("parent")).distinct()


def directory_edges(children: DataFrame) -> DataFrame:
    """Edges from the directory layout (`sources.logs.child_sessions`)."""
    return children.select(F.col("session_id").alias("child"), F.col("parent_session_id").alias("parent")).distinct()


def forest(edges: DataFrame) -> DataFrame:
    """session, root, depth of every session that edges name.

    Of several parents the smallest counts; an edge without either end, or from a session to itself, is none. A parent that is
    nobody's child is a root (depth 0), whether or not its log is there. On a cycle or below one: root and depth null."""
    real = edges.filter("child is not null and parent is not null and child <> parent")
    up = real.groupBy("child").agg(F.min("parent").alias("parent"))
    roots = real.select(F.col("parent").alias("session")).distinct().join(up.select(F.col("child").alias("session")), "session", "left_anti")
    start = up.select(F.col("child").alias("session"), F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("depth"), F.lit(False).alias("ended"))
    state = stored(start.unionByName(roots.select("session", F.col("session").alias("up"), F.lit(0).cast("bigint").alias("depth"), F.lit(True).alias("ended"))))
    waiting = state.filter("not ended").count()
    while waiting:
        above = state.select(F.col("session").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("ended").alias("ends"))
        moved = state.filter("not ended").join(above, "up").select("session", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("ended"))
        further = stored(state.filter("ended").unionByName(moved))
        discard(state)
        state, before = further, waiting
        waiting = state.filter("not ended").count()
        if waiting == before:
            break
    return state.select("session", F.when(F.col("ended"), F.col("up")).alias("root"), F.when(F.col("ended"), F.col("depth")).alias("depth"))


def rolled_up(places: DataFrame, measures: DataFrame, sums: list[str]) -> DataFrame:
    """Sessions, greatest depth and sums of each root. places: as from `forest`; measures: session and the summed columns, any number
    of rows a session. A session that no edge names is its own root; those without a root are one row, root null."""
    own = measures.filter("session is not null").groupBy("session").agg(*(F.sum(c).alias(c) for c in sums))
    lone = F.col("known").isNull()
    all_ = places.withColumn("known", F.lit(True)).join(own, "session", "full_outer")
    placed = all_.select(F.when(lone, F.col("session")).otherwise(F.col("root")).alias("root"), F.when(lone, F.lit(0)).otherwise(F.col("depth")).alias("depth"), *sums)
    return placed.groupBy("root").agg(F.count("*").alias("n_sessions"), F.max("depth").alias("max_depth"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))


def session_measures(delegations: DataFrame, usage: DataFrame, tasks: DataFrame) -> DataFrame:
    """What `rolled_up` sums of parsed sessions: delegations launched and still open, background tasks open, tokens and cost.
    usage: KEY, total, cost_usd, as from `rollups.usage_totals`; tasks: as from `correlate.background_tasks`."""
    empty = {"launched": F.lit(0), "open": F.lit(0), "total": F.lit(0), "cost_usd": F.lit(0.0)}

    def rows(df: DataFrame, **given) -> DataFrame:
        return df.select(F.col(KEY[-1]).alias("session"), *(given.get(c, zero).cast("double" if c == "cost_usd" else "bigint").alias(c) for c, zero in empty.items()))

    unfinished = F.col("status").isin("launched", "running").cast("bigint")
    parts = rows(delegations, launched=F.lit(1), open=unfinished), rows(tasks, open=F.col("open")), rows(usage, total=F.col("total"), cost_usd=F.col("cost_usd"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
