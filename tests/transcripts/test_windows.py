"""Scans of sessions in segments, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import windows


@pytest.fixture
def rows(spark):
    """One session with a third of all rows and many small ones, one without a name; equal neighbours across segments."""
    rng = random.Random(4)
    out = [("big", i, 0, rng.choice("aab"), rng.randint(0, 9)) for i in range(3000)]
    out += [(rng.choice(["s%d" % k for k in range(200)] + [None]), 10_000 + i, 0, rng.choice("ab"), rng.randint(0, 9)) for i in range(6000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield out, spark.createDataFrame(out, "session_id string, offset bigint, seq int, text string, size int").repartition(5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def sessions(rows):
    found = {}
    for r in sorted(rows, key=lambda r: r[1]):
        found.setdefault(r[0], []).append(r)
    return found


def test_a_large_session_is_many_segments(rows):
    parts = windows.segmented(rows[1], by=["session_id"]).groupBy("session_id").agg(F.countDistinct("segment").alias("n"), F.count("*").alias("rows"))
    found = {r.session_id: r.n for r in parts.collect()}
    assert found["big"] >= 4 and sum(found.values()) < 260


def test_ordinals(rows):
    want = {(r[0], r[1], i) for own in sessions(rows[0]).values() for i, r in enumerate(own)}
    assert {(r.session_id, r.offset, r.ordinal) for r in windows.ordinals(rows[1], by=["session_id"]).collect()} == want


def test_drop_adjacent(rows):
    want = {(r[0], r[1]) for own in sessions(rows[0]).values() for a, r in zip([None, *own], own) if a is None or a[3] != r[3]}
    found = windows.drop_adjacent(rows[1], [F.col("text")], by=["session_id"])
    assert {(r.session_id, r.offset) for r in found.collect()} == want and found.columns == rows[1].columns


def test_within_budget(rows):
    want = set()
    for own in sessions(rows[0]).values():
        total = 0
        for r in reversed(own):
            total += r[4]
            if total <= 700:
                want.add((r[0], r[1], total))
    assert {(r.session_id, r.offset, r.running) for r in windows.within_budget(rows[1], F.col("size"), 700, by=["session_id"]).collect()} == want
