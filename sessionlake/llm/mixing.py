"""Operator 4: mixing sources to target weights by entropy balancing.

Every document gets a rate w in (0, CAP): copies of it that the mix holds. Of all rates that give each
source its target number of words, the balanced ones have the greatest (bounded) entropy relative to a
rate of 1. Their convex dual has one multiplier for each source, and the rates are exponential tilts
held below the cap:

    w = CAP / (1 + (CAP - 1) exp(-multiplier * size / mean size of the source))

Newton iterations solve the dual. Each is one Spark aggregate over (source, size, number of documents)
that returns the gradient and curvature of each source; the driver holds the multipliers and a bracket
of each and halves the bracket where a Newton step leaves it. At the driver are a few numbers for each
source and nothing for documents.

Rates become whole copies: floor(w), and one more where a hash of the document falls below the
fraction plus a shift. Two histograms for each source (of CELLS cells and, within one cell, of CELLS
finer ones) find the shift at which the copies' words come as near the target as one document allows.

Words are runs of bytes other than space and 0x09-0x0D; a null text has none. A null source is one
source, last in order. Documents without words have taken 0. Repeated rows, and rows without doc_id, are
copied each by itself: equal in doc_id, source and text, they stand at even distances in the rounding, so the
targets are met also where one such row makes up most of a source (which of them gets the copy more may
differ between runs; how many, does not). A very long text counts as one document of its size. An empty table
gives no rows; sources without words have target 0. Other columns keep their names and values, whatever they
are called; only former columns named like the result's are replaced. The result depends only on the rows, so
reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, query, small_side, small_table, stored

WEIGHTS, CAP, CELLS, STEPS, TOLERANCE = (5, 2, 1), 3, 4096, 60, 1e-9
WORDS = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[float], weights: list[float], cap: float = CAP) -> list[float]:
    """Targets in proportion to weights that sum to all sizes, none above cap times its size."""
    left, rest = float(sum(sizes)), set(range(len(sizes)))
    targets = [0.0] * len(sizes)
    while rest:
        share = left / sum(weights[i] for i in rest)
        full = [i for i in sorted(rest) if weights[i] * share > cap * sizes[i]]
        if not full:
            for i in rest:
                targets[i] = weights[i] * share
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
        rest -= set(full)
    return targets


def _rate(multiplier, scaled, cap: float):
    return F.lit(float(cap)) / (1 + (cap - 1) * F.exp(-multiplier * scaled))


def solve(counts: DataFrame, totals: list[dict], cap: float = CAP) -> dict[int, float]:
    """counts: k (number of a source), size, n (documents of that size). Each source's multiplier; infinite
    for those whose target is the cap. After STEPS Newton steps the brackets are only halved, which always ends."""
    spark = counts.sparkSession
    state = {t["k"]: {"at": 0.0, "lo": -math.inf, "hi": math.inf} for t in totals if 0 < t["target"] < cap * t["size"]}
    out = {t["k"]: math.inf for t in totals if t["k"] not in state}
    by = {t["k"]: t for t in totals}
    turn = 0
    while state:
        turn += 1
        known = small_table(spark, [(k, s["at"], by[k]["size"] / by[k]["with_words"]) for k, s in sorted(state.items())], "k int, m double, mean double")
        w, x = _rate(F.col("m"), F.col("x"), cap), F.col("x")
        each = counts.join(F.broadcast(known), "k").withColumn("x", F.col("size") / F.col("mean"))  # known: one row a source
        sums = each.groupBy("k").agg(F.sum(F.col("n") * w * x).alias("g"), F.sum(F.col("n") * x * x * w * (1 - w / cap)).alias("h")).collect()
        for r in sums:
            s, t = state[r.k], by[r.k]
            goal = t["target"] / (t["size"] / t["with_words"])
            off = r.g - goal
            narrow = math.isfinite(s["hi"] - s["lo"]) and s["hi"] - s["lo"] <= 1e-14 * max(abs(s["lo"]), abs(s["hi"]))
            if abs(off) <= TOLERANCE * goal or narrow:
                out[r.k] = s["at"]
                del state[r.k]
                continue
            s["lo" if off < 0 else "hi"] = s["at"]
            step = s["at"] - off / r.h if r.h > 0 and turn <= STEPS else math.nan
            if not s["lo"] < step < s["hi"]:
                step = 2 * s["at"] + (1 if off < 0 else -1) if math.isinf(s["hi"] if off < 0 else s["lo"]) else (s["lo"] + s["hi"]) / 2
            s["at"] = step
    return out


def _numbered_repeats(sized: DataFrame) -> DataFrame:
    """sized (row, size, key) with u, a place in [0, 1) by the hash `key`; rows with one key (equal in doc_id, source and
    text) stand at even distances. These are numbered in two levels, within each input partition and over the
    partitions' counts, so that one such row on a third of the table is no single task's work."""
    spread = F.shiftrightunsigned("key", 11) / F.lit(float(2**53))
    repeated = stored(sized.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1"))
    n = repeated.count()
    if not n:
        discard(repeated)
        return sized.withColumn("u", spread)
    side = small_side(repeated, n)
    placed = stored(sized.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()).join(side, "key", "left"))
    again = placed.filter("times is not null")
    counts = again.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = counts.select("key", "part", (F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("key", "part").orderBy("nth")) - 1
    numbered = again.withColumn("number", number).join(before, ["key", "part"]).withColumn("u", F.pmod(spread + (F.col("before") + F.col("number")) / F.col("times"), F.lit(1.0)))
    names = [*sized.columns, "u"]
    return placed.filter("times is null").withColumn("u", spread).select(*names).unionByName(numbered.select(*names))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, keep: list[str] | None = None, store: bool = False) -> DataFrame:
    """docs (doc_id, source, text and any others) with size, source_size, target, rate, copies and taken. With `keep`, only
    these columns of docs come along; with `store` they are written once (if they are narrow), else words are counted twice."""
    spark = docs.sparkSession
    ours = ["size", "source_size", "target", "rate", "copies", "taken"]
    names = [c for c in (keep or docs.columns) if c not in ours]
    # The documents' own columns travel in one struct, so that none can be called like a column made here.
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint")
    key = F.xxhash64(F.lit("copies"), "doc_id", "source", "text")
    sized = docs.select(F.struct(*names).alias("row"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"))
    sized = _numbered_repeats(stored(sized) if store else sized).drop("key")
    narrow = sized.select("source", "size", "u") if store else stored(sized.select("source", "size", "u"))
    sums = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("with_words")).collect()
    sums = sorted(sums, key=lambda r: (r.source is None, r.source or ""))  # by code point, null last
    targets = water_fill([r["size"] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], cap)
    totals = [{"k": i, "source": r.source, "size": r["size"], "with_words": r.with_words, "target": t} for i, (r, t) in enumerate(zip(sums, targets))]
    kind = "k int, source string, source_size bigint, target double, mean double"
    known = small_table(spark, [(t["k"], t["source"], t["size"], t["target"], t["size"] / max(1, t["with_words"])) for t in totals], kind)

    def numbered(rows: DataFrame, sources: DataFrame) -> DataFrame:
        sources = F.broadcast(sources.withColumnRenamed("source", "source_"))  # a few numbers for each source, collected above
        return rows.join(sources, rows["source"].eqNullSafe(sources["source_"])).drop("source_")

    sources = numbered(narrow.filter("size > 0"), known.select("k", "source"))
    counts = stored(sources.groupBy("k", "size").agg(F.count("*").alias("n")))
    multipliers = solve(counts, totals, cap)
    discard(counts)
    tilts = known.join(small_table(spark, [(k, m if math.isfinite(m) else None) for k, m in multipliers.items()], "k int, m double"), "k")

    def rated(rows: DataFrame) -> DataFrame:
        rate = F.when(F.col("m").isNull(), F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)).otherwise(_rate(F.col("m"), F.col("size") / F.col("mean"), cap))
        rows = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
        # Below the shift, a document gets one copy more: v is its place less its fraction.
        return rows.withColumn("v", F.when(F.col("whole") < cap, F.col("u") - (F.col("rate") - F.col("whole"))))

    each = rated(numbered(narrow.filter("size > 0"), tilts))
    place = (F.col("v") + 1) / 2 * CELLS
    cell, fine = F.floor(place), F.floor((place - F.floor(place)) * CELLS)

    def cut(rows: DataFrame, by, base: DataFrame) -> dict[int, tuple[int, int]]:
        """For each source, the cell in which the running sum of sizes passes what is still wanted, and the sum before it."""
        per = rows.filter("v is not null").groupBy("k", by.alias("cell")).agg(F.sum("size").alias("s"))
        running = per.withColumn("upto", F.sum("s").over(Window.partitionBy("k").orderBy("cell"))).join(F.broadcast(base), "k")
        passed = running.filter(F.col("upto") > F.col("wanted")).groupBy("k").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("s")).alias("before"), "s"), "cell").alias("c"))
        return {r.k: (r.c.cell, r.c.before, r.c.s) for r in passed.collect()}

    floors = {r.k: r.s for r in each.groupBy("k").agg(F.sum(F.col("whole") * F.col("size")).alias("s")).collect()}
    wanted = {t["k"]: t["target"] - floors.get(t["k"], 0) for t in totals}
    coarse = cut(each, cell, small_table(spark, [(k, float(w)) for k, w in wanted.items()], "k int, wanted double"))
    inside = small_table(spark, [(k, c[0], float(wanted[k] - c[1])) for k, c in coarse.items()], "k int, cell bigint, wanted double")
    within = each.join(F.broadcast(inside.select("k", "cell")), (each["k"] == inside["k"]) & (cell == inside["cell"])).drop(inside["k"]).drop("cell")
    finer = cut(within, fine, inside.select("k", "wanted"))

    def shift(k: int) -> tuple[int, int]:
        """Cells before this pair get the further copy: of the cell that passes the target, all or none, whichever is nearer."""
        if k not in coarse:
            return (CELLS + 1, 0) if wanted[k] > 0 else (-1, 0)
        if k not in finer:
            return coarse[k][0] + 1, 0
        at, before, s = finer[k]
        left = wanted[k] - coarse[k][1]
        return coarse[k][0], at + (before + s - left < left - before)

    shifts = small_table(spark, [(t["k"], *shift(t["k"])) for t in totals], "k int, shift bigint, fine_shift bigint")
    all_rows = rated(numbered(sized, tilts.join(shifts, "k")))
    more = F.col("v").isNotNull() & ((cell < F.col("shift")) | (cell == F.col("shift")) & (fine < F.col("fine_shift")))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(more, 1).otherwise(0)).otherwise(0)
    out = all_rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), *ours)


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, keep=["doc_id"], store=True).select("doc_id", "size", "source_size", "target", "taken")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it; a document without words stays once."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    mixed = mix(row, keep=["row"])
    times = F.when(F.col("size") > 0, F.col("copies")).otherwise(1)
    each = mixed.select("row", times.alias("times"), F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int"))).alias("nth"))
    return each.filter("nth <= times").select("row.*")
