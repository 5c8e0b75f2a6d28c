"""Mixing sources to target weights along a time-varying curriculum.

Time runs from 0 to 1. Each source has a weight schedule, piecewise linear over
any number of knots; its integral is the share of the source's demand met up to a
time. The source's documents stand in a fixed hashed order, pass after pass. The
words before a pass of a document are its demand, and the inverse of the integral
gives its training position. Positions are then range-sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import n_words

CAP = 3  # passes over a source at most
BLOCKS = 4096  # hash ranges a source is numbered by
# Knots (time, relative weight) by the source's place modulo 3: early, flat, in the second half.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (0.75, 2.0), (1.0, 1.0)))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) by water-filling.

    ``sources``: one row per source with source_size, weight and place, its rank. Every source
    gets weight x level, but no more than CAP times its size; the level makes the
    targets add up to all words. Sources run full in the order of cap per
    weight, so the level follows from sums over that order.
    """
    cap = F.lit(float(CAP)) * F.col("source_size")
    order = Window.orderBy("_ratio", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        sources.withColumn("_ratio", cap / F.col("weight"))
        .withColumn("_all", F.sum("source_size").over(total))
        .withColumn("_weights", F.sum("weight").over(total))
        .withColumn("_full", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("_rest", F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # The level if this source and all later ones were below their cap.
        .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_rest"))
        .withColumn("_fits", F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "place", "_level")))
        .withColumn("_found", F.min("_fits").over(total)["_level"])  # the first that fits
    )
    return rows.select(
        "source", "source_size", "weight", "place",
        F.least(F.col("weight") * F.coalesce("_found", F.lit(0.0)), cap).alias("target"),
    )


def pieces(knots) -> list[tuple[float, ...]]:
    """(share before, share behind, time, weight, slope) of each piece of a schedule, shares out of its whole integral."""
    times, weights = zip(*knots)
    if times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:])) or min(weights) < 0 or not any(weights):
        raise ValueError("knots run from time 0 to time 1 in order, their weights are 0 or more and not all 0")
    steps = list(zip(knots, knots[1:]))
    areas = [(b - a) * (u + v) / 2 for (a, u), (b, v) in steps]
    total, met, out = sum(areas), 0.0, []
    for ((a, u), (b, v)), area in zip(steps, areas):
        out.append((met / total, (met + area) / total, a, u / total, (v - u) / (b - a) / total))
        met += area
    return out


def _time(share: Column, knots) -> Column:
    """Time at which a schedule has met this share: its integral, inverted piece by piece."""
    def inverse(before: float, at: float, weight: float, slope: float) -> Column:
        more = F.greatest(share - before, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(weight**2) + 2 * slope * more, F.lit(0.0)))
        return at + 2 * more / F.greatest(F.lit(weight) + root, F.lit(1e-300))

    found = reduce(
        lambda later, p: F.when(share < p[1], inverse(p[0], *p[2:])).otherwise(later), reversed(pieces(knots)), F.lit(1.0)
    )
    return F.least(found, F.lit(1.0))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", schedules=SCHEDULES
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, taken, passes, positions.

    Pass p of a document is taken if less than its source's target lies before
    its middle; taken is size times the passes, three at most. ``positions`` holds
    the training position of each pass. Weights 1, 2, 3 and the ``schedules``
    go round the sources in code-point order, the null source last. Empty and
    null texts have size 0 and take nothing. Null ids and repeated rows are
    documents of their own; equal rows are numbered in either order, which no
    column shows. No other column is looked at. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col).alias("_h"))
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(BLOCKS)).cast("int"))
    blocks = rows.groupBy("source", "_b").agg(F.sum("size").alias("_words"))
    source = F.coalesce(F.concat(F.lit("v"), "source"), F.lit("w"))  # never null; null last
    per_source = (
        blocks.groupBy("source").agg(F.sum("_words").alias("source_size"))
        .withColumn("place", F.row_number().over(Window.orderBy(source)) - 1)
        .withColumn("weight", F.col("place") % 3 + 1)
    )
    plan = targets(per_source)
    offset = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_words").over(offset), F.lit(0))).drop("_words")
    within = Window.partitionBy("source", "_b").orderBy("_h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    facts = starts.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        F.col("s.source").alias("_source"), F.col("_b").alias("_block"), "_start", "source_size", "target", "place"
    )
    out = numbered.join(facts, (F.col("_b") == F.col("_block")) & F.col("source").eqNullSafe(F.col("_source")))
    at = F.col("_start") + F.col("_in")
    middle = at + F.col("size") / 2
    passes = sum((F.when(middle + p * F.col("source_size") < F.col("target"), 1).otherwise(0) for p in range(CAP)), F.lit(0))
    passes = F.when(F.col("size") > 0, passes).otherwise(F.lit(0))

    def position(p: Column) -> Column:
        share = F.least((at + (p - 1) * F.col("source_size")) / F.greatest("target", F.lit(1e-9)), F.lit(1.0))
        turn = F.col("place") % len(schedules)
        return F.coalesce(*(F.when(turn == j, _time(share, knots)) for j, knots in enumerate(schedules)))

    return out.withColumn("passes", passes).select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target",
        (F.col("size") * F.col("passes")).cast("long").alias("taken"), "passes",
        F.transform(F.slice(F.array(*(F.lit(p + 1) for p in range(CAP))), F.lit(1), F.col("passes")), position).alias("positions"),
    )


def training_order(docs: DataFrame, **options) -> DataFrame:
    """Every taken pass of every document with its position, range-sorted by it."""
    rows = mixed(docs, **options)
    own = [c for c in rows.columns if c not in ("passes", "positions")]
    each = rows.select(*own, F.posexplode("positions").alias("pass", "position"))
    return each.withColumn("pass", F.col("pass") + 1).orderBy("position", *own[:1], "pass")


def ordered(docs: DataFrame, **options) -> DataFrame:
    """Documents range-sorted by their first training position, those without one last."""
    rows = mixed(docs, **options).withColumn("first_position", F.get("positions", F.lit(0)))
    return rows.orderBy(F.col("first_position").asc_nulls_last(), rows.columns[0])
