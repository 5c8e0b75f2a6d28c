"""Row numbers and running totals within a key that may be very large.

A plain window over the key would put all of a hot key's rows in one task. Here
the key is cut into blocks that follow the sort order (an hour of a log, a run
of ordinals). Blocks are counted first with a map-side combine, the counts are
summed over the blocks of a key, and rows are numbered within their block only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_within(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list[str],
    totals: dict[str, Column],
    null_keys: bool = False,
) -> DataFrame:
    """Add inclusive running sums of ``totals`` within ``keys`` by ``order``.

    ``block`` must not decrease along ``order``. Rows whose keys or block are null
    are left out, unless ``null_keys``: then null is a key as any other.
    """
    spot = [f"_v_{name}" for name in totals]
    marked = df.withColumn("_block", block)
    for name, value in totals.items():
        marked = marked.withColumn(f"_v_{name}", value.cast("bigint"))
    per_block = marked.groupBy(*keys, "_block").agg(
        *[F.sum(v).alias(f"_s{v}") for v in spot]
    )
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_s{v}").over(before), F.lit(0)).alias(f"_o{v}") for v in spot],
    )
    inside = (
        W.partitionBy(*keys, "_block")
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    rows = marked.select("*", *[F.sum(v).over(inside).alias(f"_r{v}") for v in spot])
    on: list[str] | Column = [*keys, "_block"]
    if null_keys:
        offsets = offsets.withColumnsRenamed({k: f"_k_{k}" for k in on})
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on])
    rows = rows.join(offsets, on)
    return rows.select(
        *df.columns,
        *[
            (F.col(f"_r_v_{name}") + F.col(f"_o_v_{name}")).alias(name)
            for name in totals
        ],
    )


def number_within(
    df: DataFrame, keys: list[str], block: Column, order: list[str], name: str, null_keys: bool = False
) -> DataFrame:
    """Add a dense row number, from 1, within ``keys`` by ``order``."""
    return running_within(df, keys, block, order, {name: F.lit(1)}, null_keys)
