"""Containment joins by shared grams, and a semi join on what is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
LONG_GRAM = 8  # grams of needles that are long enough; values with a common beginning differ in these


def only_asked(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the keys that are asked about, before anything is exploded."""
    return rows.join(asked.select(*keys).distinct(), keys, "left_semi")


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct substrings of the given lengths."""
    length = F.length(text)

    def of(n: int) -> Column:
        return F.when(
            length >= n,
            F.transform(F.sequence(F.lit(1), length - (n - 1)), lambda i: F.substring(text, i, F.lit(n))),
        ).otherwise(F.array().cast("array<string>"))

    parts = [of(n) for n in sizes]
    return F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])


def contains_join(
    needles: DataFrame, hays: DataFrame, keys: list[str], needle: str, hay: str
) -> DataFrame:
    """Distinct (keys, needle, hay) where the hay contains the needle.

    Both sides are made distinct first. A needle meets only the hays that share
    its first three characters, by an equi-join, and the full test follows; no
    pair of strings is formed without a shared gram. Needles shorter than that
    are joined by themselves, and only their keys' hays are cut into short grams.
    """
    wanted = needles.select(*keys, needle).filter(F.col(needle) != "").distinct()
    distinct_hays = only_asked(
        hays.select(*keys, hay).filter(F.col(hay) != ""), wanted, keys
    ).distinct()

    def joined(part: DataFrame, sizes: tuple[int, ...], right: DataFrame) -> DataFrame:
        left = part.withColumn("_gram", F.substring(F.col(needle), 1, GRAM))
        cut = right.withColumn("_gram", F.explode(_grams(F.col(hay), sizes)))
        return (
            left.join(cut, [*keys, "_gram"])
            .filter(F.col(hay).contains(F.col(needle)))
            .select(*keys, needle, hay)
        )

    short = wanted.filter(F.length(needle) < GRAM)
    return joined(wanted.filter(F.length(needle) >= GRAM), (GRAM,), distinct_hays).unionByName(
        joined(short, tuple(range(1, GRAM)), only_asked(distinct_hays, short, keys))
    )


def rarest_grams(needles: DataFrame, keys: list[str], needle: str) -> DataFrame:
    """(keys, needle, _gram): the gram of each distinct needle that fewest needles of the keys have.

    Needles of ``LONG_GRAM`` characters or more have grams of that length, others
    of ``GRAM``; what is shorter than that is left out.
    """
    size = F.length(needle)
    grams = F.when(size >= LONG_GRAM, _grams(F.col(needle), (LONG_GRAM,))).otherwise(_grams(F.col(needle), (GRAM,)))
    cut = needles.select(*keys, needle).filter(size >= GRAM).distinct().select(*keys, needle, F.explode(grams).alias("_gram"))
    often = cut.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    return (
        cut.join(often, [*keys, "_gram"])
        .groupBy(*keys, needle)
        .agg(F.min(F.struct("_n", "_gram")).alias("_rarest"))
        .select(*keys, needle, F.col("_rarest._gram").alias("_gram"))
    )


def gram_candidates(needles: DataFrame, hays: DataFrame, keys: list[str], needle: str, hay: str) -> DataFrame:
    """(keys, needle, hay) where the hay has the needle's rarest gram; not yet tested."""
    cut = hays.withColumn("_gram", F.explode(_grams(F.col(hay), (GRAM, LONG_GRAM))))
    return rarest_grams(needles, keys, needle).join(cut, [*keys, "_gram"]).select(*keys, needle, hay)


def rare_contains_join(needles: DataFrame, hays: DataFrame, keys: list[str], needle: str, hay: str) -> DataFrame:
    """As ``contains_join``, for many needles that begin alike, such as numbers of one range.

    Each needle meets the hays that have its rarest gram.
    """
    wanted = needles.select(*keys, needle).filter(F.col(needle) != "").distinct()
    distinct_hays = only_asked(hays.select(*keys, hay).filter(F.col(hay) != ""), wanted, keys).distinct()
    tested = gram_candidates(wanted, distinct_hays, keys, needle, hay).filter(F.col(hay).contains(F.col(needle)))
    short = wanted.filter(F.length(needle) < GRAM)
    return tested.unionByName(contains_join(short, distinct_hays, keys, needle, hay))
