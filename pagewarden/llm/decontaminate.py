"""Benchmark decontamination by SimHash over windows of the items' own sizes.

A window of n words is looked at only where the text holds shingles of items of
n words. A shared shingle gives a diagonal, the start that would put it in place.
A window whose shared shingles all lie on diagonals to its right loses nothing
by a step to the right, and likewise to the left, so the best window starts
between two diagonals of its own shingles. Two of them are less than 2 n apart:
all starts from diagonal to diagonal are taken where the gap is not larger, and
``SLACK`` more at the ends. Of these, windows with too few shared shingles to
reach the threshold are left out. Each
window and each item has a 64-bit SimHash of its counted shingles. A radius of r
over eight blocks of eight bits means that some block differs in r // 8 bits at
most, so items are entered under every block value within that distance and
windows are looked up by their own block values: all fingerprints within the
radius are found. The weighted Jaccard similarity of the counted shingles then
decides. Everything is built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import scratch, unused, words, written

SHINGLE = 5
BLOCKS, WIDTH = 8, 8
RADIUS = 20  # similarity 0.8 differs in about 10 of 64 bits; 20 is 3.5 deviations more
SLACK = 2
BROADCAST_ROWS = 200_000  # item shingles of 16 bytes, or entries of items, that may be sent to every task
BROADCAST_KEYS = 1_000_000  # hashes of texts with windows that may be sent to every task


def shingles(w: Column, length: int = SHINGLE) -> Column:
    """Hashes of the shingles of ``length`` words in order; of all words where there are fewer."""
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - length + 1, F.lit(1))),
            lambda i: F.xxhash64(F.slice(w, i, length)),
        )
    )


def lookups(w: Column, short: list[int]) -> Column:
    """(pos, h) of every shingle of a text; of ``short`` items' lengths too."""
    found = F.transform(shingles(w), lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
    for length in short:
        more = F.transform(shingles(w, length), lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
        found = F.concat(found, F.when(F.size(w) > length, more).otherwise(F.slice(more, 1, 0)))
    return found


def simhash(hashes: Column) -> Column:
    """Sign of the sum of the counted hashes, bit by bit."""
    def bit(b: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1))
        return F.when(ones * 2 > F.size(hashes), F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftleft", bit(b), b))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def blocks_of(fingerprint: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(BLOCKS - 1)),
        lambda b: F.struct(b.alias("block"), F.call_function("shiftrightunsigned", fingerprint, b * WIDTH).bitwiseAND(F.lit(255).cast("bigint")).alias("value")),
    )


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two lists of hashes, each weighted by its count."""
    keys = F.array_distinct(F.concat(a, b))

    def count(of: Column, key: Column) -> Column:
        return F.size(F.filter(of, lambda x: x == key))

    both = F.aggregate(keys, F.lit(0), lambda s, k: s + F.least(count(a, k), count(b, k)))
    return both / (F.size(a) + F.size(b) - both)


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    w = words(F.col(text_col).cast("string"))
    return (
        benchmark.select(F.col(id_col).alias("item_id"), w.alias("w")).filter(F.size("w") > 0)
        .select("item_id", F.size("w").alias("n"), shingles(F.col("w")).alias("item"))
        .withColumn("item_hash", simhash(F.col("item")))
    )


def between() -> Column:
    """Starts between neighbours of ``starts`` that are at most two item lengths apart."""
    last = F.greatest(F.lit(0), F.col("size") - F.col("n"))

    def reach(s: Column, i: Column) -> Column:
        after = F.get("starts", i + 1)
        end = F.when(after - s <= 2 * F.col("n"), after).otherwise(s)
        return F.sequence(F.greatest(F.lit(0), s - SLACK), F.least(last, end + SLACK))

    return F.array_distinct(F.flatten(F.transform("starts", reach)))


def full(threshold: float) -> Column:
    """Starts of windows with shared shingles at as many places of ``found`` as the threshold takes.

    b shingles in common give b / (a + c - b) at most, for a and c shingles of window and item.
    """
    size, n = F.col("size"), F.col("n")
    item = F.greatest(n - SHINGLE + 1, F.lit(1))
    window = F.greatest(F.least(size, n) - SHINGLE + 1, F.lit(1))
    need = F.greatest(F.ceil(threshold / (1 + threshold) * (item + window) - 1e-9), F.lit(1)).cast("int")

    def starts(p: Column, i: Column) -> Column:
        q = F.get("found", i + need - 1)
        first, last = F.greatest(F.lit(0), q - item + 1), F.least(p, F.greatest(F.lit(0), size - n))
        return F.when((q - p < item) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform("found", starts)))


def leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of each leaked item in each document.

    ``start`` counts words from 0; of equal windows that are looked at the first is given. Null and
    blank texts leak nothing, nor do items without words; an item, window or
    document of fewer than five words is one shingle, and a text shorter than an
    item is one window. Documents with null ids are treated as one; repeated rows give
    the same leaks once. Other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    items = written(items_of(benchmark), folder, "items")
    places = written(
        items.select("n", F.posexplode("item").alias("place", "h")).groupBy("h").agg(F.collect_set(F.struct("n", "place")).alias("at")),
        folder, "item_shingles",
    )
    # Lengths of items that are shorter than a shingle: four at most.
    short = sorted(r["n"] for r in items.filter(F.col("n") < SHINGLE).select("n").distinct().collect())
    small = places.count() <= BROADCAST_ROWS
    known = F.broadcast(places) if small else places
    texts = docs.select(F.col(id_col).alias("id"), words(F.col(text_col).cast("string")).alias("w")).filter(F.size("w") > 0)
    hits = texts.select("id", F.size("w").alias("size"), F.xxhash64(F.array_join("w", " ")).alias("key"), F.inline(lookups(F.col("w"), short))).join(known, "h")
    # Start of a window on the diagonal of the shared shingle, kept inside the text.
    diagonals = F.explode("at").alias("a")
    start = F.greatest(F.lit(0), F.least(F.col("size") - F.col("a.n"), F.col("pos") - F.col("a.place")))
    spots = written(
        hits.select("id", "key", "size", "pos", diagonals).select("id", "key", "size", "pos", F.col("a.n").alias("n"), start.alias("s")).distinct()
        .groupBy("id", "key", "size", "n").agg(F.array_sort(F.collect_set("pos")).alias("found"), F.array_sort(F.collect_set("s")).alias("starts")),
        folder, "spots",
    )
    windows = (
        spots.select("id", "key", "n", F.explode(F.array_intersect(between(), full(threshold))).alias("start"))
        .groupBy("id", "key").agg(F.collect_list(F.struct("n", "start")).alias("windows"))
    )
    windows = written(windows, folder, "windows")
    own = texts.withColumn("key", F.xxhash64(F.array_join("w", " ")))
    # Texts without windows stay where they are: only the others meet their windows.
    keys = windows.select("key").distinct()
    if windows.count() <= BROADCAST_KEYS:
        own = own.join(F.broadcast(keys), "key", "left_semi")
    own, asked = own.alias("t"), windows.alias("q")
    cut = own.join(asked, (F.col("t.key") == F.col("q.key")) & F.col("t.id").eqNullSafe(F.col("q.id"))).select(
        F.col("t.id").alias("id"), F.col("t.key").alias("key"), "w", F.explode("windows").alias("win")
    )
    prints = written(
        cut.select("id", "key", "win.*", shingles(F.slice("w", F.col("win.start") + 1, F.col("win.n"))).alias("window"))
        .withColumn("window_hash", simhash(F.col("window"))),
        folder, "prints",
    )
    # Fingerprints meet by themselves; the lists of hashes come back for pairs within the radius.
    flips = [m for m in range(1 << WIDTH) if m.bit_count() <= radius // BLOCKS]
    entered = items.select("item_id", "n", "item_hash").distinct().select("*", F.explode(blocks_of(F.col("item_hash"))).alias("b")).select(
        "item_id", "n", "item_hash", "b.block",
        F.explode(F.transform(F.array(*(F.lit(m).cast("bigint") for m in flips)), lambda m: m.bitwiseXOR(F.col("b.value")))).alias("value"),
    )
    # An entry is many times the size that is estimated from the items.
    few = items.count() * BLOCKS * len(flips) <= BROADCAST_ROWS
    met = (
        prints.select("n", "window_hash").distinct().select("*", F.explode(blocks_of(F.col("window_hash"))).alias("b"))
        .select("n", "window_hash", "b.block", "b.value")
        .join(F.broadcast(entered) if few else entered.hint("merge"), ["n", "block", "value"])
    )
    within = F.bit_count(F.col("window_hash").bitwiseXOR(F.col("item_hash"))) <= radius
    pairs = met.filter(within).select("n", "window_hash", "item_id", "item_hash").distinct()
    listed = items.select("item", F.col("item_id").alias("_item"), F.col("n").alias("_n"), F.col("item_hash").alias("_hash")).distinct()
    same = F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("n") == F.col("_n")) & (F.col("item_hash") == F.col("_hash"))
    candidates = prints.join(pairs.join(listed, same).drop("_item", "_n", "_hash"), ["n", "window_hash"])
    found = candidates.withColumn("similarity", similarity(F.col("window"), F.col("item"))).filter(F.col("similarity") >= threshold)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", (-F.col("b.back")).alias("start"), F.col("b.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    (leaky,) = unused(docs, "_leaky")
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias(leaky)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(leaky)), "left_anti")
