"""Line deduplication within one word edit, by deletion neighbourhoods.

A line is a sequence of words. Its neighbourhood is the line itself and the line
without each one of its words; two lines are one word edit apart exactly when
the neighbourhoods share a variant in one of three ways: both lack the same
place (a word replaced), or one is whole and the other lacks a word (a word more
or less). Variants are joined by their hash. For each variant only the earliest
whole line and the earliest line for each missing place are kept, so no pair of
lines is formed within a group.

Lines of every length that are equal in their words are found by their hash.
Only lines that can have a neighbour get variants: one edit leaves the first or
the second half of a line as it was, so lines are first counted by hashes of
their halves. That test loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm import arrays
from pagewarden.llm.common import scratch, unused, words, written

VARIANTS = 200_000  # variants of a task, about
MIN_WORDS = 5  # shorter lines only count as equal or not: one edit would leave less than 0.8 of them


def _pair(*parts: Column) -> list[Column]:
    """Two independent 64-bit hashes, as one 128-bit key."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]


def _numbers(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _halves(w: Column) -> Column:
    """Hashes of both halves, cut as for the own number of words and for one less."""
    def keys(m: Column) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        first = F.xxhash64(F.lit("first"), m, F.slice(w, F.lit(1), h))
        n = m - h
        return [first, F.xxhash64(F.lit("rest"), m, F.slice(w, F.size(w) - n + 1, n))]

    return F.array(*keys(F.size(w)), *keys(F.size(w) - 1))


def within(a: list[str], b: list[str], bound: int) -> bool:
    """True if the word edit distance is at most ``bound``."""
    if abs(len(a) - len(b)) > bound:
        return False
    row = {j: j for j in range(min(len(b), bound) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - bound), min(len(b), i + bound) + 1):
            if j == 0:
                new[j] = i
                continue
            new[j] = min(
                row.get(j, bound + 1) + 1, new.get(j - 1, bound + 1) + 1,
                row.get(j - 1, bound + 1) + (x != b[j - 1]),
            )
        row = new
    return row.get(len(b), bound + 1) <= bound


def neighbourhood(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of each variant: place 0 is the whole line, place i lacks word i.

    ``offsets`` cut ``values`` into lines. Two running sums give the words before
    and behind each place, so a variant costs the same however long its line is.
    """
    size = np.diff(offsets)
    up, down = arrays.powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:], dtype=np.uint64)
    row = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(row)) - np.repeat(offsets[:-1] + np.arange(len(size)), size + 1)
    first, last = offsets[:-1][row], offsets[1:][row]
    at = first + np.maximum(place - 1, 0)
    less = place > 0
    head = (total[np.where(less, at, last)] - total[first]) * down[first]
    tail = np.where(less, (total[last] - total[np.minimum(at + 1, last)]) * down[np.minimum(first + 1, len(values))], np.uint64(0))
    length = (last - first - less).astype(np.uint64)
    return row, place, arrays.mix(head + tail + length * np.uint64(0x9E3779B97F4A7C15))


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        listed = batch.column("v")
        values = np.asarray(listed.flatten()).view(np.uint64)
        row, place, key = neighbourhood(values, np.concatenate([[0], np.cumsum(np.asarray(listed.value_lengths()))]).astype(np.int64))
        for at in range(0, len(row), 50_000):
            part = slice(at, at + 50_000)
            own = batch.select(["h1", "h2", "at"]).take(pa.array(row[part]))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(place[part].astype(np.int32)), pa.array(key[part].view(np.int64))], ["h1", "h2", "at", "place", "v1"]
            )


def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within(list(x), list(y), 1) for x, y in zip(a, b)], dtype=bool)


def _order(id_column: Column, key: Column, line: Column) -> Column:
    return F.struct(id_column.isNull().alias("none"), id_column.alias("id"), key.alias("k"), line.alias("line"))


def _key(text: str | Column) -> Column:
    """MD5 of a text, all 128 bits: tells rows of one id apart."""
    return F.unhex(F.md5(text))


def duplicate_lines(docs: DataFrame, folder: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, k, gone): line numbers of each text of an id that an earlier line makes superfluous.

    ``docs`` has id, k, a key of the text, and text. Lines are judged on the
    input, in the order of id (nulls last), k and line number.
    """
    # Words are hashed once for each line; whatever else is hashed is made of those numbers.
    line = F.explode(
        F.transform(F.split("text", "\n"), lambda s, i: F.struct(i.alias("line"), _numbers(words(s)).alias("w")))
    )
    lines = docs.select("id", "k", line.alias("l")).filter(F.size("l.w") > 0)
    h1, h2 = _pair(F.col("l.w"))
    halves = F.when(F.size("l.w") >= min_words, _halves(F.col("l.w")))  # null: no variants
    lines = written(
        lines.select("id", "k", F.col("l.line").alias("line"), h1.alias("h1"), h2.alias("h2"), halves.alias("halves")),
        folder, "lines",
    )
    distinct = written(
        lines.groupBy("h1", "h2").agg(F.min(_order(F.col("id"), F.col("k"), F.col("line"))).alias("at"), F.first("halves").alias("halves")),
        folder, "distinct",
    )
    halves = distinct.select("h1", "h2", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half")
    maybe = distinct.select("h1", "h2", "at").join(halves.join(shared, "half").select("h1", "h2").distinct(), ["h1", "h2"])
    wanted = maybe.groupBy(F.col("at.id").alias("id"), F.col("at.k").alias("k")).agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "h1", "h2")).alias("wanted"))
    left, right = docs.alias("d"), wanted.alias("w")
    cut = left.join(right, (F.col("d.k") == F.col("w.k")) & F.col("d.id").eqNullSafe(F.col("w.id"))).select(
        F.col("d.id").alias("id"), F.col("d.k").alias("k"), F.split("d.text", "\n").alias("split"), F.explode("w.wanted").alias("m")
    )
    near = cut.select(
        "m.h1", "m.h2", _order(F.col("id"), F.col("k"), F.col("m.line")).alias("at"), words(F.get("split", F.col("m.line"))).alias("w")
    )
    near = near.withColumn("v", _numbers(F.col("w")))
    near = written(near.filter(_pair(F.col("v"))[0] == F.col("h1")).dropDuplicates(["h1", "h2"]), folder, "near")
    # Long lines come spread: a task gets about VARIANTS of them.
    many = near.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    kind = dict(near.dtypes)["at"]
    variants = written(
        near.select("h1", "h2", "at", "v").repartition(max(8, many // VARIANTS))
        .mapInArrow(_neighbourhoods, f"h1 long, h2 long, at {kind}, place int, v1 long"),
        folder, "variants",
    )
    # Most variants are met by no other: they are counted by their hash alone, and the rest goes no further.
    twice = variants.groupBy("v1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("v1")
    variants = written(variants.join(twice, "v1", "left_semi"), folder, "met")
    least = F.min(F.struct("at", "h1", "h2"))
    by_place = written(variants.groupBy("v1", "place").agg(least.alias("same")), folder, "places")
    by_variant = written(
        by_place.groupBy("v1").agg(
            F.min(F.when(F.col("place") == 0, F.col("same"))).alias("whole"),
            F.min(F.when(F.col("place") > 0, F.col("same"))).alias("less"),
        ),
        folder, "shared",
    )
    met = variants.join(by_variant, ["v1"]).join(by_place, ["v1", "place"])
    partner = F.when(F.col("place") == 0, F.col("less")).otherwise(F.least("same", "whole"))
    pairs = (
        met.withColumn("p", partner).filter(F.col("p.at") < F.col("at"))
        .groupBy("h1", "h2").agg(F.min("p").alias("p"))
        .select("h1", "h2", F.col("p.h1").alias("g1"), F.col("p.h2").alias("g2"))
    )
    texts = near.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("w").alias("other"))
    verified = (
        pairs.join(near.select("h1", "h2", "w"), ["h1", "h2"]).join(texts, ["g1", "g2"])
        .filter(F.pandas_udf(_verified, "boolean")("w", "other")).select("h1", "h2", F.lit(True).alias("near"))
    )
    verdict = written(
        distinct.select("h1", "h2", "at").join(verified, ["h1", "h2"], "left"), folder, "verdict"
    )
    gone = lines.select("id", "k", "line", "h1", "h2").join(verdict, ["h1", "h2"]).filter(
        F.coalesce("near", F.lit(False)) | (_order(F.col("id"), F.col("k"), F.col("line")) != F.col("at"))
    )
    return gone.groupBy("id", "k").agg(F.collect_set("line").alias("gone"))


def drop_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", into: str = "_lines"
) -> DataFrame:
    """``docs`` with a struct column ``into``: text, n_lines, n_removed.

    A line (between newlines) goes if an earlier line of any document is equal in
    its words or, where both have ``min_words`` words or more, one word edit away.
    Lines without words stay. Null and empty texts have no such line and stay as they are. Null
    ids come last in the order. Rows of one id, or of the null id, are kept apart
    by a 128-bit digest of their text, and stand in its order; rows that repeat
    both are one document, and keep and lose the same lines. A column that is called
    ``into`` is replaced; all others pass through.
    """
    folder = scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    rows = rows.withColumn("k", _key("text"))
    gone_id, gone_k, listed, own_k = unused(docs, "_gone_id", "_gone_k", "_gone", "_own_k")
    gone = duplicate_lines(rows, folder, min_words).select(F.col("id").alias(gone_id), F.col("k").alias(gone_k), F.col("gone").alias(listed))
    split = F.split(F.col(text_col), "\n")
    none = F.coalesce(listed, F.array().cast("array<int>"))
    text = F.when(F.size(none) == 0, F.col(text_col)).otherwise(
        F.array_join(F.filter(split, lambda s, i: ~F.array_contains(none, i)), "\n")
    )
    own = docs.withColumn(own_k, _key(F.col(text_col).cast("string")))
    return own.join(gone, (F.col(own_k) == F.col(gone_k)) & F.col(id_col).eqNullSafe(F.col(gone_id)), "left").withColumn(
        into,
        F.struct(text.alias("text"), F.coalesce(F.size(split), F.lit(0)).alias("n_lines"), F.size(none).alias("n_removed")),
    ).drop(gone_id, gone_k, listed, own_k)


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """Documents with the lines gone; a document that loses all its words goes too.

    A column n_chars follows the text, where there is one.
    """
    (into,) = unused(docs, "_lines")
    out, lines = drop_lines(docs, into=into), F.col(into)
    out = out.filter((lines["n_removed"] == 0) | lines["text"].rlike(r"[^\x20\x09-\x0D]")).withColumn("text", lines["text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lines["n_removed"] > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(into)


def brute_force(rows: list[tuple[int, str | None]], min_words: int = MIN_WORDS, by_text: bool = False) -> dict:
    """Line numbers that go of each id, or of each (id, text), by comparing every pair of lines, for tests."""
    lines = []
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            w = [x for x in line.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
            if w:
                lines.append(((i is None, i or 0, hashlib.md5(text.encode()).digest(), n), w, text))
    out: dict = {}
    for at, w, text in lines:
        if any(o < at and (w == v or min(len(w), len(v)) >= min_words and within(w, v, 1)) for o, v, _ in lines):
            i = None if at[0] else at[1]
            out.setdefault((i, text) if by_text else i, []).append(at[3])
    return out
