"""Near duplicates by a chosen-path join on five-word shingles.

Each text is the set of its shingles. A run splits all sets by a path of sampled
shared tokens: the path itself seeds the hash order of a node, which no other
node of any run uses, and every set goes to the child named by its smallest token
in that order, so two sets of similarity s stay together with probability s at
each step, whatever happened at other steps and in other runs. A node of few sets
is a leaf; others are split again, down to ``DEPTH`` steps. Leaves are compared
set by set. Runs are repeated until a pair at the threshold meets with the
target recall. What is still large at the last step holds texts that are alike;
it is compared whole, in tiles of bounded size.

Equal sets are one class from the start, so copies are never paired. Leaves with
the same members are compared once, and a pair counts in the first run that
brings it together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm import arrays
from pagewarden.llm.common import fitted, scratch, unused, written

SHINGLE = 5
FIRST, DEPTH = 2, 5  # steps before the first size test, and at most
LEAF = 128  # sets that are compared without another split
TILE = 512  # sets of one side of a tile
RECALL = 0.999  # chance that a pair at the threshold meets in some run


def n_runs(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**DEPTH))


def smallest(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Smallest hash of the tokens in the order of every seed."""
    least = np.full(len(seeds), np.uint64(2**64 - 1))
    factors = (arrays.mix(seeds) | np.uint64(1))[:, None]
    for at in range(0, len(tokens), 1 << 14):
        part = (tokens[None, at : at + (1 << 14)] ^ seeds[:, None]) * factors
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        np.minimum(least, part.min(axis=1), out=least)
    return least


def paths(sets: list[np.ndarray], runs: int) -> np.ndarray:
    """Node keys of each set: sets x runs x steps from FIRST to DEPTH."""
    roots = arrays.mix(np.arange(1, runs + 1, dtype=np.uint64))
    out = np.empty((len(sets), runs, DEPTH - FIRST + 1), np.uint64)
    for row, tokens in enumerate(sets):
        key = roots
        for step in range(1, DEPTH + 1):
            key = arrays.mix(key ^ arrays.mix(smallest(tokens, arrays.mix(key + np.uint64(step)))))
            if step >= FIRST:
                out[row, :, step - FIRST] = key
    return out


def _sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word counts and, one by one, the sorted shingle set of each text of a run of rows."""
    data, offsets = arrays.utf8(column)
    for first, last in arrays.runs(offsets):
        edges = offsets[first : last + 1]
        tokens, rows, count = arrays.shingles(data[edges[0] : edges[-1]], edges - edges[0], SHINGLE)
        cut = np.searchsorted(rows, np.arange(last - first + 1))
        yield first, count, [np.unique(tokens[a:b]) for a, b in zip(cut, cut[1:])]


def _signatures(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count, sets in _sets(batch.column("text")):
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                keys = paths(sets, runs).reshape(len(sets), -1).view(np.int64)
                flat = pa.array(keys.ravel())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]), flat)
                part = batch.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("k"), pa.array(names, pa.binary()), pa.array(count, pa.int64()), listed],
                    ["id", "k", "set_id", "words", "paths"],
                )

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Tokens shared by each pair of sets, by products of bounded blocks of columns."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = often[column] > 1
    rows, column = rows[useful], column[useful]
    place = np.cumsum(often > 1) - 1
    column = place[column]
    total = np.zeros((n, n), np.float32)
    by = np.argsort(column, kind="stable")
    rows, column = rows[by], column[by]
    width = 4096
    for at in range(0, int((often > 1).sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        dense = np.zeros((n, width), np.float32)
        dense[rows[a:b], column[a:b] - at] = 1
        total += dense @ dense.T
    return total.astype(np.int64)


def _compare(threshold: float):
    def tile(rows: list[tuple]) -> list[tuple]:
        run, first, second = rows[0][1], rows[0][2], rows[0][3]
        _, _, sets = _all_sets([r[6] for r in rows])
        sizes = np.array([len(s) for s in sets])
        shared = shared_counts(sets)
        near = shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
        np.fill_diagonal(near, False)
        block = np.array([r[4] for r in rows])
        if first != second:
            near &= block[:, None] != block[None, :]
        leaves = np.array([r[5] for r in rows], np.int64)
        for earlier in range(run):
            met = leaves[:, earlier]
            near &= ~((met[:, None] == met[None, :]) & (met[:, None] != 0))
        links = near.sum(axis=1)
        label = np.arange(len(rows))
        while True:
            least = np.where(near, label[None, :], len(rows)).min(axis=1)
            new = np.minimum(label, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return [(rows[i][7], rows[label[i]][7], int(links[i])) for i in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[tuple]):
            kinds = (pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], kinds[i]) for i in range(3)], ["set_id", "peer", "links"]
            )

        held: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("leaf", "run", "i", "j", "block", "leaves", "text", "set_id")]
            out = []
            for row in zip(*columns):
                if held and (row[0], row[2], row[3]) != (held[0][0], held[0][2], held[0][3]):
                    if len(held) > 1:
                        out += tile(held)
                    held = []
                held.append(row)
            yield emit(out)
        if len(held) > 1:
            yield emit(tile(held))

    return run


def _all_sets(texts: list[str | None]):
    sets = [s for _, _, part in _sets(pa.array(texts, pa.string())) for s in part]
    return None, None, sets


def components(edges: DataFrame, folder: str, rows: int | None = None) -> DataFrame:
    """(set_id, root) of every node of ``edges`` (a, b): smallest node that it reaches.

    Labels take the smallest label around, then jump to their label's label. Each
    round is written to the shared folder, and only counts come to the driver.
    ``rows``, about as many as there are edges, says how many tasks write them.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both if rows is None else fitted(both, rows), folder, "edges")
    n = both.count()
    start = both.groupBy(F.col("a").alias("set_id")).agg(F.min("b").alias("b")).select("set_id", F.least("set_id", "b").alias("root"))
    label = written(fitted(start, n), folder, "labels0")
    turn, moved = 0, 1
    while moved:
        turn += 1
        beside = fitted(both.join(label.withColumnRenamed("set_id", "b"), "b").select("a", "root"), n)
        around = beside.groupBy(F.col("a").alias("set_id")).agg(F.min("root").alias("near"))
        lower = fitted(label.join(around, "set_id").select("set_id", F.col("root").alias("was"), F.least("root", "near").alias("root")), n)
        jump = label.select(F.col("set_id").alias("root"), F.col("root").alias("far"))
        lower = lower.join(jump, "root", "left").select("set_id", "was", F.least("root", F.coalesce("far", "root")).alias("root"))
        label = written(fitted(lower, n), folder, f"labels{turn}")
        moved = label.filter("was <> root").limit(1).count()
        label = label.select("set_id", "root")
    return label


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, k, class_id, n_links, n_copies, first.

    class_id is the smallest id of all rows joined by links or by equal sets;
    n_links counts the different shingle sets that are alike; n_copies the rows
    of the same set; ``first`` marks the text (id and key k of its content) that
    stands for the class. A text of one to four words has one shingle, of all its
    words. Null, empty and blank texts have none and stay alone. Null ids lose
    against others and stay null where a class has no other; repeated rows share
    a class. Other columns are not looked at.
    """
    folder = scratch(docs.sparkSession)
    runs = n_runs(threshold, recall)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("k", text_key("text"))
    kind = dict(texts.dtypes)["id"]
    signed = written(
        texts.mapInArrow(_signatures(runs), f"id {kind}, k binary, set_id binary, words long, paths array<long>"),
        folder, "signed",
    )
    rows = signed.select("id", "k", "set_id", "words")
    sets = (
        signed.filter("words > 0").groupBy("set_id")
        .agg(F.min("k").alias("k"), F.first("paths").alias("paths"))
    )
    steps = DEPTH - FIRST + 1
    split = written(
        sets.select("set_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.slice("paths", r * steps + 1, F.lit(steps)))).alias("run", "p")),
        folder, "paths",
    )
    leaves = None
    for step in range(steps):
        node = F.xxhash64("run", F.lit(step), F.col("p")[step])
        here = split.withColumn("leaf", node)
        counted = here.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        here = written(here.join(counted, "leaf"), folder, f"nodes{step}")
        last = step == steps - 1
        done = here.select("leaf", "run", "set_id", "n") if last else here.filter(F.col("n") <= LEAF).select("leaf", "run", "set_id", "n")
        leaves = done if leaves is None else leaves.unionByName(done)
        split = here.filter(F.col("n") > LEAF).select("set_id", "run", "p")
    members = leaves.groupBy("leaf").agg(
        F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("y"),
        F.first("run").alias("run"), F.first("n").alias("n"),
    )
    kept = members.groupBy("x", "y", "n").agg(F.min(F.struct("run", "leaf")).alias("at")).select(F.col("at.leaf").alias("leaf"))
    listed = written(leaves.join(kept.withColumn("kept", F.lit(True)), "leaf", "left"), folder, "leaves")
    asked = listed.groupBy("set_id").agg(
        F.map_from_entries(F.collect_list(F.struct("run", "leaf"))).alias("by_run")
    ).select("set_id", F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.element_at("by_run", r), F.lit(0).cast("long"))).alias("leaves"))
    fetched = written(
        texts.select("k", "text").join(asked.join(sets.select("set_id", "k"), "set_id"), "k")
        .groupBy("set_id").agg(F.first("text").alias("text"), F.first("leaves").alias("leaves")),
        folder, "texts",
    )
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    block = F.pmod(F.xxhash64("set_id", "leaf"), blocks).cast("int")
    tiles = (
        listed.filter("kept").select("leaf", "run", "set_id", block.alias("block"), blocks.alias("blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leaf", "run", "set_id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(fetched, "set_id")
    )
    parts = max(8, min(20_000, listed.count() // 2_000))
    found = written(
        tiles.repartition(parts, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
        .mapInArrow(_compare(threshold), "set_id binary, peer binary, links long"),
        folder, "links",
    )
    roots = components(found.select(F.col("set_id").alias("a"), F.col("peer").alias("b")), folder)
    links = found.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    per_set = rows.filter("words > 0").groupBy("set_id").agg(F.count(F.lit(1)).alias("n_copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("best"))
    facts = written(
        per_set.join(links, "set_id", "left").join(roots, "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id")).fillna(0, ["n_links"]),
        folder, "facts",
    )
    best = facts.groupBy("root").agg(F.min("best").alias("least"))
    facts = facts.join(best, "root").select("set_id", "n_links", "n_copies", F.col("least.id").alias("class_id"), F.col("least.k").alias("class_k"))
    out = rows.join(facts, "set_id", "left")
    alone = F.col("words") == 0
    return out.select(
        F.col("id").alias(id_col), "k",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        (alone | (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("k") == F.col("class_k")))).alias("first"),
    )


def text_key(column: str):
    """MD5 of a text, all 128 bits: texts are told apart by it alone. Null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit(""))))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class; texts without words all stay."""
    found = near_duplicates(docs, **options)
    own, i, k = unused(docs, "_key", "_i", "_k")
    gone = found.filter("not first").select(F.col("doc_id").alias(i), F.col("k").alias(k)).distinct()
    left = docs.withColumn(own, text_key("text"))
    kept = left.join(gone, (F.col(own) == F.col(k)) & F.col("doc_id").eqNullSafe(F.col(i)), "left_anti")
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Repeated rows of a text that stays: one of them.
    return kept.filter(~blank).dropDuplicates([own]).unionByName(kept.filter(blank)).drop(own)
