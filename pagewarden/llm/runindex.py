"""Removal of byte strings that start in more than one place, by run-length indexes.

Texts are routed first. Every 200-byte window names an anchor: the smallest
hashed 32-byte string inside it. Equal windows name equal anchors, so windows
with different anchors never have to meet. The windows of one anchor in one
text lie side by side and form a context of at most 368 bytes. Anchors that
occur once drop out; equal contexts are counted and kept once.

The contexts left over are indexed by blocks of whole anchor groups: a suffix
order gives the Burrows-Wheeler transform, the transform is cut into runs, and
match lengths are computed at run ends only. Between two run ends the length of
the longest match elsewhere falls by one a byte, so one pass over the text
streams the matching statistics from the samples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm import arrays
from pagewarden.llm.common import scratch, written

SEED = 32  # bytes of an anchor
BLOCK = (1 << 20) - 2  # bytes of an index block; sort keys hold 20 bits a rank
GROUP = 2_500  # contexts of an anchor that one block holds; larger groups are cut finer
LONG_TEXT = 4 << 20  # windows of a longer text are handled in pieces


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, first byte, last byte); long texts in overlapping pieces."""
    for first, last in arrays.runs(offsets):
        begin, end = int(offsets[first]), int(offsets[last])
        if last - first > 1 or end - begin <= LONG_TEXT:
            yield first, last, begin, end
            continue
        while begin + length <= end:
            yield first, last, begin, min(end, begin + LONG_TEXT + length - 1)
            begin += LONG_TEXT


def anchor_runs(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int):
    """Anchor, first and last window, anchor hash and context hash of each run of windows.

    ``starts`` and ``ends`` bound the texts inside ``data``.
    """
    width = length - SEED + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    total = arrays.prefix_hash(data)
    places = np.arange(len(data) - SEED + 1)
    hashes = arrays.span_hash(total, places, places + SEED)
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | places.astype(np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    inside = np.zeros(len(least) + 1, np.int64)
    long_enough = ends - starts >= length
    np.add.at(inside, starts[long_enough], 1)
    np.add.at(inside, ends[long_enough] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside)[:-1])
    anchor = (least[window] & low).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)][: len(anchor)])
    first = window[heads]
    last = window[np.r_[heads[1:] - 1, len(window) - 1][: len(heads)]]
    anchor = anchor[heads]
    return anchor, first, last, hashes[anchor], arrays.span_hash(total, first, last + length)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            data, offsets = arrays.utf8(batch.column(1))
            for first, last, begin, end in _pieces(offsets, length):
                starts = np.maximum(offsets[first:last], begin) - begin
                ends = np.minimum(offsets[first + 1 : last + 1], end) - begin
                anchor, lo, hi, seed, context = anchor_runs(data[begin:end], ends, starts, length)
                row = np.searchsorted(starts, lo, side="right") - 1
                in_text = lo + begin - offsets[first + row]
                place = (in_text << 16) | ((hi - lo) << 8) | (anchor - lo)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(first + row)), *(pa.array(x) for x in (place, seed.view(np.int64), context.view(np.int64)))],
                    ["k", "place", "ah", "ch"],
                )

    return run


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a block by prefix doubling on packed sort keys."""
    n = len(text)
    index = np.arange(n, dtype=np.uint64)
    mask, twenty, forty = np.uint64((1 << 20) - 1), np.uint64(20), np.uint64(40)
    key = np.zeros(n, np.uint64)
    padded = np.r_[text, np.zeros(5, np.uint8)].astype(np.uint64)
    for k in range(5):
        key = (key << np.uint64(8)) | padded[k : n + k]
    packed, depth = (key << twenty) | index, 5
    while True:
        packed.sort()
        order = (packed & mask).astype(np.int64)
        key = packed >> twenty
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.uint64)
        if depth > 1024 or int(group[-1]) == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = group
        later = np.zeros(n, np.uint64)
        later[: max(n - depth, 0)] = rank[depth:] + np.uint64(1)
        packed, depth = (rank << forty) | (later << twenty) | index, depth * 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int = 1024) -> np.ndarray:
    """Length of the common prefix of the suffixes at each pair of places."""
    padded = np.r_[text, np.zeros(16, np.uint8)]
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    n = len(text)
    found = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for _ in range(limit // 8):
        x, y = a[active] + found[active], b[active] + found[active]
        same = np.minimum(n - np.maximum(x, y), 8)
        equal = words[np.minimum(x, n)] == words[np.minimum(y, n)]
        run = np.where(equal.all(axis=1), 8, equal.argmin(axis=1))
        run = np.clip(np.minimum(run, same), 0, 8)
        found[active] += run
        active = active[run == 8]
        if not len(active):
            break
    return found


def matching_statistics(text: np.ndarray) -> np.ndarray:
    """Longest match elsewhere of every suffix of ``text``, from samples at run ends."""
    order = suffix_order(text)
    before = text[order - 1].astype(np.int16)  # the transform
    before[order == 0] = 256  # nothing stands before the first byte
    cut = np.flatnonzero(before[1:] != before[:-1])
    if not len(cut):  # one run: its two ends are still run ends
        cut = np.array([0, len(text) - 2])[: max(len(text) - 1, 0)]
    shared = common_prefix(text, order[cut], order[cut + 1])
    sample = np.zeros(len(text), np.int64)
    np.maximum.at(sample, order[cut], shared)
    np.maximum.at(sample, order[cut + 1], shared)
    place = np.arange(len(text))
    return np.maximum(np.maximum.accumulate(sample + place) - place, 0)


def _marks(length: int):
    """Repeated spans of the contexts of one partition, index block by index block."""

    def block(rows: list[tuple]) -> list[tuple]:
        parts = []
        for row in rows:
            parts += [np.frombuffer(row[4], np.uint8), np.array([255], np.uint8)]
        stats = matching_statistics(np.concatenate(parts))
        found, at = [], 0
        for _, k, lo, windows, content, n in rows:
            if n == 1:
                hit = np.flatnonzero(np.diff(np.r_[0, stats[at : at + windows] >= length, 0]))
                found += [(k, lo + int(s), lo + int(e) - 1 + length) for s, e in zip(hit[::2], hit[1::2])]
            at += len(content) + 1
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups, then the rows of the group that is being read
        size, group, opened = 0, None, 0
        kind = pa.binary()

        def emit(rows: list[tuple]):
            spans = block(rows) if rows else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[i] for s in spans], t) for i, t in enumerate((kind, pa.int64(), pa.int64()))], ["k", "start", "end"]
            )

        for batch in batches:
            kind = batch.column("k").type
            columns = [batch.column(c).to_pylist() for c in ("ah", "k", "lo", "windows", "bytes", "n")]
            for row in zip(*columns):
                if row[0] != group:
                    group, opened = row[0], len(held)
                size += len(row[4]) + 1
                held.append(row)
                if size > BLOCK and opened:
                    yield from emit(held[:opened])
                    held = held[opened:]
                    size, opened = sum(len(r[4]) + 1 for r in held), 0
        yield from emit(held)

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ah, k, lo, n, content in zip(*(batch.column(c).to_pylist() for c in ("ah", "k", "lo", "n", "bytes"))):
                data = np.frombuffer(content, np.uint8)
                at = np.arange(len(data) - length + 1)
                value = arrays.span_hash(arrays.prefix_hash(data), at, at + length).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), ah)), pa.array(value), pa.repeat(pa.scalar(k, batch.column("k").type), len(at)),
                     pa.array(at + lo), pa.array(np.full(len(at), n))],
                    ["ah", "w", "k", "start", "n"],
                )

    return run


def _slices(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for k, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "wanted"))):
                data = text.encode()
                for w in wanted:
                    lo, more = w["place"] >> 16, (w["place"] >> 8) & 255
                    row = (w["ah"], k, lo, w["n"], w["hot"], more + 1, data[lo : lo + more + length])
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64(), batch.column("k").type, pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["ah", "k", "lo", "n", "hot", "windows", "bytes"]
            )

    return run


def repeated_spans(texts: DataFrame, length: int, folder: str) -> DataFrame:
    """(k, start, end): byte spans covered by windows that start elsewhere too.

    ``texts`` has k, a key of the text's content, and text. Each span comes once,
    however many rows share a text.
    """
    kind = dict(texts.dtypes)["k"]
    found = written(texts.mapInArrow(_anchors(length), f"k {kind}, place long, ah long, ch long"), folder, "anchors")
    often = found.groupBy("ah").agg(F.count(F.lit(1)).alias("total")).filter("total > 1").select("ah")
    # Written, so that the join has an exchange of its own on both sides and a hot anchor can be split.
    repeated = written(found.join(written(often, folder, "often"), "ah"), folder, "repeated")
    contexts = written(
        repeated.groupBy("ah", "ch").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "place")).alias("at")
        ),
        folder, "contexts",
    )
    equal = repeated.join(contexts.filter("n > 1").select("ah", "ch"), ["ah", "ch"]).select(
        "k", F.shiftright("place", 16).alias("start"),
        (F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(F.lit(255)) + length).alias("end"),
    )
    groups = contexts.groupBy("ah").agg(F.count(F.lit(1)).alias("d")).filter("d > 1")
    wanted = (
        contexts.join(groups, "ah")
        .groupBy(F.col("at.k").alias("k"))
        .agg(F.collect_list(F.struct("ah", "n", F.col("at.place").alias("place"), (F.col("d") > GROUP).alias("hot"))).alias("wanted"))
    )
    sliced = texts.join(wanted, "k").mapInArrow(
        _slices(length), f"ah long, k {kind}, lo long, n long, hot boolean, windows int, bytes binary"
    )
    # Equal texts give the same slices: one of each is kept, before the exchange too.
    sliced = written(
        sliced.groupBy("ah", "k", "lo").agg(*(F.first(c).alias(c) for c in ("n", "hot", "windows", "bytes"))),
        folder, "slices",
    )
    rows = sliced.count()
    parts = max(8, min(20_000, rows * 300 // (4 << 20)))
    indexed = (
        sliced.filter("not hot").repartition(parts, "ah").sortWithinPartitions("ah", "k", "lo")
        .mapInArrow(_marks(length), f"k {kind}, start long, end long")
    )
    # The exact way for groups beyond a block: every window counted by its own hash.
    windows = sliced.filter("hot").mapInArrow(_windows(length), f"ah long, w long, k {kind}, start long, n long")
    twice = windows.groupBy("ah", "w").agg(F.sum("n").alias("total")).filter("total > 1").select("ah", "w")
    cut = windows.join(twice, ["ah", "w"]).select("k", "start", (F.col("start") + length).alias("end"))
    # Copies of a text give the same spans: they go before the exchange, and a text has no more spans than bytes.
    return equal.unionByName(indexed).unionByName(cut).distinct()


def kept_text(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """Remaining bytes, removed bytes, and maximal removed runs."""
    if not len(starts):
        return data, 0, 0
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    head = np.r_[True, starts[1:] > reach[:-1]]
    first, last = starts[head], reach[np.r_[np.flatnonzero(head)[1:] - 1, len(starts) - 1]]
    edges = [0, *np.stack([first, last], 1).ravel().tolist(), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return kept, int((last - first).sum()), len(first)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        spans = []
        for name in ("starts", "ends"):
            column = batch.column(name)
            values = column.values.to_numpy(zero_copy_only=False)
            edges = column.offsets.to_numpy()
            spans.append([values[a:b] if ok else none for a, b, ok in zip(edges, edges[1:], column.is_valid().to_pylist())])
        for text, starts, ends in zip(batch.column("text").to_pylist(), *spans):
            data = (text or "").encode()
            kept, gone, runs = kept_text(data, starts, ends)
            for column, value in zip(out, (len(data), gone, runs, kept)):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text without the bytes that a repeated ``length``-byte string covers.

    Returns one row per input row: the id, n_bytes, n_removed, n_spans and kept
    (binary: the remaining bytes; cutting may split a code point). Bytes are
    UTF-8; a null text is empty; texts shorter than ``length`` are returned
    whole; equal texts remove each other entirely; null ids and repeated ids are
    kept apart by their texts; other columns are not looked at. Texts are told
    apart by all 128 bits of their MD5 and all bytes of the match are compared inside
    index blocks.
    """
    if not SEED <= length <= SEED + 255:
        raise ValueError(f"length must be from {SEED} to {SEED + 255}")
    folder = scratch(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    ).withColumn("k", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    spans = repeated_spans(texts.filter(F.octet_length("text") >= length).select("k", "text"), length, folder)
    listed = spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    joined = texts.join(listed, "k", "left").select("id", "text", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    kind = dict(texts.dtypes)["id"]
    return joined.mapInArrow(
        _assemble, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    ).withColumnRenamed("id", id_col)


def brute_force(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    """The same by a dictionary of all windows, for tests."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
