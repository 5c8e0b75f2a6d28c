"""Near duplicates by HyperMinHash registers.

The hashes of a text's five-word shingles are dealt to ``BUCKETS`` buckets by their
first bits. Of the smallest rest in a bucket a register keeps the number of
leading zeros (6 bits) and the bits behind the leading one (``MANTISSA``): 16
bits in place of 56. An empty bucket takes the register of another bucket, tried
in an order of its own. Bands of ``ROWS`` registers that agree bring texts
together; the share of equal registers, less the share expected by chance, says
which pairs are worth a look; those are confirmed on their full shingle sets.

Equal sets are one from the start. Buckets of equal bands are linked to clusters.
A cluster that fits in a tile is compared in one task. A larger one is dealt to
blocks, each compared within itself and with ``HUBS`` sets of the cluster, which
joins what is alike in one pass; then only the bands that still hold several
components are compared, the sets outside the band's largest component against
the others; a pair counts in the first of its bands only. In a tile pairs are
skipped once they are connected, so that a tile of n sets gives less than n links.

Graphs are kept small: clusters are found among the hubs of bands, each set with
its smallest hub; a tile's links lead to the smallest member of what it joins; and
the last links are between components, no longer between sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm import arrays
from pagewarden.llm.chosenpath import components, text_key
from pagewarden.llm.common import fitted, scratch, written

SHINGLE = 5
BUCKETS, MANTISSA = 256, 10
ROWS, BANDS = 6, 42  # a pair at 0.85 shares no band with probability 3e-9
SLACK = 0.2  # pairs whose estimate is this much below the threshold are not confirmed
TILE = 512  # sets of one side of a tile
TILE_SHINGLES = 1 << 21  # and their shingles, about
HUBS = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(11)
_TRIES = np.array([_rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def registers(tokens: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of 64-bit hashes that is not empty."""
    heads = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)
    at = np.searchsorted(tokens, heads)
    last = np.append(at[1:], len(tokens))
    full = at < last
    rest = (tokens[np.minimum(at, len(tokens) - 1)] & np.uint64((1 << 56) - 1)) >> np.uint64(3)
    bits = np.frexp(rest.astype(np.float64))[1]  # exact: 53 bits
    up = np.maximum(0, MANTISSA + 1 - bits).astype(np.uint64)
    down = np.maximum(0, bits - MANTISSA - 1).astype(np.uint64)
    mantissa = ((rest << up) >> down) & np.uint64((1 << MANTISSA) - 1)
    out = ((53 - bits) << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    empty = np.flatnonzero(~full)
    if len(empty):
        tries = _TRIES[empty]
        out[empty] = out[tries[np.arange(len(empty)), full[tries].argmax(1)]]
    return out


def chance(size: int) -> float:
    """Probability that the registers of two unrelated sets of ``size`` shingles agree."""
    per = max(1.0, size / BUCKETS)
    level = 2.0 ** -np.arange(1, 54)[:, None]
    low = level * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))[None, :]
    cell = (1 - low) ** per - np.maximum(0, 1 - low - level / (1 << MANTISSA)) ** per
    return float((cell**2).sum())


def estimates(left: np.ndarray, right: np.ndarray, by_chance: float) -> np.ndarray:
    """Jaccard estimates of one register row against many, corrected for chance agreement."""
    return ((right == left).mean(1) - by_chance) / (1 - by_chance)


def _sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and sorted shingle sets of runs of rows, A-Z lower-cased."""
    data, offsets = arrays.utf8(texts)
    for first, last in arrays.runs(offsets):
        edges = offsets[first : last + 1]
        tokens, rows, _ = arrays.shingles(_LOWER[data[edges[0] : edges[-1]]], edges - edges[0], SHINGLE)
        cut = np.searchsorted(rows, np.arange(last - first + 1))
        yield first, [np.unique(tokens[a:b]) for a, b in zip(cut, cut[1:])]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _sets(batch.column("text")):
            part = batch.slice(first, len(sets))
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            signs = [registers(s).tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("k"), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs, pa.binary())],
                ["id", "k", "set_id", "size", "registers"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.frombuffer(r, np.uint16) for r in batch.column("registers").to_pylist()])
        rows = rows[:, : ROWS * BANDS].reshape(len(rows), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(arrays.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2]).copy()
        for k in range(ROWS):
            key = arrays.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
        who = pa.array(np.repeat(np.arange(len(rows)), BANDS))
        index = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(rows)))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), index, batch.column("set_id").take(who)], ["band", "index", "set_id"])


def _links(rows: list[tuple], threshold: int) -> list[tuple]:
    """Links that connect what is alike in a tile; each row is (side, label, set_id, index, registers, text).

    Sides other than 0 are compared with every row, rows of side 0 with the others only. ``index`` is
    that of the band the rows share: pairs that agree in an earlier band are left to it. Without one
    (below 0) all pairs count. A link is (smallest member, member) of what is joined; members are labels,
    where rows have them, else set ids.
    """
    sets = [s for _, part in _sets(pa.array([r[5] for r in rows], pa.string())) for s in part]
    sizes = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    marked = np.zeros(len(names), bool)
    signs = np.stack([np.frombuffer(r[4], np.uint16) for r in rows])
    side, index = np.array([r[0] for r in rows]), rows[0][3]
    by_chance: dict[int, float] = {}
    members = [r[2] if r[1] is None else r[1] for r in rows]
    first: dict = {}
    group = np.array([first.setdefault(m, n) for n, m in enumerate(members)])
    joined = set()
    for i in np.flatnonzero(side != 0):
        others = np.flatnonzero(((side == 0) | (np.arange(len(rows)) > i)) & (group != group[i]))
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i])]
        level = int(sizes[i]).bit_length()
        if level not in by_chance:
            by_chance[level] = chance(1 << level)
        others = others[estimates(signs[i], signs[others], by_chance[level]) >= threshold / 100 - SLACK]
        if index >= 0:
            agree = (signs[others] == signs[i])[:, : ROWS * BANDS].reshape(len(others), BANDS, ROWS).all(2)
            others = others[agree.argmax(1) == index]
        if not len(others):
            continue
        marked[own[i]] = True
        ends = np.cumsum(sizes[others])
        shared = np.add.reduceat(marked[np.concatenate([own[j] for j in others])], ends - sizes[others], dtype=np.int64)
        marked[own[i]] = False
        for j in others[100 * shared >= threshold * (sizes[others] + sizes[i] - shared)]:
            if group[i] != group[j]:
                joined |= {int(i), int(j)}
                group[group == group[j]] = group[i]
    alike: dict[int, set] = {}
    for n in joined:
        alike.setdefault(int(group[n]), set()).add(members[n])
    return [(least, x) for some in alike.values() for least in [min(some)] for x in some if x != least]


def _tiles(threshold: int):
    """Rows sorted by tile to confirmed links; each set of a tile counts once, a tile has one index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        held, tile = {}, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "label", "set_id", "index", "registers", "text"))):
                if row[0] != tile:
                    if len(held) > 1:
                        out += _links(list(held.values()), threshold)
                    held, tile = {}, row[0]
                if row[3] not in held or row[1] > held[row[3]][0]:
                    held[row[3]] = row[1:]
            yield emit(out)
        if len(held) > 1:
            yield emit(_links(list(held.values()), threshold))

    return run


def _blocks(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / TILE)).cast("int")


def _compared(rows: DataFrame, fetched: DataFrame, threshold: int, folder: str, name: str) -> DataFrame:
    """Links within the tiles of ``rows`` (tile, side, label, set_id, index)."""
    dealt = rows.join(fetched.select("set_id", "registers", "text"), "set_id")
    return written(
        dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(threshold), "a binary, b binary"), folder, name
    )


def near_duplicates(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    A-Z are lower-cased. Texts are linked where their shingle sets share
    ``threshold`` percent or more of their union. component_id is the smallest id
    that links and equal sets reach; kept says whether that is the row's own.
    Texts of one to four words are one shingle. Null, empty and blank texts have
    none, and are linked with nothing. Null ids lose against others, and stay
    where a component has no other (kept is then true). Repeated rows share all
    results. Other columns are not looked at; an empty table gives no rows.
    """
    folder = scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("k", text_key("text"))
    kind = dict(texts.dtypes)["id"]
    signed = written(
        texts.mapInArrow(_sign, f"id {kind}, k binary, set_id binary, size long, registers binary"), folder, "signed"
    )
    # With fewer shingles than this only equal sets reach the threshold.
    least = 100 // (100 - threshold) if threshold < 100 else 1 << 62
    sets = (
        signed.filter(F.col("size") >= least).groupBy("set_id")
        .agg(F.min("k").alias("k"), F.first("size").alias("size"), F.first("registers").alias("registers"))
    )
    many = signed.count()
    banded = fitted(sets.select("set_id", "registers"), many).mapInArrow(_bands, "band long, index int, set_id binary")
    shared = banded.groupBy("band", "index").agg(
        F.count(F.lit(1)).alias("n"), F.min("set_id").alias("hub"),
        F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("y"),
    ).filter("n > 1")
    # Bands with the same members are looked at once, at the first.
    once = shared.groupBy("n", "x", "y", "hub").agg(F.min(F.struct("index", "band")).alias("at"))
    members = written(
        fitted(banded.join(once.select("at.band", "at.index", "hub"), ["band", "index"]), many), folder, "members"
    )
    # At most BANDS hubs for a set; a hub is one of its own.
    hubs = written(fitted(members.groupBy("set_id").agg(F.sort_array(F.collect_set("hub")).alias("hubs")), many), folder, "hubs")
    least_hub = F.get("hubs", F.lit(0))
    tops = components(hubs.select(least_hub.alias("a"), F.explode("hubs").alias("b")), folder + "/coarse", many)
    coarse = hubs.select("set_id", least_hub.alias("hub")).join(tops.withColumnRenamed("set_id", "hub"), "hub", "left").select(
        "set_id", F.coalesce("root", "hub").alias("root")
    )
    found = texts.select("k", "text").join(sets.join(coarse, "set_id"), "k").groupBy("set_id").agg(
        F.first("root").alias("root"), F.first("size").alias("size"), F.first("registers").alias("registers"), F.first("text").alias("text")
    )
    fetched = written(fitted(found, many), folder, "texts")
    placed = fetched.select("set_id", "root", "size")
    clusters = placed.groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"),
        F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64(F.lit(s), "set_id"), "set_id"))["set_id"] for s in range(HUBS)])).alias("hubs"),
    ).withColumn("blocks", F.greatest(_blocks(F.col("n")), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int"))
    tile = lambda *c: F.md5(F.concat_ws("/", *[F.hex(x) if isinstance(x, str) else x.cast("string") for x in c]))
    own = placed.join(clusters, "root").select(
        tile("root", F.pmod(F.xxhash64("set_id"), F.col("blocks"))).alias("tile"), F.lit(1).alias("side"), "set_id"
    )
    hubs = clusters.filter("blocks > 1").select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "hubs").select(
        tile("root", F.col("block")).alias("tile"), F.lit(1).alias("side"), F.explode("hubs").alias("set_id")
    )
    none = F.lit(None).cast("binary").alias("label")
    links = _compared(own.unionByName(hubs).select("tile", "side", none, "set_id", F.lit(-1).alias("index")), fetched, threshold, folder, "links")
    roots = components(links, folder + "/between", many)
    per_set = signed.filter("size > 0").groupBy("set_id").agg(F.min("id").alias("least"))
    labelled = per_set.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    large = written(fitted(clusters.filter("blocks > 1").select("root"), many), folder, "large")
    if not large.isEmpty():
        rest = _rest(members, placed.join(large, "root"), fetched, roots, threshold, folder, tile, many)
        tops = components(rest, folder + "/fine", many).select(F.col("set_id").alias("root"), F.col("root").alias("top"))
        labelled = labelled.join(tops, "root", "left").select("set_id", "least", F.coalesce("top", "root").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = labelled.join(smallest, "root").select("set_id", "component_id")
    out = signed.select("id", "set_id", "size").join(facts, "set_id", "left")
    component = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def _rest(members, placed, fetched, roots, threshold, folder, tile, many) -> DataFrame:
    """Links (root, root) between components that share a band, in clusters beyond a tile.

    The sets outside a band's largest component are compared with all its sets.
    """
    label = placed.select("set_id").join(roots, "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("label"))
    held = written(fitted(members.select("band", "index", "set_id").join(label, "set_id"), many), folder, "held")
    sizes = held.groupBy("band", "index", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band", "index").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "label"))["label"].alias("most"), F.max("n").alias("top")
    ).filter("n > top").select("band", "index", "most", _blocks(F.col("n")).alias("blocks"), _blocks(F.col("n") - F.col("top")).alias("odd"))
    rows = held.join(mixed, ["band", "index"])
    outside = F.col("label") != F.col("most")
    one = (F.col("blocks") == 1) & (F.col("odd") == 1)  # a set comes once into a band's only tile
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.filter(outside & ~one).select(
        "band", "index", "set_id", "label", F.pmod(F.xxhash64("set_id"), F.col("odd")).alias("i"), upto(F.col("blocks")).alias("j"), F.lit(1).alias("side")
    )
    right = rows.select(
        "band", "index", "set_id", "label", upto(F.col("odd")).alias("i"), F.pmod(F.xxhash64("set_id"), F.col("blocks")).alias("j"),
        F.when(outside & one, 1).otherwise(0).alias("side"),
    )
    dealt = left.unionByName(right)
    return _compared(
        dealt.select(tile(F.col("band"), F.col("index"), F.col("i"), F.col("j")).alias("tile"), "side", "label", "set_id", "index"),
        fetched, threshold, folder, "rest",
    )


def brute_force(rows: list[tuple], threshold: int = 85) -> list[tuple]:
    """Rows of (id, text) to (id, n_shingles, component_id, kept), for tests; ids are not null."""
    import re

    sets = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))} if ws else set())
    least = [i for i, _ in rows]
    moved = True
    linked = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    ]
    while moved:
        moved = False
        for a, b in linked:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    return [(i, len(s), m, i == m) for (i, _), s, m in zip(rows, sets, least)]
