"""Phrases whose words go together, by stripes.

A stripe is a prefix with a counter of the words that follow it. Each task counts
the stripes of its texts and sends every prefix once, with all its next words;
stripes of one prefix are merged elementwise as they stream in. The empty prefix
gives the words, one word gives the pairs, and so on, so a merged stripe holds
the extensions of its prefix, their numbers, and the prefix's own total.

Stripes of length k only take words whose two parts of length k - 1 are frequent,
as each part of a frequent phrase is. That is looked up in a bitmap of fixed size
(hashes of frequent parts), which may let rare ones through and never loses one.
A prefix that holds a large share of all words has its next words dealt to
several stripes; there are less than ``BROAD`` such prefixes of each length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm import arrays
from pagewarden.llm.common import scratch, written

BREAKS = b".,;:!?\n\x0b\x0c\r"
CHUNK = 2 << 20  # bytes that are counted at once; pieces are never cut
FILTER_BITS = 27  # the bitmap of frequent parts takes 2**27 bits: 16 MB
BITMAP = 32768  # bits of a block in Spark's bitmap functions
BROAD = 16384  # a prefix with more than 1/BROAD of all words is dealt to a stripe for each such share
EMPTY_SHARDS = 1024  # stripes of the empty prefix
MERGE_ROWS = 1 << 19  # entries that are merged at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(BREAKS)] = True
_IS_SPACE = _IS_BREAK.copy()
_IS_SPACE[[32, 9]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)

MERGED = "lang string, prefix string, next string, f long, total long, h long"


def _chunks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK bytes that end behind a break, or at the end."""
    first = 0
    while first < len(data):
        last = min(first + CHUNK, len(data))
        while last < len(data):
            found = np.flatnonzero(_IS_BREAK[data[first:last]])
            if len(found):
                last = first + int(found[-1]) + 1
                break
            last = min(last + CHUNK, len(data))
        yield first, last
        first = last


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, and whether the next word follows in the same piece."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    before = np.searchsorted(np.flatnonzero(_IS_BREAK[data]), start)
    linked = np.zeros(len(start), bool)
    linked[:-1] = before[1:] == before[:-1]
    return start, end, arrays.span_hash(arrays.prefix_hash(data), start, end), linked


def _seeds(langs: list[str]) -> np.ndarray:
    """A hash for each language name."""
    data, offsets = arrays.utf8(pa.array(langs, pa.large_string()))
    return arrays.mix(arrays.span_hash(arrays.prefix_hash(data), offsets[:-1], offsets[1:]) + np.uint64(1))


def _chained(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the phrase of ``size`` words that starts at each word; the last ones wrap round."""
    value = words
    for k in range(1, size):
        value = arrays.mix(value * _STEP + np.roll(words, -k))
    return value


def _frequent(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    at = (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings of the words between two offsets each, joined by blanks."""
    size = end - start + 1
    edge = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(int(edge[-1])) - np.repeat(edge[:-1] - start, size)
    joined = data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(0, np.uint8)
    joined[edge[1:] - 1] = 32
    first, last = edge[offsets[:-1]], edge[offsets[1:]]
    # Every string but the empty ones ends in a blank, which goes.
    keep = np.ones(len(joined), bool)
    keep[last[last > first] - 1] = False
    bounds = np.concatenate([[0], np.cumsum(np.maximum(last - first - 1, 0))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds), pa.py_buffer(joined[keep].tobytes()))


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The values between two offsets each, packed as 32-bit integers."""
    bounds = pa.py_buffer((offsets * 4).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, bounds, pa.py_buffer(values.astype("<i4").tobytes())])


def _stripes(size: int, bits: np.ndarray | None, broad: dict[int, tuple[int, int]]):
    """Texts to the stripes of each chunk; prefixes have ``size - 1`` words.

    A stripe's next words are one string, their numbers one binary value.
    """
    known = np.array(sorted(broad), np.int64).view(np.uint64)
    known_shards = np.array([broad[k][1] for k in known.view(np.int64).tolist()], np.uint64)
    by = np.argsort(known)
    known, known_shards = known[by], known_shards[by]

    def count(data: np.ndarray, lang: np.ndarray, ends: np.ndarray, base: int, names: list[str], seeds: np.ndarray):
        start, end, word, linked = _words(data)
        n = len(word)
        lang = lang[np.searchsorted(ends, start + base, side="right")]
        word = arrays.mix(word ^ seeds[lang])
        if size == 1:
            part, heads, follows = seeds[lang], np.arange(n), np.ones(n, bool)
            whole = word
        else:
            part = _chained(word, size - 1)
            reach = np.ones(n, bool)  # words that start size - 1 words of one piece
            for k in range(size - 2):
                reach &= np.roll(linked, -k)
            reach[max(0, n - size + 2) :] = False
            good = _frequent(bits, part)
            heads = np.flatnonzero(reach & good)
            # The phrase goes on with a word, and is frequent without its first one too.
            on = heads + size - 1
            follows = on < n
            follows[follows] = linked[on[follows] - 1] & good[heads[follows] + 1]
            whole = arrays.mix(part * _STEP + np.roll(word, 1 - size))
        key, first, total = np.unique(part[heads], return_index=True, return_counts=True)
        entries = heads[follows]
        phrase, at, number = np.unique(whole[entries], return_index=True, return_counts=True)
        at = entries[at]
        row = np.searchsorted(key, part[at])
        shards = np.full(len(key), EMPTY_SHARDS if size == 1 else 1, np.uint64)
        if size > 1 and len(known):
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            shards = np.where(known[place] == key, known_shards[place], shards)
        then = at + size - 1
        shard = (word[then] % shards[row]).astype(np.int64)
        stripe = row << 32 | shard
        by = np.argsort(stripe, kind="stable")
        stripe, then, number = stripe[by], then[by], number[by]
        # A prefix's own number travels with its first stripe, also when nothing follows.
        stripes = np.unique(np.concatenate([stripe, np.arange(len(key)) << 32]))
        offsets = np.append(np.searchsorted(stripe, stripes), len(stripe))
        row, shard = stripes >> 32, stripes & 0xFFFFFFFF
        head = heads[first[row]]
        ws = (head[:, None] + np.arange(size - 1)).ravel()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()).take(pa.array(lang[head])),
                _strings(data, start[ws], end[ws], np.arange(len(row) + 1) * (size - 1)),
                pa.array(shard.astype(np.int32)),
                pa.array(np.where(shard == 0, total[row], 0).astype(np.int64)),
                _strings(data, start[then], end[then], offsets),
                _binary(number, offsets),
            ],
            ["lang", "prefix", "shard", "total", "next", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pc.dictionary_encode(batch.column("lang"))
            lang = np.asarray(names.indices)
            names = names.dictionary.to_pylist()
            if not names:
                continue
            seeds = _seeds(names)
            data, offsets = arrays.utf8(batch.column("text"))
            for first, last in arrays.runs(offsets, CHUNK):
                # A line feed behind every text: no piece spans two.
                ends = np.cumsum(np.diff(offsets[first : last + 1]) + 1)
                own = np.ones(int(ends[-1]), bool)
                own[ends - 1] = False
                joined = np.full(len(own), 10, np.uint8)
                joined[own] = _LOWER[data[offsets[first] : offsets[last]]]
                for a, b in _chunks(joined):
                    found = count(joined[a:b], lang[first:last], ends, a, names, seeds)
                    for at in range(0, found.num_rows, 20_000):
                        yield found.slice(at, 20_000)

    return run


def _phrase_hash(lang: pa.Array, phrase: pa.Array, size: int) -> np.ndarray:
    """The hash that ``_stripes`` gives the same phrase of ``size`` words."""
    names = pc.dictionary_encode(lang)
    seeds = _seeds(names.dictionary.to_pylist())[np.asarray(names.indices)]
    data, _ = arrays.utf8(pc.binary_join_element_wise(phrase, "", "\n"))
    _, _, word, _ = _words(data)
    word = arrays.mix(word ^ np.repeat(seeds, size))
    return _chained(word, size)[::size]


def _merge(size: int, least: int, broad: dict[int, tuple[int, int]]):
    """Sorted stripes of a partition to their merged entries of at least ``least``.

    For the empty prefix an entry without a next word carries the number of all words.
    """
    kinds = [pa.string()] * 3 + [pa.int64()] * 3

    def flush(heads: pa.RecordBatch, total: np.ndarray, entries: pa.Table) -> pa.RecordBatch:
        entries = entries.filter(pc.greater_equal(entries["n"], least)).combine_chunks()
        key, then = (entries[c].combine_chunks() for c in ("key", "next"))
        lang, prefix = (heads.column(c).take(key) for c in ("lang", "prefix"))
        total_of = total[np.asarray(key)]
        phrase = then if size == 1 else pc.binary_join_element_wise(prefix, then, " ")
        if size > 1 and broad:
            whole = _phrase_hash(lang, prefix, size - 1).view(np.int64).tolist()
            total_of = np.array([broad[h][0] if h in broad else t for h, t in zip(whole, total_of.tolist())], np.int64)
        columns = [lang, prefix, then, entries["n"].combine_chunks(), pa.array(total_of), pa.array(_phrase_hash(lang, phrase, size).view(np.int64))]
        columns = [c.cast(k) for c, k in zip(columns, kinds)]
        if size == 1:
            at = np.flatnonzero(total)
            own = pa.array(total[at])
            extra = [heads.column("lang").take(pa.array(at)), pa.array([""] * len(at)), pa.nulls(len(at), pa.string()), own, own, pa.nulls(len(at), pa.int64())]
            columns = [pa.concat_arrays([c, e.cast(k)]) for c, e, k in zip(columns, extra, kinds)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "next", "f", "total", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One head for each stripe so far, its own number, and (key, next, n) entries.
        heads: list[pa.RecordBatch] = []
        totals: list[np.ndarray] = []
        entries: list[pa.Table] = []
        keys = rows = 0

        def summed() -> pa.Table:
            table = pa.concat_tables(entries).group_by(["key", "next"], use_threads=False).aggregate([("n", "sum")])
            return table.rename_columns({"n_sum": "n"})

        for batch in batches:
            if not batch.num_rows:
                continue
            listed = pc.split_pattern(batch.column("next"), " ")
            n = batch.column("n")
            number = np.frombuffer(b"".join(n.to_pylist()), "<i4").astype(np.int64)
            count = np.asarray(pc.binary_length(n)) // 4
            names = batch.select(["lang", "prefix", "shard"])
            fresh = np.zeros(len(count), bool)
            for c in names.columns:
                fresh[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]).cast(pa.int8())) == 1
            fresh[0] = not heads or any(names.column(c)[0] != heads[-1].column(c)[len(heads[-1]) - 1] for c in range(3))
            key = np.cumsum(fresh) - 1 + keys
            if fresh.any():
                heads.append(names.take(pa.array(np.flatnonzero(fresh))))
            keys = int(key[-1]) + 1
            totals.append(np.bincount(key, weights=np.asarray(batch.column("total")), minlength=keys).astype(np.int64))
            # The empty string splits into one empty word.
            spelled = listed.filter(pa.array(count > 0)).flatten()
            entries.append(pa.table({"key": np.repeat(key, count), "next": spelled, "n": number}))
            rows += len(number)
            if rows < MERGE_ROWS:
                continue
            # The last stripe may go on in the next batch.
            table, total = summed(), sum(np.pad(t, (0, keys - len(t))) for t in totals)
            whole = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
            done = pc.less(table["key"], keys - 1)
            yield flush(whole, np.append(total[:-1], 0), table.filter(done))
            held = table.filter(pc.invert(done))
            heads, totals = [whole.slice(keys - 1)], [total[-1:]]
            entries = [held.set_column(held.schema.get_field_index("key"), "key", pa.array(np.zeros(held.num_rows, np.int64)))]
            keys, rows = 1, 0
        if keys:
            total = sum(np.pad(t, (0, keys - len(t))) for t in totals)
            yield flush(pa.Table.from_batches(heads).combine_chunks().to_batches()[0], total, summed())

    return run


def _bitmap(counts: DataFrame) -> np.ndarray:
    """Bits of the hashes of frequent phrases: 2**FILTER_BITS of them, whatever the input."""
    bit = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    blocks = counts.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for b, bits in blocks.toLocalIterator():
        at = (b - 1) * (BITMAP // 8)
        out[at : at + BITMAP // 8] = np.frombuffer(bits, np.uint8)
    return out


def counted(docs: DataFrame, folder: str, longest: int, least: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """Merged stripes: (lang, size, prefix, next, f, total) of all frequent phrases; (lang, n) of all words."""
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
    )
    bits, broad, all_counts, per_lang, everything = None, {}, None, None, 0
    for size in range(1, longest + 1):
        counts = written(
            texts.mapInArrow(_stripes(size, bits, broad), "lang string, prefix string, shard int, total long, next string, n binary")
            .repartition("lang", "prefix", "shard").sortWithinPartitions("lang", "prefix", "shard")
            .mapInArrow(_merge(size, least, broad), MERGED),
            folder, f"stripes{size}",
        )
        if size == 1:
            per_lang = counts.filter("next is null").groupBy("lang").agg(F.sum("f").alias("n"))
            everything = per_lang.agg(F.sum("n")).first()[0] or 0
            counts = counts.filter("next is not null")
        sized = counts.select("lang", F.lit(size).alias("size"), "prefix", "next", "f", "total")
        all_counts = sized if all_counts is None else all_counts.unionByName(sized)
        if size < longest:
            bits = _bitmap(counts)
            # Less than BROAD phrases of one length hold this share of all words.
            share = max(least, everything // BROAD)
            large = counts.filter(F.col("f") > share).select("h", "f").collect()
            broad = {h: (f, 1 << int(f // share).bit_length()) for h, f in large}
    return all_counts, per_lang


def _score(a: Column, first: Column, rest: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in exact decimals."""
    exact = lambda c: c.cast("decimal(15,0)")
    top = (exact(a) * exact(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, exact(first) * exact(rest)).cast("long")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends, and
    pieces into words at blanks and tabs. Null and empty texts have no words; a
    null language is ``und``. Phrases of two to ``longest`` words with ``least``
    occurrences are scored by their weakest cut, of equal ones the first. A phrase
    inside a longer one that has ``covered`` percent of its occurrences goes.
    Repeated rows count each time; other columns are not looked at. A language
    without candidates, or an empty table, gives no rows. Numbers are exact for
    up to 10**15 words of a language.
    """
    folder = scratch(docs.sparkSession)
    counts, per_lang = counted(docs, folder, longest, least, text_col, lang_col)
    whole = F.when(F.col("size") == 1, F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    phrases = counts.select("lang", whole.alias("phrase"), "size", "next", "f", "total")
    candidates = phrases.filter("size > 1")
    words = F.split("phrase", " ")
    said = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    # The last cut has its first part's number in the stripe; the other parts are looked up.
    asked = F.flatten(F.transform(
        F.sequence(F.lit(1), F.col("size") - 1),
        lambda k: F.filter(
            F.array(
                F.struct(k.alias("cut"), F.lit("l").alias("side"), said(F.lit(1), k).alias("part")),
                F.struct(k.alias("cut"), F.lit("r").alias("side"), said(k + 1, F.col("size") - k).alias("part")),
            ),
            lambda s: (s["side"] == "r") | (s["cut"] < F.col("size") - 1),
        ),
    ))
    parts = candidates.select("lang", "phrase", "size", "f", "total", F.explode(asked).alias("p")).select("lang", "phrase", "size", "f", "total", "p.*")
    looked = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("found"))
    cuts = (
        parts.join(looked, ["lang", "part"])
        .groupBy("lang", "phrase", "size", "f", "total")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat("side", "cut"), "found"))).alias("by"))
    )
    left = lambda k: F.when(k == F.col("size") - 1, F.col("total")).otherwise(F.element_at("by", F.concat(F.lit("l"), k)))
    scored = cuts.withColumn("cuts", F.transform(
        F.sequence(F.lit(1), F.col("size") - 1),
        lambda k: F.struct(left(k).alias("l"), F.element_at("by", F.concat(F.lit("r"), k)).alias("r"), k.alias("cut")),
    )).withColumn("worst", F.array_min(F.transform(
        "cuts", lambda c: F.struct(_score(F.col("f"), c["l"], c["r"]).alias("score"), c["cut"].alias("cut"), c["l"].alias("l"), c["r"].alias("r"))
    )))
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: said(at, n)),
    ))
    maxima = (
        candidates.filter("size > 2").select("lang", "f", F.explode(inner).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    )
    kept = scored.join(maxima, ["lang", "phrase"], "left").filter(
        F.col("cover").isNull() | (F.col("cover") * 100 < F.col("f") * covered)
    )
    # The plain row number lets Spark cut each task's rows to ``top`` a language before the exchange.
    best = kept.select("lang", "phrase", F.col("f").alias("a"), "worst.l", "worst.r", "worst.score").withColumn(
        "rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")
    ).filter(F.col("rank") <= top)
    return best.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def brute_force(rows: list[tuple], longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> list[tuple]:
    """Rows of (text, lang) to (lang, rank, phrase, a, l, r, n, score), for tests."""
    import re
    from collections import Counter, defaultdict

    f: dict = defaultdict(Counter)
    for text, lang in rows:
        low = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        cover: Counter = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    cover[p[i : i + k]] = max(cover[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            if 100 * cover[p] >= covered * a:
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return out
