"""Requests scored against packed profile rows.

A page's elements are packed into one row for each run of ordinals, its requests
into packs of bounded size. A pack meets each run of its page in one row, and all
rules are answered inside that row: words are looked up once among the run's
distinct tokens, points are added in one vector over its elements. What leaves is
the run's winner of each rule, as (score, number of elements, first element), and
winners of runs merge in any order. No row stands for a request and an element.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions.staging import staged

RUN = 1024  # ordinals of one profile row
PACK = 1024  # requests of one pack, about
EXACT, SCORED, ALIAS, SINGLE = range(4)
EQUAL, WHOLE, INSIDE = 100, 20, 5


def profile_blocks(elements: DataFrame) -> DataFrame:
    """elements(page_id, ord, kinds, ids, form, groups, payload) to one row for each (page_id, run)."""
    packed = F.struct("ord", "kinds", "ids", "form", "groups", "payload")
    run = F.floor(F.col("ord") / RUN).alias("run")
    return elements.filter(F.size("kinds") > 0).groupBy("page_id", run).agg(F.collect_list(packed).alias("elements"))


def request_packs(asked: DataFrame, elements: DataFrame) -> DataFrame:
    """asked(page_id, kind, target, key, form, group) to packs, each once for every run of its page.

    A page with many requests has several packs; a page without elements none.
    """
    none = F.lit(None).cast(dict(elements.dtypes)["ord"]).alias("ord")
    sizes = (
        asked.select("page_id", F.lit(1).alias("n"), none)
        .unionByName(elements.select("page_id", F.lit(0).alias("n"), "ord"))
        .groupBy("page_id").agg(F.sum("n").alias("n"), F.max("ord").alias("last"))
        .filter((F.col("n") > 0) & F.col("last").isNotNull())
        .select("page_id", F.ceil(F.col("n") / PACK).alias("packs"), F.floor(F.col("last") / RUN).alias("last"))
    )
    part = F.pmod(F.xxhash64("kind", "target"), F.col("packs")).alias("part")
    return (
        asked.join(sizes, "page_id")
        .groupBy("page_id", part)
        .agg(F.collect_list(F.struct("kind", "target", "key", "form", "group")).alias("requests"), F.first("last").alias("last"))
        .select("page_id", "requests", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("run"))
    )


def cells(asked: DataFrame, elements: DataFrame) -> DataFrame:
    """Each pack with each run of its page. The run is in the join key, so a large page spreads over tasks.

    The number of tasks is given: a cell is little data and much work, and would be merged with others.
    """
    asked = staged(asked)
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return request_packs(asked, elements).repartition(tasks, "page_id", "run").join(profile_blocks(elements), ["page_id", "run"]).select("page_id", "requests", "elements")


class Run:
    """The elements of one kind in a run, in order, with their tokens and identifiers."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.exact: dict[str, int] = {}
        self.alias: dict[str, list[int]] = defaultdict(list)
        self.forms: dict[str, list[int]] = defaultdict(list)
        tokens: dict[str, list[int]] = defaultdict(list)
        for n, (_, _, ids, form, groups) in enumerate(rows):
            for key in ids:
                self.exact.setdefault(key, n)
            for group in groups:
                self.alias[group].append(n)
            self.forms[form].append(n)
            for token in set(form.split()):
                tokens[token].append(n)
        self.tokens = tokens
        self.names = list(tokens)
        self.text = "\n".join(self.names)
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.names])]).tolist()
        self.found: dict[str, np.ndarray | None] = {}

    def points(self, word: str) -> np.ndarray | None:
        """Points of a word for each element: whole word, or part of one."""
        if word not in self.found:
            vector = None
            at = self.text.find(word)
            while at >= 0:
                if vector is None:
                    vector = np.zeros(len(self.rows), np.int64)
                token = bisect_right(self.starts, at) - 1
                vector[self.tokens[self.names[token]]] = INSIDE
                at = self.text.find(word, self.starts[token + 1])
            if word in self.tokens:
                vector[self.tokens[word]] = WHOLE
            self.found[word] = vector
        return self.found[word]

    def winners(self, key: str, form: str, group: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(rule, score, elements, first element) of each rule that finds something."""
        if key in self.exact:
            yield EXACT, 0, 1, self.exact[key]
        total = None
        for word in form.split():
            points = self.points(word)
            if points is not None:
                total = points if total is None else total + points
        if form in self.forms:
            total = np.zeros(len(self.rows), np.int64) if total is None else total.copy()
            total[self.forms[form]] += EQUAL
        if total is not None:
            best = int(total.max())
            yield SCORED, best, int((total == best).sum()), int(total.argmax())
        if group in self.alias:
            yield ALIAS, 0, len(self.alias[group]), self.alias[group][0]
        yield SINGLE, 0, len(self.rows), 0


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        asked, held = batch.column("requests"), batch.column("elements")
        requests, elements = asked.flatten(), held.flatten()
        request = list(zip(*(requests.field(c).to_pylist() for c in ("kind", "key", "form", "group"))))
        element = list(zip(*(elements.field(c).to_pylist() for c in ("ord", "kinds", "ids", "form", "groups"))))
        request_at, element_at = ([0, *np.cumsum(np.asarray(a.value_lengths())).tolist()] for a in (asked, held))
        out: list[tuple] = []
        for n in range(batch.num_rows):
            first, last = element_at[n], element_at[n + 1]
            order = sorted(range(first, last), key=lambda i: element[i][0])
            runs: dict[str, tuple[Run, list[int]] | None] = {}
            for r in range(request_at[n], request_at[n + 1]):
                kind, key, form, group = request[r]
                if kind not in runs:
                    own = [i for i in order if kind in element[i][1]]
                    runs[kind] = (Run([element[i] for i in own]), own) if own else None
                if runs[kind] is not None:
                    run, own = runs[kind]
                    out += [(n, r, own[at], rule, score, count) for rule, score, count, at in run.winners(key, form, group)]
        table = np.array(out, np.int64).reshape(-1, 6)
        row, asked_at, element_no, rule, score, count = table.T
        take = pa.array(element_no)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id").take(pa.array(row)),
                requests.field("kind").take(pa.array(asked_at)), requests.field("target").take(pa.array(asked_at)),
                pa.array(rule.astype(np.int32)), pa.array(score), pa.array(count),
                elements.field("ord").take(take), elements.field("payload").take(take),
            ],
            ["page_id", "kind", "target", "rule_no", "score", "n", "ord", "payload"],
        )


def answers(asked: DataFrame, elements: DataFrame) -> DataFrame:
    """Answers of each distinct (page_id, kind, target): arrays by rule, see ``ruled``."""
    kinds = {f.name: f.dataType.simpleString() for f in elements.schema}
    page, target = dict(asked.dtypes)["page_id"], dict(asked.dtypes)["target"]
    rows = cells(asked, elements).mapInArrow(
        _answers,
        f"page_id {page}, kind string, target {target}, rule_no int, score bigint, n bigint, ord {kinds['ord']}, payload {kinds['payload']}",
    )
    # At most one row for each rule and run of the page.
    return rows.groupBy("page_id", "kind", "target").agg(F.collect_list(F.struct("rule_no", "score", "n", "ord", "payload")).alias("won"))


def ruled(won: Column, rule: int) -> Column:
    """(score, n, first(ord, payload)) of one rule over all runs, null when it found nothing."""
    own = F.filter(won, lambda w: w["rule_no"] == rule)
    top = F.array_max(F.transform(own, lambda w: w["score"]))
    best = F.filter(own, lambda w: w["score"] == top)
    return F.when(
        F.size(own) > 0,
        F.struct(
            top.alias("score"),
            F.aggregate(best, F.lit(0).cast("bigint"), lambda total, w: total + w["n"]).alias("n"),
            F.array_min(F.transform(best, lambda w: F.struct(w["ord"].alias("ord"), w["payload"].alias("payload")))).alias("first"),
        ),
    )
