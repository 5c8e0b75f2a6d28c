"""Vector codes by exact integer k-means over anchors hierarchies.

Vectors are cut into equal parts and each part position has a codebook. The parts
of a block of rows are kept in a ball tree that is built from the middle out: a
few anchors divide the points, stealing only where the triangle inequality lets
them; balls of the anchors are merged upwards, and each anchor is divided in the
same way below. Every ball caches the sum and the number of its points. A round
of k-means walks each tree with the list of entries that may still be nearest;
a child inherits its parent's list, and a ball with one entry left gives its sum
and count as they are. Trees are built once and written to the shared folder; a
round sends sums of one task, and only the sums of all come to the driver.

Bounds are floats with a margin and only ever leave an entry in the list;
distances that decide are integers.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import scratch, written

SCALE = 1024
LIMIT = 1 << 24  # components beyond this, after scaling, count as this
BLOCK = 2048  # rows of one tree
LEAF = 24  # points of a ball that is not divided
SALT = 32  # parts of a label in the join with its error
MARGIN = 1e-9


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x entries, as 64-bit integers."""
    most = max(1, int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 52 else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None, :]).astype(np.int64)


def _far(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - at) ** 2).sum(1, dtype=np.float64))


class Tree:
    """Balls over the rows of ``points``; ball 0 is the root once ``build`` is done.

    ``order`` lists the points so that those of a ball are next to each other:
    ``first`` to ``last``. ``kids`` are two balls, or -1 in a leaf.
    """

    FIELDS = ("points", "order", "kids", "first", "last", "pivot", "radius", "sums")

    def __init__(self, **fields: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, fields[name])

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        made = _divide(points, points.astype(np.float64), np.arange(len(points)))
        order, kids, first, last = [], [], [], []
        pending = [(made, None)]
        while pending:
            (members, pair), parent = pending.pop()
            at = len(kids)
            kids.append([-1, -1])
            if parent is not None:
                kids[parent[0]][parent[1]] = at
            first.append(len(order))
            if pair is None:
                order.extend(members)
            else:
                pending += [(pair[1], (at, 1)), (pair[0], (at, 0))]
            last.append(first[-1] + len(members))
        order, first, last = np.array(order, np.int64), np.array(first), np.array(last)
        inside = points[order]
        total = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(inside, axis=0)])
        sums = total[last] - total[first]
        pivot = sums / (last - first)[:, None]
        radius = np.array([_far(inside[a:b], p).max() for a, b, p in zip(first, last, pivot)])
        return cls(points=inside, order=order, kids=np.array(kids), first=first, last=last, pivot=pivot, radius=radius, sums=sums)

    def owners(self, entries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray | None]]:
        """(first, last, owner of each or of all, cached sum if one owner) of the balls that settle."""
        _, kept = np.unique(entries, axis=0, return_index=True)
        pending = [(0, np.sort(kept))]
        exact = entries.astype(np.float64)
        while pending:
            ball, listed = pending.pop()
            if len(listed) > 1:
                far = _far(exact[listed], self.pivot[ball])
                slack = MARGIN * (1 + far.max() + self.radius[ball])
                listed = listed[far <= far.min() + 2 * self.radius[ball] + slack]
            first, last = self.first[ball], self.last[ball]
            if len(listed) == 1:
                yield first, last, int(listed[0]), self.sums[ball]
            elif self.kids[ball][0] < 0:
                yield first, last, listed[distances(self.points[first:last], entries[listed]).argmin(1)], None
            else:
                pending += [(kid, listed) for kid in self.kids[ball]]

    def settle(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the points that each entry owns."""
        sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        for first, last, owner, cached in self.owners(entries):
            if cached is not None:
                sums[owner] += cached
                counts[owner] += last - first
            else:
                np.add.at(sums, owner, self.points[first:last])
                np.add.at(counts, owner, 1)
        return sums, counts

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point, in the points' own order."""
        owner, error = np.empty(len(self.order), np.int64), np.empty(len(self.order), np.int64)
        for first, last, found, _ in self.owners(entries):
            owner[self.order[first:last]] = found
        error[self.order] = ((self.points - entries[owner[self.order]]) ** 2).sum(1)
        return owner, error


def _divide(points: np.ndarray, exact: np.ndarray, members: np.ndarray) -> tuple:
    """(members, two balls or None): anchors over ``members``, merged upwards, divided downwards."""
    if len(members) <= LEAF:
        return members, None
    anchors = _anchors(exact, members)
    if len(anchors) == 1:
        return members, None  # all points are equal
    balls = [_divide(points, exact, owned) for owned in anchors]
    centre = np.array([exact[b[0]].mean(0) for b in balls])
    radius = np.array([_far(exact[b[0]], c).max() for b, c in zip(balls, centre)])
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
    size = (gap + radius[:, None] + radius[None]) / 2
    np.fill_diagonal(size, np.inf)
    for _ in range(len(balls) - 1):
        i, j = np.unravel_index(size.argmin(), size.shape)
        joined = np.concatenate([balls[i][0], balls[j][0]])
        balls[i] = (joined, (balls[i], balls[j]))
        centre[i] = exact[joined].mean(0)
        radius[i] = _far(exact[joined], centre[i]).max()
        size[j], size[:, j] = np.inf, np.inf
        alive = np.isfinite(size[i]) | np.isfinite(size[:, i])
        alive[[i, j]] = False
        new = (np.sqrt(((centre - centre[i]) ** 2).sum(1)) + radius + radius[i]) / 2
        size[i] = size[:, i] = np.where(alive, new, np.inf)
        top = balls[i]
    return top


def _anchors(exact: np.ndarray, members: np.ndarray) -> list[np.ndarray]:
    """About the root of n anchors with the points they own, farthest first."""
    far = _far(exact[members], exact[members[0]])
    by = np.argsort(-far, kind="stable")
    pivots, owned, reach = [members[0]], [members[by]], [far[by]]
    for _ in range(int(len(members) ** 0.5)):
        widest = max(range(len(pivots)), key=lambda a: reach[a][0])
        if reach[widest][0] == 0:
            break
        new = owned[widest][0]
        taken, taken_far = [], []
        for a in range(len(pivots)):
            # No point nearer to its anchor than half the way to the new one can be stolen.
            half = float(_far(exact[new][None], exact[pivots[a]])[0]) / 2
            n = int(np.searchsorted(-reach[a], -half, side="right"))
            if not n:
                continue
            to_new = _far(exact[owned[a][:n]], exact[new])
            steal = to_new < reach[a][:n]
            taken.append(owned[a][:n][steal])
            taken_far.append(to_new[steal])
            stay = np.concatenate([~steal, np.ones(len(owned[a]) - n, bool)])
            owned[a], reach[a] = owned[a][stay], reach[a][stay]
        points, dist = np.concatenate(taken), np.concatenate(taken_far)
        by = np.argsort(-dist, kind="stable")
        pivots.append(new)
        owned.append(points[by])
        reach.append(dist[by])
    return owned


def _packed(trees: list[Tree]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{name}{i}": getattr(t, name) for i, t in enumerate(trees) for name in Tree.FIELDS})
    return out.getvalue()


def _unpacked(blob: bytes, parts: int) -> list[Tree]:
    with np.load(io.BytesIO(blob)) as stored:
        return [Tree(**{name: stored[f"{name}{i}"] for name in Tree.FIELDS}) for i in range(parts)]


def _plant(parts: int, width: int):
    """Rows to one row for each block: ids, labels and the packed trees of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                listed = piece.column("vector")
                flat = np.asarray(listed.flatten()).reshape(len(piece), parts, width)
                edges = pa.array([0, len(piece)], pa.int32())
                whole = [pa.ListArray.from_arrays(edges, piece.column(c)) for c in ("id", "label")]
                blob = _packed([Tree.build(np.ascontiguousarray(flat[:, p])) for p in range(parts)])
                yield pa.RecordBatch.from_arrays([*whole, pa.array([blob], pa.binary())], ["ids", "labels", "trees"])

    return run


def _round(books: np.ndarray):
    """Sums and counts of all trees of a task, one row for each part and entry in use."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for blob in batch.column("trees"):
                for p, tree in enumerate(_unpacked(blob.as_py(), parts)):
                    s, c = tree.settle(books[p])
                    sums[p] += s
                    counts[p] += c
        part, entry = np.nonzero(counts)
        flat = pa.array(sums[part, entry].ravel())
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), flat)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), listed, pa.array(counts[part, entry])],
            ["part", "entry", "sums", "count"],
        )

    return run


def _coded(books: np.ndarray):
    parts = len(books)
    names = np.array([f"{i:02x}" for i in range(max(256, books.shape[1]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("ids").flatten(), batch.column("labels").flatten()
            codes, errors = [], []
            for blob in batch.column("trees"):
                found = [tree.codes(books[p]) for p, tree in enumerate(_unpacked(blob.as_py(), parts))]
                code = names[found[0][0]]
                for owner, _ in found[1:]:
                    code = np.char.add(code, names[owner])
                codes.append(code)
                errors.append(sum(error for _, error in found))
            if not codes:
                continue
            columns = [ids, labels, pa.array(np.concatenate(codes), pa.string()), pa.array(np.concatenate(errors))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    return run


def codes(
    rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per kept row: id, label, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null, NaN or infinite component go. Each
    component is floor(1024 * x); beyond 2**24 it counts as 2**24, so that every
    sum is exact in 64 bits. Vectors count as if zeros followed up to the longest
    length, rounded up to a multiple of ``parts`` (and ``parts`` at least).
    Codebooks start from the rows of the smallest ids, null ids last and equal
    ids by their components; with fewer rows they are shorter. Repeated rows
    count each time. Null labels are one label. Other columns are not looked at;
    an empty table gives no rows.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col)
    number = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long")
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    kept = rows.filter(vector.isNotNull() & F.forall(vector, finite)).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vector, number).alias("vector")
    )
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    wide = parts * width
    padded = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(wide) - F.size("vector")))
    kept = kept.select("id", "label", padded.alias("vector"))
    start = kept.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    books = np.array([r.vector for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    kinds = dict(kept.dtypes)
    folder = scratch(spark)
    planted = written(
        kept.mapInArrow(_plant(parts, width), f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, trees binary"),
        folder, "trees",
    )
    for _ in range(rounds if start else 0):
        # One row for each part and entry: bounded by the codebooks.
        merged = (
            planted.select("trees").mapInArrow(_round(books), "part int, entry int, sums array<long>, count long")
            .groupBy("part", "entry")
            .agg(F.sum("count").alias("count"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        )
        for r in merged.collect():
            books[r.part, r.entry] = np.array(r.sums, np.int64) // r["count"]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = written(
        planted.mapInArrow(_coded(books), f"id {kinds['id']}, label {kinds['label']}, code string, error long"), folder, "codes"
    )
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALT))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")).alias("salt_of")
    )
    dealt = coded.withColumn("salt", salt)
    return dealt.join(totals, dealt.label.eqNullSafe(totals.of) & (dealt.salt == totals.salt_of)).select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )


def brute_force(vectors: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4) -> list[tuple]:
    """(id, code, error) by plain k-means over equally long finite vectors, for tests."""
    rows = sorted((i, [int(np.floor(SCALE * np.float64(x))) for x in v]) for i, v in vectors)
    width = len(rows[0][1]) // parts
    out = {n: ["", 0] for n in range(len(rows))}
    for p in range(parts):
        points = [v[p * width : (p + 1) * width] for _, v in rows]
        book = [list(x) for x in points[:entries]]
        nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))  # noqa: E731, B023
        for _ in range(rounds):
            owner = [nearest(x)[1] for x in points]
            for e in set(owner):
                own = [x for x, o in zip(points, owner) if o == e]
                book[e] = [sum(c) // len(own) for c in zip(*own)]
        for n, x in enumerate(points):
            error, e = nearest(x)
            out[n][0] += f"{e:02x}"
            out[n][1] += error
    return [(rows[n][0], *out[n]) for n in range(len(rows))]
