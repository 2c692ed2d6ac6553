"""Vector codes: each part of a vector becomes the index of its nearest codebook entry.

Components become integers ``floor(scale * x)``, vectors are cut into equal parts, and every part
position has a codebook of up to 256 entries, fitted by exact Lloyd rounds: all parts, integer sums,
floored means. The rows are packed into blocks where they lie, and a block keeps a metric tree per
part position, which all rounds read. A tree is grown middle-out: anchors claim the points nearest to
them (a point can only change hands if it lies farther from its anchor than half the way to the new
one), each anchor's points are split on in the same way, and the anchors' balls are paired upward to
one root. Balls cache the sum and the count of their points. A round walks each tree with a list of
candidate entries that balls inherit; an entry leaves the list when another is nearer to every point
of the ball, and a ball whose list has one entry is counted whole. Distances are compared as exact
integers, so the result is that of comparing every part with every entry, ties to the lower index.

No rows move but sums: a task gives one row per entry, and codebooks (entries x components) are
what the driver holds. A repeated vector is a ball of radius zero, wherever its rows lie.

Rows whose vector is null, or holds a null or a non-finite component, are dropped. A codebook starts
with the rows of smallest vec_id (nulls last; of repeated ids the smaller vector first), or with all
rows if they are fewer. Vectors shorter than the longest, and lengths that ``parts`` doesn't divide,
count as filled up with zeros. Integers saturate where a vector's error would no longer fit in a long
(beyond +-2^27 for 64 components), and so do sums of errors. Null labels are one label. Repeated rows
each get their row. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldspan.llm.shared import looked_up, small_batches, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20  #: of a block's integers
LEAF = 32
_LONG = (1 << 63) - 1


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries: whole floats where those are exact, else integers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * points.shape[1] < 1 << 53 else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    return np.einsum("ij,ij->i", p, p)[:, None] + np.einsum("ij,ij->i", e, e)[None, :] - 2 * (p @ e.T)


def _far(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(distances(points, pivot[None, :])[:, 0].astype(np.float64))


@dataclass
class Tree:
    """Balls over positions of a block: a ball's points are ``order[start:stop]``; the root is ball 0."""

    order: np.ndarray
    spans: np.ndarray  #: start, stop, left, right; a leaf has no children (-1)
    pivots: np.ndarray
    radii: np.ndarray
    sums: np.ndarray

    def packed(self) -> dict[str, bytes]:
        return {"place": self.order.astype("<i4").tobytes(), "spans": self.spans.astype("<i4").tobytes(), "pivots": self.pivots.astype("<i4").tobytes(), "radii": self.radii.astype("<f8").tobytes(), "sums": self.sums.astype("<i8").tobytes()}

    @staticmethod
    def unpacked(raw: dict[str, bytes], width: int) -> Tree:
        balls = len(raw["radii"]) // 8
        take = lambda name, kind: np.frombuffer(raw[name], kind)
        return Tree(take("place", "<i4"), take("spans", "<i4").reshape(-1, 4), take("pivots", "<i4").reshape(balls, width), take("radii", "<f8"), take("sums", "<i8").reshape(balls, width))


def anchors(points: np.ndarray, count: int) -> list[np.ndarray]:
    """Positions, dealt to up to ``count`` anchors, each point to the nearest; a new anchor is the farthest point of the widest."""
    owner, pivots = np.zeros(len(points), np.int64), [0]
    far = _far(points, points[0])
    while len(pivots) < count:
        new = int(far.argmax())  # the farthest point of the widest anchor is the farthest of all
        if far[new] == 0:
            break
        half = _far(points[pivots], points[new]) / 2
        open_to = np.flatnonzero(far >= half[owner])  # others can't be nearer to the new anchor
        to_new = _far(points[open_to], points[new])
        won = to_new < far[open_to]
        owner[open_to[won]], far[open_to[won]] = len(pivots), to_new[won]
        pivots.append(new)
    return [own for a in range(len(pivots)) if len(own := np.flatnonzero(owner == a))]


class _Ball:
    def __init__(self, points: np.ndarray, rows: np.ndarray, total: np.ndarray, children: tuple = ()):
        self.rows, self.total, self.children = rows, total, children
        self.pivot = (2 * total + len(rows)) // (2 * len(rows))
        self.radius = float(_far(points[rows], self.pivot).max())


def _leaf(points: np.ndarray, rows: np.ndarray) -> _Ball:
    return _Ball(points, rows, points[rows].sum(0))


def _grown(points: np.ndarray, rows: np.ndarray, leaf: int) -> _Ball:
    own = anchors(points[rows], int(np.ceil(np.sqrt(len(rows))))) if len(rows) > leaf else []
    if len(own) < 2:
        return _leaf(points, rows)
    balls = [_grown(points, rows[x], leaf) for x in own]
    middle, width = np.array([b.pivot for b in balls]), np.array([b.radius for b in balls])
    joint = (np.sqrt(distances(middle, middle).astype(np.float64)) + width[:, None] + width[None, :]) / 2
    np.fill_diagonal(joint, np.inf)
    for _ in range(len(balls) - 1):  # the pair whose common ball is smallest becomes one
        i, j = divmod(int(joint.argmin()), len(balls))
        i, j = min(i, j), max(i, j)
        a, b = balls[i], balls[j]
        balls[i] = one = _Ball(points, np.concatenate([a.rows, b.rows]), a.total + b.total, (a, b))
        middle[i], width[i] = one.pivot, one.radius
        joint[j] = joint[:, j] = np.inf
        live = np.flatnonzero(~np.isinf(joint[i]))
        joint[i, live] = joint[live, i] = (_far(middle[live], one.pivot) + width[live] + one.radius) / 2
    return balls[0]


def grown(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over a block's points of one part position (integers, a row each)."""
    points = points.astype(np.int64)
    spans, balls, order, waiting = [], [], [], [(_grown(points, np.arange(len(points)), leaf), -1, 0, 0)]
    while waiting:
        ball, parent, side, start = waiting.pop()
        if parent >= 0:
            spans[parent][2 + side] = len(spans)
        spans.append([start, start + len(ball.rows), -1, -1])
        balls.append(ball)
        if ball.children:
            a, b = ball.children
            waiting += [(b, len(spans) - 1, 1, start + len(a.rows)), (a, len(spans) - 1, 0, start)]
        else:
            order.append(ball.rows)
    return Tree(np.concatenate(order), np.array(spans), np.array([b.pivot for b in balls]), np.array([b.radius for b in balls]), np.array([b.total for b in balls]))


def owned(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(balls, the entry that owns each whole, single points of shared leaves, their entries)."""
    apart = np.sqrt(distances(book, book).astype(np.float64))
    first = np.unique(book, axis=0, return_index=True)[1]  # of equal entries the lower index wins
    lists = np.zeros((1, len(book)), bool)
    lists[:, first] = True
    front = np.zeros(1, np.int64)
    got: tuple[list, list, list, list] = ([], [], [], [])
    while len(front):
        d = distances(tree.pivots[front], book)
        masked = np.where(lists, d, np.inf if d.dtype == np.float64 else _LONG)
        near = masked.argmin(1)
        behind = d - d[np.arange(len(front)), near][:, None]
        lists &= behind <= 2 * tree.radii[front][:, None] * apart[near] * (1 + 1e-12)
        alone = lists.sum(1) == 1
        got[0].append(front[alone])
        got[1].append(near[alone])
        last = ~alone & (tree.spans[front, 2] < 0)
        for ball, wanted in zip(front[last].tolist(), lists[last]):
            at, entries = tree.order[tree.spans[ball, 0] : tree.spans[ball, 1]], np.flatnonzero(wanted)
            got[2].append(at)
            got[3].append(entries[distances(points[at], book[entries]).argmin(1)])
        down = ~alone & ~last
        front, lists = np.concatenate([tree.spans[front[down], 2], tree.spans[front[down], 3]]), np.concatenate([lists[down], lists[down]])
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in got)


def totals(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the points that each entry owns; balls give theirs whole."""
    balls, whole, single, entries = owned(tree, points, book)
    counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    np.add.at(counts, whole, tree.spans[balls, 1] - tree.spans[balls, 0])
    np.add.at(sums, whole, tree.sums[balls])
    np.add.at(counts, entries, 1)
    np.add.at(sums, entries, points[single])
    return counts, sums


def assigned(tree: Tree, points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Each point's entry."""
    balls, whole, single, entries = owned(tree, points, book)
    out = np.empty(len(points), np.int64)
    for ball, entry in zip(balls.tolist(), whole.tolist()):
        out[tree.order[tree.spans[ball, 0] : tree.spans[ball, 1]]] = entry
    out[single] = entries
    return out


def _whole(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


@dataclass
class Fit:
    """Blocks with their trees (stored), and the codebooks: (parts, entries, width) integers."""

    blocks: DataFrame
    books: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _integers(vectors: DataFrame, scale: int, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label and ``v``, the integers filled up to equal parts; the width of a part)."""
    rows = small_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("vector").cast("array<double>").alias("v")).where(_whole(F.col("v")))
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    length = width * parts
    bound = float(1 << (63 - length.bit_length()) // 2 - 1)
    at = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-bound)), F.lit(bound)))
    filled = F.concat(F.transform("v", at), F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("v")))
    return rows.withColumn("v", filled), width


def _blocks(rows: DataFrame, width: int, parts: int, block_rows: int) -> DataFrame:
    """A row per block of neighbours in the input: ids, labels, integers, and a tree per part."""
    most = max(1, min(block_rows, BLOCK_BYTES // (4 * max(1, width * parts))))

    def block(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        points = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(n, parts, width)
        trees = [grown(points[:, p]).packed() for p in range(parts)]
        lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("vec_id", "label")]
        kinds = pa.list_(pa.struct([(k, pa.binary()) for k in trees[0]]))
        return pa.RecordBatch.from_arrays([*lists, pa.array([points.tobytes()], pa.binary()), pa.array([trees], kinds)], ["vec_ids", "labels", "points", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                held.append(batch.slice(a, most))
                n += held[-1].num_rows
                while n >= most:
                    table = pa.Table.from_batches(held)
                    yield block(table[:most])
                    held, n = table[most:].to_batches(), n - most
        if n:
            yield block(pa.Table.from_batches(held))

    label = rows.schema["label"].dataType.simpleString()
    out = f"vec_ids array<bigint>, labels array<{label}>, points binary, trees array<struct<place:binary,spans:binary,pivots:binary,radii:binary,sums:binary>>"
    return rows.mapInArrow(run, out)


def _opened(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[Tree]]]:
    for batch in (b.slice(a, 1) for b in batches for a in range(b.num_rows)):
        points = np.frombuffer(batch.column("points")[0].as_buffer(), "<i4")
        trees = [Tree.unpacked(x, width) for x in batch.column("trees")[0].as_py()]
        yield batch, points.reshape(len(trees[0].order), parts, width), trees


def _refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books after one round: each entry the floored mean of the parts it owns, if it owns any."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for _, points, trees in _opened(batches, parts, width):
            for p, tree in enumerate(trees):
                n, s = totals(tree, points[:, p], books[p])
                counts[p] += n
                sums[p] += s
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["p", "e", "n", "s"])

    rows = blocks.select("points", "trees").mapInArrow(run, "p int, e int, n long, s array<long>")
    exact = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = books.copy()
    for p, e, n, *s in rows.groupBy("p", "e").agg(F.sum("n"), *exact).collect():  # parts x entries rows at most
        out[p, e] = [int(x) // n for x in s]
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> Fit:
    """Codebooks over all rows of ``vectors`` (vec_id, vector, label)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code's index has two hex digits: 1 to 256 entries")
    rows, width = _integers(vectors, scale, parts)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    blocks = written(_blocks(rows, width, parts, block_rows), "blocks")
    for _ in range(rounds):
        books = _refined(blocks, books)
    return Fit(blocks, books)


def coded(found: Fit) -> DataFrame:
    """vec_id, label, code and error of every row."""
    books, label = found.books, found.blocks.schema["labels"].dataType.elementType.simpleString()
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points, trees in _opened(batches, parts, width):
            at = np.stack([assigned(tree, points[:, p], books[p]) for p, tree in enumerate(trees)], 1)
            error = sum(((points[:, p].astype(np.int64) - books[p][at[:, p]]) ** 2).sum(1) for p in range(parts))
            codes = [x.hex() for x in at.astype(np.uint8)[:, :].copy().view(f"V{parts}").ravel().tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_ids").flatten(), batch.column("labels").flatten(), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return found.blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def digest(found: Fit) -> DataFrame:
    """vec_id, label, code, error, label_error (summed over equal labels) and codebooks_sha256."""
    rows = written(coded(found).withColumns({"_none": F.col("label").isNull(), "_label": F.hash("label")}), "codes")
    sums = rows.groupBy("label", "_none", "_label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    held = written(sums.withColumnRenamed("label", "_of"), "labels")
    joined = looked_up(rows, held, ["_none", "_label"]).where(F.col("label").eqNullSafe(F.col("_of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(found.digest).alias("codebooks_sha256"))
