"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

Distinct vectors are dealt into shards of about ``shard_rows``; beyond SPREAD of them shards grow, up to
SHARD_BYTES, before they become more, as each query walks each shard. In a shard every vector's nearest,
found by products of blocks, are its candidates, and pruning by relaxed distances keeps diverse
edges: a candidate goes if an edge already kept is ``alpha`` times nearer to it than the vector is.
Kept edges also lead back, and a few edges lead anywhere. Queries, packed in blocks of bounded bytes,
are joined to the shards and walk every shard's graph with a beam, from the nearest of a sixteenth of its
rows on; the nearest over all shards are the answer. Walks and prunings run over many vectors at once,
in single precision on vectors moved to the shard's middle and scaled to its width; the answer's
distances are those of the given vectors in double precision.

Every row is indexed. Equal vectors are one node, which carries the ids of its rows up to the
``k + 1`` smallest: with ties to the smaller id no other row of it can be among a query's k nearest.
Vectors that are null, zero, or hold a null or a non-finite component take no part; vectors of
different lengths are never compared. A repeated vec_id is a row of its own: rows with the query's
id are left out of its answer, and of repeated query ids one row, the smallest vector, asks.
Fewer than k candidates give fewer rows; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldspan.llm.shared import small_batches, written

DEGREE = 32
BEAM = 160  #: width of a query's walk
BUILD_BEAM = 64
CANDIDATES = 64  #: nearest rows among which a vector's edges are chosen
LONG = 4  #: edges of each vector to any vectors
ENTRY_EVERY = 16
ALPHA = 1.2
SHARD_ROWS = 4_096
SPREAD = 24  #: so many shards have SHARD_ROWS, then shards grow
SHARD_BYTES = 16 << 20  #: up to this, if that is more than SHARD_ROWS
BLOCK_BYTES = 4 << 20  #: of a block of queries
PRUNE_BYTES = 4 << 20
_BATCH = 256
_FEW = 64
_AT_ONCE = 4


def walk(rows: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam searches of all queries at once: (nodes, squared distances), nearest first.

    Edges of -1 are missing ones. A walk begins at the nearest entries. Each step opens every query's
    nearest nodes not yet opened, and measures, by differences as near copies need, the neighbours
    that the query hasn't met.
    """
    n, at_once = len(queries), min(_AT_ONCE, beam)
    nodes = np.full((n, beam), -1, np.int64)
    near = np.full((n, beam), np.inf, np.float32)
    opened = np.zeros((n, beam), bool)
    met = np.zeros((n, len(rows)), np.min_scalar_type(at_once * edges.shape[1]))
    first = _entered(rows[entries], queries, beam)
    for a in range(0, n, _FEW):
        nodes[a : a + _FEW, : first.shape[1]] = own = entries[first[a : a + _FEW]]
        away = rows[own] - queries[a : a + _FEW, None, :]
        near[a : a + _FEW, : first.shape[1]] = np.einsum("ijk,ijk->ij", away, away)
    met[np.arange(n)[:, None], nodes[:, : first.shape[1]]] = 1
    live = np.arange(n)
    while len(live):
        closed = np.where(opened[live] | (nodes[live] < 0), np.inf, near[live])
        pick = np.argpartition(closed, at_once - 1, 1)[:, :at_once]
        wanted = ~np.isinf(np.take_along_axis(closed, pick, 1))
        more = wanted.any(1)
        live, pick, wanted = live[more], pick[more], wanted[more]
        if not len(live):
            break
        opened[live[:, None], pick] |= wanted
        out = edges[nodes[live[:, None], pick]]
        out[~wanted] = -1
        out = out.reshape(len(live), -1)
        i, j = np.nonzero((out >= 0) & (met[live[:, None], out] == 0))
        to, own = out[i, j], live[i]
        met[own, to] = j + 1  # of a node's places in the lists that are open together one stays
        one = met[own, to] == j + 1
        i, to, own = i[one], to[one], own[one]
        away = rows[to]
        away -= queries[own]
        d = np.einsum("ij,ij->i", away, away)
        good = d < near[live].max(1)[i]
        i, to, d = i[good], to[good], d[good]
        if not len(i):
            continue
        ids, dist = _dealt(i, to, len(live), -1), _dealt(i, d, len(live), np.inf)
        ids, dist, done = np.concatenate([nodes[live], ids], 1), np.concatenate([near[live], dist], 1), np.concatenate([opened[live], np.zeros(ids.shape, bool)], 1)
        best = np.argpartition(dist, beam - 1, 1)[:, :beam]
        nodes[live], near[live], opened[live] = (np.take_along_axis(x, best, 1) for x in (ids, dist, done))
    order = np.argsort(near, 1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)


def _entered(entries: np.ndarray, queries: np.ndarray, beam: int) -> np.ndarray:
    """Each query's nearest entries, at most ``beam``, in no order."""
    if len(entries) <= beam:
        return np.tile(np.arange(len(entries)), (len(queries), 1))
    d = np.einsum("ij,ij->i", entries, entries) - 2 * (queries @ entries.T)
    return np.argpartition(d, beam - 1, 1)[:, :beam]


def _dealt(row: np.ndarray, values: np.ndarray, n: int, fill: float) -> np.ndarray:
    """The values of ascending rows as a matrix of n rows, filled up on the right."""
    first = np.searchsorted(row, np.arange(n + 1))
    out = np.full((n, int(np.diff(first).max(initial=0))), fill, values.dtype)
    out[row, np.arange(len(row)) - first[row]] = values
    return out


def neighbours(rows: np.ndarray, small: np.ndarray, count: int) -> np.ndarray:
    """Each row's ``count`` nearest other rows of the shard, in no order.

    Products in single precision (``small``) find them, and in double precision where they lie so near
    that single precision can't tell them apart.
    """
    found, square = _by_products(small, np.arange(len(rows)), count)
    near = np.flatnonzero(square < 1e-3 * np.einsum("ij,ij->i", small, small))
    found[near] = _by_products(rows, near, count)[0]
    return found


def _by_products(rows: np.ndarray, of: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ``count`` nearest other rows of each row of ``of``, a bound of their squared distances).

    The least values of stretches of a row of distances bound its ``count``-th distance from above, so
    that only a few of the distances have to be sorted.
    """
    n, width = rows.shape
    stretch = max(1, min(32, n // (8 * count)))
    every = np.zeros((-(-n // stretch) * stretch, width + 1), rows.dtype)
    every[:n, :width], every[:, width] = rows, np.inf
    every[:n, width] = lengths = np.einsum("ij,ij->i", rows, rows)
    held = np.empty((_FEW, len(every)), rows.dtype)
    found, square = np.empty((len(of), count), np.int64), np.empty(len(of))
    for a in range(0, len(of), _FEW):
        own = of[a : a + _FEW]
        m = len(own)
        d = np.matmul(np.append(-2 * rows[own], np.ones((m, 1), rows.dtype), 1), every.T, out=held[:m])
        d[np.arange(m), own] = np.inf
        bound = np.partition(d.reshape(m, stretch, -1).min(1), count - 1, 1)[:, count - 1 : count]
        i, j = np.nonzero(d <= bound)
        best = np.argpartition(_dealt(i, d[i, j], m, np.inf), count - 1, 1)[:, :count]
        found[a : a + m] = np.take_along_axis(_dealt(i, j, m, -1), best, 1)
        square[a : a + m] = bound[:, 0] + lengths[own]
    return found, square


def prune(rows: np.ndarray, of: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse edges for each node of ``of`` out of its candidates (-1: none), nearest first."""
    n, width = found.shape
    found = np.sort(found, 1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    points = rows[np.maximum(found, 0)] - rows[of][:, None, :]
    own = np.einsum("ijk,ijk->ij", points, points)
    between = own[:, :, None] + own[:, None, :] - 2 * (points @ points.transpose(0, 2, 1))
    d = own.copy()
    d[(found < 0) | (found == of[:, None])] = np.inf
    kept = np.full((n, degree), -1, np.int64)
    at = np.arange(n)
    open_d = d.copy()
    for k in range(degree):
        pick = open_d.argmin(1)
        live = ~np.isinf(open_d[at, pick])
        if not live.any():
            break
        kept[live, k] = found[at, pick][live]
        open_d[at[live], pick[live]] = np.inf
        open_d[(alpha * alpha * between[at, pick] <= d) & live[:, None]] = np.inf
    return kept


def _batches(n: int, width: int, components: int) -> Iterator[slice]:
    """Slices of n nodes whose candidates, ``width`` each, and the distances between those stay small."""
    step = max(1, min(_BATCH, PRUNE_BYTES // (4 * width * (width + components))))
    return (slice(a, a + step) for a in range(0, n, step))


def build(rows: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) of a shard's graph over rows about their middle."""
    n, small = len(rows), rows.astype(np.float32)
    start = int(((small - small.mean(0)) ** 2).sum(1).argmin())
    if n <= degree + 1:
        every = np.tile(np.arange(n), (n, 1))
        return np.where(every == np.arange(n)[:, None], -1, every), np.array([start])
    rng = np.random.default_rng(n)
    far = rng.integers(0, n, (n, LONG))
    found = np.concatenate([neighbours(rows, small, min(candidates, n - 1)), far], 1)
    kept = np.concatenate([prune(small, np.arange(n)[x], found[x], degree, alpha) for x in _batches(n, found.shape[1], rows.shape[1])])
    edges = np.concatenate([_lead_back(small, kept, alpha), far], 1)
    entries = np.union1d(rng.choice(n, -(-n // ENTRY_EVERY), replace=False), [start])
    return _connected(small, edges, start, entries), entries


def _connected(rows: np.ndarray, edges: np.ndarray, start: int, entries: np.ndarray, spare: int = 8) -> np.ndarray:
    """The edges, and further ones to nodes that no path from ``start`` reached, from nodes near them."""
    while True:
        reached = np.zeros(len(rows), bool)
        front = np.array([start])
        reached[front] = True
        while len(front):
            to = np.unique(edges[front])
            front = to[(to >= 0) & ~reached[np.maximum(to, 0)]]
            reached[front] = True
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return edges
        added = 0
        for a in range(0, len(lost), _BATCH):
            found, _ = walk(rows, edges, entries, rows[lost[a : a + _BATCH]], BUILD_BEAM)
            for node, near in zip(lost[a : a + _BATCH], found):
                for v in near[near >= 0].tolist():
                    free = np.flatnonzero(edges[v] < 0)
                    if len(free) and reached[v]:
                        edges[v, free[0]] = node
                        added += 1
                        break
        if not added:
            edges = np.concatenate([edges, np.full((len(rows), spare), -1, np.int64)], 1)


def _lead_back(rows: np.ndarray, kept: np.ndarray, alpha: float) -> np.ndarray:
    """The edges with those that lead back; a list that grows too long is pruned again."""
    n, degree = kept.shape
    to, source = kept.T.ravel(), np.tile(np.arange(n), degree)  # of many edges to a node the nearest come first
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    to, source = to[to >= 0], source[to >= 0]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    to, source = to[place < 2 * degree], source[place < 2 * degree]
    back = _dealt(to, source, n, -1)
    every = -np.sort(-np.concatenate([kept, back, np.full((n, 1), -1)], 1), 1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    every = -np.sort(-every, 1)
    edges, full = every[:, :degree].copy(), np.flatnonzero(every[:, degree] >= 0)
    for x in _batches(len(full), every.shape[1], rows.shape[1]):
        edges[full[x]] = prune(rows, full[x], every[full[x]], degree, alpha)
    return edges


def valid(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nodes(vectors: DataFrame, k: int) -> DataFrame:
    """vector and the ids of its rows, at most the k + 1 smallest: no answer holds more of them."""
    hashed = vectors.withColumn("h", F.xxhash64("vector"))  # sorts by a long, and by vectors only where that is equal
    ranked = hashed.withColumn("r", F.row_number().over(Window.partitionBy("h", "vector").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("h", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).drop("h")


def _centred(rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(middle, width, the rows about the middle): x is (x / width - middle)."""
    width = float(np.abs(rows).max())
    middle = (rows / width).mean(0)
    rest = rows / width - middle
    more = float(np.abs(rest).max()) or 1.0
    return middle / more, width * more, rest / more


def _shards(rows: int, components: int | None, shard_rows: int) -> int:
    """How many shards: of ``shard_rows`` first, then as many rows as SPREAD shards need, within SHARD_BYTES."""
    most = rows * SHARD_BYTES // (8 * components) if components else 0
    return max(1, -(-rows // max(shard_rows, min(-(-rows // SPREAD), most))))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, degree: int = DEGREE, alpha: float = ALPHA, shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found; both inputs have vec_id and vector.

    Neither vectors nor queries come to the driver: a block of queries meets a shard's graph in a join.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    nodes = written(_nodes(clean(small_batches(vectors)), k), "vectors")
    asked = written(clean(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    n_shards = _shards(*nodes.agg(F.count("*"), F.sum(F.size("vector"))).first(), shard_rows)
    n_blocks = 1 + (asked.agg(F.sum(F.size("vector"))).first()[0] or 0) * 8 // block_bytes
    placed = lambda df, key, n: df.withColumns({"d": F.size("vector"), "s": F.pmod(F.xxhash64(key), F.lit(n)).cast("int")})

    def graph(table: pa.Table) -> pa.Table:
        rows = _matrix(table.column("vector"))
        middle, width, small = _centred(rows)
        edges, entries = build(small, degree, CANDIDATES, alpha)
        lists = table.column("ids").combine_chunks()
        sizes, ids = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        one = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
        return pa.table({"d": table.column("d")[:1], "s": table.column("s")[:1], "entries": one(entries, "<i4"), "width": pa.array([width]), "middle": one(middle, "<f8"), "rows": one(rows, "<f8"), "edges": one(edges, "<i4"), "sizes": one(sizes, "<i4"), "ids": one(ids, "<i8")})

    def block(table: pa.Table) -> pa.Table:
        ids, rows = table.column("vec_id").to_numpy(), _matrix(table.column("vector"))
        return pa.table({"d": table.column("d")[:1], "q_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "q_rows": pa.array([rows.tobytes()], pa.binary())})

    width = n_shards * 8 if n_shards <= 128 else 1024  # few shards, each much work: hardly any two in one task
    graphs = written(placed(nodes, "vector", n_shards).repartition(width, "d", "s").groupBy("d", "s").applyInArrow(graph, "d int, s int, entries binary, width double, middle binary, rows binary, edges binary, sizes binary, ids binary"), "graphs")
    blocks = written(placed(asked, "vec_id", n_blocks).groupBy("d", "s").applyInArrow(block, "d int, q_ids binary, q_rows binary"), "blocks")
    # a block counts as small to the planner, but with a copy for each shard it isn't: no broadcast
    met = blocks.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).repartition(width, "d", "s").hint("merge").join(graphs.repartition(width, "d", "s"), ["d", "s"])
    ranked = _searched(met, k, beam).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _searched(met: DataFrame, k: int, beam: int) -> DataFrame:
    """Each shard's k nearest rows to each query of a block, for rows of a block and a shard's graph."""
    width = max(beam, 2 * k)
    names = ("d", "width", "entries", "middle", "rows", "edges", "sizes", "ids", "q_ids", "q_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 1) for b in batches for a in range(b.num_rows)):
            d, scale, *raw = (batch.column(c)[0] for c in names)
            d, scale = d.as_py(), scale.as_py()
            entries, middle, rows, edges, sizes, ids, q_ids, q_rows = (np.frombuffer(x.as_buffer(), t) for x, t in zip(raw, ("<i4", "<f8", "<f8", "<i4", "<i4", "<i8", "<i8", "<f8")))
            rows, q_rows = rows.reshape(-1, d), q_rows.reshape(-1, d)
            edges = edges.reshape(len(rows), -1).astype(np.int64)
            begins = np.cumsum(sizes) - sizes
            small = (rows / scale - middle).astype(np.float32)
            for a in range(0, len(q_ids), _BATCH):
                moved = np.clip(q_rows[a : a + _BATCH] / scale - middle, -1e15, 1e15).astype(np.float32)
                nodes, _ = walk(small, edges, entries, moved, width)
                out_q, out_v, out_s = [], [], []
                for x, q in enumerate(q_ids[a : a + _BATCH].tolist()):
                    mine = nodes[x][nodes[x] >= 0]
                    score = np.sqrt(((rows[mine] - q_rows[a + x]) ** 2).sum(1))
                    count = sizes[mine]
                    at = np.repeat(begins[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    v, s_all = ids[at], np.repeat(score, count)
                    v, s_all = v[v != q], s_all[v != q]
                    best = np.lexsort((v, s_all))[:k]
                    out_q.append(np.full(len(best), q))
                    out_v.append(v[best])
                    out_s.append(s_all[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    return met.select(*names).mapInArrow(run, "query_id long, vec_id long, score double")
