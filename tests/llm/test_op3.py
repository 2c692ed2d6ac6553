import numpy as np
import pytest

from fieldspan.llm import graph_ann as G


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    v = (centres[rng.integers(0, 12, 1500)] + rng.normal(scale=0.6, size=(1500, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r], 1) for i, r in enumerate(v)], "vec_id long, vector array<float>, rank int").repartition(4)
    got = {}
    for r in G.nearest(df, df.where("vec_id % 100 = 0"), shard_rows=400).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(got) == 15
    hits, exact = 0, v.astype(np.float64)
    for q, rows in got.items():
        rows.sort()
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        assert [r[0] for r in rows] == list(range(1, 11)) and q not in [r[1] for r in rows]
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        assert np.allclose([s for _, _, s in rows], [d[i] for _, i, _ in rows], rtol=1e-12)
        best = [i for i in np.lexsort((np.arange(1500), d)).tolist() if i != q][:10]
        hits += len(set(best) & {i for _, i, _ in rows})
    assert hits >= 0.9 * 150


@pytest.mark.parametrize("offset,scale", [(1e6, 1.0), (0.0, 1e120), (-3e9, 1e3)])
def test_offsets_and_large_components(spark, offset, scale):
    rng = np.random.default_rng(5)
    v = offset + scale * rng.normal(size=(700, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, vector array<double>").repartition(3)
    got = {}
    for r in G.nearest(df, df.where("vec_id % 100 = 0"), shard_rows=300, block_bytes=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = v / np.abs(v).max()
    best = {q: [i for i in np.argsort(((unit - unit[q]) ** 2).sum(1)).tolist() if i != q][:10] for q in range(0, 700, 100)}
    hits = sum(len(got[q] & set(best[q])) for q in best)
    assert len(got) == 7 and hits >= 63


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 2.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [9.0]), (200, None)]
    rows += [(i, [1.0, 0.0]) for i in range(20, 40)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in G.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 0] == [1, *range(20, 29)]
    assert {g[0] for g in got} == {0}
    empty = df.where("vec_id < 0")
    assert G.nearest(empty, empty).count() == 0
    few = df.where("vec_id in (0, 1, 7)")
    assert [(r.vec_id, r.score) for r in G.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 0.0), (7, 5**0.5)]


def _stored(monkeypatch):
    """The frames that ``written`` stores from now on, by name."""
    kept, real = {}, G.written
    monkeypatch.setattr(G, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    return kept


def test_shards_grow_instead_of_becoming_many(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2400, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, vector array<double>").repartition(3)
    kept = _stored(monkeypatch)
    rows = G.nearest(df, df.where("vec_id % 100 = 0"), shard_rows=20).collect()
    sizes = [len(r.ids) // 8 for r in kept["graphs"].select("ids").collect()]
    assert len(sizes) == G.SPREAD and sum(sizes) == 2400  # queries meet 24 shards, not 120; every row is in one
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    best = {q: [i for i in np.argsort(((v - v[q]) ** 2).sum(1)).tolist() if i != q][:10] for q in range(0, 2400, 100)}
    assert sum(len(got[q] & set(best[q])) for q in best) >= 0.95 * 240
    monkeypatch.setattr(G, "SHARD_BYTES", 50 * 8 * 8)
    assert G._shards(2400, 2400 * 8, 20) == 48 and G._shards(0, None, 20) == 1 and G._shards(3, 3 * 10**6, 4096) == 1


def test_copies_of_query_blocks_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "vec_id long, vector array<double>").repartition(3)
    found = G.nearest(df, df.where("vec_id % 100 = 0"), shard_rows=20)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 30


def test_neighbours_with_near_copies():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 24))
    v[:1500] = v[0] + 1e-6 * rng.normal(size=(1500, 24))
    _, _, rows = G._centred(v)
    found = G.neighbours(rows, rows.astype(np.float32), 20)
    for i in (0, 7, 1499, 1500, 2999):
        d = ((rows - rows[i]) ** 2).sum(1)
        d[i] = np.inf
        assert len(set(found[i].tolist())) == 20 and d[found[i]].max() <= np.sort(d)[19] * 1.001


def test_recall_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 24))
    v[:2000] = v[0] + 1e-5 * rng.normal(size=(2000, 24))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, vector array<double>").repartition(3)
    got = {}
    for r in G.nearest(df, df.where("vec_id % 100 = 0"), shard_rows=3000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    best = {q: [i for i in np.argsort(((v - v[q]) ** 2).sum(1)).tolist() if i != q][:10] for q in range(0, 3000, 100)}
    assert sum(len(got[q] & set(best[q])) for q in best) >= 0.95 * 300
