import hashlib
from collections import defaultdict

import numpy as np
import pytest

from fieldspan.llm import vector_codes as V

LONG = (1 << 63) - 1


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain integers, every part against every entry; rows are (vec_id, vector, label)."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    length = -(-max((len(r[1]) for r in rows), default=0) // parts) * parts
    bound = 1 << (63 - length.bit_length()) // 2 - 1
    ints = [[max(-bound, min(bound, int(np.floor(np.float64(max(min(x, 1e30), -1e30)) * 1024)))) for x in r[1]] + [0] * (length - len(r[1])) for r in rows]
    w = length // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i]))[:entries]
    books = [[ints[i][p * w : p * w + w] for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, v: int(((np.array(books[p], np.int64).reshape(len(books[p]), w) - np.array(v, np.int64)) ** 2).sum(1).argmin())
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in ints:
                own[nearest(p, v[p * w : p * w + w])].append(v[p * w : p * w + w])
            for e, vs in own.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for r, v in zip(rows, ints):
        at = [nearest(p, v[p * w : p * w + w]) for p in range(parts)]
        error = sum(far(v[p * w : p * w + w], books[p][e]) for p, e in enumerate(at))
        by[r[2]] += error
        out.append((r[0], "".join(f"{e:02x}" for e in at), error, r[2]))
    return sorted(((i, c, e, min(by[k], LONG), sha) for i, c, e, k in out), key=repr)


def got(spark, rows, kind="double", parts=3, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, vector array<{kind}>, label int, error int, points string").repartition(parts)
    return sorted((tuple(r) for r in V.digest(V.fit(df, **how)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed,block,entries", [(1, 4096, 256), (2, 70, 16), (3, 50, 40)])
def test_against_brute_force(spark, seed, block, entries):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 8))
    v = (centres[rng.integers(0, 9, 400)] + rng.normal(scale=0.2 if seed < 3 else 0.002, size=(400, 8))).astype(np.float32)
    v[100:160] = v[7]  # a hot vector
    if seed == 3:
        v = np.round(v * 3) / 3  # ties
    rows = [(int(i), [float(x) for x in r], int(i) % 3 or None) for i, r in enumerate(v)]
    assert got(spark, rows, "float", block_rows=block, entries=entries) == brute(rows, entries=entries)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.5, -0.0001, 2.0, 9.0], 1), (5, [1.0, 0.5, -0.0001, 2.0, 9.0], 1), (None, [3.0, 1.0], None), (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (6, [-inf, 1.0], 2), (7, [], None), (8, [1e300, -1e300, 5.0], 2), (9, [1.0, 0.25], 2), (9, [0.5, 0.25], 2)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, entries=2, rounds=3, block_rows=2) == brute(rows, entries=2, rounds=3)
    large = [(i, [(-1.0) ** (i * j) * (1 << 14) * (1 + i % 7) + j for j in range(64)], 0) for i in range(60)]
    assert got(spark, large, entries=7) == brute(large, entries=7)
    assert got(spark, [(1, [], None), (2, [], None)]) == brute([(1, [], None), (2, [], None)])
    empty = spark.createDataFrame([], "vec_id long, vector array<float>, label int")
    assert V.digest(V.fit(empty)).count() == 0
    with pytest.raises(ValueError):
        V.fit(empty, entries=300)


def test_balls_hold_their_points_and_give_them_whole():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(500, 6)) * 20 + c for c in (0, 4000, -9000)]).astype(np.int64)
    tree = V.grown(points)
    assert sorted(tree.order.tolist()) == list(range(1500)) and tree.spans[0].tolist()[:2] == [0, 1500]
    for ball, (a, b, left, right) in enumerate(tree.spans.tolist()):
        own = points[tree.order[a:b]]
        assert (tree.sums[ball] == own.sum(0)).all() and np.sqrt(((own - tree.pivots[ball]) ** 2).sum(1)).max() <= tree.radii[ball] * (1 + 1e-12)
        assert left < 0 or (tree.spans[left][0], tree.spans[right][1], tree.spans[left][1]) == (a, b, tree.spans[right][0])
    book = points[[0, 600, 1200]]
    balls, _, single, _ = V.owned(tree, points, book)
    assert not len(single) and len(balls) < 30  # far clusters are never opened
    assert (V.assigned(tree, points, book) == V.distances(points, book).argmin(1)).all()
    counts, sums = V.totals(tree, points, book)
    assert counts.tolist() == [500] * 3 and (sums[1] == points[500:1000].sum(0)).all()
