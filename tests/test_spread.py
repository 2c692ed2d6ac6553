"""Order statistics in buckets give the rows of one window or buffer."""

import random

import pytest
from pyspark.sql import functions as F

from fieldspan.operators import spread as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(g, i, rng.choice([None, 5.0, 5.0, rng.gauss(0, 1), rng.gauss(0, 1) ** 5, float(rng.randint(0, 9))]), rng.random()) for g, n in ((1, 900), (2, 50), (3, 1), (4, 400)) for i in range(n)]
    data += [(5, i, None, 1.0) for i in range(3)] + [(6, i, 2.5, float(i)) for i in range(300)]
    return spark.createDataFrame(data, "g int, i int, v double, w double").repartition(5).cache()


def same(a, b, keys):
    pick = lambda df: sorted((tuple(r[k] for k in keys), tuple(round(x, 9) if isinstance(x, float) else tuple(None if y is None else round(y, 9) for y in x) if isinstance(x, list) else x for x in r)) for r in df.select(*keys, *[c for c in sorted(df.columns) if c not in keys]).collect())
    assert pick(a) == pick(b)


def test_quantiles(rows):
    p = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]
    same(S.quantiles(rows, "v", ["g"], p, most=10, buckets=16), S.quantiles(rows, "v", ["g"], p), ["g"])
    assert S.quantiles(rows, "v", [], p, most=10, buckets=16).first().q == pytest.approx(S.quantiles(rows, "v", [], p).first().q)


def test_percent_rank(rows):
    same(S.percent_rank(rows, "v", ["g"], "r", most=10, buckets=16), S.percent_rank(rows, "v", ["g"], "r"), ["g", "i"])


@pytest.mark.parametrize("kind,own", [("max", True), ("min", False), ("max", False)])
def test_running(rows, kind, own):
    a, b = (S.running(rows, "w", ["g"], ["v", "i"], "m", kind, own, most=m, buckets=16) for m in (10, 10**6))
    same(a, b, ["g", "i"])


def test_a_group_takes_many_tasks(spark):
    many = spark.range(20_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    b = S.bucketed(many, "v", ["g"], 32).groupBy("_b").count().collect()
    assert len(b) == 32 and max(r["count"] for r in b) < 1000


def test_skylines_in_pairs_of_blocks(spark):
    from fieldspan.operators import frontier as O

    rng = random.Random(9)
    data = [(g, i, rng.random(), round(rng.random(), 2), rng.random(), round(rng.gauss(0, 1), 2)) for g, n in ((1, 400), (2, 90), (3, 1)) for i in range(n)]
    data += [(1, 1000 + i, *data[i][2:]) for i in range(40)]  # equal points
    df = spark.createDataFrame(data, "g int, i int, a double, b double, c double, y double").repartition(3)
    for inputs in (["a", "b", "c"], ["b"]):
        at = [3 + "abc".index(c) - 1 for c in inputs]
        beats = lambda p, q: p[5] >= q[5] and all(p[k] <= q[k] for k in at)
        want = {(q[0], q[1]) for q in data if not any(p[0] == q[0] and p[1] != q[1] and beats(p, q) and (not beats(q, p) or p[1] < q[1]) for p in data)}
        for block in (30, 10_000):
            assert {(r.g, r.i) for r in O.non_dominated(df, ["g"], inputs, "y", ("i",), block).collect()} == want
