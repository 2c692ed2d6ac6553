import pytest

from fieldspan.llm import shared


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)


def test_written_tables_can_be_removed(spark):
    df = shared.written(spark.range(3).toDF("x"), "some")
    path = df.inputFiles()[0]
    assert df.count() == 3
    shared.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_bitmaps_miss_no_key(spark):
    ids = spark.range(0, 4000, 7).toDF("id")
    rows = spark.range(-100, 5000).selectExpr("if(id = 11, null, id) as id")
    got = {r.id: r.hit for r in shared.marked(rows, "id", ids, "hit").collect()}
    assert all(got[k] for k in range(0, 4000, 7)) and not got[None] and sum(got.values()) < 572 + 500
