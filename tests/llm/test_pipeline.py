import hashlib

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402
from fieldspan.llm import byte_bpe as B  # noqa: E402


def test_stages_take_effect(spark, tmp_path):
    item = " ".join(f"bench{k}" for k in range(12))
    prose = lambda seed: " ".join(f"word{(seed * 31 + k * k) % 97} und" for k in range(60))
    rows = [(i, prose(i), "de") for i in range(30)]
    rows += [(40, prose(3), "de"), (41, prose(4) + " x", "de"), (42, prose(50) + " " + item, "de"), (43, item, "de"), (44, prose(60) + " token = abcdefghijkl1234", "de"), (45, "12345", "de"), (46, None, "de")]
    full = [(i, t, g, "s", len(t or "")) for i, t, g in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {*range(30), 42, 44}
    assert "bench" not in left[42].text and left[44].text.endswith("[SECRET]") and all(left[i].n_chars == len(left[i].text) for i in left)
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    enc = B.encoding(B.public_tokenizers.path(B.RANKS))
    assert set(got) == set(left)
    for i, r in got.items():
        assert r.n_tokens == len(enc.encode_ordinary(left[i].text)) and r.decoded_sha256 == hashlib.sha256(left[i].text.encode()).hexdigest()


def test_empty_tables_clashing_columns_ties_and_long_texts(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, gram string, key string, met boolean, found string, k long"
    long = " ".join(f"lang{k} und" for k in range(30000))
    rows = [(1, long, "de"), (2, long, "de"), (2, long, "de"), (3, "kurz und gut", "de"), (None, long, None), (None, None, None), (4, "", "de")]
    for name, some in (("full", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame([(i, t, g, "s", len(t or ""), "x", "y", True, "z", 7) for i, t, g in some], names).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for stage, f in P.STAGES[:-1]:
            out = f(spark, docs, str(folder))
            assert out.columns == docs.columns, stage
            docs = spark.createDataFrame(out.collect(), out.schema)
        # of equal texts the smallest doc_id stays, and a null doc_id is linked with nothing
        assert sorted((r.doc_id or -1 for r in docs.collect())) == ([-1, 1, 3] if some else [])
        assert P.run(spark, str(folder)).count() == (3 if some else 0)
