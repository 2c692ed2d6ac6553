import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from fieldspan.llm import byte_bpe as B  # noqa: E402

ENC = B.encoding(public_tokenizers.path(B.RANKS))


def test_cuts_change_nothing():
    random.seed(3)
    for _ in range(1500):
        s = "".join(random.choice("ab  \n\té 　'.s1%̀日。,я\x1c\x85_²Ⅷ") for _ in range(random.randint(0, 200)))
        assert "".join(B.pieces(s, 5)) == s
        assert [i for p in B.pieces(s, 5) for i in ENC.encode_ordinary(p)] == ENC.encode_ordinary(s)


@pytest.mark.parametrize("text", ["слово ещё, " * 30, "λόγος και " * 30, "我们的语言，没有空格。" * 30])
def test_long_texts_of_any_script_are_cut(text):
    assert max(map(len, B.pieces(text, 20))) < 60
    assert [i for p in B.pieces(text, 20) for i in ENC.encode_ordinary(p)] == ENC.encode_ordinary(text)


def test_round_trip(spark, docs_of, empty_docs):
    rows = [(1, "Hello <|endoftext|> é\n\n x"), (2, None), (3, ""), (3, "ab " * 50000), (4, "z" * 70000)]
    got = {(r.doc_id, r.n_tokens): r for r in B.round_trip(docs_of(rows)).collect()}
    for i, t in rows:
        ids = ENC.encode_ordinary(t or "")
        r = got[i, len(ids)]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert B.round_trip(empty_docs).count() == 0


def test_general_interface(spark, docs_of):
    docs = docs_of([(1, "some text"), (2, None)])
    got = {r.doc_id: bytes(r.raw) for r in B.decoded(B.tokenized(docs)).collect()}
    assert got == {1: b"some text", 2: b""}
