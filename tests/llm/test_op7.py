import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from fieldspan.llm import token_files as T  # noqa: E402

from tokenizers import Tokenizer  # noqa: E402

PATH = public_tokenizers.path(T.VOCABULARY)
FRESH = Tokenizer.from_file(PATH)
ODD = list("abC  \n\té 　'sdAÍİﬁ1%<|>̀\x1c\x85日本語ßΣς") + ["<|endoftext|>", "<|startoftext|>", "'ll", "don't"]


def texts(n):
    random.seed(5)
    return ["".join(random.choice(ODD) for _ in range(random.randint(0, 60))) for _ in range(n)]


def test_ids_are_the_librarys():
    docs = texts(800)
    raw = [d.encode() for d in docs]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    enc = T.WordEncoder(PATH, most=300)
    for a in (0, 400):
        ids, ends = enc.encode(np.frombuffer(b"".join(raw), np.uint8)[off[a] : off[a + 400]], off[a : a + 401] - off[a])
        for k in range(400):
            assert ids[ends[k] : ends[k + 1]].tolist() == FRESH.encode(docs[a + k], add_special_tokens=False).ids


def test_special_tokens_in_texts():
    raw = b"a <|endoftext|> b x<|startoftext|>y"
    ids, _ = T.WordEncoder(PATH).encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert ids.tolist() == FRESH.encode(raw.decode(), add_special_tokens=False).ids and 49407 in ids and 49406 in ids


def test_random_access():
    rng = np.random.default_rng(1)
    x = rng.choice(np.array([0, 1, 255, 256, 49407, 70000, 1 << 25], np.uint32), 3000)
    s = T.Shard(T.pack(np.array([5, 6]), np.array([1000, 3000]), x))
    assert (s.read(0, 3000) == x).all() and all(s.token(i) == x[i] for i in range(3000)) and s.ends.tolist() == [1000, 3000]
    for a, b in rng.integers(0, 3001, (300, 2)):
        assert (s.read(min(a, b), max(a, b)) == x[min(a, b) : max(a, b)]).all()
    assert len(T.Shard(T.pack(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint32))).read(0, 0)) == 0
    with pytest.raises(ValueError):
        T.Shard(b"nothing at all")


def test_round_trip(spark, docs_of, empty_docs, monkeypatch):
    monkeypatch.setattr(T, "SHARD_TOKENS", 50)
    rows = list(enumerate(texts(150))) + [(200, None), (201, ""), (None, "a b"), (None, None), (-(2**63), "least"), (7, "again")]
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.round_trip(docs_of(rows)).collect()), key=lambda r: r[1])
    at = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*FRESH.encode(t or "", add_special_tokens=False).ids, 1]
        assert got.pop(0) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got and T.round_trip(empty_docs).count() == 0
