import random

import numpy as np
import pyarrow as pa

from conftest_llm import ALNUM_WORDS, SPACE_WORDS, lower
from fieldspan.llm import wordhash as W
from fieldspan.llm.shared import slices, text_bytes


def joined(docs):
    raw = [d.encode() for d in docs]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_words_are_those_of_the_patterns(monkeypatch):
    monkeypatch.setattr(W, "_SEGMENT", 17)
    random.seed(1)
    seen = {}
    for _ in range(400):
        docs = ["".join(random.choice("ab é\nA.1") for _ in range(random.randint(0, 40))) for _ in range(random.randint(1, 6))]
        data, off = joined(docs)
        for table, pattern, low in ((W.SPACE, SPACE_WORDS, False), (W.NOT_ALNUM, ALNUM_WORDS, True)):
            w = W.words(data, off, table, low)
            got = [[bytes(data[w.start[i] : w.end[i]]).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(docs))]
            want = [pattern.findall(lower(d) if low else d) for d in docs]
            assert [[lower(x) if low else x for x in g] for g in got] == want
            for text, h in zip([x for g in want for x in g], w.hash.tolist()):
                assert seen.setdefault((low, text), h) == h
    assert len({v for (low, _), v in seen.items() if not low}) == sum(not low for low, _ in seen)


def test_very_long_words_differ_by_order():
    a, b = "x" * 5000 + "ab", "x" * 5000 + "ba"
    data, off = joined([a, b, "ab" + "x" * 5000])
    assert len(set(W.words(data, off, W.SPACE).hash.tolist())) == 3


def test_arrow_bytes_of_slices_and_nulls():
    column = pa.array(["ab", None, "é", ""]).slice(1)
    data, off = text_bytes(column)
    assert data.tobytes() == "é".encode() and off.tolist() == [0, 0, 2, 2]
    assert list(slices(np.array([0, 5, 6, 20, 21]), 6)) == [(0, 2), (2, 3), (3, 4)]
