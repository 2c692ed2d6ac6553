import hashlib
import random
from collections import Counter

import pytest

from conftest_llm import SPACE_WORDS
from fieldspan.llm import substring_dedup as D


def brute(rows, window=35):
    texts = [SPACE_WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,group", [(1, 4096), (2, 3), (4, 50)])
def test_against_brute_force(spark, docs_of, seed, group):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[random.choice(words) for _ in range(random.choice([34, 35, 36, 40, 60, 120]))] for _ in range(12)]
    rows = []
    for i in range(200):
        w = []
        for _ in range(random.randint(0, 6)):
            w += random.choice(passages)[random.randint(0, 10) :] if random.random() < 0.5 else [random.choice(words) for _ in range(random.randint(1, 60))]
        if seed == 4 and i % 3 == 0:
            w = w + ["x"] * random.randint(30, 80) + ["a", "b"] * random.randint(10, 40)
        rows.append((i, " ".join(w) if i % 2 else "\n ".join(w) + " "))
    rows += [(900, None), (901, ""), (902, " ".join(passages[3])), (902, " ".join(passages[3])), (None, "q " * 50), (None, " ".join(words[:50])), (903, " ".join(words[:50]))]
    assert sorted((tuple(r) for r in D.digest(docs_of(rows), group=group).collect()), key=repr) == brute(rows)


def test_ranges_of_equal_rows_are_one_set_and_very_long_texts(spark, docs_of):
    text = " ".join(f"e{i % 50}" for i in range(60))
    few = docs_of([(7, text)] * 30)
    seen = [D._with_ranges(docs, D.covered(docs)).select("found").collect() for docs in (few, docs_of([(7, text)] * 300))]
    assert {len(r.found) for rows in seen for r in rows} == {len(seen[0][0].found)} and len(seen[1]) == 300
    long_words = " ".join("y" * 40_000 + str(i) for i in range(40))
    random.seed(11)
    very_long = " ".join(random.choice(["a", "b", "c", *map(str, range(3000))]) for _ in range(60_000))
    rows = [(1, very_long), (2, very_long[:50_000] + " z"), (3, long_words), (4, long_words + " q"), (5, text), *[(6, text)] * 40, (8, "y" * 3_000_000)]
    assert sorted((tuple(r) for r in D.digest(docs_of(rows)).collect()), key=repr) == brute(rows)


def test_groups_beyond_a_tree_by_bytes(spark, docs_of, monkeypatch):
    monkeypatch.setattr(D, "GROUP_BYTES", 500)
    passage = " ".join(f"w{i}" for i in range(45))
    rows = [(i, f"x{i} {passage} y{i % 3}") for i in range(12)] + [(20, passage + " " + passage)]
    assert sorted((tuple(r) for r in D.digest(docs_of(rows)).collect()), key=repr) == brute(rows)


def test_cut_keeps_columns_and_untouched_texts(spark, docs_of, empty_docs):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"a  {passage} b"), (2, f"{passage}"), (3, "left  as it is"), (4, None)]
    out = D.cut(docs_of(rows))
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("a b", 3), 2: ("", 0), 3: ("left  as it is", 14), 4: (None, None)}
    assert out.columns == docs_of(rows).columns
    assert D.digest(empty_docs).count() == D.cut(empty_docs).count() == 0
    with pytest.raises(ValueError):
        D.covered(empty_docs, window=5)


def test_tree_gives_maximal_repeats():
    random.seed(9)
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 25))) for _ in range(6)]
    runs = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w)):
            for j in range(i + 3, len(w) + 1):
                runs.setdefault(tuple(w[i:j]), []).append((d, i))
    want = set()
    for run, places in runs.items():
        if len(places) > 1:
            n = len(run)
            sides = [{(texts[d].split()[i + n] if i + n < len(texts[d].split()) else (d, i)) for d, i in places}, {(texts[d].split()[i - 1] if i else (d, i)) for d, i in places}]
            if all(len(x) > 1 for x in sides):
                want.add((n, tuple(sorted(places))))
    assert D.maximal_repeats(texts, 3) == want and D.maximal_repeats([], 3) == D.maximal_repeats(["", "a b"], 3) == set()
