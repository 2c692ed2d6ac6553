import random

import numpy as np
import pytest

from conftest_llm import SPACE_WORDS, lower
from fieldspan.llm import ngram_join as N
from fieldspan.llm.components import connected


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = SPACE_WORDS.findall(lower(t or ""))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[random.choice(words) for _ in range(random.choice([1, 2, 3, 5, 8, 12, 20, 40, 80, 200]))] for _ in range(30)]
    rows = []
    for i in range(350):
        b = list(random.choice(base[:5] if random.random() < 0.5 else base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5])):
            if b and random.random() < 0.8:
                b[random.randrange(len(b))] = random.choice(words)
            else:
                b.insert(random.randint(0, len(b)), random.choice(words))
        rows.append((i * 3, " ".join(b) if random.random() < 0.9 else "\t".join(b).upper()))
    return rows + [(5000, None), (5001, ""), (5002, "  \n"), (5003, None)]


@pytest.mark.parametrize("seed,n,percent,chunk", [(1, 3, 90, 1024), (2, 5, 80, 16), (3, 3, 90, 16)])
def test_components_against_brute_force(spark, docs_of, seed, n, percent, chunk):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.components(docs_of(rows), n, percent, chunk).collect()}
    assert got == brute(rows, n, percent)


@pytest.mark.parametrize("hot", [2, 4])
def test_leaders_lose_no_link(spark, docs_of, monkeypatch, hot):
    import fieldspan.llm.ngram_join as module

    rows = corpus(7)
    sets = [np.unique(s) for s in module.sets_of(np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8), np.cumsum([0, *[len((t or "").encode()) for _, t in rows]]), 3)]
    sizes, sketches = [len(s) for s in sets], [module.sketch(s).tobytes() for s in sets]
    words, folded = np.array([len(r) // 8 for r in sketches]), module._folded(sketches)
    near = [[i for i, s in enumerate(sets) if i != j and module._allowed(np.array(sizes), words, folded, np.array([i]), np.array([j]), 80)[0]] for j in range(60)]
    flags = np.zeros(len(sets), bool)
    for u in range(60):  # u leads x, v leads y, x and y may link: u and v must stay a pair
        for x in near[u][:5]:
            for y in [y for y in near[x] if y < 60][:5] if x < 60 else []:
                for v in near[y][:5]:
                    flags[:] = False
                    flags[[u, v]] = True
                    assert module._allowed(np.array(sizes), words, folded, np.array([u]), np.array([v]), 80, flags)[0]
    monkeypatch.setattr(module, "HOT", hot)
    leaders = module._Leaders(sizes, sketches, 80)
    kept, leads = leaders.among(np.arange(60))
    led = {int(a): int(b) for x, y in leaders.edges for a, b in zip(x, y)}
    assert sorted([*kept.tolist(), *led]) == list(range(60)) and {b for b in led.values()} == set(kept[leads].tolist())


def test_form_letters_over_several_slices(spark):
    template = " ".join(f"t{k}" for k in range(92))
    own = lambda i, k: f"{template} " + " ".join(f"o{i}x{j}" for j in range(k))
    slices = [[(1000 * s + i, own(1000 * s + i, 5 if i == 77 else 15)) for i in range(150)] for s in range(3)]
    rows = [r for s in slices for r in s]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.components(docs).collect()}
    assert got[1077] == got[2077] == (95, 77)
    assert got == brute(rows, 3, 90)


def test_repeated_null_and_no_rows(spark, docs_of, empty_docs):
    rows = [(7, "a b c d"), (7, "a b c d"), (3, "A b  c d"), (None, "a b c d"), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.components(docs_of(rows)).collect()), key=repr)
    assert got == sorted([(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 2, None), (None, 0, None)], key=repr)
    kept = N.deduplicated(docs_of(rows), 3, 90)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, None, None], key=repr)
    assert N.components(empty_docs).count() == N.deduplicated(empty_docs).count() == 0


def test_rows_of_one_doc_id_with_unequal_texts(spark, docs_of):
    text = lambda c, k: " ".join(f"{c}{j}" for j in range(60)) + f" end{k}"
    rows = [(7, text("a", 0)), (3, text("a", 0)), (7, text("b", 0)), (9, text("b", 1)), (7, text("c", 0)), (8, text("c", 2)), (20, text("d", 0)), (7, None), (1, "x")] * 2
    got = {(r.doc_id, r.component_id) for r in N.components(docs_of(rows)).collect() if r.n_shingles}
    assert got == {(7, 3), (3, 3), (9, 3), (8, 3), (20, 20), (1, 1)}


def test_partners_share_a_part():
    rng = np.random.default_rng(3)
    for percent in (70, 80, 90):
        parts = N.Parts(percent)
        for _ in range(400):
            a = int(rng.integers(1, 400))
            both = rng.integers(0, 2**63, a, dtype=np.uint64)
            cut, more = int(rng.integers(0, a // 4 + 1)), int(rng.integers(0, a // 4 + 1))
            x = np.unique(both)
            y = np.unique(np.concatenate([both[cut:], rng.integers(0, 2**63, more, dtype=np.uint64)]))
            shared = len(np.intersect1d(x, y))
            if len(y) and 100 * shared >= percent * (len(x) + len(y) - shared):
                assert len(np.intersect1d(parts.hashes(x), parts.hashes(y)))


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 500, int(rng.integers(1, 400))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in "ab")
        folded = N._folded([N.sketch(x).tobytes(), N.sketch(y).tobytes()])
        w = min(len(N.sketch(x)), len(N.sketch(y)))
        place, rows = folded[w]
        assert np.bitwise_count(rows[place[0]] ^ rows[place[1]]).sum() <= len(np.setxor1d(x, y))


def test_long_chain_is_one_component(spark):
    edges = spark.range(1, 300).selectExpr("id a", "id - 1 b")
    got = connected(edges).collect()
    assert len(got) == 299 and {r.label for r in got} == {0}
