import hashlib
import random

import pytest

from conftest_llm import ALNUM_WORDS, lower
from fieldspan.llm import decontaminate as D


def brute(rows, items, window=10):
    out = []
    for i, t in rows:
        w, hit, met = ALNUM_WORDS.findall(lower(t or "")), set(), set()
        for name, item in items:
            x = ALNUM_WORDS.findall(lower(item or ""))
            for win in [x] if 0 < len(x) < window else [x[j : j + window] for j in range(len(x) - window + 1)]:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        met.add(str(name))
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,block", [(1, D.BLOCK_BYTES), (2, 200)])
def test_against_brute_force(spark, docs_of, seed, block):
    random.seed(seed)
    make = lambda n, v: " ".join(random.choice("abcdeF"[:v]) for _ in range(n))
    items = [(i, make(random.choice([0, 3, 7, 9, 10, 12, 20]), 4)) for i in range(12)] + [(50, None), (12, make(14, 4)), (12, make(11, 3))]
    rows = [(i, make(random.randint(0, 60), 4)) for i in range(40)] + [(100, None), (101, ""), (102, "x, " * 30), (103, items[5][1].upper() + "!é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in D.digest(D.overlaps(docs_of(rows), bench, block_bytes=block)).collect()), key=repr)
    assert got == brute(rows, items)


def test_cleaned_texts(spark, docs_of, empty_docs):
    item = " ".join(f"i{k}" for k in range(12))
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, f"{long}: {item.upper()}. end"), (2, item), (3, "clean  text"), (4, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = D.decontaminated(docs_of(rows), bench)
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{long}: . end", 3: "clean  text", 4: None}
    assert out.columns == docs_of(rows).columns
    none = bench.where("item_id < 0")
    assert D.overlaps(docs_of(rows), none).where("size(spans) > 0").count() == 0
    assert D.decontaminated(docs_of(rows), none).count() == 4
    assert D.overlaps(empty_docs, bench).count() == 0


def test_repeated_and_null_rows_with_several_blocks(spark, docs_of):
    item = lambda k: " ".join(f"i{k}x{j}" for j in range(11))
    bench = spark.createDataFrame([(k, item(k)) for k in range(8)], "item_id long, text string")
    clean = " ".join(f"w{k}" for k in range(11))
    rows = [(1, item(0)), (1, item(0)), (1, item(1)), (1, clean), (2, clean), (2, clean), (None, item(2)), (None, item(3)), (None, None), (None, None), (None, ""), (3, item(4) + " " + item(5))]
    read = lambda block: sorted((tuple(r) for r in D.digest(D.overlaps(docs_of(rows), bench, block_bytes=block)).collect()), key=repr)
    assert read(200) == read(D.BLOCK_BYTES) == brute(rows, [(k, item(k)) for k in range(8)])


def test_cleaned_texts_with_several_blocks(spark, docs_of):
    random.seed(5)
    w = [f"w{k}" for k in range(60)]
    text = lambda a, b: " ".join(w[a:b])
    # overlapping items, each item's windows short of the rest once another's are cut
    items = [(k, text(a, a + 10)) for k, a in enumerate((0, 5, 9, 14, 30))] + [(k, text(a, a + 10)) for k, a in enumerate((40, 45), 20)]
    items += [(30, " ".join(w[20:25] + w[55:60]))]  # whole only in a text whose middle has been cut
    rows = [(1, text(0, 60)), (1, text(0, 60)), (2, text(0, 15) + ". Tail " + "z " * 30), (3, text(0, 10) + " " + "q " * 8 + text(30, 40)), (4, text(0, 10) + " q" * 15 + " " + text(30, 40) + " q" * 2), (5, None), (None, None), (None, text(5, 15) + " y" * 30)]
    rows += [(6, " ".join(w[20:25] + w[40:55] + w[55:60] + ["v"] * 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    read = lambda block: sorted((tuple(r) for r in D.decontaminated(docs_of(rows), bench, block_bytes=block).collect()), key=repr)
    one = read(D.BLOCK_BYTES)
    assert read(200) == one
    assert [r[1].split()[0] for r in one if r[0] == 2] == ["."]


def test_one_block_is_held_at_a_time(spark, docs_of, monkeypatch):
    item = lambda k: " ".join(f"i{k}x{j}" for j in range(11))
    bench = spark.createDataFrame([(k, item(k)) for k in range(8)] + [(None, item(8)), (None, item(9))], "item_id long, text string")
    rows = [(k, f"a {item(k)} b {item(k + 1)}") for k in range(9)] + [(20, "x " * 30_000 + item(3) + " y" * 30_000)]
    held, most = set(), []

    class Sent:
        def __init__(self, real):
            self.real, self.id = real, len(most)
            held.add(self.id)
            most.append(len(held))

        def destroy(self):
            held.remove(self.id)
            self.real.destroy()

    real = D._sent
    monkeypatch.setattr(D, "_sent", lambda docs, block: Sent(real(docs, block)) if block else real(docs, block))
    scan = D._scan
    monkeypatch.setattr(D, "_scan", lambda docs, own, sent, *rest: scan(docs, own, getattr(sent, "real", sent), *rest))
    got = D.digest(D.overlaps(docs_of(rows), bench, block_bytes=200))
    assert len(most) > 2 and max(most) == 1 and not held
    # rows are found without the blocks; items without an id are one with an empty name
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, [(k, item(k)) for k in range(8)] + [("", item(8)), ("", item(9))])


def test_packed_parts_stay_small(monkeypatch):
    random.seed(3)
    text = lambda n: " ".join(f"v{random.randrange(5000)}" for _ in range(n))
    items = [(str(i), text(200)) for i in range(300)]
    part = D.packed(items, 10)
    assert sum(len(part[c]) for c in D._ARRAYS) < 12 * sum(len(t) for _, t in items)


@pytest.mark.parametrize("part", [100, 1000])
def test_parts_change_nothing(spark, docs_of, monkeypatch, part):
    random.seed(4)
    make = lambda n: " ".join(random.choice("abcd") for _ in range(n))
    items = [(i, make(random.choice([2, 7, 12, 20]))) for i in range(30)]
    rows = [(i, make(random.randint(0, 40))) for i in range(30)]
    monkeypatch.setattr(D, "PART_BYTES", part)
    got = sorted((tuple(r) for r in D.digest(D.overlaps(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"))).collect()), key=repr)
    assert got == brute(rows, items)
