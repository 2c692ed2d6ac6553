import random

import numpy as np
from pyspark.sql import functions as F

from fieldspan.llm import language_id as L

SYLLABLES = {"en": "the ing and ion er st", "de": "sch ung ein ver keit lich", "fr": "eau oi ment que eux aille"}


def text(lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(random.choice(parts) for _ in range(random.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_odd_rows(spark):
    random.seed(1)
    rows = [(i, text(lang, random.randint(20, 80)), lang) for i in range(600) for lang in [random.choice(list(SYLLABLES))]]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (1003, "q", None), (1004, "日本語の文字だけの文" * 30, None), (None, text("fr", 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("best", F.lit(1)).repartition(3)
    got = L.predicted(docs, L.fit(L.trained_on(docs))).withColumn("out", L.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, lang in rows}
    tested = [r for r in got if r.out and r.doc_id is not None and r.doc_id < 1000]
    assert len(tested) > 60 and np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.97
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[None].lang_pred == "fr"
    assert not by[1004].accepted and by[1003].lang_pred in SYLLABLES
    assert all(r.accepted for r in tested)
    kept = L.accepted(docs, L.fit(L.trained_on(docs)))
    assert kept.columns == docs.columns and {1000, 1001, 1002, 1004}.isdisjoint(r.doc_id for r in kept.collect())


def brute_log_prob(counts, text, order=4):
    """Interpolated Kneser-Ney by its recursion over plain dictionaries: log probability of each symbol."""
    tables = [counts]
    for k in range(order - 1, 0, -1):
        lower = {}
        for g in tables[0]:
            lower[g[-k:]] = lower.get(g[-k:], 0) + 1
        tables.insert(0, lower)
    floor = 1 / (len(tables[0]) + 1)

    def p(table, gram):
        if not gram:
            return floor
        own = {g: c for g, c in table[len(gram) - 1].items() if g[:-1] == gram[:-1]}
        n1, n2 = (sum(c == x for c in table[len(gram) - 1].values()) for x in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        below = p(table, gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + min(d * len(own), total) / total * below if own else below

    s = (chr(1),) * 3 + tuple(text)
    return [np.log(p(tables, s[i - 3 : i + 1])) for i in range(3, len(s))]


def test_models_against_the_recursion():
    random.seed(6)
    texts = [text("de", 12) for _ in range(6)]
    counts = {}
    for t in texts:
        s = (chr(1),) * 3 + tuple(t + " ")
        for i in range(3, len(s)):
            counts[s[i - 3 : i + 1]] = counts.get(s[i - 3 : i + 1], 0) + 1
    m = L.KneserNey(*np.unique(L.codes(texts)[0], return_counts=True))
    again = L.KneserNey.of([x.tobytes() for level in m.levels for x in level])
    for t in ["schung ein", "zzz", text("fr", 3), "é"]:
        got = m.log_prob(L.codes([t])[0])
        assert np.allclose(got, brute_log_prob(counts, t + " "), rtol=1e-12) and (again.log_prob(L.codes([t])[0]) == got).all()


def test_sample_is_bounded_and_counts_texts_once(spark):
    random.seed(8)
    rows = [(1, "hot text of one document", "en")] * 3000 + [(i, text("en", 6), "en") for i in range(2000)] + [(None, text("de", 6), "de") for _ in range(30)]
    rows += [(9000 + i, text("fr", 5), f"l{i}") for i in range(230)] + [(8000, None, "en"), (8001, "x" * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as h", "2 as kinds", "3 as rank").repartition(4)
    got = L.sampled(docs, per_language=100).collect()
    of = lambda lang: [r.text for r in got if r.lang == lang]
    assert len(of("en")) == len(set(of("en"))) == 100 and len(of("de")) == 30 and len({r.lang for r in got}) == 232
    assert sum(r.tests for r in got if r.lang == "en") == 25
    model = L.fit(docs, per_language=100)
    assert len(model.languages) >= 230 and L.predicted(docs, model).count() == len(rows)


def test_letters_beyond_16_bits_are_no_others():
    assert L._symbols()[0x10400] >= 0xE000 and L._symbols()[ord("a")] == ord("a")


def test_no_labels(spark, empty_docs):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score, r.accepted) for r in L.predicted(docs, L.fit(docs)).collect()} == {("und", 0.0, False)}
    assert L.predicted(empty_docs, L.fit(empty_docs)).count() == 0


def test_model_sums_to_one():
    grams, counts = np.unique(L.codes(["abab abc", "cab ba"])[0], return_counts=True)
    m = L.KneserNey(grams, counts)
    symbols = np.array([ord(c) for c in "abc "], np.uint64)
    context = (np.uint64(ord("a")) << np.uint64(16) | np.uint64(ord("b"))) << np.uint64(16)
    # one floor share is left for symbols never seen
    assert 1 - m.floor - 1e-9 <= np.exp(m.log_prob(context | symbols)).sum() <= 1 + 1e-9


def test_short_foreign_texts_and_languages_without_calibration(spark):
    random.seed(2)
    rows = [(i, text(lang, random.randint(20, 80)), lang) for i in range(400) for lang in ("en", "de")]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)] + [(2000, "ololo lolo olol " * 20, "xx"), (2001, "lolo ololo " * 30, "xx")]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    noise = ["".join(random.choice("bjkqwxyzv ") for _ in range(90)) for _ in range(20)]
    tests = [(k, "日本語の文字だけの文"[: 1 + k % 9] * 9) for k in range(20)] + [(100 + k, t) for k, t in enumerate(noise)]
    tests += [(200 + k, "ol" + "z" * 150) for k in range(5)] + [(300 + k, text(random.choice(["en", "de"]), 3 + k)) for k in range(40)]
    got = {r.doc_id: r for r in L.predicted(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert np.isfinite(model.limits).all() and "xx" in model.languages
    assert not any(got[i].accepted for i in got if i < 300) and all(got[i].accepted for i in got if i >= 300)


def test_a_label_with_only_long_texts_is_learned(spark):
    random.seed(6)
    thai = "".join(random.choice("กขคงจฉชซญฎฐณดตถทนบปพฟมยรลวสหอ ") for _ in range(9000))  # 27,000 bytes
    rows = [(i, text("en", 60), "en") for i in range(40)] + [(100 + i, thai[i:], "th") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = {(r.lang, len(r.text)) for r in L.sampled(df, most_chars=5000).collect()}
    assert ("th", 5000) in taught and max(n for _, n in taught) == 5000
    got = L.predicted(df.where("doc_id >= 100").select("doc_id", "text"), L.fit(df)).collect()
    assert {r.lang_pred for r in got} == {"th"}
