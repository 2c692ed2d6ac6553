import hashlib
import math
import random
import re
from collections import Counter

from fieldspan.llm import secret_scan as S

PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def brute(text):
    out = [(m.start(), r, f"{k}:{m.start()}:{m.end()}") for r, (k, (p, ok)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if ok(m)]
    return [x[2] for x in sorted(out)]


def test_base_spans_against_brute_force(spark, docs_of):
    random.seed(2)
    parts = ["token", "Password", "secret", "api_key", "APIKEY", " ", "=", ":", '"', "'", "é", "😀", "\n", "abc123def4567890", "AKIA", "AKIAABCDEFGHIJKLMN", "deadbeef", "x", " = ", "0123456789abcdef", "Zk3", "Qp9"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 40)))) for i in range(600)] + [(900, None), (901, ""), (902, "deadbeefdeadbeef " * 1500), (902, "deadbeefdeadbeef " * 1500)]
    texts = dict(rows)
    got = S.digest(S.spans(docs_of(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k + ":") for b in base) for k in PATTERNS)


def test_entropy_adds_random_strings_and_leaves_plain_ones(spark, docs_of):
    rows = [(1, "see kt9Xq2LmPz7RwBv4NcYd8JfGh1Ts"), (2, "550e8400-e29b-41d4-a716-446655440000"), (3, "thequickbrownfoxjumpsoverthelazydog"), (4, "z" * 40 + "1B"), (5, "0F3A9C7B5D1E8246F0A1B2"), (6, "EXAMPLEkt9Xq2LmPz7RwBv4NcYd8JfGh")]
    got = {r.doc_id: r.spans for r in S.digest(S.spans(docs_of(rows))).collect()}
    assert got == {1: "entropy:4:32", 2: "", 3: "", 4: "", 5: "entropy:0:22", 6: ""}


def test_redaction(spark, docs_of, empty_docs):
    rows = [(1, "é token = abcdefghijklmnop."), (2, None), (3, "plain"), (4, "k kt9Xq2LmPz7RwBv4NcYd8JfGh1Ts k")]
    out = S.redacted(docs_of(rows))
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("é [SECRET]", 10), 2: (None, None), 3: ("plain", 5), 4: ("k [SECRET] k", 12)}
    assert out.columns == docs_of(rows).columns
    assert S.spans(empty_docs).count() == S.redacted(empty_docs).count() == 0


def test_native_plan(spark, docs_of):
    plan = S.digest(S.spans(docs_of([(1, "x")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_entropy(text, window=20):
    """First to last window at or above its class's threshold in each run of the alphabet, by recounting each window."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run = m[0]
        hexa = re.fullmatch(r"[0-9A-Fa-f]+", run)
        mixed = re.search("[0-9]", run) and re.search("[A-Za-z]", run) and (hexa or re.search("[A-Z]", run) and re.search("[a-z]", run))
        if not mixed or any(re.search(p, run) for p in S.ALLOWED):
            continue
        least = S.THRESHOLDS["hex" if hexa else "other"]
        hot = []
        for i in range(len(run) - window + 1):
            counts = Counter(run[i : i + window]).values()
            if -sum(c / window * math.log2(c / window) for c in counts) >= least - 1e-12:
                hot.append(i)
        if hot:
            out.append((m.start() + hot[0], m.start() + hot[-1] + window))
    return out


def test_entropy_spans_against_recounting(spark):
    random.seed(11)
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=", "aB3", "abcABC012345", "ABCDEF0123456789"]
    rows = []
    for i in range(150):
        parts = ["".join(random.choice(random.choice(alphabets) if random.random() < 0.1 else a) for _ in range(random.randint(15, 70))) for a in random.choices(alphabets, k=random.randint(0, 5))]
        rows.append((i, random.choice([" é ", "\n", ", "]).join(parts)))
    rows += [(900, "123e4567-e89b-12d3-a456-426614174000"), (901, "exampleKEY0123aBcDeFgHiJkLm"), (902, "a1B2" * 5000)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "entropy"] for r in S.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_entropy(t) for i, t in rows} and sum(map(len, got.values())) > 50
