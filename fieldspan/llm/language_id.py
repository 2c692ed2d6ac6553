"""Language identification by interpolated Kneser-Ney character models.

One model of 4-grams per language, kept in sorted arrays of n-gram codes; a text goes to the language
with the lowest cross-entropy per symbol. Symbols are lower-cased letters; anything else between
letters is one space.

Fitting takes at most ``per_language`` distinct labelled texts of each language (those with the
smallest hashes of the text, of longer ones the first ``most_chars`` characters), so the size of a language's model
has a bound whatever the table's size; every label that has such a text gets a model. One text in
four is not counted but calibrates rejection, by classes of length: the first stretches of each
calibration text of a class's length give cross-entropies, and a text is rejected if its own exceeds
their 99th percentile by half and ``LEAST_LIMIT``, which keeps labelled texts that are all alike from
making anything else foreign. Languages without such stretches have the percentile of all
languages' together. Scoring reads all texts whole.

A null text, or one without a letter, has the language ``und`` and score 0, and is rejected; so is
every text if no labelled one is there. Ties go to the first language by name. A text that stands
often teaches once. Repeated rows each get their row; a null doc_id counts as not held out, but
teaches nothing (``trained_on``). An empty table gives no rows; extra columns are ignored (``predicted``) or kept (``accepted``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldspan.llm.shared import small_batches, written

ORDER = 4
PER_LANGUAGE = 1000
MOST_CHARS = 20_000
FOLDS = 5
LENGTHS = np.array([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000])
WINDOWS = 20
QUANTILE = 0.99
SLACK = 1.5
LEAST_LIMIT = 1.0  #: nats a symbol; no learned language's prose comes near it
_SPACE, _EDGE = 0x20, 1
_MARK = "\ud800"
_BITS = np.uint64(16)


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Code point to symbol: letters lower-cased, all else a space; the edge mark is a surrogate."""
    table = np.full(0x110000, _SPACE, np.uint64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = ord(x.lower()[0])
            # letters beyond 16 bits share the codes of private use, where no letter is
            table[c] = low if low < 0x10000 else 0xE000 + low % 0x1900
    table[ord(_MARK)] = _EDGE
    return table


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram codes, index of the text of each) over all symbols of the texts."""
    joined = "".join(f"{_MARK * 3}{t} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbols()[points]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 4 for t in texts])
    blank = s == _SPACE
    keep = np.ones(len(s), bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | (s[:-1] == _EDGE)))
    s, doc = s[keep], doc[keep]
    gram = s.copy()
    for k in range(1, ORDER):
        gram[k:] |= s[:-k] << (_BITS * np.uint64(k))
    real = s != _EDGE
    return gram[real], doc[real]


class Level(NamedTuple):
    """Sorted codes with the discounted probability, and sorted contexts with the weight passed down."""

    codes: np.ndarray
    prob: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray

    def look(self, keys: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _found(self.codes, self.prob, keys, 0.0), _found(self.contexts, self.weight, contexts, 1.0)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _tail(x: np.ndarray, k: int) -> np.ndarray:
    """The last k symbols of each code."""
    return x & np.uint64((1 << (16 * k)) - 1) if k < 4 else x


class KneserNey:
    """Interpolated Kneser-Ney over symbol 4-grams with their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels: list[Level] = []
        counts = counts.astype(np.float64)
        for k in range(ORDER, 0, -1):
            order = np.argsort(grams)
            grams, counts = grams[order], counts[order]
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 else 0.5
            contexts, which = np.unique(grams >> _BITS, return_inverse=True)
            total = np.bincount(which, counts, len(contexts))
            kinds = np.bincount(which, minlength=len(contexts))
            self.levels.append(Level(grams, np.maximum(counts - d, 0) / total[which], contexts, np.minimum(d * kinds, total) / total))
            if k > 1:  # continuation counts: how many symbols come before
                grams, counts = np.unique(_tail(grams, k - 1), return_counts=True)
                counts = counts.astype(np.float64)
        self.floor = 1.0 / (len(self.levels[-1].codes) + 1)

    @classmethod
    def of(cls, parts: list[bytes]) -> KneserNey:
        """From the bytes of its levels' arrays."""
        self = cls.__new__(cls)
        kinds = (np.uint64, np.float64, np.uint64, np.float64)
        self.levels = [Level(*(np.frombuffer(x, k) for x, k in zip(parts[a : a + 4], kinds))) for a in range(0, len(parts), 4)]
        self.floor = 1.0 / (len(self.levels[-1].codes) + 1)
        return self

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), self.floor)
        for k, level in zip(range(1, ORDER + 1), reversed(self.levels)):
            tail = _tail(grams, k)
            own, weight = level.look(tail, tail >> _BITS)
            p = own + weight * p
        return np.log(p)


class Model(NamedTuple):
    languages: list[str]
    models: list[KneserNey]
    limits: np.ndarray  #: largest cross-entropy accepted, by language and class of length

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy by text and language, number of symbols)."""
        grams, doc = codes(texts)
        kinds, which = np.unique(grams, return_inverse=True)
        n = np.bincount(doc, minlength=len(texts))
        out = np.zeros((len(texts), len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = -np.bincount(doc, m.log_prob(kinds)[which], len(texts)) / np.maximum(n, 1)
        return out, n

    def stretches(self, texts: list[str], k: int) -> list[list[float]]:
        """By class of length: cross-entropies of the texts' first stretches of it under model k."""
        grams, doc = codes(texts)
        total = np.concatenate([[0.0], np.cumsum(-self.models[k].log_prob(grams))])
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        out: list[list[float]] = [[] for _ in LENGTHS]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            for c, n in enumerate(LENGTHS.tolist()):
                at = a + n * np.arange(min((b - a) // n, WINDOWS) + 1)
                out[c] += (np.diff(total[at]) / n).tolist()
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def sampled(labelled: DataFrame, per_language: int = PER_LANGUAGE, most_chars: int = MOST_CHARS) -> DataFrame:
    """lang, text and tests (whether it calibrates) of at most so many distinct texts a language; of longer
    texts the first ``most_chars`` characters teach, so a label with nothing but long texts has a model too.

    The distinct texts of each language are counted about; hashes under the share that gives half as
    many again as are asked for are gathered, a text once, and ranked. No language's rows meet in a task
    but those few.
    """
    rows = labelled.select(F.substring("text", 1, most_chars).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("text"))
    kinds = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("kinds"))
    near = rows.join(F.broadcast(kinds), "lang").where((F.shiftrightunsigned("h", 1) / 2.0**63) * F.col("kinds") <= 1.5 * per_language)
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= per_language)
    return ranked.select("lang", "text", (F.col("rank") % 4 == 0).alias("tests"))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, most_chars: int = MOST_CHARS) -> Model:
    """A model from (text, lang) rows; rows with a null in either, or without letters, teach nothing."""
    sample = written(sampled(small_batches(labelled), per_language, most_chars), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for a in range(0, len(texts), 200):
                    grams, n = np.unique(codes(texts[a : a + 200])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    grams = sample.where("not tests").select("lang", "text").mapInArrow(count, "lang string, gram long, n long")

    def train(rows: pa.Table) -> pa.Table:
        m = KneserNey(rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy())
        parts = [x.tobytes() for level in m.levels for x in level]
        return pa.table({"lang": rows.column("lang")[:1], "parts": pa.array([parts], pa.list_(pa.binary()))})

    # a model's size is bounded by its language's texts; a label set is a list that people keep
    trained = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(train, "lang string, parts array<binary>")
    known = sorted((r.lang, r.parts) for r in trained.collect())
    languages, models = [lang for lang, _ in known], [KneserNey.of(parts) for _, parts in known]
    model = Model(languages, models, np.full((len(languages), len(LENGTHS)), np.inf))
    if not languages:
        return model
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for a in range(0, len(texts), 20):
                best = m.entropies(texts[a : a + 20])[0].argmin(1).tolist()
                for k in set(best):
                    own = [t for t, x, y in zip(texts[a : a + 20], langs[a : a + 20], best) if y == k and x == m.languages[k]]
                    found = [(c, e) for c, es in enumerate(m.stretches(own, k)) for e in es] if own else []
                    if found:
                        c, e = zip(*found)
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(c), pa.int32()), pa.array(c, pa.int32()), pa.array(e, pa.float64())], ["k", "c", "e"])

    trial = sample.where("tests").select("lang", "text").mapInArrow(calibrate, "k int, c int, e double")
    tops = trial.groupBy("k", "c").agg(F.percentile_approx("e", QUANTILE, 10_000).alias("e")).collect()
    pooled = trial.groupBy("c").agg(F.percentile_approx("e", QUANTILE, 10_000).alias("e")).collect()
    for r in pooled:
        model.limits[:, r.c] = max(r.e * SLACK, LEAST_LIMIT)
    for r in tops:
        model.limits[r.k, r.c] = max(r.e * SLACK, LEAST_LIMIT)
    for c in range(1, len(LENGTHS)):  # no text is so long: the class below
        model.limits[:, c] = np.where(np.isinf(model.limits[:, c]), model.limits[:, c - 1], model.limits[:, c])
    return model


def _scored(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, best, score, entropy, n (symbols) and accepted; and the columns named in ``more``."""
    sent = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best, score, entropy, size, accepted = [], [], [], [], []
            a = 0
            while a < len(texts):
                b, total = a, 0
                while b < len(texts) and (b == a or total + len(texts[b] or "") <= 1 << 19):
                    total += len(texts[b] or "")
                    b += 1
                part = [t or "" for t in texts[a:b]]
                letters = [any(map(str.isalpha, t)) for t in part]
                a = b
                if not m.models:
                    best += ["und"] * len(part)
                    score, entropy, size, accepted = score + [0.0] * len(part), entropy + [None] * len(part), size + [0] * len(part), accepted + [False] * len(part)
                    continue
                e, n = m.entropies(part)
                k = e.argmin(1)
                low = e[np.arange(len(part)), k]
                odds = np.exp(-(e - low[:, None]) * np.minimum(n, 100)[:, None])
                p = 1.0 / odds.sum(1)
                ok = low <= m.limits[k, np.maximum(np.searchsorted(LENGTHS, n, "right") - 1, 0)]
                for i, has in enumerate(letters):
                    best.append(m.languages[k[i]] if has else "und")
                    score.append(float(p[i]) if has else 0.0)
                    entropy.append(float(low[i]) if has else None)
                    size.append(int(n[i]))
                    accepted.append(bool(ok[i]) and has)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in more), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(size, pa.int64()), pa.array(accepted, pa.bool_())],
                ["doc_id", *more, "best", "score", "entropy", "n", "accepted"],
            )

    kept = ", ".join(f"`{c}` {types[c]}" for c in ("doc_id", *more))
    return docs.select("doc_id", *[c for c in more if c != "text"], "text").mapInArrow(run, f"{kept}, best string, score double, entropy double, n long, accepted boolean")


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted."""
    return _scored(docs, model).select("doc_id", F.col("best").alias("lang_pred"), "score", "accepted")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is accepted; columns as given."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = _scored(docs.select("doc_id", "text", *rest).withColumnsRenamed({c: f"_{c}" for c in rest}), model, "text", *[f"_{c}" for c in rest])
    return found.where("accepted").select(*[F.col(c if c in ("doc_id", "text") else f"_{c}").alias(c) for c in docs.columns])


def trained_on(docs: DataFrame) -> DataFrame:
    """The labelled documents outside the held-out fold."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
