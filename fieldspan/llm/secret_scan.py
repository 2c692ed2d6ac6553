"""Secret scans with DataFrame functions only: base patterns, and windows of high entropy.

Candidate strings are runs of 20 or more characters of the base64 alphabets. A window of 20
characters slides over each; its character counts change by one in and one out a step, and with them
the sum of c * log2(c), so a step's Shannon entropy needs no recount. Each character class has its
threshold: strings of hexadecimal digits, and all other strings. The span of a candidate runs from its
first to its last window at or above the threshold. Candidates that hold no digit or no letter,
the other class's strings without letters of both cases, and strings that an allow-list pattern
matches (UUIDs, placeholders, runs of the alphabet) give no span. Base matches are never allowed away.

Positions count code points, ends are exclusive. A null text is an empty one and has no spans.
Repeated rows each get their row; extra columns are ignored (``spans``) or kept (``redacted``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from fieldspan.llm.shared import free

WINDOW = 20
THRESHOLDS = {"hex": 3.0, "other": 3.8}
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0000000000|1234567890|abcdefgh",
)
MARK = "[SECRET]"
KINDS = ("assign", "access", "hex", "entropy")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: kind: (pattern, test that a text may hold a match that counts, least length, group measured)
_PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""", 12, 4),
    "access": (r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}", 18, 2),
    "hex": (r"[0-9a-f]{16,}", r"[0-9a-f]{16}", 16, 2),
    "entropy": (r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+/_=-]{20}", 20, 2),
}


def _matches(text: Column, kind: str) -> Column:
    """Struct of the gaps before the matches, the matches and the measured groups; null if none can count.

    Each match begins where the last one ended: a gap, as short as can be, then the pattern. So the
    strings give the positions, and a text is read once from end to end.
    """
    pattern, test, _, group = _PATTERNS[kind]
    whole = F.lit(rf"\G(?s:(.*?))({pattern})")
    part = lambda k: F.regexp_extract_all(text, whole, F.lit(k))
    return F.when(text.rlike(test), F.struct(part(1).alias("gaps"), part(2).alias("hits"), (part(group) if group != 2 else F.array().cast("array<string>")).alias("values")))


def _running(x: Column) -> Column:
    """Sums up to each entry of an array, in blocks so that long arrays stay cheap."""
    none = F.array().cast("array<bigint>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 256).cast("int")), lambda b: F.slice(x, b * 256 + 1, F.lit(256)))
    within = F.transform(blocks, lambda blk: F.aggregate(blk, none, lambda done, v: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + v))))
    before = lambda w: F.aggregate(w, F.array(F.lit(0).cast("bigint")), lambda done, blk: F.concat(done, F.array(F.element_at(done, -1) + F.element_at(blk, -1))))
    joined = F.transform(F.array(within), lambda w: F.transform(F.array(before(w)), lambda o: F.flatten(F.transform(w, lambda blk, i: F.transform(blk, lambda v: v + F.get(o, i))))))
    return F.when(F.size(x) == 0, none).otherwise(F.flatten(F.flatten(joined)))


def _hot(hit: Column, window: int) -> Column:
    """Struct(start, end) of the windows at or above the class's threshold in a candidate; null if none."""
    hexa = hit.rlike("^[0-9A-Fa-f]+$")
    least = F.when(hexa, F.lit(THRESHOLDS["hex"])).otherwise(F.lit(THRESHOLDS["other"]))
    clog = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    codes = F.transform(F.split(hit, ""), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)
    start = F.struct(
        F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )

    def step(code: Column):
        def move(s: Column, i: Column) -> Column:
            came, went = F.get(code, i), F.get(code, i - window)
            counts = F.transform(s["counts"], lambda c, k: c + (k == came).cast("int") - F.coalesce((k == went).cast("int"), F.lit(0)))
            more = F.get(clog, F.get(s["counts"], came) + 1) - F.get(clog, F.get(s["counts"], came))
            less = F.coalesce(F.get(clog, F.get(s["counts"], went) - 1) - F.get(clog, F.get(s["counts"], went)), F.lit(0.0))
            total = F.when(F.coalesce(came == went, F.lit(False)), s["sum"]).otherwise(s["sum"] + more + less)
            high = (i >= window - 1) & (F.lit(math.log2(window)) - total / window >= least)
            return F.struct(
                counts.alias("counts"),
                total.alias("sum"),
                F.when(high & (s["first"] < 0), i - window + 1).otherwise(s["first"]).alias("first"),
                F.when(high, i + 1).otherwise(s["last"]).alias("last"),
            )

        return move

    end = F.transform(F.array(codes), lambda code: F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, step(code), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))
    return F.element_at(end, 1)


def _candidate(hit: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | hit.rlike(pattern)
    mixed = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (hit.rlike("^[0-9A-Fa-f]+$") | (hit.rlike("[A-Z]") & hit.rlike("[a-z]")))
    return mixed & ~allowed


def _judged(found: Column, kind: str, window: int) -> Column:
    """For each match: struct(gap and hit lengths, first and last position kept in it; null if it fails)."""
    least = _PATTERNS[kind][2]
    hits = F.coalesce(found["hits"], F.array().cast("array<string>"))
    if kind == "entropy":
        kept = lambda h, i: F.when(_candidate(h), _hot(h, window))
    else:
        value = (lambda h, i: F.get(found["values"], i)) if _PATTERNS[kind][3] != 2 else (lambda h, i: h)
        kept = lambda h, i: F.when(F.length(value(h, i)) >= least, F.struct(F.lit(0).alias("first"), F.length(h).alias("last")))
    return F.transform(hits, lambda h, i: F.struct(F.length(F.get(found["gaps"], i)).cast("bigint").alias("gap"), F.length(h).cast("bigint").alias("size"), kept(h, i).alias("kept")))


def _spans(judged: Column, ends: Column, kind: str) -> Column:
    every = F.transform(
        judged,
        lambda m, i: F.when(
            F.coalesce(m["kept"]["first"], F.lit(-1)) >= 0,
            F.struct(
                (F.get(ends, i) - m["size"] + m["kept"]["first"]).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                (F.get(ends, i) - m["size"] + m["kept"]["last"]).alias("end"),
                F.lit(kind).alias("kind"),
            ),
        ),
    )
    return F.filter(every, lambda s: s.isNotNull())


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and spans: array of struct(start, rank, end, kind), by start, then kind as listed."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("doc_id", *[_matches(F.col("text"), k).alias(k) for k in KINDS])
    df = df.select("doc_id", *[_judged(F.col(k), k, window).alias(k) for k in KINDS])
    df = df.select("doc_id", *KINDS, *[_running(F.transform(k, lambda m: m["gap"] + m["size"])).alias(f"{k}_ends") for k in KINDS])
    return df.select("doc_id", F.array_sort(F.concat(*[_spans(F.col(k), F.col(f"{k}_ends"), k) for k in KINDS])).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "entropy")).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = MARK, window: int = WINDOW) -> DataFrame:
    """The documents with each secret replaced by ``mark``, kind after kind; columns as given.

    A null text stays null. ``n_chars``, if there, is brought up to date.
    """
    names = docs.columns
    text, found, judged = (free(c, names) for c in ("_text", "_found", "_judged"))
    df = docs.withColumn(text, F.col("text"))
    for kind in KINDS:
        df = df.withColumn(found, _matches(F.col(text), kind))
        df = df.withColumn(judged, F.when(F.col(found).isNotNull(), _judged(F.col(found), kind, window)))
        size = F.aggregate(judged, F.lit(0).cast("bigint"), lambda n, m: n + m["gap"] + m["size"])

        def shown(m: Column, i: Column) -> Column:
            hit, first = F.get(F.col(found)["hits"], i), F.coalesce(m["kept"]["first"], F.lit(-1))
            cut = F.concat(F.substring(hit, F.lit(1), first), F.lit(mark), F.substring(hit, m["kept"]["last"] + 1, F.length(hit)))
            return F.concat(F.get(F.col(found)["gaps"], i), F.when(first >= 0, cut).otherwise(hit))

        whole = F.concat(F.array_join(F.transform(judged, shown), ""), F.substring(text, (size + 1).cast("int"), F.length(text)))
        df = df.withColumn(text, F.when(F.col(judged).isNotNull(), whole).otherwise(F.col(text)))
    df = df.withColumn("text", F.col(text))
    if "n_chars" in names:
        df = df.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*names)
