"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words build one suffix automaton. Training words stream through it; at each word the
automaton gives the longest run of words, ending there, that some item holds. Runs of at least
``window`` words (or a whole shorter item) are hits. Only stretches that share short runs of words
with the items are streamed: a hit lies whole inside such a stretch, so nothing is lost.

The items are a stated set. Parts of about ``PART_BYTES`` of them are built into automata, each in a
task of its own, and packed into arrays of 7 to 10 times the text's size. Packed parts go to the
tasks in blocks of ``block_bytes`` of text; more items mean more blocks, and each block sees all
documents as given. A block's hits are stored before the next block is fetched, and the block is given
up then: driver and executors hold one at a time. Results are the same for any number of parts and blocks.

Nulls and texts without words give no words and no hits. Items with the same item_id count as one, those without any are one with an empty name,
and repeated documents each get their row; a null doc_id is kept. Very long texts are scanned whole,
one at a time. An empty benchmark hits nothing, and no documents give no rows. Extra columns of
either table are ignored (``overlaps``), or of the documents kept (``decontaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from fieldspan.llm.shared import chunks, free, marked, small_batches, written
from fieldspan.llm.wordhash import NOT_ALNUM, Words, rolling, whole_windows, words

WINDOW = 10
PART_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
_SEED = 4
_ARRAYS = {"first": "<i4", "word": "<u8", "to": "<i4", "link": "<i4", "length": "<i4", "own_state": "<i4", "own_first": "<i4", "own_item": "<i4", "whole_state": "<i4", "whole_words": "<i4", "whole_item": "<i4", "grams": "<u8"}
_PACKED = "part int, seed long, names array<string>, " + ", ".join(f"{c} binary" for c in _ARRAYS)


class SuffixAutomaton:
    """Of several word sequences; words are integers."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        prefixes = []
        for _, tokens in items:
            last, path = 0, []
            for w in tokens:
                last = self._extend(last, w)
                path.append(last)
            prefixes.append(path)
        self.whole: dict[int, list[tuple[int, str]]] = {}
        self.owners: dict[int, set[str]] = {}
        for (name, tokens), path in zip(items, prefixes):
            if 0 < len(tokens) < window:
                self.whole.setdefault(self._at(path[-1], len(tokens)), []).append((len(tokens), name))
            for k, state in enumerate(path):
                if k + 1 >= window:
                    self.owners.setdefault(self._at(state, window), set()).add(name)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = self._add(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _add(self, length: int, edges: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(edges)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _at(self, state: int, k: int) -> int:
        """The state of the last k words, k being at most the state's length."""
        while self.length[self.link[state]] >= k:
            state = self.link[state]
        return state

    def arrays(self, names: dict[str, int]) -> dict[str, np.ndarray]:
        """The automaton in flat arrays: edges by state and word, owners and whole items by state."""
        edges = [sorted(x.items()) for x in self.next]
        owners, whole = sorted(self.owners.items()), [(s, *x) for s, found in sorted(self.whole.items()) for x in found]
        return {
            "first": np.cumsum([0, *map(len, edges)]),
            "word": np.array([w for x in edges for w, _ in x], np.uint64),
            "to": np.array([t for x in edges for _, t in x], np.int64),
            "link": np.array(self.link),
            "length": np.array(self.length),
            "own_state": np.array([s for s, _ in owners], np.int64),
            "own_first": np.cumsum([0, *[len(x) for _, x in owners]]),
            "own_item": np.array([names[n] for _, x in owners for n in x], np.int64),
            "whole_state": np.array([s for s, _, _ in whole], np.int64),
            "whole_words": np.array([k for _, k, _ in whole], np.int64),
            "whole_item": np.array([names[n] for _, _, n in whole], np.int64),
        }


def packed(items: list[tuple[str, str]], window: int) -> dict:
    """The automaton of some items, and the runs of words that stretches worth streaming share with them."""
    raw = [(t or "").encode() for _, t in items]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    w = words(np.frombuffer(b"".join(raw), np.uint8), off, NOT_ALNUM, lower=True)
    tokens = w.hash.tolist()
    parts = [(items[k][0], tokens[w.first[k] : w.first[k + 1]]) for k in range(len(items))]
    seed = min([_SEED, *[min(len(p), window) for _, p in parts if p]])
    names = {n: i for i, n in enumerate(dict.fromkeys(n for n, _ in items))}
    grams = rolling(w.hash, seed)
    found = SuffixAutomaton(parts, window).arrays(names) | {"grams": np.unique(grams[whole_windows(w.first, seed)[: len(grams)]])}
    return {"seed": seed, "names": list(names), **{c: found[c].astype(t).tobytes() for c, t in _ARRAYS.items()}}


class Matcher:
    """A packed part, ready to scan batches of documents."""

    def __init__(self, part: dict, window: int):
        self.window, self.seed, self.names = window, part["seed"], part["names"]
        self.at = {c: np.frombuffer(part[c], t) for c, t in _ARRAYS.items()}
        self.grams = self.at["grams"]
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _follow(self, state: int, w: np.uint64) -> int:
        """The state after one more word, or -1."""
        a, b = self.at["first"][state], self.at["first"][state + 1]
        k = a + np.searchsorted(self.at["word"][a:b], w)
        return int(self.at["to"][k]) if k < b and self.at["word"][k] == w else -1

    def _owners(self, state: int) -> set[str]:
        link, length = self.at["link"], self.at["length"]
        while length[link[state]] >= self.window:
            state = link[state]
        k = np.searchsorted(self.at["own_state"], state)
        return {self.names[i] for i in self.at["own_item"][self.at["own_first"][k] : self.at["own_first"][k + 1]]}

    def stream(self, tokens: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(last word, longest match, items) wherever a window or a whole short item ends."""
        link, length, whole = self.at["link"], self.at["length"], self.at["whole_state"]
        state = run = 0
        for i, w in enumerate(tokens):
            to = self._follow(state, w)
            while to < 0 and state:
                state = int(link[state])
                run = int(length[state])
                to = self._follow(state, w)
            if to < 0:
                run = 0
                continue
            state, run = to, run + 1
            if run >= self.window:
                yield i, run, self._owners(state)
            p = state
            while len(whole) and p > 0:
                a, b = np.searchsorted(whole, [p, p + 1])
                for k in range(a, b):
                    if self.at["whole_words"][k] <= run:
                        yield i, int(self.at["whole_words"][k]), {self.names[self.at["whole_item"][k]]}
                p = int(link[p])

    def hits(self, w: Words) -> Iterator[tuple[int, int, int, set[str]]]:
        """(document, first word, end, items) of each occurrence, words counted over all documents."""
        g = rolling(w.hash, self.seed)
        at = np.flatnonzero(self.quick[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return
        k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        at = at[(self.grams[k] == g[at]) & whole_windows(w.first, self.seed)[at]]
        if not len(at):
            return
        doc = np.searchsorted(w.first, at, "right") - 1
        new = np.flatnonzero((np.diff(at) > 1) | (np.diff(doc) > 0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(at)]):
            lo, hi = int(at[a]), int(at[b - 1]) + self.seed
            for i, run, items in self.stream(w.hash[lo:hi]):
                yield int(doc[a]), lo + i + 1 - min(run, self.window), lo + i + 1, items


class _Blocks:
    """The packed parts in blocks that fit a broadcast, each fetched when it is asked for."""

    def __init__(self, parts: DataFrame, n_parts: int, n: int):
        self.parts, self.n_parts, self.n = parts, n_parts, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> list[dict]:
        if k >= self.n:
            raise IndexError(k)
        return [r.asDict() for r in self.parts.where(F.col("part") % self.n == k).collect()]


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> _Blocks:
    """The bounds are checked before anything is built or fetched."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = int(total // block_bytes + 1)
    n_parts = n * int(-(-total // (n * min(PART_BYTES, block_bytes))) or 1)

    def build(rows: pa.Table) -> pa.Table:
        made = packed([(i or "", t) for i, t in zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())], window)
        return pa.table({"part": rows.column("part")[:1], **{c: pa.array([v]) for c, v in made.items()}})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)).cast("int"))
    return _Blocks(written(dealt.groupBy("part").applyInArrow(build, _PACKED), "automata"), n_parts, n)


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, spans (array of word ranges start, end), item_ids.

    Spans are merged word ranges that items' windows cover, the end exclusive.
    """
    blocks = _blocks(benchmark, window, block_bytes)
    if len(blocks) == 1:
        return _scan(docs, {"doc_id": F.col("doc_id").cast("long")}, _sent(docs, blocks[0]), window, False)
    rows = _scan(docs, {"doc_id": F.col("doc_id").cast("long"), **_keys()}, _sent(docs, []), window, False).drop("spans", "item_ids")
    hits = _hits(docs, blocks, window)
    rows = marked(rows, "short", hits.select("short"), "met")
    found = rows.where("met").join(hits.drop("short"), "key", "left")
    none = {"spans": F.expr(f"CAST(array() AS {_SPAN_TYPE})"), "item_ids": F.expr("CAST(array() AS array<string>)")}
    found = found.withColumns({c: F.coalesce(F.col(c), x) for c, x in none.items()})
    clean = rows.where("not met").withColumns(none)
    return clean.select(*_FOUND).unionByName(found.select(*_FOUND))


_FOUND = ["doc_id", "n_words", "spans", "item_ids"]
_SPAN_TYPE = "array<struct<start: bigint, end: bigint>>"


def _keys() -> dict[str, Column]:
    """A distinct text: by a digest, and by 64 bits for bitmaps."""
    return {"key": F.sha2(F.col("text").cast("binary"), 256), "short": F.xxhash64("text")}


def _sent(docs: DataFrame, block: list[dict]) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(block)


def _scan(docs: DataFrame, own: dict[str, Column], sent: Broadcast, window: int, only_hits: bool) -> DataFrame:
    """The columns ``own``, n_words, and one block's spans and item_ids; of all rows, or of those with hits."""
    docs = small_batches(docs).select("text", *[c.alias(k) for k, c in own.items()])
    types = [f"{k} {docs.schema[k].dataType.simpleString()}" for k in own]
    names = list(own)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(part, window) for part in sent.value]
        for batch in batches:
            for rows, data, off in chunks(batch, "text"):
                w = words(data, off, NOT_ALNUM, lower=True)
                spans: dict[int, list[list[int]]] = {}
                found: dict[int, set[str]] = {}
                for d, a, b, items in (h for m in matchers for h in m.hits(w)):
                    spans.setdefault(d, []).append((a - int(w.first[d]), b - int(w.first[d])))
                    found.setdefault(d, set()).update(items)
                n = rows.num_rows
                out = pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in names),
                        pa.array(np.diff(w.first).astype(np.int64)),
                        pa.array([[{"start": a, "end": b} for a, b in _joined(spans.get(k, []))] for k in range(n)], _SPANS),
                        pa.array([sorted(found.get(k, ())) for k in range(n)], pa.list_(pa.string())),
                    ],
                    [*names, *_FOUND[1:]],
                )
                yield out.take(pa.array(sorted(spans), pa.int64())) if only_hits else out

    return docs.mapInArrow(scan, ", ".join([*types, f"n_words long, spans {_SPAN_TYPE}, item_ids array<string>"]))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by start, those that meet joined into one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and out[-1][1] >= a:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def _hits(docs: DataFrame, blocks: _Blocks, window: int) -> DataFrame:
    """Per distinct text with hits: key, short (a 64-bit hash), spans and item_ids of all blocks.

    Spans are found on the whole text, and depend on nothing but the text: repeated ones count once.
    """
    once = None
    for block in blocks:
        sent = _sent(docs, block)
        found = written(_scan(docs, _keys(), sent, window, True).dropDuplicates(["key"]), "hits")
        sent.destroy()  # what it found is stored: no lost task needs it again
        once = found if once is None else once.unionByName(found)
    met = once.groupBy("key", "short").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return met.select("key", "short", merged(F.col("s")).alias("spans"), "item_ids")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def merged(spans):
    """Spans sorted by start, those that meet joined into one."""
    start = F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))),
        )
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, add)


def digest(found: DataFrame) -> DataFrame:
    """The counts of ``overlaps`` and a hash of the items met."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _cut(text: int, field: pa.Field, max_coverage: float, rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, w: Words, hit: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
    """The rows without the hit spans, words counted over all rows, and without rows mostly hit."""
    if not hit:
        return rows
    keep, texts = np.ones(rows.num_rows, bool), rows.column("text").to_pylist()
    for d, spans in hit.items():
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        mark = np.zeros(hi - lo + 1, bool)
        for a, b in spans:
            mark[a - lo : b - lo] = True
        keep[d] = mark.sum() <= max_coverage * (hi - lo)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mark]).astype(np.int8)))
        kept, at = [], int(off[d])
        for a, b in edge.reshape(-1, 2):
            kept.append(data[at : w.start[lo + a]].tobytes())
            at = int(w.end[lo + b - 1])
        kept.append(data[at : off[d + 1]].tobytes())
        texts[d] = b"".join(kept).decode()
    return rows.set_column(text, field, pa.array(texts, field.type)).filter(pa.array(keep))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the spans that items cover; columns as given, n_chars brought up to date.

    A document goes whole when items cover more than ``max_coverage`` of its words. A text without
    hits stays as it is. Each removed span takes the bytes from its first to its last word. With
    several blocks the spans of all are found on the given texts and merged before anything is cut.
    """
    docs = small_batches(docs)
    text = docs.schema.fieldNames().index("text")
    blocks = _blocks(benchmark, window, block_bytes)
    if len(blocks) == 1:
        sent = _sent(docs, blocks[0])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matchers = [Matcher(part, window) for part in sent.value]
            for batch in batches:
                for rows, data, off in chunks(batch, "text"):
                    w = words(data, off, NOT_ALNUM, lower=True)
                    hit: dict[int, list[tuple[int, int]]] = {}
                    for d, a, b, _ in (h for m in matchers for h in m.hits(w)):
                        hit.setdefault(d, []).append((a, b))
                    yield _cut(text, rows.schema.field("text"), max_coverage, rows, data, off, w, hit)

        out = docs.mapInArrow(cut, docs.schema)
    else:
        key, short, met, spans = (free(c, docs.columns) for c in ("key", "short", "met", "spans"))
        hits = _hits(docs, blocks, window)
        # most texts have no hit: they stay where they are
        rows = marked(docs.withColumn(short, _keys()["short"]), short, hits.select(F.col("short").alias(short)), met)
        found = rows.where(met).select(*docs.columns, _keys()["key"].alias(key)).join(hits.select(F.col("key").alias(key), F.col("spans").alias(spans)), key, "left")

        def cut_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, off in chunks(batch, "text"):
                    w = words(data, off, NOT_ALNUM, lower=True)
                    hit = {}
                    for d, mine in enumerate(rows.column(spans).to_pylist()):
                        if mine:
                            lo = int(w.first[d])
                            hit[d] = [(lo + x["start"], lo + x["end"]) for x in mine]
                    yield _cut(text, rows.schema.field("text"), max_coverage, rows.select(docs_columns), data, off, w, hit)

        docs_columns = docs.columns
        out = rows.where(~F.col(met)).select(*docs.columns).unionByName(found.select(*docs.columns, spans).mapInArrow(cut_found, docs.schema))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
