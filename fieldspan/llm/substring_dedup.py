"""Substring deduplication with prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words of one document. Its words go if the same words start a
window anywhere else. Only suffixes that may repeat are kept: a window's anchor is its run of
``GRAM`` words with the smallest hash (the leftmost of equals), which depends on the window's words
alone, so equal windows have equal anchors, and windows whose anchor run is alone in the corpus
can't repeat.

The suffixes at the other windows are split by prefixes of variable length: the anchor run where it
occurs at most ``group`` times, so that a task takes whole groups of a bounded size, and else the whole
window. Each batch of groups becomes a suffix tree over its words: a suffix array by doubling, and the
longest common prefixes of neighbours in it, whose intervals are the inner nodes. Nodes as deep as the
window are repeats; each leaf below one is covered to its deepest node's depth. With the whole window
as prefix each group is one such node: its leaves are counted before and after the shuffle, copies of
a passage as one, and there may be any number of them.

A null text has no words. Equal rows are separate documents that repeat each other. Null and
repeated doc_ids are allowed. Very long texts are read in slices of whole texts, one at a time. An
empty table gives no rows. Extra columns are ignored (``digest``) or kept (``cut``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldspan.llm.shared import chunks, free, looked_up, marked, shuffle_width, small_batches, text_bytes, written
from fieldspan.llm.wordhash import SPACE, Words, mix, rolling, whole_windows, words

WINDOW = 35
GRAM = 10
GROUP = 4096
GROUP_BYTES = 16 << 20  #: most text of a group that is one tree, its contexts counted one by one
_PLACE = np.uint64(28)
_BATCH = 4 << 20


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` entries in a row."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor run, first window, number of windows in a row that it serves)."""
    none = np.zeros(0, np.int64)
    grams = rolling(w.hash, GRAM)
    if len(w.hash) < window:
        return np.zeros(0, np.uint64), none, none
    place = np.arange(len(grams), dtype=np.uint64)
    least = _least(grams >> _PLACE << _PLACE | place, window - GRAM + 1)
    at = np.flatnonzero(whole_windows(w.first, window)[: len(least)])
    if not len(at):
        return np.zeros(0, np.uint64), none, none
    owner = (least[at] & np.uint64((1 << 28) - 1)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(at) > 1)]))
    return grams[owner[head]], at[head], np.diff(np.append(head, len(at)))


class Subtree:
    """The suffix tree of several word sequences, as a suffix array with common prefixes.

    ``first`` has each sequence's first word; suffixes end with their sequence.
    """

    def __init__(self, words_: np.ndarray, first: np.ndarray, starts: np.ndarray):
        n = len(words_)
        self.end = np.repeat(first[1:], np.diff(first))
        rank = np.unique(words_, return_inverse=True)[1].astype(np.int64) + 1
        self.levels = [rank]
        depth, longest = 1, int(np.diff(first).max(initial=0))
        while depth < longest:
            after = np.zeros(n, np.int64)
            after[:-depth] = rank[depth:]
            after[np.arange(n) + depth >= self.end] = 0
            rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
            self.levels.append(rank)
            depth *= 2
        self.leaves = starts[np.argsort(rank[starts], kind="stable")] if n else starts
        self.common = self._common(self.leaves[:-1], self.leaves[1:])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, by the ranks of 2^k words from the longest down."""
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            open_ = np.flatnonzero(length < most)
            x, y = a[open_] + length[open_], b[open_] + length[open_]
            same = self.levels[k][x] == self.levels[k][y]
            length[open_[same]] += 1 << k
        return np.minimum(length, most)

    def nodes(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(depth, leaves) of each inner node at least so deep; deeper ones come first."""
        open_: list[tuple[int, int]] = []
        for i, depth in enumerate([*self.common.tolist(), 0]):
            at = i
            while open_ and open_[-1][0] > depth:
                d, at = open_.pop()
                yield d, self.leaves[at : i + 1]
            if depth >= least and (not open_ or open_[-1][0] < depth):
                open_.append((depth, at))

    def covered(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, depth of its deepest inner node) where that is at least so deep, in order of suffixes."""
        depth = np.zeros(len(self.leaves), np.int64)
        if len(self.leaves) > 1:
            depth[1:] = self.common
            depth[:-1] = np.maximum(depth[:-1], self.common)
        hit = np.flatnonzero(depth >= least)
        hit = hit[np.argsort(self.leaves[hit])]
        return self.leaves[hit], depth[hit]


def maximal_repeats(texts: list[str], least: int) -> set[tuple[int, tuple[tuple[int, int], ...]]]:
    """(words, ((text, first word), ...)) of the runs of at least so many words that can't be longer everywhere."""
    raw = [t.encode() for t in texts]
    w = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), SPACE)
    out = set()
    for depth, leaves in Subtree(w.hash, w.first, np.arange(len(w.hash))).nodes(least):
        doc = np.searchsorted(w.first, leaves, "right") - 1
        before = np.where(leaves > w.first[doc], w.hash[leaves - 1], 0)
        if (leaves == w.first[doc]).any() or (before != before[0]).any():
            out.add((depth, tuple(sorted(zip(doc.tolist(), (leaves - w.first[doc]).tolist())))))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in chunks(batch, "text"):
                w = words(data, off, SPACE)
                gram, at, n = anchors(w, window)
                doc = np.searchsorted(w.first, at, "right") - 1
                size = w.end[np.minimum(at + n + window - 2, w.first[doc + 1] - 1)] - w.start[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(rows.column("k").to_numpy()[doc]), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(size.astype(np.int64))],
                    ["gram", "k", "lo", "n", "bytes"],
                )

    return _keyed(docs).select("k", "text").mapInArrow(run, "gram long, k long, lo int, n int, bytes long")


_RANGE = "k long, doc_id long, start int, end int"


def _ranges(k, doc, starts: np.ndarray, window: int) -> pa.RecordBatch:
    """Rows of _RANGE out of window starts that are sorted within equal (k, doc) runs."""
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) > window) | (np.diff(starts) < 0) | (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(starts)) - 1 if len(starts) else head
    missing = doc[head] == _NO_DOC
    return pa.RecordBatch.from_arrays(
        [pa.array(k[head]), pa.array(doc[head], mask=missing), pa.array(starts[head].astype(np.int32)), pa.array((starts[last] + window).astype(np.int32))],
        ["k", "doc_id", "start", "end"],
    )


_NO_DOC = np.iinfo(np.int64).min


def _met(docs: DataFrame, held: DataFrame) -> DataFrame:
    """Documents with their anchors (array of lo, n, gram, alone) out of rows gram, k, lo, n."""
    alone = F.col("alone") if "alone" in held.columns else F.lit(False).alias("alone")
    by_doc = written(held.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("lo", "n", "gram", alone))).alias("held")), "by_doc")
    # documents without such anchors stay where they are
    return marked(_keyed(docs), "k", by_doc.select("k"), "hit").where("hit").drop("hit").join(by_doc, "k")


def _contexts(docs: DataFrame, held: DataFrame, window: int) -> DataFrame:
    """For each anchor: gram, k, doc_id, lo and the words of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in chunks(batch, "text"):
                w = words(data, off, SPACE)
                doc, lo, n, gram, _ = _anchored(rows, w, window)
                a, b = w.start[w.first[doc] + lo], w.end[w.first[doc] + lo + n + window - 2]
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), rows.column("k").take(pa.array(doc)), rows.column("doc_id").take(pa.array(doc)), pa.array(lo.astype(np.int32)), pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())],
                    ["gram", "k", "doc_id", "lo", "words"],
                )

    return _met(docs, held).select("k", "doc_id", "held", "text").mapInArrow(run, "gram long, k long, doc_id long, lo int, words binary")


def _subtrees(contexts: DataFrame, window: int) -> DataFrame:
    """Ranges of words that repeated windows cover, for groups that fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def build() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            data, off = text_bytes(table.column("words"))
            w = words(data, off, SPACE)
            at, _ = Subtree(w.hash, w.first, np.flatnonzero(whole_windows(w.first, window))).covered(window)
            if len(at):
                ctx = np.searchsorted(w.first, at, "right") - 1
                lo, k = table.column("lo").to_numpy()[ctx], table.column("k").to_numpy()[ctx]
                doc = table.column("doc_id").fill_null(int(_NO_DOC)).to_numpy()[ctx]
                yield _ranges(k, doc, lo + at - w.first[ctx], window)

        size = 0
        for batch in batches:
            a, gram, off = 0, batch.column("gram").to_numpy(), text_bytes(batch.column("words"))[1]
            while a < len(gram):
                b = max(a + 1, int(np.searchsorted(off, off[a] + _BATCH - size, "right")) - 1)
                b = a + int(np.searchsorted(gram[a:], gram[min(b, len(gram)) - 1], "right"))
                if held and gram[a] != held[-1].column("gram")[-1].as_py() and size + off[b] - off[a] > _BATCH:
                    yield from build()
                    size = 0
                held.append(batch.slice(a, b - a))
                size += int(off[b] - off[a])
                a = b
        if held:
            yield from build()

    grouped = contexts.repartition(shuffle_width(contexts.sparkSession), "gram").sortWithinPartitions("gram")
    return grouped.mapInArrow(run, _RANGE)


def _anchored(rows: pa.RecordBatch, w: Words, window: int) -> tuple[np.ndarray, ...]:
    """(document, lo, n, gram, alone) of the anchors that a batch of _met holds."""
    lists = rows.column("held")
    flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
    lo, n, gram = (flat.field(c).to_numpy() for c in ("lo", "n", "gram"))
    alone = flat.field("alone").to_numpy(zero_copy_only=False).astype(bool)
    doc = np.repeat(np.arange(rows.num_rows), count)
    fits = w.first[doc] + lo + n + window - 2 < w.first[doc + 1]
    return doc[fits], lo[fits].astype(np.int64), n[fits].astype(np.int64), gram[fits], alone[fits]


def _whole(docs: DataFrame, held: DataFrame, window: int) -> DataFrame:
    """The same for groups of any size, split by all words of the windows.

    Anchors with the same words around them are counted as one context first: each of two or more
    is covered whole. One of each kind then gives its windows, and those of a context that is there
    once are looked up among all.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in chunks(batch, "text", 2 << 20):
                w = words(data, off, SPACE)
                label = rolling(w.hash, window)
                doc, lo, n, gram, _ = _anchored(rows, w, window)
                at = w.first[doc] + lo
                # windows at most 16 apart, from the first to the last: together they hold every word
                ctx = np.zeros(len(at), np.uint64)
                for k in range(0, int(n.max(initial=0)), 16):
                    ctx = mix(ctx + label[at + np.minimum(k, n - 1)])
                ctx = mix(ctx + label[at + n - 1] + n.astype(np.uint64))
                order = np.lexsort((lo, ctx, gram, doc))
                doc, lo, n, gram, ctx = doc[order], lo[order], n[order], gram[order], ctx[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])
                head = np.flatnonzero(new)
                own = pa.array(doc[head])
                places = pa.ListArray.from_arrays(np.append(head, len(doc)).astype(np.int32), lo.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[head]), pa.array(ctx[head].view(np.int64)), rows.column("k").take(own), rows.column("doc_id").take(own), places, pa.array(n[head].astype(np.int32))],
                    ["gram", "ctx", "k", "doc_id", "los", "n"],
                )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in chunks(batch, "text", 2 << 20):
                w = words(data, off, SPACE)
                label = rolling(w.hash, window)
                doc, lo, n, gram, alone = _anchored(rows, w, window)
                each = np.repeat(np.arange(len(n)), n)
                pos = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[each]), pa.array(label[w.first[doc[each]] + pos].view(np.int64)), pa.array(alone[each]), rows.column("k").take(pa.array(doc[each])), rows.column("doc_id").take(pa.array(doc[each])), pa.array(pos.astype(np.int32))],
                    ["gram", "label", "alone", "k", "doc_id", "pos"],
                )

    met = lambda rows: _met(docs, rows).select("k", "doc_id", "held", "text")
    each = written(met(held).mapInArrow(contexts, "gram long, ctx long, k long, doc_id long, los array<int>, n int"), "contexts")
    kinds = each.groupBy("gram", "ctx").agg(F.sum(F.size("los")).alias("times"), F.min(F.struct("k", F.col("los")[0].alias("lo"), "n")).alias("one"))
    ranges = F.transform("los", lambda lo: F.struct(lo.alias("start"), (lo + F.col("n") + window - 1).alias("end")))
    kinds = written(kinds, "kinds")
    whole = looked_up(each, kinds.where("times > 1").select("gram", "ctx"), ["gram", "ctx"]).select("k", "doc_id", ranges.alias("ranges"))
    ones = kinds.select("gram", "one.k", "one.lo", "one.n", (F.col("times") == 1).alias("alone"))
    rows = written(met(ones).mapInArrow(windows, "gram long, label long, alone boolean, k long, doc_id long, pos int"), "windows")
    more = rows.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("leaves"), F.bool_or("alone").alias("ask")).where("leaves > 1 and ask")
    part = looked_up(rows.where("alone"), written(more.select("gram", "label"), "more"), ["gram", "label"]).select("k", "doc_id", F.array(F.struct(F.col("pos").alias("start"), (F.col("pos") + window).alias("end"))).alias("ranges"))
    return whole.unionByName(part)


def covered(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """k, doc_id and ranges (array of start, end): words, ends exclusive, that repeated windows cover.

    k is a hash of doc_id and text; rows equal in both share their ranges. A document may have
    several rows, and ranges may overlap.
    """
    if window < GRAM:
        raise ValueError(f"windows have {GRAM} words or more")
    rows = written(_anchor_rows(small_batches(docs), window), "anchors")
    small = (F.count(F.lit(1)) <= group) & (F.sum("bytes") <= GROUP_BYTES)
    often = written(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("times"), small.alias("small")).where("times > 1"), "often")
    few, many = often.where("small"), often.where("not small")
    rows = rows.drop("bytes")
    out = _subtrees(_contexts(docs, looked_up(rows, few.select("gram"), ["gram"]), window), window)
    out = out.select("k", "doc_id", F.array(F.struct("start", "end")).alias("ranges"))
    if many.limit(1).count():
        out = out.unionByName(_whole(docs, looked_up(rows, many.select("gram"), ["gram"]), window))
    return out


def _with_ranges(docs: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """Documents, or the named columns of them, with the ranges found under their k."""
    # rows equal in doc_id and text have equal ranges: a set holds one document's, however many rows there are
    each = found.select("k", "doc_id", F.explode("ranges").alias("r")).select("k", F.struct("doc_id", "r.start", "r.end").alias("r"))
    by_doc = written(each.groupBy("k").agg(F.collect_set("r").alias("found")), "by_doc")
    key, name, hit = (free(c, columns) for c in ("k", "found", "hit"))
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text")).select(*columns, key) if columns else _keyed(docs)
    rows, by_doc = marked(rows, key, by_doc.select("k"), hit), by_doc.toDF(key, name)
    out = rows.where(hit).join(by_doc, key, "left").unionByName(rows.where(~F.col(hit)).withColumn(name, F.lit(None).cast(by_doc.schema[name].dataType)))
    return out.select(*columns, name) if columns else out.select("doc_id", name, "text")


def _mask(found: list[dict] | None, doc: int | None, n: int) -> np.ndarray | None:
    if not found:
        return None
    mark = np.zeros(n, bool)
    for f in found:
        if f["doc_id"] == doc:
            mark[f["start"] : f["end"]] = True
    return mark


def digest(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 over the kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            n_words, removed, sha = [], [], []
            for i, (doc, ranges) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("found").to_pylist())):
                own = data[off[i] : off[i + 1]].tobytes().split()
                n_words.append(len(own))
                mark = _mask(ranges, doc, len(own))
                if mark is not None:
                    own = [own[j] for j in np.flatnonzero(~mark).tolist()]
                removed.append(n_words[-1] - len(own))
                sha.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_ranges(docs, covered(docs, window, group)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The documents without the repeated passages; columns as given, untouched texts as they were.

    Of a touched text the kept words stand, joined by one space. n_chars is brought up to date.
    """
    names, text = docs.columns, docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, (doc, ranges) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column(len(names)).to_pylist())):
                if ranges:
                    own = texts[i].encode().split()
                    texts[i] = b" ".join(own[j] for j in np.flatnonzero(~_mask(ranges, doc, len(own))).tolist()).decode()
            kept = batch.select(names)
            yield kept.set_column(text, kept.schema.field("text"), pa.array(texts, kept.schema.field("text").type))

    out = _with_ranges(docs, covered(docs, window, group), *names).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
