"""N-gram Jaccard self-join with signature trees.

A text's set is its distinct runs of ``n`` words (64-bit hashes). Two texts link when 100 times the
intersection is at least ``percent`` times the union.

Candidates lose no link. Sizes fall into classes. In a class two linked sets differ in at most d
elements; each set is cut by hash ranges into more than d parts, so some part is equal in both, and
documents with an equal, non-empty part meet under its hash. Where a set has too few non-empty
parts for the argument it is cut again, twice as fine. Tasks pack their part hashes by bucket into
few large rows; equal sets in a slice pack theirs once. Where over ``HOT`` documents of a slice share a
hash, some lead others that their sketches allow to link with; the others leave that hash, and to
make up for it their leader meets others there with the distance that two more links may add. Equal sets are then one member, named by the
smallest doc_id, found by their digests. Members that meet are compared by parity sketches, which
differ in no more bits than the sets in elements; pairs whose sketches allow a link make clusters,
directly or through others. A hash that over ``BLOCK`` documents of the whole table have makes them
one cluster without that comparison.

The members of a cluster are the leaves of a signature tree: a node holds the OR and the AND of its
members' token bitmaps and their range of sizes. The tree is walked against itself; a pair of nodes
is pruned when even the most overlap that bitmaps and sizes allow is too little. What reaches the
leaves is verified on the sets, unless both are already in one component. Clusters over ``chunk``
members or ``WORDS`` shingles are dealt into chunks with some members common to all; then chunks meet
in pairs, but for pairs that lie in one and the same component already, or whose sizes differ too much.

A text without words has an empty set and links with nothing; so does null. Rows with the same
doc_id are one document, linked with all that any of its texts links with. Null doc_ids keep their
rows and link with nothing. Very long texts are read whole, one at a time. An empty table gives no
rows. Extra columns are ignored (``components``) or kept (``deduplicated``).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldspan.llm.components import Forest, connected, stars
from fieldspan.llm.shared import chunks, free, looked_up, marked, shuffle_width, small_batches, written
from fieldspan.llm.wordhash import SPACE, mix, mix_int, rolling, words

CHUNK = 1024
WORDS = 1 << 20  #: shingles of a chunk, on average: 8 MB
COMMON = 32
HOT = 32
LEADERS = 8
BLOCK = 4096  #: documents of the table under a key before all are one cluster, unseen
_RATIO = 1.7
_LAST_CUT = 12


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    w = words(data, offsets, SPACE, lower=True)
    grams = rolling(w.hash, n)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield rolling(w.hash[a:b], b - a)[:1] if b > a else np.zeros(0, np.uint64)


class Parts:
    """Hashes of the parts of a set under which every possible partner meets it."""

    def __init__(self, percent: int):
        if not 70 <= percent <= 100:
            raise ValueError("the join takes 70 to 100 percent")
        self.percent = percent
        self.tops = [1]

    def _class(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * _RATIO)))
        return int(np.searchsorted(self.tops, size))

    def hashes(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        p, out = self.percent, []
        for c in range(self._class(len(s)), self._class(len(s) * 100 // p) + 1):
            differ = 2 * self.tops[c] * (100 - p) // (100 + p)
            for cut in range(_LAST_CUT + 1):
                if cut == _LAST_CUT:
                    starts, place, full = np.arange(len(s)), np.zeros(len(s), np.uint64), len(s)
                else:
                    m = 1 if not differ else int((differ + 1) * 1.15 * 2**cut) + 1
                    part = (s.astype(np.float64) * (m / 2.0**64)).astype(np.int64)
                    starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
                    place, full = part[starts].astype(np.uint64), len(starts)
                out.append(mix(np.add.reduceat(s, starts) + place * np.uint64(0x9E3779B97F4A7C15) + mix_int(c * 64 + cut)))
                if full > differ:
                    break
        return np.concatenate(out)


def _planes(x: np.ndarray, n: int) -> bytes:
    """The n lowest bytes of 64-bit values, byte by byte: equal bytes lie together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _values(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


_FIELDS = [("bucket", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())]
_SCHEMA = "bucket int, a long, b long, d1 long, d2 long, keys binary, docs binary"


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _FIELDS], [k for k, _ in _FIELDS])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the elements by hash, in about as many bits as there are elements (64 to 8192)."""
    bits = 1 << int(np.clip(len(s) - 1, 63, 8191)).bit_length()
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def _heads(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal keys begin, and how many there are."""
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(keys)))


class _Leaders:
    """Leaders among the documents of a slice that share a hash."""

    def __init__(self, sizes: list[int], sketches: list[bytes], percent: int):
        self.sizes, self.percent = np.array(sizes, np.int64), percent
        self.words = np.array([len(r) // 8 for r in sketches])
        self.folded = _folded(sketches)
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def among(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that stay under the hash, whether each leads others)."""
        name = rows.tobytes()
        if name not in self.known:
            kept, leads, rest = [], [], rows
            for _ in range(LEADERS):
                if len(rest) < 2:
                    break
                one = np.full(len(rest) - 1, rest[0])
                led = _allowed(self.sizes, self.words, self.folded, one, rest[1:], self.percent)
                self.edges.append((rest[1:][led], one[led]))
                kept.append(rest[0])
                leads.append(bool(led.any()))
                rest = rest[1:][~led]
            self.known[name] = np.concatenate([np.array(kept, np.int64), rest]), np.concatenate([np.array(leads, bool), np.zeros(len(rest), bool)])
        return self.known[name]


def _thinned(keys: np.ndarray, rows: np.ndarray, leaders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, rows and leads, without the rows that others lead under a key."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    leads, stays = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    head, size = _heads(keys)
    for k in np.flatnonzero(size > HOT).tolist():
        a, b = int(head[k]), int(head[k] + size[k])
        kept, own = leaders().among(rows[a:b])
        stays[a:b] = np.isin(rows[a:b], kept)
        leads[a:b] = np.isin(rows[a:b], kept[own])
    return keys[stays], rows[stays], leads[stays]


def _runs(keys: np.ndarray, docs: np.ndarray, leads: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Keys, documents and leads by key; of keys with over ``most`` documents one is kept, and edges lead to it."""
    order = np.argsort(keys)
    keys, docs, leads = keys[order], docs[order], leads[order]
    head, size = _heads(keys)
    led = np.repeat(size > most, size)
    led[head] = False
    to = np.repeat(docs[head], size)
    return keys[~led], docs[~led], leads[~led], *stars(docs[led], to[led])


def _blocks(keys: np.ndarray, docs: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, document, leads) of keys that two or more documents share; keys with the same documents are one block."""
    head, size = _heads(keys)
    name = mix(np.add.reduceat(mix(docs.view(np.uint64) + leads * np.uint64(0x9E3779B97F4A7C15)), head) + size.astype(np.uint64))
    at = np.flatnonzero(size > 1)
    at = at[np.unique(name[at], return_index=True)[1]]
    take = np.repeat(head[at] - (np.cumsum(size[at]) - size[at]), size[at]) + np.arange(size[at].sum())
    return np.repeat(name[at], size[at]).view(np.int64), docs[take], leads[take]


def _candidates(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Three kinds of rows: facts of documents (a, its set's size b, digest d1 and d2, sketch in keys),
    edges (a, b, no digest), and members of blocks (document a, block d2, whether it leads others b)."""
    width = shuffle_width(docs.sparkSession)
    buckets = 1 << max(4, (4 * width - 1).bit_length())
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(percent)
        for batch in batches:
            for rows, data, off in chunks(batch, "text", 2 << 20):
                keys, ids, facts = [], [], []
                seen: set[tuple] = set()
                for row, (doc, s) in enumerate(zip(rows.column("doc_id").to_pylist(), sets_of(data, off, n))):
                    m = mix(s)
                    digest = (len(s), int(m.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(m)).view(np.int64)) if len(s) else 0)
                    facts.append((doc, *digest, sketch(s).tobytes()))
                    if doc is None or not len(s) or digest in seen:
                        continue
                    seen.add(digest)
                    k = parts.hashes(s)
                    keys.append(k)
                    ids.append(np.full(len(k), row, np.int64))
                a, b, d1, d2, bits = zip(*facts)
                yield _batch(bucket=[(d or 0) % buckets for d in a], a=a, b=b, d1=d1, d2=d2, keys=bits)
                if not keys:
                    continue
                led: list[_Leaders] = []
                k, d, leads = _thinned(np.concatenate(keys), np.concatenate(ids), lambda: led[0] if led else led.append(_Leaders(b, bits, percent)) or led[0])
                doc_ids = rows.column("doc_id").fill_null(0).to_numpy()
                d = doc_ids[d]
                if led:
                    x, y = stars(*(doc_ids[np.concatenate(v)] for v in zip(*led[0].edges)))
                    yield _batch(bucket=x % buckets, a=x, b=y)
                for lead in (0, 1):
                    own_k, own_d = k[leads == lead], d[leads == lead]
                    cuts = np.searchsorted(own_k >> shift, np.arange(buckets + 1, dtype=np.uint64))
                    full = [x for x in range(buckets) if cuts[x] < cuts[x + 1]]
                    yield _batch(bucket=full, b=[lead] * len(full), keys=[_planes(own_k[cuts[x] : cuts[x + 1]], 7) for x in full], docs=[_planes(own_d[cuts[x] : cuts[x + 1]].view(np.uint64), 8) for x in full])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = None

        def found() -> Iterator[pa.RecordBatch]:
            if held:
                k, d, leads, a, b = _runs(*(np.concatenate(v) for v in zip(*held)), BLOCK)
                held.clear()
                if len(a):
                    yield _batch(bucket=np.zeros(len(a), np.int32), a=a, b=b)
                block, doc, lead = _blocks(k, d, leads)
                if len(block):
                    yield _batch(bucket=np.zeros(len(block), np.int32), a=doc, b=lead.astype(np.int64), d2=block)

        for batch in batches:
            packed = batch.column("docs").is_valid().to_numpy(zero_copy_only=False)
            if not packed.all():
                yield batch.filter(pa.array(~packed))
            rows = batch.filter(pa.array(packed))
            for bucket, lead, k, d in zip(*(rows.column(c).to_pylist() for c in ("bucket", "b", "keys", "docs"))):
                if bucket != at:
                    yield from found()
                    at = bucket
                docs_ = _values(d, 8).view(np.int64)
                held.append((_values(k, 7), docs_, np.full(len(docs_), bool(lead))))
        yield from found()

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, _SCHEMA)
    return packed.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, _SCHEMA)


def _folded(raw: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of words: (each row's place or -1, sketches folded to that many words)."""
    words_ = np.array([len(r) // 8 for r in raw])
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    place, now, w = np.full(len(raw), -1), np.zeros((0, 256), np.uint64), 128
    while w:
        now = now[:, :w] ^ now[:, w:]
        own = np.flatnonzero(words_ == w)
        place[own] = len(now) + np.arange(len(own))
        if len(own):
            now = np.concatenate([now, np.frombuffer(b"".join(raw[i] for i in own.tolist()), np.uint64).reshape(-1, w)])
        out[w] = (place.copy(), now)
        w //= 2
    return out


def _allowed(sizes: np.ndarray, words_: np.ndarray, folded: dict, x: np.ndarray, y: np.ndarray, percent: int, leads: np.ndarray | None = None) -> np.ndarray:
    """Where sketches and sizes allow a link, or one between documents that the rows lead."""
    total = sizes[x] + sizes[y]
    most = total - 2 * (-(-percent * total // (100 + percent)))
    if leads is not None and leads.any():
        # a led set has at most 100 / percent times its leader's size, so its sketch has half the leader's
        # bits at least; at that width sketches' distances add up along leader, led, led, leader
        far, up = (100 - percent) / (100 + percent), 100 / percent
        size = [sizes[z] * np.where(leads[z], 1 + 2 * up, 1.0) for z in (x, y)]
        most = np.where(leads[x] | leads[y], np.ceil(far * (size[0] + size[1])).astype(np.int64), most)
    keep = np.abs(sizes[x] - sizes[y]) <= most
    least = np.minimum(words_[x], words_[y])
    if leads is not None:
        least = np.where(leads[x] | leads[y], np.maximum(least // 2, 1), least)
    for w in np.unique(least[keep]).tolist():
        at = np.flatnonzero(keep & (least == w))
        place, rows = folded[w]
        for a in range(0, len(at), 1 << 12):
            part = at[a : a + (1 << 12)]
            differ = np.bitwise_count(rows[place[x[part]]] ^ rows[place[y[part]]]).sum(1, dtype=np.int64)
            keep[part] = differ <= most[part]
    return keep


def _sketched(members: DataFrame, percent: int) -> DataFrame:
    """Edges a, b between members (block, doc, leads, n, bits) of a block whose sketches allow a link."""

    def pairs(head: list[int], ends: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        xs, ys, size = [], [], 0
        for a, b in zip(head, ends):
            k = b - a
            step = max(1, (1 << 18) // k)
            for r in range(0, k, step) if k > 512 else (0,):
                i, j = np.triu_indices(k, 1) if k <= 512 else (v.ravel() for v in np.meshgrid(np.arange(r, min(k, r + step)), np.arange(r, k), indexing="ij"))
                xs.append(i + a)
                ys.append(j + a)
                size += len(i)
                if size > 1 << 18:
                    yield np.concatenate(xs), np.concatenate(ys)
                    xs, ys, size = [], [], 0
        if xs:
            yield np.concatenate(xs), np.concatenate(ys)

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block, doc, n = (table.column(c).to_numpy() for c in ("block", "doc", "n"))
        leads = table.column("leads").to_numpy() == 1
        raw = table.column("bits").to_pylist()
        head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        ends = np.append(head[1:], len(block))
        words_, folded = np.array([len(r) // 8 for r in raw]), _folded(raw)
        a = b = doc[:0]
        for x, y in pairs(head.tolist(), ends.tolist()):
            keep = _allowed(n, words_, folded, x, y, percent, leads)
            a, b = stars(np.concatenate([a, doc[x[keep]]]), np.concatenate([b, doc[y[keep]]]))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1]))  # the last block may go on
            if held and cut == 0 and held[-1].column("block")[-1].as_py() != block[0]:
                yield from compared(pa.Table.from_batches(held).combine_chunks())
                held = []
            elif cut:
                yield from compared(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from compared(pa.Table.from_batches(held).combine_chunks())

    spread = members.repartition(shuffle_width(members.sparkSession), "block").sortWithinPartitions("block")
    return spread.mapInArrow(run, "a long, b long")


def links(sets: list[np.ndarray], percent: int, forest: Forest) -> None:
    """Join in ``forest`` the positions of linked sets, by a dual walk of their signature tree."""
    n = len(sets)
    if n < 2:
        return
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort(([int(s[0]) for s in sets], sizes))
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * max(1, np.median(sizes)))), 8, 14))
    maps = np.zeros((n, bits // 8), np.uint8)
    for i, k in enumerate(order):
        one = np.zeros(bits, bool)
        one[(sets[k] & np.uint64(bits - 1)).astype(np.int64)] = True
        maps[i] = np.packbits(one)
    maps = maps.view(np.uint64)
    low = high = sizes[order]
    every = [(maps, maps, low, high)]
    fan = [8]
    while len(every[-1][0]) > 8:
        some, all_, low, high = every[-1]
        cut = np.arange(0, len(low), fan[-1])
        every.append((np.bitwise_or.reduceat(some, cut), np.bitwise_and.reduceat(all_, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
        fan.append(8)
    x, y = (v.astype(np.int32) for v in np.triu_indices(len(every[-1][0])))
    for level in range(len(every) - 1, -1, -1):
        kept = []
        for a in range(0, len(x), 8192):
            cx, cy = x[a : a + 8192], y[a : a + 8192]
            if level < len(every) - 1:
                cx, cy = _children(cx, cy, fan[level], len(every[level][0]))
            for b in range(0, len(cx), 8192):
                dx, dy = cx[b : b + 8192], cy[b : b + 8192]
                keep = _possible(every[level], dx, dy, percent)
                if level == 0:
                    keep &= dx != dy
                kept.append((dx[keep], dy[keep]))
        x, y = (np.concatenate(v) for v in zip(*kept)) if kept else (x[:0], y[:0])
    for i, j in zip(order[x].tolist(), order[y].tolist()):
        if forest.find(i) != forest.find(j):
            a, b = sets[i], sets[j]
            both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            if 100 * both >= percent * (len(a) + len(b) - both):
                forest.join(i, j)


def _children(x: np.ndarray, y: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.divmod(np.arange(fan * fan, dtype=np.int32), fan)
    cx, cy = (x[:, None] * fan + i).ravel(), (y[:, None] * fan + j).ravel()
    keep = (cx <= cy) & (cy < n) & (cx < n)
    return cx[keep], cy[keep]


def _possible(level: tuple, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Where the most overlap of two nodes' members may reach the least that a link needs."""
    some, all_, low, high = level
    miss = lambda a, b: np.bitwise_count(all_[a] & ~some[b]).sum(1, dtype=np.int64)
    most = np.minimum(high[x] - miss(x, y), high[y] - miss(y, x))
    near = (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
    return near & ((100 + percent) * most >= percent * (low[x] + low[y]))


def _linked(percent: int):
    """Grouped: rows doc, start (component known before, or null) and shingles; out: doc, root."""

    def run(table: pa.Table) -> pa.Table:
        docs = table.column("doc").to_numpy()
        forest = Forest(len(docs))
        order = np.argsort(docs, kind="stable")  # so that a component's root has its smallest doc
        docs = docs[order]
        for i in np.flatnonzero(docs[1:] == docs[:-1]).tolist():
            forest.join(i, i + 1)
        if "comp" in table.column_names:
            seen: dict[int, int] = {}
            for i, c in enumerate(table.column("comp").to_numpy()[order].tolist()):
                forest.join(seen.setdefault(c, i), i)
        raw = table.column("shingles")
        links([np.frombuffer(raw[int(i)].as_py(), "<u8") for i in order], percent, forest)
        root = np.array([forest.find(i) for i in range(len(docs))], np.int64)
        own = docs[root] != docs
        return pa.table({"a": docs[own], "b": docs[root[own]]})

    return run


def _sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The members (cluster, size, chunks, doc, d1) with their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in chunks(batch, "text"):
                sets = list(sets_of(data, off, n))
                d1 = rows.column("d1").to_numpy()
                same = np.array([int(mix(s).sum(dtype=np.uint64).view(np.int64)) == d for s, d in zip(sets, d1.tolist())], bool)
                out = rows.select(["cluster", "size", "chunks", "doc"]).append_column("shingles", pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()))
                yield out.filter(pa.array(same))

    # most documents are in no cluster: their texts needn't move
    texts = marked(docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), "doc", members.select("doc"), "member").where("member").drop("member")
    return members.join(texts, "doc").select("cluster", "size", "chunks", "doc", "d1", "text").mapInArrow(run, "cluster long, size long, chunks int, doc long, shingles binary")


def components(docs: DataFrame, n: int = 3, percent: int = 90, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) of every row."""
    found = written(_candidates(small_batches(docs), n, percent), "candidates")
    facts = found.where("d1 is not null").select(F.col("a").alias("doc"), F.col("b").alias("n"), "d1", "d2", F.col("keys").alias("bits"))
    able = facts.where("n > 0 and doc is not null")
    copied = written(able.groupBy("n", "d1", "d2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"), "copied")
    members = looked_up(able, copied, ["n", "d1", "d2"], "left")
    members = written(members.select("doc", F.coalesce("rep", "doc").alias("rep"), "n", "d1", "bits"), "members")

    blocks = found.where("d1 is null and d2 is not null").select(F.col("a").alias("doc"), F.col("d2").alias("block"), F.col("b").alias("leads")).distinct()
    # copies give way to their member, and a block holds a member once, before sketches join in
    own = members.select("doc", "rep").distinct()
    blocks = blocks.join(own, "doc").select("block", F.col("rep").alias("doc"), "leads").distinct()
    sketches = members.where("doc = rep").select("doc", "n", "bits").distinct()
    near = _sketched(blocks.join(sketches, "doc"), percent)
    edges = found.where("d1 is null and d2 is null").select("a", "b").union(near)
    clusters = connected(edges.union(members.where("doc <> rep").select("doc", "rep")))
    labels = clusters.union(clusters.select(F.col("label"), F.col("label")).distinct()).toDF("doc", "cluster")
    reps = written(members.where("doc = rep").select("doc", "n", "d1").distinct().join(labels, "doc"), "reps")
    sizes = reps.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words")).where("size > 1")
    n_chunks = F.ceil(F.greatest(F.col("size") / chunk, F.col("words") / WORDS)).cast("int")
    sizes = written(sizes.select("cluster", "size", n_chunks.alias("chunks")), "sizes")
    sets = written(_sets(docs, looked_up(reps, sizes, ["cluster"]), n), "sets")

    shared = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("doc", F.lit(1)), F.ceil(F.col("size") / COMMON)) == 0)
    where = F.when(shared, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int")))
    dealt = sets.withColumn("chunk", F.explode(where))
    links_ = written(dealt.select("cluster", "chunk", "doc", "shingles").groupBy("cluster", "chunk").applyInArrow(_linked(percent), "a long, b long"), "links")
    one = members.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")  # rows of one doc_id with unequal texts
    one = members.join(one.select("doc", "a"), "doc").select("rep", "a").where("rep > a").distinct()
    joined = links_.toDF("rep", "component_id")
    whole, single = (not x.limit(1).count() for x in (sets.where("chunks > 1"), one))
    if not (whole and single):
        roots = connected(links_.union(one))
        more = written(_across(sets.where("chunks > 1"), roots, percent, chunk), "links") if not whole else one.limit(0)
        joined = (connected(roots.toDF("a", "b").union(more)) if more.limit(1).count() else roots).toDF("rep", "component_id")
    labelled = looked_up(members.select("doc", "rep", "n"), joined, ["rep"], "left")
    out = labelled.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))
    rest = facts.where("n = 0 or doc is null").select("doc", "n", "doc")
    return out.union(rest)


def _across(sets: DataFrame, roots: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links between chunks of large clusters, chunks made anew by the components and sizes found so far."""
    rows = sets.withColumn("n", F.octet_length("shingles") / 8).join(roots, F.col("doc") == F.col("node"), "left")
    rows = rows.select("cluster", "doc", F.coalesce("label", "doc").alias("comp"), "n", "shingles")
    grade = F.floor(F.ln("n") / F.lit(max(0.02, -log(percent / 100)))).alias("grade")
    rows = rows.withColumn("grade", grade)
    counts = rows.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("times"), F.sum("n").alias("words"))
    counts = counts.withColumn("parts", F.greatest(F.col("times") / chunk, F.col("words") / WORDS))
    small = counts.where("parts < 0.25").groupBy("cluster").agg(F.sum("parts").alias("pooled"))
    plan = written(counts.join(small, "cluster", "left").select("cluster", "comp", "parts", "pooled"), "plan")
    own = F.col("parts") >= 0.25
    name = F.struct(
        F.when(own, F.col("comp")).alias("comp"),
        "grade",
        F.when(own, F.pmod(F.xxhash64("doc"), F.ceil("parts"))).otherwise(F.pmod(F.xxhash64("comp"), F.ceil("pooled"))).alias("part"),
    )
    named = looked_up(rows, plan, ["cluster", "comp"]).withColumn("chunk", F.xxhash64(name))
    placed = written(named.select("cluster", "chunk", "doc", "comp", "n", "shingles"), "placed")
    chunks_ = placed.groupBy("cluster", "chunk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    left, right = (chunks_.toDF("cluster", *[f"{c}{k}" for c in ("c", "lo", "hi", "least", "most")]) for k in (1, 2))
    one = (F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo1") == F.col("lo2"))
    near = (100 * F.col("most1") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least1"))
    pairs = left.join(right, "cluster").where((F.col("c1") <= F.col("c2")) & near & ~one).select("cluster", "c1", "c2")
    sides = pairs.withColumn("chunk", F.explode(F.array_distinct(F.array("c1", "c2"))))
    return placed.join(sides, ["cluster", "chunk"]).select("cluster", "c1", "c2", "doc", "comp", "shingles").groupBy("cluster", "c1", "c2").applyInArrow(_linked(percent), "a long, b long")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """The documents without those that links lead to a smaller doc_id; columns as given."""
    gone = written(components(docs, n, percent, chunk).where("component_id < doc_id").select("doc_id").distinct(), "gone")
    mark = free("gone", docs.columns)
    rows = marked(docs, "doc_id", gone, mark)
    # only rows that may go are looked up; the others stay where they are
    looked_up = rows.where(mark).join(gone, "doc_id", "left_anti")
    return rows.where(~F.col(mark)).select(*docs.columns).unionByName(looked_up.select(*docs.columns))
