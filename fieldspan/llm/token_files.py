"""Token ids in directly addressable codes, with random access to any token.

A shard splits each id into chunks of 8 bits, the lowest first. Level 0 holds the first chunk of
every id, level 1 the second chunk of the ids that have one, and so on; a bitmap per level says
which ids go on, and a rank directory counts its set bits up to each block of 512, so a token's
place on the next level is one directory entry and one popcount away. No block is decoded.

Documents are dealt by ranges of doc_id and written in ascending order; rows with the same doc_id
keep the order of their texts, nulls come first. A shard is one row (its bytes in ``payload``), so
any store that Spark can write holds the files. A null text is an empty one: its only id is the end
id. An empty table gives no rows. Extra columns are ignored.

Encoding takes each distinct word once: the tokenizer replaces white space and splits at it, so a
text's ids are its words' ids one after another. The strings of special tokens, which hold no white
space, become those tokens wherever they stand in a text, as is the library's default.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fieldspan.llm.shared import chunks, shuffle_width, small_batches, written
from fieldspan.llm.wordhash import SPACE, words

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SHARD_TOKENS = 1 << 18
_MAGIC = b"DAC2"
_BLOCK = 512


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once and kept.

    What is kept is dropped and begun anew beyond ``most`` words, so memory stays bounded.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        begins, sizes, a = np.concatenate([[0], np.cumsum(lengths + 1)]), np.zeros(len(texts), np.int64), 0
        new: list[np.ndarray] = []
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(begins, begins[a] + 20_000, "right")) - 1)
            found = self.tokenizer.encode(" ".join(texts[a:b]), add_special_tokens=False)
            if found.ids:
                at = np.array(found.offsets, np.int64)[:, 0] + begins[a]
                sizes[a:b] = np.bincount(np.searchsorted(begins, at, "right") - 1 - a, minlength=b - a)
                new.append(np.array(found.ids, np.uint32))
            a = b
        ids = np.concatenate(new) if new else np.zeros(0, np.uint32)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.size, at, sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets into them)."""
        w = words(data, offsets, SPACE)
        if len(self.keys) > self.most:
            self._clear()
        keys, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if not known.all():
            raw = data.tobytes()
            lo, hi = w.start[first[~known]].tolist(), w.end[first[~known]].tolist()
            self._learn(keys[~known], [raw[a:b].decode() for a, b in zip(lo, hi)])
            at = np.searchsorted(self.keys, keys)
        size = self.size[at][which] if len(keys) else np.zeros(0, np.int64)
        start = self.start[at][which] if len(keys) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[take], ends[w.first]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process; what it has learnt serves the next tasks."""
    return WordEncoder(path)


def pack(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """A shard: doc ids (the first ``nulls`` of them null), token offsets of the documents' ends, and the ids by level."""
    out = [b""]
    level, rest = 0, ids.astype(np.uint32)
    while len(rest) or level == 0:
        more = rest >> np.uint32(8)
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        counts = np.bitwise_count(bits.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(1)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        out += [struct.pack("<I", len(rest)), (rest & np.uint32(255)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest, level = more[goes_on], level + 1
    out[0] = _MAGIC + struct.pack("<IIII", len(doc_ids), nulls, len(ids), level) + doc_ids.astype("<i8").tobytes() + ends.astype("<u4").tobytes()
    return b"".join(out)


class Shard:
    """A packed shard, read in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != _MAGIC:
            raise ValueError("not a token shard")
        docs, self.nulls, self.tokens, levels = struct.unpack_from("<IIII", payload, 4)
        at = 20
        self.doc_ids = np.frombuffer(payload, "<i8", docs, at)
        self.ends = np.frombuffer(payload, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        self.levels = []
        for _ in range(levels):
            n = struct.unpack_from("<I", payload, at)[0]
            at += 4
            size = (-(-n // 8) + 63) // 64 * 64
            chunk, bits = np.frombuffer(payload, np.uint8, n, at), np.frombuffer(payload, np.uint8, size, at + n)
            ranks = np.frombuffer(payload, "<u4", size // 64 + 1, at + n + size)
            self.levels.append((chunk, bits, ranks))
            at += n + size + 4 * (size // 64 + 1)

    def _rank(self, level: int, i: int) -> int:
        """How many of a level's first i chunks go on: one directory entry and the bits of one block."""
        _, bits, ranks = self.levels[level]
        i = int(i)
        block = i // _BLOCK
        rest = int.from_bytes(bits[block * 64 : (i + 7) >> 3].tobytes(), "little") & ((1 << (i - block * _BLOCK)) - 1)
        return int(ranks[block]) + rest.bit_count()

    def token(self, i: int) -> int:
        """The i-th id, by one byte, one bit and one rank on each of its levels."""
        value = shift = 0
        for level, (chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def read(self, a: int, b: int) -> np.ndarray:
        """The ids from a to b, b exclusive: on each level the chunks between two ranks, and no others."""
        value, at = np.zeros(b - a, np.uint32), None
        for level, (chunk, bits, _) in enumerate(self.levels):
            if a == b:
                break
            part = chunk[a:b].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].astype(bool)
            if at is None:
                value |= part
                at = np.flatnonzero(more)
            else:
                value[at] |= part
                at = at[more]
            a, b = self._rank(level, a), self._rank(level, b)
        return value


def shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """part, seq, start (tokens before the shard in its part), n_tokens, payload."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(path), TaskContext.get().partitionId()
        seq = before = 0
        docs_held: list[pa.Array] = []
        sizes_held: list[np.ndarray] = []
        ids_held: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            nonlocal seq, before
            ids = np.concatenate(ids_held)
            own = pa.concat_arrays(docs_held)
            payload = pack(own.fill_null(0).to_numpy(), np.cumsum(np.concatenate(sizes_held)), ids, own.null_count)
            values = [[part], [seq], [before], [len(ids)], [payload]]
            seq, before = seq + 1, before + len(ids)
            for held in (docs_held, sizes_held, ids_held):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seq", "start", "n_tokens", "payload"])

        for batch in batches:
            for rows, data, off in chunks(batch, "text"):
                ids, ends = encoder.encode(data, off)
                ids = np.insert(ids, ends[1:], end_id)
                ends = ends + np.arange(len(ends))
                doc = rows.column("doc_id")
                a = 0
                while a < len(doc):
                    room = SHARD_TOKENS - sum(map(len, ids_held))
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + room, "right")) - 1)
                    docs_held.append(doc[a:b])
                    sizes_held.append(np.diff(ends[a : b + 1]))
                    ids_held.append(ids[ends[a] : ends[b]])
                    a = b
                    if sum(map(len, ids_held)) >= SHARD_TOKENS or a < len(doc):
                        yield row()
        if docs_held:
            yield row()

    ordered = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shuffle_width(docs.sparkSession), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part int, seq long, start long, n_tokens long, payload binary")


def read_back(files: DataFrame) -> DataFrame:
    """Per document from the shards: doc_id, start, n_tokens, ids_crc32; each document's ids are read by
    their place. Only the token counts of the parts, as many as the writer's partitions, come to the driver.
    """
    totals = {r[0]: r[1] for r in files.groupBy("part").agg(F.sum("n_tokens")).collect()}
    starts, total = {}, 0
    for part in sorted(totals):
        starts[part], total = total, total + totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(batch.column("part"), batch.column("start"), batch.column("payload")):
                shard = Shard(payload.as_py())
                ends = shard.ends.astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(shard.read(a, b).astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, mask=np.arange(len(ends)) < shard.nulls),
                        pa.array(begins + starts[part.as_py()] + start.as_py()),
                        pa.array(ends - begins),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return small_batches(files).select("part", "start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_back(written(shards(docs, path), "tokens"))
