"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before they are matched, at places where no match can span: between a
character that is not white space and white space that follows, and between a letter or number and
a punctuation mark that follows (so texts that are written without white space are cut too). Every
alternative of the split pattern is white space followed by one run of letters, of numbers or of
other characters, or white space alone, so the pieces give the ids that the whole text gives.

A null text is an empty one: no ids, and an empty decoding. Each row, repeated or with a null doc_id
too, gets its row; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from fieldspan.llm.shared import small_batches

RANKS = "byte_bpe_50k.tiktoken"
PIECE = 1 << 16
_ROWS = 1000
#: Python's classes hold all white space, and no more letters and numbers, than the pattern's.
_SAFE = re.compile(r"(?<=\S)(?=[ \n\t\r])|(?<=[^\W_])(?=[!,.:;?()、。！，：；？])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """Parts of at most about ``most`` characters, cut at safe places; a part without any stays whole."""
    a = 0
    while len(text) - a > most:
        cut = _SAFE.search(text, a + most)
        if cut is None:
            break
        yield text[a : cut.start()]
        a = cut.start()
    yield text[a:]


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    if len(text) <= PIECE:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text)])


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in (b.slice(a, _ROWS) for b in batches for a in range(0, b.num_rows, _ROWS)):
            ids = [encode(enc, t or "").astype(np.int32) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the raw bytes of each row's ids."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            raw = [enc.decode_bytes(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return small_batches(tokens).select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 over little-endian 32-bit ids, decoded_sha256.

    The ids are encoded and decoded in one task, as ``tokenized`` and ``decoded`` would.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in (b.slice(a, _ROWS) for b in batches for a in range(0, b.num_rows, _ROWS)):
            counts, ids_hash, raw_hash = [], [], []
            for t in batch.column("text").to_pylist():
                ids = encode(enc, t or "")
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                raw_hash.append(hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(raw_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
