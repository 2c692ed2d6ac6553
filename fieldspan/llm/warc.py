"""WARC archives: one gzip member per record, and a sequential reader.

The writer gives each payload one ``response`` record and, for equal payloads of at least
``min_bytes`` bytes, ``revisit`` records that refer to it. Response members are made first, from each
page where it lies; only those of payloads that are there more than once (and a few that hash alike)
move, compressed, to learn whether they stay or become revisits. An archive is a stream of bytes,
kept as numbered chunks of whole members in rows, so any store that Spark can write holds it;
``read_files`` reads ``.warc.gz`` files through the same reader.

The reader inflates piece by piece, takes each member's header lines, then exactly the bytes that
Content-Length names, and compares the payload's SHA-1 with the recorded digest; a mismatch, a
short block or a broken member is an error, not a dropped record. A record of another type, such as
``warcinfo``, is given as it is, without page; one without a digest gets the payload's.

Null html is an empty payload. Rows with the same page_id and payload are all written, as responses
if that page_id is the largest. A null page_id is written as such and read back as null. Very long
pages are one member each. An empty table gives no archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldspan.llm.shared import looked_up, marked, small_batches, written

MIN_BYTES = 1000
_CHUNK = 1 << 20
_PIECE = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def responses(pages: DataFrame) -> DataFrame:
    """page_id, url, size and digest (hex) of each payload, and its member as a response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            raw = [(x or "").encode() for x in batch.column("html").to_pylist()]
            digests = [hashlib.sha1(x).hexdigest() for x in raw]
            made = [record(i, u, x, d, None) for i, u, x, d in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), raw, digests)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(map(len, raw), pa.int64()), pa.array(digests, pa.string()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "size", "digest", "member"])

    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, size long, digest string, member binary")


def planned(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, size, digest, member (a response's) and refers_to (null for responses)."""
    made = written(responses(pages), "members")
    long_enough = F.col("size") >= min_bytes
    copies = made.where(long_enough).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("times"))
    copies = written(copies.where("times > 1").drop("times"), "copies")
    short = F.when(long_enough, F.xxhash64("digest"))
    rows = marked(made.withColumn("key", short), "key", copies.select(F.xxhash64("digest").alias("key")), "copied").drop("key")
    refers = F.when(F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    found = looked_up(rows.where("copied").drop("copied"), copies, ["digest"], "left").withColumn("refers_to", refers).drop("holder")
    alone = rows.where("not copied").drop("copied").withColumn("refers_to", F.lit(None).cast("long"))
    return alone.unionByName(found)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | int, digest: str, refers_to: int | None) -> bytes:
    """A member; of a revisit's payload the number of bytes is enough."""
    size = payload if isinstance(payload, int) else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def archives(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """archive, seq, chunk: the archives' bytes in order, each chunk whole members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, seq, held = f"part-{TaskContext.get().partitionId():06d}", 0, bytearray()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([seq], pa.int64()), pa.array([bytes(held)], pa.binary())], ["archive", "seq", "chunk"])

        for batch in batches:
            for i, url, size, digest, member, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "size", "digest", "member", "refers_to"))):
                revisit = refers_to.is_valid
                held += record(i.as_py(), url.as_py(), size.as_py(), digest.as_py(), refers_to.as_py()) if revisit else member.as_py()
                if len(held) >= _CHUNK:
                    yield row()
                    seq, held = seq + 1, bytearray()
        if held:
            yield row()

    return planned(pages, min_bytes).mapInArrow(run, "archive string, seq long, chunk binary")


def members(stream: Iterable[bytes]) -> Iterator[bytes]:
    """Each gzip member of a stream of bytes, inflated."""
    inflate, parts = None, []
    for chunk in stream:
        while chunk:
            if inflate is None:
                inflate, parts = zlib.decompressobj(31), []
            parts.append(inflate.decompress(chunk))
            chunk = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate = None
    if inflate is not None:
        raise ValueError("the archive ends inside a gzip member")


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the block that Content-Length frames."""
    end = member.index(b"\r\n\r\n")
    first, *lines = member[:end].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(head["content-length"])
    block = member[end + 4 : end + 4 + size]
    if len(block) != size or member[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    return head, block


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def entry(member: bytes) -> tuple[int | None, str | None, int, str | None, str, int | None, bytes | None]:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits).

    The payload is what follows the HTTP header of an HTTP block, and else the whole block.
    """
    head, block = parsed(member)
    kind, name = head.get("warc-type", ""), head.get("warc-record-id")
    top, payload = b"", block
    if head.get("content-type", "").lower().startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
    digest = _digest(head.get("warc-payload-digest", "") if top else head.get("warc-block-digest", ""))
    if kind == "revisit":
        size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", top)
        return _page(name), head.get("warc-target-uri"), int(size[1]) if size else 0, digest, kind, _page(head.get("warc-refers-to")), None
    own = hashlib.sha1(payload).hexdigest()
    if digest not in (None, own):
        raise ValueError(f"payload of {name} differs from its digest")
    return _page(name), head.get("warc-target-uri"), len(payload), own, kind, None, payload


def _digest(field: str) -> str | None:
    """The hex form of a SHA-1 field, in base32 or hex; of others null: they aren't compared."""
    kind, _, value = field.partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


_KIND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_TYPES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _entries(stream: Iterable[bytes], payload: bool) -> Iterator[pa.RecordBatch]:
    """The records of one stream, in batches of bounded size."""
    held, size = [], 0
    for member in members(stream):
        e = entry(member)
        held.append(e if payload else (*e[:-1], None))
        size += (e[2] if payload else 0) + 500
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), _KIND)], schema=_KIND)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), _KIND)], schema=_KIND)


def read_chunks(rows: DataFrame, payload: bool = True) -> DataFrame:
    """The records of archives given as (archive, seq, chunk), each chunk whole members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[bytes]:
            for batch in batches:
                for chunk in batch.column("chunk"):
                    raw = chunk.as_buffer()
                    yield from (raw[a : a + _PIECE].to_pybytes() for a in range(0, raw.size, _PIECE))

        yield from _entries(pieces(), payload)

    return small_batches(rows).select("chunk").mapInArrow(run, _TYPES)


def read_files(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of ``.warc.gz`` files. Spark lists them; a task streams its files, never holding one whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(quote(re.sub(r"^file:/*", "file:///", uri), safe="/:@"))
                with store.open_input_stream(name, compression=None) as f:
                    yield from _entries(iter(lambda: f.read(_PIECE), b""), payload)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(run, _TYPES)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives to the shared folder, read them back, and give each record's facts."""
    return read_chunks(written(archives(pages, min_bytes), "warc"), payload=False).drop("payload", "url")
