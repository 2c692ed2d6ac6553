import gzip
import hashlib

import pytest

from fieldspan.llm import warc as W


def test_round_trip(spark, tmp_path):
    big, small = "é" * 600, "tiny"
    rows = [(1, "http://a/", big), (5, "http://b/\r\nX: y", big), (3, None, big), (2, "http://c/", small), (4, "http://d/", small), (6, "http://e/", None), (7, "http://f/", ""), (None, "http://g/", "n" * 1000), (9, "http://h/", "q" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in W.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: (got[i].record_type, got[i].refers_to) for i in got} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None)} | {i: ("response", None) for i in (2, 4, 6, 7, None, 9)}
    chunks = W.archives(pages).collect()
    for name in {c.archive for c in chunks}:
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(bytes(c.chunk) for c in sorted(chunks, key=lambda c: c.seq) if c.archive == name))
    back = {r.page_id: r for r in W.read_files(spark, str(tmp_path)).collect()}
    assert bytes(back[5].payload).decode() == big and back[1].payload is None and back[5].url == "http://b/%0D%0AX: y"
    assert W.round_trip(pages.where("page_id < 0")).count() == 0


def test_hot_copies_ties_and_clashing_columns(spark):
    rows = [(i, "http://a/", "hot " * 400) for i in range(3000)] + [(2999, "http://a/", "hot " * 400), (None, "u", "z" * 2000), (None, "u", "z" * 2000)]
    rows += [(5000 + i, None, f"{i % 7} " * 600) for i in range(40)] + [(6000 + i, None, "") for i in range(300)]
    names = "page_id long, url string, html string"
    pages = spark.createDataFrame(rows, names).selectExpr("*", "1 as digest", "2 as size", "3 as member", "4 as holder", "5 as times", "6 as payload").repartition(5)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in W.round_trip(pages).collect()), key=repr)
    largest = {i % 7: 5000 + i for i in range(40)}
    want = [(i, "revisit", 2999) for i in range(2999)] + [(2999, "response", None)] * 2 + [(None, "response", None)] * 2
    want += [(5000 + i, "response", None) if largest[i % 7] == 5000 + i else (5000 + i, "revisit", largest[i % 7]) for i in range(40)]
    assert got == sorted(want + [(6000 + i, "response", None) for i in range(300)], key=repr)


def test_ordinary_archives(spark, tmp_path):
    def plain(kind, body, extra=""):
        return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    head = "Content-Type: application/http; msgtype=response\r\n"
    raw = plain("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields\r\n") + plain("response", http + b"page", head) + plain("request", b"GET / HTTP/1.1\r\n\r\n", head) + plain("response", http + b"page", head + f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'page').hexdigest()}\r\n") + plain("response", http + b"x", head + "WARC-Payload-Digest: sha256:00\r\n")
    (tmp_path / "a b.warc.gz").write_bytes(raw)
    got = [(r.record_type, r.payload_bytes, bytes(r.payload)) for r in W.read_files(spark, str(tmp_path)).collect()]
    assert got == [("warcinfo", 13, b"software: x\r\n"), ("response", 4, b"page"), ("request", 0, b""), ("response", 4, b"page"), ("response", 1, b"x")]


def test_damage_is_an_error():
    one = W.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    member = next(iter(W.members([one[:10], one[10:]])))
    assert W.entry(member)[2:5] == (3, hashlib.sha1(b"abc").hexdigest(), "response")
    with pytest.raises(ValueError):
        list(W.members([one[:-4]]))
    with pytest.raises(ValueError):
        W.entry(member.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        W.parsed(gzip.decompress(one)[:-2])
