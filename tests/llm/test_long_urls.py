"""Archives hold pages whose header is longer than a megabyte, and records that others wrote."""

import base64
import gzip
import hashlib
import random

from vellum.llm import warc


def test_header_over_a_megabyte():
    rng = random.Random(3)
    url = "http://a.example/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(3 << 20))
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: {url}\r\n"
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    whole = gzip.compress(f"{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n", mtime=0)
    plain = gzip.compress(b"no record " * 50, mtime=0)
    broken = gzip.compress(b"WARC/ without an end " * 200_000, mtime=0)
    archive = plain + broken + whole
    rows = list(warc.records_from(lambda at, n: archive[at : at + n], 0, len(archive)))
    assert [(r[0], r[1] == url, r[-1]) for r in rows] == [(7, True, b"hello")]


def test_archives_of_others(spark, tmp_path):
    def member(version, kind, body, **fields):
        lines = [f"WARC/{version}", f"WARC-Type: {kind}", "WARC-Date: 2020-01-01T00:00:00Z", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items())]
        return gzip.compress("\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", mtime=0)

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    uuid = "<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>"
    archive = (
        member("1.0", "warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:uuid:0>", Content_Type="application/warc-fields")
        + member("1.0", "request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:uuid:1>", Content_Type="application/http; msgtype=request")
        + member("1.0", "response", http + b"caf\xc3\xa9", WARC_Record_ID=uuid, WARC_Target_URI="http://a/%0A", Content_Type="application/http; msgtype=response")
        + member("1.0", "metadata", b"k: v\r\n", WARC_Record_ID="<urn:uuid:3>", WARC_Refers_To=uuid)
        + member("1.1", "revisit", http, WARC_Record_ID="<urn:uuid:4>", WARC_Refers_To=uuid, WARC_Payload_Digest="sha1:ABC", Content_Type="application/http")
        + member("1.0", "response", b"20200101 a. 1.2.3.4", WARC_Record_ID="<urn:uuid:5>", WARC_Target_URI="dns:a", Content_Type="text/dns")
        + member("1.0", "conversion", b"plain", WARC_Record_ID="<urn:uuid:6>")
    )
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc.gz").write_bytes(archive)
    for split in (64, 1 << 20):
        rows = sorted(warc.read(spark, (tmp_path / "w").as_uri(), split).collect(), key=lambda r: r.record_id)
        assert [(r.page_id, r.record_type, r.record_id, r.refers_to, r.refers_to_id) for r in rows] == [
            (None, "revisit", "<urn:uuid:4>", None, uuid), (None, "response", "<urn:uuid:5>", None, None), (None, "response", uuid, None, None),
        ]
        assert [r.payload and bytes(r.payload) for r in rows] == [None, b"20200101 a. 1.2.3.4", "café".encode()]
        assert [r.payload_bytes for r in rows] == [None, 19, 5] and rows[0].payload_digest == "ABC"
        assert rows[2].url == "http://a/%0A" and rows[2].payload_digest == base64.b32encode(hashlib.sha1("café".encode()).digest()).decode()
