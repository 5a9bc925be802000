import base64
import gzip
import hashlib
import uuid
from pathlib import Path

import pytest

from shelfcheck.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nContent-Length: {n}\r\n\r\n{body}"


def payloads():
    inner = FAKE.format(n=5, body="HTTP/1.1 200 OK\r\n\r\nhello")
    return [
        None, "", "plain", "plain", "plain", "<p>é漢字🙂</p>", "ends\r\n", "ends\r\n\r\n", "\r\n\r\nstarts", "a\nb\r\nc\r\n\r\nd", "WARC/1.1\r\n", "x WARC/1.1\r\ny",
        inner, inner + "\r\n\r\n", "text " + inner + inner, FAKE.format(n=10**9, body="far"), FAKE.format(n=0, body=""), "WARC/1.1\r\nWARC-Type: response\r\n",
        "z" * 300_000, "\r\n\r\nWARC/1.1\r\n" * 50, FAKE.format(n=70_000, body="deep " * 100) * 30, "WARC/1.1", "\r", "\n", "",
    ]


def base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        top = max(same, default=None) if len(data) >= least else None
        revisit = top is not None and i != top
        out.append((i, len(data), base32(data), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as payload", "0 as key")


@pytest.mark.parametrize("compression, split, stretch", [("gzip", None, None), ("gzip", None, 5000), ("gzip", None, 90), ("none", None, 900), ("none", 4096, None), ("none", 700, 3000)])
def test_round_trip_rejects_magic_in_payloads(spark, tmp_path, compression, split, stretch):
    """Also where archives are read in many splits, with records and magic lines across their borders, and where chains are
    jumped along over many stretches, some shorter than a record."""
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(payloads())]
    folder = str(tmp_path / uuid.uuid4().hex)
    warc.write(table(spark, rows).coalesce(2), folder, compression=compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = warc.read(spark, folder, stretch or warc.STRETCH).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == plain(rows)
    html = dict((i, h or "") for i, _, h in rows)
    assert all(r.payload == html[r.page_id] and r.url == f"http://h/{r.page_id}" for r in got if r.record_type == "response")


def test_archives_are_records_one_after_another(spark, tmp_path):
    """A plain reader that starts at the first byte sees every record."""
    rows = [(i, "u", p) for i, p in enumerate(payloads())]
    warc.write(table(spark, rows), str(tmp_path / "w"))
    seen = []
    for path in Path(tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            seen.append(int(fields[b"WARC-Record-ID"][12:-1]))
            data = rest[n + 4 :]
    assert sorted(seen) == list(range(len(rows)))


def test_nulls_repeats_and_thresholds(spark, tmp_path):
    rows = [(None, "u", "same"), (4, None, "same"), (4, "u\r\nX: y", "same"), (2, "u", "same"), (None, "u", "alone"), (None, "u", "alone"), (7, "u", ""), (8, "u", None)]
    warc.write(table(spark, rows), str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == plain(rows)
    assert "u%0D%0AX: y" in {r.url for r in got}
    warc.write(table(spark, rows), str(tmp_path / "b"), least_bytes=5)
    kinds = sorted((r.payload_bytes, r.record_type) for r in warc.read(spark, str(tmp_path / "b")).collect())
    assert kinds == sorted((n, t) for _, n, _, t, _ in plain(rows, 5))


def test_nothing_and_no_archive(spark, tmp_path):
    warc.write(table(spark, [(1, "u", "x")]).limit(0), str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_text("no record\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n", newline="")
    assert warc.read(spark, str(tmp_path / "b")).count() == 0
