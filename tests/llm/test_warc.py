import base64
import glob
import gzip
import hashlib
from pathlib import Path

import pytest

from tarn.llm import warc as A
from tests.oracle import rows_of_spark, rows_of_sql


def rows():
    html = [None, "", "<p>a</p>", "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 3", "x" * 300_000, "x" * 300_000, "filedesc://b 1 2 3 4\n", "\n\n", "HTTP/1.1 200 OK\r\n\r\nbody", "\x00\x01"]
    out = [(i * 7 % 23, f"http://h/{i}?a b\n\r{i}é", h) for i, h in enumerate(html)]
    return [*out, (100, None, ""), (None, "http://n/", "alone"), (101, "http://h/1", "same url"), (102, "http://h/1", "same url")]


@pytest.mark.parametrize("file_bytes", [A.FILE_BYTES, 1000])
def test_matches_brute_force(spark, file_bytes):
    data = rows()
    pages = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(map(tuple, A.archived(pages, file_bytes=file_bytes).collect()), key=str)
    want = []
    for i, _, h in data:
        same = [j for j, _, g in data if (g or "") == (h or "")]
        last = max(same, key=lambda j: -1 if j is None else j)
        b = (h or "").encode()
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == last else "revisit", None if i == last else last))
    assert got == sorted(want, key=str)
    large = A.archived(pages, least=5).where("payload_bytes < 5").collect()
    assert large and all(r["record_type"] == "response" for r in large)
    twice = spark.createDataFrame([(1, "u", "a"), (1, "u", "a")], "page_id long, url string, html string")
    assert sorted(r["record_type"] for r in A.archived(twice).collect()) == ["response", "revisit"]
    assert A.archived(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_of_either_version(version):
    bodies = [b"", b"a\n\nfiledesc://x 1 2 3 4\n", b"HTTP/1.0 404 No\r\n\r\n\r\n\r\n"]
    data = A.arc_version_block(version, "f.arc", "20010203040506") + b"\n" + b"".join(A.arc_record(version, "http://a b/", "1.2.3.4", "20010203040506", b) + b"\n" for b in bodies)
    found = list(A.parse_arc(data))
    assert [b for _, b in found] == bodies
    assert all(h["url"] == "http://a%20b/" and h["date"] == "20010203040506" and len(h) == len(A.ARC_FIELDS[version]) for h, _ in found)
    with pytest.raises(ValueError):
        list(A.parse_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(A.parse_arc(data[data.index(b"\n\n") + 2 :]))
    other = A.arc_version_block(3 - version, "f.arc", "20010203040506") + b"\n" + A.arc_record(version, "u", "i", "2001", b"x")
    with pytest.raises(ValueError):
        list(A.parse_arc(other))


@pytest.mark.parametrize("version", [1, 2])
def test_what_arc_knows_goes_into_warc(version):
    page = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhi"
    data = b"\n".join([A.arc_version_block(version, "f.arc", "20010203040506"), A.arc_record(version, "http://a/", "192.0.2.7", "20010203040506", page), A.arc_record(version, "http://a/x.gif", "192.0.2.8", "20010203", b"GIF89a", "image/gif")])
    records = [A.converted(*x) for x in A.parse_arc(data)]
    fields = [next(A.parse_warc(r.serialised() + A.END.encode()))[0] for r in records]
    assert [f["warc-ip-address"] for f in fields] == ["192.0.2.7", "192.0.2.8"]
    assert [f["content-type"] for f in fields] == ["application/http; msgtype=response", "image/gif"]
    assert [f["warc-date"] for f in fields] == ["2001-02-03T04:05:06Z", "2001-02-03T00:00:00Z"]
    revisit = A.converted(*next(A.parse_arc(data)), {"url": "http://b/", "date": "2001-02-03T04:05:06Z", "number": None})
    fields, body = next(A.parse_warc(revisit.serialised() + A.END.encode()))
    assert fields["warc-type"] == "revisit" and fields["warc-refers-to-target-uri"] == "http://b/" and body == page[:-2]
    if version == 2:
        with pytest.raises(ValueError, match="checksum"):
            list(A.parse_arc(data.replace(b"GIF89a", b"GIF87a")))


def test_archives_of_others_and_sizes_of_files(spark, tmp_path):
    """Records without a page id, in a file that this module didn't write."""
    bodies = [b"HTTP/1.1 200 OK\r\n\r\none", b"plain", b"HTTP/1.1 200 OK\r\n\r\none"]
    (tmp_path / "arc").mkdir()
    with gzip.open(tmp_path / "arc" / "part-1.arc.gz", "wb") as file:
        file.write(b"\n".join([A.arc_version_block(1, "f.arc", "20010203040506"), *(A.arc_record(1, f"http://a/{i}", "1.2.3.4", "20010203040506", b) for i, b in enumerate(bodies))]) + b"\n\n")
    A.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = sorted((r["payload_bytes"], r["record_type"], r["page_id"]) for r in A.read_warc(spark, str(tmp_path / "warc")).where("record_type = 'response'").collect())
    assert got == [(3, "response", None), (5, "response", None)] and A.read_warc(spark, str(tmp_path / "warc")).count() == 3
    A.write_arc(spark.createDataFrame([(i, "u", "x" * 400) for i in range(100)], "page_id long, url string, html string").coalesce(1), str(tmp_path / "own"), file_bytes=5000)
    sizes = [len(gzip.decompress(Path(f).read_bytes())) for f in glob.glob(str(tmp_path / "own" / "part-*"))]
    assert len(sizes) > 5 and max(sizes) < 6500


def test_made_up_fields():
    assert A.timestamp("20010203040506") == "2001-02-03T04:05:06Z" and A.timestamp("200102") == "2001-02-01T00:00:00Z"
    assert A.record_id("u", "d", "x") == A.record_id("u", "d", "x") != A.record_id("u", "d", "y")
    data = A.Record("response", "u", "d", "<i>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n", b"pay\r\n\r\nload").serialised() + b"\r\n\r\n"
    ((fields, body),) = A.parse_warc(data)
    assert A.split_http(body) == (b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n", b"pay\r\n\r\nload") and fields["warc-type"] == "response"
    with pytest.raises(ValueError):
        list(A.parse_warc(data.replace(b"pay", b"pax")))


def test_rows_equal_those_of_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of_spark(A.op7_warc(spark, sf)) == rows_of_sql(A.OP7_SQL, sf)
