import base64
import hashlib

from sentable.llm import warc as W

SCHEMA = "page_id long, url string, html string, file string, digest string"


def pages(spark, tmp_path, rows):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA).coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx"
ROWS = [(1, "http://a", "<p>one</p>"), (2, None, None), (3, "http://b c\r\nd", ""), (4, "u", "<p>one</p>"),
        (5, "u", "line\r\n\r\nline\r\n\r\n\r\nend"), (6, "u", "ends with\r\n"), (7, "u", "ends with\r\n\r\n"),
        (8, "u", "\r\n\r\nstarts"), (9, "u", "a\r\n\r\n" + FAKE.format(3) + "\r\n\r\n"),
        (10, "u", FAKE.format(10 ** 9)), (11, "u", "b\r\n\r\n" + FAKE.format(20) + "\r\n\r\n" + FAKE.format(21)),
        (12, "u", "tail\r"), (13, "u", "\n\r\n"), (None, "u", "null id"), (14, "u", "Ünï 漢字 🎉"), (15, "u", "x" * 300_000),
        (16, "u", "HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\nnested"), (17, "u", "\r"), (18, "u", "same"), (18, "u", "same"),
        (19, "u", "WARC/1.0\r\n\r\nWARC/1.0\r\n\r\n")]


def brute(rows):
    out, keep = [], {}
    for i, _, h in rows:
        keep[h or ""] = max([x for x in (keep.get(h or ""), i) if x is not None], default=None)
    first = set()
    for i, _, h in rows:
        data = (h or "").encode()
        k = keep[h or ""]
        response = i == k and (h or "") not in first
        if response:
            first.add(h or "")
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if response else "revisit", None if response else k))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "warc")
    W.write_archives(pages(spark, tmp_path, ROWS), path, per_archive=6)
    assert sorted(map(tuple, W.read_archives(spark, path).collect()), key=str) == brute(ROWS)


def test_round_trip_of_split_files(spark, tmp_path):
    path = str(tmp_path / "warc")
    W.write_archives(pages(spark, tmp_path, ROWS).coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "1531b", "64k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(map(tuple, W.read_archives(spark, path).collect()), key=str) == brute(ROWS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_small_payloads_are_never_revisits(spark, tmp_path):
    path = str(tmp_path / "warc")
    W.write_archives(pages(spark, tmp_path, ROWS), path, min_bytes=5)
    types = {(r.page_id, r.record_type) for r in W.read_archives(spark, path).collect()}
    assert (18, "revisit") not in types and (1, "revisit") in types and (2, "response") in types


def test_archives_are_plain_warc(spark, tmp_path):
    path = str(tmp_path / "warc")
    W.write_archives(pages(spark, tmp_path, ROWS[:1]), path)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    n = int(fields[b"Content-Length"])
    assert head.startswith(b"WARC/1.0\r\n") and rest[:n].endswith(b"<p>one</p>") and rest[n:] == b"\r\n\r\n"


def test_empty(spark, tmp_path):
    path = str(tmp_path / "warc")
    W.write_archives(pages(spark, tmp_path, []), path)
    assert W.read_archives(spark, path).collect() == []
