import gzip
import hashlib
import os
import zlib

from pathloom.llm import common, warc

PAGES = "page_id long, url string, html string, record_type string"


def brute(rows):
    top = {}
    for page, html in rows:
        if page is not None and len((html or "").encode()) >= warc.LEAST_REVISIT:
            top[html] = max(top.get(html, page), page)
    out = []
    for page, html in rows:
        b = (html or "").encode()
        other = top.get(html) if len(b) >= warc.LEAST_REVISIT else None
        revisit = other is not None and other != page
        out.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(
        [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()],
        key=str,
    )


def test_round_trip(spark):
    big, same = "<p>é</p>\r\n\r\n" * 300, "x" * 999
    rows = [
        (1, "u", big),
        (2, "u", big),
        (7, None, big),
        (3, "http://a/ b\r\nc", same),
        (4, "u", same),
        (5, "u", None),
        (6, "u", ""),
        (None, "u", big),
        (None, None, None),
        (7, "u", big),
        (8, "u", "z" * 3_000_000),
        (-9, "u", "y" * 1000),
        (-9, "u", "y" * 1000),
    ]
    pages = spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows], PAGES)
    path = common.new_path(spark, "warc")
    warc.write(pages, path)
    found = warc.read(spark, path)
    assert got(found) == brute([(a, c) for a, _, c in rows])
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in found.collect() if r["record_type"] == "response" and r["page_id"] is not None}
    assert payloads[8] == "z" * 3_000_000
    assert payloads[7] == big


def test_empty(spark):
    path = common.new_path(spark, "warc")
    warc.write(spark.createDataFrame([], PAGES), path)
    assert warc.read(spark, path).count() == 0


def stored(data: bytes) -> bytes:
    """A member that keeps its data as it is, magics included."""
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def test_ranges_and_false_magics(spark):
    """Small ranges over archives whose records hold gzip magics, whole members and even WARC records as data."""
    rows, members = [], []
    for i in range(60):
        nested = gzip.compress(warc.record(1000 + i, "inner", b"n" * 900, "00" * 20, None))
        inner = (warc.MAGIC * (i * 40), gzip.compress(b"WARC/1.1 no record" * i), nested * 3)[i % 3]
        payload = b"head" + inner + b"tail" * (i * 29 % 97)
        rows.append((i, payload))
        members.append(stored(warc.record(i, "u", payload, hashlib.sha1(payload).hexdigest(), None)))
    path = common.new_path(spark, "foreign")
    folder = path.removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/a.warc", "wb") as f:
        f.write(b"".join(members[:40]))
    with open(f"{folder}/b.warc", "wb") as f:
        f.write(b"".join(members[40:]))
    keep = [(k, spark.conf.get(k)) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    try:
        for size in (512, 1777, 5000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = sorted((r["page_id"], bytes(r["payload"])) for r in warc.read(spark, path).collect())
            assert found == rows
    finally:
        for k, v in keep:
            spark.conf.set(k, v)


def test_archives_whatever_they_are_called(spark):
    """Names of compressed files change nothing, and such files are split."""
    path = common.new_path(spark, "named").removeprefix("file:")
    os.makedirs(path)
    names, rows = ["a.warc.gz", "b.gz", "c.warc", "d", "e!.gz", "f.tar.gz"], []
    for k, name in enumerate(names):
        with open(f"{path}/{name}", "wb") as f:
            for i in range(50):
                payload = os.urandom(700)
                rows.append((100 * k + i, hashlib.sha1(payload).hexdigest()))
                f.write(warc.member(warc.record(100 * k + i, "u", payload, "00" * 20, None)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        found = warc.read(spark, path)
        assert sorted((r["page_id"], r["payload_digest"]) for r in found.collect()) == sorted(rows)
        assert warc._raw_lines(spark, f"{path}/a.warc.gz").rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def foreign(kind, mime, block, record_id="<urn:uuid:12345678-0000-0000-0000-000000000042>"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: dns:x\r\nContent-Type: {mime}\r\nContent-Length: {len(block)}"
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers(spark):
    blocks = [
        ("warcinfo", "application/warc-fields", b"a: b\r\n\r\nc: d", b"a: b\r\n\r\nc: d"),
        ("response", "text/dns", b"five!", b"five!"),
        ("response", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\r\n\r\nmore", b"body\r\n\r\nmore"),
        ("resource", "application/octet-stream", b"", b""),
    ]
    path = common.new_path(spark, "others").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/x.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(foreign(*b[:3])) for b in blocks) + gzip.compress(b"no record"))
    rows = warc.read(spark, path).collect()
    assert sorted((r["record_type"], bytes(r["payload"])) for r in rows) == sorted((b[0], b[3]) for b in blocks)
    assert {(r["page_id"], r["record_id"], r["url"]) for r in rows} == {(None, "<urn:uuid:12345678-0000-0000-0000-000000000042>", "dns:x")}


def test_more_digests_than_are_broadcast(spark):
    rows = [(i, f"u{i}", "same " * 300 + str(i % 7 if i % 2 else i)) for i in range(200)] + [(500 + i, "u", None) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (0, 3):
        path = common.new_path(spark, "warc")
        warc.write(pages, path, most=most)
        assert got(warc.read(spark, path)) == brute([(a, c) for a, _, c in rows])
