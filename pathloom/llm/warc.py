"""WARC archives: a writer, and a reader that splits files at candidate gzip members."""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
#: Payloads from this size on are stored once.
LEAST_REVISIT = 1000
#: Bytes of members that the writer hands to Spark as one row.
ROW_BYTES = 1 << 20
LEVEL = 1


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


#: A gzip member without content. Spark's text writer puts a separator behind every row; this one is legal there.
EMPTY = member(b"")


def record(page_id, url, payload: bytes, digest: str, response: int | None) -> bytes:
    """One WARC/1.1 record, a response, or a revisit of page ``response`` without the payload."""
    target = quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")
    kind = "response" if response is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        head += [f"WARC-Record-ID: <urn:page:{page_id}>"]
    if target:
        head += [f"WARC-Target-URI: {target}"]
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if response is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{response}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_responses(pages: DataFrame, id_col: str, html_col: str, least: int = LEAST_REVISIT, most: int | None = None) -> DataFrame:
    """Adds __payload, __digest and __response: the page that the row revisits, or null.

    Only digests that more than one row of ``least`` bytes or more has are joined back. Payloads are shuffled only if there are
    more than ``most`` of these digests, and then only those of rows that a Bloom filter of the digests lets pass and
    whose digest isn't among the commonest; no task gets all rows of a hot digest.
    """
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.withColumn("__payload", payload).withColumn("__digest", F.sha1("__payload"))
    rows = rows.withColumn("__key", F.when(F.octet_length("__payload") >= least, F.col("__digest")))
    largest = rows.filter("__key is not null").groupBy("__key").agg(F.max(id_col).alias("__largest"), F.count("*").alias("__n"))
    joined = common.join_skewed(rows, largest.filter("__n > 1 and __largest is not null"), "__key", "__n", most, sparse=True)
    revisit = F.col("__largest").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__largest"))
    return joined.withColumn("__response", F.when(revisit, F.col("__largest"))).drop("__largest", "__key")


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    most: int | None = None,
) -> None:
    """Writes a record for each row into gzip archives below ``path``, through Spark's own file writer.

    Of records with equal payloads of at least LEAST_REVISIT bytes, that with the largest id is the response
    and the others revisit it; a null id is smaller than any. Repeated rows with the largest id are all
    responses. A null html is an empty payload; a null id or url leaves its header out. Other columns aren't
    stored. An empty table gives a folder without records.
    """
    common.ship(pages.sparkSession)
    named = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").alias("url"),
        F.col(f"`{html_col}`").alias("html"),
    )
    rows = with_responses(named, "page_id", "html", most=most)

    def run(batches):
        held, size = [], 0
        for some in (x for batch in batches for x in common.slices(batch)):
            for page, url, payload, digest, response in zip(*[c.to_pylist() for c in some.columns], strict=True):
                held.append(member(record(page, url, payload, digest, response)))
                size += len(held[-1])
                if size >= ROW_BYTES:
                    yield common.frame({"data": ([b"".join(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield common.frame({"data": ([b"".join(held)], pa.binary())})

    packed = rows.select("page_id", "url", "__payload", "__digest", "__response").mapInArrow(run, "data binary")
    # the text writer copies a string's bytes as they are
    packed.select(F.col("data").cast("string").alias("value")).write.option(
        "lineSep",
        EMPTY.decode("latin-1"),
    ).option("encoding", "ISO-8859-1").text(path)


def parse(data: bytes) -> dict | None:
    """Type, id, payload, digest and reference of a decoded member, or None where it is no WARC record."""
    if not data.startswith(b"WARC/1."):
        return None
    head, found, block = data.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    try:
        block = block[: int(fields[b"content-length"])]
    except (KeyError, ValueError):
        return None
    if not fields.get(b"content-type", "").lower().startswith("application/http"):
        return {"fields": fields, "payload": block, "full": len(block)}  # a blank line in it is its own
    http, _, payload = block.partition(b"\r\n\r\n")
    full = len(payload)
    if fields.get(b"warc-type") == "revisit":
        for line in http.split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                full = int(value)
    return {"fields": fields, "payload": payload, "full": full}


def _id(value: str | None):
    tail = (value or "").removeprefix("<urn:page:").rstrip(">")
    return int(tail) if (value or "").startswith("<urn:page:") and tail.lstrip("-").isdigit() else None


class Reader:
    """Puts the chunks between candidate magics together to gzip members.

    A chunk starts behind a magic, and starts a member if it decodes and no member is open; a magic inside an
    open member is its data. ``open`` tells whether a member wants more.
    """

    def __init__(self):
        self.stream, self.got = None, []

    @property
    def open(self) -> bool:
        return self.stream is not None

    def feed(self, chunk: bytes) -> bytes | None:
        """Takes the next chunk; gives a decoded member once one is whole."""
        for fresh in (False, True) if self.open else (True,):
            if fresh:
                self.stream, self.got = zlib.decompressobj(31), []
            try:
                self.got.append(self.stream.decompress(MAGIC + chunk))
                break
            except zlib.error:  # a broken member ends here, and this chunk may start another
                self.stream = None
        if self.open and self.stream.eof:
            data, self.stream = b"".join(self.got), None
            return data
        return None


FOUND = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string"


def _row(data: bytes, payloads: bool = True):
    if (r := parse(data)) is None:
        return None
    f = r["fields"]
    kind = f.get(b"warc-type")
    if kind == "revisit":
        digest = _sha1(f.get(b"warc-payload-digest"))
    else:
        digest = hashlib.sha1(r["payload"]).hexdigest()
    page, response = _id(f.get(b"warc-record-id")), _id(f.get(b"warc-refers-to"))
    return (
        page,
        r["payload"] if payloads else None,
        r["full"],
        digest,
        kind,
        response,
        f.get(b"warc-record-id"),
        f.get(b"warc-target-uri"),
    )


def _sha1(value: str | None) -> str | None:
    """A digest header in hex; None where it isn't a SHA-1 in base 32."""
    kind, _, digest = (value or "").partition(":")
    try:
        return base64.b32decode(digest).hex() if kind.lower() == "sha1" else None
    except ValueError:
        return None


_KINDS = {
    "page_id": pa.int64(),
    "payload": pa.binary(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
    "record_id": pa.string(),
    "url": pa.string(),
}


PLACE = ", file string, start long, open boolean"
#: Bytes of decoded records in one batch.
BATCH_BYTES = 4 << 20


def _batch(rows: list) -> pa.RecordBatch:
    kinds = _KINDS | {"file": pa.string(), "start": pa.int64(), "open": pa.bool_()}
    return common.frame({n: ([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())})


def _decode(payloads: bool, across: bool):
    """A task that decodes chunks (file, start, chunk) in order. A reader goes on within a range, or with ``across`` within a file."""

    def run(batches):
        reader, place, rows, size = Reader(), None, [], 0
        for some in (x for batch in batches for x in common.slices(batch)):
            for file, start, chunk in zip(*[some.column(i).to_pylist() for i in range(3)], strict=True):
                here = (file, None if across else start)
                if place != here:
                    if reader.open:
                        rows.append(((None,) * len(_KINDS) + (*place, True)))
                    reader, place = Reader(), here
                if start == 0 and not chunk and not reader.open:
                    continue  # nothing stands before a file's first magic
                if (data := reader.feed(chunk)) is not None and (row := _row(data, payloads)):
                    rows.append((*row, *here, False))
                    size += len(data)
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if reader.open:
            rows.append(((None,) * len(_KINDS) + (*place, True)))
        if rows:
            yield _batch(rows)

    return run


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """The files' bytes, cut at each gzip magic, whatever the files are called.

    Spark's text source would inflate a file whose name ends in ``.gz``, as a whole. It finds a codec by the reversed name: among
    all suffixes, also reversed and sorted, only the last one before the name is looked at. A suffix ``.!.gz`` comes between
    ``.gz`` and such a name (unless a blank stands before ``.gz``) and doesn't fit it, so no codec is found, and the
    file is split like any other. A name that it does fit gets a codec that leaves bytes as they are.
    """
    codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1")
    return lines.option("io.compression.codecs", codec.CLASSNAME).option(codec.OPT_EXTENSION, "!.gz").text(path)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record in the archives below ``path``: page_id, payload, payload_bytes, payload_digest, record_type, refers_to, record_id and url.

    Spark splits a file into byte ranges. Its line reader looks for the gzip magic as the separator, so a
    task gets the chunks that start in its range, reading past the range's end for the last one, and joins them
    to members, which it checks by decoding. Only where a magic inside a member's data falls behind the
    range's end does the range end with an open member, and then the next range can't know where it stands: from
    the first such range of a file on, its chunks are read again in order by one task. By chance that
    befalls one range in some thousands. A response's digest is computed from what was read, a revisit's comes
    from its header. The payload of an HTTP record is what follows its headers, that of any other its whole block. Members
    that are no WARC records are passed over, and so is one cut off by the file's end. page_id and refers_to are null
    in records of other writers. Records that repeat come back as often as they stand there; no archive, or one
    without records, gives an empty result. Without ``payloads`` the payload column is null, and what is staged
    stays narrow.
    """
    common.ship(spark)
    lines = _raw_lines(spark, path)
    chunks = lines.select(
        F.input_file_name().alias("file"),
        F.expr("input_file_block_start()").alias("start"),
        F.col("value").cast("binary").alias("chunk"),
    )
    found = common.stage(chunks.mapInArrow(_decode(payloads, False), FOUND + PLACE), "warc-read")
    doubt = found.filter("open").groupBy("file").agg(F.min("start").alias("first"))
    sure = found.filter("not open")
    if doubt.isEmpty():
        return sure.select(*_KINDS)
    whole = sure.join(doubt, "file", "left").filter("first is null or start < first")
    again = chunks.withColumn("at", common.row_key()).join(doubt, "file").filter("start >= first").select("file", "start", "chunk", "at")
    again = again.repartition("file").sortWithinPartitions("file", "start", "at").mapInArrow(
        _decode(payloads, True),
        FOUND + PLACE,
    ).filter("not open")
    return whole.select(*_KINDS).unionByName(again.select(*_KINDS))
