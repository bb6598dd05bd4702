"""WARC archives with segmented records: writing them and putting them together again.

Writing: each page becomes an HTTP response with chunked framing, cut into segments
of bounded size; the first is the record itself, the others are continuation records
that name it.  Pages whose payload another page already carries become revisit
records.  Spark's text writer puts the records into gzip files, one record a row.

Reading: gzip files are read line by line, which keeps every byte and holds one
record in memory at a time.  Segments are grouped by their origin and ordered by
number, the total length is verified, and the chunked framing is decoded.
"""

import base64
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.tables import written
from riskframe.session import shared_folder

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
DEDUP_FROM = 1_000  # shorter payloads are never revisits
DATE = "2024-01-01T00:00:00Z"
SEGMENT_SCHEMA = (
    "origin string, segment long, total long, kind string, page string, uri string, digest string, "
    "refers_to string, block binary"
)
RECORD_SCHEMA = (
    "page string, uri string, kind string, digest string, refers_to string, complete boolean, payload binary"
)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if not size:
            return b"".join(parts)
        start = end + 2
        if body[start + size : start + size + 2] != b"\r\n":
            return None
        parts.append(body[start : start + size])
        at = start + size + 2


def _header(fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _one_line(text) -> str:
    return "" if text is None else str(text).replace("\r", "").replace("\n", "")


def records_of(page: str, uri: str, payload: bytes, sha1: str, leader: str | None) -> Iterator[bytes]:
    """The records of one page without the blank lines that end each."""
    record = f"<urn:uuid:{uuid4()}>"
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    about = [("WARC-Date", DATE), ("X-Page-Id", page), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if leader is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record), *about]
        fields += [("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:x-page:{leader}>")]
        yield _header([*fields, ("Content-Length", str(len(http)))]) + http
        return
    block = http + chunked(payload)
    cuts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record), *about]
    if len(cuts) > 1:
        fields.append(("WARC-Segment-Number", "1"))
    yield _header([*fields, ("Content-Length", str(len(cuts[0])))]) + cuts[0]
    for n, cut in enumerate(cuts[1:], 2):
        fields = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", record),
            ("WARC-Segment-Number", str(n)),
        ]
        if n == len(cuts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _header([*fields, ("Content-Length", str(len(cut)))]) + cut


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            page = _one_line(row.page)
            out += records_of(page, _one_line(row.uri), row.payload, row.sha1, row.leader)
        yield pd.DataFrame({"record": out})


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes a record for every row of ``pages`` (page_id, url, html) into gzip archives below ``path``.

    Of rows with equal payloads of at least DEDUP_FROM bytes the one with the largest
    page_id is the response, the others revisit it; rows that share that id are all
    responses, and so are rows where no copy has an id.  Null html is an empty payload.
    Only (sha1, page_id) is grouped; the payloads meet just the digests with copies.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("uri"), html.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    long_enough = rows.filter(F.octet_length("payload") >= DEDUP_FROM)
    leaders = long_enough.groupBy("sha1").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n"))
    # written first, so that the payloads are shuffled only where the digests with copies are many
    leaders = written(leaders.filter("n > 1 and leader is not null").drop("n"))
    own = F.col("page_id").eqNullSafe(F.col("leader"))
    records = rows.join(leaders, "sha1", "left").select(
        F.col("page_id").cast("string").alias("page"),
        "uri",
        "payload",
        "sha1",
        F.when(~own, F.col("leader").cast("string")).alias("leader"),
    )
    records = records.mapInPandas(_records, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class RecordReader:
    """Cuts a stream of bytes into records; holds what is not yet a whole record."""

    def __init__(self):
        self.held, self.need = bytearray(), 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
        self.held += data
        if len(self.held) < self.need:
            return
        at = 0
        while True:
            while self.held[at : at + 2] == b"\r\n":
                at += 2
            end = self.held.find(b"\r\n\r\n", at)
            if end < 0:
                self.need = 0
                break
            first, *lines = bytes(self.held[at:end]).split(b"\r\n")
            if not first.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at {first[:40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
            stop = end + 4 + int(fields[b"content-length"])
            if len(self.held) < stop:
                self.need = stop - at
                break
            yield fields, bytes(self.held[end + 4 : stop])
            at = stop
        del self.held[:at]


def _segment(fields: dict[bytes, bytes], block: bytes) -> tuple:
    text = {k: v.decode() for k, v in fields.items()}
    digest = text.get(b"warc-payload-digest", "")
    total = text.get(b"warc-segment-total-length")
    refers_to = text.get(b"warc-refers-to")
    return (
        text.get(b"warc-segment-origin-id", text[b"warc-record-id"]),
        int(text.get(b"warc-segment-number", 0)),
        -1 if total is None else int(total),
        text[b"warc-type"],
        text.get(b"x-page-id"),
        text.get(b"warc-target-uri"),
        base64.b32decode(digest.removeprefix("sha1:")).hex() if digest else None,
        refers_to.removeprefix("<urn:x-page:").removesuffix(">") if refers_to else None,
        block,
    )


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
    reader, path = RecordReader(), None
    for frame in frames:
        for own, lines in frame.groupby("path", sort=False)["line"]:
            if own != path:
                reader, path = RecordReader(), own
            data = b"\n".join(lines) + b"\n"
            out = [_segment(*found) for found in reader.feed(data)]
            if out:
                yield pd.DataFrame(out, columns=columns)


def _payload(block: bytes) -> bytes | None:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _assembled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def whole(parts: list) -> tuple | None:
        first, last = parts[0], parts[-1]
        if first.kind == "revisit":
            return first.page, first.uri, first.kind, first.digest, first.refers_to, True, None
        numbers = [p.segment for p in parts]
        block = b"".join(p.block for p in parts)
        alone = numbers == [0]
        complete = alone or (numbers == list(range(1, len(parts) + 1)) and last.total == len(block))
        payload = _payload(block) if complete else None
        return first.page, first.uri, first.kind, first.digest, None, payload is not None, payload

    parts: list = []
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if parts and parts[0].origin != row.origin:
                out.append(whole(parts))
                parts = []
            parts.append(row)
        if out:
            yield pd.DataFrame(out, columns=columns)
    if parts:
        yield pd.DataFrame([whole(parts)], columns=columns)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzip archives below ``path``, its segments put together.

    (page, uri, kind, digest, refers_to, complete, payload).  A record whose segments
    are not all there, whose length is not the total it names, or whose framing is
    broken is not ``complete`` and has no payload; a revisit has none of its own.
    Archives without records give no rows.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    segments = lines.mapInPandas(_segments, SEGMENT_SCHEMA)
    # the segments of one record meet in one task: as many bytes as its payload
    ordered = segments.repartition("origin").sortWithinPartitions("origin", "segment")
    return ordered.mapInPandas(_assembled, RECORD_SCHEMA)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """What :func:`read_archive` finds after :func:`write_archive` wrote ``pages``."""
    path = path or shared_folder(pages.sparkSession)
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
