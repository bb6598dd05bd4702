import gzip
import hashlib
import random
from pathlib import Path

import pytest

from riskframe.llm import warc_segments as ws


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, page string, sha1 string")


def read_back(spark, rows, tmp_path):
    found = ws.round_trip(pages_of(spark, rows), f"file://{tmp_path}/archive").collect()
    assert len(found) == len(rows) and all(r.complete for r in found)
    return found


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    big = "".join(rng.choice("ab\r\n é\U0001f600<") for _ in range(120_000))
    tricky = "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40
    texts = [None, "", "\n", "\r\n\r\n", "short", big, tricky, "x" * ws.SEGMENT_BYTES, "\n" * 5_000, "tail\n\n"]
    rows = [(i, f"http://a/{i}\r\nX-Page-Id: 9", t) for i, t in enumerate(texts)]
    found = {int(r.page): r for r in read_back(spark, rows, tmp_path)}
    for i, _, text in rows:
        payload = (text or "").encode()
        assert found[i].kind == "response" and bytes(found[i].payload) == payload
        assert found[i].digest == hashlib.sha1(payload).hexdigest()


def test_copies_revisit_the_largest_id(spark, tmp_path):
    long, short = "long " * 400, "short"
    rows = [(i, "u", long) for i in range(50)] + [(100 + i, "u", short) for i in range(5)]
    rows += [(49, "u", long), (None, "u", long), (None, "u", "other " * 400), (None, "u", "other " * 400)]
    found = read_back(spark, rows, tmp_path)
    by_kind = {}
    for r in found:
        by_kind.setdefault(r.kind, []).append(r)
    assert sorted((str(r.page) for r in by_kind["revisit"])) == sorted([*map(str, range(49)), ""])
    assert all(r.refers_to == "49" and r.payload is None for r in by_kind["revisit"])
    assert len(by_kind["response"]) == 2 + 5 + 2


def test_no_pages(spark, tmp_path):
    assert read_back(spark, [], tmp_path) == []


def test_archives_are_plain_gzip_and_segments_may_lie_anywhere(spark, tmp_path):
    """Records written by hand: segments out of order and in two files, one incomplete, one of a wrong length."""

    def record(fields, block):
        head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"

    def parts(page, block, cut, total):
        origin = f"<urn:o:{page}>"
        first = [("WARC-Type", "response"), ("WARC-Record-ID", origin), ("X-Page-Id", page), ("WARC-Segment-Number", 1)]
        rest = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:c:{page}>"), ("WARC-Segment-Origin-ID", origin)]
        rest += [("WARC-Segment-Number", 2), ("WARC-Segment-Total-Length", total)]
        return record(first, block[:cut]), record(rest, block[cut:])

    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + ws.chunked(b"hello \xff\x00 world", 4)
    a, b = parts(1, block, 30, len(block)), parts(2, block, 40, len(block) + 1)
    alone = parts(3, block, 30, len(block))[0]
    plain = record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:o:4>"), ("X-Page-Id", 4)], b"HTTP/1.1 200 OK\r\n\r\nbody")
    folder = Path(tmp_path) / "own"
    folder.mkdir()
    (folder / "one.warc.gz").write_bytes(gzip.compress(a[1]) + gzip.compress(b[0]) + gzip.compress(alone))
    (folder / "two.warc.gz").write_bytes(gzip.compress(b[1] + plain + a[0]))
    found = {r.page: (r.complete, r.payload and bytes(r.payload)) for r in ws.read_archive(spark, f"file://{folder}").collect()}
    assert found == {"1": (True, b"hello \xff\x00 world"), "2": (False, None), "3": (False, None), "4": (True, b"body")}


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_chunks(size):
    for payload in (b"", b"a", b"\r\n0\r\n\r\n", b"x" * 10_000):
        assert ws.unchunked(ws.chunked(payload, size)) == payload
    assert ws.unchunked(b"5\r\nab") is None and ws.unchunked(b"zz\r\n") is None and ws.unchunked(b"") is None
    assert ws.unchunked(b"2;x=y\r\nab\r\n0\r\n\r\n") == b"ab"


def test_reader_takes_any_cut_of_the_stream():
    records = list(ws.records_of("7", "u", b"p" * 40_000, "00" * 20, None))
    data = b"".join(r + b"\r\n\r\n" for r in records)
    for step in (1_000, 4_097, len(data)):
        reader = ws.RecordReader()
        out = [f for i in range(0, len(data), step) for f in reader.feed(data[i : i + step])]
        assert len(out) == len(records) and not bytes(reader.held).strip()
