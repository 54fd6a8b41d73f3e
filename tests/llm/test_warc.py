"""WARC: exact round trip, index offsets, revisits, byte ranges."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from redline.llm import warc
from redline.sources.scratch import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, id string, offset int"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(1)
    big = "<p>" + "é" * 600
    rows = [(i, f"http://x.org/{i}?q=ü%20 a", "<html>" + "".join(rng.choice("ab<>\r\n") for _ in range(rng.randint(0, 3000))))
            for i in range(60)]
    rows += [(100 + i, "http://copy.org/", big) for i in range(40)]                 # a hot payload
    rows += [(200, None, None), (201, "", ""), (202, "u\r\nX: y", "short"), (203, "u", "short"), (None, "n", big),
             (204, "http://l.org", "long " * 300_000), (139, "http://copy.org/", big), (139, "http://copy.org/", big)]
    return [(*r, "d", "i", 7) for r in rows]


def _written(spark, rows, **kw):
    return warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), scratch_path(spark, "warc-test"), **kw)


def test_round_trip(llm, pages):
    index = _written(llm, pages, archive_bytes=20_000)
    got = sorted(((r.id is None, r.id or 0, r.url or "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url is None)
                  for r in warc.read_warc(index).collect()))
    want = []
    for page_id, url, html, *_ in pages:
        body = (html or "").encode()
        top = max((p[0] for p in pages if p[0] is not None and (p[2] or "") == (html or "")), default=None)
        revisit = len(body) >= 1000 and page_id is not None and page_id < top
        want.append((page_id is None, page_id or 0, url or "", len(body), hashlib.sha1(body).hexdigest(),
                     "revisit" if revisit else "response", top if revisit else None, url is None))
    assert got == sorted(want)
    payloads = {r.id: r.payload for r in warc.read_warc(index.filter("record_type = 'response'")).collect()}
    assert all((p[2] or "").encode() == payloads[p[0]] for p in pages if p[0] in payloads)
    assert index.select("archive").distinct().count() > 3


def test_index_offsets_are_gzip_members(llm, pages):
    index = _written(llm, pages)
    for r in index.filter("id in (3, 202, 204)").collect():
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            raw = gzip.decompress(f.read(r.length))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        rec = warc.parse_record(raw)
        assert (rec[0], rec[1], rec[3]) == (r.id, r.url, r.payload_digest)
    assert {r.id for r in warc.read_warc(index.filter(F.col("id") % 7 == 0), with_payload=False).collect()} == \
        {p[0] for p in pages if p[0] is not None and p[0] % 7 == 0}


def test_damaged_payloads_are_found(llm):
    raw = warc.record_bytes(1, "u", hashlib.sha1(b"abc").hexdigest(), 3, b"abd", None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw)


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 1000, 10), ("b", 0, 10), ("b", 10, 90), ("b", 100, 5)]
    assert [[r[1] for r in x] for x in warc.ranges(rows, gap=8, most=100)] == [[0, 10, 25], [1000], [0, 10], [100]]


def test_empty_table(llm):
    index = warc.write_warc(llm.createDataFrame([], SCHEMA), scratch_path(llm, "warc-test"))
    assert index.count() == 0 and warc.read_warc(index).count() == 0


def test_large_ids_stay_exact_beside_a_null_one(llm):
    body = "x" * 1500
    ids = [2**53 + 1, None, 2**60 + 3, 2**60 + 4]
    pages = llm.createDataFrame([(i, "http://a.b/", body if i and i > 2**59 else "y") for i in ids], "page_id long, url string, html string")
    got = warc.read_warc(warc.write_warc(pages, scratch_path(llm, "warc-ids"))).collect()
    assert {(r.id, r.refers_to) for r in got} == {(2**53 + 1, None), (None, None), (2**60 + 3, 2**60 + 4), (2**60 + 4, None)}
