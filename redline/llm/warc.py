"""WARC archives, index first.

Writing: each task writes its pages as gzip members, one per record, to archives of its own, and
yields the index: per record the archive, byte offset, length, URL, payload digest and the
record's header values.  The index is stored as Parquet before anything is read.  A file name is
the attempt's own, and the index holds only those of the attempts that Spark committed, so
repeated or speculative attempts leave unreferenced files, never wrong offsets.

Reading: any selection of index rows is range-partitioned by (archive, offset); neighbouring
records are fetched by one byte-range read if the gap between them is at most ``GAP`` and the read
stays within ``MAX_READ``.  Each payload's digest is checked against its header.

Payloads of at least ``REVISIT_BYTES`` that are equal (SHA-1 and length) share one response
record, that with the largest id; the others are revisit records, which hold headers only.

Files are opened by ``pyarrow.fs`` from the folder's URI: any shared file system it knows.

Defined cases: a null payload is an empty one; a null URL writes no target header and is null
again when read; a null id is never a response for others nor a revisit; of repeated rows with
the largest id all are responses, other repeated rows come out once each; an empty table writes
an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.llm.common import stored

REVISIT_BYTES = 1000
#: A task begins another archive after so many bytes; a read task fetches about so many.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 16 << 20
#: Byte-range reads: the largest gap read over, and the largest single read.
GAP, MAX_READ = 64 << 10, 8 << 20

_INDEX = ("archive string, offset long, length long, url string, payload_digest string, id long, "
          "payload_bytes long, record_type string, refers_to long")
_RECORD = ("id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, payload binary")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def record_bytes(page_id, url: str | None, digest: str, size: int, payload: bytes, refers_to) -> bytes:
    """One uncompressed record.  A revisit (``refers_to`` given) has the HTTP head only."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~-._|^`{}\"<>\\"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to, payload or None)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()

    def number(name):
        v = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(v) if v else None
    url = unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload does not match its digest")
    return (number("WARC-Record-ID"), url, size, digest, fields["WARC-Type"], number("WARC-Refers-To"),
            None if revisit else payload)


def _gzip(raw: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _exact(rows: list[tuple], schema: str) -> pd.DataFrame:
    """The rows as columns; whole numbers stay whole beside nulls."""
    columns = [c.split() for c in schema.split(", ")]
    values = zip(*rows, strict=True) if rows else [()] * len(columns)
    return pd.DataFrame({name: pd.array(v, "Int64") if kind == "long" else pd.Series(v, dtype=object)
                         for (name, kind), v in zip(columns, values, strict=True)})


def _write(batches, folder: str, archive_bytes: int):
    """Rows (id, url, digest, bytes, refers_to, payload) -> index rows."""
    out, name, offset = None, "", 0
    try:
        for pdf in batches:
            index = []
            for r in pdf.itertuples(index=False):
                if out is None or offset >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz", 0
                    fs, path = _fs(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                page_id = None if r.id is None else int(r.id)
                refers_to = None if r.refers_to is None else int(r.refers_to)
                data = _gzip(record_bytes(page_id, r.url, r.digest, int(r.bytes), r.payload or b"", refers_to))
                out.write(data)
                index.append((name, offset, len(data), r.url, r.digest, page_id, int(r.bytes),
                              "response" if refers_to is None else "revisit", refers_to))
                offset += len(data)
            yield _exact(index, _INDEX)
    finally:
        if out is not None:
            out.close()


def _payload(c: Column) -> Column:
    return F.coalesce(c.cast("binary"), F.lit(b""))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives below ``folder`` and return the stored index."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        _payload(F.col(payload_col)).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    narrow = stored(rows.select("id", "digest", "bytes").filter(F.col("bytes") >= REVISIT_BYTES), "warc-digests")
    # Payloads that occur more than once; rows join them on digests, without payloads.  What comes
    # out is stored, so that the join with the payloads is planned by its size.
    shared = (narrow.filter(F.col("id").isNotNull()).groupBy("digest", "bytes")
              .agg(F.max("id").alias("refers_to"), F.min("id").alias("least")).filter("least < refers_to"))
    revisits = stored(narrow.join(shared.drop("least"), ["digest", "bytes"]).filter(F.col("id") < F.col("refers_to"))
                      .select("id", "digest", "refers_to").distinct(), "warc-revisits")
    records = (rows.join(revisits, ["id", "digest"], "left")
               .select(F.col("id").cast("string"), "url", "digest", "bytes", F.col("refers_to").cast("string"),
                       F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload")))
    return stored(records.mapInPandas(lambda b: _write(b, folder, archive_bytes), _INDEX), "warc-index")


def ranges(rows: list, gap: int = GAP, most: int = MAX_READ):
    """Runs of (archive, offset, length, ...) rows, in order, that one read fetches."""
    run: list = []
    for r in rows:
        if run and (r[0] != run[0][0] or r[1] < run[-1][1] or r[1] - (run[-1][1] + run[-1][2]) > gap
                    or r[1] + r[2] - run[0][1] > most):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def _read(batches, with_payload: bool):
    opened, name = None, None
    try:
        for pdf in batches:
            out = []
            for run in ranges(list(pdf.itertuples(index=False, name=None))):
                if run[0][0] != name:
                    if opened is not None:
                        opened.close()
                    fs, path = _fs(run[0][0])
                    opened, name = fs.open_input_file(path), run[0][0]
                start = run[0][1]
                opened.seek(start)
                data = opened.read(max(r[1] + r[2] for r in run) - start)
                for r in run:
                    rec = parse_record(zlib.decompress(data[r[1] - start:r[1] - start + r[2]], 31))
                    out.append(rec if with_payload else (*rec[:6], None))
            yield _exact(out, _RECORD)
    finally:
        if opened is not None:
            opened.close()


def read_warc(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows (id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload); a revisit's payload is null, its size and digest come from its headers."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = int(max(1, -(-total // READ_BYTES)))
    rows = (index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset")
            .sortWithinPartitions("archive", "offset"))
    return rows.mapInPandas(lambda b: _read(b, with_payload), _RECORD)
