"""WARC archives, index first: every record's file, offset, length, URL and digest are written down, and readers fetch the
records they select by sorted, coalesced byte ranges.

``write`` makes gzip archives (a member for each record) in a folder that all executors share, and returns the index as a
table. Records with equal payloads of at least ``MIN_REVISIT`` bytes are written once: the one with the largest id is a
response, the others are revisits of it without a payload. Which payloads occur again is held as a sieve of fixed size, so
pages are not shuffled to find out. ``read`` takes any selection of index rows, deals it out by (file, offset) and reads
neighbouring records together, at most ``RANGE_BYTES`` at a time.

Every file begins with a ``warcinfo`` record. Record ids come from row ids, so no two records share one. Reading is dealt out
by bytes, ``READ_TASK_BYTES`` to a task, so a task reads as much of a large archive as of a small one.

A task writes files of its own with a name of its own and the index is committed by Spark, so a task that is run again
leaves at most a file that no index row names.

Defined cases: a null payload counts as empty; a null id is smaller than any other and written as none; of equal payloads
with equal largest ids the last in the order of files and rows is the response; repeated rows are records of their own; a null URL is empty;
an empty table gives an empty index; other columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, drop_rows, hot_join, materialise, probe, reserve, scratch_path, ship, sieve, with_row_id

MIN_REVISIT = 1000
FILE_BYTES = 1 << 30
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
READ_TASK_BYTES = 64 << 20
LEVEL = 1
DATE = "2020-01-01T00:00:00Z"  # fixed, so equal input gives equal archives

_RID = OWN + "rid"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, payload_bytes long, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def filesystem(uri: str):
    """A file system and a path on it, for a folder that may be in any store."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def _urn(row: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'tessella:{row}')}>"


def info(name: str) -> bytes:
    """The record that a file begins with."""
    body = b"software: tessella\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_urn(name)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, digest: str, payload: bytes | None, payload_bytes: int, refers_to: int | None, row: int = 0, refers_to_row: int | None = None) -> bytes:
    """One uncompressed record; without a payload a revisit. ``row`` and ``refers_to_row`` tell records apart."""
    revisit = payload is None
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(row)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {payload_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to_row is not None:
            head.append(f"WARC-Refers-To: {_urn(refers_to_row)}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) not in "<>\"")


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; the payload's digest is computed and compared."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    payload = body.partition(b"\r\n\r\n")[2] if kind == "response" else None
    size = int(fields["X-Payload-Length"])
    if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"record {fields['WARC-Record-ID']}: its payload does not have the digest or length of its header")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload}


def _member(raw: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def _writer(folder: str, level: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    page_id, url, digest, size, refers_to, payload, row, refers_to_row = (batch.column(k)[i].as_py() for k in range(8))
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                        out.write(first := _member(info(name), level))
                        at = len(first)
                    packed = _member(record(page_id, url, digest, payload, size, refers_to, row, refers_to_row), level)
                    out.write(packed)
                    rows.append((name, at, len(packed), url, digest, page_id, "revisit" if payload is None else "response", size, refers_to))
                    at += len(packed)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _schema(INDEX).types)], schema=_schema(INDEX))
        finally:
            if out is not None:
                out.close()

    return run


def write(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", level: int = LEVEL, file_bytes: int = FILE_BYTES, sieve_bits: int | None = None) -> tuple[str, DataFrame]:
    """Write the archives; the folder and the index."""
    spark = df.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "warc")
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    rows = with_row_id(reserve(df).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html")))
    rows = rows.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary")).drop("html")
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    key = F.xxhash64("digest")
    again = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").count().where("count > 1").select(key.alias("k"))
    seen = probe(rows, key, sieve(again, "k", "payloads", sieve_bits), OWN + "hit")
    several = materialise(seen.where(F.col(OWN + "hit") & (F.col("size") >= MIN_REVISIT)).select(_RID, "page_id", "url", "digest", "size"), "copies")
    best = several.groupBy("digest").agg(F.max(F.struct("page_id", _RID)).alias("best"), F.count(F.lit(1)).alias("n"))
    later = hot_join(several, materialise(best, "payload-heads"), "digest", "n").where(F.col(_RID) != F.col("best")[_RID])
    revisits = materialise(later.select(_RID, "page_id", "url", "digest", "size", F.col("best.page_id").alias("refers_to"), F.col("best")[_RID].alias("refers_to_row")), "revisits")
    responses = drop_rows(rows, _RID, revisits, "revisits-sieve").withColumns({"refers_to": F.lit(None).cast("long"), "refers_to_row": F.lit(None).cast("long")})
    order = ["page_id", "url", "digest", "size", "refers_to", "payload", _RID, "refers_to_row"]
    run = _writer(folder, level, file_bytes)
    both = responses.select(*order).mapInArrow(run, INDEX).unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")).select(*order).mapInArrow(run, INDEX))
    return folder, materialise(both, "warc-index")


def ranges(rows: list[tuple[str, int, int]], range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> Iterator[tuple[str, int, int, list[int]]]:
    """Sorted (file, offset, length) as few reads: file, begin, end and the numbers of the rows in it."""
    name, begin, end, held = None, 0, 0, []
    for k, (file, offset, length) in enumerate(rows):
        if held and (file != name or offset - end > gap_bytes or offset + length - begin > range_bytes):
            yield name, begin, end, held
            held = []
        if not held:
            name, begin, end = file, offset, offset
        held.append(k)
        end = max(end, offset + length)
    if held:
        yield name, begin, end, held


def read(folder: str, selected: DataFrame, payloads: bool = False) -> DataFrame:
    """The selected records, by byte ranges; ``selected`` holds rows of the index."""
    ship(selected.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        name, source = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for file, begin, end, held in ranges([r[:3] for r in rows]):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{base}/{file}")
                block = source.read_at(end - begin, begin)
                out = []
                for k in held:
                    at = rows[k][1] - begin
                    out.append(parse(zlib.decompress(block[at : at + rows[k][2]], 31)) | {"url": rows[k][3]})
                    if not payloads:
                        out[-1]["payload"] = None
                yield pa.RecordBatch.from_pylist(out, _schema(RECORD))
        if source is not None:
            source.close()

    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-size // READ_TASK_BYTES))
    dealt = selected.select("file", "offset", "length", "url").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORD)


def archived(df: DataFrame, **columns: str) -> DataFrame:
    """Write, then read everything back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder, index = write(df, **columns)
    return read(folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
