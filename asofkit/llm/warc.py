"""WARC archives: write captures of pages, read the records back, and assemble one nested row per capture.

A capture is a request, a response (or revisit) and a metadata record; request and metadata name the response through
WARC-Concurrent-To. Archives are gzip files with one member per record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, file_system, materialise, shared_dir, small_batches

#: Copies of a payload are looked up under so many salts, so that a very common payload spreads over tasks.
SALTS = 32
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None, row: int, kind: str) -> str:
    return f"<urn:capture:{'' if page is None else page}:{row}:{kind}>"


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))] if v is not None)
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + coder.flush()


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write one capture per row and return a manifest (file, records, bytes) of one row per archive.

    Of captures with equal payloads of at least min_bytes bytes the one of the largest key is written as response, the
    others as revisits of it; among repeated rows of that key one is the response. A null payload is empty, a null key
    or url stays out of the headers; other columns, whatever their names, play no part; an empty table gives no archive.

    Rows are numbered and written once. Payloads are compared by digest and never shuffled: a task gets the name of a
    file of rows and which of its rows are revisits of what, and makes one archive of it.
    """
    small_batches(pages.sparkSession)
    rows = columns(pages, page=key, url=url, payload=payload).select(
        F.col("page").cast("long").alias("page"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("payload").cast("string"), F.lit("")).cast("binary").alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    )
    held = materialise(rows.withColumn("digest", F.sha1("payload")), "pages")
    narrow = held.select("page", "row", "digest", F.octet_length("payload").alias("size"), F.col("_metadata.file_path").alias("file"), (F.col("row") % SALTS).cast("int").alias("salt"))
    narrow = materialise(narrow, "digests")
    copied = (
        narrow.where(F.col("size") >= min_bytes)
        .groupBy(F.col("digest").alias("d"))
        .agg(F.max(F.struct("page", "row")).alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .select("d", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    )
    again = narrow.join(copied, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s"))).where(F.col("row") != F.col("original.row"))
    revisits = again.groupBy("file").agg(F.collect_list(F.struct("row", F.col("original.page").alias("of_page"), F.col("original.row").alias("of_row"))).alias("revisits"))
    files = narrow.select("file").distinct().join(revisits, "file", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield write_one(file, {r["row"]: (r["of_page"], r["of_row"]) for r in again or []})

    def write_one(file: str, again: dict[int, tuple[int | None, int]]) -> pa.RecordBatch:
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        name = file.rsplit("/", 1)[1].removesuffix(".zstd.parquet").removesuffix(".parquet") + ".warc.gz"
        temporary, records, written = f"{root}/{name}.{TaskContext.get().taskAttemptId()}.tmp", 0, 0
        from_fs, place = file_system(file)
        with fs.open_output_stream(temporary, compression=None) as sink, from_fs.open_input_file(place) as source:
            sink.write(_record("warcinfo", [("WARC-Record-ID", f"<urn:capture:file:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for batch in pq.ParquetFile(source).iter_batches(64, columns=["page", "url", "payload", "row", "digest"]):
                for page, link, body, row, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    revisit = row in again
                    main, digest = record_id(page, row, "response"), base64.b32encode(bytes.fromhex(sha)).decode()
                    target = None if link is None else quote(link, safe="%:/?#[]@!$&'()*+,;=~-._")
                    common = [("WARC-Date", date), ("WARC-Target-URI", target)]
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    said = [("WARC-Record-ID", main), *common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
                    if revisit:
                        said += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(*again[row], "response"))]
                    also = [*common, ("WARC-Concurrent-To", main)]
                    fields = f"payloadLength: {len(body)}\r\n" + ("" if page is None else f"pageId: {page}\r\n")
                    for r in (
                        _record("request", [("WARC-Record-ID", record_id(page, row, "request")), *also, ("Content-Type", "application/http;msgtype=request")], f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode()),
                        _record("revisit" if revisit else "response", said, http if revisit else http + body),
                        _record("metadata", [("WARC-Record-ID", record_id(page, row, "metadata")), *also, ("Content-Type", "application/warc-fields")], fields.encode()),
                    ):
                        sink.write(r)
                        records, written = records + 1, written + len(r)
        fs.move(temporary, f"{root}/{name}")
        return pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [written]})

    manifest = files.repartition("file").mapInArrow(write, "file string, records long, bytes long")
    done = materialise(manifest, "manifest")
    discard(held, narrow)
    return done


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an opened, decompressed archive.

    What follows a record that cannot be framed is not read: one without a Content-Length that is a number, one cut off
    within its headers or its block, or an archive whose compression breaks off. The records before it are given.
    """
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            headers = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            length = headers.get("content-length", "")
            if not line or not (length.isascii() and length.isdigit()):
                return
            block = stream.read(int(length))
            if len(block) < int(length):
                return
            yield headers, block
    except (EOFError, gzip.BadGzipFile, zlib.error):
        return


_RECORD = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("header_digest", pa.string()), ("http_header", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def read_records(files: DataFrame, path: str, types: tuple[str, ...], with_payload: bool = True) -> DataFrame:
    """Records of the given types from the archives named in files (file string), each archive read once.

    Headers that a record lacks are null, empty payloads are empty, payloads are held whole however long, repeated
    records are rows of their own, a broken archive gives the records before the break, and no files give no rows.
    """
    small_batches(files.sparkSession)

    def rows(name: str) -> Iterator[dict]:
        fs, root = file_system(path)
        with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for h, block in parse_records(stream):
                if h.get("warc-type") not in types:
                    continue
                is_http = h.get("content-type", "").startswith("application/http")
                head, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
                full = h["warc-type"] == "response"
                text = "" if is_http else block.decode("utf-8", "replace")
                fields = [tuple(x.strip() for x in line.split(":", 1)) for line in text.splitlines() if ":" in line] if h.get("content-type") == "application/warc-fields" else []
                yield {"record_type": h["warc-type"], "record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "header_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "http_header": head.decode("utf-8", "replace"), "payload_bytes": len(payload) if full else None, "payload_digest": payload_digest(payload) if full else None, "fields": fields, "payload": payload if with_payload and full else None}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                some, held = [], 0
                for r in rows(name):
                    some.append(r)
                    held += len(r["payload"] or b"") + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(some, _RECORD)
                        some, held = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, _RECORD)

    schema = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, header_digest string, http_header string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
    return files.mapInArrow(read, schema)


def assemble_captures(files: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit: capture_id and the nested records response, request and metadata (null if the
    archives lack them), joined through concurrent-to identifiers.

    All kinds come from one reading of the archives, and one shuffle brings a capture's records together. A request or
    metadata record that names no response of the archives, or none at all, gives no row. Of several records of a kind
    in one capture, the one of the smallest record id stays; responses of one id are one capture. No files give no rows.
    """
    records = read_records(files, path, ("response", "revisit", "request", "metadata"), with_payload)
    main = F.col("record_type").isin("response", "revisit")
    own = records.withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))).where("capture_id is not null")
    pick = lambda name, kinds, *fields: F.expr(f"min_by(struct({', '.join(fields)}), coalesce(record_id, '')) FILTER (WHERE record_type IN ({kinds}))").alias(name)
    return (
        own.groupBy("capture_id")
        .agg(
            pick("response", "'response', 'revisit'", "record_type", "refers_to", "target_uri", "date", "header_digest", "http_header", "payload_bytes", "payload_digest", "payload"),
            pick("request", "'request'", "record_id", "http_header"),
            pick("metadata", "'metadata'", "record_id", "fields"),
        )
        .where("response is not null")
    )


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0, with_payload: bool = True) -> DataFrame:
    """Write the archives of pages to a shared folder and assemble the captures that they hold, one row per page.

    Nulls, repeated rows, other columns and empty tables as in write_archives.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    names = sorted(r.file for r in write_archives(pages, path, min_bytes).collect())  # one row per archive
    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)))
    return assemble_captures(files, path, with_payload)
