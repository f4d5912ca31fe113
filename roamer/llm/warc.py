"""Op 7: WARC archives and transaction assembly.

Writing: every page becomes one capture of three records: a request, a response (or a revisit, where
another page with an equal payload and a larger id is the response) and a metadata record. Archives
are .warc.gz files of a bounded size with one gzip member a record, as the format asks.

Reading: archives are parsed record by record, and transactions are put together by joins on the
WARC-Concurrent-To identifiers: the response and the metadata record name their request. Each capture
comes out as one nested row (request, response, metadata). A revisit finds its response by a join on
WARC-Refers-To. Payloads are hashed where they are read; only record headers are shuffled.

Defined results: null html is an empty payload; a null url has no target; urls are percent-encoded
where they hold white space, controls or other characters that a header line can't; a null page_id is less than
any other; repeated rows with the largest id are all responses; an empty table writes no archive and gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import cut, open_store, register, shared_folder, small_arrow_batches, small_batches, table, utf8_views, write_whole

ARCHIVE_BYTES = 64 << 20
DATE = "2026-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(*parts) -> str:
    return f"<{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, parts)).encode()).digest()).urn}>"


def _response_id(page, digest: str) -> str:
    """Any page with this payload can name the response's record."""
    return _urn("response", page, digest)


def _record(kind: str, ident: str, date: str, fields: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", compresslevel=level, mtime=0)


def _capture(page, url: str | None, payload: bytes, target, seat: str, date: str, level: int) -> list[bytes]:
    """The three records of one page. ``seat`` is unique to the row."""
    digest = base32_sha1(payload)
    safe = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")
    request = _urn("request", page, digest, seat)
    revisit = page != target
    ident = _urn("revisit", page, digest, seat) if revisit else _response_id(page, digest)
    try:
        parts = urlsplit(safe or "")
    except ValueError:
        parts = urlsplit("")
    get = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    to = [("WARC-Target-URI", safe), ("WARC-Concurrent-To", request)]
    http = [*to, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        http += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _response_id(target, digest))]
    return [_record("request", request, date, [("WARC-Target-URI", safe), ("Content-Type", "application/http; msgtype=request")], get, level),
            _record("revisit" if revisit else "response", ident, date, http, head if revisit else head + payload, level),
            _record("metadata", _urn("metadata", page, digest, seat), date, [*to, ("Content-Type", "application/warc-fields")],
                    f"page-id: {'' if page is None else page}\r\n".encode(), level)]


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE, level: int = 3) -> DataFrame:
    """Write the archives; the materialised list of their uris.

    Names hold the task attempt, so an attempt that is repeated elsewhere never mixes with the first.
    """
    rows = small_arrow_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    # Counted before the payloads move: a payload that many pages share is one row a task. Materialised,
    # so that Spark can split the pages of a payload that very many share.
    target = cut(rows.groupBy("sha").agg(F.max("page_id").alias("target")))
    placed = rows.join(target, "sha").select("page_id", "url", "html", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        part, attempt, number, seat, held, size, captures = ctx.partitionId(), ctx.taskAttemptId(), 0, 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            uri = f"{folder}/part-{part:06d}-{attempt}-{number:05d}.warc.gz"
            info = _record("warcinfo", _urn("info", uri), date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
            write_whole(uri, [info, *held])
            return pa.record_batch([pa.array([uri]), pa.array([captures], pa.int64())], names=["uri", "captures"])

        for big in batches:
            for batch in small_batches(big, "html"):
                data, off, _ = utf8_views(batch.column("html"))
                for i, (page, url, to) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "target")))):
                    got = _capture(page, url, bytes(data[off[i]:off[i + 1]]), to, f"{part}.{attempt}.{seat}", date, level)
                    seat, captures, size = seat + 1, captures + 1, size + sum(map(len, got))
                    held += got
                    if size >= archive_bytes:
                        yield flush()
                        held, size, captures, number = [], 0, 0, number + 1
        if held:
            yield flush()

    return cut(placed.mapInArrow(run, "uri string, captures long"))


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one after the other; memory holds one at a time."""
    left, done, out = b"", False, []
    unzip = zlib.decompressobj(31)
    while True:
        if not left and not done:
            left = stream.read(1 << 20)
            done = not left
        if not left:
            return
        out.append(unzip.decompress(left))
        left = unzip.unused_data
        if unzip.eof:
            yield b"".join(out)
            unzip, out = zlib.decompressobj(31), []
        elif done:
            raise ValueError("an archive ends within a record")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[:int(fields["content-length"])]


_READ = [("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()),
         ("date", pa.string()), ("http_line", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("page_id", pa.int64())]
_READ_DDL = "kind string, record_id string, concurrent_to string, refers_to string, uri string, date string, http_line string, " \
            "payload_bytes long, payload_digest string, page_id long"


def read_records(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row a record: headers, HTTP line, size and digest of the payload (of a response: as read),
    and with ``payloads`` the payload."""
    fields = _READ + ([("payload", pa.binary())] if payloads else [])

    def row(raw: bytes) -> tuple:
        h, block = parse_record(raw)
        kind, size, digest, page, line, payload = h["warc-type"], None, None, None, None, None
        if kind in ("response", "revisit", "request"):
            head, _, body = block.partition(b"\r\n\r\n")
            line, *more = head.decode().split("\r\n")
            if kind == "response":
                size, digest, payload = len(body), base32_sha1(body), body
                if h.get("warc-payload-digest") != f"sha1:{digest}":
                    raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
            elif kind == "revisit":
                size = next(int(x.partition(":")[2]) for x in more if x.lower().startswith("content-length:"))
                digest = h["warc-payload-digest"].partition(":")[2]
        elif kind == "metadata":
            value = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x).get("page-id")
            page = int(value) if value else None
        got = (kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), line, size, digest, page)
        return got + (payload,) if payloads else got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(fields)
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                store, path = open_store(uri)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for raw in _members(stream):
                        rows.append(row(raw))
                        held += len(raw) if payloads else 0
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    # A task an archive, whatever the size of the list.
    files = archives.select("uri").repartition(max(1, archives.count()), "uri")
    return files.mapInArrow(run, _READ_DDL + (", payload binary" if payloads else ""))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: request, response, metadata, joined by concurrent-to identifiers."""
    part = lambda kinds, name: records.filter(F.col("kind").isin(*kinds)).select(F.col("record_id" if name == "request" else "concurrent_to").alias("transaction"), F.struct(*records.columns).alias(name))
    return (part(["request"], "request").join(part(["response", "revisit"], "response"), "transaction", "left")
            .join(part(["metadata"], "metadata"), "transaction", "left").drop("transaction"))


def captures(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, and the nested records."""
    # Read once: the joins take their sides from the materialised headers, whose size Spark knows.
    nested = cut(assemble(cut(read_records(archives))))
    flat = nested.select(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
                         F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("to"), "request", "response", "metadata")
    # Repeated rows have equal responses: one a record id is enough to be found.
    responses = flat.filter("record_type = 'response'").groupBy(F.col("response.record_id").alias("to")).agg(F.max("page_id").alias("refers_to"))
    return flat.join(responses, "to", "left").drop("to")


@register("op7_warc_transactions")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    out = captures(archives)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("request.record_id").alias("request_id"),
                      F.col("response.record_id").alias("response_id"), F.col("metadata.record_id").alias("metadata_id"), F.col("request.uri").alias("target_uri"))
