"""WARC archives: one gzip member per record, written per task and read back sequentially.

Payloads of ``least`` bytes or more that are equal are stored once, with the record of the largest
id; the others are revisit records. Each task writes its rows to files of a bounded size in a
folder that all executors share, under names no other attempt uses, and only the names that a
committed task reports are read, so lost or repeated tasks leave no trace in the result.

The reader never holds an archive: it inflates 64 KB at a time, frames records by Content-Length
and checks block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from engram.session import checkpoint

FILE_BYTES = 64 << 20
CHUNK = 64 << 10
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC record as one gzip member; a revisit when it refers to another page."""
    head = _HTTP % len(payload)
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        *([] if refers_to is None else [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]),
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        out, path, size, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page, url, html, mark, to in zip(*batch.columns):
                if out is not None and size >= FILE_BYTES:
                    yield close()
                    out = None
                if out is None:
                    path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                body = record(page.as_py(), url.as_py(), html.as_py() or b"", mark.as_py(), to.as_py())
                out.write(body)
                size, n = size + len(body), n + 1
        if out is not None:
            yield close()

    return run


def _base32(hexed: str):
    """Upper-case base32 of a 40-digit hex column."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")  # fixed values of RFC 4648
    out = []
    for group in range(4):  # ten hex digits are forty bits are eight characters
        bits = F.conv(F.substring(hexed, 10 * group + 1, 10), 16, 10).cast("long")
        out += [F.substr(alphabet, (F.shiftright(bits, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*out)


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0
) -> DataFrame:
    """Writes every row of ``pages`` as a record; returns the files: ``path, records, bytes``.

    A null payload is empty; a null url leaves its header out; a null id is kept as none and never
    referred to while an equal payload has one. Rows repeating the kept id are all responses.
    An empty table writes nothing.
    """
    body = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), body.alias("html"),
        F.sha1(body).alias("hexed"))
    keep = (
        pages.select(F.col(page_id).cast("long").alias("page"), F.sha1(body).alias("key"), F.length(body).alias("size"))
        .where(F.col("size") >= least).groupBy("key").agg(F.max("page").alias("kept")).where("kept IS NOT NULL")
    )
    refers = F.when(F.col("page").isNull() | (F.col("page") != F.col("kept")), F.col("kept"))
    dealt = rows.join(keep, F.col("hexed") == F.col("key"), "left").select(
        "page", "url", "html", _base32("hexed").alias("mark"), refers.alias("to"))
    return checkpoint(dealt.mapInArrow(_write(folder), "path string, records bigint, bytes bigint"))


class Bad(ValueError):
    """A malformed archive."""


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, read and inflated a chunk at a time."""
    inflate, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        chunk = rest or stream.read(CHUNK)
        if not chunk:
            break
        try:
            parts.append(inflate.decompress(chunk))
        except zlib.error as error:
            raise Bad(str(error)) from error
        rest = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []
    if any(parts):
        raise Bad("truncated member")


def parse_record(member: bytes) -> dict:
    """Headers, block and payload of one record, with framing and digests checked."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise Bad("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(headers.get("content-length", -1))
    block = rest[:length]
    if length < 0 or len(block) != length or rest[length:] != b"\r\n\r\n":
        raise Bad("wrong Content-Length")
    marks = {k: headers[k].removeprefix("sha1:") for k in ("warc-block-digest", "warc-payload-digest") if k in headers}
    if marks.get("warc-block-digest", digest(block)) != digest(block):
        raise Bad("wrong block digest")
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    kind = headers.get("warc-type", "")
    if kind == "response" and marks.get("warc-payload-digest", digest(payload)) != digest(payload):
        raise Bad("wrong payload digest")
    own = lambda name: headers.get(name, "").strip("<>").removeprefix(_ID)
    return {
        "page": int(own("warc-record-id")) if own("warc-record-id").lstrip("-").isdigit() else None,
        "url": headers.get("warc-target-uri"), "kind": kind, "mark": marks.get("warc-payload-digest", digest(payload)),
        "to": int(own("warc-refers-to")) if own("warc-refers-to").lstrip("-").isdigit() else None,
        "size": len(payload) if kind != "revisit" else None, "payload": payload if kind != "revisit" else None,
    }


RECORDS = "page bigint, url string, kind string, mark string, refers bigint, size bigint, payload binary, error string"


def _read(folder: str, payloads: bool):
    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([r["page"] for r in rows], pa.int64()), pa.array([r["url"] for r in rows], pa.string()),
            pa.array([r["kind"] for r in rows], pa.string()), pa.array([r["mark"] for r in rows], pa.string()),
            pa.array([r["to"] for r in rows], pa.int64()), pa.array([r["size"] for r in rows], pa.int64()),
            pa.array([r["payload"] if payloads else None for r in rows], pa.binary()), pa.array([r.get("error") for r in rows], pa.string()),
        ], names=["page", "url", "kind", "mark", "refers", "size", "payload", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        rows, held = [], 0
        none = dict.fromkeys(("page", "url", "kind", "mark", "to", "size", "payload"))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    try:
                        for member in members(stream):
                            rows.append(parse_record(member))
                            held += len(member)
                            if len(rows) >= 2000 or held > 8 << 20:
                                yield batch_of(rows)
                                rows, held = [], 0
                    except Bad as error:  # what follows in the file can't be framed
                        rows.append({**none, "error": f"{path}: {error}"})
        if rows:
            yield batch_of(rows)

    return run


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in column ``path``, one task per group of files.

    ``page, url, kind, mark`` (payload digest), ``refers, size, payload, error``. A malformed or
    truncated archive gives the records before the fault and one row with the error.
    """
    return files.select("path").repartition(max(1, files.count()), "path").mapInArrow(_read(folder, payloads), RECORDS)


def archive_folder(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder, as a URI."""
    checkpoint(spark.range(1))  # names the folder where the session has set none
    base = spark.sparkContext.getCheckpointDir() or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = f"{base}/warc-{uuid.uuid4().hex}"
    store, path = pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    store.create_dir(path, recursive=True)
    return folder if ":" in folder else f"file://{folder}"


def archived_pages(pages: DataFrame, folder: str | None = None, least: int = 0, **names) -> DataFrame:
    """Writes ``pages`` and reads them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, error``.

    A revisit's size is that of the response with its digest.
    """
    page_id = names.get("page_id", "page_id")
    folder = folder or archive_folder(pages.sparkSession)
    found = checkpoint(read_archives(write_archives(pages, folder, least=least, **names), folder, payloads=False).drop("payload"))
    sizes = found.where("kind = 'response'").groupBy(F.col("mark").alias("m")).agg(F.max("size").alias("full"))
    return found.join(sizes, F.col("mark") == F.col("m"), "left").select(
        F.col("page").alias(page_id), F.coalesce("size", "full").alias("payload_bytes"), F.col("mark").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"), "error")
