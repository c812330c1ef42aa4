"""WARC archives: a writer with one gzip member per record, and a reader that splits files.

The reader cuts every file into byte ranges.  A task looks for gzip magic in its range, accepts a
candidate only if its first bytes decode to a WARC version line, reads members from there one after
the other and owns the records that start inside its range; the last one is read past the end.
Only one record is held at a time, besides a read buffer of fixed size.

Equal payloads are written once: of those with at least ``min_bytes`` the one with the smallest id
becomes a response, the others revisits that refer to it.  Who is whom is decided on digests, so
groups of copies of any size cost one row per task.

Nulls and repeated rows: a null payload is empty; a null url leaves the header out; a null id sorts
below all others and is read back as null; equal rows become records of their own with the
same type.  A member that cannot be decoded to its end is returned as type ``damaged``.
Archives are written below the shared folder by each task under a fresh name and listed in a
manifest once complete, so files of failed attempts are never read.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotvalue.llm.arrow import NO_ID, batch_of, id_key, map_batches, shuffle_width
from slotvalue.runtime import scratch_path
from slotvalue.sources.files import open_store

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 1 << 30
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
LEVEL = 4
_URL_SAFE = "%!#$&'()*+,/:;=?@[]~"


def _record_id(key: int) -> str:
    return f"<urn:page:{'null' if key == NO_ID else key}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


_INFO = _member(
    [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, 'urn:archive').urn}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields"),
    ],
    b"format: WARC File Format 1.1\r\n",
)


def page_record(key: int, url: str | None, payload: bytes, digest: str, first: int | None, size: int) -> bytes:
    """A response, or a revisit without body if ``first`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", _record_id(key)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=_URL_SAFE)))
    if first is not None:
        headers.append(("WARC-Refers-To", _record_id(first)))
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        return _member(headers, http)
    return _member(headers, http + payload)


def _write(folder: str, file_bytes: int):
    def run(batches, schema):
        fs, base = open_store(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        done: list[tuple[str, int, int]] = []
        size = records = 0

        def close():
            out.close()
            done.append((name, size, records))

        for batch in batches:
            key, url, payload, digest, first, length = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                if out is None or size >= file_bytes:
                    if out is not None:
                        close()
                    file = f"pages-{uuid.uuid4().hex}.warc.gz"
                    name = posixpath.join(folder, file)
                    out = fs.open_output_stream(posixpath.join(base, file), compression=None)
                    records = 0
                    out.write(_INFO)
                    size = len(_INFO)
                record = page_record(key[i].as_py(), url[i].as_py(), payload[i].as_py(), digest[i].as_py(), first[i].as_py(), length[i].as_py())
                out.write(record)
                size += len(record)
                records += 1
        if out is not None:
            close()
        yield batch_of({n: [d[i] for d in done] for i, n in enumerate(schema.names)}, schema)

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 100,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes the archives below ``folder`` and returns their manifest ``(path, bytes, records)``.

    The folder must be one that tasks can reach (``sources.files``); another is refused before anything runs.
    """
    open_store(folder)
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(
        id_key(page_id).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"),
    )
    narrow = rows.where(F.col("size") >= min_bytes).select("key", "digest").distinct()
    firsts = narrow.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = narrow.join(firsts.select("digest", "first"), "digest").where("key <> first")
    # Bodies travel by (id, digest): the narrow join on the digest alone may be skewed, this one is not.
    placed = rows.join(revisits, ["key", "digest"], "left").select("key", "url", "payload", "digest", "first", "size")
    body = F.when(F.col("first").isNull(), F.col("payload")).alias("payload")
    placed = placed.select("key", "url", body, "digest", "first", "size")
    manifest = map_batches(placed, _write(folder, file_bytes), "path string, bytes bigint, records bigint")
    manifest.write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.parquet(f"{folder}/_manifest")


class _Bytes:
    """Forward reads from an open file with a small buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, start: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``start``."""
        if not self.at <= start <= start + length <= self.at + len(self.data):
            self.file.seek(start)
            self.data = self.file.read(min(max(length, READ_BYTES), self.size - start)) if start < self.size else b""
            self.at = start
        return self.data[start - self.at : start - self.at + length]


def _starts_record(source: _Bytes, at: int) -> bool:
    """Whether a gzip member at ``at`` decodes to a WARC version line."""
    try:
        return zlib.decompressobj(31).decompress(source.get(at, 4096), 16).startswith(b"WARC/")
    except zlib.error:
        return False


def _next_start(source: _Bytes, at: int, end: int) -> int | None:
    """First record that starts in ``[at, end)``."""
    while at < end:
        block = source.get(at, READ_BYTES)
        found = block.find(MAGIC)
        if found < 0:
            if len(block) < READ_BYTES:
                return None
            at += len(block) - len(MAGIC) + 1
            continue
        at += found
        if at < end and _starts_record(source, at):
            return at
        at += 1
    return None


def _decode(source: _Bytes, at: int) -> tuple[bytes | None, int]:
    """The record at ``at`` and where the next member begins; None if it is damaged."""
    unpacker, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            block = source.get(pos, READ_BYTES // 4)
            if not block:
                return None, at + 1
            parts.append(unpacker.decompress(block))
            pos += len(block)
    except zlib.error:
        return None, at + 1
    return b"".join(parts), pos - len(unpacker.unused_data)


def parse_record(record: bytes) -> dict:
    """Headers and payload of a record; an HTTP block is split into its headers and body."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length") or 0)]
    out = {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
        "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "digest": (fields.get("warc-payload-digest") or "").partition(":")[2] or None,
        "http_bytes": None, "payload": block,
    }
    if fields.get("content-type", "").startswith("application/http"):
        http, _, out["payload"] = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                out["http_bytes"] = int(value)
    return out


def read_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """Offset and content of the records that start in ``[start, end)``."""
    source, at = _Bytes(file, size), start
    while (at := _next_start(source, at, end)) is not None:
        record, following = _decode(source, at)
        if record is None:
            yield at, {"record_type": "damaged"}
        else:
            yield at, parse_record(record)
        at = following


def _read(batches, schema):
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = open_store(row["path"])
            rows, held = [], 0
            with fs.open_input_file(path) as file:
                for offset, record in read_range(file, file.size(), row["start"], row["end"]):
                    rows.append({"path": row["path"], "offset": offset, **record})
                    held += len(record.get("payload") or b"")
                    if held >= 8 << 20:
                        yield batch_of({n: [r.get(n) for r in rows] for n in schema.names}, schema)
                        rows, held = [], 0
            yield batch_of({n: [r.get(n) for r in rows] for n in schema.names}, schema)


RECORD = (
    "path string, offset bigint, record_type string, record_id string, url string, refers_to string, "
    "digest string, http_bytes bigint, payload binary"
)


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the files ``(path, bytes)``, whatever member structure they were cut at."""
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint")))
    ranges = files.select("path", start.alias("start"), "bytes")
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    return map_batches(ranges.repartition(shuffle_width(files), "path", "start"), _read, RECORD)


def archive_listing(pages: DataFrame, folder: str | None = None, **rule) -> DataFrame:
    """Writes ``pages``, reads the archives back and lists their records; a damaged record is an error, not a missing page."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    records = read_archives(spark, write_archives(pages, folder, **rule))
    damaged = F.raise_error(F.concat(F.lit("damaged record at "), F.col("offset").cast("string"), F.lit(" of "), F.col("path"))).cast("boolean")
    pages_only = F.when(F.col("record_type") == "damaged", damaged).otherwise(F.col("record_type").isin("response", "revisit"))
    records = records.where(pages_only)
    own = F.col("record_type") == "response"
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    return records.select(
        page("record_id").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("bigint")).otherwise(F.col("http_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
