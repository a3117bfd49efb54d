"""WARC archives: writing with revisit records, and a splittable reader.

*Writing.* Every page becomes one gzip member (a WARC/1.1 record). Of records with equal
payloads of at least ``REVISIT_BYTES`` the one with the largest page id is the response and
the others are revisits that refer to it. Digests are compared by an aggregation, so a
payload that a third of all pages share is one row when it is counted. A task writes one
archive under a name of its own and reports it; the report, committed by Spark, is the list
of archives, so what a lost or repeated attempt leaves behind is never read.

*Reading.* Archives are cut into byte ranges, one task each. A task scans its range for the
gzip magic, validates a candidate by decoding the member's header and the WARC version line
behind it, and owns the records that start in its range, reading past its end to finish the
last one. From a valid record on it follows the members, so what looks like a record inside a
payload isn't one: after a member has ended the next must begin. No index is needed.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, shared_folder
from gleaner.sources.tables import read_table

#: Smaller payloads are always written in full.
REVISIT_BYTES = 1000
#: Bytes of an archive that a task scans.
SPLIT_BYTES = 16 << 20
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_CHUNK = 1 << 16

MANIFEST = "path string, bytes long, records long"
RECORDS = (
    "path string, offset long, warc_type string, target_uri string, page_id long, payload binary, payload_bytes long, "
    "payload_digest string, refers_to long, headers map<string,string>"
)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): every page with what its record says.

    ``refers_to`` is null for responses. A null html is an empty payload. Pages repeated with
    the largest id of their payload are all responses; pages without an id refer to the largest
    id if there is one and are responses otherwise.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    counted = rows.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    shared = counted.where("n > 1 and largest is not null").select(F.col("digest").alias("same"), "largest")
    joined = rows.join(shared, (F.col("digest") == F.col("same")) & (F.col("size") >= revisit_bytes), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return joined.select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to"))


def _line(value: str) -> str:
    """A header value in one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One gzip member. The payload digest and length always describe the full payload."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write the records of :func:`plan` below ``folder``; returns the committed list of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(6))):
                out = out or system.open_output_stream(name, compression=None)
                data = record(*row)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    columns = planned.select("page_id", "url", "payload", "digest", "size", "refers_to")
    return materialize(columns.mapInArrow(run, MANIFEST), "archives")


class _Source:
    """Bytes of a file from an offset on, with a buffer that grows at its end."""

    def __init__(self, handle, at: int):
        self.handle, self.base, self.data = handle, at, b""
        handle.seek(at)

    def more(self) -> bool:
        chunk = self.handle.read(_CHUNK)
        self.data += chunk
        return bool(chunk)

    def skip(self, n: int) -> None:
        self.data, self.base = self.data[n:], self.base + n


def _valid(source: _Source, at: int) -> bool:
    """Does a gzip member that begins at ``at`` of the buffer decode to a WARC version line?"""
    while len(source.data) - at < 4096 and source.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(source.data[at : at + 4096], 64).startswith(_VERSION)
    except zlib.error:
        return False


def _member(source: _Source) -> bytes | None:
    """Content of the member at the front of the buffer, which moves past it; None if it is broken."""
    unpack, parts = zlib.decompressobj(31), []
    try:
        while True:
            if not source.data and not source.more():
                return None
            parts.append(unpack.decompress(source.data))
            used = len(source.data) - len(unpack.unused_data)
            source.skip(used)
            if unpack.eof:
                return b"".join(parts)
    except zlib.error:
        return None


def split_records(handle, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end) of an archive."""
    source = _Source(handle, start)
    following = False
    while True:
        if following and source.base >= end:
            return
        if following and (len(source.data) >= 3 or (source.more() or source.data)):
            if source.data[:3] == _MAGIC and _valid(source, 0):
                at = 0
            else:
                following = False
                continue
        else:
            at = source.data.find(_MAGIC)
            while at < 0:
                source.skip(max(0, len(source.data) - 2))
                if source.base >= end or not source.more():
                    return
                at = source.data.find(_MAGIC)
            if source.base + at >= end:
                return
            if not _valid(source, at):
                source.skip(at + 1)
                continue
        source.skip(at)
        offset, held = source.base, source.data
        content = _member(source)
        if content is None:  # damaged: go on one byte behind its start
            source.data, source.base = held[1:], offset + 1
            handle.seek(offset + len(held))
            following = False
            continue
        yield offset, content
        following = True


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    return headers, rest[: int(length)] if length.isdigit() else rest


def _number(value: str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


def read(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """All records of the archives in (path, bytes): a row each, with headers and payload.

    Digest and length are those of the payload itself; of a revisit, whose block is empty, what
    its headers say. Damaged members are passed over. An empty list gives no rows.
    """
    splits = archives.where(F.col("bytes") > 0).select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system, local = _open(path)
                rows, held = [], 0
                with system.open_input_file(local) as handle:
                    for offset, content in split_records(handle, start, end):
                        headers, payload = parse(content)
                        kind = headers.get("warc-type")
                        if kind == "revisit":
                            size, digest = _number(headers.get("x-payload-length")), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        else:
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        rows.append((
                            path, offset, kind, headers.get("warc-target-uri"), _number(headers.get("x-page-id")), payload if with_payload else None,
                            size, digest, _number(headers.get("x-refers-to-page-id")), list(headers.items()),
                        ))
                        held += len(payload)
                        if held >= 8 << 20 or len(rows) >= 2000:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    # Every split is a task: it is all its work that the row stands for.
    n = splits.count()
    return splits.repartition(max(1, n), "path", "start").mapInArrow(run, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    records = read(spark, write(planned, shared_folder(spark, "warc")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", "target_uri")


ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS n, sha1(html) AS digest FROM p),
g AS (SELECT digest, max(page_id) AS largest FROM d WHERE n >= {REVISIT_BYTES} GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> largest THEN largest END AS refers_to, url AS target_uri
FROM d LEFT JOIN g ON d.digest = g.digest
"""
