"""WARC archives: writing, normalising and reading.

``write_archives`` makes archives of the kind that is found in the wild: a
whole file is one gzip stream, so no record can be reached without inflating
all before it. ``normalise`` inflates such a stream once, writes every record
as a gzip member of its own and a sidecar table of offsets beside it. With
that table ``read_records`` reads any record alone, from many tasks.

Everything streams: a task holds one buffer of a record, never a file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.files import new_file, open_file, open_stream
from reviewloom.sources.shared import materialize, new_path

CHUNK = 1 << 18
RECORD_ID = "urn:x-page:"
ROLL_BYTES = 64 << 20
GZIP = 16 + zlib.MAX_WBITS
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "path string, records long"
INDEX = "path string, offset long, length long, record_id string, record_type string, digest string"
RECORDS = (
    "record_id string, record_type string, target string, digest string, refers_to string, declared_bytes long, payload_bytes long, computed_digest string"
)


def record_decisions(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str = "url", least_bytes: int = 100) -> DataFrame:
    """Columns page_id, url, html, payload_bytes, digest, refers_to.

    Of equal payloads of ``least_bytes`` or more, the smallest id is the
    response and the others refer to it. Only (digest, id) pairs are grouped,
    with partial sums. The digests found more than once are written before the
    join: its sides are then plain exchanges, and adaptive execution can split
    the rows of a digest that a third of all pages share.

    A NULL body is empty. Rows of one id are pages of their own; equal ones with
    large payloads are all responses if that id is the smallest, and a row
    without an id refers to the smallest id that has its payload, if any. Other
    columns of ``pages`` are ignored, and an empty table gives no rows.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        body.alias("html"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha2(body.cast("binary"), 256).alias("digest"),
    )
    large = F.col("payload_bytes") >= least_bytes
    repeated = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = materialize(repeated, "repeated-payloads")
    joined = rows.join(repeated, "digest", "left")
    return joined.select("page_id", "url", "html", "payload_bytes", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record_header(page_id, url: str | None, size: int, digest: str, refers_to) -> tuple[bytes, bytes]:
    """Header and HTTP part of a page's record; a revisit has no more than these."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {header_value(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def header_value(text: str | None) -> str:
    return "" if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def write_archives(decisions: DataFrame, folder: str | None = None, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Write each row as a record of a monolithic archive; one row (path, records) for each file, written before it is returned."""
    folder = folder or new_path(decisions.sparkSession, "warc")

    def write(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "payload_bytes", "digest", "refers_to"))))
        row = next(rows, None)
        while row is not None:
            count = size = 0
            with new_file(folder, ".warc.gz") as (path, stream):
                deflate = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                while row is not None and size < roll_bytes:
                    page_id, url, html, n, digest, refers_to = row
                    header, http = record_header(page_id.as_py(), url.as_py(), n.as_py(), digest.as_py(), refers_to.as_py())
                    stream.write(deflate.compress(header + http))
                    if refers_to.as_py() is None:
                        stream.write(deflate.compress(html.as_buffer()))
                    stream.write(deflate.compress(b"\r\n\r\n"))
                    size += len(header) + n.as_py()
                    count += 1
                    row = next(rows, None)
                stream.write(deflate.flush())
            yield pa.RecordBatch.from_pylist([{"path": path, "records": count}])

    rows = decisions.withColumn("html", F.col("html").cast("binary"))
    return materialize(rows.mapInArrow(write, ARCHIVES), "archives")


class Inflated:
    """Reads from a gzip stream of one or several members, or from plain bytes."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.over = stream, b"", 0, False
        self.raw = stream.read(CHUNK)
        self.plain = self.raw[:2] != b"\x1f\x8b"
        self.inflate = None if self.plain else zlib.decompressobj(GZIP)

    def _more(self) -> bool:
        piece = b""
        while not piece and not self.over:
            if self.plain:
                piece, self.raw = self.raw, self.stream.read(CHUNK)
                self.over = not piece
                continue
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                if not self.raw:
                    self.raw = self.stream.read(CHUNK)
                if not self.raw.strip(b"\0"):
                    self.over = True
                    break
                self.inflate = zlib.decompressobj(GZIP)
            if not self.raw and not self.inflate.unconsumed_tail:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    raise ValueError("a gzip stream ends early")
            piece = self.inflate.decompress(self.inflate.unconsumed_tail or self.raw, 4 * CHUNK)
            self.raw = b""
        self.held = self.held[self.at:] + piece
        self.at = 0
        return bool(piece)

    def line(self) -> bytes:
        """Through the next line feed; empty at the end."""
        while True:
            end = self.held.find(b"\n", self.at)
            if end >= 0:
                out, self.at = self.held[self.at:end + 1], end + 1
                return out
            if not self._more():
                out, self.held, self.at = self.held[self.at:], b"", 0
                return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if self.at == len(self.held) and not self._more():
                raise ValueError("a record ends early")
            piece = self.held[self.at:self.at + size]
            self.at += len(piece)
            size -= len(piece)
            yield piece


def next_header(source: Inflated) -> tuple[bytes, dict[str, str]] | None:
    """Raw header and its fields (names in lower case) of the next record, None at the end."""
    line = source.line()
    while line in (b"\r\n", b"\n"):
        line = source.line()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a record: {line[:40]!r}")
    raw, fields = [line], {}
    while True:
        line = source.line()
        raw.append(line)
        if line in (b"\r\n", b"\n", b""):
            return b"".join(raw), fields
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()


def normalise(archives: DataFrame, folder: str | None = None, level: int = 6) -> DataFrame:
    """Rewrite archives so that each record is a gzip member; returns the offset index, one row for each record.

    ``archives`` has a column ``path``. Each file is inflated once, by one
    task, as gzip allows no other way; the tasks are as many as the files. Beside each new file lies its own index
    (``.idx``, tab-separated), so the archive can be used without Spark; the
    same rows are written as a table and returned.
    """
    folder = folder or new_path(archives.sparkSession, "warc-normal")

    def rewrite(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _rewrite(path, folder, level)

    dealt = archives.select("path").repartition(max(1, archives.count()), "path")  # a number of its own, which adaptive execution keeps
    return materialize(dealt.mapInArrow(rewrite, INDEX), "warc-index")


def _rewrite(source_path: str, folder: str, level: int) -> Iterator[pa.RecordBatch]:
    names = ("path", "offset", "length", "record_id", "record_type", "digest")
    with open_stream(source_path) as raw, new_file(folder, ".warc.gz") as (path, out), new_file(folder, ".idx") as (_, sidecar):
        source, offset, rows = Inflated(raw), 0, []
        while (found := next_header(source)) is not None:
            header, fields = found
            deflate = zlib.compressobj(level, zlib.DEFLATED, GZIP)
            length = out.write(deflate.compress(header)) or 0
            for piece in source.take(int(fields["content-length"])):
                length += out.write(deflate.compress(piece)) or 0
            length += out.write(deflate.compress(b"\r\n\r\n")) or 0
            length += out.write(deflate.flush()) or 0
            row = (path, offset, length, fields.get("warc-record-id", ""), fields.get("warc-type", ""), fields.get("warc-payload-digest", ""))
            sidecar.write(("\t".join(map(str, row[1:])) + "\n").encode())
            rows.append(row)
            offset += length
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
                rows = []
    # The last rows come after both files have their names.
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])


class _Window:
    """A part of a file as a stream."""

    def __init__(self, file, offset: int, length: int):
        self.file, self.at, self.end = file, offset, offset + length

    def read(self, size: int) -> bytes:
        piece = self.file.read_at(min(size, self.end - self.at), self.at)
        self.at += len(piece)
        return piece


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read each record of an index by its offset.

    Returns record_id, record_type, target, digest (as the header says), refers_to,
    declared_bytes (of the payload, by its HTTP header), payload_bytes and
    computed_digest (of the payload that is there), and the payload on request.
    Rows of an index are read by any task, sorted by offset for each file.
    """
    fields = RECORDS + (", payload binary" if with_payload else "")

    def read(batches):
        path, file = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if file is not None:
                        file.close()
                    path, file = row["path"], open_file(row["path"])
                rows.append(_read_record(Inflated(_Window(file, row["offset"], row["length"])), with_payload))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if file is not None:
            file.close()

    schema = pa.schema([(n, pa.int64() if n.endswith("bytes") else pa.binary() if n == "payload" else pa.string()) for n in (f.split()[0] for f in fields.split(", "))])
    return index.select("path", "offset", "length").mapInArrow(read, fields)


def _bare(value: str | None) -> str | None:
    return None if value is None else value.strip("<>")


def _read_record(source: Inflated, with_payload: bool) -> dict:
    _, fields = next_header(source)
    size, declared, held = int(fields["content-length"]), None, []
    if fields.get("content-type", "").startswith("application/http"):
        while size:
            line = source.line()
            size -= len(line)
            if line in (b"\r\n", b"\n", b""):
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            if name.strip().lower() == "content-length":
                declared = int(value)
    digest, n = hashlib.sha256(), size
    for piece in source.take(size):
        digest.update(piece)
        if with_payload:
            held.append(piece)
    out = {
        "record_id": _bare(fields.get("warc-record-id")),
        "record_type": fields.get("warc-type"),
        "target": fields.get("warc-target-uri"),
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"),
        "refers_to": _bare(fields.get("warc-refers-to")),
        "declared_bytes": declared,
        "payload_bytes": n,
        "computed_digest": digest.hexdigest(),
    }
    return out | ({"payload": b"".join(held)} if with_payload else {})
