"""WARC archives with a two-level capture index.

Captures are written as WARC/1.1 records, each a gzip member of its own, so
that one byte range is one record. Equal payloads are kept once; the others are
revisits. The index sorts reversed-host URL keys into compressed blocks, one
file for each range of keys; a sparse directory holds each block's first line.
A lookup searches the ranges' first lines, then the range's directory, reads
one block, searches it, and reads one byte range of an archive.

Tasks write and read files through :mod:`pyarrow.fs`, by the scheme of the path.
A task names its files after its attempt, and only files that a finished task
reports are part of the archives, so a repeated task does no harm.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import attach_groups, materialize, partitions, shared_path, small_batches

#: What ends a WARC record (fixed value).
END = "\r\n\r\n"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Lines of an index block before it is compressed.
BLOCK_LINES = 2000
#: Bytes after which a task begins another archive.
FILE_BYTES = 256 << 20
#: Neighbouring records are read at once up to so many bytes, and captures are dealt to tasks by stretches of archives.
READ_BYTES, STRETCH = 8 << 20, 64 << 20
#: zlib's window bits for gzip members.
GZIP = 31

LINE = "key string, capture string, file string, at long, size long"
RANGE = "first_key string, first_capture string, last_key string, last_capture string, name string, n long"
LINE_TYPES = [pa.string()] * 3 + [pa.int64()] * 2


def batch_of(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def line_batch(rows: list[tuple]) -> pa.RecordBatch:
    return batch_of(rows, LINE_TYPES, ["key", "capture", "file", "at", "size"])


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path)


def revisits(captures: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(row_id, digest, response_id, response_url) of the captures whose payload a larger id has too.

    Only payloads of at least ``min_bytes`` count. Rows with a null id are no
    revisits and nothing revisits them.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    sized = captures.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).alias("url_"), payload.alias("payload_"))
    sized = sized.filter(F.col("row_id").isNotNull() & (F.octet_length("payload_") >= min_bytes))
    rows = materialize(sized.select("row_id", "url_", F.unhex(F.sha1("payload_")).alias("digest")), "payloads")
    groups = rows.groupBy("digest").agg(F.max(F.struct("row_id", "url_")).alias("last"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = materialize(groups.select("digest", "copies", F.col("last.row_id").alias("response_id"), F.col("last.url_").alias("response_url")), "payload-groups")
    linked = attach_groups(rows.select("row_id", "digest"), groups, "digest", "copies").filter("row_id <> response_id")
    return materialize(linked.select("row_id", "digest", "response_id", "response_url").distinct(), "revisits")


def written(url: str) -> str:
    """A URL as it stands in a header: line breaks are percent-encoded."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(capture: str, url: str | None, digest: str, payload_bytes: int, payload: bytes | None, date: str, target: str = "", target_url: str | None = None) -> bytes:
    """One WARC record as a gzip member: a response, or with ``payload`` None a revisit of ``target``."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {payload_bytes}{END}".encode()
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if payload is not None else "revisit"), f"WARC-Record-ID: <urn:capture:{capture}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + written(url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        lines += ["WARC-Profile: " + PROFILE, f"WARC-Refers-To: <urn:capture:{target}>"]
        if target_url is not None:
            lines.append("WARC-Refers-To-Target-URI: " + written(target_url))
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload or b'')}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    parts = [CRLF.join(lines).encode("utf-8", "surrogatepass"), END.encode(), http, payload or b"", END.encode()]
    return b"".join([*map(squeeze.compress, parts), squeeze.flush()])


def write_archives(
    captures: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write one record per capture into archives below ``path`` and return their index lines: key, capture, file, at, size.

    Of equal payloads of at least ``min_bytes`` the largest id is the response,
    the others revisit it. Null payloads are empty ones, null URLs leave the
    header out, a null id is written as an empty one and is a response. Rows
    that repeat an id and a payload are all of one kind. An archive ends after
    ``file_bytes``, or the record that passes it. An empty table gives no
    archive. Columns that are not named are not read.

    Payloads are compressed in the scan, so only records travel, and they do
    only where the revisits are too many for Spark to broadcast.
    """
    spark = captures.sparkSession
    small_batches(spark)
    again = revisits(captures, id_col, url_col, payload_col, min_bytes)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row_id, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                digest = hashlib.sha1(payload, usedforsecurity=False)
                member = record("" if row_id is None else str(row_id), url, digest.hexdigest(), len(payload), payload, date)
                rows.append((row_id, url, digest.digest(), len(payload), member))
            yield batch_of(rows, [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.binary()], ["row_id", "url_", "digest", "payload_bytes", "member"])

    rows = captures.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).alias("url_"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload_"))
    members = rows.mapInArrow(compress, "row_id long, url_ string, digest binary, payload_bytes long, member binary")
    told = members.join(again, ["row_id", "digest"], "left").select(
        "row_id", "url_", "digest", "payload_bytes", F.when(F.col("response_id").isNull(), F.col("member")).alias("member"), "response_id", "response_url"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(path)
        task, number, out, file, at, lines = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", 0, None, "", 0, []
        try:
            for batch in batches:
                for row_id, url, digest, size, member, response_id, response_url in zip(*(c.to_pylist() for c in batch.columns)):
                    capture = "" if row_id is None else str(row_id)
                    if member is None:
                        member = record(capture, url, digest.hex(), size, None, date, str(response_id), response_url)
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        else:
                            store.create_dir(top, recursive=True)
                        file, at, number = f"{task}-{number:04d}.warc.gz", 0, number + 1
                        out = store.open_output_stream(f"{top}/{file}", compression=None)
                    out.write(member)
                    lines.append((url_key(url), capture, file, at, len(member)))
                    at += len(member)
                if len(lines) >= 2000:
                    yield line_batch(lines)
                    lines = []
        finally:
            if out is not None:
                out.close()
        yield line_batch(lines)

    return materialize(told.mapInArrow(write, LINE), "captures")


def parse_header(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Headers of the record at ``at`` and where its block begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split(CRLF)
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line), end + 4


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a gzip member."""
    data = zlib.decompress(member, GZIP)
    head, begin = parse_header(data, 0)
    http, body = parse_header(data, begin)
    return head, http, data[body : begin + int(head["Content-Length"])]


def url_key(url: str | None) -> str:
    """Sort key: host labels reversed and joined by commas, then ``)`` and the rest, all lower-case."""
    if not url or "://" not in url:
        return "-)" + written(url or "").lower()
    rest = written(url).split("://", 1)[1].lower()
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:]


def members_of(stream, piece: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(at, size, data) of the gzip members of a stream, which is read piece by piece."""
    at, left = 0, b""
    while True:
        left = left or stream.read(piece)
        if not left:
            return
        inflate, parts, size = zlib.decompressobj(GZIP), [], 0
        while not inflate.eof:
            if not left:
                raise ValueError("an archive ends inside a record")
            parts.append(inflate.decompress(left))
            size += len(left) - len(inflate.unused_data)
            left = inflate.unused_data if inflate.eof else stream.read(piece)
        yield at, size, b"".join(parts)
        at += size


def capture_lines(spark: SparkSession, path: str) -> DataFrame:
    """Index lines of archives that are already there, by reading them through record by record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                lines = []
                with store.open_input_file(f"{top}/{file}") as stream:
                    for at, size, data in members_of(stream):
                        head, _ = parse_header(data, 0)
                        lines.append((url_key(head.get("WARC-Target-URI")), head["WARC-Record-ID"][13:-1], file, at, size))
                        if len(lines) == 5000:
                            yield line_batch(lines)
                            lines = []
                yield line_batch(lines)

    return files.mapInArrow(run, LINE)


class CaptureIndex:
    """Two-level index below ``path`` of the archives in ``archives``.

    For each range of keys there is a file of compressed blocks of lines in
    key order, and a file with the first and last line and the place of each block; the
    table ``ranges`` has a row for each range that holds lines.
    """

    def __init__(self, spark: SparkSession, archives: str, path: str):
        self.spark, self.archives, self.path = spark, archives, path
        #: Blocks that lookups have read.
        self.opened = 0
        self._ranges: list[tuple] | None = None

    def build(self, lines: DataFrame | None = None, lines_per_block: int = BLOCK_LINES) -> CaptureIndex:
        """Sort all captures by key and write both levels. A key with many captures runs over several blocks."""
        lines = capture_lines(self.spark, self.archives) if lines is None else lines
        ordered = lines.repartitionByRange(partitions(self.spark), "key", "capture", "file", "at").sortWithinPartitions("key", "capture", "file", "at")
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, top = open_store(path)
            name, rows, directory, at, n = f"range-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", [], [], 0, 0
            out = None

            def block() -> None:
                nonlocal at, n, out
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{name}.blocks", compression=None)
                blob = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode("utf-8", "surrogatepass"))
                out.write(blob)
                directory.append((*rows[0][:2], *rows[-1][:2], at, len(blob)))
                at, n = at + len(blob), n + len(rows)
                rows.clear()

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    rows.append(row)
                    if len(rows) == lines_per_block:
                        block()
            if rows:
                block()
            if out is not None:
                out.close()
                with store.open_output_stream(f"{top}/{name}.directory", compression=None) as stream:
                    stream.write(zlib.compress(json.dumps(directory).encode()))
                yield batch_of([(*directory[0][:2], *directory[-1][2:4], name, n)], [pa.string()] * 5 + [pa.int64()], RANGE.replace(" string", "").replace(" long", "").split(", "))

        ordered.mapInArrow(run, RANGE).write.mode("overwrite").parquet(f"{self.path}/ranges")
        self._ranges = None
        return self

    def ranges(self) -> DataFrame:
        return self.spark.read.schema(RANGE).parquet(f"{self.path}/ranges")

    def lines(self) -> DataFrame:
        """(key, capture, file, at, size) of all captures, out of the blocks."""
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, top = open_store(path)
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    directory = read_directory(store, f"{top}/{name}")
                    with store.open_input_file(f"{top}/{name}.blocks") as stream:
                        for *_, at, size in directory:
                            yield line_batch(block_lines(stream.read_at(size, at)))

        return self.ranges().select("name").mapInArrow(run, LINE)

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """(WARC headers, payload) of every capture of one URL; a revisit's payload is its response's."""
        out = []
        for line in self._find(url_key(url)):
            head, payload = self._read(line)
            if head["WARC-Type"] == "revisit":
                for source in self._find(url_key(head.get("WARC-Refers-To-Target-URI")), head["WARC-Refers-To"][13:-1]):
                    payload = self._read(source)[1]
            out.append((head, payload))
        return out

    def _find(self, key: str, capture: str | None = None) -> list[tuple]:
        """Lines of a key, or of one capture of it, by binary search of ranges, directory and blocks."""
        if self._ranges is None:  # one row for each range, so as many as there were tasks
            self._ranges = sorted(tuple(r) for r in self.ranges().drop("n").collect())
        store, top = open_store(self.path)
        start, end, found = (key, capture or ""), (key, capture if capture is not None else chr(0x10FFFF)), []
        for *first, _, _, name in self._ranges[bisect.bisect_left(self._ranges, start, key=lambda r: r[2:4]) :]:
            if tuple(first) > end:
                break
            directory = read_directory(store, f"{top}/{name}")
            with store.open_input_file(f"{top}/{name}.blocks") as stream:
                for *first, _, _, at, size in directory[bisect.bisect_left(directory, list(start), key=lambda d: d[2:4]) :]:
                    if tuple(first) > end:
                        return found
                    lines = block_lines(stream.read_at(size, at))
                    self.opened += 1
                    for line in lines[bisect.bisect_left(lines, start, key=lambda r: r[:2]) :]:
                        if line[:2] > end:
                            return found
                        found.append(line)
        return found

    def _read(self, line: tuple) -> tuple[dict[str, str], bytes]:
        """(WARC headers, payload) of one record, by its byte range."""
        _, _, file, at, size = line
        store, top = open_store(self.archives)
        with store.open_input_file(f"{top}/{file}") as stream:
            head, _, payload = parse_record(stream.read_at(size, at))
        return head, payload


def read_directory(store: fs.FileSystem, name: str) -> list[list]:
    """(key and capture of the first and of the last line, at, size) of each block of a range."""
    with store.open_input_file(f"{name}.directory") as stream:
        return json.loads(zlib.decompress(stream.read()))


def block_lines(blob: bytes) -> list[tuple]:
    return [tuple(json.loads(x)) for x in zlib.decompress(blob).decode("utf-8", "surrogatepass").split("\n")]


def read_captures(index: CaptureIndex) -> DataFrame:
    """Read every capture by its byte range in the index.

    (capture, url, record_type, payload_bytes, payload_digest, refers_to):
    length and SHA-1 of a response are taken from the bytes read, those of a
    revisit from its headers. Only index lines are shuffled, by stretches of
    archives; neighbouring ranges are read at once.
    """
    archives = index.archives
    names = ["capture", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2

    def row(member: bytes) -> tuple:
        head, http, payload = parse_record(member)
        name, url = head["WARC-Record-ID"][13:-1], head.get("WARC-Target-URI")
        if head["WARC-Type"] == "response":
            return name, url, "response", len(payload), hashlib.sha1(payload, usedforsecurity=False).hexdigest(), None
        return name, url, head["WARC-Type"], int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Refers-To"][13:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(archives)
        name, stream = None, None
        for batch in batches:
            files, ats, sizes = (c.to_pylist() for c in batch.columns)
            i = 0
            while i < len(files):
                if files[i] != name:
                    if stream is not None:
                        stream.close()
                    name, stream = files[i], store.open_input_file(f"{top}/{files[i]}")
                j = i + 1
                while j < len(files) and files[j] == name and ats[j] == ats[j - 1] + sizes[j - 1] and ats[j] + sizes[j] - ats[i] <= READ_BYTES:
                    j += 1
                data = stream.read_at(ats[j - 1] + sizes[j - 1] - ats[i], ats[i])
                yield batch_of([row(data[at - ats[i] : at - ats[i] + size]) for at, size in zip(ats[i:j], sizes[i:j])], types, names)
                i = j
        if stream is not None:
            stream.close()

    dealt = index.lines().select("file", "at", "size").repartition(partitions(index.spark), "file", F.floor(F.col("at") / STRETCH)).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, "capture string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string")


def archive_round_trip(captures: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Write, index and read all captures: id, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Nulls, repeated rows and empty tables are met as in :func:`write_archives`;
    an empty table gives an empty result.
    """
    spark = captures.sparkSession
    path = shared_path(spark, "archives")
    lines = write_archives(captures, path, id_col, url_col, payload_col, min_bytes)
    index = CaptureIndex(spark, path, shared_path(spark, "capture-index")).build(lines)
    as_id = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return read_captures(index).select(as_id("capture").alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))
