"""WARC archives with a two-level capture index.

Writing: every task streams its records into gzip-per-record archive files under
one folder. Indexing: the captures are sorted by reversed-host URL key; each task
writes its key range as one index file of compressed blocks of lines, and beside
it a sparse directory with the first key, offset and length of every block.
Reading: a task finds the index file of a key by binary search among the files'
first keys, the block by binary search in that file's directory, fetches the block
by a range read, finds the line, and fetches the record by another range read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import task_count

MIN_SHARED_BYTES = 100  # smaller payloads are always written in full
MAX_FILE_BYTES = 256 << 20  # an archive file is closed beyond this size
BLOCK_LINES = 1000  # index lines in a compressed block
TASK_BYTES = 64 << 20  # most archive bytes that a task reads back
LEAST_TASK_BYTES = 1 << 20
LEAST_TASK_LINES = 5000  # fewest index lines that are worth a file of their own
GZIP_LEVEL = 4
DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture time
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
_CAPTURES = "capture bigint, key string, file string, offset bigint, length bigint"
_FILES = "first_key string, file string, lines bigint"
_READ = ("capture bigint, page_id bigint, url string, record_type string, payload_bytes bigint, "
         "payload_digest string, refers_to bigint, payload binary")


def _open(uri: str):
    """File system and path of a folder or file, of any store that Arrow reads."""
    return pafs.FileSystem.from_uri(uri if re.match(r"[a-z0-9+.-]+:", uri) else "file://" + uri)


def url_key(url: str | None) -> str:
    """Reversed-host key: scheme, user and a www prefix go, host labels are
    reversed, the rest follows after ')'. Blanks and control characters are
    escaped. Null gives an empty key."""
    text = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d*)?(.*)", text, re.S)
    if not m:
        return text
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + (m[2] or "").rstrip(":") + ")" + (m[3] or "/")


def capture_key(url: str | None, capture: int) -> str:
    """Index key: the URL key and the capture's number, so that captures of one
    URL are told apart and a very common URL can be cut into many ranges."""
    return f"{url_key(url)} {capture:019d}"


def record(row: dict) -> bytes:
    """One WARC 1.1 record as a gzip member. Revisits carry no payload."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "")
    http = _HEAD + b"Content-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http if row["record_type"] == "revisit" else http + row["payload"]
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:capture:{row['capture']}>",
             f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response",
             f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"Content-Length: {len(block)}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {url}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"X-Refers-To-Page-ID: {row['refers_to']}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, GZIP_LEVEL, mtime=0)


def parse_record(member: bytes) -> dict:
    """The inverse of ``record``. Of a response the payload is checked against
    the digest in the header."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = h["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(h[k]) if k in h else None
    return {"capture": int(re.search(r"\d+", h["WARC-Record-ID"])[0]), "page_id": number("X-Page-ID"),
            "url": h.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": digest,
            "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


class _Roll:
    """Output files of one task attempt, named so that no other attempt has them."""

    def __init__(self, folder: str, suffix: str, most: float = MAX_FILE_BYTES):
        self.fs, self.path = _open(folder)
        self.fs.create_dir(self.path, recursive=True)
        context = TaskContext.get()
        self.stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.suffix, self.most, self.n, self.out, self.at = suffix, most, 0, None, 0

    def append(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at and self.at + len(data) > self.most:
            self.close()
            self.name = f"{self.stem}-{self.n:04d}{self.suffix}"
            self.out, self.at = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), 0
            self.n += 1
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data)

    def close(self):
        if self.out is not None:
            self.out.close()
            self.out = None


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            out = out or _Roll(folder, ".warc.gz")
            done = []
            for row in rows:
                member = record(row)
                name, offset = out.append(member)
                done.append((row["capture"], capture_key(row["url"], row["capture"]), name, offset, len(member)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["capture", "key", "file", "offset", "length"])
        if out:
            out.close()
    return write


def shared_payloads(pages: DataFrame, min_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """pages -> capture, page_id, url, payload, payload_bytes, payload_digest,
    record_type, refers_to (see ``write_archives``)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(html, "UTF-8").alias("payload")).withColumns({
                            "payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    firsts = (base.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    firsts = materialize(firsts, "warc-firsts")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return base.join(firsts, "payload_digest", "left").select(
        F.monotonically_increasing_id().alias("capture"), "page_id", "url",
        F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per page under ``folder``; returns the stored captures
    (capture, key, file, offset, length).

    The payload is the html in UTF-8 (null: empty). Of records with equal
    payloads of at least ``MIN_SHARED_BYTES`` bytes, that with the least page_id
    is a response and the others revisit it; rows that repeat this page_id are
    responses, too, and rows with a null id revisit it unless all ids are null.
    Files of failed attempts stay unnamed in the captures and are never read.
    """
    return materialize(shared_payloads(pages).mapInArrow(_write(folder), _CAPTURES), "warc-captures")


def _write_index(folder: str, block_lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, directory, first, lines = None, [], [], None, 0

        def block():
            nonlocal held
            packed = gzip.compress("\n".join(held).encode(), 6, mtime=0)
            _, offset = out.append(packed)
            directory.append(f"{held[0].split(chr(9), 1)[0]}\t{offset}\t{len(packed)}")
            held = []

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out, first = _Roll(folder, ".idx", float("inf")), row["key"]
                held.append(f"{row['key']}\t{row['file']}\t{row['offset']}\t{row['length']}")
                lines += 1
                if len(held) == block_lines:
                    block()
        if out is None:
            return
        if held:
            block()
        out.close()
        with out.fs.open_output_stream(f"{out.path}/{out.stem}.dir", compression=None) as f:
            f.write("\n".join(directory).encode())
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([out.stem]), pa.array([lines])],
                                         names=["first_key", "file", "lines"])
    return write


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures by key into index files under ``folder``, one per range
    of keys; returns (first_key, file, lines), one row per file; there are at most
    as many files as the shuffle has partitions."""
    lines = captures.count()
    n = task_count(captures.sparkSession, lines, max(1, lines), LEAST_TASK_LINES)
    ranges = captures.repartitionByRange(n, "key").sortWithinPartitions("key")
    return materialize(ranges.mapInArrow(_write_index(folder, block_lines), _FILES), "warc-index")


class _Cache(OrderedDict):
    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def fetch(self, key, make):
        if key in self:
            self.move_to_end(key)
        else:
            self[key] = make()
            if len(self) > self.most:
                self.popitem(last=False)
        return self[key]


class Reader:
    """Lookups in the two-level index. ``files``: sorted (first key, file)."""

    def __init__(self, archive: str, index: str, files: list[tuple[str, str]]):
        (self.afs, self.apath), (self.ifs, self.ipath) = _open(archive), _open(index)
        self.first, self.files = [k for k, _ in files], [f for _, f in files]
        self.directories, self.blocks, self.handles = _Cache(4), _Cache(4), _Cache(16)

    def _directory(self, file: str):
        with self.ifs.open_input_file(f"{self.ipath}/{file}.dir") as f:
            rows = [x.split("\t") for x in f.read().decode().split("\n")]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def _range(self, fs, path: str, offset: int, length: int) -> bytes:
        f = self.handles.fetch(path, lambda: fs.open_input_file(path))
        return f.read_at(length, offset)

    def _block(self, file: str, offset: int, length: int):
        lines = gzip.decompress(self._range(self.ifs, f"{self.ipath}/{file}-0000.idx", offset, length)).decode().split("\n")
        rows = [x.split("\t") for x in lines]
        return [r[0] for r in rows], rows

    def find(self, key: str) -> tuple[str, int, int] | None:
        """(archive file, offset, length) of a capture key, or None."""
        at = bisect_right(self.first, key) - 1
        if at < 0:
            return None
        file = self.files[at]
        keys, spans = self.directories.fetch(file, lambda: self._directory(file))
        n = bisect_right(keys, key) - 1
        if n < 0:
            return None
        lines, rows = self.blocks.fetch((file, n), lambda: self._block(file, *spans[n]))
        i = bisect_right(lines, key) - 1
        return (rows[i][1], int(rows[i][2]), int(rows[i][3])) if i >= 0 and lines[i] == key else None

    def read(self, place: tuple[str, int, int]) -> dict:
        return parse_record(self._range(self.afs, f"{self.apath}/{place[0]}", place[1], place[2]))


def read_captures(keys: DataFrame, archive: str, index: str, files: DataFrame, payload: bool = False,
                  tasks: int | None = None) -> DataFrame:
    """keys(key) -> the records' fields, read through the index; keys that the
    index does not hold give no row. The keys are sorted by range, so a task
    touches few index blocks; ``tasks`` is their number (else the planner's, which
    sees the keys' size only and not that of the records). The list of index files is sent to every task: a
    row for each range partition of ``write_index``, whatever the data."""
    tops = sorted((r.first_key, r.file) for r in files.select("first_key", "file").collect())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = None, [c.split()[0] for c in _READ.split(", ")]
        for batch in batches:
            reader = reader or Reader(archive, index, tops)
            places = sorted(p for p in map(reader.find, batch.column(0).to_pylist()) if p)
            for at in range(0, len(places), 256):
                rows = [reader.read(p) for p in places[at:at + 256]]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                if not payload:
                    rows = [r | {"payload": None} for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
    spread = keys.select("key").repartitionByRange(*([tasks] if tasks else []), "key")
    return spread.sortWithinPartitions("key").mapInArrow(look, _READ)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives and index in the shared folder, then read every
    record back by its key: page_id, payload_bytes, payload_digest, record_type,
    refers_to; a row for each input row. Both size and digest are of the full
    payload. Null urls have an empty key, null html an empty payload; an empty
    table writes nothing and gives no row; other columns are not looked at."""
    root = scratch_path(spark, "warc")
    captures = write_archives(pages, f"{root}/archive")
    files = write_index(captures, f"{root}/index")
    stored = captures.agg(F.sum("length")).first()[0] or 0
    tasks = task_count(spark, stored, TASK_BYTES, LEAST_TASK_BYTES)
    return read_captures(captures, f"{root}/archive", f"{root}/index", files, tasks=tasks).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
