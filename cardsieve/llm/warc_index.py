"""WARC archives with a two-level capture index.

Pages are written as WARC records, one gzip member each. The index holds a line for each record, sorted by reversed-host URL
key and page id. A range of keys is one index file: compressed blocks of lines, then a sparse directory with the first key of
each block. To look a key up: the range by its bounds, the block by binary search in the directory, one range read and the
line by binary search in the block; then one range read of the archive.

Files are in the shared folder; each task's files have names of their own, so a repeated task leaves the first one's unread.

Defined cases: null html is an empty payload; a null or unreadable URL has the key of its text as it stands (empty for
null); rows with equal ids and payloads that are the largest of their group are all responses; a null page_id is kept, and
its record refers to the group's largest id like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import slices

#: Bytes of html in one archive; lines in one index block; smallest payload that is written once only.
ARCHIVE_BYTES, BLOCK_LINES, LEAST = 64 << 20, 1024, 1000
DATE = "2024-01-01T00:00:00Z"
_CAPTURE = "key string, page_id bigint, archive string, offset bigint, length bigint"
_SHARD = "name string, first_key string, last_key string, first_page bigint, last_page bigint, n_lines bigint, directory bigint, size bigint"
_NO_ID = -(1 << 63)


def url_key(url: str | None) -> str:
    """Reversed host, port if odd, path and sorted query: http://a.example.com/x?b&a -> com,example,a)/x?a&b."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = host.removeprefix("www.")
    port_text = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + port_text + ")" + (parts.path or "/") + query


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def make_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the payload's digest and length but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(_header(fields) + block + b"\r\n\r\n") + packer.flush()


def read_record(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes and payload_digest (hex) of a gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    revisit, digest = fields["WARC-Type"] == "revisit", base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of page {page}")
    refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
    return {"page_id": int(page) if page else None, "url": fields["WARC-Target-URI"], "record_type": "revisit" if revisit else "response", "refers_to": int(refers) if refers else None, "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest}


def write_archives(pages: DataFrame, least: int = LEAST) -> tuple[DataFrame, str]:
    """Write a record for each row of (page_id, url, html); returns the captures (key, page_id, archive, offset, length) and the folder. A page_id that is no number becomes null."""
    folder = _store.new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").try_cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    keep = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1 and keep is not null").select("digest", "keep")
    again = rows.filter(F.octet_length("html") >= least).select("digest", "page_id").join(keep, "digest").filter("page_id is null or page_id <> keep").select("digest", F.coalesce("page_id", F.lit(_NO_ID)).alias("id"), "keep").distinct()
    joined = rows.withColumn("id", F.coalesce("page_id", F.lit(_NO_ID))).join(again, ["digest", "id"], "left").select("page_id", "url", "html", "digest", "keep")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", ARCHIVE_BYTES):
            name = f"pages-{uuid.uuid4().hex}.warc.gz"
            columns: list[list] = [[] for _ in range(5)]

            def records(batch=batch, name=name, columns=columns):
                at = 0
                for page, url, html, digest, keep in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "keep"))):
                    raw = make_record(page, url, html.encode(), digest, keep, keep is not None)
                    for column, value in zip(columns, (url_key(url), page, name, at, len(raw))):
                        column.append(value)
                    at += len(raw)
                    yield raw

            _store.put_file(folder, name, records())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "archive", "offset", "length"])

    return _store.stored(joined.mapInArrow(write, _CAPTURE), "captures"), folder


@dataclass
class Index:
    """Index files in a folder; ``shards`` has a row for each, with its bounds."""

    shards: DataFrame
    folder: str


def _line(key: str, page: int | None, archive: str, offset: int, length: int) -> tuple:
    return (key, _NO_ID if page is None else page, archive, offset, length)


def build_index(captures: DataFrame) -> Index:
    """Sort the captures by key and page id into index files."""
    folder = _store.new_path(captures.sparkSession, "capture-index")
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"index-{uuid.uuid4().hex}.cdx"
        directory: list[tuple] = []
        ends: dict = {"n": 0, "first": None, "last": None, "at": 0, "directory": 0}

        def blocks():
            held: list[tuple] = []

            def block(lines):
                raw = zlib.compress(b"".join(_entry(x) for x in lines), 6)
                directory.append((*lines[0][:2], ends["at"], len(raw)))
                ends["at"] += len(raw)
                return raw

            for batch in batches:
                held += [_line(*x) for x in zip(*(c.to_pylist() for c in batch.columns))]
                while len(held) >= BLOCK_LINES:
                    yield block(held[:BLOCK_LINES])
                    ends["n"], ends["last"] = ends["n"] + BLOCK_LINES, held[BLOCK_LINES - 1]
                    held = held[BLOCK_LINES:]
            if held:
                yield block(held)
                ends["n"], ends["last"] = ends["n"] + len(held), held[-1]
            ends["directory"] = ends["at"]
            yield zlib.compress(b"".join(_entry((k, p, "", at, n)) for k, p, at, n in directory), 6)

        first = next(batches, None)
        if first is None:
            return
        rest, source = batches, first

        def chained():
            yield source
            yield from rest

        batches = chained()
        size = _store.put_file(folder, name, blocks())
        if ends["n"]:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, directory[0][0], ends["last"][0], directory[0][1], ends["last"][1], ends["n"], ends["directory"], size)], ["name", "first_key", "last_key", "first_page", "last_page", "n_lines", "directory", "size"])

    return Index(_store.stored(ordered.select("key", "page_id", "archive", "offset", "length").mapInArrow(write, _SHARD), "index-files"), folder)


def _entry(line: tuple) -> bytes:
    key, page, archive, offset, length = line
    key, archive = key.encode(), archive.encode()
    return struct.pack("<IIqqq", len(key), len(archive), page, offset, length) + key + archive


def _entries(raw: bytes) -> list[tuple]:
    data, at, out = zlib.decompress(raw), 0, []
    while at < len(data):
        a, b, page, offset, length = struct.unpack_from("<IIqqq", data, at)
        at += 32
        out.append((data[at : at + a].decode(), page, data[at + a : at + a + b].decode(), offset, length))
        at += a + b
    return out


def _utf8(key: str, page: int) -> tuple[bytes, int]:
    """Order of Spark's strings: by bytes."""
    return key.encode(), page


class _Shard:
    """An index file open for look-ups."""

    def __init__(self, file, size: int, directory: int):
        self.file = file
        file.seek(directory)
        self.directory = _entries(file.read(size - directory))
        self.firsts = [_utf8(k, p) for k, p, *_ in self.directory]
        self.number, self.lines, self.keys = -1, [], []

    def _block(self, number: int) -> None:
        if number != self.number:
            _, _, _, at, size = self.directory[number]
            self.file.seek(at)
            self.lines = _entries(self.file.read(size))
            self.keys, self.number = [_utf8(k, p) for k, p, *_ in self.lines], number

    def find(self, key: str, page: int | None) -> Iterator[tuple]:
        """Captures with this key, and this page id unless it is None, in order."""
        low = _utf8(key, _NO_ID if page is None else page)
        high = (low[0], (1 << 63) - 1 if page is None else page)
        number = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while number < len(self.firsts) and (self.firsts[number] <= high):
            self._block(number)
            yield from self.lines[bisect.bisect_left(self.keys, low) : bisect.bisect_right(self.keys, high)]
            number += 1


def look_up(index: Index, requests: DataFrame) -> DataFrame:
    """Captures of the requested (key, page_id): each request once; a page_id of None asks for all captures of the key, one that is
    no number for those without an id.

    The bounds of the index files, one row each, go to the tasks; a request is sent to the files whose bounds hold it.
    """
    spark = requests.sparkSession
    shards = sorted(index.shards.collect(), key=lambda r: _utf8(r.first_key, r.first_page))
    sent, folder = spark.sparkContext.broadcast([(r.name, _utf8(r.first_key, r.first_page), _utf8(r.last_key, r.last_page), r.size, r.directory) for r in shards]), index.folder
    requests = requests.select(F.col("key").cast("string").alias("key"), F.when(F.col("page_id").isNotNull(), F.coalesce(F.col("page_id").try_cast("bigint"), F.lit(_NO_ID))).alias("page_id")).distinct()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = sent.value
        lasts = [b[2] for b in bounds]
        for batch in batches:
            out: list[tuple] = []
            for key, page in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist()):
                low = _utf8(key or "", _NO_ID if page is None else page)
                high = (low[0], (1 << 63) - 1 if page is None else page)
                k = bisect.bisect_left(lasts, low)
                while k < len(bounds) and bounds[k][1] <= high:
                    out.append((k, key or "", page))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["shard", "key", "page_id"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _store.file_system(folder)
        number, shard = -1, None
        for batch in batches:
            out: list[tuple] = []
            for k, key, page in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "page_id"))):
                if k != number:
                    name, _, _, size, directory = sent.value[k]
                    number, shard = k, _Shard(system.open_input_file(f"{base}/{name}"), size, directory)
                out += shard.find(key, page)
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "page_id", "archive", "offset", "length"])

    routed = requests.mapInArrow(send, "shard int, key string, page_id bigint").repartition("shard").sortWithinPartitions("shard", "key", "page_id")
    return routed.mapInArrow(find, _CAPTURE).withColumn("page_id", F.when(F.col("page_id") != _NO_ID, F.col("page_id")))


def read_captures(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Range-read and verify the records of captures: page_id, url, record_type, refers_to, payload_bytes, payload_digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _store.file_system(folder)
        name, file = None, None
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    name, file = archive, system.open_input_file(f"{base}/{archive}")
                file.seek(offset)
                out.append(read_record(file.read(length)))
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in zip(names, types)], names)

    spread = captures.repartition("archive", F.floor(F.col("offset") / (1 << 22))).sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(read, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string" + ", payload binary" * with_payload)


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, look each page's capture up by its URL key and read it back."""
    captures, folder = write_archives(pages)
    index = build_index(captures)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], ["key", "page_id"])

    requests = pages.select(F.col("url").cast("string").alias("url"), F.coalesce(F.col("page_id").try_cast("bigint"), F.lit(_NO_ID)).alias("page_id")).mapInArrow(key, "key string, page_id bigint")
    return read_captures(look_up(index, requests), folder)
