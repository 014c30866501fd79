"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding a group of whole
WARC records, and a footer: the seek table of the public seekable format (a
skippable frame with every frame's compressed and plain size).  Each bundle's
row also has the map from its record identifiers to (frame, offset in the frame), made while it
is written, so a record is found by reading that column (`record_index`) and
read by decompressing one frame (`read_payloads`).

Bundles are rows (name, bytes, places) of a table in the shared folder: Spark's
committer makes a retried or speculative task's bundle appear once, on any store.
`export_bundle` writes one as a .warc.zst file, readable by standard tools.

Duplicates: of equal payloads (told by SHA-256 and length; the headers have SHA-1)
the smallest page is a response and the others are revisits, which have headers
but no payload.  Only digests are aggregated and joined; html moves only where a
Bloom filter says that the page may be a revisit.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.llm import bloom
from vitrail.llm.scratch import written

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the format
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_NAMELESS = 1 << 82


def record_id(page_id: int | None, number: int = 0) -> str:
    """A custom-layout (version 8) UUID that holds the page number; of a page
    without one, that and the record's number."""
    n = (number if page_id is None else page_id) & ((1 << 64) - 1)
    flag = _NAMELESS if page_id is None else 0
    return f"<urn:uuid:{uuid.UUID(int=flag | (n >> 62) << 80 | 0x8 << 76 | 0b10 << 62 | n & ((1 << 62) - 1))}>"


def page_of(identifier: str) -> int | None:
    n = uuid.UUID(identifier[10:-1]).int
    if n & _NAMELESS:
        return None
    n = (n >> 80 & 3) << 62 | n & ((1 << 62) - 1)
    return n - (1 << 64) if n >> 63 else n


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, number: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit when it refers to another page."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, number)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join((url or "").split()),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """WARC headers (lower-case names), block, and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record has no end")
    return headers, data[start:stop], stop + 4


class BundleWriter:
    """Collects records into frames; index entries are (frame, offset)."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes = frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frames: list[bytes] = []
        self.plain: list[int] = []
        self.open: list[bytes] = []
        self.size = 0
        self.bytes = 0

    def add(self, rec: bytes) -> tuple[int, int]:
        place = len(self.frames), self.size
        self.open.append(rec)
        self.size += len(rec)
        self.bytes += len(rec)
        if self.size >= self.frame_bytes:
            self._close_frame()
        return place

    def _close_frame(self) -> None:
        if self.open:
            self.frames.append(self.compress(b"".join(self.open)))
            self.plain.append(self.size)
            self.open, self.size = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        body = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.plain))
        body += struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """Random access to a bundle through its footer."""

    def __init__(self, data: bytes):
        self.data = data
        count, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        table = len(data) - 9 - count * width
        if struct.unpack("<II", data[table - 8 : table]) != (SKIPPABLE, count * width + 9):
            raise ValueError("a damaged seek table")
        self.sizes = [struct.unpack("<II", data[table + i * width : table + i * width + 8]) for i in range(count)]
        self.starts = [0]
        for c, _ in self.sizes:
            self.starts.append(self.starts[-1] + c)

    def frame(self, i: int) -> bytes:
        part = self.data[self.starts[i] : self.starts[i + 1]]
        return zstandard.ZstdDecompressor().decompress(part, max_output_size=max(self.sizes[i][1], 1))

    def records(self) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
        """(headers, block, frame, offset) of all records, a frame at a time."""
        for i in range(len(self.sizes)):
            plain, at = self.frame(i), 0
            while at < len(plain):
                headers, block, after = parse_record(plain, at)
                yield headers, block, i, at
                at = after

    def read(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        headers, block, _ = parse_record(self.frame(frame), offset)
        return headers, block


def export_bundle(data: bytes, path: str) -> None:
    with open(path, "wb") as f:
        f.write(data)


_PLACE = pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64())])
_BUNDLES = "name string, bytes binary, places array<struct<record_id:string,page_id:long,refers_to:long,frame:int,offset:long>>"
_RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
    "bundle string, frame int, offset long"
)


def _write_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    count, number, out, places = 0, part << 32, BundleWriter(), []

    def done():
        columns = [pa.array([f"part-{part:06d}-{count:06d}.warc.zst"]), pa.array([out.finish()], pa.binary()), pa.array([places], pa.list_(_PLACE))]
        return pa.record_batch(columns, names=["name", "bytes", "places"])

    for batch in batches:
        for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
            frame, offset = out.add(record(page, url, (html or "").encode(), refers, number))
            places.append({"record_id": record_id(page, number), "page_id": page, "refers_to": refers, "frame": frame, "offset": offset})
            number += 1
            if out.bytes >= BUNDLE_BYTES:
                yield done()
                count, out, places = count + 1, BundleWriter(), []
    if out.bytes:
        yield done()


def _revisits(pages: DataFrame) -> DataFrame:
    """(p, d, refers_to): the pages and payloads of which a smaller page has the payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digests = pages.select("page_id", F.unhex(F.concat(F.sha2(payload, 256), F.lpad(F.hex(F.length(payload).cast("long")), 16, "0"))).alias("digest"))
    # one row per payload that more than one page has; a page without id is after all others
    shared = digests.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.bool_or(F.isnull("page_id")).alias("nameless")
    )
    shared = shared.where("first <> last or nameless and first is not null").select(F.hex("digest").alias("d"), "first")
    return (
        digests.select("page_id", F.hex("digest").alias("digest"))
        .join(shared, F.col("digest") == F.col("d"))
        .where("page_id is null or page_id <> first")
        .groupBy(F.col("page_id").alias("p"), F.unhex("digest").alias("d"))
        .agg(F.min("first").alias("refers_to"))
    )


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row; returns the stored table (name, bytes, places)."""
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")
    )
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    revisits = written(_revisits(base), "warc-revisits")
    base = base.withColumn("digest", F.unhex(F.concat(F.sha2(payload, 256), F.lpad(F.hex(F.length(payload).cast("long")), 16, "0"))))
    rows = bloom.flagged(base, F.xxhash64("page_id", "digest"), revisits, F.xxhash64("p", "d"), "warc-filter")
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))  # an id may have several payloads
    apart = rows.where(~F.col("maybe")).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    met = rows.where("maybe").join(revisits, same, "left").select("page_id", "url", "html", "refers_to")
    return written(apart.unionByName(met).mapInArrow(_write_task, _BUNDLES), "warc-bundles")


def record_index(bundles: DataFrame) -> DataFrame:
    """(record_id, page_id, refers_to, bundle, frame, offset) as stored with the
    bundles; their bytes are not read."""
    return bundles.select(F.col("name").alias("bundle"), F.explode("places").alias("p")).select(
        "p.record_id", "p.page_id", "p.refers_to", "bundle", "p.frame", "p.offset"
    )


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row per record, from the archives alone: headers, place (bundle, frame,
    offset in the frame), and, of a response, its payload's size and digest
    as recomputed and held against the header.  The stored index is held against the places."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows, found = [], []
                for h, block, frame, at in Bundle(data).records():
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
                    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"damaged payload of {h['warc-record-id']}")
                    refers = h.get("warc-refers-to")
                    found.append((h["warc-record-id"], frame, at))
                    rows.append(
                        (page_of(h["warc-record-id"]), h["warc-target-uri"], kind, refers and page_of(refers), digest, size, name, frame, at)
                    )
                if found != [(p["record_id"], p["frame"], p["offset"]) for p in places]:
                    raise ValueError(f"the index of {name} is not its bundle's")
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
                names = [c.split()[0] for c in _RECORDS.split(", ")]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return bundles.select("name", "bytes", "places").mapInArrow(task, _RECORDS)


def read_payloads(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, payload) of the pages `wanted` (page_id), by the stored index:
    of each frame that holds one, only that frame is decompressed.  A revisit's
    payload is that of the page it refers to."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, payloads = [], []
            for data, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bundle = Bundle(data)
                frames: dict[int, bytes] = {}
                for p in sorted(places, key=lambda p: p["frame"]):
                    if p["frame"] not in frames:
                        frames = {p["frame"]: bundle.frame(p["frame"])}
                    _, block, _ = parse_record(frames[p["frame"]], p["offset"])
                    ids.append(p["page_id"])
                    payloads.append(block.partition(b"\r\n\r\n")[2])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(payloads, pa.binary())], names=["page_id", "payload"])

    index = record_index(bundles)
    asked = index.join(wanted.select(F.col("page_id").alias("w")).distinct(), F.col("page_id") == F.col("w"), "left_semi")
    asked = asked.select("page_id", F.coalesce("refers_to", "page_id").alias("target")).distinct()
    held = index.where("refers_to is null").select(F.col("page_id").alias("held"), "bundle", "frame", "offset")
    places = asked.join(held, F.col("target") == F.col("held")).groupBy("bundle").agg(F.collect_list(F.struct("page_id", "frame", "offset")).alias("at"))
    return bundles.select("name", "bytes").join(places, F.col("name") == F.col("bundle")).select("bytes", "at").mapInArrow(task, "page_id long, payload binary")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives and reads them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, then the record's place.

    Null html is an empty payload; empty payloads are equal like any others.
    A row without page_id has a record too (of equal payloads, a page with an id is
    the response; if none has one, all are); a repeated page_id is written as often as it comes (a repeat with
    the same payload refers to no other page, so it is a response again).  An empty
    table makes no bundle.
    """
    return read_bundles(write_bundles(pages, id_col, url_col, html_col)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "offset"
    )
