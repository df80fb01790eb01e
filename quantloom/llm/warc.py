"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with a group of whole
WARC records, closed by the seek table of the Zstandard seekable format (a
skippable frame that lists the sizes of all frames). An index maps each record
to its bundle, frame and place within the frame, so one record is read by
decompressing one frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import fresh_path, staged

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "page_id long, record_id string, bundle string, frame int, frame_start long, frame_size long, record_start long, record_size long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int | None, sha: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}:{sha}:{kind}')}>"


def record(page: int | None, url: str | None, payload: bytes, owner: int | None, revisit: bool, date: str) -> tuple[str, bytes]:
    """Record id and bytes of a WARC/1.1 record; a revisit has the HTTP header of the page, and no payload."""
    sha, kind = digest(payload), "revisit" if revisit else "response"
    own = _record_id(page, sha, kind)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{sha}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c else f"%{ord(c):02X}" for c in url))
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(owner, sha, 'response')}", f"X-Refers-To-Page: {owner}"]
    head.append(f"Content-Length: {len(block)}")
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record here")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("record is cut short")
        yield head, block
        at = end + 8 + size


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def frames_of(tail: bytes | memoryview) -> list[tuple[int, int]]:
    """Compressed and plain size of each frame, from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    step = 12 if flags & 0x80 else 8
    at = len(tail) - 9 - n * step
    if at < 8 or struct.unpack("<I", tail[at - 8 : at - 4])[0] != _SKIPPABLE:
        raise ValueError("seek table is cut short")
    return [struct.unpack("<II", tail[at + i * step : at + i * step + 8]) for i in range(n)]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Bundle:
    """Collects records into frames, and frames into one file, written under its final name only when complete."""

    def __init__(self, folder: str):
        import zstandard

        self.fs, root = _filesystem(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{root}/{self.name}"
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.open: list[bytes] = []
        self.size = self.at = 0
        self.rows: list[list] = []
        self.pending: list[list] = []

    def add(self, page: int | None, own: str, data: bytes) -> None:
        self.pending.append([page, own, self.name, len(self.frames), self.at, 0, self.size, len(data)])
        self.open.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.frames.append((len(packed), self.size))
            self.parts.append(packed)
            for row in self.pending:
                row[5] = len(packed)
            self.rows += self.pending
            self.at += len(packed)
            self.open, self.pending, self.size = [], [], 0

    def close(self) -> list[list]:
        self.flush()
        with self.fs.open_output_stream(f"{self.path}.part") as out:
            for x in [*self.parts, seek_table(self.frames)]:
                out.write(x)
        self.fs.move(f"{self.path}.part", self.path)
        return self.rows


def _index_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in INDEX.split(", ")])


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    bundle: _Bundle | None = None
    for batch in batches:
        for page, url, payload, owner in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), textkit.texts(batch.column("html")), batch.column("owner").to_pylist(), strict=True):
            bundle = bundle or _Bundle(folder)
            bundle.add(page, *record(page, url, payload, owner, owner is not None and owner != page, date))
            if bundle.at >= BUNDLE_BYTES:
                yield _index_batch(bundle.close())
                bundle = None
    if bundle:
        yield _index_batch(bundle.close())


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) below `folder` and return the index.

    Of pages with equal payloads of at least `least_bytes` bytes the one with
    the largest page_id is a response, the others revisit it; smaller payloads
    are all responses. Null html: empty payload. Null url: no target URI. Null
    page_id: a revisit of an equal page if there is one with an id. Rows that
    repeat a page_id and its payload are each what that page is. Other columns
    are not read. Tasks that are run again write bundles of other names; only
    bundles named in the index count."""
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit(""))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload.cast("binary")).alias("sha"))
    long = src.where(F.octet_length(payload) >= least_bytes)
    owners = staged(long.groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 and owner is not null").select("sha", "owner"), "owners")
    owned = src.join(owners, "sha", "left").select("page_id", "url", "html", "owner")
    return staged(owned.mapInArrow(lambda it: _write(it, folder, date), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for content in batch.column("content"):
            raw = memoryview(content.as_buffer())
            at, rows = 0, []
            for packed, plain in frames_of(raw):
                for head, block in parse(unzip.decompress(raw[at : at + packed], max_output_size=plain)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and digest(payload) != said:
                        raise ValueError(f"payload of {head['warc-record-id']} is damaged")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    rows.append((head.get("x-page-id"), size, said, head["warc-type"], head.get("x-refers-to-page"), head.get("warc-target-uri")))
                at += packed
            ints = [pa.array([None if r[i] is None else int(r[i]) for r in rows], pa.int64()) for i in (0, 1, 4)]
            yield pa.record_batch([ints[0], ints[1], *(pa.array([r[i] for r in rows], pa.string()) for i in (2, 3)), ints[2], pa.array([r[5] for r in rows], pa.string())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Read every bundle that the index names, record by record; payloads of responses are checked against their digests."""
    files = index.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = index.select("bundle").distinct()
    ours = files.withColumn("bundle", F.element_at(F.split("path", "/"), -1)).join(named, "bundle", "left_semi")
    return ours.select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def read_record(folder: str, row) -> tuple[dict[str, str], bytes]:
    """One record by its index row: one range of bytes is read and one frame decompressed."""
    import zstandard

    fs, root = _filesystem(folder)
    with fs.open_input_file(f"{root}/{row['bundle']}") as f:
        f.seek(row["frame_start"])
        plain = zstandard.ZstdDecompressor().decompress(f.read(row["frame_size"]))
    return next(parse(plain[row["record_start"] : row["record_start"] + row["record_size"]]))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
