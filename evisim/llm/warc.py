"""WARC archives as seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames of whole WARC records, then skippable frames with a record table (record
identifier to frame and place in the decompressed frame) and, last, the seek table of the seekable Zstandard format, which any
Zstandard decoder skips. One record is read by the footer, the seek table and a single frame.

Of records with equal payloads of `least` bytes or more the one with the largest page_id is a response, the others are
revisits that name it; smaller payloads are all responses. Digests are found before payloads move: a payload's size and SHA-1
group the pages, and pages meet their record's type by page_id and digest.

A task writes a bundle under a name of its own and renames it when it is whole, to a name that follows from its partition, its
number there and its content: bundles of equal bytes are files of their own, and a task that runs again writes the same bytes to
the same name. Files go where Spark's shared folder is, by the file
system that its URI names. Reading deals the names of bundles, not their contents: a task opens a bundle, reads its footer, and then
one frame at a time, so it holds a frame however large the bundle is; `lookup` reads footers and the frames wanted. A response's
payload is hashed again as it is read, and a record whose digest or size isn't that of its header is an error.

Null html counts as empty. Null urls give records without a target URI; control characters and spaces in urls are
percent-encoded. Repeated page_ids with one payload: all rows with the winner's page_id are responses. Null page_ids are
written as empty identifiers and lose to any other. Very long payloads are a frame of their own; an empty table gives no bundles
and no records. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evisim.llm.staging import new_path, staged

SKIPPABLE_SEEK, SKIPPABLE_RECORDS, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
IDENTIFIER = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = "bundle string, record_id string, frame int, start long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header that gives the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: "" if i is None else str(i)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{IDENTIFIER}{name(page_id)}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{IDENTIFIER}{name(refers_to)}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, and the payload of a response."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record")
    out = dict(line.split(": ", 1) for line in lines)
    size = int(out["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't match its header")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    out["payload"] = payload
    out["payload_bytes"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return out


class Bundle:
    """Collects records into frames; `close` gives the file's bytes and the places of its records."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.frame_bytes, self.size = frame_bytes, 0
        self.out: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.places: list[tuple[str, int, int, int]] = []
        self.pending: list[bytes] = []
        self.pending_size = 0

    def add(self, record_id: str, data: bytes) -> None:
        self.places.append((record_id, len(self.table), self.pending_size, len(data)))
        self.pending.append(data)
        self.pending_size += len(data)
        if self.pending_size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if self.pending:
            packed = self.compressor.compress(b"".join(self.pending))
            self.table.append((len(packed), self.pending_size))
            self.out.append(packed)
            self.size += len(packed)
            self.pending, self.pending_size = [], 0

    def close(self) -> bytes:
        self._frame()
        records = self.compressor.compress(json.dumps(self.places).encode())
        seek = b"".join(struct.pack("<II", c, d) for c, d in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join([*self.out, struct.pack("<II", SKIPPABLE_RECORDS, len(records)), records, struct.pack("<II", SKIPPABLE_SEEK, len(seek)), seek])


def frames_of(data: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of each frame, from the seek table at the end."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    width = 12 if flags & 0x80 else 8
    if magic != SEEKABLE or struct.unpack("<II", data[-9 - width * n - 8 : -9 - width * n]) != (SKIPPABLE_SEEK, width * n + 9):
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", data, len(data) - 9 - width * (n - i))
        out.append((at, c, d))
        at += c
    return out


def records_of(data: bytes) -> list[tuple[str, int, int, int]]:
    """(record identifier, frame, start, length) of each record, from the record table."""
    return _record_table(data[sum(c for _, c, _ in frames_of(data)) :])


def _record_table(data: bytes) -> list[tuple[str, int, int, int]]:
    """Records by the record table that data begins with."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_RECORDS:
        raise ValueError("no record table")
    return [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))]


def _store(folder: str):
    """The file system of a folder's URI, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:/") else (fs.LocalFileSystem(), folder)


def read_one(data: bytes, frame: int, start: int, length: int) -> bytes:
    """One record, by decompressing its frame alone."""
    import zstandard

    at, c, d = frames_of(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + c], max_output_size=d)[start : start + length]


def typed_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, revisit, refers_to of every page."""
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    digests = staged(pages.select("page_id", F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).alias("size")), "warc-digests")
    winners = staged(digests.groupBy("sha1", "size").agg(F.max("page_id").alias("winner")), "warc-winners")
    w = winners.select(F.col("sha1").alias("s"), F.col("size").alias("z"), "winner")
    revisit = (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("winner"))
    types = digests.join(w, (F.col("sha1") == F.col("s")) & (F.col("size") == F.col("z"))).select("page_id", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("winner")).alias("refers_to"))
    revisits = staged(types.filter("revisit").distinct().select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "refers_to"), "warc-revisits")
    own = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"))
    joined = own.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")), "left")
    return joined.select("page_id", "url", "payload", F.col("s").isNotNull().alias("revisit"), "refers_to")


def write_archives(pages: DataFrame, folder: str, least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the bundles to folder (a URI) and returns a written table of ENTRY: where each record is."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        store, base = _store(folder)
        store.create_dir(base, recursive=True)

        def finish(bundle: Bundle) -> pa.RecordBatch:
            nonlocal number
            data = bundle.close()
            name = f"{part:06d}-{number:06d}-{hashlib.sha256(data).hexdigest()[:32]}.warc.zst"
            number += 1
            own = f"{base}/_{uuid.uuid4().hex}"
            with store.open_output_stream(own, compression=None) as f:
                f.write(data)
            store.move(own, f"{base}/{name}")
            ids, frames, starts, lengths = zip(*bundle.places, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids), pa.array(frames, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=["bundle", "record_id", "frame", "start", "length"])

        bundle = Bundle(frame_bytes)
        for batch in it:
            for page_id, url, payload, revisit, refers_to in zip(*batch.columns, strict=True):
                page_id = page_id.as_py()
                bundle.add(f"{IDENTIFIER}{'' if page_id is None else page_id}", record(page_id, url.as_py(), payload.as_py().encode("utf-8", "surrogatepass"), refers_to.as_py(), revisit.as_py()))
                if bundle.size >= bundle_bytes:
                    yield finish(bundle)
                    bundle = Bundle(frame_bytes)
        if bundle.places:
            yield finish(bundle)

    return staged(typed_pages(pages, least).mapInArrow(run, ENTRY), "warc-index")


class BundleFile:
    """A bundle in the archive's folder, of which only the parts asked for are read."""

    def __init__(self, folder: str, name: str) -> None:
        store, base = _store(folder)
        self.file = store.open_input_file(f"{base}/{name}")
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        width = 12 if flags & 0x80 else 8
        seek = self._at(size - 9 - width * n - 8, width * n + 17)
        self.frames = frames_of(seek)
        self.records_at = sum(c for _, c, _ in self.frames)
        self.seek_at = size - len(seek)

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def records(self) -> list[tuple[str, int, int, int]]:
        return _record_table(self._at(self.records_at, self.seek_at - self.records_at))

    def frame(self, i: int) -> bytes:
        import zstandard

        at, c, d = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self._at(at, c), max_output_size=d)

    def __enter__(self) -> BundleFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """RECORD of every record of the bundles that index names; a revisit's payload is null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda text: int(text) if text else None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in it:
            for name in batch.column(0).to_pylist():
                with BundleFile(folder, name) as bundle:
                    by_frame: dict[int, list[tuple[int, int]]] = {}
                    for _, f, start, length in bundle.records():
                        by_frame.setdefault(f, []).append((start, length))
                    for f, places in by_frame.items():
                        plain = bundle.frame(f)
                        cols: list[list] = [[] for _ in kinds]
                        for start, length in places:
                            r = parse_record(plain[start : start + length])
                            revisit, digest = r["WARC-Type"] == "revisit", r["WARC-Payload-Digest"].removeprefix("sha1:")
                            if not revisit and (base32_sha1(r["payload"]) != digest or len(r["payload"]) != r["payload_bytes"]):
                                raise ValueError(f"the payload of {r['WARC-Record-ID']} in {name} isn't what its header says")
                            row = (number(r["WARC-Record-ID"][len(IDENTIFIER) + 1 : -1]), r["payload_bytes"], digest, r["WARC-Type"], number(r["WARC-Refers-To"][len(IDENTIFIER) + 1 : -1]) if revisit else None, r.get("WARC-Target-URI"), None if revisit else r["payload"])
                            for col, v in zip(cols, row, strict=True):
                                col.append(v)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    names = index.select("bundle").distinct()
    return names.repartition(_readers(spark, names.count()), "bundle").mapInArrow(run, RECORD)


def _readers(spark: SparkSession, bundles: int) -> int:
    """Tasks that read bundles: one for each, up to many to a task."""
    return max(1, min(bundles, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def lookup(spark: SparkSession, folder: str, index: DataFrame, record_ids: DataFrame) -> DataFrame:
    """record_id, data of record_ids(record_id): the frames that hold them are read, no others."""
    wanted = index.join(record_ids.select(F.col("record_id").alias("w")).distinct(), F.col("record_id") == F.col("w"), "left_semi")
    wanted = staged(wanted.select("bundle", "frame", "start", "length", "record_id"), "warc-wanted")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, opened, at, plain = None, None, None, b""
        for batch in it:
            out = []
            for name, frame, start, length, record_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != opened:
                    if bundle is not None:
                        bundle.file.close()
                    bundle, opened, at = BundleFile(folder, name), name, None
                if frame != at:
                    at, plain = frame, bundle.frame(frame)
                out.append((record_id, plain[start : start + length]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["record_id", "data"])

    places = wanted.repartition(_readers(spark, wanted.select("bundle").distinct().count()), "bundle").sortWithinPartitions("bundle", "frame", "start")
    return places.mapInArrow(run, "record_id string, data binary")


def archive_folder(spark: SparkSession) -> str:
    return new_path(spark, "warc")
