"""WARC archives: monolithic writer, gzip normaliser with a sidecar offset index, indexed reader.

The normaliser takes archives that were compressed as one whole-file gzip stream (no random
access), inflates each stream once, rewrites every record as a gzip member of its own and
writes ``<archive>.idx`` beside it: one JSON line per record with offset, length and headers.
The reader seeks to each indexed member and inflates only that one.

Defined results: a null payload is an empty one; a null url or id writes no such header and
reads back as null; repeated rows are written as often as they occur, and rows that repeat the
responding page's id are responses too; an empty table writes no archive and reads back empty;
columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.llm.common import delete_path, frugal, materialise, open_fs, scratch_path

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
BROADCAST_ROWS = 100_000
WARC_DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20

MANIFEST = "archive string, records long, bytes long"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "target_uri string, archive string, offset long, length long, payload_ok boolean"
)


def plan_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, refers_to) of every page that revisits another.

    Payloads are grouped by digest and length with map-side combination, so a payload that a
    third of the pages share is one row per task before the shuffle.
    """
    slim = pages.select(
        "page_id",
        F.sha1(F.coalesce("html", F.lit(""))).alias("payload_digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"),
    ).where(F.col("payload_bytes") >= min_bytes)
    owners = (
        slim.groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return (
        slim.join(owners, ["payload_digest", "payload_bytes"])
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "payload_digest", "payload_bytes", "refers_to")
        .distinct()
    )


def _clean(value: str) -> str:
    """A header value: control characters and blanks are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 0x20 or ord(c) == 0x7F else c for c in value)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed WARC/1.1 record; with ``refers_to``, a revisit without the payload."""
    digest = hashlib.sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: {_record_id(page_id, digest.hexdigest())}")
    head.append(f"WARC-Date: {WARC_DATE}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(digest.digest()).decode())
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {_record_id(refers_to, digest.hexdigest())}")
        head.append(f"WARC-Refers-To-Page-ID: {refers_to}")
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _AtomicFile:
    """Written under a name of this attempt, then moved, so that a retried task leaves one file."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = open_fs(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def write_monolithic(
    pages: DataFrame, revisits: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES,
    broadcast_rows: int = BROADCAST_ROWS, level: int = 6,
) -> DataFrame:
    """Write every page into archives that are one gzip stream each; returns their manifest.

    Payloads stay in the partition that read them while the counted list of revisits fits the
    broadcast bound; beyond it, pages and revisits meet in a shuffled join.
    """
    spark = pages.sparkSession
    revisits = materialise(revisits, "warc-revisits")
    small = revisits.count() <= broadcast_rows
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    r = revisits.select(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest"), "refers_to")
    joined = rows.join(
        F.broadcast(r) if small else r,
        F.col("page_id").eqNullSafe(F.col("r_page")) & (F.sha1("payload") == F.col("r_digest")),
        "left",
    ).select("page_id", "url", "payload", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        made: list[tuple[str, int, int]] = []
        file = gz = None
        records = raw = 0

        def close() -> None:
            file.write(gz.flush())
            file.close()
            made.append((file.uri, records, file.size))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    file = _AtomicFile(f"{folder}/part-{part:06d}-{len(made):04d}.warc.gz")
                    gz, records, raw = zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                record = build_record(page_id, url, payload, refers_to)
                file.write(gz.compress(record))
                records, raw = records + 1, raw + len(record)
                if raw >= archive_bytes:
                    close()
                    file = None
        if file is not None:
            close()
        yield _manifest(made)

    return materialise(joined.mapInArrow(frugal(write), MANIFEST), "warc-manifest")


def _manifest(made: list[tuple[str, int, int]]) -> pa.RecordBatch:
    names, counts, sizes = zip(*made) if made else ((), (), ())
    return pa.record_batch(
        [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
        names=["archive", "records", "bytes"],
    )


def inflated(stream) -> Iterator[bytes]:
    """Pieces of what a gzip file of one or many members holds, read once from start to end."""
    gz, within = zlib.decompressobj(31), False
    while piece := stream.read(READ_BYTES):
        while piece:
            within = True
            if data := gz.decompress(piece):
                yield data
            piece = gz.unused_data
            if gz.eof:
                gz, within = zlib.decompressobj(31), False
    if within:
        raise ValueError("truncated gzip stream")


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, head bytes, block bytes) of every record of an inflated archive."""
    buffer = bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        at, seen = -1, 0
        while at < 0:
            at = buffer.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(buffer)
            if at < 0 and not fill(seen + 1):
                if bytes(buffer).strip():
                    raise ValueError("truncated WARC header")
                return
        head = bytes(buffer[: at + 4])
        headers = parse_headers(head)
        end = at + 4 + int(headers["content-length"])
        if not fill(end + 4) or buffer[end : end + 4] != b"\r\n\r\n":
            raise ValueError("truncated WARC record")
        yield headers, head, bytes(buffer[at + 4 : end])
        del buffer[: end + 4]


def parse_headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    pairs = (line.split(":", 1) for line in lines if line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def normalise_archive(source: str, target: str, level: int = 6) -> tuple[int, int]:
    """Rewrite one archive member by member and write its index; returns (records, bytes)."""
    fs, path = open_fs(source)
    out, idx, records = _AtomicFile(target), _AtomicFile(f"{target}.idx"), 0
    with fs.open_input_stream(path, compression=None) as stream:
        for headers, head, block in split_records(inflated(stream)):
            gz, offset = zlib.compressobj(level, zlib.DEFLATED, 31), out.size
            out.write(gz.compress(head) + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush())
            line = {"offset": offset, "length": out.size - offset}
            line |= {k: headers[h] for k, h in (("id", "warc-record-id"), ("type", "warc-type"), ("uri", "warc-target-uri"), ("digest", "warc-payload-digest")) if h in headers}
            idx.write(json.dumps(line).encode() + b"\n")
            records += 1
    out.close()
    idx.close()
    return records, out.size


def normalise(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Normalise every archive of a manifest into ``folder``, one archive per step of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        for batch in batches:
            made = []
            for source in batch.column("archive").to_pylist():
                target = f"{folder}/{source.rsplit('/', 1)[-1]}"
                made.append((target, *normalise_archive(source, target, level)))
            yield _manifest(made)

    spread = manifest.repartition(_tasks(manifest), "archive")
    return materialise(spread.mapInArrow(frugal(run), MANIFEST), "warc-normalised")


def _tasks(df: DataFrame) -> int:
    return max(1, 2 * df.sparkSession.sparkContext.defaultParallelism)


def read_record(head_and_block: bytes) -> tuple:
    """(page_id, payload bytes, digest hex, type, refers_to, uri, digest fits) of a record."""
    headers, _, block = next(split_records(iter([head_and_block])))
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = headers["warc-type"]
    page, refers = headers.get("warc-page-id"), headers.get("warc-refers-to-page-id")
    ok = kind == "revisit" or (len(payload) == length and hashlib.sha1(payload).hexdigest() == digest)
    return (int(page) if page else None, length, digest, kind, int(refers) if refers else None, headers.get("warc-target-uri"), ok)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of normalised archives, read member by member at the offsets of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                fs, path = open_fs(archive)
                with fs.open_input_stream(f"{path}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(path) as f:
                    for start in range(0, len(index), 4096):
                        rows = []
                        for line in index[start : start + 4096]:
                            f.seek(line["offset"])
                            member = zlib.decompress(f.read(line["length"]), 31)
                            page, size, digest, kind, refers, uri, ok = read_record(member)
                            rows.append((page, size, digest, kind, refers, uri, archive, line["offset"], line["length"], ok))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORD_TYPES)], names=_RECORD_NAMES)

    return manifest.repartition(_tasks(manifest), "archive").mapInArrow(frugal(run), RECORDS)


_RECORD_NAMES = [x.strip().split(" ")[0] for x in RECORDS.split(",")]
_RECORD_TYPES = [
    {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.strip().split(" ")[1]] for x in RECORDS.split(",")
]


def warc_roundtrip(spark: SparkSession, pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write pages monolithically, normalise the archives, and read the normalised ones back.

    Raises if a response's payload, read back, doesn't have its recorded digest.
    """
    folder = folder or scratch_path(spark, "warc")
    raw = write_monolithic(pages, plan_revisits(pages), f"{folder}/monolithic", **options)
    done = normalise(raw, f"{folder}/records")
    delete_path(spark, f"{folder}/monolithic")
    records = read_archives(done)
    return records.withColumn("payload_digest", F.expr("if(payload_ok, payload_digest, raise_error('payload digest does not fit'))"))
