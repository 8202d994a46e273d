"""EXIF facts of JPEG, TIFF-based and ISO base media (CR3) files, read where the rows are.

Only the headers and directories that lead to a tag are read, never whole files.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lumicat.functions.scalars import WHITE_SPACE

#: Tags of the TIFF and EXIF specifications.
MAKE, MODEL, ORIENTATION, DATE_TIME, WIDTH, HEIGHT, EXIF_DIRECTORY = 0x010F, 0x0110, 0x0112, 0x0132, 0x0100, 0x0101, 0x8769
ORIGINAL_TIME, ORIGINAL_OFFSET, PIXEL_WIDTH, PIXEL_HEIGHT = 0x9003, 0x9011, 0xA002, 0xA003
#: Bytes of the TIFF types that these tags have (ASCII, SHORT, LONG).
TYPE_BYTES = {2: 1, 3: 2, 4: 4}
#: Marks after the byte order of TIFF and of raw formats built on it.
TIFF_MARKS = (b"*\0", b"\0*", b"RO", b"RS", b"U\0")
MAX_ENTRIES, MAX_TEXT = 4096, 4096

FACTS = (
    StructType().add("make", "string").add("model", "string").add("capture_time_unix_seconds", "long")
    .add("width", "integer").add("height", "integer").add("exif_orientation", "integer").add("exif_error", "string")
)
Read = Callable[[int, int], bytes]


class ExifError(ValueError):
    pass


def _directory(read: Read, base: int, at: int, order: str) -> dict[int, int | str]:
    """Tags of one directory; a value that doesn't fit its type is left out."""
    head = read(base + at, 2)
    if len(head) < 2:
        raise ExifError("a directory lies outside the file")
    count = struct.unpack(order + "H", head)[0]
    if count > MAX_ENTRIES:
        raise ExifError("too many tags")
    table = read(base + at + 2, 12 * count)
    tags: dict[int, int | str] = {}
    for k in range(len(table) // 12):
        tag, kind, n = struct.unpack(order + "HHI", table[12 * k : 12 * k + 8])
        size = TYPE_BYTES.get(kind, 0) * n
        if not 0 < size <= MAX_TEXT:
            continue
        value = table[12 * k + 8 : 12 * k + 12]
        raw = value[:size] if size <= 4 else read(base + struct.unpack(order + "I", value)[0], size)
        if len(raw) == size:
            tags[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip(WHITE_SPACE) if kind == 2 else struct.unpack(order + {3: "H", 4: "I"}[kind], raw[: TYPE_BYTES[kind]])[0]
    return tags


def _tiff(read: Read, base: int) -> dict[int, int | str]:
    """Tags of a TIFF header's first directory and of the EXIF directory that it names."""
    head = read(base, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or head[2:4] not in TIFF_MARKS:
        raise ExifError("no TIFF header")
    tags = _directory(read, base, struct.unpack(order + "I", head[4:8])[0], order)
    inner = tags.get(EXIF_DIRECTORY)
    return (_directory(read, base, inner, order) if isinstance(inner, int) else {}) | tags


def _jpeg(read: Read) -> dict[int, int | str]:
    at = 2
    while len(head := read(at, 10)) >= 4 and head[0] == 0xFF and head[1] not in (0xD9, 0xDA):
        if head[1] == 0xE1 and head[4:10] == b"Exif\0\0":
            return _tiff(read, at + 10)
        at += 2 + struct.unpack(">H", head[2:4])[0]
    raise ExifError("no EXIF segment")


def _boxes(read: Read, at: int, end: int | None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the contents of each box."""
    while (end is None or at + 8 <= end) and len(head := read(at, 16)) >= 8:
        size, kind, skip = struct.unpack(">I", head[:4])[0], head[4:8], 8
        if size == 1 and len(head) == 16:
            size, skip = struct.unpack(">Q", head[8:])[0], 16
        if size < skip:  # 0: up to the end of the file
            return
        yield kind, at + skip, at + size
        at += size


def _media(read: Read) -> dict[int, int | str]:
    """Tags of a CR3's metadata boxes: CMT1 is the main directory, CMT2 the EXIF directory, each with a TIFF header."""
    tags: dict[int, int | str] = {}
    for kind, start, end in _boxes(read, 0, None):
        for inner, a, b in _boxes(read, start, end) if kind == b"moov" else ():
            for name, c, _ in _boxes(read, a + 16, b) if inner == b"uuid" else ():  # after the box's id
                if name in (b"CMT1", b"CMT2"):
                    tags = _tiff(read, c) | tags
    if not tags:
        raise ExifError("no metadata boxes")
    return tags


def seconds(text: str | None, offset: str | None = None) -> int | None:
    """Unix seconds of an EXIF time, taken as UTC without an offset; None for zero or no time."""
    if not text or not re.fullmatch(r"[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", text):
        return None
    zone = offset if offset and re.fullmatch(r"[+-][0-9]{2}:[0-9]{2}", offset) else "+00:00"
    try:
        when = datetime.strptime(text + zone, "%Y:%m:%d %H:%M:%S%z")
    except ValueError:
        return None
    return int((when - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) or None


def facts(read: Read) -> dict:
    """The columns of FACTS; an error without a make. Sizes must be positive, orientations 1 to 8."""
    head = read(0, 12)
    tags = _jpeg(read) if head[:2] == b"\xff\xd8" else _media(read) if head[4:8] == b"ftyp" else _tiff(read, 0)

    def number(*names: int) -> int | None:
        return next((v for n in names if isinstance(v := tags.get(n), int) and 0 < v < 2**31), None)

    def text(name: int) -> str | None:
        return v if isinstance(v := tags.get(name), str) and v else None

    if text(MAKE) is None:
        raise ExifError("no make")
    turned = number(ORIENTATION)
    return {
        "make": text(MAKE), "model": text(MODEL), "width": number(PIXEL_WIDTH, WIDTH), "height": number(PIXEL_HEIGHT, HEIGHT),
        "capture_time_unix_seconds": seconds(text(ORIGINAL_TIME) or text(DATE_TIME), text(ORIGINAL_OFFSET)), "exif_orientation": turned if turned in range(1, 9) else None,
    }


def with_exif(rows: DataFrame, path: str = "source_path") -> DataFrame:
    """Rows with the EXIF facts of the file each ``path`` names; exif_error says why there are none."""
    at = rows.columns.index(path)
    schema = StructType(rows.schema.fields + FACTS.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(at).to_pylist():
                try:
                    with open(name, "rb") as f:
                        found.append(facts(lambda start, n: f.read(n) if f.seek(start) >= 0 else b""))
                except (OSError, ValueError, struct.error, TypeError) as e:
                    found.append({"exif_error": str(e)})
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            extra = [pa.array([x.get(n) for x in found], k) for n, k in zip(FACTS.names, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return rows.mapInArrow(run, schema)
