"""Pixel kernels over numpy arrays (height, width, 3 or 4) of uint8, for use inside Arrow batches."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Channel means and deviations of the embedding model's input.
CHANNEL_MEAN = np.array([0.48145466, 0.4578275, 0.40821073], np.float32)
CHANNEL_STD = np.array([0.26862954, 0.26130258, 0.27577711], np.float32)


def _round8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def _weights(size: int, out: int, kernel, support: float, antialias: bool) -> tuple[np.ndarray, np.ndarray]:
    """(source index, weight) of each output place, half-pixel centres, edges repeated."""
    scale = size / out
    wide = max(scale, 1.0) if antialias else 1.0
    centre = (np.arange(out) + 0.5) * scale - 0.5
    reach = int(np.ceil(support * wide))
    offsets = np.arange(-reach, reach + 1)
    at = np.floor(centre)[:, None].astype(int) + offsets[None, :]
    w = kernel((at - centre[:, None]) / wide)
    return np.clip(at, 0, size - 1), w / w.sum(1, keepdims=True)


def _resample(image: np.ndarray, width: int, height: int, kernel, support: float, antialias: bool) -> np.ndarray:
    x, wx = _weights(image.shape[1], width, kernel, support, antialias)
    y, wy = _weights(image.shape[0], height, kernel, support, antialias)
    rows = np.einsum("hwkc,wk->hwc", image.astype(np.float64)[:, x], wx)
    return np.einsum("hkwc,hk->hwc", rows[y], wy)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def _catmull_rom(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    near, far = 1.5 * x**3 - 2.5 * x**2 + 1, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def bilinear(image: np.ndarray, width: int, height: int) -> np.ndarray:
    return _round8(_resample(image, width, height, _triangle, 1, False))


def bicubic(image: np.ndarray, width: int, height: int) -> np.ndarray:
    return _round8(_resample(image, width, height, _catmull_rom, 2, False))


def lanczos(image: np.ndarray, width: int, height: int) -> np.ndarray:
    return _round8(_resample(image, width, height, _lanczos3, 3, True))


def score_input(image: np.ndarray, side: int = 224) -> np.ndarray:
    """(1, side, side, 3) in [-1, 1]."""
    return (bilinear(image, side, side).astype(np.float32) / 127.5 - 1.0)[None]


def embedding_crop(image: np.ndarray, edge: int = 256, side: int = 224) -> np.ndarray:
    """Shorter edge to ``edge``, then the centre."""
    h, w = image.shape[:2]
    scale = edge / min(w, h)
    nw, nh = int(np.floor(w * scale + 0.5)), int(np.floor(h * scale + 0.5))
    x, y = (nw - side) // 2, (nh - side) // 2
    return bicubic(image, nw, nh)[y : y + side, x : x + side]


def embedding_input(image: np.ndarray) -> np.ndarray:
    """(1, 3, 224, 224), normalised by channel."""
    x = (embedding_crop(image).astype(np.float32) / 255.0 - CHANNEL_MEAN) / CHANNEL_STD
    return np.transpose(x, (2, 0, 1))[None]


def tone_table(exposure_ev: float) -> np.ndarray:
    """8-bit value of every 16-bit linear sample; the constants are those of scalars.tone_value."""
    x = np.arange(65536) / 65535.0 * 2.0**exposure_ev
    y = np.clip((x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14), 0.0, 1.0)
    return _round8(np.where(y <= 0.0031308, 12.92 * y, 1.055 * y ** (1 / 2.4) - 0.055) * 255.0)


def resize_long_edge(image: np.ndarray, long_edge: int | None, downscale_only: bool = False) -> np.ndarray:
    if long_edge is None:
        return image
    if long_edge < 16:
        raise ValueError("the long edge is at least 16")
    h, w = image.shape[:2]
    scale = long_edge / max(w, h)
    if downscale_only:
        scale = min(scale, 1.0)
    if scale == 1.0:
        return image
    return bicubic(image, max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5)))


def shadow_ramp(height: int, fraction: float) -> np.ndarray:
    if not np.isfinite(fraction) or not 0 < fraction <= 1:
        return np.zeros(0, np.uint8)
    band = int(height * fraction + 0.5)
    return _round8(np.arange(band) / max(band - 1, 1) * 255.0)


def shade_bottom(image: np.ndarray, fraction: float) -> np.ndarray:
    ramp = shadow_ramp(image.shape[0], fraction)
    out = image.copy()
    if len(ramp):
        keep = 1.0 - ramp.astype(float) / 255.0
        out[-len(ramp) :, :, :3] = _round8(image[-len(ramp) :, :, :3] * keep[:, None, None])
    return out


def premultiply(rgba: np.ndarray) -> np.ndarray:
    out = rgba.astype(float)
    out[..., :3] *= out[..., 3:] / 255.0
    return _round8(out)


def unpremultiply(rgba: np.ndarray) -> np.ndarray:
    """RGB of premultiplied RGBA; black where nothing is."""
    a = rgba[..., 3:].astype(float)
    return _round8(np.where(a > 0, rgba[..., :3] * 255.0 / np.maximum(a, 1.0), 0.0))


def blend(image: np.ndarray, mark: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """The image with an RGBA mark scaled to a box and laid over it; parts outside are left out."""
    m = lanczos(premultiply(mark), width, height).astype(float)
    out = image.copy()
    x0, y0 = max(x, 0), max(y, 0)
    x1, y1 = min(x + width, image.shape[1]), min(y + height, image.shape[0])
    if x0 < x1 and y0 < y1:
        part = m[y0 - y : y1 - y, x0 - x : x1 - x]
        below = out[y0:y1, x0:x1, :3].astype(float)
        out[y0:y1, x0:x1, :3] = np.clip(part[..., :3] + below * (1.0 - part[..., 3:] / 255.0), 0, 255).astype(np.uint8)
    return out


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """Undo an EXIF orientation 1..8."""
    return {
        1: lambda a: a, 2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1],
        5: lambda a: a.swapaxes(0, 1), 6: lambda a: np.rot90(a, -1), 7: lambda a: np.rot90(a, 2).swapaxes(0, 1), 8: lambda a: np.rot90(a, 1),
    }.get(orientation, lambda a: a)(image)


def jpeg_orientation(data: bytes) -> int | None:
    """Orientation of the EXIF segment of a JPEG, if it has a valid one."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xDA or size < 2:
            return None
        body = data[at + 4 : at + 2 + size]
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            return tiff_orientation(body[6:])
        at += 2 + size
    return None


def tiff_orientation(tiff: bytes) -> int | None:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return None
    mark, start = struct.unpack(order + "HI", tiff[2:8])
    if mark != 42 or start + 2 > len(tiff):
        return None
    (n,) = struct.unpack_from(order + "H", tiff, start)
    for i in range(n):
        at = start + 2 + 12 * i
        if at + 12 > len(tiff):
            return None
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at)
        if tag == 0x0112 and kind == 3 and count >= 1:
            (value,) = struct.unpack_from(order + "H", tiff, at + 8)
            return value if 1 <= value <= 8 else None
    return None


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit RGB or RGBA PNG without filters."""
    h, w, c = image.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image).reshape(h, w * c)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """RGBA of an 8-bit RGB or RGBA PNG that isn't interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ValueError("only plain 8-bit RGB and RGBA PNGs")
    w, h, c = head[0], head[1], {2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.int64)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind:
            for x in range(w * c):  # these filters need the bytes on the left
                left = int(line[x - c]) if x >= c else 0
                corner = int(above[x - c]) if x >= c else 0
                up = int(above[x])
                near = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
                line[x] = (line[x] + {1: left, 3: (left + up) // 2, 4: near}[kind]) & 255
        above = line & 255
        out[y] = above
    image = out.reshape(h, w, c)
    return image if c == 4 else np.concatenate([image, np.full((h, w, 1), 255, np.uint8)], axis=2)


def render(image: np.ndarray, long_edge: int | None = None, downscale_only: bool = False, shadow: float = 0.0, marks: list[tuple[np.ndarray, tuple[int, int, int, int]]] = ()) -> bytes:
    """Resize, shade the bottom, lay marks over it, encode. Without work the pixels pass through."""
    out = resize_long_edge(image, long_edge, downscale_only)
    if shadow > 0:
        out = shade_bottom(out, shadow)
    for mark, (x, y, w, h) in marks:
        out = blend(out, mark, x, y, w, h)
    return encode_png(out)
