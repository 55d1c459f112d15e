"""Rasters (width, height, rgba) in columns: PNG, edits and comparison."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.udf import scalar

RASTER = "struct<width:int,height:int,rgba:binary>"
_ARROW = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary())])
#: Pixels that are edited at once, beyond those of one image.
_PIXELS = 1 << 17
_MAGIC = b"\x89PNG\r\n\x1a\n"


def pixels(width: int, height: int, rgba: bytes) -> np.ndarray:
    if len(rgba) != width * height * 4:
        raise ValueError(f"{width} x {height} pixels need {width * height * 4} bytes, got {len(rgba)}")
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)


def raster(a: np.ndarray) -> dict:
    return {"width": a.shape[1], "height": a.shape[0], "rgba": np.ascontiguousarray(a, np.uint8).tobytes()}


def _of(r) -> np.ndarray:
    return pixels(r["width"], r["height"], bytes(r["rgba"])).copy()


def _parts(images: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Whether a row has an image, widths, heights and bytes."""
    width, height, rgba = (c.cast(t.type) for c, t in zip(images.flatten(), _ARROW, strict=True))
    given = np.asarray(images.is_valid())
    if not all((np.asarray(c.is_valid()) == given).all() for c in (width, height, rgba)):
        raise ValueError("an image needs width, height and bytes")
    return given, np.asarray(width.fill_null(0)), np.asarray(height.fill_null(0)), rgba


def _stack(rgba: pa.Array, rows: np.ndarray, width: int, height: int) -> np.ndarray:
    taken = rgba.take(pa.array(rows))
    sizes = np.diff(offsets := np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1])
    for n in sizes[sizes != width * height * 4][:1].tolist():
        raise ValueError(f"{width} x {height} pixels need {width * height * 4} bytes, got {n}")
    data = taken.buffers()[2] if sizes.any() else None
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(len(rows), height, width, 4).copy()


def _alike(given: np.ndarray, width: np.ndarray, height: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Rows with images of one size, as many as are edited at once."""
    rows = np.flatnonzero(given)
    sizes = width[rows].astype(np.int64) << 32 | height[rows]
    for size in np.unique(sizes).tolist():
        same, w, h = rows[sizes == size], size >> 32, size & 0xFFFFFFFF
        step = max(1, _PIXELS // max(1, w * h))
        for i in range(0, len(same), step):
            yield same[i : i + step], w, h


def _rasters(stack: np.ndarray) -> pa.Array:
    n, height, width, _ = stack.shape
    data = pa.py_buffer(np.ascontiguousarray(stack, np.uint8).tobytes())
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(height * width * 4)
    rgba = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), data])
    return pa.StructArray.from_arrays([pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, height, np.int32)), rgba], fields=list(_ARROW))


def edited(images: pa.Array, fn: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """fn over stacks (images, height, width, 4) of images of one size; null in, null out."""
    given, width, height, rgba = _parts(images)
    out, at = [], np.zeros(len(images), np.int64)
    done = 0
    for rows, w, h in _alike(given, width, height):
        out.append(_rasters(fn(_stack(rgba, rows, w, h))))
        at[rows] = np.arange(done, done + len(rows))
        done += len(rows)
    return pa.concat_arrays(out).take(pa.array(at, mask=~given)) if out else pa.nulls(len(images), _ARROW)


def png_bytes(a: np.ndarray) -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), a.reshape(a.shape[0], -1)], 1)
    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """Eight-bit grey, grey and alpha, RGB and RGBA, not interlaced."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", b""
    while at < len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + n]
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 4: 2, 2: 3, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("unsupported PNG colour type or depth")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(width, channels), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for i in range(len(line)):
                a, b = int(line[i - channels]) if i >= channels else 0, int(above[i])
                if kind == 3:
                    p = (a + b) // 2
                else:
                    c = int(above[i - channels]) if i >= channels else 0
                    p = min((a, b, c), key=lambda v, t=a + b - c: abs(t - v))
                line[i] = (int(line[i]) + p) & 255
        out[y] = above = line
    px = out.reshape(height, width, channels)
    alpha = px[..., -1:] if channels in (2, 4) else np.full((height, width, 1), 255, np.uint8)
    rgb = px[..., :3] if channels > 2 else np.repeat(px[..., :1], 3, 2)
    return np.concatenate([rgb, alpha], 2)


def png_decode(data: Column) -> Column:
    return scalar(lambda b: raster(png_pixels(bytes(b))), RASTER)(data)


def png_encode(image: Column) -> Column:
    return scalar(lambda r: png_bytes(_of(r)), "binary")(image)


def resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Triangle filter, widened when the image shrinks; a is one image or a stack of them."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = n / m
        support = max(1.0, scale)
        centre = (np.arange(m) + 0.5) * scale
        w = np.maximum(0, 1 - np.abs((np.arange(n)[None, :] + 0.5 - centre[:, None]) / support))
        return w / w.sum(1, keepdims=True)

    f = np.einsum("yh,...hwc->...ywc", weights(a.shape[-3], height), a.astype(np.float64))
    f = np.einsum("xw,...ywc->...yxc", weights(a.shape[-2], width), f)
    return np.clip(np.round(f), 0, 255).astype(np.uint8)


def _edit(fn):
    """fn of stacks of images, over Arrow batches."""

    def run(images: pa.Array) -> pa.Array:
        return edited(images, fn)

    return F.arrow_udf(run, RASTER)


def resize(image: Column, width: int, height: int) -> Column:
    return _edit(lambda a: resized(a, width, height))(image)


def crop(image: Column, x: int, y: int, width: int, height: int) -> Column:
    return _edit(lambda a: a[..., y : y + height, x : x + width, :])(image)


def flip(image: Column, horizontal: bool, vertical: bool) -> Column:
    return _edit(lambda a: a[..., :: -1 if vertical else 1, :: -1 if horizontal else 1, :])(image)


def rotate(image: Column, degrees: int) -> Column:
    """Clockwise, by multiples of 90."""
    if degrees % 90:
        raise ValueError("rotation must be a multiple of 90 degrees")
    return _edit(lambda a: np.rot90(a, -degrees // 90, (-3, -2)))(image)


def _colours(a: np.ndarray, fn) -> np.ndarray:
    a[..., :3] = np.clip(np.round(fn(a[..., :3].astype(np.float64))), 0, 255)
    return a


def greyscale(image: Column) -> Column:
    return _edit(lambda a: _colours(a, lambda c: np.repeat((c @ np.array([0.2126, 0.7152, 0.0722]))[..., None], 3, -1)))(image)


def invert(image: Column) -> Column:
    return _edit(lambda a: _colours(a, lambda c: 255 - c))(image)


def brightness(image: Column, value: float) -> Column:
    """value from -1 to 1 as a share of the full range."""
    return _edit(lambda a: _colours(a, lambda c: c + 255 * value))(image)


def contrast(image: Column, value: float) -> Column:
    """value from -1 to 1; away from or towards the middle."""
    return _edit(lambda a: _colours(a, lambda c: ((c / 255 - 0.5) * (1 + value) ** 2 + 0.5) * 255))(image)


def composed(a: np.ndarray, b: np.ndarray, x: int, y: int) -> np.ndarray:
    """b over a at (x, y)."""
    x0, y0, x1, y1 = max(0, x), max(0, y), min(a.shape[1], x + b.shape[1]), min(a.shape[0], y + b.shape[0])
    if x0 < x1 and y0 < y1:
        top, under = b[y0 - y : y1 - y, x0 - x : x1 - x] / 255, a[y0:y1, x0:x1] / 255
        alpha = top[..., 3:] + under[..., 3:] * (1 - top[..., 3:])
        rgb = (top[..., :3] * top[..., 3:] + under[..., :3] * under[..., 3:] * (1 - top[..., 3:])) / np.maximum(alpha, 1e-9)
        a[y0:y1, x0:x1] = np.round(np.concatenate([rgb, alpha], 2) * 255)
    return a


def composite(image: Column, over: Column, x: int, y: int) -> Column:
    return scalar(lambda r, s: raster(composed(_of(r), _of(s), x, y)), RASTER)(image, over)


# The weights of luma and of the two chroma axes, and of their squares in a difference.
_YIQ = np.array([[0.29889531, 0.58662247, 0.11448223], [0.59597799, -0.27417610, -0.32180189], [0.21147017, -0.52261711, 0.31114694]])
_SHARES = np.array([0.5053, 0.299, 0.1957])
_LARGEST = 35215.0


def _over_white(a: np.ndarray) -> np.ndarray:
    return 255 + (a[..., :3].astype(np.float64) - 255) * (a[..., 3:] / 255)


def _along(c: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Term by term, so that equal colours give equal numbers wherever they are."""
    return c[..., 0] * axis[0] + c[..., 1] * axis[1] + c[..., 2] * axis[2]


#: Where neighbours are, (x, y), by columns: of equally dark or bright ones the first counts.
_NEAR = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])


def differing(a: np.ndarray, b: np.ndarray, threshold: float = 0.1, include_aa: bool = False) -> np.ndarray:
    """Where two images of one size, or stacks of them, differ in colour, leaving out anti-aliased edges."""
    if a.shape != b.shape:
        raise ValueError("image sizes do not match")
    shape, a, b = a.shape[:-1], a.reshape(-1, *a.shape[-3:]), b.reshape(-1, *b.shape[-3:])
    out = np.zeros(a.shape[:-1], bool)
    unlike = np.flatnonzero((a != b).reshape(len(a), -1).any(1))
    if len(unlike):
        a, b = a[unlike], b[unlike]
        p, q = _over_white(a), _over_white(b)
        y, i, j = (_along(p, axis) - _along(q, axis) for axis in _YIQ)
        found = _SHARES[0] * y * y + _SHARES[1] * i * i + _SHARES[2] * j * j > _LARGEST * threshold * threshold
        found &= (a != b).any(-1)
        flat = None if include_aa else _flat(a) & _flat(b)
        if flat is not None and flat.any():
            lumas = [np.pad(_along(c, _YIQ[0]), ((0, 0), (1, 1), (1, 1)), constant_values=np.nan) for c in (p, q)]
            at = np.nonzero(found)
            for k in range(0, len(at[0]), _PIXELS):
                part = tuple(x[k : k + _PIXELS] for x in at)
                found[part] = ~(_edge(lumas[0], flat, *part) | _edge(lumas[1], flat, *part))
        out[unlike] = found
    return out.reshape(shape)


def _flat(a: np.ndarray) -> np.ndarray:
    """Whether more than two neighbours (the border counts as one) of each pixel are of the same colour."""
    colour = np.ascontiguousarray(a).view(np.uint32)[..., 0]
    h, w = colour.shape[1:]
    same = np.zeros(colour.shape, np.int8)
    same[:, [0, -1]] = 1
    same[:, :, [0, -1]] = 1
    for i, j in _NEAR.tolist():
        own, other = ((slice(None), slice(max(0, -s * j), h - max(0, s * j)), slice(max(0, -s * i), w - max(0, s * i))) for s in (1, -1))
        same[own] += colour[own] == colour[other]
    return same > 2


def _edge(luma: np.ndarray, flat: np.ndarray, n: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether pixels of images n lie between a darker and a brighter one of which one is in a flat area of both images; luma has a border of NaN."""
    own, (h, w) = luma[n, y + 1, x + 1], flat.shape[1:]
    equal = ((y == 0) | (y == h - 1) | (x == 0) | (x == w - 1)).astype(np.int8)
    least, most, first, last = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), np.int8), np.zeros(len(n), np.int8)
    for k, (i, j) in enumerate(_NEAR.tolist()):
        step = own - luma[n, y + 1 + j, x + 1 + i]
        equal += step == 0
        for better, best, where in ((step < least, least, first), (step > most, most, last)):
            best[better], where[better] = step[better], k
    out = (equal <= 2) & (least < 0) & (most > 0)
    n, y, x, first, last = n[out], y[out], x[out], first[out], last[out]
    out[out] = flat[n, y + _NEAR[first, 1], x + _NEAR[first, 0]] | flat[n, y + _NEAR[last, 1], x + _NEAR[last, 0]]
    return out


def counted(first: pa.Array, second: pa.Array, threshold: float, include_aa: bool) -> pa.Array:
    one, other = _parts(first), _parts(second)
    given = one[0] & other[0]
    if (given & ((one[1] != other[1]) | (one[2] != other[2]))).any():
        raise ValueError("image sizes do not match")
    out = np.zeros(len(first), np.int64)
    for rows, w, h in _alike(given, one[1], one[2]):
        out[rows] = differing(_stack(one[3], rows, w, h), _stack(other[3], rows, w, h), threshold, include_aa).sum((1, 2))
    return pa.array(out, mask=~given)


def count_diff(first: Column, second: Column, threshold: float = 0.1, include_aa: bool = False) -> Column:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return counted(a, b, threshold, include_aa)

    return F.arrow_udf(run, "long")(first, second)


def diff_image(first: Column, second: Column, threshold: float = 0.1) -> Column:
    """The first image faded, with what differs in red."""

    def run(r, s):
        a, b = _of(r), _of(s)
        where = differing(a, b, threshold)
        grey = 255 + (_over_white(a) @ _YIQ[0] - 255) * 0.1
        out = np.dstack([np.round(grey)] * 3 + [np.full(a.shape[:2], 255)]).astype(np.uint8)
        out[where] = (255, 0, 0, 255)
        return raster(out)

    return scalar(run, RASTER)(first, second)
