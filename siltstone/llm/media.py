"""Media columns: Netpbm and BMP to numpy arrays, area resize, NPY tiles, difference hashes.

An image is a uint8 (or, beyond 255 levels, uint16) array [height, width] or
[height, width, 3]. Resizing averages exact areas: the integral image gives
any axis-parallel box sum in four looks, fractional borders included.

Edge cases: a null or undecodable image has null results and an error text;
images with fewer samples than stated are undecodable; empty texts are one row
of 64 zero samples; equal inputs have equal outputs; extra columns pass
through.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.batches import append_columns, text_bytes

ROW = 64


class MediaError(ValueError):
    pass


# -- Netpbm ----------------------------------------------------------------


def _numbers(raw: bytes, at: int, count: int) -> tuple[list[int], int]:
    """The next ``count`` decimal numbers of a header, comments skipped, and where they end."""
    out = []
    while len(out) < count:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at] == 35):
            at = raw.find(b"\n", at) + 1 or len(raw) if raw[at] == 35 else at + 1
        end = at
        while end < len(raw) and 48 <= raw[end] <= 57:
            end += 1
        if end == at:
            raise MediaError("a number is missing in the header")
        out.append(int(raw[at:end]))
        at = end
    return out, at


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6. Bitmaps become 0 (black) and 255."""
    kind = raw[:2]
    if len(raw) < 2 or kind[:1] != b"P" or not 49 <= kind[1] <= 54:
        raise MediaError("not a Netpbm file")
    k = kind[1] - 48
    (width, height, *rest), at = _numbers(raw, 2, 2 if k in (1, 4) else 3)
    levels = rest[0] if rest else 1
    if not (width and height and 0 < levels < 65536):
        raise MediaError("bad size or depth")
    shape = (height, width, 3) if k in (3, 6) else (height, width)
    n = int(np.prod(shape))
    if k <= 3:
        body = b"\n".join(line.split(b"#")[0] for line in raw[at:].split(b"\n"))
        items = [c - 48 for c in body if c in b"01"] if k == 1 else [int(x) for x in body.split()]
        if len(items) < n:
            raise MediaError("too few samples")
        image = np.array(items[:n]).reshape(shape)
    else:
        body = memoryview(raw)[at + 1 :]
        line = -(-width // 8) if k == 4 else 0
        kind = np.dtype(">u2") if levels > 255 else np.dtype(np.uint8)
        if len(body) < (height * line if k == 4 else n * kind.itemsize):
            raise MediaError("too few samples")
        if k == 4:
            image = np.unpackbits(np.frombuffer(body, np.uint8, height * line).reshape(height, line), axis=1)[:, :width]
        else:
            image = np.frombuffer(body, kind, n).reshape(shape)
    if k in (1, 4):
        return ((1 - image) * 255).astype(np.uint8)
    if image.size and image.max() > levels:
        raise MediaError("a sample is over the stated maximum")
    return image.astype(np.uint16 if levels > 255 else np.uint8)


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 or P6."""
    height, width = image.shape[:2]
    levels = 65535 if image.dtype == np.uint16 else 255
    head = f"P{6 if image.ndim == 3 else 5}\n{width} {height}\n{levels}\n".encode()
    return head + np.ascontiguousarray(image.astype(">u2") if levels > 255 else image).tobytes()


# -- BMP -------------------------------------------------------------------


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed 1, 4, 8, 24 or 32 bits a pixel, the last with masks of whole bytes too; a grey palette gives [height, width]."""
    if len(raw) < 54 or raw[:2] != b"BM":
        raise MediaError("not a BMP file")
    start, head = struct.unpack_from("<II", raw, 10)
    if head < 40:
        raise MediaError("header form not supported")
    width, height, _, depth, packed, _, _, _, used = struct.unpack_from("<iiHHIIiiI", raw, 18)
    if packed not in (0, 3) or depth not in (1, 4, 8, 24, 32) or width <= 0 or height == 0 or (packed == 3 and depth != 32):
        raise MediaError("compression or depth not supported")
    line = (width * depth + 31) // 32 * 4
    rows = abs(height)
    if len(raw) < start + line * rows:
        raise MediaError("too few samples")
    body = np.frombuffer(raw, np.uint8, line * rows, start).reshape(rows, line)
    body = body[::-1] if height > 0 else body
    if depth >= 24:
        order = [2, 1, 0]
        if packed == 3:
            masks = struct.unpack_from("<III", raw, 54) if len(raw) >= 66 else ()
            order = [m.bit_length() // 8 - 1 for m in masks]
            if [255 << 8 * max(k, 0) for k in order] != [*masks]:
                raise MediaError("colour masks that aren't whole bytes")
        return np.ascontiguousarray(body[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, order])
    colours = used or 1 << depth
    if len(raw) < 14 + head + 4 * colours:
        raise MediaError("palette is cut off")
    palette = np.frombuffer(raw, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
    index = body if depth == 8 else np.unpackbits(body, axis=1) if depth == 1 else np.stack([body >> 4, body & 15], 2).reshape(rows, -1)
    index = index[:, :width]
    if index.size and index.max() >= colours:
        raise MediaError("a sample is outside the palette")
    image = palette[index]
    grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    return np.ascontiguousarray(image[:, :, 0] if grey else image)


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


# -- resize, hash, tiles ---------------------------------------------------


def _cut(integral: np.ndarray, edges: np.ndarray, axis: int) -> np.ndarray:
    """The integral image at fractional positions along one axis; between grid points it is linear."""
    low = np.minimum(edges.astype(np.int64), integral.shape[axis] - 2)
    part = edges - low
    part = part.reshape((-1, *[1] * (integral.ndim - axis - 1)))
    return np.take(integral, low, axis) * (1 - part) + np.take(integral, low + 1, axis) * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, as float64."""
    rows, cols = image.shape[:2]
    # rows are integrated first and cut at once, so that only height + 1 lines stay
    down = np.zeros((rows + 1, *image.shape[1:]))
    np.cumsum(image, axis=0, out=down[1:])
    down = _cut(down, np.linspace(0, rows, height + 1), 0)
    both = np.zeros((height + 1, cols + 1, *image.shape[2:]))
    np.cumsum(down, axis=1, out=both[:, 1:])
    both = _cut(both, np.linspace(0, cols, width + 1), 1)
    box = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return box * (height * width / (rows * cols))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hex: is a pixel of the 8 by 9 reduction darker than its right neighbour?"""
    grey = image if image.ndim == 2 else image.mean(2)
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """NPY file of the image reduced to side by side, in its own type."""
    out = io.BytesIO()
    np.save(out, np.round(area_resize(image, side, side)).astype(image.dtype))
    return out.getvalue()


def media_columns(images: DataFrame, media_col: str = "media", side: int = 32) -> DataFrame:
    """height, width, channels, tile (NPY bytes), dhash and media_error of each encoded image."""
    kinds = [("height", T.IntegerType()), ("width", T.IntegerType()), ("channels", T.IntegerType()), ("tile", T.BinaryType()), ("dhash", T.StringType()), ("media_error", T.StringType())]
    new = {k for k, _ in kinds}
    keep = [f for f in images.schema.fields if f.name.lower() not in new or f.name == media_col]
    schema = T.StructType([*keep, *[T.StructField(k, t) for k, t in kinds]])
    names = [f.name for f in keep]

    def one(raw: bytes | None):
        if raw is None:
            return (None,) * 6
        try:
            image = decode(raw)
        except MediaError as e:
            return (None,) * 5 + (str(e),)
        return (*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, npy_tile(image, side), difference_hash(image), None)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # decoded images of 64 rows at a time
                part = batch.slice(at, 64)
                made = list(zip(*[one(x) for x in part.column(media_col).to_pylist()]))
                types = [pa.int32()] * 3 + [pa.binary(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(m, t) for m, t in zip(made, types)], names=names + [k for k, _ in kinds])

    return images.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


# -- texts as images -------------------------------------------------------


def padded_payload(text: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of ROW."""
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, b"\0")


def text_media(docs: DataFrame, text_col: str = "text", with_media: bool = True, side: int = 32) -> DataFrame:
    """Each text as a lossless grey image of ROW samples a line, and what is read back from the stored form.

    New columns: n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (difference hash), tile_sha256 (of the NPY
    tile of side by side samples), and media if with_media.
    """
    kinds = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("tile_sha256", T.StringType())]
    kinds += [("media", T.BinaryType())] * with_media

    def one(text: bytes):
        media = encode_netpbm(np.frombuffer(padded_payload(text), np.uint8).reshape(-1, ROW))
        image = decode(media)
        payload = image.tobytes()
        row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(npy_tile(image, side)).hexdigest())
        return (*row, media) if with_media else row

    def make():
        def run(part: pa.RecordBatch):
            return [pa.array(c) for c in zip(*[one(t) for t in text_bytes(part.column(text_col))])]

        return run

    return append_columns(docs, text_col, [T.StructField(k, t) for k, t in kinds], make)
