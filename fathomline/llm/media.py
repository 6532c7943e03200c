"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles and difference hashes.

Images are decoded to uint8 arrays, area-resized through an integral image, and
written as NPY bytes with a 64-bit difference hash.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_rows, text_bytes

#: Rows of an image that the integral image holds at a time.
BLOCK_ROWS = 16_384


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    height, width, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """24-bit, bottom-up, rows padded to four bytes."""
    height, width, _ = samples.shape
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 0, 0, 0, 0)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + head + rows.tobytes()


_SPACE = rb"(?:[ \t\r\n\v\f]|#[^\r\n]*[\r\n])"


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    fields = 2 if kind in (1, 4) else 3
    head = re.compile(rb"P[1-6]" + (_SPACE + rb"+([0-9]+)") * fields).match(data)
    if not head:
        raise ValueError("bad Netpbm header")
    width, height, top = int(head[1]), int(head[2]), int(head[3]) if fields == 3 else 1
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    at = head.end() + 1
    if not 0 < top < 65536:
        raise ValueError("bad maximum")
    if count > 8 * len(data):  # even packed bits hold no more
        raise ValueError("short image")
    if kind == 1:
        values = np.frombuffer(re.sub(rb"#[^\r\n]*|[^01]", b"", data[head.end() :]), np.uint8)[:count] - 48
    elif kind in (2, 3):
        values = np.array(re.sub(rb"#[^\r\n]*", b"", data[head.end() :]).split()[:count], np.int64)
        if values.size and values.min() < 0:
            raise ValueError("bad sample")
    elif kind == 4:
        stride = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
        values = np.unpackbits(packed, axis=1)[:, :width].reshape(-1)
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at)
    if values.size < count or not count:
        raise ValueError("short image")
    if kind in (1, 4):
        values = (1 - values) * 255  # 1 is black
    elif values.max() > top:
        raise ValueError("sample above the maximum")
    elif top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    shape = (height, width, 3) if channels == 3 else (height, width)
    return values.astype(np.uint8, copy=False).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("this kind of BMP isn't read")
    if start < 14 + head or width * abs(height) > 8 * len(data):
        raise ValueError("short image")
    stride, down = (width * bits + 31) // 32 * 4, height < 0
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    if bits >= 24:
        image = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    else:
        colours = np.frombuffer(data, np.uint8, start - 14 - head, 14 + head)
        colours = colours[: colours.size // 4 * 4].reshape(-1, 4)[:, 2::-1]
        if bits < 8:
            split = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)
            rows = (split << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        image = colours[rows[:, :width]]
    return np.ascontiguousarray(image if down else image[::-1])


def decode(data: bytes) -> np.ndarray:
    """A (height, width) or (height, width, 3) uint8 array; ValueError for other data."""
    try:
        if data[:2] == b"BM":
            return _bmp(data)
        if re.match(rb"P[1-6]", data):
            return _netpbm(data)
    except (struct.error, IndexError, OverflowError) as error:
        raise ValueError(str(error)) from error
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.uint16) @ np.array([77, 150, 29], np.uint16) >> 8).astype(np.uint8)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each cell, from the integral image read at the cells' corners.

    Between pixels the integral is linear, so the corners may fall inside a pixel.
    Only BLOCK_ROWS rows of the integral image exist at a time.
    """
    rows, cols = image.shape
    ys, xs = np.arange(height + 1) * rows / height, np.arange(width + 1) * cols / width
    low = np.minimum(ys.astype(np.int64), rows - 1)
    corners, above = np.zeros((height + 1, cols)), np.zeros(cols, np.int64)
    for at in range(0, rows, BLOCK_ROWS):
        block = image[at : at + BLOCK_ROWS]
        integral = np.vstack([above, above + np.cumsum(block, axis=0, dtype=np.int64)])
        for i in np.flatnonzero((low >= at) & (low < at + len(block))):
            corners[i] = integral[low[i] - at] + (ys[i] - low[i]) * block[low[i] - at]
        above = integral[-1]
    across = np.concatenate([np.zeros((height + 1, 1)), np.cumsum(corners, axis=1)], axis=1)
    left = np.minimum(xs.astype(np.int64), cols - 1)
    at_x = across[:, left] + (xs - left) * (across[:, left + 1] - across[:, left])
    sums = np.diff(np.diff(at_x, axis=0), axis=1)
    return np.clip(np.rint(sums * (height * width / (rows * cols))), 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 reduction is brighter than the one to its left."""
    small = area_resize(grey(image), 8, 9).astype(np.int16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0))
    return out.getvalue()


def image_tiles(df: DataFrame, id_col: str, media_col: str, tile: int = 32) -> DataFrame:
    """Decode a binary column; per row: id, height, width, channels, tile (NPY bytes), dhash, error.

    Null, empty and unreadable data give an error text and nulls elsewhere: headers
    that promise more than the data hold, maxima of 0 or above 65535, samples
    outside 0 to the maximum. Ids of any simple type stay as they are; repeated
    rows give repeated results, and other columns aren't returned.
    """

    def rows(batch: list[dict]) -> list[dict]:
        out = []
        for row in batch:
            try:
                image = decode(row["data"] or b"")
                out.append({"id": row["id"], "height": image.shape[0], "width": image.shape[1], "channels": 1 if image.ndim == 2 else 3, "tile": npy(area_resize(grey(image), tile, tile)), "dhash": difference_hash(image), "error": None})
            except ValueError as error:
                out.append({"id": row["id"], "error": str(error)})
        return out

    kind = df.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, height int, width int, channels int, tile binary, dhash string, error string"
    arrow = pa.schema([("id", to_arrow_type(kind)), *((n, pa.int32()) for n in ("height", "width", "channels")), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])
    return map_rows(df.select(F.col(id_col).alias("id"), F.col(media_col).alias("data")), rows, schema, arrow, 64)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64) -> DataFrame:
    """Store each whole text as a PGM image, read it back, and describe what was read.

    The UTF-8 bytes (null: none) are padded with bytes 0 to a positive multiple
    of `width`, one image row each. Repeated rows give repeated results, equal
    texts equal values. Other columns of `df` are not returned.
    """

    def rows(batch: list[dict]) -> list[dict]:
        out = []
        for row in batch:
            data = row["data"]
            size = max(1, -(-len(data) // width)) * width
            media = encode_pgm(np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, width))
            image = decode(media)
            payload = image.tobytes()
            out.append({"doc_id": row["doc_id"], "n_bytes": len(data), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": difference_hash(image), "tile": npy(area_resize(image, 8, 8))})
        return out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary())])
    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data")), rows, schema, arrow, 64)
