"""Grey-scale PNG pictures as bytes."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: signature, and width and height right after the first chunk's name.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 24


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: bytes, width: int) -> bytes:
    """Rows of 8-bit grey values, stored without compression so that equal pictures are equal bytes everywhere."""
    height = len(pixels) // width if width else 0
    rows = b"".join(b"\0" + pixels[y * width : (y + 1) * width] for y in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows, 0)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> bytes:
    """Grey values of a picture written by ``encode``."""
    at, body, width = len(SIGNATURE), b"", 0
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            (width,) = struct.unpack(">I", part[:4])
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    rows = zlib.decompress(body)
    return b"".join(rows[y + 1 : y + 1 + width] for y in range(0, len(rows), width + 1))


@F.pandas_udf(T.BinaryType())
def png(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Pictures from arrays of whole numbers from 0 to 255."""
    return pd.Series([encode(bytes(int(v) for v in p), int(w)) for p, w in zip(pixels, width, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def grey_values(data: pd.Series) -> pd.Series:
    return pd.Series([list(decode(bytes(d))) for d in data], dtype=object)


def size_in_header(data: Column | str) -> tuple[Column, Column]:
    """Width and height from the first ``HEADER_BYTES``."""
    number = lambda start: F.conv(F.hex(F.substring(data, start, 4)), 16, 10).cast("int")
    return number(17), number(21)
