"""Image files as rows: sizes and text metadata, read from the bytes.

PNG, JPEG and GIF are parsed here, as no image library is needed for their
headers: text chunks, comments, and the text fields of EXIF.  Pixels are not
decoded.  Files of other kinds and broken ones have null sizes and ``readable``
false, with whatever was found before the break.  Spark's reader skips empty files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, width int, height int, metadata map<string,string>, readable boolean"
#: Unpacked bytes of one compressed text chunk that are kept in memory; a chunk beyond is not readable.
MOST_UNPACKED = 64 << 20

# Markers of JPEG without a length, and those that begin a frame (and hold its size).
BARE = {0x01, *range(0xD0, 0xDA)}
FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def _unpacked(data: bytes) -> bytes:
    z = zlib.decompressobj()
    out = z.decompress(data, MOST_UNPACKED)
    if z.unconsumed_tail:
        raise ValueError("text chunk too large")
    return out


def _png(data: bytes, found: dict[str, str]) -> tuple[int, int]:
    width, height = struct.unpack(">II", data[16:24])
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind in (b"tEXt", b"zTXt", b"iTXt"):
            key, _, rest = body.partition(b"\0")
            if kind == b"zTXt":
                value = _unpacked(rest[1:]).decode("latin-1")
            elif kind == b"iTXt":
                packed, (_, _, text) = rest[:1] == b"\1", rest[2:].split(b"\0", 2)
                value = (_unpacked(text) if packed else text).decode("utf-8", "replace")
            else:
                value = rest.decode("latin-1")
            found[key.decode("latin-1")] = value
        elif kind == b"eXIf":
            _exif(body, found)
        at += 12 + size
    return width, height


def _exif(data: bytes, found: dict[str, str]) -> None:
    """Text fields of the first directory and of those it points to."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    todo, seen = [struct.unpack(order + "I", data[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or not 0 < at <= len(data) - 2:
            continue
        seen.add(at)
        for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, n, value = struct.unpack(order + "HHII", entry)
            if kind == 2:
                text = entry[8 : 8 + n] if n <= 4 else data[value : value + n]
                found[f"exif:{tag}"] = text.rstrip(b"\0").decode("utf-8", "replace")
            elif tag == 0x8769:
                todo.append(value)


def _jpeg(data: bytes, found: dict[str, str]) -> tuple[int, int]:
    at, size = 2, None
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF or marker in BARE:
            at += 1 if marker == 0xFF else 2
            continue
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + n]
        if marker == 0xFE:
            found["comment"] = body.decode("utf-8", "replace")
        elif marker == 0xE1 and body.startswith(b"Exif\0\0"):
            _exif(body[6:], found)
        elif marker in FRAMES:
            height, width = struct.unpack(">HH", body[1:5])
            size = width, height
        if marker == 0xDA:  # pixels follow
            break
        at += 2 + n
    if size is None:
        raise ValueError("no frame")
    return size


def _gif(data: bytes, found: dict[str, str]) -> tuple[int, int]:
    width, height, flags = struct.unpack("<HHB", data[6:11])
    table = lambda f: 3 << ((f & 7) + 1) if f & 0x80 else 0
    at = 13 + table(flags)
    while at < len(data) and data[at] != 0x3B:
        kind, label = data[at], data[at + 1 : at + 2]
        at += 2 if kind == 0x21 else 11 + table(data[at + 9])  # an extension, or an image and its first code size
        text = bytearray()
        while data[at]:
            text += data[at + 1 : at + 1 + data[at]] if label == b"\xfe" and kind == 0x21 else b""
            at += 1 + data[at]
        at += 1
        if text:
            found["comment"] = text.decode("utf-8", "replace")
    return width, height


PARSERS = {b"\x89PNG\r\n\x1a\n": _png, b"\xff\xd8": _jpeg, b"GIF87a": _gif, b"GIF89a": _gif}


def parsed(data: bytes | None) -> tuple[int | None, int | None, dict[str, str], bool]:
    """Width, height, metadata and whether the file could be read."""
    found: dict[str, str] = {}
    for magic, parser in PARSERS.items():
        if data is not None and data.startswith(magic):
            try:
                return *parser(data, found), found, True
            except (struct.error, IndexError, KeyError, ValueError, zlib.error):
                return None, None, found, False
    return None, None, found, False


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(path, *parsed(data)) for path, data in zip(batch["path"], batch["content"], strict=True)], columns=["path", "width", "height", "metadata", "readable"])


def table(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, width, height, metadata, readable`` of the files in a folder and
    below.  A batch holds as many whole files as the session's Arrow batch size says."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(_rows, SCHEMA)
