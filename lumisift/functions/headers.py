"""What the first bytes of an image file say: its size and its Exif block, without its pixels. JPEG, PNG, WebP and HEIC.

Readers walk a file's segments, chunks or boxes by seeking, so a file costs a few small reads whatever its length. What can't be read is None.
"""

from __future__ import annotations

import struct
from typing import BinaryIO, NamedTuple

from lumisift.shipping import ship

ship(__name__)

#: Longest Exif block that is read; the formats' own limit for JPEG is 64 kB.
MOST = 1 << 20


class Facts(NamedTuple):
    width: int | None
    height: int | None
    exif: bytes | None


def _take(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise EOFError
    return data


def _bare(exif: bytes) -> bytes:
    """The block without the mark that some writers put before it."""
    return exif[6:] if exif.startswith(b"Exif\0\0") else exif


def _jpeg(f: BinaryIO) -> Facts:
    size, exif = (None, None), None
    f.seek(2)
    while size == (None, None) or exif is None:
        if _take(f, 1) != b"\xff":
            break
        marker = _take(f, 1)
        while marker == b"\xff":
            marker = _take(f, 1)
        kind = marker[0]
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:
            continue
        if kind in (0xD9, 0xDA):  # pixels or the end
            break
        length = struct.unpack(">H", _take(f, 2))[0] - 2
        after = f.tell() + length
        if kind == 0xE1 and exif is None:
            body = _take(f, length)
            exif = body[6:] if body.startswith(b"Exif\0\0") else None
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">xHH", _take(f, 5))
            size = (width, height)
        f.seek(after)
    return Facts(*size, exif)


def _png(f: BinaryIO) -> Facts:
    size, exif = (None, None), None
    f.seek(8)
    while size == (None, None) or exif is None:
        head = f.read(8)
        if len(head) < 8 or head[4:] == b"IEND":
            break
        length, after = struct.unpack(">I", head[:4])[0], f.tell() + struct.unpack(">I", head[:4])[0] + 4
        if head[4:] == b"IHDR":
            size = struct.unpack(">II", _take(f, 8))
        elif head[4:] == b"eXIf" and length <= MOST:
            exif = _bare(_take(f, length))
        f.seek(after)
    return Facts(*size, exif)


def _webp(f: BinaryIO) -> Facts:
    size, exif = (None, None), None
    f.seek(12)
    while exif is None:
        head = f.read(8)
        if len(head) < 8:
            break
        length = struct.unpack("<I", head[4:])[0]
        after = f.tell() + length + length % 2
        if head[:4] == b"VP8X":
            body = _take(f, 10)
            size = (1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little"))
        elif head[:4] == b"VP8 " and size == (None, None):
            body = _take(f, 10)
            if body[3:6] == b"\x9d\x01\x2a":
                size = tuple(x & 0x3FFF for x in struct.unpack("<HH", body[6:]))
        elif head[:4] == b"VP8L" and size == (None, None):
            body = _take(f, 5)
            if body[0] == 0x2F:
                bits = int.from_bytes(body[1:], "little")
                size = (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
        elif head[:4] == b"EXIF" and length <= MOST:
            exif = _bare(_take(f, length))
        f.seek(after)
    return Facts(*size, exif)


def _boxes(data: bytes, at: int, end: int):
    """(kind, from, to) of the boxes in a range."""
    while at + 8 <= end:
        length, kind = struct.unpack_from(">I4s", data, at)
        start = at + 8
        if length == 1:
            length, start = struct.unpack_from(">Q", data, start)[0], start + 8
        length = length or end - at
        if length < start - at or at + length > end:
            return
        yield kind, start, at + length
        at += length


def _number(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "big")


def _exif_items(data: bytes, start: int, end: int) -> set[int]:
    """Numbers of the items that a list of items calls Exif."""
    version = data[start]
    found, at = set(), start + 4 + (2 if version == 0 else 4)
    for kind, a, _ in _boxes(data, at, end):
        if kind == b"infe" and data[a] >= 2:
            wide = 4 if data[a] >= 3 else 2
            if data[a + 6 + wide : a + 10 + wide] == b"Exif":
                found.add(_number(data, a + 4, wide))
    return found


def _places(data: bytes, start: int) -> dict[int, tuple[int, int]]:
    """item -> (offset in the file, length) of its first extent, for items that lie in the file itself."""
    version, sizes = data[start], _number(data, start + 4, 2)
    offset_size, length_size, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    wide = 4 if version == 2 else 2
    count, at, out = _number(data, start + 6, wide), start + 6 + wide, {}
    for _ in range(count):
        item, at = _number(data, at, wide), at + wide
        method = 0
        if version:
            method, at = _number(data, at, 2) & 15, at + 2
        base, at = _number(data, at + 2, base_size), at + 2 + base_size
        extents, at = _number(data, at, 2), at + 2
        for k in range(extents):
            at += index_size
            offset, length = _number(data, at, offset_size), _number(data, at + offset_size, length_size)
            at += offset_size + length_size
            if k == 0 and method == 0:
                out[item] = (base + offset, length)
    return out


def _heic(f: BinaryIO) -> Facts:
    f.seek(0)
    at, meta = 0, None
    while meta is None:  # boxes of the file up to the one that describes it
        head = f.read(16)
        if len(head) < 8:
            break
        length, kind = struct.unpack(">I4s", head[:8])
        own = 8
        if length == 1 and len(head) == 16:
            length, own = struct.unpack(">Q", head[8:])[0], 16
        if length < own:
            break
        if kind == b"meta" and length - own <= 16 * MOST:
            f.seek(at + own)
            meta = _take(f, length - own)
        at += length
        f.seek(at)
    if meta is None:
        return Facts(None, None, None)
    size, items, places = (None, None), set(), {}
    for kind, a, b in _boxes(meta, 4, len(meta)):
        if kind == b"iinf":
            items = _exif_items(meta, a, b)
        elif kind == b"iloc":
            places = _places(meta, a)
        elif kind == b"iprp":
            for inner, c, d in _boxes(meta, a, b):
                if inner == b"ipco":
                    sizes = [struct.unpack_from(">II", meta, e + 4) for said, e, _ in _boxes(meta, c, d) if said == b"ispe"]
                    size = max(sizes, key=lambda s: s[0] * s[1], default=size)
    for item in sorted(items & places.keys()):
        offset, length = places[item]
        if 4 < length <= MOST:
            f.seek(offset)
            body = _take(f, length)
            return Facts(*size, _bare(body[4 + _number(body, 0, 4) :] if _number(body, 0, 4) < length - 4 else body[4:]))
    return Facts(*size, None)


def facts(f: BinaryIO) -> Facts:
    """Of an open file, by its first bytes, whatever its name."""
    try:
        head = f.read(12)
        if head[:2] == b"\xff\xd8":
            return _jpeg(f)
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(f)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return _webp(f)
        if head[4:8] == b"ftyp":
            return _heic(f)
    except (EOFError, struct.error, IndexError, ValueError, OSError):  # cut short or not what it seems
        pass
    return Facts(None, None, None)
