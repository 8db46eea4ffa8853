"""Capture times out of Exif blocks: a small reader of Exif date tags, and the order in which they count."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumisift.functions.text import capture_time
from lumisift.functions.xmp import segments
from lumisift.shipping import ship

ship(__name__)

#: Fixed values of the format: date tags in the order in which they count, and the pointer to the Exif block.
ORIGINAL, CHANGED, DIGITIZED, EXIF_BLOCK = 0x9003, 0x0132, 0x9004, 0x8769
FIELDS = ("original_sub", "original_top", "changed_sub", "changed_top", "digitized_sub", "digitized_top")


def _block(data: bytes, at: int, order: str) -> dict[int, object]:
    """Strings and offsets of a block of tags; what does not fit the bytes is left out."""
    out: dict[int, object] = {}
    if at + 2 > len(data):
        return out
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind == 2:  # text
            start = entry + 8 if count <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            if start + count <= len(data):
                out[tag] = data[start : start + count].split(b"\0")[0].decode("ascii", "replace").strip()
        elif kind == 4 and count == 1:
            (out[tag],) = struct.unpack_from(order + "I", data, entry + 8)
    return out


def date_tags(data: bytes | None) -> dict[str, str | None]:
    """FIELDS of JPEG bytes; all None where there is no Exif that can be read."""
    try:
        return block_dates(next(body[6:] for marker, body in segments(bytes(data)) if marker == 0xE1 and body.startswith(b"Exif\0\0")))
    except (StopIteration, ValueError, TypeError, struct.error):
        return dict.fromkeys(FIELDS)


def block_dates(exif: bytes | None) -> dict[str, str | None]:
    """FIELDS of an Exif block, of whatever file; all None where it can't be read."""
    none: dict[str, str | None] = dict.fromkeys(FIELDS)
    try:
        order = {b"II": "<", b"MM": ">"}[exif[:2]]
        top = _block(exif, struct.unpack_from(order + "I", exif, 4)[0], order)
    except (KeyError, TypeError, struct.error):
        return none
    pointer = top.get(EXIF_BLOCK)
    sub = _block(exif, pointer, order) if isinstance(pointer, int) else {}
    said = [block.get(tag) for tag in (ORIGINAL, CHANGED, DIGITIZED) for block in (sub, top)]
    return dict(zip(FIELDS, (x if isinstance(x, str) else None for x in said)))


def taken_at(content: Column) -> Column:
    """The capture time of JPEG bytes: the first date tag that can be read, the Exif block before the top level."""
    @F.pandas_udf(", ".join(f"{f} string" for f in FIELDS))
    def read(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([date_tags(x) for x in data], columns=list(FIELDS), dtype=object)

    found = read(content)
    return F.aggregate(F.array(found), F.lit(None).cast("timestamp_ntz"), lambda _, t: capture_time(*[t[f] for f in FIELDS]))
