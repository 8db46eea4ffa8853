"""Image codecs of an optional library: decoders for what Spark's image reader does not know, and encoders of JPEG and WebP bytes.

They register themselves where the library can be imported, on the driver, and are asked for again on the executors that run them. Without it there
are none: such frames stay undecodable rows, and files are copied as they are.
"""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Callable

import numpy as np

from lumisift.shipping import ship

ship(__name__)

JPEG_QUALITY, WEBP_QUALITY = 92, 82


def has(module: str) -> bool:
    return importlib.util.find_spec(module) is not None


def _opened(data: bytes):
    from PIL import Image

    if has("pillow_heif"):
        import pillow_heif

        pillow_heif.register_heif_opener()
    return Image.open(io.BytesIO(data))


def decoded(data: bytes) -> np.ndarray:
    """A uint8 raster in blue-green-red order."""
    return np.asarray(_opened(data).convert("RGB"))[:, :, ::-1]


class Encoder:
    """File bytes to JPEG or WebP bytes, with the Exif block they came with."""

    def __init__(self, kind: str, quality: int):
        self.kind, self.quality = kind, quality

    def __call__(self, data: bytes) -> bytes:
        image, out = _opened(data), io.BytesIO()
        exif = image.info.get("exif")
        more = {"optimize": True} if self.kind == "JPEG" else {"method": 6}
        image.convert("RGB").save(out, self.kind, quality=self.quality, **more, **({"exif": exif} if exif else {}))
        return out.getvalue()


def decoders() -> dict[str, Callable[[bytes], np.ndarray]]:
    """By suffix, for `scan_folder`."""
    found = {".webp": decoded} if has("PIL") else {}
    return found | ({".heic": decoded} if has("PIL") and has("pillow_heif") else {})


def jpeg_encoders(quality: int = JPEG_QUALITY) -> dict[str, Callable[[bytes], bytes]]:
    """By the suffix of what they encode, for `write_files`."""
    heif = has("PIL") and has("pillow_heif")
    return {suffix: Encoder("JPEG", quality) for suffix in ((".heic", ".heif") if heif else ())}


def webp_encoder(quality: int = WEBP_QUALITY) -> Callable[[bytes], bytes] | None:
    return Encoder("WEBP", quality) if has("PIL") else None
