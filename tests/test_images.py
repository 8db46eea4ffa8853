"""Headers of real bytes of four formats, the data source over them, and the committed file sink."""

import io
import os
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift import sinks
from lumisift.functions import headers
from lumisift.functions.exif import block_dates
from lumisift.functions.png import png
from lumisift.shipping import ship
from lumisift.sources import frames, images

ship(__name__)
WHEN = "2026:07:05 12:34:56"


def exif(when=WHEN, order="<", sub=True):
    """A block with its date in the Exif directory, or in the first."""
    text = when.encode() + b"\0"
    tag = 0x9003 if sub else 0x0132
    mark = b"II*\0" if order == "<" else b"MM\0*"
    if not sub:
        return mark + struct.pack(order + "IHHHIII", 8, 1, tag, 2, len(text), 26, 0) + text
    first = struct.pack(order + "IHHHIII", 8, 1, 0x8769, 4, 1, 26, 0)
    return mark + first + struct.pack(order + "HHHIII", 1, tag, 2, len(text), 44, 0) + text


def segment(kind, body):
    return b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body


def jpeg(width, height, block=None):
    size = segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0")
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9) + (segment(0xE1, b"Exif\0\0" + block) if block else b"") + segment(0xE2, b"x" * 60_000) + size + b"\xff\xda" + b"\0" * 5000 + b"\xff\xd9"


def with_chunk(data, block):
    """PNG bytes with an eXIf chunk before the end."""
    chunk = struct.pack(">I", len(block)) + b"eXIf" + block + struct.pack(">I", zlib.crc32(b"eXIf" + block))
    return data[:-12] + chunk + data[-12:]


def webp(width, height, block=None, kind=b"VP8X"):
    out = b""
    if kind == b"VP8X":
        out += b"VP8X" + struct.pack("<I", 10) + b"\x08\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
        out += b"VP8 " + struct.pack("<I", 11) + b"\0" * 11 + b"\0"  # an odd length is filled up
    elif kind == b"VP8 ":
        out += b"VP8 " + struct.pack("<I", 20) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", width, height) + b"\0" * 10
    else:
        out += b"VP8L" + struct.pack("<I", 6) + b"\x2f" + ((width - 1) | (height - 1) << 14).to_bytes(4, "little") + b"\0"
    if block:
        out += b"EXIF" + struct.pack("<I", len(block)) + block + b"\0" * (len(block) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(out)) + b"WEBP" + out


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def heic(width, height, block):
    item = struct.pack(">I", 6) + b"Exif\0\0" + block

    def meta(at):
        infe = box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 2, 0) + b"Exif\0")
        iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 2) + box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 1, 0) + b"hvc1\0") + infe)
        iloc = box(b"iloc", b"\0\0\0\0" + struct.pack(">BBH", 0x44, 0, 2) + struct.pack(">HHHII", 1, 0, 1, 7, 9) + struct.pack(">HHHII", 2, 0, 1, at, len(item)))
        ipco = box(b"ipco", box(b"ispe", b"\0\0\0\0" + struct.pack(">II", 160, 120)) + box(b"ispe", b"\0\0\0\0" + struct.pack(">II", width, height)))
        return box(b"meta", b"\0\0\0\0" + iinf + iloc + box(b"iprp", ipco))

    head = box(b"ftyp", b"heic\0\0\0\0mif1")
    start = len(head) + len(meta(0)) + 8
    return head + meta(start) + box(b"mdat", item + b"pixels")


def gray(width, height, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (height, width), dtype=np.uint8)


FILES = {
    "a.jpg": jpeg(640, 480, exif()),
    "b.JPEG": jpeg(30, 20, exif("2020-01-02 03:04:05", ">", sub=False)),
    "c.png": with_chunk(png(gray(40, 30)), exif("2021:01:01 00:00:01", ">")),
    "d.png": png(gray(12, 10)),
    "e.webp": webp(4000, 3000, exif()),
    "f.webp": webp(50, 70, None, b"VP8 "),
    "g.webp": webp(51, 71, b"Exif\0\0" + exif("1999:12:31 23:59:59"), b"VP8L"),
    "h.heic": heic(4032, 3024, exif()),
    "i.jpg": b"not an image",
    "j.png": png(gray(9, 9))[:20],
    "k.heic": heic(10, 10, exif())[:60],
    "l.webp": b"",
    "m e%1+.png": png(gray(16, 8, 3)),
    "n.txt": b"text",
}
SIZES = {"a.jpg": (640, 480), "b.JPEG": (30, 20), "c.png": (40, 30), "d.png": (12, 10), "e.webp": (4000, 3000), "f.webp": (50, 70), "g.webp": (51, 71), "h.heic": (4032, 3024), "m e%1+.png": (16, 8)}
TIMES = {"a.jpg": datetime(2026, 7, 5, 12, 34, 56), "b.JPEG": datetime(2020, 1, 2, 3, 4, 5), "c.png": datetime(2021, 1, 1, 0, 0, 1), "e.webp": datetime(2026, 7, 5, 12, 34, 56), "g.webp": datetime(1999, 12, 31, 23, 59, 59), "h.heic": datetime(2026, 7, 5, 12, 34, 56)}


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub.png").mkdir()
    return str(tmp_path)


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        self.read_bytes += len(data)
        return data


def test_headers_are_read_without_pixels():
    for name, data in FILES.items():
        f = Counted(data)
        said = headers.facts(f)
        assert ((said.width, said.height) if said.width else None) == SIZES.get(name), name
        assert (said.exif is not None) == (name in TIMES), name
        assert f.read_bytes < 2000
    assert block_dates(headers.facts(io.BytesIO(FILES["g.webp"])).exif)["original_sub"] == "1999:12:31 23:59:59"


@pytest.mark.parametrize("data", [FILES[n] for n in ("a.jpg", "c.png", "e.webp", "g.webp", "h.heic")])
def test_cut_files_never_raise(data):
    for n in range(0, min(len(data), 700)):
        headers.facts(io.BytesIO(data[:n]))
        headers.facts(io.BytesIO(data[:n] + b"\xff" * 40))


def test_the_source_opens_files_of_the_wanted_suffixes_only(spark, folder):
    rows = {r.name: r for r in images.files_of(spark, f"file://{folder}").collect()}
    assert set(rows) == set(FILES) - {"n.txt"}
    assert {n: (r.width, r.height) for n, r in rows.items() if r.width} == SIZES
    assert {n: r.capture_time for n, r in rows.items() if r.capture_time} == TIMES
    assert all(r.decode_ok is None and r.bytes == len(FILES[n]) for n, r in rows.items())
    reader = images.Reader(f"file://{folder}", {}, 1)
    left = list(reader.pushFilters([images.In(("suffix",), (".png", ".webp")), images.EqualTo(("suffix",), ".png"), images.EqualTo(("name",), "x")]))
    assert len(left) == 1 and [p.rows[0][1] for p in reader.partitions()] == ["c.png", "d.png", "j.png", "m e%1+.png"]
    assert [len(p.rows) for p in images.Reader(f"file://{folder}", {}, 1 << 30).partitions()] == [len(FILES)]
    plan = images.files_of(spark, f"file://{folder}").where(F.col("suffix") == ".png")._jdf.queryExecution().executedPlan().toString()
    assert "lumisift_images" in plan and plan.count("BatchScan") == 1


def test_a_decoder_gets_pixels_and_dates_from_one_open(spark, folder):
    def decode(content):
        if len(content) < 100:
            raise ValueError("cut")
        return np.full((8, 8), 7, dtype=np.uint8)

    found = frames.scan_folder(spark, folder, {".heic": decode, ".webp": decode})
    rows = {r.name: r for r in frames.with_capture_time(found, spark, folder).collect()}
    assert set(rows) == set(FILES) - {"n.txt"}
    assert rows["h.heic"].decode_ok and (rows["h.heic"].width, rows["h.heic"].height, rows["h.heic"].exposure) == (8, 8, pytest.approx(1 - 2 * abs(7 / 255 - 0.5)))
    assert not rows["k.heic"].decode_ok and rows["k.heic"].width is None and rows["k.heic"].sharpness == 0.0
    assert rows["c.png"].decode_ok and rows["c.png"].capture_time == TIMES["c.png"] and not rows["i.jpg"].decode_ok
    assert {n: r.capture_time for n, r in rows.items() if r.capture_time} == TIMES
    for r in rows.values():
        assert sinks.write_contents  # paths can be opened by the sinks
        assert r.path.startswith("file:")


def test_a_failed_job_leaves_the_target_empty(spark, tmp_path):
    target = tmp_path / "out"

    def boom(x):
        if x == "7":
            raise RuntimeError("lost")
        return x

    plain = spark.range(20).repartition(4).select(F.col("id").cast("string").alias("name"))
    shaped = lambda df: df.select("name", F.concat("name", F.lit(".bin")).alias("output_filename"), F.encode("name", "utf-8").alias("content"), F.lit(None).cast("string").alias("error"))
    rows = shaped(plain.select(F.udf(boom)("name").alias("name")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_contents(rows, f"file://{target}")
    assert not target.exists() or os.listdir(target) == []
    good = sinks.write_contents(shaped(plain.where("name <> '7'")).withColumn("error", F.when(F.col("name") == "3", "unread")), f"file://{target}")
    said = {r.name: r for r in good.collect()}
    assert len(said) == 19 and not said["3"].ok and said["3"].error == "unread"
    assert sorted(os.listdir(target)) == sorted(f"{k}.bin" for k in range(20) if k not in (3, 7))
    assert (target / "11.bin").read_bytes() == b"11" and said["11"].output_path == f"{target}/11.bin"


def test_thumbnails_are_written_by_executors(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(png(gray(64, 48)))
    (tmp_path / "y.png").write_bytes(png(gray(20, 20)))
    outputs = spark.createDataFrame([("x.png", "one/x"), ("y.png", "y")], "name string, stem string")
    report = sinks.write_thumbnails(spark, str(tmp_path), outputs, [32, 16, 64], f"file://{tmp_path}/out").collect()
    assert sorted((r.name, r.width, r.ok) for r in report) == [("x.png", 16, True), ("x.png", 32, True), ("y.png", 16, True)]
    said = headers.facts(open(tmp_path / "out/one/x-32w.png", "rb"))
    assert (said.width, said.height) == (32, 24) and sorted(os.listdir(tmp_path / "out")) == ["one", "y-16w.png"]
