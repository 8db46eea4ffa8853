"""Frames: the relation everything else works on, from a folder of images or any other producer.

frames(name, stem, ext, width, height, decode_ok, sharpness, exposure, grid array<int>): one row a file. Names order
frames wherever order matters; nothing numbers all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions import raster, text
from lumisift.shipping import ship
from lumisift.sources.images import files_of

ship(__name__)

FEATURES = "path string, width int, height int, decode_ok boolean, sharpness double, exposure double, grid array<int>"


def discovered(files: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name has a suffix that a folder scan takes, in any case."""
    return files.where(text.suffix(F.col(name)).isin(*text.SCANNED))


def scan_folder(spark: SparkSession, folder: str, decoders: dict[str, Callable[[bytes], np.ndarray]] | None = None) -> DataFrame:
    """Frames of the images directly in a folder. What can't be decoded is a row with decode_ok false.

    The suffix filter stands before decoding, pixels are dropped where they are read, and one decode gives every feature.
    decoders map suffixes that Spark's image reader does not know (.heic, .webp) to functions of file bytes to a uint8 raster in
    blue-green-red order; without one such files are undecodable rows.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (files.exists(path) and files.getFileStatus(path).isDirectory()):
        raise NotADirectoryError(folder)
    pattern = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s[1:]) for s in text.SCANNED) + "}"
    if not files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, pattern)):
        return spark.createDataFrame([], f"{FEATURES}, name string, stem string, ext string")
    images = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).load(folder).select("image.*")
    own = text.suffix(F.element_at(F.split("origin", "/"), -1)).isin(*(decoders or {}))
    found = images.where(~own).mapInArrow(_features, FEATURES)
    if decoders:
        opened = files_of(spark, qualified(spark, folder), decoders).where(F.col("suffix").isin(*decoders))
        none = {"sharpness": F.coalesce("sharpness", F.lit(0.0)), "exposure": F.coalesce("exposure", F.lit(0.0)), "width": F.when(F.col("decode_ok"), F.col("width")), "height": F.when(F.col("decode_ok"), F.col("height"))}
        read = opened.withColumns(none).withColumn("path", F.concat(F.lit("file:"), F.regexp_replace(F.regexp_replace("path", "%", "%25"), " ", "%20")) if qualified(spark, folder).startswith("file:") else F.col("path"))
        found = found.unionByName(read.select(*(c.split()[0] for c in FEATURES.split(", "))))
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return found.withColumn("name", name).withColumn("stem", text.stem(F.col("name"))).withColumn("ext", text.suffix(F.col("name")))


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder as a URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    said = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + said[len("file:") :] if said.startswith("file:/") and not said.startswith("file://") else said


def with_capture_time(frames: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Adds capture_time (no zone) out of the Exif blocks of JPEG, PNG, WebP and HEIC files; null for others. Only their first bytes are read for it."""
    return frames.join(files_of(spark, qualified(spark, folder)).select("name", "capture_time"), "name", "left")


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, modified, bytes) of the files in a folder; their content is not read."""
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return spark.read.format("binaryFile").load(folder).select(name.alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def _features(batches: Iterator):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            row = {name: batch.column(j)[k] for j, name in enumerate(batch.schema.names)}
            w, h, c = row["width"].as_py(), row["height"].as_py(), row["nChannels"].as_py()
            if w < 1 or h < 1:
                rows.append((row["origin"].as_py(), None, None, False, 0.0, 0.0, None))
                continue
            pixels = np.frombuffer(row["data"].as_buffer(), dtype=np.uint8).reshape(h, w, c)
            rows.append((row["origin"].as_py(), w, h, True, *raster.raster_features(raster.luma(pixels))))
        yield _batch(rows, pa)


def _batch(rows: list, pa):
    types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types)], names=["path", "width", "height", "decode_ok", "sharpness", "exposure", "grid"])


def with_features(frames: DataFrame) -> DataFrame:
    """Adds sharpness, exposure, score and h (null where undecodable) to frames that have only a grid."""
    ok = F.col("decode_ok")
    measured = frames.withColumns({
        "sharpness": F.when(ok, raster.sharpness(F.col("grid"))).otherwise(F.lit(0.0)),
        "exposure": F.when(ok, raster.exposure(F.col("grid"))).otherwise(F.lit(0.0)),
        "h": F.when(ok, raster.average_hash(F.col("grid"))),
    })
    return measured.withColumn("score", raster.composite(F.col("sharpness"), F.col("exposure")))


def dimensions(frames: DataFrame) -> DataFrame:
    """Adds dimensions struct<width, height>, null where undecodable."""
    return frames.withColumn("dimensions", F.when(F.col("decode_ok"), F.struct("width", "height")))


def hashed(frames: DataFrame) -> DataFrame:
    """Adds score and h to frames that come with sharpness and exposure, as from scan_folder."""
    return frames.withColumn("score", raster.composite(F.col("sharpness"), F.col("exposure"))).withColumn("h", F.when(F.col("decode_ok"), raster.average_hash(F.col("grid"))))
