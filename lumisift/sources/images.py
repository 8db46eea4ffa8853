"""A data source of image files: one row a file, its size and Exif dates from its first bytes, and its pixels' features from the same open where a decoder is given.

The suffix filter is pushed down, so other files are never opened; partitions hold about PARTITION_BYTES of what is read. Spark's own image reader decodes JPEG and PNG faster than
Python can, so `sources.frames` takes pixels from it and only what it lacks from here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from lumisift.functions import headers, raster, text
from lumisift.functions.exif import FIELDS, block_dates
from lumisift.shipping import ship

ship(__name__)

SCHEMA = "path string, name string, suffix string, bytes long, modified timestamp, width int, height int, " + ", ".join(f"{f} string" for f in FIELDS) + ", decode_ok boolean, sharpness double, exposure double, grid array<int>"
#: Bytes of a partition; a file that is not decoded counts as HEAD_BYTES at most.
PARTITION_BYTES, HEAD_BYTES = 64 << 20, 64 << 10


class Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(0)
        self.rows = rows


class Reader(DataSourceReader):
    def __init__(self, folder: str, decoders: dict[str, Callable], size: int):
        self.folder, self.decoders, self.size, self.suffixes = folder, decoders, size, None

    def pushFilters(self, filters):
        for one in filters:
            if isinstance(one, (EqualTo, In)) and one.attribute == ("suffix",):
                said = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.suffixes = said if self.suffixes is None else self.suffixes & said
            else:
                yield one

    def partitions(self):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.folder)
        found, held, weight = [], [], 0
        for entry in sorted(files.get_file_info(fs.FileSelector(base)), key=lambda e: e.base_name):
            name = entry.base_name
            suffix = name[name.rfind(".") :].lower() if "." in name else ""
            if entry.type != fs.FileType.File or (self.suffixes is not None and suffix not in self.suffixes):
                continue
            held.append((entry.path, name, suffix, entry.size, entry.mtime_ns))
            weight += entry.size if suffix in self.decoders else min(entry.size, HEAD_BYTES)
            if weight >= self.size:
                found.append(Files(held))
                held, weight = [], 0
        return [*found, Files(held)] if held or not found else found

    def read(self, partition: Files) -> Iterator[tuple]:
        import datetime
        import io

        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.folder)
        for path, name, suffix, size, mtime in partition.rows:
            said, pixels = headers.Facts(None, None, None), None
            try:
                with files.open_input_file(path) as f:
                    if suffix in self.decoders:  # the whole file, once
                        content = f.read()
                        said = headers.facts(io.BytesIO(content))
                        try:
                            pixels = self.decoders[suffix](content)
                        except Exception:  # an undecodable file is a row, not the end of a scan
                            pixels = None
                    else:
                        said = headers.facts(f)
            except OSError:  # gone since it was listed
                pass
            dates = block_dates(said.exif)
            modified = datetime.datetime.fromtimestamp(mtime / 1e9, datetime.timezone.utc) if mtime else None
            features = (True, *raster.raster_features(raster.luma(pixels))) if pixels is not None else (False if suffix in self.decoders else None, None, None, None)
            width, height = (pixels.shape[1], pixels.shape[0]) if pixels is not None else (said.width, said.height)
            yield (path, name, suffix, size, modified, width, height, *(dates[x] for x in FIELDS), *features)


def files_of(spark: SparkSession, folder: str, decoders: dict[str, Callable] | None = None, size: int = PARTITION_BYTES) -> DataFrame:
    """SCHEMA of the image files directly in a folder (a URI), and capture_time. decode_ok and the features are null for suffixes without a decoder.

    decoders map suffixes to functions of file bytes to a uint8 raster in blue-green-red order.
    """
    own, used = decoders or {}, spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    if used != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    class Images(DataSource):
        @classmethod
        def name(cls):
            return "lumisift_images"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options["path"], own, size)

    spark.dataSource.register(Images)
    files = spark.read.format("lumisift_images").load(folder).where(F.col("suffix").isin(*text.SCANNED))
    return files.withColumn("capture_time", text.capture_time(*[F.col(f) for f in FIELDS])).drop(*FIELDS)
