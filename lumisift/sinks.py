"""Sinks: copies and transcoded files, thumbnails, manifests, and the guards around an output folder.

Files are written from executors into a hidden folder of the target, and moved into place when all tasks have succeeded. Encoders
are pluggable: without one for a format, files are copied as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lumisift.functions import raster, xmp
from lumisift.functions.png import png
from lumisift.operators.selection import RENAME_SCHEMES
from lumisift.session import checkpoint_dir
from lumisift.shipping import ship

ship(__name__)


def thumbnail_plan(frames: DataFrame, widths: list[int]) -> DataFrame:
    """(name, thumb_width, thumb_height): each distinct width narrower than the frame, at the frame's proportions."""
    wanted = F.array(*[F.lit(w) for w in sorted(set(widths))])
    each = frames.select("name", "width", "height", F.explode(wanted).alias("thumb_width")).where("thumb_width < width")
    return each.select("name", "thumb_width", F.bround(F.col("height") * (F.col("thumb_width") / F.col("width"))).cast("int").alias("thumb_height"))


def fitted(width: Column, height: Column, longest: int, w: str = "width", h: str = "height") -> list[Column]:
    """The size of a frame whose longer side may not pass `longest`; never larger, never below one pixel."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    size = lambda x, name: F.greatest(F.lit(1), F.bround(x * scale).cast("int")).alias(name)
    return [size(width, w), size(height, h)]


def preview_width(width: Column, wanted: int) -> Column:
    """A preview never grows: the original width where it is the smaller."""
    return F.least(width, F.lit(wanted))


def resized(spark: SparkSession, folder: str, names: DataFrame, longest: int = 1568) -> DataFrame:
    """(name, content): PNG bytes of names(name) in a folder, the longer side cut to `longest`; null where undecodable."""
    return _scaled(spark, folder, names.select("name", F.array(F.lit(-longest)).alias("widths"))).select("name", "content")


def thumbnails(spark: SparkSession, folder: str, names: DataFrame, widths: list[int]) -> DataFrame:
    """(name, width, content): PNG bytes at each distinct width narrower than the frame."""
    return _scaled(spark, folder, names.select("name", F.array(*[F.lit(w) for w in sorted(set(widths))]).alias("widths"))).where("content IS NOT NULL")


def _scaled(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Names are joined before pixels are read into Python; a negative width is a limit of the longer side."""
    images = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("origin", "/"), -1), r"\+", "%2B"))
    rows = images.withColumn("name", name).join(wanted, "name").select("name", "widths", "width", "height", "nChannels", "data")

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                name, widths, w, h, c = (batch.column(j)[k].as_py() for j in range(5))
                pixels = np.frombuffer(batch.column(5)[k].as_buffer(), dtype=np.uint8).reshape(h, w, c)[:, :, 2::-1] if c == 3 else None
                if w > 0 and c == 1:
                    pixels = np.frombuffer(batch.column(5)[k].as_buffer(), dtype=np.uint8).reshape(h, w)
                for width in widths:
                    scale = min(1.0, -width / max(w, h)) if width < 0 else width / max(w, 1)
                    if pixels is None:
                        out.append((name, width, None))
                    elif width < 0 or width < w:
                        size = (max(1, round(h * scale)), max(1, round(w * scale)) if width < 0 else width)
                        planes = [pixels] if pixels.ndim == 2 else [pixels[:, :, j] for j in range(3)]
                        small = [np.rint(raster.shrunk(p, *size)).clip(0, 255).astype(np.uint8) for p in planes]
                        out.append((name, width, png(small[0] if len(small) == 1 else np.stack(small, axis=2))))
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.binary()))], names=["name", "width", "content"])

    return rows.mapInArrow(run, "name string, width int, content binary")


def tally(report: DataFrame) -> DataFrame:
    """Counts of a sink's report(name, output_path, ok, error): written, failed."""
    return report.agg(F.count_if("ok").alias("written"), F.count_if(~F.col("ok")).alias("failed"))


def changes_of_name(report: DataFrame) -> DataFrame:
    """Of files written (name, output_path, ok): written, transcoded (to another kind of file), renamed (other than by that)."""
    from lumisift.functions import text

    out = F.element_at(F.split("output_path", "/"), -1)
    other = text.suffix(out) != text.suffix(F.col("name"))
    return report.where("ok").agg(F.count("*").alias("written"), F.count_if(other).alias("transcoded"), F.count_if(text.stem(out) != text.stem(F.col("name"))).alias("renamed"))


def save_session(path: str, session: dict, attempts: int = 3) -> None:
    """A session as JSON on a local or shared file system: a draft is written and moved, so readers see the old or the new one."""
    import json

    from pyarrow import fs

    files, target = fs.FileSystem.from_uri(path)
    for k in range(attempts):
        draft = f"{target}.{uuid.uuid4().hex}"
        try:
            with files.open_output_stream(draft) as f:
                f.write(json.dumps(session).encode("utf-8"))
            files.move(draft, target)
            return
        except PermissionError:
            if k + 1 == attempts:
                raise


def claim(path: str, content: bytes) -> bool:
    """Writes a file whole if there is none of that name, and says whether it did. Of two that try at once one succeeds on a local or Hadoop file system;
    a store without renames that fail can only be looked at before."""
    import os

    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    draft = f"{at}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as f:
        f.write(content)
    try:
        if isinstance(files, fs.LocalFileSystem):
            os.link(draft, at)  # fails where the name is taken
            return True
        if files.get_file_info(at).type != fs.FileType.NotFound:
            return False
        files.move(draft, at)
        return True
    except FileExistsError:
        return False
    finally:
        if files.get_file_info(draft).type != fs.FileType.NotFound:
            files.delete_file(draft)


def folder_entries(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder that don't start with a dot; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    return [n for n in (s.getPath().getName() for s in files.listStatus(path)) if not n.startswith(".")]


def guard_output(spark: SparkSession, folder: str, overwrite: bool = False) -> None:
    if not overwrite and (found := folder_entries(spark, folder)):
        raise FileExistsError(f"{folder} is not empty ({found[0]} and others); say overwrite to write there")


REPORT = "name string, output_path string, ok boolean, error string"


class Staged(WriterCommitMessage):
    """What a task has written beside the target: (name, staged file or None, output file name, error or None)."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows


class FileWriter(DataSourceArrowWriter):
    """Rows of (name, output_filename, content, error) as files, all or none: tasks write into a hidden folder of the target, the commit moves each into place."""

    def __init__(self, folder: str, report: str):
        self.folder, self.report, self.stage = folder, report, f".stage-{uuid.uuid4().hex}"

    def write(self, iterator) -> Staged:
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(self.folder)
        target.create_dir(f"{base}/{self.stage}", recursive=True)
        done = []
        for batch in iterator:
            for row in batch.to_pylist():
                staged, error = f"{base}/{self.stage}/{uuid.uuid4().hex}", row["error"]
                if error is None:
                    with target.open_output_stream(staged) as f:
                        f.write(row["content"])
                done.append((row["name"], staged if error is None else None, row["output_filename"], error))
        return Staged(done)

    def commit(self, messages) -> None:
        import json

        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(self.folder)
        out = []
        for name, staged, file, error in (row for m in messages if m is not None for row in m.rows):
            final = f"{base}/{file}"
            if error is None:
                try:
                    target.create_dir(final.rpartition("/")[0], recursive=True)
                    target.move(staged, final)
                except OSError as failed:
                    error = str(failed)
            out.append({"name": name, "output_path": final if error is None else None, "ok": error is None, "error": error})
        self._clear(target, base)
        files, at = fs.FileSystem.from_uri(self.report)
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/report.json") as f:
            f.write("".join(json.dumps(row) + "\n" for row in out).encode())

    def abort(self, messages) -> None:
        from pyarrow import fs

        self._clear(*fs.FileSystem.from_uri(self.folder))

    def _clear(self, target, base: str) -> None:
        from pyarrow import fs

        if target.get_file_info(f"{base}/{self.stage}").type != fs.FileType.NotFound:
            target.delete_dir(f"{base}/{self.stage}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumisift_files"

    def writer(self, schema, overwrite) -> FileWriter:
        return FileWriter(self.options["path"], self.options["report"])


def write_contents(rows: DataFrame, folder: str) -> DataFrame:
    """rows(name, output_filename, content, error) -> REPORT. Files are in the folder (a URI) when the job has succeeded and none is if it failed; rows with an error are reported only."""
    spark = rows.sparkSession
    report = f"{checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    spark.dataSource.register(FileSink)
    rows.select("name", "output_filename", "content", "error").write.format("lumisift_files").mode("append").option("report", report).save(folder)
    return spark.read.schema(REPORT).json(report)


def write_files(picks: DataFrame, folder: str, encoders: dict[str, Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """picks(name, path, output_filename, rating int or null) -> REPORT: (name, output_path, ok, error), written once.

    encoders map a source suffix to a function of its bytes to others. A rating is embedded in JPEG output. Output names may hold folders. A file that can't be
    read or encoded is a row of the report; a job that fails leaves nothing.
    """
    encoders = encoders or {}

    def run(batches: Iterator):
        import pyarrow as pa
        from pyarrow import fs

        for row in (row for batch in batches for row in batch.to_pylist()):  # a file at a time
            data, error = None, None
            try:
                files, path = fs.FileSystem.from_uri(row["path"])
                with files.open_input_stream(path) as f:
                    data = f.read()
                suffix = "." + row["name"].rpartition(".")[2].lower()
                if suffix in encoders:
                    data = encoders[suffix](data)
                if row["rating"] is not None and data[:2] == b"\xff\xd8":
                    data = xmp.with_rating(data, row["rating"])
            except Exception as failed:  # reported by row
                data, error = None, str(failed)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((row["name"], row["output_filename"], data, error), (pa.string(), pa.string(), pa.binary(), pa.string()))], names=["name", "output_filename", "content", "error"])

    read = picks.select("name", "path", "output_filename", F.col("rating").cast("int").alias("rating")).mapInArrow(run, "name string, output_filename string, content binary, error string")
    return write_contents(read, folder)


def write_thumbnails(spark: SparkSession, folder: str, outputs: DataFrame, widths: list[int], target: str) -> DataFrame:
    """outputs(name, stem): PNG thumbnails of a folder's images as <stem>-<width>w.png under the target -> (name, width, output_path, ok, error). Their bytes stay on executors."""
    made = thumbnails(spark, folder, outputs.select("name"), widths).join(outputs, "name")
    file = F.concat("stem", F.lit("-"), F.col("width").cast("string"), F.lit("w.png"))
    report = write_contents(made.select("name", file.alias("output_filename"), "content", F.lit(None).cast("string").alias("error")), target)
    return report.withColumn("width", F.regexp_extract("output_path", r"-(\d+)w\.png$", 1).cast("int"))


def write_bytes(path: str, content: bytes) -> str:
    """A file on a local or shared file system, moved into place; returns its path."""
    from pyarrow import fs

    files, at = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    draft = f"{at.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as f:
        f.write(content)
    files.move(draft, at)
    return at


def write_manifest(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """One JSON object a line; Spark's committed write leaves all or nothing."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(folder)


def write_table(rows: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """State tables (sessions, caches): Parquet with a committed write."""
    writer = rows.write.mode("overwrite" if overwrite else "append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def summary(counts: dict[str, int], picked: int, total: int) -> str:
    """The one-line report of a run."""
    lost = ", ".join(f"{n} {reason}" for reason, n in counts.items() if n)
    return f"kept {picked} of {total}" + (f" (rejected: {lost})" if lost else "")


__all__ = ["RENAME_SCHEMES", "changes_of_name", "claim", "fitted", "folder_entries", "guard_output", "preview_width", "resized", "save_session", "summary", "tally", "thumbnail_plan", "thumbnails", "write_bytes", "write_contents", "write_files", "write_manifest", "write_table", "write_thumbnails"]
