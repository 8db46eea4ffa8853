"""Review sessions as files: tolerant reading, and the classifier's score cache."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.shipping import ship

ship(__name__)

SIMILAR = "array<struct<path string, filename string, score double>>"
CANDIDATE = f"struct<idx int, path string, filename string, score double, ai_score int, ai_reason string, decision string, capture_time string, rejected_reason string, similar {SIMILAR}>"
SESSION = f"source_folder string, prompt string, input_count int, reject_summary map<string,int>, candidates array<{CANDIDATE}>, history array<int>, _corrupt_record string"


def session_paths(spark: SparkSession, folders: list[str], root: str | None, file_name: str) -> list[str]:
    """Paths of session files directly in `folders`, then any others below `root`; each once. Listed by the file system, which hides none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf, found = spark._jsc.hadoopConfiguration(), {}
    for folder in folders:
        path = hadoop.Path(folder, file_name)
        files = path.getFileSystem(conf)
        if files.exists(path):
            found[files.makeQualified(path).toString()] = None
    if root:
        files = hadoop.Path(root).getFileSystem(conf)
        every = files.listFiles(hadoop.Path(root), True)
        below = []
        while every.hasNext():
            at = every.next().getPath()
            if at.getName() == file_name:
                below.append(at.toString())
        found |= dict.fromkeys(sorted(below))
    return list(found)


def read_sessions(spark: SparkSession, *folders: str, root: str | None = None, file_name: str = "lumisift-session.json") -> DataFrame:
    """One row a readable session file: file, and the session's fields. Broken files and records are left out.

    Files directly in `folders`, and any below `root`; each once. The name may start with a dot: files are listed first and then read by path.
    """
    if not folders and not root:
        raise ValueError("give at least one folder, or a root")
    paths = spark.createDataFrame([(p,) for p in session_paths(spark, list(folders), root, file_name)], "file string")

    def run(batches: Iterator):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            said = []
            for uri in batch.column(0).to_pylist():
                try:
                    files, path = fs.FileSystem.from_uri(uri)
                    with files.open_input_stream(path) as f:
                        said.append(f.read().decode("utf-8"))
                except (OSError, ValueError):  # gone, or not text
                    said.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["file", "said"])

    found = paths.mapInArrow(run, "file string, said string").select("file", F.from_json("said", SESSION).alias("s")).select("file", "s.*")
    return found.where(F.col("_corrupt_record").isNull() & F.col("candidates").isNotNull()).drop("_corrupt_record")


def candidates(sessions: DataFrame) -> DataFrame:
    """One row a candidate: session, pos, and its fields."""
    return sessions.select(F.col("file").alias("session"), F.posexplode("candidates").alias("pos", "c")).where(F.col("c").isNotNull()).select("session", "pos", "c.*")


def cache_key(path, mtime, size, labels):
    """What a cached score depends on: absolute path, modification time, size, and the labels asked for."""
    from lumisift.functions.text import label_signature

    return F.concat_ws("::", path, F.unix_micros(mtime).cast("string"), size.cast("string"), label_signature(labels))


def cache_split(wanted: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted(key, labels, ...), cached(key, probs map) -> hits with probs, misses. A hit needs the same labels too."""
    held = cached.select("key", "probs")
    both = wanted.join(held, "key", "left")
    fits = F.col("probs").isNotNull() & (F.array_sort(F.map_keys("probs")) == F.array_sort("labels"))
    marked = both.withColumn("_hit", F.coalesce(fits, F.lit(False)))
    return marked.where("_hit").drop("_hit"), marked.where(~F.col("_hit")).drop("_hit", "probs")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, each key's newest answer, or an empty one where there is none."""
    from lumisift.sources import cache

    return cache.read(spark, path)
