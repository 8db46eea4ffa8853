"""The score cache as a log: runs append versions, readers take each key's newest, and a compaction rewrites what is live by ranges of keys.

A version is a folder `v=<number>-<id>` of the table's folder, live once its write is committed. A compaction writes such a folder too, and then names, in a file that appears
at once (`_base-<folder>`), what it has merged; readers that began before still find the old versions, which the next compaction removes. A table of plain Parquet files is an oldest version.
Versions appended while a compaction runs are not in its list, so they stay live.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, probs map<string,double>"
PLAIN = "v=000000000000"
#: Keys of a range that a compaction writes as one file, more or less.
RANGE_KEYS = 1_000_000


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, path: str) -> list[str]:
    files, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def _committed(spark: SparkSession, path: str, name: str) -> bool:
    files, at = _files(spark, f"{path}/{name}/_SUCCESS")
    return files.exists(at)


def _bases(spark: SparkSession, path: str, names: list[str]) -> list[dict]:
    """What compactions have merged, the newest last."""
    rows = []
    for name in names:
        if name.startswith("_base-"):
            rows.append(json.loads("".join(r.value for r in spark.read.text(f"{path}/{name}").collect())))  # a few lines
    return rows


def live(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions that a reader takes, oldest first."""
    names = _listed(spark, path)
    merged = {x for base in _bases(spark, path, names) for x in base["merged"]}
    plain = [PLAIN] if any(n.endswith(".parquet") for n in names) else []
    return [n for n in [*plain, *(n for n in names if n.startswith("v=") and _committed(spark, path, n))] if n not in merged]


def read(spark: SparkSession, path: str, versions: list[str] | None = None) -> DataFrame:
    """(key, probs): each key once, as its newest version has it; empty where there is no table."""
    rows = None
    for name in live(spark, path) if versions is None else versions:
        part = spark.read.schema(SCHEMA).option("recursiveFileLookup", False).parquet(f"{path}/*.parquet" if name == PLAIN else f"{path}/{name}").withColumn("version", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], SCHEMA)
    return rows.groupBy("key").agg(F.max_by("probs", "version").alias("probs"))


def _next(spark: SparkSession, path: str) -> str:
    last = max((int(n[2:14]) for n in _listed(spark, path) if n.startswith("v=")), default=0)
    return f"v={last + 1:012}-{uuid.uuid4().hex[:12]}"


def append(rows: DataFrame, path: str) -> str:
    """Writes rows(key, probs) as a new version; two writers at a time make one each."""
    name = _next(rows.sparkSession, path)
    rows.select("key", "probs").write.parquet(f"{path}/{name}")
    return name


def compact(spark: SparkSession, path: str) -> str | None:
    """Merges the live versions into one, and removes those that an earlier compaction has merged. None where there is nothing to merge."""
    names = _listed(spark, path)
    done = {x for base in _bases(spark, path, names) for x in base["merged"]}
    merged = live(spark, path)
    if len(merged) < 2:
        return None
    rows = read(spark, path, merged)
    parts = max(1, -(-rows.count() // RANGE_KEYS))
    name = _next(spark, path)
    rows.repartitionByRange(parts, "key").sortWithinPartitions("key").write.parquet(f"{path}/{name}")
    files, draft = _files(spark, f"{path}/_draft-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps({"base": name, "merged": sorted(done | set(merged))}).encode()))
    out.close()
    files.rename(draft, _files(spark, f"{path}/_base-{name}")[1])  # from here on readers take the new one
    for old in done:
        for gone in [n for n in names if n.endswith(".parquet")] if old == PLAIN else [old]:
            files.delete(_files(spark, f"{path}/{gone}")[1], True)
    return name
