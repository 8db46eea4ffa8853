"""Twins: one frame kept of each group of JPEG and HEIC files that share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.functions import text


def twin_losers(frames: DataFrame, name: str = "name") -> DataFrame:
    """Names that lose to a twin, with the winner: (name, winner)."""
    grouped = _grouped(frames, name)
    winners = grouped.groupBy("_key").agg(F.min_by("_name", F.struct("_heic", "_name")).alias("winner"))
    return grouped.join(winners, "_key").where(F.col("_name") != F.col("winner")).select(F.col("_name").alias(name), "winner")


def collapse_twins(frames: DataFrame, name: str = "name") -> DataFrame:
    """Frames less those that lose to a twin. In a group the first JPEG by name wins, else the first HEIC; other formats pass."""
    ext = text.suffix(F.col(name))
    paired = ext.isin(*text.JPEG, *text.HEIC)
    heic = ext.isin(*text.HEIC)
    key = text.twin_key(text.stem(F.col(name)))
    rows = frames.where(paired).withColumn("_key", key)
    best = rows.groupBy("_key").agg(F.min(F.struct(heic.alias("heic"), F.col(name).alias("name"))).alias("_best"))
    kept = rows.join(best, "_key").where(F.col(name) == F.col("_best.name")).drop("_key", "_best")
    return kept.unionByName(frames.where(~paired))


def _grouped(frames: DataFrame, name: str) -> DataFrame:
    ext = text.suffix(F.col(name))
    rows = frames.where(ext.isin(*text.JPEG, *text.HEIC))
    return rows.select(text.twin_key(text.stem(F.col(name))).alias("_key"), F.col(name).alias("_name"), ext.isin(*text.HEIC).alias("_heic"))
