"""The quality gate: one ordered check a frame, with a reason code and a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SHARPNESS, MIN_LONG_EDGE = 60.0, 800
REASONS = ("duplicates", "unreadable", "too_small", "blurry")


def with_gate(frames: DataFrame, min_sharpness: float = MIN_SHARPNESS, min_long_edge: int = MIN_LONG_EDGE) -> DataFrame:
    """Adds gate struct<kept, code, reason, sharpness, long_edge>. Small frames are not measured: their sharpness is 0."""
    edge = F.greatest("width", "height")
    unreadable, small = ~F.col("decode_ok"), edge < min_long_edge
    blurry = F.col("sharpness") < min_sharpness

    def case(bad: Column, tiny: Column, dull: Column, fine: Column) -> Column:
        return F.when(unreadable, bad).when(small, tiny).when(blurry, dull).otherwise(fine)

    lit = F.lit
    reason = case(
        lit("unreadable"),
        F.format_string(f"too small (%dpx < {min_long_edge})", edge),
        F.format_string(f"blurry (sharpness %.1f < {float(min_sharpness)})", F.bround("sharpness", 1)),
        lit(""),
    )
    gate = F.struct(
        case(lit(False), lit(False), lit(False), lit(True)).alias("kept"),
        case(lit("unreadable"), lit("too_small"), lit("blurry"), lit("")).alias("code"),
        reason.alias("reason"),
        case(lit(0.0), lit(0.0), F.col("sharpness"), F.col("sharpness")).alias("sharpness"),
        case(lit(0), edge, edge, edge).alias("long_edge"),
    )
    return frames.withColumn("gate", gate)


def reason_counts(rejects: DataFrame) -> DataFrame:
    """rejects(name, reason) -> (reason, n): reasons without rows don't appear."""
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def all_rejected(rejects: DataFrame) -> DataFrame:
    """rejects(name, reason) -> (name, reason): each name once, with its first reason in the order of REASONS."""
    rank = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    return rejects.groupBy("name").agg(F.min_by("reason", rank).alias("reason"))
