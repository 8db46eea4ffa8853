"""Ranks, percentiles and orders of presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SORT_MODES = ("score", "name", "capture-time")


def check_sort(mode: str) -> None:
    if mode not in SORT_MODES:
        raise ValueError(f"sort={mode!r} is not one of {SORT_MODES}")


def presentation(mode: str, score: str = "score", name: str = "name", time: str = "capture_time") -> list[Column]:
    """How winners are shown; who wins is not changed."""
    check_sort(mode)
    low = F.lower(F.col(name))
    return {"score": [F.desc(score), F.asc(name)], "name": [low, F.asc(name)], "capture-time": [F.asc_nulls_last(time), low, F.asc(name)]}[mode]


def review_order(mode: str, score: str = "score", name: str = "filename", time: str = "capture_time") -> list[Column]:
    """The orders of the review page: a missing time is last, a missing score counts as 0."""
    check_sort(mode)
    low = F.lower(F.col(name))
    return {"score": [F.desc(F.coalesce(score, F.lit(0.0))), low], "name": [low], "capture-time": [F.asc_nulls_last(time), low]}[mode]


def top(frames: DataFrame, n: int, by: list[Column]) -> DataFrame:
    return frames.orderBy(*by).limit(n)


def ranked(rows: DataFrame, by: list[Column], within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based row numbers, restarting in each group. Without a group, only for results already cut to a top n."""
    return rows.withColumn(name, F.row_number().over((W.partitionBy(*within) if within else W).orderBy(*by)))


def top_per_group(rows: DataFrame, group: list[str], n: int, by: list[Column]) -> DataFrame:
    return ranked(rows, by, group).where(F.col("rank") <= n)


def percentiles(rows: DataFrame, score: str = "score", buckets: int = 256) -> DataFrame:
    """Adds percentile, "top N %": ranks are 1 plus the rows strictly above, rounded half up, at least 1.

    Distinct scores are counted, then dealt to `buckets` ranges at approximate quantiles; sums of ranges come first, so that no task
    orders more than one range. Null scores rank last.
    """
    key = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    counts = rows.groupBy(key.alias("_s")).agg(F.count("*").alias("_n"))
    edges = counts.agg(F.percentile_approx("_s", [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    edges = sorted(set(edges), reverse=True)
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e > F.col("_s"))) if edges else F.lit(0)
    dealt = counts.withColumn("_b", bucket)
    sums = dealt.groupBy("_b").agg(F.sum("_n").alias("_w"))  # a row a range
    before = sums.select("_b", F.coalesce(F.sum("_w").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_w").over(W.partitionBy()).alias("_all"))
    above = W.partitionBy("_b").orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, -1)
    place = dealt.join(F.broadcast(before), "_b").select("_s", (F.col("_before") + F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("_r"), "_all")
    share = F.floor(F.col("_r") / F.col("_all") * 100 + 0.5)
    return rows.withColumn("_k", key).join(place, F.col("_k") == F.col("_s")).withColumn("percentile", F.greatest(F.lit(1), share.cast("int"))).drop("_k", "_s", "_r", "_all")


def unseen(rows: DataFrame, key: str, by: list[Column]) -> DataFrame:
    """The first row of each key."""
    return ranked(rows, by, [key], "_first").where("_first = 1").drop("_first")
