"""The cull: twins, near-duplicates in score order, the gate, and the best n."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.operators import gate, neardup, rank, twins

TOP_N = 30


@dataclass
class Cull:
    """Tables over one lineage.

    keepers(name, score, capture_time, rank, ...): the best n, rank in the order asked for.
    rejects(name, reason); clusters(winner, ord, loser); scored: every frame that outlived its twin, with its score.
    Usable frames beyond the best n are in neither keepers nor rejects.
    """

    keepers: DataFrame
    rejects: DataFrame
    clusters: DataFrame
    scored: DataFrame
    input: DataFrame
    survivors: DataFrame

    def reject_counts(self) -> DataFrame:
        return gate.reason_counts(self.rejects)

    def all_rejected(self) -> DataFrame:
        return gate.all_rejected(self.rejects)

    def input_count(self) -> DataFrame:
        return self.input.agg(F.count("*").alias("input_count"))


def cull(frames: DataFrame, top_n: int = TOP_N, min_sharpness: float = gate.MIN_SHARPNESS, min_long_edge: int = gate.MIN_LONG_EDGE, sort: str = "score", threshold: int = neardup.THRESHOLD, faces: DataFrame | None = None) -> Cull:
    """frames(name, score, h, width, height, decode_ok, sharpness, capture_time, ...); faces(name, multiplier) scale scores.

    Duplicates are dropped before the gate and in order of score, so a leader that fails the gate takes its cluster with it.
    Survivors (without grids) are persisted, so that frames are decoded once; unpersist `survivors` when done.
    """
    rank.check_sort(sort)
    survivors = twins.collapse_twins(frames)
    if faces is not None:
        survivors = survivors.join(faces.select("name", "multiplier"), "name", "left").withColumn("score", F.col("score") * F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")
    best = [F.desc("score"), F.asc("name")]
    survivors = survivors.drop("grid").persist()
    led = neardup.leaders(survivors, [-F.col("score")], threshold)
    leaders = survivors.join(led.where("kept").select("name"), "name", "left_semi")
    gated = gate.with_gate(leaders, min_sharpness, min_long_edge)
    winners = rank.top(gated.where("gate.kept"), top_n, best)
    keepers = rank.ranked(winners, rank.presentation(sort))
    twin_drops = frames.select("name").join(survivors.select("name"), "name", "left_anti").select("name", F.lit("duplicates").alias("reason"))
    near_drops = led.where("NOT kept").select("name", F.lit("duplicates").alias("reason"))
    failed = gated.where("NOT gate.kept").select("name", F.col("gate.code").alias("reason"))
    rejects = twin_drops.unionByName(near_drops).distinct().unionByName(failed)
    return Cull(keepers, rejects, neardup.clusters(led, survivors, [-F.col("score")]), survivors.select("name", "score"), frames, survivors)
