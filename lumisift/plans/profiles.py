"""Profiles: named plans from frames and label probabilities to a selection, and their registry.

A profile takes frames(name, score, h, ..., probs map<label, double>) and returns a Selection. Weight overrides are arguments, not
global state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.operators import gate, neardup, rank, twins
from lumisift.operators.rules import MAX_BONUS, Rule, Rules, best_label
from lumisift.operators.selection import Selection

DEFAULT_TOP, PER_BUCKET, OTHERS, PER_PHASE = 9, 6, 6, 8


@dataclass(frozen=True)
class Profile:
    """select(frames), and with rules select(frames, rules) where other weights are asked for."""

    name: str
    select: Callable[..., Selection]
    labels: tuple[str, ...] = ()
    rules: Rules | None = None

    def reweighted(self, weights: dict[str, float]) -> "Profile":
        """The profile with other weights for some of its rules; an error where it has none, or not these."""
        if self.rules is None:
            raise ValueError(f"profile {self.name!r} has no rules to weigh")
        rules = self.rules.reweighted(weights)
        return replace(self, rules=rules, select=lambda frames: self.select(frames, rules))


_REGISTRY: dict[str, Profile] = {}


def register(profile: Profile) -> Profile:
    _REGISTRY[profile.name] = profile
    return profile


def get(name: str) -> Profile:
    if name not in _REGISTRY:
        raise KeyError(f"no profile {name!r}; known: {', '.join(names())}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def _best() -> list:
    return [F.desc("total"), F.asc("name")]


def _explained(frames: DataFrame, rules: Rules | None) -> DataFrame:
    """Adds breakdown and total; without rules the total is the bare score."""
    if rules is None:
        none = F.create_map().cast("map<string,double>")
        return frames.withColumn("breakdown", F.struct(F.col("score").alias("quality"), none.alias("contributions"), F.col("score").alias("total"))).withColumn("total", F.col("score"))
    return frames.withColumn("breakdown", rules.breakdown(F.col("score"), F.col("probs"))).withColumn("total", F.col("breakdown.total"))


def _staged(frames: DataFrame, phases: dict[str, str]) -> DataFrame:
    """Adds label, stage (where several stages share a label, the last has it) and cat_idx."""
    stage_of = {label: stage for stage, label in phases.items()}
    at = {stage: k for k, stage in enumerate(phases)}
    pairs = [F.lit(x) for label, stage in stage_of.items() for x in (label, stage)]
    order = [F.lit(x) for stage, k in at.items() for x in (stage, k)]
    found = frames.withColumn("label", best_label(F.col("probs"), tuple(dict.fromkeys(phases.values()))))
    return found.withColumn("category", F.element_at(F.create_map(*pairs), F.col("label"))).withColumn("cat_idx", F.element_at(F.create_map(*order), F.col("category")))


def featured(frames: DataFrame, n: int = DEFAULT_TOP) -> Selection:
    """The best n by score. No dedup and no gate, so undecodable frames (score 0) may be among few."""
    best = rank.ranked(rank.top(frames, n, [F.desc("score"), F.asc("name")]), [F.desc("score"), F.asc("name")])
    return Selection(best.select(F.lit("featured").alias("category"), F.lit(0).alias("cat_idx"), "rank", "name"))


def bucketed(frames: DataFrame, buckets: dict[str, str], rules: Rules | None, cap: int = PER_BUCKET) -> Selection:
    """The best `cap` by total in the bucket of each frame's likeliest label."""
    rows = _staged(_explained(frames, rules), buckets)
    best = rank.top_per_group(rows, ["category"], cap, _best())
    return Selection(best.select("category", "cat_idx", "rank", "name"), explain=rows.select("name", "breakdown"))


def staged(frames: DataFrame, phases: dict[str, str], rules: Rules | None, others: int = OTHERS) -> Selection:
    """One frame a stage, then the best others.

    A stage takes, of frames not taken yet, the one of its own with the highest (probability, total), or of all if it has none left. Of
    n stages only the first n in each ranking can be taken, so one scan gathers n x n candidates and the chain is resolved on those.
    """
    rows = _staged(_explained(frames, rules), phases)
    n = len(phases)
    wish = [F.struct(F.lit(k).alias("k"), (F.col("category") == stage).alias("own"), F.coalesce(F.try_element_at(F.col("probs"), F.lit(label)), F.lit(0.0)).alias("p")) for k, (stage, label) in enumerate(phases.items())]
    each = rows.select("name", "total", F.explode(F.array(*wish)).alias("w")).select("name", "total", "w.*")
    best = rank.top_per_group(each, ["k"], n, [F.desc("own"), F.desc("p"), F.desc("total"), F.asc("name")])
    taken: dict[str, int] = {}
    for r in sorted(best.select("k", "rank", "name").collect()):  # n x n rows at most
        if r.k not in taken.values() and r.name not in taken:
            taken[r.name] = r.k
    spark = frames.sparkSession
    chosen = spark.createDataFrame([(list(phases)[k], k, 1, name) for name, k in taken.items()], "category string, cat_idx int, rank int, name string")
    rest = rank.ranked(rank.top(rows.where(~F.col("name").isin(*taken)), others, _best()), _best())
    picked = chosen.unionByName(rest.select(F.lit("others").alias("category"), F.lit(n).alias("cat_idx"), "rank", "name"))
    return Selection(picked, explain=rows.select("name", "breakdown"))


def gallery(frames: DataFrame, phases: dict[str, str], rules: Rules | None = None, cap: int = PER_PHASE, chronological: bool = True, min_sharpness: float = gate.MIN_SHARPNESS, min_long_edge: int = gate.MIN_LONG_EDGE, threshold: int = neardup.THRESHOLD) -> Selection:
    """Dedup in order of name, gate, then the best `cap` of each phase by probability x (0.5 + total), oldest first if chronological.

    The frames that outlive their twins are persisted, so that they are decoded once; unpersist when done.
    """
    single = twins.collapse_twins(frames).persist()
    led = neardup.leaders(single, [], threshold)
    kept = single.join(led.where("kept").select("name"), "name", "left_semi")
    gated = gate.with_gate(kept, min_sharpness, min_long_edge)
    rows = _staged(_explained(gated.where("gate.kept"), rules), phases)
    key = F.element_at("probs", F.col("label")) * (F.lit(0.5) + F.col("total"))
    best = rank.top_per_group(rows.withColumn("key", key), ["category"], cap, [F.desc("key"), F.asc("name")])
    if chronological:
        best = rank.ranked(best.drop("rank"), [F.asc_nulls_last("capture_time"), F.asc("name")], ["category"])
    lost = frames.select("name").join(kept.select("name"), "name", "left_anti").select("name", F.lit("duplicates").alias("reason"))
    failed = gated.where("NOT gate.kept").select("name", F.col("gate.code").alias("reason"))
    return Selection(best.select("category", "cat_idx", "rank", "name"), lost.unionByName(failed), rows.select("name", "breakdown"))


class ConfigError(ValueError):
    """A profile description that can't be used."""


def from_config(cfg: dict[str, Any]) -> Profile:
    """A gallery profile from its description: name, phases, per_phase_cap, chronological, quality_gate, dedup, max_bonus, rules."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    phases = cfg.get("phases") if isinstance(cfg, dict) else None
    if not isinstance(phases, dict) or not phases or not all(isinstance(x, str) and x.strip() for kv in phases.items() for x in kv):
        raise ConfigError("phases must map names to labels, and not be empty")
    given = cfg.get("rules") or []
    if not isinstance(given, list):
        raise ConfigError("rules must be a list")
    for k, rule in enumerate(given):
        if not isinstance(rule, dict) or not all(isinstance(rule.get(x), str) and rule[x].strip() for x in ("name", "label")):
            raise ConfigError(f"rule {k} needs a name and a label")
        if not number(rule.get("weight")) or rule["weight"] < 0:
            raise ConfigError(f"rule {rule['name']!r} needs a weight of 0 or more")
    if len({r["name"] for r in given}) < len(given):
        raise ConfigError("rule names must differ")
    ceiling = cfg.get("max_bonus", MAX_BONUS)
    if not number(ceiling) or ceiling < 0:
        raise ConfigError("max_bonus must be 0 or more")
    rules = Rules(tuple(Rule(r["name"], r["label"], float(r["weight"])) for r in given), float(ceiling)) if given else None
    quality, dedup = cfg.get("quality_gate") or {}, cfg.get("dedup") or {}
    how = {
        "cap": int(cfg.get("per_phase_cap", PER_PHASE)),
        "chronological": bool(cfg.get("chronological", True)),
        "min_sharpness": float(quality.get("min_sharpness", gate.MIN_SHARPNESS)),
        "min_long_edge": int(quality.get("min_long_edge", gate.MIN_LONG_EDGE)),
        "threshold": int(dedup.get("perceptual_threshold", neardup.THRESHOLD)),
    }
    labels = tuple(dict.fromkeys([*phases.values(), *(rules.labels if rules else ())]))
    return Profile(cfg.get("name") or "custom", lambda frames, rules=rules: gallery(frames, dict(phases), rules, **how), labels, rules)


#: The built-in profiles. Names and labels are this engine's own; the weights are fixed values.
DUO = {"people": "a photo of people together", "place": "a photo of a place"}
DUO_RULES = Rules((Rule("glow", "warm glowing light", 0.5), Rule("framing", "a well framed photo", 0.3), Rule("depth", "a photo with depth", 0.15), Rule("calm", "a calm background", 0.1)))
STORY = {"before": "work not begun", "during": "work under way", "after": "work finished"}
STORY_RULES = Rules((Rule("glow", "warm glowing light", 0.5), Rule("tidy", "a tidy scene", 0.2), Rule("detail", "fine detail", 0.15), Rule("wide", "a wide view", 0.12)))

register(Profile("default", featured))
register(Profile("duo", lambda f, rules=DUO_RULES: bucketed(f, DUO, rules), (*DUO.values(), *DUO_RULES.labels), DUO_RULES))
register(Profile("story", lambda f, rules=STORY_RULES: staged(f, STORY, rules), (*STORY.values(), *STORY_RULES.labels), STORY_RULES))
register(Profile("story-gallery", lambda f: gallery(f, STORY), tuple(STORY.values())))
