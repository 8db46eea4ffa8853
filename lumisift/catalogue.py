"""The catalogue: one query for each operator over the test tables, with the same query in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift import sinks
from lumisift.functions import exif, raster, text, xmp
from lumisift.operators import classify, gate, neardup, rank, review, rules, selection, twins
from lumisift.plans import profiles
from lumisift.plans.cull import cull
from lumisift.sources import frames as frame_source
from lumisift.sources import sessions, testdata
from lumisift.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _list(items) -> str:
    return "[" + ", ".join(str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'" for x in items) + "]"


# --- the relations in SQL ------------------------------------------------------------------------------------------

_SECOND = "v % 64, (v * 7) % 64"
_THIRD = f"{_SECOND}, (v * 13 + 1) % 64, (v * 17 + 2) % 64, (v * 29 + 3) % 64"
_FLIP = "list_transform(grid, lambda p, i: CASE WHEN list_contains([{}], i - 1) THEN 255 - p ELSE p END)"

FRAMES = f"""
e0 AS (SELECT vec_id AS v, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, {_list(testdata.CONTRAST)}[vec_id % 8 + 1] AS amp FROM embeddings),
e1 AS (SELECT *, list_min(e) AS low, list_max(e) AS high, (255 - amp) // 2 + (v % 5 - 2) * ((255 - amp) // 5) AS base FROM e0),
e2 AS (SELECT v, list_transform(e, lambda x: CAST(floor((x - low) / (high - low) * amp) AS INTEGER) + CAST(base AS INTEGER)) AS grid FROM e1),
e3 AS (
  SELECT v AS frame_id, grid FROM e2
  UNION ALL SELECT v + {testdata.SECOND}, {_FLIP.format(_SECOND)} FROM e2 WHERE v % 5 = 0
  UNION ALL SELECT v + {testdata.THIRD}, {_FLIP.format(_THIRD)} FROM e2 WHERE v % 10 = 0),
e4 AS (
  SELECT frame_id, 'frame_' || lpad(CAST(CASE WHEN frame_id % 10 = 1 THEN frame_id - 1 ELSE frame_id END AS VARCHAR), 9, '0') || '.' ||
      ['jpg', 'heic', 'JPEG', 'webp', 'png', 'heic', 'gif', 'jpg', 'jpg', 'jpg'][frame_id % 10 + 1] AS name,
    CAST(400 + frame_id * 37 % 1200 AS INTEGER) AS width, CAST(300 + frame_id * 53 % 1000 AS INTEGER) AS height, frame_id % 23 <> 5 AS decode_ok,
    CASE WHEN frame_id % 6 <> 0 THEN frame_id * 7919 % 1000000 END AS capture_time, grid,
    CAST(list_sum(grid) AS BIGINT) AS s,
    list_transform(range(0, 64), lambda i: grid[CASE WHEN i < 8 THEN i + 8 ELSE i - 8 END + 1] + grid[CASE WHEN i >= 56 THEN i - 8 ELSE i + 8 END + 1]
      + grid[CASE WHEN i % 8 = 0 THEN i + 1 ELSE i - 1 END + 1] + grid[CASE WHEN i % 8 = 7 THEN i - 1 ELSE i + 1 END + 1] - 4 * grid[i + 1]) AS lap
  FROM e3),
e5 AS (
  SELECT *, CASE WHEN decode_ok THEN CAST(64 * CAST(list_sum(list_transform(lap, lambda x: x * x)) AS BIGINT) - CAST(list_sum(lap) AS BIGINT) * CAST(list_sum(lap) AS BIGINT) AS DOUBLE) / 4096.0::DOUBLE ELSE 0.0::DOUBLE END AS sharpness,
    CASE WHEN decode_ok THEN 1.0::DOUBLE - 2.0::DOUBLE * abs(CAST(s AS DOUBLE) / 64.0::DOUBLE / 255.0::DOUBLE - 0.5::DOUBLE) ELSE 0.0::DOUBLE END AS exposure,
    CASE WHEN decode_ok THEN list_sum(list_transform(grid, lambda x, i: CASE WHEN x * 64 > s THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) END AS u
  FROM e4),
frames AS (
  SELECT *, 0.7::DOUBLE * least(sharpness / 1000.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * exposure AS score,
    CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS h FROM e5)"""


def _twins(source: str, name: str = "kept_twins") -> str:
    ext = "lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1))"
    key = "substr(regexp_replace(name, '\\.[^.]+$', ''), 1, 15)"
    return f"""
{name}_g AS (SELECT *, {ext} AS tw_ext, {key} AS tw_key FROM {source}),
{name}_w AS (SELECT tw_key, arg_min(name, (CASE WHEN tw_ext IN ('.heic', '.heif') THEN 1 ELSE 0 END, name)) AS winner FROM {name}_g WHERE tw_ext IN ('.jpg', '.jpeg', '.heic', '.heif') GROUP BY tw_key),
{name} AS (SELECT g.* EXCLUDE (tw_ext, tw_key) FROM {name}_g g LEFT JOIN {name}_w w USING (tw_key) WHERE g.tw_ext NOT IN ('.jpg', '.jpeg', '.heic', '.heif') OR g.name = w.winner)"""


def _greedy(source: str, order: str, name: str = "led", threshold: int = neardup.THRESHOLD) -> str:
    """The sequential scan as a recursive query that carries the kept hashes; needs WITH RECURSIVE."""
    return f"""
{name}_o AS (SELECT row_number() OVER (ORDER BY {order}) AS ord, name, h FROM {source}),
{name}_r AS (
  SELECT CAST(0 AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS name, true AS kept, CAST(NULL AS VARCHAR) AS winner, CAST([] AS BIGINT[]) AS hs, CAST([] AS VARCHAR[]) AS ns
  UNION ALL
  SELECT ord, name, hit IS NULL, ns[hit], CASE WHEN hit IS NULL AND h IS NOT NULL THEN list_append(hs, h) ELSE hs END, CASE WHEN hit IS NULL AND h IS NOT NULL THEN list_append(ns, name) ELSE ns END
  FROM (SELECT o.ord, o.name, o.h, r.hs, r.ns, nullif(coalesce(list_position(list_transform(r.hs, lambda k: bit_count(xor(k, o.h)) <= {threshold}), true), 0), 0) AS hit
    FROM {name}_r r JOIN {name}_o o ON o.ord = r.ord + 1)),
{name} AS (SELECT name, kept, winner FROM {name}_r WHERE ord > 0)"""


def _gate(source: str, name: str = "gated", sharp: float = gate.MIN_SHARPNESS, edge: int = gate.MIN_LONG_EDGE) -> str:
    return f"""
{name} AS (
  SELECT *, CASE WHEN NOT decode_ok THEN 'unreadable' WHEN greatest(width, height) < {edge} THEN 'too_small' WHEN sharpness < {sharp} THEN 'blurry' ELSE '' END AS code,
    CASE WHEN NOT decode_ok THEN 'unreadable' WHEN greatest(width, height) < {edge} THEN 'too small (' || greatest(width, height) || 'px < {edge})'
      WHEN sharpness < {sharp} THEN printf('blurry (sharpness %.1f < {sharp})', sharpness) ELSE '' END AS reason,
    CASE WHEN decode_ok AND greatest(width, height) >= {edge} THEN sharpness ELSE 0.0::DOUBLE END AS gate_sharpness,
    CASE WHEN decode_ok THEN greatest(width, height) ELSE 0 END AS long_edge FROM {source})"""


CULL = f"""{FRAMES},{_twins("frames", "survivors")},{_greedy("survivors", "score DESC, name")},
leaders AS (SELECT s.* FROM survivors s JOIN led USING (name) WHERE kept),{_gate("leaders")},
winners AS (SELECT * FROM gated WHERE code = '' ORDER BY score DESC, name LIMIT 30),
rejects AS (
  SELECT name, 'duplicates' AS reason FROM frames WHERE name NOT IN (SELECT name FROM survivors)
  UNION SELECT name, 'duplicates' FROM led WHERE NOT kept
  UNION ALL SELECT name, code FROM gated WHERE code <> '')"""


def _probs(labels, name: str) -> str:
    """frames -> the same with p, a list of probabilities in label order."""
    k = len(labels)
    parts = [f"(1 + coalesce(CAST(list_sum(list_filter(grid, lambda x, i: (i - 1) % {k} = {j})) AS BIGINT), 0))" for j in range(k)]
    return f"{name} AS (SELECT *, list_transform(w, lambda x: CAST(x AS DOUBLE) / CAST(list_sum(w) AS DOUBLE)) AS p FROM (SELECT *, [{', '.join(parts)}] AS w FROM frames))"


def _points(stack: rules.Rules, at: int, quality: str = "score") -> tuple[list[str], str]:
    """Points of each rule and the total, where the rules' probabilities start at p[at]."""
    raw = [f"({float(r.weight)!r}::DOUBLE * p[{at + k}])" for k, r in enumerate(stack.rules)]
    earned = "(" + " + ".join(["0.0::DOUBLE", *raw]) + ")"
    scale = f"(CASE WHEN {earned} > {stack.max_bonus!r} THEN {float(stack.max_bonus)!r}::DOUBLE / {earned} ELSE 1.0::DOUBLE END)"
    points = [f"({quality} * {x} * {scale})" for x in raw]
    return points, f"({quality} + (" + " + ".join(["0.0::DOUBLE", *points]) + "))"


def _argmax(n: int) -> str:
    return f"list_position(p[1:{n}], list_max(p[1:{n}]))"


# --- scans and pixels ----------------------------------------------------------------------------------------------

FILES = r"""
files AS (SELECT regexp_replace(substr(text, 1, 24), '[./\n\r\t]', '_', 'g') || '_' || doc_id || ['.heic', '.jpg', '.JPEG', '.png', '.txt'][doc_id % 5 + 1] AS name, n_chars AS size FROM documents)"""


@query(f"WITH {FILES} SELECT name, size FROM files WHERE lower(regexp_extract(name, '(\\.[^.]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.heic', '.webp')")
def scan_extension_filter(spark, sf_dir):
    return frame_source.discovered(testdata.files(spark, sf_dir))


@query(f"WITH {FRAMES} SELECT frame_id, s AS level_sum, round(1.0::DOUBLE - 2.0::DOUBLE * abs(CAST(s AS DOUBLE) / 64.0::DOUBLE / 255.0::DOUBLE - 0.5::DOUBLE), 9) AS exposure FROM frames")
def grid_mean_exposure(spark, sf_dir):
    g = F.col("grid")
    return testdata.frame_grids(spark, sf_dir).select("frame_id", raster.grid_sum(g).alias("level_sum"), F.round(raster.exposure(g), 9).alias("exposure"))


@query(f"WITH {FRAMES} SELECT frame_id, round(sharpness, 6) AS sharpness FROM frames WHERE decode_ok")
def grid_laplacian_variance(spark, sf_dir):
    return testdata.frames(spark, sf_dir).where("decode_ok").select("frame_id", F.round("sharpness", 6).alias("sharpness"))


@query(f"WITH {FRAMES} SELECT frame_id, round(score, 9) AS score FROM frames")
def composite_score(spark, sf_dir):
    return testdata.frames(spark, sf_dir).select("frame_id", F.round("score", 9).alias("score"))


@query(f"WITH {FRAMES} SELECT frame_id, h FROM frames WHERE h IS NOT NULL")
def average_hash(spark, sf_dir):
    return testdata.frames(spark, sf_dir).where("h IS NOT NULL").select("frame_id", "h")


_PAIRS = f"""WITH {FRAMES}, d AS (SELECT DISTINCT h FROM frames WHERE h IS NOT NULL)
SELECT x.h AS a, y.h AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS bits FROM d x JOIN d y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= 6"""


def _pairs(spark, sf_dir, **how):
    hashes = testdata.frames(spark, sf_dir).where("h IS NOT NULL").select("h").distinct()
    return neardup.similar_pairs(hashes, neardup.THRESHOLD, **how).withColumn("bits", raster.hamming(F.col("a"), F.col("b")))


@query(_PAIRS)
def hamming_pairs_naive(spark, sf_dir):
    return _pairs(spark, sf_dir, compare_all=True)


@query(_PAIRS)
def hamming_pairs_banded(spark, sf_dir):
    return _pairs(spark, sf_dir, plan=neardup.plan_bands(100_000, neardup.THRESHOLD))


@query(f"WITH {FILES},{_twins('files')} SELECT name, size FROM kept_twins")
def twin_collapse(spark, sf_dir):
    return twins.collapse_twins(testdata.files(spark, sf_dir))


@query(f"WITH {FILES},{_twins('files')} SELECT f.name, w.winner FROM kept_twins_g f JOIN kept_twins_w w USING (tw_key) WHERE f.tw_ext IN ('.jpg', '.jpeg', '.heic', '.heif') AND f.name <> w.winner")
def twin_losers(spark, sf_dir):
    return twins.twin_losers(testdata.files(spark, sf_dir))


# --- near-duplicates -----------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {FRAMES},{_greedy('frames', 'score DESC, name')} SELECT name, kept FROM led")
def neardup_kept(spark, sf_dir):
    return neardup.leaders(testdata.frames(spark, sf_dir), [-F.col("score")]).select("name", "kept")


@query(f"WITH RECURSIVE {FRAMES},{_greedy('frames', 'score DESC, name')} SELECT winner, CAST(row_number() OVER (PARTITION BY winner ORDER BY score DESC, name) AS INTEGER) AS ord, name AS loser FROM led JOIN frames USING (name) WHERE NOT kept")
def neardup_clusters(spark, sf_dir):
    rows = testdata.frames(spark, sf_dir)
    return neardup.clusters(neardup.leaders(rows, [-F.col("score")]), rows, [-F.col("score")])


@query(f"WITH RECURSIVE {FRAMES},{_greedy('frames', 'name', threshold=16)} SELECT name, kept, winner FROM led")
def neardup_wide_threshold(spark, sf_dir):
    return neardup.leaders(testdata.frames(spark, sf_dir), [], 16)


@query(f"WITH RECURSIVE {FRAMES},{_twins('frames', 'survivors')},{_greedy('survivors', 'name')} SELECT name FROM led WHERE kept")
def dedup_all(spark, sf_dir):
    return neardup.leaders(twins.collapse_twins(testdata.frames(spark, sf_dir)), []).where("kept").select("name")


# --- gate and attribution ------------------------------------------------------------------------------------------


@query(f"WITH {FRAMES},{_gate('frames')} SELECT name, code = '' AS kept, code, reason, round(gate_sharpness, 6) AS sharpness, long_edge FROM gated")
def quality_gate(spark, sf_dir):
    g = gate.with_gate(testdata.frames(spark, sf_dir))
    return g.select("name", "gate.kept", "gate.code", "gate.reason", F.round("gate.sharpness", 6).alias("sharpness"), "gate.long_edge")


@query(f"WITH {FRAMES},{_gate('frames')} SELECT code AS reason, count(*) AS n FROM gated WHERE code <> '' GROUP BY code")
def gate_reject_counts(spark, sf_dir):
    g = gate.with_gate(testdata.frames(spark, sf_dir)).where("NOT gate.kept")
    return gate.reason_counts(g.select("name", F.col("gate.code").alias("reason")))


@query(f"WITH RECURSIVE {CULL} SELECT name, reason FROM rejects")
def reject_attribution(spark, sf_dir):
    return cull(testdata.frames(spark, sf_dir)).rejects


@query(f"WITH RECURSIVE {CULL} SELECT name, ['duplicates', 'unreadable', 'too_small', 'blurry'][min(list_position(['duplicates', 'unreadable', 'too_small', 'blurry'], reason))] AS reason FROM rejects GROUP BY name")
def all_rejected_distinct(spark, sf_dir):
    return cull(testdata.frames(spark, sf_dir)).all_rejected()


@query(f"WITH RECURSIVE {CULL} SELECT reason, count(*) AS n FROM rejects GROUP BY reason")
def cull_reject_counts(spark, sf_dir):
    return cull(testdata.frames(spark, sf_dir)).reject_counts()


@query(f"WITH RECURSIVE {CULL} SELECT name, round(score, 9) AS score FROM survivors")
def cull_all_scores(spark, sf_dir):
    return cull(testdata.frames(spark, sf_dir)).scored.select("name", F.round("score", 9).alias("score"))


def _cull_sql(order: str) -> str:
    return f"WITH RECURSIVE {CULL} SELECT name, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM winners"


def _keepers(spark, sf_dir, sort):
    return cull(testdata.frames(spark, sf_dir), sort=sort).keepers.select("name", F.round("score", 9).alias("score"), "rank")


@query(_cull_sql("score DESC, name"))
def cull_top_n(spark, sf_dir):
    return _keepers(spark, sf_dir, "score")


@query(_cull_sql("lower(name), name"))
def cull_by_name(spark, sf_dir):
    return _keepers(spark, sf_dir, "name")


@query(_cull_sql("capture_time ASC NULLS LAST, lower(name), name"))
def cull_by_time(spark, sf_dir):
    return _keepers(spark, sf_dir, "capture-time")


def _faces(spark, sf_dir):
    """Two eyes from twelve points of the grid; a frame in three has no face."""
    rows = testdata.frames(spark, sf_dir)
    eye = lambda at: raster.eye_aspect_ratio([(F.get("grid", at + 2 * k).cast("double"), F.get("grid", at + 2 * k + 1).cast("double")) for k in range(6)])
    least = F.when(F.col("frame_id") % 3 != 0, F.least(eye(0), eye(12)))
    return rows.withColumn("least_ratio", least).withColumn("multiplier", raster.face_multiplier(F.col("least_ratio")))


def _eye_sql(at: int) -> str:
    x = lambda k: f"CAST(grid[{at + 2 * k + 1}] AS DOUBLE)"
    y = lambda k: f"CAST(grid[{at + 2 * k + 2}] AS DOUBLE)"
    away = lambda a, b: f"sqrt(pow({x(a)} - {x(b)}, 2) + pow({y(a)} - {y(b)}, 2))"
    return f"CASE WHEN {away(0, 3)} = 0 THEN 0.0::DOUBLE ELSE ({away(1, 5)} + {away(2, 4)}) / (2.0::DOUBLE * {away(0, 3)}) END"


@query(f"WITH {FRAMES}, r AS (SELECT *, CASE WHEN frame_id % 3 <> 0 THEN least({_eye_sql(0)}, {_eye_sql(12)}) END AS least_ratio FROM frames) SELECT name, round(least_ratio, 6) AS least_ratio, round(score * CASE WHEN least_ratio < 0.2 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM r")
def face_downrank(spark, sf_dir):
    return _faces(spark, sf_dir).select("name", F.round("least_ratio", 6).alias("least_ratio"), F.round(F.col("score") * F.col("multiplier"), 6).alias("score"))


@query(f"WITH {FRAMES} SELECT name, CAST(row_number() OVER (ORDER BY score DESC, name) AS INTEGER) AS rank, 'featured' AS category FROM (SELECT * FROM frames ORDER BY score DESC, name LIMIT 9)")
def default_top9(spark, sf_dir):
    return profiles.get("default").select(testdata.frames(spark, sf_dir)).picked.select("name", "rank", "category")


# --- rules and profiles --------------------------------------------------------------------------------------------

_RULES = profiles.STORY_RULES
_RULE_LABELS = _RULES.labels
#: A stack that earns more than its ceiling.
_RICH = rules.Rules(tuple(rules.Rule(r.name, r.label, 4.0 - k) for k, r in enumerate(_RULES.rules)))
_OVERRIDE = {"tidy": 0.9, "wide": 0.0}


def _rule_sql(stack: rules.Rules) -> str:
    points, total = _points(stack, 1)
    each = ", ".join(f"round({x}, 9) AS {r.name}" for x, r in zip(points, stack.rules))
    return f"WITH {FRAMES}, {_probs(_RULE_LABELS, 'r')} SELECT frame_id, {each}, round({total}, 9) AS total FROM r"


def _rule_rows(spark, sf_dir, stack: rules.Rules):
    rows = testdata.with_probs(testdata.frames(spark, sf_dir), _RULE_LABELS).withColumn("b", stack.breakdown(F.col("score"), F.col("probs")))
    each = [F.round(F.col("b.contributions")[r.name], 9).alias(r.name) for r in stack.rules]
    return rows.select("frame_id", *each, F.round("b.total", 9).alias("total"))


@query(_rule_sql(_RULES))
def rule_contributions(spark, sf_dir):
    return _rule_rows(spark, sf_dir, _RULES)


@query(_rule_sql(_RICH))
def rule_saturation(spark, sf_dir):
    return _rule_rows(spark, sf_dir, _RICH)


@query(_rule_sql(_RULES.reweighted(_OVERRIDE)))
def weight_override(spark, sf_dir):
    return _rule_rows(spark, sf_dir, _RULES.reweighted(_OVERRIDE))


@query(f"WITH {FRAMES}, {_probs(tuple(profiles.STORY.values()), 'r')} SELECT frame_id, {_list(profiles.STORY.values())}[{_argmax(3)}] AS label FROM r")
def best_label_argmax(spark, sf_dir):
    labels = tuple(profiles.STORY.values())
    return testdata.with_probs(testdata.frames(spark, sf_dir), labels).select("frame_id", rules.best_label(F.col("probs"), labels).alias("label"))


@query(f"WITH {FRAMES}, l AS (SELECT frame_id, list_transform(grid[1:5], lambda x: CAST(x AS DOUBLE) / 16.0::DOUBLE) AS l FROM frames), x AS (SELECT frame_id, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM l) SELECT frame_id, {', '.join(f'round(e[{k}] / list_sum(e), 6) AS p{k}' for k in range(1, 6))} FROM x")
def softmax_labels(spark, sf_dir):
    logits = F.transform(F.slice("grid", 1, 5), lambda x: x / F.lit(16.0))
    p = testdata.frames(spark, sf_dir).select("frame_id", rules.softmax(logits).alias("p"))
    return p.select("frame_id", *[F.round(F.get("p", k), 6).alias(f"p{k + 1}") for k in range(5)])


def _parts_sql(labels, name: str = "frames") -> str:
    w = ", ".join(f"CAST((p_partkey * {31 + 2 * j} + p_size * {7 + j}) % {53 + j} + 1 AS BIGINT)" for j in range(len(labels)))
    return f"""
{name}_w AS (SELECT 'part_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || CASE WHEN p_partkey % 3 = 0 THEN '.heic' ELSE '.JPG' END AS name, p_size / 50.0::DOUBLE AS score, [{w}] AS w FROM part),
{name} AS (SELECT name, score, list_transform(w, lambda x: CAST(x AS DOUBLE) / CAST(list_sum(w) AS DOUBLE)) AS p FROM {name}_w)"""


_DUO_LABELS = profiles.get("duo").labels
_DUO_PICKS = f"""WITH {_parts_sql(_DUO_LABELS)},
t AS (SELECT name, {_list(profiles.DUO)}[{_argmax(2)}] AS category, {_argmax(2)} - 1 AS cat_idx, {_points(profiles.DUO_RULES, 3)[1]} AS total FROM frames),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY total DESC, name) AS rank FROM t),
picks AS (SELECT category, CAST(cat_idx AS INTEGER) AS cat_idx, CAST(rank AS INTEGER) AS rank, name FROM k WHERE rank <= 6)"""


def _duo(spark, sf_dir) -> selection.Selection:
    return profiles.get("duo").select(testdata.parts(spark, sf_dir, _DUO_LABELS))


@query(f"{_DUO_PICKS} SELECT category, cat_idx, rank, name FROM picks")
def bucket_top6(spark, sf_dir):
    return _duo(spark, sf_dir).picked


def _staged_sql() -> str:
    total = _points(profiles.STORY_RULES, 4)[1]
    steps = [f"t AS (SELECT name, p, {_argmax(3)} AS best, {total} AS total FROM r)"]
    used = []
    for k in range(3):
        free = " AND ".join([f"name NOT IN (SELECT name FROM s{j})" for j in used]) or "true"
        steps.append(f"s{k} AS (SELECT name FROM t WHERE {free} ORDER BY best = {k + 1} DESC, p[{k + 1}] DESC, total DESC, name LIMIT 1)")
        used.append(k)
    free = " AND ".join(f"name NOT IN (SELECT name FROM s{j})" for j in used)
    picks = " UNION ALL ".join(f"SELECT '{stage}' AS category, {k} AS cat_idx, 1 AS rank, name FROM s{k}" for k, stage in enumerate(profiles.STORY))
    rest = f"SELECT 'others', 3, CAST(row_number() OVER (ORDER BY total DESC, name) AS INTEGER), name FROM (SELECT * FROM t WHERE {free} ORDER BY total DESC, name LIMIT 6)"
    return f"WITH {FRAMES}, {_probs(profiles.get('story').labels, 'r')}, {', '.join(steps)} {picks} UNION ALL {rest}"


@query(_staged_sql())
def staged_greedy_pick(spark, sf_dir):
    profile = profiles.get("story")
    return profile.select(testdata.with_probs(testdata.frames(spark, sf_dir), profile.labels)).picked


CONFIG = {
    "name": "trip", "phases": {"leaving": "packed bags", "there": "a far place", "home": "a front door"}, "per_phase_cap": 5, "chronological": False, "max_bonus": 0.4,
    "quality_gate": {"min_sharpness": 30.0, "min_long_edge": 700}, "dedup": {"perceptual_threshold": 8},
    "rules": [{"name": "sun", "label": "sunshine", "weight": 0.6}, {"name": "sea", "label": "the sea", "weight": 0.8}],
}


def _gallery_sql(stages, labels, stack, cap, chronological, sharp, edge, threshold, what="picks") -> str:
    total = _points(stack, 1 + len(stages))[1] if stack else "score"
    shown = "row_number() OVER (PARTITION BY best ORDER BY capture_time ASC NULLS LAST, name)" if chronological else "place"
    names = _list(stages)
    end = {
        "picks": f"SELECT {names}[best] AS category, CAST(best - 1 AS INTEGER) AS cat_idx, CAST({shown} AS INTEGER) AS rank, name FROM k WHERE place <= {cap}",
        "rejects": "SELECT name, 'duplicates' AS reason FROM frames WHERE name NOT IN (SELECT name FROM kept) UNION ALL SELECT name, code FROM gated WHERE code <> ''",
    }[what]
    return f"""WITH RECURSIVE {FRAMES},{_twins("frames", "single")},{_greedy("single", "name", threshold=threshold)},
kept AS (SELECT s.* FROM single s JOIN led USING (name) WHERE kept),{_gate("kept", "gated", sharp, edge)},
{_probs(labels, "r").replace("FROM frames", "FROM gated WHERE code = ''")},
t AS (SELECT name, capture_time, {_argmax(len(stages))} AS best, p[{_argmax(len(stages))}] * (0.5::DOUBLE + {total}) AS key FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY best ORDER BY key DESC, name) AS place FROM t)
{end}"""


def _gallery(spark, sf_dir):
    profile = profiles.get("story-gallery")
    return profile.select(testdata.with_probs(testdata.frames(spark, sf_dir), profile.labels))


_GALLERY = (list(profiles.STORY), profiles.get("story-gallery").labels, None, 8, True, gate.MIN_SHARPNESS, gate.MIN_LONG_EDGE, neardup.THRESHOLD)


@query(_gallery_sql(*_GALLERY))
def phase_gallery(spark, sf_dir):
    return _gallery(spark, sf_dir).picked


@query(_gallery_sql(*_GALLERY, what="rejects"))
def phase_gallery_rejects(spark, sf_dir):
    return _gallery(spark, sf_dir).rejected


@query(_gallery_sql(list(CONFIG["phases"]), profiles.from_config(CONFIG).labels, profiles.from_config(CONFIG).rules, 5, False, 30.0, 700, 8))
def config_profile(spark, sf_dir):
    profile = profiles.from_config(CONFIG)
    return profile.select(testdata.with_probs(testdata.frames(spark, sf_dir), profile.labels)).picked


# --- ranks, names and manifests ------------------------------------------------------------------------------------


@query(f"{_DUO_PICKS} SELECT category, rank, name, CAST(row_number() OVER (ORDER BY cat_idx, rank) AS INTEGER) AS global_rank FROM picks")
def global_rank(spark, sf_dir):
    return selection.global_rank(_duo(spark, sf_dir).picked).select("category", "rank", "name", "global_rank")


def _manifest_json(entry: str) -> str:
    return f"""'{{"profile":"duo","category":"' || category || '","picks":[' || string_agg({entry}, ',' ORDER BY rank) || ']}}'"""


@query(f"""{_DUO_PICKS} SELECT category, {_manifest_json("'{\"rank\":' || rank || ',\"filename\":\"' || name || '\"}'")} AS json FROM picks GROUP BY category""")
def manifest_category_rank(spark, sf_dir):
    return selection.manifest(_duo(spark, sf_dir), "duo")


@query(f"""{_DUO_PICKS}, g AS (SELECT *, row_number() OVER (ORDER BY cat_idx, rank) AS n, CASE WHEN name LIKE '%.heic' THEN '.jpg' ELSE lower(regexp_extract(name, '(\\.[^.]+)$', 1)) END AS ext FROM picks)
SELECT name, CASE WHEN name LIKE '%.heic' THEN regexp_replace(name, '\\.heic$', '.jpg') ELSE name END AS original, lpad(CAST(n AS VARCHAR), 2, '0') || ext AS sequential, category || '-' || lpad(CAST(rank AS VARCHAR), 2, '0') || ext AS by_category FROM g""")
def output_names(spark, sf_dir):
    rows = selection.global_rank(_duo(spark, sf_dir).picked)
    named = lambda scheme: selection.output_name(F.col("name"), F.col("category"), F.col("rank"), F.col("global_rank"), F.lit(12), scheme)
    return rows.select("name", named("original").alias("original"), named("sequential").alias("sequential"), named("category-rank").alias("by_category"))


@query(f"{_DUO_PICKS} SELECT name, arg_min(category, (cat_idx, rank)) AS category FROM picks GROUP BY name")
def all_picked_distinct(spark, sf_dir):
    return _duo(spark, sf_dir).all_picked().select("name", "category")


@query(f"{_DUO_PICKS} SELECT name, round(total, 9) AS total FROM t WHERE name IN (SELECT name FROM picks)")
def explained_picks(spark, sf_dir):
    return _duo(spark, sf_dir).explained_picks().select("name", F.round("breakdown.total", 9).alias("total"))


@query(f"WITH RECURSIVE {CULL}, k AS (SELECT name, row_number() OVER (ORDER BY score DESC, name) AS rank, count(*) OVER () AS n FROM winners) SELECT name, CAST(rank AS INTEGER) AS rank, CAST(greatest(1, 5 - (rank - 1) * 5 // n) AS INTEGER) AS stars FROM k")
def star_rating(spark, sf_dir):
    keepers = cull(testdata.frames(spark, sf_dir)).keepers.select("name", "rank")
    total = keepers.agg(F.count("*").alias("n"))
    return keepers.crossJoin(F.broadcast(total)).select("name", "rank", xmp.star_rating(F.col("rank"), F.col("n")).alias("stars"))  # one row is broadcast


@query(f"WITH {FRAMES} SELECT name, CAST(greatest(1, floor(CAST(rank() OVER (ORDER BY score DESC) AS DOUBLE) / CAST(count(*) OVER () AS DOUBLE) * 100 + 0.5)) AS INTEGER) AS percentile FROM frames")
def quality_percentile(spark, sf_dir):
    return rank.percentiles(testdata.frames(spark, sf_dir).select("name", "score")).select("name", "percentile")


@query(f"""WITH {FRAMES}, w AS (SELECT name, width, height, unnest([320, 640, 1280]) AS w FROM frames WHERE decode_ok)
SELECT name, w AS thumb_width, CAST(round_even(height * (CAST(w AS DOUBLE) / width), 0) AS INTEGER) AS thumb_height FROM w WHERE w < width""")
def thumbnail_plan(spark, sf_dir):
    from lumisift.sinks import thumbnail_plan as plan

    return plan(testdata.frames(spark, sf_dir).where("decode_ok"), [640, 320, 1280, 320])


@query(f"""WITH {FRAMES}, s AS (SELECT name, width, height, least(1.0::DOUBLE, 900.0::DOUBLE / greatest(width, height)) AS scale FROM frames WHERE decode_ok)
SELECT name, CAST(greatest(1, round_even(width * scale, 0)) AS INTEGER) AS w, CAST(greatest(1, round_even(height * scale, 0)) AS INTEGER) AS h FROM s""")
def model_input_size(spark, sf_dir):
    from lumisift.sinks import fitted

    return testdata.frames(spark, sf_dir).where("decode_ok").select("name", *fitted(F.col("width"), F.col("height"), 900, "w", "h"))


@query("SELECT p_partkey, CAST(p_partkey % 6 AS INTEGER) AS rating, sha256(replace('" + xmp.PACKET.replace("'", "''") + "', '%d', CAST(p_partkey % 6 AS VARCHAR))) AS packet FROM part")
def xmp_packet(spark, sf_dir):
    p = testdata.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 6).cast("int").alias("rating"))
    return p.select("p_partkey", "rating", F.sha2(xmp.packet_column(F.col("rating")), 256).alias("packet"))


@query("SELECT l_returnflag, count(*) AS n, CASE WHEN sum(CAST(l_linestatus = 'O' AS INTEGER)) = 0 THEN '0.0%' ELSE printf('%.1f', round_even(CAST(sum(CAST(l_linestatus = 'O' AS INTEGER)) AS DOUBLE) / count(*) * 100, 1)) || '%' END AS open_share FROM lineitem GROUP BY l_returnflag")
def share_of_total(spark, sf_dir):
    rows = testdata.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("o"))
    return rows.select("l_returnflag", "n", selection.share(F.col("o"), F.col("n")).alias("open_share"))


# --- review --------------------------------------------------------------------------------------------------------

CANDIDATES = """
last_events AS (SELECT user_id AS session, CAST(event_id % 12 AS INTEGER) AS idx, max(event_id) AS event_id FROM events GROUP BY ALL),
candidates AS (
  SELECT l.session, l.idx, '/shoot/p' || lpad(CAST(l.event_id AS VARCHAR), 7, '0') || '.jpg' AS path, 'p' || lpad(CAST(l.event_id AS VARCHAR), 7, '0') || '.jpg' AS filename, e.value AS score,
    CASE WHEN l.session % 4 = 0 OR e.event_type IN ('view', 'error') THEN '' WHEN e.event_type = 'click' THEN 'reject' ELSE 'keep' END AS decision,
    CASE WHEN l.event_id % 7 = 3 THEN 'blurry' ELSE '' END AS rejected_reason
  FROM last_events l JOIN events e ON e.event_id = l.event_id)"""


@query(f"WITH {CANDIDATES} SELECT session, count(*) AS total, count(*) FILTER (decision = 'keep') AS keep, count(*) FILTER (decision = 'reject') AS reject, count(*) FILTER (decision = '') AS undecided FROM candidates GROUP BY session")
def session_counts(spark, sf_dir):
    return review.counts(testdata.candidates(spark, sf_dir))


@query(f"""WITH {CANDIDATES} SELECT session, count(*) FILTER (rejected_reason = '') AS "all", count(*) FILTER (rejected_reason = '' AND decision = '') AS undecided, count(*) FILTER (rejected_reason = '' AND decision = 'keep') AS keep,
count(*) FILTER (rejected_reason = '' AND decision = 'reject') AS reject, count(*) FILTER (rejected_reason <> '') AS rejected_input FROM candidates GROUP BY session""")
def filter_chip_counts(spark, sf_dir):
    return review.chip_counts(testdata.candidates(spark, sf_dir))


@query(f"""WITH {CANDIDATES} SELECT 'all' AS "view", path FROM candidates WHERE rejected_reason = '' UNION ALL SELECT 'undecided', path FROM candidates WHERE rejected_reason = '' AND decision = ''
UNION ALL SELECT 'keep', path FROM candidates WHERE decision = 'keep' UNION ALL SELECT 'reject', path FROM candidates WHERE decision = 'reject' UNION ALL SELECT 'rejected-input', path FROM candidates WHERE rejected_reason <> ''""")
def filter_views(spark, sf_dir):
    rows, out = testdata.candidates(spark, sf_dir), None
    for which in review.VIEWS:
        part = review.view(rows, which).select(F.lit(which).alias("view"), "path")
        out = part if out is None else out.unionByName(part)
    return out


_STATS = f"""{CANDIDATES},
sums AS (SELECT session, count(*) FILTER (rejected_reason = '') AS picks, count(*) FILTER (rejected_reason = '' AND decision = 'reject') AS overridden,
  count(*) FILTER (rejected_reason = '' AND decision <> '') AS decided, count(*) FILTER (rejected_reason <> '' AND decision = 'keep') AS rescued FROM candidates GROUP BY session),
stats AS (SELECT session, picks, picks - overridden AS kept, overridden, decided, rescued, round_even(CAST(overridden AS DOUBLE) / picks, 4) AS rate,
  'kept ' || (picks - overridden) || '/' || picks || ' picks — ' || CAST(round_even(CAST(overridden AS DOUBLE) / picks * 100, 0) AS INTEGER) || '% override' ||
  CASE WHEN rescued > 0 THEN ' · rescued ' || rescued || ' pipeline reject' || CASE WHEN rescued > 1 THEN 's' ELSE '' END ELSE '' END AS line FROM sums WHERE picks > 0)"""


@query(f"WITH {_STATS} SELECT * FROM stats")
def override_rate(spark, sf_dir):
    return review.override_stats(testdata.candidates(spark, sf_dir))


@query(f"""WITH {_STATS} SELECT count(*) FILTER (decided > 0) AS sessions, count(*) FILTER (decided = 0) AS undecided_sessions, CAST(sum(picks) FILTER (decided > 0) AS BIGINT) AS picks,
CAST(sum(overridden) FILTER (decided > 0) AS BIGINT) AS overridden, CAST(sum(rescued) FILTER (decided > 0) AS BIGINT) AS rescued, round_even(CAST(sum(overridden) FILTER (decided > 0) AS DOUBLE) / sum(picks) FILTER (decided > 0), 4) AS rate FROM stats""")
def override_aggregate(spark, sf_dir):
    return review.override_aggregate(review.override_stats(testdata.candidates(spark, sf_dir)))


def _saved_pair(spark, sf_dir):
    """Fresh candidates, and saved ones of the same groups whose picks and members have changed places; some groups differ, some repeat."""
    rows = testdata.candidates(spark, sf_dir)
    made = lambda k: F.struct(F.concat(F.col("path"), F.lit(f".{k}")).alias("path"), F.concat(F.col("filename"), F.lit(f".{k}")).alias("filename"), (F.col("score") - k).alias("score"))
    fresh = rows.withColumn("similar", F.array(made(1), made(2))).withColumn("_d", F.col("decision")).withColumn("decision", F.lit(""))
    swap = F.struct("path", "filename", "score", "similar")
    moved = review.promoted(swap, F.lit(1))
    saved = fresh.withColumn("_m", moved).withColumn("decision", F.col("_d")).where("idx % 5 <> 4")
    saved = saved.withColumns({c: F.when(F.col("idx") % 2 == 0, F.col(f"_m.{c}")).otherwise(F.col(c)) for c in ("path", "filename", "score", "similar")}).drop("_m", "_d")
    saved = saved.unionByName(saved.where("idx % 7 = 3"))
    return fresh.drop("_d"), saved


@query(f"WITH {CANDIDATES} SELECT session, idx, CASE WHEN idx % 5 <> 4 AND idx % 7 <> 3 AND idx % 2 = 0 THEN path || '.2' ELSE path END AS path, CASE WHEN idx % 5 <> 4 AND idx % 7 <> 3 THEN decision ELSE '' END AS decision, CASE WHEN idx % 5 <> 4 AND idx % 7 <> 3 AND idx % 2 = 0 THEN path ELSE path || '.2' END AS second FROM candidates")
def session_restore_group_key(spark, sf_dir):
    return review.restore(*_saved_pair(spark, sf_dir)).select("session", "idx", "path", "decision", F.element_at(F.col("similar"), 2)["path"].alias("second"))


_ACTION = "CASE event_type WHEN 'signup' THEN 'keep' WHEN 'purchase' THEN 'keep' WHEN 'view' THEN 'clear' WHEN 'click' THEN 'reject' WHEN 'error' THEN 'undo' END"


@query(f"""WITH RECURSIVE log AS (SELECT user_id AS session, {_ACTION} AS action, CAST(event_id % 12 AS INTEGER) AS idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS k, list_transform(range(0, 12), lambda x: CAST(NULL AS VARCHAR)) AS d, CAST([] AS INTEGER[]) AS h FROM log
  UNION ALL
  SELECT f.session, l.k,
    CASE WHEN l.action = 'undo' THEN CASE WHEN len(h) = 0 THEN d ELSE list_transform(d, lambda x, i: CASE WHEN i - 1 = h[-1] THEN '' ELSE x END) END
      ELSE list_transform(d, lambda x, i: CASE WHEN i - 1 = l.idx THEN CASE WHEN l.action = 'clear' THEN '' ELSE l.action END ELSE x END) END,
    CASE WHEN l.action = 'undo' THEN h[:-2] ELSE list_append(h, l.idx) END
  FROM f JOIN log l ON l.session = f.session AND l.k = f.k + 1),
e AS (SELECT session, d, h FROM f WHERE k = (SELECT max(k) FROM log WHERE log.session = f.session))
SELECT session, array_to_string(list_filter(list_transform(d, lambda x, i: (i - 1) || ':' || x), lambda x: x IS NOT NULL), ',') AS decisions, array_to_string(h, ',') AS history FROM e""")
def decision_fold_undo(spark, sf_dir):
    s = review.fold_decisions(testdata.decision_log(spark, sf_dir))
    entries = F.transform(F.array_sort(F.map_entries("decisions")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"]))
    return s.select("session", F.array_join(entries, ",").alias("decisions"), F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query(f"WITH {CANDIDATES} SELECT session, arg_min(idx, (CASE WHEN idx <= 5 THEN 1 ELSE 0 END, idx)) AS next_idx FROM candidates WHERE rejected_reason = '' AND decision = '' GROUP BY session")
def next_undecided(spark, sf_dir):
    return review.next_undecided(testdata.candidates(spark, sf_dir), F.lit(5))


@query(f"""WITH {CANDIDATES} SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY idx) AS INTEGER) AS rank, filename, 'out_' || idx || '.jpg' AS output_filename, round_even(score, 4) AS score, CASE WHEN decision = '' THEN 'undecided' ELSE decision END AS decision
FROM candidates WHERE decision IN ('keep', '') AND idx % 4 <> 1""")
def export_manifest(spark, sf_dir):
    rows = testdata.candidates(spark, sf_dir)
    copied = review.exported(rows).where("idx % 4 <> 1").select("session", "path", F.concat(F.lit("/out/out_"), F.col("idx").cast("string"), F.lit(".jpg")).alias("dest"))
    return review.export_manifest(rows, copied)


@query(f"""WITH RECURSIVE {CULL}, n AS (SELECT winner AS path, count(*) AS n_similar FROM led l WHERE NOT kept GROUP BY winner),
c AS (SELECT name AS path, score, '' AS rejected_reason FROM winners UNION ALL SELECT r.name, coalesce(s.score, 0.0), r.reason FROM rejects r LEFT JOIN survivors s USING (name) WHERE r.reason <> 'unreadable' AND r.name NOT IN (SELECT name FROM winners))
SELECT c.path, round(c.score, 9) AS score, rejected_reason, CAST(coalesce(n_similar, 0) AS INTEGER) AS n_similar FROM c LEFT JOIN n USING (path)""")
def session_build(spark, sf_dir):
    done = cull(testdata.frames(spark, sf_dir))
    rows = review.build_session(done.keepers, done.clusters, done.scored, done.rejects)
    return rows.groupBy("path", F.round("score", 9).alias("score"), "rejected_reason").agg(F.sum(F.size("similar")).cast("int").alias("n_similar"))


@query("""WITH l AS (SELECT 'label ' || vec_id AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 3),
s AS (SELECT vec_id, l.label, exp(10 * list_dot_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v)))) AS odds FROM embeddings, l)
SELECT vec_id, label, round(odds / sum(odds) OVER (PARTITION BY vec_id), 6) AS prob FROM s""")
def embedding_labels(spark, sf_dir):
    rows = testdata.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    labels = {f"label {r.vec_id}": list(r.embedding) for r in rows.where("vec_id < 3").orderBy("vec_id").collect()}  # three
    probed = classify.embedded(rows, labels, 10.0, "embedding")
    return probed.select("vec_id", F.explode("probs").alias("label", "prob")).select("vec_id", "label", F.round("prob", 6).alias("prob"))


# --- progress, replies, caches, strings ----------------------------------------------------------------------------


@query("""WITH u AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id AS seq, event_type AS stage, CAST(event_id % 2 AS INTEGER) AS done, 2 AS total FROM events),
m AS (SELECT *, row_number() OVER w = 1 OR (stage, done, total) IS DISTINCT FROM lag((stage, done, total)) OVER w AS fresh FROM u WINDOW w AS (PARTITION BY run ORDER BY seq))
SELECT run, seq, stage, done, total, row_number() OVER (PARTITION BY run ORDER BY seq) AS serial FROM m WHERE fresh""")
def progress_change_only(spark, sf_dir):
    e = testdata.table(spark, sf_dir, "events")
    return progress.changes(e.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), (F.col("event_id") % 2).cast("int").alias("done"), F.lit(2).alias("total")))


_SHAPES = """[
  '{"score": ' || k || ', "reason": "  steady light "}', 'Here it is:' || chr(10) || '```json' || chr(10) || '{"score": "' || k || '", "reason": "in a string"}' || chr(10) || '``` thanks',
  '{"score": ' || k || '.75, "reason": "a fraction"}', '{"score": "' || k || '.7"}', '{"reason": "no score ' || k || '"}', '{"score": 9' || k || ', "reason": 7}', '{"score": -' || k || '}',
  '{"score": true, "reason": "yes"}', '{"score": null, "reason": "none"}', '  no JSON here, only ' || k || ' words ', '{"score": ' || k || ', broken}']"""
REPLIES = f"""
r0 AS (SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events),
r1 AS (SELECT id, {_SHAPES}[id % 11 + 1] AS said FROM r0),
r2 AS (SELECT *, nullif(regexp_extract(said, '(\\{{[^{{}}]*\\}})', 1), '') AS obj FROM r1),
r3 AS (SELECT *, obj IS NOT NULL AND json_valid(obj) AS ok FROM r2),
r4 AS (SELECT *, CASE WHEN ok THEN json_type(obj, '$.score') END AS kind, CASE WHEN ok THEN json_extract_string(obj, '$.score') END AS raw FROM r3),
replies AS (SELECT id, said, CASE WHEN NOT ok THEN 0 ELSE greatest(0, least(100, coalesce(CASE kind WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN CAST(trim(raw) AS BIGINT) END WHEN 'BOOLEAN' THEN CASE WHEN raw = 'true' THEN 1 ELSE 0 END WHEN 'NULL' THEN 0 ELSE CAST(trunc(CAST(raw AS DOUBLE)) AS BIGINT) END, 0))) END AS score,
  CASE WHEN NOT ok THEN substr(trim(said), 1, 120) ELSE substr(trim(coalesce(json_extract_string(obj, '$.reason'), '')), 1, 200) END AS reason FROM r4)"""


@query(f"WITH {REPLIES} SELECT id, CAST(score AS INTEGER) AS score, reason FROM replies")
def reply_parse(spark, sf_dir):
    r = testdata.replies(spark, sf_dir).withColumn("r", text.reply(F.col("said")))
    return r.select("id", "r.score", "r.reason")


@query(f"WITH {REPLIES}, k AS (SELECT id, CAST(score AS INTEGER) AS ai_score FROM replies ORDER BY score DESC, id LIMIT 25) SELECT id, ai_score, CAST(row_number() OVER (ORDER BY ai_score DESC, id) AS INTEGER) AS ai_rank FROM k")
def rerank_topn(spark, sf_dir):
    from lumisift.operators.rerank import ordered

    scored = testdata.replies(spark, sf_dir).select("id", F.col("id").alias("rank"), text.reply(F.col("said"))["score"].alias("ai_score"))
    return ordered(scored, 25).select("id", "ai_score", "ai_rank")


@query("""WITH w AS (SELECT p_partkey, p_brand, 'k' || p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN ['b', 'a'] ELSE ['a', 'b', 'c'] END AS labels FROM part),
c AS (SELECT 'k' || p_partkey AS key, ['a', 'b'] AS labels FROM part WHERE p_partkey % 3 <> 0)
SELECT w.p_partkey, c.key IS NOT NULL AND list_sort(w.labels) = c.labels AS hit FROM w LEFT JOIN c USING (key)""")
def score_cache_hit_miss(spark, sf_dir):
    p = testdata.table(spark, sf_dir, "part")
    key = F.concat(F.lit("k"), F.col("p_partkey").cast("string"))
    labels = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    cached = p.where("p_partkey % 3 <> 0").select(key.alias("key"), rules.uniform(("a", "b")).alias("probs"))
    hits, misses = sessions.cache_split(p.select("p_partkey", key.alias("key"), labels.alias("labels")), cached)
    return hits.select("p_partkey", F.lit(True).alias("hit")).unionByName(misses.select("p_partkey", F.lit(False).alias("hit")))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') WHEN 1 THEN 'not a time' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE strftime(o_orderdate, '%Y:%-m:%-d %-H:%-M:%-S') END AS a,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') WHEN o_orderkey % 3 = 1 THEN '0000:00:00 00:00:00' END AS b FROM orders),
p AS (SELECT o_orderkey, coalesce(try_strptime(a, '%Y:%m:%d %H:%M:%S'), try_strptime(a, '%Y-%m-%d %H:%M:%S'), try_strptime(b, '%Y:%m:%d %H:%M:%S'), try_strptime(b, '%Y-%m-%d %H:%M:%S')) AS read_at FROM t)
SELECT o_orderkey, strftime(read_at, '%Y-%m-%dT%H:%M:%S') AS taken FROM p""")
def exif_time_parse(spark, sf_dir):
    o = testdata.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("d"))
    k, form = F.col("o_orderkey"), lambda p, c=F.col("d"): F.date_format(c, p)
    a = F.when(k % 5 == 0, form("yyyy:MM:dd HH:mm:ss")).when(k % 5 == 1, F.lit("not a time")).when(k % 5 == 2, F.lit(None)).when(k % 5 == 3, F.lit("")).otherwise(form("yyyy:M:d H:m:s"))
    b = F.when(k % 3 == 0, form("yyyy-MM-dd HH:mm:ss", F.col("d") + F.expr("INTERVAL 1 DAY"))).when(k % 3 == 1, F.lit("0000:00:00 00:00:00"))
    return o.select("o_orderkey", text.iso(text.capture_time(a, b)).alias("taken"))


@query("SELECT p_partkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS BIGINT) AS bust FROM part")
def rolling_hash(spark, sf_dir):
    return testdata.table(spark, sf_dir, "part").select("p_partkey", text.rolling_hash(F.col("p_name")).alias("bust"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '|') AS signature FROM orders GROUP BY o_custkey")
def label_signature(spark, sf_dir):
    return testdata.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(text.label_signature(F.collect_set("o_orderpriority")).alias("signature"))


# --- what scans, sinks and commands compute ------------------------------------------------------------------------


@query(f"WITH {FRAMES} SELECT frame_id, CASE WHEN decode_ok THEN width END AS width, CASE WHEN decode_ok THEN height END AS height, CASE WHEN decode_ok THEN greatest(width, height) END AS long_edge FROM frames")
def frame_dimensions(spark, sf_dir):
    d = frame_source.dimensions(testdata.frames(spark, sf_dir))
    return d.select("frame_id", "dimensions.width", "dimensions.height", F.greatest("dimensions.width", "dimensions.height").alias("long_edge"))


@query("SELECT l_orderkey, l_linenumber, CAST(((l_partkey % 256) * 19595 + (l_suppkey % 256) * 38470 + (l_orderkey % 256) * 7471 + 32768) >> 16 AS INTEGER) AS level FROM lineitem")
def luma_levels(spark, sf_dir):
    level = raster.luma_level(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256)
    return testdata.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", level.alias("level"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS iso, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS shown FROM orders")
def capture_time_shown(spark, sf_dir):
    time = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).cast("timestamp_ntz")
    return testdata.table(spark, sf_dir, "orders").select("o_orderkey", text.iso(time).alias("iso"), text.shown(time).alias("shown"))


#: A TIFF block with one date of 20 bytes, within a JPEG: start, an Exif segment of 54 bytes, and a scan.
_DATED = ("FFD8FFE1003645786966000049492A00080000000100", "0200140000001A00000000000000", "00FFDA00020000FFD9")


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderdate AS d FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1, 2) THEN strftime(d, '%Y-%m-%dT%H:%M:%S') END AS taken FROM t""")
def exif_capture_time(spark, sf_dir):
    """The date tags of JPEG bytes: original, changed and digitised; junk and other bytes have none."""
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("timestamp_ntz")
    tag = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ("0390", "3201", "0490", "3201", "3201")]), (k + 1).cast("int"))
    said = F.when(k == 3, F.lit("0000:00:00 00:00:00")).when(k == 1, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(day, "yyyy:MM:dd HH:mm:ss"))
    parts = [F.unhex(F.lit(_DATED[0])), tag, F.unhex(F.lit(_DATED[1])), F.encode(said, "UTF-8"), F.unhex(F.lit(_DATED[2]))]
    content = F.when(k == 4, F.encode(F.lit("no image"), "UTF-8")).otherwise(F.concat(*parts))
    rows = testdata.table(spark, sf_dir, "orders").select("o_orderkey", content.alias("content"))
    return rows.select("o_orderkey", text.iso(exif.taken_at(F.col("content"))).alias("taken"))


_HEAD = xmp.HEADER.hex().upper()


@query("WITH p AS (SELECT p_partkey, CAST(p_partkey % 8 AS INTEGER) AS rating, replace('" + xmp.PACKET.replace("'", "''") + "', '%d', CAST(p_partkey % 8 AS VARCHAR)) AS packet FROM part),"
       f" q AS (SELECT *, lpad(to_hex({len(xmp.HEADER) + 2} + octet_length(encode(packet))), 4, '0') AS size FROM p)"
       f" SELECT p_partkey, rating, CASE WHEN rating <= 5 AND p_partkey % 3 <> 0 THEN md5('FFD8FFE1' || size || '{_HEAD}' || hex(packet) || 'FFDA0002' || hex(CAST(p_partkey AS VARCHAR))) END AS content FROM q")
def xmp_embed(spark, sf_dir):
    """Ratings within JPEG bytes; none where the bytes are others, or the rating is not from 0 to 5."""
    p = testdata.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 8).cast("int").alias("rating"))
    data = F.when(F.col("p_partkey") % 3 == 0, F.encode(F.lit("PNG"), "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FFD8FFDA0002")), F.encode(F.col("p_partkey").cast("string"), "UTF-8")))
    return p.withColumn("content", data).select("p_partkey", "rating", F.md5(F.hex(xmp.embed(F.col("content"), F.col("rating")))).alias("content"))


_PAIRS_GIVEN = ("glow={}", " tidy = 0.{} ", "wide=-{}", "none={}", "={}", "detail", "glow=x{}", "wide=1e{}", "tidy=inf")


@query("WITH t AS (SELECT p_partkey, replace(" + _list(_PAIRS_GIVEN) + f"[p_partkey % {len(_PAIRS_GIVEN)} + 1], '{{}}', CAST(p_size AS VARCHAR)) AS pair FROM part),"
       " s AS (SELECT *, instr(pair, '=') AS sign FROM t), v AS (SELECT *, trim(CASE WHEN sign > 0 THEN substr(pair, 1, sign - 1) ELSE '' END) AS n, TRY_CAST(trim(substr(pair, sign + 1)) AS DOUBLE) AS w FROM s),"
       " f AS (SELECT *, CASE WHEN NOT coalesce(sign > 0 AND n <> '' AND w IS NOT NULL AND NOT isnan(w) AND w >= 0 AND NOT isinf(w), false) THEN 'bad' WHEN NOT list_contains(" + _list(_RULES.names) + ", n) THEN 'unknown' ELSE '' END AS fault FROM v)"
       " SELECT p_partkey, CASE WHEN fault = '' THEN n END AS name, CASE WHEN fault = '' THEN w END AS weight, fault FROM f")
def weight_pairs(spark, sf_dir):
    shapes = F.array(*[F.lit(x) for x in _PAIRS_GIVEN])
    pair = F.replace(F.get(shapes, (F.col("p_partkey") % len(_PAIRS_GIVEN)).cast("int")), F.lit("{}"), F.col("p_size").cast("string"))
    return testdata.table(spark, sf_dir, "part").select("p_partkey", rules.weight_pair(pair, _RULES.names).alias("w")).select("p_partkey", "w.*")


@query(f"WITH {_parts_sql(_DUO_LABELS)} SELECT name, round(score * (0.5::DOUBLE * p[1]), 9) AS known, 0.0::DOUBLE AS missing FROM frames")
def missing_label_points(spark, sf_dir):
    stack = rules.Rules((rules.Rule("known", _DUO_LABELS[0], 0.5), rules.Rule("missing", "a label that no frame has", 9.0)))
    rows = testdata.parts(spark, sf_dir, _DUO_LABELS).select("name", stack.contributions(F.col("score"), F.col("probs")).alias("c"))
    return rows.select("name", F.round(F.col("c")["known"], 9).alias("known"), F.col("c")["missing"].alias("missing"))


@query(f"""WITH {CANDIDATES}, t AS (SELECT session, filename, score, lower(filename) AS low, CASE WHEN idx % 3 <> 0 THEN idx * 7 % 5 END AS taken, CASE WHEN idx % 4 <> 1 THEN score END AS said FROM candidates)
SELECT session, filename, CAST(row_number() OVER (PARTITION BY session ORDER BY coalesce(said, 0.0) DESC, low) AS INTEGER) AS by_score, CAST(row_number() OVER (PARTITION BY session ORDER BY low) AS INTEGER) AS by_name,
  CAST(row_number() OVER (PARTITION BY session ORDER BY taken NULLS LAST, low) AS INTEGER) AS by_time FROM t""")
def review_sort(spark, sf_dir):
    idx = F.col("idx")
    rows = testdata.candidates(spark, sf_dir).withColumns({"capture_time": F.when(idx % 3 != 0, idx * 7 % 5), "score": F.when(idx % 4 != 1, F.col("score"))})
    for name, mode in (("by_score", "score"), ("by_name", "name"), ("by_time", "capture-time")):
        rows = rank.ranked(rows, rank.review_order(mode), ["session"], name)
    return rows.select("session", "filename", "by_score", "by_name", "by_time")


@query("""WITH t AS (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS done, count(*) OVER (PARTITION BY l_suppkey) - 1 AS total FROM lineitem)
SELECT run, CAST(done AS INTEGER) AS done, total FROM t WHERE done % 20 = 0 OR done = total""")
def progress_cadence(spark, sf_dir):
    rows = rank.ranked(testdata.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), "l_orderkey", "l_linenumber"), [F.col("l_orderkey"), F.col("l_linenumber")], ["run"], "n")
    totals = rows.groupBy("run").agg((F.count("*") - 1).alias("total"))
    told = rows.join(totals, "run").withColumn("done", F.col("n") - 1)
    return told.where(progress.cadence(F.col("done"), F.col("total"))).select("run", F.col("done").cast("int").alias("done"), "total")


@query(f"""WITH {FILES}, o AS (SELECT name, regexp_replace(name, '[.][^.]+$', '') AS stem, lower(regexp_extract(name, '([.][^.]+)$', 1)) AS ext, size FROM files),
w AS (SELECT *, CASE WHEN size % 5 = 0 THEN 'new' ELSE stem END AS out_stem, CASE WHEN ext = '.heic' THEN '.jpg' ELSE ext END AS out_ext FROM o WHERE size % 7 <> 0)
SELECT count(*) AS written, count(*) FILTER (ext <> out_ext) AS transcoded, count(*) FILTER (stem <> out_stem) AS renamed FROM w""")
def sink_counts(spark, sf_dir):
    f = testdata.files(spark, sf_dir)
    stem, ext = text.stem(F.col("name")), text.suffix(F.col("name"))
    out = F.concat(F.lit("/out/"), F.when(F.col("size") % 5 == 0, F.lit("new")).otherwise(stem), F.when(ext == ".heic", F.lit(".jpg")).otherwise(ext))
    return sinks.changes_of_name(f.select("name", out.alias("output_path"), (F.col("size") % 7 != 0).alias("ok")))


@query(f"WITH RECURSIVE {CULL} SELECT w.name, round(s.score, 9) AS score FROM winners w JOIN survivors s USING (name)")
def keeper_scores(spark, sf_dir):
    done = cull(testdata.frames(spark, sf_dir))
    return done.scored.join(done.keepers.select("name"), "name").select("name", F.round("score", 9).alias("score"))
