"""Adapters from star-schema tables to the engine's relations, for tests, benchmarks and demonstrations.

Each has a twin in `catalogue`, written for another engine in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.sources.frames import with_features

#: Contrast of a frame by its number modulo 8, so that gates and scores vary.
CONTRAST = (3, 6, 10, 16, 24, 40, 120, 255)
SECOND, THIRD = 1_000_000, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames without features from embeddings: 64 floats become an 8x8 grid; some get near copies, and copies of those."""
    v = F.col("vec_id")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    spread = vectors.select("vec_id", "e", F.array_min("e").alias("low"), F.array_max("e").alias("high"), F.element_at(F.array(*[F.lit(x) for x in CONTRAST]), (v % 8 + 1).cast("int")).alias("amp"))
    base = F.floor((F.lit(255) - F.col("amp")) / 2).cast("int") + ((v % 5 - 2) * F.floor((F.lit(255) - F.col("amp")) / 5)).cast("int")
    level = spread.withColumn("base", base)
    px = F.transform("e", lambda x: (F.floor((x - F.col("low")) / (F.col("high") - F.col("low")) * F.col("amp"))).cast("int") + F.col("base"))
    first = level.select("vec_id", px.alias("grid"))

    def flipped(places: list[Column]) -> Column:
        return F.transform("grid", lambda p, i: F.when(F.array_contains(F.array(*[c.cast("int") for c in places]), i), 255 - p).otherwise(p))

    second = [v % 64, (v * 7) % 64]
    third = [v % 64, (v * 7) % 64, (v * 13 + 1) % 64, (v * 17 + 2) % 64, (v * 29 + 3) % 64]
    gens = F.explode(F.concat(
        F.array(F.struct(F.lit(0).cast("long").alias("g"), F.col("grid").alias("grid"))),
        F.when(v % 5 == 0, F.array(F.struct(F.lit(SECOND).cast("long").alias("g"), flipped(second).alias("grid")))).otherwise(F.array().cast("array<struct<g:bigint,grid:array<int>>>")),
        F.when(v % 10 == 0, F.array(F.struct(F.lit(THIRD).cast("long").alias("g"), flipped(third).alias("grid")))).otherwise(F.array().cast("array<struct<g:bigint,grid:array<int>>>")),
    ))
    rows = first.select("vec_id", gens.alias("x")).select((v + F.col("x.g")).alias("frame_id"), F.col("x.grid").alias("grid"))
    n = F.col("frame_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "heic", "JPEG", "webp", "png", "heic", "gif", "jpg", "jpg", "jpg")]), (n % 10 + 1).cast("int"))
    stem = F.concat(F.lit("frame_"), F.lpad(F.when(n % 10 == 1, n - 1).otherwise(n).cast("string"), 9, "0"))
    return rows.select(
        "frame_id", F.concat(stem, F.lit("."), ext).alias("name"), (400 + n * 37 % 1200).cast("int").alias("width"), (300 + n * 53 % 1000).cast("int").alias("height"),
        (n % 23 != 5).alias("decode_ok"), F.when(n % 6 != 0, n * 7919 % 1_000_000).alias("capture_time"), "grid",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(frame_grids(spark, sf_dir))


def shares(grid: Column, labels: tuple[str, ...]) -> Column:
    """map<label, probability>: each label's share of the grid's levels over every len(labels)-th cell, plus 1."""
    k = len(labels)

    def part(j: int) -> Column:
        return F.aggregate(F.filter(grid, lambda _, i: i % k == j), F.lit(1).cast("long"), lambda a, x: a + x)

    parts = [part(j) for j in range(k)]
    whole = sum(parts[1:], parts[0])
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[p / whole for p in parts]))


def with_probs(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("probs", shares(F.col("grid"), labels))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, size) from documents: texts as stems, so that many share their first characters."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".heic", ".jpg", ".JPEG", ".png", ".txt")]), (F.col("doc_id") % 5 + 1).cast("int"))
    stem = F.concat(F.regexp_replace(F.substring("text", 1, 24), r"[./\n\r\t]", "_"), F.lit("_"), F.col("doc_id").cast("string"))
    return d.select(F.concat(stem, ext).alias("name"), F.col("n_chars").alias("size"))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, at, action, idx) from events: a user is a session of 12 candidates."""
    e = table(spark, sf_dir, "events")
    action = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "keep", "purchase", "keep", "view", "clear", "click", "reject", "error", "undo")]), F.col("event_type"))
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), action.alias("action"), (F.col("event_id") % 12).cast("int").alias("idx"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of sessions, from the last event of each user and slot."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 12).cast("int").alias("idx"), "event_id", "event_type", "value")
    last = e.groupBy(F.col("user_id").alias("session"), "idx").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("l"))
    kind = F.col("l.event_type")
    return last.select(
        "session", "idx", F.concat(F.lit("/shoot/p"), F.lpad(F.col("l.event_id").cast("string"), 7, "0"), F.lit(".jpg")).alias("path"),
        F.concat(F.lit("p"), F.lpad(F.col("l.event_id").cast("string"), 7, "0"), F.lit(".jpg")).alias("filename"), F.col("l.value").alias("score"),
        F.when((F.col("session") % 4 == 0) | kind.isin("view", "error"), F.lit("")).when(kind == "click", F.lit("reject")).otherwise(F.lit("keep")).alias("decision"),
        F.when(F.col("l.event_id") % 7 == 3, F.lit("blurry")).otherwise(F.lit("")).alias("rejected_reason"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, said) from events: model replies of many shapes, with and without JSON."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    shapes = [
        F.concat(F.lit('{"score": '), k, F.lit(', "reason": "  steady light "}')),
        F.concat(F.lit('Here it is:\n```json\n{"score": "'), k, F.lit('", "reason": "in a string"}\n``` thanks')),
        F.concat(F.lit('{"score": '), k, F.lit('.75, "reason": "a fraction"}')),
        F.concat(F.lit('{"score": "'), k, F.lit('.7"}')),
        F.concat(F.lit('{"reason": "no score '), k, F.lit('"}')),
        F.concat(F.lit('{"score": 9'), k, F.lit(', "reason": 7}')),
        F.concat(F.lit('{"score": -'), k, F.lit('}')),
        F.lit('{"score": true, "reason": "yes"}'),
        F.lit('{"score": null, "reason": "none"}'),
        F.concat(F.lit("  no JSON here, only "), k, F.lit(" words ")),
        F.concat(F.lit('{"score": '), k, F.lit(", broken}")),
    ]
    said = F.element_at(F.array(*shapes), (F.col("event_id") % len(shapes) + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), said.alias("said"))


def parts(spark: SparkSession, sf_dir: str, labels: tuple[str, ...]) -> DataFrame:
    """Scored frames with probabilities, from part: a wider and larger relation than embeddings."""
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    weights = [((k * (31 + 2 * j) + s * (7 + j)) % (53 + j) + 1).cast("long") for j in range(len(labels))]
    whole = sum(weights[1:], weights[0])
    probs = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[w / whole for w in weights]))
    name = F.concat(F.lit("part_"), F.lpad(k.cast("string"), 9, "0"), F.when(k % 3 == 0, F.lit(".heic")).otherwise(F.lit(".JPG")))
    return p.select(name.alias("name"), (s / 50.0).alias("score"), probs.alias("probs"))
