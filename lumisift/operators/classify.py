"""Label probabilities from a pluggable classifier, in batches, with a cache.

A classifier is any picklable object with score(key: str, labels: list[str]) -> dict[str, float], and optionally
score_batch(keys, labels) -> list of such. It is set up once a worker; its calls are Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from lumisift.sources.sessions import cache_split
from lumisift.shipping import ship

ship(__name__)

BATCH = 32
#: What cosines are scaled by before the softmax.
SCALE = 100.0


def classify(frames: DataFrame, classifier, labels: tuple[str, ...], key: str = "name", batch: int = BATCH) -> DataFrame:
    """Adds probs map<label, double> in label order."""
    schema = StructType([*frames.schema.fields, StructField("probs", MapType(StringType(), DoubleType()))])
    wanted = list(labels)

    def run(batches: Iterator):
        import pyarrow as pa

        for rows in batches:
            keys, found = rows.column(key).to_pylist(), []
            for at in range(0, len(keys), batch):
                part = keys[at : at + batch]
                if hasattr(classifier, "score_batch"):
                    found += classifier.score_batch(part, wanted)
                else:
                    found += [classifier.score(k, wanted) for k in part]
            probs = pa.array([[(x, float(p.get(x, 0.0))) for x in wanted] for p in found], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, probs], names=schema.names)

    return frames.mapInArrow(run, schema)


def classify_cached(frames: DataFrame, classifier, labels: tuple[str, ...], cached: DataFrame, cache_key: str = "cache_key", key: str = "name", batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(frames with probs, new cache rows key, probs): only frames that the cache does not answer reach the classifier.

    The new rows should be written before the frames are used again, or the classifier runs twice.
    """
    asked = frames.withColumn("labels", F.array(*[F.lit(x) for x in labels])).withColumnRenamed(cache_key, "key")
    hits, misses = cache_split(asked, cached)
    fresh = classify(misses, classifier, labels, key, batch)
    both = hits.unionByName(fresh).drop("labels").withColumnRenamed("key", cache_key)
    return both, fresh.select("key", "probs")


def embedded(frames: DataFrame, labels: dict[str, list[float]], scale: float = SCALE, vector: str = "vector") -> DataFrame:
    """Adds probs map<label, double> in label order to frames with an embedding: the softmax of the scaled cosines with each label's own.

    One matrix product a batch of rows. A null or zero vector, or one of another length than the labels', has uniform probabilities.
    """
    import numpy as np

    names = list(labels)
    sides = np.array([labels[x] for x in names], dtype=np.float64).reshape(len(names), -1)
    sides = sides / np.maximum(np.sqrt((sides**2).sum(axis=1, keepdims=True)), 1e-300)
    schema = StructType([*frames.schema.fields, StructField("probs", MapType(StringType(), DoubleType()))])

    def run(batches: Iterator):
        import pyarrow as pa

        for rows in batches:
            x = np.zeros((rows.num_rows, sides.shape[1]))
            for k, v in enumerate(rows.column(vector).to_pylist()):
                if v is not None and len(v) == sides.shape[1] and None not in v:
                    x[k] = v
            length = np.sqrt((x**2).sum(axis=1, keepdims=True))
            logits = scale * (x / np.where(length > 0, length, 1)) @ sides.T
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            probs = odds / odds.sum(axis=1, keepdims=True)
            keys = pa.array(np.tile(np.arange(len(names)), rows.num_rows))
            offsets = pa.array(np.arange(rows.num_rows + 1) * len(names), pa.int32())
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.MapArray.from_arrays(offsets, pa.array(names).take(keys), pa.array(probs.ravel()))], names=schema.names)

    return frames.mapInArrow(run, schema)


class Stub:
    """A test double: canned probabilities by file name, uniform for other names."""

    def __init__(self, table: dict[str, dict[str, float]] | None = None):
        self.table = table or {}

    def score(self, key: str, labels: list[str]) -> dict[str, float]:
        given = self.table.get(key.rpartition("/")[2])
        if given is None:
            return {x: 1.0 / len(labels) for x in labels}
        return {x: given.get(x, 0.0) for x in labels}


def faces(frames: DataFrame, provider, key: str = "name") -> DataFrame:
    """(name, found, n, least_ratio, closed, multiplier) from a provider of landmarks.

    provider(key) -> for each face, its two eyes, each six (x, y) points. The geometry stays in Spark.
    """
    from lumisift.functions import raster

    def run(batches: Iterator):
        import pyarrow as pa

        eyes = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
        for rows in batches:
            keys = rows.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([provider(k) for k in keys], eyes)], names=["name", "faces"])

    found = frames.select(F.col(key).alias("name")).mapInArrow(run, "name string, faces array<array<array<array<double>>>>")
    point = lambda eye, k: (F.get(F.get(eye, k), F.lit(0)), F.get(F.get(eye, k), F.lit(1)))
    ratio = lambda eye: raster.eye_aspect_ratio([point(eye, F.lit(k)) for k in range(6)])
    least = F.array_min(F.flatten(F.transform("faces", lambda face: F.transform(face, ratio))))
    rows = found.select("name", (F.size("faces") > 0).alias("found"), F.size("faces").alias("n"), least.alias("least_ratio"))
    closed = F.coalesce(F.col("least_ratio") < raster.CLOSED_BELOW, F.lit(False))
    return rows.withColumn("closed", closed).withColumn("multiplier", raster.face_multiplier(F.col("least_ratio")))
