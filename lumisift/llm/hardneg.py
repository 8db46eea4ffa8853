"""Hard negatives: rows of another label that score nearly as high for an anchor as rows of its own, found exactly.

Vectors are integers (each component floor(SCALE * x)) and scores their inner products. All rows are turned by one orthogonal matrix, the principal axes of
their second moments, so that leading components hold most of a product. For an anchor and a row the products of the leading components are
added up stage by stage (LEADING); what the others can still add is at most the product of the two residual norms, and rounding at most SLACK of the
product of the norms. A row whose upper bound stays below what enough others reach for certain is discarded early; survivors are verified with
integer products, so neither the rotation nor rounding decides anything.

Two passes, each rows in blocks against anchors in parts: the `positives` best other rows of an anchor's label, then, for each of them, the `negatives` best rows
of another label whose score lies between two shares of the positive's. A block gives at most so many rows for each anchor, and the best of
all blocks are taken by a window. Rows are dealt to blocks in turn, whatever their label, so no label or vector fills a task.

Defined cases: rows without id, label or vector, with an empty vector, one of another length than most, a null or non-finite component, or one beyond
sqrt(2**61 / length) after scaling (such products are no longs) take no part; zero vectors do, with scores of 0. Repeated rows are candidates each; a
repeated anchor id asks once, with the row whose bytes (then label) come first, and no row of its own id is its candidate. Anchors without another row of
their label, and positives without a row between the shares (negative scores have none), give no rows; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Shared, materialise, ship, small_batches, tidied

ship(__name__)

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A positive's score times these over 100 bounds its negatives' scores.
SHARES = (50, 95)
#: Components of the first stages; rounding is at most SLACK of the norms' product; rows of a block, anchors of a part, anchors compared at once.
LEADING, SLACK, BLOCK, LEAST_BLOCKS, PART, AT_ONCE = (8, 16, 32), 1e-11, 16_384, 48, 8_192, 64
#: Once so small a share of the pairs is left, they are verified at once; so many are multiplied at a time.
FEW, PAIRS = 0.02, 20_000


def usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> tuple[DataFrame, int]:
    """(id, label, v array<double> of whole numbers) of the rows that take part, and their length."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    most = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not most:
        return good, 0
    limit = (2**61 / most["n"]) ** 0.5 / scale - 1
    return good.where((F.size("v") == most["n"]) & F.forall("v", lambda x: F.abs(x) < F.lit(limit))), most["n"]


def whole(column, width: int, scale: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
    return np.floor(flat * scale).astype(np.int32)


def matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, width)


def second_moments(good: DataFrame, width: int, scale: int) -> np.ndarray:
    """The sum of x x' over all rows: summed in tasks, then by few, so that a handful of matrices reaches the driver."""

    def partial(batches: Iterator):
        import pyarrow as pa

        total = np.zeros((width, width))
        for batch in batches:
            x = whole(batch.column(0), width, scale).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def added(batches: Iterator):
        import pyarrow as pa

        total = np.zeros(width * width)
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total += np.frombuffer(m)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    sums = good.select("v").mapInArrow(tidied(partial), "m binary").repartition(8).mapInArrow(added, "m binary").collect()
    return sum(np.frombuffer(r.m) for r in sums).reshape(width, width)


class Rotated:
    """Integer vectors with their turned components and the norms of what each stage leaves over."""

    def __init__(self, x: np.ndarray, axes: np.ndarray, stages: list[tuple[int, int]]):
        self.x, self.y, self.stages = x, x.astype(np.float64) @ axes, stages
        self.rest = [np.sqrt((self.y[:, high:] ** 2).sum(axis=1)) for _, high in stages]
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))

    def take(self, rows) -> "Rotated":
        out = object.__new__(Rotated)
        out.x, out.y, out.stages, out.norm, out.rest = self.x[rows], self.y[rows], self.stages, self.norm[rows], [r[rows] for r in self.rest]
        return out


def stages_of(width: int) -> list[tuple[int, int]]:
    edges = [0, *(m for m in LEADING if m < width), width]
    return list(zip(edges, edges[1:]))


def bounds(a: Rotated, r: Rotated) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lower, upper) bounds of all products, tighter at each stage."""
    slack = SLACK * np.outer(a.norm, r.norm) + 1e-6
    partial = np.zeros((len(a.x), len(r.x)))
    for k, (low, high) in enumerate(a.stages):
        partial += a.y[:, low:high] @ r.y[:, low:high].T
        away = np.outer(a.rest[k], r.rest[k]) + slack
        yield partial - away, partial + away


def reached(lower: np.ndarray, k: int) -> np.ndarray:
    """What k columns of each row reach for certain; -inf where there are fewer."""
    if lower.shape[1] < k:
        return np.full(len(lower), -np.inf)
    return -np.partition(-lower, k - 1, axis=1)[:, k - 1]


def products(a: np.ndarray, r: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Integer products of pairs of rows."""
    out = np.empty(len(at), dtype=np.int64)
    for k in range(0, len(at), PAIRS):
        out[k : k + PAIRS] = np.einsum("ij,ij->i", a[at[k : k + PAIRS]].astype(np.int64), r[to[k : k + PAIRS]].astype(np.int64))
    return out


def first_of(groups: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group by score, then id."""
    order = np.lexsort((ids, -score, groups))
    sorted_groups = groups[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_groups, sorted_groups, side="left")
    return order[rank < k]


def best(a: Rotated, r: Rotated, alive: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, row, score) of the k best rows of each anchor among those alive, and how many pairs were verified."""
    for lower, upper in bounds(a, r):
        alive = alive & (upper >= reached(np.where(alive, lower, -np.inf), k)[:, None])
        if alive.mean() < FEW:
            break
    at, to = np.nonzero(alive)
    score = products(a.x, r.x, at, to)
    keep = first_of(at, score, ids[to], k)
    return at[keep], to[keep], score[keep], len(at)


def between(a: Rotated, r: Rotated, alive: np.ndarray, ids: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, which interval, row, score) of the k best rows of each anchor with a score in [least, most], for each of its intervals; and how many pairs were verified.

    least, most: (anchors, intervals) of whole numbers, least > most for none.
    """
    size = least.shape[1]
    may = [alive & (least[:, j] <= most[:, j])[:, None] for j in range(size)]
    slack = 1e-12 * np.maximum(np.abs(least), np.abs(most)).astype(np.float64) + 1e-6
    low, high = least.astype(np.float64), most.astype(np.float64)
    for lower, upper in bounds(a, r):
        for j in range(size):
            inside = may[j] & (upper >= (low - slack)[:, j, None]) & (lower <= (high + slack)[:, j, None])
            sure = inside & (lower >= (low + slack)[:, j, None]) & (upper <= (high - slack)[:, j, None])
            may[j] = inside & (upper >= reached(np.where(sure, lower, -np.inf), k)[:, None])
        if np.mean(may) < FEW / size:
            break
    any_of = np.logical_or.reduce(may)
    at, to = np.nonzero(any_of)
    score = products(a.x, r.x, at, to)
    found = []
    for j in range(size):
        rows = np.flatnonzero(may[j][at, to] & (score >= least[at, j]) & (score <= most[at, j]))
        rows = rows[first_of(at[rows], score[rows], ids[to[rows]], k)]
        found.append((at[rows], np.full(len(rows), j), to[rows], score[rows]))
    return *(np.concatenate(c) for c in zip(*found)), len(at)


def _labels(rows, anchors) -> tuple[np.ndarray, np.ndarray]:
    """Labels of rows and anchors as numbers of one list."""
    import pyarrow as pa

    codes = pa.concat_arrays([rows.combine_chunks(), anchors.combine_chunks()]).dictionary_encode().indices.to_numpy()
    return codes[: len(rows)], codes[len(rows) :]


def mine(vectors: DataFrame, is_anchor, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, shares: tuple[int, int] = SHARES, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank, for each id that is_anchor(id) holds for."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"
    good, width = usable(vectors, id_column, vector_column, label_column, scale)
    if not width:
        return spark.createDataFrame([], schema)
    count, asking = good.agg(F.count("*"), F.count_if(is_anchor(F.col("id")))).first()
    if not asking:
        return spark.createDataFrame([], schema)
    blocks, parts, stages = max(LEAST_BLOCKS, -(-count // BLOCK)), -(-asking // PART), stages_of(width)
    axes = Shared(spark, "hardneg", np.linalg.eigh(second_moments(good, width, scale))[1][:, ::-1].copy())

    def index(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() * 7919
        for batch in batches:
            x = whole(batch.column(2), width, scale)
            dealt = pa.array((at + np.arange(len(x))) % blocks, pa.int32())
            at += len(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), dealt], names=["id", "label", "x", "block"])

    rows = materialise(good.select("id", "label", "v").mapInArrow(tidied(index), "id long, label string, x binary, block int"), "hardneg-rows")
    anchors = rows.where(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("x", "label")).alias("a")).select("id", "a.x", "a.label", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    stored = rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "label", "x")

    def against(asked: DataFrame, match, schema: str) -> DataFrame:
        sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return stored.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInArrow(match, schema)

    def sides(stored, asked):
        ids, own = stored.column("id").to_numpy(), asked.column("id").to_numpy()
        labels, own_labels = _labels(stored.column("label"), asked.column("label"))
        r, a = (Rotated(matrix(t.column("x"), width), axes.value, stages) for t in (stored, asked))
        return ids, labels, r, own, own_labels, a

    def same(_, stored, asked):
        import pyarrow as pa

        out = [(np.zeros(0, dtype=np.int64),) * 3]
        if stored.num_rows and asked.num_rows:
            ids, labels, r, own, own_labels, a = sides(stored, asked)
            for label in np.unique(own_labels):
                mine, its = np.flatnonzero(own_labels == label), np.flatnonzero(labels == label)
                side = r.take(its)
                for at in range(0, len(mine), AT_ONCE) if len(its) else ():
                    chunk = mine[at : at + AT_ONCE]
                    q, v, score, _ = best(a.take(chunk), side, own[chunk][:, None] != ids[its][None, :], ids[its], positives)
                    out.append((own[chunk[q]], ids[its[v]], score))
        x, y, z = (np.concatenate(c) for c in zip(*out))
        return pa.table({"id": x, "positive_id": y, "score": z})

    ranked = against(anchors, same, "id long, positive_id long, score long").withColumn("k", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "positive_id"))).where(F.col("k") <= positives)
    each = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "positive_id", "score"))).alias("p"))  # `positives` of them at most
    asked = materialise(anchors.join(each.select("id", F.col("p.positive_id").alias("ps"), F.col("p.score").alias("scores")), "id"), "hardneg-positives")

    def other(_, stored, asked):
        import pyarrow as pa

        out = [(np.zeros(0, dtype=np.int64),) * 6]
        if stored.num_rows and asked.num_rows:
            ids, labels, r, own, own_labels, a = sides(stored, asked)
            names, scores = asked.column("ps").to_pylist(), asked.column("scores").to_pylist()
            least, most = np.ones((len(own), positives), dtype=np.int64), np.zeros((len(own), positives), dtype=np.int64)
            for row, said in enumerate(scores):  # whole numbers of any length until here
                least[row, : len(said)] = [-(-shares[0] * s // 100) for s in said]
                most[row, : len(said)] = [shares[1] * s // 100 for s in said]
            for at in range(0, len(own), AT_ONCE):
                chunk = slice(at, at + AT_ONCE)
                alive = (own[chunk][:, None] != ids[None, :]) & (own_labels[chunk][:, None] != labels[None, :])
                q, j, v, score, _ = between(a.take(chunk), r, alive, ids, least[chunk], most[chunk], negatives)
                q = q + at
                out.append((own[q], j + 1, np.array([names[x][y] for x, y in zip(q, j)], dtype=np.int64), np.array([scores[x][y] for x, y in zip(q, j)], dtype=np.int64), ids[v], score))
        cols = [np.concatenate(c) for c in zip(*out)]
        cols[1] = cols[1].astype(np.int32)
        return pa.table(dict(zip(["anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"], cols)))

    met = against(asked, other, "anchor_id long, positive_rank int, positive_id long, positive_score long, negative_id long, negative_score long")
    order = W.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(*(c.split()[0] for c in schema.split(", ")))
