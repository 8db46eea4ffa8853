"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, searched best bin first.

Inner products become distances by one more component, sqrt(longest**2 - |x|**2), zero for queries (Bachrach et al., RecSys 2014).
A tree of `branching` k-means clusters at each level is fitted on a bounded sample (SAMPLE vectors, taken in the order of a hash) on the
driver. Where the table has more than LEAF_SIZE vectors a leaf, each leaf is parted further, on executors and on a bounded sample of
its own vectors, so that leaves keep their size up to MAX_LEAVES of them; this bounds what is collected and broadcast. Every vector is indexed
in the leaf it descends to. A bin promises a query the inner product with the centre of its vectors and the most that so many of their deviations reach; leaves are measured on
MEASURED of their vectors at most, by a hash, and bins above from their leaves. A query walks the tree with a priority queue
of bins by promise: a bin is looked at when its parent comes out of the queue, and leaves are visited in the order they come out.

How many leaves: CALIBRATION queries (a bounded set, in the order of a hash) are answered exactly by a scan; the visits are
widened until the leaves seen hold at least `recall` of their true neighbours; their walks, too, run on executors.

Leaves next to each other in the tree are stored together, in groups of about BLOCK vectors; a leaf that is larger fills several blocks of a
group of its own, so a frequent vector fills blocks and not a task. A query goes once to each group in which it visits leaves, with the
list of them; queries of a group are blocked too. Blocks are matched as matrices, and what lies in leaves that a query does not visit is
left out; what may be among the k best is scored again in double precision, adding components in order, so equal vectors tie exactly.

Defined cases: vectors null, empty, zero, of another length than most, or with null or non-finite components take no part; fewer
candidates than k give all of them (visits go on until the leaves hold more than k); repeated ids are candidates each, but ask once, with the
vector whose bytes come first; a row is no candidate of a query with its own id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Shared, materialise, ship, small_batches, tidied

ship(__name__)

SAMPLE, BRANCHING, LEAF_SAMPLE, CALIBRATION, RECALL, BLOCK, QUERY_BLOCK = 20_000, 8, 24, 200, 0.95, 4096, 512
LEAF_SIZE, MAX_LEAVES, MEASURED = 64, 100_000, 256


def grown(points: np.ndarray, branching: int = BRANCHING, least: int = LEAF_SAMPLE, seed: int = 7) -> tuple:
    """A tree of k-means clusters as nested (centre, spread, children); clusters of at most `least` points have none."""
    rng = np.random.default_rng(seed)

    def node(own: np.ndarray) -> tuple:
        centre = own.mean(axis=0)
        spread = float(np.sqrt(((own - centre) ** 2).mean()))
        parts = [] if len(own) <= least else kmeans(own, branching, rng)
        return centre, spread, [node(own[rows]) for rows in parts] if len(parts) > 1 else []

    return node(points)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T, axis=1)


def kmeans(points: np.ndarray, k: int, rng, rounds: int = 8) -> list[np.ndarray]:
    """Rows of the clusters that are not empty; less than two if the points can't be parted."""
    centres = np.unique(points[rng.choice(len(points), min(k, len(points)), replace=False)], axis=0)
    for _ in range(rounds):
        own = nearest(points, centres)
        centres = np.array([points[own == j].mean(axis=0) for j in range(len(centres)) if (own == j).any()])
    own = nearest(points, centres)
    return [np.flatnonzero(own == j) for j in range(len(centres)) if (own == j).any()]


class Tree:
    """A grown tree as arrays. Children of a node stand together; leaves are numbered from left to right, so neighbours are alike."""

    def __init__(self, root: tuple, measured: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        """measured: how many vectors each leaf holds, their centre and their deviation; without it leaves stand for the vectors they were fitted on."""
        self.root, self.leaves = root, 0
        centres, spread, self.first, self.count, self.leaf, todo = [root[0]], [root[1]], [0], [0], [-1], [(0, root)]
        while todo:  # depth first, so that leaves come out from left to right
            at, (_, _, children) = todo.pop()
            if not children:
                self.leaf[at] = self.leaves
                self.leaves += 1
                continue
            self.first[at], self.count[at] = len(centres), len(children)
            for child in children:
                centres.append(child[0]), spread.append(child[1]), self.first.append(0), self.count.append(0), self.leaf.append(-1)
            todo += [(self.first[at] + k, child) for k, child in reversed(list(enumerate(children)))]
        self.centres = np.array(centres, dtype=np.float64)
        ends = np.flatnonzero(np.array(self.leaf) >= 0)
        self.end = ends[np.argsort(np.array(self.leaf)[ends])]  # the node of each leaf
        self.measured = measured or (np.ones(self.leaves), self.centres[self.end], np.array(spread)[self.end])
        self._measure()

    def __reduce__(self):
        return Tree, (self.root, self.measured)

    def grafted(self, parts: dict[int, tuple]) -> "Tree":
        """The tree with other nodes in place of some leaves."""
        at = -1

        def node(old: tuple) -> tuple:
            nonlocal at
            if old[2]:
                return old[0], old[1], [node(child) for child in old[2]]
            at += 1
            new = parts.get(at)
            return (old[0], old[1], new[2]) if new else old

        return Tree(node(self.root))

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point descends to."""
        out, todo = np.zeros(len(points), dtype=np.int32), [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if not self.count[at]:
                out[rows] = self.leaf[at]
            elif len(rows):
                children = range(self.first[at], self.first[at] + self.count[at])
                near = nearest(points[rows], self.centres[children.start : children.stop])
                todo += [(child, rows[near == k]) for k, child in enumerate(children)]
        return out

    def _measure(self) -> None:
        """The centre and reach of every bin, from those of its leaves. Children stand after their parents."""
        held, centre, spread = self.measured
        n, width = len(self.centres), centre.shape[1]
        self.held, self.mean, square = np.zeros(n), np.zeros((n, width)), np.zeros(n)
        self.held[self.end], self.mean[self.end], square[self.end] = held, centre, np.maximum(spread, 0) ** 2
        for at in range(n - 1, -1, -1):
            if self.count[at]:
                own = slice(self.first[at], self.first[at] + self.count[at])
                share = self.held[own] / max(1.0, self.held[own].sum())
                self.held[at], self.mean[at] = self.held[own].sum(), share @ self.mean[own]
                square[at] = share @ (square[own] + ((self.mean[own] - self.mean[at]) ** 2).mean(axis=1))
        # the most that so many vectors of a bell curve reach, in deviations
        self.reach = np.sqrt(2 * np.log(self.held + 1)) * np.sqrt(square)

    def visits(self, query: np.ndarray, most: int, least: float = 0, wanted: set[int] | None = None) -> tuple[list[int], int]:
        """Leaves in the order in which a priority queue of bins yields them, and how many bins were looked at: `most` leaves, and on until they hold `least` vectors; or until all wanted ones are out.

        A bin promises its centre's product and what its deviation along the query adds; it is looked at when its parent comes out of the queue, so whole branches never are.
        """
        length = float(np.sqrt(query @ query))
        queue, out, seen, looked = [(0.0, 0)], [], 0.0, 1
        missing = set(wanted) if wanted is not None else None
        while queue and (len(out) < most or seen < least) and (missing is None or missing):
            at = heapq.heappop(queue)[1]
            if not self.count[at]:
                out.append(self.leaf[at])
                seen += self.held[at]
                if missing is not None:
                    missing.discard(self.leaf[at])
                continue
            low, high = self.first[at], self.first[at] + self.count[at]
            promise = self.mean[low:high, : len(query)] @ query + length * self.reach[low:high]
            looked += high - low
            for child, said, held in zip(range(low, high), promise.tolist(), self.held[low:high].tolist()):
                if held:
                    heapq.heappush(queue, (-said, child))
        return out, looked


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes inner products distances."""
    return np.concatenate([x, np.sqrt(np.maximum(0.0, longest**2 - (x**2).sum(axis=1)))[:, None]], axis=1)


def in_order(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision, adding components in order."""
    out = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        out += queries[:, d] * vectors[:, d]
    return out


def best_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the k best of a block for each query, ties to smaller ids. seen: which vectors count for which query."""
    rough = queries @ vectors.T
    out = query_ids[:, None] == ids[None, :]
    if seen is not None:
        out |= ~seen
    rough[out] = -np.inf
    if vectors.shape[0] > k:
        edge = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (1 + np.abs(rough[~out]).max(initial=0))
        maybe = (rough >= (edge - slack)[:, None]) & ~out
    else:
        maybe = ~out
    q, v = np.nonzero(maybe)
    score = in_order(queries[q], vectors[v])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    keep = rank < k
    return q[keep], v[keep], score[keep]


def rows_of(column, width: int) -> np.ndarray:
    """A list column as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)


def matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, width)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the vectors that take part, and their length."""
    v = F.col(vector_column).cast("array<double>")
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = plain.where(F.col("v").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    most = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = most["n"] if most else 0
    return good.where(F.size("v") == width), width


def search(vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = RECALL, sample: int = SAMPLE, calibration: int = CALIBRATION) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each id for which is_query(id) holds, among all others."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    good, width = usable(vectors, id_column, vector_column)
    if not width:
        return spark.createDataFrame([], schema)
    by_hash = F.xxhash64(F.lit(2), "id")
    count, asking, longest = good.select(is_query(F.col("id")).alias("q"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("n")).agg(F.count("*"), F.count_if("q"), F.sqrt(F.max("n"))).first()

    def some(rows: DataFrame, share: float) -> DataFrame:
        """About a share of the rows, by hash."""
        return rows.withColumn("h", by_hash).where(F.col("h") <= F.lit(min(int(-(2**63) + 2**64 * min(1.0, share)), 2**63 - 1)))

    def few(rows: DataFrame, of: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of about the n first by hash, sorted out of no more than a few times as many."""
        got = some(rows, 1.5 * n / max(1, of)).orderBy("h", "id", "v").limit(n).select("id", "v").toArrow()
        return got.column(0).to_numpy(), rows_of(got.column(1).combine_chunks(), width)

    tree = Tree(grown(lifted(few(good, count, sample)[1], longest)))
    test_ids, tests = few(good.where(is_query(F.col("id"))), asking, calibration)
    if not len(tests):
        return spark.createDataFrame([], schema)

    def index(shared: Shared):
        def run(batches: Iterator):
            import pyarrow as pa

            tree = shared.value
            for batch in batches:
                x = rows_of(batch.column(1), width)
                leaf = tree.place(lifted(x, longest)) if len(x) else np.zeros(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf, pa.int32()), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())], names=["id", "leaf", "x"])

        return tidied(run)

    wanted = min(count // LEAF_SIZE, MAX_LEAVES)
    if wanted > tree.leaves:  # part each leaf of the sample's tree on its own vectors
        each = LEAF_SAMPLE * -(-wanted // tree.leaves)

        def fit(group):
            import pyarrow as pa

            root = grown(lifted(matrix(group.column("x"), width), longest).astype(np.float32))
            return pa.table({"leaf": group.column("leaf")[:1], "part": pa.array([pickle.dumps(root)], pa.binary())})

        inside = some(good, 3 * each * tree.leaves / count).select("id", "v").mapInArrow(index(Shared(spark, "ann", tree)), "id long, leaf int, x binary")
        first = W.partitionBy("leaf").orderBy(F.xxhash64(F.lit(3), "id"), "x")
        bounded = inside.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each).select("leaf", "x")
        fitted = bounded.groupBy("leaf").applyInArrow(fit, "leaf int, part binary").collect()  # bounded by MAX_LEAVES
        tree = tree.grafted({r.leaf: pickle.loads(r.part) for r in fitted})

    indexed = materialise(good.mapInArrow(index(Shared(spark, "ann", tree)), "id long, leaf int, x binary"), "ann")

    def measure(group):
        import pyarrow as pa

        x = matrix(group.column("x"), width)
        centre = x.mean(axis=0)
        return pa.table({"leaf": group.column("leaf")[:1], "centre": pa.array([centre.tobytes()], pa.binary()), "spread": [float(np.sqrt(((x - centre) ** 2).mean()))]})

    some_of_each = indexed.withColumn("k", F.row_number().over(W.partitionBy("leaf").orderBy(F.xxhash64(F.lit(4), "id"), "x"))).where(F.col("k") <= MEASURED)
    held, centres, spread = np.zeros(tree.leaves), np.zeros((tree.leaves, width)), np.zeros(tree.leaves)
    for r in indexed.groupBy("leaf").count().collect():  # a row a leaf
        held[r.leaf] = r["count"]
    for r in some_of_each.select("leaf", "x").groupBy("leaf").applyInArrow(measure, "leaf int, centre binary, spread double").collect():  # a row a leaf
        centres[r.leaf], spread[r.leaf] = np.frombuffer(r.centre, dtype="<f8"), r.spread
    tree = Tree(tree.root, (held, centres, spread))
    shared = Shared(spark, "ann", tree)
    asked_first = Shared(spark, "ann-tests", (test_ids, tests))

    def exact(batches: Iterator):
        import pyarrow as pa

        ids, queries = asked_first.value
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                q, v, score = best_of(queries, ids, matrix(batch.column(2), width), own, k)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(own[v]), pa.array(batch.column(1).to_numpy()[v]), pa.array(score)], names=["q", "id", "leaf", "score"])

    each_test = W.partitionBy("q").orderBy(F.desc("score"), "id")
    true: dict[int, list[int]] = {}
    for r in indexed.mapInArrow(tidied(exact), "q int, id long, leaf int, score double").withColumn("k", F.row_number().over(each_test)).where(F.col("k") <= k).collect():
        true.setdefault(r.q, []).append(r.leaf)

    def places(batches: Iterator):
        """When the leaves of each test's true neighbours come out of the queue."""
        import pyarrow as pa

        for batch in batches:
            out = []
            for x, leaves in zip(matrix(batch.column(0), width), batch.column(1).to_pylist()):
                order = {leaf: k for k, leaf in enumerate(shared.value.visits(x, len(held), wanted=set(leaves))[0], 1)}
                out += [order[leaf] for leaf in leaves]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["place"])

    test_rows = spark.createDataFrame([(tests[q].astype("<f8").tobytes(), leaves) for q, leaves in true.items()], "x binary, leaves array<int>")
    reached = test_rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(tidied(places), "place int").groupBy("place").count().collect()  # of the tests' neighbours
    found = np.zeros(tree.leaves + 1)
    for r in reached:
        found[r.place] = r["count"]
    share = np.cumsum(found) / max(1, found.sum())
    most = min(tree.leaves, max(1, int(np.searchsorted(share, recall - 1e-12))))
    large = held > BLOCK
    start = np.cumsum(np.where(large, 0, held)) // BLOCK
    # a large leaf is a group of its own, so are the leaves between two of them that fall into one block
    group = np.cumsum(np.concatenate(([0], (np.diff(start) > 0) | large[1:] | large[:-1])))
    blocks = np.ones(int(group[-1]) + 1, dtype=np.int64)
    blocks[group[large]] = -(-held[large] // BLOCK)
    laid = Shared(spark, "ann-laid", group)

    def walk(batches: Iterator):
        import pyarrow as pa

        tree, group = shared.value, laid.value
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            at, groups, leaves = [], [], []
            for row, x in enumerate(matrix(batch.column(1), width)):
                visited = np.sort(np.array(tree.visits(x, most, k + 1)[0], dtype=np.int32))
                own = group[visited]
                cuts = np.flatnonzero(np.diff(own)) + 1
                at += [row] * (len(cuts) + 1)
                groups += own[np.concatenate(([0], cuts))].tolist()
                leaves += np.split(visited, cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(groups, pa.int32()), pa.array([x.tobytes() for x in leaves], pa.binary()), batch.column(1).take(pa.array(at))], names=["query_id", "grp", "leaves", "q"])

    dealt = max(spark.sparkContext.defaultParallelism, asking // 4096)  # walks are long and rows short, so partitions go by number
    queries = indexed.where(is_query(F.col("id"))).select("id", "x").repartition(dealt, "id").groupBy("id").agg(F.min("x").alias("x"))
    asked = materialise(queries.mapInArrow(tidied(walk), "query_id long, grp int, leaves binary, q binary"), "ann-asked")
    places = spark.createDataFrame([(leaf, int(group[leaf]), int(blocks[group[leaf]])) for leaf in range(tree.leaves) if held[leaf]], "leaf int, grp int, blocks int")  # MAX_LEAVES bounds it
    asks = asked.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("groups"))  # a row a group
    both = places.select("grp", "blocks").distinct().join(F.broadcast(asks), "grp")
    stored = indexed.join(F.broadcast(places.join(F.broadcast(asks), "grp")), "leaf").select("grp", F.pmod(F.xxhash64("id", "x"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "leaf", "id", "x")
    sent = asked.join(F.broadcast(both), "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id", F.lit(5)), "groups").cast("int").alias("part"), "query_id", "leaves", "q")

    def match(_, stored, asked):
        import pyarrow as pa

        if not stored.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query_ids, leaf = stored.column("id").to_numpy(), asked.column("query_id").to_numpy(), stored.column("leaf").to_numpy()
        vectors, queries = matrix(stored.column("x"), width), matrix(asked.column("q"), width)
        visited = [np.frombuffer(x, dtype=np.int32) for x in asked.column("leaves").to_pylist()]
        low, parts = int(leaf.min()), []
        for at in range(0, len(queries), 128):
            own = visited[at : at + 128]
            seen = np.zeros((len(own), int(leaf.max()) - low + 1), dtype=bool)
            for row, leaves in enumerate(own):
                near = leaves[(leaves >= low) & (leaves < low + seen.shape[1])]
                seen[row, near - low] = True
            q, v, score = best_of(queries[at : at + 128], query_ids[at : at + 128], vectors, ids, k, seen[:, leaf - low])
            parts.append((query_ids[at : at + 128][q], ids[v], score))
        a, b, c = (np.concatenate(x) for x in zip(*parts))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    keys = ("grp", "block", "part")
    met = stored.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(match, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
