"""Near-duplicate frames: an exact similarity join of 64-bit hashes, and greedy leader selection over it.

Join: to find all pairs within t bits, cut the 64 bits into t+r bands; at least r of them agree, so every choice of r
bands is an equi-join key, and a pair is given at the first choice that agrees only. More bands in a key make it rarer, at the price of
more keys a row; `plan_bands` weighs the two by the number of distinct hashes. Where no bands are selective (wide thresholds), hashes are cut into
blocks, a row each, and each pair of blocks is a row that is compared whole, so tasks stay of one size whatever the number of hashes. Selection keeps a frame unless an earlier kept one is within t bits: the
lexicographically first maximal independent set. Hashes are numbered in the order and cut into ranges of it; each range is scanned in order, in rounds
that hand decisions from range to range (few for orders that are random to the hashes: Blelloch, Fineman and Shun, SPAA 2012; and never one a link of a chain, as
frames that drift do so within a range). Equal hashes are merged first, so bursts and flat frames cost one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations, groupby, islice
from math import comb
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.functions.raster import hamming
from lumisift.operators.ordered import numbered, running
from lumisift.session import checkpoint_dir
from lumisift.shipping import ship

ship(__name__)

THRESHOLD = 6
#: Pairs of near hashes that a range of the order holds, more or less.
RANGE_EDGES = 1_000_000
#: Up to so many distinct hashes, one side is broadcast where all are compared; beyond, blocks of so many meet in pairs.
NAIVE_ROWS, BLOCK_ROWS = 20_000, 8_192
#: Hashes compared with a block at a time; pairs, and decisions of a range, that are handed on at a time; pairs of blocks a task, and tasks at most.
COMPARED, GIVEN, DEALT, TASKS = 16, 50_000, 16, 10_000
#: Work of a hash under a key and of a pair that meets there, in pairs compared in a block. Measured: 4 and 0.1 microseconds, and 0.8 nanoseconds; the
#: first counts for less, as few hashes are compared by a join, not in blocks.
KEY_WORK, MET_WORK = 200.0, 32.0


def plan_bands(rows: int, threshold: int) -> tuple[int, int] | None:
    """(bands, bands in a key) with the least work for so many hashes, or None where comparing all pairs is cheaper."""
    best, choice = rows * rows / 2.0, None
    for used in range(1, 5):
        bands = threshold + used
        if bands > 64:
            break
        keys, bits = comb(bands, used), 64 * used // bands
        work = rows * keys * KEY_WORK + rows * rows / 2.0 * keys / 2.0**bits * MET_WORK
        if keys <= 1000 and work < best:
            best, choice = work, (bands, used)
    return choice


def _parts(h: Column, bands: int) -> list[Column]:
    edges = [64 * k // bands for k in range(bands + 1)]
    return [F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) if high - low < 64 else h for low, high in zip(edges, edges[1:])]


def _longs(values: Iterable[int]) -> Column:
    """An array of constants as one expression: one for each would be planned, printed and compiled by the driver."""
    return F.split(F.lit(",".join(str(x - (x >> 63 << 64)) for x in values)), ",").cast("array<long>")


def band_keys(hashes: DataFrame, bands: int, used: int) -> DataFrame:
    """hashes(h) -> h, which, value: a row for every choice of `used` of the bands, with the bits that it leaves."""
    edges = [64 * k // bands for k in range(bands + 1)]
    masks = [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen) for chosen in combinations(range(bands), used)]
    return hashes.select("h", F.posexplode(_longs(masks)).alias("which", "mask")).select("h", "which", F.col("h").bitwiseAND(F.col("mask")).alias("value"))


def _first_choice(which: Column, bands: int, used: int) -> Column:
    """Of a pair (a, b) under a key: no earlier choice agrees too. Choices are in order, so none of the bands before its last may agree but its own."""
    differ = _parts(F.col("a").bitwiseXOR(F.col("b")), bands)
    agree = sum((F.when(d == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, d in enumerate(differ[1:], 1)), F.when(differ[0] == 0, F.lit(1)).otherwise(F.lit(0)))
    chosen = [sum(1 << k for k in c) for c in combinations(range(bands), used)]
    upto = [(1 << c.bit_length()) - 1 for c in chosen]
    return agree.cast("long").bitwiseAND(F.get(_longs(upto), which)) == F.get(_longs(chosen), which)


def _in_blocks(hashes: DataFrame, rows: int, threshold: int) -> DataFrame:
    """All pairs within the threshold, from each pair of blocks of about BLOCK_ROWS hashes: a row a block, and one a pair of them."""

    def compare(batches: Iterator):
        import pyarrow as pa

        def said(a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            same = [i == j for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            for k, one in enumerate(same):
                x, y = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                a, b, held = [], [], 0
                for at in range(0, len(x), COMPARED):
                    part = x[at : at + COMPARED]
                    row, column = divmod(np.flatnonzero(np.bitwise_count((part[:, None] ^ y).view(np.uint64)) <= threshold), len(y))
                    u, v = part[row], y[column]
                    if one:  # a block with itself gives each pair twice, and each hash with itself
                        u, v = u[u < v], v[u < v]
                    a.append(np.minimum(u, v)), b.append(np.maximum(u, v))
                    held += len(u)
                    if held >= GIVEN:
                        yield said(a, b)
                        a, b, held = [], [], 0
                if held:
                    yield said(a, b)

    checkpoint_dir(hashes.sparkSession)
    blocks = -(-rows // BLOCK_ROWS)
    whole = hashes.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int").alias("own")).agg(F.collect_list("h").alias("hs")).checkpoint()
    x = whole.select(F.col("own").alias("i"), F.explode(F.sequence("own", F.lit(blocks - 1))).alias("j"), F.col("hs").alias("x"))
    y = whole.select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("hs").alias("y"))
    tasks = min(TASKS, -(-blocks * (blocks + 1) // 2 // DEALT))  # a number of its own: by size, many pairs of blocks would meet in one task
    x, y = (side.repartition(tasks, "i", "j") for side in (x, y))
    spread = x.hint("merge").join(y, ["i", "j"]).select("i", "j", "x", "y")
    return spread.mapInArrow(compare, "a long, b long")


def similar_pairs(hashes: DataFrame, threshold: int = THRESHOLD, rows: int | None = None, plan: tuple[int, int] | None = None, compare_all: bool = False) -> DataFrame:
    """hashes(h long, distinct) -> (a, b): all pairs a < b within the threshold, each once.

    rows: their number, counted if not given. The plan is chosen by it unless one is given, or compare_all asks for none.
    """
    rows = hashes.count() if rows is None else rows
    if plan is None and not compare_all:
        plan = plan_bands(rows, threshold)
    left, right = hashes.select(F.col("h").alias("a")), hashes.select(F.col("h").alias("b"))
    near = (F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= threshold)
    if plan is None:
        return left.join(F.broadcast(right), near) if rows <= NAIVE_ROWS else _in_blocks(hashes, rows, threshold)
    keyed = band_keys(hashes, *plan)
    x, y = keyed.withColumnRenamed("h", "a"), keyed.withColumnRenamed("h", "b")
    return x.join(y, ["which", "value"]).where(near & _first_choice(F.col("which"), *plan)).select("a", "b")


def streamed(edges: Iterable[tuple[int, int, bool | None]]) -> Iterator[tuple[int, bool]]:
    """(frame, kept) as far as the open edges(earlier, later, whether the earlier is kept or None) of a range tell, in one scan; they come by the later.

    A frame with a kept one before it is dropped; one with dropped ones only is kept; what hangs on an undecided frame of another range stays open.
    What it holds is a row a decided frame of the range, whatever the number of edges.
    """
    kept: dict[int, bool] = {}
    at, lost, open_ = None, False, False
    for x, y, known in chain(edges, [(None, None, None)]):
        if y != at:
            if at is not None and (lost or not open_):
                kept[at] = not lost
                yield at, kept[at]
            at, lost, open_ = y, False, False
        if not lost:
            said = kept.get(x) if known is None else known
            lost, open_ = said is True, open_ or said is None


def scanned(edges: list[tuple[int, int, bool | None]]) -> dict[int, bool]:
    """`streamed`, of edges in any order."""
    return dict(streamed(sorted(edges, key=itemgetter(1))))


def settled(edges: DataFrame) -> DataFrame:
    """edges(x, y, part) of numbers x < y, part the range of y -> (n, kept) of all y: y is kept unless a kept x comes before it.

    Each round scans all ranges, each on its own, in order and as its edges stream by, with what earlier rounds have decided of the others. The first
    range that is open is decided whole in a round, and so is whatever does not hang on another range's undecided frames: a chain within a
    range takes no more rounds than a pair, and chains across ranges one a crossing.
    """
    roots = edges.select(F.col("x").alias("n")).join(edges.select(F.col("y").alias("n")), "n", "left_anti").distinct()
    open_ = edges.join(roots.withColumn("known", F.lit(True)), F.col("x") == F.col("n"), "left").select("part", "x", "y", "known").checkpoint()
    found: list[DataFrame] = []

    def scan(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def decided():
            for _, edges in groupby(rows(), itemgetter(0)):
                yield from streamed(e[1:] for e in edges)

        found = decided()
        while said := list(islice(found, GIVEN)):
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in said], pa.int64()), pa.array([k for _, k in said], pa.bool_())], names=["n", "kept"])

    while not open_.isEmpty():
        new = open_.select("part", "x", "y", "known").repartition("part").sortWithinPartitions("part", "y").mapInArrow(scan, "n long, kept boolean").checkpoint()
        found.append(new)
        left = open_.join(new.select(F.col("n").alias("y")), "y", "left_anti").join(new.select(F.col("n").alias("x"), F.col("kept").alias("now")), "x", "left")
        open_ = left.select("part", "x", "y", F.coalesce("known", "now").alias("known")).checkpoint()
    out = edges.sparkSession.createDataFrame([], "n long, kept boolean")
    for new in found:
        out = out.unionByName(new)
    return out


def leaders(frames: DataFrame, order: list[Column], threshold: int = THRESHOLD, each: int | None = None, edges_each: int = RANGE_EDGES) -> DataFrame:
    """frames(name, h, ...) -> (name, kept, winner) under an order that names break.

    winner: the earliest kept frame within the threshold of a dropped one. A null h is kept and joins no cluster. each, edges_each: hashes and edges of a range.
    """
    checkpoint_dir(frames.sparkSession)
    slim = frames.select("name", "h", F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col("name").alias("name")).alias("ord")).checkpoint()
    known = slim.where(F.col("h").isNotNull())
    first = known.groupBy("h").agg(F.min("ord").alias("ord")).checkpoint()
    rows = first.count()
    pairs = similar_pairs(first.select("h"), threshold, rows).checkpoint()
    ranges = max(1, -(-pairs.count() // edges_each))
    placed = numbered(first, [F.col("ord")], each, ranges).checkpoint()
    a, b = (placed.select(F.col("h").alias(c), F.col("pos").alias(c + "p"), F.col("part").alias(c + "r")) for c in "ab")
    laid = pairs.join(a, "a").join(b, "b")
    edges = laid.select(F.least("ap", "bp").alias("x"), F.greatest("ap", "bp").alias("y"), F.greatest("ar", "br").alias("part")).checkpoint()
    dropped = settled(edges).where("NOT kept").select("n").checkpoint()
    lost = edges.join(dropped.withColumnRenamed("n", "y"), "y", "left_semi").join(dropped.withColumnRenamed("n", "x"), "x", "left_anti")
    led = lost.groupBy("y").agg(F.min("x").alias("pos")).join(placed.select("pos", F.col("ord").alias("lo")), "pos").select(F.col("y").alias("pos"), "lo")
    heads = placed.join(led, "pos", "left").select("h", F.coalesce("lo", "ord").alias("lead"))
    named = known.join(heads, "h").select("name", F.col("lead.name").alias("lead"))
    out = named.select("name", (F.col("lead") == F.col("name")).alias("kept"), F.when(F.col("lead") != F.col("name"), F.col("lead")).alias("winner"))
    return out.unionByName(slim.where(F.col("h").isNull()).select("name", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("winner")))


def clusters(led: DataFrame, frames: DataFrame, order: list[Column]) -> DataFrame:
    """(winner, ord, loser): the dropped frames of each winner, numbered in the order in which they were seen.

    order is the one that `leaders` was given. Numbers come from ranges of all losers, so a winner of any size meets in no task.
    """
    keys = [f"o{k}" for k in range(len(order))]
    lost = led.where(~F.col("kept")).join(frames.select("name", *[c.alias(k) for c, k in zip(order, keys)]), "name")
    placed = numbered(lost.select("winner", *keys, F.col("name").alias("loser")), [F.col(c) for c in ("winner", *keys, "loser")])
    return running(placed, ["winner"], F.lit(1), "ord").select("winner", F.col("ord").cast("int").alias("ord"), "loser")
