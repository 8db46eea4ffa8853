"""Mixing sources to target weights with a time-varying curriculum.

Native: DataFrame functions only. Each source has a weight schedule over training time 0..1, piecewise linear. Its
integral is the source's weight; water-filling turns weights into word targets, none above `cap` times the source. The
source's documents, in a keyed order, are read round and round until the target is met; the last one taken is cut at
the word where the target is reached. A taken copy sits at the training time at which its source's cumulative demand
reaches the copy's middle, found by inverting the integral, and rows are range-sorted by that position.

Running sums never need a source in one task: documents are dealt into ranges of (source, keyed order), whose sums are
accumulated first, a row a source and range. Rows that share a doc_id, null or not, are told apart by their text, and repeated rows by a
number, so they spread over ranges like any others. The sources too are numbered by ranges, and the water level is found by rounds of sums.

Defined cases: null text has size 0 and takes nothing; a null source is a source, last; null doc_ids count as rows;
repeated rows are mixed each for itself, and are interchangeable; rows of one doc_id are taken by size, then by a hash of the text; other
columns are ignored but for those in `carry`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_ranges, materialise

#: Schedules of the sources by turns: (time, weight) knots from 0 to 1. Their integrals are 5, 2 and 1.
SCHEDULES = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.0), (0.5, 1.0), (1.0, 2.0)))
WORD = r"[^\x20\x09-\x0D]+"


def integral(knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def inverted(knots, share: Column) -> Column:
    """The time at which the integral of the schedule reaches this share (0..1) of its whole."""
    total, below, out = integral(knots), 0.0, F.lit(1.0)
    steps = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        if area > 0:
            need = share * total - below
            at = need / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * need)) - w0) / slope
            steps.append((below + area, F.least(F.lit(t1), F.lit(t0) + at)))
        below += area
    for upto, at in reversed(steps):
        out = F.when(share * total <= upto, at).otherwise(out)
    return out


def n_words(text: Column) -> Column:
    """Maximal runs of other than ASCII white space; null: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sources: DataFrame, schedules=SCHEDULES, cap: int = 3) -> DataFrame:
    """sources(skey, source_size) -> with class (index of its schedule) and target."""
    order = [F.col("skey").startswith("n"), F.col("skey")]
    dealt = in_ranges(sources, order, "mix-sources")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a range of sources
    counts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(integral(k))) for k in schedules]), F.col("class") + 1)
    ranked = dealt.join(F.broadcast(counts), "part").select("skey", "source_size", (place % len(schedules)).cast("int").alias("class"))
    ranked = materialise(ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap))), "mix-ranked")
    size, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    # sources at their limit give the rest to the others, until no more reach theirs; the level only rises
    level, full = None, None
    while weights is not None:
        limit, weighed = full or (0.0, 0.0)
        level = (size - limit) / (weights - weighed) if weights > weighed else None
        if level is None:
            break
        at = ranked.where(F.col("limit") / F.col("weight") <= level).agg(F.coalesce(F.sum("limit"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if tuple(at) == (limit, weighed):
            break
        full = tuple(at)
    reached = F.col("limit") if level is None else F.least(F.col("limit"), F.col("weight") * F.lit(level))
    return ranked.select("skey", "source_size", "class", reached.alias("target"))


def _position(share: Column, schedules) -> Column:
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        out = F.when(F.col("class") == k, inverted(knots, share)).otherwise(out)
    return out


def mix(docs: DataFrame, schedules=SCHEDULES, cap: int = 3, seed: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, size, source_size, target, taken, passes, position, class, start_at.

    taken: words the mix takes of the document, repeats counted; passes: copies begun; position: training time of the
    first copy, null where nothing is taken; start_at: words of the source before the document. Columns in `carry` are kept. Rows are
    range-partitioned and sorted by position.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    tie = [F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("tie2")]
    slim = materialise(docs.select("doc_id", "source", *carry, n_words(F.col("text")).alias("size"), skey.alias("skey"), key.alias("h"), *tie), "mix")
    by = [F.col(c) for c in ("h", "doc_id", "size", "tie", "tie2")]
    dealt = in_ranges(slim, [F.col("skey"), *by], "mix-ranges", least=int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = dealt.groupBy("skey", "part").agg(F.sum("size").alias("words"))
    goal = targets(sums.groupBy("skey").agg(F.sum("words").alias("source_size")), schedules, cap)
    before = W.partitionBy("skey").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(goal, "skey")
    within = W.partitionBy("skey", "part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.join(ranges, ["skey", "part"]).withColumn("start_at", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    goal_words, whole = F.round("target").cast("long"), F.col("source_size")
    full = F.expr("CAST(round(target) AS BIGINT) div greatest(source_size, 1L)")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), goal_words - full * whole - F.col("start_at")))
    taken = placed.withColumn("taken", full * F.col("size") + cut).withColumn("passes", (full * (F.col("size") > 0).cast("long") + (cut > 0).cast("long")).cast("int"))
    share = (F.col("start_at") + F.least("size", "taken") / 2) / F.greatest(goal_words, F.lit(1))
    out = taken.withColumn("position", F.when(F.col("taken") > 0, _position(share, schedules)))
    order = ["position", "doc_id", "tie", "tie2"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "source", *carry, "size", "source_size", "target", "taken", "passes", "position", "class", "start_at")


def copies(mixed: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """A row for each copy that a mix takes: the mix's columns with `copy` (from 1), `words` of it that are taken, and its own position."""
    each = mixed.where("passes > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes")))).withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    share = (F.col("start_at") + (F.col("copy") - 1) * F.col("source_size") + F.col("words") / 2) / F.greatest(F.round("target"), F.lit(1.0))
    return each.withColumn("position", _position(share, schedules))
