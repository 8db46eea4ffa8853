"""Order over all rows without a task that sees them all: ranges of the order, and what runs on from one range to the next.

Rows are cut into ranges of about RANGE_ROWS by their order and written with the number of their range, so every later step sees the same cut.
Within a range a window does the work; from range to range goes one value, of the key that the range before ended with. Those values (a row a
range) are all that reaches the driver, so neither one long key nor a long table meets in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumisift.session import checkpoint_dir

RANGE_ROWS = 250_000


def numbered(rows: DataFrame, order: list[Column], each: int | None = None, least: int = 1) -> DataFrame:
    """rows with `part`, the range they lie in, and `pos`, their number in the order from 0. Ties are numbered anyhow, but once and for all."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    parts = max(least, -(-rows.count() // (each or RANGE_ROWS)))
    cut = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    in_part = cut.withColumn("pos", F.row_number().over(W.partitionBy("part").orderBy(*order)).cast("long") - 1).checkpoint()
    sizes, starts, total = {r.part: r["count"] for r in in_part.groupBy("part").count().collect()}, [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    offsets = spark.createDataFrame(starts, "part int, _before long")  # a row a range
    return in_part.join(F.broadcast(offsets), "part").withColumn("pos", F.col("pos") + F.col("_before")).drop("_before")


def running(rows: DataFrame, keys: list[str], value: Column, name: str, kind: str = "sum", strict: bool = False, reverse: bool = False) -> DataFrame:
    """Adds the running sum, min or last of a value within each key.

    rows: numbered in an order that begins with the keys. strict leaves the row itself out (null before the first, for sums 0); reverse runs from the end.
    """
    spark = rows.sparkSession
    own, key = rows.withColumn("_v", value), F.struct(F.lit(0), *keys)
    total = {"sum": F.sum("_v"), "min": F.min("_v"), "last": F.max_by("_v", -F.col("pos") if reverse else F.col("pos"))}[kind]
    each = own.groupBy("part", *keys).agg(total.alias("_v"))
    ends = each.groupBy("part").agg(F.min(key).alias("k0"), F.min_by("_v", key).alias("v0"), F.max(key).alias("k1"), F.max_by("_v", key).alias("v1")).collect()  # a row a range
    join = {"sum": lambda a, b: (a or 0) + (b or 0), "min": lambda a, b: a if b is None else b if a is None else min(a, b), "last": lambda a, b: b}[kind]
    carried, open_, held = [], None, None
    for r in sorted(ends, key=lambda r: -r.part if reverse else r.part):
        first, last = ((r.k1, r.v1), (r.k0, r.v0)) if reverse else ((r.k0, r.v0), (r.k1, r.v1))
        on = first[0] == open_
        if on:
            carried.append((r.part, tuple(first[0]), held))
        open_, held = last[0], join(held, last[1]) if on and r.k0 == r.k1 else last[1]
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    fields = ", ".join(["c0: int", *(f"c{j + 1}: {types[k]}" for j, k in enumerate(keys))])
    brought = spark.createDataFrame(carried, f"part int, _k struct<{fields}>, _c {each.schema['_v'].dataType.simpleString()}")
    window = W.partitionBy("part", *keys).orderBy(F.desc("pos") if reverse else F.asc("pos")).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    here = {"sum": F.sum, "min": F.min, "last": F.last}[kind]("_v").over(window)
    met = own.withColumn("_own", here).join(F.broadcast(brought), "part", "left")
    mine = F.lit(True)
    for j, k in enumerate(keys):
        mine &= F.col(k).eqNullSafe(F.col(f"_k.c{j + 1}"))
    before = F.when(mine & F.col("_k").isNotNull(), F.col("_c"))
    out = {"sum": F.coalesce("_own", F.lit(0)) + F.coalesce(before, F.lit(0)), "min": F.least("_own", before), "last": F.coalesce("_own", before)}[kind]
    return met.withColumn(name, out).drop("_v", "_own", "_k", "_c")
