import os

from pyspark.sql import functions as F

from lumisift.llm import common


def test_scratch_is_one_folder_that_can_be_removed(spark):
    one, two = (common.materialise(spark.range(k), "test") for k in (3, 4))
    assert one.count() == 3 and two.count() == 4
    folder = spark.sparkContext._lumisift_llm_scratch
    assert all(common.scratch_path(spark, "x").startswith(folder) for _ in range(2))
    place = folder.removeprefix("file://")
    assert len(os.listdir(place)) >= 2
    common.remove_scratch(spark)
    assert not os.path.exists(place)
    assert common.materialise(spark.range(5), "again").count() == 5


def test_ranges_follow_the_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS a", "'x' AS name")
    dealt = common.in_ranges(df, [df["a"]], "ranges", each=100)
    got = dealt.groupBy("part").agg({"a": "min"}).orderBy("part").collect()
    assert len(got) >= 8 and [r[1] for r in got] == sorted(r[1] for r in got)
    assert dealt.count() == 1000 and common.in_ranges(df.limit(0), [df["a"]], "none").count() == 0


def test_written_row_groups_are_small_whatever_a_task_writes(spark):
    """A task holds a row group while it writes, and its columns twice while it reads: their size may not follow the table's."""
    import pyarrow.parquet as pq

    text = F.concat(*[F.md5(F.concat("id", F.lit(f"|{k}"))) for k in range(64)])
    out = common.materialise(spark.range(20_000, numPartitions=1).select("id", text.alias("text")), "groups")
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata for f in out.inputFiles()]
    sizes = [meta.row_group(k).total_byte_size for meta in files for k in range(meta.num_row_groups)]
    assert sum(sizes) > 2 * common.ROW_GROUP and max(sizes) < 1.5 * common.ROW_GROUP
    assert out.count() == 20_000 and out.agg(F.sum("id")).first()[0] == 199_990_000
