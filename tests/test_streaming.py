"""Streams give what the batch operators give."""

import random

from lumisift.operators import review
from lumisift.shipping import ship
from lumisift.streaming import decisions, progress
from pyspark.sql import functions as F

ship(__name__)


def stream(spark, rows, schema, folder, parts=3):
    """The rows as files that arrive one by one."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def finished(query):
    query.processAllAvailable()
    query.stop()


def test_progress_changes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["r1", "r2"]), k, rng.choice(["scan", "score"]), rng.randrange(2), 5) for k in range(60)]
    schema = "run string, seq long, stage string, done int, total int"
    want = {tuple(r) for r in progress.changes(spark.createDataFrame(rows, schema)).select("run", "seq", "stage", "done", "total", "serial").collect()}
    source = stream(spark, rows, schema, str(tmp_path))
    finished(progress.change_stream(source).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start())
    got = [tuple(r) for r in spark.sql("SELECT run, seq, stage, done, total, serial FROM changed").collect()]
    assert set(got) == want and len(got) == len(want)
    last = {r.run: r.serial for r in progress.latest(spark.table("changed")).collect()}
    assert last == {run: max(x[5] for x in want if x[0] == run) for run in last}


def test_decisions_fold(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c"]), k, rng.choice([*decisions.ACTIONS[:4]] * 9 + ["reset"]), rng.randrange(5)) for k in range(200)]
    schema = "session string, at long, action string, idx int"
    want = {r.session: (r.decisions, r.history) for r in review.fold_decisions(spark.createDataFrame(rows, schema)).collect()}
    source = stream(spark, rows, schema, str(tmp_path), 4)
    finished(decisions.decision_stream(source).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start())
    newest = spark.table("folded").groupBy("session").agg(F.max_by(F.struct("decisions", "history"), "version").alias("s"))
    assert {r.session: (r.s.decisions, r.s.history) for r in newest.collect()} == want
