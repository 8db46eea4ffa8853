"""Progress of running work: told on change, once each, in order, to an end."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from lumisift import cli
from lumisift.functions.png import png
from lumisift.shipping import ship
from lumisift.streaming import progress, watch

ship(__name__)


def test_the_broker_tells_changes_once():
    told = []
    b = watch.Broker("r", told.append)
    for said in (("scan", 0, 5), ("scan", 0, 5), ("scan", 5, 5), ("dedup", 0, 0)):
        b.update(*said)
    b.finish(), b.finish(), b.update("late", 1, 1)
    assert [(s["seq"], s["stage"], s["done"], s["total"], s["finished"]) for s in told] == [(1, "scan", 0, 5, False), (2, "scan", 5, 5, False), (3, "dedup", 0, 0, False), (4, "dedup", 0, 0, True)]
    assert b.after(99, timeout=0.01)["seq"] == 4


def test_followers_wait_skip_and_stop():
    b = watch.Broker()
    got = []
    reader = threading.Thread(target=lambda: got.extend(s["seq"] for s in b.states(5)))
    reader.start()
    for k in range(200):
        b.update("scan", k, 200)
    b.finish()
    reader.join(5)
    assert got == sorted(set(got)) and got[-1] == 201
    start = time.monotonic()
    assert [s["stage"] for s in watch.Broker().states(bound=0.3)] == [""] and time.monotonic() - start < 2  # nothing comes, and the bound ends it


def test_stages_advance_with_tasks(spark):
    told = []
    w = watch.Watch(spark, watch.Broker("r", told.append), every=0.05)
    with w.stage("work"):
        spark.range(0, 24, 1, 12).select(F.udf(lambda x: time.sleep(0.05) or x)("id").alias("x")).count()
        spark.range(0, 24, 1, 12).select(F.udf(lambda x: time.sleep(0.05) or x)("id").alias("x")).agg(F.max("x")).collect()
    said = [(s["done"], s["total"]) for s in told]
    assert said[0] == (0, 0) and said[-1][0] == said[-1][1] >= 12 and len(said) > 2 and all(d < t for d, t in said[1:-1])
    with pytest.raises(ValueError), w.stage("bad"):
        raise ValueError("x")
    assert told[-1]["stage"] == "bad" and told[-1]["done"] == told[-1]["total"] == 0


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(progress.ROCKS[0], None)
    spark.conf.set(*progress.ROCKS)
    yield spark
    spark.conf.set(progress.ROCKS[0], before) if before else spark.conf.unset(progress.ROCKS[0])


def started(frame, name, where):
    return frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(where)).start()


def wait_for(spark, name, condition, n, seconds=60):
    """With timers a stream never is at rest, so its table is watched."""
    until = time.time() + seconds
    while time.time() < until and spark.table(name).where(condition).count() < n:
        time.sleep(0.3)


def test_a_stream_follows_runs_to_their_end(rocks, tmp_path):
    spark = rocks
    log = tmp_path / "log"
    log.mkdir()
    brokers = {run: watch.Broker(run, watch.log_to(f"file://{log}/{run}")) for run in ("a", "b")}
    for run in brokers:
        (log / run).mkdir()
    query = started(progress.live_stream(watch.logged(spark, f"file://{log}")), "followed", tmp_path / "c")
    try:
        a, b = brokers["a"], brokers["b"]
        a.update("scan", 0, 2), b.update("scan", 0, 9)
        wait_for(spark, "followed", "true", 2)
        a.update("scan", 2, 2), a.finish()
        wait_for(spark, "followed", "run = 'a'", 3)
        (log / "a" / "late.json").write_text(json.dumps(a.state | {"seq": 9, "stage": "late", "finished": False}) + "\n")
        b.update("scan", 3, 9)
        wait_for(spark, "followed", "run = 'b'", 2)
        rows = sorted(tuple(r) for r in spark.sql("SELECT run, serial, stage, done, finished, ended FROM followed").collect())
    finally:
        query.stop()
    assert rows == [("a", 1, "scan", 0, False, None), ("a", 2, "scan", 2, False, None), ("a", 3, "scan", 2, True, "finished"), ("b", 1, "scan", 0, False, None), ("b", 2, "scan", 3, False, None)]


def test_a_timer_ends_what_never_finishes(rocks, tmp_path):
    spark = rocks
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"run": "r", "seq": 1, "stage": "scan", "done": 1, "total": 5, "finished": False}) + "\n")
    query = started(progress.live_stream(watch.logged(spark, f"file://{tmp_path}/in"), bound=1), "timed", tmp_path / "c")
    try:
        wait_for(spark, "timed", "ended IS NOT NULL", 1)
        rows = sorted(tuple(r) for r in spark.sql("SELECT serial, stage, done, finished, ended FROM timed").collect())
    finally:
        query.stop()
    assert rows == [(1, "scan", 1, False, None), (2, "scan", 1, False, "expired")]


def test_a_running_cull_shows_its_progress(spark, tmp_path, capsys, monkeypatch):
    import numpy as np

    monkeypatch.setattr(cli, "session", lambda: spark)
    rng = np.random.default_rng(1)
    shots, log = tmp_path / "shots", tmp_path / "log"
    shots.mkdir()
    for k in range(6):
        (shots / f"p{k}.png").write_bytes(png(rng.integers(0, 256, (900, 900), dtype=np.uint8)))
    log.mkdir()
    assert cli.main(["cull", str(shots), "--top", "3", "--progress-log", str(log), "--json"]) == 0
    err = capsys.readouterr().err
    assert [x.split(":")[0].strip() for x in err.splitlines() if ":" in x and x.split(":")[1].strip() == "0/0"] == ["scan", "dedup", "select"]
    said = [json.loads((log / f).read_text()) for f in sorted(os.listdir(log)) if f.endswith(".json")]
    assert [s["seq"] for s in said] == list(range(1, len(said) + 1)) and said[-1]["finished"] and sum(s["finished"] for s in said) == 1
    assert [k for k, s in enumerate(said) if s["done"] == s["total"] > 0]
    assert cli.main(["cull", str(shots), "--top", "3", "--live-progress", "--output", str(tmp_path / "out"), "--json"]) == 0
    shown = capsys.readouterr().err
    assert "finished" in shown and "write" in shown and len(os.listdir(tmp_path / "out")) == 3
    assert cli.main(["cull", str(tmp_path / "out2"), "--live-progress"]) == 1
