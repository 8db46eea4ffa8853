"""The score cache as a log, sessions that several change, calls that are asked once, embedded labels."""

import json
import math
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift import sinks
from lumisift.operators import classify, rerank
from lumisift.plans import desk
from lumisift.shipping import ship
from lumisift.sources import cache

ship(__name__)


def rows(spark, **said):
    return spark.createDataFrame([(k, {"a": v}) for k, v in said.items()], cache.SCHEMA)


def held(spark, path, versions=None):
    return {r.key: r.probs["a"] for r in cache.read(spark, path, versions).collect()}


def test_the_newest_version_of_each_key_counts(spark, tmp_path):
    path = f"{tmp_path}/cache"
    assert held(spark, path) == {} and cache.compact(spark, path) is None
    sinks.write_table(rows(spark, k=0.1, old=0.2), path)  # a table of before
    cache.append(rows(spark, k=0.5, l=0.6), path)
    cache.append(rows(spark, l=0.7), path)
    assert held(spark, path) == {"k": 0.5, "old": 0.2, "l": 0.7}
    os.makedirs(f"{path}/v=000000000009-dead")  # a write that never was committed
    assert held(spark, path) == {"k": 0.5, "old": 0.2, "l": 0.7}


def test_readers_keep_their_table_while_it_is_compacted(spark, tmp_path):
    path = f"{tmp_path}/cache"
    for k in range(4):
        cache.append(rows(spark, **{f"k{k}": k / 10, "same": k / 10}), path)
    before = cache.live(spark, path)
    reader = cache.read(spark, path)  # planned before
    late = cache.append(rows(spark, late=0.9), path)
    base = cache.compact(spark, path)
    raced = cache.append(rows(spark, k0=0.8), path)
    want = {"k0": 0.0, "k1": 0.1, "k2": 0.2, "k3": 0.3, "same": 0.3}
    assert {r.key: r.probs["a"] for r in reader.collect()} == want
    assert cache.live(spark, path) == [base, raced] and held(spark, path) == want | {"late": 0.9, "k0": 0.8}
    assert held(spark, path, before) == want  # still there
    again = cache.compact(spark, path)
    assert cache.live(spark, path) == [again] and held(spark, path) == want | {"late": 0.9, "k0": 0.8}
    assert not any(os.path.exists(f"{path}/{v}") for v in [*before, late]) and os.path.exists(f"{path}/{base}")


def session(n=4):
    return desk.counted({"source_folder": "s", "prompt": "", "input_count": n, "reject_summary": {}, "candidates": [{"idx": k, "path": f"{k}", "filename": f"{k}", "score": 1.0, "decision": "", "rejected_reason": "", "similar": []} for k in range(n)], "history": []})


def test_two_reviewers_lose_no_event(tmp_path):
    path = f"file://{tmp_path}/s.json"
    sinks.save_session(path, session(40))

    def review(start):
        store = desk.Store(path)
        for k in range(start, 40, 2):
            store.change("keep" if start else "reject", k)

    both = [threading.Thread(target=review, args=(k,)) for k in (0, 1)]
    [t.start() for t in both], [t.join() for t in both]
    store = desk.Store(path)
    number, newest = store.newest()
    assert number == 40 and newest["counts"] == {"total": 40, "keep": 20, "reject": 20, "undecided": 0}
    assert sorted(newest["history"]) == list(range(40)) and sorted(e["idx"] for e in store.events()) == list(range(40))
    assert desk.load(path)["counts"] == newest["counts"]
    back = store.back_to(10)
    assert sum(back["counts"][k] for k in ("keep", "reject")) == 10 and store.newest()[0] == 41 and desk.load(path)["history"] == back["history"]


def test_a_change_that_cannot_be_saved_leaves_the_version_before(tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s.json"
    sinks.save_session(path, session())
    store = desk.Store(path)
    store.change("keep", 1)
    monkeypatch.setattr(sinks, "claim", lambda *_: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(desk.SaveError):
        store.change("reject", 2)
    monkeypatch.setattr(sinks, "claim", lambda *_: False)
    with pytest.raises(desk.SaveError):
        desk.Store(path, attempts=3).change("reject", 2)
    assert store.newest()[1]["history"] == [1]
    with pytest.raises(ValueError):
        store.change("keep", 99)
    with pytest.raises(ValueError):
        desk.Store(f"file://{tmp_path}/none.json").change("keep", 0)


def test_a_file_is_claimed_once(tmp_path):
    won = []
    one = lambda k: won.append(k) if sinks.claim(f"file://{tmp_path}/f", str(k).encode()) else None
    threads = [threading.Thread(target=one, args=(k,)) for k in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and os.listdir(tmp_path) == ["f"] and (tmp_path / "f").read_text() == str(won[0])


class Dies:
    """Answers, and counts what it is asked; dies once, after some answers."""

    def __init__(self, folder):
        self.folder = folder

    def score_photo(self, content, media_type, prompt):
        if content == b"p5" and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)  # the worker, not the call
        with open(f"{self.folder}/asked", "a") as f:
            f.write(content.decode() + "\n")
        return json.dumps({"score": 10 * int(content[1:]), "reason": "r"})


def test_photos_are_asked_about_once(spark, tmp_path):
    (tmp_path / "log").mkdir()
    df = spark.createDataFrame([(f"n{k}", k, f"p{k}".encode()) for k in range(8)], "name string, rank int, content binary").coalesce(1)
    how = dict(call_log=f"file://{tmp_path}/log", sleep=lambda s: None)
    try:
        rerank.rerank(df, Dies(str(tmp_path)), "best?", **how).collect()
    except Exception:  # one try a task on a local master: the job is run again
        pass
    got = rerank.rerank(df, Dies(str(tmp_path)), "best?", **how).collect()
    assert [r.name for r in sorted(got, key=lambda r: r.ai_rank)] == [f"n{k}" for k in range(7, -1, -1)]
    asked = (tmp_path / "asked").read_text().split()
    assert sorted(asked) == [f"p{k}" for k in range(8)]  # though the worker died between
    rerank.rerank(df, Dies(str(tmp_path)), "another?", **how).collect()
    assert len((tmp_path / "asked").read_text().split()) == 16


def test_embedded_labels(spark):
    rng = np.random.default_rng(4)
    labels = {"b": [1.0, 0.0, 0.0], "a": [0.0, 2.0, 0.0], "c": [1.0, 1.0, 1.0]}
    data = [(k, rng.normal(size=3).tolist()) for k in range(50)] + [(50, None), (51, [0.0] * 3), (52, [1.0]), (53, [1.0, None, 2.0])]
    got = {r.id: r.probs for r in classify.embedded(spark.createDataFrame(data, "id int, vector array<double>"), labels, 5.0).collect()}
    for k, v in data[:50]:
        odds = {x: math.exp(5 * float(np.dot(v, w)) / float(np.linalg.norm(v) * np.linalg.norm(w))) for x, w in labels.items()}
        assert [got[k][x] for x in labels] == pytest.approx([odds[x] / sum(odds.values()) for x in labels])
    assert all([got[k][x] for x in labels] == pytest.approx([1 / 3] * 3) for k in (50, 51, 52, 53))
