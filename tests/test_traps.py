"""Traps of the semantics, one test each where no other test is about it; COVERAGE.md names the rest."""

import numpy as np
import pytest
from lumisift.functions import raster
from lumisift.operators import rank, rules
from lumisift.plans import desk, profiles
from lumisift.sources.frames import with_features
from pyspark.sql import functions as F

FRAMES = "name string, score double, h long, width int, height int, decode_ok boolean, sharpness double, exposure double, capture_time timestamp_ntz, probs map<string,double>"


def frame(name, score, h, probs=None, ok=True):
    return (name, score, h if ok else None, 900, 900, ok, 100.0 if ok else 0.0, 0.5, None, probs or {})


def test_t05_flat_frames_of_any_brightness_share_a_hash(spark):
    df = spark.createDataFrame([(f"f{v}", [v] * 64, True) for v in (0, 7, 128, 255)], "name string, grid array<int>, decode_ok boolean")
    assert {r.h for r in with_features(df).collect()} == {0}
    assert raster.raster_features(np.full((64, 64), 9, dtype=np.uint8))[2] == [9] * 64


def test_t10_plain_profiles_neither_dedup_nor_gate(spark):
    labels = profiles.get("duo").labels
    probs = dict.fromkeys(labels, 0.1) | {labels[0]: 0.5}
    df = spark.createDataFrame([frame("a", 0.9, 5, probs), frame("b", 0.8, 5, probs), frame("u", 0.0, None, probs, ok=False)], FRAMES)
    for name in ("default", "duo"):
        assert {r.name for r in profiles.get(name).select(df).picked.collect()} == {"a", "b", "u"}


def test_t11_bonuses_of_a_softmax_stay_below_the_ceiling(spark):
    labels = profiles.get("story").labels
    stack = profiles.STORY_RULES
    for hot in range(len(labels)):
        logits = F.array(*[F.lit(9.0 if k == hot else 0.0) for k in range(len(labels))])
        probs = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), rules.softmax(logits))
        bonus = spark.range(1).select((stack.breakdown(F.lit(1.0), probs)["total"] - 1).alias("b")).first().b
        assert bonus <= max(r.weight for r in stack.rules) < stack.max_bonus


def test_t12_the_gallery_key_is_a_product(spark):
    a, b = {"x": 0.9, "y": 0.1, "r": 0.0}, {"x": 0.6, "y": 0.4, "r": 1.0}
    df = spark.createDataFrame([frame("a", 0.1, 1, a), frame("b", 0.5, 0xFFFF0000, b)], FRAMES)
    first = lambda select: select(df).picked.where("rank = 1").first().name
    assert first(lambda f: profiles.gallery(f, {"one": "x", "two": "y"}, None, chronological=False)) == "b"  # 0.54 < 0.60
    df = spark.createDataFrame([frame("a", 0.3, 1, a), frame("b", 0.35, 0xFFFF0000, b)], FRAMES)
    assert first(lambda f: profiles.gallery(f, {"one": "x", "two": "y"}, None, chronological=False)) == "a"  # 0.72 > 0.51
    bonus = rules.Rules((rules.Rule("r", "r", 0.75),))
    assert first(lambda f: profiles.gallery(f, {"one": "x"}, bonus, chronological=False)) == "a"  # with the bonus 0.6 * 1.1125 < 0.72
    big = spark.createDataFrame([frame("a", 0.3, 1, a), frame("b", 0.9, 0xFFFF0000, b)], FRAMES)
    assert profiles.gallery(big, {"one": "x"}, bonus, chronological=False).picked.where("rank = 1").first().name == "b"


def test_t13_galleries_dedup_in_order_of_name(spark):
    from lumisift.plans.cull import cull

    probs = {"x": 1.0}
    df = spark.createDataFrame([frame("a", 0.2, 5, probs), frame("b", 0.9, 5, probs)], FRAMES)
    assert [r.name for r in profiles.gallery(df, {"one": "x"}).picked.collect()] == ["a"]
    assert [r.name for r in cull(df).keepers.collect()] == ["b"]


def test_t17_resuming_keeps_the_history(tmp_path):
    path = f"file://{tmp_path}/s.json"
    held = desk.counted({"candidates": [{"idx": k, "path": f"{k}", "filename": f"{k}", "score": 1.0, "decision": "", "rejected_reason": "", "similar": []} for k in range(2)], "history": []})
    desk.changed(desk.changed(held, path, "keep", 1), path, "reject", 0)
    back = desk.load(path)
    assert back["history"] == [1, 0] and back["counts"]["keep"] == 1
    assert desk.changed(back, path, "undo")["counts"] == {"total": 2, "keep": 1, "reject": 0, "undecided": 1}


def test_t18_names_are_folded_in_a_cull_only(spark):
    df = spark.createDataFrame([("b",), ("A",), ("a",), ("B",)], "name string")
    assert [r.name for r in df.orderBy(*rank.presentation("name", score="name", time="name")).collect()] == ["A", "a", "B", "b"]
    probs = {"x": 1.0}
    rows = [frame(n, 0.5, h, probs) for n, h in (("b", 0), ("A", 0xFFFF), ("a", 0xFFFF0000), ("B", 0xFFFF00000000))]
    picked = profiles.gallery(spark.createDataFrame(rows, FRAMES), {"one": "x"}).picked
    assert [r.name for r in picked.orderBy("rank").collect()] == ["A", "B", "a", "b"]


def test_a_hidden_fault_of_the_text_operators_is_not_swallowed(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as entry

    real = builtins.__import__
    for missing, hidden in (("corpus_pipeline", True), ("numpy.nothing", False)):

        def broken(name, *a, missing=missing, **k):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(name, *a, **k)

        monkeypatch.setattr(builtins, "__import__", broken)
        if hidden:
            importlib.reload(entry)
            assert "cull_top_n" in entry.queries() and "pipeline" not in entry.queries()
        else:
            with pytest.raises(ModuleNotFoundError):
                importlib.reload(entry)
    monkeypatch.setattr(builtins, "__import__", real)
    importlib.reload(entry)
