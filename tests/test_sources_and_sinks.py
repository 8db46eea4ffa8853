"""Folders of real PNG bytes, session files, sinks, and the commands."""

import json
import os

import numpy as np
import pytest
from lumisift import cli, sinks
from lumisift.functions import xmp
from lumisift.operators import review
from lumisift.plans import profiles
from lumisift.plans.cull import cull
from lumisift.shipping import ship
from lumisift.sources import demo, frames, sessions
from pyspark.sql import functions as F

ship(__name__)


@pytest.fixture(scope="module")
def shoot(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shoot"))
    demo.write_shoot(folder, scenes=5, variants=3, blurred=2)
    for name, data in {"broken.jpg": b"not an image", "notes.txt": b"text", "small file.PNG": demo.png(demo.scene(77, 300)), "colour+1.png": demo.png(np.stack([demo.scene(78)] * 3, axis=2))}.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    os.makedirs(f"{folder}/below")
    with open(f"{folder}/below/deep.png", "wb") as f:
        f.write(demo.png(demo.scene(79)))
    return folder


def scanned(spark, shoot):
    return frames.hashed(frames.scan_folder(spark, shoot)).withColumn("capture_time", F.lit(None).cast("timestamp_ntz"))


def test_scan(spark, shoot):
    got = {r.name: r for r in scanned(spark, shoot).collect()}
    assert len(got) == 5 * 3 + 2 + 3 and "notes.txt" not in got and "deep.png" not in got
    assert not got["broken.jpg"].decode_ok and got["broken.jpg"].h is None and got["broken.jpg"].score == 0
    assert (got["small file.PNG"].width, got["small file.PNG"].stem, got["small file.PNG"].ext) == (300, "small file", ".png")
    assert got["scene_000_0.png"].sharpness > got["scene_000_1.png"].sharpness > got["scene_000_2.png"].sharpness and got["soft_000.png"].sharpness < 60
    assert got["colour+1.png"].decode_ok and got["colour+1.png"].sharpness > 60
    with pytest.raises(NotADirectoryError):
        frames.scan_folder(spark, shoot + "/none")


def test_cull_of_a_folder(spark, shoot, tmp_path):
    done = cull(scanned(spark, shoot).persist(), top_n=4)
    names = [r.name for r in done.keepers.orderBy("rank").collect()]
    assert len(names) == 4 and all(n.endswith("_0.png") or n == "colour+1.png" for n in names)
    reasons = {r.name: r.reason for r in done.rejects.collect()}
    assert {n for n, r in reasons.items() if r == "duplicates"} >= {f"scene_{k:03d}_{v}.png" for k in range(5) for v in (1, 2)}
    assert reasons["broken.jpg"] == "unreadable" and reasons["small file.PNG"] == "too_small" and reasons["soft_000.png"] == "blurry"
    picks = done.keepers.select("name", "path", F.concat(F.lit("k_"), "rank", F.lit(".png")).alias("output_filename"), F.lit(5).alias("rating"))
    report = sinks.write_files(picks, f"file://{tmp_path}/out").collect()
    assert all(r.ok for r in report) and sorted(os.listdir(f"{tmp_path}/out")) == [f"k_{k}.png" for k in range(1, 5)]
    with open(f"{tmp_path}/out/k_1.png", "rb") as a, open(f"{shoot}/{names[0]}", "rb") as b:
        assert a.read() == b.read()
    with pytest.raises(FileExistsError):
        sinks.guard_output(spark, f"{tmp_path}/out")
    sinks.guard_output(spark, f"{tmp_path}/out", overwrite=True)
    sinks.guard_output(spark, f"{tmp_path}/new")
    assert sinks.summary({r.reason: r.n for r in done.reject_counts().collect()}, 4, 20).startswith("kept 4 of 20 (rejected: ")


def encode(data):
    return b"\xff\xd8\xff\xda\x00\x02" + data + b"\xff\xd9"


def test_transcoding_rates_jpeg_output_and_reports_failures(spark, tmp_path):
    with open(f"{tmp_path}/a.heic", "wb") as f:
        f.write(b"pixels")
    df = spark.createDataFrame([("a.heic", f"file://{tmp_path}/a.heic", "a.jpg", 4), ("b.heic", f"file://{tmp_path}/b.heic", "b.jpg", None)], "name string, path string, output_filename string, rating int")
    report = {r.name: r for r in sinks.write_files(df, f"file://{tmp_path}/out", {".heic": encode}).collect()}
    assert report["a.heic"].ok and not report["b.heic"].ok and report["b.heic"].error
    with open(f"{tmp_path}/out/a.jpg", "rb") as f:
        assert f.read() == xmp.with_rating(encode(b"pixels"), 4)


def test_thumbnails_and_previews(spark):
    df = spark.createDataFrame([("a", 1000, 501), ("b", 300, 900)], "name string, width int, height int")
    got = sorted(tuple(r) for r in sinks.thumbnail_plan(df, [500, 320, 1000, 500]).collect())
    assert got == [("a", 320, 160), ("a", 500, 250)]
    sizes = df.select("name", *sinks.fitted(F.col("width"), F.col("height"), 450, "w", "h"), sinks.preview_width(F.col("width"), 640).alias("p")).collect()
    assert [(r.w, r.h, r.p) for r in sizes] == [(450, 225, 640), (150, 450, 300)]


def test_session_files(spark, tmp_path):
    good = {"source_folder": "x", "prompt": "", "input_count": 2, "reject_summary": {"blurry": 1}, "history": [0], "candidates": [
        {"idx": 0, "path": "a", "filename": "a", "score": 0.5, "decision": "keep", "rejected_reason": "", "similar": [{"path": "b", "filename": "b", "score": 0.4}]}, None]}
    for name, body in {"one": json.dumps(good), "two": "[]", "three": "{broken", "deep/four": json.dumps(good | {"candidates": None})}.items():
        os.makedirs(f"{tmp_path}/{name}")
        with open(f"{tmp_path}/{name}/lumisift-session.json", "w") as f:
            f.write(body)
    every = sessions.read_sessions(spark, root=str(tmp_path))
    assert every.count() == 1
    both = sessions.read_sessions(spark, f"{tmp_path}/one", root=str(tmp_path))
    assert both.count() == 1
    os.makedirs(f"{tmp_path}/hidden")
    with open(f"{tmp_path}/hidden/.other-session.json", "w") as f:
        f.write(json.dumps(good))
    assert sessions.read_sessions(spark, root=str(tmp_path), file_name=".other-session.json").count() == 1
    assert sessions.read_sessions(spark, f"{tmp_path}/hidden", f"{tmp_path}/none", file_name=".other-session.json").count() == 1
    rows = sessions.candidates(both)
    assert [(r.path, r.pos, r.similar[0].path) for r in rows.collect()] == [("a", 0, "b")]
    assert review.override_stats(rows).first().picks == 1
    with pytest.raises(ValueError, match="folder"):
        sessions.read_sessions(spark)


def test_restore_swaps_the_pick_only_for_one_equal_group(spark):
    schema = "session string, idx int, path string, filename string, score double, decision string, similar array<struct<path string, filename string, score double>>"
    fresh = spark.createDataFrame([("s", 0, "a", "a", 0.9, "", [("b", "b", 0.8), ("c", "c", 0.7)]), ("s", 1, "d", "d", 0.5, "", []), ("s", 2, "e", "e", 0.4, "", [("f", "f", 0.3)]), ("s", 3, "g", "g", 0.2, "", [])], schema)
    saved = spark.createDataFrame([("s", 0, "c", "stale", 0.1, "reject", [("a", "x", 0.0), ("b", "x", 0.0)]), ("s", 1, "d", "d", 0.5, "maybe", []), ("s", 2, "e", "e", 0.4, "keep", []), ("s", 3, "g", "g", 0.2, "keep", []), ("s", 4, "g", "g", 0.2, "reject", [])], schema)
    got = {r.idx: r for r in review.restore(fresh, saved).collect()}
    assert (got[0].path, got[0].filename, got[0].score, got[0].decision) == ("c", "c", 0.7, "reject")
    assert [(s.path, s.score) for s in got[0].similar] == [("b", 0.8), ("a", 0.9)]
    assert [got[k].decision for k in (1, 2, 3)] == ["", "", ""]


def test_cache_table(spark, tmp_path):
    path = f"{tmp_path}/cache"
    assert sessions.read_cache(spark, path).count() == 0
    rows = spark.createDataFrame([("k", {"a": 0.5})], "key string, probs map<string,double>")
    sinks.write_table(rows, path)
    sinks.write_table(rows.withColumn("key", F.lit("l")), path)
    assert sorted(r.key for r in sessions.read_cache(spark, path).collect()) == ["k", "l"]
    df = spark.createDataFrame([("/a", 5)], "path string, size long").withColumn("t", F.timestamp_micros(F.lit(7)))
    assert df.select(sessions.cache_key(F.col("path"), F.col("t"), F.col("size"), F.array(F.lit("b"), F.lit("a"))).alias("k")).first().k == "/a::7::5::a|b"


def test_manifest_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a", '{"x":1}')], "category string, json string")
    sinks.write_manifest(rows, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").count() == 1
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        sinks.write_manifest(rows, f"{tmp_path}/m")


def test_commands(spark, shoot, tmp_path, capsys):
    assert cli.main(["profiles"]) == 0 and "default" in capsys.readouterr().out
    assert cli.main(["cull", shoot, "--top", "2", "--json", "--output", f"{tmp_path}/out"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert len(said["keepers"]) == 2 and sorted(os.listdir(f"{tmp_path}/out")) == sorted(said["keepers"])
    assert cli.main(["cull", shoot, "--top", "2", "--output", f"{tmp_path}/out"]) == 2
    assert cli.main(["cull", f"{tmp_path}/none"]) == 1
    os.makedirs(f"{tmp_path}/empty")
    assert cli.main(["cull", f"{tmp_path}/empty"]) == 1
    config = f"{tmp_path}/p.json"
    with open(config, "w") as f:
        json.dump({"name": "mine", "phases": {"one": "a label"}, "per_phase_cap": 3}, f)
    assert cli.main(["pick", shoot, "--config", config, "--json", "--rename-scheme", "category-rank", "--output", f"{tmp_path}/named"]) == 0
    assert sorted(os.listdir(f"{tmp_path}/named/one")) == ["one-01.png", "one-02.png", "one-03.png"]
    assert cli.main(["pick", shoot, "--profile", "nothing"]) == 1
    assert cli.main(["pick", shoot, "--weight", "x=1"]) == 1
    profiles._REGISTRY.pop("mine")


def decode(data):
    if data == b"bad":
        raise ValueError("bad")
    return np.frombuffer(data, dtype=np.uint8).reshape(20, 10)


def test_decoders_and_scaled_images(spark, tmp_path):
    for name, data in {"a.heic": bytes(range(200)), "b.HEIC": b"bad", "c.webp": b"x", "d.png": demo.png(demo.scene(1, 640)), "e.png": demo.png(np.stack([demo.scene(2, 64)] * 3, axis=2))}.items():
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
    got = {r.name: (r.decode_ok, r.width) for r in frames.scan_folder(spark, str(tmp_path), {".heic": decode}).collect()}
    assert got == {"a.heic": (True, 10), "b.HEIC": (False, None), "c.webp": (False, None), "d.png": (True, 640), "e.png": (True, 64)}
    names = spark.createDataFrame([("d.png",), ("e.png",), ("c.webp",)], "name string")
    small = {r.name: r.content for r in sinks.resized(spark, str(tmp_path), names, 100).collect()}
    assert small["c.webp"] is None
    thumbs = sinks.thumbnails(spark, str(tmp_path), names, [320, 32, 320]).collect()
    assert sorted((r.name, r.width) for r in thumbs) == [("d.png", 32), ("d.png", 320), ("e.png", 32)]
    os.makedirs(f"{tmp_path}/out")
    for k, content in enumerate([small["d.png"], small["e.png"], *(r.content for r in thumbs)]):
        with open(f"{tmp_path}/out/{k}.png", "wb") as f:
            f.write(content)
    back = {r.name: (r.decode_ok, r.width, r.height) for r in frames.scan_folder(spark, f"{tmp_path}/out").collect()}
    assert back["0.png"] == (True, 100, 100) and back["1.png"] == (True, 64, 64) and all(x[0] for x in back.values())


def test_session_save_and_counts(spark, tmp_path):
    from lumisift.streaming.progress import watched

    path = f"file://{tmp_path}/lumisift-session.json"
    sinks.save_session(path, {"source_folder": "f", "candidates": [{"idx": 0, "path": "a", "decision": "keep"}], "history": []})
    sinks.save_session(path, {"source_folder": "g", "candidates": [], "history": []})
    assert os.listdir(tmp_path) == ["lumisift-session.json"] and sessions.read_sessions(spark, str(tmp_path)).first().source_folder == "g"
    report = spark.createDataFrame([("a", "x", True, None), ("b", None, False, "e")], "name string, output_path string, ok boolean, error string")
    assert tuple(sinks.tally(report).first()) == (1, 1)
    rows, seen = watched(report, "report")
    assert rows.count() == 2 and seen.get["rows"] == 2


@pytest.fixture(scope="module")
def jpegs(tmp_path_factory):
    """Files that only a codec of ours can read: grey rasters of 900x900 behind a JPEG head with a date."""
    from tests.test_operators import jpeg, tiff

    folder = str(tmp_path_factory.mktemp("jpegs"))
    demo.write_shoot(folder, scenes=4, variants=2, blurred=1)
    with open(f"{folder}/dated.jpg", "wb") as f:
        f.write(jpeg(b"Exif\0\0" + tiff([(0x0132, "2024:01:02 03:04:05")])))
    return folder


def test_capture_times_reach_a_scan(spark, jpegs):
    rows = frames.with_capture_time(frames.hashed(frames.scan_folder(spark, jpegs)), spark, jpegs).collect()
    assert {str(r.capture_time) for r in rows if r.name == "dated.jpg"} == {"2024-01-02 03:04:05"}
    assert {r.capture_time for r in rows if r.name != "dated.jpg"} == {None} and len(rows) == 4 * 2 + 1 + 1


class Judge:
    def score_photo(self, content, media_type, prompt):
        return json.dumps({"score": len(content) % 90, "reason": prompt})


class Labels:
    calls = 0

    def score(self, key, labels):
        return {x: (1.0 if x == labels[len(key) % 2] else 0.0) for x in labels}


def test_cull_options(spark, jpegs, tmp_path, capsys):
    manifest = f"{tmp_path}/m/manifest.json"
    assert cli.main(["cull", jpegs, "--top", "3", "--json", "--manifest", manifest, "--session", "--include-rejects", "--prompt", "why", "--client", "tests.test_sources_and_sinks:Judge", "--ai-workers", "2"]) == 0
    said = json.loads(capsys.readouterr().out)
    with open(manifest) as f:
        wrote = json.load(f)
    assert [p["filename"] for p in wrote["picks"]] == said["keepers"] and wrote["input_count"] == 10 and wrote["reject_counts"]["unreadable"] == 1
    assert all(p["ai_reason"] == "why" and p["ai_score"] == said["ai_scores"][p["filename"]]["score"] for p in wrote["picks"])
    assert [p["ai_score"] for p in wrote["picks"]] == sorted((p["ai_score"] for p in wrote["picks"]), reverse=True)
    held = json.load(open(f"{jpegs}/lumisift-session.json"))
    assert [c["filename"] for c in held["candidates"][:3]] == said["keepers"] and held["counts"]["undecided"] == len(held["candidates"]) > 3
    assert any(c["similar"] for c in held["candidates"]) and all(os.path.exists(c["path"].removeprefix("file:").replace("//", "/")) for c in held["candidates"])
    assert sessions.read_sessions(spark, jpegs).count() == 1
    # resume, decide, undo, swap, export
    assert cli.main(["cull", jpegs, "--resume", "--json"]) == 0 and json.loads(capsys.readouterr().out)["prompt"] == "why"
    for action, args, keep, reject in (("keep", ["0"], 1, 0), ("reject", ["1"], 1, 1), ("keep", ["1"], 2, 0), ("undo", [], 1, 0), ("swap", [str(next(c["idx"] for c in held["candidates"] if c["similar"])), "0"], 1, 0)):
        assert cli.main(["review", jpegs, action, *args]) == 0
        counts = json.loads(capsys.readouterr().out)
        assert (counts["keep"], counts["reject"]) == (keep, reject), action
    assert cli.main(["review", jpegs, "keep", "99"]) == 1 and cli.main(["review", jpegs, "reject", "2"]) == 0
    capsys.readouterr()
    assert cli.main(["review", jpegs, "export", f"{tmp_path}/export"]) == 0
    names = [p["filename"] for p in json.load(open(f"{tmp_path}/export/export-manifest.json"))["picks"]]
    assert set(names) == set(os.listdir(f"{tmp_path}/export")) - {"export-manifest.json"} and len(names) == len(held["candidates"]) - 1
    assert cli.main(["review", jpegs, "stats"]) == 0 and "override" in capsys.readouterr().out
    assert cli.main(["overrides", "--root", jpegs]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["sessions"] == 1
    assert cli.main(["review", jpegs, "reset"]) == 0 and json.loads(capsys.readouterr().out)["keep"] == 0
    with open(f"{jpegs}/lumisift-session.json", "w") as f:
        f.write("{broken")
    assert cli.main(["review", jpegs, "undo"]) == 1
    assert cli.main(["cull", jpegs, "--resume", "--top", "1", "--no-ai", "--prompt", "x"]) == 0 and "kept 1 of 10" in capsys.readouterr().out
    os.remove(f"{jpegs}/lumisift-session.json")
    assert cli.main(["cull", jpegs, "--prompt", "x"]) == 1 and cli.main(["cull", jpegs, "--top", "0"]) == 1 and cli.main(["cull", jpegs, "--sort", "colour"]) == 1


def closed(path):
    eye = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (2.0, 0.1), (1.0, 0.1)]
    return [[eye, eye]] if "scene_000" in path else []


def test_faces_and_ratings_of_a_cull(spark, tmp_path, capsys, jpegs):
    assert cli.main(["cull", jpegs, "--top", "4", "--json", "--xmp", "--faces", "tests.test_sources_and_sinks:closed", "--output", f"{tmp_path}/out"]) == 0
    faced = json.loads(capsys.readouterr().out)
    assert cli.main(["cull", jpegs, "--top", "4", "--json"]) == 0
    plain = json.loads(capsys.readouterr().out)
    assert faced["scores"]["scene_000_0.png"] == pytest.approx(0.4 * plain["scores"]["scene_000_0.png"], abs=1e-3)
    assert sorted(os.listdir(f"{tmp_path}/out")) == sorted(faced["keepers"])


def test_pick_options(spark, jpegs, tmp_path, capsys):
    pick = ["pick", jpegs, "--json"]
    assert cli.main([*pick, "--profile", "duo", "--benchmark", "--classifier", "tests.test_sources_and_sinks:Labels", "--cache", f"{tmp_path}/cache"]) == 0
    one = json.loads(capsys.readouterr().out)
    assert set(one["benchmark"]) == {x[2] for x in one["selection"]} and all(set(b["contributions"]) == set(profiles.DUO_RULES.names) for b in one["benchmark"].values())
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 10
    assert cli.main([*pick, "--profile", "duo", "--benchmark", "--classifier", "tests.test_sources_and_sinks:Labels", "--cache", f"{tmp_path}/cache"]) == 0
    assert json.loads(capsys.readouterr().out) == one and spark.read.parquet(f"{tmp_path}/cache").count() == 10
    out, manifest = f"{tmp_path}/out", f"{tmp_path}/m.json"
    assert cli.main([*pick, "--dry-run", "--output", out, "--manifest", manifest]) == 0 and not os.path.exists(out) and not os.path.exists(manifest)
    capsys.readouterr()
    assert cli.main([*pick, "--output", out, "--manifest", manifest, "--thumbnails", "200,100,2000", "--webp", "--rename-scheme", "sequential", "--no-convert-heic"]) == 0
    wrote = json.load(open(manifest))
    assert all(p["output_filename"] in os.listdir(f"{out}/{p['category']}") and p["rank"] == k + 1 for k, p in enumerate(wrote["picks"]))
    with_thumbs = [p for p in wrote["picks"] if p["dimensions"]]
    assert with_thumbs and all(set(p["thumbnails"]) == {"100", "200"} and set(p["thumbnails"].values()) <= set(os.listdir(f"{out}/featured")) for p in with_thumbs)
    assert cli.main([*pick, "--thumbnails", "10,x"]) == 1 and cli.main([*pick, "--jpg-quality", "0"]) == 1
    assert cli.main([*pick, "--profile", "duo", "--weight", "none=1"]) == 1 and cli.main([*pick, "--profile", "duo", "--weight", "glow"]) == 1


def test_weights_act(spark, jpegs, capsys):
    """A weight of 0 switches a rule off; totals and contributions follow."""
    found = {}
    for weights in ([], ["--weight", "glow=0"], ["--weight", "glow=2", "--weight", "calm=0"]):
        assert cli.main(["pick", jpegs, "--json", "--profile", "duo", "--benchmark", *weights]) == 0
        said = json.loads(capsys.readouterr().out)["benchmark"]
        name = max(said, key=lambda n: said[n]["quality"])
        found[len(weights)] = said[name]["contributions"], said[name]["quality"]
    (plain, quality), (off, _), (more, _) = found[0], found[2], found[4]
    assert off["glow"] == 0 and off["framing"] == pytest.approx(plain["framing"]) and plain["glow"] > 0 and more["calm"] == 0
    assert more["glow"] == pytest.approx(4 * plain["glow"]) and plain["glow"] == pytest.approx(quality * 0.5 / 6)


def test_a_change_that_can_not_be_saved_is_taken_back(monkeypatch):
    from lumisift.plans import desk

    held = desk.counted({"candidates": [{"idx": 0, "path": "a", "filename": "a", "score": 1.0, "decision": "", "rejected_reason": "", "similar": []}], "history": []})

    def fail(*_):
        raise PermissionError("no")

    monkeypatch.setattr(sinks, "save_session", fail)
    with pytest.raises(desk.SaveError):
        desk.changed(held, "file:///x", "keep", 0)
    assert held["counts"]["keep"] == 0 and held["history"] == []


def test_codecs_register_where_the_library_is(monkeypatch):
    from lumisift.functions import codecs

    monkeypatch.setattr(codecs, "has", lambda module: module in present)
    for present, known, encoded in (((), set(), set()), (("PIL",), {".webp"}, set()), (("PIL", "pillow_heif"), {".webp", ".heic"}, {".heic", ".heif"})):
        assert set(codecs.decoders()) == known and set(codecs.jpeg_encoders()) == encoded and (codecs.webp_encoder() is None) == (not present)
