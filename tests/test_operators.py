"""Operators against sequential versions, hand-made examples and the traps of their semantics."""

import random

import numpy as np
import pytest
from lumisift.functions import exif, raster, text, xmp
from lumisift.operators import classify, gate, neardup, rank, rerank, review, rules, selection, twins
from lumisift.plans import profiles
from lumisift.plans.cull import cull
from lumisift.shipping import ship
from pyspark.sql import functions as F

ship(__name__)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def scan(rows, threshold):
    """The sequential scan: rows (name, h) in order -> {name: winner or None}."""
    kept, out = [], {}
    for name, h in rows:
        if h is None:
            out[name] = None
            continue
        winner = next((n for n, k in kept if ((h ^ k) & (2**64 - 1)).bit_count() <= threshold), None)
        out[name] = winner
        if winner is None:
            kept.append((name, h))
    return out


@pytest.mark.parametrize("threshold", [0, 1, 6, 16, 63, 64])
def test_leaders_equal_the_sequential_scan(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for k in range(150):
        h = rng.choice(base)
        for _ in range(rng.randrange(0, threshold + 3)):
            h ^= 1 << rng.randrange(64)
        rows.append((f"f{k:03d}", None if k % 31 == 0 else signed(h if k % 7 else 0), rng.choice([0.1, 0.5, 0.5, 0.9])))
    df = spark.createDataFrame(rows, "name string, h long, score double").repartition(5)
    got = {r.name: r.winner for r in neardup.leaders(df, [-F.col("score")], threshold).collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert got == scan([r[:2] for r in order], threshold)


def test_chain_keeps_both_ends_and_losers_go_to_the_earliest(spark):
    rows = [("a", 0b0), ("b", 0b111111), ("c", 0b111111111111), ("d", 0b111)]
    df = spark.createDataFrame(rows, "name string, h long")
    got = {r.name: (r.kept, r.winner) for r in neardup.leaders(df, []).collect()}
    assert got == {"a": (True, None), "b": (False, "a"), "c": (True, None), "d": (False, "a")}
    lost = neardup.clusters(neardup.leaders(df, []), df, []).collect()
    assert [(r.winner, r.ord, r.loser) for r in sorted(lost, key=lambda r: r.ord)] == [("a", 1, "b"), ("a", 2, "d")]


@pytest.mark.parametrize(("threshold", "rows"), [(0, 10**6), (3, 10**6), (6, 10**9), (12, 10**4)])
def test_bands_miss_no_pair(spark, threshold, rows):
    rng = random.Random(rows)
    base = [rng.getrandbits(64) for _ in range(30)]
    hashes = set(base)
    for h in base:
        for _ in range(6):
            x = h
            for b in rng.sample(range(64), rng.randrange(1, threshold + 2)):
                x ^= 1 << b
            hashes.add(x)
    signed_hashes = sorted(signed(h) for h in hashes)
    df = spark.createDataFrame([(h,) for h in signed_hashes], "h long")
    got = sorted((r.a, r.b) for r in neardup.similar_pairs(df, threshold, rows).collect())  # each pair once
    want = {(a, b) for k, a in enumerate(signed_hashes) for b in signed_hashes[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= threshold}
    assert got == sorted(want)


def test_band_plan_grows_with_the_rows():
    plans = [neardup.plan_bands(n, 6) for n in (10, 10**4, 10**7, 10**10)]
    assert plans[0] is None and plans[-1][1] > plans[1][1]


def test_hundreds_of_band_keys_are_no_expressions(spark):
    """Nearly every pair meets under some choice of 19 bands at 16 bits, so no number of hashes makes that cheaper; and where choices are many, the plan stays small."""
    assert [neardup.plan_bands(n, 16) for n in (10**5, 266_667, 800_000, 10**7)] == [None] * 4
    rng = random.Random(16)
    base = [rng.getrandbits(64) for _ in range(8)]
    hashes = sorted({signed(h ^ sum(1 << b for b in rng.sample(range(64), k))) for h in base for k in (0, 1, 15, 16, 17)} | {0, -1, 2**63 - 1, -(2**63)})
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    found = neardup.similar_pairs(df, 16, plan=(19, 3))
    want = {(a, b) for k, a in enumerate(hashes) for b in hashes[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 16}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert len(found._jdf.queryExecution().analyzed().toString()) < 60_000  # not an expression for each of 969 choices, which the driver plans and compiles


def test_wide_thresholds_of_many_hashes(spark):
    """50,000 hashes within 24 bits, where no bands are selective: as many pairs as all comparisons give, and the same."""
    assert neardup.plan_bands(50_000, 24) is None
    hashes = np.unique(np.random.default_rng(8).integers(-(2**63), 2**63, 50_000))
    n = total = 0
    for k in range(len(hashes)):
        near = hashes[k + 1 :][np.bitwise_count((hashes[k] ^ hashes[k + 1 :]).view(np.uint64)) <= 24]
        n += len(near)
        total += int((near % 1000003).sum()) + len(near) * int(hashes[k] % 1000003)
    df = spark.createDataFrame([(int(h),) for h in hashes], "h long")
    got = neardup.similar_pairs(df, 24).agg(F.count("*"), F.sum(F.pmod("a", F.lit(1000003)) + F.pmod("b", F.lit(1000003)))).first()
    assert tuple(got) == (n, total) and n > 10**7


def test_twins(spark):
    names = ["20240101_120000001_a.heic", "20240101_120000002_b.jpg", "20240101_120000003_c.JPG", "x.heic", "y.HEIC", "y.heif", "sunset_over_the_sea_1.jpg", "sunset_over_the_sea_2.jpg", "sunset_over_the_sea_3.png", "z.webp"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    kept = sorted(r.name for r in twins.collapse_twins(df).collect())
    assert kept == ["20240101_120000002_b.jpg", "sunset_over_the_sea_1.jpg", "sunset_over_the_sea_3.png", "x.heic", "y.HEIC", "z.webp"]
    lost = {r.name: r.winner for r in twins.twin_losers(df).collect()}
    assert set(lost) == set(names) - set(kept) and lost["y.heif"] == "y.HEIC"


FRAMES = "name string, score double, h long, width int, height int, decode_ok boolean, sharpness double, exposure double, capture_time long"


def frame(name, score, h, sharp=100.0, side=900, ok=True, at=None):
    return (name, score, h if ok else None, side, side, ok, sharp, 0.5, at)


def test_cull_traps(spark):
    far = [0, 0xFFFF, 0xFFFF0000, 0xFFFF00000000, 0x7FFF << 48]
    rows = [
        frame("a.png", 0.9, far[0], sharp=1.0), frame("a2.png", 0.8, far[0] ^ 1),  # a leader fails the gate: its cluster goes with it
        frame("B.png", 0.7, far[1], at=5), frame("b2.png", 0.7, far[1] ^ 3, at=1),  # a tie in score: the first name leads
        frame("c.png", 0.6, far[2], at=None), frame("d.png", 0.5, far[3], at=2), frame("e.png", 0.4, far[4], side=300), frame("u.png", 0.0, None, ok=False),
        frame("p_long_name_0001.heic", 0.95, 7 << 50), frame("p_long_name_000.jpg", 0.3, 0x00FF00FF00FF00FF),
    ]
    df = spark.createDataFrame(rows, FRAMES)
    done = cull(df, top_n=3)
    assert [r.name for r in done.keepers.orderBy("rank").collect()] == ["B.png", "c.png", "d.png"]
    assert {(r.name, r.reason) for r in done.rejects.collect()} == {("a.png", "blurry"), ("a2.png", "duplicates"), ("b2.png", "duplicates"), ("e.png", "too_small"), ("u.png", "unreadable"), ("p_long_name_0001.heic", "duplicates")}
    assert {r.reason: r.n for r in done.reject_counts().collect()} == {"blurry": 1, "duplicates": 3, "too_small": 1, "unreadable": 1}
    assert {(r.winner, r.loser) for r in done.clusters.collect()} == {("a.png", "a2.png"), ("B.png", "b2.png")}
    assert done.scored.count() == 9 and done.input_count().first()[0] == 10  # p_long_name_000.jpg is usable, but beyond the top: in neither
    assert [r.name for r in cull(df, top_n=3, sort="capture-time").keepers.orderBy("rank").collect()] == ["d.png", "B.png", "c.png"]
    assert [r.name for r in cull(df, top_n=3, sort="name").keepers.orderBy("rank").collect()] == ["B.png", "c.png", "d.png"]
    with pytest.raises(ValueError, match="not one of"):
        cull(df, sort="size")
    session = review.build_session(done.keepers, done.clusters, done.scored, done.rejects).collect()
    by = {r.path: r for r in session}
    assert [s.path for s in by["B.png"].similar] == ["b2.png"] and "u.png" not in by and by["e.png"].rejected_reason == "too_small"


def test_gate_is_ordered(spark):
    rows = [frame("a", 1.0, 1, sharp=60.0, side=800), frame("b", 1.0, 1, sharp=59.96), frame("c", 1.0, 1, sharp=1.0, side=799), frame("d", 1.0, 1, ok=False, side=10)]
    got = {r.name: r.gate for r in gate.with_gate(spark.createDataFrame(rows, FRAMES)).collect()}
    assert [got[k].code for k in "abcd"] == ["", "blurry", "too_small", "unreadable"]
    assert got["b"].reason == "blurry (sharpness 60.0 < 60.0)" and got["c"].reason == "too small (799px < 800)"
    assert got["c"].sharpness == 0.0 and got["d"].long_edge == 0


def evaluated(spark, column, schema="x int", row=(0,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_rules(spark):
    stack = rules.Rules((rules.Rule("warm", "w", 0.5), rules.Rule("green", "g", 0.4), rules.Rule("none", "n", 0.3)), 0.75)
    probs = F.create_map(F.lit("w"), F.lit(0.5), F.lit("g"), F.lit(0.5))
    assert evaluated(spark, stack.contributions(F.lit(10.0), probs)) == {"warm": 2.5, "green": 2.0, "none": 0.0}
    full = rules.Rules(stack.rules, 0.3)
    points = evaluated(spark, full.breakdown(F.lit(10.0), probs))
    assert points.total == pytest.approx(13.0) and sum(points.contributions.values()) == pytest.approx(3.0)
    assert evaluated(spark, stack.reweighted({"warm": 0.0}).breakdown(F.lit(10.0), probs)).total == pytest.approx(12.0)
    with pytest.raises(ValueError, match="no such rules: blue"):
        stack.reweighted({"blue": 1.0})
    assert rules.parse_weights(["a=1", "b = 0.5", "a=2"]) == {"a": 2.0, "b": 0.5}
    for bad in ("a", "=1", "a=-1", "a=x", "a=inf", "a=nan"):
        with pytest.raises(ValueError, match="NAME=VALUE"):
            rules.parse_weights([bad])
    tie = F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.lit(0.5))
    assert evaluated(spark, rules.best_label(tie, ("a", "b"))) == "a"
    assert evaluated(spark, rules.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]
    assert evaluated(spark, rules.canned({"x.jpg": {"a": 0.9}}, ("a", "b"), F.lit("x.jpg"))) == {"a": 0.9, "b": 0.0}
    weights = [sum(r.weight for r in p.rules) for p in (profiles.STORY_RULES, profiles.DUO_RULES)]
    assert weights == pytest.approx([0.97, 1.05])


def test_staged_profile_falls_back_to_any_frame(spark):
    labels = profiles.get("story").labels
    probs = lambda b, d, a: {labels[0]: b, labels[1]: d, labels[2]: a}
    rows = [("f1", 0.5, probs(0.8, 0.1, 0.1)), ("f2", 0.6, probs(0.7, 0.2, 0.1)), ("f3", 0.9, probs(0.6, 0.3, 0.1)), ("f4", 0.1, probs(0.1, 0.1, 0.8))]
    df = spark.createDataFrame(rows, "name string, score double, probs map<string,double>")
    got = {r.category: r.name for r in profiles.get("story").select(df).picked.where("category <> 'others'").collect()}
    assert got == {"before": "f1", "during": "f3", "after": "f4"}
    uniform = df.withColumn("probs", rules.uniform(labels))
    assert {r.category for r in profiles.get("duo").select(df.withColumn("probs", rules.uniform(profiles.get("duo").labels))).picked.collect()} == {"people"}
    picks = profiles.get("story").select(uniform).picked.collect()
    assert len({r.name for r in picks}) == 4


def test_profile_configs():
    with pytest.raises(KeyError, match="known"):
        profiles.get("nothing")
    assert profiles.names() == sorted(profiles.names()) and "default" in profiles.names()
    good = {"phases": {"a": "x"}, "rules": [{"name": "r", "label": "l", "weight": 1}]}
    assert profiles.from_config(good).labels == ("x", "l")
    for change in ({"phases": {}}, {"phases": None}, {"rules": [{"name": "r", "label": "l", "weight": True}]}, {"rules": [{"name": "r", "label": "l", "weight": -1}]}, {"rules": [{"name": "", "label": "l", "weight": 1}]}, {"rules": good["rules"] * 2}, {"max_bonus": -1}, {"max_bonus": True}, {"rules": "x"}):
        with pytest.raises(profiles.ConfigError):
            profiles.from_config(good | change)


def test_names_stars_and_shares(spark):
    for n, want in ((30, {1: 5, 6: 5, 7: 4, 30: 1}), (7, {1: 5, 2: 5, 3: 4, 4: 3, 5: 3, 6: 2, 7: 1}), (1, {1: 5})):
        for r, stars in want.items():
            assert evaluated(spark, xmp.star_rating(F.lit(r), F.lit(n))) == stars
    name = lambda s, n, rank_=3, total=120: evaluated(spark, selection.output_name(F.lit(n), F.lit("after"), F.lit(rank_), F.lit(1234), F.lit(total), s))
    assert (name("original", "a.b.HEIC"), name("original", "x.JPG")) == ("a.b.jpg", "x.JPG")
    assert (name("sequential", "x.JPG"), name("category-rank", "x.heif", 7)) == ("1234.jpg", "after-007.jpg")
    with pytest.raises(ValueError, match="rename scheme"):
        name("random", "x")
    assert evaluated(spark, selection.share(F.lit(1), F.lit(0))) == "-" and evaluated(spark, selection.share(F.lit(1), F.lit(8))) == "12.5%"
    assert [evaluated(spark, text.stem(F.lit(n))) for n in ("a.b.jpg", ".jpg", "none")] == ["a.b", ".jpg", "none"]
    assert [evaluated(spark, text.suffix(F.lit(n))) for n in ("a.b.JPG", ".jpg", "none")] == [".jpg", "", ""]


def test_percentiles_round_half_up(spark):
    df = spark.createDataFrame([(f"f{k}", s) for k, s in enumerate([0.9, 0.8, 0.8, 0.1, 0.05, 0.04, 0.03, 0.02])], "name string, score double")
    got = {r.name: r.percentile for r in rank.percentiles(df).collect()}
    assert [got[f"f{k}"] for k in range(4)] == [13, 25, 25, 50]


def test_replies(spark):
    cases = {
        '{"score": 85, "reason": " ok "}': (85, "ok"), 'Sure: {"score": "42"} done': (42, ""), '{"score": 250}': (100, ""), '{"score": -50}': (0, ""), '{"score": "abc", "reason": "x"}': (0, "x"),
        '{"score": "85.7"}': (0, ""), '{"score": 85.7}': (85, ""), '{"score": true}': (1, ""), '{"score": null}': (0, ""), "no json": (0, "no json"), "": (0, ""), "{broken": (0, "{broken"), '{"a": {"score": 3}}': (3, ""),
        '{"score": " 7 "}': (7, ""), "  " + "x" * 200: (0, "x" * 120), '{"score": [1]}': (0, ""),
    }
    df = spark.createDataFrame([(k, s) for k, s in enumerate([*cases, None])], "id int, said string").withColumn("r", text.reply(F.col("said")))
    got = [(r.r.score, r.r.reason) for r in df.orderBy("id").collect()]
    assert got == [*cases.values(), (0, "")]


class Client:
    def score_photo(self, content, media_type, prompt):
        if content == b"slow":
            raise TimeoutError("slow")
        if content == b"bad":
            raise ValueError("refused")
        return '{"score": %d, "reason": "seen"}' % len(content)


def test_rerank_keeps_order_of_ties_and_survives_errors(spark):
    rows = [("a", 1, bytearray(b"xx")), ("b", 2, bytearray(b"xxxx")), ("c", 3, bytearray(b"yy")), ("d", 4, None), ("e", 5, bytearray(b"slow")), ("f", 6, bytearray(b"bad"))]
    df = spark.createDataFrame(rows, "name string, rank int, content binary")
    got = rerank.rerank(df, Client(), "which?", attempts=2, sleep=_no_sleep).orderBy("ai_rank").collect()
    assert [(r.name, r.ai_score) for r in got] == [("b", 4), ("a", 2), ("c", 2), ("e", 0), ("f", 0)]
    assert "gave up after 2 attempts" in got[3].ai_reason and "refused" in got[4].ai_reason
    assert [r.name for r in rerank.rerank(df, Client(), "which?", 2, attempts=1, sleep=_no_sleep).orderBy("ai_rank").collect()] == ["b", "a"]


def _no_sleep(_):
    pass


def test_retries():
    class Refused(Exception):
        status_code = 400

    class Busy(Exception):
        status_code = 429

    assert rerank.retryable(Busy()) and rerank.retryable(ConnectionError()) and not rerank.retryable(Refused()) and not rerank.retryable(KeyboardInterrupt())
    slept, calls = [], iter([Busy(), Busy(), None])

    def call():
        if error := next(calls):
            raise error
        return "done"

    assert rerank.with_retries(call, 3, slept.append, random.Random(1)) == "done" and len(slept) == 2
    assert 0.75 <= slept[0] <= 1.25 and 1.5 <= slept[1] <= 2.5
    assert rerank.delay(50, random.Random(1)) <= 30 * 1.25
    class Late(Exception):
        status_code = 408

    assert not rerank.retryable(Late())


def test_retry_attempts_and_hook(monkeypatch):
    told, tries = [], []

    def call():
        tries.append(1)
        raise TimeoutError("late")

    def hook(attempt, error, wait):
        told.append((attempt, type(error).__name__, wait))
        raise RuntimeError("a hook's own fault ends nothing")

    with pytest.raises(rerank.RetryError) as caught:
        rerank.with_retries(call, sleep=_no_sleep, on_retry=hook)
    assert caught.value.attempts == len(tries) == 3 and [x[:2] for x in told] == [(1, "TimeoutError"), (2, "TimeoutError")]
    for said, n in (("5", 5), ("0", 1), ("-3", 1), ("many", 3), ("", 3)):
        monkeypatch.setenv(rerank.ATTEMPTS_SETTING, said)
        assert rerank.attempts_of(None) == n
        assert rerank.attempts_of(2) == 2 and rerank.attempts_of(0) == 1
    with pytest.raises(rerank.RetryError) as caught:
        rerank.with_retries(lambda: {}["none"])
    assert caught.value.attempts == 1 and isinstance(caught.value.last, KeyError)


CANDIDATES = "session string, idx int, path string, filename string, score double, decision string, rejected_reason string"


def test_override_counts_undecided_as_kept(spark):
    rows = [("s", k, f"p{k}", f"p{k}", 0.5, d, "") for k, d in enumerate(["keep", "keep", "reject", ""])]
    rows += [("t", 0, "q", "q", 0.5, "", ""), ("u", 0, "z", "z", 0.5, "keep", "blurry"), ("s", 9, "r", "r", 0.5, "keep", "blurry")]
    df = spark.createDataFrame(rows, CANDIDATES)
    stats = {r.session: r for r in review.override_stats(df).collect()}
    assert set(stats) == {"s", "t"}
    assert (stats["s"].rate, stats["s"].kept, stats["s"].rescued) == (0.25, 3, 1)
    assert stats["s"].line == "kept 3/4 picks — 25% override · rescued 1 pipeline reject"
    whole = review.override_aggregate(review.override_stats(df)).first()
    assert (whole.sessions, whole.undecided_sessions, whole.picks, whole.rate) == (1, 1, 4, 0.25)
    assert review.override_aggregate(review.override_stats(df.where("session = 't'"))).first().rate is None
    counts = {r.session: (r.total, r.keep, r.reject, r.undecided) for r in review.counts(df).collect()}
    assert counts["s"] == (5, 3, 1, 1)
    chips = {r.session: r.keep for r in review.chip_counts(df).collect()}
    assert chips["s"] == 2 and review.view(df, "keep").where("session = 's'").count() == 3
    with pytest.raises(ValueError, match="view"):
        review.view(df, "best")
    assert review.exported(df).where("session = 's'").count() == 4


def test_undo_clears_and_does_not_revert(spark):
    actions = [("keep", 1), ("reject", 1), ("undo", None), ("undo", None), ("undo", None), ("clear", 2), ("keep", 3)]
    df = spark.createDataFrame([("s", k, a, i) for k, (a, i) in enumerate(actions)], "session string, at long, action string, idx int")
    upto = lambda n: review.fold_decisions(df.where(F.col("at") < n)).first()
    assert upto(2).decisions == {1: "reject"} and upto(3).decisions == {1: ""} and upto(3).history == [1]
    assert upto(5).history == [] and upto(7).decisions == {1: "", 2: "", 3: "keep"} and upto(7).history == [2, 3]
    more = df.unionByName(spark.createDataFrame([("s", 9, "reset", None)], df.schema))
    assert review.fold_decisions(more).first().history == []


def test_classifier_batches_and_cache(spark):
    class Batched:
        def score_batch(self, keys, labels):
            assert len(keys) <= 3
            return [{labels[0]: float(k[1:])} for k in keys]

    df = spark.createDataFrame([(f"n{k}", f"k{k}") for k in range(10)], "name string, cache_key string")
    got = {r.name: r.probs for r in classify.classify(df, Batched(), ("a", "b"), batch=3).collect()}
    assert got["n7"] == {"a": 7.0, "b": 0.0}
    cached = spark.createDataFrame([("k1", {"a": 0.1, "b": 0.2}), ("k2", {"a": 0.3})], "key string, probs map<string,double>")
    rows, new = classify.classify_cached(df, Batched(), ("a", "b"), cached, batch=3)
    assert {r.name: r.probs["a"] for r in rows.collect()}["n1"] == 0.1 and {r.key for r in new.collect()} == {f"k{k}" for k in range(10)} - {"k1"}
    assert classify.Stub({"x.jpg": {"a": 1.0}}).score("/d/x.jpg", ["a", "b"]) == {"a": 1.0, "b": 0.0}


def test_faces(spark):
    def provider(name):
        eye = lambda open_: [[0.0, 0.0], [1.0, open_], [2.0, open_], [3.0, 0.0], [2.0, -open_], [1.0, -open_]]
        return {"open": [[eye(1.0), eye(1.0)]], "shut": [[eye(1.0), eye(0.1)], [eye(1.0), eye(1.0)]]}.get(name, [])

    df = spark.createDataFrame([("open",), ("shut",), ("none",)], "name string")
    got = {r.name: r for r in classify.faces(df, provider).collect()}
    assert [(got[k].n, got[k].closed, got[k].multiplier) for k in ("open", "shut", "none")] == [(1, False, 1.0), (2, True, 0.4), (0, False, 1.0)]
    assert got["none"].least_ratio is None


def tiff(entries, sub=None):
    """Little-endian TIFF bytes with text tags, and an Exif block."""
    import struct

    def block(tags, at):
        body, tail, start = struct.pack("<H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
        for tag, value in tags:
            if isinstance(value, int):
                body += struct.pack("<HHII", tag, 4, 1, value)
            else:
                raw = value.encode() + b"\0"
                body += struct.pack("<HHII", tag, 2, len(raw), start + len(tail))
                tail += raw
        return body + b"\0\0\0\0" + tail

    top = list(entries)
    if sub is not None:
        size = len(block([*top, (0x8769, 0)], 8))
        top.append((0x8769, 8 + size))
    data = b"II*\0" + struct.pack("<I", 8) + block(top, 8)
    return data + (block(sub, len(data)) if sub is not None else b"")


def jpeg(*app1):
    out = b"\xff\xd8\xff\xe0\x00\x04JF"
    for body in app1:
        out += b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body
    return out + b"\xff\xda\x00\x02scan\xff\xd9"


def test_capture_times_from_bytes(spark):
    cases = [
        jpeg(b"Exif\0\0" + tiff([(0x0132, "2024:01:02 03:04:05")])),
        jpeg(b"Exif\0\0" + tiff([(0x0132, "2024:01:02 03:04:05")], [(0x9003, "2023-05-06 07:08:09")])),
        jpeg(b"Exif\0\0" + tiff([(0x9003, "junk"), (0x0132, "2021:1:2 3:4:5")], [(0x9003, "0000:00:00 00:00:00")])),
        jpeg(), b"not an image", None, jpeg(b"Exif\0\0II*\0\xff\xff\xff\x00"),
    ]
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(cases)], "id int, content binary")
    got = [r.t for r in df.orderBy("id").select(text.iso(exif.taken_at(F.col("content"))).alias("t")).collect()]
    assert got == ["2024-01-02T03:04:05", "2023-05-06T07:08:09", "2021-01-02T03:04:05", None, None, None, None]


def test_xmp_ratings(spark):
    data = jpeg(b"Exif\0\0II*\0", xmp.HEADER + b"old packet")
    out = xmp.with_rating(data, 4)
    bodies = [body for marker, body in xmp.segments(out) if marker == 0xE1]
    assert len(bodies) == 2 and bodies[0].startswith(b"Exif") and b'xmp:Rating="4"' in bodies[1] and out.endswith(b"scan\xff\xd9")
    assert xmp.with_rating(out, 4) == out
    for bad in (-1, 6):
        with pytest.raises(ValueError, match="0..5"):
            xmp.packet(bad)
    with pytest.raises(ValueError, match="not JPEG"):
        xmp.with_rating(b"PNG", 3)
    df = spark.createDataFrame([(1, bytearray(data), 3), (2, bytearray(b"x"), 3), (3, None, 3), (4, bytearray(data), 9)], "id int, content binary, stars int")
    got = [r.v for r in df.orderBy("id").select(xmp.embed(F.col("content"), F.col("stars")).alias("v")).collect()]
    assert bytes(got[0]) == xmp.with_rating(data, 3) and got[1:] == [None, None, None]


def test_raster_kernels():
    checker = np.where(np.indices((64, 64)).sum(axis=0) % 2 == 0, 0, 255).astype(np.uint8)
    sharp, exposed, grid = raster.raster_features(checker)
    flat = raster.raster_features(np.full((50, 70), 200, dtype=np.uint8))
    assert sharp > 1000 and exposed == pytest.approx(1.0) and set(grid) <= {127, 128}
    assert flat[0] == 0 and flat[2] == [200] * 64
    small = np.arange(64, dtype=np.uint8).reshape(8, 8)
    padded = np.pad(small.astype(float), 1, mode="reflect")
    want = (padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * padded[1:-1, 1:-1]).var()
    assert raster.raster_features(small)[0] == pytest.approx(want) and raster.raster_features(small)[2] == list(range(64))
    assert raster.luma(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255]]], dtype=np.uint8)).tolist() == [[29, 150, 76]]


def test_no_local_scratch_on_a_cluster(monkeypatch):
    from lumisift.session import checkpoint_dir

    class Conf:
        def get(self, key):
            return None

    class Context:
        master, found = "spark://host:7077", None
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: self.found

        def setCheckpointDir(self, at):
            self.found = at

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert checkpoint_dir(Session()).startswith("file://") and Session.sparkContext.found


def test_all_comparisons_are_made_by_blocks(spark, monkeypatch):
    """Pairs of blocks are rows that are compared whole: no join of hashes with hashes makes a row for each of the comparisons."""
    monkeypatch.setattr(neardup, "NAIVE_ROWS", 100)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 300)
    monkeypatch.setattr(neardup, "GIVEN", 50)
    rng = np.random.default_rng(3)
    hashes = rng.integers(-(2**63), 2**63, 1000)
    hashes = np.unique(np.concatenate((hashes, hashes ^ (np.int64(1) << rng.integers(0, 64, 1000)), [0, -1, 2**63 - 1, -(2**63)])))
    df = spark.createDataFrame([(int(h),) for h in hashes], "h long")
    found = neardup.similar_pairs(df, 6, compare_all=True)
    near = np.bitwise_count((hashes[:, None] ^ hashes).view(np.uint64)) <= 6
    assert sorted(map(tuple, found.collect())) == [(int(hashes[i]), int(hashes[j])) for i, j in zip(*np.nonzero(np.triu(near, 1)))]
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "xor" not in plan.lower() and "^" not in plan


def test_a_hash_takes_the_sum_of_its_grid_once(spark):
    rng = random.Random(8)
    grids = [[rng.randint(0, 255) for _ in range(64)] for _ in range(20)] + [[7] * 64]
    df = spark.createDataFrame([(g,) for g in grids], "grid array<int>")
    found = df.select("grid", raster.average_hash(F.col("grid")).alias("h"))
    for r in found.collect():
        assert r.h % 2**64 == sum(1 << i for i, x in enumerate(r.grid) if x * 64 > sum(r.grid))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "> aggregate(" not in plan  # a sum in the lambda of a cell is taken 64 times
