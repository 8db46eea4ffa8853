"""Numbers, running values, greedy selection and undo over ranges of every size, against plain loops."""

import random
import time
from itertools import chain

import pytest
from pyspark.sql import functions as F

from lumisift.operators import neardup, ordered, review
from lumisift.streaming.decisions import applied


def test_running_values_cross_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "c"]), k, rng.randint(-3, 3)) for k in range(200)] + [("z", 1, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v int")
    placed = ordered.numbered(df, [F.col("g"), F.col("k")], each=7)
    assert placed.select("part").distinct().count() > 10
    out = ordered.running(placed, ["g"], F.col("v"), "sums")
    out = ordered.running(out, ["g"], F.col("v"), "after", strict=True, reverse=True)
    out = ordered.running(out, ["g"], F.col("v"), "least", "min")
    out = ordered.running(out, ["g"], F.col("v"), "before", "last", strict=True)
    got = sorted(((r.pos, r.g, r.k, r.sums, r.after, r.least, r.before) for r in out.collect()))
    want, seen = [], {}
    for g, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        own = seen.setdefault(g, [])
        own.append(v)
        later = sum(y for x, z, y in rows if x == g and z > k)
        want.append((len(want), g, k, sum(own), later, min(own), own[-2] if len(own) > 1 else None))
    assert got == want


def test_empty_table_is_numbered(spark):
    none = ordered.numbered(spark.createDataFrame([], "g string, k int"), [F.col("k")])
    assert ordered.running(none, ["g"], F.lit(1), "n").collect() == []


def scan(rows, threshold):
    """name -> winner, a sequential scan in order of (ord, name)."""
    kept, out = [], {}
    for name, h, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        lead = next((n for n, g in kept if h is not None and (h ^ g).bit_count() <= threshold), None)
        if lead is None and h is not None:
            kept.append((name, h))
        out[name] = lead
    return out


def drifting(n, bits=4, seed=2):
    """Frames that each differ by so many bits from the one before."""
    rng, h, rows = random.Random(seed), 0, []
    for k in range(n):
        for b in rng.sample(range(63), bits):
            h ^= 1 << b
        rows.append((f"f{k:05}", h, k))
    return rows


@pytest.mark.parametrize("each, shuffled", [(9, False), (9, True), (250_000, False)])
def test_leaders_of_drifting_frames_by_ranges(spark, each, shuffled):
    rows = drifting(120) + [("z1", None, 3), ("z2", None, 4)] + [(f"y{k}", 0, 500 + k) for k in range(5)]
    if shuffled:
        rng = random.Random(4)
        rows = [(n, h, rng.randrange(1000)) for n, h, _ in rows]
    df = spark.createDataFrame(rows, "name string, h long, o long")
    got = neardup.leaders(df, [F.col("o")], each=each, edges_each=1_000_000).collect()
    assert {r.name: r.winner for r in got} == scan(rows, neardup.THRESHOLD) and all(r.kept == (r.winner is None) for r in got)


def test_a_long_chain_takes_one_round(spark):
    rows = drifting(1000, seed=5)
    df = spark.createDataFrame(rows, "name string, h long, o long")
    start = time.time()
    got = {r.name: r.winner for r in neardup.leaders(df, [F.col("o")]).collect()}
    assert got == scan(rows, neardup.THRESHOLD)
    assert time.time() - start < 60  # about 10 s; a round a link would take minutes


def test_scanned_leaves_open_what_hangs_on_others():
    assert neardup.scanned([(1, 12, None), (12, 13, None), (10, 11, True), (2, 14, True), (3, 15, False)]) == {11: False, 14: False, 15: True}
    assert neardup.scanned([(10, 11, True), (11, 12, None)]) == {11: False, 12: True}


def test_a_winner_of_many_losers_is_numbered_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    rows = [(f"n{k:04}", 0 if k % 10 else -1, float(k % 7)) for k in range(600)]
    df = spark.createDataFrame(rows, "name string, h long, score double")
    led = neardup.leaders(df, [-F.col("score")])
    got = sorted((r.winner, r.ord, r.loser) for r in neardup.clusters(led, df, [-F.col("score")]).collect())
    want = []
    for h in (0, -1):
        own = sorted((r for r in rows if r[1] == h), key=lambda r: (-r[2], r[0]))
        want += [(own[0][0], k, r[0]) for k, r in enumerate(own[1:], 1)]
    assert got == sorted(want)


def test_undo_by_brackets_equals_the_fold(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 40)
    rng = random.Random(6)
    rows = []
    for s in ("a", "b", "c", None):
        undo = {"a": 0.5, "b": 0.2, "c": 0.35, None: 0.6}[s]
        for at in range(300):
            action = "undo" if rng.random() < undo else "reset" if s == "c" and rng.random() < 0.02 else rng.choice(["keep", "reject", "clear", "wave"])
            rows.append((s, at, action, None if action in ("undo", "reset") else rng.randrange(12)))
    rows += [("d", 1, "undo", None), ("e", 1, "keep", 3), ("e", 2, "reset", None), ("f", 1, "keep", None), ("g", 1, "keep", 5), ("g", 2, "undo", None), ("g", 3, "undo", None)]
    df = spark.createDataFrame(rows, "session string, at long, action string, idx int")
    got = {r.session: (r.decisions, r.history) for r in review.fold_decisions(df).collect()}
    want = {}
    for s, _, action, idx in rows:
        decisions, history = want.setdefault(s, ({}, []))
        if action in ("undo", "reset") or idx is not None:
            applied(decisions, history, action, idx)
    assert got == want


def test_a_session_of_many_events(spark):
    n = 1_000_000
    at = F.col("id")
    log = spark.range(n).select(F.lit("s").alias("session"), at.alias("at"), F.when(at % 5 == 4, "undo").when(at % 2 == 0, "keep").otherwise("reject").alias("action"), F.when(at % 5 != 4, (at % 1000).cast("int")).alias("idx"))
    decided, remembered = review.bracketed(log)
    decisions, history = {}, []
    for k in range(n):
        applied(decisions, history, "undo" if k % 5 == 4 else "reject" if k % 2 else "keep", k % 1000)
    assert {r.idx: r.decision for r in decided.collect()} == decisions
    assert remembered.count() == len(history) == 600_000


def test_similar_frames_come_in_chunks(spark):
    from lumisift.plans import desk

    clusters = spark.createDataFrame([("k", n, f"l{n}") for n in range(1, 8)], "winner string, ord int, loser string")
    scored = spark.createDataFrame([("k", 9.0), ("j", 8.0), *((f"l{n}", float(n)) for n in range(1, 8))], "name string, score double")
    keepers = spark.createDataFrame([("k", 9.0, 1), ("j", 8.0, 2)], "name string, score double, rank int")
    rows = review.build_session(keepers, clusters, scored, each=3)
    assert sorted((r.path, r.chunk, [s.path for s in r.similar]) for r in rows.collect()) == [("j", 0, []), ("k", 0, ["l1", "l2", "l3"]), ("k", 1, ["l4", "l5", "l6"]), ("k", 2, ["l7"])]
    held = desk.built("f", "", 9, {}, rows)
    assert [(c["path"], len(c["similar"])) for c in held["candidates"]] == [("k", 7), ("j", 0)]


def test_edges_of_a_range_stream_by():
    """A million edges into one frame and a long chain: what is held is a row a decided frame, not the edges."""
    import tracemalloc

    edges = chain(((x, 1_000_000, False) for x in range(1_000_000)), ((n - 1, n, None) for n in range(1_000_001, 1_001_000)))
    tracemalloc.start()
    got = dict(neardup.streamed(edges))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {n: n % 2 == 0 for n in range(1_000_000, 1_001_000)} and most < 1 << 20


def test_ranges_of_many_edges_reach_python_in_batches(spark, monkeypatch):
    """No task is handed a range's edges whole."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", None)
    ordered.checkpoint_dir(spark)
    rows = [(x, y, y // 40) for y in range(1, 200) for x in range(max(0, y - 3), y)]
    got = {r.n: r.kept for r in neardup.settled(spark.createDataFrame(rows, "x long, y long, part int")).collect()}
    assert got == {n: n % 4 == 0 for n in range(1, 200)}
