"""Base scores against plain counts; the model's probabilities sum to one, match a loop over decisions, and beat the base on texts it has not seen."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.llm import mixture


def said(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ") if w] + [None]


def brute(rows):
    hash_ = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    counts = Counter(w for d, t in rows if hash_(d) for w in said(t))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        words = said(t)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        out.append((d, hash_(d) == 0, len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    parts = ["th", "on", "Er", "tion", "é", "ing", "an", "st"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 60, 400])]) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    extra = [(None, texts[0]), (500, None), (501, ""), (502, " \t\n "), (3, texts[3]), (3, texts[3]), (503, "x" * 50_000), (504, ("Long word " + "y" * 100 + " ") * 3000), (505, "a b\u0000c \x0bD\x1cE")]
    return [(k, t) for k, t in enumerate(texts)] + extra


def test_counts_and_base_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(mixture, "FREQUENT", 50)  # so that most words go through the join
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("row", F.lit(2)).withColumn("held_out", F.lit(3))
    found = mixture.score_texts(df).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr)
    assert got == brute(rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)
    fresh = [r for r in found if r.held_out and r.n_tokens > 20]
    assert fresh and sum(r.score for r in fresh) > 1.2 * sum(r.base_score for r in fresh)
    again = mixture.score_texts(df.repartition(3, "text")).collect()  # other batches, the same scores
    assert sorted((repr(r.doc_id), round(r.score, 4)) for r in again) == sorted((repr(r.doc_id), round(r.score, 4)) for r in found)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert mixture.score_texts(none).count() == 0
    row = mixture.score_texts(spark.createDataFrame([(None, "some words")], "doc_id long, text string")).first()  # held out, nothing learned
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and row.score < 0


def test_first_weights_come_from_all_rows(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeth") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(4000)) for _ in range(3)]  # each longer than what was once sampled
    training = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    m, _ = mixture.train(training)
    tokens = mixture.Tokens([mixture.words_of(t) for t in texts], m.code)
    cells = mixture.decision_cells(training.repartition(2).select("text"), m.shared)
    assert cells.sum() == tokens.made.count[tokens.ids].sum()
    assert not np.allclose(m.weights, 0.3) and np.allclose(m.weights, mixture.first_weights(cells))
    even = mixture.Model(m.code, m.bits, m.tables, np.full_like(m.weights, 0.3), {}, 0, 0)
    assert m.scores(tokens).sum() < even.scores(tokens).sum()


def test_weights_are_found_again():
    rng = np.random.default_rng(5)
    want = np.array([0.2, 0.5, 0.1, 0.4])
    cells = np.zeros((mixture.GATES, mixture.STEPS**mixture.PREDICTORS))
    steps = rng.integers(0, mixture.STEPS, (4000, mixture.PREDICTORS))
    mirrored = np.abs(mixture.MIDDLES[:, None] + mixture.MIDDLES[None]).argmin(axis=0)  # the step of the other bit, about
    for row in steps:
        back = mirrored[row]
        x, y = mixture.MIDDLES[row], mixture.MIDDLES[back]
        p = 1 / (1 + np.exp(-(x @ want)))
        if np.allclose(x, -y, atol=0.6):
            for s, n in ((row, p), (back, 1 - p)):
                cells[7, np.ravel_multi_index(tuple(s), (mixture.STEPS,) * mixture.PREDICTORS)] += 1000 * n
    found = mixture.first_weights(cells)
    assert np.allclose(found[7], want, atol=0.1) and np.allclose(np.delete(found, 7, axis=0), 0.3)


def model(seed=1):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, (mixture.CONTEXTS, 256)) ** 3 * (rng.random((mixture.CONTEXTS, 1)) < 0.05)
    tables = rng.integers(0, 65536, (mixture.PREDICTORS, 1 << 13)) * (rng.random((mixture.PREDICTORS, 1 << 13)) < 0.7)
    return mixture.Model(mixture.Code(counts), 13, tables.astype(np.uint16), rng.normal(0.3, 0.1, (mixture.GATES, mixture.PREDICTORS)), {}, 0, 0)


def test_next_bytes_sum_to_one():
    m = model()
    head = [b"word", b"th"]
    ends = [2.0 ** -m.scores(mixture.Tokens([[*head, b"x" + bytes([b]) + b"z", b""]], m.code))[0] for b in range(4)]
    assert all(e > 0 for e in ends)
    code = m.code
    assert len(code.length) > 257 * 256
    for tree in (32, 97, 255, 256, len(code.length) // 256 - 1):  # a complete prefix code in each tree
        assert sum(2.0 ** -int(code.length[tree * 256 + b]) for b in range(256)) == pytest.approx(1, abs=1e-9)
        paths = {tuple(code.bits[code.start[at] : code.start[at] + code.length[at]]) for at in range(tree * 256, tree * 256 + 256)}
        assert len(paths) == 256


def loop(m, words, segment=mixture.SEGMENT):
    """Bits of one text, a decision at a time."""
    tokens = mixture.Tokens([words], m.code)
    m.ready()
    pairs, within = m.looked_up(tokens)
    at, before, _ = tokens.decisions(0, len(tokens.ids))
    cross = m.across(within, at, before)
    gate, odds = m.gate(pairs[1], pairs[2])[at] + m.across_gate[cross], m.odds
    weights, bent = m.weights.astype(np.float64).copy(), np.full(mixture.GATES, mixture.FIRM)
    bits, done, size = 0.0, 0, segment
    while done < len(at):
        pull, bend = np.zeros_like(weights), np.zeros(mixture.GATES)
        for k in range(done, min(done + size, len(at))):
            x = np.array([m.rounded[p[at[k]]] / mixture.ODDS_STEPS for p in pairs] + [odds[cross[k]]], dtype=np.float64)
            g = gate[k]
            p = 1 / (1 + math.exp(-float(x @ weights[g])))
            y = tokens.made.bits[at[k]]
            bits -= math.log2(p if y else 1 - p)
            pull[g] += (y - p) * x
            bend[g] += p * (1 - p) * float(x @ x)
        bent += bend
        weights += pull / bent[:, None]
        done += size
        size = min(mixture.LONGEST, done)
    return bits


def test_batches_equal_a_loop_over_decisions(monkeypatch):
    m = model(2)
    rng = random.Random(5)
    texts = [[bytes(rng.choice(b"abcdeth") for _ in range(rng.randint(1, 9))) for _ in range(n)] + [b""] for n in (0, 1, 40, 300, 900, 7)]
    want = [loop(m, t) for t in texts]
    assert m.scores(mixture.Tokens(texts, m.code)) == pytest.approx(want, rel=1e-4)
    monkeypatch.setattr(mixture, "CHUNK", 64)  # so that long texts are laid out segment by segment
    assert m.scores(mixture.Tokens(texts, m.code)) == pytest.approx(want, rel=1e-4)


def test_decisions_of_a_byte_are_fetched_together():
    m = model(4)
    tokens = mixture.Tokens([[b"abc", b"b" * 40, b""], [b"abc", b"", ]], m.code)
    at, before, _ = tokens.decisions(0, len(tokens.ids))
    got, slot = tokens.across(tokens.made.hashed(2), 0, len(tokens.ids), m.bits)
    assert got.tolist() == at.tolist() and (slot & 1).tolist() == tokens.made.bits[at].tolist()
    assert m.tables[mixture.WITHIN][slot >> 1].tolist() == m.across(tokens.made, at, before).tolist()  # decision by decision
    byte = np.repeat(np.arange(len(tokens.made.data)), tokens.made.size)
    for which in range(mixture.WITHIN):
        own = (tokens.made.within(which, m.bits) >> 1) // (mixture.NEAR + 1)
        assert all(len(set(own[byte == b])) == 1 for b in range(len(tokens.made.data)))


def test_refining_pays():
    m = model(3)
    words = [b"abab", b"cdcd"] * 4000 + [b""]
    short, long = m.scores(mixture.Tokens([words[:100], words], m.code))
    assert long / len(words) < 0.9 * short / 100


def test_counts_as_bytes():
    n = np.arange(32)
    assert (mixture.quantised(n) == n).all()
    odds, level = mixture._of_pairs()
    assert odds[0] == 0 and (np.delete(odds, 0) != 0).all() and (level[0], level[1], level[256 + 1], level[255]) == (0, 1, 2, 5)
    assert odds[3 + 256 * 5] == pytest.approx(math.log(5.2 / 3.2))
    pairs = np.array([3 + 256 * 5, 0, 256, 40 + 256 * 40])
    assert mixture.less_one(pairs, np.array([1, 1, 1, 0])).tolist() == [3 + 256 * 4, 0, 0, 40 + 256 * 40]



def test_split_is_words_of():
    import pyarrow as pa

    texts = ["", None, " \t\n ", "One two", "x", " é É \x0bD\x1cE\x00f\r", "end ", "  Z" * 5, "a" * 300, None, " q"]
    for array in (pa.array(texts), pa.array(texts).slice(3, 5), pa.array(["", None]), pa.array(["a", "b", "c d"])):
        words, sizes = mixture.split(array)
        want = [mixture.words_of(t) for t in array.to_pylist()]
        assert words.to_pylist() == [w for said_ in want for w in said_] and sizes.tolist() == [len(said_) for said_ in want]


def test_each_pair_of_words_is_laid_out_once(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "dD"]) for _ in range(rng.randint(0, 40))) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    want = Counter()
    for t in texts:
        words = [b"", *mixture.words_of(t)]
        want.update(zip(words, words[1:]))
    names = {int(h): w for w, h in zip([b"", b"a", b"bb", b"ccc", b"dd"], mixture.whole_hashes(pa.array([b"", b"a", b"bb", b"ccc", b"dd"], pa.binary())))}
    for spelled in (mixture.SPELLED, 2):  # words laid out in parts, too
        monkeypatch.setattr(mixture, "SPELLED", spelled)
        got, laid = Counter(), 0
        for made, ids, before, often in mixture.pairs_of(iter([batch]), model().code):
            for k, b, n in zip(ids, before, often):
                got[names[int(b)], names[int(made.whole[k])]] += int(n)
                laid += 1
        assert got == want and laid == len(want)


def test_longer_contexts_need_fewer_decisions():
    import pyarrow as pa

    words = pa.array([b"abcx", b"dbcy", b"ebcz", b"fbcw"] * 300, pa.binary())
    data, place, _ = mixture.laid_out(words)
    which, n = np.unique(mixture.context_of(data, place) * 256 + data, return_counts=True)
    short, long = mixture.Code(mixture.shorter(which, n)), mixture.Code(mixture.shorter(which, n), (which, n))
    assert mixture.Decisions(words, long).count.sum() < mixture.Decisions(words, short).count.sum()
    for tree in range(len(long.length) // 256):
        assert sum(2.0 ** -int(long.length[tree * 256 + b]) for b in range(256)) == pytest.approx(1, abs=1e-9)
