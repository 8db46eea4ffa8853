import math
import random

import numpy as np
import pytest
from lumisift.llm import langid


def plain_length(samples, text, order):
    """The code length by a dictionary of contexts."""
    seen = {}
    for t in samples:
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                node = seen.setdefault(t[i - k : i], {})
                node[t[i]] = node.get(t[i], 0) + 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            node = seen.get(text[i - k : i])
            if not node:
                continue
            whole = sum(node.values()) + len(node)
            if text[i] in node:
                bits -= math.log2(node[text[i]] / whole)
                break
            bits -= math.log2(len(node) / whole)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [0, 1, 3, 4])
def test_lengths_are_those_of_context_trees(order, monkeypatch):
    rng = random.Random(order)
    draw = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    samples = {"a": [draw(b"abcab", 300), draw(b"abcd", 50)], "b": [draw(b"bcdx", 200), b"", b"b"]}
    model = langid.Model(samples, order)
    texts = [draw(b"abcdxz", n) for n in (1, 2, 3, 30, 200)] + [b"", b"a", "é".encode()]
    want = [[plain_length(samples[x], t, order) for x in model.langs] for t in texts]
    assert np.allclose(model.lengths(texts), want, rtol=1e-4, atol=1e-3)
    monkeypatch.setattr(langid, "GROUP_BYTES", 40)
    assert np.allclose(model.lengths(texts), want, rtol=1e-4, atol=1e-3)


def test_predictions_and_odd_rows(spark):
    rng = random.Random(1)
    words = {"xx": ["foo", "bar", "bazen"], "yy": ["lorem", "ipsüm", "dolor"]}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(3, 40))), x, "s") for k in range(120) for x in [rng.choice(["xx", "yy"])]]
    odd = [(200, None, "xx", "s"), (201, "", "xx", "s"), (202, "12 !? 34", None, "s"), (None, "foo bar foo", None, "s"), (5, "dolor dolor", "xx", "s"), (5, "dolor dolor", "xx", "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = langid.train(docs.where(~langid.held_out(docs.doc_id)), rows=20)
    got = langid.identify(docs.select("doc_id", "text"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (200, 201, 202))
    assert by[None].lang_pred == "xx" and 0.5 < by[None].score <= 1
    true = {r[0]: r[2] for r in rows if r[0] != 5}
    assert sum(by[k].lang_pred == v for k, v in true.items()) >= 0.97 * len(true)
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_columns_named_like_the_added_ones_are_replaced(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "foo bar " * 5 if k % 2 else "lorem dolor " * 4, "x" if k % 2 else "y", 9, "old", "c", -1) for k in range(40)], "doc_id long, text string, lang string, score int, lang_pred string, c0 string, bits_per_byte int")
    model = langid.train(docs)
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "c0", "lang_pred", "score", "bits_per_byte"]
    assert all(r.lang_pred == r.lang and r.c0 == "c" and 0.5 < r.score <= 1 and r.bits_per_byte > 0 for r in out.collect())
    monkeypatch.setattr(langid, "LANGS", 1)  # a model a language
    apart = langid.identify(docs, langid.train(docs))
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, out.collect()))


def test_a_thousand_labels(spark, monkeypatch):
    def text(k, n):
        return " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{j % 3}" for j in range(n))

    docs = spark.createDataFrame([(2 * k + j, text(k, 12 + j), f"l{k:04}") for k in range(1000) for j in range(2)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "ALL_BYTES", 100_000)  # so that only one of a label's two rows is learned from
    model = langid.train(docs)
    assert len(model.langs) == 1000 and len(model.parts) == 16
    asked = docs.where("doc_id % 100 < 2")
    got = langid.identify(asked, model).collect()
    assert len(got) == 40 and sum(r.lang_pred == r.lang for r in got) >= 38
    one = langid.Model({x: [text(int(x[1:]), 12).encode()] for x in model.langs[:70]})
    two = langid.Models({x: [text(int(x[1:]), 12).encode()] for x in model.langs[:70]}, each=9)
    texts = [text(k, 9).encode() for k in range(0, 70, 5)]
    assert np.allclose(one.lengths(texts), two.lengths(texts), rtol=1e-5)  # languages do not see each other
