"""The pipeline on a small fixture, stage by stage, with planted cases."""

import random

import corpus_pipeline
from lumisift.llm import common, decontam, simhash
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(seed=6):
    rng = random.Random(seed)
    words = {lang: [f"{p}{rng.choice('aeiou')}{rng.choice(t)}{k}" for k in range(300)] for lang, p, t in (("en", "th", "rst"), ("de", "sch", "pfz"))}
    draw = lambda lang, n: [rng.choice(words[lang]) for _ in range(n)]
    rows, bench = [], [(k, " ".join(draw("en", 25))) for k in range(4)]
    for k in range(120):
        lang = rng.choice(["en", "de"])
        text = draw(lang, rng.randrange(30, 200))
        if k % 20 == 3:
            text[10:10] = bench[k % 4][1].split()
        rows.append((k, " ".join(text), lang, rng.choice(["a", "b", "c", None]), None))
    rows += [(200 + k, rows[k][1], rows[k][2], "a", None) for k in range(5)]  # copies
    for k in range(6, 9):  # near copies of long texts
        base = draw("en", 400)
        rows += [(210 + 2 * k, " ".join(base), "en", "b", None), (211 + 2 * k, " ".join([*base[:200], *base[201:]]), "en", "b", None)]
    rows += [(300, None, "en", "a", None), (301, "", None, "a", None), (302, "12 + 7 = 19", "en", "a", None), (None, " ".join(draw("de", 60)), None, "c", None), rows[50], rows[50]]
    return rows, bench


def test_stages(spark, tmp_path):
    rows, bench = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = common.table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialise(stage(spark, docs, str(tmp_path)), name)
        seen[name] = (docs, out)
        if name != "token_shards":
            assert out.columns == COLUMNS
        docs = out
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    first, kept = seen["language_id"]
    assert set(ids(first)) - set(ids(kept)) == {300, 301, 302} and len(ids(first)) - len(ids(kept)) == 3
    true = {r[0]: r[2] for r in rows}
    assert all(r.lang == true[r.doc_id] for r in kept.collect() if r.doc_id is not None)
    before, after = seen["near_dedup"]
    groups = simhash.near_duplicates(before).where("doc_id is not null").select("component_id").distinct().count()
    assert len(ids(after)) == len(set(ids(after))) == groups + (None in ids(after))
    assert not set(range(200, 205)) & set(ids(after)) and None in ids(after)
    assert [223, 225, 227] == [x for x in ids(before) if x in (223, 225, 227)] and not {223, 225, 227} & set(ids(after))
    before, after = seen["decontamination"]
    leaks = {k for k in range(120) if k % 20 == 3}
    assert set(ids(before)) - set(ids(after)) == leaks & set(ids(before))
    assert decontam.overlaps(after, common.table(spark, str(tmp_path), "benchmark")).count() == 0
    before, after = seen["mixing"]
    size = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(size(before) - size(after)) <= 4
    shards = seen["token_shards"][1].collect()
    assert sorted(r.slot for r in shards) == list(range(len(shards)))
    assert {r.doc_id for r in shards} == {r.doc_id for r in after.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id")).collect()} - {-1} | ({None} if None in ids(after) else set())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, shards))


def test_other_columns_are_dropped(spark, tmp_path):
    spark.createDataFrame([(1, "a benchmark item of ten words or more than that here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, f"some words of text number {k} " * 9, "en", "a", None, "x", 1, "s") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_key string, position int, score string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == COLUMNS
        assert stage(spark, docs, str(tmp_path)).count() >= 1
    assert {r.doc_id for r in corpus_pipeline.token_shards(spark, docs, str(tmp_path)).collect()} == set(range(6))


def test_an_empty_corpus(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_at_similarities_of_0_8_to_0_9(spark):
    rng = random.Random(12)
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    texts = []
    for k in range(40):
        base = draw(rng.randrange(150, 400))
        other = list(base)
        for _ in range(round(len(base) * rng.uniform(0.008, 0.035))):
            other[rng.randrange(len(other))] = "changed"
        texts += [" ".join(base), " ".join(other)]
    base = draw(200)  # many copies under one key
    for _ in range(200):
        other = list(base)
        for _ in range(4):
            other[rng.randrange(200)] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(other))
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    close = 0
    for i in range(len(texts)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if alike >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                close += i < 80 and alike < 0.9
    assert close >= 15
    rows = [(k, t, "en", "a", None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [k for k in range(len(texts)) if find(k) == k]


def test_crowds_lose_no_link(spark, monkeypatch):
    """A crowd whose forest and nearest by sketch are all dissimilar sets: what is left is compared whole, in blocks too."""
    from lumisift.llm import shingles

    rng = random.Random(5)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, texts = draw(300), []
    for k in range(60):  # copies of similarity near 0.7 to each other, in pairs of similarity over 0.8
        head = list(base)
        for _ in range(5):
            head[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        tail = list(head)
        for _ in range(3):
            tail[rng.randrange(300)] = f"y{rng.randrange(10**6)}"
        texts += [" ".join(head), " ".join(tail)]
    sets, root = [{tuple(t.split()[k : k + 5]) for k in range(296)} for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert 10 < len(set(root)) < 110
    monkeypatch.setattr(shingles, "SMALL", 2)
    monkeypatch.setattr(shingles, "NEAREST", 1)
    monkeypatch.setattr(shingles, "PASSES", 1)
    monkeypatch.setattr(shingles, "BIG", 40)
    df = spark.createDataFrame(list(enumerate(texts)), "row_key long, text string")
    found = {r.row_key: r.component for r in shingles.grouped(df, shingles.signed(df), lambda d: simhash.linked(d.select("fp", "sig"))).collect()}
    assert all((found[i] == found[j]) == (root[i] == root[j]) for i in range(len(texts)) for j in range(i))


def test_a_key_of_many_gives_pairs_in_proportion():
    """All alike: a forest, and the same one whatever the key."""
    import numpy as np
    from lumisift.llm import shingles

    rows = np.stack([np.arange(3000, dtype=np.uint64) * np.uint64(977), np.full(3000, 100, np.uint64), np.full(3000, 5, np.uint64), np.full(3000, 9, np.uint64)], axis=1)
    rng = np.random.default_rng(1)
    one, two = (shingles.pairs_of(np.full(3000, k), rows[rng.permutation(3000)]) for k in (4, 8))
    assert len(one[0]) == 2999 and (one[0] == two[0]).all() and one[1].tolist() == [[4, 3000]]
    assert sum(map(len, shingles.between(rows, np.zeros(3000, np.int64), None))) == 0
