"""Token counts, SimHash and substring dedup against plain versions."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from lumisift.llm import graph, simhash, tokencount

DOCS = "doc_id long, text string, extra string"
ODD = [None, "", "   \n\t ", "one", "one two three", "a b c d", "é à ü " * 40, "x" * 5000, "<|endoftext|> mid <|endoftext|>"]


def odd_docs(spark, texts):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], DOCS)


def test_long_texts_splice_to_the_same_count():
    rng = random.Random(3)
    words = ["the", "naïve", "don't", "12345", "...", "\n\n", "  ", "<|endoftext|>", "ß", "a" * 90, "\t", "日本語", "　"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        enc = tokencount.encoder(public_tokenizers.path(name))
        for _ in range(25):
            text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 400)))
            assert tokencount.spliced_count(text, enc, 120, 8) == enc.counts([text])[0], (name, text)
            assert enc.sums([text, "", text[3:]]) == enc.counts([text, "", text[3:]]), (name, text)


def test_which_files_cut_at_blanks(tmp_path):
    assert all(tokencount.encoder(public_tokenizers.path(x)).splits_at_blanks for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        said = json.load(f)
    text = "one two,\n\n three!\r\n" * 40 + "don't 12 " * 60
    for pattern, cuts in ((public_tokenizers.PATTERN, True), (r"\p{L}+| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+|\p{N}", False)):
        byte = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        said["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}, byte]}
        path = tmp_path / f"{cuts}.json"
        path.write_text(json.dumps(said), encoding="utf-8")
        enc = tokencount.JsonEncoder(str(path))
        assert enc.splits_at_blanks is cuts
        assert tokencount.spliced_count(text, enc, 100, 8) == enc.counts([text])[0] == enc.sums([text])[0]


@pytest.mark.parametrize("change", ["prefix", "normalizer", "default"])
def test_files_that_change_texts_are_not_cut(tmp_path, change):
    """Each stretch would get what the library gives the beginning of a text only."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        said = json.load(f)
    if change == "normalizer":
        said["normalizer"] = {"type": "Prepend", "prepend": "_"}
    elif change == "prefix":
        said["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    else:
        said["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Metaspace", "replacement": "_", "prepend_scheme": "always", "split": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]}
    path = tmp_path / f"{change}.json"
    path.write_text(json.dumps(said))
    enc = tokencount.JsonEncoder(str(path))
    texts = ["a\nfoo bar", "one\n\ntwo\tthree", "plain words here", ""]
    assert not enc.splits_at_blanks and enc.sums(texts) == [len(enc.encoder.encode(t, add_special_tokens=False)) for t in texts]


def test_repeated_rows_and_null_ids_are_counted(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    got = tokencount.count_tokens(docs.selectExpr("*", "1 AS n_tokens", "2 AS n_bytes"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got)) == [(0, 0, 0), (0, 1, 1), (1, 3, 2), (1, 3, 2)]


def test_simhash_of_repeated_rows_and_null_ids(spark):
    rows = [(5, "one two three four five"), (5, "one two three four five"), (None, "one two three four five"), (9, None), (None, "alone in its text")]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, fp int")).collect()
    assert sorted(((r.doc_id or 0, r.component_id or 0) for r in got)) == [(0, 0), (0, 5), (5, 5), (5, 5), (9, 9)]


def test_overlap_widens_where_nothing_aligns():
    enc = tokencount.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "ab" * 700 + " tail end " + "z9" * 500
    assert tokencount.spliced_count(text, enc, 64, 4) == enc.counts([text])[0]


def test_count_tokens_on_odd_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in tokencount.count_tokens(odd_docs(spark, ODD), path, 1000, chunk=64, overlap=8).collect()}
    enc = tokencount.encoder(path)
    for k, text in enumerate(ODD):
        assert (got[k].n_bytes, got[k].n_tokens) == (len((text or "").encode()), enc.counts([text or ""])[0])
        assert got[k].over_limit == (got[k].n_tokens > 1000)
    assert tokencount.count_tokens(odd_docs(spark, []), path).count() == 0


def test_golay_keys_meet_within_two_bits():
    table, used = simhash.golay_table()
    assert sorted(set(used.tolist())) == [1, 6] and (used == 6).sum() == 1771
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        other = words.copy()
        for k in range(len(other)):
            for b in rng.choice(23, flips, replace=False):
                other[k] ^= 1 << int(b)
        (a, ua), (b, ub) = simhash.golay_keys(words), simhash.golay_keys(other)
        assert all(set(x[u]) & set(y[v]) for x, u, y, v in zip(a, ua, b, ub))


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    said = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(s, seed=42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k in range(len(ids)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [least[find(k)] for k in range(len(ids))]


def test_simhash_against_all_pairs(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(50)] + ["Éa", "A", "zZ"]
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(5, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            near = list(base)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            texts.append("  ".join(near))
    got = {r.doc_id: r for r in simhash.near_duplicates(odd_docs(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[k].component_id for k in range(len(texts))] == plain_components(list(range(len(texts))), fps)
    assert simhash.near_duplicates(odd_docs(spark, [])).count() == 0


@pytest.mark.parametrize("big", [16_384, 40])
def test_links_connect_random_and_crowded_fingerprints(spark, monkeypatch, big):
    monkeypatch.setattr(simhash, "BIG", big)  # small: buckets are split into pairs of blocks
    monkeypatch.setattr(simhash, "PART", 2)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    crowd = [int(base[0])]
    for _ in range(400):
        f = int(rng.choice(np.array(crowd, dtype=np.uint64)))
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            f ^= 1 << int(b)
        crowd.append(f)
    fps = sorted({int(x) for x in base} | set(crowd))
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r.u: r.root for r in graph.components(simhash.links(rows)).collect()}
    want = plain_components(signed, fps)
    assert [root.get(x, x) for x in signed] == want


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)], "u long, v long")
    got = {r.u: r.root for r in graph.components(edges).collect()}
    assert got == {k: 0 for k in range(1, n + 1)}


def plain_cut(rows, window=50):
    import hashlib

    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        if d is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for k in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup_against_every_window(spark, seed, monkeypatch):
    from lumisift.llm import substring

    if seed >= 2:  # small groups, so that hot keys and long texts take their own ways
        monkeypatch.setattr(substring, "GROUP_BYTES", 3000)
        monkeypatch.setattr(substring, "SEGMENT_WORDS", 70)
        monkeypatch.setattr(substring, "HOT_ROWS", 3 if seed == 2 else 10)
        monkeypatch.setattr(substring, "MOST_HOT", 5)
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passages = [new(rng.choice([49, 50, 51, 60, 90, 300])) for _ in range(8)] + [["x"] * 120, ["y", "z"] * 60, [*"abcdefghij"] * 12]
    rows = [(None, " ".join(passages[0])), (None, None), (70, None), (71, "")]
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed"
            parts += rng.choice([new(rng.randrange(0, 90)), p, p[rng.randrange(len(p)) :]])
        rows.append((rng.randrange(70), rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += rows[-5:]
    df = spark.createDataFrame([(*r, r[0], 1, "x") for r in rows], "doc_id long, text string, tag long, spans int, key string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_digests(df).collect()), key=str)
    assert got == plain_cut(rows)
    assert sum(x[2] for x in got) > 0
    assert substring.dedup_substrings(df.limit(0)).count() == 0


def test_windows_under_one_anchor_differ_by_all_64_bits(monkeypatch):
    import pyarrow as pa
    from lumisift.llm import substring

    words = [f"w{k}" for k in range(49)]
    real, rows, keys = substring.mixed, [], set()
    for doc in (1, 2):  # one window each: its own hash differs from the other's above bit 40 only
        own = np.array([(doc << 40) | 12345], dtype=np.uint64)
        monkeypatch.setattr(substring, "mixed", lambda x, own=own: own if len(x) == 1 else real(x))
        found = list(substring.texts_rows([(0, " ".join([*words, f"last{doc}"]).encode())], np.array([doc]), np.array([0]), substring.group_rows, np.zeros(0, dtype=np.uint64)))
        rows += found
        keys |= {x for batch in found for x in batch.column(0).to_pylist()}
    assert len(keys) == 1
    table = pa.Table.from_batches(rows).combine_chunks().to_batches()
    assert not [batch for batch in substring.resolve_rows(iter(table)) if batch.num_rows]


def test_a_passage_in_every_group_is_dealt_by_window(spark, monkeypatch):
    """One boilerplate in each of 10,000 groups: no task of any stage has a large part of its rows."""
    from lumisift.llm import substring

    monkeypatch.setattr(substring, "GROUP_BYTES", 1)  # a text a group
    monkeypatch.setattr(substring, "HOT_ROWS", 1000)
    passage = " ".join(f"p{k}" for k in range(60))
    df = spark.range(10_000).selectExpr("id AS doc_id", f"concat('a', id, ' {passage} ', 'z', id) AS text").repartition(8)
    tagged = df.selectExpr("doc_id", "text", "hash(text) & 2147483647 AS tag")
    hot = substring.hot_keys(tagged)
    assert 1 <= len(hot) <= 35
    rows = [b for batch in tagged.toArrow().to_batches() for b in substring.index_rows([batch], substring.group_rows, hot)]
    by_kind = {}
    for b in rows:
        for key, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by_kind.setdefault(kind, {}).setdefault(key, []).append(1)
    assert max(map(len, by_kind.get(substring.COLD, {0: []}).values())) < 1000
    assert max(map(len, by_kind[substring.HOT].values())) <= 3  # spread, though each window stands there 10,000 times
    got = substring.dedup_digests(df).groupBy("n_words", "n_removed").count().collect()
    assert sorted(tuple(r) for r in got) == [(62, 0, 1), (62, 60, 9_999)]


def test_factors_are_greedy_and_the_longest(spark):
    from lumisift.llm import substring

    a, b, c = ([f"{x}{k}" for k in range(100)] for x in "abc")
    rows = [(1, " ".join(a + b)), (2, " ".join(b[:70] + c)), (3, " ".join(["new", *b, *c[:80], "end"])), (4, " ".join(a[:49]))]
    found = sorted(tuple(r) for r in substring.factors(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "at", "n_words", "ref_doc", "ref_at").collect())
    assert found == [(2, 0, 70, 1, 100), (3, 1, 100, 1, 100), (3, 101, 80, 2, 70)]
