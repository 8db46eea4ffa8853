import base64
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from lumisift.llm import tokenstore

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_keyed_permutation(size):
    a, b = (tokenstore.feistel(np.arange(size), size, key) for key in (1, 2))
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(size))
    assert size < 64 or (a != b).any() and (a != np.arange(size)).any()


def test_shards_hold_every_token_once(spark, tmp_path):
    texts = {0: "a b c", 1: "", 2: None, 3: "naïve text, don't " * 60, 9: "x" * 3000, 12: "\n\n word " * 200}
    rows = [*texts.items(), (-1, "minus one"), (3, "other text"), (None, "nobody's"), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, slot string").repartition(3)
    seen = []
    for run in ("one", "two"):
        out = f"file://{tmp_path}/{run}"
        manifest = tokenstore.write_shards(docs.repartition(2 if run == "one" else 5), out, PATH, P.PATTERN, seq_len=32, shard_bytes=1500)
        assert len(manifest["shards"]) > 2
        got = list(tokenstore.records(out))
        assert [x[0] for x in got] == list(range(len(got)))
        got = [(k, -9 if d is None else d, s, ids) for k, d, s, ids in got]
        seen.append([(d, s, ids.tolist()) for _, d, s, ids in got])
        back = sorted((r.slot, -9 if r.doc_id is None else r.doc_id, r.seq, r.n_tokens, r.crc) for r in tokenstore.read_shards(spark, out).collect())
        assert back == [(k, d, s, len(ids), zlib.crc32(ids.tobytes())) for k, d, s, ids in got]
        later = list(tokenstore.records(out, 7, block=3))
        assert [x[0] for x in later] == list(range(7, len(got))) and later[0][3].tolist() == got[7][3].tolist()
    assert seen[0] == seen[1]  # whatever the partitions
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((-9 if d is None else d, enc.encode_ordinary(t or "") + [50256]) for d, t in rows)
    joined = []
    for d, t in want:
        parts = [t[k : k + 32] for k in range(0, len(t), 32)]
        joined += [(d, k, p) for k, p in enumerate(parts)]
    assert sorted(joined) == sorted((d, s, t) for d, s, t in seen[0])
    assert [x[:2] for x in seen[0]] != sorted(x[:2] for x in seen[0])


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenstore.materialise_order(docs, PATH, P.PATTERN).count() == 0


def test_long_texts_are_coded_in_pieces(monkeypatch):
    monkeypatch.setattr(tokenstore, "PIECE_CHARS", 10)
    text = "some words  here,\n\n and\tmore don't " * 9
    enc = tokenstore.coder(PATH, P.PATTERN)
    assert tokenstore.ids_of(text, PATH, P.PATTERN).tolist() == enc.encode_ordinary(text)


def test_many_repeated_rows_fill_shards_of_their_own(spark, tmp_path):
    """The same records in the same order as without, in even shards."""
    long = "many words of a text that is repeated " * 20
    rows = [(7, long)] * 300 + [(None, "no id")] * 200 + [(k, f"text {k} " * (k % 30)) for k in range(20, 120)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, tag long, number int").repartition(4)
    out, plain = f"file://{tmp_path}/hot", f"file://{tmp_path}/plain"
    manifest = tokenstore.write_shards(docs, out, PATH, P.PATTERN, seq_len=32, shard_bytes=2400)
    assert max(x["rows"] for x in manifest["shards"]) <= 4 * 2400 / manifest["stride"]
    tokenstore.write_shards(docs.repartition(7), plain, PATH, P.PATTERN, seq_len=32, shard_bytes=10_000_000)
    read = lambda at: [(s, d, n, ids.tobytes()) for s, d, n, ids in tokenstore.records(at)]
    assert read(out) == read(plain) and len(read(out)) > 1500


def test_ids_over_two_bytes_are_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    out = f"file://{tmp_path}/wide"
    manifest = tokenstore.write_shards(docs, out, PATH, P.PATTERN, seq_len=8, eos=70_000)
    assert manifest["id_bytes"] == 4 and manifest["stride"] == 16 + 32
    got = {d: ids.tolist() for _, d, _, ids in tokenstore.records(out)}
    assert got[2] == [70_000] and got[1] == [*tokenstore.coder(PATH, P.PATTERN).encode_ordinary("a b c"), 70_000]
    assert {r.doc_id: r.n_tokens for r in tokenstore.read_shards(spark, out).collect()} == {1: len(got[1]), 2: 1}
    with pytest.raises(ValueError):
        tokenstore.id_bytes(PATH, 1 << 32)
