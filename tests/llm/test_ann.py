import numpy as np
import pytest
from lumisift.llm import ann


def exact(rows, is_query, k):
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], dtype=np.float32).astype(np.float64)
    out = {}
    for q in sorted({i for i in ids if is_query(i)}):
        own = min(x[ids == q], key=lambda v: v.tobytes())  # of rows that share an id one asks
        score = ann.in_order(np.repeat(own[None], len(ids), axis=0), x)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), score[j]) for j in order]
    return out


@pytest.mark.parametrize("copies", [0, 400])
def test_search_against_all_pairs(spark, monkeypatch, copies):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 8))).astype(np.float32)
    x[100 : 100 + copies] = x[100]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [float("nan")] * 8), (2080, [1.0] * 7 + [None]), (2100, [float("inf")] * 8), (2120, [1.0] * 5), (None, [1.0] * 8)]
    rows += [(20, x[20].tolist())] * 2 + [(41, x[41].tolist()), (40, x[7].tolist())]  # repeated ids: the same vector, and another
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got: dict = {}
    for r in ann.search(df, lambda i: i % 20 == 0, k=10, sample=800, calibration=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = exact(rows, lambda i: i % 20 == 0, 10)
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in got)
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    scores = {(q, v, s) for q, all_of in exact(rows, lambda i: i % 20 == 0, None).items() for v, s in all_of}
    assert all((q, v, s) in scores for q in got for v, s in got[q])  # each found one has its exact score, wanted or not
    assert all((v, s) in want[q] for q in got for v, s in got[q] if s > min(y for _, y in want[q]))  # and a better one than the last wanted is wanted
    assert [v for v, _ in want[0]].count(41) == [v for v, _ in got[0]].count(41)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(k, [float(k + 1), 1.0]) for k in range(5)], "vec_id long, embedding array<float>")
    got = ann.search(df, lambda i: i % 20 == 0, k=20).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 4, 6.0), (0, 2, 3, 5.0), (0, 3, 2, 4.0), (0, 4, 1, 3.0)]
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_recall_of_queries_that_did_not_calibrate(spark):
    found = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in found]), np.array([v for _, v in found], dtype=np.float64)
    df = spark.createDataFrame(found, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.search(df, lambda i: i % 5 == 0, k=20, calibration=40).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 5 == 0)
    assert set(got) == set(ids[asked].tolist()) and len(got) > 300  # so nine in ten did not
    share = []
    for q in asked:
        score = ann.in_order(np.repeat(x[q : q + 1], len(x), axis=0), x)
        score[q] = -9
        share.append(len(got[int(ids[q])] & set(ids[np.lexsort((ids, -score))[:20]].tolist())) / 20)
    assert np.mean(share) >= 0.9


def test_leaves_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_SIZE", 10)
    sizes = {}
    real = ann.Tree.__init__

    def seen(self, root, measured=None):
        real(self, root, measured)
        sizes.setdefault(n, []).append(self.leaves)

    monkeypatch.setattr(ann.Tree, "__init__", seen)
    rng = np.random.default_rng(5)
    for n in (400, 4000):
        x = rng.normal(size=(n, 6)).astype(np.float32)
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = ann.search(df, lambda i: i % 20 == 0, k=5, sample=300, calibration=50).collect()
        score = x[::20].astype(np.float64) @ x.T.astype(np.float64)
        score[np.arange(len(score)), np.arange(0, n, 20)] = -9e9
        want = {(20 * q, int(v)) for q, vs in enumerate(np.argsort(-score, axis=1)[:, :5]) for v in vs}
        assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    assert max(sizes[400]) >= 20 and max(sizes[4000]) >= 200


@pytest.mark.parametrize("n", [1, 2, 3])
def test_a_tree_visits_each_leaf_once(n):
    x = np.random.default_rng(n).normal(size=(50 * n, 3))
    tree = ann.Tree(ann.grown(ann.lifted(x, 9.0), least=4))
    grafted = tree.grafted({0: ann.grown(ann.lifted(x[:40], 9.0), least=2)})
    for t in (tree, grafted):
        leaves, looked = t.visits(x[0], t.leaves)
        assert looked == len(t.centres)
        assert sorted(leaves) == list(range(t.leaves)) and set(t.place(ann.lifted(x, 9.0)).tolist()) <= set(leaves)
    assert grafted.leaves > tree.leaves


def test_branches_without_promise_are_never_looked_at():
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(40, 16)) * 3
    x = heads[rng.integers(0, 40, 8000)] + 0.2 * rng.normal(size=(8000, 16))
    longest = float(np.sqrt((x**2).sum(axis=1).max()))
    tree = ann.Tree(ann.grown(ann.lifted(x, longest), least=24))
    leaf = tree.place(ann.lifted(x, longest))
    held = np.bincount(leaf, minlength=tree.leaves).astype(float)
    centre = np.array([x[leaf == k].mean(axis=0) if held[k] else np.zeros(16) for k in range(tree.leaves)])
    spread = np.array([np.sqrt(((x[leaf == k] - centre[k]) ** 2).mean()) if held[k] else 0.0 for k in range(tree.leaves)])
    tree = ann.Tree(tree.root, (held, centre, spread))
    looked, found = [], []
    for q in range(0, 8000, 200):
        near = np.argsort(-(x @ x[q]))[:10]
        leaves, bins = tree.visits(x[q], tree.leaves, wanted=set(leaf[near].tolist()))
        looked.append(bins)
        found.append(set(leaf[near].tolist()) <= set(leaves))
    assert all(found) and tree.leaves > 300 and np.mean(looked) < len(tree.centres) / 3
