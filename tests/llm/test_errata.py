"""One-edit pairs against all pairs, with ranges of every size; slips against zlib."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lumisift.llm import errata


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, x) for x, m in counts.items() if one_edit(w, x)]
        form = min(near)[1] if near and -min(near)[0] >= errata.TIMES * n else None
        out[w] = [w, form, None, n, len(near), counts.get(form)]
    for w, row in out.items():
        at = w
        while out[at][1] is not None:
            at = out[at][1]
        row[2] = at
    return sorted(map(tuple, out.values()))


def counted(rows):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(str.maketrans(errata.UPPER, errata.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def random_words(n, letters, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(n)})


@pytest.mark.parametrize("letters, parts", [("ab", 1), ("ab", 7), ("abc", 40), ("aé", 3), ("a", 2)])
def test_entries_of_cut_ranges_find_each_pair_once(letters, parts):
    words = random_words(150, letters, parts)
    size = max(1, len(words) // parts)
    ranges = [words[k : k + size] for k in range(0, len(words), size)]
    edges = errata.Edges([(10 * k, r[0], r[-1]) for k, r in enumerate(ranges)])
    cut = [edges.cut(10 * k, r) for k, r in enumerate(ranges)]
    sizes = {}
    for r, nodes in zip(ranges, cut):
        for name, low, high in nodes:
            for w in r[low:high]:
                own = sizes.setdefault(name, {})
                own[errata.child(w, name[1])] = own.get(errata.child(w, name[1]), 0) + 1
    for (b, d), own in sizes.items():  # a name is a prefix, and each prefix has one
        assert len({w[:d] for r, nodes in zip(ranges, cut) for name, low, high in nodes if name == (b, d) for w in r[low:high]}) == 1
        assert sum(own.values()) == sum(w.startswith(ranges[b][-1][:d]) for w in words)
    heavy = {name: max(own, key=lambda c: (own[c], -ord(c or "\0"))) for name, own in sizes.items() if len(own) > 1}
    made = [(said, wild, r[k]) for r, nodes in zip(ranges, cut) for k, depth, char in errata.carried(r, nodes, heavy) for said, wild in errata.entries(r[k], depth, char)]
    found = [frozenset((w, said)) for said, wild, w in made if not wild and said in set(words)]
    groups = {}
    for said, wild, w in made:
        if wild:
            groups.setdefault(said, []).append(w)
    found += [frozenset((x, y)) for g in groups.values() for i, x in enumerate(g) for y in g[:i]]
    want = {frozenset((x, y)) for x in words for y in words if x < y and one_edit(x, y)}
    assert len(found) == len(set(found)) and set(found) == want


def test_light_subtrees_are_few():
    words = random_words(4000, "abcdefgh", 5)
    at = {}
    for k, _, _ in errata.carried(words, [], {}):
        at[k] = at.get(k, 0) + 1
    assert max(at.values()) <= len(words).bit_length()  # small-to-large


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    stems = random_words(60, "abcdeÉé", 9)
    said = []
    for w in stems:
        said += [w] * rng.choice([3, 4, 8, 20, 40])
        for _ in range(3):
            k = rng.randrange(len(w))
            said += [rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :]])] * rng.choice([1, 3, 5, 9])
    rng.shuffle(said)
    rows = [(k, " ".join(said[k::40]).upper() if k % 3 else "-".join(said[k::40])) for k in range(40)]
    return rows + [rows[0], rows[0], (None, rows[1][1]), (None, None), (77, ""), (78, "ABCDE " * 3000 + "ABCDEF" * 5000)]


def test_whole_query_equals_brute_force(spark, texts):
    want = brute(counted(texts))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("run", F.lit(2))
    got = errata.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_empty_and_long_words(spark):
    assert errata.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "ab" * 20_000
    rows = [(k, f"{long} {long}c {long[:-1]}") for k in range(3)]
    got = {r.word: r for r in errata.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[long].n_near == 2 and got[long + "c"].n_near == 1 and got[long].form is None


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(100)], "word string, form string")
    assert {r.root for r in errata.followed(forms).collect()} == {"w100"}
