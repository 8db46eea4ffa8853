"""Decontamination, licences, mixing and chat formatting against plain versions."""

import hashlib
import random
import re

import pytest
from lumisift.llm import chat, decontam, licenses, mixing
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string, score string"


def best(doc, item, shift):
    now = top = 0
    for i in range(max(0, -shift), min(len(item), len(doc) - shift)):
        now = max(0, now + (1 if doc[i + shift] == item[i] else -2))
        top = max(top, now)
    return top


def test_overlaps_against_every_alignment(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 9, 10, 12, 15, 40])))) for k in range(12)] + [(12, None), (13, ""), (3, "again " * 20)]
    docs = [(0, None), (1, ""), (2, "short"), (3, "again " * 30)]
    for k in range(4, 60):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 60))]
        if rng.random() < 0.7:
            part = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(3)):
                if part:
                    part[rng.randrange(len(part))] = "CHANGED"
            at = rng.randrange(len(words))
            words[at:at] = part
        docs.append((k, ", ".join(words).upper() if k % 2 else " ".join(words)))
    docs += docs[-3:]
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = {}
    for d, text in docs:
        for k, item in items:
            a, b = tokens(text), tokens(item)
            top = max((best(a, b, s) for s in range(-len(b), len(a) + 1)), default=0)
            if b and top >= min(decontam.SCORE, len(b)):
                want[d, k] = max(top, want.get((d, k), 0))
    df = spark.createDataFrame([(d, t, None, "x") for d, t in docs], DOCS)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string")
    for limit in (500_000, 1):  # broadcast, and not
        got = {(r.doc_id, r.item_id): r.score for r in decontam.overlaps(df, bench, broadcast_rows=limit).collect()}
        assert got == want and len(got) > 10
    for limit in (500_000, 1):
        kept = {r.doc_id for r in decontam.decontaminate(df, bench, limit).collect()}
        assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontam.overlaps(df.limit(0), bench).count() == 0 == decontam.overlaps(df, bench.limit(0)).count()


def test_one_substitution_anywhere_is_found(spark):
    item = [f"t{k}" for k in range(15)]
    docs = [(k, " ".join(["before", *item[:k], "other", *item[k + 1 :], "after"]), None, None) for k in range(15)]
    got = decontam.overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect() if r.score >= 10) == [k for k in range(15) ]


def test_no_stretch_is_without_a_seed(spark):
    masks, width = [(int(m, 2), len(m)) for m in decontam.SEEDS], max(map(len, decontam.SEEDS))
    seen = todo = {(1, 1, 1)}  # the last matches as bits, how many, the score of a stretch so far
    while todo:  # all stretches, by what a seed or the score can still depend on
        found = set()
        for bits, n, score in todo:
            for bit, gain in ((1, 1), (0, -decontam.PENALTY)):
                now = ((bits << 1 | bit) & ((1 << width) - 1), min(width, n + 1), score + gain)
                if now[2] > 0 and not any(now[1] >= w and now[0] & m == m for m, w in masks):
                    assert now[2] < decontam.SCORE
                    found.add(now)
        todo = found - seen
        seen = seen | found
    words = [f"t{k}" for k in range(60)]
    fifth = [w if k % 5 else "other" for k, w in enumerate(words)]
    items = [(10, " ".join(words[:10])), (11, " ".join(words[:11])), (60, " ".join(words)), (9, " ".join(words[:9]))]
    docs = [(0, " ".join(["a", *words[:10], "b"]), None, None), (1, " ".join(["a", *words[:11], "b"]), None, None), (2, " ".join(fifth), None, None)]
    got = decontam.overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in got.collect()} == {(0, 10): 10, (0, 11): 10, (0, 60): 10, (1, 10): 10, (1, 11): 11, (1, 60): 11, (2, 60): 26, (0, 9): 9, (1, 9): 9}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_texts_that_repeat_themselves(spark, limit):
    docs = [(1, "again " * 20_000, None, None), (2, "ha ho " * 10_000, None, None), (3, "x " * 30 + "again " * 19 + "y", None, None), (4, "ho ha " * 8, None, None)]
    items = [(1, "again " * 20), (2, "ha ho " * 12), (3, "again"), (4, "again " * 9), (5, "x again again")]
    got = decontam.overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=limit)
    assert {(r.doc_id, r.item_id): r.score for r in got.collect()} == {(1, 1): 20, (1, 3): 1, (1, 4): 9, (2, 2): 24, (3, 1): 19, (3, 3): 1, (3, 4): 9, (3, 5): 3, (4, 2): 16}


def test_clean_namesakes_of_a_leak_stay(spark):
    item = " ".join(f"t{k}" for k in range(20))
    docs = [(None, item, None, None), (None, "clean one", None, None), (7, f"it says {item}", None, None), (7, "clean two", None, None), (8, None, None, None), (None, None, None, None)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], "item_id long, text string")
    for limit in (500_000, 0):
        kept = decontam.decontaminate(df, bench, limit).collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, "clean one"), (7, "clean two"), (8, None), (None, None)], key=str)


def test_licences(spark):
    mit = "\n\n".join([*licenses.SENTENCES["mit-title"][:1], "Copyright (c) 2020 Somebody", licenses.SENTENCES["mit-grant"][0].replace("copies of", "copies\nof"), licenses.SENTENCES["mit-notice"][0], licenses.SENTENCES["mit-asis"][0]])
    bsd = " ".join(licenses.SENTENCES[k][0] for k in ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse"))
    texts = [None, "", "nothing here.", "Text. Released under the MIT License.\nMore", mit, bsd, bsd.rpartition("Neither")[0], "LICENSED   under the Apache license,\nversion 2.0. All rights reserved.", "licence of no kind"]
    df = spark.createDataFrame([(k, t, None, "x") for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.licences, r.sentence_ids) for r in licenses.scan_licenses(df).collect()}
    assert [got[k][0] for k in range(9)] == [[], [], [], ["MIT"], ["MIT"], ["BSD-3-Clause"], ["BSD-2-Clause"], ["All-Rights-Reserved", "Apache-2.0"], []]
    assert got[3][1] == ["mit-under"] and got[5][1] == ["bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse"]
    assert {x for _, rule in licenses.RULES for x in rule} <= set(licenses.SENTENCES)
    assert all(any(h in word for h in licenses.HINTS for word in s.split()) for s in licenses.known())
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_each_rule_matches_its_own_text(spark):
    cut = r"(?<=[.!?;:])[ \t\r\n\f]+"
    assert all(len(re.split(cut, s)) == 1 for all_of in licenses.SENTENCES.values() for s in all_of)
    texts = [(licence, "\n".join(licenses.SENTENCES[x][0] for x in rule)) for licence, rule in licenses.RULES]
    gpl = "# This program is free software{} you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation{} "
    later = "either version {} of the License, or\n# (at your option) any later version.\n"
    texts += [("GPL-3.0-or-later", gpl.format(":", ",") + later.format(3)), ("GPL-2.0-or-later", gpl.format(";", ";") + later.format(2))]
    texts += [("GPL-2.0", gpl.format(";", ";") + "version 2 of the License.\n"), ("", gpl.format(";", ";") + "some version.")]
    texts += [("LGPL-2.1-or-later", gpl.format(";", ";").replace("GNU General", "GNU Lesser General") + later.format("2.1")), ("AGPL-3.0-or-later", gpl.format(":", ",").replace("GNU General", "GNU Affero General") + later.format(3))]
    texts += [("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("MIT", "// SPDX-License-Identifier: MIT\ncode();"), ("GPL-2.0-only", "/* SPDX-License-Identifier: GPL-2.0-only */"), ("", "MIT"), ("", "SPDX-License-Identifier: none")]
    texts += [("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at http://mozilla.org/MPL/2.0/.")]
    got = licenses.scan_licenses(spark.createDataFrame([(k, t, None, "x") for k, (_, t) in enumerate(texts)], DOCS)).collect()
    assert [",".join(r.licences) for r in sorted(got)] == [x for x, _ in texts]


def test_licences_agree_with_the_sql(spark):
    import duckdb
    from lumisift.llm import queries

    texts = [None, "", "All rights\nreserved.", "All  rights   reserved", "ALL-RIGHTS-RESERVED", "SPDX-License-Identifier: MIT", "MIT", "some text; no licence: here"]
    texts += ["\n".join(x for k in rule for x in licenses.SENTENCES[k]) for _, rule in licenses.RULES]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = {r[0]: r[1:] for r in c.sql("SELECT doc_id, licences, sentence_ids FROM (" + queries.ORACLE_SQL["op3_license_rules"] + ")").fetchall()}
    got = licenses.scan_licenses(spark.createDataFrame([(k, t, None, "x") for k, t in enumerate(texts)], DOCS)).collect()
    assert {r.doc_id: (",".join(r.licences), ",".join(r.sentence_ids)) for r in got} == want


def test_rights_reserved_over_two_lines(spark):
    texts = ["All rights\nreserved.", "ALL-RIGHTS-RESERVED", "All  rights   reserved", "rights reserved"]
    got = licenses.scan_licenses(spark.createDataFrame([(k, t, None, "x") for k, t in enumerate(texts)], DOCS)).collect()
    assert [r.licences for r in sorted(got)] == [["All-Rights-Reserved"]] * 3 + [[]]


def plain_targets(sizes, weights, cap=3):
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        whole = sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * left / whole > cap * sizes[s]]
        if not over:
            out |= {s: weights[s] * left / whole for s in open_}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
        open_ -= set(over)
        left = sum(sizes.values()) - sum(out.values())
    return out


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 900]))), rng.choice(["é", "a", "b", "c", "Z", None, "a"]), "x") for k in range(300)]
    rows += [(400, None, "nul", "x"), (401, "one", "tiny", "x"), (None, "two words", "a", "x"), *rows[:4]]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    weights = {s: [5, 2, 1][k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    want, taken = plain_targets(sizes, weights), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0
    copies = mixing.copies(mixing.mix(df)).collect()
    assert sum(r.words for r in copies) == sum(taken.values()) and all(0 < r.words <= r.size for r in copies)
    for source in sizes:  # the demand of a source is met in order
        own = sorted((r.copy, r.start_at, r.position) for r in copies if r.source == source)
        assert [x[2] for x in own] == sorted(x[2] for x in own)


def test_rows_that_share_an_id_spread(spark):
    """Many rows without an id, many of them equal: ranges stay even, sums stay right."""
    from lumisift.llm import common

    rows = spark.range(300_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same words here' ELSE concat('text ', id % 1000) END AS text", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 < 9 THEN 'b' END AS source", "1 AS part", "2 AS tie")
    got = mixing.mix(rows).groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.max("source_size").alias("whole"), F.max("target").alias("target")).collect()
    assert {r.source: r.n for r in got} == {"hot": 210_000, "b": 60_000, None: 30_000}
    assert all(r.size == r.whole and abs(r.taken - r.target) <= 1 for r in got)
    dealt = common.in_ranges(rows.select("doc_id", F.xxhash64("text").alias("a"), F.monotonically_increasing_id().alias("b")), [F.col("doc_id"), F.col("a"), F.col("b")], "test", each=20_000)
    assert max(r["count"] for r in dealt.groupBy("part").count().collect()) <= 60_000


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:04d}": (k * 7919) % 1000 for k in range(2000)} | {"n": 17}
    got = {r.skey: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "skey string, source_size long")).collect()}
    weights = {s: [5, 2, 1][k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s == "n", s)))}
    want = plain_targets(sizes, weights)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)


def test_positions_follow_the_schedule(spark):
    knots = ((0.0, 0.0), (0.5, 1.0), (1.0, 2.0))
    shares = spark.range(0, 101).select((F.col("id") / 100).alias("s"))
    for s, t in shares.select("s", mixing.inverted(knots, F.col("s"))).collect():
        assert t * t == pytest.approx(s, abs=1e-9)  # the integral of 2t


def test_chat_round_trip_and_turn_order(spark):
    odd = ["", "\\", "\\b<>\\l", "</turn>\n", "<turn user>\nhi", "a\n</turn>", None, "é</turn>\n\n"]
    rows = []
    for k, roles in enumerate([["user", "assistant"], ["system", "user", "assistant", "user", "assistant"], ["assistant"], ["user", "user"], ["user", "assistant", "tool", "assistant"], [None, "we<ird>\n"], ["user"]]):
        rows += [(k, t, r, odd[(k + t) % len(odd)], "x") for t, r in enumerate(roles)]
    rows += [(None, 0, "user", "x", "x"), (None, 1, "assistant", "y", "x"), (9, None, "user", "q", "x"), (9, None, "user", "q", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    done = chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    by = {r.conv_id: r for r in done}
    assert len(done) == len(by) == 9
    for k in by:
        own = sorted([(-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == k])
        assert [(t.role, t.text) for t in by[k].back] == [x[1:] for x in own]
        assert by[k].loss == "".join(x[2] for x in own if x[1] == "assistant")
        assert "".join(s.text for s in by[k].segments) == by[k].formatted
    assert {k for k in by if by[k].valid} == {0, 1, 4, None}
    assert chat.format_conversations(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
