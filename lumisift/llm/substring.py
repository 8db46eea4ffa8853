"""Substring dedup by relative Lempel-Ziv parsing.

The reference is every document: its text is indexed by blocks, where a block is a run of windows (50 consecutive words) that share
an anchor, the least 26-word hash among the 25 in a window. Equal windows pick equal anchors, so what a block can match
lies under its anchor's key. The index gives, for each window, the earliest document (smallest doc_id, then place) in which it starts; what
continues there on the same diagonal is one match. A document is then parsed greedily from left to right: at each word the longest match
that covers it is taken as a factor, and parsing goes on at the first matched window that the factor does not hold. That window
may start before the factor's end, so words across a factor's boundary are looked up like any others and none is lost there. Factors have 50
words or more and become duplicate spans; a document's repeats of itself are factors that refer to it.

A match found in one group of texts is settled there, so a group gives a window once; the rest meets in a shuffle by anchor key. Blocks are
counted by key beforehand, with partial sums: a key with HOT_ROWS or more is hot (the MOST_HOT largest, if there are more, which bounds the
list that workers are given and the rows of any other key). Windows under hot keys are not dealt by key. They are spread evenly, and
the earliest place of each is found by partial minima and joined back, a join in which Spark splits large keys; so no task gathers one key's rows.

A window is known by 128 hash bits (64 of its anchor, 64 of its own); windows are judged on the input.
Words are runs of other than ASCII white space, unchanged. Hashing is numpy over whole batches.

Defined cases: null text has no words; a null doc_id is neither judged nor a reference; rows with equal doc_id don't judge each
other; other columns are ignored, whatever their names; an empty table gives no rows; a text of fewer than 50 words is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, materialise, ship, small_batches, tidied, worker_cache

ship(__name__)

WINDOW, GRAM, HASH_BYTES = 50, 26, 8
GROUP_BYTES, SEGMENT_WORDS, HOT_ROWS, MOST_HOT = 800_000, 150_000, 4096, 1_000_000
COLD, FACTOR, HOT = 1, 2, 3
ROW = "key long, kind int, doc_id long, meta long, data binary"
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (the splitmix64 constants)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**k modulo 2**64 for k below n. A worker keeps the longest run asked for, so its memory follows GROUP_BYTES."""
    kept = worker_cache("powers", dict)
    if base not in kept or len(kept[base]) < n:
        out = np.full(max(n, 1 << 16), base, dtype=_U)
        out[0] = 1
        kept[base] = np.multiply.accumulate(out)
    return kept[base][:n]


#: Two odd multipliers.
BYTE_BASE, WORD_BASE = 0x9E6C63D0876A9A47, 0xD1342543DE82EF95


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[starts:ends], from one running sum."""
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(pow(base, -1, 1 << 64), len(values) + 1)[starts]


def words_at(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text, and where its words start and end."""
    arr = np.frombuffer(buffer, dtype=np.uint8)
    inside = np.concatenate(([False], ~((arr == 32) | ((arr >= 9) & (arr <= 13))), [False]))
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    return arr, turn[::2], turn[1::2]


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where it starts."""
    arr, starts, ends = words_at(buffer)
    raw = span_hashes(arr.astype(_U) + _U(1), starts, ends, BYTE_BASE)
    return mixed(raw ^ ((ends - starts).astype(_U) << _U(40))), starts


def long_hashes(buffer: bytes) -> np.ndarray:
    """As word_hashes, in slices that end at white space."""
    out, at = [], 0
    while at < len(buffer):
        end = min(len(buffer), at + GROUP_BYTES)
        while end < len(buffer) and buffer[end] not in b" \t\n\v\f\r":
            end += 1
        out.append(word_hashes(buffer[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=_U)


def anchors(grams: np.ndarray) -> np.ndarray:
    """For each place, where the least of WINDOW-GRAM+1 grams from there on stands, the leftmost if several."""
    width = WINDOW - GRAM + 1
    value, place, have = grams, np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        a, b = value[: len(value) - step], value[step:]
        left = a <= b
        value, place = np.where(left, a, b), np.where(left, place[: len(place) - step], place[step:])
        have += step
    return place


def factors_of(row: np.ndarray, at: np.ndarray, ref_row: np.ndarray, ref_doc: np.ndarray, ref_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors over matched windows sorted by (row, at): where each begins, and its number of windows."""
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    goes_on = (np.diff(row) == 0) & (np.diff(at) == 1) & (np.diff(ref_row) == 0) & (np.diff(ref_doc) == 0) & (np.diff(ref_at) == 1)
    first = np.concatenate(([0], np.flatnonzero(~goes_on) + 1))
    return first, np.diff(np.concatenate((first, [len(at)])))


def factor_data(n: np.ndarray, ref_doc: np.ndarray, ref_at: np.ndarray) -> np.ndarray:
    return np.stack([n.astype("<i8"), ref_doc.astype("<i8"), ref_at.astype("<i8")], axis=1).view(np.uint8).reshape(len(n), 24)


def earliest(order_keys: tuple, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows: which stand in an earlier document too, and the index of the earliest place of each."""
    order = np.lexsort((at, tag, doc, *order_keys))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in order_keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    first = np.zeros(len(order), dtype=np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return doc > doc[first], first


def binary(offsets: np.ndarray, data: np.ndarray):
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def record(key, kind, doc, meta, column):
    import pyarrow as pa

    whole = lambda x, t: pa.array(np.ascontiguousarray(x), t)
    return pa.RecordBatch.from_arrays([whole(key.view(np.int64), pa.int64()), whole(kind.astype(np.int32), pa.int32()), whole(doc, pa.int64()), whole(meta, pa.int64()), column], names=["key", "kind", "doc_id", "meta", "data"])


def factor_rows(row, doc, tag, at, ref_doc, ref_row, ref_at):
    """FACTOR rows of matched windows sorted by (row, at)."""
    first, n = factors_of(row, at, ref_row, ref_doc, ref_at)
    data = factor_data(n, ref_doc[first], ref_at[first])
    meta = (tag[first] << 32) | at[first]
    return record(mixed(doc[first].view(_U) ^ meta.view(_U)), np.full(len(first), FACTOR), doc[first], meta, binary(np.arange(len(first) + 1) * 24, data))


def windows_in(words: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows within one document start, the hashes of all runs of GRAM words, and which of them is each window's anchor."""
    n = len(words)
    if n < WINDOW:
        return (np.zeros(0, dtype=np.int64),) * 3
    at = np.arange(n - WINDOW + 1)
    whole = at[doc_of[: n - WINDOW + 1] == doc_of[WINDOW - 1 :]]
    every = np.arange(n - GRAM + 1)
    grams = mixed(span_hashes(words, every, every + GRAM, WORD_BASE))
    return whole, grams, anchors(grams)[whole]


def block_counts(words: np.ndarray, doc_of: np.ndarray, *_) -> Iterator:
    """(key, blocks) of one group, before anything is settled."""
    import pyarrow as pa

    whole, grams, anchor = windows_in(words, doc_of)
    if len(whole):
        begins = np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(whole) != 1)))
        keys, n = np.unique(grams[anchor[begins]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


def group_rows(words: np.ndarray, doc_of: np.ndarray, place: np.ndarray, docs: np.ndarray, tags: np.ndarray, hot: np.ndarray) -> Iterator:
    """Rows for one group: words' hashes, the document index and the place in it of each. hot: sorted keys."""
    whole, grams, anchor = windows_in(words, doc_of)
    if not len(whole):
        return
    own = mixed(span_hashes(words, whole, whole + WINDOW, WORD_BASE) ^ _U(0x5851F42D4C957F2D))
    row = doc_of[whole]
    doc, tag, pos = docs[row], tags[row], place[whole]
    # settle what an earlier document of this group already has
    again, first = earliest((own,), doc, tag, pos)
    key = grams[anchor]
    alike = key == key[first]  # both hashes must agree
    again &= alike
    if again.any():
        hit = np.flatnonzero(again)
        ref = first[hit]
        yield factor_rows(row[hit], doc[hit], tag[hit], pos[hit], doc[ref], row[ref], pos[ref])
    # a document's own repeats are looked up once: factors that refer to the document itself say what else that settles
    own_repeat = ~again & alike & (first != np.arange(len(first))) & (row[first] == row)
    if own_repeat.any():
        hit = np.flatnonzero(own_repeat)
        ref = first[hit]
        yield factor_rows(row[hit], doc[hit], tag[hit], pos[hit], doc[ref], row[ref], pos[ref])
    keep = ~(again | own_repeat)
    if not keep.any():
        return
    whole, anchor, own, doc, tag, pos, key = (x[keep] for x in (whole, anchor, own, doc, tag, pos, key))
    is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else np.zeros(len(key), dtype=bool)
    if is_hot.any():
        where = (tag << 32) | pos
        window = np.stack([key, own], axis=1)[is_hot]
        yield record(mixed(own[is_hot] ^ mixed(doc[is_hot].view(_U) ^ where[is_hot].view(_U))), np.full(len(window), HOT), doc[is_hot], where[is_hot], binary(np.arange(len(window) + 1) * 16, window.view(np.uint8)))
        whole, anchor, own, doc, tag, pos, key = (x[~is_hot] for x in (whole, anchor, own, doc, tag, pos, key))
    if len(whole):
        begins = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(whole) != 1))))
        sizes = np.diff(np.concatenate((begins, [len(whole)])))
        data = own.view(np.uint8).reshape(-1, 8)
        yield record(key[begins], np.full(len(begins), COLD), doc[begins], (tag[begins] << 32) | pos[begins], binary(np.concatenate(([0], np.cumsum(sizes))) * HASH_BYTES, data))


def index_rows(batches: Iterator, rows=group_rows, *more) -> Iterator:
    """doc_id, text, tag -> what `rows` gives for each group of texts."""
    for batch in batches:
        ids, texts, tags = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        known = np.array([x is not None for x in ids.to_pylist()], dtype=bool)
        docs = np.array([x or 0 for x in ids.to_pylist()], dtype=np.int64)
        group, held = [], 0
        for k in np.flatnonzero(known):
            text = texts[int(k)].as_py()
            if not text:
                continue
            raw = text.encode("utf-8")
            if len(raw) > GROUP_BYTES:
                words = long_hashes(raw)
                for s in range(0, max(1, len(words) - WINDOW + 1), SEGMENT_WORDS):
                    part = words[s : s + SEGMENT_WORDS + WINDOW - 1]
                    yield from rows(part, np.zeros(len(part), dtype=np.int64), np.arange(s, s + len(part)), docs[k : k + 1], tags[k : k + 1], *more)
                continue
            group.append((k, raw))
            held += len(raw)
            if held >= GROUP_BYTES:
                yield from texts_rows(group, docs, tags, rows, *more)
                group, held = [], 0
        if group:
            yield from texts_rows(group, docs, tags, rows, *more)


def texts_rows(group: list, docs: np.ndarray, tags: np.ndarray, rows, *more) -> Iterator:
    words, starts = word_hashes(b"\n".join(raw for _, raw in group))
    edges = np.concatenate(([0], np.cumsum([len(raw) + 1 for _, raw in group])))
    doc_of = np.searchsorted(edges, starts, side="right") - 1
    begin = np.searchsorted(doc_of, np.arange(len(group)))
    at = np.array([k for k, _ in group])
    yield from rows(words, doc_of, np.arange(len(words)) - begin[doc_of], docs[at], tags[at], *more)


class Held:
    """Rows as columns: key, kind, doc, meta, the sizes of their data, and all data in one."""

    def __init__(self, *columns):
        self.key, self.kind, self.doc, self.meta, self.sizes, self.data = self.columns = columns

    @classmethod
    def of(cls, batch):
        data = batch.column(4)
        offsets = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1]
        raw = np.frombuffer(data.buffers()[2], dtype=np.uint8) if data.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        return cls(*(batch.column(k).to_numpy() for k in range(4)), np.diff(offsets).astype(np.int64), raw[offsets[0] : offsets[-1]])

    def __add__(self, other):
        return Held(*(np.concatenate(x) for x in zip(self.columns, other.columns)))

    def cut(self, at: int):
        byte = int(self.sizes[:at].sum())
        return Held(*(x[:at] for x in self.columns[:5]), self.data[:byte]), Held(*(x[at:] for x in self.columns[:5]), self.data[byte:])

    def take(self, rows: np.ndarray):
        """Rows by mask."""
        return Held(*(x[rows] for x in self.columns[:5]), self.data[np.repeat(rows, self.sizes)])


def resolve_rows(batches: Iterator) -> Iterator:
    """Rows sorted by key: settled factors and the windows of hot keys go on, the blocks under one key are resolved."""
    held: list[Held] = []  # whole batches of one key, which may go on in the next
    for batch in batches:
        if not batch.num_rows:
            continue
        got = Held.of(batch)
        if held and held[-1].key[-1] == got.key[0] == got.key[-1]:
            held.append(got)
            continue
        for part in held[::-1]:
            got = part + got
        done, rest = got.cut(int(np.searchsorted(got.key, got.key[-1])))
        held = [rest]
        yield from resolved(done)
    if held:
        got = held[-1]
        for part in held[-2::-1]:
            got = part + got
        yield from resolved(got)


def resolved(rows: Held) -> Iterator:
    onward = rows.kind != COLD
    if onward.any():
        yield said(rows.take(onward))
        rows = rows.take(~onward)
    if not len(rows.key):
        return
    key, doc, meta, row, data = windows(rows)
    own = np.ascontiguousarray(data).view(_U).ravel()
    tag, at = meta >> 32, meta & 0xFFFFFFFF
    again, first = earliest((own, key), doc, tag, at)
    hit = np.flatnonzero(again)
    if len(hit):
        ref = first[hit]
        yield factor_rows(row[hit], doc[hit], tag[hit], at[hit], doc[ref], tag[ref], at[ref])


def windows(rows: Held):
    """Key, doc, meta (of its own place), row and hash bytes of each window."""
    n = rows.sizes // HASH_BYTES
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return rows.key[row], rows.doc[row], rows.meta[row] + step, row, rows.data.reshape(-1, HASH_BYTES)


def said(rows: Held):
    return record(rows.key.view(_U), rows.kind, rows.doc, rows.meta, binary(np.concatenate(([0], np.cumsum(rows.sizes))), rows.data))


def hot_keys(tagged: DataFrame) -> np.ndarray:
    """The keys under which HOT_ROWS blocks or more stand, the MOST_HOT largest if there are more; sorted."""
    counted = tagged.mapInArrow(tidied(lambda b: index_rows(b, block_counts)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "key").limit(MOST_HOT).select("key").toArrow()
    return np.sort(found.column(0).to_numpy().view(_U))


def matches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tag, at, n_words, ref_doc, ref_at: runs of 50 words or more that an earlier document has.

    tag: a hash of the text, to tell rows of equal doc_id apart. Matches of a document may touch or overlap. Where ref_doc is the
    document itself, the words repeat earlier ones of its own, and are duplicates as far as those are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tagged = docs.select("doc_id", "text", F.hash("text").bitwiseAND(0x7FFFFFFF).alias("tag"))
    hot = Shared(spark, "substring-hot", hot_keys(tagged))
    indexed = tagged.mapInArrow(tidied(lambda b: index_rows(b, group_rows, hot.value)), ROW)
    once = materialise(indexed.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(resolve_rows), ROW), "substring")

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            rows = Held.of(batch)
            x = np.ascontiguousarray(rows.data).view("<i8").reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rows.doc, rows.meta >> 32, rows.meta & 0xFFFFFFFF, x[:, 0] + WINDOW - 1, x[:, 1].copy(), x[:, 2].copy())], names=["doc_id", "tag", "at", "n_words", "ref_doc", "ref_at"])

    settled = once.where(F.col("kind") == FACTOR).mapInArrow(tidied(decode), "doc_id long, tag long, at long, n_words long, ref_doc long, ref_at long")
    if not len(hot.value):
        return settled
    windows = once.where(F.col("kind") == HOT).select(F.col("data").alias("window"), "doc_id", "meta")
    # written, so that the join has an exchange on both sides and Spark can split a window that many groups have
    first = materialise(windows.groupBy("window").agg(F.min(F.struct("doc_id", "meta")).alias("first")), "substring-first")
    place = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    again = windows.join(first, "window").where(F.col("doc_id") > F.col("first.doc_id"))
    return settled.unionByName(again.select("doc_id", F.shiftright("meta", 32).alias("tag"), place("meta").alias("at"), F.lit(WINDOW).cast("long").alias("n_words"), F.col("first.doc_id").alias("ref_doc"), place("first.meta").alias("ref_at")))


def parsed(found: list[dict], doc_id: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (at, n_words, ref_doc, ref_at) of a document from its matches; what repeats only the document itself is left out."""
    runs: list[list[int]] = []  # of windows: first, last, ref_doc, where the first stands there
    for at, n, ref, ref_at in sorted((x["at"], x["n_words"] - WINDOW + 1, x["ref_doc"], x["ref_at"]) for x in found):
        runs.append([at, at + n - 1, ref, ref_at])
    before = [r for r in runs if r[2] != doc_id]
    if len(before) < len(runs):  # a repeat is a duplicate as far as what it repeats is
        at, end, ref, ref_at = (np.array(x, dtype=np.int64) for x in zip(*before)) if before else (np.zeros(0, dtype=np.int64),) * 4
        for first, last, _, own_at in (r for r in runs if r[2] == doc_id):
            for k in np.flatnonzero((at <= own_at + last - first) & (end >= own_at)):
                low, high = max(own_at, int(at[k])), min(own_at + last - first, int(end[k]))
                before.append([first + low - own_at, first + high - own_at, int(ref[k]), int(ref_at[k]) + low - int(at[k])])
    lines: dict[tuple[int, int], list[list[int]]] = {}  # by reference and diagonal, where runs that touch are one
    for run in sorted(before):
        line = lines.setdefault((run[2], run[3] - run[0]), [])
        if line and run[0] <= line[-1][1] + 1:
            line[-1][1] = max(line[-1][1], run[1])
        else:
            line.append(list(run))
    todo, out, reached, best = sorted(r for line in lines.values() for r in line), [], -1, None
    k = 0
    while True:
        while k < len(todo) and todo[k][0] <= reached + 1:  # of those that hold the next window, the longest
            if best is None or todo[k][1] > best[1]:
                best = todo[k]
            k += 1
        if best is not None and best[1] > reached:
            start = max(best[0], reached + 1)
            out.append((start, best[1] - start + WINDOW, best[2], best[3] + start - best[0]))
            reached, best = best[1], None if k == len(todo) else best
        elif k < len(todo):
            reached, best = todo[k][0] - 1, None
        else:
            return out


FACTORS = "array<struct<at:bigint,n_words:bigint,ref_doc:bigint,ref_at:bigint>>"


def _factors(docs: DataFrame) -> DataFrame:
    """doc_id, tag, factors, for the rows that have any. A set, as rows repeated exactly have the same matches each."""
    found = matches(docs).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "n_words", "ref_doc", "ref_at")).alias("found")).where(F.exists("found", lambda s: s["ref_doc"] != F.col("doc_id")))

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("at", "n_words", "ref_doc", "ref_at")]))
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            each = [[dict(zip(("at", "n_words", "ref_doc", "ref_at"), x)) for x in parsed(f, d)] for d, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(each, kind)], names=["doc_id", "tag", "factors"])

    return found.mapInArrow(tidied(run), f"doc_id long, tag long, factors {FACTORS}")


def factors(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tag, at, n_words, ref_doc, ref_at: the greedy factors of each document, in no order."""
    return _factors(docs).select("doc_id", "tag", F.inline("factors"))


def cut_text(text: str | None, spans) -> tuple[int, int, bytes]:
    """Words of a text, words removed, and what is kept, joined by one space. spans: at and n_words."""
    words = text.encode("utf-8").split() if text else []
    gone = np.zeros(len(words), dtype=bool)
    for span in spans or ():
        gone[span["at"] : span["at"] + span["n_words"]] = True
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if spans else words)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    return _cut(docs, False)


def dedup_digests(docs: DataFrame) -> DataFrame:
    """As dedup_substrings, with kept_sha256 (hex of kept's UTF-8) for kept."""
    return _cut(docs, True)


def _cut(docs: DataFrame, digest: bool) -> DataFrame:
    spans = _factors(docs).select("doc_id", "tag", F.transform("factors", lambda x: F.struct(x["at"].alias("at"), x["n_words"].alias("n_words"))).alias("spans"))
    tagged = docs.select("doc_id", "text", F.hash("text").bitwiseAND(0x7FFFFFFF).cast("long").alias("tag"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            found = [cut_text(t.as_py(), s.as_py()) for t, s in zip(batch.column(1), batch.column(2))]
            last = [hashlib.sha256(x[2]).hexdigest() if digest else x[2].decode("utf-8") for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(last, pa.string())], names=["doc_id", "n_words", "n_removed", "last"])

    joined = tagged.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(tidied(run), "doc_id long, n_words long, n_removed long, last string").withColumnRenamed("last", "kept_sha256" if digest else "kept")
