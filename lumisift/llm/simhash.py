"""SimHash near-duplicates through Golay-code keys.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay
code (23, 12). The keys of a segment are the codewords within 4 bits of it: one, or six where the nearest lies 3 away. Two
segments that differ in at most 2 bits share a key: the codeword nearest to a word halfway is within 4 of both. Of 4
errors in three segments the two least hit segments have at most 2 together, so fingerprints within 4 bits share a
key pair in one of the three pairs of segments. Keys are joined and every candidate verified; nothing is missed.

Equal fingerprints are merged first (partial sums before the shuffle), so copies cost nothing later. In a bucket, links are
found as a spanning forest: big buckets by growing from a seed over what is not yet reached, so a bucket of m emits at most
m-1 links. A bucket of more than BIG is cut into blocks, and each pair of its blocks is a bucket of its own, so that tasks share it and each
two members still meet; which buckets are big is estimated on a part of the fingerprints, and decides nothing but how work is dealt.
Components come from `graph.components`.

`near_copies` asks for a similarity of the texts themselves: fingerprints are of five-word shingles, and what shares keys is verified on the
shingles. Texts of similarity 0.8 differ in ten of the 64 bits on average, far beyond what the keys are complete for, so `shingles` adds
candidates, and verifies all of them.

Hashing and popcounts run in Arrow batches with numpy and xxhash.

Defined cases: null or empty text has fingerprint zero and links like any other; repeated rows stay, each with its
component; an empty table gives no rows; a null doc_id takes part, but never names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, small_batches, tidied, worker_cache
from .graph import components

ship(__name__)

SHINGLE, SEED, MAX_BITS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: the generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
_SMALL = 48
#: Buckets above BIG are split; one fingerprint in PART, by hash, is looked at to find them; the list is broadcast up to LISTED keys.
BIG, PART, LISTED = 16_384, 16, 500_000


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split() if text else []  # of bytes: only A-Z change, only ASCII white space splits
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """64 bits: those set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            found = np.fromiter((fingerprint_of(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    left = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        left ^= ((left >> bit) & 1) * (GENERATOR << (bit - 11))
    return left


def golay_table() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of weight 4 at most (six places), and how many there are."""
    from itertools import combinations

    patterns = np.array([sum(1 << b for b in bits) for k in range(5) for bits in combinations(range(23), k)], dtype=np.int64)
    table, used = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for s, e in zip(syndrome(patterns).tolist(), patterns.tolist()):
        table[s, used[s]] = e
        used[s] += 1
    return table, used


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of the codewords within 4 bits of each word, and which places count."""
    table, used = worker_cache("golay", golay_table)
    s = syndrome(words)
    return (words[:, None] ^ table[s]) >> 11, np.arange(6) < used[s][:, None]  # twelve neighbouring bits name a codeword


def key_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and the index of the fingerprint each belongs to."""
    parts = [golay_keys(((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    keys, rows = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, ua), (b, ub) = parts[i], parts[j]
        used = ua[:, :, None] & ub[:, None, :]
        both = (pair << 24) | (a[:, :, None] << 12) | b[:, None, :]
        keys.append(both[used])
        rows.append(np.nonzero(used)[0])
    return np.concatenate(keys), np.concatenate(rows)


def forest(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within `bits` that connect what is connected among distinct members."""
    left, a, b = members, [], []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                new = left[near]
                a.append(np.full(len(new), at)), b.append(new)
                reached.extend(new)
                left = left[~near]
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links_of(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys; rows are sorted by key."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    sizes, a, b = ends - starts, [], []
    small = np.repeat(sizes <= _SMALL, sizes)
    for step in range(1, min(_SMALL, int(sizes.max())) if len(sizes) else 0):
        at = np.flatnonzero((keys[:-step] == keys[step:]) & small[:-step])
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= bits]
        a.append(fps[near]), b.append(fps[near + step])
    for s, e in zip(starts[sizes > _SMALL], ends[sizes > _SMALL]):
        x, y = forest(np.unique(fps[s:e]), bits)
        a.append(x), b.append(y)
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """distinct(fp) -> (u, v): enough links within `bits` (4 at most) to connect all that are connected."""
    if bits > MAX_BITS:
        raise ValueError("the keys are complete up to 4 bits")

    def expand(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                block = fps[at : at + 4096]
                keys, rows = key_rows(block)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(block[rows].view(np.int64))], names=["key", "fp"])

    def match(batches: Iterator):
        import pyarrow as pa

        def said(a, b):
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["u", "v"])

        keys, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        held: list = []  # of the last key, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if held and held[-1][0][0] == k[0] == k[-1]:
                held.append((k, f))
                continue
            keys, fps = np.concatenate([x[0] for x in held] + [k]), np.concatenate([x[1] for x in held] + [f])
            last = int(np.searchsorted(keys, keys[-1]))
            held = [(keys[last:], fps[last:])]
            if last:
                yield said(*links_of(keys[:last], fps[:last], bits))
        if held:
            yield said(*links_of(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), bits))

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(match), "u long, v long")

    def keyed(fps: DataFrame) -> DataFrame:
        return fps.mapInArrow(tidied(expand), "key long, fp long")

    fps = distinct.select("fp")
    looked = keyed(fps.where(F.pmod(F.xxhash64("fp"), F.lit(PART)) == 0)).groupBy("key").agg((F.count("*") * PART).alias("n"))
    big = materialise(looked.where(F.col("n") > BIG).select("key", F.ceil(F.col("n") * 2 / BIG).cast("int").alias("blocks")), "simhash-big")
    listed = big.count()
    if not listed:
        return met(keyed(fps))
    known = F.broadcast(big) if listed <= LISTED else big
    split = keyed(fps).join(known, "key").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "fp"), "blocks").cast("int"))
    other = split.select("key", "fp", "own", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = other.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    return met(keyed(fps).join(known, "key", "left_anti").unionByName(pairs))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = MAX_BITS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    each = materialise(fingerprints(docs, shingle, seed), "simhash")
    first = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = components(links(first, bits))
    rooted = found.join(first.withColumnRenamed("fp", "u"), "u").select("root", "u", "first")
    roots = found.select("root").distinct().join(first.withColumnRenamed("fp", "root"), "root").select("root", F.col("root").alias("u"), "first")
    grouped = rooted.unionByName(roots)
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    named = grouped.join(least, "root").select(F.col("u").alias("fp"), "least")
    # written, so that the last join has an exchange on both sides and Spark can split a fingerprint that many documents share
    names = materialise(first.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-names")
    return each.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(texts: DataFrame) -> DataFrame:
    """texts(row_key, text), equal keys having equal texts -> row_key, component: equal for texts of a similarity of 0.8 or more on five-word shingles, directly or by way of others."""
    from . import shingles

    signed = shingles.signed(texts)
    return shingles.grouped(texts, signed, lambda distinct: linked(distinct.select("fp", "sig")))


def linked(named: DataFrame) -> DataFrame:
    """named(fp, sig) -> (u, v): sigs whose fingerprints are equal or within MAX_BITS, each with the least of its fingerprint, and those with each other."""
    least = materialise(named.groupBy("fp").agg(F.min("sig").alias("least")), "simhash-least")
    same = named.join(least, "fp").where(F.col("sig") != F.col("least")).select(F.col("sig").alias("u"), F.col("least").alias("v"))
    near = links(least).join(least.select(F.col("fp").alias("u"), F.col("least").alias("x")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("y")), "v")
    return same.unionByName(near.select(F.col("x").alias("u"), F.col("y").alias("v")))
