"""Spelling variants: all pairs of words one edit apart, by merging light subtrees of the trie of words with one character skipped or replaced.

Two words one edit apart part at one node of the trie, after their longest common prefix P: one goes on with c and a rest s, the other with another
character. Heavy-path decomposition lets each node's largest subtree alone and merges the others into it (small-to-large; Cole, Gottlieb and
Lewenstein, STOC 2004), so a word is carried over only at the O(log words) nodes at which it lies in a light subtree. There the word P c s, a being the
first character of the heavy subtree, becomes

* P s, its character skipped (where s does not begin with c: else the words part later), which meets any word of that spelling;
* P a c s and P a s, the heavy path's character put before its own or in its place, which meet words of the heavy subtree;
* P ? s, its character replaced by any, which meets the same entry of another light subtree.

Entries whose terminals coincide are the one-edit pairs, each found once: at the node where it parts.

On Spark: sorted ranges of the distinct words, each small enough for a task, hold whole subtrees but for nodes on their edges. A node that several ranges share
is named by its depth and its first boundary; each range counts its children there, the sums give its heavy child, and those few nodes (as many as neighbouring
ranges have common prefix) are sent to all. Entries join the words by spelling. Rows of `?` entries of one spelling differ in one character, so they are as
many as the alphabet at most. Roots come by doubling pointers, and rows whose pointer has no form any more leave the rounds.

Defined cases: a null text has no words, a null doc_id is hashed as empty text, repeated rows count each time, an empty table gives no rows, columns besides doc_id
and text are ignored, a text's or word's length is not bounded (neighbouring ranges share the driver's memory with their first and last words).
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, in_ranges, materialise, ship, small_batches

ship(__name__)

RUN, UPPER, LOWER, ANY = r"([A-Za-zÀ-ÿ]+)", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "?"
#: One run in so many, by hash, loses a code point.
SLIPS, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: A form is used so many times as often as its variant. Words and ranges: a range holds about so many, and there are at least so many.
TIMES, RANGE_WORDS, LEAST_RANGES = 2, 50_000, 24


def slipped(doc_id: Column, run: Column) -> Column:
    """The lower-cased run; where the hash of doc_id and run says so, without one code point."""
    low = F.translate(run, UPPER, LOWER)
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low))
    at = (h % F.length(low)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(F.substring(low, F.lit(1), at), F.substring(low, at + 2, F.length(low)))).otherwise(low)


def vocabulary(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (word, n): words of enough code points and occurrences."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(1))).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    words = runs.select(slipped(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while low < n and a[low] == b[low]:
        low += 1
    return low


class Edges:
    """What neighbouring ranges share: boundary b lies between ranges b and b + 1, and `shared[b]` is the common prefix of the words beside it.

    A node of depth d that a boundary cuts is named (b, d) by the first boundary that cuts it.
    """

    def __init__(self, ends: list[tuple[int, str, str]]):
        self.place = {part: k for k, (part, _, _) in enumerate(ends)}
        self.inside = [common(first, last) for _, first, last in ends]
        self.shared = [common(x[2], y[1]) for x, y in zip(ends, ends[1:])]
        self.first: list[list[int]] = []  # of each boundary, by depth
        for b, top in enumerate(self.shared):
            reach = min(self.shared[b - 1], self.inside[b], top) if b else -1
            self.first.append([self.first[b - 1][d] if d <= reach else b for d in range(top + 1)])

    def cut(self, part: int, words: list[str]) -> list[tuple[tuple[int, int], int, int]]:
        """(name, from, to): the nodes of a range that a boundary cuts, with the places of their words in it."""
        k, out = self.place[part], []
        left = self.shared[k - 1] if k else -1
        right = self.shared[k] if k < len(self.shared) else -1
        for d in range(left + 1):
            high = len(words) if self.inside[k] >= d else bisect_left(words, True, key=lambda w: w[:d] != words[0][:d])
            out.append(((self.first[k - 1][d], d), 0, high))
        for d in range(right + 1):
            if d > left or self.inside[k] < d:
                out.append(((self.first[k][d], d), bisect_left(words, words[-1][:d]), len(words)))
        return out


def inner_nodes(words: list[str]) -> list[tuple[int, int, int, list[int]]]:
    """(depth, from, to, starts of its children): the branching nodes of the trie of sorted distinct words."""
    out, stack = [], [[0, 0, [0]]] if words else []  # (depth, from, starts); lower entries are ancestors
    for k in range(1, len(words) + 1):
        shared = common(words[k - 1], words[k]) if k < len(words) else -1
        start = k - 1
        while stack and stack[-1][0] > shared:
            depth, start, starts = stack.pop()
            if len(starts) > 1:
                out.append((depth, start, k, starts))
        if k == len(words):
            break
        if stack and stack[-1][0] == shared:
            if stack[-1][2][-1] != k:
                stack[-1][2].append(k)
        else:
            stack.append([shared, start, [start, k]])
    return out


def child(word: str, depth: int) -> str:
    """The character by which a word leaves a node; empty where it ends there."""
    return word[depth : depth + 1]


def carried(words: list[str], cut: list[tuple[tuple[int, int], int, int]], heavy: dict[tuple[int, int], str]):
    """(place of a word, depth, heavy character) for every node at which the word lies in a light subtree."""
    ours = {(d, low, high) for (_, d), low, high in cut}
    for depth, low, high, starts in inner_nodes(words):
        if (depth, low, high) in ours:
            continue
        sizes = [b - a for a, b in zip(starts, [*starts[1:], high])]
        most = max(range(len(starts)), key=lambda j: (sizes[j], -j))
        char = child(words[starts[most]], depth)
        for j, (a, n) in enumerate(zip(starts, sizes)):
            if j != most:
                for k in range(a, a + n):
                    yield k, depth, char
    for (b, depth), low, high in cut:
        char = heavy.get((b, depth))
        if char is not None:
            for k in range(low, high):
                if child(words[k], depth) != char:
                    yield k, depth, char


def entries(word: str, depth: int, char: str):
    """(spelling, whether it holds ANY) of the entries that a word makes at a node with that heavy character."""
    head, own, rest = word[:depth], word[depth : depth + 1], word[depth + 1 :]
    if char:
        yield head + char + own + rest, False
    if own:
        if rest[:1] != own:
            yield head + rest, False
        if char:
            yield head + char + rest, False
        yield head + ANY + rest, True


def merged(words: DataFrame) -> DataFrame:
    """words(word, n), distinct -> (spelling, wild, word, n): the entries of all words."""
    spark = words.sparkSession
    ranged = in_ranges(words, [F.col("word")], "errata-ranges", LEAST_RANGES, RANGE_WORDS)
    ends = Edges(sorted(tuple(r) for r in ranged.groupBy("part").agg(F.min("word"), F.max("word")).collect()))  # a row a range
    edges = Shared(spark, "errata-edges", ends)

    def counted(group):
        import pyarrow as pa

        words = sorted(group.column("word").to_pylist())
        rows = []
        for (b, d), low, high in edges.value.cut(group.column("part")[0].as_py(), words):
            sizes: dict[str, int] = {}
            for k in range(low, high):
                own = child(words[k], d)
                sizes[own] = sizes.get(own, 0) + 1
            rows += [(b, d, own, n) for own, n in sizes.items()]
        b, d, own, n = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"b": pa.array(b, pa.int32()), "d": pa.array(d, pa.int32()), "own": pa.array(own, pa.string()), "n": pa.array(n, pa.int64())})

    sizes = ranged.groupBy("part").applyInArrow(counted, "b int, d int, own string, n long").groupBy("b", "d", "own").agg(F.sum("n").alias("n"))
    best = sizes.groupBy("b", "d").agg(F.min_by("own", F.struct(-F.col("n"), F.col("own"))).alias("own"), F.count("*").alias("children")).where("children > 1")
    heavy = Shared(spark, "errata-heavy", {(r.b, r.d): r.own for r in best.collect()})  # nodes on the edges of ranges

    def carry(group):
        import pyarrow as pa

        of = dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist()))
        words = sorted(of)
        spelling, wild, word = [], [], []
        for k, depth, char in carried(words, edges.value.cut(group.column("part")[0].as_py(), words), heavy.value):
            for said, some in entries(words[k], depth, char):
                if some or len(said) >= LEAST_LENGTH:
                    spelling.append(said), wild.append(some), word.append(words[k])
        return pa.table({"spelling": pa.array(spelling, pa.string()), "wild": pa.array(wild, pa.bool_()), "word": pa.array(word, pa.string()), "n": pa.array([of[w] for w in word], pa.int64())})

    return ranged.groupBy("part").applyInArrow(carry, "spelling string, wild boolean, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """words(word, n) -> (word, n_near, form, form_n): of each word with a near one, their number and the most frequent (ties: the smallest)."""
    all_ = materialise(merged(words), "errata-entries")
    best = lambda n, w: F.struct((-F.col(n)).alias("n"), F.col(w).alias("word")).alias("best")
    met = all_.where(~F.col("wild")).join(words.select(F.col("word").alias("spelling"), F.col("n").alias("m")), "spelling")
    sides = F.array(F.struct(F.col("word").alias("word"), best("m", "spelling")), F.struct(F.col("spelling").alias("word"), best("n", "word")))
    pairs = met.select(F.explode(sides).alias("s")).select("s.word", F.lit(1).cast("long").alias("near"), "s.best")
    groups = all_.where("wild").groupBy("spelling").agg(F.array_sort(F.collect_list(best("n", "word"))).alias("all")).where(F.size("all") > 1)  # one a letter at most
    own = groups.select("all", F.posexplode("all").alias("at", "own"))
    swapped = own.select(F.col("own.word").alias("word"), (F.size("all") - 1).cast("long").alias("near"), F.when(F.col("at") == 0, F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0))).alias("best"))
    near = pairs.unionByName(swapped).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return near.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def followed(forms: DataFrame) -> DataFrame:
    """forms(word, form), without circles -> (word, root): where following forms ends."""
    known = materialise(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")), "errata-roots")
    while not known.where("NOT done").isEmpty():
        to = known.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("done").alias("ends"))
        on = known.where("NOT done").join(to, "root", "left")
        moved = on.select("word", F.coalesce("next", "root").alias("root"), F.coalesce("ends", F.lit(True)).alias("done"))
        known = materialise(known.where("done").unionByName(moved), "errata-roots")
    return known.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (word, form, root, n, n_near, form_n), one row a word."""
    small_batches(docs.sparkSession)
    words = materialise(vocabulary(docs.select("doc_id", "text")), "errata-words")
    near = words.join(near_words(words), "word", "left")
    far = F.col("form_n") >= TIMES * F.col("n")  # null where nothing is near
    known = materialise(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")), "errata-forms")
    roots = followed(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
