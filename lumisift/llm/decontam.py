r"""Benchmark decontamination by spaced-seed hashing.

Native: DataFrame functions only. Tokens are runs of letters and digits, lower-cased. A seed looks at a few tokens in a row through a fixed
mask that ignores some of them, so a substituted token under an ignored place does not hide a match. The masks are chosen so that no
stretch that scores enough is without a seed, wherever its substitutions lie (the tests go through all of them). Seeds of the benchmark,
one at each place and mask, are joined with those of the documents. Each hit names a diagonal, the item laid on the document, which is
verified on the tokens themselves: a token that agrees scores 1, one that does not -PENALTY, and the best stretch must score SCORE or
more, so ten tokens in a row, or fourteen of sixteen. An item of fewer tokens has one seed, of all of them, and must stand there whole.

A document is tokenised once, before the join. Of a run of hits on one diagonal the first is scored, over no more than the item's length, and
of diagonals next to each other under which the document says the same, the first; so a text that repeats itself costs its length
times the item's at worst, and in practice little.

The benchmark side is broadcast if its seeds number at most BROADCAST_ROWS, which bounds its tokens too. Beyond that the seeds meet in a
shuffled join, in which Spark splits hot keys; hits are then laid on the tokens of the documents that have any. Documents never meet
each other, and nothing is grouped but by document and item.

Defined cases: null or empty texts and items have no tokens and give no rows; repeated rows give one row for
each pair of ids; null ids are kept as they are; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Fixed masks: 1 looks, 0 ignores. Every stretch of SCORE or more holds a place of one of them.
SEEDS = ("111101", "10110011")
PENALTY, SCORE, BROADCAST_ROWS = 2, 10, 500_000
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def looked(mask: str) -> list[int]:
    return [j for j, x in enumerate(mask) if x == "1"]


def seeded(keyed: DataFrame, array: str, masks: list[str], *keep: str) -> DataFrame:
    """keyed(array of tokens, keep...) -> keep, at, k (which mask), seed: one row for each place at which a mask fits. A seed holds its k."""
    word = lambda j: F.get(F.col(array), F.col("at") + j)
    one = lambda k, m: F.when(word(len(m) - 1).isNotNull(), F.xxhash64(F.lit(k), *[word(j) for j in looked(m)]))
    places = keyed.select(array, *[c for c in keep if c != array], F.posexplode(array).alias("at", "_token"))
    return places.select(*keep, "at", F.posexplode(F.array(*[one(k, m) for k, m in enumerate(masks)])).alias("k", "seed")).where(F.col("seed").isNotNull())


def best_stretch(doc: Column, item: Column, penalty: int = PENALTY) -> Column:
    """The best score of a stretch of two runs of tokens of one length."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def add(a: Column, same: Column) -> Column:
        now = F.greatest(F.lit(0), a["now"] + F.when(same, F.lit(1)).otherwise(F.lit(-penalty)))
        return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))

    return F.when(doc == item, F.size(item)).otherwise(F.aggregate(F.zip_with(doc, item, lambda x, y: x == y), zero, add)["best"])


def _first_of_run(masks: list[str]) -> Column:
    """Of hits(w, t, at, item_at, k): no hit of the same mask stands one place before on the diagonal."""
    before = lambda j: F.get("w", F.col("at") + (j - 1)) == F.get("t", F.col("item_at") + (j - 1))
    out = F.lit(False)
    for k, mask in enumerate(masks):
        out = F.when(F.col("k") == k, reduce(lambda a, b: a & b, [before(j) for j in looked(mask)])).otherwise(out)
    return (F.col("at") == 0) | (F.col("item_at") == 0) | ~F.coalesce(out, F.lit(False))


def _laid(hits: DataFrame, *keep: str) -> DataFrame:
    """hits(w, n, shift, ...) -> keep, low, part: the document's tokens under the item; left out where they are the same one place before."""
    under = lambda at: F.slice("w", at + 1, F.col("n"))
    shift, n = F.col("shift"), F.col("n")
    again = (shift >= 1) & (shift + n <= F.size("w")) & (under(F.greatest(shift, F.lit(1)) - 1) == under(F.greatest(shift, F.lit(0))))
    low = F.greatest(F.lit(0), -shift)
    return hits.where(~again).select(*keep, low.alias("low"), F.slice("w", low + shift + 1, F.least(n, F.size("w") - shift) - low).alias("part"))


def _scored(docs: DataFrame, benchmark: DataFrame, masks, penalty: int, broadcast_rows: int) -> DataFrame:
    """A row for each diagonal that was hit and scored: dk (names the row of the document), doc_id, item_id, item_tokens, score."""
    known = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("ik"), tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    items = materialise(known.dropDuplicates(["item_id", "ik"]), "bench")
    short = sorted(r.n for r in items.select(F.size("t").alias("n")).where(F.col("n") < SCORE).distinct().collect())  # nine at most
    masks, common = [*masks, *("1" * n for n in short)], len(masks)
    own = F.get(F.array(*[F.lit(len(m)) for m in masks]), F.col("k")) == F.size("t")
    fits = F.when(F.col("k") < common, F.size("t") >= SCORE).otherwise(own)
    test = seeded(items, "t", masks, "t", "ik").where(fits).select("ik", F.size("t").alias("n"), F.col("at").alias("item_at"), "k", "seed")
    test = materialise(test, "bench-seeds")
    named = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), tokens(F.col("text")).alias("w"))
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    if test.count() <= broadcast_rows:  # a token has a seed for each mask at least, but for the last of each item
        met = seeded(named, "w", masks, "dk", "doc_id", "w").drop("k").join(F.broadcast(test), "seed").join(F.broadcast(items), "ik")
        hits = met.where(_first_of_run(masks)).select("dk", "doc_id", "item_id", "t", "n", "w", shift)
        parts = _laid(hits, "dk", "doc_id", "item_id", "t")
    else:
        met = seeded(named, "w", masks, "dk").drop("k").join(test, "seed").select("dk", "ik", "n", shift).distinct()
        hits = materialise(met, "hits")
        with_hits = materialise(named.join(hits.select("dk").distinct(), "dk", "left_semi").dropDuplicates(["dk", "doc_id"]), "hit-docs")
        parts = _laid(with_hits.join(hits, "dk"), "dk", "doc_id", "ik").join(items, "ik")
    return parts.select("dk", "doc_id", "item_id", F.size("t").alias("item_tokens"), best_stretch(F.col("part"), F.slice("t", F.col("low") + 1, F.size("part")), penalty).alias("score"))


def _enough(score: int) -> Column:
    return F.col("score") >= F.least(F.lit(score), F.col("item_tokens"))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks=SEEDS, penalty: int = PENALTY, score: int = SCORE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, score, item_tokens: one row for each pair that overlaps."""
    best = _scored(docs, benchmark, masks, penalty, broadcast_rows).groupBy("doc_id", "item_id", "item_tokens").agg(F.max("score").cast("long").alias("score"))
    found = best.where(_enough(score)).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("item_tokens").cast("long").alias("item_tokens"))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS, masks=SEEDS, penalty: int = PENALTY, score: int = SCORE) -> DataFrame:
    """The documents, all columns, that overlap no benchmark item; rows that share a doc_id, null or not, are judged one by one."""
    best = _scored(docs, benchmark, masks, penalty, broadcast_rows).where(_enough(score)).select(F.col("dk").alias("_leak"), F.col("doc_id").alias("_id"))
    leaks = materialise(best.distinct(), "leaks")
    few = leaks.count() <= broadcast_rows
    same = (F.xxhash64(docs["doc_id"], docs["text"]) == leaks["_leak"]) & docs["doc_id"].eqNullSafe(leaks["_id"])
    return docs.join(F.broadcast(leaks) if few else leaks, same, "left_anti")
