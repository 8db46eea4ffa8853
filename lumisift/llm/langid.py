"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of 0 to `order` bytes is counted on a bounded sample of labelled rows and then frozen. A byte
costs -log2(count / (total + distinct)) in the longest context that has seen it; each longer known context that has not costs
an escape, -log2(distinct / (total + distinct)) (method C); below order 0 a byte costs 8 bits. The language with the shortest exact
code of the whole text wins; the score is its share of 2**-length over all languages.

The trees of all languages share one numbering of the byte strings seen, so a text is scored by array look-ups,
`order` + 1 for a byte. LANGS languages share a model; more are several models, each of which a text is scored by, so their number has no limit. What the driver collects
and broadcasts is bounded by the sample: ROWS rows of at most MAX_BYTES bytes a language, and of ALL_BYTES divided by the languages where they are many (one row at least). Prediction reads
whole texts and is narrow.

Defined cases: null text, or text without a letter, is `und` with score 0; so is everything if nothing was learned;
ties go to the smaller language name; repeated rows stay; an empty table gives no rows; a null doc_id is hashed as empty text; columns
named like those that `identify` adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Shared, materialise, ship, small_batches, tidied

ship(__name__)

ORDER, ROWS, MAX_BYTES, GROUP_BYTES, LANGS, ALL_BYTES = 3, 150, 20_000, 250_000, 64, 256 << 20
ADDED = ("lang_pred", "score", "bits_per_byte")


class Model:
    """Frozen context trees of several languages.

    symbol: byte -> number, 0 for bytes never seen. grams[j]: (number of a string of j bytes, symbol) -> number of the longer
    string, 0 for none. cost[j]: of the last byte of a string of j bytes, by language; escape[j]: of a context of j bytes.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.langs, self.order = sorted(samples), order
        texts = [np.frombuffer(t, dtype=np.uint8) for lang in self.langs for t in samples[lang]]
        lang_of = np.repeat(np.arange(len(self.langs), dtype=np.int16), [sum(map(len, samples[x])) for x in self.langs])
        data = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint8)
        offset = np.concatenate([np.minimum(np.arange(len(t)), order).astype(np.int8) for t in texts]) if texts else np.zeros(0, dtype=np.int8)
        n, used = len(self.langs), np.unique(data)
        self.symbol = np.zeros(256, dtype=np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        sym = self.symbol[data].astype(np.int32)
        self.grams, self.cost, self.escape = [], [np.full((1, n), 8.0)], []
        before = np.zeros(len(data), dtype=np.int32)  # number of the string of j bytes that ends before each place
        suffix = before  # number of the shorter string that ends at each place
        known = 1
        for j in range(order + 1):
            at = np.flatnonzero(offset >= j)
            names, first, number = np.unique(before[at].astype(np.int64) * self.width + sym[at], return_index=True, return_inverse=True)
            table = np.zeros(known * self.width, dtype=np.int32)
            table[names] = np.arange(1, len(names) + 1)
            self.grams.append(table)
            counts = np.zeros((len(names) + 1, n))
            np.add.at(counts, (number + 1, lang_of[at]), 1)
            context = np.concatenate(([0], names // self.width))
            total, distinct = np.zeros((known, n)), np.zeros((known, n))
            np.add.at(total, context[1:], counts[1:])
            np.add.at(distinct, context[1:], counts[1:] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                own = -np.log2(counts / (total + distinct)[context])
            lower = np.zeros(len(names) + 1, dtype=np.int64)
            lower[1:] = suffix[at][first]
            self.escape.append(escape)
            self.cost.append(np.where(counts > 0, own, escape[context] + self.cost[j][lower]).astype(np.float64))
            whole = np.zeros(len(data), dtype=np.int32)
            whole[at] = number + 1
            suffix, known = whole, len(names) + 1
            before = np.concatenate((whole[:0], np.zeros(min(1, len(whole)), dtype=np.int32), whole[:-1]))
        self.cost = [x.astype(np.float32) for x in self.cost]
        self.escape = [x.astype(np.float32) for x in self.escape]

    def costs(self, data: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """(bytes, languages) code lengths; no context reaches back over a place in `fresh`."""
        sym = self.symbol[data]
        n = len(sym)
        numbers = [np.zeros(n, dtype=np.int32)]
        for j in range(self.order + 1):
            before = np.zeros(n, dtype=np.int32)
            before[1:] = numbers[j][:-1]
            table = self.grams[j]
            if j:  # the empty string has number 0, longer ones none
                before[fresh] = 0
                number = np.where(before > 0, table[before.astype(np.int64) * self.width + sym], 0)
            else:
                number = table[sym]
            numbers.append(number.astype(np.int32))
        top = self.order + 1
        out = self.cost[top][numbers[top]]
        left = np.flatnonzero(numbers[top] == 0)
        out[left] = 0
        for j in range(top - 1, -1, -1):  # what stands in a context of j bytes was not found
            if not len(left):
                break
            if j:
                prior = np.where(left > 0, numbers[j][left - 1], 0)
                reach = self._not_fresh(left, fresh, n)
                prior = np.where(reach, prior, 0)
                out[left] += np.where((prior > 0)[:, None], self.escape[j][prior], 0)
                found = numbers[j][left] > 0
                out[left[found]] += self.cost[j][numbers[j][left[found]]]
                left = left[~found]
            else:
                out[left] += self.escape[0][0] + self.cost[0][0]
        return out

    @staticmethod
    def _not_fresh(at: np.ndarray, fresh: np.ndarray, n: int) -> np.ndarray:
        is_fresh = np.zeros(n, dtype=bool)
        is_fresh[fresh] = True
        return ~is_fresh[at]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) code lengths in bits."""
        out = np.zeros((len(texts), len(self.langs)))
        group: list[int] = []
        held = 0
        for k, text in enumerate(texts):
            if len(text) > GROUP_BYTES:
                for at in range(0, len(text), GROUP_BYTES):
                    lead = min(at, self.order)
                    part = np.frombuffer(text[at - lead : at + GROUP_BYTES], dtype=np.uint8)
                    out[k] += self.costs(part, np.array([0]))[lead:].sum(axis=0, dtype=np.float64)
                continue
            if len(text):
                group.append(k)
                held += len(text)
            if held >= GROUP_BYTES:
                self._group(texts, group, out)
                group, held = [], 0
        if group:
            self._group(texts, group, out)
        return out

    def _group(self, texts, group, out):
        starts = np.cumsum([0] + [len(texts[k]) for k in group[:-1]])
        costs = self.costs(np.frombuffer(b"".join(texts[k] for k in group), dtype=np.uint8), starts)
        out[group] = np.add.reduceat(costs.astype(np.float64), starts, axis=0)


class Models:
    """Languages in models of `each` at most. A language's code lengths depend on its own rows only."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, each: int | None = None):
        names, each = sorted(samples), each or LANGS
        self.parts = [Model({x: samples[x] for x in names[k : k + each]}, order) for k in range(0, len(names), each)]
        self.langs = [x for part in self.parts for x in part.langs]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) code lengths in bits."""
        return np.concatenate([np.zeros((len(texts), 0)), *(part.lengths(texts) for part in self.parts)], axis=1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(labelled: DataFrame, order: int = ORDER, rows: int = ROWS, max_bytes: int = MAX_BYTES) -> Models:
    """labelled(doc_id, text, lang): counts a sample of at most `rows` rows a language, each of at most max_bytes bytes, in the order of a hash.

    Of very many languages each has fewer rows: as many as fit its share of ALL_BYTES, one at least.

    A count by language gives the share of hashes that holds about 1.5 times as many rows; only those are gathered, equal rows once.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= max_bytes)).select("lang", "text", F.xxhash64(F.lit(4), "doc_id", "text").alias("h"))
    share = F.least(F.lit(1.0), F.lit(1.5 * rows) / F.count("*"))
    limit = materialise(usable.groupBy("lang").agg((share * F.lit(float(2**63))).alias("most")), "langs")  # a row a language
    most = ALL_BYTES // max(1, limit.count())
    near = usable.join(F.broadcast(limit), "lang").where(F.abs(F.col("h").cast("double")) <= F.col("most"))
    first = W.partitionBy("lang").orderBy("h")  # a few rows more than are kept
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    placed = once.withColumn("k", F.row_number().over(first)).withColumn("bytes", F.sum(F.octet_length("text")).over(first))
    samples: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(tuple(r) for r in placed.where((F.col("k") <= rows) & ((F.col("k") == 1) | (F.col("bytes") <= most))).select("lang", "h", "text").collect()):
        samples.setdefault(lang, []).append(text.encode("utf-8"))
    return Models(samples, order)


def identify(docs: DataFrame, model: Model | Models) -> DataFrame:
    """docs(doc_id, text, ...) -> all columns, with lang_pred, score and bits_per_byte (of the winner; null for und)."""
    import pyspark.sql.types as T

    docs = docs.drop(*ADDED)
    spark = docs.sparkSession
    small_batches(spark)
    shared = Shared(spark, "langid", model)
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no name clashes
    plain = docs.toDF(*names)
    text = F.col(names[docs.columns.index("text")])
    flagged = plain.withColumn("lettered", F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    at = docs.columns.index("text")

    def run(batches: Iterator):
        import pyarrow as pa

        model = shared.value
        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            lettered = batch.column(len(names)).to_pylist()
            texts = [(x.as_py() or "").encode("utf-8") if ok else b"" for x, ok in zip(batch.column(at), lettered)]
            lang, score, bits = [], [], []
            lengths = model.lengths(texts) if model.langs else np.zeros((len(texts), 0))
            for text, ok, cost in zip(texts, lettered, lengths):
                if not ok or not model.langs:
                    lang.append("und"), score.append(0.0), bits.append(None)
                    continue
                best = int(np.argmin(cost))
                lang.append(model.langs[best])
                score.append(float(1 / np.exp2(np.maximum(cost[best] - cost, -1000)).sum()))
                bits.append(float(cost[best] / len(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=[*names, *ADDED])

    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return flagged.mapInArrow(tidied(run), schema).toDF(*docs.columns, *ADDED)
