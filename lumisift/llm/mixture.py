"""LM scoring by context mixing: hashed-context bit predictors, combined by gated weights that are refined online while a text is scored.

A text is its lower-cased (A-Z) tokens, words `[^\\x20\\x09-\\x0D]+` and an end, as bytes: each word and a space, the end as a line feed. A byte is a path of binary decisions
in a Huffman tree chosen by up to three bytes before it, so the product of the decisions' probabilities is one of the text. Four predictors give each decision a log-odds from
counts of zeros and ones in a hashed context, which also holds the node of the tree: the last 2 bytes and the tree, the last 4, the word so far, and the word so far with the
word before. Odds are combined by a weight vector chosen by a gate (how much the longer contexts have seen), through the logistic function.

What is learned, from all training rows:

* counts of words, exactly, as a table; the base score uses it, and the first three predictors are counted from it, as their contexts lie within a word;
* counts of the fourth, by a pass over all texts, in which each pair of a word and the word before is laid out once in a group of texts and added as often as it is there. Counters stand in tables of 2**bits slots a predictor, where bits follow the
  bytes of the training words up to MAX_BITS, since the tables are broadcast; tasks of about TASK_BYTES of text add up dense tables, which are summed by slots;
* first weights of each gate, by Newton steps on all decisions of all texts, each predicted as if it had not been counted itself. A second pass over the texts counts decisions by their gate and
  the step in which each of their four odds lies (CELLS counters in all); the Newton steps see those counts, with each step's middle as its odds.

While a text is scored, its weights are refined: after each of its segments (512 decisions, then each as long as all before, 32,768 at most) by the gradient of the code length over the
accumulated curvature. A text's score depends on it and the model alone, not on its batch. Frequent words (FREQUENT of them at most) are broadcast with their counts, the others join the table of counts by
word: no such key holds much more than one token in FREQUENT.

Defined cases: a null text is empty (one token, its end); a null doc_id is hashed as empty text; repeated rows stay; without training rows all counts are zero; an empty table
gives no rows; columns besides doc_id and text are ignored, whatever their names; texts and words may be of any length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, materialise, ship, small_batches, tidied

ship(__name__)

MAX_BITS, FREQUENT, LONG_WORD = 22, 200_000, 64
PREDICTORS, WITHIN = 4, 3
#: Contexts of the trees; one of its own needs so many bytes.
CONTEXTS, OFTEN = 32 * 256, 256
#: Contexts of one byte more, of which so many have trees of their own: those that save most decisions.
LONGER, OWN = 32 * CONTEXTS, 1024
#: What a context has seen, in steps: the gate is the step of the word so far, of the word before with it (3 at most), and whether the last 4 bytes reach the second.
LEVELS = np.array([1, 2, 4, 8, 32])
GATES = 6 * 3 * 2
#: Edges of the steps of log-odds of the bit that comes, and each step's middle; first weights are fitted on counts of decisions by gate and steps.
EDGES = np.array([-4.5, -2, -0.7, -1e-7, 1e-7, 0.3, 0.7, 1.2, 1.8, 2.5, 3.3, 4.3, 5.5, 7, 9])
MIDDLES = np.array([-6, -3, -1.3, -0.35, 0, 0.15, 0.5, 0.95, 1.5, 2.15, 2.9, 3.8, 4.9, 6.2, 8, 11])
STEPS = len(MIDDLES)
CELLS = GATES * STEPS**PREDICTORS
#: Added to counts; the curvature that first weights are worth; segments in decisions.
PRIOR, FIRM, SEGMENT, LONGEST, LANES = 0.2, 400.0, 512, 32_768, 4
#: Bytes of text whose words are looked up together, and whose words are counted together; decisions that are mixed together; slots of a block.
BATCH, COUNTED, CHUNK, SLOTS = 3 << 20, 10 << 20, 1 << 19, 1 << 13
#: The last bits of nodes, by which the slots of a context differ. Nodes near the root, which are most of those visited, are the last 32: a line of memory.
NEAR = 127
#: Bytes of text, and distinct words, that a task counts into its tables.
TASK_BYTES, TASK_WORDS = 64 << 20, 2_000_000
#: Tokens whose decisions are laid out at a time; distinct words whose decisions are.
LAID, SPELLED = 1 << 11, 20_000
SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, rare array<struct<word:binary,tf:int>>"

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, then the end as an empty one. Bytes know ASCII letters and white space only."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


def split(texts) -> tuple:
    """The words of an Arrow array of strings as words_of gives them, one after the other, as an Arrow array of binaries; and how many each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.binary())
    _, edges, data = texts.buffers()
    edges = np.frombuffer(edges, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, dtype=np.uint8)
    edges -= edges[0]
    inner, edge = np.zeros(len(data) + 2, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    inner[1:-1], edge[edges] = (data != 32) & (data - np.uint8(9) > 4), True
    mine = inner[1:-1]
    starts, ends = np.flatnonzero(mine & (edge[:-1] | ~inner[:-2])), np.flatnonzero(mine & (edge[1:] | ~inner[2:]))
    sizes = np.diff(np.searchsorted(starts, edges)) + 1
    lengths, words = np.zeros(int(sizes.sum()), dtype=np.int64), np.ones(int(sizes.sum()), dtype=bool)
    words[np.cumsum(sizes) - 1] = False
    lengths[words] = ends - starts + 1
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER.take(data[mine]))]), sizes


def short_name(word: bytes) -> bytes:
    """Of a frequent word, in bounded space; no word begins with a space."""
    import hashlib

    return word if len(word) <= LONG_WORD else b" " + hashlib.sha256(word).digest()


# ---------------------------------------------------------------- counts as bytes

def quantised(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact below 32, then by steps of an eighth of a doubling."""
    with np.errstate(divide="ignore"):
        coarse = 32 + np.floor(8 * np.log2(np.maximum(n, 32) / 32.0))
    return np.where(n < 32, n, np.minimum(coarse, 255)).astype(np.uint8)


def _of_pairs() -> tuple[np.ndarray, np.ndarray]:
    """By a pair of byte counts (zeros + 256 ones): log-odds of a one, exactly 0 for unseen only; and how much the context has seen, in LEVELS."""
    q = np.arange(256, dtype=np.float64)
    n = np.where(q < 32, q, 32 * 2 ** ((q - 31.5) / 8))
    zeros, ones = np.tile(n, 256), np.repeat(n, 256)
    odds = np.log((ones + PRIOR) / (zeros + PRIOR))
    odds = np.where(zeros + ones == 0, 0.0, np.where(odds == 0, 1e-6, odds)).astype(np.float32)
    return odds, np.searchsorted(LEVELS, zeros + ones, side="right").astype(np.uint8)


def less_one(pair: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Pairs of byte counts without one of that bit, where the count is exact."""
    count = np.where(bit == 1, pair >> 8, pair & 255)
    return pair - np.where((count > 0) & (count < 32), np.where(bit == 1, 256, 1), 0)


class Code:
    """Huffman trees of bytes, one for each context that was seen often, else that of the byte before: the tree of each context, and by tree * 256 + byte the length and start of
    a path, and along it the last bits of the nodes, with the bits."""

    def __init__(self, counts: np.ndarray, longer: tuple[np.ndarray, np.ndarray] | None = None):
        """counts: (CONTEXTS, 256); a context is the byte before and a class of the one before that. longer: counts of longer contexts * 256 + bytes, as (which, how many)."""
        single = counts.reshape(-1, 256, 256).sum(axis=0)
        often = np.flatnonzero(counts.sum(axis=1) >= OFTEN)
        own, more = ([], []) if longer is None else self.chosen(counts, *longer)
        self.tree = np.tile(np.arange(256), LONGER // 256)
        self.tree.reshape(-1, CONTEXTS)[:, often] = 256 + np.arange(len(often))
        self.tree[own] = 256 + len(often) + np.arange(len(own))
        self.length, self.start = (np.zeros((256 + len(often) + len(own)) * 256, dtype=np.int32) for _ in range(2))
        marks = []  # the last bits of a node, and the bit
        for tree, own in enumerate(chain(single, counts[often], more)):
            parent: dict[int, tuple[int, int]] = {}
            heap = [(int(n) * 1024 + 1, sym) for sym, n in enumerate(own)]
            heapq.heapify(heap)
            inner = 256
            while len(heap) > 1:
                (m, x), (n, y) = heapq.heappop(heap), heapq.heappop(heap)
                parent[x], parent[y] = (inner, 0), (inner, 1)
                heapq.heappush(heap, (m + n, inner))
                inner += 1
            paths: dict[int, list[tuple[int, int]]] = {inner - 1: []}
            for node in range(inner - 2, -1, -1):
                up, bit = parent[node]
                path = [*paths[up], (up - 256, bit)]
                if node >= 256:
                    paths[node] = path
                else:
                    self.length[tree * 256 + node], self.start[tree * 256 + node] = len(path), len(marks)
                    marks += [(p[0] & NEAR) << 1 | p[1] for p in path]
        self.marks = np.array(marks, dtype=np.uint8)

    @property
    def bits(self) -> np.ndarray:
        return self.marks & 1

    @staticmethod
    def chosen(counts: np.ndarray, which: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longer contexts that save most, and their counts; a context saves what its bytes cost by their shares in the shorter one, less their cost by those in its own."""
        context, n = which >> 8, n.astype(np.float64)
        total = np.bincount(context, n, LONGER)
        short = (context % CONTEXTS) * 256 + (which & 255)
        before = np.maximum(1, np.log2(counts.sum(axis=1)[context % CONTEXTS] / np.maximum(counts.ravel()[short], 1).astype(np.float64)))
        saved = np.bincount(context, n * (before - np.maximum(1, np.log2(total[context] / n))), LONGER)
        own = np.argsort(-saved, kind="stable")[:OWN]
        own = np.sort(own[(saved[own] > 0) & (total[own] >= OFTEN)])
        place, held = np.full(LONGER, -1), np.zeros((len(own), 256), dtype=np.uint64)
        place[own] = np.arange(len(own))
        some = place[context] >= 0
        held[place[context[some]], which[some] & 255] = n[some].astype(np.uint64)
        return own, held


def laid_out(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of an Arrow array of words with their terminators, their places in the word, and the words' lengths."""
    import pyarrow as pa

    words = words.cast(pa.binary())
    _, offsets, spelled = words.buffers()
    edges = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    lengths = np.diff(edges) + 1
    ends = np.cumsum(lengths) - 1
    data, inner = np.empty(int(lengths.sum()), dtype=np.uint8), np.ones(int(lengths.sum()), dtype=bool)
    inner[ends] = False
    data[ends] = np.where(lengths == 1, 10, 32)
    if edges[-1] > edges[0]:
        data[inner] = np.frombuffer(spelled, dtype=np.uint8)[edges[0] : edges[-1]]
    return data, np.arange(len(data)) - np.repeat(ends + 1 - lengths, lengths), lengths


def context_of(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The byte before each, and the last five bits of the two before that, within its word."""
    out = np.full(len(data), 32, dtype=np.int64)
    out[1:] = data[:-1]
    out[place == 0] = 32
    for back in (2, 3):
        prior = np.zeros(len(data), dtype=np.int64)
        prior[back:] = data[:-back] & 31
        prior[place < back] = 0  # a space
        out |= prior << (5 * back - 2)
    return out


def spelled_sums(data: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Running sums whose differences tell what stands between two places of a word."""
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(lengths.max(initial=1)), _K[3], dtype=np.uint64))))
    return np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.take(place))))


def whole_hashes(words) -> np.ndarray:
    """Of an Arrow array of words, what Decisions calls whole."""
    out = np.zeros(len(words), dtype=np.uint64)
    for at in range(0, len(words), SPELLED):
        data, place, lengths = laid_out(words.slice(at, SPELLED))
        sums, ends = spelled_sums(data, place, lengths), np.cumsum(lengths)
        out[at : at + SPELLED] = sums[ends] - sums[ends - lengths]
    return out


class Decisions:
    """The decisions of distinct words: where each word's begin and how many they are, their bits, and hashes of the bytes' contexts.

    Decisions of a byte have neighbouring slots: those of its context's hash, each with the last bits of the node turned over, so that they are fetched together.
    """

    def __init__(self, words, code: Code):
        """words: an Arrow array of binaries."""
        data, place, lengths = laid_out(words)
        self.data, self.place = data, place
        self.tree = code.tree.take(context_of(data, place))
        at = self.tree * 256 + data
        self.size = code.length.take(at)
        last = np.cumsum(self.size, dtype=np.int64)
        path = np.repeat(code.start.take(at) - (last - self.size), self.size)
        path += np.arange(len(path))
        self.mark = code.marks.take(path)  # what the slot and the bit add to twice the slot of the context
        self.bits = self.mark & 1
        ends = np.cumsum(lengths) - 1
        self.first, self.bytes = ends + 1 - lengths, lengths
        begin = np.concatenate(([0], last))
        self.start, self.count = begin[ends + 1 - lengths], begin[ends + 1] - begin[ends + 1 - lengths]
        sums = spelled_sums(data, place, lengths)
        opened = np.repeat(sums[ends + 1 - lengths], lengths)
        self.prefix = (sums[:-1] - opened) * _K[1] + place.astype(np.uint64)
        self.whole = sums[ends + 1] - sums[ends + 1 - lengths]  # of each word, terminator and all

    def last(self, n: int) -> np.ndarray:
        """The last n bytes, 4 at most, before each, within its word."""
        out, place = np.zeros(len(self.data), dtype=np.uint32), np.minimum(self.place, n).astype(np.uint8)
        for back in range(1, n + 1):
            prior = np.full(len(self.data), 32, dtype=np.uint8)
            prior[back:] = np.where(place[back:] < back, np.uint8(32), self.data[:-back])
            out = (out << np.uint32(8)) | prior
        return out.astype(np.uint64)

    def hashed(self, which: int) -> np.ndarray:
        """One number for each byte: its context within the word."""
        context = self.last(2) | self.tree.astype(np.uint64) << np.uint64(16) if which == 0 else self.last(4) if which == 1 else self.prefix
        context = (context + np.uint64(which + 1)) * _K[0]
        return context ^ (context >> np.uint64(31))

    def within(self, which: int, bits: int) -> np.ndarray:
        """Of each decision: twice its slot, and its bit."""
        return np.repeat(slots(self.hashed(which), bits) << 1, self.size) ^ self.mark

    def across(self, hashed: np.ndarray, ids: np.ndarray, before: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words by number, each after a word of that hash: places of their decisions; twice the slots of the last predictor for each, without their marks; and how many each word has."""
        at, count = _spread(self.start, self.count, ids)
        byte, size = _spread(self.first, self.bytes, ids)
        slot = slots(crossed(hashed.take(byte, mode="wrap"), np.repeat(before, size)), bits) << 1
        return at, np.repeat(slot, self.size.take(byte, mode="wrap")), count


def slots(hashed: np.ndarray, bits: int) -> np.ndarray:
    return ((hashed * _K[1]) >> np.uint64(64 - bits)).astype(np.int64)


#: Log-odds of the predictors within a word are kept in such parts.
ODDS_STEPS = 1024


def crossed(within: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Contexts of the word so far, with the word before it."""
    return within ^ (before * _K[3] + _K[0])


class Tokens:
    """Texts as numbers of distinct words. Each text's first word follows its end."""

    def __init__(self, texts: list[list[bytes]] | tuple, code: Code):
        """texts: the words of each, or what split gives."""
        import pyarrow as pa

        if not isinstance(texts, tuple):
            texts = pa.array(chain.from_iterable(texts), pa.binary(), size=sum(map(len, texts))), np.array([len(t) for t in texts], dtype=np.int64)
        whole, self.sizes = texts[0].dictionary_encode(), texts[1]
        self.words = whole.dictionary
        self.ids = whole.indices.to_numpy().astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.made = Decisions(self.words, code)
        hashes = self.made.whole.take(self.ids)
        self.before = np.concatenate((hashes[:1], hashes[:-1]))
        self.before[self.ends - self.sizes] = hashes[-1]  # an end

    def decisions(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens low to high: places among the words' decisions, hashes of the words before, and how many each token has."""
        at, count = _spread(self.made.start, self.made.count, self.ids[low:high])
        return at, np.repeat(self.before[low:high], count), count

    def across(self, hashed: np.ndarray, low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Of tokens low to high: places among the words' decisions; and twice the slot of the last predictor, and the bit."""
        at, slot, _ = self.made.across(hashed, self.ids[low:high], self.before[low:high], bits)
        return at, slot ^ self.made.mark.take(at)


def _spread(start: np.ndarray, count: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, ... of each id, as many as its count; and the counts."""
    n = count.take(ids, mode="wrap")
    at = np.repeat(start.take(ids, mode="wrap") - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return at, n


def in_batches(batches: Iterator, texts: int, size: int = BATCH):
    """(batch, split of its texts) for slices of Arrow batches of about so many bytes."""
    import pyarrow.compute as pc

    for batch in batches:
        column = batch.column(texts)
        reached = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            high = min(batch.num_rows, int(np.searchsorted(reached, (reached[low - 1] if low else 0) + size)) + 1)
            yield batch.slice(low, high - low), split(column.slice(low, high - low))
            low = high


def in_groups(batches: Iterator):
    """Words of about COUNTED bytes of texts at a time, as numbers of distinct ones: each text whole, one after the other."""
    import pyarrow as pa

    def numbered():
        whole = pa.concat_arrays(held)
        held.clear()
        return whole.dictionary_encode()

    held: list = []
    for _, (words, _) in in_batches(batches, 0):
        held.append(words)
        if sum(w.nbytes for w in held) >= COUNTED:
            yield numbered()
    if held:
        yield numbered()


def pairs_of(batches: Iterator, code: Code):
    """Each pair of a word and the word before it once in a group of texts: (decisions of some words, numbers of words among them, hashes of the words before, how often)."""
    for group in in_groups(batches):
        ids, words = group.indices.to_numpy().astype(np.int64), group.dictionary
        key = ids << 32 | np.roll(ids, 1)  # a text's first word follows an end, as each text before it, or the last, ends with one
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        often, key = np.diff(np.append(first, len(key))), key[first]
        word, before = key >> 32, whole_hashes(words).take(key & 0xFFFFFFFF)
        for at in range(0, len(words), SPELLED):
            made = Decisions(words.slice(at, SPELLED), code)
            low, high = np.searchsorted(word, (at, at + SPELLED)).tolist()
            yield made, word[low:high] - at, before[low:high], often[low:high]


# ---------------------------------------------------------------- learning

def word_counts(training: DataFrame) -> DataFrame:
    """training(text) -> (word binary, n), the end as the empty word: counted in tasks, a group of texts at a time, then by word."""

    def run(batches: Iterator):
        import pyarrow as pa

        for group in in_groups(batches):
            n = np.bincount(group.indices.to_numpy(), minlength=len(group.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([group.dictionary, pa.array(n)], names=["word", "n"])

    return training.select("text").mapInArrow(tidied(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(parts: DataFrame, finish=None) -> DataFrame:
    """(which, block, sums binary of unsigned longs) -> one row a block, added up as rows stream by; `finish` turns sums into what is kept."""

    def run(batches: Iterator):
        import pyarrow as pa

        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for which, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                added = np.frombuffer(data, dtype="<u4" if len(data) == 8 * SLOTS else "<u8")
                if (which, block) in held:
                    held[which, block] += added
                else:
                    held[which, block] = added.astype(np.uint64)
        keys = sorted(held)
        data = [(finish(held[k]) if finish else held[k]).tobytes() for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(data, pa.binary())], names=["which", "block", "sums"])

    return parts.repartition("which", "block").mapInArrow(tidied(run), parts.schema)


def _blocks(which: int, total: np.ndarray):
    """Rows of a task's table: blocks of SLOTS pairs that hold anything, in four bytes a count where they fit."""
    import pyarrow as pa

    cut = total.reshape(-1, 2 * SLOTS)
    for k in range(0, len(cut), 64):
        some = [j for j in range(k, min(k + 64, len(cut))) if cut[j].any()]
        data = [cut[j].astype("<u4" if cut[j].max() < 2**32 else "<u8").tobytes() for j in some]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([which] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["which", "block", "sums"])


PARTS = "which int, block int, sums binary"


def byte_contexts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of longer contexts * 256 + bytes in the training texts, from the words' counts: (which, how many)."""

    def run(batches: Iterator):
        import pyarrow as pa

        total = np.zeros(0, dtype=np.int64), np.zeros(0)
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                part = batch.slice(at, 50_000)
                data, place, lengths = laid_out(part.column(0))
                which = np.concatenate((total[0], context_of(data, place) * 256 + data))
                n = np.concatenate((total[1], np.repeat(part.column(1).to_numpy().astype(np.float64), lengths)))
                which, of = np.unique(which, return_inverse=True)
                total = which, np.bincount(of, n, len(which))
        yield pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1].astype(np.int64))], names=["which", "n"])

    found = words.mapInArrow(tidied(run), "which long, n long").groupBy("which").agg(F.sum("n").alias("n")).toArrow()  # contexts bound them
    which, n = (found.column(k).to_numpy() for k in range(2))
    order = np.argsort(which)
    return which[order], n[order]


def shorter(which: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(context, byte) counts of the shorter contexts."""
    return np.bincount(which % (CONTEXTS * 256), n.astype(np.float64), CONTEXTS * 256).astype(np.uint64).reshape(CONTEXTS, 256)


def packed(sums: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones of each slot, in two bytes."""
    return quantised(sums[0::2]).astype("<u2") | quantised(sums[1::2]).astype("<u2") << 8


def _count_words(which: int, code: Shared, bits: int):
    def run(batches: Iterator):
        total = np.zeros(2 << bits, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                made = Decisions(part.column(0), code.value)
                np.add.at(total, made.within(which, bits), np.repeat(part.column(1).to_numpy().astype(np.uint64), made.count))
        yield from _blocks(which, total)

    return tidied(run)


def _count_texts(code: Shared, bits: int):
    def run(batches: Iterator):
        total = np.zeros(2 << bits, dtype=np.uint32)  # a task has fewer decisions than that holds
        for made, ids, before, often in pairs_of(batches, code.value):
            hashed = made.hashed(2)
            for low in range(0, len(ids), LAID):
                cut = slice(low, low + LAID)
                at, slot, count = made.across(hashed, ids[cut], before[cut], bits)
                slot ^= made.mark.take(at, mode="wrap")
                np.add.at(total, slot, np.repeat(often[cut].astype(np.uint32), count))
        yield from _blocks(WITHIN, total)

    return tidied(run)


class Model:
    """Frozen tables, trees and first weights; frequent: Arrow arrays of frequent words' names and log10 of their counts; and what all words have in common."""

    def __init__(self, code: Code, bits: int, tables: np.ndarray, weights: np.ndarray, frequent: tuple, total: int, distinct: int):
        self.code, self.bits, self.tables, self.weights, self.frequent, self.total, self.distinct = code, bits, tables, weights, frequent, total, distinct
        self.shared: Shared | None = None  # without its weights

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("odds", "level", "rounded", "across_gate", "signed", "shared")}

    def common(self, words) -> np.ndarray:
        """Of an Arrow array of words, log10 of a frequent one's count, else nan."""
        import pyarrow as pa
        import pyarrow.compute as pc

        names, values = self.frequent
        long = np.flatnonzero(pc.binary_length(words).to_numpy() > LONG_WORD)
        at = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy(zero_copy_only=False).copy()
        if len(long):
            at[long] = pc.fill_null(pc.index_in(pa.array([short_name(w) for w in words.take(pa.array(long)).to_pylist()], pa.binary()), value_set=names), -1).to_numpy(zero_copy_only=False)
        return np.append(values.to_numpy(), np.nan)[at]

    def looked_up(self, tokens: Tokens) -> tuple[list[np.ndarray], Decisions]:
        """Of the words' decisions: pairs of counts of the predictors within a word; and what the last predictor needs."""
        return self.within(tokens.made), tokens.made

    def within(self, made: Decisions) -> list[np.ndarray]:
        return [self.tables[w].take(made.within(w, self.bits) >> 1, mode="wrap") for w in range(WITHIN)]

    def across(self, made: Decisions, at: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Pairs of counts of the last predictor, of decisions in any order."""
        byte = np.repeat(np.arange(len(made.data)), made.size).take(at)
        return self.tables[WITHIN].take(slots(crossed(made.hashed(2).take(byte), before), self.bits) ^ (made.mark.take(at) >> 1))

    def ready(self) -> None:
        if not hasattr(self, "odds"):
            self.odds, self.level = _of_pairs()
            self.rounded = np.where(self.odds == 0, 0, np.copysign(np.maximum(1, np.rint(np.abs(self.odds) * ODDS_STEPS)), self.odds)).astype(np.int16)
            self.across_gate = 2 * np.minimum(self.level, 2)
            self.signed = np.stack([-self.rounded, self.rounded], axis=1).ravel()  # by a pair of counts and the bit that comes

    def gate(self, last: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What the contexts within a word add to the gate."""
        return self.level.take(word) * np.uint8(6) + (self.level.take(last) >= 2)

    def scores(self, tokens: Tokens) -> np.ndarray:
        """Bits of each text."""
        self.ready()
        pairs, made = self.looked_up(tokens)
        sign = (made.bits * 2).astype(np.int16) - np.int16(1)
        known = np.empty((len(sign), 4), dtype=np.int16)  # three odds of the bit that comes, the gate and the mark, as one number to fetch
        for k, p in enumerate(pairs):
            known[:, k] = self.rounded.take(p) * sign
        known[:, 3] = self.gate(pairs[1], pairs[2]).astype(np.int16) << 8 | made.mark
        known = known.view(np.uint64).ravel(), made.hashed(2)
        out = np.zeros(len(tokens.sizes))
        decisions = np.concatenate(([0], np.cumsum(tokens.made.count.take(tokens.ids))))
        begins, ends = decisions[tokens.ends - tokens.sizes], decisions[tokens.ends]
        low = 0
        while low < len(out):
            high = low + 1  # texts low to high are mixed together, a large one alone
            while high < len(out) and ends[high] - begins[low] <= CHUNK:
                high += 1
            self._mix(tokens, decisions, begins[low:high], ends[low:high], known, out[low:high])
            low = high
        return out

    def _mix(self, tokens, decisions, begins, ends, known, out) -> None:
        order = np.argsort(begins - ends, kind="stable")  # longest first, so that those with more to come are in front
        length, at_first = (ends - begins)[order], (begins - begins[0])[order]
        weights = np.tile(self.weights / ODDS_STEPS, (len(out), 1)).astype(np.float32)  # (texts and their gates, predictors), of odds in steps
        bent, bits = np.full(len(out) * GATES, FIRM), np.zeros(len(out))
        done, size, open_, steps = 0, SEGMENT, len(out), 1 / ODDS_STEPS**2
        turns = np.arange(int(length.sum() if len(out) > 1 else min(LONGEST, length[0]))) % LANES
        kept = None  # decisions of a small group are laid out once
        if ends[-1] - begins[0] <= 2 * CHUNK:
            kept = self._laid(tokens, known, decisions, begins[0], ends[-1])
        while open_:
            step = np.minimum(length[:open_] - done, size)
            if kept is None:
                odds, gate = self._laid(tokens, known, decisions, int(begins[0] + done), int(begins[0] + done + step[0]))
            else:
                cut = [slice(a, b) for a, b in zip((at_first[:open_] + done).tolist(), (at_first[:open_] + done + step).tolist())]
                odds, gate = (np.concatenate([x[c] for c in cut]) for x in kept)
            odds = odds.view(np.int16).reshape(-1, PREDICTORS)
            inputs = [odds[:, k].astype(np.float32) for k in range(PREDICTORS)]
            key = np.repeat(np.arange(open_) * GATES, step)
            key += gate
            own = weights.view(np.complex128).ravel().take(key, mode="wrap").view(np.float32).reshape(-1, PREDICTORS)  # the four weights in one fetch
            dot = own[:, 0] * inputs[0]
            for k in range(1, PREDICTORS):
                dot += own[:, k] * inputs[k]
            wrong = np.negative(np.clip(dot, -30, 30, out=dot), out=dot)
            np.exp(wrong, out=wrong)
            bits[:open_] += np.add.reduceat(np.log1p(wrong), np.cumsum(step) - step, dtype=np.float64)
            done += size
            open_ = int(np.count_nonzero(length[:open_] > done))
            if open_:  # whole segments of the first texts
                n, key, p = open_ * GATES, key[: open_ * size], wrong[: open_ * size]
                key *= LANES  # sums in turns, as one that waits for the one before is slow
                key += turns[: len(key)]
                inputs = [x[: open_ * size] for x in inputs]
                p /= 1 + p
                bend = inputs[0] * inputs[0]
                for x in inputs[1:]:
                    bend += x * x
                bend *= p
                bend *= 1 - p
                bent[:n] += np.bincount(key, bend, n * LANES).reshape(n, LANES).sum(axis=1) * steps
                for x, w in zip(inputs, weights.T):
                    x *= p
                    w[:n] += np.bincount(key, x, n * LANES).reshape(n, LANES).sum(axis=1) * steps / bent[:n]
            size = min(LONGEST, done)
        out[order] = bits / np.log(2)

    def _laid(self, tokens, known, decisions, low, high) -> tuple[np.ndarray, np.ndarray]:
        """Of decisions low to high of the batch: the four odds of the bit that comes, in steps, as one number; and the gates."""
        known, hashed = known
        first, last = int(np.searchsorted(decisions, low, side="right")) - 1, int(np.searchsorted(decisions, high, side="left"))
        odds, gates = np.empty(int(high - low), dtype=np.uint64), np.empty(int(high - low), dtype=np.int16)
        for begin in range(first, last, LAID):
            end = min(begin + LAID, last)
            at, slot, _ = tokens.made.across(hashed, tokens.ids[begin:end], tokens.before[begin:end], self.bits)
            a, b = max(int(decisions[begin]), int(low)), min(int(decisions[end]), int(high))
            cut, to = slice(a - int(decisions[begin]), b - int(decisions[begin])), slice(a - int(low), b - int(low))
            slot, own = slot[cut], known.take(at[cut], mode="wrap").view(np.int16).reshape(-1, PREDICTORS)
            gate = own[:, WITHIN].copy()
            slot ^= gate & 255
            cross = self.tables[WITHIN].take(slot >> 1, mode="wrap")
            gate >>= 8
            np.add(gate, self.across_gate.take(cross, mode="wrap"), out=gates[to])
            slot &= 1
            slot |= cross.astype(np.int64) << 1
            own[:, WITHIN] = self.signed.take(slot, mode="wrap")
            odds[to] = own.view(np.uint64).ravel()
        return odds, gates


def _count_cells(shared: Shared):
    """Texts -> counts of their decisions by gate and steps, each decision left out of what predicts it."""

    def run(batches: Iterator):
        model = shared.value
        model.ready()
        left = np.stack([less_one(np.arange(65536), np.full(65536, bit)) for bit in (0, 1)], axis=1).ravel()  # by a pair of counts and the bit
        step = np.searchsorted(EDGES, model.odds[left] * np.tile([-1, 1], 65536)).astype(np.int32)
        across = step + model.across_gate[left] * np.int32(STEPS**PREDICTORS)
        total = np.zeros(CELLS, dtype=np.uint32)  # a task has fewer decisions than that holds
        for made, ids, before, often in pairs_of(batches, model.code):
            pairs = model.within(made)
            seen = [p.astype(np.int64) << 1 | made.bits for p in pairs]
            own = model.gate(left.take(seen[1]), left.take(seen[2])).astype(np.int32)
            for s in seen:
                own = own * np.int32(STEPS) + step.take(s)
            own *= np.int32(STEPS)
            hashed = made.hashed(2)
            for low in range(0, len(ids), LAID):
                cut = slice(low, low + LAID)
                at, slot, count = made.across(hashed, ids[cut], before[cut], model.bits)
                slot ^= made.mark.take(at, mode="wrap")
                cross = model.tables[WITHIN].take(slot >> 1, mode="wrap").astype(np.int64) << 1 | (slot & 1)
                np.add.at(total, own.take(at, mode="wrap") + across.take(cross, mode="wrap"), np.repeat(often[cut].astype(np.uint32), count))
        yield from _blocks(0, total)

    return tidied(run)


def decision_cells(texts: DataFrame, shared: Shared) -> np.ndarray:
    """texts(text) -> how many of all their decisions have each gate and steps."""
    cells = np.zeros(CELLS, dtype=np.uint64)
    for r in _summed(texts.mapInArrow(_count_cells(shared), PARTS)).collect():  # CELLS bound them
        cells[r.block * 2 * SLOTS : (r.block + 1) * 2 * SLOTS] = np.frombuffer(r.sums, dtype="<u8")
    return cells


def first_weights(cells: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Weights of each gate that make the counted decisions shortest; near an even mixture where they are few."""
    weights = np.full((GATES, PREDICTORS), 0.3)
    for g, own in enumerate(cells.reshape(GATES, -1)):
        some = np.flatnonzero(own)
        x, n = MIDDLES[np.stack(np.unravel_index(some, (STEPS,) * PREDICTORS), axis=1)], own[some].astype(np.float64)
        w = weights[g].copy()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            pull = x.T @ (n * (1 - p)) - 20 * (w - 0.3)
            bend = (x * (n * p * (1 - p))[:, None]).T @ x + 20 * np.eye(PREDICTORS)
            w = w + np.linalg.solve(bend, pull)
        weights[g] = w
    return weights


def train(training: DataFrame, max_bits: int = MAX_BITS) -> tuple[Model, DataFrame]:
    """training(doc_id, text) -> the model, and (word, n) of all training words."""
    import pyarrow as pa

    spark = training.sparkSession
    words = materialise(word_counts(training), "mixture-words")
    total, distinct, size = words.agg(F.sum("n"), F.count("*"), F.sum((F.octet_length("word") + 1) * F.col("n"))).first()
    total, distinct, size = total or 0, distinct or 0, size or 0
    bits = max(13, min(max_bits, int(size).bit_length() - 2))
    few = words.coalesce(max(1, int(distinct) // TASK_WORDS))
    longer = byte_contexts(few)
    code = Code(shorter(*longer), longer)
    shared = Shared(spark, "mixture", code)
    tasks = max(spark.sparkContext.defaultParallelism, int(size) // TASK_BYTES)  # a task's table costs the same however little it has counted
    texts = training.select("text").coalesce(tasks)
    parts = texts.mapInArrow(_count_texts(shared, bits), PARTS)
    for which in range(WITHIN):
        parts = parts.unionByName(few.mapInArrow(_count_words(which, shared, bits), PARTS))
    tables = np.zeros((PREDICTORS, 1 << bits), dtype=np.uint16)
    for r in _summed(parts, packed).collect():  # 2**max_bits slots bound them
        tables[r.which, r.block * SLOTS : (r.block + 1) * SLOTS] = np.frombuffer(r.sums, dtype="<u2")
    name = F.when(F.octet_length("word") <= LONG_WORD, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.sha2("word", 256))))
    step = F.floor(8 * F.log2("n")).cast("int")
    held, least = 0, 1 << 20
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 8 for each doubling
        held += r["count"]
        if held > FREQUENT:
            break
        least = r.step
    often = words.where(step >= least).select(name.alias("word"), F.log10(F.col("n") + F.lit(0.1)).alias("value")).toArrow()
    often = tuple(pa.concat_arrays([pa.array([], c.type), *c.chunks]) for c in often.columns)
    model = Model(code, bits, tables, np.full((GATES, PREDICTORS), 0.3), often, total, distinct)
    model.shared = Shared(spark, "mixture", model)
    model.weights = first_weights(decision_cells(texts, model.shared))
    return model, words


# ---------------------------------------------------------------- scoring

def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte."""
    spark = docs.sparkSession
    shared, weights = model.shared or Shared(spark, "mixture", model), model.weights

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        model = shared.value
        model.weights = weights
        row = TaskContext.get().partitionId() << 36
        for batch, said in in_batches(batches, 2):
            tokens = Tokens(said, model.code)
            bits = model.scores(tokens)
            value = model.common(tokens.words).take(tokens.ids)
            rare = np.isnan(value)
            texts, starts = len(tokens.sizes), tokens.ends - tokens.sizes
            base = np.add.reduceat(np.where(rare, 0.0, value), starts)
            known = np.add.reduceat((~rare).astype(np.int64), starts)
            text_of = np.repeat(np.arange(texts), tokens.sizes)[rare]
            pair, tf = np.unique(text_of * len(tokens.words) + tokens.ids[rare], return_counts=True)
            offsets = np.searchsorted(pair, np.arange(texts + 1) * len(tokens.words))
            spelled = tokens.words.take(pa.array(pair % len(tokens.words)))
            entries = pa.StructArray.from_arrays([spelled, pa.array(tf.astype(np.int32))], names=["word", "tf"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(texts)), batch.column(0), batch.column(1), pa.array(tokens.sizes), pa.array(known), pa.array(base), pa.array(bits * -np.log10(2.0)), pa.array(np.add.reduceat(tokens.made.bytes.take(tokens.ids), starts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )
            row += texts

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    made = materialise(plain.mapInArrow(tidied(run), SCHEMA), "mixture-scored")
    rare = made.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf").join(words, "word")
    more = rare.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("n") + F.lit(0.1))).alias("more"), F.sum("tf").alias("seen"))
    floor, never = float(np.log10(model.total + 0.1 * (model.distinct + 1))), float(np.log10(0.1))
    n_known = F.col("known") + F.coalesce("seen", F.lit(0))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + (F.col("n_tokens") - n_known) * F.lit(never) - F.col("n_tokens") * F.lit(floor)
    return made.drop("rare").join(more, "row", "left").select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), F.round(base, 9).alias("base_score"), "score", (-F.col("score") / (F.lit(float(np.log10(2.0))) * F.col("n_bytes"))).alias("bits_per_byte"))


def score_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> all rows scored by a model of those that are not held out."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    model, words = train(rows.where(~held_out(F.col("doc_id"))))
    return score(rows, model, words)
