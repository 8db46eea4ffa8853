"""Token counts of whole texts with overlap resynchronisation.

Texts up to `chunk_chars` are encoded as they are. A longer one is encoded in overlapping chunks with offsets. Two
neighbouring encodings are spliced at a place inside their overlap where neither has a token across and where the text goes
from other than white space to white space. Such a place is proven stable: the tokenizers served here cut a text
there before they merge (`splits_at_blanks` tells whether a given file is known to; if not, texts are encoded whole), so what stands
before it can't change what comes after, nor the reverse. An overlap without such a place is doubled until one is found.
By the same proof a shorter text's count is the sum over its stretches between such places, so a worker asks the library
once for each different stretch and keeps the answers (KEPT at most).

Runs in Arrow batches on the executors: the encoder is a native library that only Python reaches. Memory is bounded
by a chunk, not by the text. Lost tasks are simply run again.

Defined cases: null counts as empty (0 tokens); repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches, tidied, worker_cache

ship(__name__)

CHUNK_CHARS, OVERLAP_CHARS, GROUP_CHARS, KEPT = 16_384, 512, 400_000, 1_000_000


_TURN = re.compile(r"(?<=[^\s])(?=[ \n\r\t])")
#: What lies between two such places, for texts without other white space.
_STRETCH = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_OTHER_BLANK = re.compile(r"[^\S \n\r\t]")


#: Patterns of Split steps that cut wherever text turns to one of the blanks of _TURN. Others may let a piece run on into blanks, as
#: those do in which line ends follow punctuation.
KNOWN_SPLITS = frozenset((
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
))


def cuts_at_blanks(step: dict) -> bool:
    """Whether a step of a pre-tokenizer is known to part a text wherever it turns to white space."""
    if step.get("type") == "ByteLevel":
        return step.get("use_regex", True)
    pattern = step.get("pattern")
    return step.get("type") == "Split" and step.get("behavior") in ("Isolated", "Removed") and isinstance(pattern, dict) and pattern.get("Regex") in KNOWN_SPLITS


def leaves_text_alone(step: dict) -> bool:
    """Whether a step of a pre-tokenizer is known to part a text only, adding nothing where one begins; by default a ByteLevel step puts a space there."""
    return step.get("type") == "Split" or (step.get("type") == "ByteLevel" and not step.get("add_prefix_space", True))


def keeps_blanks(normalizer: dict | None) -> bool:
    """Whether a normaliser is known to do the same to a stretch as to the text it is from: none of these looks across the place before a blank, or adds anything."""
    if not normalizer:
        return True
    if normalizer.get("type") == "Sequence":
        return all(map(keeps_blanks, normalizer["normalizers"]))
    blanks = normalizer.get("type") == "Replace" and normalizer.get("pattern") == {"Regex": r"\s+"} and normalizer.get("content") == " "
    return blanks or normalizer.get("type") in ("NFC", "NFD", "Lowercase")


class JsonEncoder:
    """A file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        kinds = said.get("pre_tokenizer") or {}
        steps = kinds.get("pretokenizers", [kinds])
        cuts = any(map(cuts_at_blanks, steps)) and all(map(leaves_text_alone, steps)) and keeps_blanks(said.get("normalizer")) and not (said.get("model") or {}).get("dropout")
        self.known: dict[str, int] = {}
        self.splits_at_blanks = cuts and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in said["added_tokens"])

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def sums(self, texts: list[str]) -> list[int]:
        """As counts, by stretches."""
        if not self.splits_at_blanks:
            return self.counts(texts)
        cut = [[t] if _OTHER_BLANK.search(t) else _STRETCH.findall(t) for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        self.known.update(zip(new, self.counts(new)))
        return [sum(map(self.known.__getitem__, parts)) for parts in cut]

    def encoded(self, text: str) -> "Encoded":
        return JsonEncoded(self.encoder.encode(text, add_special_tokens=False))


class PieceEncoder:
    """A file of the sentencepiece library. Its pieces may hold blanks only where they begin, or nothing but blanks."""

    def __init__(self, path: str):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        blank = "▁"
        pieces = (self.encoder.id_to_piece(k) for k in range(self.encoder.get_piece_size()))
        self.splits_at_blanks = not any(blank in p.lstrip(blank) for p in pieces)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encoder.encode(texts, num_threads=1)]

    sums = counts

    def encoded(self, text: str) -> "Encoded":
        pieces = self.encoder.encode(text, return_type="proto").pieces
        spans = np.array([(p.begin, p.end) for p in pieces], dtype=np.int64).reshape(-1, 2)  # in bytes
        starts = (np.frombuffer(text.encode("utf-8"), dtype=np.uint8) & 0xC0) != 0x80
        return Encoded(np.concatenate(([0], np.cumsum(starts)))[spans])


class Encoded:
    """Where the tokens of a chunk start and end, in characters."""

    def __init__(self, spans: np.ndarray):
        order = np.argsort(spans[:, 0], kind="stable")
        self.starts, self.ends = spans[order, 0], np.maximum.accumulate(spans[order, 1])

    def __len__(self) -> int:
        return len(self.starts)

    def before(self, at: int) -> int | None:
        """Tokens before a place, or None if one goes across it."""
        k = int(np.searchsorted(self.starts, at, side="left"))
        return k if k == 0 or self.ends[k - 1] <= at else None


class JsonEncoded:
    """The same from the library's own encoding; all offsets are fetched only where it drops the character at a place."""

    def __init__(self, encoding):
        self.encoding, self.all = encoding, None

    def __len__(self) -> int:
        return len(self.encoding)

    def before(self, at: int) -> int | None:
        k = self.encoding.char_to_token(at)
        if k is not None:
            return k if self.encoding.token_to_chars(k)[0] == at else None
        self.all = self.all or Encoded(np.array(self.encoding.offsets, dtype=np.int64).reshape(-1, 2))
        return self.all.before(at)


def encoder(path: str):
    return worker_cache(("encoder", path), lambda: (PieceEncoder if path.endswith(".model") else JsonEncoder)(path))


def spliced_count(text: str, enc, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a long text, from overlapping chunks of it."""
    if len(text) <= chunk or not enc.splits_at_blanks:
        return enc.counts([text])[0]
    begin, end, total, skip = 0, chunk, 0, 0  # skip: tokens of this chunk that stand before the last splice
    now = enc.encoded(text[:end])
    while end < len(text):
        width, found = overlap, None
        while found is None and end - width > begin:
            start = end - width
            stop = min(len(text), start + max(chunk, 2 * width))
            after = enc.encoded(text[start:stop])
            for turn in reversed(list(_TURN.finditer(text, start + 1, end))):
                a, b = now.before(turn.start() - begin), after.before(turn.start() - start)
                if a is not None and b is not None and a >= skip:
                    found = a, b
                    break
            width *= 2
        if found is None:  # nothing left to widen into: lengthen this chunk instead
            end = min(len(text), end + chunk)
            now = enc.encoded(text[begin:end])
        else:
            total += found[0] - skip
            begin, end, now, skip = start, stop, after, found[1]
    return total + len(now) - skip


def counts_of(texts: list[str], path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    enc, out = encoder(path), np.zeros(len(texts), dtype=np.int64)
    group: list[int] = []
    held = 0

    def flush():
        nonlocal held
        if group:
            out[group] = enc.sums([texts[k] for k in group])
        group.clear()
        held = 0

    for k, text in enumerate(texts):
        if len(text) > chunk:
            out[k] = spliced_count(text, enc, chunk, overlap)
        else:
            group.append(k)
            held += len(text)
            if held >= GROUP_CHARS:
                flush()
    flush()
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            n = counts_of(batch.column(1).to_pylist(), tokenizer_path, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
