"""Training-order materialisation of token ids as fixed-stride binary shards.

Every document is encoded, ended by `eos` and cut into sequences of `seq_len` ids, the last one padded. A sequence has an
address: its document's number (doc_id, and a little of the text's hash) times the most sequences any document can have, plus
its own number. A keyed Feistel network with cycle-walking permutes the whole address space, which is known from one cheap pass
(ids, longest text) before anything is encoded, so texts are encoded once. A shard is a range of permuted addresses; it is written in their order, and
places no sequence uses are closed up: a sequence's global slot is its rank. Slots depend on the key, ids and texts alone,
not on partitions, so a rerun or a lost executor writes the same bytes.

A record is doc_id (8 bytes, NULL_ID for null), sequence number (4), ids used (4), then seq_len little-endian ids of two bytes, or of four where
the vocabulary or `eos` needs them (the manifest says which). All records have one stride, so slot s stands at a computed offset, and reading can
stop and resume anywhere.

Encoding and file writing are Arrow batches on the executors: the encoder and raw files need Python. Files are written under
another name and then moved, so a repeated task leaves one whole file. Addresses are spread evenly by the permutation; no
task holds more than a record batch. Rows with equal addresses are rows repeated exactly, as a rule; one that is repeated so often that
it would fill a shard (they are counted by key, and MOST_HOT of them listed at most) gets shards of its own at each of its places, among which
its records, all alike, are dealt evenly: the sequence of records is the same as without.

Defined cases: null or empty text is one sequence of `eos` alone; a null doc_id is numbered by its text's hash; rows with
equal addresses (repeated rows) follow each other in the order (text hash, doc_id); ids that do not fit their width are an error; other columns
are ignored; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, ship, small_batches, tidied, worker_cache

ship(__name__)

SEQ_LEN, SHARD_BYTES, KEY, EOS, PIECE_CHARS = 512, 16_000_000, 20_240_607, 50_256, 500_000
#: Addresses of each doc_id, dealt by the text's hash, so that rows that share a doc_id do not share a shard.
SAME_ID = 1024
MOST_HOT = 1_000
HEAD, NULL_ID = 16, -(2**63)
_U = np.uint64


def feistel(values: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of [0, size): walk the Feistel network of the next even power of two until back inside."""
    half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
    mask, shift = _U((1 << half) - 1), _U(half)

    def once(x):
        left, right = x >> shift, x & mask
        for r in range(rounds):
            y = (right + _U((key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) & (2**64 - 1))) * _U(0xBF58476D1CE4E5B9)
            y = (y ^ (y >> _U(29))) * _U(0x94D049BB133111EB)
            left, right = right, left ^ ((y ^ (y >> _U(32))) & mask)
        return (left << shift) | right

    out = once(values.astype(_U))
    outside = np.flatnonzero(out >= _U(size))
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= _U(size)]
    return out.astype(np.int64)


class Dealer:
    """Which shard a record belongs to: ranges of `per_shard` addresses, cut where one address (place, tag) has many records of its own.

    often: (place, tag, shards to fill). The tags before, at and after such a one at its place have shards of their own, in this order.
    """

    def __init__(self, size: int, per_shard: int, often: list[tuple[int, int, int]]):
        self.at: dict[int, list[tuple[int, int]]] = {}
        for place, tag, many in sorted(often):
            self.at.setdefault(place, []).append((tag, many))
        self.cuts = np.array(sorted({*range(per_shard, size, per_shard), *(x for p in self.at for x in (p, p + 1) if 0 < x < size)}), dtype=np.int64)
        widths = np.ones(len(self.cuts) + 1, dtype=np.int64)
        for place, tags in self.at.items():
            widths[np.searchsorted(self.cuts, place, side="right")] = 1 + sum(many + 1 for _, many in tags)
        self.first = np.cumsum(widths) - widths
        self.total, self.turn = int(widths.sum()), 0

    def shards(self, place: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Records at an address that has many are alike, and dealt by turns."""
        out = self.first[np.searchsorted(self.cuts, place, side="right")]
        for p in np.unique(place[np.isin(place, list(self.at))]).tolist() if self.at else ():
            rows = np.flatnonzero(place == p)
            for own, many in self.at[p]:
                same = rows[tag[rows] == own]
                out[rows[tag[rows] >= own]] += 1
                out[same] += (self.turn + np.arange(len(same))) % many
                out[rows[tag[rows] > own]] += many
                self.turn += len(same)
        return out


def coder(path: str, pattern: str):
    def build():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return worker_cache(("coder", path), build)


_TURN = re.compile(r"(?<=\S)(?=[ \n\r\t])")


def ids_of(text: str, path: str, pattern: str, kind: str = "<u2") -> np.ndarray:
    """Ids of a text, of a width that the vocabulary is known to fit. A very long one is encoded in pieces that part where text turns to white space: there the pattern parts it anyway."""
    enc, at, out = coder(path, pattern), 0, []
    while at < len(text):
        turn = _TURN.search(text, at + PIECE_CHARS) if len(text) - at > 2 * PIECE_CHARS else None
        end = turn.start() if turn else len(text)
        out.append(np.asarray(enc.encode_to_numpy(text[at:end], disallowed_special=())).astype(kind))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=kind)


def id_bytes(path: str, eos: int) -> int:
    """Two bytes an id where the largest of the vocabulary and `eos` fit, else four."""
    with open(path, "rb") as f:
        largest = max([eos, *(int(line.split()[1]) for line in f if line.strip())])
    if min(eos, largest) < 0 or largest >= 1 << 32:
        raise ValueError(f"ids from 0 to {largest} do not fit four bytes")
    return 2 if largest < 1 << 16 else 4


def opened(uri: str):
    """A file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, out: str, tokenizer_path: str, pattern: str, seq_len: int = SEQ_LEN, key: int = KEY, eos: int = EOS, shard_bytes: int = SHARD_BYTES) -> dict:
    """Write docs(doc_id, text) as shards under the shared folder `out`; returns the manifest, also written there."""
    small_batches(docs.sparkSession)
    wide_ids = id_bytes(tokenizer_path, eos)
    kind, width = f"<u{wide_ids}", wide_ids * seq_len
    stride = HEAD + width
    text = F.coalesce("text", F.lit(""))
    low, high, longest, total, n = docs.select("doc_id", F.octet_length(text).cast("long").alias("b")).agg(F.min("doc_id"), F.max("doc_id"), F.max("b"), F.sum("b"), F.count("*")).first()
    manifest = {"seq_len": seq_len, "stride": stride, "id_bytes": wide_ids, "key": key, "eos": eos, "shards": []}
    if n:
        low, span, most = low or 0, max((high or 0) - (low or 0) + 1, n), (longest + 1 + seq_len - 1) // seq_len  # no id is less than a byte
        wide = span * most > 1 << 62
        span = (1 << 62) // most if wide else span
        twins = SAME_ID if span * most * SAME_ID < 1 << 62 else 1
        size = span * twins * most
        expected = (total / 2.5 + n * (1 + seq_len / 2)) / seq_len * stride
        shards = max(1, round(expected / shard_bytes))
        per_shard = -(-size // shards)
        own = F.when(F.lit(wide) | F.col("doc_id").isNull(), F.expr(f"pmod(xxhash64(coalesce(cast(doc_id as string), text, '')), {span}L)")).otherwise(F.col("doc_id") - low)
        tag = F.coalesce(F.xxhash64("text"), F.lit(0))
        number = (own * twins + F.pmod(tag, F.lit(twins))).cast("long")
        full = max(2, shard_bytes // stride)  # rows of one address that would fill a shard
        counted = docs.select(number.alias("number"), tag.alias("tag"), F.octet_length(text).alias("b")).groupBy("number", "tag").agg(F.count("*").alias("n"), F.max("b").alias("b")).where(F.col("n") >= full)
        often = counted.orderBy(F.desc("n"), "number", "tag").limit(MOST_HOT).collect()
        dealer = Dealer(size, per_shard, [(int(p), r.tag, -(-r.n // full)) for r in often for p in feistel(r.number * most + np.arange((r.b + seq_len) // seq_len), size, key)])

        def encode(batches: Iterator):
            import pyarrow as pa

            for batch in batches:
                ids, tags, texts, numbers = (batch.column(k) for k in range(4))
                heads, blocks, held = [], [], 0
                for k in range(batch.num_rows):
                    got = ids_of(texts[k].as_py(), tokenizer_path, pattern, kind)
                    count = len(got) // seq_len + 1
                    block = np.full((count, seq_len), eos, dtype=kind)
                    block.ravel()[: len(got)] = got
                    used = np.full(count, seq_len)
                    used[-1] = len(got) + 1 - (count - 1) * seq_len
                    heads.append((np.full(count, k), np.arange(count), used))
                    blocks.append(block)
                    held += count
                    if k + 1 == batch.num_rows or held >= 4096:
                        row, seq, used = (np.concatenate(x) for x in zip(*heads))
                        place = feistel(numbers.to_numpy()[row] * most + seq, size, key)
                        shard = dealer.shards(place, tags.to_numpy()[row])
                        data = np.concatenate(blocks)
                        offsets = np.arange(len(row) + 1, dtype=np.int32) * width
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.astype(np.int32)), pa.array(place), ids.take(pa.array(row)), tags.take(pa.array(row)), pa.array(seq.astype(np.int32)), pa.array(used.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(data)])],
                            names=["shard", "place", "doc_id", "tag", "seq", "used", "data"],
                        )
                        heads, blocks, held = [], [], 0

        def write(batches: Iterator):
            import pyarrow as pa

            shard = sink = None
            rows = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                if sink is None:
                    shard = batch.column(0)[0].as_py()
                    files, folder = opened(out)
                    draft = f"{folder}/.{shard:08d}-{uuid.uuid4().hex}"
                    sink = files.open_output_stream(draft)
                n = batch.num_rows
                record = np.zeros((n, stride), dtype=np.uint8)
                record[:, :8] = batch.column(2).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(n, 8)
                record[:, 8:12] = batch.column(4).to_numpy().astype("<i4").view(np.uint8).reshape(n, 4)
                record[:, 12:16] = batch.column(5).to_numpy().astype("<i4").view(np.uint8).reshape(n, 4)
                data = batch.column(6)
                record[:, HEAD:] = np.frombuffer(data.buffers()[2], dtype=np.uint8)[data.offset * width :][: n * width].reshape(n, width)
                sink.write(record.tobytes())
                rows += n
            if sink is not None:
                sink.close()
                files.move(draft, f"{folder}/shard-{shard:08d}.bin")
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([rows], pa.int64())], names=["shard", "rows"])

        files, folder = opened(out)
        files.create_dir(folder, recursive=True)
        rows = docs.select("doc_id", tag.alias("tag"), text.alias("text"), number.alias("number"))
        coded = rows.mapInArrow(tidied(encode), "shard int, place long, doc_id long, tag long, seq int, used int, data binary")
        ordered = coded.repartitionById(dealer.total, F.col("shard")).sortWithinPartitions("place", "tag", "doc_id")
        start = 0
        for shard, count in sorted(tuple(r) for r in ordered.mapInArrow(tidied(write), "shard int, rows long").collect()):
            manifest["shards"].append({"shard": shard, "file": f"shard-{shard:08d}.bin", "start": start, "rows": count})
            start += count
    files, folder = opened(out)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def load_manifest(out: str) -> dict:
    files, folder = opened(out)
    with files.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def unpacked(raw: bytes, stride: int, wide: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, sequence numbers, ids used, and the ids (of `wide` bytes) of records."""
    record = np.frombuffer(raw, dtype=np.uint8).reshape(-1, stride)
    part = lambda a, b, t: np.ascontiguousarray(record[:, a:b]).view(t)
    return part(0, 8, "<i8").ravel(), part(8, 12, "<i4").ravel(), part(12, 16, "<i4").ravel(), part(HEAD, stride, f"<u{wide}")


def records(out: str, slot: int = 0, block: int = 1024) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """Sequential read from a slot on: (slot, doc_id, sequence number, ids used)."""
    manifest = load_manifest(out)
    files, folder = opened(out)
    for shard in manifest["shards"]:
        if shard["start"] + shard["rows"] <= slot:
            continue
        with files.open_input_file(f"{folder}/{shard['file']}") as f:
            f.seek((slot - shard["start"]) * manifest["stride"])
            while slot < shard["start"] + shard["rows"]:
                docs, seqs, used, ids = unpacked(f.read(min(block, shard["start"] + shard["rows"] - slot) * manifest["stride"]), manifest["stride"], manifest["id_bytes"])
                for k in range(len(docs)):
                    yield slot, None if docs[k] == NULL_ID else int(docs[k]), int(seqs[k]), ids[k, : used[k]]
                    slot += 1


def read_shards(spark: SparkSession, out: str, manifest: dict | None = None) -> DataFrame:
    """slot, doc_id, seq, n_tokens, crc (CRC-32 of the ids used, little-endian), read back from the files."""
    manifest = manifest or load_manifest(out)
    starts = {x["file"]: x["start"] for x in manifest["shards"]}
    stride, wide = manifest["stride"], manifest["id_bytes"]
    schema = "slot long, doc_id long, seq int, n_tokens int, crc long"
    if not starts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                slot = starts[path.rpartition("/")[2]]
                for at in range(0, len(raw), 4096 * stride):
                    docs, seqs, used, ids = unpacked(raw[at : at + 4096 * stride], stride, wide)
                    crc = [zlib.crc32(x[:n]) for x, n in zip(ids, used)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(slot, slot + len(docs))), pa.array(docs, mask=docs == NULL_ID), pa.array(seqs), pa.array(used), pa.array(crc, pa.int64())], names=["slot", "doc_id", "seq", "n_tokens", "crc"])
                    slot += len(docs)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(out)
    return files.select("path", "content").mapInArrow(tidied(run), schema)


def materialise_order(docs: DataFrame, tokenizer_path: str, pattern: str, **how) -> DataFrame:
    """Write the shards to a new folder of the shared scratch space and read them back."""
    out = scratch_path(docs.sparkSession, "shards")
    return read_shards(docs.sparkSession, out, write_shards(docs, out, tokenizer_path, pattern, **how))
