"""Token-id output in training order: a keyed Feistel permutation gives every sequence a global slot, range partitions write fixed-stride shards.

The documents' ids, each with an end id, are one stream, in the order of the input files' names and of the rows in them, however
the files are split (rows that come from no file: in the order of their tasks). It is cut into sequences of `length` ids; the last one is padded
with the end id. Sequence s gets slot P(s), where P is a Feistel network over the next power of four, walked along its
cycle until it is below the number of sequences. Shards hold `per_shard` slots one after another as little-endian
unsigned integers of 2 bytes (4 for larger vocabularies): slot s is at byte (s mod per_shard) * stride of shard
s div per_shard, so that reading can start anywhere.

The ids are written once and compressed, and move once, to the range partition of their slots. Shard files are
written by tasks under a name of their own and then renamed, so a task that runs twice leaves one file.

Edge cases: a null or empty text is the end id alone; repeated rows are documents each; an empty table has no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import buffers, chunks, shared_dir, stored, tune
from .tokens import default_vocabulary, tokenizer

LENGTH, END_ID, KEY, ROUNDS = 2048, 1, 20240229, 4
SHARD_BYTES = 16 << 20
_M = (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M
    return x ^ x >> 31


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0 .. n - 1 and its inverse."""

    n: int
    key: int = KEY

    @property
    def half(self) -> int:
        return max(1, ((self.n - 1).bit_length() + 1) // 2)

    def _round(self, r: int, x: int) -> int:
        return _mix(_mix(self.key + r * 0x9E3779B97F4A7C15 & _M) ^ x) & (1 << self.half) - 1

    def slot(self, s: int) -> int:
        while True:
            a, b = s >> self.half, s & (1 << self.half) - 1
            for r in range(ROUNDS):
                a, b = b, a ^ self._round(r, b)
            s = a << self.half | b
            if s < self.n:
                return s

    def sequence(self, slot: int) -> int:
        while True:
            a, b = slot >> self.half, slot & (1 << self.half) - 1
            for r in reversed(range(ROUNDS)):
                a, b = b ^ self._round(r, a), a
            slot = a << self.half | b
            if slot < self.n:
                return slot


#: Where a run of documents stands in the stream: the file, the place in it where its block begins, and, without files, the task.
PLACE = ["__file", "__at", "__part"]


def token_table(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """The stream of ids in runs of some documents: PLACE, before (ids before the run in its block), n and ids (zstd of 4-byte integers by bytes); written."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pack, at, place = tokenizer(vocabulary), zstandard.ZstdCompressor(level=6), 0, None
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            where = list(zip(*(batch.column(c).to_pylist() for c in PLACE), strict=True))
            cuts = [k for k in range(1, len(where)) if where[k] != where[k - 1]]
            for first, last in zip([0, *cuts], [*cuts, len(where)], strict=True):
                if first == last:
                    continue
                if where[first] != place:
                    place, at = where[first], 0
                for i, j in chunks(offsets[first : last + 1], 4 << 20):
                    i, j = i + first, j + first
                    flat, counts = own.ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    ids = np.insert(flat, np.cumsum(counts), end_id)
                    # low bytes first, then high ones: ids pack better so
                    raw = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
                    yield pa.RecordBatch.from_arrays([*(batch.column(c)[i : i + 1] for c in PLACE), pa.array([at]), pa.array([len(ids)]), pa.array([pack.compress(raw)], pa.binary())], [*PLACE, "before", "n", "ids"])
                    at += len(ids)

    # a task reads blocks of several files, and which ones depends on how the input is split; the place in a file doesn't
    file = F.input_file_name()
    rows = docs.select("text", file.alias("__file"), F.input_file_block_start().alias("__at"), F.when(file == "", F.spark_partition_id()).otherwise(0).alias("__part"))
    return stored(rows.mapInArrow(run, "__file string, __at long, __part int, before long, n long, ids binary"), "uncompressed")


def unpack(ids: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def write(docs: DataFrame, path: str, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards of docs (text) below `path`, and returns a row for each slot: slot, sequence, shard, byte_offset, n_bytes, ids_crc32."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    tokens = token_table(docs, vocabulary, end_id)
    # ids before each block's first one: a number for each block of the scan
    parts = sorted((tuple(r[c] for c in PLACE), r["n"]) for r in tokens.groupBy(*PLACE).agg(F.sum("n").alias("n")).collect())
    base, total = {}, 0
    for place, n in parts:
        base[place], total = total, total + n
    n = -(-total // length)
    width = 2 if _vocabulary_size(vocabulary) <= 1 << 16 else 4
    stride = length * width
    per_shard = max(1, shard_bytes // stride)
    permutation = Permutation(max(n, 1), key)
    kind = f"<u{width}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for *place, before, ids in zip(*(batch.column(c).to_pylist() for c in (*PLACE, "before", "ids")), strict=True):
                own, at = unpack(ids).astype(kind), base[tuple(place)] + before
                end = at + len(own)
                for s in range(at // length, -(-end // length)):
                    a, b = max(at, s * length), min(end, (s + 1) * length)
                    raw = own[a - at : b - at]
                    for column, v in zip(out, (permutation.slot(s), s, a - s * length, pack.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, width).T).tobytes())), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["slot", "sequence", "start", "ids"])

    pieces = tokens.select(*PLACE, "before", "ids").mapInArrow(cut, "slot long, sequence long, start long, ids binary")
    shards = -(-n // per_shard)
    pieces = pieces.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    # a shard is a range of slots, of a fixed number of bytes, and so is a task of one or a few
    ranged = pieces.repartitionById(max(1, shards), "shard").sortWithinPartitions("shard", "slot", "start")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = filesystem(path)
        unzip = zstandard.ZstdDecompressor()
        shard, file, name, slot, filled, rows = None, None, "", None, [], []

        def flush_slot() -> None:
            if slot is not None:
                raw = b"".join(filled)
                raw += np.full(length, end_id, kind).tobytes()[len(raw) :]
                file.write(raw)
                rows[-1][5] = zlib.crc32(raw)

        def close() -> pa.RecordBatch:
            file.close()
            fs.move(name, f"{root}/shard-{shard:06d}.bin")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["slot", "sequence", "shard", "byte_offset", "n_bytes", "ids_crc32"])

        for batch in batches:
            for own_shard, own_slot, sequence, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "sequence", "ids")), strict=True):
                if own_slot != slot:
                    flush_slot()
                    if own_shard != shard:
                        if file is not None:
                            yield close()
                        shard, rows = own_shard, []
                        fs.create_dir(root)
                        name = f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
                        file = fs.open_output_stream(name)
                    slot, filled = own_slot, []
                    rows.append([slot, sequence, shard, (slot - shard * per_shard) * stride, stride, 0])
                raw = np.frombuffer(unzip.decompress(ids), np.uint8)
                filled.append(np.ascontiguousarray(raw.reshape(width, -1).T).tobytes())
        if file is not None:
            flush_slot()
            yield close()

    return stored(ranged.mapInArrow(save, "slot long, sequence long, shard int, byte_offset long, n_bytes long, ids_crc32 long"))


def _vocabulary_size(vocabulary: str) -> int:
    return tokenizer(vocabulary).tokenizer.get_vocab_size()


def read_slots(path: str, first: int, count: int, length: int, width: int, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Slots first .. first + count - 1 as an array (count, length): sequential reads that may start at any slot."""
    fs, root = filesystem(path)
    stride, per_shard = length * width, max(1, shard_bytes // (length * width))
    out = []
    while count:
        shard, at = divmod(first, per_shard)
        some = min(count, per_shard - at)
        with fs.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(at * stride)
            out.append(np.frombuffer(f.read(some * stride), f"<u{width}").reshape(some, length))
        first, count = first + some, count - some
    return np.concatenate(out)


def materialise(docs: DataFrame) -> DataFrame:
    """write() into a new folder of the shared one."""
    return write(docs, shared_dir(docs.sparkSession))
