"""Shared pieces: tables in the cluster's shared folder, Arrow buffers as numpy arrays, hashed words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of one Arrow batch. Texts can be long, so batches stay small.
BATCH_ROWS = 256
#: Bytes of text that are worked on at once inside a task.
CHUNK_BYTES = 1 << 19


def tune(spark: SparkSession) -> None:
    """Session settings that bound the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors see, below spark.checkpoint.dir. Only a local master may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-millwright-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millwright-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there, and lost executors cost only their tasks."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that a broadcast may hold.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """Rows of a few numbers, written; a join with them is a broadcast if they are at most BROADCAST_ROWS, and shuffled else."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hidden(df: DataFrame, own: list[str]) -> DataFrame:
    """The columns `own`, and all others as one, so that no name of theirs can clash with a name that an operator adds."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in own]
    return df.select(*[F.col(f"`{c}`") for c in own], (F.struct(*rest) if rest else F.lit(True)).alias("__others"))


def shown(df: DataFrame, names: list[str], own: list[str]) -> DataFrame:
    """The columns `names` of a table that hidden() made, in their order."""
    return df.select(*[F.col(f"`{c}`") if c in own else F.col(f"__others.`{c}`").alias(c) for c in names])


# --- Arrow buffers -----------------------------------------------------------------------------


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the row offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `limit` bytes together; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# --- Words and their hashes --------------------------------------------------------------------

#: Upper-case A-Z become lower case; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z, all of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Bytes between the chunks that a tokenizer which drops white space can see one by one.
GAP = np.ones(256, bool)
GAP[[9, 10, 13, 32]] = False

_R = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are read as three integers; a longer word is hashed on its own.
_READ = 24
#: The lower n bytes of an integer.
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run of `table` bytes, and the number of words of each row. No run crosses rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    w = table[data]
    edge = np.empty(n + 1, bool)
    edge[1:n] = w[1:] != w[:-1]
    edge[0] = edge[n] = True
    cuts = offsets[1:-1]
    edge[cuts] = True
    before = np.zeros(n, bool)
    before[1:] = w[:-1]
    starts = np.flatnonzero(edge[:n] & w)
    ends = np.flatnonzero(edge[1:] & w) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; another seed gives an independent one. Words of one length of 8 bytes at most never share it."""
    n = ends - starts
    h = (n.astype(np.uint64) + np.uint64(seed << 32)) * _R
    room = np.zeros(len(data) + _READ + 8, np.uint8)
    room[: len(data)] = data
    at = np.ndarray(len(data) + _READ + 1, "<u8", room, strides=(1,))
    h = mix(h ^ (at[starts] & _LOWEST[np.minimum(n, 8)]))
    for first in (8, 16):
        more = np.flatnonzero(n > first)
        h[more] = mix(h[more] ^ (at[starts[more] + first] & _LOWEST[np.minimum(n[more] - first, 8)]))
    for k in np.flatnonzero(n > _READ).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]], seed)
    return h


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, without regard to rows: len(hashes) - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _R
        out += hashes[j : j + n]
    return mix(out + np.uint64(k))
