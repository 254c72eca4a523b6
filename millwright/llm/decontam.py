"""Benchmark decontamination: a broadcast hash set of the items' word windows, a scan of every word window of every
document, and an exact check of each hit against the item's words.

A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window. A document's word
inside any occurrence of a window is hit; a document is contaminated if it has a hit and at least 5 % of its words are.

The set is broadcast while the items have at most `block_bytes` of text; larger benchmarks are scanned in blocks of
that size, one after another (the driver holds two blocks at most), and the hit words of all blocks are united. Documents are
read once for each block.

Edge cases: null or wordless texts have no words and no hits; an item id that is null counts no item, though its
windows hit; items with the same id are one item; repeated documents are judged each for itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import LOWER, buffers, chunks, hidden, shown, stored, tune, window_hashes, word_hashes, words

WINDOW = 13
#: Bytes of item texts in one broadcast set.
BLOCK_BYTES = 16 << 20


class Windows:
    """The windows of some items, in arrays: by length of the window a bit table and sorted hashes; for each different
    window the place of its words in the items' text, and its items. About 40 bytes a word."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        data, offsets = buffers(pa.array([t for _, t in items], pa.large_string()))
        self.raw = LOWER[data].tobytes()
        data = np.frombuffer(self.raw, np.uint8)
        self.names = [i for i, _ in items]
        starts, ends, hashes, counts = [], [], [], []
        for i, j in chunks(offsets):  # hashing needs many bytes for each one of text
            own = data[offsets[i] : offsets[j]]
            a, b, n = words(own, offsets[i : j + 1] - offsets[i])
            hashes.append(word_hashes(own, a, b))
            starts.append((a + offsets[i]).astype(np.int64))
            ends.append((b + offsets[i]).astype(np.int64))
            counts.append(n)
        none = [np.zeros(0, np.int64)]
        self.starts, self.ends, counts = (np.concatenate(x or none) for x in (starts, ends, counts))
        hashes = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        own_size = np.minimum(counts, size)
        self.by_size = {}
        for k in np.unique(own_size[own_size > 0]).tolist():
            rows = np.flatnonzero(own_size == k)
            n = counts[rows] - k + 1
            item = np.repeat(rows, n)
            at = np.repeat(first[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = window_hashes(hashes, k)[at]
            order = np.lexsort((at, h))
            h, at, item = h[order], at[order], item[order]
            # entries of one hash are one window, but for collisions
            lead = np.concatenate([[True], h[1:] != h[:-1]])
            ends_of = np.append(np.flatnonzero(lead)[1:], len(h))
            for a, b in zip(np.flatnonzero(lead).tolist(), ends_of.tolist(), strict=True):
                if b - a > 1:
                    own = [self.words(x, k) for x in at[a:b].tolist()]
                    if any(w != own[0] for w in own):
                        by_words = sorted(range(b - a), key=lambda x: own[x])
                        at[a:b], item[a:b] = at[a:b][by_words], item[a:b][by_words]
                        lead[a + 1 : b] = [own[x] != own[y] for x, y in zip(by_words[1:], by_words, strict=False)]
            heads = np.flatnonzero(lead)
            keys = h[heads]
            bits = max(16, int(len(keys) * 16).bit_length())
            table = np.zeros(1 << bits - 3, np.uint8)
            slot = keys >> np.uint64(64 - bits)
            np.bitwise_or.at(table, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
            self.by_size[k] = (np.uint64(64 - bits), table, keys, at[heads], np.append(heads, len(h)), item)

    def words(self, first: int, k: int) -> tuple[bytes, ...]:
        return tuple(self.raw[a:b] for a, b in zip(self.starts[first : first + k].tolist(), self.ends[first : first + k].tolist(), strict=True))

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, set]]]:
        """Words of each row, and (row, first word, end word, items) of each verified occurrence."""
        data = LOWER[data]
        starts, ends, counts = words(data, offsets)
        out = []
        if len(starts):
            first = np.concatenate([[0], np.cumsum(counts)])
            hashes = word_hashes(data, starts, ends)
            for k, (shift, table, keys, at, ptr, item) in self.by_size.items():
                h = window_hashes(hashes, k)
                slot = h >> shift
                maybe = np.flatnonzero(table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & np.uint8(1))
                maybe = maybe[np.isin(h[maybe], keys)]
                if not len(maybe):
                    continue
                row = np.searchsorted(first, maybe, "right") - 1
                inside = maybe + k <= first[row + 1]
                for w, r in zip(maybe[inside].tolist(), row[inside].tolist(), strict=True):
                    own = tuple(data[a:b].tobytes() for a, b in zip(starts[w : w + k].tolist(), ends[w : w + k].tolist(), strict=True))
                    for g in range(*(int(np.searchsorted(keys, h[w], side)) for side in ("left", "right"))):
                        if self.words(int(at[g]), k) == own:
                            out.append((r, w - int(first[r]), w - int(first[r]) + k, {self.names[x] for x in item[ptr[g] : ptr[g + 1]].tolist()}))
        return counts, out


def _scan(docs: DataFrame, windows: Windows) -> DataFrame:
    """Adds __n_words, __hits (ranges of hit words, merged) and __items to `docs` (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            n_words, hits, items = [], [[] for _ in range(len(batch))], [set() for _ in range(len(batch))]
            for i, j in chunks(offsets):
                counts, found = own.hits(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_words += counts.tolist()
                for r, a, b, which in sorted(found, key=lambda x: x[:3]):
                    ranges = hits[i + r]
                    if ranges and a <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], b)
                    else:
                        ranges.append([a, b])
                    items[i + r] |= which
            more = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + more, [*names, "__n_words", "__hits", "__items"])

    schema = T.StructType(list(docs.schema.fields)).add("__n_words", "long").add("__hits", T.ArrayType(T.ArrayType(T.LongType()))).add("__items", T.ArrayType(T.StringType()))
    return docs.mapInArrow(run, schema)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[Windows]:
    """The windows of all items, in blocks of about `block_bytes` of text, one after another; one at least."""
    items = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    items = stored(items) if n > 1 else items
    for b in range(n):
        yield Windows([tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()])


def _found(docs: DataFrame, items: DataFrame, block_bytes: int) -> DataFrame:
    """`docs` with __n_words, __hits (ranges of hit words, which may overlap if there are several blocks) and __items (ids as text, sorted, distinct)."""
    tune(docs.sparkSession)
    blocks = _blocks(items, block_bytes)
    windows, after = next(blocks), next(blocks, None)
    if after is None:
        return _scan(docs, windows)
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    parts = None
    while windows is not None:  # each block is scanned and written before the next one is made
        one = stored(_scan(rows.select("__row", "text"), windows).select("__row", "__n_words", "__hits", "__items"))
        parts = one if parts is None else parts.unionByName(one)
        windows, after = after, next(blocks, None)
    united = parts.groupBy("__row").agg(F.first("__n_words").alias("__n_words"), F.flatten(F.collect_list("__hits")).alias("__hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))
    return rows.join(united, "__row").drop("__row")


def scan(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with __n_words, __n_hit, __items (ids as text, sorted, distinct); columns of `docs` must not have these names."""
    found = _found(docs, items, block_bytes)
    merged = F.aggregate(F.array_sort("__hits"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x[1] - F.greatest(x[0], s["end"]))).alias("n"), F.greatest(x[1], s["end"]).alias("end")))
    return found.withColumn("__n_hit", merged["n"]).drop("__hits")


def _contaminated() -> Column:
    return (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))


def report(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = scan(docs.select("doc_id", "text"), items, block_bytes)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"), _contaminated().alias("contaminated"))


def remove_documents(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that aren't contaminated, as they are."""
    return shown(scan(hidden(docs, ["text"]), items, block_bytes).where(~_contaminated()), docs.columns, ["text"])


def remove_spans(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with the hit words, and what stands between hit words of one span, cut from the texts. The hits of all
    blocks are found in the texts as they were; what the cuts bring together isn't scanned again."""
    return shown(_cut(_found(hidden(docs, ["text"]), items, block_bytes), ["text", "__others"]), docs.columns, ["text"])


def _cut(found: DataFrame, names: list[str]) -> DataFrame:
    schema = found.select(*[F.col(f"`{c}`") for c in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            texts = []
            for k, (text, hits) in enumerate(zip(batch.column("text").to_pylist(), batch.column("__hits").to_pylist(), strict=True)):
                if hits:
                    raw = data[offsets[k] : offsets[k + 1]]
                    starts, ends, _ = words(LOWER[raw], np.array([0, len(raw)]))
                    keep = np.ones(len(raw), bool)
                    for a, b in hits:
                        keep[starts[a] : ends[b - 1]] = False
                    text = raw[keep].tobytes().decode()
                texts.append(text)
            columns = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(run, schema)


def brute_force(docs: list[tuple], items: list[tuple], size: int = WINDOW) -> list[tuple]:
    """The contract, plainly, for tests: rows (id, text) in, digests out."""
    import re

    own = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    of = [(i, own(t)) for i, t in items]
    out = []
    for doc, text in docs:
        ws, hit, ids = own(text), set(), set()
        for item, iw in of:
            k = min(len(iw), size)
            grams = {tuple(iw[a : a + k]) for a in range(len(iw) - k + 1)} if k else set()
            for a in range(len(ws) - k + 1 if k else 0):
                if tuple(ws[a : a + k]) in grams:
                    hit |= set(range(a, a + k))
                    ids.add(item)
        names = sorted(str(i) for i in ids if i is not None)
        out.append((doc, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, w[i : i + least(len(w), 13) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, w[i : i + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
