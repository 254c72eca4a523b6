"""Filter interaction audit: what five filters remove, alone, together and in every order, by part of the corpus.

One pass of a byte transducer goes over the UTF-8 text: a table of byte classes and, for each state (between words, in a
word) and class, the next state and what is emitted: a word begins or ends, a capital, a code point, a symbol. The next
state follows from the byte alone, so the states of a whole block are one lookup. The word spans go into a table of
open addresses that compares the bytes of words, not only their hashes; a span that finds its word there isn't new.

Filters, by what fails: A under 50 words; B fewer than 65 distinct words in 100; C more than 5 capitals A-Z in 100 code
points; D any of #$%&*|; E the text of a smaller doc_id, removed or not. A row's failures are five bits, and a part of
the corpus is at most 32 cells of rows with equal bits. All orders are computed from the cells: what a filter removes
are the cells with its bit and without those of the filters before it.

Edge cases: a null text is empty and a null part the empty string; texts without words fail A alone, and E if a smaller
doc_id has none either; a row without a doc_id fails E never, and rows that share doc_id and text don't make each other
fail it; several labels of a document count as one that is good or toxic if any is; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import buffers, chunks, few, mix, stored, tune, word_hashes

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PER_100, CAPITALS_PER_100 = 50, 65, 5
#: Classes of bytes: white space, A-Z, symbols, other ASCII, bytes that go on with a character, first bytes of longer characters.
SPACE, CAPITAL, SYMBOL, PLAIN, GOES_ON, FIRST = range(6)
CLASS = np.full(256, PLAIN, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[65:91] = CAPITAL
CLASS[np.frombuffer(b"#$%&*|", np.uint8)] = SYMBOL
CLASS[128:192], CLASS[192:] = GOES_ON, FIRST
#: What is emitted, as bits.
BEGINS, ENDS, IS_CAPITAL, IS_POINT, IS_SYMBOL = 1, 2, 4, 8, 16
_ALWAYS = np.array([IS_POINT, IS_POINT | IS_CAPITAL, IS_POINT | IS_SYMBOL, IS_POINT, 0, IS_POINT], np.uint8)
#: The state after each class, and what is emitted in each state (between words, in a word) at each class.
NEXT = np.array([0, 1, 1, 1, 1, 1], np.uint8)
EMIT = np.stack([_ALWAYS | np.where(NEXT == 1, BEGINS, 0), _ALWAYS | np.where(NEXT == 0, ENDS, 0)]).astype(np.uint8)


def transduce(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, the number of words of each row, and (rows, 3) capitals, code points and symbols."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(rows, np.int64), np.zeros((rows, 3), np.int64)
    kind = CLASS[data]
    after = NEXT[kind]
    state = np.zeros(n, np.uint8)
    state[1:] = after[:-1]
    state[offsets[:-1][offsets[:-1] < n]] = 0
    emitted = EMIT[state, kind]
    starts = np.flatnonzero(emitted & BEGINS)
    ends = np.zeros(n + 1, bool)
    ends[:-1] = (emitted & ENDS) > 0
    full = offsets[1:][offsets[1:] > offsets[:-1]]
    ends[full[after[full - 1] == 1]] = True  # a word at the end of a row
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[offsets])
    counts = np.stack([sums((emitted & bit) > 0) for bit in (IS_CAPITAL, IS_POINT, IS_SYMBOL)], 1)
    return starts, np.flatnonzero(ends), np.diff(np.searchsorted(starts, offsets)), counts


def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the words a and b, which are equally long, have the same bytes: eight at a time, as long as they agree."""
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    at = np.ndarray(len(data) + 1, "<u8", room, strides=(1,))
    n, good, live, first = ends[a] - starts[a], np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        lowest = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(n[live] - first, 8)).astype(np.uint64))
        differ = ((at[starts[a[live]] + first] ^ at[starts[b[live]] + first]) & lowest) != 0
        good[live[differ]] = False
        first += 8
        live = live[~differ & (n[live] > first)]
    return good


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The number of different words of each row, by a hash table of all rows' words in which equal hashes are checked by the bytes."""
    n, row = len(starts), np.repeat(np.arange(len(counts)), counts)
    h = word_hashes(data, starts, ends)
    h = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    size = 1 << int(2 * n + 1).bit_length()
    place = (h & np.uint64(size - 1)).astype(np.int64)
    held, new, todo = np.full(size, -1, np.int64), np.zeros(n, bool), np.arange(n)
    while len(todo):
        at = place[todo]
        free = held[at] < 0
        held[at[free]] = todo[free]  # of several, the last one stays
        owner = held[at]
        new[todo[owner == todo]] = True
        rest = owner != todo
        todo, owner = todo[rest], owner[rest]
        like = (h[owner] == h[todo]) & (row[owner] == row[todo]) & (ends[owner] - starts[owner] == ends[todo] - starts[todo])
        like[like] = _same(data, starts, ends, owner[like], todo[like])
        todo = todo[~like]
        place[todo] = (place[todo] + 1) & (size - 1)
    return np.bincount(row[new], minlength=len(counts))


def facts(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, failed (bits of A to D), and the first 128 bits of the text's SHA-256 (k1, k2) of every row of docs (doc_id, text, part)."""
    tune(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets):
                own, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, n, counts = transduce(own, offs)
                capitals, points, symbols = counts.T
                different = distinct_words(own, starts, ends, n)
                failed = (n < LEAST_WORDS) * 1 + (100 * different < DISTINCT_PER_100 * n) * 2 + (100 * capitals > CAPITALS_PER_100 * points) * 4 + (symbols > 0) * 8
                prints = np.frombuffer(b"".join(hashlib.sha256(own[a:b]).digest()[:16] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), "<i8").reshape(-1, 2)
                columns = [batch.column(c)[i:j] for c in ("doc_id", "part")] + [pa.array(failed.astype(np.int32)), pa.array(np.ascontiguousarray(prints[:, 0])), pa.array(np.ascontiguousarray(prints[:, 1]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "failed", "k1", "k2"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, part string, failed int, k1 long, k2 long")


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, failed (bits of A to E), n, good and toxic: rows, and those among them with such a label."""
    rows = stored(facts(docs, part))
    copied = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(few(copied), ["k1", "k2"], "left")
    rows = rows.withColumn("failed", F.col("failed") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0))
    marks = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).where("doc_id is not null")
    rows = rows.groupBy("doc_id", "part", "failed").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")  # rows without an id are one for each cell
    return rows.groupBy("part", "failed").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders of the filters."""
    of = cells(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))).alias("filter_order")
    rows = of.select("part", "cells", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda place: F.pow(F.lit(2), F.ascii(F.substr("filter_order", place, F.lit(1))) - ord("A")).cast("int")
    before = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: k < F.col("step")), F.lit(0), lambda bits, k: bits.bitwiseOR(bit_of(k)))
    rows = rows.select("*", bit_of(F.col("step")).alias("own"), before.alias("earlier"))

    def total(condition, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", condition), F.lit(0).cast("long"), lambda s, c: s + value(c))

    fails = lambda c, bits: c["failed"].bitwiseAND(F.col(bits)) != 0
    here = lambda c: fails(c, "own") & ~fails(c, "earlier")
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c, "own") & ~fails(c, "earlier")).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: fails(c, "own") & fails(c, "earlier")).alias("redundant"),
        total(lambda c: c["failed"] == F.col("own")).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        # of the orders of a row's failed filters, each filter is first in an equal share
        total(lambda c: fails(c, "own"), lambda c: c["n"] * (F.lit(120) / F.bit_count(c["failed"])).cast("long")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
m AS (SELECT doc_id, part,
        (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS failed FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits
      FROM f a, f b, f x, f y, f z WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31
      AND (a.bit | b.bit | x.bit | y.bit | z.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step]) - bits[step] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN failed & (own + earlier) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN failed & own <> 0 AND failed & earlier = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN failed & own <> 0 AND failed & earlier <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN failed & own <> 0 AND failed & earlier = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN failed & own <> 0 AND failed & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
