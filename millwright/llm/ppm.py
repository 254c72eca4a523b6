"""LM scoring: prediction by partial matching over the bytes of texts, learned from the whole corpus, and a base score of words.

The model is a trie of byte contexts up to `order` bytes. At a context, a symbol seen c times of T in training, of D different
ones, gets (c - 1/2) / T; the escape to the context without its first byte gets (D / 2) / T (method D). Symbols that the
longer context has seen are excluded from the shorter one, as it was left because none of them came. Below the empty
context all symbols that nothing excludes are equal. A text is read after `order` starts, and an end is its last symbol.

What a longer context has seen the shorter one has, too. So what is excluded on the way depends on the last context alone: T
less the counts of its symbols, D less their number. Level by level of the trie, in Spark, each gram (a context and a
symbol) gets its code length from the gram without its first byte, by joins; contexts have 257 symbols at most.

Texts are read in chunks of bounded size. A chunk's different grams and words, with their counts in training texts, are
added up over the corpus; the grams' code lengths, and the counts of words that other chunks have too, go back to the
chunks that hold them, and there each text adds up its own. So no table of all grams or words is ever in one task,
however large it gets.

Training rows are scored with what they themselves have given to the counts, as in the base score.

Edge cases: a null or empty text is the end alone; a row without an id isn't held out; repeated rows count each; with
no training rows every symbol is as likely as any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import LOWER, buffers, chunks, stored, tune, words
from .tokens import piece_hashes

ORDER = 4
#: Bytes of a byte's value, and the end.
SYMBOLS = 257
#: Symbols of no UTF-8 text: what stands before a text, and its end.
START, END = 0xFE, 0xFF
#: Bytes of text whose grams and words are counted at once, and of what is worked on at once.
CHUNK_TEXT, BLOCK = 32 << 20, 1 << 20
TOKEN = np.ones(256, bool)
TOKEN[[9, 10, 11, 12, 13, 32]] = False
#: Words are known by two hashes, grams by their bytes and this in place of the second one. The end of a text is a word of its own.
GRAM, TEXT_END = -1, (0, 0)


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that aren't learned from: crc32 of the id as text, modulo 10, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every symbol of each row, its end included, as an integer of order + 1 bytes; and each row's first one."""
    rows = len(offsets) - 1
    n = np.diff(offsets) + order + 1
    firsts = np.concatenate([[0], np.cumsum(n)])
    own = np.full(int(firsts[-1]), START, np.uint8)
    own[firsts[1:] - 1] = END
    text = np.arange(len(data)) + np.repeat(order * np.arange(1, rows + 1) + np.arange(rows), np.diff(offsets))
    own[text] = data
    wide = own.astype(np.uint64)
    grams = np.zeros(len(own), np.uint64)
    for back in range(order, -1, -1):
        grams[order:] = (grams[order:] << np.uint64(8)) | wide[order - back : len(own) - back]
    real = np.ones(len(own), bool)
    real[(firsts[:-1, None] + np.arange(order)).reshape(-1)] = False
    return grams[real].view(np.int64), np.concatenate([[0], np.cumsum(n - order)])


def token_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word of each row, and the number of words of each row."""
    starts, ends, per_row = words(data, offsets, TOKEN)
    a, b = (h.view(np.int64) for h in piece_hashes(data, starts, ends))
    return a, np.where(b == GRAM, GRAM - 1, b), per_row


def _counted(k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((k2, k1))
    k1, k2, n = k1[order], k2[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])[: len(k1)])
    return k1[at], k2[at], np.add.reduceat(n, at) if len(at) else n


def read(docs: DataFrame, order: int = ORDER, chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """Rows of texts, a block of documents each: chunk, ids, held (not learned from), ends (of their texts in bytes) and texts (lower case, zstd).
    Rows of what chunks hold: chunk, k1, k2 and n, the count in training texts. Written."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "ids", "held", "ends", "texts", "k1", "k2", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, parts, id_type, pack = TaskContext.get().partitionId() << 32, 0, [], pa.null(), zstandard.ZstdCompressor(level=6)
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

        def flush() -> Iterator[pa.RecordBatch]:
            k1, k2, n = _counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for i in range(0, len(k1), 1 << 16):
                m = len(k1[i : i + (1 << 16)])
                none = [pa.nulls(m, t) for t in (pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), *none, *(pa.array(x[i : i + m]) for x in (k1, k2, n))], names)

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            id_type = batch.column("doc_id").type
            for i, j in chunks(offsets, BLOCK):
                own, offs = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                held = batch.column("held_out")[i:j]
                train = ~held.to_numpy(zero_copy_only=False)
                grams, firsts = grams_of(own, offs, order)
                # sorted with the training flag as the last bit, each gram's counts are two runs
                flagged, n = np.unique(grams << 1 | np.repeat(train, np.diff(firsts)), return_counts=True)
                a, b, per_row = token_keys(own, offs)
                parts.append(_counted(np.concatenate([flagged >> 1, a, [TEXT_END[0]]]), np.concatenate([np.full(len(flagged), GRAM), b, [TEXT_END[1]]]), np.concatenate([n * (flagged & 1), np.repeat(train, per_row), [int(train.sum())]]).astype(np.int64)))
                row = [listed(batch.column("doc_id")[i:j]), listed(held), listed(pa.array(offs[1:])), pa.array([pack.compress(own.tobytes())], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *row, *(pa.nulls(1, pa.int64()) for _ in range(3))], names)
                size += int(offsets[j] - offsets[i])
                if size >= chunk_text:
                    yield from flush()
                    number, size, parts = number + 1, 0, []
        if parts:
            yield from flush()

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return stored(rows.mapInArrow(run, f"chunk long, ids array<{kind}>, held array<boolean>, ends array<long>, texts binary, k1 long, k2 long, n long"))


def shared_words(tokens: DataFrame) -> tuple[DataFrame, int, int]:
    """From words of chunks (chunk, k1, k2, n): the words that several chunks have, with their count in all (chunk, k1, k2, value), written; the count of all words, and the number of different ones, in training."""
    same = Window.partitionBy("k1", "k2")  # a row for each chunk at most
    rows = tokens.select("chunk", "k1", "k2", "n", F.sum("n").over(same).alias("total"), (F.col("chunk") == F.min("chunk").over(same)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = different = 0
        for batch in batches:
            n, total, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "total", "first"))
            many, different = many + int(n.sum()), different + int((first & (total > 0)).sum())
            other = pa.array(total != n)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(other) for c in ("chunk", "k1", "k2", "total")] + [pa.nulls(int((total != n).sum()), pa.int64())], ["chunk", "k1", "k2", "value", "different"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()) for _ in range(3)] + [pa.array([many]), pa.array([different])], ["chunk", "k1", "k2", "value", "different"])

    found = stored(rows.mapInArrow(run, "chunk long, k1 long, k2 long, value long, different long"))
    many, different = found.where("chunk is null").agg(F.coalesce(F.sum("value"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()
    return found.where("chunk is not null").select("chunk", "k1", "k2", "value"), many, different


def code_lengths(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """grams (g: order + 1 bytes as an integer, n: its count in training) -> g and log10 of the probability that the model gives its last byte after the others."""
    levels = [stored(grams.select("g", "n"))]
    for k in range(order, 0, -1):
        shorter = F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))
        levels.append(stored(levels[-1].groupBy(shorter.alias("g")).agg(F.sum("n").alias("n"))))
    context = Window.partitionBy(F.shiftright("g", 8))  # SYMBOLS rows at most
    seen = F.col("n") > 0
    below = None
    for k, level in enumerate(reversed(levels)):
        if k == 0:
            rows = level.select("g", "n", F.sum("n").over(context).alias("t"), F.sum(seen.cast("long")).over(context).alias("d"))
            rows = rows.withColumn("rest", -F.log10(F.lit(SYMBOLS) - F.col("d")))
        else:
            rows = level.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(below, "s")
            rows = rows.select("g", "n", F.sum("n").over(context).alias("t"), F.sum(seen.cast("long")).over(context).alias("d"), F.sum(F.when(seen, F.col("sn"))).over(context).alias("x"), "sn", "st", "sd", "srest")
            left = F.col("st") - F.coalesce("x", F.lit(0))  # what the shorter context has seen less what this one excludes
            lower = F.when(F.col("sn") > 0, F.log10((F.col("sn") - 0.5) / left)).when(left > 0, F.log10((F.col("sd") - F.col("d")) / 2 / left) + F.col("srest")).otherwise(F.col("srest"))
            rows = rows.select("g", "n", "t", "d", F.when(~seen, lower).alias("rest"))
        below = rows.select(F.col("g").alias("s"), *(F.col(c).alias(f"s{c}") for c in ("n", "t", "d", "rest")))
    value = F.when(seen, F.log10((F.col("n") - 0.5) / F.col("t"))).when(F.col("t") > 0, F.log10(F.col("d") / 2 / F.col("t")) + F.col("rest")).otherwise(F.col("rest"))
    return rows.select("g", value.alias("value"))


def _places(keys: np.ndarray, checks: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Places of pairs in sorted pairs, or -1."""
    at, out, todo = np.searchsorted(keys, k1), np.full(len(k1), -1), np.arange(len(k1))
    while len(todo):
        p = at[todo]
        inside = p < len(keys)
        todo, p = todo[inside], p[inside]
        like = keys[p] == k1[todo]
        hit = like & (checks[p] == k2[todo])
        out[todo[hit]] = p[hit]
        todo = todo[like & ~hit]
        at[todo] += 1
    return out


def score(docs: DataFrame, order: int = ORDER, chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    parts = read(docs, order, chunk_text)
    items = parts.where("k1 is not null").select("chunk", "k1", "k2", "n")
    grams = items.where(F.col("k2") == GRAM)
    lengths = code_lengths(grams.groupBy(F.col("k1").alias("g")).agg(F.sum("n").alias("n")), order)
    shared, total, different = shared_words(items.where(F.col("k2") != GRAM))
    own = grams.select("chunk", F.col("k1").alias("g")).join(lengths, "g").select(F.col("chunk").alias("of"), F.col("g").alias("k1"), F.lit(GRAM).cast("long").alias("k2"), "value")
    own = own.unionByName(shared.select(F.col("chunk").alias("of"), "k1", "k2", F.col("value").cast("double").alias("value")))
    floor = total + 0.1 * (different + 1)

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        k1, k2, value = (right[c].to_numpy() for c in ("k1", "k2", "value"))
        sort = np.lexsort((k2, k1))
        k1, k2, value = k1[sort], k2[sort], value[sort]
        gram = k2 == GRAM
        g, lengths = k1[gram], value[gram]
        k1, k2, value = k1[~gram], k2[~gram], value[~gram]
        unpack = zstandard.ZstdDecompressor()

        def blocks() -> Iterator[tuple]:
            for i in range(len(left)):
                ids, held, ends, raw = (left[c].chunk(0)[i] if left[c].num_chunks == 1 else left[c][i] for c in ("ids", "held", "ends", "texts"))
                data = np.frombuffer(unpack.decompress(raw.as_py()), np.uint8)
                yield ids.values, held.values, data, np.concatenate([[0], ends.values.to_numpy()])

        # words that no other chunk has: their counts are those of this chunk's training texts
        alone = [(np.zeros(0, np.int64),) * 3]
        ends_in_training = 0
        for _, held, data, offs in blocks():
            train = ~held.to_numpy(zero_copy_only=False)
            a, b, per_row = token_keys(data, offs)
            new = _places(k1, k2, a, b) < 0
            alone.append(_counted(a[new], b[new], np.repeat(train, per_row)[new].astype(np.int64)))
            ends_in_training += int(train.sum())
        own1, own2, count = _counted(*(np.concatenate(x) for x in zip(*alone, strict=True)))
        end = _places(k1, k2, np.array([TEXT_END[0]]), np.array([TEXT_END[1]]))[0]
        end = value[end] if end >= 0 else float(ends_in_training)
        log = lambda c: np.log10((c + 0.1) / floor)
        out = []
        for ids, held, data, offs in blocks():
            grams, firsts = grams_of(data, offs, order)
            a, b, per_row = token_keys(data, offs)
            at = _places(k1, k2, a, b)
            model = np.add.reduceat(lengths[np.searchsorted(g, grams)], firsts[:-1])
            c = np.zeros(len(a))
            c[at >= 0] = value[at[at >= 0]]
            c[at < 0] = count[_places(own1, own2, a[at < 0], b[at < 0])]
            row = np.repeat(np.arange(len(ids)), per_row)
            base = np.bincount(row, log(c), len(ids)) + log(end)
            known = np.bincount(row, c > 0, len(ids)).astype(np.int64) + (end > 0)
            out.append((ids, held, per_row + 1, known, base, model))
        ids, held, *rest = zip(*out, strict=True)
        n, known, base, model = (pa.array(np.concatenate(x)) for x in rest)
        return pa.table({"doc_id": pa.concat_arrays(ids), "held_out": pa.concat_arrays(held), "n_tokens": n, "n_known": known, "train_tokens": pa.array(np.full(len(n), total)), "base_score": base, "score": model})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = parts.where("k1 is null").select("chunk", "ids", "held", "ends", "texts")
    return rows.groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(sums, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def brute_force(rows: list[tuple], order: int = ORDER) -> list[tuple]:
    """The scores by plain loops over a trie in which exclusion is by sets of symbols, for tests."""
    import re
    import zlib
    from collections import Counter
    from math import log10

    trie: dict[tuple, Counter] = {}
    seen, texts = Counter(), []
    for i, text in rows:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        symbols = (START,) * order + tuple(low.encode()) + (END,)
        tokens = re.findall(r"[^\x20\x09-\x0D]+", low)
        held = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        texts.append((i, held, symbols, tokens))
        if not held:
            seen.update([*tokens, None])
            for at in range(order, len(symbols)):
                for k in range(order + 1):
                    trie.setdefault(symbols[at - k : at], Counter())[symbols[at]] += 1
    total, out = sum(seen.values()), []

    def probability(context: tuple, symbol: int) -> float:
        p, excluded = 1.0, set()
        for k in range(order, -1, -1):
            here = trie.get(context[order - k :], {})
            left = {s: n for s, n in here.items() if s not in excluded}
            if symbol in left:
                return p * (left[symbol] - 0.5) / sum(left.values())
            if left:
                p *= len(left) / 2 / sum(left.values())
            excluded |= set(here)
        return p / (SYMBOLS - len(excluded))

    for i, held, symbols, tokens in texts:
        every = [*tokens, None]
        base = sum(log10((seen[t] + 0.1) / (total + 0.1 * (len(seen) + 1))) for t in every)
        out.append((i, held, len(every), sum(seen[t] > 0 for t in every), total, base, sum(log10(probability(symbols[at - order : at], symbols[at])) for at in range(order, len(symbols)))))
    return out
