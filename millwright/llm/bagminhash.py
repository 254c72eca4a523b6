"""MinHash near-dedup by BagMinHash: documents are bags of five-word shingles, similarity is the weighted Jaccard index.

Every shingle of weight w owns Poisson processes on a dyadic discretisation of its weight axis: one of rate 1 on
[0, 1) and one of rate 2^(j-1) on each [2^(j-1), 2^j) that w reaches. A point has a time, a component and a place on
the axis; it counts if the place is below w. A component's value is its first point, so two documents agree in it
with a probability equal to their weighted Jaccard index. Processes stop at the slowest component's time.

Texts with the same words, by a 128-bit print of their bytes, are one class. Bands of signatures give candidates: in each bucket the class that shares most buckets with
others is paired with every other one. They are verified by exact bag overlap, and connected components are built. Buckets that still hold
several components go on with other leaders, and at last with all their pairs across components that share
enough shingles to be similar at all, so no link between different texts is lost, and no group of copies is ever expanded into its pairs.

Edge cases: texts of 1 to 4 words are one shingle, the whole text; null and wordless texts are no duplicates of
anything; a null id is never the smallest; repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, WORD, buffers, chunks, hidden, mix, shown, stored, tune, window_hashes, word_hashes, words
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
#: 21 bands of 6 components find a pair of similarity 0.8 with probability 0.998; 128 one-bit sketches bound the rest.
COMPONENTS, BANDS, ROWS = 128, 21, 6
#: Sketch bits that may differ: at similarity 0.8 a bit differs with probability 0.1, and 31 of 128 never do (5 sigma).
MOST_BITS = 31
#: Class ids that a broadcast may hold; above it the same join is shuffled.
BROADCAST_IDS = 1_000_000
LEADER_ROUNDS = 1
#: Rounds that leave out texts of open buckets which share too little with any other.
PEELS = 3


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bag of each row: row, shingle and weight arrays, sorted; then the number of words and the 128-bit print of each row's words."""
    data = LOWER[data]
    starts, ends, counts = words(data, offsets)
    h = word_hashes(data, starts, ends)
    rows = len(counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    prints = word_prints(data, offsets, counts)
    row = np.repeat(np.arange(rows), np.maximum(counts - k + 1, 0))
    if len(h) >= k:
        at = np.arange(len(h) - k + 1)
        owner = np.repeat(np.arange(rows), counts)[at]
        bag = window_hashes(h, k)[at + k <= first[owner + 1]]
    else:
        bag = np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        row = np.concatenate([row, short])
        bag = np.concatenate([bag, mix(prints[short, 0] + np.uint64(1))])
    order = np.lexsort((bag, row))
    row, bag = row[order], bag[order]
    new = np.ones(len(bag), bool)
    new[1:] = (bag[1:] != bag[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], bag[at], np.diff(np.append(at, len(bag))), counts, prints


def word_prints(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(rows, 2): a 128-bit print of the bytes of each row's words with one space between them; 0 without words."""
    in_word = WORD[data]
    after = np.zeros(len(data), bool)  # the byte after a word, in the same row
    after[1:] = in_word[:-1] & ~in_word[1:]
    after[offsets[:-1][offsets[:-1] < len(data)]] = False
    kept = in_word | after
    plain = np.where(in_word, data, 32)[kept].astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
    prints = np.zeros((len(counts), 2), np.uint64)
    for k in np.flatnonzero(counts).tolist():
        a, b = ends[k], ends[k + 1]
        prints[k] = divmod(xxhash.xxh3_128_intdigest(plain[a : b - (plain[b - 1] == 32)]), 1 << 64)
    return prints


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, bag: np.ndarray, weight: np.ndarray, rows: int, m: int = COMPONENTS) -> np.ndarray:
    """(rows, m) times of the first points, as integers; rows without shingles keep the largest value."""
    sig = np.full(rows * m, np.inf)
    who, seed, rate, low = [row], [mix(bag ^ np.uint64(0x1D8E4E27C47D124F))], [np.ones(len(row))], [np.zeros(len(row))]
    level, part = 1, np.flatnonzero(weight > 1)
    while len(part):
        who.append(row[part])
        seed.append(mix(bag[part] + np.uint64(level * 0xD1342543DE82EF95 % (1 << 64))))
        rate.append(np.full(len(part), 2.0 ** (level - 1)))
        low.append(np.full(len(part), 2.0 ** (level - 1)))
        part, level = part[weight[part] > 2**level], level + 1
    tops = [weight.astype(np.float64)] + [weight[weight > 2 ** (j - 1)].astype(np.float64) for j in range(1, level)]
    who, seed, rate, low, top = (np.concatenate(x) for x in (who, seed, rate, low, tops))
    time, index, slowest = np.zeros(len(who)), 0, np.full(rows, np.inf)
    while len(who):
        block = 1 if index < 2 and len(who) > 2000 else 16
        steps = np.arange(index, index + block, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a = mix(seed[:, None] + steps[None, :])
        t = -np.log(_unit(a)) / rate[:, None]
        t[:, 0] += time
        t = np.cumsum(t, 1)
        b = mix(a ^ np.uint64(0x2545F4914F6CDD1D))
        ok = (t < slowest[who][:, None]) & (low[:, None] + _unit(mix(b)) * rate[:, None] < top[:, None])
        np.minimum.at(sig, ((who * m)[:, None] + (b % np.uint64(m)).astype(np.int64))[ok], t[ok])
        time, index = t[:, -1], index + block
        slowest = sig.reshape(rows, m).max(1)
        more = time < slowest[who]
        who, seed, rate, low, top, time = (x[more] for x in (who, seed, rate, low, top, time))
    return (sig.view(np.uint64) >> np.uint64(12)).reshape(rows, m)


def bands_and_bits(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows, BANDS) and one-bit sketches (rows, 2) as signed integers."""
    keys = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for c in range(b * ROWS, (b + 1) * ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, c])
        keys[:, b] = h
    bits = np.packbits((mix(sig) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64)
    return keys.view(np.int64), bits.view(np.int64)


#: A row's key, the same whenever and however it is read: 128 bits of id and text.
KEY = ["__k1", "__k2"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64("text", "doc_id")})


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, the row's key, __p1 and __p2 (the print of the words), __n (words), __bands, __s1 and __s2 of each row of docs (doc_id, text)."""
    docs = keyed(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            parts = []
            for i, j in chunks(offsets):
                row, bag, weight, counts, prints = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append((counts, prints.view(np.int64), *bands_and_bits(signatures(row, bag, weight, j - i))))
            if parts:
                n, p, keys, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                numbers = [pa.array(np.ascontiguousarray(x)) for x in (p[:, 0], p[:, 1], n)] + [lists] + [pa.array(np.ascontiguousarray(bits[:, k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *KEY)] + numbers, ["doc_id", *KEY, "__p1", "__p2", "__n", "__bands", "__s1", "__s2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, __k1 long, __k2 long, __p1 long, __p2 long, __n long, __bands array<long>, __s1 long, __s2 long")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two sorted bags (shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / max(1, int(a[1].sum() + b[1].sum()) - least)


def _texts(uids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """uid and text of classes."""
    ids = stored(uids.join(reps.select("uid", *KEY), "uid"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return keyed(docs.select("doc_id", "text")).join(ids, KEY).select("uid", "text").dropDuplicates(["uid"])


def _sharable(rows: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """rows (key, uid, root, ...) with __size (weight of the bag) and __shared (weight of shingles that other texts of rows have), but
    without those that for lack of shared shingles can't be similar to any other text of their bucket.

    An overlap is at most the smaller __shared, so (1 + t) min(shared) >= t (size + size) holds for every pair of similarity t. What
    is left out makes further shingles unshared, so this is done PEELS times; a pair that is similar passes at each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            uids = batch.column("uid").to_numpy()
            for i, j in chunks(offsets):
                row, bag, weight, _, _ = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array(uids[i:j][row]), pa.array(bag.view(np.int64)), pa.array(weight)], ["uid", "gram", "weight"])

    grams = stored(_texts(rows.select("uid").distinct(), reps, docs).mapInArrow(run, "uid long, gram long, weight long"))
    rows = rows.join(grams.groupBy("uid").agg(F.sum("weight").alias("__size")), "uid")
    for _ in range(PEELS):
        live = grams.join(rows.select("uid").distinct(), "uid", "left_semi")
        alone = live.groupBy("gram").agg(F.count("*").alias("n"), F.min("uid").alias("uid"), F.sum("weight").alias("w")).where("n = 1")
        bound = rows.drop("__shared").join(alone.groupBy("uid").agg(F.sum("w").alias("w")), "uid", "left").withColumn("__shared", F.col("__size") - F.coalesce("w", F.lit(0))).drop("w")
        room = (1 + threshold) * F.col("__shared") - threshold * F.col("__size") + 1e-6
        most = bound.groupBy("key").agg(F.max(room).alias("__room"), F.min("__size").alias("__least"))
        rows = stored(bound.join(most, "key").where((room >= threshold * F.col("__least")) & (F.col("__room") >= threshold * F.col("__size"))).drop("__room", "__least"))
    return rows


def _verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of class ids whose texts are similar enough. reps: uid and row key of the classes."""
    need = _texts(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), reps, docs)
    both = pairs.join(need.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a").join(need.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b")

    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        _, own, weight, _, _ = shingles(*buffers(pa.array([text], pa.string())))
        return own, weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, bags = [], {}
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                for uid, text in ((a, ta), (b, tb)):
                    if uid not in bags:
                        bags[uid] = bag(text)
                good.append(overlap(bags[a], bags[b]) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good, pa.bool_())), batch.column("b").filter(pa.array(good, pa.bool_()))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _near(a: str, b: str) -> Column:
    """Sketches that similar texts can have."""
    return F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1"))) + F.bit_count(F.col(f"{a}2").bitwiseXOR(F.col(f"{b}2"))) <= MOST_BITS


def classify(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row key, __uid, __class (smallest __uid with the same words) and __root (of the component), row by row."""
    tune(docs.sparkSession)
    signed = stored(sign(docs).withColumn("__uid", F.monotonically_increasing_id()))
    full = signed.where("__n > 0")
    first = [F.first(c).alias(c.strip("_")) for c in ("__bands", "__s1", "__s2")]
    reps = stored(full.groupBy("__p1", "__p2").agg(F.min("__uid").alias("uid"), F.min_by(F.struct(*KEY), "__uid").alias("k"), *first).select("*", "k.*").drop("k"))
    rows = reps.select("uid", "s1", "s2", F.explode("bands").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(rows.join(counts, "key"))
    # the text that shares most buckets with others leads, for it is the likeliest to be similar to all of them
    weight = rows.groupBy("uid").agg(F.sum("n").alias("w"))
    leads = rows.select("key", "uid").join(weight, "uid").groupBy("key").agg(F.max_by("uid", F.struct("w", -F.col("uid"))).alias("lead"))
    pairs = rows.join(leads, "key").where("uid <> lead").select(F.least("lead", "uid").alias("a"), F.greatest("lead", "uid").alias("b")).distinct()
    pairs = stored(pairs)
    roots = components(_verify(pairs, reps, docs, threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
    # buckets of two are settled; others, while they hold several components
    tried = pairs
    for k in range(LEADER_ROUNDS + 1):
        at = rows.where("n > 2").select("key", "uid", "s1", "s2").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        mixed = at.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by(F.struct("uid", "root", F.col("s1").alias("l1"), F.col("s2").alias("l2")), F.xxhash64("uid", "key", F.lit(k))).alias("lead")).where("r0 < r1")
        open_rows = stored(at.join(mixed.select("key", "lead.root", "lead.l1", "lead.l2", "lead.uid").toDF("key", "lroot", "l1", "l2", "lead"), "key"))
        if k < LEADER_ROUNDS:
            more = open_rows.where(F.col("root") != F.col("lroot")).where(_near("s", "l")).select(F.least("lead", "uid").alias("a"), F.greatest("lead", "uid").alias("b"))
        else:
            rest = _sharable(open_rows, reps, docs, threshold)
            rest = rest.join(rest.groupBy("uid").agg(F.collect_set("key").alias("keys")), "uid")  # BANDS keys at most
            x, y = (rest.select("key", *(F.col(c).alias(f"{p}{c.strip('_')}") for c in ("uid", "root", "s1", "s2", "keys", "__size", "__shared"))) for p in "xy")
            share = (1 + threshold) * F.least("xshared", "yshared") + 1e-6 >= threshold * (F.col("xsize") + F.col("ysize"))
            once = F.array_min(F.array_intersect("xkeys", "ykeys")) == x.key
            more = x.join(y, (x.key == y.key) & (F.col("xuid") < F.col("yuid")) & (F.col("xroot") != F.col("yroot")) & share & _near("xs", "ys") & once).select(F.col("xuid").alias("a"), F.col("yuid").alias("b"))
        more = stored(more.distinct().join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            if k < LEADER_ROUNDS and not open_rows.isEmpty():
                continue
            break
        tried = tried.unionByName(more)
        found = stored(_verify(more, reps, docs, threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
        if not found.isEmpty():  # stars of the components so far and the new links have the same components as all links
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))
    of = reps.select("__p1", "__p2", "uid").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    own = F.coalesce(F.col("uid"), F.col("__uid"))
    rows = signed.select("doc_id", *KEY, "__uid", F.when(F.col("__n") > 0, F.col("__p1")).alias("__p1"), "__p2")
    return rows.join(of, ["__p1", "__p2"], "left").select("doc_id", *KEY, "__uid", own.alias("__class"), F.coalesce("root", own).alias("__root"))


def _first() -> Column:
    """Of a component: the row that stays."""
    return F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__uid"))["__uid"].alias("__first")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id with the same words), component_id (smallest doc_id reachable by links), kept of every row."""
    found = stored(classify(docs, threshold))
    of_class = found.groupBy("__class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    of_root = found.groupBy("__root").agg(F.min("doc_id").alias("component_id"), _first(), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = found.join(_few(of_class), "__class", "left").join(_few(of_root), "__root", "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("__uid") == F.col("__first"), F.lit(True)).alias("kept"))


def _few(groups: DataFrame) -> DataFrame:
    """Groups of more than one row, each a row of a few numbers; broadcast if they are few, so that a large group's rows stay where they are."""
    groups = stored(groups)
    return F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component of near-duplicates, that of the smallest doc_id, with all columns of `docs`."""
    names, docs = docs.columns, hidden(docs, ["doc_id", "text"])
    found = stored(classify(docs, threshold))
    keys = stored(found.join(_few(found.groupBy("__root").agg(_first(), F.count("*").alias("n")).where("n > 1").drop("n")), "__root", "left").withColumn("__first", F.coalesce("__first", "__uid")).groupBy(*KEY).agg(F.max(F.col("__uid") == F.col("__first")).alias("stays"), F.count("*").alias("n")))
    gone = keys.where(~F.col("stays")).select(*KEY)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    rest = keyed(docs).join(gone, KEY, "left_anti")
    if not keys.where("stays and n > 1").isEmpty():  # rows that share id and text
        words_in = found.join(keys.where("stays and n > 1").select(*KEY), KEY).where("__class <> __uid or __uid <> __root").select(*KEY).distinct()
        once = rest.join(words_in, KEY, "left_semi").dropDuplicates(KEY)
        rest = rest.join(words_in, KEY, "left_anti").unionByName(once)
    return shown(rest, names, ["doc_id", "text"])
