"""Sharding by histogram sort: bytes below candidate boundaries are counted exactly and boundaries refined, then one exchange.

Rows are ordered by the hash of their text, then by doc_id, so that equal texts go to one shard; no row is compared
with another. The first round counts bytes and rows of 2^12 intervals; every further one cuts those that still hold a
boundary, one for each shard at most, into 2^12 parts. The driver sees only these counts, 2^12 x shards a round at
most, whatever the rows. A boundary is the interval edge next to the wanted number of bytes, and is refined while it
misses by more than the tolerance. Where a hash alone is too large (a hot text), the rounds go on by doc_id, so a hot
text is cut between shards. The law is `bytes`: shards of nearly equal sizes. A shard's size is off by the tolerance
and by the size of one row at each of its two ends, since rows aren't cut.

Inside a shard rows lie in ranges of their hashes of text and id, so that many tasks number them: a range's first slot
is the number of rows in the ranges before it.

Edge cases: a null text has size 1 and no bytes; rows that share text and doc_id can't be parted by a boundary; a null
doc_id is ordered before all others; other columns of any name pass through write_shards; with fewer rows than shards
some shards are empty; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import hidden, stored

SHARDS = 16
#: Of a shard's share of the bytes: by how much a boundary may miss.
TOLERANCE = 0.0005
BITS = 12
#: Ranges of a shard that are numbered by a task each, at least, and the rows of one, about.
RANGES, RANGE_ROWS = 16, 1_000_000
_LOW = -(1 << 63)


def _interval(level: int) -> Column:
    """The number of a row's interval of the given level in its parent, from 0. Levels 0 to 5 are of the hash, then of doc_id."""
    key, k = ("__h", level) if level < 6 else ("__d", level - 6)
    shift = max(0, 64 - BITS * (k + 1))
    bits = BITS if k < 5 else 64 - 5 * BITS
    top = F.col(key).bitwiseXOR(F.lit(_LOW))
    return F.shiftrightunsigned(top, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _lower(path: tuple[int, ...]) -> tuple[int, int]:
    """The smallest (hash, doc_id) of the interval with this path."""
    out = []
    for part in (path[:6], path[6:]):
        x = 0
        for k, v in enumerate(part):
            x |= v << max(0, 64 - BITS * (k + 1))
        out.append(x - (1 << 63))
    return out[0], out[1]


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of a bounded number of rows that the driver knows."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def histogram(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[tuple[int, ...], int, int]]:
    """Disjoint intervals in order, with their bytes and rows, fine enough for the boundaries. keys: __h, __d, size."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    miss = tolerance * total / shards
    done: list[tuple[tuple[int, ...], int, int]] = []
    active: list[tuple[int, ...]] = [()]
    for level in range(12):
        if not active:
            break
        path = F.array(*[_interval(k) for k in range(level)]) if level else F.array().cast("array<int>")
        some = keys.withColumn("__path", path)
        if level:  # only the intervals that are refined: one for each boundary at most
            some = some.join(F.broadcast(_rows(keys.sparkSession, [{"__path": p} for p in active], "__path: array<int>")), "__path")
        counted = some.groupBy("__path", _interval(level).alias("__part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        active_set = set(active)
        done = [d for d in done if d[0] not in active_set] + [((*r["__path"], r["__part"]), r["bytes"], r["rows"]) for r in counted]
        done.sort(key=lambda d: d[0])
        before, active = 0, []
        for p, size, rows in done:
            after = before + size
            wanted = -(-before * shards // total)  # the first boundary not below this interval
            near = False
            while wanted * total < after * shards and wanted < shards:
                t = wanted * total / shards
                near |= min(t - before, after - t) > miss
                wanted += 1
            if len(p) == level + 1 < 12 and rows > 1 and near:
                active.append(p)
            before = after
    return done


def _keys(docs: DataFrame) -> DataFrame:
    """`docs` with __h, __d (the order), size and text_crc32."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    whole = dict(docs.dtypes)["doc_id"] in ("int", "bigint", "smallint", "tinyint")
    order = F.col("doc_id").cast("long") if whole else F.xxhash64(F.col("doc_id").cast("string"))
    return docs.withColumns({"__h": F.xxhash64("text"), "__d": F.coalesce(order, F.lit(_LOW)), "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text)})


def _placed(rows: DataFrame, keys: DataFrame, shards: int, tolerance: float) -> DataFrame:
    """`rows` (with the columns of keys: __h, __d, size, text_crc32) with shard and slot; each row moves once."""
    intervals = histogram(keys, shards, tolerance)
    total = sum(x[1] for x in intervals)
    bounds = [i * total / shards for i in range(1, shards)]
    edges, held, before = [], {}, 0
    for path, size, n in intervals:
        # a boundary is the interval edge next to the wanted one
        i = bisect_left(bounds, before + size / 2 + 1e-9)
        if i not in held:
            edges.append((*_lower(path), i))
        held[i] = held.get(i, 0) + n
        before += size
    edges = edges or [(_LOW, _LOW, 0)]
    edges[0] = (_LOW, _LOW, edges[0][2])
    known = F.from_json(F.lit(json.dumps([{"h": h, "d": d} for h, d, _ in edges])), "array<struct<h: bigint, d: bigint>>")
    numbers = F.from_json(F.lit(json.dumps([i for *_, i in edges])), "array<int>")
    own = F.struct(F.col("__h").alias("h"), F.col("__d").alias("d"))

    def half(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"] + 1) / 2).cast("int")
        up = F.get(known, mid) <= own
        return F.struct(F.when(up, mid).otherwise(at["lo"]).alias("lo"), F.when(up, at["hi"]).otherwise(F.greatest(mid - 1, at["lo"])).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(edges) - 1).alias("hi"))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(len(edges).bit_length())), start, half)["lo"]
    ranges = max(RANGES, -(-max(held.values(), default=0) // RANGE_ROWS))
    place = {"shard": F.get(numbers, at), "__range": F.pmod(F.xxhash64("__h", "__d"), F.lit(ranges)).cast("int")}
    # a count for each range of about RANGE_ROWS rows
    counts = {(r["shard"], r["__range"]): r["count"] for r in keys.withColumns(place).groupBy("shard", "__range").count().collect()}
    first = []
    for i in range(shards):
        slot = 0
        for k in range(ranges):
            first.append(slot)
            slot += counts.get((i, k), 0)
    of_range = F.get(F.from_json(F.lit(json.dumps(first)), "array<bigint>"), F.col("shard") * ranges + F.col("__range"))
    within = Window.partitionBy("shard", "__range").orderBy("__h", "__d", "size", "text_crc32")
    return rows.withColumns(place).withColumn("slot", (of_range + F.row_number().over(within) - 1).cast("long")).drop("__range")


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    keys = stored(_keys(docs.select("doc_id", "text")).drop("text"))
    rows = _placed(keys, keys, shards, tolerance)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> tuple[str, str]:
    """Writes docs with their shard and slot: a folder for each shard, files of a range each, ordered by slot. The texts
    move once. Returns the names of the two columns, which get underscores where `docs` has columns of these names."""
    names, own = docs.columns, ["doc_id", "text"]
    taken = {c.lower() for c in names}
    new = []
    for name in ("shard", "slot"):
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        new.append(name)
    keys = stored(_keys(docs.select(*own)).drop("text"))
    rows = _placed(_keys(hidden(docs, own)), keys, shards, tolerance)
    rows = rows.select(*own, "__others", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    columns = [F.col(c) if c in own else F.col(f"__others.`{c}`").alias(c) for c in names]
    rows.sortWithinPartitions("__shard", "__slot").select(*columns, F.col("__shard").alias(new[0]), F.col("__slot").alias(new[1])).write.partitionBy(new[0]).parquet(path)
    return new[0], new[1]
