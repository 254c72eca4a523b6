"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are cut only where they are longer than a sequence. The pieces are dealt into groups of bounded size; every
group evolves on several islands (tasks). Chromosomes are lists of bins: crossover injects whole well-filled bins of
one parent into the other, removes the bins that hold a piece twice, and best-fits the displaced pieces. Between
epochs the elite of each island migrates to the next one of its ring. Then the badly filled bins of all groups are
opened and their pieces packed again together, so that the loss doesn't grow with the number of groups.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each for itself.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import buffers, stored, tune
from .tokens import default_vocabulary, tokenizer

CAPACITY = 4096
END_ID = 1
#: Pieces of a group at most, about: what one task packs.
GROUP = 4000
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 30, 8
#: Rounds of exchanges between displaced pieces and those of bins with room.
EXCHANGES = 12
#: Bins filled less than this are opened again after the first round.
WELL_FILLED = 0.995


def cut(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    tune(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            flat, counts = own.ids(*buffers(batch.column("text")))
            row, piece, start, length, crc = [], [], [], [], []
            at = 0
            for k, n in enumerate(counts.tolist()):
                ids = np.append(flat[at : at + n], end_id).astype("<u4")
                at += n
                for p, s in enumerate(range(0, n + 1, capacity)):
                    part = ids[s : s + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --- One island -------------------------------------------------------------------------------


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray, room: list[int]) -> None:
    """Puts the items of `order` each into the fullest bin with room for it; bins and room are changed."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i in order.tolist():
        size = int(sizes[i])
        k = bisect_left(free, (size, -1))
        if k < len(free):
            r, b = free.pop(k)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i] = b
        room[b] = r - size
        if r > size:
            insort(free, (r - size, b))


def exchange(sizes: np.ndarray, bins: np.ndarray, room: np.ndarray, rounds: int = EXCHANGES) -> None:
    """Displaced pieces (bin -1) change places with smaller ones, alone or in pairs, of bins that they fill better; bins and room are changed."""
    for _ in range(rounds):
        out = np.flatnonzero(bins < 0)
        own = np.flatnonzero(bins >= 0)
        own = own[room[bins[own]] > 0]
        if not len(out) or not len(own):
            return
        out = out[np.argsort(sizes[out], kind="stable")]
        of = sizes[out]
        own = own[np.argsort(bins[own], kind="stable")]
        pair = np.flatnonzero(bins[own[1:]] == bins[own[:-1]])  # neighbours in a bin
        first, second = np.concatenate([own, own[pair]]), np.concatenate([np.full(len(own), -1), own[pair + 1]])
        held = sizes[first] + np.where(second >= 0, sizes[second], 0)
        at = np.searchsorted(of, held + room[bins[first]], "right") - 1
        gain = np.where(at >= 0, of[at] - held, 0)
        good = np.flatnonzero(gain > 0)
        if not len(good):
            return
        # what fills its bin best comes first; a bin and a displaced piece take part once in a round
        good = good[np.lexsort((gain[good], room[bins[first[good]]] - gain[good]))]
        good = good[np.sort(np.unique(bins[first[good]], return_index=True)[1])]
        good = good[np.sort(np.unique(at[good], return_index=True)[1])]
        b = bins[first[good]]
        bins[out[at[good]]] = b
        room[b] -= gain[good]
        bins[first[good]] = -1
        bins[second[good][second[good] >= 0]] = -1


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among equals, more unequal filling, which leaves room together."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return -int(len(fill)), float((fill**2).sum())


def _complete(sizes: np.ndarray, child: np.ndarray, capacity: int) -> np.ndarray:
    """Exchanges the displaced pieces (bin -1), best-fits what is left, and numbers the bins from 0."""
    put = child >= 0
    names, own = np.unique(child[put], return_inverse=True)
    child[put] = own
    room = (capacity - np.bincount(own, weights=sizes[put], minlength=len(names))).astype(np.int64)
    exchange(sizes, child, room)
    rest = np.flatnonzero(child < 0)
    best_fit(sizes, rest[np.argsort(-sizes[rest], kind="stable")], capacity, child, room.tolist())
    return np.unique(child, return_inverse=True)[1]


def crossover(sizes: np.ndarray, into: np.ndarray, donor: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Injects some of the donor's well-filled bins; bins that hold their pieces too are removed, the displaced pieces are placed again."""
    fill = np.bincount(donor, weights=sizes)
    good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = rng.choice(good, max(1, int(len(good) * rng.uniform(0.05, 0.5))), replace=False)
    injected = np.isin(donor, chosen)
    child = into.copy()
    child[np.isin(into, np.unique(into[injected]))] = -1
    child[injected] = donor[injected] + int(into.max()) + 1
    return _complete(sizes, child, capacity)


def mutate(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Opens the emptiest bins and some others, and places their pieces again."""
    fill = np.bincount(bins, weights=sizes)
    n = int(rng.integers(2, 4 + len(fill) // 20))
    opened = np.append(rng.choice(len(fill), min(len(fill), n), replace=False), np.argsort(fill, kind="stable")[: int(rng.integers(1, n + 1))])
    child = bins.copy()
    child[np.isin(bins, opened)] = -1
    return _complete(sizes, child, capacity)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, generations: int) -> list[np.ndarray]:
    """A number of generations on one island; it ends at once where no packing can be better."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    if not population:
        for k in range(POPULATION):
            noise = rng.normal(0, 0.02 * k, len(sizes)) * sizes
            bins, room = np.zeros(len(sizes), np.int64), []
            best_fit(sizes, np.argsort(-(sizes + noise), kind="stable"), capacity, bins, room)
            population.append(bins)
            if len(room) == least:
                break
    rank = lambda x: fitness(sizes, x, capacity)
    ranked = sorted(((rank(x), k, x) for k, x in enumerate(population)), key=lambda r: r[:2], reverse=True)
    for g in range(generations):
        if -ranked[0][0][0] <= least or len(sizes) < 2:
            break
        a, b = (ranked[k][2] for k in np.sort(rng.choice(len(ranked), 2, replace=len(ranked) < 2)))
        children = [crossover(sizes, a, b, capacity, rng), mutate(sizes, a, capacity, rng), mutate(sizes, ranked[0][2], capacity, rng)]
        known = {r[0] for r in ranked}
        for k, x in enumerate(children):
            if (f := rank(x)) not in known:  # equals of one that is there would crowd out the others
                known.add(f)
                ranked.append((f, -3 * g - k - 1, x))
        ranked = sorted(ranked, key=lambda r: r[:2], reverse=True)[:POPULATION]
    return [r[2] for r in ranked]


# --- The islands on Spark ---------------------------------------------------------------------

_STATE = "grp long, island int, uids binary, sizes binary, best binary, bins int, others array<binary>, migrant binary"


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                sizes = np.frombuffer(r["sizes"], np.int32).astype(np.int64)
                old = [np.frombuffer(x, np.int32).astype(np.int64) for x in (r["best"], r["migrant"], *(r["others"] or [])) if x is not None]
                new = evolve(sizes, old[: POPULATION + 1], capacity, (r["grp"] * ISLANDS + r["island"]) * 31 + epoch, GENERATIONS)
                r["best"], *r["others"] = (x.astype(np.int32).tobytes() for x in new)
                r["bins"], r["migrant"] = int(new[0].max()) + 1, None
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return state.mapInArrow(run, _STATE)


def _pack_groups(pieces: DataFrame, groups: int, capacity: int) -> DataFrame:
    """uid, grp, bin, fill of the bin: the best packing of all islands for each group."""
    spark = pieces.sparkSession
    dealt = pieces.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("grp"))

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        sizes = table.column("length").to_numpy().astype(np.int32)
        uids = table.column("uid").to_numpy().astype(np.int64)
        n = ISLANDS
        return pa.table(
            {"grp": pa.array([key[0].as_py()] * n, pa.int64()), "island": pa.array(range(n), pa.int32()), "uids": pa.array([uids.tobytes()] * n, pa.binary()), "sizes": pa.array([sizes.tobytes()] * n, pa.binary()),
             "best": pa.nulls(n, pa.binary()), "bins": pa.nulls(n, pa.int32()), "others": pa.nulls(n, pa.list_(pa.binary())), "migrant": pa.nulls(n, pa.binary())}
        )

    state = stored(_epoch(dealt.groupBy("grp").applyInArrow(gather, _STATE), capacity, 0))
    ring = Window.partitionBy("grp").orderBy("island")  # ISLANDS rows each
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for epoch in range(1, EPOCHS):
        elite = F.coalesce(F.lag("best").over(ring), F.last("best").over(every))
        state = stored(_epoch(state.withColumn("migrant", elite), capacity, epoch))
    best = state.groupBy("grp").agg(F.min_by(F.struct("uids", "sizes", "best"), F.struct("bins", "island")).alias("b")).select("grp", "b.*")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                uids, bins = np.frombuffer(r["uids"], np.int64), np.frombuffer(r["best"], np.int32)
                sizes = np.frombuffer(r["sizes"], np.int32).astype(np.int64)
                fill = np.bincount(bins, weights=sizes).astype(np.int64)
                order = np.lexsort((uids, bins))
                before = np.cumsum(sizes[order]) - sizes[order]
                first = np.searchsorted(bins[order], bins[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[order]), pa.array(np.full(len(uids), r["grp"], np.int64)), pa.array(bins[order].astype(np.int64)), pa.array(before - before[first]), pa.array(fill[bins[order]])],
                    ["uid", "grp", "bin", "offset", "fill"],
                )

    return best.mapInArrow(spread, "uid long, grp long, bin long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to the rows of `pieces` (length; at most `capacity` each). Pieces must not change when read again."""
    spark = pieces.sparkSession
    tune(spark)
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = stored(pieces.select(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id().alias("__uid")))
    short = pieces.where(F.col("length") < capacity).select(F.col("__uid").alias("uid"), "length")
    count = short.count()
    placed = []
    if count:
        first = stored(_pack_groups(short, -(-count // group), capacity))
        open_bins = F.col("fill") < int(WELL_FILLED * capacity)
        rest = first.where(open_bins).join(short, "uid").select("uid", "length")
        left = rest.count()
        number = lambda df, k: df.select("uid", ((F.col("grp") * (1 << 20) + F.col("bin")) * 2 + k).alias("sequence_id"), "offset")
        if 0 < left and -(-count // group) > 1:
            placed = [number(first.where(~open_bins), 0), number(_pack_groups(rest, -(-left // group), capacity), 1)]
        else:
            placed = [number(first, 0)]
    whole = pieces.where(F.col("length") >= capacity).select(F.col("__uid").alias("uid"), (-1 - F.col("__uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for p in placed:
        whole = whole.unionByName(p)
    return pieces.join(whole.withColumnRenamed("uid", "__uid"), "__uid").drop("__uid")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of `docs` (doc_id, text)."""
    return pack(cut(docs, vocabulary, capacity), capacity)
