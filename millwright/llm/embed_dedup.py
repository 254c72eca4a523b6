"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Vectors are compared only where labels are equal and not null. Vectors that are equal but for a power of two are one
class, so that copies are never paired. The bits of a bucket grow with the number of classes, and the tables with the
bits. Each table gives a class a bucket by the signs of its projections; buckets of more than a block of classes
are split into blocks, and a task gets two blocks. A pair is counted in the first table that both share, and a task
sends on sums and the edges of a spanning forest, not the pairs.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing and stand alone;
vectors of different lengths don't link; a null id gives a null component; repeated rows count as vectors each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, tune
from .components import components

THRESHOLD = 0.93
#: A pair at the threshold shares a bucket in some table with this probability.
RECALL, SEED = 0.9995, 20
LEAST_BITS, MOST_BITS = 8, 30
BLOCK = 1024


def bits_and_tables(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a bucket, so that vectors at random angles are a few to a bucket at every size, and tables for the recall."""
    bits = min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(classes, 1))) - 2))
    once = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - once))

_PLANES: dict[tuple[int, int, int, int], np.ndarray] = {}


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    key = (dim, bits, tables, seed)
    if key not in _PLANES:
        _PLANES[key] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
    return _PLANES[key]


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(n, tables) codes of `bits` bits."""
    signs = (vectors @ planes(vectors.shape[1], bits, tables, seed) > 0).reshape(len(vectors), tables, bits)
    return (signs << np.arange(bits)).sum(2).astype(np.int32)


def _classes(rows: DataFrame) -> DataFrame:
    """__uid, __label, __vec (doubles as bytes; null if it can't link)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("__v").to_pylist():
                x = np.array(v, np.float64) + 0.0 if v and None not in v else None
                good = x is not None and np.isfinite(x).all() and x.any()
                # a power of two changes no cosine, and keeps squares from overflow and underflow
                out.append(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("__uid"), batch.column("__label"), pa.array(out, pa.binary())], ["__uid", "__label", "__vec"])

    return rows.select("__uid", "__label", "__v").mapInArrow(run, "__uid long, __label string, __vec binary")


def _codes(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for raw in batch.column("vec").to_pylist():
                codes.append(signatures(np.frombuffer(raw, np.float64)[None, :], bits, tables)[0])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("uid", "label", "size", "vec")] + [pa.array([c.tolist() for c in codes], pa.list_(pa.int32()))], ["uid", "label", "size", "vec", "codes"])

    return reps.mapInArrow(run, "uid long, label string, size long, vec binary, codes array<int>")


def linked(ids: np.ndarray, vecs: np.ndarray, codes: np.ndarray, side: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions with cosine >= threshold that no earlier table holds. side: 0 and 1 for two blocks, else all 0."""
    norm = np.sqrt((vecs * vecs).sum(1))
    unit = vecs / norm[:, None]
    if side.any():
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.nonzero(unit[a] @ unit[b].T >= threshold - 1e-9)
        i, j = a[i], b[j]
    else:
        i, j = np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-9, 1))
    keep = np.empty(len(i), bool)
    for s in range(0, len(i), 1 << 16):  # the exact test, on what may pass
        p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        exact = (vecs[p] * vecs[q]).sum(1) / (norm[p] * norm[q]) >= threshold
        keep[s : s + (1 << 16)] = exact & ~(codes[p, :table] == codes[q, :table]).any(1)
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of the pairs to the smallest id that it reaches."""
    root = ids.copy()
    while len(i):
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (before == root).all():
            break
    moved = np.flatnonzero(root != ids)
    return ids[moved], root[moved]


def _compare(dealt: DataFrame, threshold: float) -> DataFrame:
    """dealt: rows (label, tbl, code, lo, hi, blk, uid, size, vec, codes), sorted by the first five inside partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            by_dim: dict[int, list] = {}
            for r in held:
                by_dim.setdefault(len(r[2]), []).append(r)
            for rows in by_dim.values():
                ids = np.array([r[0] for r in rows])
                size = np.array([r[1] for r in rows])
                vecs = np.frombuffer(b"".join(r[2] for r in rows), np.float64).reshape(len(rows), -1)
                codes = np.array([r[3] for r in rows], np.int32)
                side = np.array([int(r[4] != name[0]) for r in rows])
                if name[0] != name[1] and not (side.any() and (side == 0).any()):
                    continue
                i, j = linked(ids, vecs, codes, side, held[0][5], threshold)
                if not len(i):
                    continue
                links = np.bincount(i, weights=size[j], minlength=len(rows)) + np.bincount(j, weights=size[i], minlength=len(rows))
                some = np.flatnonzero(links)
                u, v = forest(len(rows), i, j, ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[some], u])), pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(u), np.int64)])), pa.array([None] * len(some) + v.tolist(), pa.int64())],
                    ["uid", "links", "root"],
                )

        for batch in batches:
            cols = batch.to_pydict()
            for k in range(len(batch)):
                own = (cols["lo"][k], cols["hi"][k], cols["label"][k], cols["tbl"][k], cols["code"][k])
                if own != name:
                    if name is not None:
                        yield from done()
                    held, name = [], own
                held.append((cols["uid"][k], cols["size"][k], cols["vec"][k], cols["codes"][k], cols["blk"][k], cols["tbl"][k]))
        if name is not None:
            yield from done()

    return dealt.mapInArrow(run, "uid long, links long, root long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("__label"), F.col(embedding).cast("array<double>").alias("__v"))
    rows = stored(rows.withColumn("__uid", F.monotonically_increasing_id()))
    every = stored(_classes(rows).withColumn("__class", F.when(F.col("__label").isNotNull() & F.col("__vec").isNotNull(), F.sha2(F.concat(F.encode("__label", "UTF-8"), F.lit(b"\0"), "__vec"), 256))))
    reps = every.where("__class is not null").groupBy("__class").agg(F.min("__uid").alias("uid"), F.count("*").alias("size"), F.first("__label").alias("label"), F.first("__vec").alias("vec"))
    reps = stored(reps)
    bits, tables = bits_and_tables(reps.count(), threshold, recall)
    reps = stored(_codes(reps.select("uid", "label", "size", "vec"), bits, tables))
    key = ["label", "tbl", "code"]
    buckets = reps.select("uid", F.posexplode("codes").alias("tbl", "code"), "label")
    counts = buckets.groupBy(*key).count().where("count > 1")
    # (uid, block) of the full buckets first; the vectors follow once
    dealt = buckets.join(counts, key).withColumn("n", F.ceil(F.col("count") / BLOCK).cast("int"))
    dealt = dealt.withColumn("blk", F.pmod(F.hash("uid"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("uid", *key, "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    dealt = dealt.join(reps.select("uid", "size", "vec", "codes"), "uid")
    dealt = dealt.repartition(*[F.col(c) for c in (*key, "lo", "hi")]).sortWithinPartitions(*key, "lo", "hi")
    found = stored(_compare(dealt, threshold))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(found.where("root is not null").select(F.col("uid").alias("u"), F.col("root").alias("v")))
    of = reps.select("uid", "size").join(links, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("uid", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root"))
    member = every.where("__class is not null").groupBy("__class").agg(F.min("__uid").alias("uid")).join(of, "uid").select("__class", "n_links", "root")
    joined = rows.select("__uid", "vec_id").join(every.select("__uid", "__class"), "__uid").join(member, "__class", "left").withColumn("root", F.coalesce("root", "__uid"))
    joined = stored(joined.select("vec_id", "root", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    least = joined.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = joined.join(least, "root")
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), ok AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
