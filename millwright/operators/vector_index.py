"""An index of vectors: inverted lists around centroids, searched by a table of queries.

Centroids are fitted by Lloyd's rounds on a bounded sample; every vector is in the list of its nearest one. A query looks into its
`probes` nearest lists. Lists are dealt into blocks of bounded size, and so are the queries that look into one, so a list
or a query that many share is worked on by many tasks; each gives the k best of its block. Queries are never in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .filters import first_of_each
from .lineage import stored

#: Rows that centroids are fitted on, centroids at most, rounds.
SAMPLE_ROWS, MOST_LISTS, ROUNDS = 20_000, 1024, 12
#: Vectors of a block, and queries of one.
BLOCK, QUERIES = 4096, 1024
#: Share of the lists that a query looks into. The given vectors hardly lie in clusters; the recall of the five nearest is in the README.
PROBED = 0.6


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that can be compared: no null, no component that isn't finite."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.where("vec_id is not null and size(embedding) > 0").where(~bad).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def fit(vectors: DataFrame, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> np.ndarray:
    """Centroids of usable vectors of one dimension: about the square root of their number, MOST_LISTS at most. The sample is of the smallest hashes of the ids."""
    n = vectors.count()
    lists = lists or max(1, min(MOST_LISTS, int(n**0.5)))
    sample = _matrix(vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample_rows).select("embedding").toArrow()["embedding"])
    if not len(sample):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = _squares(sample, centres).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)  # an empty list keeps its place
    return centres


def _near_lists(rows: DataFrame, centres: np.ndarray, many: int) -> DataFrame:
    """rows with list: a row for each of its `many` nearest centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _squares(_matrix(batch.column("embedding")), centres)
            near = np.argsort(d, 1, kind="stable")[:, :many] if many < len(centres) else np.tile(np.arange(len(centres)), (len(d), 1))
            at = np.repeat(np.arange(len(d)), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), batch.column("embedding").take(pa.array(at)), pa.array(near.reshape(-1).astype(np.int32))], ["vec_id", "embedding", "list"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, embedding array<double>, list int")


def index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, embedding, list of every usable vector of the centroids' dimension. Written."""
    return stored(_near_lists(usable(vectors).where(F.size("embedding") == centres.shape[1]), centres, 1))


def _blocks(df: DataFrame, of: str, most: int) -> DataFrame:
    """list and the number of blocks of at most about `most` rows."""
    return df.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(of))


def search(indexed: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 5, most: float = 1.0, probes: int | None = None) -> DataFrame:
    """query_id, vec_id, dist (squared L2, 9 digits): of the lists that each query looks into, the k nearest that are no farther than `most`; not the query's own id."""
    probes = probes or max(1, int(np.ceil(PROBED * len(centres))))
    asked = stored(_near_lists(usable(queries).where(F.size("embedding") == centres.shape[1]), centres, min(probes, len(centres))))
    size = _blocks(indexed, "nv", BLOCK).join(_blocks(asked, "nq", QUERIES), "list")
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = indexed.join(size, "list").select("list", deal("nv", 1).alias("bv"), every("nq").alias("bq"), "vec_id", "embedding")
    q = asked.join(size, "list").select(F.col("list").alias("ql"), every("nv").alias("qv"), deal("nq", 2).alias("qq"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(left) and len(right):
            ids, x, y = left["vec_id"].to_numpy(), _matrix(left["embedding"]), _matrix(right["query"])
            asks = right["query_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for a in range(0, len(asks), 256):
                d = np.round(_squares(y[a : a + 256], x), 9)
                d[asks[a : a + 256, None] == ids] = np.inf
                # ties go to the smaller id: it stands first
                near = np.argsort(d, 1, kind="stable")[:, :k]
                dist = np.take_along_axis(d, near, 1)
                row, at = np.nonzero(dist <= most)
                for column, part in zip(out, (asks[a : a + 256][row], ids[near[row, at]], dist[row, at]), strict=True):
                    column.append(part)
        parts = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(parts[0].astype(np.int64)), "vec_id": pa.array(parts[1].astype(np.int64)), "dist": pa.array(parts[2].astype(np.float64))})

    found = v.groupBy("list", "bv", "bq").cogroup(q.groupBy("ql", "qv", "qq")).applyInArrow(best, "query_id long, vec_id long, dist double")
    return first_of_each(found, ["query_id"], ["dist", "vec_id"], k)
