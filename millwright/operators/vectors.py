"""Exact nearest vectors of many queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .filters import first_of_each

#: Queries that are sent to all tasks at once. The vectors are read once for each block of queries.
BLOCK = 2048


def _block(vectors: DataFrame, ids: list, rows: list, k: int) -> DataFrame:
    """query_id, vec_id, dist: the k nearest of each query within each task."""
    qid, q = np.array(ids, np.int64), np.array(rows, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, who = np.full((len(qid), k), np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
        norm = (q * q).sum(1)[:, None]
        for batch in batches:
            own = np.asarray(batch.column("vec_id").to_numpy(zero_copy_only=False), np.int64)
            e = np.asarray(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(own), q.shape[1])
            for a in range(0, len(own), 512):
                x, n = e[a : a + 512], own[a : a + 512]
                d = np.round(np.maximum(norm + (x * x).sum(1) - 2 * (q @ x.T), 0), 9)
                d[(qid[:, None] == n) | np.isnan(d)] = np.inf
                near = np.flatnonzero(d.min(1, initial=np.inf) <= best[:, -1])
                d = np.hstack([best[near], d[near]])
                all_ids = np.hstack([who[near], np.broadcast_to(n, (len(near), len(n)))])
                order = np.lexsort((all_ids, d), axis=1)[:, :k]
                best[near], who[near] = np.take_along_axis(d, order, 1), np.take_along_axis(all_ids, order, 1)
        at, rank = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(who[at, rank]), pa.array(best[at, rank])], ["query_id", "vec_id", "dist"])

    return vectors.where(F.size("embedding") == q.shape[1]).where(~F.exists("embedding", lambda v: v.isNull())).select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, dist double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, most: float = 1.0) -> DataFrame:
    """query_id, vec_id, dist (squared L2, 9 digits): the k nearest of all `vectors` (vec_id, embedding) for every row of `queries`, no farther than `most`; not the query's own id."""
    out, block = None, []

    def add(out: DataFrame | None, block: list) -> DataFrame:
        new = _block(vectors, [r.vec_id for r in block], [r.embedding for r in block], k)
        return new if out is None else out.unionByName(new)

    good = queries.where("vec_id is not null and size(embedding) > 0").where(~F.exists("embedding", lambda v: v.isNull())).select("vec_id", "embedding")
    for r in good.orderBy(F.size("embedding"), "vec_id").toLocalIterator():
        if block and (len(block) == BLOCK or len(r.embedding) != len(block[0].embedding)):
            out, block = add(out, block), []
        block.append(r)
    if block:
        out = add(out, block)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, dist double")
    return first_of_each(out, ["query_id"], ["dist", "vec_id"], k).where(F.col("dist") <= most)
