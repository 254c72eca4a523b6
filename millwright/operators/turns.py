"""Passes in which the tokens of a drawing, one after another, each take the first token in reach that is left: without listing the pairs in reach."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Cells that what a token reaches is wide or high.
ACROSS = 6


@dataclass(frozen=True)
class Pass:
    """Who asks, who can be taken, whether a token fits by its place less that of who asks, and the bounds of these differences."""

    asks: Column
    gives: Column
    fits: Callable[[float, float], bool]
    x: tuple[float, float]
    y: tuple[float, float]


def within(radius: float) -> dict:
    """For a pass to tokens up to a distance, which is computed as SQL does."""
    edge = radius * (1 + 1e-12)  # a rounded difference can be the radius where the true one is more
    return {"fits": lambda dx, dy: math.sqrt(dx * dx + dy * dy) <= radius, "x": (-edge, edge), "y": (-edge, edge)}


def claim_in_turn(tokens: DataFrame, group: str, key: str, x: str, y: str, passes: list[Pass], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Pass after pass, each token that asks, in the order of the whole number `key`, takes of its group the token of the lowest key that fits and is
    free, unless it is taken itself. So of all pairs that fit, in the order of pass, asker and giver, each is taken unless one of its
    sides is taken before. Returns pass (1 for the first), a (who asked), b (who was taken) and the columns `keep` of both, with a_ and b_.

    Keys are unique. Tokens without a group or a finite place are never in a pair. A task has the tokens of one group at a time, in flat arrays, in the order
    of keys. A cell has its places with a free token, by the first one of each; who asks looks at the first that fits in each cell it reaches."""
    inf = F.lit(float("inf"))
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << n) for n, c in enumerate(c for p in passes for c in (p.asks, p.gives))), F.lit(0))
    at = tokens.select(F.col(group).alias("__g"), F.col(key).cast("long").alias("__k"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), mask.alias("__m"), *keep)
    at = at.where((F.abs("__x") < inf) & (F.abs("__y") < inf) & (F.col("__m") > 0)).where("__g is not null and __k is not null")
    at = at.repartition("__g").sortWithinPartitions("__g", "__k")
    kept = [at.schema[c] for c in keep]
    rules = [(p.fits, p.x, p.y) for p in passes]
    schema = at.select(F.lit(0).alias("pass"), F.col("__k").alias("a"), F.col("__k").alias("b"), *(F.col(f.name).alias(f"{p}_{f.name}") for p in "ab" for f in kept)).schema

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, []
        for batch in batches:
            runs, start = pc.run_end_encode(batch.column("__g")), 0
            for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if value != group and parts:
                    yield from _claimed(pa.Table.from_batches(parts), rules, keep)
                    parts = []
                group = value
                parts.append(batch.slice(start, end - start).select(["__k", "__x", "__y", "__m", *keep]))
                start = end
        if parts:
            yield from _claimed(pa.Table.from_batches(parts), rules, keep)

    return at.mapInArrow(take, schema)


def _claimed(table: pa.Table, rules: list[tuple], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """What the tokens of one group, in the order of keys, take."""
    keys, xs, ys, masks = (table.column(c).to_numpy() for c in ("__k", "__x", "__y", "__m"))
    taken = bytearray(len(keys))
    for n, (fits, x, y) in enumerate(rules):
        free = np.frombuffer(bytes(taken), np.uint8) == 0
        asks, gives = (np.flatnonzero(free & (masks >> bit & 1 == 1)) for bit in (2 * n, 2 * n + 1))
        a, b = _pass(asks, gives, xs, ys, fits, x, y, taken)
        if a:
            columns = [pa.array([n + 1] * len(a), pa.int32()), pa.array(keys[a]), pa.array(keys[b]), *(table.column(c).take(pa.array(side)).combine_chunks() for side in (a, b) for c in keep)]
            yield pa.RecordBatch.from_arrays(columns, ["pass", "a", "b", *(f"{p}_{c}" for p in "ab" for c in keep)])


def _pass(asks: np.ndarray, gives: np.ndarray, xs: np.ndarray, ys: np.ndarray, fits: Callable, x: tuple, y: tuple, taken: bytearray) -> tuple[list[int], list[int]]:
    if not len(asks) or not len(gives):
        return [], []
    wide, high = ((max(hi - lo, 1e-300) / ACROSS) for lo, hi in (x, y))
    # tokens at one place fit the same ones, so a cell has the first of each place only, which leads to the next one there
    order = gives[np.lexsort((gives, ys[gives], xs[gives]))]
    same = (xs[order][1:] == xs[order][:-1]) & (ys[order][1:] == ys[order][:-1])
    after = np.full(len(xs), -1, np.int64)
    after[order[:-1][same]] = order[1:][same]
    first = order[np.concatenate(([True], ~same))]
    after, px, py = after.tolist(), xs.tolist(), ys.tolist()
    cells: dict[tuple[int, int], list[int]] = {}
    for i in np.sort(first).tolist():
        cells.setdefault((math.floor(px[i] / wide), math.floor(py[i] / high)), []).append(i)
    end, a, b = len(px), [], []

    def drop(i: int) -> None:
        taken[i] = 1
        cell = cells.get((math.floor(px[i] / wide), math.floor(py[i] / high)))
        if cell:
            k = bisect_left(cell, i)
            if k < len(cell) and cell[k] == i:
                del cell[k]
                i = after[i]
                while i >= 0 and taken[i]:
                    i = after[i]
                if i >= 0:
                    insort(cell, i)

    for i in asks.tolist():
        if taken[i]:
            continue
        ax, ay, best = px[i], py[i], end
        rows = range(math.floor((ay + y[0]) / high), math.floor((ay + y[1]) / high) + 1)
        for cx in range(math.floor((ax + x[0]) / wide), math.floor((ax + x[1]) / wide) + 1):
            for cy in rows:
                for j in cells.get((cx, cy), ()):
                    if j >= best:
                        break
                    if j != i and fits(px[j] - ax, py[j] - ay):
                        best = j
                        break
        if best < end:
            drop(i)
            drop(best)
            a.append(i)
            b.append(best)
    return a, b
