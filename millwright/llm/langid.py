"""Language identification: family first, then one-versus-one linear SVMs inside the family.

Features are the relative frequencies of hashed letter 1-, 2- and 3-grams of the whole lower-cased text. A binary
linear SVM per pair of families picks the family by votes; inside it, one SVM per pair of languages does the same.
Training takes a documented, bounded sample of distinct labelled texts; prediction reads every whole text.

Edge cases: a null text, or one without a letter, is `und` with score 0; without any training row all are `und`; an
unknown language is a family of its own; equal votes go to the larger sum of margins, then to the smaller name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import chunks, hidden, shown, stored, tune

#: Genealogical families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc rm la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi ur bn pa gu mr ne si",
    "sinitic": "zh yue wuu",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

DIMENSIONS = 1 << 14
#: Bound of the training sample, over all languages.
SAMPLE_ROWS, LEAST_ROWS = 2400, 20


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed grams of all texts one after another, the first gram of each text (and the end), whether it has a letter."""
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) + 2 for t in low), np.int64, len(low))
    cps = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if low else np.zeros(0, np.uint32)
    kinds = np.unique(cps)
    letter = np.fromiter((chr(c).isalpha() for c in kinds), bool, len(kinds))
    known = np.zeros(int(kinds[-1]) + 1 if len(kinds) else 1, bool)
    known[kinds] = letter
    is_letter = known[cps]
    doc = np.repeat(np.arange(len(low)), sizes)
    seen = np.zeros(len(cps), bool)
    seen[1:] = is_letter[:-1]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    keep = is_letter | seen
    keep[first[first < len(cps)]] = True
    c = np.where(is_letter, cps, 0)[keep].astype(np.uint32)
    doc = doc[keep]
    has = np.bincount(doc, weights=c > 0, minlength=len(low)) > 0
    n = len(c)
    a, b = c, np.zeros(n, np.uint32)
    b[:-1] = c[1:]
    d = np.zeros(n, np.uint32)
    d[:-2] = np.where(doc[2:] == doc[:-2], c[2:], 0)  # the grams of a text are its own, whatever text stands next to it
    one = a * np.uint32(0x9E3779B1)
    two = (one ^ b) * np.uint32(0x85EBCA6B) + np.uint32(1)
    three = ((two ^ (two >> np.uint32(15))) + d) * np.uint32(0xC2B2AE35) + np.uint32(2)
    out = np.empty((n, 3), np.int32)
    for k, h in enumerate((one, two, three)):
        out[:, k] = ((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 14)
    edges = np.searchsorted(doc, np.arange(len(low) + 1))
    return out.reshape(-1), edges * 3, has


@dataclass
class Model:
    """weights: a column for each pair of families, then for each pair of languages in a family; the last row is the bias."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str, str]] = field(default_factory=list)  # level ("" for families), winner if positive, else
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMENSIONS + 1, 0), np.float32))

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        g, edges, has = grams(texts)
        out = np.zeros((len(texts), len(self.pairs)))
        n = np.diff(edges)
        full = np.flatnonzero(n)
        if len(full):
            for k in range(len(self.pairs)):
                w = self.weights[:, k]
                out[full, k] = np.add.reduceat(w[:-1].astype(np.float64)[g], edges[full]) / n[full] + w[-1]
        return out, has

    def _pick(self, level: str, names: list[str], row: np.ndarray) -> tuple[str, float]:
        votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for k, (where, a, b) in enumerate(self.pairs):
            if where == level and a in votes and b in votes:
                m = row[k]
                votes[a if m > 0 else b] += 1
                for name, v in ((a, m), (b, -m)):
                    sums[name] += v
                    least[name] = min(least[name], v)
        best = min(names, key=lambda x: (-votes[x], -sums[x], x))
        return best, 1.0 if least[best] == np.inf else 1 / (1 + float(np.exp(-4 * least[best])))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        rows, has = self.margins(texts)
        langs, scores = [], []
        for row, letters in zip(rows, has, strict=True):
            if not letters or not self.families:
                langs.append("und")
                scores.append(0.0)
                continue
            family, p = self._pick("", sorted(self.families), row)
            lang, q = self._pick(family, self.families[family], row)
            langs.append(lang)
            scores.append(p * q)
        return langs, scores


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 20.0, rounds: int = 12) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised squared hinge loss; classes weigh the same."""
    w = np.zeros(DIMENSIONS + 1)
    cost = np.where(y > 0, c / max((y > 0).mean(), 1e-9), c / max((y < 0).mean(), 1e-9)) / 2
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(7)
    norm = np.array([v @ v for _, v in rows]) + 1 / (2 * cost)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v) - 1 + alpha[i] / (2 * cost[i])
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


#: Frequencies of grams are small; the SVM sees them times this, with a constant 1 for the bias.
_SCALE = 10.0


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """rows: language, indices of grams, their relative frequencies."""
    langs = sorted({r[0] for r in rows})
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(FAMILY.get(lang.lower().split("-")[0], f"only {lang}"), []).append(lang)
    data = [(lang, np.append(at, DIMENSIONS), np.append(v * _SCALE, 1.0)) for lang, at, v in rows]
    of = {lang: f for f, names in families.items() for lang in names}
    todo = [("", a, b, lambda x: of[x]) for a, b in combinations(sorted(families), 2)]
    todo += [(f, a, b, lambda x: x) for f, names in sorted(families.items()) for a, b in combinations(names, 2)]
    pairs, columns = [], []
    for level, a, b, kind in todo:
        some = [(at, v, 1.0 if kind(lang) == a else -1.0) for lang, at, v in data if kind(lang) in (a, b)]
        w = _svm([x[:2] for x in some], np.array([x[2] for x in some]))
        w[:-1] *= _SCALE
        pairs.append((level, a, b))
        columns.append(w)
    weights = np.stack(columns, 1).astype(np.float32) if columns else np.zeros((DIMENSIONS + 1, 0), np.float32)
    return Model(families, pairs, weights)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        g, edges, _ = grams(texts)
        at, v = [], []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            counts = np.bincount(g[i:j], minlength=DIMENSIONS)
            some = np.flatnonzero(counts)
            at.append(some.astype(np.int32).tobytes())
            v.append((counts[some] / max(j - i, 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(at, pa.binary()), pa.array(v, pa.binary())], ["lang", "at", "v"])


#: Parts of the hashes' range that are counted to find where a language's sample ends.
_PARTS = 1 << 16


def _limits(distinct: DataFrame, each: int) -> DataFrame:
    """lang, __limit: the rank up to which a language has `each` texts. No task gathers a language: counts by parts of
    the range bound the ranks that are looked at, to about `each` and a part's."""
    part = F.shiftrightunsigned(F.col("__rank").cast("long") + F.lit(1 << 31), 16).cast("int").alias("__part")
    counts = distinct.groupBy("lang", part).count()
    upto = F.sum("count").over(Window.partitionBy("lang").orderBy("__part"))  # _PARTS rows of a language at most
    last = stored(counts.withColumn("__upto", upto).withColumn("__full", F.col("__upto") >= each).groupBy("lang").agg(F.min(F.when(F.col("__full"), F.col("__part"))).alias("__last")))
    some = distinct.withColumn("__part", part).join(F.broadcast(last), "lang").where(F.col("__last").isNull() | (F.col("__part") <= F.col("__last")))
    order = Window.partitionBy("lang").orderBy("__rank", "__h")
    ranked = some.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= each)
    return stored(ranked.groupBy("lang").agg(F.max("__rank").alias("__limit")))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `sample_rows` distinct texts of `docs` (text, lang), as many of each language; null langs don't count. Of more
    than sample_rows / LEAST_ROWS values of lang, those with the most different texts are learned, so the driver fits a bounded number of SVMs.

    The sample is the texts with the least hashes, so that it depends neither on row order nor on how often a text is repeated.
    """
    tune(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("__h"))
    distinct = stored(rows.groupBy("lang", "__h").count().select("lang", "__h", F.hash("__h").alias("__rank")))
    # languages by the number of their texts, as many as a sample has room for
    most = distinct.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, sample_rows // LEAST_ROWS)).select("lang")
    most = stored(most)
    distinct = distinct.join(F.broadcast(most), "lang")
    each = max(LEAST_ROWS, sample_rows // max(1, most.count()))
    chosen = distinct.join(F.broadcast(_limits(distinct, each)), "lang").where(F.col("__rank") <= F.col("__limit")).select("lang", "__h")
    # at most `sample_rows` keys, but for equal ranks: a bounded broadcast
    sample = rows.join(F.broadcast(chosen), ["lang", "__h"]).dropDuplicates(["lang", "__h"])
    got = sample.select("lang", "text").mapInArrow(_vectors, "lang string, at binary, v binary").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.v)))
    return fit([(r.lang, np.frombuffer(r.at, np.int32), np.frombuffer(r.v, np.float32).astype(np.float64)) for r in got if len(r.at)])


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and a score from 0 to 1 to `docs`; only the text decides."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            ends = np.cumsum([0] + [4 * len(t or "") for t in texts])
            langs, scores = [], []
            for i, j in chunks(ends, 1 << 20):
                a, b = shared.value.predict(texts[i:j])
                langs += a
                scores += b
            columns = [batch.column(n) for n in kept] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, lang, score])

    kept = [c for c in docs.columns if c not in (lang, score)]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(lang, "string").add(score, "double")
    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is not learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learns from the rows of `docs` that aren't held out, and returns doc_id, held_out, lang_pred and score for every row."""
    model = train(docs.where(~held_out()).select("text", "lang"), sample_rows)
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The rows of `docs` whose language is known with a score of `least` or more; their columns stay as they are."""
    model = train(docs.where(~held_out()).select("text", "lang"))
    out = predict(hidden(docs, ["text"]), model, lang="__lang", score="__score")
    return shown(out.where((F.col("__lang") != "und") & (F.col("__score") >= least)), docs.columns, ["text"])
