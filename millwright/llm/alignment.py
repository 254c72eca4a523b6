"""Cross-tokenizer alignment: where two tokenizers' tokens of a text end together, which tokens overlap, and how common each such pair is.

A text with a space before it is cut into stretches: a stretch begins at a space that follows anything but white space.
Neither vocabulary has a token that goes on from a stretch into the next one (no pattern of A ends in a space, no piece of
B holds one behind another character), so a text's tokens are those of its stretches, and both tokenizers' tokens end
together wherever a stretch ends. Each different stretch is therefore aligned once per Python worker; equality with whole
texts is tested. Where white space beyond ASCII stands before a space, no stretch begins.

Alignment is a pipeline over Arrow tables: the lists of ids are flattened and get parent indices; cumulative sums of the
tokens' byte lengths, less those before the parent, are their ends; an outer hash join on (parent, end) puts the ends of
both side by side. Ends of both close a group; every end closes one link, between the tokens that hold the bytes before it.
Table.group_by counts for a chunk of documents how many hold a pair linked; Spark adds the chunks' counts up, finds the
highest of each A id, and sends to each chunk the counts of its own pairs, so nothing grows with the corpus in any task.

Edge cases: texts that are null or empty, or that the joined tokens of A or B don't give back, have no tokens: zeros and
an empty groups_sha256. Repeated rows, and those without an id, are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import buffers, chunks, stored, tune
from .tokens import Entries, first_of_each, piece_hashes

#: Bytes of text in a chunk of documents: what is counted at once.
CHUNK_TEXT = 8 << 20
#: Different stretches, and bytes of them with what is known of them, that a worker keeps.
MOST, MOST_BYTES = 400_000, 96 << 20
_SPACE = np.zeros(256, bool)
_SPACE[:33] = True


def with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty."""
    n = np.diff(offsets)
    full = n > 0
    moved = offsets + np.concatenate([[0], np.cumsum(full)])
    out = np.empty(int(moved[-1]), np.uint8)
    firsts = moved[:-1][full]
    own = np.ones(len(out), bool)
    own[firsts] = False
    out[own], out[firsts] = data, 32
    return out, moved


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each stretch of texts that begin with a space, and the number of stretches of each row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    b1, b2, b3 = (np.concatenate([np.zeros(k, np.uint8), data[:-k] if k < n else data[:0]])[:n] for k in (1, 2, 3))
    # white space beyond ASCII ends in one of these ways; other characters that do only make stretches longer
    odd = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 >= 0xE1) & (b3 <= 0xE3) & ((b2 == 0x9A) | (b2 == 0x80) | (b2 == 0x81)))
    begins = (data == 32) & ~_SPACE[b1] & ~odd
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n), np.diff(np.searchsorted(starts, offsets))


def byte_tokens(path: str):
    """The byte-level tokenizer, and each id's bytes: its characters stand for bytes, printable ones for themselves."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    names = [own.id_to_token(i) or "" for i in range(own.get_vocab_size(with_added_tokens=True))]
    return own, [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in names]


def piece_tokens(path: str):
    """The sentencepiece model, and each id's bytes."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    return own, [bytes([int(t[3:5], 16)]) if own.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]


def ends_of(lists: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each token: its id, the number of its list, and its end within the list's bytes."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    sums = pc.cumulative_sum(pc.take(lengths, flat))
    before = pc.take(pa.concat_arrays([pa.array([0], sums.type), sums]), pc.take(lists.offsets, parent))
    return flat, parent, pc.subtract(sums, before)


def align(a: pa.ListArray, b: pa.ListArray, a_bytes: pa.Array, b_bytes: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of ids of the same byte strings, which aren't empty -> their groups as text, the number of groups, the first link of each (and of the end), and the links (a << 32 | b)."""
    sides = []
    for lists, lengths, name in ((a, a_bytes, "a"), (b, b_bytes, "b")):
        flat, parent, end = ends_of(lists, lengths)
        key = pc.bit_wise_or(pc.shift_left(pc.cast(parent, pa.int64()), pa.scalar(32, pa.int64())), pc.cast(end, pa.int64()))
        sides.append(pa.table({"key": key, name: pc.cast(flat, pa.int64())}))
    ends = sides[0].join(sides[1], "key", join_type="full outer", use_threads=False).sort_by("key")
    is_a, is_b = (pc.is_valid(ends[c]).combine_chunks().to_numpy(zero_copy_only=False) for c in "ab")
    closes = is_a & is_b
    owner = ends["key"].to_numpy() >> 32
    # the tokens that hold the bytes before an end are the next ones to end; the last end is one of both
    of_a, of_b = (pc.fill_null_backward(ends[c]).to_numpy() for c in "ab")
    first = np.searchsorted(owner, np.arange(len(a) + 1))
    group = np.cumsum(closes) - closes
    n_groups = int(closes.sum())
    sides = []
    for has, c in ((is_a, "a"), (is_b, "b")):
        names = pc.cast(ends[c].combine_chunks().filter(pa.array(has)), pa.string())
        offs = np.concatenate([[0], np.cumsum(np.bincount(group[has], minlength=n_groups))]).astype(np.int32)
        sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offs), names), ","))
    each = pc.binary_join_element_wise(*sides, "|")
    per = np.bincount(owner[closes], minlength=len(a))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), each), ";")
    return texts, per, first, of_a << 32 | of_b


class Aligner:
    """rows(): what is known of each text, and its links. Different stretches are kept, up to a bound."""

    def __init__(self, a_path: str, b_path: str):
        (self.a, self.a_tokens), (self.b, self.b_tokens) = byte_tokens(a_path), piece_tokens(b_path)
        self.a_bytes, self.b_bytes = (pa.array([len(x) for x in t], pa.int64()) for t in (self.a_tokens, self.b_tokens))
        self.space = [self.b.piece_to_id("▁")]
        self._reset(MOST)

    def _reset(self, most: int) -> None:
        self.seen, self.used = Entries(most), 0
        self.texts: list[str] = []
        self.sizes, self.first, self.links = np.zeros((0, 3), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _add(self, h: np.ndarray, check: np.ndarray, raw: list[bytes]) -> None:
        texts = [x.decode("utf-8", "replace") for x in raw]
        ids_a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        ids_b = [ids or self.space for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]  # B adds the first space itself
        good = [b"".join(map(self.a_tokens.__getitem__, x)) == b"".join(map(self.b_tokens.__getitem__, y)) == r for x, y, r in zip(ids_a, ids_b, raw, strict=True)]
        kept = lambda lists: pa.array([x if g else [] for x, g in zip(lists, good, strict=True)], pa.list_(pa.int32()))
        a, b = kept(ids_a), kept(ids_b)
        groups, per, first, links = align(a, b, self.a_bytes, self.b_bytes)
        n = [pc.list_value_length(x).to_numpy().astype(np.int64) for x in (a, b)]
        self.sizes = np.concatenate([self.sizes, np.stack([*n, per], 1)])
        self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
        self.links = np.concatenate([self.links, links])
        self.texts += groups.to_pylist()
        self.used += sum(map(len, raw)) + groups.nbytes + links.nbytes + 100 * len(raw)
        self.seen.add(h, check)

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h, check = piece_hashes(data, starts, ends)
        if self.seen.n + len(h) > self.seen.most or self.used > MOST_BYTES:
            self._reset(max(MOST, 2 * len(h)))
        entry = self.seen.find(h, check)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            new = miss[first_of_each(h[miss], check[miss])]
            self._add(h[new], check[new], [data[starts[k] : ends[k]].tobytes() for k in new.tolist()])
            entry[miss] = self.seen.find(h[miss], check[miss])
        return entry

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(rows, 4) A and B tokens, groups, links; the digest of each row's groups; and row, pair and times of the links of each row."""
        data, offsets = with_space(data, offsets)
        starts, ends, per_row = stretches(data, offsets)
        entry = self.entries(data, starts, ends)
        row = np.repeat(np.arange(len(per_row)), per_row)
        bounds = np.concatenate([[0], np.cumsum(per_row)])
        links = self.first[entry + 1] - self.first[entry]
        whole = np.bincount(row[links == 0], minlength=len(per_row)) == 0  # a stretch that isn't given back has no link
        whole &= per_row > 0
        sizes = np.column_stack([self.sizes[entry], links])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sizes, 0)])
        n = (sums[bounds[1:]] - sums[bounds[:-1]]) * whole[:, None]
        texts, of = self.texts, entry.tolist()
        digests = [hashlib.sha256(";".join([texts[e] for e in of[i:j]]).encode()).hexdigest() if w else "" for i, j, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), whole.tolist(), strict=True)]
        # every different stretch of a row once, with its number there
        key, times = np.unique((row << 32 | entry)[whole[row]], return_counts=True)
        entry, count = key & 0xFFFFFFFF, self.first[(key & 0xFFFFFFFF) + 1] - self.first[key & 0xFFFFFFFF]
        take = np.arange(int(count.sum())) + np.repeat(self.first[entry] - (np.cumsum(count) - count), count)
        return n, digests, np.repeat(key >> 32, count), self.links[take], np.repeat(times, count)


def _summed(row: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One (row, pair) each, with its times added up."""
    order = np.lexsort((pair, row))
    row, pair, times = row[order], pair[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])[: len(row)])
    return row[at], pair[at], np.add.reduceat(times, at) if len(at) else times


_MADE: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker and pair of vocabularies."""
    if (a_path, b_path) not in _MADE:
        _MADE[a_path, b_path] = Aligner(a_path, b_path)
    return _MADE[a_path, b_path]


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def encode(docs: DataFrame, a_path: str, b_path: str, chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """Rows of documents: chunk, doc_id, counts, digest, and its links as places in the chunk's pairs (at) with times. A row for
    each chunk: its pairs and in how many of its documents each is (n). Written, so the two agree whatever is computed again."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times", "pairs", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, size, parts = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, 0, []
        def flush() -> pa.RecordBatch:
            ids, n, digests, *links = zip(*parts, strict=True)
            rows = np.cumsum([0, *map(len, n)])
            row = np.concatenate([x + k for x, k in zip(links[0], rows, strict=False)])
            pair, times = np.concatenate(links[1]), np.concatenate(links[2])
            held = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
            pairs = held["pair"].to_numpy()
            offs = np.searchsorted(row, np.arange(rows[-1] + 1)).astype(np.int32)
            of = lambda values: pa.concat_arrays([pa.ListArray.from_arrays(pa.array(offs), pa.array(values.astype(np.int32))), pa.nulls(1, pa.list_(pa.int32()))])
            last = lambda values: pa.concat_arrays([pa.nulls(int(rows[-1]), pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))])
            counts = np.concatenate(n)
            plus = lambda x: pa.concat_arrays([x, pa.nulls(1, x.type)])
            columns = [pa.array(np.full(rows[-1] + 1, number)), plus(pa.concat_arrays(list(ids)))] + [plus(pa.array(np.ascontiguousarray(counts[:, k]))) for k in range(4)]
            columns += [plus(pa.array([d for x in digests for d in x], pa.string())), of(np.searchsorted(pairs, pair)), of(times), last(pairs), last(held["count_all"].to_numpy())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets, 1 << 20):
                n, digests, row, pair, times = own.rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append((batch.column("doc_id")[i:j], n, digests, *_summed(row, pair, times)))
                size += int(offsets[j] - offsets[i])
                if size >= chunk_text:
                    yield flush()
                    number, size, parts = number + 1, 0, []
        if parts:
            yield flush()

    rows = docs.select("doc_id", "text").mapInArrow(run, f"chunk long, doc_id {kind}, {_COLUMNS}, at array<int>, times array<int>, pairs array<long>, n array<long>")
    return stored(rows)


def report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of every row of docs (doc_id, text)."""
    default = default_vocabularies() if a_path is None or b_path is None else ("", "")
    encoded = encode(docs, a_path or default[0], b_path or default[1], chunk_text)
    local = encoded.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "n")).alias("at", "p")).select("chunk", "at", "p.pairs", "p.n")
    counts = local.groupBy("pairs").agg(F.sum("n").alias("count"))
    most = Window.partitionBy(F.shiftright("pairs", 32))  # the B ids that one A id can be linked with
    counts = counts.select("pairs", "count", (F.col("count") == F.max("count").over(most)).alias("best"))
    values = local.select("chunk", "at", "pairs").join(counts, "pairs").select(F.col("chunk").alias("of"), "at", "count", "best")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("at")
        count, best = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        at, times = (left[c].combine_chunks() for c in ("at", "times"))
        flat, n = pc.list_flatten(at).to_numpy().astype(np.int64), pc.list_flatten(times).to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(at).to_numpy())]).astype(np.int64)
        total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]).astype(np.int64))
        kept = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return kept.append_column("n_best", total(best[flat] * n)).append_column("count_sum", total(count[flat] * n))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = encoded.where("pairs is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")
    return rows.groupBy("chunk").cogroup(values.groupBy("of")).applyInArrow(sums, f"doc_id {kind}, {_COLUMNS}, n_best long, count_sum long")


def brute_force(rows: list[tuple], a_path: str | None = None, b_path: str | None = None) -> list[tuple]:
    """The report by plain loops over whole texts, for tests."""
    default = default_vocabularies()
    (a, a_tokens), (b, b_tokens) = byte_tokens(a_path or default[0]), piece_tokens(b_path or default[1])
    known, held = [], {}
    for i, text in rows:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        whole = f" {text}".encode() if text else b""
        if b"".join(a_tokens[t] for t in ids_a) != whole or b"".join(b_tokens[t] for t in ids_b) != whole:
            ids_a = ids_b = []
        groups, links, at_a, at_b, end_a, end_b, own = [], [], 0, 0, 0, 0, ([], [])
        while at_a < len(ids_a) or at_b < len(ids_b):
            next_a, next_b = end_a <= end_b, end_b <= end_a
            if next_a:
                end_a += len(a_tokens[ids_a[at_a]])
                own[0].append(ids_a[at_a])
                at_a += 1
            if next_b:
                end_b += len(b_tokens[ids_b[at_b]])
                own[1].append(ids_b[at_b])
                at_b += 1
            links.append((ids_a[at_a - 1], ids_b[at_b - 1]))
            if end_a == end_b:
                groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
                own = ([], [])
        for p in set(links):
            held[p] = held.get(p, 0) + 1
        known.append((i, ids_a, ids_b, groups, links))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(i, len(x), len(y), len(g), len(p), digest(g), sum(held[q] == most[q[0]] for q in p), sum(held[q] for q in p)) for i, x, y, g, p in known]
