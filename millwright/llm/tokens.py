"""Token ids of whole texts by a public tokenizer, with a cache of the ids of the pieces of texts.

A vocabulary that drops white space and cuts a text into runs of letters, single digits and runs of other characters
gives a text the ids of those pieces one after another, so each different piece is tokenised once per Python worker;
equality with whole texts is tested. Chunks between white space that hold anything but ASCII and À to ÿ, an apostrophe
or a bar are left whole. Pieces are found by two independent 64-bit hashes of their bytes.
"""

from __future__ import annotations

import os

import numpy as np

from .common import GAP, LOWER, chunks, word_hashes, words

#: Kinds of bytes: 0 between chunks, 1 letters (with those of À to ÿ), 2 digits, 3 others.
_KIND = np.full(256, 3, np.uint8)
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_KIND[~GAP] = 0
#: Bytes that leave a chunk whole: controls, the apostrophe of contractions, the bar of control tokens, what isn't in À to ÿ.
_WHOLE = np.zeros(256, bool)
_WHOLE[:33] = _WHOLE[[39, 124, 127]] = _WHOLE[192:] = True
_WHOLE[[9, 10, 13, 32, 195]] = False


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each piece, and the number of pieces of each row."""
    starts, ends, per_row = words(data, offsets, GAP)
    if not len(starts):
        return starts, ends, per_row
    kind = _KIND[data]
    odd = _WHOLE[data]
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 195
    odd |= second & ((data == 0x97) | (data == 0xB7))
    seen = np.concatenate([[0], np.cumsum(odd)])
    whole = seen[ends] > seen[starts]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    if whole.any():
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[whole]] += 1
        inside[ends[whole]] -= 1
        begins &= np.cumsum(inside) == 0
    begins[starts] = True
    at = np.flatnonzero(begins[:-1] & (kind > 0))
    begins[ends] = True
    return at, np.flatnonzero(begins[1:] & (kind > 0)) + 1, np.diff(np.searchsorted(at, offsets))


class Entries:
    """Numbers of the byte strings seen so far, by two 64-bit hashes of each, in a table of open addresses. The first hash is never 0."""

    def __init__(self, most: int):
        self.most, self.n = most, 0
        self.size = 1 << int(2 * most).bit_length()
        self.keys, self.checks, self.entry = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each string, or -1."""
        pos, out, todo = (h & np.uint64(self.size - 1)).astype(np.int64), np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(todo):
            p = pos[todo]
            key = self.keys[p]
            hit = (key == h[todo]) & (self.checks[p] == check[todo])
            out[todo[hit]] = self.entry[p[hit]]
            todo = todo[~hit & (key != 0)]
            pos[todo] = (pos[todo] + 1) & (self.size - 1)
        return out

    def add(self, h: np.ndarray, check: np.ndarray) -> None:
        """Numbers strings that differ from each other and from those seen so far."""
        entries = np.arange(self.n, self.n + len(h))
        self.n += len(h)
        pos, todo = (h & np.uint64(self.size - 1)).astype(np.int64), np.arange(len(h))
        while len(todo):
            p = pos[todo]
            free = np.flatnonzero(self.keys[p] == 0)
            self.entry[p[free]] = entries[todo[free]]  # of several at one place, the last stays
            won = free[self.entry[p[free]] == entries[todo[free]]]
            self.keys[p[won]], self.checks[p[won]] = h[todo[won]], check[todo[won]]
            todo = np.delete(todo, won)
            pos[todo] = (pos[todo] + 1) & (self.size - 1)


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each piece's bytes, the first of which isn't 0."""
    h = word_hashes(data, starts, ends)
    h[h == 0] = 1
    return h, word_hashes(data, starts, ends, 1)


def first_of_each(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Places of one of each pair of hashes."""
    order = np.lexsort((check, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    return order[new]


class ChunkTokenizer:
    """ids(): the token ids of texts. Memory is bounded: the caches start anew beyond `most` entries."""

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._reset()

    def _reset(self) -> None:
        self.seen = Entries(self.most)
        self.first, self.ids_flat, self.used = np.zeros(self.most + 2, np.int64), np.zeros(4 * self.most, np.uint32), 0

    def _add(self, h: np.ndarray, check: np.ndarray, lists: list[list[int]]) -> None:
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((x for ids in lists for x in ids), np.uint32, int(n.sum()))
        if self.used + len(flat) > len(self.ids_flat):
            self.ids_flat = np.concatenate([self.ids_flat, np.zeros(max(len(flat), len(self.ids_flat) // 2), np.uint32)])
        self.ids_flat[self.used : self.used + len(flat)] = flat
        self.first[self.seen.n + 1 : self.seen.n + 1 + len(h)] = self.used + np.cumsum(n)
        self.used += len(flat)
        self.seen.add(h, check)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch(texts[i : i + 4096], add_special_tokens=False)]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and each row's number of ids."""
        flat, counts = [], []
        for i, j in chunks(offsets):
            a, b = offsets[i], offsets[j]
            part, offs = data[a:b], offsets[i : j + 1] - a
            starts, ends, per_row = pieces(part, offs)
            h, check = piece_hashes(LOWER[part], starts, ends)
            if self.seen.n + len(h) > self.most:
                if len(h) > self.most:
                    self.most = 2 * len(h)
                self._reset()
            entry = self.seen.find(h, check)
            miss = np.flatnonzero(entry < 0)
            if len(miss):
                new = miss[first_of_each(h[miss], check[miss])]
                raw = part.tobytes()
                self._add(h[new], check[new], self._encode([raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in new]))
                entry[miss] = self.seen.find(h[miss], check[miss])
            first = self.first[entry]
            n = self.first[entry + 1] - first
            sums = np.cumsum(n)
            total = int(sums[-1]) if len(sums) else 0
            take = np.arange(total) + np.repeat(first - (sums - n), n)
            flat.append(self.ids_flat[take])
            bounds = np.concatenate([[0], np.cumsum(per_row)])
            ids_before = np.concatenate([[0], sums])
            counts.append(np.diff(ids_before[bounds]))
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


_MADE: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer for each Python worker and vocabulary."""
    if path not in _MADE:
        _MADE[path] = ChunkTokenizer(path)
    return _MADE[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
