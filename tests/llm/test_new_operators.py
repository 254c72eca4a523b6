"""LM scoring, alignment and filter audit against plain loops, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.llm import alignment, filter_audit, ppm


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    stems = "the of and to über naïve 日本 😀 don't it's A1 12,5 x#y foo_bar ÉTÉ <|endoftext|> <s> tab\tbed".split(" ")
    out = []
    for i in range(160):
        n = int(rng.integers(0, 120))
        out.append((i, "".join(str(w) + str(rng.choice([" ", " ", " ", "  ", "\n", " \n ", "\r\n", "\xa0 ", "　"])) for w in rng.choice(stems, n))))
    out += [(200 + k, out[k][1]) for k in range(30)]
    out += [(300, None), (301, ""), (302, " "), (303, "   "), (304, " a"), (305, "a "), (306, "a▁b c"), (307, "x" * 5000), (308, "ab " * 4000), (309, "a\x00b\x1c c"), (310, "a\x85 b   c"), (5, out[5][1]), (None, "the of and"), (311, "’ “quoted” ‘a’ b"), (312, "\n\n\n"), (313, "THE Of")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    kinds = ["n", "m", None, ""]
    return spark.createDataFrame([(i, t, kinds[k % 4], 1, 2.0, "c") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, chunk int, n double, part string").repartition(3)


def keyed(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r[:1]) + (str(r[1:]),))


def test_alignment_is_that_of_plain_loops(docs, rows):
    want = keyed(alignment.brute_force(rows))
    for size in (alignment.CHUNK_TEXT, 2000):
        got = alignment.report(docs, chunk_text=size).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
        assert keyed(map(tuple, got)) == want
    of = {r[0]: r for r in want}
    assert of[300][1:] == of[301][1:] == of[306][1:] == (0, 0, 0, 0, "", 0, 0) and of[307][1] > 0
    assert alignment.report(docs.limit(0)).count() == 0


def test_alignment_keeps_its_tables_bounded(docs, rows, monkeypatch):
    own = alignment.Aligner(*alignment.default_vocabularies())
    from millwright.llm.common import buffers
    import pyarrow as pa

    texts = pa.array([t for _, t in rows])
    whole = own.rows(*buffers(texts))
    monkeypatch.setattr(alignment, "MOST_BYTES", 1)
    again = own.rows(*buffers(texts))
    assert all(np.array_equal(x, y) for x, y in zip(whole, again, strict=True))
    assert len(own.rows(*buffers(pa.array(['a b a'])))[1]) == 1 and own.seen.n == 2  # those before are gone


def test_scores_are_those_of_a_plain_trie(docs, rows):
    for order, size in ((4, ppm.CHUNK_TEXT), (2, 3000)):
        want = {r[0]: r for r in ppm.brute_force(rows, order)}
        got = ppm.score(docs, order, size).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[1:5]
            assert r.base_score == pytest.approx(w[5], abs=1e-6) and r.score == pytest.approx(w[6], abs=1e-6)
    assert ppm.score(docs.limit(0)).count() == 0


def test_scores_without_training(spark):
    held = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 10 == 0][:2]
    got = ppm.score(spark.createDataFrame([(i, "ab") for i in held], "doc_id long, text string")).collect()
    assert all(r.score == pytest.approx(-3 * np.log10(257)) and r.base_score == pytest.approx(0) and r.n_known == 0 and r.n_tokens == 2 for r in got)


def test_probabilities_of_a_context_add_up_to_one(spark):
    seen = {(c, s): 1 + (7 * c + 3 * s) % 5 for c in (97, 98, 255) for s in range(97, 103) if (c + s) % 3}
    grams = [(c << 8 | s, seen.get((c, s), 0)) for c in (97, 98, 99, 255) for s in range(256)]
    values = {r.g: 10**r.value for r in ppm.code_lengths(spark.createDataFrame(grams, "g long, n long"), 1).collect()}
    for c in (97, 98, 99, 255):  # the 257th symbol is as likely as any other that was never seen
        assert sum(values[c << 8 | s] for s in range(256)) + values[c << 8] == pytest.approx(1)


def plain_audit(rows, marks):
    first, facts = {}, []
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        facts.append((part or "", fails, *marks.get(i, (0, 0))))
    out = {}
    for part in {f[0] for f in facts}:
        own, taken = [f for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            gone = set()
            for step, x in enumerate(p, 1):
                now = {k for k, f in enumerate(own) if f[1][x] and k not in gone}
                redundant = sum(f[1][x] for k, f in enumerate(own) if k in gone)
                gone |= now
                taken[x] += len(now)
                out[part, "".join(p), step] = [len(own) - len(gone), len(now), redundant, sum(f[1][x] and sum(f[1].values()) == 1 for f in own), sum(own[k][2] for k in now), sum(own[k][3] for k in now), x]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = taken[v[-1]]
    return out


def test_audit_is_that_of_filters_applied_in_order(spark, docs, rows):
    kinds = ["n", "m", None, ""]
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 250, 3)] + [(3, 0, 0), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    best = {}
    for i, q, x in marks:
        if i is not None:
            best[i] = tuple(map(max, best.get(i, (0, 0)), (q, x)))
    want = plain_audit([(i, t, kinds[k % 4]) for k, (i, t) in enumerate(rows)], best)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(docs, labels).collect()}
    assert got == want and len(got) == 3 * 600
    assert filter_audit.audit(docs.limit(0), labels).count() == 0


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    from millwright.llm.common import buffers
    import pyarrow as pa

    monkeypatch.setattr(filter_audit, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data, offsets = buffers(pa.array(["a b a longer-than-eight longer-than-eighty longer-than-eight", "", "b b", "é è é"]))
    starts, ends, n, _ = filter_audit.transduce(data, offsets)
    assert filter_audit.distinct_words(data, starts, ends, n).tolist() == [4, 0, 1, 2]
