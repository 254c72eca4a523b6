"""All contract columns of personal data against the patterns as written; texts whose polynomial hashes would be equal."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millwright.llm import bagminhash, packing, pii
from millwright.llm.common import buffers, word_hashes
from millwright.llm.tokens import default_vocabulary, tokenizer

KINDS = ("email", "ip", "card", "phone")


def plain_spans(text):
    return pii.brute_base(text)


def hold(rows, report):
    got = {r.doc_id: r for r in report.collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        spans = plain_spans(text)
        n = Counter(k for k, *_ in spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in KINDS), (i, text)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        terms = [s.split(":") for s in r.spans.split(",") if s.startswith("term:")]
        assert r.spans == ",".join([*filter(None, [joined]), *(":".join(t) for t in terms)]) and r.n_term == len(terms)


def test_counts_of_each_kind(spark):
    rng, parts = np.random.default_rng(4), ["bob@x.org", "10.0.0.1", "4111 1111 1111 1111", "+49 30 1234567", "1.2.3.4.5.6.7.8", "300.1.1.1", "a@b", "é😀", "word", "4111-1111", "+1 (2)", "x@y.z@w.v", "1.2.3.4@h.de"]
    rows = [(i, " ".join(rng.choice(parts, int(rng.integers(0, 14))))) for i in range(150)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hold(rows, pii.report(df))
    assert pii.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [32_000])
def test_a_text_of_many_spans_takes_seconds(spark, n):
    text = " ".join(f"u{k}@h{k % 7}.org" for k in range(n))
    df = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    began = time.time()
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert out[1] == " ".join(["[EMAIL]"] * n) and out[2] == "plain"
    assert time.time() - began < 40


def test_overlapping_spans_are_replaced_once(spark):
    rows = [(1, "at 1.2.3.4@h.de now"), (2, "x" * 1500 + " bob@x.org " + "é" * 3000 + " 10.0.0.1")]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].startswith("at [") and out[1].endswith(" now") and "1.2" not in out[1]
    assert out[2] == "x" * 1500 + " [EMAIL] " + "é" * 3000 + " [IP]"


@pytest.fixture(scope="module")
def morse():
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_complementary_texts_have_their_own_ids_and_classes(spark, morse):
    df = spark.createDataFrame(list(enumerate(morse)), "doc_id long, text string")
    own = tokenizer(default_vocabulary()).tokenizer
    got = {r.doc_id: r.ids_crc32 for r in packing.cut(df).where("piece = 0").collect()}
    for i, t in enumerate(morse):
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 1][:4096], "<u4")
        assert got[i] == zlib.crc32(ids.tobytes())
    near = {r.doc_id: r for r in bagminhash.near_duplicates(df).collect()}
    assert near[1].component_id == 1 and near[1].class_id == 1 and near[1].kept


def test_hashes_follow_bytes_alone():
    words = ["a" * k for k in range(1, 60)] + ["ab" * k for k in range(1, 30)] + [f"w{k}" for k in range(2000)]
    data, offsets = buffers(pa.array(words))
    h = word_hashes(data, offsets[:-1], offsets[1:])
    assert len(set(h.tolist())) == len(words)
    back, ends = buffers(pa.array(words[::-1]))
    assert word_hashes(back, ends[:-1], ends[1:])[::-1].tolist() == h.tolist()
    assert not set(word_hashes(data, offsets[:-1], offsets[1:], 1).tolist()) & set(h.tolist())


def test_classes_are_those_of_equal_words(spark):
    texts = ["One two, three", "one TWO three!", "one two three four", "onetwo three", " one two\nthree ", "é é", "É é", "x", "x ", None, "", "..", "x.."]
    rows = bagminhash.sign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "__p1", "__p2", F.col("__n").alias("n")).collect()
    of = {}
    for r in rows:
        of.setdefault((r["__p1"], r["__p2"]) if r.n else r.doc_id, set()).add(r.doc_id)
    assert sorted(map(sorted, of.values())) == [[0, 1, 4], [2], [3], [5], [6], [7, 8, 12], [9], [10], [11]]
