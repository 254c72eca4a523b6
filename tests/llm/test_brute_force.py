"""Language ID, near-dedup, HTML extraction and the pipeline against plain versions that share no code with their main paths."""

import re
import xml.etree.ElementTree as ET
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from millwright.llm import bagminhash, decontam, html_extract, langid, pii
from millwright.llm.tokens import default_vocabulary, tokenizer

STEMS = {"en": "the of and to in that with from which were", "de": "der die und nicht mit auf eine sich dem über", "fr": "le la les des une dans pour avec être très", "es": "el los una que por con para está según niño"}


def plain_grams(text):
    """Hashed letter grams of one text: letters, and one 0 before the text and after each run of letters."""
    seq = [0]
    for c in (text or "").lower():
        if c.isalpha():
            seq.append(ord(c))
        elif seq[-1]:
            seq.append(0)
    seq += [0] * (seq[-1] != 0)
    one = lambda a: a * 0x9E3779B1 % 2**32
    two = lambda a, b: ((one(a) ^ b) * 0x85EBCA6B + 1) % 2**32
    three = lambda a, b, d: (((two(a, b) ^ (two(a, b) >> 15)) + d) * 0xC2B2AE35 + 2) % 2**32
    out = []
    for k, a in enumerate(seq):
        b, d = (seq[k + j] if k + j < len(seq) else 0 for j in (1, 2))
        out += [((h ^ (h >> 13)) * 0x27D4EB2F % 2**32) >> 18 for h in (one(a), two(a, b), three(a, b, d))]
    return out


def plain_language(model, text):
    if not any(c.isalpha() for c in text or "") or not model.families:
        return "und", 0.0
    counts = Counter(plain_grams(text))
    total = sum(counts.values())
    score, level, names = 1.0, "", sorted(model.families)
    for _ in range(2):
        margins = {n: [] for n in names}
        for k, (where, a, b) in enumerate(model.pairs):
            if where == level and a in margins and b in margins:
                m = sum(float(model.weights[g, k]) * n for g, n in counts.items()) / total + float(model.weights[-1, k])
                margins[a].append(m)
                margins[b].append(-m)
        level = min(names, key=lambda x: (-sum(v > 0 for v in margins[x]), -sum(margins[x]), x))
        score *= 1 / (1 + np.exp(-4 * min(margins[level]))) if margins[level] else 1.0
        names = model.families.get(level, [])
    return level, score


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_bag(text):
    w = plain_words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_near(rows):
    """rows (id, text) -> smallest id of each row's component, in order of rows; and the number of similar pairs of different bags."""
    bags, parent, links = [plain_bag(t) for _, t in rows], list(range(len(rows))), 0

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = (bags[i] & bags[j]).total()
            if both and both >= 0.8 * ((bags[i] | bags[j]).total()) - 1e-9:
                links += plain_words(rows[i][1]) != plain_words(rows[j][1])
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return [least[root(k)] for k in range(len(rows))], links


@pytest.fixture(scope="module")
def rows():
    """Documents in four languages: near copies from far below to far above the threshold, copies, bags with weights, odd texts."""
    rng, out = np.random.default_rng(11), []
    for i in range(24):
        lang = list(STEMS)[i % 4]
        stems = STEMS[lang].split()
        base = [f"{w}{chr(97 + int(k))}" if k < 26 else w for w, k in zip(rng.choice(stems, 180), rng.integers(0, 60, 180), strict=True)]
        for changes in (0, 0, 1, 2, 3, 4, 6, 9):
            w = list(base)
            for k in rng.choice(len(w), changes, replace=False):
                w[k] = f"{stems[int(rng.integers(len(stems)))]}{chr(97 + int(rng.integers(26)))}"
            out.append((" ".join(w), lang))
        out.append((" ".join(base[:12] * int(rng.integers(3, 9))), lang))
        out.append((" ".join(base[:12] * int(rng.integers(3, 9))), lang))
    out += [(t, "en") for t in (None, "", "12 !!", "the of", "THE of", "the, of!", "and " * 3000, "mail bob@x.org now, or +49 30 1234567 that were from 10.0.0.1 with 4111 1111 1111 1111")]
    return [(i, *out[int(k)]) for i, k in enumerate(rng.permutation(len(out)))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang string, __score string, __k1 double").repartition(3)


def test_language_of_a_text_is_its_own(docs, rows):
    model = langid.train(docs.where(~langid.held_out()).select("text", "lang"))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for i, text, _ in rows:
        lang, score = plain_language(model, text)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-5)
    texts = [t for _, t, _ in rows[:40]]
    assert model.predict(texts)[1] == [model.predict([t])[1][0] for t in texts]  # whatever stands next to it


def test_near_duplicates_are_those_of_all_pairs(docs, rows):
    want, links = plain_near([r[:2] for r in rows])
    assert links > 200 and 30 < len(set(want)) < len(rows)
    got = {r.doc_id: r for r in bagminhash.near_duplicates(docs).collect()}
    assert [got[i].component_id for i, *_ in rows] == want
    assert [got[i].kept for i, *_ in rows] == [i == w for (i, *_), w in zip(rows, want, strict=True)]
    first = {}
    for i, t, _ in rows:
        first.setdefault(tuple(plain_words(t)) or i, i)
    assert all(got[i].class_id == first[tuple(plain_words(t)) or i] for i, t, _ in rows)
    assert bagminhash.near_duplicates(docs.limit(0)).count() == 0


def test_recurring_subtrees_are_those_of_a_plain_count(spark):
    """Pages without tell-tale names or classes; well-formed, so that any XML parser gives the tree."""
    rng, pages = np.random.default_rng(2), []
    for i in range(60):
        host = i % 3
        blocks = [f"<div><b>site {host}</b> top {k}</div>" for k in range(3) if rng.random() < 0.6]
        inner = "".join(f"<p>own {i // 6 * 6 if k else i} text {k} &amp; more</p>" + ("<div>block " + str(int(rng.integers(4))) + "</div>") for k in range(3))
        rare = f"<section><div>rare {i // 12} of {host}</div><p>again {host}</p></section>"
        pages.append((i, f"http://h{host}.example/{i}", f"<html><body>{''.join(blocks)}<article><h1>Title {i}</h1>{inner}{rare}</article><div>after {host}</div></body></html>"))
    pages += [(60, "http://two.example/a", "<html><body><div>x</div><p>own a</p></body></html>"), (61, "http://two.example/b", "<html><body><div>x</div><p>own b</p></body></html>"), (62, "http://one.example", "<html><body><div>x</div><p>only</p></body></html>")]
    block = {"div", "p", "section", "article", "h1"}

    def tree(page):
        root = ET.fromstring(page)
        main = root.find(".//article") if root.find(".//article") is not None else root
        prose = {id(y) for y in main.iter() if y.tag == "p"} if main is not root else set()
        return root, main, prose

    def plain_text(x, gone, top=True):
        if not top and id(x) in gone:
            return " "
        own = (x.text or "") + "".join(plain_text(y, gone, False) + (y.tail or "") for y in x)
        return f" {own} " if x.tag in block else own

    def candidates(root, main, prose):
        for x in root.iter():
            if x.tag in block and id(x) not in prose and not any(y.tag in ("article", "h1") for y in x.iter()):
                copy = ET.fromstring(ET.tostring(x).decode()[: ET.tostring(x).decode().rindex(">") + 1])
                yield x, ET.tostring(copy)

    seen, articles = {}, {}
    for _, url, page in pages:
        root, main, prose = tree(page)
        host, text = url.split("/")[2], " ".join(plain_text(main, ()).split())
        articles.setdefault(host, set()).add(text)
        for _, key in candidates(root, main, prose):
            seen.setdefault((host, key), set()).add(text)
    want, lost = {}, 0
    for i, url, page in pages:
        root, main, prose = tree(page)
        host = url.split("/")[2]
        gone = {id(x) for x, key in candidates(root, main, prose) if len(seen[host, key]) >= min(5, max(2, len(articles[host])))}
        want[i] = " ".join(plain_text(main, gone).split())
        lost += want[i] != " ".join(plain_text(main, ()).split())
    assert lost > 30
    got = html_extract.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_pipeline(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = {i: t for i, t, _ in rows}
    long = sorted(i for i, t in text.items() if t and len(plain_words(t)) == 180)
    items = [("a", " ".join(plain_words(text[long[5]])[10:40])), ("b", "the of"), ("c", None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = langid.train(docs.where(~langid.held_out()).select("text", "lang"))
    after, kept, at = [], rows, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}.parquet")
        at = spark.read.parquet(f"{tmp_path}/stage{k}.parquet")
        if k < 4:
            assert at.columns == docs.columns
        after.append(at.collect())
    kept = [r for r in rows if (p := plain_language(model, r[1]))[0] != "und" and p[1] >= 0.2]
    assert sorted(r.doc_id for r in after[0]) == [r[0] for r in kept] and len(kept) > 200
    kept = [r for r, w in zip(kept, plain_near([r[:2] for r in kept])[0], strict=True) if r[0] == w]
    assert sorted(r.doc_id for r in after[1]) == [r[0] for r in kept]
    dirty = {r[0] for r in decontam.brute_force([r[:2] for r in kept], items) if r[5]}
    assert dirty and sorted(r.doc_id for r in after[2]) == [r[0] for r in kept if r[0] not in dirty]
    assert sorted(r.doc_id for r in after[3]) == sorted(r.doc_id for r in after[2])
    assert not any(pii.brute_base(r.text) for r in after[3]) and any("[EMAIL]" in r.text for r in after[3])
    own, pieces, bins = tokenizer(default_vocabulary()).tokenizer, {}, {}
    for r in after[4]:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for r in after[3]:
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(pieces.pop(r.doc_id), key=lambda p: p.piece)
        assert [(p.start, p.length, p.ids_crc32) for p in mine] == [(k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    assert not pieces
    for members in bins.values():
        members.sort(key=lambda p: p.offset)
        assert [p.offset for p in members] == [sum(q.length for q in members[:k]) for k in range(len(members))] and sum(p.length for p in members) <= 4096
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select(names).collect())) == sorted(tuple(r[n] for n in names) for r in after[4])
